"""Registrable domains by a list of public suffixes.

Rules are text, one a row, as such lists have them: ``co.uk``; ``*.ck`` for any one label before ck; ``!www.ck`` for a name that a wildcard does not take.
An exception goes before all, then the rule with most labels; a name that no rule takes has its last label as suffix. The domain is the suffix and one label
more; names that are a suffix, have one label or are IP addresses have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.functions import pages

#: Rules up to so many are broadcast, some megabytes; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def clean_host(host: Column) -> Column:
    """Lower case, without a port or a trailing dot; null for what is no name."""
    h = F.regexp_replace(F.lower(F.trim(host)), r"(:\d+)?\.?$", "")
    ok = h.rlike(r"^[^\s\[\]:/@]+$") & ~h.rlike(r"^\d+(\.\d+){3}$") & ~h.rlike(r"(^\.)|(\.\.)")
    return F.when(ok, h)


def with_registrable(df: DataFrame, url: str, rules: DataFrame, rule: str = "rule", out: str = "registrable", is_host: bool = False) -> DataFrame:
    """df with the registrable domain of a URL's host (null where there is none).

    Rules are parted by how many labels they have, and each part is joined once to the last labels of the host: as many joins as the longest rule has labels,
    on a broadcast table, so rows do not move and a host that most rows share costs nothing more. Null and empty rules are not read; rules that repeat count once.
    """
    text = F.lower(F.trim(F.col(rule)))
    r = rules.select(text.alias("r")).filter("r IS NOT NULL AND r != ''").distinct()
    bare = F.regexp_replace("r", r"^(!|\*\.)", "")
    kind = F.when(F.col("r").startswith("!"), 2).when(F.col("r").startswith("*."), 1).otherwise(0)
    r = r.select(bare.alias("_name"), kind.alias("k")).groupBy("_name").agg(F.bool_or(F.col("k") == 0).alias("_plain"), F.bool_or(F.col("k") == 1).alias("_wild"), F.bool_or(F.col("k") == 2).alias("_but")).withColumn("_n", F.size(F.split("_name", r"\.")))
    size = r.agg(F.count("*"), F.max("_n")).first()
    host = clean_host(F.col(url) if is_host else pages.host(F.col(url)))
    df = df.withColumn("_labels", F.split(host, r"\."))
    n = F.size("_labels")
    best = []  # (exception or not, labels of the suffix) of each rule that takes the host
    for k in range(1, (size[1] or 0) + 1):
        part = r.filter(F.col("_n") == k).select(F.col("_name").alias(f"_name{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("_plain", "_wild", "_but")))
        last = F.when(n >= k, F.array_join(F.slice("_labels", n - (k - 1), k), "."))
        df = df.withColumn(f"_key{k}", last)
        df = df.join(F.broadcast(part) if size[0] <= BROADCAST_RULES else part, F.col(f"_key{k}") == F.col(f"_name{k}"), "left")
        best += [F.when(F.col(f"_but{k}"), 1000 + k - 1), F.when(F.col(f"_wild{k}") & (n > k), k + 1), F.when(F.col(f"_plain{k}"), k)]
    taken = F.coalesce(F.array_max(F.array(F.lit(None).cast("int"), *best)), F.lit(1)) % 1000
    found = F.when(n > taken, F.array_join(F.slice("_labels", n - taken, taken + 1), "."))
    drop = ["_labels", *(f"{c}{k}" for k in range(1, (size[1] or 0) + 1) for c in ("_name", "_plain", "_wild", "_but", "_key"))]
    return df.withColumn(out, F.when(F.col("_labels").isNotNull(), found)).drop(*drop)
