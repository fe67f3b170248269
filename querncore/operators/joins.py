"""Joins with the checks that go with them: exact cover, foreign keys, aliases, validity, near sizes, fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cover_violations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks: keys, missing_in (left or right). Empty if the sides cover each other."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("missing_in", F.lit("left")).unionByName(a.join(b, keys, "left_anti").withColumn("missing_in", F.lit("right")))


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """rule, key, n: the child's keys without a parent, with their rows. Counted before the join, so that it shuffles keys once each."""
    keys = child.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    return keys.join(parent.select(F.col(parent_key).cast("string").alias("key")), "key", "left_anti").select(F.lit(rule).alias("rule"), "key", "n")


def unambiguous_aliases(rows: DataFrame, alias: Column, owner: Column) -> DataFrame:
    """alias, owner of the aliases that have one owner only."""
    return rows.groupBy(alias.alias("alias")).agg(F.countDistinct(owner).alias("_n"), F.min(owner).alias("owner")).filter("_n = 1").drop("_n")


def validity(rank: Column, start: Column, end: Column, ended: Column, point: Column, now: Column) -> Column:
    """The state of a statement at a time, from the earliest moment of its start and the latest of its end."""
    return (
        F.when(rank == "deprecated", "invalid")
        .when(ended, "ended")
        .when(start > now, "future")
        .when(end <= now, "ended")
        .when(point & start.isNull() & end.isNull(), "historical_point_in_time")
        .otherwise("current")
    )


def preferred_then_unique(rows: DataFrame, keys: list[str], preferred: Column, value: str) -> DataFrame:
    """Per group: the preferred rows if there are any, else all; their single value, or null and ambiguous. Columns: keys, files, chosen, ambiguous."""
    best = F.max(preferred.cast("int")).over(Window.partitionBy(*keys))
    kept = rows.withColumn("_best", best).filter(F.coalesce(preferred, F.lit(False)).cast("int") == F.coalesce("_best", F.lit(0)))
    out = kept.groupBy(*keys).agg(F.countDistinct(value).alias("files"), F.min(value).alias("_v"))
    return out.select(*keys, "files", F.when(F.col("files") == 1, F.col("_v")).alias("chosen"), (F.col("files") > 1).alias("ambiguous"))


def near(a: Column, b: Column, share: float = 0.12, least: float = 4.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(least), F.lit(share) * F.greatest(a, b))


def near_pairs(rows: DataFrame, keys: list[str], x: str, y: str, id_col: str, cell: float = 0.12, least: float = 4.0) -> DataFrame:
    """Pairs within a group (a < b by id) whose x and y are near each other. A range join by cells of both: values are put on a scale on which near ones
    differ by one cell at most, even up to the least distance's bound and logarithmic beyond, each row looks into its own and half of the cells around it, so
    that every pair of cells meets once, and equal cells are joined by a hash. Rows are dealt over a fixed number of tasks: pairs, not rows, are the work,
    and tables too small for more than a task or two may hold most of it."""
    bound, width = least / cell, math.log(1 / (1 - cell)) * (1 + 1e-9)
    scale = lambda v: F.when(v <= bound, v / bound / width).otherwise((1 + F.log(v / bound)) / width)
    at = lambda c: F.floor(scale(F.col(c).cast("double")))
    tasks = max(8 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = rows.select(*keys, F.col(id_col).alias("_p"), F.col(x).alias("_px"), F.col(y).alias("_py"), at(x).alias("_cx"), at(y).alias("_cy"), F.lit(False).alias("_own"))
    cells = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    around = F.explode(F.array(*(F.struct((F.col("_cx") + i).alias("_cx"), (F.col("_cy") + j).alias("_cy"), F.lit((i, j) == (0, 0)).alias("_own")) for i, j in cells)))
    other = base.select(*keys, F.col("_p").alias("_q"), F.col("_px").alias("_qx"), F.col("_py").alias("_qy"), around.alias("_c")).select(*keys, "_q", "_qx", "_qy", "_c.*")
    meet = [*keys, "_cx", "_cy"]
    met = base.drop("_own").repartition(tasks, *meet).join(other.repartition(tasks, *meet), meet)
    # in one cell each pair is met from both sides
    ok = near(F.col("_px"), F.col("_qx"), cell, least) & near(F.col("_py"), F.col("_qy"), cell, least) & F.when(F.col("_own"), F.col("_p") < F.col("_q")).otherwise(F.col("_p") != F.col("_q"))
    return met.filter(ok).select(*keys, F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"))


def sign_bits(vector: str, first: int = 32) -> Column:
    """The signs of a vector's first components as the bits of a number, the first lowest."""
    bit = F.transform(F.slice(F.col(vector), 1, first), lambda v, i: F.when(v > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("bigint"))
    return F.aggregate(bit, F.lit(0).cast("bigint"), lambda s, b: s + b)


def catalog_match(rows: DataFrame, fingerprint: str, catalog: DataFrame, catalog_fp: str, order: str, most: int = 4, limit: int = 100_000) -> DataFrame:
    """Adds match (the first catalogue entry within a Hamming distance) and distance. The catalogue is a small reviewed table; more than
    ``limit`` rows are refused, as every row meets every entry."""
    if catalog.limit(limit + 1).count() > limit:
        raise ValueError(f"a fingerprint catalogue of more than {limit} entries is not broadcast")
    entries = catalog.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(catalog_fp).alias("f")))).alias("_entries"))
    met = rows.join(F.broadcast(entries))
    d = lambda e: F.bit_count(F.col(fingerprint).bitwiseXOR(e["f"]))
    first = F.get(F.filter("_entries", lambda e: d(e) <= most), F.lit(0))
    return met.withColumn("_m", first).withColumn("match", F.col("_m.o")).withColumn("distance", F.bit_count(F.col(fingerprint).bitwiseXOR(F.col("_m.f")))).drop("_m", "_entries")


def replay_novel(candidates: DataFrame, seen: DataFrame, hash_col: str, url_cols: list[str], entity: list[str] | None = None) -> DataFrame:
    """Candidates whose hash has not been seen, and none of whose URLs is any URL that has been (of the same entity): an anti-join a key instead of a
    disjunction. Null hashes and URLs match nothing."""
    own = entity or []
    known = seen.select(*own, F.explode(F.array(*(c for c in url_cols if c in seen.columns))).alias("_u")).filter("_u is not null").distinct()
    out = candidates.join(seen.select(*own, hash_col), [*own, hash_col], "left_anti")
    for c in url_cols:
        out = out.join(known.withColumnRenamed("_u", c), [*own, c], "left_anti")
    return out.select(*candidates.columns)


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base with the rows of new in place of those with the same key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


#: Entries of a catalogue that is broadcast; a larger one is joined by a shuffle.
CATALOGUE_ENTRIES = 100_000


def reviewed_hashes(df: DataFrame, content_hash: str, catalogue: DataFrame) -> DataFrame:
    """df with reviewed: struct<reason, owners, owner_domains> of the catalogue's entry (sha256, reason, owners, owner_domains) for a row's hash, null where it has
    none. Of entries that repeat a hash the last reason in order counts; no list of owners or domains is an empty one."""
    none = F.array().cast("array<string>")
    entry = F.struct("reason", F.coalesce("owners", none).alias("owners"), F.coalesce("owner_domains", none).alias("owner_domains"))
    known = catalogue.filter("sha256 IS NOT NULL").groupBy(F.col("sha256").alias("_sha256")).agg(F.max(entry).alias("reviewed"))
    small = known.limit(CATALOGUE_ENTRIES + 1).count() <= CATALOGUE_ENTRIES
    return df.join(F.broadcast(known) if small else known, F.col(content_hash) == F.col("_sha256"), "left").drop("_sha256")
