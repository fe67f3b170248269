"""Score cards, agreement, diffs: evaluation of selections against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.functions.numbers import half_up, money, rate_pct
from querncore.operators.percentiles import exact_percentiles, with_percentiles


def taxonomy(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"))


def metrics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """available, total, mean (one decimal), p50, p95 (nearest rank, exact) of the non-null values of each group."""
    total = F.sum(money(F.col(value))).cast("double")
    n = F.count(value)
    sums = df.groupBy(*keys).agg(n.alias("available"), total.alias("total"), half_up(total / n, 1).alias("mean"))
    return with_percentiles(sums, exact_percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95}), keys)


def role_coverage(df: DataFrame, entity: str, role: str, reachable: Column) -> DataFrame:
    """For each role: entities with it, rows, and rates over all entities and over reachable ones (entities with a reachable row)."""
    totals = df.agg(F.countDistinct(entity).alias("all"), F.countDistinct(F.when(reachable, F.col(entity))).alias("reach"))
    by = df.groupBy(role).agg(F.countDistinct(entity).alias("domains"), F.count("*").alias("candidates"), F.countDistinct(F.when(reachable, F.col(entity))).alias("reachable_domains"))
    rows = by.join(F.broadcast(totals))  # one row
    return rows.select(role, "domains", "candidates", rate_pct(F.col("domains"), F.col("all")).alias("all_rate_pct"), rate_pct(F.col("reachable_domains"), F.col("reach")).alias("reachable_rate_pct"))


def score_card(selected: DataFrame, performance: Column, safe_at: float = 0.1) -> DataFrame:
    """A quality score of 100 over one row for each entity: covered, correct, usability (0 to 1), wrong (booleans, doubles; null where
    a slot is not labelled). 30 for coverage, 30 for correctness, 20 for usability, 10 for safety (none at safe_at wrong entities), 10 for
    performance (a fraction). The value is null unless every slot is labelled."""
    n = F.count("*")
    rate = lambda c: F.sum(F.when(c, 1).otherwise(0)) / n
    out = selected.agg(
        n.alias("entities"),
        rate(F.col("covered")).alias("coverage"),
        rate(F.col("correct")).alias("top1"),
        (F.sum(money(F.when(F.col("correct"), F.col("usability")).otherwise(0.0))).cast("double") / n).alias("usability"),
        rate(F.col("wrong")).alias("wrong_rate"),
        F.coalesce(F.every(F.col("correct").isNotNull()), F.lit(False)).alias("complete"),
        performance.alias("efficiency"),
    )
    safety = F.greatest(F.lit(0.0), 1 - F.col("wrong_rate") / F.lit(safe_at))
    value = 30 * F.col("coverage") + 30 * F.col("top1") + 20 * F.col("usability") + 10 * safety + 10 * F.col("efficiency")
    r = lambda c, d=4: half_up(c, d)
    return out.select("entities", r(F.col("coverage")).alias("coverage"), r(F.col("top1")).alias("top1"), r(F.col("usability")).alias("usability"), r(F.col("wrong_rate")).alias("wrong_rate"), r(safety).alias("safety"), r(F.col("efficiency")).alias("efficiency"), "complete", F.when(F.col("complete"), half_up(value, 2)).alias("value"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: n, kappa, status (computed, single_category, insufficient_data). Nulls in either are passed over."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = rows.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("v"), "n"), F.struct(F.lit("b").alias("side"), F.col("b").alias("v"), "n"))).alias("x")).select("x.*")
    marginal = sides.groupBy("v").agg(F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("nb"))
    expected = marginal.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("e"))
    seen = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    both = seen.join(F.broadcast(expected))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    status = F.when(F.col("n") == 0, "insufficient_data").when(F.col("e") == F.col("n") * F.col("n"), "single_category").otherwise("computed")
    return both.select("n", F.when(status == "computed", half_up((po - pe) / (1 - pe), 6)).alias("kappa"), status.alias("status"))


def field_agreement(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each field: compared, agreements, missing_a, missing_b over the full outer join of two reviewers' rows. A missing value is
    not a null one: rows absent on a side count as missing."""
    un = lambda df, v: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x")).select(key, "x.field", F.col("x.v").alias(v), F.lit(True).alias(f"has_{v}"))
    both = un(left, "a").join(un(right, "b"), [key, "field"], "full_outer")
    ok = F.col("has_a") & F.col("has_b")
    return both.groupBy("field").agg(F.count_if(ok).alias("compared"), F.count_if(ok & F.col("a").eqNullSafe(F.col("b"))).alias("agreements"), F.count_if(F.col("has_a").isNull()).alias("missing_a"), F.count_if(F.col("has_b").isNull()).alias("missing_b"))


def confusion(df: DataFrame, expected: str, judged: str) -> DataFrame:
    """expected, judged, n and the precision (percent) of each judgment over all that were judged so."""
    rows = df.groupBy(F.col(expected).alias("expected"), F.col(judged).alias("judged")).agg(F.count("*").alias("n"))
    total = rows.groupBy("judged").agg(F.sum("n").alias("t"))
    return rows.join(total, "judged").select("expected", "judged", "n", rate_pct(F.col("n"), F.col("t")).alias("share_pct"))


def run_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two runs' selections side by side: keys, before, after, change (gained, lost, flipped, stable)."""
    a, b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a")), after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "gained").when(F.col("_b").isNull(), "lost").when(F.col("before").eqNullSafe(F.col("after")), "stable").otherwise("flipped")
    return both.select(*keys, "before", "after", change.alias("change"))


def gain_loss(diff: DataFrame, by: list[str]) -> DataFrame:
    n = lambda c: F.count_if(F.col("change") == c)
    return diff.groupBy(*by).agg(n("gained").alias("gained"), n("lost").alias("lost"), (n("gained") - n("lost")).alias("net"), n("flipped").alias("flipped"), n("stable").alias("stable"), rate_pct(n("flipped"), n("flipped") + n("stable")).alias("flip_rate_pct"))


def change_class(had: Column, has: Column, same_bytes: Column, same_url: Column, same_look: Column, larger: Column) -> Column:
    """The state of an asset between two snapshots, first rule that holds."""
    return (
        F.when(~has & had, "blocked_or_missing_retained")
        .when(~has, "missing_unapproved")
        .when(~had, "new_asset")
        .when(same_bytes & same_url, "unchanged")
        .when(same_bytes, "equivalent_artwork_new_url")
        .when(same_look & larger, "better_quality_same_artwork")
        .when(same_look, "equivalent_artwork_new_bytes")
        .otherwise("possible_rebrand")
    )


def loss_taxonomy(df: DataFrame, keys: list[str], captured: Column, candidate: Column, eligible: Column, selected: Column, correct: Column) -> DataFrame:
    """Why a role's correct asset was not chosen, per group: the first stage at which it was lost."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = df.groupBy(*keys).agg(any_(captured).alias("captured"), any_(selected & correct).alias("hit"), any_(selected).alias("picked"), any_(eligible & correct).alias("ok"), any_(candidate & correct).alias("there"))
    outcome = F.when(~F.col("captured"), "capture_failure").when(F.col("hit"), "selected_correct").when(F.col("ok") & F.col("picked"), "ranking_miss").when(F.col("ok"), "selection_miss").when(F.col("there"), "eligibility_miss").otherwise("no_captured_candidate")
    return flags.select(*keys, outcome.alias("outcome"))


def grouping_metrics(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Metrics over the union of rows of every grouping set (never an average of averages). Absent keys are null; level tells the set: a bit for each key in
    order of names, the last one lowest, set where the key is absent."""
    names = sorted({k for s in sets for k in s})
    level = lambda s: sum(1 << (len(names) - 1 - i) for i, k in enumerate(names) if k not in s)
    kind = {k: df.schema[k].dataType for k in names}
    each = F.array(*(F.struct(F.lit(level(s)).cast("long").alias("level"), *((F.col(k) if k in s else F.lit(None).cast(kind[k])).alias(k) for k in names)) for s in sets))
    rows = df.select(F.explode(each).alias("_g"), F.col(value)).select("_g.*", value)
    keys = [*names, "level"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(money(F.col(value))).cast("double").alias("total"))
    return with_percentiles(sums, exact_percentiles(rows, keys, value, {"p95": 0.95}), keys)
