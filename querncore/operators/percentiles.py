"""Exact nearest-rank percentiles of groups of any size: ranges of the value, ranked by counts.

Equal values of a group are counted first. The values' ranges are the same for all groups, of about as many rows each; how many of a group's rows stand in
each range tells in which one a rank lies, and only that range's values are put in order. So a task never holds a whole group, only its share of a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at least and at most; in between, so many for each shuffle partition.
FEWEST, MOST, EACH = 16, 4096, 4


def range_of(v: Column, points: list) -> Column:
    """How many of the ascending points are not above the value: found among every 64th point, then among those behind it."""
    if not points:
        return F.lit(0)
    blocks = [points[i : i + 64] for i in range(0, len(points), 64)]
    starts, inner = F.array(*(F.lit(b[0]) for b in blocks)), F.array(*(F.array(*map(F.lit, b)) for b in blocks))
    block = F.size(F.filter(starts, lambda p: p <= v))
    return F.when(block == 0, 0).otherwise((block - 1) * 64 + F.size(F.filter(F.get(inner, block - 1), lambda p: p <= v)))


def same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b)))


def with_percentiles(grouped: DataFrame, percentiles: DataFrame, keys: list[str]) -> DataFrame:
    """A table of one row a group with the percentiles' columns; groups with no value have nulls."""
    if not keys:
        return grouped.join(F.broadcast(percentiles), how="left")  # one row each
    p = percentiles.select(*(F.col(k).alias(f"_p_{k}") for k in keys), *(c for c in percentiles.columns if c not in keys))
    return grouped.join(p, same(keys, [f"_p_{k}" for k in keys]), "left").drop(*(f"_p_{k}" for k in keys))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], ranges: int | None = None) -> DataFrame:
    """A row for each group that has a value: keys and, by name, the value at rank ceil(fraction * n) (1 at least) of its n values in ascending order.

    Nulls and non-finite values are passed over; a null key is a group like others; rows without keys are one group; an empty table gives no rows. The
    points between ranges are approximate percentiles of all values and decide only how the work is dealt.
    """
    spark = df.sparkSession
    own = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    v = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), *([] if keys else [F.lit(0).alias("_all")]), F.col(value).alias("_v")).filter("_v IS NOT NULL")
    if v.schema["_v"].dataType.simpleString() in ("double", "float"):
        v = v.filter(~F.isnan("_v") & (F.abs("_v") != float("inf")))
    n = ranges or min(MOST, max(FEWEST, EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = v.agg(F.percentile_approx("_v", F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(max(10_000, 20 * n)))).first()[0] if n > 1 else None
    counts = v.groupBy(*own, "_v").agg(F.count("*").alias("_n")).withColumn("_r", range_of(F.col("_v"), sorted(set(got or []))))
    spread = counts.groupBy(*own, "_r").agg(F.sum("_n").alias("_in"))
    whole = Window.partitionBy(*own)
    up_to, total = F.sum("_in").over(whole.orderBy("_r")), F.sum("_in").over(whole)
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(float(f)) * F.col("_total")), F.lit(1)).alias("rank")) for name, f in wanted.items())))
    # at most as many rows a group as there are ranges
    at = spread.withColumns({"_upto": up_to, "_total": total}).select(*own, "_r", "_in", "_upto", asked.alias("_a"))
    before = F.col("_upto") - F.col("_in")
    at = at.filter((F.col("_a.rank") > before) & (F.col("_a.rank") <= F.col("_upto")))
    at = at.select(*(F.col(o).alias("_b" + o) for o in own), F.col("_r").alias("_br"), F.col("_a.name").alias("_name"), (F.col("_a.rank") - before).alias("_left"))
    met = counts.join(at, same([*own, "_r"], ["_b" + o for o in own] + ["_br"]))
    run = F.sum("_n").over(Window.partitionBy(*own, "_name").orderBy("_v"))
    picked = met.withColumn("_run", run).filter(F.col("_run") >= F.col("_left")).groupBy(*own).agg(*(F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in wanted))
    return picked.select(*(F.col(o).alias(k) for k, o in zip(keys, own)), *wanted)
