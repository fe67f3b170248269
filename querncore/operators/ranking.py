"""Winners, capped queues, reserved places: top-k with the rules of candidate selection.

Every order names a unique last key, so results do not depend on the order of rows. All windows are partitioned by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, floor: Column | None = None) -> DataFrame:
    """The first k rows of each group (Spark keeps k rows a partition before the shuffle); floor: a condition rows must meet."""
    rows = df if floor is None else df.filter(floor)
    out = ranked(rows, keys, order, "_rank").filter(F.col("_rank") <= k)
    return out.drop("_rank") if k == 1 else out.withColumnRenamed("_rank", "rank")


def capped_queues(df: DataFrame, entity: list[str], queue: str, caps: dict[str, int], budget: int, order: list[Column]) -> DataFrame:
    """First, in order, rows whose queue still has room while the budget lasts; then the rows passed over fill what is left of
    the budget. Rows without a queue never come. Adds phase (1 or 2) and place (from 1)."""
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    rows = df.filter(F.col(queue).isNotNull())
    rows = ranked(ranked(rows, entity, order, "_at"), [*entity, queue], order, "_in_queue")
    fits = F.col("_in_queue") <= cap[F.col(queue)]
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    running = F.sum(F.col("_fits").cast("int")).over(Window.partitionBy(*entity).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("phase", F.when(F.col("_fits") & (running <= budget), 1).otherwise(2))
    rows = ranked(rows, entity, [F.col("phase"), F.col("_at")], "place").filter(F.col("place") <= budget)
    return rows.drop("_at", "_in_queue", "_fits")


def reserve_then_fill(df: DataFrame, entity: list[str], eligible: Column, reserve: int, budget: int, order: list[Column]) -> DataFrame:
    """The first ``reserve`` eligible rows, then the others in order up to the budget. Adds reserved and place."""
    rows = df.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    rows = ranked(rows, [*entity, "_eligible"], order, "_n")
    rows = rows.withColumn("reserved", F.col("_eligible") & (F.col("_n") <= min(reserve, budget)))
    return ranked(rows, entity, [F.desc("reserved"), *order], "place").filter(F.col("place") <= budget).drop("_eligible", "_n")


def winner_with_fallback(df: DataFrame, keys: list[str], primary: Column, fallback: Column, order: list[Column], value: str) -> DataFrame:
    """Per group: the best row that meets primary, else the best that meets fallback, else null. One pass: both winners are picked
    by one aggregate. Columns: keys, winner, via."""
    tagged = df.withColumn("_tier", F.when(primary, 1).when(fallback, 2)).filter(F.col("_tier").isNotNull())
    best = top(tagged, keys, [F.col("_tier"), *order])
    every = df.select(*keys).distinct()
    out = every.join(best.select(*keys, F.col(value).alias("winner"), "_tier"), keys, "left")
    return out.select(*keys, "winner", F.when(F.col("_tier") == 1, "primary").when(F.col("_tier") == 2, "fallback").otherwise("none").alias("via"))


def displacement(df: DataFrame, keys: list[str], displaceable: Column, declared: Column, protected: Column, corroborates: Column, order: list[Column], value: str) -> DataFrame:
    """The staged decision on a group's winner. A displaceable winner yields to the best declared row unless it is protected and no row
    corroborates the declared one; then the choice abstains and the winner stays. Columns: keys, winner, action."""
    rows = ranked(df.withColumn("_displaceable", F.coalesce(displaceable, F.lit(False))).withColumn("_declared", F.coalesce(declared, F.lit(False))).withColumn("_protected", F.coalesce(protected, F.lit(False))).withColumn("_cor", F.coalesce(corroborates, F.lit(False))), keys, order, "_rank")
    first = F.col("_rank") == 1
    found = rows.groupBy(*keys).agg(
        F.max(F.when(first, F.col(value))).alias("w"),
        F.bool_or(first & F.col("_displaceable")).alias("weak"),
        F.bool_or(first & F.col("_protected")).alias("safe"),
        F.min_by(F.col(value), F.when(F.col("_declared"), F.col("_rank"))).alias("d"),
        F.bool_or("_declared").alias("has"),
        F.bool_or("_cor").alias("cor"),
    )
    act = F.when(~F.col("weak") | ~F.col("has"), "ranked").when(~F.col("safe") | F.col("cor"), "displaced").otherwise("abstained")
    return found.select(*keys, F.when(act == "displaced", F.col("d")).otherwise(F.col("w")).alias("winner"), act.alias("action"))
