"""Deterministic splits, shards, samples.

A global seeded order is a sort by sha256 keys. These are uniform hex strings, so their first digits cut the order into equal
buckets: a row's rank is its bucket's offset (a sum over at most 4096 counts) plus its place in the bucket. Nothing is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querncore.functions.ids import seeded_key
from querncore.functions.numbers import half_up

DIGITS = 3


def seeded_rank(df: DataFrame, key: Column, tie: Column, name: str = "at") -> DataFrame:
    """Adds the row's place, from 0, in the order of (key, tie) over the whole table, and _total, the number of rows. key: uniform lower-case hex."""
    rows = df.withColumn("_key", key).withColumn("_tie", tie).withColumn("_bucket", F.left("_key", F.lit(DIGITS)))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    whole = Window.orderBy("_bucket")  # 4096 rows at most
    offsets = sizes.select("_bucket", (F.sum("_n").over(whole) - F.col("_n")).alias("_before"), F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    rows = rows.join(F.broadcast(offsets), "_bucket")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "_tie"))
    return rows.withColumn(name, F.col("_before") + place - 1).drop("_key", "_tie", "_bucket", "_before")


def assign_splits(df: DataFrame, id_col: str, seed: str, shards: int = 10, overlap: float = 0.2) -> DataFrame:
    """benchmark_split (60/20/20 along the seeded order), capture_shard (contiguous), qa_overlap (a share drawn over all rows by a second order)."""
    value = F.col(id_col).cast("string")
    rows = seeded_rank(df, seeded_key(seed, value), value, "at")
    n = F.col("_total")
    dev, val = half_up(n * 0.6), half_up(n * 0.2)
    rows = rows.withColumn("benchmark_split", F.when(F.col("at") < dev, "development").when(F.col("at") < dev + val, "validation").otherwise("evaluation"))
    size = F.greatest(F.lit(1), F.ceil(n / shards))
    rows = rows.withColumn("capture_shard", F.least(F.lit(shards - 1), F.floor(F.col("at") / size)).cast("int"))
    rows = seeded_rank(rows.drop("_total"), seeded_key(f"{seed}\0overlap", value), value, "_second")
    return rows.withColumn("qa_overlap", F.col("_second") < half_up(F.col("_total") * overlap)).drop("_second", "_total")


def holdout(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """Adds held_out: the first n rows of the seeded order."""
    value = F.col(id_col).cast("string")
    return seeded_rank(df, seeded_key(seed, value), value, "_at").withColumn("held_out", F.col("_at") < n).drop("_at", "_total")


def of_split(df: DataFrame, assigned: DataFrame, id_col: str, split: str, shard: int | None = None) -> DataFrame:
    """The rows of entities of one split, or of one of its shards: a semi-join with what ``assign_splits`` gave."""
    chosen = assigned.filter(F.col("benchmark_split") == split)
    chosen = chosen if shard is None else chosen.filter(F.col("capture_shard") == shard)
    return df.join(chosen.select(id_col), id_col, "left_semi")


def hash_bucket(value: Column, buckets: int = 10) -> Column:
    """The first 32 bits of sha256, modulo the buckets."""
    return F.conv(F.left(F.sha2(value, 256), F.lit(8)), 16, 10).cast("bigint") % buckets


def stratified_round_robin(df: DataFrame, stratum: str, within: list[Column], n: int) -> DataFrame:
    """One row of each stratum in turn, strata by name, until n rows are drawn. Only n rows of a stratum survive the first window."""
    rows = df.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*within))).filter(F.col("turn") <= n)
    return rows.orderBy("turn", stratum).limit(n)
