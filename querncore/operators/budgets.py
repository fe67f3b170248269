"""Budgets, windows from a first event, freshness, caches."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(df: DataFrame, keys: list[str], cost: Column, order: list[Column], budget: float) -> DataFrame:
    """Rows, in order, whose running cost stays within the budget. Adds spent."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost.cast("decimal(18,4)")).over(w).cast("double")).filter(F.col("spent") <= budget)


def aligned_limit(df: DataFrame, key: str, ts: str, window: str, limit: int) -> DataFrame:
    """Counts per key and aligned window: key, start, n, allowed, refused."""
    out = df.groupBy(key, F.date_trunc(window, F.col(ts).cast("timestamp")).alias("start")).agg(F.count("*").alias("n"))
    return out.select(key, "start", "n", F.least(F.col("n"), F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def first_event_limit(df: DataFrame, key: str, ts: str, tie: str, seconds: float, limit: int) -> DataFrame:
    """A window opens at a key's first event and lasts so many seconds; the next event after it opens another. Adds allowed and remaining.
    Each window depends on the one before, so a key's events are walked in order, in batches as Arrow brings them."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ts, tie])
        reset, n, out = None, 0, []
        for t in rows[ts]:
            if reset is None or t >= reset:
                reset, n = t + pd.Timedelta(seconds=seconds), 0
            n += 1
            out.append(n)
        count = pd.Series(out, index=rows.index, dtype="int64")
        return rows.assign(allowed=count <= limit, remaining=(limit - count).clip(lower=0))

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())])
    return df.groupBy(key).applyInPandas(walk, schema)


def freshness(age_days: Column, fresh: float, stale: float) -> Column:
    return F.when(age_days.isNull(), "miss").when(age_days <= fresh, "fresh").when(age_days <= stale, "stale").otherwise("miss")


def cache_replay(df: DataFrame, shard: str, key: str, ts: str, size: str, ttl: float, most_bytes: int, most_entries: int = 1 << 30, lru: bool = True) -> DataFrame:
    """Replays accesses of each shard against a cache with a time to live and a byte (and entry) limit, evicting the least recently used, or
    first come first out. Adds hit. An access that misses stores its entry unless it is larger than the cache."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ts, key])
        held: OrderedDict = OrderedDict()
        used, hits = 0, []
        for k, t, n in zip(rows[key], rows[ts].astype("int64") / 1e9 if rows[ts].dtype.kind == "M" else rows[ts], rows[size]):
            entry = held.get(k)
            hit = entry is not None and t < entry[0]
            if entry is not None and not hit:
                used -= held.pop(k)[1]
            if hit and lru:
                held.move_to_end(k)
            if not hit and n <= most_bytes:
                held[k] = (t + ttl, n)
                used += n
                while used > most_bytes or len(held) > most_entries:
                    used -= held.popitem(last=False)[1][1]
            hits.append(hit)
        return rows.assign(hit=hits)

    from pyspark.sql import types as T

    return df.groupBy(shard).applyInPandas(replay, T.StructType([*df.schema.fields, T.StructField("hit", T.BooleanType())]))


def coalesced(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Requests for one key that overlap in time share one fetch: key, fetch_start, fetch_end, requests."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", (before.isNull() | (F.col(start) >= before)).cast("int"))
    rows = rows.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_n").agg(F.min(start).alias("fetch_start"), F.max(end).alias("fetch_end"), F.count("*").alias("requests")).drop("_n")
