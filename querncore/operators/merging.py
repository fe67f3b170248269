"""Runs of several workers become one: each entity belongs to one run, each key stands once; what breaks either is reported and goes into no table.

Records: run, record_type, entity, key and any other columns. Owners: run, entity. A conflict is a row of kind, record_type, key, entity, runs (sorted), n:

* overlapping_ownership: an entity that several runs own; none of its records is merged
* outside_owned: records whose run does not own their entity
* duplicate_key: records of one type that share a key, all of them

An entity with no owner has all its records outside. Records of no entity (null) belong to no one and are checked for their key alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that are made up here.
OWNER, OWNERS, COUNT, RUNS = "_owner", "_owners", "_n", "_runs"


def ownership(owners: DataFrame) -> DataFrame:
    """A row for each entity: its owner (the smallest), and how many own it."""
    once = owners.select("run", "entity").filter("entity IS NOT NULL").distinct()
    return once.groupBy("entity").agg(F.min("run").alias(OWNER), F.count("*").alias(OWNERS), F.array_sort(F.collect_set("run")).alias(RUNS))  # runs: as many as workers


def overlaps(owners: DataFrame) -> DataFrame:
    """Entities that several runs own."""
    rows = ownership(owners).filter(F.col(OWNERS) > 1)
    none = F.lit(None).cast("string")
    return rows.select(F.lit("overlapping_ownership").alias("kind"), none.alias("record_type"), none.alias("key"), F.col("entity").cast("string").alias("entity"), F.col(RUNS).cast("array<string>").alias("runs"), F.col(OWNERS).alias("n"))


def judged(records: DataFrame, owners: DataFrame) -> DataFrame:
    """Records with _fault: null where a record may stay.

    The owner's row is the one side of a join that adaptive execution splits where an entity has most records; keys are counted in parts before they are shuffled.
    """
    own = ownership(owners).drop(RUNS)
    keyed = records.groupBy("record_type", "key").agg(F.count("*").alias(COUNT)).withColumnsRenamed({"record_type": "_type", "key": "_key"}).filter(F.col(COUNT) > 1)
    rows = records.join(own, "entity", "left")
    rows = rows.join(keyed, F.col("record_type").eqNullSafe(F.col("_type")) & F.col("key").eqNullSafe(F.col("_key")), "left")
    outside = F.col("entity").isNotNull() & (F.col(OWNER).isNull() | ~F.col("run").eqNullSafe(F.col(OWNER)))
    fault = F.when(F.col(OWNERS) > 1, "overlapping_ownership").when(outside, "outside_owned").when(F.col(COUNT).isNotNull(), "duplicate_key")
    return rows.withColumn("_fault", fault).select(*records.columns, "_fault")


def merged(records: DataFrame, owners: DataFrame) -> DataFrame:
    """The records that may stay."""
    return judged(records, owners).filter("_fault IS NULL").drop("_fault")


def conflicts(records: DataFrame, owners: DataFrame) -> DataFrame:
    """What is refused: a row for each entity with several owners, each key outside and each key that repeats. A record counts for the first of its faults, in
    that order."""
    rows = judged(records, owners).filter("_fault IN ('outside_owned', 'duplicate_key')")
    by = rows.groupBy(F.col("_fault").alias("kind"), "record_type", F.col("key").cast("string").alias("key"), F.col("entity").cast("string").alias("entity"))
    out = by.agg(F.array_sort(F.collect_set(F.col("run").cast("string"))).alias("runs"), F.count("*").alias("n"))
    return overlaps(owners).unionByName(out)


def per_type(records: DataFrame, owners: DataFrame) -> DataFrame:
    """record_type, merged, overlapping, outside, duplicate: counts that add up to the type's records."""
    n = lambda c: F.count_if(c)
    f = F.col("_fault")
    return judged(records, owners).groupBy("record_type").agg(n(f.isNull()).alias("merged"), n(f == "overlapping_ownership").alias("overlapping"), n(f == "outside_owned").alias("outside"), n(f == "duplicate_key").alias("duplicate"))
