"""Label expansion and slot adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjudicate_slots(candidates: DataFrame, labels: DataFrame, entity: str, candidate: str, role: str, label_key: str, verdict: Column, own: str = "icon", stand_in: str = "favicon") -> DataFrame:
    """candidate, slot, verdict: a candidate of the role ``stand_in`` stands in the slot ``own`` where its entity has no candidate of its own for it; others stand in
    their role's slot. verdict: over the label's columns; candidates without a label are unlabelled. The entity's flag is an aggregate joined back, so an entity with many
    candidates is counted in parts. Labels are one a key."""
    flags = candidates.groupBy(entity).agg(F.coalesce(F.bool_or(F.col(role) == own), F.lit(False)).alias("_own"))
    rows = candidates.join(flags, entity).join(labels.withColumn("_has", F.lit(True)), F.col(candidate) == F.col(label_key), "left")
    slot = F.when((F.col(role) == stand_in) & ~F.col("_own"), own).otherwise(F.col(role))
    return rows.select(candidate, slot.alias("slot"), F.when(F.col("_has").isNull(), "unlabelled").otherwise(verdict).alias("verdict"))


def expand_omitted(items: DataFrame, labels: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """A row for each item and role; what reviewers left out counts as not correct. Columns: key, role, correct, omitted."""
    rows = items.join(labels.select(key, *roles, F.lit(True).alias("_has")), key, "left")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(r) == 1, F.lit(False)).alias("correct")) for r in roles]))
    return rows.select(key, each.alias("x"), F.col("_has").isNull().alias("omitted")).select(key, "x.role", "x.correct", "omitted")


def apply_adjudications(labels: DataFrame, corrections: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """labels with corrected values, and the conflicts: corrections (key, original, corrected) whose original is not what the label holds, or
    whose key no label has. Conflicting corrections are not applied."""
    c = corrections.select(key, F.col("original").alias("_original"), F.col("corrected").alias("_corrected"), F.lit(True).alias("_c"))
    both = labels.withColumn("_l", F.lit(True)).join(c, key, "full_outer")
    fits = F.col("_c").isNotNull() & F.col("_l").isNotNull() & F.col(value).eqNullSafe(F.col("_original"))
    fixed = both.filter("_l is not null").withColumn(value, F.when(fits, F.col("_corrected")).otherwise(F.col(value))).select(*labels.columns)
    conflicts = both.filter(F.col("_c").isNotNull() & ~fits).select(key, F.when(F.col("_l").isNull(), "no_label").otherwise("changed_since").alias("problem"))
    return fixed, conflicts
