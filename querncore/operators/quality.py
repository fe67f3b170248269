"""Data-quality rules. Each gives rows (rule, key); violations() is the union. Nothing is thrown: a table without rows is a clean one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[DataFrame], DataFrame]


def _rows(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def satisfies(rule: str, key: str, condition: Column) -> Rule:
    """Rows for which the condition is false (null passes)."""
    return lambda df: _rows(df.filter(~condition), rule, key)


def required(rule: str, key: str, *cols: str) -> Rule:
    return lambda df: _rows(df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])), rule, key)


def in_set(rule: str, key: str, col: str, allowed: list) -> Rule:
    return lambda df: _rows(df.filter(~F.coalesce(F.col(col).isin(*allowed), F.lit(False))), rule, key)


def unique(rule: str, col: str) -> Rule:
    return lambda df: _rows(df.groupBy(col).agg(F.count("*").alias("_n")).filter("_n > 1"), rule, col)


def reference(rule: str, key: str, col: str, parent: DataFrame, parent_key: str) -> Rule:
    return lambda df: _rows(df.filter(F.col(col).isNotNull()).join(parent.select(F.col(parent_key).alias(col)), col, "left_anti"), rule, key)


def exactly_one(rule: str, keys: list[str], flag: Column) -> Rule:
    """Groups in which not exactly one row has the flag."""
    return lambda df: _rows(df.groupBy(*keys).agg(F.count_if(flag).alias("_n")).filter("_n <> 1").withColumn("_key", F.concat_ws("|", *keys)), rule, "_key")


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [r(df) for r in rules])
