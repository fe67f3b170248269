"""Identifiers and deterministic orders, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nul() -> Column:
    return F.expr("char(0)")


def joined(*parts: Column) -> Column:
    """Parts with a NUL character between them."""
    out: list[Column] = []
    for p in parts:
        out += [nul(), p] if out else [p]
    return F.concat(*out)


def candidate_id(entity: Column, identity: Column, source: Column) -> Column:
    """The run-level id of a candidate: 16 hex digits."""
    return F.left(F.sha2(joined(entity, identity, source), 256), F.lit(16))


def captured_id(entity: Column, identity: Column) -> Column:
    """The capture-level id of a candidate: a prefix and 24 hex digits."""
    return F.concat(F.lit("candidate-"), F.left(F.sha2(joined(entity, identity), 256), F.lit(24)))


def seeded_key(seed: str, value: Column) -> Column:
    """The hex key that a seeded order sorts by."""
    return F.sha2(joined(F.lit(seed), value), 256)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII text, as a non-negative bigint. The offset basis and prime are the algorithm's."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("bigint"))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    letters = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(letters, F.lit(2166136261).cast("bigint"), step)


def review_id(prefix: str, text: Column) -> Column:
    """prefix and the eight lower-case hex digits of the hash."""
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(fnv1a32(text))), 8, "0"))


def rows_digest(rows: Column) -> Column:
    """The digest of an array of structs: sha256 of their JSON, in the array's order and the structs' field order."""
    return F.sha2(F.to_json(rows), 256)
