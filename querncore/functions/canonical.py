"""Canonical text of nested values: equal values have equal texts, whatever the order of an object's keys or an array's items was."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(c: Column, kind: T.DataType) -> Column:
    """JSON of a typed value: fields of structs and keys of maps in order of their names, items of arrays in order of their texts. A null is null; a field that is
    null stays, as null."""
    text = body(c, kind)
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def leaf(c: Column) -> Column:
    """The JSON of one plain value, taken out of an array of one."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def body(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{name_text(f.name)}:"), canonical(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(c, lambda x: canonical(x, kind.elementType))), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.concat(leaf(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType))
        return F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(c), entry)), ","), F.lit("}"))
    return leaf(c)


def name_text(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)
