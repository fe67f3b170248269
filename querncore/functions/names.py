"""Names in one form: compatibility forms and accents gone, words of a-z and 0-9, legal suffixes off the end."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The block of combining marks that is dropped, and suffixes of companies' names.
MARKS = r"[\x{0300}-\x{036F}]"
SUFFIXES = ["ag", "co", "company", "corp", "corporation", "gmbh", "inc", "incorporated", "ltd", "limited", "llc", "plc"]


#: Texts that are folded at once.
SLICE = 64


@F.arrow_udf(StringType())
def _decomposed(text: pa.Array) -> pa.Array:
    """Unicode's compatibility decomposition (NFKD) without combining marks; null for null. Spark has no such expression. A batch is gone through by slices, so
    that what is made besides it stays small."""
    made = (pc.replace_substring_regex(pc.utf8_normalize(text.slice(k, SLICE), form="NFKD"), MARKS, "") for k in range(0, len(text), SLICE))
    return pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in made)])


def folded(text: Column) -> Column:
    """The text in Unicode's compatibility decomposition (NFKD) without combining marks; null for null. ASCII texts are in it already and do not go to Python."""
    return F.coalesce(_decomposed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalized_name(text: Column, suffixes: list[str] | None = None) -> Column:
    """Words of the folded text, one space between, without legal suffixes at the end; a name of suffixes alone keeps its first. Empty for null."""
    words = F.filter(F.split(folded(F.lower(F.coalesce(text, F.lit("")))), "[^a-z0-9]+"), lambda w: w != "")
    kept = F.transform(words, lambda w, i: F.when((i == 0) | ~w.isin(suffixes or SUFFIXES), i + 1).otherwise(0))
    return F.array_join(F.slice(words, 1, F.coalesce(F.array_max(kept), F.lit(0))), " ")
