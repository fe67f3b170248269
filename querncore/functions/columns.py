"""How long chains of derived columns are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows; columns worked out so far are not worked out anew in what follows. Spark inlines no expression across a generator, so plans stay as
    small as the rules are written, where inlined rules over rules grow beyond what the optimiser can go through. The row is a column of its own before it is
    exploded: what is worked out inside a generator is interpreted row by row, what is worked out before it is compiled."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("c")).select(F.explode(F.array("c")).alias("c")).select("c.*")
