"""Column expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """A double at so many digits: scaled, rounded half away from zero and scaled back, as the SQL engine does.

    Spark's round judges the shortest decimal of the value: it makes 4.65 of 4.645, where
    4.645 * 100 = 464.49999999999994 rounds to 464. Null, NaN and infinite values stay.
    """
    scale = F.lit(10.0**digits)
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * scale, 0) / scale
