"""When a cell counts as missing, how words are compared, and which rows of two tables belong together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on keys and time. A key that is null equals a null key, as it does in windows; of the columns ``on`` there is one each."""
    other = right.withColumnsRenamed({c: f"__of_{c}" for c in on})
    out = left.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on]), how)
    if how == "full_outer":
        out = out.withColumns({c: F.coalesce(c, f"__of_{c}") for c in on})
    return out.drop(*(f"__of_{c}" for c in on))


def number(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """The value, or null where it is missing: null, NaN, or a whole number outside low..high (a logger's code)."""
    code = (value == F.floor(value)) & ((value < low) | (value > high))
    infinite = F.abs(value) == float("inf")
    return F.when(value.isNull() | F.isnan(value) | infinite | code, None).otherwise(value)


def word(value: Column) -> Column:
    """A word without case, outer blanks, and with one blank for blanks, ``_`` or ``-`` between its parts."""
    return F.trim(F.regexp_replace(F.lower(value), r"[\s_\-]+", " "))
