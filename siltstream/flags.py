"""The flag domain, and how flags are written and read."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNFLAGGED, GOOD, DOUBTFUL, BAD = -math.inf, 0.0, 25.0, 255.0
FILTER_ALL, FILTER_NONE = -math.inf, math.inf


def is_flagged(flag: Column, limit: float) -> Column:
    """Whether a flag hides its value at a filter limit; rows never touched by a test are unflagged."""
    flag = F.coalesce(flag, F.lit(UNFLAGGED))
    return flag > UNFLAGGED if limit == FILTER_ALL else flag >= F.lit(limit)


def squeeze(hist: Column, how: str = "last", start: int = 0, raw: bool = False) -> Column:
    """One flag from the history of tests from position ``start``: the last that was set, or the greatest or least."""
    part = F.slice(hist, F.lit(start + 1), F.greatest(F.size(hist) - start, F.lit(0))) if start else hist
    part = F.filter(part, lambda x: x.isNotNull())
    if how == "last":
        out = F.try_element_at(part, F.lit(-1))
    elif how in ("max", "min"):
        out = (F.array_max if how == "max" else F.array_min)(part)
    else:
        raise ValueError("history is squeezed by last, max or min")
    return out if raw else F.coalesce(out, F.lit(UNFLAGGED))
