"""Windows of bounded reach over series of any length.

A window partitioned by a series' key runs in one task. Where a window reaches at most so far in
time, the series is cut into stretches instead, each with copies of the rows that its windows
still need, so that a series holding a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..frame import Series


def bounded(s: Series, reach: int, split: int, fn: Callable[[Series], Series]) -> Series:
    """``fn`` applied to stretches of ``split`` microseconds; its result at a row may depend on rows up to ``reach`` away, and on nothing else."""
    if reach * 2 > split:
        return fn(s)
    around = F.sequence(F.floor((F.col("t") - reach) / split), F.floor((F.col("t") + reach) / split))
    cut = s.df.withColumn("__own", F.floor(F.col("t") / split)).withColumn("__part", F.explode(around))
    out = fn(Series(cut, (*s.keys, "__part")))
    return Series(out.df.filter("__own = __part").drop("__own", "__part"), s.keys)


def near(s: Series, reach: int, split: str | bool | None, fn: Callable[[Series], Series]) -> Series:
    """The same for scans (``operators.vector.scan``), for which short stretches cost nothing: eight times the reach, a day at least. split None: not cut."""
    return bounded(s, reach, max(8 * reach, 86_400_000_000), fn) if split else fn(s)
