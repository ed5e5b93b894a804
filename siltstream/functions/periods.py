"""Periods of the calendar, given by stamps such as ``"06:00"`` or ``"12-01T00:00:00"``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A stamp's length tells its period; the format that makes times comparable with it.
_FORMS = {2: "ss", 5: "mm:ss", 8: "HH:mm:ss", 11: "dd'T'HH:mm:ss", 14: "MM-dd'T'HH:mm:ss", 19: "yyyy-MM-dd'T'HH:mm:ss"}


def in_period(ts: Column, start: str, end: str, closed: bool = True) -> Column:
    """Whether a time lies in start .. end of every period; start after end runs over the period's turn."""
    form = _FORMS.get(len(start or end))
    if form is None or (start and end and len(start) != len(end)):
        raise ValueError("start and end are stamps of one form, such as HH:MM:SS")
    at = F.date_format(ts, form)
    a = at >= start if closed else at > start
    if not end:
        return a
    b = at <= end if closed else at < end
    if not start:
        return b
    return (a & b) if start <= end else (a | b)
