"""Lengths of time, given as offset strings, in microseconds."""

from __future__ import annotations

import re
from datetime import timedelta

#: Microseconds of each unit.
UNITS = {"us": 1, "ms": 10**3, "s": 10**6, "min": 60 * 10**6, "t": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}


def micros(span: str | timedelta) -> int:
    """``"90min"``, ``"1D12h"`` or a timedelta in microseconds."""
    if isinstance(span, timedelta):
        return span // timedelta(microseconds=1)
    parts = re.findall(r"(\d*\.?\d*)\s*([A-Za-z]+)", span)
    if not parts or re.sub(r"(\d*\.?\d*)\s*([A-Za-z]+)", "", span).strip():
        raise ValueError(f"{span!r} is no length of time")
    total = 0.0
    for n, unit in parts:
        key = unit.lower()
        if key not in UNITS:
            raise ValueError(f"{unit!r} is no unit of fixed length")
        total += float(n or 1) * UNITS[key]
    if total <= 0:
        raise ValueError("a length of time is positive")
    return round(total)
