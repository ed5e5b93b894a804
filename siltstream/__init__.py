"""Spark-native quality control and preparation of time-series data."""

from . import operators
from .flags import BAD, DOUBTFUL, FILTER_ALL, FILTER_NONE, GOOD, UNFLAGGED
from .frame import QC
from .registry import flagging, processing, register

__all__ = ["BAD", "DOUBTFUL", "FILTER_ALL", "FILTER_NONE", "GOOD", "QC", "UNFLAGGED", "flagging", "operators", "processing", "register"]
