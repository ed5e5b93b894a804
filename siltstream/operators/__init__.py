"""All operators; importing this registers them."""

from . import basic, changepoints, drift, fits, grid, outliers, pattern, windowed

__all__ = ["basic", "changepoints", "drift", "fits", "grid", "outliers", "pattern", "windowed"]
