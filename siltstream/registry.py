"""Registered operators. A new one is a function with a decorator; it becomes a method and a name in config files."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from .flags import FILTER_ALL


@dataclass(frozen=True)
class Op:
    """mask: the operator sees flagged values as missing; demask: what it hid comes back afterwards."""

    func: Callable
    mask: bool
    demask: bool
    multivariate: bool
    handles_target: bool
    dfilter: float
    reach: Callable | None
    wants: frozenset[str]
    order: tuple[str, ...]


OPERATORS: dict[str, Op] = {}


def register(mask: bool = True, demask: bool = False, multivariate: bool = False, handles_target: bool = False, dfilter: float = FILTER_ALL, name: str | None = None, reach: Callable | None = None) -> Callable:
    """Register an operator.

    Univariate: ``func(series, ...)`` returns the series with a column ``hit`` (rows to flag),
    ``out`` (new values) or ``newflag``. Multivariate or handling its target: ``func(call,
    field(s), target(s), ...)`` returns a new object. ``reach(keywords)`` tells how far in time a
    row's result depends on other rows (microseconds; None: without bound); with it, long series are cut.
    """

    def put(func: Callable) -> Callable:
        OPERATORS[name or func.__name__] = Op(func, mask, demask, multivariate, handles_target, dfilter, reach, frozenset(inspect.signature(func).parameters), tuple(inspect.signature(func).parameters)[1:])
        return func

    return put


def flagging(**kw) -> Callable:
    return register(mask=True, demask=True, **kw)


def processing(**kw) -> Callable:
    return register(mask=False, demask=False, **kw)
