"""Generic expressions: text or functions over fields, compiled to columns. Nothing is executed as Python code."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..flags import BAD, DOUBTFUL, FILTER_ALL, FILTER_NONE, GOOD, UNFLAGGED, is_flagged

if TYPE_CHECKING:
    from ..frame import Series

CONSTANTS = {"nan": None, "NAN": None, "GOOD": GOOD, "BAD": BAD, "UNFLAGGED": UNFLAGGED, "DOUBTFUL": DOUBTFUL, "FILTER_ALL": FILTER_ALL, "FILTER_NONE": FILTER_NONE, "pi": math.pi}


def divide(a: Column, b: Column) -> Column:
    """Division as floats do it: by zero it gives an infinity, or nothing for 0/0."""
    a, b = F.lit(a).cast("double"), F.lit(b).cast("double")
    return F.when(b != 0, a / b).when(a > 0, float("inf")).when(a < 0, float("-inf"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    a, b = F.lit(a).cast("double"), F.lit(b).cast("double")
    return F.when(b != 0, a - b * F.floor(a / b))


def environment(s: Series) -> dict[str, Callable]:
    """Functions that expressions may call. Reducers work on the whole series and skip missing values."""
    n = iter(range(10**6))

    def column(x: Column) -> Column:
        """The expression as a column of its own, which an aggregate or a window function may read though it holds one."""
        name = f"__step{next(n)}_{len(s.df.columns)}"
        s.df = s.df.withColumn(name, x)
        return F.col(name)

    def totals(x: Column, *stats: Callable[[Column], Column]) -> list[Column]:
        """Statistics of the whole series, joined to its rows."""
        c = column(x)
        names = [f"__total{next(n)}_{len(s.df.columns)}" for _ in stats]
        s.df = s.summed(**{k: f(c) for k, f in zip(names, stats, strict=True)}).df
        return [F.col(k) for k in names]

    reduce_ = lambda f: lambda x: totals(x, f)[0]
    quantile = lambda q: lambda x: F.percentile(x, F.lit(q))
    median = reduce_(quantile(0.5))

    def scale(x: Column) -> Column:
        lo, hi = totals(x, F.min, F.max)
        return F.when(hi > lo, (x - lo) / (hi - lo)).when(x.isNotNull(), 0.5)

    def cv(x: Column) -> Column:
        lo, hi, dev, mean = totals(x, F.min, F.max, F.stddev_samp, F.avg)
        return F.try_divide(F.try_divide(dev, hi - lo), F.try_divide(mean - lo, hi - lo))

    def z_score(x: Column) -> Column:
        mean, dev = totals(x, F.avg, F.stddev_samp)
        return F.try_divide(x - mean, dev)

    def iqs_score(x: Column) -> Column:
        low, middle, high = totals(x, quantile(0.25), quantile(0.5), quantile(0.75))
        return F.try_divide(x - middle, high - low)

    def shifted(x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(s.order)

    def mad(x: Column) -> Column:
        return median(F.abs(x - median(x)))

    def mad_score(x: Column) -> Column:
        middle = median(x)
        return divide(x - middle, median(F.abs(x - middle)))

    def valid(x: Column, max_nan_total: int | None = None, max_nan_consec: int | None = None) -> Column:
        out = F.lit(True)
        if max_nan_total is not None:
            out &= totals(x, lambda c: F.sum(F.when(c.isNull(), 1).otherwise(0)))[0] <= max_nan_total
        if max_nan_consec is not None:
            # missing rows in a row have their position and their rank among the missing in common
            run = column(F.row_number().over(s.order) - F.count(F.when(x.isNull(), 1)).over(s.order.rowsBetween(-(2**31) + 1, 0)))
            size = F.sum(F.when(x.isNull(), 1).otherwise(0)).over(Window.partitionBy(*s.by(), run))
            out &= totals(size, F.max)[0] <= max_nan_consec
        return out

    def checked(f: Callable[[Column], Column]) -> Callable:
        return lambda x, max_nan_total=None, max_nan_consec=None: F.when(valid(x, max_nan_total, max_nan_consec), totals(x, f)[0])

    def span_of(x: Column, target_range: tuple[float, float] = (0.0, 1.0)) -> Column:
        low, high = target_range
        return scale(x) * (high - low) + low

    return {
        "sum": reduce_(F.sum), "mean": reduce_(F.avg), "min": reduce_(F.min), "max": reduce_(F.max), "std": reduce_(F.stddev_pop), "var": reduce_(F.var_pop),
        "median": median, "count": reduce_(F.count), "len": reduce_(lambda c: F.count(F.lit(1))), "cv": cv, "scale": span_of, "mad": mad, "madScore": mad_score, "diff": lambda x: x - shifted(x), "shift": shifted,
        "zScore": z_score, "iqsScore": iqs_score,
        "id": lambda x: x, "abs": F.abs, "exp": F.exp, "sqrt": F.sqrt, "sign": F.signum, "round": F.round,
        "log": lambda x: F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")), "nanLog": lambda x: F.when(x > 0, F.ln(x)).when(x == 0, 2.2250738585072014e-308),
        "clip": lambda x, lower=None, upper=None: F.when(x.isNull(), None).otherwise(_clip(x, lower, upper)),
        "deltaT": lambda x: (F.col("t") - F.lag("t").over(s.order)) / 1e6, "derivative": lambda x: F.try_divide(x - shifted(x), (F.col("t") - F.lag("t").over(s.order)) / 1e6),
        "rateOfChange": lambda x: F.try_divide(x - shifted(x), shifted(x)), "relativeDifference": lambda x: F.try_divide(x - shifted(x), F.abs(x) + F.abs(shifted(x))),
        "isValid": valid, "evaluate": valid,
        "stdQC": checked(F.stddev_samp), "varQC": checked(F.var_samp), "meanQC": checked(F.avg),
    }


def _clip(x: Column, lower: float | None, upper: float | None) -> Column:
    if lower is not None:
        x = F.greatest(x, F.lit(float(lower)))
    return x if upper is None else F.least(x, F.lit(float(upper)))


_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.Mod: modulo, ast.Pow: lambda a, b: F.pow(F.lit(a), F.lit(b)),
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
}


def names_in(text: str) -> list[str]:
    """Names of an expression that are no functions or constants, in order of first use: the fields it reads."""
    tree = ast.parse(text.strip(), mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    found = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Name)), key=lambda n: (n.lineno, n.col_offset))
    return list(dict.fromkeys(n.id for n in found if n.id not in called and n.id not in CONSTANTS))


def compile_expression(text: str, fields: dict[str, tuple], s: Series, dfilter: float) -> Column:
    """A text expression as a column. ``fields``: name -> (value, flag, history, meta). A name that is no field stands for the fields in order."""
    free = [n for n in names_in(text) if n not in fields]
    order = iter(fields.values())
    bound = {**fields, **{n: v for n, v in zip(free, order)}}
    if any(n not in bound for n in free):
        raise NameError(f"unknown names: {free}")
    env = environment(s)

    def flagged(node: ast.Call) -> Column:
        if not node.args or not isinstance(node.args[0], ast.Name):
            raise TypeError("isflagged takes a field")
        _, flag, hist, meta = bound[node.args[0].id]
        for k in node.keywords:
            if k.arg == "label":
                label = ast.literal_eval(k.value)
                at = [i for i, m in enumerate(meta) if m["kwargs"].get("label") == label]
                if not at:
                    raise KeyError(label)
                flag = F.get(hist, at[-1])
        return is_flagged(flag, dfilter)

    def go(node: ast.AST):
        if isinstance(node, ast.Expression):
            return go(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return F.lit(CONSTANTS[node.id]) if node.id in CONSTANTS and node.id not in bound else bound[node.id][0]
        if isinstance(node, ast.BinOp):
            a, b = go(node.left), go(node.right)
            if isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
                a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
                return a & b if isinstance(node.op, ast.BitAnd) else a | b if isinstance(node.op, ast.BitOr) else a != b
            if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.USub):
                return -go(node.operand)
            if isinstance(node.op, (ast.Invert, ast.Not)):
                return ~F.coalesce(go(node.operand), F.lit(False))
        if isinstance(node, ast.Compare):
            out, left = None, go(node.left)
            for op, right in zip(node.ops, node.comparators, strict=True):
                if type(op) not in _COMPARE:
                    raise TypeError(f"not allowed in an expression: {type(op).__name__}")
                r = go(right)
                one = F.coalesce(_COMPARE[type(op)](left, r), F.lit(False))
                out, left = one if out is None else out & one, r
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            if node.func.id == "isflagged":
                return flagged(node)
            if node.func.id in env:
                plain = lambda x: tuple(plain(e) for e in x.elts) if isinstance(x, (ast.Tuple, ast.List)) else x.value if isinstance(x, ast.Constant) else -x.operand.value if isinstance(x, ast.UnaryOp) and isinstance(x.operand, ast.Constant) else go(x)
                return env[node.func.id](go(node.args[0]), *[plain(a) for a in node.args[1:]], **{k.arg: plain(k.value) for k in node.keywords})
            raise NameError(f"unknown function {node.func.id}")
        raise TypeError(f"not allowed in an expression: {type(node).__name__}")

    return go(ast.parse(text.strip(), mode="eval"))


def evaluate(func: Callable, fields: Sequence[tuple], s: Series, dfilter: float) -> list[Column]:
    """A function of columns (the fields' values); what it returns are columns, or plain values that hold for all rows."""
    out = func(*[f[0] for f in fields])
    out = list(out) if isinstance(out, (list, tuple)) else [out]
    return [x if isinstance(x, Column) else F.lit(x) for x in out]
