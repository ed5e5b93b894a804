"""Configurations: a table of fields and tests as text, or a list of calls as JSON."""

from __future__ import annotations

import ast
import json
import urllib.request
from collections.abc import Iterable
from pathlib import Path

from .flags import BAD, DOUBTFUL, FILTER_ALL, FILTER_NONE, GOOD, UNFLAGGED
from .frame import QC
from .functions.expr import names_in
from .registry import OPERATORS

_NAMES = {"nan": float("nan"), "NAN": float("nan"), "inf": float("inf"), "GOOD": GOOD, "BAD": BAD, "UNFLAGGED": UNFLAGGED, "DOUBTFUL": DOUBTFUL, "FILTER_ALL": FILTER_ALL, "FILTER_NONE": FILTER_NONE, "True": True, "False": False, "None": None}
#: Statistics that may be given by their bare name.
_STATS = frozenset("sum mean median min max std var count sem skew kurt first last linear time zScore madScore iqsScore scale mad cv diff abs exp log nanLog id climatologicalMean trueDailyMean".split())


def _read(source: str | Path) -> str:
    text = str(source)
    if text.startswith(("http://", "https://", "file://")):
        with urllib.request.urlopen(text) as f:
            return f.read().decode()
    return Path(text).read_text()


def _literal(node: ast.AST) -> object:
    """A value written in a config: numbers, strings, names of constants, arithmetic on numbers, lists, tuples, dicts."""
    if isinstance(node, ast.Name):
        if node.id in _NAMES:
            return _NAMES[node.id]
        if node.id in _STATS:
            return node.id
        raise NameError(f"unknown name {node.id}")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_literal(node.operand)  # type: ignore[operator]
    if isinstance(node, ast.BinOp):
        a, b = _literal(node.left), _literal(node.right)
        for kind, f in ((ast.Add, lambda: a + b), (ast.Sub, lambda: a - b), (ast.Mult, lambda: a * b), (ast.Div, lambda: a / b)):  # type: ignore[operator]
            if isinstance(node.op, kind):
                return f()
    if isinstance(node, (ast.List, ast.Tuple)):
        out = [_literal(x) for x in node.elts]
        return tuple(out) if isinstance(node, ast.Tuple) else out
    if isinstance(node, ast.Dict):
        return {_literal(k): _literal(v) for k, v in zip(node.keys, node.values, strict=True)}  # type: ignore[arg-type]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("sum", "min", "max", "len", "abs") and not node.keywords:
        return {"sum": sum, "min": min, "max": max, "len": len, "abs": abs}[node.func.id](*[_literal(a) for a in node.args])  # type: ignore[operator]
    return ast.literal_eval(node)


def parse_test(text: str) -> tuple[str, dict]:
    """``flagRange(min=0, max=60)`` as a name and keywords; an expression for ``func`` stays text."""
    node = ast.parse(text.strip(), mode="eval").body
    if isinstance(node, ast.Name):
        node = ast.Call(node, [], [])
    if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
        raise TypeError("a test is a call of an operator")
    if node.args:
        raise TypeError("only keyword arguments are allowed")
    if node.func.id not in OPERATORS:
        raise NameError(f"unknown operator {node.func.id}")
    kw: dict[str, object] = {}
    for a in node.keywords:
        if a.arg is None or a.arg in kw:
            raise TypeError("keywords are given once, and by name")
        if a.arg == "func" and node.func.id in ("flagGeneric", "processGeneric"):
            kw["func"] = ast.literal_eval(a.value) if isinstance(a.value, ast.Constant) and isinstance(a.value.value, str) else ast.unparse(a.value)
        else:
            kw[a.arg] = _literal(a.value)
    return node.func.id, kw


def read_text(text: str) -> list[tuple[str, bool, str, dict, str]]:
    """Lines ``varname ; test`` after one header row; ``#`` begins a comment; a quoted name is a regular expression."""
    out, header = [], False
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        parts = [p.strip() for p in line.split(";", 1)]
        if not header:
            header = True
            continue
        where = f"line {n}: {line}"
        if len(parts) != 2 or (";" in parts[1] and not any(q in parts[1] for q in "'\"")):
            raise ValueError(f"two columns are expected, in {where}")
        test = parts[1].split(" #", 1)[0].strip()
        name = parts[0]
        quoted = len(name) > 1 and name[0] == name[-1] and name[0] in "'\""
        try:
            func, kw = parse_test(test)
        except (SyntaxError, TypeError, NameError, ValueError) as e:
            raise type(e)(f"{e}, in {where}") from e
        out.append((name.strip("'\"") if quoted else name, quoted, func, kw, where))
    return out


def read_json(records: str | Iterable[dict], unpack: str | None = None) -> list[tuple[str, bool, str, dict, str]]:
    """Records {varname, func, kwargs}, as a list or JSON text; ``unpack`` names the part of an object that holds them."""
    data = json.loads(records) if isinstance(records, str) else records
    if unpack is not None:
        data = data[unpack]  # type: ignore[index,call-overload]
    out = []
    for i, r in enumerate(data):
        func = r["func"]
        if func not in OPERATORS:
            raise NameError(f"unknown operator {func}, in record {i}")
        out.append((r["varname"], False, func, dict(r.get("kwargs", {})), f"record {i}"))
    return out


def run(qc: QC, calls: list[tuple[str, bool, str, dict, str]]) -> QC:
    """All calls in order."""
    for name, quoted, func, kw, where in calls:
        kw = dict(kw)
        try:
            field: object = name
            if "field" in kw:
                field, kw["target"] = kw.pop("field"), name
            elif func in ("flagGeneric", "processGeneric") and isinstance(kw.get("func"), str):
                # the names of the expression are the fields; the line's name is the target
                names = [n for n in names_in(kw["func"]) if n in qc]  # type: ignore[arg-type]
                field, kw["target"] = names or [name], name
            qc = qc.call(func, field, regex=quoted, **kw)  # type: ignore[arg-type]
        except Exception as e:
            raise type(e)(f"{e}, in {where}") if isinstance(e, (ValueError, TypeError, KeyError, NameError)) else RuntimeError(f"{e}, in {where}") from e
    return qc


def run_config(qc: QC, source: str | Path, json_field: str | None = None) -> QC:
    """Run a config file (text, or JSON by its ending), from a path or URL."""
    text = _read(source)
    return run(qc, read_json(text, json_field) if str(source).endswith(".json") else read_text(text))
