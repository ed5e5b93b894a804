"""External vocabularies for flags."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import BAD, DOUBTFUL, FILTER_ALL, GOOD, UNFLAGGED

if TYPE_CHECKING:
    from .frame import Field

#: The causes that the structured vocabulary knows.
CAUSES = ("", "BATTERY_LOW", "BELOW_MINIMUM", "ABOVE_MAXIMUM", "BELOW_OR_ABOVE_MIN_MAX", "ISOLATED_SPIKE", "DEFECTIVE_SENSOR", "LEFT_CENSORED_DATA", "RIGHT_CENSORED_DATA", "OTHER", "AUTOFLAGGED")


class Scheme:
    """Floats as they are; by default every flag hides its value."""

    dfilter: float = FILTER_ALL

    def internal(self, flag: object) -> float:
        return float(flag)  # type: ignore[arg-type]

    def limit(self, flag: object) -> float:
        return float(flag) if isinstance(flag, (int, float)) and not isinstance(flag, bool) else self.internal(flag)

    def external(self, field: Field) -> Column:
        return F.coalesce("flag", F.lit(UNFLAGGED))


class Mapping(Scheme):
    """Words for flags: ``forward`` word -> float, ``backward`` float -> word. UNFLAGGED and BAD must be there."""

    def __init__(self, forward: dict[str, float], backward: dict[float, str]):
        if not {UNFLAGGED, BAD} <= set(backward):
            raise ValueError("a scheme needs words for UNFLAGGED and BAD")
        self.forward, self.backward = forward, backward

    def internal(self, flag: object) -> float:
        if flag in self.forward:
            return self.forward[flag]  # type: ignore[index]
        if isinstance(flag, (int, float)) and float(flag) in self.backward:
            return float(flag)
        raise ValueError(f"flag {flag!r} isn't known to the scheme")

    def external(self, field: Field) -> Column:
        flag, out = F.coalesce("flag", F.lit(UNFLAGGED)), None
        for k, v in self.backward.items():
            out = F.when(flag == k, v) if out is None else out.when(flag == k, v)
        return out.otherwise(F.raise_error(F.concat(F.lit("flag without a word in the scheme: "), flag.cast("string"))))


def _tests(field: Field, what) -> Column:
    """For each row the property of the last test that set its flag."""
    position = F.filter(F.sequence(F.lit(1), F.greatest(F.size("hist"), F.lit(1))), lambda i: F.get(F.col("hist"), i - 1).isNotNull())
    names = F.array(*(F.lit(what(m)) for m in field.meta)) if field.meta else F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(names, F.try_element_at(position, F.lit(-1))), F.lit(""))


class Annotated(Scheme):
    """struct(flag, func, parameters)."""

    def external(self, field: Field) -> Column:
        flag = F.coalesce("flag", F.lit(UNFLAGGED))
        return F.struct(flag.alias("flag"), _tests(field, lambda m: m["func"]).alias("func"), _tests(field, lambda m: json.dumps(m["kwargs"], default=str)).alias("parameters"))


class Structured(Scheme):
    """struct(quality_flag, quality_cause, quality_comment): NIL, OK, DOUBTFUL or BAD with a cause and a comment naming the test."""

    dfilter = GOOD + 1
    #: The words for quality.
    forward = {"NIL": UNFLAGGED, "OK": GOOD, "DOUBTFUL": DOUBTFUL, "BAD": BAD}

    def internal(self, flag: object) -> float:
        return self.forward[flag] if flag in self.forward else float(flag)  # type: ignore[index,arg-type]

    def external(self, field: Field) -> Column:
        flag = F.coalesce("flag", F.lit(UNFLAGGED))
        word = F.when(flag == UNFLAGGED, "NIL").when(flag <= GOOD, "OK").when(flag < BAD, "DOUBTFUL").otherwise("BAD")
        cause = F.when(flag > GOOD, F.coalesce(F.nullif(_tests(field, lambda m: m["kwargs"].get("cause", "")), F.lit("")), F.lit("OTHER"))).otherwise("")
        comment = F.when(flag > GOOD, F.to_json(F.struct(_tests(field, lambda m: m["func"]).alias("test"), _tests(field, lambda m: m["kwargs"].get("comment", "")).alias("comment")))).otherwise("")
        return F.struct(word.alias("quality_flag"), cause.alias("quality_cause"), comment.alias("quality_comment"))

    @staticmethod
    def invalid(flags) -> Column:
        """Rows of an external table that break the vocabulary's rules."""
        q, c, m = F.col(f"{flags}.quality_flag"), F.col(f"{flags}.quality_cause"), F.col(f"{flags}.quality_comment")
        return ~q.isin(*Structured.forward) | ~c.isin(*CAUSES) | ((c == "OTHER") & (m == "")) | (q.isin("NIL", "OK") & (c != "")) | (q.isin("DOUBTFUL", "BAD") & (c == ""))


class Positional(Scheme):
    """A whole number: 9, then for each test 0 (not flagged), 1 (doubtful) or 2 (bad); up to 18 tests."""

    dfilter = DOUBTFUL + 1

    def internal(self, flag: object) -> float:
        # fixed values: the digits of the vocabulary
        return {-6: UNFLAGGED, -5: UNFLAGGED, -2: UNFLAGGED, -1: UNFLAGGED, 0: UNFLAGGED, 1: DOUBTFUL, 2: BAD}.get(flag, flag)  # type: ignore[call-overload]

    def external(self, field: Field) -> Column:
        if len(field.meta) > 18:
            raise ValueError("a positional flag holds at most 18 tests")
        digit = F.transform("hist", lambda x: F.when(x >= BAD, "2").when(x >= DOUBTFUL, "1").otherwise("0"))
        return F.concat(F.lit("9"), F.array_join(digit, "")).cast("long")


SCHEMES = {
    "float": Scheme, "annotated-float": Annotated, "dmp": Structured, "positional": Positional,
    "simple": lambda: Mapping({"UNFLAGGED": UNFLAGGED, "BAD": BAD, "OK": GOOD}, {UNFLAGGED: "UNFLAGGED", BAD: "BAD", GOOD: "OK", DOUBTFUL: "DOUBTFUL"}),
}


def of(scheme: str | Scheme) -> Scheme:
    if isinstance(scheme, Scheme):
        return scheme
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    return SCHEMES[scheme]()
