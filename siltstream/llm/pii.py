"""Personal information in free text, by bootstrapped contextual extraction.

Shapes only propose: whatever is formed like a name, a number, a mailbox or a street is a
candidate, with the lexical patterns it stands in - the two tokens before, the two after, and
the one on each side. Seeds are candidates that are sure without any context: names of which a
directory knows a part, mailboxes named after such a part, numbers beside a word that says what
they are, phones with a country code, streets with a postcode. Spark scores the graph of
patterns and instances in turns: a pattern is trusted by the share of its *distinct* name
instances that are known (of its occurrences that are seeds, for the other kinds), a name part
by the share of its occurrences that stand in trusted patterns; parts learnt in one turn count as
known in the next. At last the patterns decide: they bring in candidates of a looser shape (names
that the directory lacks, numbers without a cue or in an unknown format, streets of no known
kind) and throw out candidates of a good shape where no seed of their kind ever stands.

Scale. A text is read once by the scan and once, in its small words, after learning. Candidates
are a table; patterns, their scores and the answers to a block's questions are computed from it
by Spark. The scores stay a table, of any size: candidates are dealt to blocks, each block asks
for the distinct keys it needs and gets them by a join. No support rises with the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import drop, stage

KINDS = ("email", "phone", "id_number", "address", "name")

# ---- shapes: fixed values, the public formats of each kind -------------------------------

_AT = r"(?:@| ?\(at\) ?| ?\[at\] ?| AT )"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| DOT )"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+/@-])[A-Za-z0-9][\w.+-]*?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w@])(?!:[\w/~])(?!-\w)")
_AT_SIGN = re.compile(r"@| ?\(at\)| ?\[at\]| AT ")
#: Endings of file names, which no mailbox has.
_FILES = frozenset("png jpg jpeg gif svg py sh csv dat log txt pdf html git json xml zip gz".split())

PHONE = re.compile(
    r"(?<![\w+])(?<!\d[./,;:-])(?:"
    r"(?:\+|00)(?:1|[2-9]\d{1,2})(?:[ .\-–/]?(?:\(\d{1,4}\)|\d{2,11}|\d(?=[ .]\d\d)))+"  # with country code
    r"|(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.–]\d{4}"  # area, exchange, line
    r"|0\d{4}[ /-]\d{6}"
    r"|\(0\d{2,4}\) ?\d{4,8}(?:[/ -]\d{1,5})?"
    r"|0\d{2,4}[ /-]\d{4,6}[ /-]\d{3}"
    r"|0[1-9]([ .])\d\d(?:\1\d\d){3}"
    r")(?:,? ?(?:ext\.?|x|Durchwahl|poste) ?\d{1,5})?(?!\w)(?![-./]\d)"
)
_SIX_DIGITS = re.compile(r"\d(?:[ ()./–A-Z+-]{0,3}\d){5}")
_NINE_DIGITS = re.compile(r"\d(?:[ ()./–+-]{0,3}\d){8}")
ID = re.compile(r"(?<![\w.+/@#-])(?:[A-ZÀ-ÖØ-Þ]{1,4}-?)?\d[\dA-Z]*(?:[ -]\d[\dA-Z]*)*(?:-[A-Z])?(?![\w@])(?!-\w)(?![.,:]\d)")
#: Words for a number that an authority issues to a person, as they stand just before it.
CUE = re.compile(
    r"(?:\b(?:SSN|social security|passport|reisepass\w*|passeport|pasaporte|(?:ID|identity) card|(?:personal)?ausweis\w*|carte d['’]identité|national id|national insurance|"
    r"(?:driver['’]?s|driving)? ?licen[cs]e|führerschein\w*|permis de conduire|tax id|steuer-?(?:id|nummer)|NIE|DNI|NIF|NIR|insurance)\b"
    r"(?:/\w+)?(?: \((?:driver|card)\))?(?: ?(?:no|number|nr|num|n°|nº)\b)?[.:]? ?[#:]? ?)$",
    re.I,
)
#: What every cue contains, in small letters.
_CUES = ("ssn", "social", "pass", "pasaporte", "ausweis", "card", "identit", "national", "licen", "führerschein", "permis", "tax", "steuer", "nie", "dni", "nif", "nir", "insurance")
#: Kinds of street, before or after the proper part of its name, and of part of a house.
_AFTER = r"(?:Street|Lane|Road|Avenue|Close|Drive|Court|Square|Terrace|Crescent|Way|Place|St\.|Rd|Ave|Ln|Dr|St)"
_BEFORE = r"(?:rue|avenue|bd|boulevard|chemin|place|allée|impasse|quai|route|cours)"
_FIRST = r"(?:C/|Calle|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda|Via|Viale|Piazza)"
_ENDS = r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig|markt|graben|hof)"
_CAP = r"[A-ZÄÖÜÉÈÀÁÍÓÚÑÇ][\w'’-]*"
_LINK = r"(?:(?:de|du|des|del|de la|de las|de los|la|le|les|d'|l')[ ]?)"
_NO = r"\d{1,4}[a-hA-H]?\b(?: (?:bis|ter)\b)?"
_GAP = r"(?:,? |,?\n[ \t]*)"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|unit|Suite|Whg\.?|App\.?) \w{1,5})"
def _street() -> re.Pattern:
    anglo = rf"(?:{_UNIT}, )?{_NO},? (?:{_CAP} ){{1,3}}{_AFTER}(?!\w)(?:{_GAP}{_UNIT})?"
    french = rf"(?:{_UNIT}, )?{_NO},? {_BEFORE} {_LINK}*{_CAP}"
    spanish = rf"{_FIRST} {_LINK}*{_CAP},? {_NO}(?:, \d{{1,2}}º ?[A-Z]?)?"
    german = rf"(?:[A-ZÄÖÜ][\w-]*{_ENDS}|(?:Am|An der|An den|Auf der|Auf dem|Zum|Zur|Alte|Alter|Neue|Neuer|Hinter der) {_CAP}) {_NO}"
    return re.compile(rf"(?<![\w.])(?:{anglo}|{french}|{spanish}|{german})(?![\w])", re.U)


STREET = _street()
#: What every street contains: a word from the lists above.
_STREETS = tuple("Street Lane Road Avenue Close Drive Court Square Terrace Crescent Way Place St. Rd Ave Ln Dr St rue avenue bd boulevard chemin place allée impasse quai route cours C/ Calle Avda. Avenida Plaza Paseo Camino Ronda Via Viale Piazza straße strasse str. gasse weg allee platz ufer damm ring steig markt graben hof Am An Auf Zum Zur Alte Neue Hinter".split())
#: A looser shape: capital words and a house number just before a postcode.
PLACE = re.compile(rf"(?<![\w.])(?:{_NO},? (?:{_CAP} ){{0,2}}{_CAP}|(?:{_CAP} ){{1,2}}{_NO})(?={_GAP}(?:\d{{5}} {_CAP}|{_CAP}(?: {_CAP})? \d{{5}}(?!\d)))", re.U)
_POSTCODE = re.compile(r"\d{5}(?!\d)")
#: Town and postcode after a street: with a postcode also on the next line, without one only after a comma.
TOWN = re.compile(rf"(?:(?:,? |,?\n[ \t]*|,? in )\d{{5}} (?P<a>{_CAP})(?: (?P<a2>{_CAP}))?|(?:, |,?\n[ \t]*)(?P<b>{_CAP})(?: (?P<b2>{_CAP}))? \d{{5}}(?!\d)|, (?P<c>{_CAP})(?: (?P<c2>{_CAP}))?(?! ?\d))", re.U)

_W = r"[A-ZÄÖÜÉÈÀÁÍÓÚÑÇÅØŠŽ](?:[^\W\d_]|['’](?=[^\W\d_]))+"
_PART = r"(?:(?:von|van|der|den|de|la|le|del|di|da|dos|zu|zur|Mac|Mc|Le|La|Van|Von|De|VON|VAN|DER|DE|LA|MAC)[ ])"
_S = r"(?:[ ]|[ ]?\n[ \t]*)"
_GIVEN, _FAMILY = rf"{_W}(?:-{_W})?", rf"{_PART}{{0,2}}{_W}(?:-{_W})?"
_INIT = r"[A-ZÄÖÜ]\."
NAMES = (
    re.compile(rf"(?<![\w'’-])(?=(?P<g>{_GIVEN}){_S}(?:{_INIT}{_S}){{0,2}}(?P<f>{_FAMILY})(?![\w'’-]))", re.U),
    re.compile(rf"(?<![\w'’-])(?=(?P<f>{_FAMILY}), (?P<g>{_GIVEN})(?P<i>(?: {_INIT}){{0,2}})(?![\w'’-]))", re.U),
    re.compile(rf"(?<![\w'’.-])(?=(?P<g>{_INIT})(?:[ ]?{_INIT}){{0,2}}{_S}(?P<f>{_FAMILY})(?![\w'’-]))", re.U),
)
_C = "[A-ZÄÖÜÉÈÀÁÍÓÚÑÇÅØŠŽ]"
#: Where a name may begin: a cheap form that no name fails.
_MAYBE = re.compile(rf"(?<![\w'’-])(?:(?={_C}[\w'’-]*(?:,|\.(?:[ ]?{_C}\.)*)?{_S}(?:{_C}\.{_S}){{0,2}}(?:{_C}|{_PART}))|(?={_PART}{{1,2}}{_C}[\w'’-]*, {_C}))")
_SMALL_WORD = re.compile(r"(?<![\w'’-])[^\W\d_A-Z]+|(?<![\w'’.-])[^\W\d_A-Z]\.(?=[ ][^\W\d_A-Z])")
_w = r"[^\W\d_A-Z](?:[^\W\d_]|['’](?=[^\W\d_]))*"
_part = r"(?:(?:von|van|der|den|de|la|le|del|di|da|zu|mac|mc)[ ])"
_family = rf"(?P<f>{_part}{{0,2}}{_w}(?:-{_w})?)(?![\w'’-])"
LOWER = (
    re.compile(rf"(?<![\w'’-])(?=(?P<g>{_w}(?:-{_w})?)[ ](?:[^\W\d_]\.[ ]){{0,2}}{_family})", re.U),
    re.compile(rf"(?<![\w'’-])(?=(?P<f>{_part}{{0,2}}{_w}(?:-{_w})?), (?P<g>{_w}(?:-{_w})?)(?P<i>(?: [^\W\d_]\.){{0,2}})(?![\w'’-]))", re.U),
    re.compile(rf"(?<![\w'’.-])(?=(?P<g>[^\W\d_]\.)[ ]{_family})", re.U),
)
#: Small words inside a family name, with which no given name begins.
PARTICLES = frozenset("von van der den de la le del di da zu".split())
#: Titles and forms of address, which are no part of a name.
TITLES = frozenset("mr mrs ms dr prof herr frau sr sra señor señora don doña m mme mlle monsieur madame sir".split())

_TOKEN = re.compile(r"\s*\n\s*|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_")


def _tokens(piece: str) -> list[str]:
    return ["\n" if t.isspace() else "#" if t[0].isdigit() else t.lower() for t in _TOKEN.findall(piece)]


def _before(text: str, end: int) -> str:
    """The two tokens before a position, read backwards: ``^`` where the text begins."""
    out: list[str] = []
    i = end
    while len(out) < 2:
        broken, j = False, i
        while j > 0 and text[j - 1].isspace():
            broken |= text[j - 1] == "\n"
            j -= 1
        if broken:
            out.append("\n")
        elif j == 0:
            out.append("^")
        elif (c := text[j - 1]).isalpha():
            k = j
            while k > 0 and (text[k - 1].isalpha() or (text[k - 1] in "'’-" and k > 1 and k < j and text[k - 2].isalpha())):
                k -= 1
            out.append(text[k:j].lower())
            j = k
        elif c.isdigit():
            while j > 0 and text[j - 1].isdigit():
                j -= 1
            out.append("#")
        else:
            out.append(c)
            j -= 1
        i = j
    return f"{out[1]} {out[0]}"


def _after(text: str, start: int) -> str:
    """The two tokens after a position: ``$`` where the text ends."""
    out: list[str] = []
    for m in _TOKEN.finditer(text, start):
        t = m.group()
        out.append("\n" if t.isspace() else "#" if t[0].isdigit() else t.lower())
        if len(out) == 2:
            break
    return " ".join((out + ["$", "$"])[:2])


def _shape(s: str) -> str:
    return re.sub(r"\d", "#", re.sub(r"[^\W\d_]", "A", s))


def _named(text: str, at: int, lower: bool) -> Iterator[tuple[int, int, str, str]]:
    """Spans that begin here and are formed like a name: start, end, given part (empty for an initial), family part, in small letters."""
    for k, rx in enumerate(LOWER if lower else NAMES):
        if not (m := rx.match(text, at)):
            continue
        g, f = m.group("g"), m.group("f")
        if (k != 2 and g.lower() in TITLES) or (k == 1 and f.lower() in TITLES):
            continue
        if lower and g in PARTICLES:
            continue
        if not lower and k != 2 and g.isupper() != f.isupper():
            continue
        yield at, m.end("f") if k != 1 else m.end("i"), "" if k == 2 else g.lower(), " ".join(f.lower().split())


#: What a candidate's shape says: spans lines, small letters, of a strict shape, a seed.
LINES, SMALL, STRICT, SEED = 1, 2, 4, 8
#: kind, start, end, what stands there, three properties of its kind, shape, and the tokens before and after.
_COLS = {"kind": "string", "s": "int", "e": "int", "item": "string", "a": "string", "b": "string", "c": "string", "x": "int", "left": "string", "right": "string"}
Candidate = tuple


def scan(text: str) -> list[Candidate]:
    """The candidates of a text, but for names in small letters.

    a, b, c: ``name`` - given and family part; ``number`` - shape, a cue before it ("1"), its
    digits; ``phone`` - shape; ``email`` - ending, parts of the mailbox; ``address`` - town, its
    second word, and the ends (from the start) of street, town and second word.
    """
    out: list[Candidate] = []

    def put(kind: str, s: int, e: int, a: str, b: str, c: str, x: int, context: int = -1, end: int = -1) -> None:
        out.append((kind, s, e, text[s:e], a, b, c, x, _before(text, s if context < 0 else context), _after(text, e if end < 0 else end)))

    done = 0
    if "@" in text or "at" in text or " AT " in text:
        for m in _AT_SIGN.finditer(text):
            s = m.start()
            while s > done and (text[s - 1].isalnum() or text[s - 1] in "_.+-"):
                s -= 1
            if s < m.start() and (hit := EMAIL.match(text, s)):
                box = hit.group()
                ending = box.rpartition(".")[2].lower()
                strict = ending not in _FILES and not box.lower().startswith("git@")
                put("email", s, hit.end(), ending, " ".join(re.findall(r"[^\W\d_]{2,}", text[s : m.start()].lower())), "", STRICT * strict)
                done = hit.end()
    digits = _SIX_DIGITS.search(text)
    lowered = text.lower()
    cues = any(w in lowered for w in _CUES)
    if digits or cues:
        for m in ID.finditer(text):
            s, e = m.span()
            if e - s < 6 and not cues:
                continue
            cue = CUE.search(text[max(0, s - 80) : s]) if cues else None
            n = sum(map(str.isdigit, m.group()))
            if not cue and (not 6 <= n <= 12 or e - s > 20):
                continue
            put("number", s, e, _shape(m.group()), "1" if cue else "", str(n), SEED * bool(cue), s - len(cue.group()) if cue else -1)
    if digits and _NINE_DIGITS.search(text):
        for m in PHONE.finditer(text):
            item = m.group()
            if 9 <= sum(map(str.isdigit, item)) <= 17:
                put("phone", m.start(), m.end(), _shape(item), "", "", STRICT | SEED * item.startswith(("+", "00")))
    streets: list[tuple[int, int]] = []
    if any(w in text for w in _STREETS):
        for m in STREET.finditer(text):
            _address(text, m.start(), m.end(), STRICT, put)
            streets.append(m.span())
    if _POSTCODE.search(text):
        for m in PLACE.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e in streets):
                _address(text, m.start(), m.end(), 0, put)
    for m in _MAYBE.finditer(text):
        for s, e, g, f in _named(text, m.start(), False):
            put("name", s, e, g, f, "", LINES * ("\n" in text[s:e]))
    return out


def _address(text: str, s: int, e: int, x: int, put: Callable) -> None:
    m = TOWN.match(text, e)
    if not m:
        put("address", s, e, "", "", "", x)
        return
    k = next(k for k in "abc" if m.group(k))
    second = m.group(k + "2") or ""
    # a postcode after the town belongs to it, and then the town is as long as it stands
    first = m.end() if k == "b" or not second else m.end(k)
    put("address", s, m.end(), m.group(k), second, f"{e - s} {first - s} {m.end() - s}", x | SEED * (bool(x) and k != "c"))


def scan_small(text: str, known: Callable[[str], bool]) -> list[Candidate]:
    """Candidates for names in small letters, of texts with a small word that may be a given part, or an initial."""
    if not any(w[-1] == "." or known(w) for w in set(_SMALL_WORD.findall(text))):
        return []
    out = []
    for rx in LOWER:
        for m in rx.finditer(text):
            g = m.group("g")
            if g[-1] != "." and not known(g.partition("-")[0]):
                continue
            for s, e, g, f in _named(text, m.start(), True):
                out.append(("name", s, e, text[s:e], g, f, "", SMALL, _before(text, s), _after(text, e)))
    return list(dict.fromkeys(out))


#: Least occurrences of a pattern, a shape and a fixed phrase, whatever the size of the corpus.
LEAST, LEAST_FIXED = 3, 5
#: Places of the filter of given parts.
_PLACES = 1 << 20
#: A section of the scores for each kind of candidate, its patterns and its shapes.
_SECTIONS = {"number": ("ids", "shapes"), "phone": ("phones", "phone shapes"), "email": ("mailboxes", "endings"), "address": ("places", None)}

Model = Mapping[str, Mapping[str, float]]


@dataclass(frozen=True)
class Scores:
    """What a corpus teaches. ``table``: section, key, trust. ``candidates``: what the scan proposed, in ``blocks`` blocks. ``given``: a filter of fixed size that no known given part fails; it only spares questions, the table decides."""

    table: DataFrame
    candidates: DataFrame
    given: bytes
    blocks: int


def _filter(parts: DataFrame) -> bytes:
    places = np.zeros(_PLACES, dtype=np.uint8)
    places[parts.select((F.crc32(F.col("part").cast("binary")) % _PLACES).alias("place")).distinct().toPandas()["place"].to_numpy(dtype=np.int64)] = 1
    return places.tobytes()


def _rows(batches: Iterable[pd.DataFrame], id_: str, text: str, of: Callable[[str], list[Candidate]]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, h, *c) for i, h, t in zip(pdf[id_], pdf["h"], pdf[text], strict=True) for c in of(t)]
        yield pd.DataFrame(rows, columns=[id_, "h", *_COLS])


def _small(batches: Iterable[pd.DataFrame], id_: str, text: str, given: bytes) -> Iterator[pd.DataFrame]:
    known = lru_cache(maxsize=200_000)(lambda w: given[zlib.crc32(w.encode()) % _PLACES] == 1)
    yield from _rows(batches, id_, text, partial(scan_small, known=known))


def _candidates(documents: DataFrame, id_: str, text: str, blocks: int, scanner: Callable) -> DataFrame:
    """Candidates of the non-empty texts: block_, id, h (hash of the text), and their properties."""
    kind = dict(documents.dtypes)[id_]
    schema = f"`{id_}` {kind}, h long, " + ", ".join(f"{k} {v}" for k, v in _COLS.items())
    texts = documents.filter(F.col(text) != "").select(id_, text, F.xxhash64(text).alias("h"))
    return texts.mapInPandas(scanner, schema).withColumn("block_", F.pmod(F.xxhash64(id_, "h"), F.lit(blocks)))


def _patterns_of() -> list[Column]:
    """The lexical patterns of a candidate: two tokens before it, two after it, one on each side."""
    return [F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"), F.concat(F.lit("B "), F.substring_index("left", " ", -1), F.lit(" _ "), F.substring_index("right", " ", 1))]


def _by_occurrence(edges: DataFrame, sure: Column, section: str, shapes: str | None) -> list[DataFrame]:
    """Trust of patterns by the share of their occurrences that are seeds, and of shapes by the share that stands in trusted patterns."""
    by = edges.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("good"))
    by = stage(by.filter(F.col("n") >= LEAST).withColumn("trust", F.col("good") / F.col("n")), "contexts")
    said = by
    if section != "ids":
        # no seed says something only where, at the kind's share of seeds, there should have been one (chance below a thousandth)
        share = by.agg((F.sum("good") / F.sum("n")).alias("share"))
        said = by.crossJoin(F.broadcast(share)).filter((F.col("good") > 0) | (F.pow(1 - F.col("share"), F.col("n")) < 1e-3))  # one row
    out = [said.select(F.lit(section), "pattern", "trust")]
    if shapes:
        strong = by.filter("trust >= 0.5 and good >= 3").select("pattern", F.lit(1).alias("strong"))
        near = edges.filter("pattern not like 'B %'").join(strong, "pattern", "left")
        per = near.groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.when((F.col("strong") == 1) | sure, F.col("n")).otherwise(0)).alias("s")).filter(F.col("n") >= LEAST)
        if section != "ids":
            per = per.crossJoin(F.broadcast(share)).filter((F.col("s") > 0) | (F.pow(1 - F.col("share"), F.col("n")) < 1e-3))
        out.append(per.select(F.lit(shapes), "a", F.col("s") / F.col("n")))
    return out


def learn(documents: DataFrame, directory: DataFrame, id_: str = "doc_id", text: str = "text", turns: int = 3, block_chars: int = 1_000_000) -> Scores:
    """Score patterns and instances of a corpus. ``directory``: name_part, part_kind (given or family); it may be partial and wrong in places."""
    size = documents.agg(F.sum(F.char_length(text))).first()[0] or 0
    blocks = 1 + size // block_chars
    found = stage(_candidates(documents, id_, text, blocks, partial(_rows, id_=id_, text=text, of=scan)), "candidates")
    seeds = directory.select(F.lower("name_part").alias("part"), "part_kind").dropna().distinct()
    seen = found.filter(F.col("x").bitwiseAND(LINES) == 0).select("kind", F.explode(F.array(*_patterns_of())).alias("pattern"), "a", "b", F.col("x").bitwiseAND(SEED).alias("seed"))
    edges = stage(seen.groupBy("kind", "pattern", "a", "b", "seed").agg(F.count("*").alias("n")), "edges", ["kind"])
    table = [*_names(edges.filter("kind = 'name'"), seeds, turns), *_by_occurrence(edges.filter("kind = 'number'"), F.col("seed") > 0, *_SECTIONS["number"])]
    table += _by_occurrence(edges.filter("kind = 'phone'"), F.col("seed") > 0, *_SECTIONS["phone"]) + _by_occurrence(edges.filter("kind = 'address'"), F.col("seed") > 0, *_SECTIONS["address"])
    # a mailbox named after a part of a name is a person's
    boxes = edges.filter("kind = 'email'").select("pattern", "a", "b", "n", F.explode_outer(F.split("b", " ")).alias("part")).join(seeds.select("part", F.lit(1).alias("known")).distinct(), "part", "left")
    boxes = boxes.groupBy("pattern", "a", "b").agg(F.max("n").alias("n"), F.max("known").alias("known"))
    table += _by_occurrence(boxes, F.col("known") == 1, *_SECTIONS["email"])
    # a town of two words: the second nearly always follows the first
    towns = found.filter("kind = 'address' and a <> ''").groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.sum("n").alias("all"), F.max_by("b", F.when(F.col("b") != "", F.col("n"))).alias("second"), F.max(F.when(F.col("b") != "", F.col("n"))).alias("top"))
    table.append(towns.filter("second is not null and top >= 2 and top >= 0.5 * all").select(F.lit("towns"), F.concat("a", F.lit(" "), "second"), F.lit(1.0)))
    scores = stage(reduce(DataFrame.union, (t.toDF("section", "key", "trust") for t in table)), "scores")
    drop(edges)
    return Scores(scores, found, _filter(scores.filter("section = 'given'").select(F.col("key").alias("part"))), blocks)


def _names(names: DataFrame, seeds: DataFrame, turns: int) -> list[DataFrame]:
    """The turns over the graph of patterns and name parts."""
    given, family = (seeds.filter(F.col("part_kind") == k).select("part").withColumn("known", F.lit(1)) for k in ("given", "family"))
    trusted = None
    for turn in range(turns):
        # a compound given name counts as known by its first half
        half = names.withColumn("g", F.substring_index("a", "-", 1))
        marked = half.join(given.withColumnsRenamed({"part": "g", "known": "kg"}), "g", "left").join(family.withColumnsRenamed({"part": "b", "known": "kf"}), "b", "left")
        known = F.when(F.col("kg").isNotNull() | F.col("kf").isNotNull(), 1).otherwise(0)
        # a span whose parts are both known is no mere phrase, however often it recurs, where other known names stand too
        whole = F.when(F.col("kf").isNotNull() & (F.col("kg").isNotNull() | (F.col("a") == "")), 1).otherwise(0)
        both = F.when(F.col("kg").isNotNull() & F.col("kf").isNotNull(), 1).otherwise(0)
        per = marked.groupBy("pattern", "b").agg(F.sum("n").alias("one"), F.count("*").alias("instances"), F.sum(known).alias("good"), F.sum(both).alias("both"), F.sum(whole).alias("whole"))
        # the most frequent family part of the pattern
        per = per.groupBy("pattern").agg(
            F.sum("one").alias("n"), F.sum("instances").alias("instances"), F.sum("good").alias("good"), F.sum("both").alias("whole"), F.max(F.struct("one", "b", F.col("instances").alias("i"), (F.col("good") - F.col("whole")).alias("g"), F.col("whole").alias("w"), "both")).alias("top"))
        # often, and nearly always the same: a fixed phrase, which neither is a name here nor counts for those beside it
        phrase = (F.col("top.one") >= 0.9 * F.col("n")) & (F.col("n") >= 10)
        per = per.withColumn("phrase", F.when(phrase, F.col("top.b"))).withColumn("instances", F.col("instances") - F.when(phrase, F.col("top.i") - F.col("top.w")).otherwise(0)).withColumn("good", F.col("good") - F.when(phrase, F.col("top.g")).otherwise(0))
        trust = F.greatest(F.when(F.col("instances") > 0, F.col("good") / F.col("instances")), F.lit(0.001))
        spare = F.when(F.col("whole") > F.col("top.both"), 1.0).otherwise(0.0)
        trusted = stage(per.filter(F.col("n") >= LEAST).select("pattern", "n", "instances", "whole", "phrase", spare.alias("spare"), trust.alias("trust")), "patterns")
        if turn == turns - 1:
            break
        strong = trusted.filter("trust >= 0.5 and instances >= 5 and whole >= 1").select("pattern", "phrase", F.lit(1).alias("strong"))
        seen = names.filter("pattern not like 'B %'").join(strong, "pattern", "left").withColumn("strong", F.when(F.col("phrase").isNull() | (F.col("b") != F.col("phrase")), F.col("strong")))
        learnt = []
        for part, other, base in ((F.substring_index("a", "-", 1), "b", given), (F.col("b"), "a", family)):
            new = seen.withColumn("part", part).filter("part <> ''").groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("strong") == 1, F.col("n")).otherwise(0)).alias("s"), F.countDistinct(other).alias("others"))
            new = new.filter((F.col("s") >= 0.4 * F.col("n")) & (F.col("s") >= 2)).select("part", F.lit(1).alias("known"))
            learnt.append(stage(base.union(new).dropDuplicates(["part"]), "parts"))
        drop(trusted)
        given, family = learnt
    counted = names.filter("pattern like 'L %'")
    # two words that hardly ever stand without each other are a phrase: parts of names meet many others
    own = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("a <> ''")
    by_a, by_b = (own.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in "ab")
    own = own.filter(F.col("n") >= LEAST_FIXED).join(by_a, "a").join(by_b, "b")
    fixed = own.filter((F.col("n") >= 0.9 * F.col("na")) & (F.col("n") >= 0.9 * F.col("nb")))
    return [
        trusted.filter("instances >= 3").select(F.lit("names"), "pattern", "trust"), given.select(F.lit("given"), "part", F.lit(1.0)), family.select(F.lit("family"), "part", F.lit(1.0)),
        fixed.select(F.lit("fixed"), F.concat("a", F.lit(" "), "b"), F.lit(1.0)),
        trusted.filter("phrase is not null and pattern not like 'B %'").select(F.lit("phrases"), F.concat("pattern", F.lit(" "), "phrase"), "spare"),
    ]


def decide(candidates: Iterable[Candidate], model: Model) -> list[tuple[int, int, str, str]]:
    """The items among the candidates of one text: start, end, kind, what stands there; none overlap."""
    of: dict[str, list[tuple]] = {k: [] for k in ("email", "address", "number", "phone", "name")}
    for kind, s, e, item, a, b, c, x, left, right in candidates:
        l2, r1 = left.rpartition(" ")[2], right.partition(" ")[0]
        of[kind].append((s, e, item, a, b, c, x, (f"L {left}", f"R {right}", f"B {l2} _ {r1}")))
    out: list[tuple[int, int, str, str]] = []
    none: Mapping[str, float] = {}
    get = lambda section: model.get(section, none)

    def put(s: int, e: int, kind: str, item: str) -> None:
        if not any(a < e and s < b for a, b, _, _ in out):
            out.append((s, e, kind, item))

    def accepted(kind: str, a: str, x: int, patterns: tuple) -> bool:
        """A seed is; a strict shape is unless its patterns are known and never hold a seed, and its shape is not trusted either; a looser one needs trusted patterns."""
        section, shapes = _SECTIONS[kind]
        known = [t for p in patterns if (t := get(section).get(p)) is not None]
        shape = get(shapes).get(a) if shapes else None
        if x & SEED:
            return True
        if x & STRICT:
            return not known or max(*known, shape or 0.0) > 0.002
        return max(known, default=0.0) >= 0.75 and sum(t >= 0.3 for t in known) >= 2 and (shape is None or shape >= 0.5)

    for s, e, item, a, _, _, x, patterns in of["email"]:
        if accepted("email", a, x, patterns):
            put(s, e, "email", item)
    for s, e, item, a, b, c, x, patterns in of["address"]:
        if accepted("address", a, x, patterns):
            if c:
                street, first, second = map(int, c.split())
                end = second if not b or f"{a} {b}" in get("towns") else first
                item, e = item[:end], s + end
            put(s, e, "address", item)
    numbers = []
    for s, e, item, a, _, c, x, patterns in of["number"]:
        known = [t for p in patterns if (t := get("ids").get(p)) is not None]
        best = max(known, default=None)
        sure = x & SEED or (best is not None and best >= 0.5 and min(known) > 0.02)
        if sure or (get("shapes").get(a, 0.0) >= 0.9 and (best is None or best > 0.02)):
            numbers.append((s, e, item, x & SEED))
        elif int(c) >= 9 and max(best or 0.0, get("shapes").get(a, 0.0)) < 0.2 and accepted("phone", a, 0, patterns):  # what numbers of identity look like, or stand beside, is no unknown form of a phone
            of["phone"].append((s, e, item, a, "", "", SEED, patterns))
    for s, e, item, a, _, _, x, patterns in of["phone"]:
        if accepted("phone", a, x, patterns) and not any(p < e and s < q and q - p >= e - s and cue for p, q, _, cue in numbers):
            put(s, e, "phone", item)
    for s, e, item, _ in numbers:
        put(s, e, "id_number", item)

    ranked = []
    for s, e, item, g, f, _, x, patterns in of["name"]:
        small = x & SMALL
        kg, kf = bool(g) and g.partition("-")[0] in get("given"), f in get("family")
        if small and not (kg or (not g and kf)):
            continue
        trust = [get("names").get(p) for p in patterns]
        filled = [t for p in patterns[:2] if (t := get("phrases").get(f"{p} {f}")) is not None]
        known = [t for t in trust if t is not None]
        best = max(known, default=-1.0)
        slot, both = best >= 0.5, (kg or not g) and kf
        if filled and not (both and min(filled) == 1.0):  # part of a fixed phrase
            continue
        if slot and not kg and not kf and best < 0.75 and sum(t >= 0.3 for t in known) < 2:
            continue  # one pattern alone must be a sure one to bring in an unknown name
        if not (kg and kf) and f"{g} {f}" in get("fixed"):
            continue
        if small or x & LINES:
            good = slot and (kg or both) and (bool(small) or both)
        else:
            good = slot or (both and bool(g) and (best >= 0.15 or best < 0))
        if good:
            ranked.append((-(2 * slot + (kg or not g) + kf), s, -(e - s), e, item))
    for _, s, _, e, item in sorted(ranked):
        put(s, e, "name", item)
    return sorted(out)


def find(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """The items of a text: start, end, kind; none overlap. Null and empty texts have none."""
    if not text:
        return []
    small = scan_small(text, lambda w: w in model.get("given", {}))
    return [(s, e, kind) for s, e, kind, _ in decide([*scan(text), *small], model)]


def _questions(candidates: DataFrame) -> DataFrame:
    """The distinct keys that ``decide`` needs in each block: block_, section, key."""
    patterns = _patterns_of()
    ask = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    a, b, is_ = F.col("a"), F.col("b"), lambda k: F.col("kind") == k
    name = [ask("names", p) for p in patterns] + [ask("phrases", F.concat(p, F.lit(" "), b)) for p in patterns[:2]]
    name += [ask("given", F.substring_index(a, "-", 1)), ask("family", b), ask("fixed", F.concat(a, F.lit(" "), b))]
    keys = F.when(is_("name"), F.array(*name))
    for kind, (section, shapes) in _SECTIONS.items():
        own = [ask(section, p) for p in patterns] + ([ask(shapes, a)] if shapes else [ask("towns", F.concat(a, F.lit(" "), b))])
        if kind == "number":
            own += [ask("phones", p) for p in patterns] + [ask("phone shapes", a)]
        keys = keys.when(is_(kind), F.array(*own))
    return candidates.select("block_", F.explode(keys).alias("q")).select("block_", "q.section", "q.key").distinct()


def _decided(pdf: pd.DataFrame, answers: pd.DataFrame, id_: str) -> pd.DataFrame:
    model: dict[str, dict[str, float]] = {k: dict(zip(g["key"], g["trust"], strict=True)) for k, g in answers.groupby("section")}
    rows = []
    pdf = pdf.drop_duplicates([id_, "h", "kind", "s", "e", "a", "b"])
    cols = list(zip(*(pdf[c] for c in _COLS), strict=True))
    texts: dict[tuple, list] = {}
    for key, c in zip(zip(pdf[id_], pdf["h"], strict=True), cols, strict=True):
        texts.setdefault(key, []).append(c)
    for (i, h), own in texts.items():
        rows += [(i, h, *item) for item in decide(own, model)]
    return pd.DataFrame(rows, columns=[id_, "h", "s", "e", "pii_kind", "pii_text"])


def _items(documents: DataFrame, scores: Scores, id_: str, text: str) -> DataFrame:
    """The items of all texts: id, h, s, e, pii_kind, pii_text. Each block of candidates is decided beside the scores of the keys it asks for."""
    kind = dict(documents.dtypes)[id_]
    small = stage(_candidates(documents, id_, text, scores.blocks, partial(_small, id_=id_, text=text, given=scores.given)), "small")
    every = scores.candidates.unionByName(small)
    answers = _questions(every).join(scores.table, ["section", "key"]).select(F.col("block_").alias("asked_by"), "section", "key", "trust")
    return every.groupBy("block_").cogroup(answers.groupBy("asked_by")).applyInPandas(partial(_decided, id_=id_), f"`{id_}` {kind}, h long, s int, e int, pii_kind string, pii_text string")


def extract(documents: DataFrame, scores: Scores, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The distinct items of each document, as they stand in its text: id, pii_kind, pii_text.

    ``documents`` are those that ``scores`` was learnt from, or some of them. Null and empty
    texts have none; repeated documents repeat their items; other columns are not read; an empty
    table gives an empty result. The size of the blocks does not change the result.
    """
    kept = documents.filter(F.col(text) != "").select(id_, F.xxhash64(text).alias("h")).distinct()
    return _items(documents, scores, id_, text).join(kept, [id_, "h"], "left_semi").select(id_, "pii_kind", "pii_text").distinct()


def redact(documents: DataFrame, scores: Scores, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its items replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]``: id, text, n_replaced. A null text stays null."""
    spans = _items(documents, scores, id_, text).groupBy(id_, "h").agg(F.sort_array(F.collect_list(F.struct("s", "e", F.concat(F.lit("["), F.upper("pii_kind"), F.lit("]")).alias("w")))).alias("spans"))
    rows = documents.select(id_, text, F.xxhash64(text).alias("h")).join(spans, [id_, "h"], "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["w"]).alias("out"), x["e"].alias("at"))
    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    new = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.aggregate("spans", start, step, end))
    return rows.select(id_, new.alias(text), F.coalesce(F.size("spans"), F.lit(0)).alias("n_replaced"))
