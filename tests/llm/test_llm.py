"""Operators for training data against brute force, on small and awkward input."""

import os
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstream.llm import pii
from siltstream.llm.mixing import mix_report, mix_sources
from siltstream.llm.nearest import nearest_in_time
from siltstream.llm.packing import harmonic, pack, pack_documents, pack_report
from siltstream.llm.runs import collapse_runs, segment, segment_levels, segment_steps
from siltstream.llm.tokens import _encoding, count, token_sizes, TOKENIZERS

ROW = "entity string, id long, t long"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no tokenizer files")


@pytest.mark.parametrize("width", [None, 3, 100])
def test_nearest_equals_brute_force(spark, width):
    rng = np.random.default_rng(1)
    make = lambda n, base: [(f"e{int(rng.integers(3))}", base + i, int(rng.integers(0, 4000))) for i in range(n)]
    left, right = make(300, 0), make(200, 1000)
    got = {(r["entity"], r["left_id"]): (r["right_id"], r["distance_us"]) for r in nearest_in_time(spark.createDataFrame(left + left[:9], ROW), spark.createDataFrame(right + right[:9], ROW), 40, width).collect()}
    want = {}
    for e, i, t in left:
        near = [(abs(u - t), u, j) for f, j, u in right if f == e and abs(u - t) <= 40]
        if near:
            d, _, j = min(near)
            want[e, i] = (j, d)
    assert got == want


def test_nearest_awkward(spark):
    none = spark.createDataFrame([], ROW)
    one = spark.createDataFrame([("a", 1, 5), (None, 2, 5), ("a", None, 5), ("a", 3, None)], ROW)
    assert nearest_in_time(none, one, 10).collect() == [] and nearest_in_time(one, none, 10).collect() == []
    assert [(r["left_id"], r["right_id"]) for r in nearest_in_time(one, one, 0).collect()] == [(1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.2, 0.5, 0.9, 1.1, 3.0]), min_size=1, max_size=9))
def test_segmentation_is_optimal(cost):
    cost = np.array(cost)
    n = len(cost)
    price = lambda starts: sum(cost[i] for i in range(n) if i not in starts) + len(starts)
    best = min(price({0, *c}) for k in range(n) for c in combinations(range(1, n), k))
    assert price(set(segment(cost).tolist())) == pytest.approx(best)


@given(st.lists(st.sampled_from([0.0, 0.5, 1.0, 1.5, float("inf")]), min_size=1, max_size=30))
def test_steps_need_no_programme(cost):
    assert segment_steps(np.array(cost)).tolist() == segment(np.array(cost)).tolist()


@given(st.lists(st.integers(0, 6), min_size=1, max_size=25), st.sampled_from([0.3, 1.0, 4.0]))
@settings(deadline=None)
def test_pruned_levels_cost_least(values, penalty):
    x = np.array(values) / 2
    cost = lambda a, b: ((x[a:b] - x[a:b].mean()) ** 2).sum()
    best = [0.0]
    for i in range(1, len(x) + 1):
        best.append(min(best[a] + cost(a, i) + penalty for a in range(i)))
    at = [*segment_levels(x, 1.0, penalty).tolist(), len(x)]
    assert at[0] == 0 and sum(cost(a, b) + penalty for a, b in zip(at, at[1:], strict=False)) == pytest.approx(best[-1])


def test_levels_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.repeat(rng.integers(0, 3, 40), rng.integers(1, 9, 40)) + 0.004 * rng.integers(-2, 3, 1)[0] + np.arange(1, 2) * 0, 3)
    drift = 20 + np.arange(60) * 0.008  # each step within the tolerance, the whole far beyond it
    rows = [("a", i, i * 10, float(v)) for i, v in enumerate(x)] + [("b", 1000 + i, i * 10, float(v)) for i, v in enumerate(drift)]
    rows += rows[5:9] + [("b", 2000, 5, None), (None, 2001, 5, 1.0)]
    df = spark.createDataFrame(rows, "entity string, id long, t long, x double").repartition(3)
    one, *others = ({tuple(r) for r in collapse_runs(df, 0.01, 1000, 1, level_penalty=2.0, block_rows=n).collect()} for n in (10_000, 7, 1))
    assert all(o == one for o in others)
    assert sum(r[3] for r in one) == len(x) + 60 and len([r for r in one if r[0] == "b"]) > 3
    assert len([r for r in collapse_runs(df, 0.01, 1000).collect() if r["entity"] == "b"]) == 1
    assert collapse_runs(df.limit(0), 0.01, level_penalty=1.0).collect() == []


def test_runs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in ("a", "b"):
        t, x = 0, 10.0
        for i in range(400):
            t += int(rng.choice([10, 20, 500]))
            x = round(x + float(rng.choice([0, 0.01, -0.01, 0.5])), 2)
            rows.append((e, (e == "b") * 1000 + i, t, x))
    df = spark.createDataFrame(rows + rows[10:20], f"{ROW}, x double").repartition(6)
    want = set()
    for e in ("a", "b"):
        own = [r for r in rows if r[0] == e]
        start = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or abs(own[i][3] - own[i - 1][3]) > 0.01 + 1e-9 or own[i][2] - own[i - 1][2] > 100:
                if i - start >= 3:
                    want.add((e, own[start][1], own[i - 1][1], i - start, own[i - 1][2] - own[start][2]))
                start = i
    got = {(r["entity"], r["first_id"], r["last_id"], r["n_events"], r["duration_us"]) for r in collapse_runs(df, 0.01, 100, 3).collect()}
    assert got == want
    assert collapse_runs(df.limit(0), 0.01).collect() == []
    all_ = collapse_runs(df, 0.01, 100)
    assert sum(r["n_events"] for r in all_.collect()) == 800


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_packing(sizes):
    sizes = np.array(sizes, np.int64)
    of = pack(sizes, 50)
    assert (of >= 0).all()
    if len(sizes):
        assert np.bincount(of, weights=sizes).max() <= 50
        assert of.max() + 1 <= 2 * sizes.sum() / 50 + 1


def test_packs_hold_every_token_once(spark):
    rng = np.random.default_rng(0)
    docs = [(i, int(n)) for i, n in enumerate(rng.integers(0, 3000, 400))] + [(5, 40), (999, None)]
    caps = spark.createDataFrame([(1, 256), (2, 1024), (3, None), (4, 0)], "pack_id int, capacity_tokens int")
    out = pack_documents(spark.createDataFrame(docs, "doc_id long, n_tokens long"), caps, block_items=100)
    rows = out.collect()
    for cap in (256, 1024):
        own = [r for r in rows if r["capacity_tokens"] == cap]
        assert sum(r["n_tokens"] for r in own) == sum(n or 0 for _, n in docs)
        fill, parts = {}, {}
        for r in own:
            if r["pack_key"] is not None:
                fill[r["pack_key"]] = fill.get(r["pack_key"], 0) + r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append(r["n_tokens"])
        assert max(fill.values()) <= cap
        assert all(len(parts[i]) == (1 if n <= cap else -(-n // cap)) for i, n in docs[:400] if i != 5)
    assert all(r["filled_share"] > 0.85 for r in pack_report(out).collect())
    assert pack_documents(spark.createDataFrame([], "doc_id long, n_tokens long"), caps).collect() == []


def test_plain_harmonic_packs(spark):
    rng = np.random.default_rng(2)
    docs = [(i, int(n)) for i, n in enumerate(rng.integers(0, 700, 800))] + [(5, 90), (5, 90), (900, None)]
    caps = spark.createDataFrame([(256,)], "capacity_tokens int")
    sized = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    out = harmonic(sized, caps, block_items=300).collect()
    assert sum(r["n_tokens"] for r in out) == sum(n or 0 for _, n in docs)
    fill, of = {}, {}
    for r in out:
        if r["pack_key"] is not None:
            fill[r["pack_key"]] = fill.get(r["pack_key"], 0) + r["n_tokens"]
            of.setdefault(r["pack_key"], []).append(256 // r["n_tokens"])
    assert max(fill.values()) <= 256 and all(len(set(k)) == 1 and len(k) <= k[0] for k in of.values())
    plain, refilled = pack_report(harmonic(sized, caps)).first(), pack_report(pack_documents(sized, caps)).first()
    assert plain["tokens"] == refilled["tokens"] and plain["filled_share"] < refilled["filled_share"]
    assert harmonic(sized.limit(0), caps).collect() == []


def test_mixing_keeps_max_repeats(spark):
    """A source out of reach whose documents mostly cost nothing."""
    sized = spark.createDataFrame([(i, "a", 0) for i in range(3000)] + [(i, "a", 7) for i in range(3000, 3040)] + [(i, "b", 100) for i in range(4000, 5000)] + [(i, "c", 0) for i in range(6000, 6010)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.8, 2), ("b", 0.1, 1), ("c", 0.1, 3)], "source string, target_share double, max_repeats int")
    out = mix_sources(sized, targets).toPandas()
    assert out[out["source"] == "a"]["repeats"].unique().tolist() == [2] and (out["source"] == "a").sum() == 3040
    assert out[out["source"] == "b"]["repeats"].max() == 1 and not (out["source"] == "c").any()


def test_mixing(spark):
    docs = [(i, "abc"[i % 3] if i % 10 else None, 10 + i % 7) for i in range(3000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.2, 1), ("c", 0.05, 2), ("d", 0.05, 9)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in mix_report(sized, targets).collect()}
    size = {s: sum(n for _, x, n in docs if x == s) for s in "abc"}
    total = sum(size.values())
    for s, share in (("a", 0.7), ("b", 0.2), ("c", 0.05)):
        assert 0 <= share * total - rep[s]["tokens_used"] < 18
    assert rep["a"]["most_repeats"] == 3 or rep["a"]["most_repeats"] == 2 + (0.7 * total > 2 * size["a"])
    assert not rep["d"]["reachable"] and rep["d"]["tokens_used"] == 0
    assert sum(r["reached_share"] for r in rep.values()) == pytest.approx(1)
    few = mix_sources(sized, targets, 100_000_000).collect()
    assert max(r["repeats"] for r in few if r["source"] == "b") == 1 and len(few) == len([d for d in docs if d[1]])
    assert mix_sources(sized.limit(0), targets).collect() == []


@needs_tokenizer
def test_token_counts(spark):
    path = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    long = "some words, " * 60_000
    assert count(None, path) == count("", path) == 0 and count("Hello world", path) == 2
    # cut for encoding: as many tokens as in one piece
    assert count(long, path) == len(_encoding(path).encode_ordinary(long))
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y")], "doc_id long, text string, n_tokens string").drop("n_tokens")
    assert {r["doc_id"]: r["n_tokens"] for r in token_sizes(df, ["doc_id"]).collect()} == {1: 2, 2: 0}


GIVEN, FAMILY = ["Anna", "Bruno", "Carla", "Dietmar", "Elif"], ["Aalto", "Brandt", "Castell", "Dorn", "Ekberg"]


def _corpus():
    rng = np.random.default_rng(0)
    new_g, new_f = ["Zelda", "Yorick", "Xenia"], ["Zorn", "Ysbrand", "Xanthou"]
    out, truth = [], {}
    frames = ["Thanks to {} for the hint.", "My colleague {} wrote the parser.", "As {} said in the other thread."]
    for i in range(300):
        unseen = i % 4 == 0
        g, f = (rng.choice(new_g), rng.choice(new_f)) if unseen else (rng.choice(GIVEN), rng.choice(FAMILY))
        name = f"{g} {f}"
        text = f"The Heath Index rises again.\n{frames[i % 3].format(name)} Contact: user{i}@mail.example or +49 30 1234567."
        if i % 5 == 0:
            text += f" Applicant {'SSN: ' if i % 10 else ''}123-45-{6000 + i} was in the export."
        text += f" Catalogue number 754-27-{3000 + i}, part 7. We are at 12 Mill Road, Overton 12345."
        out.append((i, text))
        truth[i] = name
    return out, truth


def test_personal_information(spark):
    docs, truth = _corpus()
    extra = [(1000, None), (1001, ""), (1002, "x " * 300_000)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string")
    directory = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [("Heath", "given"), (None, "given")], "name_part string, part_kind string")
    model = pii.learn(df, directory)
    got = {}
    for r in pii.extract(df, model).collect():
        got.setdefault((r["doc_id"], r["pii_kind"]), []).append(r["pii_text"])
    for i, name in truth.items():
        assert got[i, "name"] == [name]  # also names that the directory lacks, and no Heath Index
        assert got[i, "email"] == [f"user{i}@mail.example"] and got[i, "phone"] == ["+49 30 1234567"]
        assert got[i, "address"] == ["12 Mill Road, Overton 12345"]
        assert got.get((i, "id_number"), []) == ([f"123-45-{6000 + i}"] if i % 5 == 0 else [])
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert red[1000] is None and red[1001] == "" and red[1002] == "x " * 300_000
    assert "[NAME] for the hint. Contact: [EMAIL] or [PHONE]." in red[0]
    assert pii.extract(df.limit(0), pii.learn(df.limit(0), directory)).collect() == []


def test_a_rare_name_is_found_in_a_large_corpus(spark):
    docs = [(i, "Alpha Beta " * 50_000) for i in range(7)] + [(7, "we met Ada Quill there."), (8, "ada quill, as we heard")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scores = pii.learn(df, spark.createDataFrame([("Ada", "given"), ("Quill", "family"), ("Never", "given")], "name_part string, part_kind string"), block_chars=100_000)
    assert scores.blocks > 30
    assert {r["key"] for r in scores.table.filter("section = 'given'").collect()} == {"ada", "never"}
    assert [tuple(r) for r in pii.extract(df, scores).collect()] == [(7, "name", "Ada Quill")]
    assert [tuple(r) for r in pii.extract(df.filter("doc_id >= 7"), scores).collect()] == [(7, "name", "Ada Quill")]


def test_only_the_phrase_that_fills_a_context_is_vetoed(spark):
    # a known person on 40 signature lines, and others on the same line; a phrase in another context
    docs = [(i, f"text {i}\n-- \nAda Quill, office") for i in range(40)] + [(40, "text\n-- \nTom Berg, office"), (41, "x\nid 7\nEva Lind sent it")]
    docs += [(100 + i, f"row\nid {i}\n{w} By hand") for i, w in enumerate(["Posted", "Written", "Signed", "Checked"] * 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = [("Ada", "given"), ("Tom", "given"), ("Eva", "given"), ("Quill", "family"), ("Berg", "family"), ("Lind", "family"), ("Posted", "given")]
    found = {(r["doc_id"], r["pii_text"]) for r in pii.extract(df, pii.learn(df, spark.createDataFrame(names, "name_part string, part_kind string"))).collect()}
    assert found == {(i, "Ada Quill") for i in range(40)} | {(40, "Tom Berg"), (41, "Eva Lind")}


def test_contexts_decide_beyond_shapes(spark):
    """Seeds teach contexts; these bring in looser shapes, and throw out good shapes where no seed stands."""
    docs = [(i, f"Ring me under +49 30 55{i:04d}, thanks") for i in range(20)] + [(50, "Ring me under 123 456 789, thanks"), (51, "total 123 456 789, thanks")]
    docs += [(100 + i, f"parcels to {i + 1} Mill Road, Overton 12345 please") for i in range(20)] + [(150, "parcels to 7 Old Garth, Overton 12345 please"), (151, "plot 7 Old Garth, Overton 12345 is dry")]
    docs += [(200 + i, f"mail to ada.q{i}@post.example now") for i in range(20)] + [(250, "mail to x99@post.example now")] + [(300 + i, f"push as bot{i}@build.local again") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in pii.extract(df, pii.learn(df, spark.createDataFrame([("Ada", "given")], "name_part string, part_kind string"))).collect():
        got.setdefault(r["doc_id"], []).append((r["pii_kind"], r["pii_text"]))
    assert all(got[i] == [("phone", f"+49 30 55{i:04d}")] for i in range(20)) and got[50] == [("phone", "123 456 789")] and 51 not in got
    assert all(got[100 + i] == [("address", f"{i + 1} Mill Road, Overton 12345")] for i in range(20)) and got[150] == [("address", "7 Old Garth, Overton 12345")] and 151 not in got
    assert all(got[200 + i] == [("email", f"ada.q{i}@post.example")] for i in range(20)) and got[250] == [("email", "x99@post.example")] and not any(300 + i in got for i in range(20))


def test_tokens_around_a_span():
    text = "He  said\n it's 12_x: Ada-Lee, then\nmore"
    assert pii._before(text, text.index("Ada")) == "x :" and pii._before(text, text.index("12")) == "\n it's" and pii._before(text, 2) == "^ he" and pii._before("", 0) == "^ ^"
    assert pii._after(text, text.index(", then")) == ", then" and pii._after(text, len(text) - 4) == "more $" and pii._after("a  \n b", 1) == "\n b"


@pytest.mark.parametrize(("text", "kind", "item"), [
    ("mail a.b+c (at) x-y.example now", "email", "a.b+c (at) x-y.example"), ("to a_b7[at]mx[dot]host[dot]example.", "email", "a_b7[at]mx[dot]host[dot]example"),
    ("ring (030) 23125/849, evenings", "phone", "(030) 23125/849"), ("ring 933-555-0194 ext. 92 if", "phone", "933-555-0194 ext. 92"), ("(01632 960144) was", "phone", "01632 960144"),
    ("at Lindenweg 16c\n25697 Overton", "address", "Lindenweg 16c\n25697 Overton"), ("at C/ Olmos 23, 3º B, 16153 Overton picks", "address", "C/ Olmos 23, 3º B, 16153 Overton"), ("at 104, rue des Bois.", "address", "104, rue des Bois"),
    ("passport X3 537 177?", "id_number", "X3 537 177"), ("NIE X-3095637-U.", "id_number", "X-3095637-U"),
])
def test_shapes(text, kind, item):
    assert (item, kind) in [(text[s:e], k) for s, e, k in pii.find(text, {})]


@pytest.mark.parametrize(("text", "item"), [("NIR 2 84 05 75 123 456 78, merci", "2 84 05 75 123 456 78"), ("NIR: 284057512345678.", "284057512345678"), ("passport ABCD-12EF", "ABCD-12EF"), ("part 284057512345678.", None)])
def test_a_cue_needs_no_number_of_digits(text, item):
    assert [text[s:e] for s, e, k in pii.find(text, {}) if k == "id_number"] == ([item] if item else [])


@pytest.mark.parametrize("text", ["pin tool@4.91 now", "git clone git@code.host.example:qc/x.git", "scp me@logger-7:/data/x.dat .", "ls pic@2x.png", "order 62-4247-4247", "version 29.50.003.41", "192.0.2.63"])
def test_no_items(text):
    assert pii.find(text, {}) == []
