"""Matching, markers and merges against plain Python and hand-made cases."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import linkage, sequences, versions
from quillon.plans import matching

DATA = "/root/testdata/sf0.001"


def decide(edges, sources, least=0.08):
    """Decisions as the rules say, edge by edge."""
    by_source, by_slot = collections.defaultdict(list), collections.defaultdict(list)
    for s, t, score in edges:
        by_source[s].append((-score, t))
        by_slot[t].append((-score, s))
    margin = lambda xs: round(-xs[0][0] + xs[1][0], 6) if len(xs) > 1 else 1.0
    out = {}
    for s in sources:
        own = sorted(by_source[s])
        if not own:
            out[s] = (None, "unmatched", None)
            continue
        rivals = sorted(by_slot[own[0][1]])
        good = rivals[0][1] == s and margin(own) >= least and margin(rivals) >= least
        out[s] = (own[0][1], "accepted" if good else "review", None if good else [t for _, t in own[:2]])
    return out


def test_decisions(spark):
    edges = [("s1", 1, 0.95), ("s1", 2, 0.70), ("s2", 1, 0.75), ("s4", 7, 0.90), ("s4", 8, 0.85)]
    sources = ["s1", "s2", "s3", "s4"]
    rows = linkage.decisions(spark.createDataFrame([(s,) for s in sources], "s string"), spark.createDataFrame(edges, "s string, t long, score double"), "s", "t", "score").collect()
    got = {r["s"]: (r["t"], r["outcome"], r["candidates"]) for r in rows}
    assert got == decide(edges, sources)
    assert got["s1"] == (1, "accepted", None) and got["s2"][1] == "review" and got["s3"][1] == "unmatched" and got["s4"] == (7, "review", [7, 8])
    first = next(r for r in rows if r["s"] == "s1")
    assert (first["source_margin"], first["target_margin"]) == (0.25, 0.20)


def test_blocked_match(spark):
    """The registered query against the same rules pair by pair."""
    pairs = matching._pairs(spark, DATA).collect()
    edges, sources = [], set()
    for r in pairs:
        source, slot = f"{r['paper']}/{r['a_id']}", f"{r['paper']}/{r['b_ordinal']}"
        sources.add(source)
        if r["rejected"] is not None:
            continue
        a, b = (set(w.lower() for w in r[c].replace("#", " ").split()) for c in ("a_topic", "b_topic"))
        topic = max(0.9 * len(a & b) / min(len(a), len(b)), len(a & b) / len(a | b))
        found = []
        for kind, text in (("exact", r["b_text"]), ("ocr", r["b_text"][::-1])):
            score, _, coverage, longest = tx.similarity(r["a_text"], text)
            if (score >= 0.74 and coverage >= 0.68) if kind == "exact" else (score >= 0.62 and coverage >= 0.58 and longest >= 0.20):
                found.append(score)
        if found and tx.similarity(r["a_text"], r["b_text"])[0] >= 0.30:
            edges.append((source, slot, round(0.9 * max(found) + 0.1 * topic, 6)))
    want = {s: (t, o, ",".join(c) if c else None) for s, (t, o, c) in decide(edges, sources).items()}
    got = {r["source"]: (r["slot"], r["outcome"], r["candidates"]) for r in matching.blocked_match(spark, DATA).collect()}
    assert got == want and {v[1] for v in want.values()} == {"accepted", "review", "unmatched"}


def test_similarity_is_measured_on_the_left():
    score, ratio, coverage, longest = tx.similarity("one two three four five six", "zero one two three four five six 7.5 it's")
    assert (coverage, longest) == (1.0, 1.0) and ratio == pytest.approx(12 / 15) and score == 1.0
    assert tx.similarity("zero one two three four five six 7.5 it's", "one two three four five six")[2:] == (round(6 / 9, 6), round(6 / 9, 6))
    assert tx.similarity("a b c d e", "a b c d e") == (0.0, 0.0, 0.0, 0.0)


def test_no_similarity_exceeds_its_bounds(spark):
    rng = random.Random(8)
    words = ["a", "b", "it's", "7.5", "tree", "Tree", "x-y", "12"]
    pairs = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))) for _ in range(300)]
    rows = spark.createDataFrame([*pairs, ("é " * 8, "a " * 8), (None, "a"), ("a", None)], "a string, b string")
    for r in rows.select("a", "b", tx.similarity_bounds(F.col("a"), F.col("b")).alias("x")).collect():
        score, _, coverage, _ = tx.similarity(r["a"], r["b"])
        assert r["x"]["score"] >= score and r["x"]["coverage"] >= coverage, r
        assert "é" in (r["a"] or "") or r["x"]["coverage"] == coverage


def test_runs_have_their_similarity_from_sizes(spark):
    """Pairs of which one is a run of the other aren't compared in sequence, and get the same figures."""
    rng = random.Random(9)
    words = ["a", "b", "it's", "7.5", "Tree", "12"]
    pairs = []
    for _ in range(400):
        long = [rng.choice(words) for _ in range(rng.randrange(4, 140))]
        at = rng.randrange(len(long))
        pairs.append((" ".join(long), " ".join(long[at : at + rng.randrange(1, 140)]) + rng.choice(["", "", " x", "!"])))
    pairs += [(b, a) for a, b in pairs] + [("one two three four five six", "éone two three four five six"), ("1 2 3 4 5 6", "11 2 3 4 5 66"), (None, "a"), (" ".join(words * 60), " ".join(words * 60))]
    rows = spark.createDataFrame(pairs, "a string, b string")
    runs = 0
    for r in rows.select("a", "b", tx.contained_similarity(tx.similarity_words(F.col("a")), tx.similarity_words(F.col("b"))).alias("x")).collect():
        if r["x"] is not None:
            runs += 1
            assert tuple(r["x"]) == tx.similarity(r["a"], r["b"]), r
    assert runs > 300


def test_token_and_answer_shortcuts(spark):
    from quillon.functions import answers

    texts = ["a b", "A b", "b a c", "", "?!", None, "x"]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in rows.select("a", "b", tx.token_similarity(a, b).alias("got"), tx.set_similarity(tx.tokens(a), tx.tokens(b)).alias("want")).collect():
        assert r["got"] == r["want"], r
    keys = ["A", "a", "A,B", "b ; a", "1.0", "1", "1e2", "1E2", "100", " ,", None, "x y", "XY"]
    rows = spark.createDataFrame([(k, x, y) for k in ("mcq", "msq", "nat") for x in keys for y in keys], "k string, a string, b string")
    for r in rows.select("k", "a", "b", answers.same_answer(F.col("k"), a, b).alias("got"), (answers.fingerprint(F.col("k"), a) == answers.fingerprint(F.col("k"), b)).alias("want")).collect():
        assert r["got"] == r["want"], r


def rising_choices(wanted, places):
    """Every choice of places that rises, for the labels that the first of them reach."""
    last, own = float("-inf"), []
    for label in wanted:
        places_of = [p for p in sorted(set(places.get(label, []))) if p > last]
        own.append(sorted(set(places.get(label, []))) if places_of else [])
        last = places_of[0] if places_of else last
    kept = [k for k, x in enumerate(own) if x]
    return kept, [c for c in itertools.product(*(own[k] for k in kept)) if all(a < b for a, b in zip(c, c[1:]))]


def test_segment_markers(spark):
    """A label is chosen where all rising choices agree, whatever the candidates."""
    rng = random.Random(6)
    cases = [(["1", "2", "3", "1", "2"], {"1": [10, 40], "2": [20, 50], "3": [30]}), (["1", "2"], {"1": [1, 2], "2": [5]}), (["1", "2"], {"2": [5]}), (["1"], {"x": [1]})]
    cases += [(["1", "2", "3", "1", "2"], {label: [rng.randrange(12) for _ in range(rng.randrange(4))] for label in "123x"}) for _ in range(60)]
    for wanted in {tuple(w) for w, _ in cases}:
        own = [(k, places) for k, (w, places) in enumerate(cases) if tuple(w) == wanted]
        rows = [(k, label, p) for k, places in own for label, found in places.items() for p in found]
        got = collections.defaultdict(dict)
        for r in sequences.segment_markers(spark.createDataFrame(rows, "paper long, label string, at long"), "paper", "label", "at", list(wanted)).collect():
            got[r["paper"]][r["number"]] = (r["at"], r["status"])
        for k, places in own:
            if not any(places.values()):
                continue
            kept, choices = rising_choices(wanted, places)
            for j in range(len(wanted)):
                of = {c[kept.index(j)] for c in choices} if j in kept else set()
                want = (None, "missing") if not of else (of.pop(), "chosen") if len(of) == 1 else (None, "ambiguous")
                assert got[k][j + 1] == want, (wanted, places, j)


def test_page_blocks(spark):
    pages = {("a", 1): "Q.1 one\n", ("a", 2): "  \n", ("a", 3): "more\tof it Q.2 two", ("a", 4): "", ("b", 7): "x Q.1 é"}
    markers = [("a", 1, 0), ("a", 3, 11), ("b", 7, 2), ("b", 7, 99)]
    df = sequences.page_blocks(
        spark.createDataFrame(markers, "doc string, page long, start long"), spark.createDataFrame([(d, p, t) for (d, p), t in pages.items()], "doc string, page long, text string"), "doc", "page", "start", "text"
    )
    got = {(r["doc"], r["page"], r["start"]): (r["status"], r["block"], r["pages"], r["end_page"], r["end"]) for r in df.collect()}
    assert got == {
        ("a", 1, 0): ("found", "Q.1 one more of it", [1, 3], 3, 11), ("a", 3, 11): ("found", "Q.2 two", [3], 4, 0),
        ("b", 7, 2): ("found", "Q.1 é", [7], 7, 99), ("b", 7, 99): ("outside", None, [7], 7, 7),
    }


def test_bank_plan(spark):
    old = spark.createDataFrame([("a", 2001, "p", 1, "x", True, True), ("b", 2001, "p", 2, "y", True, False), ("c", None, None, None, "z", False, True), ("d", 2002, "p", 1, "w", True, True), ("e", 2002, "p", 2, "v", True, True)], "k string, year long, paper string, number long, v string, managed boolean, live boolean")
    new = spark.createDataFrame([("a", 2001, "p", 1, "x2"), ("bb", 2001, "p", 2, "y"), ("n", None, "p", 3, "new"), ("d", 2002, "p", 2, "both")], "k string, year long, paper string, number long, v string")
    plan = versions.bank_plan(old, new, "k", ["year", "paper", "number"], ["v"], F.col("managed"), "live")
    got = {(r["old_key"], r["new_key"]): r["op"] for r in plan.collect()}
    assert got == {("a", "a"): "update", ("b", "bb"): "reactivate", ("c", None): "keep", ("d", "d"): "conflict", ("e", None): "retire", (None, "n"): "insert"}
    with pytest.raises(ValueError, match="differently|different"):
        versions.require_no_conflicts(plan)
    assert versions.require_no_conflicts(plan.where("op <> 'conflict'")).count() == 5
