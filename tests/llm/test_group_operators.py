"""Operators across documents: line dedup, near duplicates, the pipeline."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import linededup, neardup, queries
from quillon.llm.shared import Scratch

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_brute(rows):
    """Texts after removing later windows; rows that repeat id and text are one occurrence."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, gone = {}, collections.defaultdict(set)
    for doc, text in distinct:
        lines = (text or "").split("\n")
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if WORD.search("".join(window)) and first.setdefault(window, (doc, text, i)) != (doc, text, i):
                gone[doc, text] |= {i, i + 1, i + 2}
    return {r: None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[r]) for r in distinct}


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for k in range(60)]
    rows += [(None, None), (None, "a\nb\nc"), (70, ""), (71, "\n\n\n\n"), (72, "\n\n\n\n"), (73, "x\nx\nx\nx\nx"), (3, rows[3][1]), (3, rows[3][1]), (80, "ä\n\nz\r\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("covered", F.lit(1))
    out = linededup.dedup_lines(docs, counts=True)
    brute = line_brute(rows)
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == collections.Counter((r[0], brute[r]) for r in rows)
    assert out.columns == ["doc_id", "text", "covered", "n_lines", "n_removed"]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def sets_of(rows, width=5):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        out.append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]))
    return out


def component_brute(rows):
    sets, root = sets_of(rows), component_indices(rows)
    members = collections.defaultdict(list)
    for i, at in enumerate(root):
        members[at].append(rows[i][0])
    least = {at: min((x for x in ids if x is not None), default=None) for at, ids in members.items()}
    return [len(s) for s in sets], [least[at] for at in root]


def component_indices(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_rows(seed, groups=6, most=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 150, 300]))]
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    out = [(k, t) for k, t in enumerate(rows)]
    out += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, "one two three four"), (9006, "É a b c d e"), (9007, "é a b c d e"), (None, rows[0]), (5, rows[5]), (5, rows[5]), (6, "something else entirely with words")]
    return out


@pytest.mark.parametrize("settings", [neardup.NearSettings(), neardup.NearSettings(block=8, block_shingles=900, broadcast_rows=0)])
def test_near_duplicates(spark, settings):
    rows = near_rows(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash"))
    sizes, least = component_brute(rows)
    want = collections.Counter(zip((r[0] for r in rows), sizes, least))
    # an empty text keeps its own id
    got = neardup.near_duplicates(docs, settings).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = neardup.drop_near_duplicates(docs, settings)
    assert kept.columns == docs.columns
    # one row of each component, and all rows without words
    groups = collections.defaultdict(set)
    for (doc, _), size, root in zip(rows, sizes, component_indices(rows)):
        groups[root if size else ("empty", doc)].add(doc)
    want = collections.Counter(min((x is None, x or 0) for x in ids) for ids in groups.values())
    assert collections.Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "t", "x"), (1, "t", "y"), (2, "t  ", "z"), (None, "u v", ""), (None, "u v", ""), (3, "", ""), (3, "", "")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.drop_near_duplicates(docs).collect())
    assert got == [(0, "u v"), (1, "t"), (3, ""), (3, "")]


def test_rows_sent_to_blocks(spark):
    """A bucket's rows are sent once for every `block` classes that ask, not to all blocks."""
    settings = neardup.NearSettings(block=100)
    rows = [(7, f"{k:04}".encode(), b"main" if k else b"other", b"main", 10) for k in range(3000)]
    df = spark.createDataFrame(rows, "bucket long, cls binary, root binary, main binary, n long")
    sent = neardup.block_rows(df, Scratch(spark), settings).groupBy("asks").count().collect()
    assert {r["asks"]: r["count"] for r in sent} == {True: 30, False: 3000}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    apart = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (3, None)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in neardup.near_duplicates(apart).collect()) == [1, 2, 3]


def test_bayes_bounds_keep_what_is_over_the_threshold():
    settings = neardup.NearSettings()
    bounds = neardup.least_matches(settings)
    assert [n for n, _ in bounds] == [32, 64, 96, 128] and all(m < 0.75 * n for n, m in bounds)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20_000, 128), dtype=np.uint8)
    like = lambda s: np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    assert len(neardup.surviving(a, like(0.75), bounds)[0]) >= 19_999 and len(neardup.surviving(a, like(0.2), bounds)[0]) == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"{rng.randrange(200):03}".encode(), f"{rng.randrange(200):03}".encode()) for _ in range(150)] + [(f"c{k:03}".encode(), f"c{k + 1:03}".encode()) for k in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in parent}


def test_sql_twins(spark):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        result = c.execute(sql)
        columns = [d[0] for d in result.description]
        want = sorted(result.fetchall())
        assert sorted(tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*columns).collect()) == want, name


def leaked_brute(texts, items):
    """Which texts hold an item within the edit budget of one of its probes, by alignment with the whole text."""
    from quillon.llm import decontaminate
    from tests.llm.test_text_operators import semi_global

    settings = decontaminate.LeakSettings()
    probes = decontaminate.LeakIndex(items, settings).probes
    out = set()
    for doc, text in texts:
        points = decontaminate.normal(text or "")
        if len(points) and any(semi_global(p, points) <= settings.edits(len(p)) for _, p in probes):
            out.add(doc)
    return out


def test_pipeline(spark):
    """The stages against brute force, on what each one gets."""
    import corpus_pipeline as cp

    from quillon.llm import mixing
    from tests.llm.test_proofs import bayes

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    seen = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, seen, DATA).cache()
        assert out.columns[:5] == docs.columns and (k == 4 or out.columns == docs.columns)
        rows = [(r["doc_id"], r["text"]) for r in seen.collect()]
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":  # all languages are known here: only texts without a letter have none
            assert set(got) == {d for d, t in rows if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            brute = line_brute(rows)
            assert got == {r[0]: t for r, t in ((r, brute[r]) for r in rows) if t == r[1] or WORD.search(t or "")}
        elif name == "near_dedup":
            assert set(got) == {r[0] for r, c in zip(rows, component_brute(rows)[1]) if r[0] == c}
        elif name == "decontamination":
            gone = leaked_brute(rows, items)
            assert set(got) == {d for d, _ in rows} - gone and gone
        else:
            rates = mixing.rates(seen, labels).withColumn("copies", mixing.copies(F.col("rate"))).toPandas().set_index("doc_id")
            assert {r["doc_id"]: r["copies"] for r in out.collect()} == rates.loc[rates["copies"] > 0, "copies"].to_dict()
            settings = mixing.MixSettings()
            hashed = {r["doc_id"]: r["b"] for r in seen.select("doc_id", mixing._buckets("text", settings.buckets).alias("b")).collect()}
            known = {r["id"]: r["domain"] for r in mixing.label_domains(labels).collect()}
            # the prior counts all labelled rows, the words only those that are still there
            sizes = collections.Counter(known.values())
            ids, domains = rates.index.tolist(), list(mixing.TARGETS)
            p = bayes([hashed[d] for d in ids], [(hashed.get(d, []), x) for d, x in known.items()], domains, settings)
            r, tokens = rates["rate"].to_numpy(), rates["tokens"].to_numpy()
            assert sum(sizes.values()) == len(known) and np.allclose(rates[["p0", "p1", "p2"]].to_numpy(), p, atol=1e-9)
            goal = tokens.sum() * np.array(list(mixing.TARGETS.values()))
            assert np.abs((tokens * r) @ p - goal).max() < 1e-3 * tokens.sum() and (r >= 0).all()
        seen = out
    final = {r["doc_id"] for r in cp.run(spark, DATA).collect()}
    assert final == set(got)
