"""Fill-in-the-middle, Merkle manifests and exact dedup against plain Python."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import exactdup, fim, merkle, queries
from quillon.llm.textbytes import as_bytes

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_merkle_manifest", "op13_exact_dedup"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)


# fill in the middle


def fim_brute(doc, text, seed=42):
    text = text or ""
    tokens = fim.TOKENS.findall(text)
    n, h = len(tokens), sha(f"{seed}:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


PIECES = ["a", "Zürich", "学习", "😀", " ", "\n", "\t\t", "\x0b", " ", "é", "<", "<S", "P>", "word", "\x1f", "é", " "]


def test_fill_in_middle(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 30)))) for k in range(400)]
    rows += [(None, None), (None, "a b ü"), (500, ""), (501, "a <S> b"), (502, " \n "), (503, "ü"), (504, "a b 😀 " * 50_000), (3, rows[3][1]), (3, rows[3][1]), (-9, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fim_form": F.lit(1), "fim_draws": F.lit("kept"), "Text_": F.lit(2)})
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "fim_draws", "Text_", "fim_tokens", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    back = fim.restored(F.col("fim_text"), F.col("fim_form"))
    got = collections.Counter(tuple(r) for r in out.select("doc_id", "text", "fim_draws", "fim_tokens", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text", back).collect())
    assert got == collections.Counter((doc, text, "kept", *fim_brute(doc, text), text or "") for doc, text in rows)
    assert {r[4] for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    none = fim.fill_in_middle(docs, fim.FimSettings(rate=0))
    assert {r[0] for r in none.select("fim_form").distinct().collect()} == {"plain"}


def test_own_sentinels_and_seed(spark):
    rows = [(k, f"one two-{k} ü three") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = fim.FimSettings(seed=7, rate=100, spm_rate=30, prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>")
    out = fim.fill_in_middle(docs, own)
    assert out.where(fim.restored(F.col("fim_text"), F.col("fim_form"), own) != F.col("text")).count() == 0
    assert out.where(F.col("fim_form") == "plain").count() == 0 and out.select("fim_form").distinct().count() == 2
    for marks in (("", "b", "c"), ("ab", "bc", "d"), ("aa", "b", "c"), ("ab", "xaby", "c"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            fim.FimSettings(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_exception_index_converts_every_cut():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "ü", "学", "😀", "bcd"]) for _ in range(rng.randrange(0, 40)))
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        index = fim.Exceptions(raw)
        byte = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
        assert index.to_points(byte).tolist() == list(range(len(text) + 1)) and index.to_bytes(np.arange(len(text) + 1)).tolist() == byte.tolist()
        assert len(index.bytes) == sum(len(c.encode()) > 1 for c in text)


def test_invalid_bytes_are_kept(spark):
    data = [b"\x80\xbf a \xff\xfe b \xe5\xad", b"\xc3", b"ok \xf0\x9f\x98 x y"]
    docs = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(data)], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    own = fim.FimSettings(rate=100)
    out = fim.fill_in_middle(docs, own).withColumn("back", fim.restored(F.col("fim_text"), F.col("fim_form")))
    got = {r["doc_id"]: r for r in out.select("doc_id", F.col("back").cast("binary").alias("b"), (F.col("text").cast("binary") == F.col("back").cast("binary")).alias("same")).collect()}
    assert all(bytes(got[k]["b"]) == x and got[k]["same"] for k, x in enumerate(data))


# Merkle manifest


def leaf_brute(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, path of each node) of one tree; a path is a list of (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
            at[k] = i // 8
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
    return level[0], paths


def merkle_brute(rows):
    """doc_id, leaf, subroot, root, path of every row (doc_id, source, lang, n_chars, text)."""
    parts = collections.defaultdict(list)
    for row in rows:
        parts[row[2]].append((row[0], leaf_brute(row)))
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for part in order:
        leaves = sorted(parts[part], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *climb([h for _, h in leaves])))
    root, above = climb([t[1] for t in trees])
    return [(doc, h, sub, root, path + above[k]) for k, (leaves, sub, paths) in enumerate(trees) for (doc, h), path in zip(leaves, paths)]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


def digest_of(path):
    return sha("".join(left + right for left, right in path))


def test_manifest_of_parts_of_many_sizes(spark):
    sizes = {None: 3, "": 1, "a": 8, "b": 9, "c": 64, "d": 65, "e": 512, "f": 513, "g": 1100, "é": 2, "Z": 7}
    rows = [(k, random.choice(["s", None]), lang, 3, f"text {lang} {k}") for lang, n in sizes.items() for k in range(n)]
    rows += [(None, None, "a", None, None), (None, None, "a", None, None), (5, "s", "b", 3, "other"), (6, "s", "b", 3, "text b 6"), (6, "s", "b", 3, "text b 6")]
    manifest = merkle.build(table_of(spark, rows))
    got = collections.Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], digest_of(r["path"])) for r in manifest.proofs().collect())
    want = merkle_brute(rows)
    assert got == collections.Counter((*x[:4], digest_of(x[4])) for x in want)
    assert manifest.root == want[0][3]
    assert manifest.proofs().where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    # the manifest: every level of every part, whole
    levels = collections.defaultdict(list)
    for r in manifest.levels().collect():
        levels[r["part"], r["level"]].append((r["block"], r["nodes"]))
    for lang in sizes:
        part = "" if lang is None else f"={lang}"
        own = sorted(((row[0], leaf_brute(row)) for row in rows if row[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        level = [h for _, h in own]
        for k in range(10):
            assert "".join(nodes for _, nodes in sorted(levels[part, k])) == "".join(level)
            if len(level) == 1:
                assert not levels[part, k + 1]
                break
            level = [sha("".join(level[j : j + 8])) for j in range(0, len(level), 8)]
    assert "".join(x for _, x in sorted(levels[None, 0])) == "".join(dict.fromkeys(x[2] for x in want))


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_few_rows_and_many_parts(spark, n):
    rows = [(k, None, f"p{k}", k, "x") for k in range(n)]
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], digest_of(r["path"])) for r in merkle.build(table_of(spark, rows)).proofs().collect()}
    assert got == {x[0]: (*x[1:4], digest_of(x[4])) for x in merkle_brute(rows)}


def test_more_parts_than_a_block(spark):
    rows = [(k, None, f"{k % 600}", k, "x") for k in range(700)]
    got = {r["doc_id"]: (r["root"], digest_of(r["path"])) for r in merkle.build(table_of(spark, rows)).proofs().collect()}
    assert got == {x[0]: (x[3], digest_of(x[4])) for x in merkle_brute(rows)}


def test_tampering_shows(spark):
    rows = [(k, "S", random.Random(k).choice(["a", "b", None]), k, random.Random(k).choice(["Text", "text", None, ""])) for k in range(300)]
    docs = table_of(spark, rows).withColumns({"part": F.lit(1), "pos": F.lit(2), "node": F.lit(3), "n": F.lit(4)})
    third = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    found = merkle.digest(merkle.build(docs, carried={"other": merkle.tampered(docs, third, F.lower(docs["text"]))}).proofs())
    for r in found.collect():
        doc, _, _, _, text = rows[r["doc_id"]]
        assert r["verified"] == (zlib.crc32(str(doc).encode()) % 3 != 0 or text != "Text")
    empty = merkle.build(docs.limit(0))
    assert empty.root is None and empty.proofs().count() == 0 and empty.levels().count() == 0


def test_one_id_that_holds_all_rows(spark):
    """Equal rows are dealt to several tasks, and the root doesn't depend on how."""
    rows = [(7, "s", "a", 1, "same")] * 3000 + [(k, "s", "a", 1, "x") for k in range(50)]
    one, two = merkle.build(table_of(spark, rows)), merkle.build(spark.createDataFrame(rows[::-1], "doc_id long, source string, lang string, n_chars long, text string").repartition(2))
    assert one.root == two.root == merkle_brute(rows)[0][3]


# exact dedup


def exact_brute(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOW)].append(doc)
    best = {t: max((d for d in docs if d is not None), default=None) for t, docs in groups.items()}
    return groups, best


@pytest.mark.parametrize("counters", [1, 4, 1024])
def test_exact_duplicates(spark, counters):
    rng = random.Random(counters)
    texts = ["Hot", "hOT", "ÄB", "äb", "", None, "İ"] + [f"T{k % 40}" for k in range(80)]
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(k + 1000, rng.choice(["HOT", "hot"])) for k in range(300)]
    rows += [(None, "null only"), (None, "null only"), (None, "hot"), (1299, "hot"), (5000, "twice"), (5000, "Twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumns({"digest": F.lit(1), "best": F.lit(2), "ID": F.lit(3)})
    groups, best = exact_brute(rows)
    found = exactdup.digest(exactdup.exact_duplicates(docs, counters)).collect()
    got = collections.Counter((r["doc_id"], r["text_sha256"], r["keep_id"], r["group_size"]) for r in found)
    assert got == collections.Counter((doc, sha(t), best[t], len(groups[t])) for doc, text in rows for t in [(text or "").translate(LOW)])
    kept = collections.Counter((r["doc_id"], r["text_sha256"]) for r in found if r["kept"])
    assert kept == collections.Counter((best[t], sha(t)) for t in groups)  # one row of each group, repeated rows too
    left = exactdup.drop_exact_duplicates(docs, counters)
    assert left.columns == docs.columns
    assert collections.Counter((r["doc_id"], sha((r["text"] or "").translate(LOW))) for r in left.collect()) == kept
    assert exactdup.exact_duplicates(docs.limit(0), counters).count() == exactdup.drop_exact_duplicates(docs.limit(0), counters).count() == 0


@pytest.mark.parametrize("counters", [1, 3, 10])
def test_summary_bounds(spark, counters):
    rng = random.Random(counters)
    for _ in range(50):
        keys = [bytes([min(int(rng.expovariate(0.3)), 60)]) for _ in range(rng.randrange(1, 400))]
        summary, true = exactdup.Summary(counters), collections.Counter(keys)
        for k in range(0, len(keys), 37):
            some = collections.Counter(keys[k : k + 37])
            summary.add(list(some), list(some.values()))
        assert len(summary.counts) <= counters
        assert all(true[key] - len(keys) / (counters + 1) <= summary.counts.get(key, 0) <= true[key] for key in true)
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "digest binary").repartition(3)
    found = {bytes(r["digest"]) for r in exactdup.frequent(rows, "digest", counters).collect()}
    assert len(found) <= counters and found >= {k for k, n in true.items() if n >= 2 * len(keys) / (counters + 1)}


def test_frequent_rows_are_not_shuffled(spark):
    """Rows of a frequent digest are settled before the shuffle of the others."""
    docs = spark.createDataFrame([(k, "hot" if k % 2 else f"t{k}") for k in range(2000)], "doc_id long, text string")
    rows, heavy, rest = exactdup._settled(docs, 16, "doc_id", "text")
    assert [r["group_size"] for r in heavy.collect()] == [1000]
    assert rest.count() == 1000 and rest.agg(F.max("group_size")).first()[0] == 1


def test_bytes_view():
    assert [x.tobytes() for x in as_bytes(pa.array(["a", "ü"]))] == [b"a", "ü".encode()]
