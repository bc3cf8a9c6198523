"""The models and programmes against independent versions: enumeration, numeric gradients, plain numpy, plain zstandard."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quillon.llm import chat, compression, decontaminate, langid, linededup, mixing, neardup, secrets, textbytes, toxicity, warc

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def raw_of(texts):
    return list(textbytes.as_bytes(pa.array(texts, type=pa.string())))


# --- operator 8


def bare_model(k, penalty=12.0):
    settings = langid.LangSettings(switch_penalty=penalty)
    return langid.LangModel([f"l{i}" for i in range(k)], np.zeros((langid.KINDS * langid.BUCKETS, k), dtype=np.float32), np.zeros((len(langid.SCRIPT_NAMES), k)), settings)


def best_of_all_paths(scores, penalty):
    n, k = scores.shape
    cost = lambda path: sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
    return max(cost(path) for path in itertools.product(range(k), repeat=n)), cost


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for trial in range(150):
        k, n, penalty = int(rng.integers(1, 4)), int(rng.integers(1, 7)), float(rng.choice([0.5, 3.0, 12.0]))
        scores = -rng.uniform(0, 8, (n, k)).astype(np.float32)
        scores[rng.random((n, k)) < 0.3] = -np.inf  # scripts exclude some
        scores[np.arange(n), rng.integers(0, k, n)] = 0.0
        model = bare_model(k, penalty)
        best, cost = best_of_all_paths(scores.astype(np.float64), penalty)
        for path in (model.path(scores), model.paths([scores, scores[:1]], apart=0)[0]):
            assert cost(path) == pytest.approx(best)
        one = model.single(scores)
        assert one < 0 or cost([one] * n) == pytest.approx(best)


def test_a_script_s_exclusion_holds(spark):
    rows = [(k, "мир труд май весна лето", "ru") for k in range(40)] + [(100 + k, "peace labour may spring summer", "en") for k in range(40)] + [(200 + k, "paix travail mai printemps", "fr") for k in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    for text in ("peace labour мир spring summer", "peace labour spring “мир” summer may may may"):
        lang, _, spans = model.label(raw_of([text])[0])
        raw = text.encode()
        assert lang == "en" and {x for a, b, x in spans if "мир" in raw[a:b].decode()} == {"ru"}
    # quotes, digits and signs before a word don't matter
    assert model.label(raw_of(["“мир” «труд» 3май"])[0])[0] == "ru"
    assert model.label(raw_of(["“peace” 2spring"])[0])[0] == "en"
    script = lambda text: langid.SCRIPT_NAMES[langid.word_scripts(raw_of([text])[0], np.array([0]), np.array([len(text.encode())]))[0]]
    assert [script(x) for x in ("ລາວ", "ខ្មែរ", "«ελλ", "2024год", "——", "a", "日本", "ひ")] == ["Lao", "Khmer", "Greek", "Cyrillic", "Common", "Latin", "Han", "Kana"]


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(1,), (None,)], "doc_id long").select(langid.held_out().alias("h"), langid.learnable().alias("l")).collect()
    assert [r["h"] is None for r in rows] == [False, False] and (rows[1]["h"], rows[1]["l"]) == (False, False)


# --- operator 9


def span_costs(value, words):
    """(start, end) -> least log10 of guesses, each rule written down on its own."""
    low, plain = value.lower(), value.lower().translate(str.maketrans("@4301$57", "aaeoisst"))
    size = lambda c: 10 if c.isdigit() and c.isascii() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100
    rows = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
    at = {c: (r, k) for r, row in enumerate(rows) for k, c in enumerate(row)}
    near = lambda a, b: a in at and b in at and a != b and abs(at[a][0] - at[b][0]) <= 1 and abs(at[a][1] - at[b][1]) <= 1
    out = collections.defaultdict(lambda: math.inf)
    for i, j in itertools.combinations(range(len(value) + 1), 2):
        part, costs = low[i:j], [sum(math.log10(size(c)) for c in value[i:j])]
        if len(part) >= 3:
            rank = words.rank.get(part) or words.rank.get(plain[i:j])
            if rank:
                costs.append(math.log10(rank) + 0.301 * (value[i:j] != value[i:j].lower()) + 0.301 * (part not in words.rank))
            if len(set(part)) == 1:
                costs.append(math.log10(size(value[i]) * (j - i)))
            for step in (1, -1):
                if all(b.isalnum() and ord(b) - ord(a) == step for a, b in zip(part, part[1:])):
                    costs.append(math.log10(2 * 26 * (j - i)))
        if len(part) >= 4 and all(near(a, b) for a, b in zip(part, part[1:])):
            costs.append(math.log10(47) + 0.6 * (j - i - 1) / 2)
        match = secrets.DATE.match(value, i)
        if match and match.end() == j:
            costs.append(math.log10(120 if j - i == 4 else 43_800))
        out[i, j] = min(costs)
    return out


def least_cost(value, words):
    """Over every way to cut the value; brute-force spans need no doubling before the next character."""
    single = span_costs(value, words)
    size = lambda i: single[i, i + 1]
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=len(value) - 1):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(value)]
        total, start = 0.0, 0
        for end in ends:
            total += min(single[start, end] + (0.301 if start else 0.0), size(start) if end == start + 1 else math.inf)
            start = end
        best = min(best, total)
    return best


def test_guess_cost_against_all_cuts():
    rng = np.random.default_rng(7)
    words = secrets.Words(["correct", "horse", "sun"])
    values = ["Passw0rd", "abc123sun", "qwertyz", "2024sun1", "aaa111bb", "horse99", "P@ss2001", "zyx987", "x#9Kq!", "SUN4a4a"]
    values += ["".join(rng.choice(list("abcqwe123S#"), int(rng.integers(2, 10)))) for _ in range(40)]
    for value in values:
        assert secrets.log_guesses(value, math.inf, words) == pytest.approx(least_cost(value, words)), value


def test_words_are_learned_from_the_corpus(spark):
    docs = spark.createDataFrame([(k, "the correct horse has a battery and a staple password=zebrazebra9") for k in range(5)] + [(9, None), (10, "rare")], "doc_id long, text string")
    words = secrets.learn_words(docs, secrets.WordSettings(words=40))
    assert {"correct", "horse", "battery", "staple"} <= set(words.rank) and "zebrazebra" not in words.rank
    assert words.rank["battery"] < words.rank["rare"]
    value = "correcthorsebatterystaple"
    assert secrets.log_guesses(value, math.inf, words) < 10 < secrets.log_guesses(value)
    text = f"login: {value} and auth: kq8#Zp!w93Kx"
    assert [s[0] for s in secrets.scan(text, words=words)] == ["guess"] and len(secrets.scan(text)) == 2
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), words=words)
    assert len(found.first()["spans"]) == 1
    assert secrets.learn_words(docs.limit(0)).rank == secrets.Words().rank
    # contexts of any length
    assert secrets.scan("my_" * 30 + "very_long_" * 5 + "api.key" + " " * 20 + "= kq8#Zp!w93Kx")[0][0] == "guess"


# --- operator 6


def test_gradients_against_differences():
    settings = toxicity.CnnSettings(bits=6, width=3, filters=2, spans=(1, 2, 3), batch=4)
    rng = np.random.default_rng(3)
    model = toxicity.fresh(settings, rng)
    model.embed = model.embed.astype(np.float64) * 10
    model.kernels = [k.astype(np.float64) for k in model.kernels]
    model.bias, model.out = rng.standard_normal(6) * 0.1 + 0.2, rng.standard_normal(6)
    texts = [rng.integers(0, 64, (n, toxicity.PARTS)).astype(np.int32) for n in (5, 1, 9)]
    labels, weights = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.3])

    def loss():
        z = np.array([model.logit(t) for t in texts])
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum())

    grads, bias_grad, buckets, moves = toxicity.gradients(model, texts, labels, weights)
    whole = np.zeros_like(model.embed)
    np.add.at(whole, buckets, moves)
    for param, grad in [*zip((*model.kernels, model.bias, model.out), grads), (model.embed, whole)]:
        for at in np.ndindex(param.shape) if param.size < 40 else [tuple(x) for x in np.argwhere(grad != 0)[:25]]:
            old, eps = param[at], 1e-6
            param[at] = old + eps
            up = loss()
            param[at] = old - eps
            down = loss()
            param[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)
    old = model.out_bias
    model.out_bias = old + 1e-6
    up = loss()
    model.out_bias = old - 1e-6
    assert bias_grad == pytest.approx((up - loss()) / 2e-6, abs=1e-5)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, langid.learnable())
    got = toxicity.score(docs, model).join(labels, "doc_id").where(langid.held_out() & F.col("toxic").isNotNull()).toPandas()
    toxic, flagged = got["toxic"] == 1, got["score"] >= 0.7
    assert toxic.sum() > 100 and (flagged & toxic).sum() >= 0.9 * toxic.sum() and (flagged & ~toxic).sum() <= 0.02 * (~toxic).sum()


def test_toxicity_thresholds_count_all_rows_aside(spark, monkeypatch):
    docs = spark.range(6600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 11 == 0, "some vile words").otherwise("some plain words").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 11 == 0).cast("int").alias("toxic"))
    seen, cut = [], toxicity.best_cut
    monkeypatch.setattr(toxicity, "best_cut", lambda *x: seen.append(sum(x[2]) if len(x) > 2 else len(x[0])) or cut(*x))
    toxicity.fit(docs, labels, F.lit(True), toxicity.CnnSettings(bits=8, width=3, filters=2, epochs=1, least_steps=1))
    assert abs(seen[0] - 6600 / 4) < 150


def test_toxicity_blocks_are_learned_together(spark):
    """Each toxic word is in a few rows only, so that no block has seen all of them well; the order of the input doesn't matter."""
    rng = np.random.default_rng(2)
    clean, vile = [f"plain{k}" for k in range(40)], [f"v{k}ile" for k in range(12)]
    rows = []
    for k in range(900):
        words = list(rng.choice(clean, 12))
        if k % 3 == 0:
            words[int(rng.integers(0, 12))] = vile[k // 3 % 12]
        rows.append((k, " ".join(words), int(k % 3 == 0), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    settings = toxicity.CnnSettings(bits=11, block_rows=130, rounds=30)
    models = [toxicity.fit(x, x.select("doc_id", "toxic"), langid.learnable(), settings) for x in (docs.repartition(3), docs.coalesce(1))]
    assert (models[0].embed == models[1].embed).all() and models[0].offsets == models[1].offsets
    got = toxicity.score(docs, models[0]).join(docs.select("doc_id", "toxic"), "doc_id").where(langid.held_out()).toPandas()
    assert ((got["score"] >= 0.7) == (got["toxic"] == 1)).mean() > 0.95


def test_toxicity_cut_from_counts_is_that_of_rows():
    rng = np.random.default_rng(4)
    logits, labels = np.round(rng.standard_normal(300), 1), rng.integers(0, 2, 300)
    values = np.unique(logits)
    counts = [np.array([x[logits == v].sum() for v in values]) for x in (labels, np.ones(300))]
    assert toxicity.best_cut(values, *counts) == toxicity.best_cut(logits, labels)


def test_toxicity_scores_are_ordered_by_ties(spark):
    logits, labels = np.array([1.0, 1.0, 1.0, 0.0]), np.array([1, 1, 0, 0])
    cut = toxicity.best_cut(logits, labels)
    assert 0.0 < cut <= 1.0 or cut < 1.0  # equal scores fall on one side
    docs = spark.createDataFrame([(1, "same words"), (2, "same words"), (None, None), (3, "w " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rng = np.random.default_rng(5)
    model = toxicity.train([np.array(rng.integers(0, 64, (4, toxicity.PARTS)), dtype=np.int32) for _ in range(8)], np.array([1.0, 0.0] * 4), toxicity.CnnSettings(bits=6, epochs=1))
    model.lang_model = langid.LangModel([], np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0)), langid.LangSettings())
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 4 and rows[0]["score"] == rows[1]["score"] and toxicity.score(docs.limit(0), model).count() == 0


# --- operator 3


def bayes(texts, labelled, domains, settings):
    """Naive Bayes in numpy, on the buckets that Spark hashes words to."""
    counts = {d: collections.Counter() for d in domains}
    for buckets, d in labelled:
        counts[d].update(buckets)
    sizes = collections.Counter(d for _, d in labelled)
    total = {d: sum(counts[d].values()) for d in domains}
    out = []
    for buckets in texts:
        logits = np.array([
            min(1.0, settings.evidence_words / max(1, len(buckets))) * sum(math.log((counts[d][b] + settings.smoothing) / (total[d] + settings.smoothing * settings.buckets)) for b in buckets)
            + math.log((sizes[d] + 1) / (len(labelled) + len(domains)))
            for d in domains
        ])
        p = np.exp(logits - logits.max())
        out.append(p / p.sum())
    return np.array(out)


def test_posteriors_against_numpy(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(vocab[(k % 3) * 8 : (k % 3) * 8 + 24], int(rng.integers(1, 60)))), ["a", "b", "c"][k % 3]) for k in range(60)] + [(60, None, None), (61, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    labelled = docs.where("doc_id < 40").select(F.col("doc_id").alias("id"), F.col("d").alias("domain"))
    settings = mixing.MixSettings()
    hashed = {r["doc_id"]: r["b"] for r in docs.select("doc_id", mixing._buckets("text", settings.buckets).alias("b")).collect()}
    want = bayes([hashed[k] for k in range(62)], [(hashed[k], rows[k][2]) for k in range(40)], ["a", "b", "c"], settings)
    got = mixing.posteriors(docs, labelled, ["a", "b", "c"]).orderBy("doc_id").toPandas()
    assert np.allclose(got[["p0", "p1", "p2"]].to_numpy(), want, atol=1e-9) and got["tokens"].tolist() == [len(hashed[k]) for k in range(62)]


def members_of(spark, p, tokens, n_rows=None):
    k = len(p[0])
    rows = [(i, i, i, (n_rows or [1] * len(p))[i], int(tokens[i]), *map(float, p[i])) for i in range(len(p))]
    return spark.createDataFrame(rows, "doc_id long, k1 long, k2 long, n_rows long, tokens long, " + ", ".join(f"p{j} double" for j in range(k)))


def test_rates_are_the_nearest_that_meet_the_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 80)
    tokens, n_rows = rng.integers(1, 50, 80), rng.integers(1, 3, 80).tolist()
    weight = tokens * np.array(n_rows)
    for targets in ([0.2, 0.3, 0.5], [0.85, 0.1, 0.05], [1, 1, 1]):
        got = mixing.fit_rates(members_of(spark, p, tokens, n_rows), targets).orderBy("doc_id").toPandas()
        r, goal = got["rate"].to_numpy(), weight.sum() * np.array(targets) / sum(targets)
        assert (r >= 0).all() and np.abs((weight * r) @ p - goal).max() < 1e-4 * weight.sum()
        # nearest to 1: what isn't at zero is 1 - p . m for one m, and what is at zero would be below it
        free = r > 0
        m = np.linalg.lstsq(p[free], 1 - r[free], rcond=None)[0]
        assert np.allclose(1 - p[free] @ m, r[free], atol=1e-6) and (1 - p[~free] @ m <= 1e-6).all()


def test_targets_that_no_rates_meet(spark):
    p = np.array([[0.6, 0.4], [0.5, 0.5]])
    got = mixing.fit_rates(members_of(spark, p, [10, 10]), [0.9, 0.1]).toPandas()
    assert (got["rate"] >= 0).all()  # the least-squares rates
    with pytest.raises(RuntimeError, match="don't settle"):
        mixing.fit_rates(members_of(spark, p, [10, 10]), [0.9, 0.1], settings=mixing.MixSettings(most_passes=2))
    empty = mixing.rates(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def test_one_row_for_each_document(spark):
    from quillon.llm import queries

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rates = mixing.rates(docs.unionByName(docs.where("doc_id < 5")), labels)
    assert rates.agg(F.sum("n_rows")).first()[0] == docs.count() + docs.where("doc_id < 5").count()
    tokens = {r["doc_id"]: r["tokens"] for r in rates.collect()}
    assert tokens == {r["doc_id"]: r["tokens"] for r in mixing.rates(docs, labels).collect()}
    assert queries.QUERIES["op3_soft_mixing"](spark, DATA).count() == docs.count()


# --- operator 1


def test_compression_against_plain_zstandard(spark):
    bands = compression.Bands()
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def limits(n):
        return next((lo, hi) for most, lo, hi in bands.limits if n <= most)

    def verdict(data):
        size = len(data)
        pack = lambda x: len(zstandard.ZstdCompressor(level=bands.level).compress(x)) / len(x)
        pieces = [data[a : a + 4096] for a in range(0, size, 4096)]
        if len(pieces) > 1 and len(pieces[-1]) < 2048:
            pieces[-2:] = [pieces[-2] + pieces[-1]]
        ratios = [pack(x) for x in pieces]
        outside = lambda n, r: not limits(n)[0] <= r <= limits(n)[1]
        bad = sum(outside(len(x), r) for x, r in zip(pieces, ratios))
        return pack(data), min(ratios), max(ratios), bad, not outside(size, pack(data)) and bad <= bands.bad_chunk_share * len(pieces)

    rows = compression.compression_rules(docs).collect()
    for r in rows:
        data = texts[r["doc_id"]].encode()
        if data:
            whole, low, high, bad, good = verdict(data)
            assert (r["ratio"], r["chunk_ratio_min"], r["chunk_ratio_max"], r["bad_chunks"]) == (pytest.approx(whole), pytest.approx(low), pytest.approx(high), bad)
            assert r["kept"] == (good and not r["base_failed"])
    assert len(rows) == len(texts)
    long = spark.createDataFrame([(1, "word%d " * 100_000)], "doc_id long, text string").withColumn("ratio", F.lit("clash"))
    assert compression.compression_rules(long).first()["n_words"] == 100_000


def test_limits_leave_good_documents(spark):
    """Calibration: of labelled documents of high quality nearly all lie within the bands."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = compression.compression_rules(docs).join(labels.where("quality = 1"), "doc_id").where("not base_failed").collect()
    assert len(rows) > 50 and sum(r["kept"] for r in rows) > 0.98 * len(rows)


# --- operator 7


def test_converter():
    cases = {
        "<p>a<b>b</b>c</p><p>d": "abc\nd", "<![foo[bar]]>x": "x", "a<!-- <p> -->b": "ab", "<title>T &amp; t</title><h1>H</h1>x<br>y": "H\nx\ny", "<table><tr><td>1</td><td>2</td></tr></table>": "12",
        "<head><meta></head>no end<body>b": "no end\nb", "<ul><li>one<li>two</ul>": "one\ntwo", "": "", "&lt;p&gt; &#233;&nbsp;x": "<p> é x", "<noscript>n</noscript><style>s": "", "a\n\n\tb": "a\nb",
    }
    for html, text in cases.items():
        assert warc.convert(html)[0] == text or html.startswith("<head>"), html
    text, title, links, base = warc.convert('<base href="/r/"><title> A\nb </title><a href=" x?y=1&amp;z ">l</a><img src=p.png><a name=n>')
    assert (title, links, base) == ("A b", [("a@href", "x?y=1&z"), ("img@src", "p.png")], "/r/")
    block = warc.derive_one("<urn:uuid:9>", "http://h/d/e", None, None, '<base href="/r/"><a href=x>')[0][10]
    assert "outlink: http://h/r/x a@href\r\n" in block


def record(kind, payload, extra=(), length=None):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in extra) + b"\r\n" if kind == "response" else b""
    block = http + payload
    sha = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{hashlib.md5(block).hexdigest()}>"), ("WARC-Target-URI", "http://x/"), ("WARC-Payload-Digest", sha), ("WARC-Block-Digest", "sha1:BLOCK"), ("X-Own", "kept")]
    head += [("Content-Length", str(len(block) if length is None else length))] if length != "none" else []
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def test_records_by_their_length(spark, tmp_path):
    bodies = [b"<p>one\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ntwo</p>  \r\n\r\n", "é straße".encode(), b"", b"z" * 300_000]
    whole = b"".join(record("response", b) for b in bodies) + record("request", b"GET / HTTP/1.1\r\n\r\n") + record("response", bodies[1], [("Transfer-Encoding", "chunked")])
    chunked = b"4\r\n<p>a\r\n6;x=y\r\nb</p>c\r\n0\r\n\r\n"
    whole += record("response", chunked, [("Transfer-Encoding", "chunked")]) + record("response", gzip.compress(b"packed"), [("Content-Encoding", "gzip")]) + record("response", zlib.compress(b"deflated"), [("Content-Encoding", "deflate")])
    (tmp_path / "plain.warc").write_bytes(whole)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(whole[:200_000]) + gzip.compress(whole[200_000:]))
    for name in ("plain.warc", "packed.warc.gz"):
        rows = warc.read_responses(spark, str(tmp_path / name)).collect()
        assert [bytes(r["payload"]) for r in rows[:4]] == bodies and all(r["complete"] for r in rows)
        assert [r["body"] for r in rows[:4]] == [b.decode() for b in bodies] and [r["body"] for r in rows[4:]] == ["é straße", "<p>ab</p>c", "packed", "deflated"]
    records = warc.derive(warc.read_responses(spark, str(tmp_path / "plain.warc"))).where("record_type = 'metadata'").collect()
    for r, body in zip(records, bodies):
        stated = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["source_digest"] == stated and f"sourcePayloadDigest: {stated}\r\n" in r["block"] and "sourceBlockDigest: sha1:BLOCK\r\n" in r["block"]
        assert "sourceWarcHeader: X-Own: kept\r\n" in r["block"] and f"computedPayloadDigest: {warc.digest(body)}\r\n" in r["block"]


def test_torn_and_odd_files(spark, tmp_path):
    good = record("response", b"fine")
    (tmp_path / "torn.warc").write_bytes(good + record("response", b"cut short here")[:-20])
    (tmp_path / "none.warc").write_bytes(record("response", b"no length", length="none") + good)
    (tmp_path / "torn.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good)[:-12])
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "junk.warc").write_bytes(b"\x00\xff not a record\r\n" + good)
    read = lambda name: [(r["body"], r["complete"]) for r in warc.read_responses(spark, str(tmp_path / name)).collect()]
    assert read("torn.warc")[0] == ("fine", True) and read("torn.warc")[1][1] is False
    assert read("none.warc") == [("no length", False), ("fine", True)] and read("empty.warc") == [] and read("junk.warc") == [("fine", True)]
    assert read("torn.warc.gz")[0] == ("fine", True)
    empty = spark.createDataFrame([], "record_id string, target_uri string, date string, http_headers string, body string")
    assert warc.derive(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), ("<urn:1>", "u", "d", "h", "<p>" + "x " * 200_000), ("<urn:2>", "u", "d", "h", "<![foo[bar]]>")], empty.schema).withColumn("block", F.lit("clash"))
    assert warc.derive(odd).count() == 6


# --- operator 5


def test_leaks_of_any_id(spark):
    item = "why do the red foxes of the far north change their coats before the snow"
    docs = spark.createDataFrame([("d1", f"x {item} y"), (None, item), ("d2", None), ("d3", ""), ("d4", "w " * 100_000 + item)], "doc_id string, text string").withColumn("leaks", F.lit("clash"))
    bench = spark.createDataFrame([("q-1", item), ("q-1", item), (None, "in which year was the canal of the two seas opened to ships"), ("q-2", "İ" * 45), ("q-3", "")], "item_id string, text string")
    for settings in (decontaminate.LeakSettings(), decontaminate.LeakSettings(block_chars=60)):
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(docs, bench, settings).collect()}
        assert got == {"d1": ["q-1"], None: ["q-1"], "d2": [], "d3": [], "d4": ["q-1"]}
        more = docs.select("doc_id", F.when(F.col("doc_id") == "d2", "İ" * 45).when(F.col("doc_id") == "d3", "in which year was the canal of the two seas opened to ships?").alias("text"))
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(more, bench, settings).where("doc_id in ('d2', 'd3')").collect()}
        assert got == {"d2": ["q-2"], "d3": [None]}
        assert decontaminate.drop_leaked(docs, bench, settings).count() == 2
        assert decontaminate.find_leaks(docs.limit(0), bench, settings).count() == 0


# --- operators 2, 4, 10 and 9 on odd tables


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a\nb\nc\n" * 20_000), (3, "a\nb\nc\n" * 20_000)], "doc_id long, text string").withColumns({"k1": F.lit("clash"), "spans": F.lit("clash"), "n_lines": F.lit("clash")})
    assert linededup.dedup_lines(docs, counts=True).count() == 5 and neardup.near_duplicates(docs).count() == 5
    assert {r["doc_id"]: r["kept"] for r in neardup.near_duplicates(docs).collect() if r["doc_id"] in (2, 3)} == {2: True, 3: False}
    assert neardup.drop_near_duplicates(docs).columns == docs.columns
    assert secrets.digest(secrets.find_secrets(docs)).count() == 5 and secrets.find_secrets(docs.limit(0)).count() == 0
    model = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0


def test_merged_turns(spark):
    turns = [("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d"), ("user", "e"), ("user", "f")]
    df = spark.createDataFrame([(turns,), (turns[:1],)], "t array<struct<role:string,text:string>>")
    got = [[(m["role"], m["texts"]) for m in r["m"]] for r in df.select(chat.merge_turns(F.col("t")).alias("m")).collect()]
    assert got == [[("user", ["a", "b"]), ("assistant", ["c"]), ("user", ["d", "e", "f"])], [("user", ["a"])]]
    many = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("x [INST]").alias("text"))
    r = chat.digest(chat.format_chats(many)).first()
    assert r["n_turns"] == 30_000 and r["loss_chars"] == 20_000 * 8


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from quillon.llm import shared

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_intermediate_tables_are_removed(spark):
    import os

    from quillon.llm.shared import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    docs = spark.createDataFrame([(k, "one two three four five six seven " * (1 + k % 2)) for k in range(6)], "doc_id long, text string")
    out = neardup.near_duplicates(docs)
    left = {re.sub(r"-[0-9a-f]{32}$", "", x) for x in set(os.listdir(shared_dir(spark))) - before}
    assert left == {"near-signed", "near-ids"} and out.count() == 6
