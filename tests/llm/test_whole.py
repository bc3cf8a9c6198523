"""Operators do the whole job: long values, small and many languages, short items, repeated rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, secrets, textbytes


def test_secrets_of_any_length(spark):
    rng = random.Random(1)
    value = "".join(rng.choice("abcXYZ019+/_-") for _ in range(1000))
    text = f"auth: {value} and more"
    assert secrets.scan(text) == [("guess", 6, 1006)]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(docs).first()["text"] == "auth: [SECRET] and more"
    # long but cheap: not a secret
    assert secrets.scan("login: " + "x" * 50_000) == []


def test_guess_cost_decides_on_one_class_after_a_sign():
    lower, pin = "qzjxvkwpmbtgfhyrcndl", "839204715562"
    for sign in ("=", ": ", " = ", "=>"):
        for value in (lower, lower.upper(), pin):
            assert [x[0] for x in secrets.scan(f"user_pwd{sign}{value}")] == ["guess"]
    assert secrets.scan(f"the pin is {pin}") == [("guess", 11, 23)]
    assert secrets.scan("the key is unquestionably clear") == secrets.scan("pin: 20240115") == []


@pytest.mark.parametrize("value", ["summer2024!", "aaaabbbb12", "xqwertyz1999", "P@ssw0rdLove", "x" * 300, "abcdefgh" * 3, "asdfdsasdf9"])
def test_guess_cost_up_to_a_limit(value):
    cost = secrets.log_guesses(value)
    for limit in (1.0, cost - 0.01, cost + 0.01, math.inf):
        assert secrets.log_guesses(value, limit) == min(cost, limit)


def language_rows(sizes, seed=3):
    """(lang, words): languages of invented words, each from an alphabet of its own."""
    rng = random.Random(seed)
    rows = []
    for k, (rows_of, words) in enumerate(sizes):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        vocab = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(40)]
        rows += [(f"l{k:03}", " ".join(rng.choice(vocab) for _ in range(words))) for _ in range(rows_of)]
    return [(i, text, lang) for i, (lang, text) in enumerate(rows)]


def test_rare_languages_are_found(spark):
    rows = language_rows([(200, 200), (200, 200), (2, 12), (2, 12)])
    rows.append((999, "мир труд " * 30, "l000"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_more_than_256_languages(spark):
    rows = language_rows([(2, 30)] * 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, F.lit(True))
    assert len(model.langs) == 300
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.98 * len(rows)
    # parts of a long text score like the whole
    raw = next(iter(textbytes.as_bytes(pa.array([" ".join(r[1] for r in rows)]))))
    long, short = model.word_scores(raw)[2], [model.word_scores(raw[a : a + 2000])[2] for a in (0,)]
    assert len(raw) * 300 > 8_000_000 and np.allclose(long[: len(short[0]) - 1], short[0][:-1], atol=1e-4)


def test_mixed_documents_stay(spark):
    rows = language_rows([(40, 40)] * 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    mixed = "\n".join(" ".join([next(t for _, t, x in rows if x == lang)] * 2) for lang in model.langs)
    lang, score, spans = model.label(next(iter(textbytes.as_bytes(pa.array([mixed])))))
    assert score < 0.3 and {s[2] for s in spans} == set(model.langs)
    odd = spark.createDataFrame([(1, mixed), (2, "x"), (3, "1 2 3"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.keep_identified(odd, model).collect()) == [1, 2]
