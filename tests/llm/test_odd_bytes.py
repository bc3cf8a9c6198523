"""Texts that aren't valid UTF-8 stop no operator and no stage."""

import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, queries, secrets, toxicity, warc

DATA = "/root/testdata/sf0.001"
BAD = b"token=abcdef\xff\xfe123 \x80 tail \xe5\xad word " * 3


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with invalid bytes in every 20th document and page."""
    folder = tmp_path_factory.mktemp("odd")
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        shutil.copy(f"{DATA}/{name}.parquet", folder)
    for name, column in (("documents", "text"), ("pages", "html")):
        t = pq.read_table(folder / f"{name}.parquet")
        texts = [BAD + (x or "").encode() if k % 20 == 0 else None if x is None else x.encode() for k, x in enumerate(t[column].to_pylist())]
        t = t.set_column(t.column_names.index(column), column, pa.array(texts, pa.binary()).view(pa.string()))
        pq.write_table(t, folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, odd, name):
    assert len(queries.QUERIES[name](spark, odd).collect()) >= queries.table(spark, odd, "conversations" if "op10" in name else "pages" if "op7" in name else "documents").count() * ("op10" not in name)


def test_pipeline(spark, odd):
    assert corpus_pipeline.run(spark, odd).count() > 50


def test_results_around_invalid_bytes(spark):
    docs = spark.createDataFrame([(1, bytearray(b"\xffpassword=hunter22 \xfe")), (2, bytearray(b"\xc3"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    found = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert found == {1: [("assign", 1, 18), ("guess", 10, 18)], 2: []}
    left = {r["doc_id"]: bytes(r["b"]) for r in secrets.redact(docs).select("doc_id", F.col("text").cast("binary").alias("b")).collect()}
    assert left == {1: "�[SECRET] �".encode(), 2: b"\xc3"}
    bench = spark.createDataFrame([(9, "password=hunter22")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, bench).where(F.size("leaks") > 0).collect()] == [1]
    kept = decontaminate.drop_leaked(docs, bench).select(F.col("text").cast("binary")).collect()
    assert [bytes(r[0]) for r in kept] == [b"\xc3"]


def test_records_are_parted_by_two_line_ends(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>page {k} é</p>") for k in range(5)], "page_id long, url string, html string").coalesce(1)
    records = warc.derive(warc.responses_of_pages(pages))
    want = "".join(r["record"] for r in records.collect())
    warc.write_records(records, f"{tmp_path}/plain", "none")
    (file,) = (tmp_path / "plain").glob("part-*")
    assert file.read_bytes() == want.encode()


def test_long_texts_are_learned_from(spark):
    """Every toxic text is long, and toxic in one place only."""
    import random

    rng = random.Random(1)
    clean = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(80):
        words = [rng.choice(clean) for _ in range(400)]
        if k % 2:
            at = rng.randrange(0, 390)
            words[at : at + 3] = ["vile", "nasty", "slur"]
        rows.append((k, " ".join(words), k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("lang", F.lit("en"))
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 60, toxicity.CnnSettings(window_words=100, bits=10))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    right = sum((scores[k] >= 0.7) == bool(y) for k, _, y in rows if k >= 60)
    assert right >= 17, right
    assert set(model.offsets) == {"en"} and model.offsets["en"] != 0
