"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, compression, decontaminate, exactdup, fim, langid, linededup, merkle, mixing, neardup, secrets, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    p = [F.round(f"p{k}", 6).alias(f"p_{d}") for k, d in enumerate(mixing.TARGETS)]
    rates = rates.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))  # one row per document
    return rates.select("doc_id", "tokens", *p, F.round("rate", 6).alias("rate"), mixing.copies(F.col("rate")).alias("copies"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.transform("leaks", lambda x: x["item_id"])
    return found.select("doc_id", F.size("leaks").cast("long").alias("n_items"), (F.size("leaks") > 0).alias("contaminated"), F.array_join(items, ",").alias("items"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), langid.learnable())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= model.settings.cut).cast("int").alias("predicted"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    digest = [F.sha2("block", 256).alias("block_sha256"), F.sha2("record", 256).alias("record_sha256")]
    return records.select("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_digest", *digest)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.learnable())
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, words=secrets.learn_words(docs)))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = F.lit("</s>[INST] ok [/INST]").alias("text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), same)
    return chat.digest(chat.format_chats(turns.unionByName(odd)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's proofs; every third document by its id's CRC is folded from a leaf with a lower-cased text."""
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    lower = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.digest(merkle.build(docs, carried={"other": merkle.tampered(docs, third, lower)}).proofs())


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.digest(exactdup.exact_duplicates(table(spark, sf_dir, "documents")))


#: op4 in SQL is quadratic in what shares a shingle; fine for small tables only.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), rare AS (
  SELECT * FROM grams WHERE g IN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_rules": op1_compression_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_chat_format": op10_chat_format,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": linededup.DIGEST_SQL,
    "op4_near_dedup": NEAR_SQL,
    "op10_chat_format": chat.DIGEST_SQL,
    "op11_fill_in_middle": fim.DIGEST_SQL,
    "op12_merkle_manifest": merkle.DIGEST_SQL,
    "op13_exact_dedup": exactdup.DIGEST_SQL,
}
