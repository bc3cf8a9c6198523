"""Question documents and JSON lines as tables; all reading and writing is Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTION = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))
QUESTION = T.StructType([
    T.StructField("external_id", T.StringType()), T.StructField("course", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("question_type", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("question", T.StringType()), T.StructField("options", OPTION),
    T.StructField("answer", T.StringType()), T.StructField("marks", T.LongType()), T.StructField("year", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType())),
])
DOCUMENT = T.StructType([T.StructField("bank_version", T.StringType()), T.StructField("questions", T.ArrayType(QUESTION)), T.StructField("items", T.ArrayType(QUESTION))])
# What other names a question type goes by.
KINDS = {"single_choice": "mcq", "single": "mcq", "multiple_select": "msq", "multiple": "msq", "numerical": "nat", "numeric": "nat", "integer": "nat"}


def question_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of JSON files: a flat array, `{questions: [...]}` or `{items: [...]}`.

    Without a version of its own a document has the first 12 digits of its SHA-256.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("raw"))
    doc, flat = F.from_json("raw", DOCUMENT), F.from_json("raw", T.ArrayType(QUESTION))
    listed = F.when(F.trim("raw").startswith("["), flat).otherwise(F.coalesce(doc["questions"], doc["items"]))
    version = F.coalesce(doc["bank_version"], F.substring(F.sha2("raw", 256), 1, 12))
    rows = raw.select(version.alias("bank_version"), listed.alias("list")).select("bank_version", F.posexplode("list").alias("seq", "q")).select("bank_version", "seq", "q.*")
    kind = F.lower(F.coalesce("question_type", "type"))
    for name, short in KINDS.items():
        kind = F.when(kind == name, F.lit(short)).otherwise(kind)
    return rows.withColumns({"question_type": kind, "text": F.coalesce("text", "question")}).drop("type", "question")


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Multi-line JSON that must fit the schema; a file that doesn't fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def strict_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(path, checksum, the schema's columns) of JSON files, one object each; the checksum is that of the raw bytes.

    A file that isn't such an object, lacks a field that can't be null, or has a field that the schema doesn't name, is an error.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("checksum"), F.decode("content", "UTF-8").alias("_text"))
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    doc = F.from_json("_text", schema)
    extra = F.array_except(F.json_object_keys("_text"), known)
    lacks = F.lit(False)
    for f in schema.fields:
        if not f.nullable:
            lacks = lacks | F.get_json_object("_text", f"$.{f.name}").isNull()
    problem = F.when(F.json_object_keys("_text").isNull() | doc.isNull(), "not an object").when(F.size(extra) > 0, F.concat(F.lit("unknown fields "), F.array_join(extra, ", "))).when(lacks, "a required field is missing")
    checked = raw.withColumn("_doc", F.when(problem.isNull(), doc).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": "), problem)).cast(schema)))
    return checked.select("path", "checksum", "_doc.*")


def write_canonical_json(df: DataFrame, path: str) -> None:
    """Replaces the folder's JSON lines: keys sorted, nulls written, one line a row; the commit is atomic."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], seq: str) -> DataFrame:
    """JSON lines, the last row of each key by `seq`; a broken line is an error unless it is the file's last.

    A torn last line is what an interrupted writer leaves.
    """
    # place of a line: the split it is in, then its row there
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("_at")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}))
    judged = parsed.join(parsed.groupBy("file").agg(F.max("_at").alias("_last")), "file")
    broken = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    # one expression: whether a line may be broken is known only after the join
    ok = F.when(~broken, F.lit(True)).when(F.col("_at") == F.col("_last"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("broken line in "), F.col("file"))).cast("boolean"))
    rows = judged.where(ok).select("row.*", "_at").drop("_corrupt")
    order = F.struct(F.col(seq), F.col("_at"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in schema.names if c not in keys)), order).alias("r")).select(*keys, "r.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replaces the folder's JSON lines; the commit is atomic."""
    df.write.mode("overwrite").json(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of cached files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def page_text(pages: DataFrame, least_chars: int = 250) -> DataFrame:
    """The text to use of each page: its own if long enough, else the recognised one, else its own with low confidence.

    `pages`: (doc, page, text, ocr_text, ocr_confidence).
    """
    own, ocr = F.coalesce("text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    enough = F.length(own) >= least_chars
    method = F.when(enough, "text").when(ocr != "", "ocr").otherwise("low_text")
    confidence = F.when(enough, F.lit(0.98)).when(ocr != "", F.col("ocr_confidence")).otherwise(F.lit(0.35))
    return pages.select("doc", "page", F.when(method == "ocr", ocr).otherwise(own).alias("text"), method.alias("method"), confidence.alias("confidence"))
