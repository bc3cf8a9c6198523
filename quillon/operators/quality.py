"""Data-quality rules, completeness checks and the n-gram overlap audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.sources.shared import tasks


def codes(rules: dict[str, Column]) -> Column:
    """Sorted codes of the rules that hold (null counts as not); a row passes if there are none."""
    return F.array_sort(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))


def first_code(rules: dict[str, Column]) -> Column:
    """The first rule that holds, in the order given; null if none does."""
    return F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))


def gate(rows: DataFrame, rules: dict[str, Column], name: str = "blockers") -> DataFrame:
    """Rows with their failures and whether they are eligible; rejected rows stay."""
    return rows.withColumn(name, codes(rules)).withColumn("eligible", F.size(name) == 0)


def code_counts(rows: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """How often each code occurs: in total, and per key by rollup (code null: rows with any)."""
    exploded = rows.select(*([key] if key else []), F.explode(column).alias("code"))
    if key is None:
        return exploded.groupBy("code").agg(F.count("*").alias("rows"))
    return exploded.groupingSets([[F.col(key), F.col("code")], [F.col("code")]], key, "code").agg(F.count("*").alias("rows"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: (keys, side) with side missing (of b) or unexpected (in b)."""
    # the same tasks for both sides and for distinct keys and differences, and so many that each holds few keys
    n = max(tasks(a, 500_000), tasks(b, 500_000))
    left, right = (df.select(*keys).repartition(n, *keys).distinct() for df in (a, b))
    missing = left.join(right, keys, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("unexpected")))


def contiguity(rows: DataFrame, group: str, ordinal: str, start: int = 0) -> DataFrame:
    """Per group: rows, and whether the ordinals are start, start + 1, ... each once."""
    n, low, high = F.count("*"), F.min(ordinal), F.max(ordinal)
    whole = (low == start) & (high == start + n - 1) & (F.count_distinct(ordinal) == n)
    return rows.groupBy(group).agg(n.alias("n"), F.coalesce(whole, F.lit(False)).alias("contiguous"))


def bijection(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Per group whether a and b determine each other, each once."""
    n = F.count("*")
    return rows.groupBy(group).agg(n.alias("n"), ((F.count_distinct(a) == n) & (F.count_distinct(b) == n)).alias("bijective"))


def complete_sets(rows: DataFrame, groups: list[str], column: str, wanted: tuple[str, ...]) -> DataFrame:
    """Groups that lack one of the wanted values, with the values they lack."""
    has = [F.count_if(F.col(column) == w) for w in wanted]
    counted = rows.groupBy(*groups).agg(*(h.alias(f"_{k}") for k, h in enumerate(has)))
    missing = F.array_compact(F.array(*(F.when(F.col(f"_{k}") == 0, F.lit(w)) for k, w in enumerate(wanted))))
    return counted.select(*groups, missing.alias("missing")).where(F.size("missing") > 0)


def slot_grid(papers: DataFrame, paper_col: str, count_col: str) -> DataFrame:
    """(paper, ordinal) for every slot that a paper should have."""
    return papers.where(F.col(count_col) > 0).select(F.col(paper_col), F.explode(F.sequence(F.lit(1).cast("long"), F.col(count_col).cast("long"))).alias("ordinal"))


def value_conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the value if all rows agree, else null and the values that compete; null values are none."""
    n = F.count_distinct(value)
    return rows.groupBy(key).agg(n.alias("n_values"), F.when(n == 1, F.min(value)).alias("value"), F.when(n > 1, F.array_sort(F.collect_set(value))).alias("conflict"))


def forbidden_keys(text: Column, names: tuple[str, ...]) -> Column:
    """Which of the names are keys anywhere in a JSON text, however deep: sorted, empty if none is."""
    return codes({name: text.rlike(rf'"{name}"\s*:') for name in names})


def overlap(content: DataFrame, reference: DataFrame, n: int, id_col: str, ref_id: str, text_col: str = "text") -> DataFrame:
    """Word n-grams of the content that occur in the reference set: (id, place, gram_sha).

    Every window is hashed to 64 bits and looked up among the reference's; only for hits is the n-gram built, and
    compared by its SHA-256.  The reference is deduplicated first, so that frequent n-grams don't multiply rows.
    """
    words = lambda df, key: df.select(F.col(key).alias("_id"), tx.tokens(F.col(text_col)).alias("words")).where(F.size("words") >= n)
    windows = lambda f: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), f)
    gram = lambda i: F.array_join(F.slice("words", i, n), " ")
    known = words(reference, ref_id).select(F.explode(windows(lambda i: F.struct(F.xxhash64(F.slice("words", i, n)).alias("h"), F.sha2(gram(i), 256).alias("sha")))).alias("g"))
    known = known.select("g.h", "g.sha").distinct()
    hashed = words(content, id_col).select("_id", F.posexplode(windows(lambda i: F.xxhash64(F.slice("words", i, n)))).alias("place", "h"))
    places = hashed.join(known.select("h").distinct(), "h", "left_semi").groupBy("_id").agg(F.collect_set("place").alias("places")).withColumnRenamed("_id", "_hit")
    # back to the few texts with hits, to build their n-grams
    hit = words(content, id_col).join(places, F.col("_id").eqNullSafe(F.col("_hit"))).select("_id", "words", "places")
    built = hit.select("_id", F.explode(F.transform("places", lambda p: F.struct(p.cast("long").alias("place"), F.sha2(gram(p + 1), 256).alias("gram_sha")))).alias("g"))
    found = built.select(F.col("_id").alias(id_col), "g.place", "g.gram_sha")
    return found.join(known.select(F.col("sha").alias("gram_sha")).distinct(), "gram_sha", "left_semi")


def precedence(sources: dict[str, Column]) -> Column:
    """struct(value, source): the first value that isn't null, and whose it is."""
    label = reduce(lambda rest, kv: F.when(kv[1].isNotNull(), F.lit(kv[0])).otherwise(rest), reversed(list(sources.items())), F.lit(None).cast("string"))
    return F.struct(F.coalesce(*sources.values()).alias("value"), label.alias("source"))


def keyword_scores(docs: DataFrame, keywords: dict[str, dict[str, int]], id_col: str, text_col: str) -> DataFrame:
    """(id, label, score): weighted count of a label's keywords that occur in the text."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    entry = lambda label, words: F.struct(F.lit(label).alias("label"), sum((F.contains(low, F.lit(w)).cast("long") * k for w, k in words.items()), F.lit(0).cast("long")).alias("score"))
    return docs.select(id_col, F.explode(F.array(*(entry(label, words) for label, words in keywords.items()))).alias("s")).select(id_col, "s.label", "s.score")


def renumbered(rows: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """1, 2, ... within each group in the given order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def inherited(children: DataFrame, parents: DataFrame, key: str, column: str) -> DataFrame:
    """A child's own array, else its parent's."""
    up = parents.select(key, F.col(column).alias("_parent"))
    own = F.when(F.size(column) > 0, F.col(column))
    return children.join(up, key, "left").withColumn(column, F.coalesce(own, F.col("_parent"), F.col(column))).drop("_parent")


def nested_fields(schema, prefix: str = "") -> list[str]:
    """All field paths of a schema, arrays and maps included: to find forbidden keys."""
    from pyspark.sql import types as T

    out: list[str] = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *nested_fields(f.dataType, path)]
    elif isinstance(schema, T.ArrayType):
        out += nested_fields(schema.elementType, prefix)
    elif isinstance(schema, T.MapType):
        out += nested_fields(schema.valueType, prefix)
    return out


def forbidden_fields(df: DataFrame, names: set[str]) -> list[str]:
    return [path for path in nested_fields(df.schema) if path.rpartition(".")[2] in names]
