"""Operator 2: line dedup by overlapping three-line windows.

Texts split at \\n.  Every run of three consecutive lines that has a word is hashed to
128 bits; of a window that occurs more than once in the corpus, the first occurrence (by
id, row key, line) stays and the lines that any later one covers are removed.

Nulls and texts under three lines have no windows and stay as they are; windows without
a word are never removed.  Null ids sort first.  Rows that repeat id and text are one
occurrence: they lose the same lines.  A text may lose all its lines and is then empty.
Other columns pass through.  A window's occurrences are counted with partial sums and
joined back as a written table, so no group meets in one task and Spark can split the join
where one window is very common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import fresh, quoted, row_keys, saved

WIDTH = 3
WORD = r"[^\x20\x09-\x0D]"


def _lines(text_col: str):
    return F.split(F.col(text_col).cast("string"), "\n", -1)


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(row_id, k1, k2, line, h1, h2) of every window that has a word; `line` counts from 0."""
    source = docs.select(F.col(id_col).alias("row_id"), *row_keys(id_col, text_col), _lines(text_col).alias("lines")).where(F.size("lines") >= width)
    at = lambda i, k: F.get(F.col("lines"), i + k)
    window = F.transform(
        F.sequence(F.lit(0), F.size("lines") - width),
        lambda i: F.struct(
            i.alias("line"),
            F.xxhash64(F.lit(3), *(x for k in range(width) for x in (at(i, k), F.lit("\n")))).alias("h1"),
            F.xxhash64(F.lit(4), *(x for k in range(width) for x in (F.lit("\n"), at(i, k)))).alias("h2"),
            F.concat(*(at(i, k) for k in range(width))).rlike(WORD).alias("worded"),
        ),
    )
    return source.select("row_id", "k1", "k2", F.explode(window).alias("w")).where("w.worded").select("row_id", "k1", "k2", "w.line", "w.h1", "w.h2")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row key the sorted lines to remove: (k1, k2, covered)."""
    windows = line_windows(docs, id_col, text_col, width)
    place = F.struct("row_id", "k1", "k2", "line")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    first = saved(first, "line-first")
    later = windows.join(first, ["h1", "h2"]).where(
        (F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2")) | (F.col("line") != F.col("first.line"))
    )
    spread = F.flatten(F.collect_set(F.sequence(F.col("line"), F.col("line") + (width - 1))))
    return later.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(spread)).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """The documents without repeated windows' lines.

    With `counts`, also n_lines and n_removed (columns of these names are replaced); with
    `drop_emptied`, without the documents that lose all their words.
    """
    own1, own2, gone, lines, rest = fresh(docs.columns, "line_k1", "line_k2", "line_covered", "line_all", "line_left")
    covered = covered_lines(docs, id_col, text_col, width).withColumnsRenamed({"k1": own1, "k2": own2, "covered": gone})
    k1, k2 = row_keys(id_col, text_col)
    joined = docs.join(covered, (k1 == F.col(own1)) & (k2 == F.col(own2)), "left")
    # lines as a column of their own: inside the lambda the text would be split again for every line
    split = joined.withColumn(lines, _lines(text_col))
    n_lines, n_removed = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(gone), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(F.col(lines), i))
    left = split.withColumn(rest, F.when(n_removed == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    if drop_emptied:
        left = left.where((n_removed == 0) | F.col(rest).rlike(WORD))
    more = {"n_lines": n_lines.cast("long"), "n_removed": n_removed.cast("long")} if counts else {}
    return left.select(*(F.col(rest).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns if c not in more), *(x.alias(c) for c, x in more.items()))


#: For row-unique doc_id: id, lines, removed lines and a digest of the text that is left.
DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), windows AS (
  SELECT doc_id, i, l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS x FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), marked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k
  FROM windows WHERE x IS NOT NULL AND regexp_matches(x, '[^\x20\x09-\x0D]')
), gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM marked, (VALUES (0), (1), (2)) AS t(d) WHERE k > 1
)
SELECT d.doc_id, count(l.i) AS n_lines, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS text_sha256
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id
"""
