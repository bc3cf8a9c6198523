"""Queries on papers and slots.

paper = order (year and set number by its keys), slot = line number, row = line; locators name
a question's year and a supplier's set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import linkage, papers
from quillon.plans import linking, star
from quillon.plans.registry import query
from quillon.plans.star import table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_partkey").alias("question"), F.col("l_suppkey").alias("source"),
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_shipdate").alias("shipped"),
    )


def digested(spark: SparkSession, sf_dir: str, by_paper: bool = False) -> DataFrame:
    """Lines with their digests; `by_paper`: those of a paper in one task, where they are digested, as digests are longer than what they are made of."""
    every = rows(spark, sf_dir)
    if by_paper:
        every = every.drop("shipped").repartition(star.parts(spark, sf_dir), "paper")
    return every.withColumn("sha", F.sha2(F.concat_ws("|", "question", "source", "quantity", "flag"), 256))


_ROWS = "r AS (SELECT l_orderkey AS paper, CAST(l_linenumber AS BIGINT) AS ordinal, l_partkey AS question, l_suppkey AS source, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS quantity, l_shipdate AS shipped FROM lineitem)"


@query("""SELECT o_orderkey AS paper, ordinal FROM orders, LATERAL (SELECT unnest(range(1, 1 + CASE WHEN year(o_orderdate) >= 2000 THEN 6 WHEN year(o_orderdate) >= 1997 THEN 4 ELSE 0 END)) AS ordinal)""")
def regime_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by the year's regime; papers from before the first regime have none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"))
    return papers.regime_slots(orders, "paper", "year", [(2000, 6), (1997, 4)])


@query(f"""WITH {_ROWS}, p AS (SELECT DISTINCT 1990 + p_size AS year, p_partkey % 3 AS number FROM part WHERE p_size % 4 = 0 OR p_partkey % 3 = 0), q AS (SELECT *, year * 10 + number AS paper FROM p),
  y AS (SELECT year, min(paper) AS paper FROM q GROUP BY year HAVING count(*) = 1), l AS (SELECT r.paper AS locator, ordinal, source, 1990 + question % 55 AS year, source % 4 AS number FROM r)
  SELECT locator, ordinal, source, coalesce(y.paper, q.paper) AS paper, CASE WHEN y.paper IS NOT NULL THEN 'year' WHEN q.paper IS NOT NULL THEN 'set' ELSE 'unresolved' END AS rule
  FROM l LEFT JOIN y USING (year) LEFT JOIN q ON q.year = l.year AND q.number = l.number""")
def paper_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    known = part.where((F.col("p_size") % 4 == 0) | (key % 3 == 0)).select((1990 + F.col("p_size")).cast("long").alias("year"), (key % 3).alias("number")).distinct()
    known = known.withColumn("paper", F.col("year") * 10 + F.col("number"))
    locators = rows(spark, sf_dir).select(F.col("paper").alias("locator"), "ordinal", "source", (1990 + F.col("question") % 55).alias("year"), (F.col("source") % 4).alias("number"))
    return papers.resolved_papers(locators, known, "year", "number", "paper").select("locator", "ordinal", "source", "paper", "rule")


@query(f"""WITH {_ROWS}, s AS (SELECT paper, ordinal, count(*) AS n FROM r WHERE flag <> 'R' GROUP BY paper, ordinal)
  SELECT paper, question, source, CASE WHEN r.quantity % 10 = 0 THEN NULL WHEN s.n = 1 THEN s.ordinal END AS ordinal,
    CASE WHEN r.quantity % 10 = 0 THEN 'unreadable' WHEN s.n IS NULL THEN 'missing' WHEN s.n > 1 THEN 'ambiguous' ELSE 'linked' END AS outcome
  FROM r LEFT JOIN s USING (paper, ordinal)""")
def label_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as locators print them against those of the slots: `Q. 3`, `03` and `3` are the same, `x3y` is none."""
    every = rows(spark, sf_dir)
    slots = every.where("flag <> 'R'").select("paper", F.concat(F.lit("0"), "ordinal").alias("label"), "ordinal")
    label = F.when(F.col("quantity") % 10 == 0, F.concat(F.lit("x"), "ordinal", F.lit("y"))).when(F.col("quantity") % 2 == 0, F.concat(F.lit("Q. "), "ordinal")).otherwise(F.col("ordinal").cast("string"))
    return papers.located(every.withColumn("label", label).drop("ordinal"), slots, "paper", "label").select("paper", "question", "source", "ordinal", "outcome")


@query(f"""WITH {_ROWS}, a AS (SELECT source, ordinal, question, count(*) AS n FROM r WHERE flag <> 'R' GROUP BY ALL), b AS (SELECT source, ordinal, question, count(*) AS n FROM r WHERE flag <> 'A' GROUP BY ALL)
  SELECT source, ordinal, question, CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' WHEN a.n = 1 AND b.n = 1 THEN 'paired' ELSE 'repeated' END AS outcome FROM a FULL JOIN b USING (source, ordinal, question)""")
def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings (volume, page, heading) of two readings: only pairs of one and one count."""
    every = rows(spark, sf_dir)
    return papers.paired_blocks(every.where("flag <> 'R'"), every.where("flag <> 'A'"), ["source", "ordinal", "question"])


_ADOPT = "CASE WHEN quantity % 25 = 0 THEN NULL ELSE ordinal END"


@query(f"""WITH {_ROWS}, k AS (SELECT paper, {_ADOPT} AS slot, question, source, flag FROM r), c AS (SELECT paper, slot, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT o_orderkey AS paper, unnest(range(1, 6)) AS slot FROM orders)
  SELECT k.paper, k.slot, k.question, k.source, CASE WHEN k.slot IS NULL THEN 'unmapped' WHEN s.slot IS NULL THEN 'missing_slot' WHEN c.n > 1 THEN 'collision' WHEN flag = 'A' THEN 'verified' ELSE 'review' END AS outcome
  FROM k LEFT JOIN c ON c.paper = k.paper AND c.slot = k.slot LEFT JOIN s ON s.paper = k.paper AND s.slot = k.slot""")
def adopted_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = rows(spark, sf_dir).withColumn("slot", F.when(F.col("quantity") % 25 != 0, F.col("ordinal"))).withColumn("id", F.struct("question", "source"))
    slots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("slot"))
    return papers.adopted(every, slots, ["paper", "slot"], "id", F.col("flag") == "A").select("paper", "slot", "id.question", "id.source", "outcome")


@query("""WITH k AS (SELECT doc_id, lang, CASE WHEN doc_id % 20 = 1 THEN CAST(doc_id - 1 AS VARCHAR) WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS own, sha256(coalesce(lang, '') || chr(10) || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS full_text FROM documents),
  key AS (SELECT doc_id, 0 AS no, 'explicit' AS tier, own AS key FROM k UNION ALL SELECT doc_id, 1, 'full_text', full_text FROM k),
  known AS (SELECT no, key, count(*) AS n, min(doc_id) AS target FROM key WHERE doc_id % 2 = 0 AND key IS NOT NULL GROUP BY no, key),
  hit AS (SELECT a.doc_id, arg_min(a.tier, a.no) AS tier, arg_min(known.n, a.no) AS n, arg_min(known.target, a.no) AS target FROM key a JOIN known USING (no, key) WHERE a.doc_id % 2 = 1 GROUP BY a.doc_id),
  one AS (SELECT doc_id, tier, CASE WHEN n = 1 THEN target END AS target FROM hit), claims AS (SELECT target, count(*) AS c FROM one WHERE target IS NOT NULL GROUP BY target)
  SELECT d.doc_id, tier, CASE WHEN c = 1 THEN o.target END AS target, CASE WHEN tier IS NULL THEN 'unmatched' WHEN o.target IS NULL THEN 'ambiguous' WHEN c > 1 THEN 'collision' ELSE 'linked' END AS outcome
  FROM documents d LEFT JOIN one o USING (doc_id) LEFT JOIN claims ON claims.target = o.target WHERE d.doc_id % 2 = 1""".replace("\\\\", "\\"))
def attached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary texts by an explicit key, else by their exact full text within a language."""
    docs = table(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 20 == 1, F.col("doc_id") - 1).when(F.col("doc_id") % 2 == 0, F.col("doc_id")).cast("string")
    full = F.sha2(F.concat_ws("\n", F.coalesce("lang", F.lit("")), F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))), 256)
    docs = docs.select("doc_id", own.alias("own"), F.when(F.col("text").isNotNull(), full).alias("full"))
    tiers = [("explicit", F.col("own")), ("full_text", F.col("full"))]
    return linkage.tiered(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "target_id"), "doc_id", "target_id", tiers)


@query(f"""WITH {_ROWS}, p AS (SELECT source, ordinal, list_distinct(list(question)) AS labels FROM r WHERE flag = 'N' GROUP BY ALL)
  SELECT paper, r.source, r.ordinal, question, CASE WHEN labels IS NULL THEN 'no_page' WHEN list_contains(labels, question) THEN 'confirmed' ELSE 'label_not_on_page' END AS outcome
  FROM r LEFT JOIN p ON p.source = r.source AND p.ordinal = CASE WHEN r.flag = 'A' THEN r.ordinal + 1 ELSE r.ordinal END""")
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = rows(spark, sf_dir)
    # labels of a page: bounded by what a page can print, here by the questions
    pages = every.where("flag = 'N'").groupBy("source", F.col("ordinal").alias("page")).agg(F.collect_set("question").alias("labels"))
    named = every.withColumn("page", F.when(F.col("flag") == "A", F.col("ordinal") + 1).otherwise(F.col("ordinal"))).withColumn("id", F.struct("paper", "source", "ordinal", "question"))
    return papers.page_evidence(named, pages, ["source", "page"], "question", "id").select("id.*", "outcome")


_SHA = "sha256(concat_ws('|', question, source, quantity, flag))"


@query(f"""WITH {_ROWS}, g AS (SELECT paper, ordinal, list_sort(list({_SHA})) AS d FROM r GROUP BY ALL HAVING count(*) > 1), l AS (SELECT paper, ordinal, CASE WHEN paper % 7 = 1 THEN 'other' ELSE d[1] END AS chosen, CASE WHEN paper % 7 = 2 THEN [] ELSE d[2:] END AS preserved FROM g WHERE paper % 7 <> 0)
  SELECT paper, ordinal, len(d) AS rows, CASE WHEN chosen IS NULL THEN 'not_reviewed' WHEN len(list_filter(d, lambda x: x = chosen)) <> 1 THEN 'chosen_absent'
    WHEN list_filter(d, lambda x: x <> chosen) <> list_sort(preserved) THEN 'duplicates_differ' ELSE 'settled' END AS outcome FROM g LEFT JOIN l USING (paper, ordinal)""")
def reviewed_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share a slot, against a ledger that knows most of them."""
    every = digested(spark, sf_dir)
    groups = every.groupBy("paper", "ordinal").agg(F.array_sort(F.collect_list("sha")).alias("d")).where((F.size("d") > 1) & (F.col("paper") % 7 != 0))
    chosen = F.when(F.col("paper") % 7 == 1, F.lit("other")).otherwise(F.get("d", F.lit(0)))
    kept = F.when(F.col("paper") % 7 == 2, F.array().cast("array<string>")).otherwise(F.slice("d", F.lit(2), F.size("d")))
    ledger = groups.select("paper", "ordinal", chosen.alias("chosen"), kept.alias("preserved"))
    return papers.reviewed_collisions(every, ledger, ["paper", "ordinal"], "sha")


@query(f"""WITH {_ROWS}, e AS (SELECT year(o_orderdate) AS year, o_orderpriority AS session, count(*) * 4 AS expected FROM orders WHERE o_orderstatus = 'F' OR year(o_orderdate) < 2000 GROUP BY ALL),
  f AS (SELECT year(o_orderdate) AS year, o_orderpriority AS session, count(*) AS observed, count(*) FILTER (WHERE flag = 'A') AS joined, count(*) FILTER (WHERE quantity > 25) AS mapped FROM r JOIN orders ON o_orderkey = paper WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
  SELECT year, session, expected, coalesce(observed, 0) AS observed, coalesce(joined, 0) AS joined, coalesce(mapped, 0) AS mapped,
    CASE WHEN expected IS NULL THEN 'unexpected' WHEN coalesce(observed, 0) = 0 THEN 'absent' WHEN observed >= expected THEN 'complete' ELSE 'partial' END AS grade FROM e FULL JOIN f USING (year, session)""")
def paper_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against observed rows by year and session, with the groups that nothing was found for."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("session"), "o_orderstatus")
    expected = orders.where("o_orderstatus = 'F' OR year < 2000").groupBy("year", "session").agg((F.count("*") * 4).alias("expected"))
    observed = rows(spark, sf_dir).join(orders.where("session <> '5-LOW'"), "paper")
    return papers.coverage(expected, observed, ["year", "session"], {"joined": F.col("flag") == "A", "mapped": F.col("quantity") > 25})


@query(f"""WITH {linking._CLAIMS}, v AS (SELECT slot, value, count(DISTINCT source) AS sources, max(CAST(official AS INT)) AS official FROM claim GROUP BY slot, value),
  f AS (SELECT slot, count(*) AS n, sum(official) AS o, max(sources) AS most FROM v GROUP BY slot),
  s AS (SELECT p_brand AS paper, CASE WHEN n IS NULL THEN 'gap' WHEN o > 1 THEN 'official_conflict' WHEN o = 1 THEN 'official' WHEN n > 1 THEN 'conflict' WHEN most >= 2 THEN 'corroborated' ELSE 'unverified' END AS status FROM part LEFT JOIN f ON f.slot = p_partkey),
  a AS (SELECT *, CASE WHEN status LIKE 'official%' THEN 'official' WHEN status = 'gap' THEN 'none' ELSE 'secondary' END AS authority FROM s)
  SELECT paper, status, authority, count(*) AS slots, grouping(paper, status, authority) AS level FROM a GROUP BY GROUPING SETS ((paper, status, authority), (status, authority), (status))""")
def claim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slot"), F.col("p_brand").alias("paper"))
    resolved = linkage.resolve_claims(part, linking.claims(spark, sf_dir), "slot").join(part, "slot")
    authority = F.when(F.col("status").startswith("official"), "official").when(F.col("status") == "gap", "none").otherwise("secondary")
    return papers.claim_summary(resolved, "paper", authority)


def _book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five books of a page for each part, with a page of contents before them."""
    part = table(spark, sf_dir, "part").selectExpr("p_size % 5 AS book", "p_partkey AS page", "1 + p_partkey % 700 DIV 100 AS chapter", "p_partkey % 3 AS n", "p_partkey % 3 + IF(p_partkey % 7 = 0, 1, 0) AS h", "p_name")
    number = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= F.col("n"), F.concat(F.col("chapter").cast("string"), F.lit(".2."), i.cast("string"), F.lit("\n"))).otherwise(""))
    heading = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= F.col("h"), F.concat(F.lit("Trees: PAPER CSE 2014 | Question: "), i.cast("string"), F.lit("\nWhat holds of "), "p_name", F.lit("?\n"))).otherwise(""))
    body = part.select("book", F.col("page").cast("long").alias("page"), F.concat(F.array_join(number, ""), F.array_join(heading, "")).alias("text"))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda c: F.concat(c.cast("string"), F.lit(" Chapter of topics ("), (c * 20).cast("string"), F.lit(")"))), "\n")
    front = part.select("book").distinct().select("book", F.lit(0).cast("long").alias("page"), F.concat(F.lit("Contents\n"), lines, F.lit("\n1 Again the first (3)\n")).alias("text"))
    return body.unionByName(front)


_BOOK = """h AS (SELECT p_size % 5 AS book, p_partkey AS page, unnest(range(1, 1 + p_partkey % 3 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END)) AS k, p_partkey % 7 <> 0 AS same, CAST(1 + p_partkey % 700 // 100 AS VARCHAR) AS own FROM part),
  o AS (SELECT book, page, k, CASE WHEN same THEN own || '.2.' || k END AS number, last_value(CASE WHEN same THEN own END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter, CASE WHEN same THEN 'aligned' ELSE 'withheld' END AS status FROM h)"""


@query(f"""WITH {_BOOK} SELECT book, page, k, 'Trees: PAPER CSE 2014 | Question: ' || k AS heading, number, chapter, CASE WHEN chapter <= '6' THEN 'Chapter of topics' END AS title, CASE WHEN chapter <= '6' THEN 20 * CAST(chapter AS BIGINT) END AS declared, status FROM o""")
def book_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of books with the numbers and chapters that their pages and contents give."""
    return papers.outline(_book_pages(spark, sf_dir), "book", "page", "text")


@query(f"""WITH {_BOOK}, c AS (SELECT book, chapter, count(*) AS found FROM o WHERE chapter IS NOT NULL GROUP BY book, chapter), t AS (SELECT book, CAST(c AS VARCHAR) AS chapter, CAST(20 * c AS BIGINT) AS declared FROM (SELECT DISTINCT p_size % 5 AS book FROM part), range(1, 7) AS r(c))
  SELECT book, chapter, NULL::BIGINT AS page, CASE WHEN declared IS NULL THEN 'unlisted' ELSE 'count' END AS problem, declared AS expected, coalesce(found, 0) AS found FROM t FULL JOIN c USING (book, chapter) WHERE declared IS DISTINCT FROM coalesce(found, 0)
  UNION ALL SELECT book, NULL, page, 'page', NULL, count(*) FROM o WHERE status = 'withheld' GROUP BY book, page""")
def outline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that don't have the questions that they declare, and pages whose numbers don't pair."""
    pages = _book_pages(spark, sf_dir)
    return papers.outline_findings(papers.outline(pages, "book", "page", "text"), pages, "book", "page", "text")
