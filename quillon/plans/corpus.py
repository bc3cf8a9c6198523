"""Queries on texts: flags, digests, overlap, classification, HTML, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import quality, selection, sequences
from quillon.plans import star
from quillon.plans.registry import query
from quillon.plans.star import table

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_FOLD = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_FOLD}) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY sha256({_FOLD}) ORDER BY doc_id) = 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content digest; digests are counted with partial sums, not windows."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", tx.content_digest(F.col("text")).alias("digest"))
    return keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query(f"SELECT sha256({_FOLD}) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select(tx.content_digest(F.col("text")).alias("digest"))
    return quality.duplicate_keys(keyed, ["digest"])


_GRAMS = f"""SELECT *, w || ' ' || {" || ' ' || ".join(f"lead(w, {k}) OVER x" for k in range(1, 12))} AS g
  FROM (SELECT %s AS id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) - 1 AS place FROM %s) WINDOW x AS (PARTITION BY id ORDER BY place)"""


@query(f"""WITH own AS ({_GRAMS % ('doc_id', 'documents')}), known AS ({_GRAMS % ('item_id', 'benchmark')})
  SELECT id AS doc_id, place, sha256(g) AS gram_sha FROM own WHERE g IN (SELECT g FROM known WHERE g IS NOT NULL)""")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 12, "doc_id", "item_id")


_CLEAN = r"trim(regexp_replace(translate(text, chr(160) || chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(8722), ' ------'), '\s+', ' ', 'g'))"
# The same rules written for SQL: on lower-cased text where case doesn't count, `l`, else on the clean one, `x`.
_CODES = {
    "answer_metadata": r"regexp_matches(l, '\b(correct|wrong)\s*:')",
    "embedded_question_number": r"regexp_matches(l, '\bquestion\s+number\s*:')",
    "watermark": r"regexp_matches(l, '\biqp\s*bank\b') OR contains(l, 'iqpbank') OR contains(l, 'www.')",
    "website_navigation": r"regexp_matches(l, 'homehome|information\s*brochure|pre\s*examination|important\s*dates|faqsfaqs|contact\s*us')",
    "paper_header": r"regexp_matches(l, '\bgate\s*20(1[789]|2[0-5])\s*(computer\s*sc|general\s+aptitude|graduate\s+aptitude\s+test)')",
    "section_page_footer": r"regexp_matches(l, '\b(ga|cs(-\d+)?)\s+\d{1,2}\s*/\s*\d{1,2}\b')",
    "copyright_footer": r"regexp_matches(l, '\bcopyright\s*:?\s*gate\b')",
    "embedded_q_label": r"regexp_matches(l, '\bq\.?\s*(no\.?\s*)?\d{1,2}\b')",
    "joined_word_ocr": "len(list_intersect(regexp_extract_all(l, '[a-z0-9_]+'), ['considerthe', 'considera', 'whichoneof', 'whichof', 'thetotal', 'whena', 'thefollowing', 'followingstatement', 'followingstatements', 'assignpriorities', 'deviceraises', 'avectored', 'toidentify', 'bethenumber', 'denotethe', 'maximumdegreeof', 'setofall', 'isthestarting', 'arenon', 'semanticrules', 'operationextract', 'bargraph', 'namedstudent', 'grammarg', 'arenonterminals', 'lexicaltokens'])) > 0",
    "joined_formula_ocr": r"regexp_matches(x, '\b(If|then)[A-Z]\s*[=+*/-]')",
    "marks_or_key_boilerplate": r"regexp_matches(l, 'answer\s+key|key\s*/\s*range|question\s+type|page\s+\d+\s+of\s+\d+|carry\s*(one|two)\s*marks?\s*each')",
    "visual_dependency": r"regexp_matches(l, '\b(figure|diagram|((bar|line)\s+)?graph\s+(shown|given)|shown\s+(above|below|in\s+the)|given\s+(above|below)\s+is|following\s+((two|three)\s+)?(image|figure|diagram|circuit|graph|parse\s+tree|dfa|nfa|state\s+diagram)|(circuit|binary\s+tree|parse\s+tree|dfa|nfa|state\s+diagram)\s+(given|shown|above|below))\b')",
    "private_use_math_glyph": "len(list_filter(string_split(x, ''), lambda c: unicode(c) BETWEEN 57344 AND 63743)) > 0",
    "spaced_character_ocr": r"regexp_matches(x, '(^|[^A-Za-z])([a-z]\s+){3,}[a-z]([^A-Za-z]|$)')",
    "dense_missing_space_ocr": r"""length(x) >= 120 AND (regexp_matches(x, '[A-Za-z]{36,}') OR (
      NOT (contains(x, '#include') OR contains(x, 'printf(') OR contains(x, 'scanf(') OR contains(x, 'int main') OR contains(x, '->')) AND
      (length(regexp_replace(x, '\S', '', 'g')) / length(x) <= 0.12 OR len(regexp_extract_all(x, '[A-Za-z]{20,}')) >= 3 OR len(regexp_extract_all(x, '[a-z]{2,}[A-Z][A-Za-z]{2,}')) >= 4)))""",
    "truncated_prompt": "x <> '' AND contains('([{', right(x, 1))",
    "suspicious_prompt_ending": r"regexp_matches(l, '(\breturn|\bif|[,={])\s*$')",
}


@query(f"WITH c AS (SELECT doc_id, {_CLEAN} AS x, lower({_CLEAN}) AS l FROM documents) SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {rule} THEN {chr(39)}{name}{chr(39)} END' for name, rule in _CODES.items())}], lambda v: v IS NOT NULL)), ',') AS flags FROM c")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = tx.with_quality_flags(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return flagged.select("doc_id", F.array_join("flags", ",").alias("flags"))


#: Label: keyword -> weight, 3 for a phrase and 1 for a word.
KEYWORDS = {
    "english": {"the": 1, "and": 1, "of the": 3, "that": 1}, "german": {"der": 1, "und": 1, "in der": 3, "nicht": 1},
    "french": {"les": 1, "des": 1, "de la": 3, "pour": 1}, "spanish": {"los": 1, "que": 1, "de los": 3, "como": 1},
}
_SCORE = {label: " + ".join(f"CAST(contains(lower(text), '{w}') AS BIGINT) * {k}" for w, k in words.items()) for label, words in KEYWORDS.items()}


@query(f"""WITH s AS ({' UNION ALL '.join(f"SELECT doc_id, '{label}' AS label, {sums} AS score FROM documents" for label, sums in _SCORE.items())}),
  r AS (SELECT *, row_number() OVER w AS rk, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, label))
  SELECT doc_id, CASE WHEN score > 0 AND (nxt IS NULL OR nxt < score) THEN label END AS label, score, coalesce(score - nxt, score) AS margin FROM r WHERE rk = 1""")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.argmax(quality.keyword_scores(table(spark, sf_dir, "documents"), KEYWORDS, "doc_id", "text"), "doc_id", "label", "score")


@query(r"""WITH s AS (SELECT page_id, regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gs') AS x FROM pages), t AS (
  SELECT page_id, regexp_replace(x, '<[^>]*>', ' ', 'g') AS x FROM s), u AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS x FROM t)
  SELECT page_id, sha256(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS text_sha FROM u""")
def html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.without_tags(F.col("html")), 256).alias("text_sha"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text by an HTML parser, which SQL has not; tested against its plain function."""
    pages = table(spark, sf_dir, "pages")
    shown = pages.select("page_id", tx.html_content("html").alias("c"), tx.has_active_html(F.col("html")).alias("active"))
    return shown.select("page_id", "active", "c.has_image", F.length("c.text").cast("long").alias("n_chars"), F.sha2("c.text", 256).alias("text_sha"))


@query(r"""SELECT page_id, regexp_matches(html, '(?i)<\s*(script|iframe|object|embed|form|svg|style|link|meta)\b|\son\w+\s*=|javascript:') AS active,
  trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS squashed FROM pages""")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.has_active_html(F.col("html")).alias("active"), tx.slug(F.col("url")).alias("slug"), tx.squash(F.col("url")).alias("squashed"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
  o AS (SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l),
  m AS (SELECT o.doc_id, line_no, start, length(d.text) AS n FROM o JOIN documents d USING (doc_id) WHERE length(line) > 80)
  SELECT doc_id, line_no, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), n) AS "end" FROM m""")
def block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that begin at lines of over 80 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    markers = sequences.line_table(docs, "doc_id", "text").where(F.length("line") > 80).join(docs.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")
    return sequences.blocks(markers, "doc_id", "start", F.col("n")).select("doc_id", "line_no", "start", "end")


@query(r"""WITH page AS (SELECT doc_id // 8 AS paper, doc_id % 8 AS page, coalesce(text, '') AS text FROM documents),
  l AS (SELECT paper, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM page),
  o AS (SELECT paper, page, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY paper, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l),
  m AS (SELECT paper, page, start, lead({p: page, s: start}) OVER (PARTITION BY paper ORDER BY page, start) AS nxt FROM o WHERE length(line) > 80 AND length(line) % 4 = 0),
  e AS (SELECT paper, max({p: page, s: length(text)}) AS last FROM page GROUP BY paper),
  b AS (SELECT m.paper, m.page, m.start, coalesce(nxt, last).p AS end_page, CAST(coalesce(nxt, last).s AS BIGINT) AS "end" FROM m JOIN e USING (paper)),
  x AS (SELECT b.*, g.page AS nr, trim(regexp_replace(substring(g.text, CASE WHEN g.page = b.page THEN b.start ELSE 0 END + 1, CASE WHEN g.page = end_page THEN "end" ELSE length(g.text) END - CASE WHEN g.page = b.page THEN b.start ELSE 0 END), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS piece
    FROM b JOIN page g ON g.paper = b.paper AND g.page BETWEEN b.page AND b.end_page)
  SELECT paper, page, start, end_page, "end", sha256(coalesce(string_agg(piece, ' ' ORDER BY nr) FILTER (WHERE piece <> ''), '')) AS block_sha256,
    coalesce(string_agg(CAST(nr AS VARCHAR), ',' ORDER BY nr) FILTER (WHERE piece <> ''), CAST(page AS VARCHAR)) AS pages FROM x GROUP BY paper, page, start, end_page, "end" """)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that run over pages: eight documents are a paper, long lines of some lengths its markers."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.expr("doc_id div 8").alias("paper"), F.pmod("doc_id", F.lit(8)).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    lines = sequences.line_table(pages.withColumn("_at", F.struct("paper", "page")), "_at", "text").where((F.length("line") > 80) & (F.length("line") % 4 == 0))
    found = sequences.page_blocks(lines.select("_at.paper", "_at.page", "start"), pages, "paper", "page", "start", "text")
    return found.select("paper", "page", "start", "end_page", "end", F.sha2("block", 256).alias("block_sha256"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS n, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem),
  a AS (SELECT l_orderkey, list(n ORDER BY k) AS ns FROM p GROUP BY l_orderkey)
  SELECT l_orderkey, CAST(list_reduce(list_prepend(0, ns), lambda want, x: CASE WHEN x = want + 1 THEN want + 1 ELSE want END) AS BIGINT) AS accepted FROM a""")
def forced_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the line numbers of an order, by ship date, count 1, 2, 3, ..."""
    line = table(spark, sf_dir, "lineitem")
    numbers = F.sort_array(F.collect_list(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")))
    listed = line.groupBy("l_orderkey").agg(F.transform(numbers, lambda x: x["l_linenumber"].cast("long")).alias("numbers"))
    return listed.select("l_orderkey", F.size(sequences.accepted_sequence(F.col("numbers"))).cast("long").alias("accepted"))


@query(f"WITH {star.CTE} SELECT question_id, text, CASE WHEN small > 0 THEN greatest(0.9 * both_n / small, both_n / either) ELSE 0.0 END AS similarity FROM (SELECT question_id, text, len(list_intersect(a, b)) AS both_n, least(len(list_distinct(a)), len(list_distinct(b))) AS small, len(list_distinct(list_concat(a, b))) AS either FROM (SELECT question_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(topic || ' ' || text), '[a-z0-9]+') AS b FROM question))")
def topic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star.questions(spark, sf_dir)
    return q.select("question_id", "text", tx.set_similarity(tx.tokens(F.col("text")), tx.tokens(F.concat_ws(" ", "topic", "text"))).alias("similarity"))


@query("""SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id""")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contiguity(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '(?i)^\\s*(page\\s+\\d+(\\s+of\\s+\\d+)?|\\d+\\s*/\\s*\\d+|-?\\s*\\d+\\s*-?)?\\s*$')), chr(10))) AS text_sha FROM documents".replace("\\\\", "\\"))
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.without_noise(F.col("text")), 256).alias("text_sha"))


_GATE = {"too_short": "length(text) < 200", "no_language": "lang IS NULL", "unbalanced": "NOT (length(replace(text, '(', '')) = length(replace(text, ')', '')))", "blank_source": "coalesce(trim(source), '') = ''"}


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "too_short": F.length("text") < 200, "no_language": F.col("lang").isNull(),
        "unbalanced": ~tx.balanced(F.col("text"), (("(", ")"),)), "blank_source": F.coalesce(F.trim("source"), F.lit("")) == "",
    }
    return quality.gate(table(spark, sf_dir, "documents"), rules)


_GATED = f"gated AS (SELECT *, list_sort(list_filter([{', '.join(f'CASE WHEN {rule} THEN {chr(39)}{name}{chr(39)} END' for name, rule in _GATE.items())}], lambda v: v IS NOT NULL)) AS blockers FROM documents)"


@query(f"WITH {_GATED} SELECT doc_id, array_to_string(blockers, ',') AS blockers, len(blockers) = 0 AS eligible FROM gated")
def eligibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("doc_id", F.array_join("blockers", ",").alias("blockers"), "eligible")


@query(f"WITH {_GATED}, e AS (SELECT source, unnest(blockers) AS code FROM gated) SELECT source, code, count(*) AS rows FROM e GROUP BY GROUPING SETS ((source, code), (code))")
def blocker_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.code_counts(gated(spark, sf_dir), "blockers", "source")


@query("""SELECT lang, source, count(*) AS observed, CAST(sum(n_chars) AS BIGINT) AS chars, median(n_chars) AS median_chars,
  CASE WHEN median(n_chars) < 200 THEN 'weak' ELSE 'text_bearing' END AS grade FROM documents GROUP BY lang, source""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.median("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("observed"), F.sum("n_chars").alias("chars"), middle.alias("median_chars"), F.when(middle < 200, "weak").otherwise("text_bearing").alias("grade")
    )


@query("SELECT doc_id, quality = 1 AND toxic = 0 AS promoted FROM labels JOIN documents USING (doc_id)")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowlist's decision for the rows that it names."""
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("promoted"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
