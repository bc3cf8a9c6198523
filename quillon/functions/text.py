"""Text normalisation, tokens, similarity and quality flags.

Column expressions where the built-in functions can say it; Arrow-batched functions for
Unicode normal forms, HTML and sequence similarity, which they can't.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import markup


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 become one hyphen."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def collapse(text: Column) -> Column:
    """No-break spaces and white-space runs become one blank, dashes a hyphen."""
    return F.trim(F.regexp_replace(F.translate(text, " ‐‑‒–—−", " ------"), r"\s+", " "))


def fold(text: Column) -> Column:
    """For comparison: lower case, runs of other characters than a-z and 0-9 become a blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0)


def word_tokens(text: Column) -> Column:
    """Words with an inner apostrophe and numbers with decimals, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?"), 0)


def anchors(text: Column, longest: int = 3) -> Column:
    """Words of `longest` characters or more and digits, of the text without formulas."""
    plain = F.regexp_replace(text, r"(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]", " ")
    return F.filter(word_tokens(plain), lambda t: (F.length(t) >= longest) | t.rlike(r"^\d+$"))


def ngrams(words: Column, n: int) -> Column:
    """Every run of n words joined by blanks; none if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def set_similarity(a: Column, b: Column) -> Column:
    """max(0.9 containment, Jaccard) of two arrays as sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    either = F.size(F.array_union(a, b))
    return F.when(small > 0, F.greatest(0.9 * both / small, both / either)).otherwise(F.lit(0.0))


def token_similarity(left: Column, right: Column) -> Column:
    """`set_similarity` of the tokens of two texts; equal texts aren't split."""
    same = F.when(F.lower(left).rlike("[a-z0-9]"), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(left == right, same).otherwise(set_similarity(tokens(left), tokens(right)))


def content_digest(stem: Column, options: Column | None = None) -> Column:
    """SHA-256 of the case- and blank-folded stem and options."""
    parts = [stem] if options is None else [stem, F.array_join(options, "\n")]
    return F.sha2(F.concat_ws("\n", *(F.trim(F.regexp_replace(F.lower(p), r"\s+", " ")) for p in parts)), 256)


def label_key(label: Column) -> Column:
    """`2.25`, `24-b`, `81a` in one form: number, then the part in lower case."""
    pattern = r"^\s*(?:[Qq]\.?\s*)?0*(\d+)\s*[-.]?\s*([0-9]+|[A-Za-z])?\s*$"
    number, part = F.regexp_extract(label, pattern, 1), F.lower(F.regexp_extract(label, pattern, 2))
    return F.when(number != "", F.concat_ws(".", number, F.nullif(part, F.lit(""))))


def note_fields(note: Column) -> Column:
    """`k=v; k=v` as a map with trimmed keys and values; entries without `=` are left out."""
    pairs = F.filter(F.split(note, ";"), lambda p: p.contains("="))
    entry = lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))


def without_noise(text: Column, noise: str = r"(?i)^\s*(page\s+\d+(\s+of\s+\d+)?|\d+\s*/\s*\d+|-?\s*\d+\s*-?)?\s*$") -> Column:
    """The lines that aren't page noise (or blank)."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(noise)), "\n")


def without_tags(text: Column) -> Column:
    """HTML to text by patterns, for comparison with SQL: scripts, styles and comments go, tags become blanks."""
    shown = F.regexp_replace(text, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    plain = F.regexp_replace(shown, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


ACTIVE_HTML = r"(?i)<\s*(script|iframe|object|embed|form|svg|style|link|meta)\b|\son\w+\s*=|javascript:"


def has_active_html(text: Column) -> Column:
    return text.rlike(ACTIVE_HTML)


def balanced(text: Column, pairs: tuple[tuple[str, str], ...] = (("{", "}"), ("(", ")"), ("[", "]"))) -> Column:
    """Every kind of bracket opens as often as it closes."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    out = F.lit(True)
    for opening, closing in pairs:
        out = out & (count(opening) == count(closing))
    return out


# The patterns that mark damaged transcriptions, by flag.
DEBRIS = {
    "answer_metadata": r"(?i)\b(?:Correct|Wrong)\s*:",
    "embedded_question_number": r"(?i)\bQuestion\s+Number\s*:",
    "watermark": r"(?i)\bIQP\s*BANK\b|IQPBANK|www\.",
    "website_navigation": r"(?i)HomeHome|Information\s*Brochure|Pre\s*Examination|Important\s*Dates|FAQsFAQs|Contact\s*Us",
    "paper_header": r"(?i)\bGATE\s*20(?:17|18|19|20|21|22|23|24|25)\s*(?:Computer\s*Sc|General\s+Aptitude|Graduate\s+Aptitude\s+Test)",
    "section_page_footer": r"(?i)\b(?:GA|CS(?:-\d+)?)\s+\d{1,2}\s*/\s*\d{1,2}\b",
    "copyright_footer": r"(?i)\bCopyright\s*:?\s*GATE\b",
    "embedded_q_label": r"(?i)\bQ\.?\s*(?:No\.?\s*)?\d{1,2}\b",
    "joined_word_ocr": r"(?i)\b(?:Considerthe|Considera|Whichoneof|Whichof|Thetotal|Whena|thefollowing|followingstatements?|assignpriorities|deviceraises|avectored|toidentify|bethenumber|denotethe|maximumdegreeof|setofall|isthestarting|arenon|semanticrules|operationExtract|bargraph|namedStudent|grammarG|arenonterminals|lexicaltokens)\b",
    "joined_formula_ocr": r"\b(?:If|then)[A-Z]\s*(?:=|[+\-*/])",
    "marks_or_key_boilerplate": r"(?i)answer\s+key|key\s*/\s*range|question\s+type|page\s+\d+\s+of\s+\d+|carry\s*(?:one|two)\s*marks?\s*each",
    "visual_dependency": r"(?i)\b(?:figure|diagram|(?:bar\s+|line\s+)?graph\s+(?:shown|given)|shown\s+(?:above|below|in\s+the)|given\s+(?:above|below)\s+is|following\s+(?:(?:two|three)\s+)?(?:image|figure|diagram|circuit|graph|parse\s+tree|DFA|NFA|state\s+diagram)|(?:circuit|binary\s+tree|parse\s+tree|DFA|NFA|state\s+diagram)\s+(?:given|shown|above|below))\b",
    "private_use_math_glyph": r"[\x{E000}-\x{F8FF}]",
}
# What a text has to hold, in lower case, for a pattern to be tried; patterns without an entry are always tried.
NEEDS = {
    "answer_metadata": ("correct", "wrong"), "embedded_question_number": ("question",), "watermark": ("iqp", "www."), "paper_header": ("gate",), "section_page_footer": ("/",), "copyright_footer": ("copyright",),
    "website_navigation": ("homehome", "information", "examination", "important", "faqsfaqs", "contact"), "marks_or_key_boilerplate": ("answer", "range", "question", "page", "carry"),
    "visual_dependency": ("figure", "diagram", "graph", "shown", "given", "image", "circuit", "tree", "dfa", "nfa"),
}
# What tells code from prose, for the density rule and for the delimiter rule.
CODE_MARKS = ("#include", "printf(", "scanf(", "int main", "->")
CODE_WORDS = ("#include", "printf(", "scanf(", "int main", "return ", "char *", "void ", "for (", "while (")
# Letters with blanks between them, prompts that end too early, labels inside options.
SPACED_LETTERS = r"(?<![A-Za-z])(?:[a-z]\s+){3,}[a-z](?![A-Za-z])"
OPEN_ENDING = r"[(\[{]$"
ODD_ENDING = r"(?i)(?:\breturn|\bif|[,={])\s*$"
NESTED_LABEL = r"(?i)\(\s*[A-D]\s*\)"


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | text.contains(mark)
    return out


def _dense(text: Column) -> Column:
    """Text in which blanks are missing: few of them, overlong words, or many inner capitals."""
    share = F.length(F.regexp_replace(text, r"\S+", "")) / F.length(text)
    many_long = F.regexp_count(text, F.lit(r"[A-Za-z]{20,}")) >= 3
    camel = F.regexp_count(text, F.lit(r"[a-z]{2,}[A-Z][A-Za-z]{2,}")) >= 4
    return (F.length(text) >= 120) & (((share <= 0.12) | many_long | camel) & ~_any_of(text, CODE_MARKS) | text.rlike(r"[A-Za-z]{36,}"))


def _debris(clean: Column, low: Column, name: str) -> Column:
    """Patterns without case are tried on the lower-cased text, if it holds what they need."""
    pattern = DEBRIS[name]
    found = low.rlike(pattern[4:].lower()) if pattern.startswith("(?i)") else clean.rlike(pattern)
    return _any_of(low, NEEDS[name]) & found if name in NEEDS else found


def quality_flags(clean: Column, prompt: Column | None = None, options: Column | None = None, low: Column | None = None) -> Column:
    """Sorted codes of what is wrong with a transcription; empty if nothing is.

    `clean`, `low`: the collapsed text and its lower case, as columns of their own (see `with_quality_flags`), because
    every flag reads them.  `prompt`: the part whose ending counts, by default all of it; `options`: texts that may hold a
    label of their own.
    """
    ending = clean if prompt is None else prompt
    found = {name: _debris(clean, F.lower(clean) if low is None else low, name) for name in DEBRIS}
    found |= {"spaced_character_ocr": clean.rlike(SPACED_LETTERS), "dense_missing_space_ocr": _dense(clean), "truncated_prompt": ending.rlike(OPEN_ENDING), "suspicious_prompt_ending": F.right(ending, F.lit(20)).rlike(ODD_ENDING)}
    if options is not None:
        found["nested_option_label"] = F.exists(options, lambda x: F.coalesce(x.rlike(NESTED_LABEL), F.lit(False)))
        found["unbalanced_code_delimiters"] = _any_of(clean, CODE_WORDS) & ~balanced(clean)
    return F.array_sort(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in found.items()))))


def with_quality_flags(df: DataFrame, text_col: str, name: str = "flags", options_col: str | None = None) -> DataFrame:
    """The rows with their flags; with options (an array of texts) those of the whole record."""
    text = F.col(text_col)
    if options_col is None:
        clean = df.withColumn("_clean", collapse(text)).withColumn("_low", F.lower("_clean"))
        return clean.withColumn(name, quality_flags(F.col("_clean"), low=F.col("_low"))).drop("_clean", "_low")
    options = F.coalesce(options_col, F.array().cast("array<string>"))
    whole = df.withColumns({"_clean": collapse(F.concat_ws(" ", text, options)), "_prompt": collapse(text)}).withColumn("_low", F.lower("_clean"))
    return whole.withColumn(name, quality_flags(F.col("_clean"), F.col("_prompt"), options, F.col("_low"))).drop("_clean", "_prompt", "_low")


def shown_text(page: str | None) -> str | None:
    """The text of an HTML fragment without zero-width characters; white space is folded."""
    return None if page is None else shown(page)[0]


def shown(page: str) -> tuple[str, bool]:
    """The text of an HTML fragment, and whether it has an image."""
    parts, image = [], False
    for kind, value, _ in markup.tokens(page):
        if kind == "text":
            parts.append(value)
        elif kind == "open":
            image = image or value == "img"
            if value in ("br", "p", "div", "li", "tr", "h1", "h2", "h3"):
                parts.append("\n")
    return " ".join(re.sub("[\u200b-\u200d\ufeff]", "", "".join(parts)).split()), image


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(shown_text, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("has_image", T.BooleanType())]))
def html_content(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if page is None else shown(page) for page in pages], columns=["text", "has_image"])


# Quotes, dashes and the ellipsis in plain form.
_QUOTES = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u2026": "..."})


@F.pandas_udf(T.StringType())
def search_key(texts: pd.Series) -> pd.Series:
    """NFKC, case-folded, quotes and dashes plain, white space folded; null under 20 characters."""

    def one(text: str) -> str | None:
        key = " ".join(unicodedata.normalize("NFKC", html.unescape(text)).translate(_QUOTES).casefold().split())
        return key if len(key) >= 20 else None

    return texts.map(one, na_action="ignore")


def plain_ascii(text: str) -> str:
    """Letters without their marks; what has no ASCII form goes."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


@F.pandas_udf(T.StringType())
def ascii_slug(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: re.sub(r"[^a-z0-9]+", "-", plain_ascii(x).lower()).strip("-"), na_action="ignore")


@F.pandas_udf(T.StringType())
def comparison_key(texts: pd.Series) -> pd.Series:
    """NFKC and case-folded, runs of other characters than a-z and 0-9 one blank."""
    return texts.map(lambda x: re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKC", x).casefold()).strip(), na_action="ignore")


def similarity(left: str | None, right: str | None) -> tuple[float, float, float, float]:
    """(score, ratio, coverage, longest) of a text by another, from their word sequences, rounded to 6 places.

    coverage: the share of the left words that the right has too, as multisets; longest: the longest common run, as a
    share of the left words; score = max(ratio, 0.55 coverage + 0.45 longest); 0 if either has under six words.
    """
    if not left or not right:
        return 0.0, 0.0, 0.0, 0.0
    a, b = (re.findall(r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?", unicodedata.normalize("NFKC", x or "").casefold()) for x in (left, right))
    if min(len(a), len(b)) < 6:
        return 0.0, 0.0, 0.0, 0.0
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    ratio = 2 * sum(m.size for m in blocks) / (len(a) + len(b))
    coverage = (Counter(a) & Counter(b)).total() / len(a)
    longest = max(m.size for m in blocks) / len(a)
    return tuple(round(x, 6) for x in (max(ratio, 0.55 * coverage + 0.45 * longest), ratio, coverage, longest))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("score", "ratio", "coverage", "longest")]))
def text_similarity(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """For pairs that a blocking join has chosen: sequence similarity is costly."""
    return pd.DataFrame([similarity(x, y) for x, y in zip(left, right)], columns=["score", "ratio", "coverage", "longest"])


# costly, so the optimiser must neither repeat it nor move it before a filter
text_similarity = text_similarity.asNondeterministic()


def similarity_words(text: Column) -> Column:
    """The words that `text_similarity` compares; null for texts with other than ASCII characters, whose normal form takes Python."""
    return F.when(F.octet_length(text) == F.length(text), word_tokens(text))


def contained_similarity(a: Column, b: Column) -> Column:
    """What `text_similarity` gives for texts (their words) of which one is a run within the other, null for other texts.

    The shorter one is the longest matching block then, and nothing is left to match.  Sizes are bounded so that a share is a tie of
    the sixth place only where it is exact: it is rounded as in Python.
    """
    n, m = F.size(a), F.size(b)
    padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    least = F.least(n, m)
    ratio, share = 2 * least / (n + m), least / n
    score = F.greatest(ratio, 0.55 * share + 0.45 * share)
    fields = {"score": score, "ratio": ratio, "coverage": share, "longest": share}
    run = F.when(n < m, padded(b).contains(padded(a))).otherwise(padded(a).contains(padded(b)))
    return F.when((least >= 6) & (n + m < 640) & run, F.struct(*(F.bround(x, 6).alias(name) for name, x in fields.items())))


def similarity_bounds(left: Column, right: Column) -> Column:
    """`word_bounds` of two texts; null texts have no words."""
    return word_bounds(similarity_words(F.coalesce(left, F.lit(""))), similarity_words(F.coalesce(right, F.lit(""))))


def word_bounds(left: Column, right: Column) -> Column:
    """struct(coverage, score): the coverage of `text_similarity`, and what its score can't exceed, from the words; 1 where these are null.

    Matching blocks are common words in order, so they hold no more than the texts have in common as multisets.
    """
    sides = F.array(F.struct(left.alias("a"), right.alias("b")))  # as a lambda's variable, so that each is split once

    def bound(x: Column) -> Column:
        a, b = x["a"], x["b"]
        times = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
        common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))
        few = (F.size(a) < 6) | (F.size(b) < 6)
        # score = max(ratio, 0.55 coverage + 0.45 longest), and longest is no more than coverage
        both = F.struct(F.round(common / F.size(a), 6).alias("coverage"), F.round(F.greatest(2 * common / (F.size(a) + F.size(b)), common / F.size(a)), 6).alias("score"))
        none = F.struct(F.lit(0.0).alias("coverage"), F.lit(0.0).alias("score"))
        one = F.struct(F.lit(1.0).alias("coverage"), F.lit(1.0).alias("score"))
        return F.when(a.isNull() | b.isNull(), one).when(few, none).otherwise(both)

    return F.get(F.transform(sides, bound), F.lit(0))


@F.pandas_udf(T.DoubleType())
def char_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """For blocked pairs: twice the matching characters over all, 1 for two empty texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(left, right)], dtype="float64")


def ratio_band(ratio: Column) -> Column:
    return F.when(ratio >= 0.85, "strong").when(ratio >= 0.60, "partial").otherwise("weak")
