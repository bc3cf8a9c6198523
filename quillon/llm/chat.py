"""Operator 10 [native]: chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged into one turn with an array of texts; the merged turns are concatenated.  Control strings inside texts get a
backslash after their first character (one more for each that is there already), which
`unescape` takes away again.

    <s>[SYS] text [/SYS][INST] text[SEP]text [/INST][ANS] text </s>[ROLE] name[SEP]text [/ROLE]

Besides the text a row has its segments in order, each with the flag of the loss mask:
true for the texts of the assistant, false for everything else.

Turns sort by turn, role, text, nulls first; ties and repeated rows stay.  Null text
counts as empty, a null role as a role without name.  A null conv_id is one conversation.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, JOIN = "<s>", "[SEP]"
#: role: (opening, closing)
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE] ", " [/ROLE]")
_CONTROL = r"(/?INST\]|ANS\]|/?SYS\]|/?ROLE\]|SEP\]|/?s>)"
_CLOSING = r" (?:\[/INST\]|</s>|\[/SYS\]|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _CONTROL, r"$1$2$3")


def _mark(role: Column, which: int) -> Column:
    out = F.lit(OTHER[which])
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[which])).otherwise(out)
    if which == 0:  # an opening names a role that has no mark of its own
        out = F.when(role.isin(*MARKS), out).otherwise(F.concat(out, escape(role), F.lit(JOIN)))
    return out


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of (text, loss))."""
    one = F.struct(
        turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy(turns[conv_col].alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    merged = sorted_turns.select("conv_id", merge_turns(F.col("turns")).alias("merged"))

    def block(t: Column) -> Column:
        """Opening, texts with joints between them, closing."""
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        spoken = F.transform(t["texts"], lambda x, k: F.array(plain(F.when(k == 0, F.lit("")).otherwise(F.lit(JOIN))), F.struct(escape(x).alias("text"), (t["role"] == "assistant").alias("loss"))))
        return F.concat(F.array(plain(_mark(t["role"], 0))), F.flatten(spoken), F.array(plain(_mark(t["role"], 1))))

    begin = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    segments = F.filter(F.concat(begin, F.flatten(F.transform("merged", block))), lambda s: s["loss"] | (s["text"] != ""))
    return merged.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def merge_turns(turns: Column) -> Column:
    """Merged turns (role, texts) of a sorted array of turns (role, text): one for each run of one role.

    Runs begin where the role differs from the one before; the arrays are cut there, in time linear in the turns.
    """
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(turns)), F.array(F.size(turns)))
    runs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.transform(runs, lambda r: F.struct(F.get(turns, r["a"])["role"].alias("role"), F.transform(F.slice(turns, r["a"] + 1, r["b"] - r["a"]), lambda t: t["text"]).alias("texts")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    body = F.substring(formatted, len(BEGIN) + 1, 2_147_483_647)
    blocks = F.filter(F.split(body, _CLOSING, -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        opening = F.regexp_extract(block, r"^(\[[A-Z]+\] )", 1)
        parts = F.split(F.regexp_replace(block, r"^\[[A-Z]+\] ", ""), r"\[SEP\]", -1)
        role = unescape(parts[0])
        for name, (mark, _) in MARKS.items():
            role = F.when(opening == mark, F.lit(name)).otherwise(role)
        texts = F.when(opening == OTHER[0], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the output."""
    turns = read_back(F.col("formatted"))
    spoken = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (
        formatted.select("conv_id", turns.alias("turns"), spoken.alias("spoken"), F.length("formatted").cast("long").alias("formatted_chars"))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("spoken").cast("long").alias("loss_chars"), F.sha2("spoken", 256).alias("loss_sha256"), "formatted_chars",
        )
    )


#: The same digests, from the rows instead of the output.
DIGEST_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|ANS\]|/?SYS\]|/?ROLE\]|SEP\]|/?s>)', '\1\\\2\3', 'g')) AS escaped_chars
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, escaped_chars
    + CASE WHEN before = role THEN 5 ELSE CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 6 WHEN 'system' THEN 6 ELSE 12 + length(role) END END
    + CASE WHEN after = role THEN 0 ELSE CASE role WHEN 'user' THEN 8 WHEN 'assistant' THEN 5 WHEN 'system' THEN 7 ELSE 8 END END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
