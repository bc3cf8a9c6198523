"""Operator 8: language ID of mixed-language text.

The script of a word narrows its candidate languages; hashed byte n-grams and the
hashed word give each candidate a log-likelihood per word; Viterbi decoding with a
penalty for every switch labels spans: no word gets a language that its script excludes,
and within the candidates one odd word's evidence is bounded.  The language of a document is the one whose
spans hold the most bytes.

Fitting: per language, about `rows_per_lang` documents chosen by a hash of their id
(all if there are fewer) are counted in Spark tasks; only the bounded count table
reaches the driver.  All languages of the rows are learned, however rare.  Languages, scripts and counts are learned from text and lang of
the rows that `train` selects.

Nulls and texts without a letter give `und` with score 0; null-lang rows aren't
learned from; without any training row every text is `und`.  Ties go to the language
that sorts first.  Null ids are passed through, repeated rows repeat, other columns are
ignored.  Whole texts are decoded, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textbytes import LOWER, U64, as_bytes, hash_spans, translated, word_spans

BITS = 15
BUCKETS = 1 << BITS
#: The most that a word's best language leads another candidate by, in nats.
LEAD = np.float32(8.0)
#: Features: 3-byte and 5-byte grams within a word (edges marked), and the word itself.
KINDS = 3

#: First code point of a range, its script; a range ends where the next begins.  Fixed values, from Unicode's blocks.
#: Digits, quotes and signs belong to no script: a word has that of the first code point after them.
SCRIPTS = (
    (0x0000, "Common"), (0x0041, "Latin"), (0x0080, "Common"), (0x00C0, "Latin"), (0x02B0, "Common"), (0x0370, "Greek"), (0x0400, "Cyrillic"),
    (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0800, "Other"), (0x0860, "Syriac"), (0x0870, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1400, "Syllabics"), (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Syllabics"), (0x1900, "Other"), (0x19E0, "Khmer"),
    (0x1A00, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1DC0, "Common"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Common"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2D00, "Georgian"), (0x2D30, "Other"),
    (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, "Common"), (0x2E80, "Han"), (0x2FF0, "Common"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, "Common"), (0x31A0, "Bopomofo"), (0x31C0, "Common"), (0x31F0, "Kana"), (0x3200, "Common"), (0x3400, "Han"),
    (0x4DC0, "Common"), (0x4E00, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xA8E0, "Devanagari"), (0xA900, "Other"), (0xA960, "Hangul"), (0xA980, "Other"), (0xA9E0, "Myanmar"), (0xAA00, "Other"),
    (0xAA60, "Myanmar"), (0xAA80, "Other"), (0xAB00, "Ethiopic"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Common"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Common"),
    (0xFE70, "Arabic"), (0xFEFF, "Common"), (0xFF21, "Latin"), (0xFF5B, "Common"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Common"),
    (0x10000, "Other"), (0x1B000, "Kana"), (0x1B170, "Other"), (0x1D000, "Common"), (0x1D800, "Other"), (0x1F000, "Common"), (0x20000, "Han"), (0x40000, "Common"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_COMMON = SCRIPT_NAMES.index("Common")
_SCRIPT_AT = np.array([at for at, _ in SCRIPTS])
_SCRIPT_ID = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER_TABLE = _ASCII_LETTER.astype(np.uint8).tobytes()
_CLEAN = LOWER.copy()
_CLEAN[[*range(0, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
_CLEAN[[*range(0x30, 0x3A)]] = 0x30
_CLEAN_TABLE = _CLEAN.tobytes()
_EMPTY = np.zeros(0, dtype=np.int64)
_ODD = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LangSettings:
    """`switch_penalty`: nats for a change of language between words; `narrow_share`: least share
    of a language's own training words in a script that makes it a candidate there; `temper`: how many words'
    evidence the score may use."""

    rows_per_lang: int = 1500
    switch_penalty: float = 12.0
    narrow_share: float = 0.002
    smoothing: float = 0.3
    temper: float = 8.0


def word_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of one text (start, end), where each one's bytes begin among all, and features in KINDS
    groups of BUCKETS: per byte (two rows) and per word.

    Words of digits alone aren't words here.
    """
    clean = translated(raw, _CLEAN_TABLE)
    starts, ends = word_spans(clean)
    if len(starts):
        lettered = np.maximum.reduceat(clean, starts) > 0x30
        starts, ends = starts[lettered], ends[lettered]
    if not len(starts):
        return starts, ends, _EMPTY, np.zeros((2, 0), dtype=np.int64), _EMPTY
    length = ends - starts
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(starts - first, length)
    padded = np.full(len(clean) + 5, 0x20, dtype=U64)
    padded[1:-4] = clean
    tri = (padded[:-4] << U64(16) | padded[1:-3] << U64(8) | padded[2:-2]).take(at)  # bytes j-1, j, j+1
    five = tri << U64(16) | (padded[3:-1] << U64(8) | padded[4:]).take(at)  # bytes j-1 .. j+3
    shift = U64(64 - BITS)
    grams = np.empty((2, len(at)), dtype=np.int64)
    grams[0] = tri * _ODD >> shift
    grams[1] = five * _ODD >> shift
    grams[1] += BUCKETS
    whole = (hash_spans(clean, starts, ends) >> shift).astype(np.int64) + 2 * BUCKETS
    return starts, ends, first, grams, whole


def _scripts_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The script of the code point that begins at each byte."""
    first = raw[at].astype(np.int64)
    point = first.copy()
    if len(first) and first.max() >= 0xC0:
        wide = np.concatenate((raw, np.zeros(4, dtype=np.uint8))).astype(np.int64)
        b, c, d = (wide[at + k] & 0x3F for k in (1, 2, 3))
        point = np.where(first >= 0xC0, (first & 0x1F) << 6 | b, point)
        point = np.where(first >= 0xE0, (first & 0x0F) << 12 | b << 6 | c, point)
        point = np.where(first >= 0xF0, (first & 0x07) << 18 | b << 12 | c << 6 | d, point)
    return _SCRIPT_ID[np.searchsorted(_SCRIPT_AT, point, side="right") - 1]


def word_scripts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The script of each word: that of its first code point that isn't shared by several scripts, if it has one."""
    out = _scripts_at(raw, starts)
    shared = out == _COMMON
    if shared.any():
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        scripts = _scripts_at(raw, at)
        own = scripts != _COMMON
        at, scripts = np.append(at[own], len(raw)), np.append(scripts[own], _COMMON)
        first = np.searchsorted(at, starts[shared])
        out[shared] = np.where(at[first] < ends[shared], scripts[first], _COMMON)
    return out


def has_letter(raw: np.ndarray) -> bool:
    if translated(raw, _LETTER_TABLE).any():
        return True
    return bool(len(raw)) and bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # feature x language, log-likelihoods
    allowed: np.ndarray  # script x language, 0 or -inf
    settings: LangSettings

    def word_scores(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words (start, end) and their log-likelihood under each language, centred on the best."""
        starts, ends, first, grams, whole = word_features(raw)
        if not len(starts):
            return starts, ends, np.zeros((0, len(self.langs)), dtype=np.float32)
        # a part of the words at a time, so that many languages and a long text don't meet in one array
        size, n = max(1, 8_000_000 // len(self.langs)), grams.shape[1]
        cuts = [*np.unique(np.searchsorted(first, np.arange(0, n, size))).tolist(), len(first)] if n > size else [0, len(first)]
        scores = np.empty((len(first), len(self.langs)), dtype=np.float32)
        for i, j in zip(cuts[:-1], cuts[1:]):
            a, b = int(first[i]) if i < j else 0, int(first[j]) if j < len(first) else n
            if i < j:
                values = self.table.take(grams[0, a:b], axis=0)
                values += self.table.take(grams[1, a:b], axis=0)
                scores[i:j] = np.add.reduceat(values, first[i:j] - a, axis=0)
        scores += self.table.take(whole, axis=0)
        narrow = None
        if raw.max() >= 0xCA or np.isneginf(self.allowed[SCRIPT_NAMES.index("Latin")]).any():
            narrow = self.allowed[word_scripts(raw, starts, ends)].astype(np.float32)
            scores += narrow
        scores -= scores.max(axis=1, keepdims=True)
        # among the script's candidates one odd word can't outweigh a span: its lead is bounded
        np.maximum(scores, -LEAD, out=scores)
        if narrow is not None:
            scores += narrow
        return starts, ends, scores

    def single(self, scores: np.ndarray) -> int:
        """The one language of the text, or -1 if a switch may pay: if no run of words gains more by
        leaving the best language than the switches cost, the best path has no switch."""
        total, penalty = scores.sum(axis=0), self.settings.switch_penalty
        best = int(total.argmax())
        if np.isneginf(total[best]):  # no language is a candidate for every word
            return -1
        gain = np.zeros(len(scores) + 1)
        np.cumsum(-scores[:, best], out=gain[1:])
        return best if gain[-1] < penalty or self._gains(scores, best, penalty) else -1

    def _gains(self, scores: np.ndarray, best: int, penalty: float) -> bool:
        other = scores - scores[:, best : best + 1]
        other[:, best] = -np.inf
        # leads of the best other language of each word bound those of any mix of them
        run = np.cumsum(np.maximum(other.max(axis=1), -1e6), dtype=np.float64)
        floor = np.minimum.accumulate(np.minimum(np.concatenate(([0.0], run[:-1])), 0))
        return bool((run - floor).max() < penalty)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word: Viterbi with a penalty for each switch."""
        n, penalty = len(scores), self.settings.switch_penalty
        rows = scores.astype(np.float64).tolist()
        k = range(len(self.langs))
        value, back = rows[0], []
        for row in rows[1:]:
            top = max(value)
            at = value.index(top)
            top -= penalty
            back.append([j if value[j] >= top else at for j in k])
            value = [max(value[j], top) + row[j] for j in k]
        out = np.empty(n, dtype=np.int64)
        out[-1] = at = value.index(max(value))
        for i in range(n - 2, -1, -1):
            at = back[i][at]
            out[i] = at
        return out

    def paths(self, many: list[np.ndarray], apart: int = 12) -> list[np.ndarray]:
        """`path` of each text, step by step over all at once; the longest ones one by one."""
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        out: list = [None] * len(many)
        for i in order[:apart]:
            out[i] = self.path(many[i])
        rest = order[apart:]
        if not rest:
            return out
        length = np.array([len(many[i]) for i in rest])
        steps, k, penalty = int(length[0]), len(self.langs), self.settings.switch_penalty
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        flat = np.concatenate([many[i] for i in rest]).astype(np.float64)
        back = np.zeros((len(flat), k), dtype=np.int16)
        value = flat[first]
        own = np.arange(k, dtype=np.int16)
        for t in range(1, steps):
            m = int(np.searchsorted(-length, -t, side="left"))  # texts with more than t words
            now = value[:m]
            top = now.max(axis=1, keepdims=True) - penalty
            back[first[:m] + t] = np.where(now >= top, own, now.argmax(axis=1).astype(np.int16)[:, None])
            value[:m] = np.maximum(now, top) + flat[first[:m] + t]
        at = value.argmax(axis=1)
        flat_out = np.empty(len(flat), dtype=np.int64)
        flat_out[first + length - 1] = at
        for t in range(steps - 1, 0, -1):
            m = int(np.searchsorted(-length, -t, side="left"))
            here = first[:m] + t
            at[:m] = back[here, at[:m]]
            flat_out[here - 1] = at[:m]
        for i, a, n in zip(rest, first, length):
            out[i] = flat_out[a : a + n]
        return out

    def _label(self, starts: np.ndarray, ends: np.ndarray, scores: np.ndarray, path: np.ndarray | int) -> tuple[str, float, list[tuple[int, int, str]]]:
        temper = self.settings.temper
        if not isinstance(path, np.ndarray):
            own = scores.sum(axis=0) * min(1.0, temper / len(scores))
            return self.langs[path], float(1.0 / np.exp(own - own[path]).sum()), [(int(starts[0]), int(ends[-1]), self.langs[path])]
        size = np.bincount(path, weights=ends - starts, minlength=len(self.langs))
        at = int(size.argmax())
        cut = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        last = np.concatenate((cut[1:] - 1, [len(path) - 1]))
        spans = [(int(starts[i]), int(ends[j]), self.langs[path[i]]) for i, j in zip(cut, last)]
        own = scores[path == at].sum(axis=0) * min(1.0, temper / max(1, np.count_nonzero(path == at)))
        return self.langs[at], float(size[at] / size.sum() / np.exp(own - own[at]).sum()), spans

    def label_all(self, raws: Iterator[np.ndarray | None], cells: int = 1_600_000) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (byte start, end, language) of each text.

        Texts that may be mixed are decoded together, about `cells` words times languages at a time."""
        out: list = []
        waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def decode() -> None:
            for (i, starts, ends, scores), path in zip(waiting, self.paths([w[3] for w in waiting])):
                out[i] = self._label(starts, ends, scores, path)
            waiting.clear()

        for raw in raws:
            out.append(("und", 0.0, []))
            if raw is None or not self.langs or not has_letter(raw):
                continue
            starts, ends, scores = self.word_scores(raw)
            if not len(starts):
                out[-1] = (self.langs[0], 1.0 / len(self.langs), [])
            elif (one := self.single(scores)) >= 0:
                out[-1] = self._label(starts, ends, scores, one)
            else:
                waiting.append((len(out) - 1, starts, ends, scores))
                held += len(starts)
                if held * len(self.langs) > cells:
                    decode()
                    held = 0
        decode()
        return out

    def main_language(self, raw: np.ndarray | None) -> str:
        """The language with the best total over all words, without spans."""
        if raw is None or not self.langs:
            return "und"
        scores = np.maximum(self.word_scores(raw)[2], -LEAD)  # a word of another script is only evidence here
        return self.langs[int(scores.sum(axis=0).argmax())] if len(scores) else "und"

    def label(self, raw: np.ndarray | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        return self.label_all(iter([raw]))[0]


def held_out(id_col: str = "doc_id") -> Column:
    """Never null: a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    """Rows to learn from: those that have an id and aren't held out."""
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def hash_below(id_col: str, share: Column) -> Column:
    """A fixed choice of about that share of the rows."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < share * (1 << 30)


def fit(docs: DataFrame, train: Column, settings: LangSettings = LangSettings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learn from the rows that `train` selects."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LangModel([], np.zeros((KINDS * BUCKETS, 0), dtype=np.float32), np.zeros((len(SCRIPT_NAMES), 0), dtype=np.float32), settings)
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, settings.rows_per_lang / r["count"]))))
    lang = F.col(lang_col).cast("string")
    sample = rows.where(lang.isin(langs) & hash_below(id_col, share[lang])).select(lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    index = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows come by language: one table of counts at a time, however many languages there are
        now, own = None, np.zeros(KINDS * BUCKETS + len(SCRIPT_NAMES), dtype=np.int64)

        def counted() -> pa.RecordBatch:
            at = np.flatnonzero(own)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), index[now])), pa.array(at), pa.array(own[at])], names=["lang", "feature", "n"])

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if name != now:
                    if now is not None:
                        yield counted()
                    now = name
                    own[:] = 0
                starts, ends, _, grams, whole = word_features(raw)
                if len(starts):
                    own += np.bincount(np.concatenate((*grams, whole, KINDS * BUCKETS + word_scripts(raw, starts, ends))), minlength=len(own))
        if now is not None:
            yield counted()

    # the sample of a language is bounded, so a few tasks count it and send few partial counts
    counted = sample.repartition(8).sortWithinPartitions("lang").mapInArrow(count, "lang long, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((KINDS * BUCKETS + len(SCRIPT_NAMES), len(langs)))
    counts[counted["feature"], counted["lang"]] = counted["n"]
    scripts = counts[KINDS * BUCKETS :]
    # by the language's own words: how much text other languages have in the script doesn't matter
    allowed = np.where(scripts >= settings.narrow_share * np.maximum(1.0, scripts.sum(axis=0, keepdims=True)), 0.0, -np.inf)
    allowed[np.isneginf(allowed).all(axis=1)] = 0.0  # nothing, or too little of each language, is known of the script
    allowed[_COMMON] = 0.0
    # grams overlap and so aren't independent: a word's evidence counts about once
    table = np.empty((KINDS, BUCKETS, len(langs)), dtype=np.float32)
    for kind, weight in enumerate((0.35, 0.25, 0.5)):
        grams = counts[kind * BUCKETS : (kind + 1) * BUCKETS] + settings.smoothing
        table[kind] = weight * np.log(grams / grams.sum(axis=0, keepdims=True))
    return LangModel(langs, table.reshape(-1, len(langs)), allowed, settings)


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, n_spans, and spans in bytes."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([source.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    # KINDS * BUCKETS rows by a float32 column for each language: 0.4 MB a language, whatever the corpus's size
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = own.label_all(as_bytes(batch.column(1)))
            spans = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows], type=arrow)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], type=pa.string()), pa.array([r[1] for r in rows], type=pa.float64()), spans],
                names=["doc_id", "lang_pred", "score", "lang_spans"],
            )

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """The documents that aren't `und`, unchanged: mixed and short texts stay, however their score is spread."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            verdicts = own.label_all(as_bytes(batch.column(at)))
            yield batch.filter(pa.array([lang != "und" for lang, _, _ in verdicts], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
