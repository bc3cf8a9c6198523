"""Operator 6: a convolutional text classifier for toxicity, trained in numpy.

Words are embedded by hashing (the word and its first three, four and five bytes, so that
unseen endings share what their stems have learned), filters of several widths run over
them, and the maximum of each filter over the whole text feeds a logistic output.  The
threshold is calibrated by language, where language is what a text's own n-grams say
(see `langid`); the score is shifted so that a language's threshold lies at `cut`.

Every labelled row that may be learned from is, with its whole text.  A hash of the id keeps
`calibration_share` of the rows aside for the thresholds; the model is trained on all others.  These lie
in blocks of about `block_rows` rows and `block_bytes` bytes of text, one task each.  In a round, every
block goes on from the same model through all its rows, and what the blocks have moved is averaged by
Spark: values that all move by the mean, an embedding by the mean of the blocks that moved it.  A single
block goes through its rows as often by itself.  Thresholds are taken from counts of all rows that are
kept aside, by language and logit (in steps of 1 / 256).  A model that tells these no better than a coin has
learned few rows by heart: training begins anew with other values, `starts` times at most.  So the driver gets a model and these counts,
and a task holds a block's words (2 bytes a feature), however many rows there are.  Scoring covers whole
texts of any length too.  The language model learns from the same side of the split.

A language's threshold is its best one, weighted by its rows of the rarer class, and the common
one, weighted by `prior_rows`: few rows move it little, and none not at all.

Null and empty texts score like texts without any pattern.  Rows without a label aren't
learned from; without both classes every score is the share of the class that is there
(0 without any).  Null ids are passed through; repeated rows repeat; labels that repeat
or contradict count each; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import langid
from quillon.llm.textbytes import U64, as_bytes, hash_spans, translated, word_spans

#: Lower-cases ASCII and blanks ASCII punctuation.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
PREFIXES = (3, 4, 5)
PARTS = 1 + len(PREFIXES)


@dataclass(frozen=True)
class CnnSettings:
    """A single block takes `epochs`, or as many as `least_steps` batches need; several take `rounds`."""

    bits: int = 15
    width: int = 12
    spans: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    epochs: int = 8
    least_steps: int = 300
    batch: int = 64
    rate: float = 0.01
    rounds: int = 4
    starts: int = 5
    block_rows: int = 8000
    block_bytes: int = 64_000_000
    window_words: int = 65_536
    calibration_share: float = 0.25
    prior_rows: float = 25.0
    cut: float = 0.7
    seed: int = 11


def features(raw: np.ndarray | None, bits: int) -> np.ndarray:
    """Per word PARTS bucket numbers, as one int32 matrix."""
    if raw is None:
        return np.zeros((0, PARTS), dtype=np.int32)
    clean = translated(raw, _CLEAN)
    starts, ends = word_spans(clean)
    out = np.empty((len(starts), PARTS), dtype=np.int32)
    shift = U64(64 - bits)
    out[:, 0] = hash_spans(clean, starts, ends) >> shift
    for k, n in enumerate(PREFIXES):
        # a different hash for each length: the length is part of it
        out[:, k + 1] = hash_spans(clean, starts, np.minimum(ends, starts + n)) * U64(0x9E3779B97F4A7C15 + 2 * k) >> shift
    return out


@dataclass
class Cnn:
    settings: CnnSettings
    embed: np.ndarray
    kernels: list[np.ndarray]  # one per span: (span, width, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    offsets: dict[str, float] = field(default_factory=dict)
    offset: float = 0.0
    constant: float | None = None
    lang_model: langid.LangModel | None = None

    def maps(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embedded words, and for each span the filters' values at every place (at least one)."""
        most = max(self.settings.spans)
        n = max(len(ids), 1)
        x = np.zeros((n + most - 1, self.settings.width), dtype=self.embed.dtype)  # blanks after the end
        if len(ids):
            parts = self.embed.take(ids[:, 0], axis=0)
            for k in range(1, PARTS):
                parts += self.embed.take(ids[:, k], axis=0)
            x[: len(ids)] = parts
        values = []
        for kernel in self.kernels:
            v = x[:n] @ kernel[0]
            for j in range(1, len(kernel)):
                v += x[j : j + n] @ kernel[j]
            values.append(v)
        return x, values

    def peaks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each filter, the highest value over the whole text and the first place that has it."""
        step = self.settings.window_words  # a long text is run through in parts that overlap by the widest span
        top = place = np.zeros(0)
        for a in range(0, max(1, len(ids)), step):
            _, values = self.maps(ids[a : a + step + max(self.settings.spans) - 1])
            at = np.concatenate([v.argmax(axis=0) for v in values])
            best = np.concatenate([v.max(axis=0) for v in values])
            top, place = (best, at) if not a else (np.maximum(top, best), np.where(best > top, a + at, place))
        return top, place

    def logit(self, ids: np.ndarray) -> float:
        step = self.settings.window_words
        pooled = None
        for a in range(0, max(1, len(ids)), step):
            _, values = self.maps(ids[a : a + step + max(self.settings.spans) - 1])
            top = np.concatenate([v.max(axis=0) for v in values])
            pooled = top if pooled is None else np.maximum(pooled, top)
        return float(np.maximum(pooled + self.bias, 0.0) @ self.out + self.out_bias)

    def score(self, logit: float, lang: str) -> float:
        cut = np.log(self.settings.cut / (1 - self.settings.cut))
        return float(1.0 / (1.0 + np.exp(-np.clip(logit - self.offsets.get(lang, self.offset) + cut, -30, 30))))


def gradients(model: Cnn, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the weighted logistic loss, summed over the texts: by the dense parameters (kernels, bias, out), by the output's
    bias, and by embeddings as (bucket, move), one row for each use.  The gradient of a maximum goes to the place that gave it."""
    f = model.settings.filters
    grads = [np.zeros_like(p) for p in (*model.kernels, model.bias, model.out)]
    bias_grad = 0.0
    buckets, moves = [np.zeros(0, dtype=np.int64)], [np.zeros((0, model.settings.width), dtype=model.embed.dtype)]
    for ids, label, weight in zip(texts, labels, weights):
        top, places = model.peaks(ids)
        pooled = top + model.bias
        hidden = np.maximum(pooled, 0.0)
        z = float(hidden @ model.out + model.out_bias)
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        bias_grad += error
        grads[-1] += error * hidden
        down = (error * model.out * (pooled > 0)).astype(model.embed.dtype)
        grads[-2] += down
        for s, kernel in enumerate(model.kernels):
            g, place = down[s * f : (s + 1) * f], places[s * f : (s + 1) * f]
            for j in range(len(kernel)):
                real = place + j < len(ids)  # blanks after the end
                if real.any():
                    here = ids[place[real] + j]
                    grads[s][j][:, real] += model.embed[here].sum(axis=1).T * g[real]
                    buckets.append(here.ravel())
                    moves.append(np.repeat((kernel[j].T * g[:, None])[real], PARTS, axis=0))
    return grads, bias_grad, np.concatenate(buckets), np.concatenate(moves)


def fresh(settings: CnnSettings, rng: np.random.Generator) -> Cnn:
    """A model before training."""
    d, f, spans = settings.width, settings.filters, settings.spans
    return Cnn(
        settings, (rng.standard_normal((1 << settings.bits, d)) * 0.1).astype(np.float32),
        [(rng.standard_normal((s, d, f)) / np.sqrt(s * d)).astype(np.float32) for s in spans],
        np.zeros(f * len(spans), dtype=np.float32), (rng.standard_normal(f * len(spans)) * 0.1).astype(np.float32), 0.0,
    )


@dataclass
class Training:
    """A model with what its steps have left: Adam on the logistic loss, Adagrad on the embeddings (one step size per bucket)."""

    model: Cnn
    first: list[np.ndarray]
    second: list[np.ndarray]
    squares: np.ndarray
    step: int = 0

    @staticmethod
    def begin(settings: CnnSettings) -> Training:
        model = fresh(settings, np.random.default_rng(settings.seed))
        dense = [*model.kernels, model.bias, model.out]
        return Training(model, [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], np.full(1 << settings.bits, 1e-8, dtype=np.float32))

    def go_through(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> None:
        """One step for each batch of the texts, in an order of chance."""
        model, settings = self.model, self.model.settings
        dense = [*model.kernels, model.bias, model.out]
        order = rng.permutation(len(texts))
        for at in range(0, len(order), settings.batch):
            self.step += 1
            rows = order[at : at + settings.batch]
            grads, bias_grad, buckets, moves = gradients(model, [texts[i] for i in rows], labels[rows], weights[rows] / len(rows))
            for k, (p, g) in enumerate(zip(dense, grads)):
                self.first[k] = 0.9 * self.first[k] + 0.1 * g
                self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                p -= settings.rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-7)
            model.out_bias -= settings.rate * bias_grad
            if len(buckets):
                bucket, inverse = np.unique(buckets, return_inverse=True)
                total = np.zeros((len(bucket), settings.width), dtype=np.float32)
                np.add.at(total, inverse, moves)
                self.squares[bucket] += (total * total).mean(axis=1)
                model.embed[bucket] -= 5 * settings.rate * total / np.sqrt(self.squares[bucket])[:, None]

    def dense(self) -> np.ndarray:
        """All but the embeddings and their step sizes, as one row."""
        return np.concatenate([p.ravel() for p in (*self.model.kernels, self.model.bias, self.model.out, *self.first, *self.second, np.array([self.model.out_bias, self.step]))])

    def embedded(self) -> np.ndarray:
        """The embeddings with, in a last column, the squares of their step sizes."""
        return np.concatenate((self.model.embed, self.squares[:, None]), axis=1)

    def put(self, dense: np.ndarray, embedded: np.ndarray) -> None:
        """Take these values."""
        at = 0
        for p in (*self.model.kernels, self.model.bias, self.model.out, *self.first, *self.second):
            p[...] = dense[at : at + p.size].reshape(p.shape)
            at += p.size
        self.model.out_bias, self.step = float(dense[at]), round(float(dense[at + 1]))
        self.model.embed, self.squares = embedded[:, :-1].astype(np.float32), embedded[:, -1].astype(np.float32)


def mean_moves(moves: np.ndarray) -> np.ndarray:
    """Of blocks' moves of embeddings (block, bucket, value), the mean of the blocks that moved the bucket: their squares grew."""
    return moves.sum(axis=0) / np.maximum(1, (moves[:, :, -1:] > 0).sum(axis=0))


def passes(rows: int, settings: CnnSettings) -> int:
    """How often a single block goes through its rows: a small one more often."""
    return max(settings.epochs, -(-settings.least_steps // max(1, -(-rows // settings.batch))))


def class_weights(labels: np.ndarray, share: float) -> np.ndarray:
    """Both classes weigh the same in all, where `share` of all rows are of class 1."""
    return np.where(labels == 1, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))


def train(texts: list[np.ndarray], labels: np.ndarray, settings: CnnSettings) -> Cnn:
    """A model of one block."""
    state, rng = Training.begin(settings), np.random.default_rng(settings.seed)
    for _ in range(passes(len(texts), settings)):
        state.go_through(texts, labels, class_weights(labels, labels.mean()), rng)
    return state.model


def best_cut(logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The middle of the thresholds around the best F1 that are as good but for one row, so that no single row decides.
    Of `rows` at each logit (one if not given), `toxic` are; equal logits stay together."""
    values, at = np.unique(-logits, return_inverse=True)
    hits = np.cumsum(np.bincount(at, weights=toxic))
    f1 = 2 * hits / (np.cumsum(np.bincount(at, weights=rows)) + hits[-1])
    k = int(f1.argmax())
    near = f1 >= f1[k] - 0.5 / max(1, hits[-1])
    first, last = k, k
    while first > 0 and near[first - 1]:
        first -= 1
    while last + 1 < len(values) and near[last + 1]:
        last += 1
    low = -values[last + 1] if last + 1 < len(values) else -values[last] - 2.0
    return float((low - values[first]) / 2)


#: Buckets whose moves are averaged in one group.
PART = 1024
#: Steps of a logit that thresholds tell apart.
LOGIT_STEPS = 256
#: Bits, as a power of two, that mark the ids of labelled rows.
MARKS = 26


def trained(rows: DataFrame, blocks: int, n: int, share: float, settings: CnnSettings) -> Cnn:
    """Of rows (block, y, ids) in as many partitions as blocks: n in all, `share` of them of class 1."""
    spark, state = rows.sparkSession, Training.begin(settings)
    parts = range(0, 1 << settings.bits, PART)

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")  # sums of floats depend on the order
        part, kind = group["part"][0].as_py(), np.float64 if group["part"][0].as_py() < 0 else np.float32
        moved = np.stack([np.frombuffer(x.as_py(), dtype=kind) for x in group["moved"]])
        value = moved.mean(axis=0) if part < 0 else mean_moves(moved.reshape(len(moved), -1, settings.width + 1))
        return pa.table({"part": pa.array([part], type=pa.int32()), "moved": pa.array([value.astype(kind).tobytes()], type=pa.binary())})

    for turn in range(settings.rounds if blocks > 1 else 1):
        # bounded by the settings: buckets times width
        shared = spark.sparkContext.broadcast(state)
        times = 1 if blocks > 1 else passes(n, settings)

        def go(batches: Iterator[pa.RecordBatch], turn: int = turn, times: int = times, shared=shared) -> Iterator[pa.RecordBatch]:
            texts, labels, block = [], [], 0
            for batch in batches:
                if batch.num_rows:
                    block = batch.column(0)[0].as_py()
                labels += batch.column(1).to_pylist()
                texts += unpacked(batch.column(2), settings.bits)
            if not texts:
                return
            own, y = copy.deepcopy(shared.value), np.array(labels, dtype=np.float64)
            before, rng = own.embedded(), np.random.default_rng((settings.seed, turn, block))
            for _ in range(times):
                own.go_through(texts, y, class_weights(y, share), rng)
            moves = own.embedded() - before
            out = [own.dense().astype(np.float64).tobytes(), *(moves[k : k + PART].astype(np.float32).tobytes() for k in parts)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *parts], type=pa.int32()), pa.array([block] * len(out), type=pa.int32()), pa.array(out, type=pa.binary())], names=["part", "block", "moved"])

        moved = rows.select("block", "y", "ids").mapInArrow(go, "part int, block int, moved binary")
        found = {r["part"]: bytes(r["moved"]) for r in moved.groupBy("part").applyInArrow(mean, "part int, moved binary").collect()}
        shared.unpersist()
        moves = np.concatenate([np.frombuffer(found[k], dtype=np.float32) for k in parts]).reshape(1 << settings.bits, -1)
        state.put(np.frombuffer(found[-1], dtype=np.float64), state.embedded() + moves)
    return state.model


def marked(rows: DataFrame, id_col: str, known: DataFrame, known_id: str) -> DataFrame:
    """The rows whose id's bit is set, of 1 << MARKS bits by a hash of the known ids: all rows with a known id and few others,
    so that a join shuffles few texts in vain."""
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << MARKS))
    bits = known.select(at(known_id).alias("_at")).select(F.shiftright("_at", 6).alias("_word"), F.expr("shiftleft(1L, cast(_at & 63 AS int))").alias("_bit"))
    # bounded: a row for each 64 bits
    words = F.broadcast(bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return rows.withColumn("_at", at(id_col)).join(words, F.shiftright("_at", 6) == F.col("_word")).where(F.getbit("_bits", F.col("_at").bitwiseAND(63)) == 1).select(*rows.columns)


def packed(ids: np.ndarray, bits: int) -> bytes:
    return ids.astype(np.uint16 if bits <= 16 else np.int32).tobytes()


def unpacked(column: pa.Array, bits: int) -> list[np.ndarray]:
    return [raw.view(np.uint16 if bits <= 16 else np.int32).reshape(-1, PARTS) for raw in as_bytes(column)]


def set_thresholds(rows: DataFrame, model: Cnn) -> float:
    """By counts of all rows (y, lang, ids) at each language and logit; the rows' logistic loss, both classes weighing the same."""
    settings, shared = model.settings, rows.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [round(shared.value.logit(ids) * LOGIT_STEPS) for ids in unpacked(batch.column(2), settings.bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(steps, type=pa.int64())], names=["y", "lang", "step"])

    # bounded by the languages and the steps of a logit
    found = rows.select("y", "lang", "ids").mapInArrow(logits, "y int, lang string, step long").groupBy("lang", "step").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).orderBy("lang", "step").collect()
    langs, logit = np.array([r["lang"] for r in found]), np.array([r["step"] for r in found]) / LOGIT_STEPS
    toxic, n = (np.array([r[k] for r in found], dtype=np.float64) for k in ("toxic", "n"))
    model.offset = best_cut(logit, toxic, n)
    for lang in np.unique(langs):
        own = langs == lang
        rarer = min(toxic[own].sum(), (n - toxic)[own].sum())
        if rarer:
            model.offsets[str(lang)] = float((rarer * best_cut(logit[own], toxic[own], n[own]) + settings.prior_rows * model.offset) / (rarer + settings.prior_rows))
    clean = n - toxic
    return float((np.logaddexp(0, -logit) @ toxic / toxic.sum() + np.logaddexp(0, logit) @ clean / clean.sum()) / 2)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: CnnSettings = CnnSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Cnn:
    """Learn from the labelled rows whose id passes `learn` (a column over `id_col`)."""
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    lang_model = langid.fit(docs, learn, id_col=id_col, text_col=text_col, lang_col=lang_col)
    own = docs.where(learn).select(id_col, F.col(text_col).cast("string").alias("text"))
    # about the rows and bytes to train on; what a task holds follows from them
    size, texts = known.count(), own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    size *= 1 - settings.calibration_share
    blocks = max(1, math.ceil(size / settings.block_rows), math.ceil(size * (texts["size"] or 0) / max(1, texts["n"]) / settings.block_bytes))
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), F.col(c).cast("string")), F.lit(blocks)).cast("int")
    left = marked(own, id_col, known, "_id").withColumn("block", block(id_col)).repartitionById(blocks, F.col("block"))
    right = known.withColumn("_block", block("_id")).repartitionById(blocks, F.col("_block"))
    dealt = left.join(right.hint("merge"), (F.col("block") == F.col("_block")) & (F.col(id_col) == F.col("_id"))).select("_id", F.col("_y").alias("y"), "block", "text").sortWithinPartitions("_id", "y", "text")
    bits = settings.bits
    shared = docs.sparkSession.sparkContext.broadcast(lang_model)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = list(as_bytes(batch.column(3)))
            langs = [shared.value.main_language(raw) if wanted else None for raw, wanted in zip(raws, batch.column(2).to_pylist())]
            ids = [packed(features(raw, bits), bits) for raw in raws]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(langs, type=pa.string()), pa.array(ids, type=pa.binary())], names=["block", "y", "aside", "lang", "ids"])

    def prepared(aside: Column) -> tuple[DataFrame, dict[tuple[bool, int], int]]:
        """The rows as words' features in their blocks, kept on the executors' disks, and how many are aside and of each class."""
        rows = dealt.select("block", "y", aside.alias("aside"), "text").mapInArrow(prepare, "block int, y int, aside boolean, lang string, ids binary").persist(StorageLevel.DISK_ONLY)
        return rows, {(r["aside"], r["y"]): r["count"] for r in rows.groupBy("aside", "y").count().collect()}

    rows, sizes = prepared(langid.hash_below("_id", F.lit(settings.calibration_share)))
    classes = {y for _, y in sizes}
    if len(classes) < 2:
        rows.unpersist()
        blank = Cnn(settings, np.zeros((1 << bits, settings.width), dtype=np.float32), [np.zeros((s, settings.width, settings.filters), dtype=np.float32) for s in settings.spans], np.zeros(settings.filters * len(settings.spans), dtype=np.float32), np.zeros(settings.filters * len(settings.spans), dtype=np.float32), 0.0)
        blank.constant, blank.lang_model = float(max(classes, default=0)), lang_model
        return blank
    learned, judged = rows.where(~F.col("aside")), rows.where("aside")
    if len(sizes) < 4:  # too few rows to keep both classes aside: all are learned from, and give the thresholds
        rows.unpersist()
        rows, sizes = prepared(F.lit(True))
        learned = judged = rows
        sizes = {(False, y): n for (_, y), n in sizes.items()}
    n = sizes[False, 0] + sizes[False, 1]
    tried: list[tuple[float, Cnn]] = []
    for start in range(settings.starts):
        model = trained(learned, blocks, n, sizes[False, 1] / n, replace(settings, seed=settings.seed + start))
        tried.append((set_thresholds(judged, model), model))
        if tried[-1][0] < math.log(2):
            break
    model = min(tried, key=lambda x: x[0])[1]
    rows.unpersist()
    model.lang_model = lang_model
    return model


def score(docs: DataFrame, model: Cnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_guess, score) of every document."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("lang_guess", T.StringType()), T.StructField("score", T.DoubleType())])
    # bounded by the settings: buckets times width, and the language table
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bits = own.settings.bits
        for batch in batches:
            raws = list(as_bytes(batch.column(1)))
            langs = [own.lang_model.main_language(raw) for raw in raws]
            if own.constant is not None:
                scores = [own.constant] * len(raws)
            else:
                scores = [own.score(own.logit(features(raw, bits)), lang) for raw, lang in zip(raws, langs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_guess", "score"])

    return source.mapInArrow(run, schema)
