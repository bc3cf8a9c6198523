"""Operator 4: MinHash near-dedup with sequential Bayesian verification.

A document is the set of its five-word shingles (words lower-cased A-Z; under five words,
the whole sequence).  Two documents are linked if 100 |A & B| >= 75 |A | B|.  Documents
with equal sets form a class; classes are nodes, links make components.

1. Every text gets MinHash values; bands of them give buckets that similar classes share.
   With 32 bands of 4, a pair at the threshold shares none with probability 5e-6.
2. Candidates of a bucket are compared batch by batch of their signatures; a pair is
   pruned as soon as the posterior probability that its similarity reaches the threshold
   falls under `miss`.  Survivors are verified on their full sets.
3. Not all pairs of a bucket are compared: pairs within one component can't change the
   result.  First each class meets one leader, then the leaders of its other buckets.  Then
   the classes outside a bucket's largest component ask the whole bucket, by signatures:
   each is verified with its nearest, and who has survivors at all is noted.  If a class
   has more survivors than that one, those noted meet once more in blocks that hold their
   full sets and return links only.  So every candidate pair across components is pruned
   or verified.  Rows sent to the blocks: those of a bucket once for every `block` classes
   that ask, those that ask once for every `block` classes of the bucket.

Null and empty texts have no shingles, link with nothing and keep their own id.  A null
id is never smallest unless a component has no other; repeated rows are one class and
share a component.  Rows that share an id but not the text are separate nodes.  Other
columns are ignored.  Nothing of the corpus is collected to the driver; components are
found by alternating large and small stars on written tables.  Joins on buckets read
written tables, so that Spark can split a bucket that holds many classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import Scratch, fresh, row_keys, scratch
from quillon.llm.textbytes import LOWER, U64, as_bytes, hash_spans, mix, seeded, translated, window_hashes, word_spans

_LOWER_TABLE = LOWER.tobytes()


@dataclass(frozen=True)
class NearSettings:
    """`threshold` in hundredths; `batch` signature values per comparison step; `miss`: posterior bound of a prune;
    `block`, `block_shingles`: about so many classes, and shingles of full sets, meet as many in one task."""

    shingle: int = 5
    threshold: int = 75
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-6
    block: int = 512
    block_shingles: int = 1_000_000
    broadcast_rows: int = 100_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingles(raw: np.ndarray | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if raw is None:
        return np.zeros(0, dtype=U64)
    low = translated(raw, _LOWER_TABLE)
    hashes = hash_spans(low, *word_spans(low))
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(width, len(hashes))))


class Signer:
    def __init__(self, settings: NearSettings) -> None:
        self.settings = settings
        keys = seeded(2 * settings.hashes, 900)
        self.mul = (keys[: settings.hashes] >> U64(32)).astype(np.uint32) | np.uint32(1)
        self.add = (keys[settings.hashes :] >> U64(32)).astype(np.uint32)
        self.buffer = np.empty((256, settings.hashes), dtype=np.uint32)
        self.band_keys = seeded(settings.rows, 901) | U64(1)
        self.band_salt = seeded(settings.bands, 902)

    def values(self, own: np.ndarray) -> np.ndarray:
        """The MinHash values of a set."""
        x = (mix(own) >> U64(32)).astype(np.uint32)
        low = np.full(self.settings.hashes, 0xFFFFFFFF, dtype=np.uint32)
        for a in range(0, len(x), 256):
            part = x[a : a + 256, None]
            buffer = self.buffer[: len(part)]
            np.multiply(part, self.mul, out=buffer)
            buffer += self.add
            np.minimum(low, buffer.min(axis=0), out=low)
        return low

    def bands(self, values: np.ndarray) -> np.ndarray:
        grid = values.reshape(self.settings.bands, self.settings.rows).astype(U64)
        return mix((grid * self.band_keys).sum(axis=1, dtype=U64) + self.band_salt).view(np.int64)

    def signature(self, values: np.ndarray) -> bytes:
        """One byte per value: equal for different values in one of 256 cases, which the posterior counts in."""
        return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(settings: NearSettings) -> list[tuple[int, int]]:
    """(n, m): after n values, fewer than m matches prune the pair.

    Uniform prior on the similarity s; a value matches with probability s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    high = s >= settings.threshold / 100
    out = []
    for n in range(settings.batch, settings.hashes + 1, settings.batch):
        m = 0
        while m <= n:
            choose = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1)
            like = np.exp(choose + m * np.log(p) + (n - m) * np.log1p(-p))
            if like[high].sum() >= settings.miss * like.sum():
                break
            m += 1
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signature rows survive the batches, and their matches (of survivors)."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    done = 0
    for n, least in bounds:
        matches += (a[left, done:n] == b[left, done:n]).sum(axis=1)
        keep = matches >= least
        left, matches = left[keep], matches[keep]
        done = n
    return left, matches


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def sign(docs: DataFrame, settings: NearSettings = NearSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, cls, n_shingles, bands, sig) per row; cls is a digest of the set, null if it is empty."""
    source = docs.select(docs[id_col].alias("doc_id"), *row_keys(id_col, text_col), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([
        *source.schema.fields[:3], T.StructField("cls", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(settings)
        for batch in batches:
            cls, sizes, bands, sigs = [], [], [], []
            for raw in as_bytes(batch.column(3)):
                own = shingles(raw, settings.shingle)
                sizes.append(len(own))
                if len(own):
                    values = signer.values(own)
                    cls.append(blake2b(own.tobytes(), digest_size=16).digest())
                    bands.append(signer.bands(values))
                    sigs.append(signer.signature(values))
                else:
                    cls.append(None), bands.append(np.zeros(0, dtype=np.int64)), sigs.append(None)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(cls, type=pa.binary()), pa.array(sizes, type=pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sigs, type=pa.binary())],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def _sets(docs: DataFrame, members: DataFrame, settings: NearSettings, id_col: str, text_col: str) -> DataFrame:
    """(cls, n, sig, own): the full sets of the member classes, from one text of each."""
    wanted = members.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "cls", F.col("n_shingles").alias("n"), "sig")
    if wanted.count() <= settings.broadcast_rows:  # else both sides are shuffled
        wanted = F.broadcast(wanted)
    k1, k2 = row_keys(id_col, text_col)
    keyed = docs.select(k1, k2, docs[text_col].cast("string").alias("text"))
    found = keyed.join(wanted, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select("cls", "n", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingles(raw, settings.shingle).tobytes() for raw in as_bytes(batch.column(3))], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own], names=["cls", "n", "sig", "own"])

    # a row that is repeated comes more than once
    return found.mapInArrow(run, "cls binary, n long, sig binary, own binary").dropDuplicates(["cls"])


def linked(pairs: DataFrame, members: DataFrame, settings: NearSettings) -> DataFrame:
    """The pairs (a, b) of classes that are linked: signatures first, then full sets."""
    bounds = least_matches(settings)
    width = settings.hashes

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, _ = surviving(_matrix(batch.column(2), width), _matrix(batch.column(3), width), bounds)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=U64) for c in (2, 3))
                if 100 * min(len(one), len(two)) < settings.threshold * max(len(one), len(two)):
                    continue
                shared = len(one) + len(two) - len(np.union1d(one, two))
                if 100 * shared >= settings.threshold * (len(one) + len(two) - shared):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, type=pa.int64()))

    def both(pairs: DataFrame, column: str) -> DataFrame:
        side = lambda name: members.select(F.col("cls").alias(name), F.col(column).alias(f"{column}_{name}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", f"{column}_a", f"{column}_b")

    survivors = both(pairs, "sig").mapInArrow(prune, "a binary, b binary")
    return both(survivors, "own").mapInArrow(verify, "a binary, b binary")


def components(edges: DataFrame, own: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge (a, b): the smallest node of its component.

    Alternates large and small stars until nothing changes; each round is a written table.
    """
    now = own.saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = mark(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins can be split where one node has very many neighbours
        low = own.saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = own.saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "stars")
        low = own.saved(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = own.saved(small.select("e.u", "e.v").where("u != v").distinct(), "stars")
        this = mark(now)
        if this == last:
            break
        last = this
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def block_rows(rows: DataFrame, own: Scratch, settings: NearSettings, sets: bool = False) -> DataFrame:
    """The rows (bucket, cls, root, main, n) of buckets, with q, o, asks: as they are sent to blocks.

    A class outside the bucket's main component asks, in one of the blocks q, all the blocks
    o of the bucket; every class is told in its own block o, to all the blocks q.
    """
    apart = F.col("root") != F.col("main")
    weight = (F.lit(1) if not sets else F.greatest(F.lit(1.0), F.col("n") * settings.block / settings.block_shingles)).cast("double")
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / settings.block)).cast("int")
    size = own.saved(rows.groupBy("bucket").agg(blocks(F.sum(weight)).alias("os"), blocks(F.sum(F.when(apart, weight))).alias("qs")), "near-sizes")
    placed = rows.join(size, "bucket")
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "cls"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    names = ("bucket", "cls", "root", "main")
    asks = placed.where(apart).select(*names, block(1, F.col("qs")).alias("q"), every(F.col("os")).alias("o"), F.lit(True).alias("asks"))
    told = placed.select(*names, every(F.col("qs")).alias("q"), block(2, F.col("os")).alias("o"), F.lit(False).alias("asks"))
    return asks.unionByName(told)


class _Block:
    """The classes that meet in a block, and which pairs across components survive the signatures."""

    def __init__(self, group: pa.Table, settings: NearSettings, bounds: list[tuple[int, int]]) -> None:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        self.cls, self.root, self.main = (np.array(group.column(c).to_pylist(), dtype=object) for c in ("cls", "root", "main"))
        self.sig = _matrix(group.column("sig"), settings.hashes)
        self.asking, self.told = np.flatnonzero(asks), np.flatnonzero(~asks)
        self.settings, self.bounds = settings, bounds

    def survivors(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in `told` that class k has to be verified with, and their matches."""
        root, told = self.root, self.told
        # two classes that both stand apart meet once
        others = np.flatnonzero((root[told] != root[k]) & ((root[told] == self.main[told]) | (self.cls[told] < self.cls[k])))
        keep, matches = surviving(np.broadcast_to(self.sig[k], (len(others), self.settings.hashes)), self.sig[told[others]], self.bounds)
        return others[keep], matches


def _nearest(rows: DataFrame, members: DataFrame, own: Scratch, settings: NearSettings) -> DataFrame:
    """(bucket, cls, nearest, matches, others) of the classes that survive somewhere in a bucket.

    `nearest` is the told class with the most matches and `others` the number of survivors of a
    class that asks; both are null and 0 where a class was only told.
    """
    bounds = least_matches(settings)
    sent = block_rows(rows, own, settings).join(members.select("cls", "sig"), "cls")
    kinds = [("bucket", pa.int64()), ("cls", pa.binary()), ("nearest", pa.binary()), ("matches", pa.int64()), ("others", pa.int64())]

    def compare(group: pa.Table) -> pa.Table:
        block = _Block(group, settings, bounds)
        bucket = group.column("bucket")[0].as_py()
        hit = np.zeros(len(block.told), dtype=bool)
        out: list[tuple] = []
        for k in block.asking:
            others, matches = block.survivors(k)
            if len(others):
                hit[others] = True
                best = np.lexsort((block.cls[block.told[others]], -matches))[0]
                out.append((bucket, block.cls[k], block.cls[block.told[others[best]]], int(matches[best]), len(others)))
        out += [(bucket, block.cls[j], None, None, 0) for j in block.told[hit]]
        return pa.table({name: pa.array(c, type=kind) for (name, kind), c in zip(kinds, zip(*out) if out else [()] * len(kinds))})

    met = sent.groupBy("bucket", "q", "o").applyInArrow(compare, "bucket long, cls binary, nearest binary, matches long, others long")
    best = F.max(F.when(F.col("nearest").isNotNull(), F.struct("matches", "nearest")))
    return met.groupBy("bucket", "cls").agg(best["nearest"].alias("nearest"), F.sum("others").alias("others"))


def _links_in_blocks(rows: DataFrame, members: DataFrame, own: Scratch, settings: NearSettings) -> DataFrame:
    """(a, b): for each class that asks, one link to each other component of its bucket that it is linked with."""
    bounds = least_matches(settings)
    sent = block_rows(rows, own, settings, sets=True).join(members.select("cls", "sig", "own"), "cls")

    def compare(group: pa.Table) -> pa.Table:
        block = _Block(group, settings, bounds)
        told = block.told
        out: list[tuple[bytes, bytes]] = []
        if len(block.asking) and len(told):
            sets = [np.frombuffer(x, dtype=U64) for x in group.column("own").to_pylist()]
            size = np.array([len(x) for x in sets])
            grams, gram_of = np.unique(np.concatenate([sets[k] for k in told]), return_inverse=True)
            first = np.concatenate(([0], np.cumsum(size[told])[:-1]))
            for k in block.asking:
                others, _ = block.survivors(k)
                if len(others):
                    mark = np.isin(grams, sets[k], assume_unique=True)
                    shared = np.add.reduceat(mark.take(gram_of).astype(np.int64), first)[others]
                    hits = told[others[100 * shared >= settings.threshold * (size[k] + size[told[others]] - shared)]]
                    out += [(max(block.cls[k], block.cls[j]), min(block.cls[k], block.cls[j])) for j in {block.root[j]: j for j in hits}.values()]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, type=pa.binary()), "b": pa.array(b, type=pa.binary())})

    return sent.groupBy("bucket", "q", "o").applyInArrow(compare, "a binary, b binary").distinct()


def _rows(docs: DataFrame, own: Scratch, settings: NearSettings, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, cls, least) per row; `least` is (id is null, id, k1, k2) of the component's first row."""
    signed = own.saved(sign(docs, settings, id_col, text_col), "near-signed", stays=True)
    real = signed.where("cls IS NOT NULL")
    classes = own.saved(real.select("cls", "k1", "k2", "n_shingles", "bands", "sig").dropDuplicates(["cls"]), "near-classes")
    placed = classes.select("cls", F.explode("bands").alias("bucket"))
    several = own.saved(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cls").alias("lead")).where("size > 1"), "near-several")
    shared = own.saved(placed.join(several, "bucket"), "near-buckets")
    members = own.saved(_sets(docs, classes.join(shared.select("cls").distinct(), "cls", "left_semi"), settings, id_col, text_col), "near-members")

    met = own.saved(shared.where("cls != lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct(), "near-met")
    first = own.saved(met.groupBy("a").agg(F.min("b").alias("b")), "near-pairs")
    edges = own.saved(linked(first, members, settings), "near-links")
    roots = own.saved(components(edges, own), "near-roots")

    def with_roots(df: DataFrame, *names: str) -> DataFrame:
        for name in names:
            df = df.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"_{name}")), name, "left")
            df = df.withColumn(f"_{name}", F.coalesce(f"_{name}", name))
        return df

    def merge(found: DataFrame) -> DataFrame:
        """Roots after more links: only the roots that the links join move."""
        joint = own.saved(components(with_roots(found, "a", "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), own), "near-joint")
        moved = roots.join(joint.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        fresh = joint.join(roots.select("node"), "node", "left_anti")
        return own.saved(moved.unionByName(fresh), "near-roots")

    second = own.saved(with_roots(met.join(first, ["a", "b"], "left_anti"), "a", "b").where("_a != _b").select("a", "b"), "near-pairs")
    roots = merge(linked(second, members, settings))
    tested = first.unionByName(second)

    def apart(rows: DataFrame) -> DataFrame:
        """Of the buckets of rows (bucket, cls) those that hold several components, with each class's and the largest one."""
        rooted = own.saved(with_roots(rows.select("bucket", "cls"), "cls").withColumnRenamed("_cls", "root"), "near-rooted")
        main = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main"))
        main = own.saved(main.where("parts > 1").select("bucket", "main"), "near-main")
        return own.saved(rooted.join(main, "bucket").join(members.select("cls", "n"), "cls").select("bucket", "cls", "root", "main", "n"), "near-apart")

    # in a bucket of two, both have met
    near = own.saved(_nearest(apart(shared.where("size > 2")), members, own, settings), "near-nearest")
    pairs = near.where("nearest IS NOT NULL").select(F.greatest("cls", "nearest").alias("a"), F.least("cls", "nearest").alias("b")).distinct()
    roots = merge(linked(pairs.join(tested, ["a", "b"], "left_anti"), members, settings))
    if near.agg(F.max("others")).first()[0] not in (None, 0, 1):
        roots = merge(_links_in_blocks(apart(near), members, own, settings))

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    ids = with_roots(real.groupBy("cls").agg(F.min(order).alias("least")), "cls").withColumnRenamed("_cls", "root")
    # components of one class need no further grouping; the others are few
    joined = ids.join(roots.select(F.col("node").alias("cls")), "cls", "left_semi").groupBy("root").agg(F.min("least").alias("first"))
    ids = own.saved(ids.join(joined, "root", "left").select("cls", F.coalesce("first", "least").alias("least")), "near-ids", stays=True)
    return signed.join(ids, "cls", "left").select("doc_id", "k1", "k2", "n_shingles", "cls", "least")


def near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept) per row."""
    with scratch(docs.sparkSession) as own:
        rows = _rows(docs, own, settings, id_col, text_col)
    out = rows.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")))
    return out.select("doc_id", "k1", "k2", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id (a null id last), of several texts under that id the
    one with the smallest row key, of rows that repeat id and text any one.  Rows without words all stay."""
    with scratch(docs.sparkSession) as own:
        rows = own.saved(_rows(docs, own, settings, id_col, text_col).where("cls IS NOT NULL"), "near-rows", stays=True)
    mine = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
    k1, k2 = row_keys(id_col, text_col)
    own1, own2, both = fresh(docs.columns, "near_k1", "near_k2", "near_key")
    match = (k1 == F.col(own1)) & (k2 == F.col(own2))
    keys = lambda df: df.select(F.col("k1").alias(own1), F.col("k2").alias(own2))
    single = docs.join(keys(rows.where(~mine)), match, "left_anti")
    again = rows.where(mine).groupBy("k1", "k2").count().where("count > 1")
    if again.isEmpty():
        return single
    again = own.saved(keys(again), "near-again", stays=True)
    repeated = single.select("*", F.struct(k1, k2).alias(both)).join(again, match, "left_semi")
    return single.join(again, match, "left_anti").unionByName(repeated.dropDuplicates([both]).drop(both))
