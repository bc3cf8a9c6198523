"""Operator 12: Merkle manifest of a dataset.

A row's leaf is the SHA-256 of its fields, each as byte count, colon and value, or `-` for
null.  In every part (a language) leaves stand by id; eight neighbours at a time become
their digest, level by level, until one is left, the part's subroot.  The subroots, by part
(null first, then by bytes), make the root in the same way.  Digests are hex text.

Aligned blocks of 512 nodes hold each of their levels as one string of 64-character digests.
A parent is the digest of a fixed-width substring, a node's siblings are the substrings on
both sides of it in its run of eight.  The digests of the blocks are the nodes of the next,
512 times smaller, table of blocks, until every part has one block; then proofs are handed
down from the root, by one join per table of blocks.

Places of rows come from a range partitioning by part, id and leaf, whose rows are counted by
partition, so no part meets in one task.  A block holds 512 rows at most.  Texts are read
once and never shuffled.

Null id: first of its part.  Rows with equal ids stand by leaf, so that repeated rows give the same
tree in any order.  Null part: a part of its own.  A lone leaf is its subroot, a lone subroot the root.
An empty table has no root and no proofs.  Values count as the bytes that they have, valid UTF-8 or not.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import Scratch, scratch

ARITY = 8
DEPTH = 3
BLOCK = ARITY**DEPTH
WIDTH = 64
RUN = ARITY * WIDTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """The digest of a row's values."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the siblings on its path give."""
    return F.aggregate(path, node, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, from the leaf's run to the root."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _part(column: Column) -> Column:
    """A text that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _placed(rows: DataFrame, by: list[str], tables: Scratch) -> DataFrame:
    """The rows with `pos`, their place in their part by the columns `by`, and `n`, the rows of the part."""
    tie = F.monotonically_increasing_id()  # equal rows can be dealt to several tasks
    dealt = rows.withColumn("tie", tie).repartitionByRange("part", *by, "tie").sortWithinPartitions("part", *by, "tie").drop("tie")
    dealt = tables.saved(dealt.withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "merkle-dealt")
    runs = dealt.groupBy("part", "task").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    of = "PARTITION BY part"
    runs = runs.select("part", "task", "first", F.expr(f"sum(size) OVER ({of} ORDER BY task) - size").alias("before"), F.expr(f"sum(size) OVER ({of})").alias("n"))
    return dealt.join(runs, ["part", "task"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("task", "at", "first", "before")


def _up(level: Column) -> Column:
    """The level above one: digests of its runs."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(level.substr(i * RUN + 1, F.lit(RUN)), 256)), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(part, block, n, steps, items, l0 .. l3) of nodes (part, pos, n, node, carried columns).

    `steps` levels lie above the nodes in this block, the last of them one digest.
    """
    items = F.array_sort(F.collect_list(F.struct("pos", *(c for c in nodes.columns if c not in ("part", "pos", "n")))))
    steps = reduce(lambda done, k: F.when(F.col("n") <= ARITY**k, k).otherwise(done), reversed(range(DEPTH)), F.lit(DEPTH))
    out = nodes.groupBy("part", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), items.alias("items"))
    out = out.withColumns({"steps": steps, "l0": F.array_join(F.transform("items", lambda x: x["node"]), "")})
    for k in range(1, DEPTH + 1):
        out = out.withColumn(f"l{k}", F.when(F.col("steps") >= k, _up(F.col(f"l{k - 1}"))))
    return out


def _top() -> Column:
    """A block's own digest."""
    return F.coalesce(*(F.col(f"l{k}") for k in range(DEPTH, -1, -1)))


def _beside(level: Column, at: Column) -> Column:
    """The siblings of a level's node number `at`."""
    left = F.pmod(at, F.lit(ARITY)) * WIDTH
    return F.struct(level.substr(at * WIDTH - left + 1, left).alias("left"), level.substr((at + 1) * WIDTH + 1, F.lit(RUN - WIDTH) - left).alias("right"))


def _down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of the blocks with their paths, from the paths of the blocks' digests (part, pos, path and more)."""
    more = [c for c in paths.columns if c not in ("part", "pos", "path")]
    known = blocks.join(paths.withColumnRenamed("pos", "block"), ["part", "block"])

    def run(i: Column) -> Column:
        above = [F.when(F.col("steps") > k, F.array(_beside(F.col(f"l{k}"), F.floor(i / ARITY ** (k - 1)).cast("int")))).otherwise(F.array().cast(_PATH)) for k in range(1, DEPTH)]
        return F.struct(F.col("l0").substr(i * RUN + 1, F.lit(RUN)).alias("nodes"), F.slice("items", i * ARITY + 1, ARITY).alias("items"), F.concat(*above, "path").alias("path"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / ARITY).cast("int")), run)
    each = known.select("part", "steps", *more, F.explode(runs).alias("r"))
    each = each.select("part", "steps", *more, "r.nodes", "r.path", F.posexplode("r.items").alias("k", "item"))
    path = F.when(F.col("steps") > 0, F.concat(F.array(_beside(F.col("nodes"), F.col("k"))), "path")).otherwise(F.col("path"))
    return each.select("part", *more, "item.*", path.alias("path"))


_PATH = "array<struct<left:string,right:string>>"


def _tables(nodes: DataFrame, tables: Scratch) -> list[DataFrame]:
    """The tables of blocks, from the nodes' own to the one with a block for each part."""
    most, found = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1 or not found:
        found.append(tables.saved(_blocks(nodes), "merkle-blocks", stays=True))
        nodes = found[-1].select("part", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), _top().alias("node"))
        most = -(-most // BLOCK)
    return found


@dataclass(frozen=True)
class Manifest:
    """Tables of blocks of the parts and of the tree of their subroots, each from the leaves up; `root` is null without rows."""

    parts: list[DataFrame]
    trunk: list[DataFrame]
    root: str | None

    def levels(self) -> DataFrame:
        """The manifest itself: (part, level, block, nodes), a level's nodes in a block as one string; the tree of subroots has no part.

        Blocks are those of the table that makes the level: of 512 rows for levels 0 to 3, of 512 nodes of level 3 for levels 4 to 6.
        """
        out = []
        for own, tables in ((True, self.parts), (False, self.trunk)):
            part = F.col("part") if own else F.lit(None).cast("string")
            for j, blocks in enumerate(tables):
                out += [blocks.where(F.col("steps") >= k).select(part.alias("part"), F.lit(j * DEPTH + k).alias("level"), "block", F.col(f"l{k}").alias("nodes")) for k in range(min(j, 1), DEPTH + 1)]
        return reduce(DataFrame.unionByName, out)

    def subroots(self) -> DataFrame:
        return self.parts[-1].select("part", _top().alias("subroot"))

    def proofs(self) -> DataFrame:
        """Every row's id, carried columns, leaf, subroot, root and path, an array of (left, right) siblings from the leaf up."""
        paths = self.trunk[-1].select("part", F.col("block").alias("pos"), F.array().cast(_PATH).alias("path"))
        for blocks in reversed(self.trunk):
            paths = _down(blocks, paths.select("part", "pos", "path"))
        paths = paths.select(F.col("of").alias("part"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "path")
        for k, blocks in enumerate(reversed(self.parts)):
            last = k + 1 == len(self.parts)
            paths = _down(blocks, paths)
            paths = paths if last else paths.select("part", "pos", "subroot", "path")
        return paths.withColumnsRenamed({"row_id": "doc_id", "node": "leaf"}).withColumn("root", F.lit(self.root)).drop("part", "pos")


def build(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, carried: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of a table.  `carried`: columns by name, read with the leaves and given back by `proofs`."""
    leaves = docs.select(_part(docs[part_col]).alias("part"), docs[id_col].alias("row_id"), leaf([docs[c] for c in fields]).alias("node"), *(c.alias(name) for name, c in (carried or {}).items()))
    with scratch(docs.sparkSession) as own:
        # written, as range partitioning samples its rows first and would read the texts twice
        leaves = own.saved(leaves, "merkle-leaves")
        parts = _tables(_placed(leaves, ["row_id", "node"], own), own)
        subroots = parts[-1].select(F.lit("").alias("part"), F.col("part").alias("of"), _top().alias("node"))
        trunk = _tables(_placed(subroots, ["of"], own), own)
        root = trunk[-1].select(_top().alias("root")).first()
    return Manifest(parts, trunk, root["root"] if root else None)


def tampered(docs: DataFrame, where: Column, change: Column, text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf that a row has after its text was changed, null where it wasn't."""
    return F.when(where, leaf([change if c == text_col else docs[c] for c in fields]))


def digest(found: DataFrame) -> DataFrame:
    """Digests of the proofs, and the root that each gives from the carried leaf `other`, else from its own."""
    out = found.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_VALUES = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in FIELDS)
_CHANGED = _VALUES.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
#: CRC-32 of a number's digits, byte by byte and bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
    " lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(k AS BIGINT) for k in range(8)]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"
)
_TREE = "SELECT tree, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM {0} WHERE n > 1 GROUP BY tree, lvl, pos // 8"
_BESIDE = "SELECT f.part, f.pos, {1} + x.lvl AS step, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos < f.at // CAST(8 ** x.lvl AS BIGINT)), '') || '|' || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos > f.at // CAST(8 ** x.lvl AS BIGINT)), '') AS s FROM {2} f JOIN {0} x ON x.tree = f.tree AND x.n > 1 AND x.pos // 8 = f.at // CAST(8 ** (x.lvl + 1) AS BIGINT) GROUP BY f.part, f.pos, x.lvl"

#: For row-unique ids that are not null.
DIGEST_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, sha256({_VALUES}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_CHANGED}) END AS other FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM leaves
), nodes(tree, lvl, pos, h, n) AS (
  SELECT part, 0, pos, leaf, n FROM placed UNION ALL {_TREE.format("nodes")}
), subroots AS (
  SELECT tree AS part, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), trunk(tree, lvl, pos, h, n) AS (
  SELECT '', 0, pos, h, n FROM subroots UNION ALL {_TREE.format("trunk")}
), beside AS (
  {_BESIDE.format("nodes", 0, "(SELECT part, pos, part AS tree, pos AS at FROM placed)")}
  UNION ALL {_BESIDE.format("trunk", 1000, "(SELECT p.part, p.pos, '' AS tree, s.pos AS at FROM placed p JOIN subroots s USING (part))")}
), paths AS (
  SELECT part, pos, list(s ORDER BY step) AS path FROM beside GROUP BY part, pos
), folded AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM trunk WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(p.other, p.leaf), coalesce(path, [])), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root
  FROM placed p JOIN subroots s ON s.part = p.part LEFT JOIN paths q ON q.part = p.part AND q.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""
