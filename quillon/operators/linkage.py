"""Record linkage: mutual best matches, tiered links, claims and routes.

Where a key may be frequent, the side that is looked up is grouped by it first, so that
a hot key makes one row and not all pairs.  Ambiguity gives a row with a reason, never a
guess.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.sources.shared import written


def margins(edges: DataFrame, key: str, score: str, tie: str, prefix: str) -> DataFrame:
    """Rank of each edge within its key and the best one's lead over the runner-up (1 if alone)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    best, second = F.first(score).over(w), F.nth_value(score, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return edges.withColumns({f"{prefix}_rank": F.row_number().over(w).cast("long"), f"{prefix}_margin": F.coalesce(F.round(best - second, 6), F.lit(1.0))})


def mutual_best(edges: DataFrame, source: str, target: str, score: str, least_margin: float = 0.08) -> DataFrame:
    """Each source's best target: accepted if both are each other's best and both margins suffice, else review."""
    ranked = margins(margins(edges, source, score, target, "source"), target, score, source, "target")
    mutual = F.col("target_rank") == 1
    clear = (F.col("source_margin") >= least_margin) & (F.col("target_margin") >= least_margin)
    return ranked.where("source_rank = 1").select(source, target, score, "source_margin", "target_margin", mutual.alias("mutual"), F.when(mutual & clear, "accepted").otherwise("review").alias("outcome"))


def decisions(sources: DataFrame, edges: DataFrame, source: str, target: str, score: str, least_margin: float = 0.08) -> DataFrame:
    """Every source with its decision: accepted, review or unmatched; for a review its two best candidates.

    Only the two best edges of a source and of a target are ranked against each other, so that a target with very
    many edges is cut down before its rows meet.
    """
    by_source = Window.partitionBy(source).orderBy(F.desc(score), target)
    by_target = Window.partitionBy(target).orderBy(F.desc(score), source)
    best = edges.select(source, target, score).withColumn("_k", F.row_number().over(by_source)).where("_k <= 2")
    top = best.groupBy(source).agg(F.min_by(F.struct(target, score), "_k").alias("_top"), F.array_sort(F.collect_list(F.struct("_k", target, score))).alias("_both"))
    rivals = edges.select(source, target, score).withColumn("_k", F.row_number().over(by_target)).where("_k <= 2")
    held = rivals.groupBy(target).agg(F.min_by(source, "_k").alias("_holder"), F.max(F.when(F.col("_k") == 1, F.col(score))).alias("_s1"), F.max(F.when(F.col("_k") == 2, F.col(score))).alias("_s2"))
    margin = lambda a, b: F.coalesce(F.round(a - b, 6), F.lit(1.0))
    joined = top.select(source, F.col(f"_top.{target}").alias(target), F.col(f"_top.{score}").alias(score), "_both").join(held, target)
    mutual = F.col("_holder") == F.col(source)
    source_margin, target_margin = margin(F.col(score), F.get("_both", F.lit(1))[score]), margin(F.col("_s1"), F.col("_s2"))
    accepted = mutual & (source_margin >= least_margin) & (target_margin >= least_margin)
    decided = joined.select(
        source, target, score, source_margin.alias("source_margin"), target_margin.alias("target_margin"), mutual.alias("mutual"), F.when(accepted, "accepted").otherwise("review").alias("outcome"),
        F.when(~accepted, F.transform("_both", lambda x: x[target])).alias("candidates"),
    )
    return sources.select(source).distinct().join(decided, source, "left").withColumn("outcome", F.coalesce("outcome", F.lit("unmatched")))


def tiered(sources: DataFrame, targets: DataFrame, source_id: str, target_id: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """(source_id, tier, target, outcome): the first tier whose key any target has decides.

    `tiers`: name and key, the same expression on both sides; null keys don't match.  One
    target with the key: linked; several: ambiguous; a target that several sources claim:
    collision; no tier: unmatched.
    """
    key_array = F.array(*(F.struct(F.lit(k).alias("tier_no"), F.lit(name).alias("tier"), key.cast("string").alias("key")) for k, (name, key) in enumerate(tiers)))
    exploded = lambda df, i: df.select(F.col(i), F.explode(key_array).alias("t")).select(i, "t.tier_no", "t.tier", "t.key").where("key IS NOT NULL")
    known = exploded(targets, target_id).groupBy("tier_no", "key").agg(F.count("*").alias("n"), F.min(target_id).alias("target"))
    hits = exploded(sources, source_id).join(known, ["tier_no", "key"])
    first = hits.groupBy(source_id).agg(F.min(F.struct("tier_no", "tier", "n", "target")).alias("hit"))
    return _resolved(sources, first, source_id)


def _resolved(sources: DataFrame, first: DataFrame, source_id: str) -> DataFrame:
    """Outcomes from the first tier that hit each source."""
    linked = first.select(source_id, "hit.tier", F.when(F.col("hit.n") == 1, F.col("hit.target")).alias("target"))
    claims = linked.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("claims"))
    outcome = F.when(F.col("tier").isNull(), "unmatched").when(F.col("target").isNull(), "ambiguous").when(F.col("claims") > 1, "collision").otherwise("linked")
    return sources.select(source_id).join(linked, source_id, "left").join(claims, "target", "left").select(source_id, "tier", F.when(outcome == "linked", F.col("target")).alias("target"), outcome.alias("outcome"))


def text_linked(sources: DataFrame, targets: DataFrame, source_id: str, target_id: str, text: str, explicit: str | None = None, within: str | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(source_id, tier, target, outcome) as by `tiered`, with tiers that compare whole texts.

    explicit: equal `explicit` columns; content: equal texts, case- and blank-folded; prefix:
    the target starts with the whole source of 40 characters or more; anchor: the source's
    anchor tokens, 6 or more of 32 or more characters together, begin the target's, or the
    target's 6 or more begin them and are three quarters of them at least.  Texts are compared
    within equal `within` columns, if given.

    Prefixes are equi-joins on hashes: a target is cut at the lengths that sources of its
    block (the same 40 characters or 6 tokens, doubled up to half of the shorter text) have, a source at those that targets have.
    Which lengths a row meets is found from hashes of its starts; only the rows that meet any are cut, and texts travel for no others
    (for all, once a tier, where those rows and their blocks' sizes are more than `broadcast_rows`).
    """

    def prepared(df: DataFrame, key: str) -> DataFrame:
        normal = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
        plain = F.regexp_replace(F.lower(text), r"(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]", " ")
        anchors = F.filter(F.regexp_extract_all(plain, F.lit(r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?"), 0), lambda x: (F.length(x) >= 3) | x.rlike(r"^\d+$"))
        part = F.lit("") if within is None else F.col(within).cast("string")
        own = F.lit(None).cast("string") if explicit is None else F.col(explicit).cast("string")
        folded = df.select(F.col(key).alias("id"), own.alias("own"), part.alias("part"), F.nullif(normal, F.lit("")).alias("normal"), anchors.alias("anchors"))
        folded = folded.withColumns({"chars": F.length("normal"), "count": F.size("anchors"), "anchors": F.array_join("anchors", " ")})
        return folded.withColumn("row", F.monotonically_increasing_id())

    def keyed(df: DataFrame, tier: int, *parts: Column, more: tuple[str, ...] = ()) -> DataFrame:
        """Rows with a key of the tier; a null part is no key."""
        there = functools.reduce(operator.and_, (p.isNotNull() for p in parts))
        return df.where(there).select("id", F.lit(tier).alias("tier_no"), F.unhex(F.sha2(F.concat_ws("\n", *parts), 256)).alias("key"), *more)

    def blocked(df: DataFrame, way: tuple[str, str, int], every: bool = False) -> DataFrame:
        """Rows with the hash of their first least * 2 ** level units as `block`, for their last `level` or for every one."""
        cut, size, least = way
        top = f"CAST(length(bin({size} DIV {least})) - 1 AS INT)"
        start = f"xxhash64(part, {cut.format(n=f'shiftleft({least}, level)')})"
        if not every:
            return df.withColumn("level", F.expr(top)).withColumn("block", F.expr(start))
        starts = F.expr(f"explode(transform(sequence(0, {top}), level -> struct(level, {start} AS block)))")
        return df.withColumn("start", starts).withColumns({"level": F.col("start.level"), "block": F.col("start.block")})

    def meeting(df: DataFrame, other: DataFrame, way: tuple[str, str, int], name: str) -> DataFrame:
        """(name, level, block, row, sizes): the rows that begin as rows of the other side do, with the sizes of these, if any fits.

        A row of the other side is blocked by its first least * 2 ** level units, half of it at least; a row meets it by as
        many units of its own, so texts that only begin alike don't multiply.
        """
        sizes = blocked(other.where("part IS NOT NULL"), way).select("level", "block", F.col(way[1]).alias("n")).distinct()
        sizes = sizes.groupBy("level", "block").agg(F.collect_set("n").alias("sizes"))
        own = blocked(df.where("part IS NOT NULL"), way, every=True).select("level", "block", "row", F.col(way[1]).alias("size"))
        found = own.join(sizes, ["level", "block"]).where(F.exists("sizes", lambda n: fits[name](n, F.col("size"))))
        return found.select(F.lit(name).alias("name"), "level", "block", "row", "sizes")

    def cut_at(df: DataFrame, way: tuple[str, str, int], name: str) -> DataFrame:
        """The rows that meet sizes, each with every size `n` that fits."""
        own = met.where(F.col("name") == name)
        if weights.get(name, 0) <= broadcast_rows:  # three numbers a row, and a block's sizes once
            blocks = own.groupBy("level", "block").agg(F.first("sizes").alias("sizes"))
            rows = df.join(F.broadcast(own.select("row", "level", "block")), "row").join(F.broadcast(blocks), ["level", "block"])
        else:
            rows = df.join(own.select("row", "sizes"), "row")
        return rows.withColumn("n", F.explode(F.filter("sizes", lambda n: fits[name](n, F.col(way[1])))))

    def in_blocks(df: DataFrame, way: tuple[str, str, int], name: str, tier: int, *parts: Column) -> DataFrame:
        """Keys of the rows whose size a row of the other side meets."""
        keys = keyed(blocked(df, way), tier, *parts, more=("level", "block"))
        return keys.join(met.where(F.col("name") == name).select("level", "block"), ["level", "block"], "left_semi").select("id", "tier_no", "key")

    # each side is read a dozen times below, and folding texts takes most of the time; the two tables are most of the disk
    a, b = written(prepared(sources, source_id), "linked-sources", "zstd"), written(prepared(targets, target_id), "linked-targets", "zstd")
    # how a text is cut after n units, how many it has, and how many a prefix has at least
    by_chars, by_words = ("left(normal, {n})", "chars", 40), ("substring_index(anchors, ' ', {n})", "count", 6)
    normal, words = F.col("normal"), F.col("anchors")
    long, wide = a.where("chars >= 40"), b.where("chars >= 40")
    solid = a.where((F.col("count") >= 6) & (F.length("anchors") - F.col("count") + 1 >= 32))
    worded = b.where("count >= 6")
    fits = {"starts": operator.lt, "longer": operator.lt, "shorter": lambda n, size: (n < size) & (n >= 0.75 * size)}
    met = meeting(wide, long, by_chars, "starts").unionByName(meeting(worded, solid, by_words, "longer")).unionByName(meeting(solid, worded, by_words, "shorter"))
    # the rows that meet sizes are mostly few, and weighed before texts are joined with them
    met = written(met, "linked-sizes")
    weighed = met.groupBy("name", "level", "block").agg((F.count("*") + F.size(F.first("sizes"))).alias("weight"))
    weights = dict(weighed.groupBy("name").agg(F.sum("weight")).collect())
    part, whole, forward, backward = F.col("part"), F.lit("whole"), F.lit("forward"), F.lit("backward")
    first_chars, first_words = F.expr(by_chars[0].format(n="n")), F.expr(by_words[0].format(n="n"))
    # a prefix that is the whole target is equal text, which the tier before has found
    known = keyed(b, 0, F.col("own")).unionByName(keyed(b, 1, whole, part, normal))
    known = known.unionByName(keyed(cut_at(wide, by_chars, "starts"), 2, part, first_chars)).unionByName(keyed(worded, 3, forward, part, words))
    known = known.unionByName(keyed(cut_at(worded, by_words, "longer"), 3, forward, part, first_words)).unionByName(in_blocks(worded, by_words, "shorter", 3, backward, part, words))
    known = known.groupBy("tier_no", "key").agg(F.count("*").alias("n"), F.min("id").alias("target"))
    asked = keyed(a, 0, F.col("own")).unionByName(keyed(a, 1, whole, part, normal)).unionByName(in_blocks(long, by_chars, "starts", 2, part, normal))
    asked = asked.unionByName(keyed(solid, 3, forward, part, words)).unionByName(keyed(cut_at(solid, by_words, "shorter"), 3, backward, part, first_words))
    # the keys of one tier have no target in common, so their counts add up
    hits = asked.join(known, ["tier_no", "key"]).groupBy("id", "tier_no").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    name = F.element_at(F.array(*map(F.lit, ("explicit", "content", "prefix", "anchor"))), F.col("tier_no") + 1)
    first = hits.groupBy(F.col("id").alias(source_id)).agg(F.min(F.struct("tier_no", name.alias("tier"), "n", "target")).alias("hit"))
    return _resolved(sources, first, source_id)


def resolve_claims(slots: DataFrame, claims: DataFrame, slot: str) -> DataFrame:
    """Every expected slot with its resolution.

    `claims`: (slot, value, source, official); a null value is no claim.  Official values that disagree: official_conflict;
    one: official; else a value that two sources give alone: corroborated; several values:
    conflict; one claim: unverified; none: gap.
    """
    by_value = claims.where("value IS NOT NULL").groupBy(slot, "value").agg(F.count_distinct("source").alias("sources"), F.max(F.col("official").cast("int")).alias("official"))
    found = by_value.groupBy(slot).agg(
        F.count("*").alias("n_values"), F.sum("official").alias("official_values"), F.min(F.when(F.col("official") == 1, F.col("value"))).alias("official_value"),
        F.min("value").alias("one_value"), F.max("sources").alias("most_sources"),
    )
    joined = slots.select(slot).join(found, slot, "left")
    status = (
        F.when(F.col("n_values").isNull(), "gap").when(F.col("official_values") > 1, "official_conflict").when(F.col("official_values") == 1, "official")
        .when(F.col("n_values") > 1, "conflict").when(F.col("most_sources") >= 2, "corroborated").otherwise("unverified")
    )
    value = F.when(status == "official", F.col("official_value")).when(status.isin("corroborated", "unverified"), F.col("one_value"))
    disagrees = (status == "official") & (F.col("n_values") > 1)
    return joined.select(slot, status.alias("status"), value.alias("value"), disagrees.alias("secondary_disagrees"))


def judged_pairs(sources: DataFrame, slots: DataFrame, block: list[str], rules: dict[str, Column]) -> DataFrame:
    """Pairs of a source and a slot of the same block, with the first rule that rejects them (null: none does).

    Blocks are papers: their slots are few, so pairs stay in proportion to the sources.  The columns of sources are
    prefixed `a_`, those of slots `b_`; rules are over these.
    """
    named = lambda df, p: df.select(*block, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in block))
    reason = F.coalesce(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()))
    return named(sources, "a").join(named(slots, "b"), block).withColumn("rejected", reason)


def rejections(pairs: DataFrame) -> DataFrame:
    """(reason, pairs): how many pairs each rule has rejected, `candidate` for those that stay."""
    return pairs.groupBy(F.coalesce("rejected", F.lit("candidate")).alias("reason")).agg(F.count("*").alias("pairs"))


def _compared(pairs: DataFrame, name: str, text: Column, needed: Column, coverage: float, score: float, above: Column | None = None) -> DataFrame:
    """The pairs (with the left text's `_words`) with their similarity; only those that can reach the limits, and exceed `above`, are compared, the others get zeros.

    A text whose words are a run of the other's has its similarity from their numbers; what is left is compared in sequence.
    """
    worth = needed if above is None else needed & (F.coalesce(above, F.lit(0.0)) < 1.0)
    split = pairs.withColumn("_b", F.when(worth, tx.similarity_words(text)))
    run = split.withColumn("_run", tx.contained_similarity(F.col("_words"), F.col("_b")))
    bounds = run.withColumn("_most", F.when(worth & F.col("_run").isNull(), tx.word_bounds(F.col("_words"), F.col("_b"))))
    able = (F.col("_most.coverage") >= coverage) & (F.col("_most.score") >= score)
    if above is not None:
        able = able & (F.col("_most.score") > F.coalesce(above, F.lit(0.0)))
    marked = bounds.withColumn("_able", F.coalesce(able, F.lit(False))).drop("_b", "_most")
    similar = tx.text_similarity(F.when(F.col("_able"), F.col("a_text")), F.when(F.col("_able"), text))
    return marked.withColumn("_seq", similar).withColumn(name, F.coalesce("_run", "_seq")).drop("_able", "_run", "_seq")


def text_edges(pairs: DataFrame, topic_score: Column, evidence: dict[str, Column], exact: str, existing: Column | None = None) -> DataFrame:
    """The candidates among judged pairs whose texts agree, with `score` = 0.9 text + 0.1 topic.

    `evidence`: texts of a slot by kind, with confidence `b_confidence` for those that aren't `exact`.  An exact text
    needs a score of 0.74 and a coverage of 0.68; a recognised one 0.62, 0.58, a longest run of 0.20 and a confidence of
    0.70.  A pair whose existing text scores under 0.30 is left out.
    """
    found = pairs.where("rejected IS NULL").withColumns({"_topic": topic_score, "_words": tx.similarity_words(F.col("a_text"))})
    sure = F.coalesce("b_confidence", F.lit(0.0)) >= 0.70
    if existing is not None:  # it can leave a pair out, so it comes first
        blank = existing.isNull() | (F.trim(existing) == "")
        found = _compared(found, "_old", existing, ~blank, 0.0, 0.30).where(blank | (F.col("_old.score") >= 0.30))
    best = []
    for kind, text in evidence.items():
        so_far = F.greatest(*best) if len(best) > 1 else best[0] if best else None
        least, coverage = (0.74, 0.68) if kind == exact else (0.62, 0.58)
        if existing is not None and str(text) == str(existing):  # its score is there, and what can't reach 0.30 reaches no limit
            found = found.withColumn(f"_{kind}", F.col("_old"))
        else:
            found = _compared(found, f"_{kind}", text, text.isNotNull() & (F.lit(kind == exact) | sure), coverage, least, so_far)
        s, c, longest = (F.col(f"_{kind}.{x}") for x in ("score", "coverage", "longest"))
        good = (s >= 0.74) & (c >= 0.68) if kind == exact else (s >= 0.62) & (c >= 0.58) & (longest >= 0.20) & sure
        best.append(F.when(text.isNotNull() & good, s))
    text_score = F.greatest(*best) if len(best) > 1 else best[0]
    return found.withColumn("text_score", text_score).where("text_score IS NOT NULL").withColumn("score", F.round(0.9 * F.col("text_score") + 0.1 * F.col("_topic"), 6))


def any_key(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str]) -> DataFrame:
    """Pairs that agree on any of the keys, once: a union of equi-joins instead of an OR."""
    pairs = None
    for key in keys:
        hit = left.where(F.col(key).isNotNull()).select(left_id, key).join(right.select(right_id, key), key).select(left_id, right_id)
        pairs = hit if pairs is None else pairs.unionByName(hit)
    return pairs.distinct()


def alias_lookup(dimension: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(key, id) for every squashed name; keys that two ids share have id null."""
    squashed = F.array(*(F.regexp_replace(F.lower(F.col(n).cast("string")), "[^a-z0-9]", "") for n in names))
    keys = dimension.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.filter(squashed, lambda x: x.isNotNull() & (x != "")))).alias("key")).distinct()
    return keys.groupBy("key").agg(F.when(F.count("*") == 1, F.min("id")).alias("id"))


def routes(ids: DataFrame, id_col: str, stages: dict[str, DataFrame]) -> DataFrame:
    """The first stage that knows each id, `unresolved` if none does; stages are frames with the column."""
    out = ids
    label = F.lit("unresolved")
    for name, known in reversed(list(stages.items())):
        flag = f"_{name}"
        out = out.join(known.select(id_col).distinct().withColumn(flag, F.lit(True)), id_col, "left")
        label = F.when(F.col(flag), F.lit(name)).otherwise(label)
    return out.select(*ids.columns, label.alias("route"))


def zip_lists(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Positional pairs of two arrays where their sizes agree, else null and `mismatch` true."""
    same = F.size(a) == F.size(b)
    return rows.withColumn("pairs", F.when(same, F.arrays_zip(a, b))).withColumn("mismatch", ~F.coalesce(same, F.lit(False)))


def prune_graph(nodes: DataFrame, edges: DataFrame, present: DataFrame, terminal: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (code) and edges (src, dst) among those present; nodes left without a way out get one to the terminal."""
    kept = nodes.join(present.select("code"), "code", "left_semi")
    inner = edges.join(kept.select(F.col("code").alias("src")), "src", "left_semi").join(kept.select(F.col("code").alias("dst")), "dst", "left_semi").select("src", "dst")
    orphans = kept.where(F.col("code") != terminal).select(F.col("code").alias("src")).join(inner.select("src").distinct(), "src", "left_anti")
    return kept, inner.unionByName(orphans.withColumn("dst", F.lit(terminal)))


def next_node(progress: DataFrame, edges: DataFrame, user: str = "user_id") -> DataFrame:
    """Per learner what to study next: (user, code, reason).

    `progress`: (user, code, level, percent).  In progress first, then a node whose
    prerequisites are done, then any that isn't.
    """
    needs = edges.select(F.col("src").alias("need"), F.col("dst").alias("code"))
    done = progress.select(user, F.col("code").alias("need"), (F.col("percent") >= 100).alias("ok"))
    ready = done.join(needs, "need").groupBy(user, "code").agg(F.every("ok").alias("ready"))
    state = progress.join(ready, [user, "code"], "left").withColumn("ready", F.coalesce("ready", F.lit(True)))
    tier = F.when((F.col("percent") > 0) & (F.col("percent") < 100), 0).when((F.col("percent") < 100) & F.col("ready"), 1).when(F.col("percent") < 100, 2).otherwise(3)
    best = state.groupBy(user).agg(F.min(F.struct(tier.alias("tier"), F.col("level"), F.col("code"))).alias("b"))
    reason = F.element_at(F.array(F.lit("in_progress"), F.lit("ready"), F.lit("incomplete"), F.lit("complete")), F.col("b.tier") + 1)
    return best.select(user, "b.code", reason.alias("reason"))
