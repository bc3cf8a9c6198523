"""Deterministic ordering, sampling and balanced selection of forms and practice batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.digests import hash_order
from quillon.sources.shared import tasks


def sample(items: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """The first n in hash order: the same for the same key, whatever the input's order."""
    return items.orderBy(hash_order(key, F.col(id_col)), id_col).limit(n)


def quota_form(items: DataFrame, forms: Column, strata: Column, quotas: dict[str, int], id_col: str) -> DataFrame:
    """For each form, quotas of the strata in hash order: (form, stratum, place, id).

    `forms`: an array of form keys; items are dealt anew, independently, for every form.
    """
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    # every task sorts its items once a form
    spread = items.repartition(tasks(items, 20_000), id_col)
    dealt = spread.select(F.explode(forms).alias("form"), strata.alias("stratum"), F.col(id_col).alias("id")).where(F.col("stratum").isin(list(quotas)))
    order = Window.partitionBy("form", "stratum").orderBy(hash_order(F.col("form"), F.col("id")), "id")
    ranked = dealt.withColumn("place", F.row_number().over(order).cast("long"))
    # the largest quota as a number: with it Spark cuts the ranking down before it shuffles
    return ranked.where(F.col("place") <= max(quotas.values())).where(F.col("place") <= quota[F.col("stratum")])


def shortfalls(picked: DataFrame, quotas: dict[str, int], forms: list[str]) -> DataFrame:
    """(form, stratum, wanted, found) where a form can't be filled: reasons to refuse it."""
    spark = picked.sparkSession
    wanted = spark.createDataFrame([(f, s, n) for f in forms for s, n in quotas.items()], "form string, stratum string, wanted long")
    found = picked.groupBy("form", "stratum").agg(F.count("*").alias("found"))
    return wanted.join(found, ["form", "stratum"], "left").na.fill(0, ["found"]).where("found < wanted")


def refusals(items: DataFrame, form_col: str, kind_col: str, kinds: tuple[str, ...], n: int) -> DataFrame:
    """(form, reason) of the forms that can't be made: too few items, or a required kind that is missing."""
    found = items.groupBy(form_col).agg(F.count("*").alias("_n"), F.collect_set(F.when(F.col(kind_col).isin(*kinds), F.col(kind_col))).alias("_kinds"))
    missing = F.array_sort(F.array_except(F.array(*(F.lit(k) for k in kinds)), "_kinds"))
    few = F.concat(F.lit(f"requires {n}; only "), F.col("_n").cast("string"), F.lit(" are available"))
    reason = F.when(F.col("_n") < n, few).when(F.size(missing) > 0, F.concat(F.lit("missing types: "), F.array_join(missing, ", ")))
    return found.select(form_col, reason.alias("reason")).where("reason IS NOT NULL")


def _unless_grouped(taken: Column):
    """A filter of candidates whose group no taken item has."""
    return lambda x: ~F.exists(taken, lambda c: c["group"] == x["group"])


def balanced_form(items: DataFrame, form_col: str, group_col: str, kind_col: str, id_col: str, kinds: tuple[str, ...], n: int) -> DataFrame:
    """Per form n items in a hash order of their own; forms of `refusals` have none.

    Chosen are one item of each kind, of a group that has none yet if there is one; then one of each group that has none;
    then the groups in turn.  Everything but the first step, which looks at one candidate of each kind and group, is
    ranks in windows: no group is visited item by item.
    """
    form, group, kind, own = (F.col(c) for c in (form_col, group_col, kind_col, id_col))
    order = lambda what, identity: hash_order(F.concat_ws(":", form, what if not isinstance(what, str) else F.lit(what)), identity)
    grouped = lambda what: F.concat_ws(":", F.lit(what), group.cast("string"))
    parts = tasks(items, 500_000)
    bad = refusals(items, form_col, kind_col, kinds, n).select(form_col)
    items = items.join(bad, form_col, "left_anti")

    best = items.where(kind.isin(*kinds)).groupBy(form_col, kind_col, group_col).agg(F.min(F.struct(order(F.concat(F.lit("required:"), kind), own).alias("h"), own.alias("id"))).alias("best"))
    pools = best.groupBy(form_col).agg(*(F.sort_array(F.collect_list(F.when(kind == k, F.struct("best.h", "best.id", group.alias("group"))))).alias(f"_{i}") for i, k in enumerate(kinds)))
    chosen: list[Column] = []
    for i in range(len(kinds)):  # a few kinds, in their order
        pool, taken = F.col(f"_{i}"), F.array(*chosen) if chosen else None
        fresh = pool if taken is None else F.filter(pool, _unless_grouped(taken))
        pools = pools.withColumn(f"_pick{i}", F.coalesce(F.get(fresh, F.lit(0)), F.get(pool, F.lit(0))))
        chosen.append(F.col(f"_pick{i}"))
    required = pools.select(form_col, F.posexplode(F.array(*chosen)).alias("_k", "_p")).select(form_col, F.col("_p.id").alias("_id"), F.col("_p.group").alias("_group"), F.col("_k").cast("long").alias("_k"))

    marked = items.join(required.select(F.col(form_col).alias("_form"), F.col("_id"), "_k"), (form == F.col("_form")) & (own == F.col("_id")), "left").drop("_form", "_id")
    has = required.select(form_col, F.col("_group").alias(group_col)).distinct().withColumn("_has", F.lit(True))
    # both ranks of a group are taken where its items lie
    marked = marked.join(has, [form_col, group_col], "left").repartition(parts, form_col, group_col)
    first = F.row_number().over(Window.partitionBy(form_col, group_col, F.col("_k").isNotNull()).orderBy(order(grouped("topic"), own), id_col)) == 1
    step = F.when(F.col("_k").isNotNull(), 0).when(F.col("_has").isNull() & first, 1).otherwise(2)
    stepped = marked.withColumn("_step", step)
    turn = F.row_number().over(Window.partitionBy(form_col, group_col, "_step").orderBy(order(grouped("group"), own), id_col))
    ranked = stepped.withColumn("_turn", F.when(F.col("_step") == 0, F.col("_k")).when(F.col("_step") == 1, F.lit(0).cast("long")).otherwise(turn.cast("long")))
    tie = F.when(F.col("_step") == 1, order("topics", group)).when(F.col("_step") == 2, order("groups", group)).otherwise(F.lit(""))
    kept = ranked.withColumn("_at", F.row_number().over(Window.partitionBy(form_col).orderBy("_step", "_turn", tie, id_col))).where(F.col("_at") <= n)
    final = Window.partitionBy(form_col).orderBy(order("final-order", own), id_col)
    return kept.withColumn("place", F.row_number().over(final).cast("long")).drop("_k", "_has", "_step", "_turn", "_at")


def practice_batch(items: DataFrame, solved: DataFrame, seed: str, size: int, group_cols: list[str], id_col: str, learner: str = "user_id") -> DataFrame:
    """Per learner and group the first batch (of `size`, in hash order) with an item not yet solved, else the first one.

    `solved`: (learner, item).  Only counts per learner, group and batch are compared, so no learner meets all items;
    learners without a solved item in a group have its first batch and aren't listed.
    """
    order = Window.partitionBy(*group_cols).orderBy(hash_order(seed, F.col(id_col)), id_col)
    batched = items.select(*group_cols, id_col).withColumn("place", F.row_number().over(order)).withColumn("batch", F.floor((F.col("place") - 1) / size))
    sizes = batched.groupBy(*group_cols, "batch").agg(F.count("*").alias("_size"))
    counts = solved.select(learner, id_col).distinct().join(batched, id_col).groupBy(learner, *group_cols, "batch").agg(F.count("*").alias("_solved"))
    # solved batches in order: the first number that isn't among the wholly solved ones
    whole = counts.join(sizes, [*group_cols, "batch"]).groupBy(learner, *group_cols).agg(F.array_sort(F.collect_set(F.when(F.col("_solved") == F.col("_size"), F.col("batch")))).alias("_whole"))
    last = sizes.groupBy(*group_cols).agg(F.max("batch").alias("_last"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("_last")), "_whole"))
    return whole.join(last, group_cols).select(learner, *group_cols, F.coalesce(gap, F.lit(0).cast("long")).alias("batch"))


def examples(items: DataFrame, group_cols: list[str], kind_col: str, id_col: str, n: int = 3) -> DataFrame:
    """Up to n examples per group: the first of each kind, then the next by id."""
    kind_first = F.row_number().over(Window.partitionBy(*group_cols, kind_col).orderBy(id_col)) > 1
    order = Window.partitionBy(*group_cols).orderBy("_later", F.when(F.col("_later"), F.lit("")).otherwise(F.col(kind_col)), id_col)
    ranked = items.withColumn("_later", kind_first).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("place") <= n).drop("_later")


def argmax(scored: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """The best label of each key; none if the best score is zero or tied."""
    order = Window.partitionBy(key).orderBy(F.desc(score), label)
    ranked = scored.withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.lead(score).over(order)).where("_rank = 1")
    clear = (F.col(score) > 0) & (F.col("_next").isNull() | (F.col("_next") < F.col(score)))
    return ranked.select(key, F.when(clear, F.col(label)).alias(label), F.col(score), F.coalesce(F.col(score) - F.col("_next"), F.col(score)).alias("margin"))


def rotated(options: Column, by: Column) -> Column:
    """The array turned left by so many places."""
    n = F.size(options)
    k = F.pmod(by, n)
    return F.when(n > 0, F.concat(F.slice(options, k + 1, n), F.slice(options, F.lit(1), k))).otherwise(options)


def day_number(at: Column, offset_minutes: int = 330) -> Column:
    """Days since the epoch in a zone with this offset."""
    return F.floor((F.unix_millis(at.cast("timestamp")) + offset_minutes * 60_000) / 86_400_000)


_WORD = (1 << 32) - 1


def _times(a: Column, b: Column) -> Column:
    """The product of two unsigned 32-bit numbers, modulo 2 ** 32, without leaving 64 bits."""
    high = F.shiftright(a, 16) * b
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.ascii(F.substring(text, k, F.lit(1))).cast("long"))
    # fixed values: offset basis and prime of the hash
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: _times(h.bitwiseXOR(c), F.lit(0x01000193).cast("long")))


def mulberry32(seed: Column, draw: Column) -> Column:
    """Number `draw` (from 1) of the mulberry32 generator, as an unsigned 32-bit number: its state only counts up."""
    # fixed values: the generator's increment and masks
    x = (seed + draw * F.lit(0x6D2B79F5).cast("long")).bitwiseAND(F.lit(_WORD))
    one = F.array(x)  # a lambda's variable stands for a value that is used several times
    y = F.transform(one, lambda v: _times(v.bitwiseXOR(F.shiftright(v, 15)), v.bitwiseOR(F.lit(1).cast("long"))))
    z = F.transform(y, lambda v: v.bitwiseXOR((v + _times(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(F.lit(_WORD))))
    return F.get(F.transform(z, lambda v: v.bitwiseXOR(F.shiftright(v, 14))), F.lit(0))


def shuffled(items: Column, seed: Column) -> Column:
    """Fisher-Yates over an array, from its end; the swaps' places are drawn from mulberry32."""
    n = F.size(items)
    last = F.sequence(n - 1, F.lit(1), F.lit(-1))
    # (place, place to swap with)
    swaps = F.transform(last, lambda i: F.struct(i.alias("i"), F.shiftright(mulberry32(seed, (n - i).cast("long")) * (i + 1), 32).cast("int").alias("j")))

    def swap(held: Column, s: Column) -> Column:
        return F.transform(held, lambda x, k: F.when(k == s["i"], F.get(held, s["j"])).when(k == s["j"], F.get(held, s["i"])).otherwise(x))

    return F.when(n > 1, F.aggregate(swaps, items, swap)).otherwise(items)


def daily_items(items: DataFrame, days: DataFrame, day: str, item: str, seed: str = "daily-focus:") -> DataFrame:
    """(day, item) of each day: every cycle of all items is a seeded permutation of its own, walked day by day.

    If a cycle would begin with the item that the one before ended with, its first two items change places; so two items
    keep the order of cycle 0.  Days before day 0 walk the items in order.  The items are few: they fit an array.
    No items, no rows.
    """
    ordered = items.agg(F.array_sort(F.collect_set(item)).alias("_items")).where(F.size("_items") > 0).withColumn("_one", F.lit(1))
    n = F.size("_items")
    asked = days.select(day).distinct().withColumn("_one", F.lit(1)).join(F.broadcast(ordered), "_one")
    asked = asked.select(day, "_items", F.floor(F.col(day) / n).alias("_cycle"), F.pmod(F.col(day), n).cast("int").alias("_place"))
    # a cycle's last item is not touched by its own seam, if there are more than two
    of = lambda cycle: shuffled(F.col("_items"), fnv1a(F.concat(F.lit(seed), cycle.cast("string"))))
    cycles = asked.select("_cycle", "_items").distinct().withColumns({"_own": of(F.when(n == 2, 0).otherwise(F.col("_cycle"))), "_before": of(F.col("_cycle") - 1)})
    meets = (n > 2) & (F.col("_cycle") > 0) & (F.get("_own", F.lit(0)) == F.element_at("_before", -1))
    seamed = F.when(meets, F.concat(F.array(F.get("_own", F.lit(1)), F.get("_own", F.lit(0))), F.slice("_own", F.lit(3), n))).otherwise(F.col("_own"))
    walked = cycles.select("_cycle", F.when(F.col("_cycle") < 0, F.col("_items")).otherwise(seamed).alias("_walk"))
    return asked.select(day, "_cycle", "_place").join(walked, "_cycle").select(day, F.get("_walk", "_place").alias(item))


def until_next_day(at: Column, offset_minutes: int = 330) -> Column:
    """Milliseconds until the next day begins in a zone with this offset."""
    return 86_400_000 - F.pmod(F.unix_millis(at.cast("timestamp")) + offset_minutes * 60_000, F.lit(86_400_000))


def session_items(items: DataFrame, seed: str, id_col: str, n: int) -> DataFrame:
    """The first n in hash order with their place; fewer than n are an error that names both numbers."""
    found = items.count()
    if found < n:
        raise ValueError(f"{n} questions are wanted, {found} are available")
    return sample(items, seed, id_col, n)
