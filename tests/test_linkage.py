"""Links by whole texts against a brute-force version."""

import collections
import random
import re

from quillon.operators import linkage


def normal(text):
    return re.sub(r"\s+", " ", (text or "").lower()).strip()


def anchors(text):
    plain = re.sub(r"(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]", " ", (text or "").lower())
    return [t for t in re.findall(r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?", plain) if len(t) >= 3 or t.isdigit()]


def hits_of(source, targets):
    _, own, part, text = source
    yield "explicit", [t[0] for t in targets if own is not None and t[1] == own]
    near = [t for t in targets if t[2] == part]
    yield "content", [t[0] for t in near if normal(text) and normal(t[3]) == normal(text)]
    yield "prefix", [t[0] for t in near if len(normal(text)) >= 40 and normal(t[3]).startswith(normal(text))]
    q = anchors(text)
    if len(q) >= 6 and sum(map(len, q)) >= 32:
        both = [(t[0], anchors(t[3])) for t in near]
        yield "anchor", [i for i, c in both if (c[: len(q)] == q if len(c) >= len(q) else len(c) >= 6 and len(c) / len(q) >= 0.75 and q[: len(c)] == c)]


def brute(sources, targets):
    first = {s[0]: next(((name, ids) for name, ids in hits_of(s, targets) if ids), (None, [])) for s in sources}
    claims = collections.Counter(ids[0] for _, ids in first.values() if len(ids) == 1)
    outcome = lambda ids: "unmatched" if not ids else "ambiguous" if len(ids) > 1 else "collision" if claims[ids[0]] > 1 else "linked"
    return {s: (tier, ids[0] if outcome(ids) == "linked" else None, outcome(ids)) for s, (tier, ids) in first.items()}


def test_text_links(spark):
    rng = random.Random(4)
    opening = "licensed under the same terms as all the others of this shared bank: "
    words = "graph tree matrix vector prime number integer process thread memory cache page table".split()
    sources, targets = [], []
    for k in range(60):
        base = (opening if k % 2 else "") + " ".join(rng.choice(words) for _ in range(rng.randrange(4, 30))) + f" {k}"
        part, own = rng.choice(["p", "q"]), rng.choice([None, None, None, f"e{k}"])
        targets.append((1000 + k, own, part, base + rng.choice(["", " and so on", "?", " $x + 1$"])))
        short = " ".join(base.split()[: -rng.randrange(1, 4)])
        sources.append((k, rng.choice([None, own]), part, rng.choice([base, base.upper(), short, base + " tail", base.replace(" ", ", ", 3), base + " of an end that is longer by far " * 3])))
    sources += [(100, None, "p", None), (101, None, "p", ""), (102, None, None, "x"), (103, None, sources[1][2], sources[1][3])]
    targets += [(2000, None, "p", None), (2001, None, "p", "")]
    schema = "own string, part string, text string"
    got = linkage.text_linked(spark.createDataFrame(sources, "id long, " + schema), spark.createDataFrame(targets, "target_id long, " + schema), "id", "target_id", "text", "own", "part").collect()
    want = brute(sources, targets)
    assert {r["id"]: (r["tier"], r["target"], r["outcome"]) for r in got} == want
    assert {w[0] for w in want.values()} == {None, "explicit", "content", "prefix", "anchor"} and {w[2] for w in want.values()} >= {"linked", "unmatched", "collision"}


def test_a_shared_opening_is_no_link(spark):
    opening = "this passage is for the next questions of the paper: "
    targets = spark.createDataFrame([(1, opening + "how many pages does it need in all"), (2, opening + "which thread ends first")], "target_id long, text string")
    sources = spark.createDataFrame([(10, opening + "how many pages"), (11, opening + "what else is there")], "id long, text string")
    got = {r["id"]: (r["tier"], r["target"], r["outcome"]) for r in linkage.text_linked(sources, targets, "id", "target_id", "text").collect()}
    assert got == {10: ("prefix", 1, "linked"), 11: (None, None, "unmatched")}


def test_texts_that_only_begin_alike_dont_multiply(spark, capsys):
    """Sizes are looked up by half of a text at least: 200 texts of one beginning meet none of the others."""
    head = "the same forty characters begin this text and all others "
    rows = [(k, head + " ".join(f"word{k}" for _ in range(20 + k))) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    sources, targets = df.where("id % 2 = 1"), df.where("id % 2 = 0").withColumnRenamed("id", "target_id")
    extra = spark.createDataFrame([(1000, rows[1][1] + " more words here"), (1002, rows[3][1].rsplit(" ", 5)[0])], "target_id long, text string")
    found = linkage.text_linked(sources, targets.unionByName(extra), "id", "target_id", "text")
    found.explain()
    plan = capsys.readouterr().out
    assert "regexp_extract_all" not in plan and "shiftleft" in plan  # folded once, blocked by half of the shorter text
    got = {r["id"]: (r["tier"], r["target"], r["outcome"]) for r in found.collect()}
    assert got[1] == ("prefix", 1000, "linked") and got[3][2] == "linked" and got[3][0] == "anchor"
    assert sum(v[2] == "unmatched" for v in got.values()) == 98


def test_many_that_meet_give_the_same_links(spark):
    """Rows too many to broadcast are joined with texts by shuffles; cuts are the same."""
    rng = random.Random(6)
    base = [rng.choice(("graph", "tree", "matrix", "vector", "prime", "number")) for _ in range(60)]
    rows = [(k, " ".join(base[: rng.randrange(8, 60)]) + rng.choice(["", "", " tail", f" end {k}"])) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, text string")
    sources, targets = df.where("id % 2 = 1"), df.where("id % 2 = 0").withColumnRenamed("id", "target_id")
    few, many = ({r["id"]: (r["tier"], r["target"], r["outcome"]) for r in linkage.text_linked(sources, targets, "id", "target_id", "text", broadcast_rows=n).collect()} for n in (1_000_000, 0))
    plain = [(k, None, "", text) for k, text in rows]
    assert few == many == brute([r for r in plain if r[0] % 2], [r for r in plain if not r[0] % 2])
    assert {v[0] for v in few.values()} >= {"content", "prefix", "anchor"}


def test_texts_arent_shuffled(spark):
    """Long texts are looked up by hashes of their starts: what is shuffled is a small part of them."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(2000))) for k in range(60)]
    rows += [(100, rows[1][1] + " and more"), (102, rows[3][1].rsplit(" ", 50)[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    before = set(stages())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # less than the texts
    try:
        found = linkage.text_linked(df.where("id % 2 = 1"), df.where("id % 2 = 0").withColumnRenamed("id", "target_id"), "id", "target_id", "text").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r["id"]: (r["tier"], r["target"], r["outcome"]) for r in found if r["tier"]} == {1: ("prefix", 100, "linked"), 3: ("anchor", 102, "linked")}
    assert sum(n for k, n in stages().items() if k not in before) < sum(len(text) for _, text in rows) / 10
