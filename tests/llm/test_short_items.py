"""Decontamination by benchmark items of every length."""

import pytest

from quillon.llm import decontaminate

SENTENCE = "why do the red foxes of the far north change their coats before the snow"
ITEMS = [(n, SENTENCE[:n].strip() + "q" * (n - len(SENTENCE[:n].strip()))) for n in (3, 9, 12, 17, 19, 20, 25, 39, 40)]
FILL = "some words that stand around it"


@pytest.mark.parametrize("n, item", ITEMS)
def test_items_of_any_length(n, item):
    assert len(item) == n
    texts = [f"{FILL} {item} {FILL}", item, f"({item.upper()})\n", f"x{item}y {FILL}", FILL, None, ""]
    index = decontaminate.LeakIndex([(7, item), (8, "quite another question of the same list, that nothing holds")], decontaminate.LeakSettings())
    found = [[x[0] for x in index.leaks(t)] for t in texts]
    assert found[:3] == [[7]] * 3 and found[4:] == [[], [], []]
    # within a word: no copy of an item that has no edits
    assert found[3] == ([] if n < 17 else [7])
    at = index.leaks(texts[0])[0]
    assert at[1] <= len(FILL) + 1 and at[2] >= len(FILL) + 1 + n


def test_short_items_in_one_pass(spark):
    docs = spark.createDataFrame([(n, f"{FILL} {item}. {FILL}") for n, item in ITEMS] + [(100, FILL)], "doc_id long, text string")
    bench = spark.createDataFrame([*ITEMS, (50, "日本語"), (51, " ")], "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[100] == [] and all(n in got[n] for n, _ in ITEMS)
    assert [r["doc_id"] for r in decontaminate.drop_leaked(docs, bench).collect()] == [100]
    index = decontaminate.LeakIndex([(50, "日本語")], decontaminate.LeakSettings())
    assert index.leaks("これは日本語です") == [(50, 3, 6)]
