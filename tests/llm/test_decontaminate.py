"""Leaks whose equal tokens lie apart or outside the seeds, against a brute-force version."""

import random

import pytest

pytest.importorskip("walkloom.llm")
from walkloom.llm import decontaminate  # noqa: E402

DOC = "doc_id long, text string"
ITEM = [f"item{k}" for k in range(55)]


def found(spark, texts, item):
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOC)
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(8, " ".join(item))], "item_id long, text string")).collect()
    return {r["doc_id"]: r["matched_tokens"] for r in rows}


def test_fragments_of_one_diagonal(spark):
    apart = [*ITEM[:20], *[f"own{k}" for k in range(15)], *ITEM[35:]]
    chance = [*ITEM[:20], *[f"own{k}" for k in range(25)], *ITEM[45:52], "own", "own", "own"]
    assert found(spark, [apart, ITEM[:20], chance, ITEM[:9]], ITEM) == {0: 20, 1: 20, 2: 20}


def brute(text, item):
    """Most equal tokens of a run of 13 or more with a share of 75 %, where a seed hits; texts keep the item's places."""
    same = [a == b for a, b in zip(text, item, strict=True)]
    if not any(all(p + k < len(same) and same[p + k] for k in mask) for mask in decontaminate.MASKS for p in range(len(same))):
        return 0
    runs = [sum(same[a:b]) for a in range(len(same)) for b in range(a + 13, len(same) + 1) if 4 * sum(same[a:b]) >= 3 * (b - a)]
    return max(runs, default=0)


def test_any_run_counts(spark):
    rng, item = random.Random(5), ITEM[:24]
    texts = [[w if rng.random() > rng.choice((0.2, 0.3, 0.45)) else f"own{k}" for k, w in enumerate(item)] for _ in range(300)]
    want = {k: n for k, t in enumerate(texts) if (n := brute(t, item))}
    assert 50 < len(want) < 290 and found(spark, texts, item) == want


def test_rows_that_repeat_an_id_are_judged_apart(spark):
    """Nine of an item's thirty tokens each: clean under any ids; one whole item among them is found."""
    item, other = ITEM[:30], [f"own{k}" for k in range(30)]
    rows = [(1, " ".join([*other[:k], *item[k : k + 9], *other[k + 9 :]])) for k in (0, 9, 18)]
    items = spark.createDataFrame([(8, " ".join(item))], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(rows, DOC), items).count() == 0
    rows += [(1, " ".join(item)), (1, "short"), (1, " ".join(item)), (2, "w " * 300 + " ".join(item[:20]))]
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOC), items).collect()
    assert sorted((r["doc_id"], r["n_items"], r["item_ids"], r["matched_tokens"]) for r in got) == [(1, 1, [8], 30), (2, 1, [8], 20)]


def test_a_long_item_is_compared_in_linear_time(spark):
    long = [f"t{k}" for k in range(20_000)]
    text = [w if k % 10 else "own" for k, w in enumerate(long)]
    assert found(spark, [text, long[:40]], long) == {0: 18_000, 1: 40}


def test_short_items_and_odd_rows(spark, monkeypatch):
    items = [(1, "alpha beta gamma"), (2, "one two three four five six seven"), (3, None), (4, ""), (None, "x y z"), (5, " ".join(ITEM))]
    docs = [(1, "so Alpha  beta\tGamma it is", "a"), (2, "alpha gamma beta", "b"), (3, "zero one two three four five six seven eight", "c"), (4, "one two three FOUR five six eight", "d"), (None, " ".join(ITEM), "e"), (6, None, "f"), (7, "", "g"), (8, "w " * 100_000 + " ".join(ITEM) + " v" * 100_000, "h"), (8, "alpha beta gamma", "i")]
    left = spark.createDataFrame(docs, f"{DOC}, item_id string")
    right = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
        got = {r["doc_id"]: (r["item_ids"], r["matched_tokens"]) for r in decontaminate.contaminated(left, right).collect()}
        assert got == {1: ([1], 3), 3: ([2], 7), 8: ([1, 5], 55)}
    assert decontaminate.contaminated(left.limit(0), right).count() == 0 and decontaminate.contaminated(left, right.limit(0)).count() == 0
