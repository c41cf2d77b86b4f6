"""Near-dedup against brute force: ties, nulls, short and empty texts, large groups of near copies, clashing columns."""

import random
import re

import pytest

pytest.importorskip("walkloom.llm")
from walkloom.llm import common, near_dedup  # noqa: E402


def brute(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = {i: (lambda w: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())(words(t)) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def hot_rows(n, seed):
    """A base text, copies with one to eight changed words, chains of drifting copies, and passages shared by texts of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    rows, drift = [], list(base)
    for i in range(n):
        kind = rng.random()
        text = list(base)
        if kind < 0.7:
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(120)] = word()
        elif kind < 0.85:
            drift = list(drift)
            for _ in range(2):
                drift[rng.randrange(120)] = word()
            text = drift
        else:
            text = base[:60] + [word() for _ in range(60)]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("least", [256, 4])
def test_large_group_of_near_copies(spark, monkeypatch, least):
    """least: rows from which a key counts as hot, so that both ways of joining are taken."""
    monkeypatch.setattr(common, "HOT_ROWS", least)
    monkeypatch.setattr(common, "FEW_ROWS", 200_000 if least > 4 else 0)
    rows = [*hot_rows(150, 1), *((1000 + k, "one text with many copies of its own") for k in range(30)), *((2000 + k, "") for k in range(30))]
    rng = random.Random(2)
    rng.shuffle(rows)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"w{k % 977}x{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A\tB"), (6, "b a"), (7, long), (8, long + " end"), (9, "one two three four five"), (9, "one two three four five")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_shingles int, v int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(df).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 6, True)
    assert got[7][1] == 7 and got[8][1] == 7 and got[9] == (1, 9, True)
    assert near_dedup.near_groups(df).count() == len(rows)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, "x y z")]
    got = sorted(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("5", "5", True), ("None", "5", False), ("None", "None", True)]
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
