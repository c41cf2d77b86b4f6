"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("walkloom.llm")
from walkloom.llm import queries, spelling  # noqa: E402


def vocabulary(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = vocabulary(rows)
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and is_near(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


def got(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def drawn(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé×") for _ in range(rng.randint(7, 9))) for _ in range(30)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = list(stems[min(int(rng.expovariate(0.25)), 29)])
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice(([], [rng.choice("abcÉ")], [w[k], rng.choice("abc")]))
            words.append("".join(w))
        rows.append((i % 250, " ".join(words).replace("a", rng.choice("aA"), 3)))
    return [*rows, *((1000 + i, "chainaaa " * (i < 4) + "chainaab " * 3 + "chainabb " * 40) for i in range(20))]


@pytest.mark.parametrize("most", [64 << 20, 1])
def test_equals_comparison_of_all_words(spark, monkeypatch, most):
    """most: bytes of filter a pass broadcasts, one pass or many."""
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", most)
    monkeypatch.setattr(spelling, "SEGMENT", 1024 if most > 1 else 64)
    monkeypatch.setattr(spelling, "HELD_WORDS", 200_000 if most > 1 else 50)
    rows = drawn(3)
    want = brute(rows)
    assert len(want) > 150 and any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want)
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want


def test_odd_rows(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (None, "letters letters"), (None, "letters"), (3, "Letters-LETTERS1Étoiles étoiles Étoiles étoiles"), (4, f"{long} {long} {long}c {long}c {long[1:]} {long[1:]}"), (4, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa"), (5, "letterz letterz short short")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    assert got(spelling.variants(df)) == brute(rows)
    assert spelling.variants(df.limit(0)).count() == 0


def test_query_over_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(queries.QUERIES["op12_spelling_variants"](spark, d)) == brute(rows)
