"""The language model beats the base on held-out texts however the input is cut, and its counts equal plain ones."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("walkloom.llm")
from walkloom.llm import lm  # noqa: E402

END = object()


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_given_texts(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    c = Counter(w for i, own in rows.items() if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    got = lm.lm_scores(docs.repartition(parts)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = rows[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_probabilities_sum_to_one():
    """Over all leaves behind any context, before and after training, and over the words of a leaf."""
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(-(2**62), 2**62, 3000))
    counts = np.sort(rng.integers(1, 500, 3000))[::-1].astype(np.int64)
    forms = lm._forms(words).astype(np.int64)
    form_tokens, form_words = np.bincount(forms, counts, lm.FORMS), np.bincount(forms, minlength=lm.FORMS).astype(float)
    top = np.argsort(-counts, kind="stable")[: lm.KNOWN * lm.groups(3000) ** 2]
    model = lm.Model(words[top], counts[top], 3000, form_tokens, form_words)

    def total(context):
        rows = np.repeat(context, model.leaves)
        own = np.stack((rows, rows), axis=1).ravel()
        leaf = np.stack((np.zeros(model.leaves, np.int64), np.arange(model.leaves)), axis=1).ravel()
        return np.exp(model.logs(own, np.full(model.leaves, 2), leaf)[1::2]).sum()

    assert total(0) == pytest.approx(1, abs=1e-4) and total(5) == pytest.approx(1, abs=1e-4)
    rows, leaf = model.ids(words[rng.integers(0, 3000, 20_000)])
    model.train(rows, np.full(200, 100), leaf, 2048, rng)
    assert total(0) == pytest.approx(1, abs=1e-4) and total(7) == pytest.approx(1, abs=1e-4)
    rest = np.setdiff1d(np.arange(3000), top[: model.singles])
    for ending in range(model.endings):
        own = rest[forms[rest] % model.endings == ending]
        assert ((counts[own] + 1) / model.within[ending]).sum() + 1 / model.within[ending] == pytest.approx(1)


def test_a_corpus_of_several_lots(spark, monkeypatch):
    """One pass in tasks of a lot each, averaged, beats the base on held-out texts too."""
    monkeypatch.setattr(lm, "LOT", 60_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = lm.lm_scores(docs.repartition(40)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n", "max(train_tokens) t").first()
    assert out["t"] > 3 * 60_000 and out["s"] / out["n"] > out["b"] / out["n"] + 0.08
