"""Ids by units equal those of the whole text by the tokenizer."""

import random

import pyarrow as pa
import pytest

from walkloom.llm import tokens
from walkloom.llm.tokens import encode

P = pytest.importorskip("public_tokenizers")
PARTS = [*"abzXYJıİſßÀÖéçñÿŸǰΣς09 _'’.,!-<>|\t\n\x85\xa0 ̌中Ж😀½²\xad", "'s", "n't", "<|endoftext|>", "<|startoftext|>", " ", " "]


@pytest.mark.parametrize(("kind", "name"), [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_same_ids_as_the_whole_text(kind, name):
    from tokenizers import Tokenizer

    rng, plain = random.Random(5), Tokenizer.from_file(P.path(name))
    texts = ["", "a" * 5000 + "1", "!" * 5000 + "x", *("".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(2000))]
    for some in (texts[:3], texts[3:], [None, "", *texts[5:9]], []):
        ids, at = encode(P.path(name), kind, pa.array(some, pa.string()))
        assert len(at) == len(some) + 1 and at[-1] == len(ids)
        for k, text in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_the_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST", 1 << 16)
    path = P.path("byte_bpe_50k.json")
    for k in range(30):
        tokens.encode(path, "byte", pa.array([" ".join(f"w{k}x{j}y" for j in range(200)) + " " + "q" * 100_000]))
        assert tokens._loaded[path].used() < (1 << 16) + 200_000


def test_a_task_holds_few_bytes_beside_a_large_batch():
    """Packing a batch of 12 MB of text takes a working set of slices, and the ids and cache do not depend on how hashes are blocked."""
    import tracemalloc

    from walkloom.llm import packing

    path, rng = P.path("word_bpe_49k.json"), random.Random(8)
    words = [f"{a}{b}{c}" for a in "ab cd ef gh".split() for b in "ij kl mn op".split() for c in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(600), pa.int64()), "text": [" ".join(rng.choices(words, k=3000)) for _ in range(600)]})
    task = packing._pieces(path, "word", 1, 4096)
    next(task(iter([batch.slice(0, 1)])))  # the tokenizer and the tables are loaded
    tracemalloc.start()
    try:
        n = sum(out.num_rows for out in task(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n >= 600 and peak < 100 << 20, peak


def test_hashes_of_spans_do_not_depend_on_blocks(monkeypatch):
    import numpy as np

    from walkloom.llm import textkit

    rng = random.Random(4)
    texts = pa.array(["", "x" * 900, *(" ".join("".join(rng.choices("abÉ", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(50)), "x" * 900, "y"])
    raw, at = textkit.text_bytes(texts)
    begin, end, _ = textkit.word_spans(raw, at)
    for lower in (True, False):
        monkeypatch.setattr(textkit, "_BLOCK", 1 << 18)
        whole = textkit.span_hashes(raw, begin, end, lower)
        for block in (1, 7, 64, 500):
            monkeypatch.setattr(textkit, "_BLOCK", block)
            assert np.array_equal(textkit.span_hashes(raw, begin, end, lower), whole)
    assert len(textkit.span_hashes(raw, begin[:0], end[:0])) == 0


def test_units_are_found_in_old_and_newest_index():
    import numpy as np

    known, rng = tokens._Cached(P.path("word_bpe_49k.json"), "word"), np.random.default_rng(6)
    hashes, sizes, seen = rng.permutation(5000).astype(np.uint64) * np.uint64(3), rng.integers(0, 4, 5000), 0
    split = set()
    while seen < 5000:
        k = min(5000, seen + int(rng.integers(1, 400)))
        known.add(hashes[seen:k], sizes[seen:k], np.arange(sizes[seen:k].sum(), dtype=np.uint32))
        seen = k
        split.add(len(known.newest) > 0)
        assert known.find(hashes).tolist() == [*range(k), *[-1] * (5000 - k)]
        assert len(known.index) + len(known.newest) == len(known.size) == len(known.place) == k
    assert split == {True, False}


@pytest.mark.parametrize("most", [1 << 25, 300])
def test_shards_of_any_size_read_alike(spark, tmp_path, most):
    """Null and repeated ids, empty and long texts, clashing columns, in one shard or many."""
    from tokenizers import Tokenizer

    from walkloom.llm import token_store

    path = P.path("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(2)
    rows = [(k if k % 9 else None, rng.choice((None, "", "word " * rng.randint(1, 300), f"text {k} é"))) for k in range(1, 90)] + [(40, "a b"), (40, "a b"), (40, "longer text"), (7, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, 5, "p") for i, t in rows], "doc_id long, text string, shard int, path string")
    root = f"file://{tmp_path}/store"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a shard is closed after a slice of a batch
    try:
        manifest = token_store.write_store(df, root, path, "byte", 2, most=most)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = token_store.read_store(manifest, root).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or ""), r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids)) and r["ids"] == b"".join(x.to_bytes(4, "little") for x in ids)
        start += len(ids)
    assert (manifest.count() > 10) == (most == 300)
