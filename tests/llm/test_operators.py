"""Small cases of the corpus operators: nulls, empty and long texts, ties, empty tables, clashing columns."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("walkloom.llm")
from walkloom.llm import decontaminate, exact_dedup, html_text, line_dedup, lm, packing, pii, quality, token_store  # noqa: E402
from walkloom.llm.queries import tokenizer_file  # noqa: E402

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Hello, world. " * 3000), (5, "same"), (5, "same"), (6, "sa me")]


def test_exact_groups(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ODD], f"{DOC}, kept string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"]): r["kept"] for r in exact_dedup.exact_groups(df).collect()}
    assert got[(3, 3, 3)] and not got[(1, 3, 3)] and got[(6, 6, 3)] and not got[(5, 6, 3)] and got[(4, 4, 1)]
    same = spark.createDataFrame([(k, "copy of one text") for k in range(500)], DOC)
    rows = exact_dedup.exact_groups(same).collect()
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(0, 500)} and sum(r["kept"] for r in rows) == 1
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOC)).count() == 0


def test_exact_groups_over_many_batches(spark):
    """Runs of copies that begin, go on and end anywhere in batches of three rows, against plain grouping."""
    import random
    import re
    from hashlib import sha256

    rng = random.Random(8)
    texts = ["a", "b b", "c", *(f"own {k}" for k in range(40)), "", None]
    rows = [(i, rng.choice(texts[:3] if rng.random() < 0.6 else texts)) for i in range(400)] + [(i, "b b" + " " * (i % 5)) for i in range(400, 500)] + [(None, "a")]
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for key, own in groups.items():
        best = min(own)
        want += [(str(i), str(best[3]), len(own), (n, none, k) == best[:3], sha256(key.encode()).hexdigest()) for n, none, k, i in own]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = exact_dedup.exact_groups(spark.createDataFrame([(i, t, "x") for i, t in rows], f"{DOC}, key string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted(want)


def test_line_dedup(spark):
    rows = [(k, f"own {k}\n Share this \nmore {k}", "a") for k in range(20)] + [(99, None, None), (100, "Share this", "b")]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, f"{DOC}, source string")).collect()}
    assert got[3]["text"] == "own 3\nmore 3" and got[3]["n_dropped"] == 1
    assert got[99]["text"] is None and got[100]["text"] == "Share this"


def test_contaminated(spark):
    item = " ".join(f"item{k}" for k in range(30))
    changed = item.split()
    changed[7], changed[15], changed[22] = "x", "y", "z"
    rows = [(1, f"before {item} after"), (2, "before " + " ".join(changed) + " after"), (3, "clean words only here"), (4, None), (None, item)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame([(8, item), (9, None)], "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in got} == {1: [8], 2: [8]}


def test_token_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in ODD if i != 5] + [(None, "no id"), (7, "it's  John's “é,é”!! 12,34\n\nx")]
    root = f"file://{tmp_path}/store"
    found = token_store.read_store(token_store.write_store(spark.createDataFrame(rows, DOC), root, path, "byte", 2), root).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(found, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_elias_fano_select():
    values = np.cumsum(np.random.default_rng(1).integers(0, 900, 2000))
    ef = token_store.EliasFano.of(values)
    assert [ef.get(k) for k in range(0, 2000, 37)] == values[::37].tolist()
    for a, b in ((0, 2000), (0, 1), (255, 257), (256, 512), (700, 1999), (5, 5)):
        assert ef.some(a, b).tolist() == values[a:b].tolist()
    assert all(ef.below(x) == np.searchsorted(values, x, side="right") for x in (0, 5, 400_000, int(values[-1])))


def test_packing_equals_brute_force(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in ODD] + [(None, "no id", "y"), (8, "one two three " * 900, "z")]
    got = packing.pack(spark.createDataFrame(rows, f"{DOC}, piece string"), path, "word", 1, capacity=512).collect()
    want = []
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i or 0, k, at, zlib.crc32(np.array(ids[at : at + 512], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], zlib.crc32(r["ids"])) for r in got) == sorted(want)
    bins: dict = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 512
    sizes = [r["length"] for r in got]
    assert len(bins) == sum(n for _, n in packing.best_fit({x: sizes.count(x) for x in set(sizes)}, 512))
    assert packing.pack(spark.createDataFrame([], DOC), path, "word", 1).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_the_program_packs_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(np.exp(rng.normal(4.0 + seed / 3, 0.6 + seed / 5, 4000)).astype(int), 1, 512)
    lengths = {int(x): int(n) for x, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    ours, others = packing.programmed(lengths, 512)
    held: dict = {}
    for config, n in ours + others:
        assert n > 0 and sum(x * a for x, a in config.items()) <= 512
        for x, a in config.items():
            held[x] = held.get(x, 0) + a * n
    assert held == lengths
    used = sum(n for _, n in ours + others)
    assert -(-int(sizes.sum()) // 512) <= used <= sum(n for _, n in packing.best_fit(lengths, 512))


def base_spans(text):
    """The contract's patterns by re, leftmost and non-overlapping per kind."""

    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0

    out = []
    for rank, (kind, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    parts = [*"ab1. @-+()é😀", "a.b@c.de", "10.1.2.3", "4111 1111 1111 1111", "4111111111111111", "+1 (743) 555-3824", "x [at] y [dot] com", "743-555-3824", "1:2::3", "5500005555555559", "0"]
    bare = ["b." * 100_000, "a[at]" + "b." * 100_000 + "c", "1" * 100_000, "+1" * 50_000]  # long texts without spans, which re would take hours for
    texts = [None, "", *bare, "1.2.3.4 " * 20_000, "a@b.c " * 20_000, *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(600))]
    rows = [(k if k % 50 else None, t, "x") for k, t in enumerate(texts)] + [(7, texts[30], "y")]
    got = pii.personal_data(spark.createDataFrame(rows, f"{DOC}, spans string")).withColumn("joined", pii.joined("base_spans")).collect()
    want = sorted((d is not None, d or 0, [] if t in bare else base_spans(t)) for d, t, _ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, [(s["at"], s["rank"] - 1, s["end"], s["kind"]) for s in r["base_spans"]]) for r in got) == want
    for r in got:
        own = [(s["at"], s["end"]) for s in r["base_spans"]]
        assert r["joined"] == ",".join(f"{s['kind']}:{s['at']}:{s['end']}" for s in r["base_spans"])
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["spans"]}
        for s in r["spans"][:50]:
            assert (s["at"], s["end"]) in own or all(s["end"] <= a or b <= s["at"] for a, b in own)
    assert any(len(r["spans"]) > len(r["base_spans"]) for r in got)
    assert pii.personal_data(spark.createDataFrame([], DOC)).count() == 0


def test_personal_data_adds_no_decoys(spark):
    """Numbers that fail the check digit, long runs of digits and 00 runs without gaps are no spans; planted ones among them are found."""
    import random

    rng = random.Random(9)
    run = lambda n: str(rng.randrange(1, 10)) + "".join(rng.choices("0123456789", k=n - 1))

    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0

    decoys = [x for x in (run(rng.choice((15, 16))) for _ in range(400)) if not luhn(x)]
    decoys += [f"{a[:4]} {a[4:8]} {a[8:12]} {a[12:]}" for a in (run(16) for _ in range(200)) if not luhn(a)]
    decoys += ["00" + run(14) for _ in range(100)]
    rows = [(k, f"the figure {x} stands in plain prose", "x") for k, x in enumerate(decoys)]
    real = {5000: "call me at 743-555-3824 on the phone today", 5001: "visa card 4111.1111.1111.1111 credit", 5002: "write mail to jane [at] example [dot] com please"}
    rows += [(k, t, "x") for k, t in real.items()] * 3
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, f"{DOC}, m string")).collect()}
    more = {k for k, r in got.items() if len(r["spans"]) > len(r["base_spans"])}
    assert more <= set(real) and more


def test_quality(spark):
    rows = [(k, "plain words of a calm text. " * (k % 7 + 3) if k % 2 else "BUY!! NOW$$$ ###" * (k % 5 + 3)) for k in range(200)] + [(900, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(spark.createDataFrame(rows, DOC), labels).collect()}
    held = [r for k, r in got.items() if r["held_out"] and k < 200]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held) and 0 <= got[900]["score"] <= 1


def test_main_text(spark):
    page = "<html><body><nav>menu</nav><div class='ad'>buy</div><article><h1>T &amp; x</h1><p>One\n two<p>three <b>bold</b></article><div id=comments>c</div><footer>f</footer><script>var a='<p>';</script></body></html>"
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame([(1, "http://h/a", page), (2, None, None)], "page_id long, url string, html string")).collect()}
    assert got == {1: "T & x One two three bold", 2: ""}


def test_language_model(spark):
    rows = [(k, "the cat sat on the mat and the dog ran " * 5) for k in range(60)] + [(100, None), (101, "unseen")]
    got = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(rows, DOC)).collect()}
    assert got[100]["n_tokens"] == 1 and got[0]["n_tokens"] == 51 and got[0]["score"] < 0
    assert lm.lm_scores(spark.createDataFrame([], DOC)).count() == 0
