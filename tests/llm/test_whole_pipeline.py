"""The quality classifier and the whole pipeline against plain versions of all their steps, and operators on empty tables."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("walkloom.llm")
import corpus_pipeline  # noqa: E402
from tests.llm.test_near_dedup import brute as near_brute  # noqa: E402
from walkloom.llm import line_dedup, packing, quality, token_store  # noqa: E402
from walkloom.llm.queries import tokenizer_file  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    size, n = max(len(raw), 1), max(len(words), 1)
    classes = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!\"'(),-./:;?[]{}", b"#$%&*+<=>@\\^_`~|", b"|", b"!", bytes(range(128, 256)), b" \t\x0b\x0c\r\n", b"\n", b".", b","]
    counts = [sum(c in own for c in raw) for own in classes]
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    share = [c / size for c in counts]
    ends = [sum(w[-1] in classes[k] for w in words) / n for k in (4, 6, 10)]
    low = [w.lower() for w in words]
    runs = [tuple(low[k : k + 3]) for k in range(max(1, len(low) - 2))] if low else []
    return [np.log1p(len(raw)), np.log1p(len(words)), mean, max(sum(x * x for x in lengths) / n - mean**2, 0) ** 0.5, *share, share[0] / max(share[0] + share[1], 1e-9), *ends, counts[9] / n, len(set(low)) / n, len(set(runs)) / max(len(runs), 1)]


def scores(rows, labels):
    """Plain ridge over all labelled rows at once, and a plain monotone fit."""
    x = {i: np.array(statistics(t)) for i, t in rows}
    train = sorted(i for i in labels if i in x and zlib.crc32(str(i).encode()) % 5)
    a, y = np.stack([x[i] for i in train]), np.array([labels[i] for i in train], float)
    rng = np.random.default_rng(20)
    w, b = rng.standard_normal((a.shape[1], 192)) / 4, rng.uniform(0, 2 * np.pi, 192)
    mean, scale = a.mean(0), np.sqrt(np.maximum((a**2).mean(0) - a.mean(0) ** 2, 1e-12)) + 1e-6

    def inputs(m):
        z = np.clip((m - mean) / scale, -8, 8)
        return np.hstack([np.sqrt(2 / 192) * np.cos(z @ w + b), z, np.ones((len(z), 1))])

    p = inputs(a)
    ridge = 1e-3 * len(a) * np.diag([1.0] * (p.shape[1] - 1) + [0.0]) + 1e-9 * np.eye(p.shape[1])
    coef = np.linalg.solve(p.T @ p + ridge, p.T @ y)
    bins = np.clip(((p @ coef + 1) / 3 * 1200).astype(int), 0, 1199)
    places, share, weight = [], [], []
    for k in sorted(set(bins)):
        own = bins == k
        places.append([(k + 0.5) / 1200 * 3 - 1] * own.sum())
        share.append(y[own].mean())
        weight.append(own.sum())
        while len(share) > 1 and share[-2] >= share[-1]:
            total = weight[-2] + weight[-1]
            share[-2:] = [(share[-2] * weight[-2] + share[-1] * weight[-1]) / total]
            weight[-2:], places[-2:] = [total], [places[-2] + places[-1]]
    knots = [np.mean(q) for q in places]
    return {i: float(np.clip(np.interp(inputs(v[None]) @ coef, knots, share)[0], 0, 1)) for i, v in x.items()}


def test_quality_equals_a_plain_fit(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()] + [(9000, None), (9001, ""), (9002, "é " * 30_000)]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, score int, stats string").repartition(6)
    known = spark.createDataFrame([*labels.items(), (77_777, 1), (9000, None)], "doc_id long, quality int")
    want, got = scores(rows, labels), {r["doc_id"]: r for r in quality.quality_scores(df, known).collect()}
    assert got.keys() == want.keys()
    for i, s in want.items():
        assert abs(got[i]["score"] - s) < 1e-6 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def lines_dropped(rows):
    hosts = {}
    for _, text, host in rows:
        hosts.setdefault(host or "", set()).add(text or "")
    strip, bad = (lambda x: x.strip(" \t\n\x0b\x0c\r")), {}
    for host, pages in hosts.items():
        count = {}
        for page in pages:
            for line in {strip(x) for x in page.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        bad[host] = {x for x, n in count.items() if n >= 3 and n > 0.1 * len(pages)}
    return [(i, "\n".join(x for x in t.split("\n") if strip(x) not in bad[h or ""]) if t else t, h) for i, t, h in rows]


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    item = [word() for _ in range(30)]
    rows, labels = [], {}
    for i in range(160):
        good = i % 3 > 0
        text = " ".join(word() for _ in range(rng.randint(30, 400))) + "." if good else " ".join(rng.choice(("BUY!!", "$$$", "###", "99%", "|||")) for _ in range(60))
        if i % 17 == 4:
            text = text + " " + " ".join(item) + " " + word()
        host = f"h{i % 4}"
        rows.append((i, f"{text}\nAll rights of {host} reserved\n{word()}" if i % 4 < 2 else text, "en", host, len(text)))
        labels[i] = int(good)
    for i, j in ((200, 1), (201, 1), (202, 7), (203, 202)):
        base = next(r[1] for r in rows if r[0] == j)
        rows.append((i, base + " " + word(), "de", f"copy{i}", 5))
    rows += [(300, None, None, None, None), (301, "", "en", "h0", 0), (302, "one two", "en", "h1", 7), (303, rows[2][1], "en", "h2", 1)]
    return rows, labels, item


def test_run_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels, item = made(4)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(8, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    score = scores([(r[0], r[1]) for r in rows], labels)
    kept = [(i, t, h) for i, t, _, h, _ in rows if score[i] >= 0.3]
    after_quality = len(kept)
    kept = lines_dropped(kept)
    groups = near_brute([(i, t) for i, t, _ in kept])
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    after_near = len(kept)
    kept = [r for r in kept if " ".join(item) not in (r[1] or "")]
    assert len(rows) > after_quality > after_near > len(kept) > 80
    plain, want, lengths = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), [], {}
    for i, t, _ in kept:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            lengths[len(part)] = lengths.get(len(part), 0) + 1
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own)[:-1], sorted(own)[1:], strict=True)) and min(own)[0] == 0 and sum(n for _, n in own) <= 4096
    assert len(places) <= sum(n for _, n in packing.best_fit(lengths, 4096))


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert line_dedup.drop_boilerplate(docs).count() == 0
    manifest = token_store.write_store(docs, f"file://{tmp_path}/store", tokenizer_file("byte_bpe_50k.json"), "byte", 2)
    assert token_store.read_store(manifest, f"file://{tmp_path}/store").count() == 0
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
