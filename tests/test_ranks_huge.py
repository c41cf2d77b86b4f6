"""Ranks and sums over skewed keys, and walks on a graph with hubs, against plain versions."""

import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from walkloom.operators import huge, ranks


def test_running_over_skewed_keys_and_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "b", None)), 7.5 if rng.random() < 0.5 else rng.choice((-3.0, float("inf"), 100.0, None)), k % 10) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, n int").repartition(5)
    got = ranks.running(df, [F.col("x")], group=["g"]).collect()
    assert Counter((r["g"], r["x"], r["n"]) for r in got) == Counter(rows)
    for g in ("a", "b", None):
        own = sorted((r["ahead"], r["x"] is not None, r["x"] or 0) for r in got if r["g"] == g)
        assert [a for a, *_ in own] == list(range(len(own))) and [o[1:] for o in own] == sorted(o[1:] for o in own)
        assert {r["total"] for r in got if r["g"] == g} == {len(own)}
    got = sorted((r["ahead"], r["x"], r["n"]) for r in ranks.running(df.na.drop(), [F.col("x"), F.col("n").desc()], "n").collect())
    total, seen = 0, []
    for ahead, x, n in sorted(got, key=lambda r: (r[1], -r[2], r[0])):
        assert ahead == total
        total += n
    assert ranks.running(df.limit(0), [F.col("x")]).count() == 0


def u32(*parts):
    return int(md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("weighted", [False, True])
def test_walks_with_hubs(spark, weighted, monkeypatch):
    monkeypatch.setattr(huge, "FAN", 4)
    rng = random.Random(4)
    pairs = {(0, v) for v in range(1, 150)} | {(1, v) for v in range(2, 80)} | {(rng.randrange(200), rng.randrange(200)) for _ in range(150)}
    pairs = {p for u, v in pairs if u != v for p in ((u, v), (v, u))}
    near = defaultdict(list)
    for u, v in sorted(pairs):
        near[u].append(v)
    edges = spark.createDataFrame(sorted(pairs), "u long, v long").repartition(3)
    starts = spark.createDataFrame([(w, w % 210) for w in range(400)], "walk long, node long")
    got = defaultdict(dict)
    for r in huge.huge_walks(edges, starts, 7, 3, weighted, every=3).collect():
        got[r["walk"]][r["pos"]] = r["node"]
    for w in range(400):
        node = w % 210
        for j in range(7):
            assert got[w][j] == node
            if near[node]:
                if weighted:
                    left = u32(3, w, j + 1) / 2**32 * sum(1 / min(len(near[node]), len(near[v])) for v in near[node])
                    for v in near[node]:
                        left -= 1 / min(len(near[node]), len(near[v]))
                        if left < 0:
                            break
                    node = v
                else:
                    node = near[node][u32(3, w, j + 1) % len(near[node])]
        assert len(got[w]) == 7


def test_trees_do_not_pass_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(huge, "FAN", 4)
    pairs = [p for v in range(1, 60) for p in ((0, v), (v, 0))]
    levels = huge.neighbour_trees(spark.createDataFrame(pairs, "u long, v long"))
    at = spark.createDataFrame([(w, 0, 3, [0]) for w in range(50)], "walk long, node long, height int, path array<long>")
    after = huge._descended(at, levels, lambda total: total * 0.5)
    assert len(levels) > 2 and "Broadcast" not in after._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r["path"]) for r in after.collect()} == {(0, 30)}
    assert "Broadcast" not in after._jdf.queryExecution().executedPlan().toString()


def test_auc_of_any_scores(spark):
    from walkloom.operators import metrics

    rng = random.Random(2)
    rows = [(rng.choice((-5.0, 0.25, 3.5, 1e9, rng.gauss(0, 4))), rng.randrange(2)) for _ in range(400)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = metrics.roc_auc(spark.createDataFrame(rows, "score double, label int")).first()
    assert abs(got["auc"] - want) < 1e-12 and (got["n_pos"], got["n_neg"]) == (len(pos), len(neg))


def test_group_split_of_many_groups(spark):
    from walkloom.operators import splits

    df = spark.range(300_000).select((F.col("id") * F.col("id") % 100_003).alias("grp"))
    got = splits.group_split(df, 1).select("grp", "size", "fold").toPandas()
    got["k"] = [md5(f"0|0|{g}".encode()).hexdigest() for g in got["grp"]]
    got = got.sort_values(["k", "grp"])
    ahead, tested, want = 0, 0, []
    for size in got["size"]:
        want.append("test" if ahead < 0.2 * 300_000 else "")
        tested += size if want[-1] else 0
        ahead += size
    ahead = 0
    for i, size in enumerate(got["size"]):
        want[i] = want[i] or ("valid" if ahead - tested < 0.2 * 300_000 else "train")
        ahead += size
    assert want == got["fold"].tolist() and len(want) > 40_000


def test_fingerprint_of_any_order(spark):
    from hashlib import sha256

    from walkloom.operators import splits

    ids = [5, 3, 2**40, 7, 7]
    one, two = (splits.fingerprint(spark.createDataFrame([("a", i) for i in x], "fold string, id long").repartition(3), ["fold"]).first() for x in (ids, ids[::-1]))
    assert one == two and one["digest"] == sha256(b"".join(i.to_bytes(8, "little") for i in sorted(ids))).hexdigest()
    hashes = [int(md5(str(i).encode()).hexdigest()[:16], 16) for i in ids]
    mixed = 0
    for h in hashes:
        mixed ^= h
    assert one["total"] == str(sum(hashes) % 2**64) and one["mixed"] == f"{mixed:016x}"
    large = splits.fingerprint(spark.createDataFrame([("a", i) for i in ids], "fold string, id long"), ["fold"], most=4).first()
    assert large["digest"] is None and large["mixed"] == one["mixed"]


def test_early_stop_of_runs_of_any_length(spark, monkeypatch):
    from walkloom.operators import experiments

    monkeypatch.setattr(experiments, "BLOCK", 8)
    rng = random.Random(6)
    rows, want = [], {}
    for run in range(60):
        n, level = rng.choice((1, 3, 12, 40, 150)), 1.0
        values = []
        for _ in range(n):
            level *= rng.choice((1.0, 0.97, 0.999))
            values.append(rng.choice((level, level + rng.random() * 0.2, None if rng.random() < 0.1 else level)))
        best, at, bad, last = float("inf"), -1, 0, -1
        for e, v in enumerate(values):
            if bad >= 4:
                break
            last = e
            if v is not None and v < best - 0.01:
                best, at, bad = v, e, 0
            else:
                bad += 1
        rows += [(run, 2 * e, v) for e, v in enumerate(values)]
        want[run] = (best, 2 * at if at >= 0 else -1, 2 * last)
    got = experiments.early_stop(spark.createDataFrame(rows, "run long, epoch int, valid double").repartition(3), 0.01, 4).collect()
    assert {r["run"]: (r["best"], r["best_epoch"], r["last_epoch"]) for r in got} == want
