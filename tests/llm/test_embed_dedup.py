"""Links and components of vectors against a full comparison."""

import math

import numpy as np
import pytest

pytest.importorskip("walkloom.llm")
from walkloom.llm import embed_dedup, queries, small_world  # noqa: E402


def brute(rows, least=0.9):
    """(vec_id, n_links, component_id) of each row; rows that repeat an id are told apart by place."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], float) / max(abs(x) for x in rows[k][1]) for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    near = {k: [j for j in ok if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= least] for k in ok}
    low, out = {k: rows[k][0] for k in ok}, []
    while True:
        new = {k: min([low[k], *(low[j] for j in near[k])]) for k in ok}
        if new == low:
            break
        low = new
    for k, (i, _) in enumerate(rows):
        out.append((str(i), len(near.get(k, [])), str(low.get(k, i))))
    return sorted(out)


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None) for r in rows)
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rows)


def groups(seed, dim=16):
    """Single vectors, tight groups, loose chains whose ends don't link, and copies."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(500)]
    for size, noise in ((60, 0.02), (40, 0.07), (25, 0.085), (12, 0.1)):
        c = rng.normal(size=dim)
        out += [c + noise * np.linalg.norm(c) * rng.normal(size=dim) for _ in range(size)]
    v = rng.normal(size=dim)
    for _ in range(60):
        v = v + 0.08 * np.linalg.norm(v) * rng.normal(size=dim)
        out.append(v)
    out += [out[3]] * 40 + [2 * out[4]] * 3
    return [(int(i), [float(x) for x in out[k]]) for k, i in enumerate(rng.permutation(len(out)))]


@pytest.mark.parametrize(("size", "beams"), [(64 << 20, (16, 64)), (20_000, (16, 64)), (20_000, (1,))])
def test_equals_full_comparison(spark, size, beams):
    """size: bytes of a shard, one or many; a beam of one falls short of the audit, so shards are compared in full."""
    rows = groups(5)
    want = brute(rows)
    assert any(n > 30 for _, n, _ in want) and any(0 < n < 30 for _, n, _ in want)
    assert got(embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), shard_bytes=size, beams=beams)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e300, 0.0]), (9, [1e-300, -0.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (0, [3.0, 0.1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, key string")
    assert got(embed_dedup.near_vectors(df)) == brute(rows)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0 and got(embed_dedup.near_vectors(df.limit(1))) == [("1", 0, "1")]


def test_small_world_finds_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    x[1000:1400] = x[0] + 0.05 * x[1000:1400]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[rng.permutation(len(x))]
    graph = small_world.built(x)
    assert len(graph.links) == 1 and graph.top == 375
    ids, sims = small_world.search(graph, x, 32)
    assert (ids == np.arange(len(x))[:, None]).any(axis=1).mean() > 0.97 and np.allclose(sims[5], x[ids[5]] @ x[5], atol=1e-5)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_over_the_given_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert got(queries.QUERIES["op11_embedding_near_dedup"](spark, f"/root/testdata/{sf}")) == brute_fast(rows)


def brute_fast(rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    assert not (near & ~np.eye(len(x), dtype=bool)).any()  # the small tables have no near pairs, which the query must say too
    return sorted((str(i), 0, str(i)) for i, _ in rows)
