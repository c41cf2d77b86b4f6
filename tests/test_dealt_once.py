"""Queries on many small graphs deal out the lines by graph once, and nothing that grows with edges, pairs of steps or vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.operators import features, graph, walks
from walkloom.plans import catalog

D = "/root/testdata/sf0.001"


def dealt(df):
    """Exchanges of the plan that ran, without those that stand for one that is there already."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange hash" in line and "Reused" not in line]


@pytest.mark.parametrize("name", ["laplacian_residuals", "edge_encoding"])
def test_lines_are_dealt_once(spark, name):
    assert len(dealt(catalog.QUERIES[name](spark, D))) == 1


def test_packed_graphs(spark):
    nodes = spark.createDataFrame([(1, 1, 5), (1, 0, None), (1, 2, 7), (2, 0, 8), (None, 0, 1)], "g long, v int, z int")
    edges = spark.createDataFrame([(1, 0, 2), (1, 0, 1), (1, 0, 2), (1, 9, 0), (3, 0, 1), (1, 2, 2)], "g long, u int, v int")
    got = {r["g"]: (r["n"], r["adj"], r["z"]) for r in graph.packed(nodes, edges).collect()}
    assert got == {1: (3, [[1, 2], [], [2]], [None, 5, 7]), 2: (1, [[]], [8])}


def test_residuals_are_those_of_the_pairs(spark):
    rng = np.random.default_rng(3)
    nodes, pairs = [], []
    for g, n in ((1, 1), (2, 3), (3, 9), (4, 9), (5, 30)):
        nodes += [(g, v, 0) for v in range(n)]
        pairs += [(g, int(u), int(v)) for u, v in rng.integers(0, max(1, n - 1), (2 * n, 2)) if u != v]  # the last node has no edge
    nodes, edges = spark.createDataFrame(nodes, "g long, v int, z int"), graph.undirected(spark.createDataFrame(pairs, "g long, u int, v int"))
    got = {(r["g"], r["k"]): r for r in graph.laplacian_residuals(nodes, edges, 4).collect()}
    both, found = {(r["g"], r["u"], r["v"]) for r in edges.collect()}, graph.laplacian_eigs(nodes, edges, 4).orderBy("g", "v").collect()
    for g in range(1, 6):
        x = np.array([r["raw"] for r in found if r["g"] == g])
        n = len(x)
        a = np.array([[float((g, u, v) in both) for v in range(n)] for u in range(n)])
        r = np.sqrt(np.maximum(a.sum(axis=1), 1))
        lx = (np.eye(n) - a / np.outer(r, r)) @ x
        values = next(row["values"] for row in found if row["g"] == g)
        for k in range(4):
            own = got[g, k]
            assert math.isclose(own["norm"], np.linalg.norm(x[:, k]), abs_tol=1e-12)
            assert math.isclose(own["residual"], abs(lx[:, k] - values[k] * x[:, k]).max(), abs_tol=1e-12)
            assert math.isclose(own["overlap"], max(abs(x[:, k] @ x[:, j]) for j in range(4) if j != k), abs_tol=1e-12)
    assert len(got) == 20


def test_residuals_show_a_wrong_pair(spark, monkeypatch):
    from walkloom.operators import spectra

    batch = graph.packed(spark.createDataFrame([(1, v, 0) for v in range(4)], "g long, v int, z int"), graph.undirected(spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "g long, u int, v int"))).select("g", "adj").toArrow().to_batches()
    right = np.linalg.eigh

    def wrong(x):
        values, vectors = right(x)
        vectors[:, :, 1] = vectors[:, :, 0] * 2
        return values, vectors

    monkeypatch.setattr(np.linalg, "eigh", wrong)
    (found,) = spectra._residuals(2)(iter(batch))
    norm, residual, overlap = (found.column(c).to_pylist() for c in ("norm", "residual", "overlap"))
    assert math.isclose(norm[1], 2) and residual[1] > 0.1 and math.isclose(overlap[0], 2) and math.isclose(overlap[1], 2)


def test_edge_bits_inside_the_row_are_those_of_the_join(spark):
    nodes = spark.createDataFrame([(g, v, 0) for g in (1, 2, 3) for v in range(3 * g - 2)], "g long, v int, z int")
    edges = spark.createDataFrame([(2, 0, 1), (2, 1, 2), (2, 2, 2), (3, 0, 1), (3, 1, 0), (3, 4, 1), (3, 1, 5), (3, 5, 3), (3, 3, 4)], "g long, u int, v int")  # some in one direction only
    found = walks.uniform(graph.packed(nodes, edges), 5, 7, keep=("adj",))
    for some in (found, found.withColumn("ids", F.slice("ids", 1, 2)), found.withColumn("ids", F.slice("ids", 1, F.col("walk")))):
        got, want = features.edge_encoding_packed(some, 4), features.edge_encoding(walks.steps(some), edges, 4)
        assert got.dtypes == want.dtypes
        assert sorted(got.collect()) == sorted(want.collect())
