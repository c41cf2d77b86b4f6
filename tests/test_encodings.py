"""Blocks of pairs equal the joined form, long walks fit, widths are asserted, stacked spectra equal plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.operators import encodings, features, graph, lockstep, spectra

XYZ = "struct<x:double,y:double,z:double>"


def test_pair_blocks_equal_the_joined_form(spark):
    rng = random.Random(3)
    walks = [(g, 0, [(rng.gauss(0, 2), rng.gauss(0, 2), rng.gauss(0, 2)) for _ in range(n)]) for g, n in ((1, 1), (2, 2), (3, 7), (4, 136))]
    walks.append((5, 0, [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)]))
    df = spark.createDataFrame(walks, f"g long, walk int, xyz array<{XYZ}>")
    blocks = {r["g"]: np.array(r["block"]).reshape(r["length"], r["length"], 40) for r in encodings.pair_blocks(df).collect()}
    steps = df.select("g", "walk", F.posexplode("xyz").alias("pos", "xyz"))
    for r in features.pair_basis(features.pair_geometry(steps)).collect():
        assert np.allclose(blocks[r["g"]][r["i"], r["j"]], r["x"], atol=1e-6)
    assert {g: b.shape for g, b in blocks.items()} == {g: (len(p), len(p), 40) for g, _, p in walks}
    assert encodings.pair_blocks(df.limit(0)).count() == 0


def chain(spark, n):
    nodes = spark.createDataFrame([(1, v, (float(v), 0.0, float(v % 2))) for v in range(n)], f"g long, v int, pos {XYZ}")
    edges = graph.undirected(spark.createDataFrame([(1, v, v + 1) for v in range(n - 1)], "g long, u int, v int"))
    return nodes, edges, graph.packed(nodes.withColumn("z", F.lit(0)), edges)


def test_widths(spark):
    nodes, edges, graphs = chain(spark, 5)
    bonds = edges.withColumn("attr", F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)))
    full = encodings.with_geometry(graphs, nodes, bonds)
    found = lockstep.step_walks(graphs, 2, 6)
    for kind, flags, width in (("walk", {}, 16), ("walk", {"distances": True}, 32), ("walk", {"bonds": True}, 19), ("walk", {"distances": True, "bonds": True}, 35), ("dfs", {"distances": True, "bonds": True, "angles": True, "dihedrals": True}, 43), ("bfs", {"distances": True, "angles": True}, 24), ("rum", {}, 0)):
        for row in encodings.step_encoding(kind, found, full, 8, **flags).collect():
            assert all(len(x) == width for x in row["pe"]) and len(row["pe"]) == 6
    short = encodings.with_geometry(graphs, nodes, edges.withColumn("attr", F.array(F.lit(1.0))))
    with pytest.raises(Exception, match="not 19 wide"):
        encodings.step_encoding("walk", found, short, 8, bonds=True).collect()
    with pytest.raises(ValueError):
        encodings.step_encoding("walk_x", found, full, 8)


def test_an_isolated_walk_has_no_bond(spark):
    nodes, _, _ = chain(spark, 1)
    graphs = graph.packed(nodes.withColumn("z", F.lit(0)), spark.createDataFrame([], "g long, u int, v int"))
    full = encodings.with_geometry(graphs, nodes, spark.createDataFrame([], "g long, u int, v int, attr array<double>"))
    (row,) = encodings.step_encoding("walk", lockstep.step_walks(graphs, 1, 3), full, 1, bonds=True).collect()
    assert row["pe"] == [[0, 0, 0, 0, 0], [1, 0, 0, 0, 0], [1, 0, 0, 0, 0]]


def test_stacked_powers_equal_joins(spark):
    rng = random.Random(2)
    nodes, pairs = [], []
    for g in range(12):
        n = 1 + g % 5
        nodes += [(g, v, 0) for v in range(n)]
        pairs += [(g, rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
    nodes, edges = spark.createDataFrame(nodes, "g long, v int, z int"), graph.undirected(spark.createDataFrame(pairs, "g long, u int, v int"))
    joined = {(r["g"], r["v"], r["step"]): r["p"] for r in graph.rwse(nodes, edges, 4, joins=True).collect()}
    stacked = {(r["g"], r["v"], k + 1): p for r in spectra.rwse(graph.packed(nodes, edges), 4).collect() for k, p in enumerate(r["p"])}
    assert joined.keys() == stacked.keys() and all(abs(joined[k] - stacked[k]) < 1e-12 for k in joined)
