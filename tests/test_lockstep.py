"""Batched walks and searches equal the folds, on both sides of the border, and large graphs end soon."""

import random
import time

import pytest
from pyspark.sql import functions as F

from walkloom.operators import graph, lockstep, walks


@pytest.fixture(scope="module")
def packed(spark):
    """Graphs of 1 to 60 nodes with self-loops, isolated nodes and several components, once written out."""
    rng = random.Random(3)
    nodes, pairs = [], []
    for g in range(40):
        n = 1 + g * 3 // 2
        nodes += [(g, v, rng.randrange(3)) for v in range(n)]
        pairs += [(g, rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice((0, 0.5, 1, 2))))]
    edges = graph.undirected(spark.createDataFrame(pairs, "g long, u int, v int"))
    return graph.packed(spark.createDataFrame(nodes, "g long, v int, z int"), edges).cache()


def found(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("length", [1, 2, 9, None])
def test_walks_equal_the_folds(packed, length):
    size = F.col("n") if length is None else length
    assert found(lockstep.step_walks(packed.repartition(3), 3, size, 5)) == found(walks.uniform(packed, 3, size, 5))
    assert found(lockstep.step_walks(packed, 3, size, 5, weighted=True)) == found(walks.mdlr(packed, 3, size, 5))
    assert found(lockstep.step_walks(packed, 3, size, 5, drop_self_loops=True)) == found(walks.uniform(packed, 3, size, 5, drop_self_loops=True))
    assert found(lockstep.step_walks(packed, 3, size, 5, strict=True, drop_self_loops=True)) == found(walks.uniform(packed, 3, size, 5, strict=True, drop_self_loops=True))


@pytest.mark.parametrize("depth_first", [True, False])
def test_searches_equal_the_folds(packed, depth_first):
    want = found(walks.search(packed, 2, None, 7, depth_first))
    assert found(lockstep.traverse(packed, 2, None, 7, depth_first)) == want
    assert found(lockstep.search(packed, 2, None, 7, depth_first, border=20)) == want
    assert found(lockstep.search(packed, 2, 4, 7, depth_first, border=20)) == found(walks.search(packed, 2, 4, 7, depth_first))
    ranked = packed.join(graph.wl_ranks_packed(packed), "g")
    assert found(lockstep.search(ranked, 1, depth_first=depth_first, rank="rank", border=20)) == found(walks.search(ranked, 1, depth_first=depth_first, rank="rank"))


def test_a_graph_of_five_thousand_nodes(spark):
    n, rng = 5000, random.Random(1)
    pairs = [(1, v, v + 1) for v in range(n - 1)] + [(1, 0, v) for v in range(2, n, 3)] + [(1, rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    nodes = spark.createDataFrame([(1, v, 0) for v in range(n)], "g long, v int, z int")
    large = graph.packed(nodes, graph.undirected(spark.createDataFrame(pairs, "g long, u int, v int"))).cache()
    large.count()
    began = time.time()
    for row in lockstep.search(large, 2).collect():
        assert sorted(row["ids"]) == list(range(n)) and row["parents"].count(-1) == 1
    for row in lockstep.step_walks(large, 4, F.col("n"), weighted=True).collect():
        assert len(row["ids"]) == n
    assert time.time() - began < 30


def test_no_graphs(packed):
    assert lockstep.step_walks(packed.limit(0), 2, 4).count() == 0 and lockstep.search(packed.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        lockstep.step_walks(packed, 2, 4, weighted=True, strict=True)
