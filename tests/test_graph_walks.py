"""Closed-form cases, invariances and statistics of the graph, walk and feature operators."""

import math
import random

from pyspark.sql import functions as F

from walkloom.functions import geometry
from walkloom.operators import features, graph, walks


def tables(spark, n, pairs, z=None):
    nodes = spark.createDataFrame([(1, v, (z or [0] * n)[v]) for v in range(n)], "g long, v int, z int")
    edges = graph.undirected(spark.createDataFrame([(1, u, v) for u, v in pairs], "g long, u int, v int"))
    return nodes, edges


def canonical(spark, n, pairs, z):
    nodes, edges = tables(spark, n, pairs, z)
    ranks = graph.wl_ranks(nodes, edges, F.col("z")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("r")).select("g", F.transform("r", lambda x: x["c"]).alias("rank"))
    return walks.search(graph.packed(nodes, edges).join(ranks, "g"), 1, rank="rank").first()["ids"]


def test_star_is_visited_in_canonical_order(spark):
    assert canonical(spark, 4, [(0, 1), (0, 2), (0, 3)], [6, 1, 1, 1]) == [1, 0, 2, 3]


def test_canonical_search_does_not_depend_on_names(spark):
    pairs, z, new = [(0, 1), (1, 2), (2, 3), (1, 4), (2, 5)], [6, 7, 8, 9, 1, 16], [3, 0, 5, 1, 4, 2]
    there = [0] * 6
    for v, w in enumerate(new):
        there[w] = z[v]
    a = [z[v] for v in canonical(spark, 6, pairs, z)]
    b = [there[v] for v in canonical(spark, 6, [(new[u], new[v]) for u, v in pairs], there)]
    assert a == b


def test_search_tree_of_a_path_has_all_edges(spark):
    found = walks.search(graph.packed(*tables(spark, 5, [(k, k + 1) for k in range(4)])), 3).collect()
    for row in found:
        assert sorted(row["ids"]) == [0, 1, 2, 3, 4]
        assert all(abs(p - v) == 1 for p, v in zip(row["parents"][1:], row["ids"][1:], strict=True))


def test_walks_do_not_depend_on_partitions_and_starts_are_uniform(spark):
    packed = graph.packed(*tables(spark, 10, [(k, k + 1) for k in range(9)]))
    one = {tuple(r["ids"]): 1 for r in walks.uniform(packed.repartition(1), 20, 6).collect()}
    assert one == {tuple(r["ids"]): 1 for r in walks.uniform(packed.repartition(7), 20, 6).collect()}
    counts = dict(walks.uniform(packed, 5000, 1).groupBy(F.get("ids", 0)).count().collect())
    chi2 = sum((counts.get(v, 0) - 500) ** 2 / 500 for v in range(10))
    assert chi2 < 27.9  # 9 degrees of freedom, p = 0.001


def test_strict_walks_do_not_turn_back(spark):
    packed = graph.packed(*tables(spark, 6, [(k, (k + 1) % 6) for k in range(6)]))
    for row in walks.uniform(packed, 20, 8, strict=True).collect():
        ids = row["ids"]
        assert all(ids[k] != ids[k + 2] for k in range(6))


def test_anonymised(spark):
    row = spark.range(1).select(features.anonymised(F.array(F.lit(1), F.lit(2), F.lit(1), F.lit(3))).alias("a")).first()
    assert row["a"] == [0, 1, 0, 2]


def measured(spark, points, f):
    at = [F.struct(*[F.lit(float(x)).alias(k) for x, k in zip(p, "xyz", strict=True)]) for p in points]
    return spark.range(1).select(f(*at).alias("x")).first()["x"]


def test_angles_and_dihedrals(spark):
    assert math.isclose(measured(spark, [(1, 0, 0), (0, 0, 0), (0, 1, 0)], geometry.bond_angle), math.pi / 2, abs_tol=1e-6)
    assert math.isclose(measured(spark, [(-1, 0, 0), (0, 0, 0), (1, 0, 0)], geometry.bond_angle), math.pi, abs_tol=1e-3)
    assert math.isclose(measured(spark, [(0, 0, 0)] * 3, geometry.bond_angle), math.pi / 2, abs_tol=1e-6)
    base = [(0, 1, 0), (0, 0, 0), (1, 0, 0)]
    assert math.isclose(abs(measured(spark, [*base, (1, -1, 0)], geometry.dihedral)), math.pi, abs_tol=1e-6)
    assert math.isclose(measured(spark, [*base, (1, 1, 0)], geometry.dihedral), 0, abs_tol=1e-6)
    assert math.isclose(abs(measured(spark, [*base, (1, 0, 1)], geometry.dihedral)), math.pi / 2, abs_tol=1e-6)
    assert measured(spark, [(0, 1, 0), (0, 0, 0), (1e-9, 0, 0), (1, 1, 0)], geometry.dihedral) == 0


def test_distances_do_not_change_under_rotation(spark):
    rng = random.Random(4)
    points = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(5)]
    c, s = math.cos(0.7), math.sin(0.7)
    turned = [[c * x - s * y, s * x + c * y, z + 3] for x, y, z in points]

    def sums(ps):
        nodes = spark.createDataFrame([(1, v, tuple(p)) for v, p in enumerate(ps)], "g long, v int, pos struct<x:double,y:double,z:double>")
        return [round(r["dist"], 6) for r in graph.pair_distances(nodes).orderBy("u", "v").collect()]

    assert sums(points) == sums(turned)


def test_laplacian_eigenpairs(spark):
    rows = graph.laplacian_eigs(*tables(spark, 4, [(0, 1), (1, 2), (2, 3)]), k=3).orderBy("v").collect()
    d = [1, 2, 2, 1]
    for j in range(3):
        x = [r["raw"][j] for r in rows]
        lx = [x[v] - sum(x[w] / math.sqrt(d[v] * d[w]) for w in (v - 1, v + 1) if 0 <= w < 4) for v in range(4)]
        assert all(math.isclose(a, rows[0]["values"][j] * b, abs_tol=1e-9) for a, b in zip(lx, x, strict=True))
