"""The queries on whole graphs reach every node, pair and column."""

from pyspark.sql import functions as F

from walkloom.operators import graph
from walkloom.plans import catalog, fixtures

D = "/root/testdata/sf0.001"


def test_every_node_and_pair(spark):
    sizes = {r["g"]: r["count"] for r in fixtures.g2_nodes(spark, D).groupBy("g").count().collect()}

    def rows(name):
        return {r["g"]: r["count"] for r in catalog.QUERIES[name](spark, D).groupBy("g").count().collect()}

    for name in ("step_edge_feature_dfs", "step_edge_feature_bfs", "emit_xyz"):
        assert rows(name) == sizes
    assert rows("pair_geometry") == {g: n * n for g, n in sizes.items()}
    assert rows("rbf_expand") == {g: n * (n - 1) * 16 for g, n in sizes.items()}
    keys = catalog.QUERIES["distance_multiset_key"](spark, D).collect()
    assert {r["g"]: r["n"] for r in keys} == {g: n * (n - 1) // 2 for g, n in sizes.items()}


def test_every_column(spark):
    assert catalog.QUERIES["results_pivot"](spark, D).columns == ["model", "target", *[f"m{k}" for k in range(1, 8)]]
    cells = catalog.QUERIES["median_min_max"](spark, D)
    assert cells.where((F.col("lo") > F.col("med") + 1e-6) | (F.col("hi") < F.col("med") - 1e-6)).count() == 0


def test_packed_ranks_equal_ranks_by_joins(spark):
    nodes, edges = fixtures.g1(spark, D, chain=False)
    by_joins = {(r["g"], r["v"]): r["c"] for r in graph.wl_ranks(nodes, edges, F.col("z")).collect()}
    ranks = graph.wl_ranks_packed(graph.packed(nodes, edges)).collect()
    assert {(r["g"], v): c for r in ranks for v, c in enumerate(r["rank"])} == by_joins


def test_approximate_coverage(spark):
    (row,) = catalog.QUERIES["approx_coverage"](spark, D).collect()
    seen = catalog.QUERIES["walk_edge_table"](spark, D).select("node").distinct().count()
    n = fixtures.g3_edges(spark, D).select("u").distinct().count()
    assert abs(row["seen"] - seen) <= 0.1 * seen and abs(row["n"] - n) <= 0.1 * n


def test_coverage_takes_no_tree_through_the_driver(spark, monkeypatch):
    from walkloom.operators import huge

    plans, written = [], huge.written
    monkeypatch.setattr(huge, "written", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), written(df, tag))[1])
    catalog.QUERIES["approx_coverage"](spark, D).collect()
    joins = [line for tag, plan in plans if tag == "walks" for line in plan.splitlines() if "Join [node#" in line and "key#" in line]
    assert any(tag == "inner" for tag, _ in plans) and joins and not any("Broadcast" in line for line in joins)
