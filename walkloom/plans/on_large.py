"""Queries on graphs of up to some hundred nodes (G4), on both sides of the border of the folds, and weighted walks on the skewed graph (G3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.operators import features, graph, huge, lockstep, walks
from walkloom.plans import fixtures as fx
from walkloom.plans.catalog import query

R = "WITH RECURSIVE "
#: Walks and searches of each graph.
NW, NS = 2, 1


def _text(ids: str) -> F.Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def _searched(graphs: DataFrame, depth_first: bool) -> DataFrame:
    return lockstep.search(graphs, NS, depth_first=depth_first).select("g", "walk", _text("ids").alias("ids"), _text("parents").alias("parents"))


@query(f"{R}{fx.G4}, {fx.sql_search(NS, True)} SELECT g, walk, array_to_string(ids, ',') ids, array_to_string(parents, ',') parents FROM found")
def traverse_dfs(spark, d):
    return _searched(fx.g4_packed(spark, d), True)


@query(f"{R}{fx.G4}, {fx.sql_search(NS, False)} SELECT g, walk, array_to_string(ids, ',') ids, array_to_string(parents, ',') parents FROM found")
def traverse_bfs(spark, d):
    return _searched(fx.g4_packed(spark, d), False)


# Weighted steps: each node's neighbours with running weights, and walks as long as the graph.
_CUM = """wt AS (SELECT a.g, a.v, x.u nb, 1.0::DOUBLE / least(len(a.nbrs), len(b.nbrs)) w FROM adj a, LATERAL (SELECT unnest(a.nbrs) u) x JOIN adj b ON b.g = a.g AND b.v = x.u),
cum AS (SELECT g, v, list(nb ORDER BY nb) nbs, list(c ORDER BY nb) cs FROM (SELECT g, v, nb, sum(w) OVER (PARTITION BY g, v ORDER BY nb ROWS UNBOUNDED PRECEDING) c FROM wt) GROUP BY g, v)"""
_MDLR_ADA = f"""size AS (SELECT g, count(*) n FROM n GROUP BY g), {_CUM},
w AS (SELECT g, CAST(k AS INT) walk, 0 pos, CAST({fx.sql_u32("0", "g", "k", "0")} % n AS INT) node, n FROM size, range({NW}) t(k)
  UNION ALL SELECT w.g, w.walk, w.pos + 1, CASE WHEN c.nbs IS NULL THEN w.node ELSE c.nbs[least(len(list_filter(c.cs, lambda y: y <= {fx.sql_u32("0", "w.g", "w.walk", "w.pos + 1")} / 4294967296.0::DOUBLE * c.cs[-1])), len(c.nbs) - 1) + 1] END, w.n
  FROM w LEFT JOIN cum c ON c.g = w.g AND c.v = w.node WHERE w.pos + 1 < w.n)"""


@query(f"{R}{fx.G4}, {_MDLR_ADA} SELECT g, walk, pos, node FROM w")
def walk_mdlr_adaptive(spark, d):
    return walks.steps(walks.sample("mdlr_ada", fx.g4_packed(spark, d), NW, 0))


@query(f"{R}{fx.G4}, {fx.sql_walk(NW, 0, adaptive=True)}, f AS (SELECT *, min(pos) OVER (PARTITION BY g, walk, node) first FROM w) SELECT g, walk, pos, node, dense_rank() OVER (PARTITION BY g, walk ORDER BY first) - 1 anon FROM f")
def walk_rum_adaptive(spark, d):
    found = walks.sample("rum_ada", fx.g4_packed(spark, d), NW, 0)
    rows = found.select("g", "walk", F.posexplode(F.arrays_zip("ids", features.anonymised(F.col("ids")).alias("anon"))).alias("pos", "x"))
    return rows.select("g", "walk", "pos", F.col("x.ids").alias("node"), F.col("x.anon").alias("anon"))


_LOOPS = fx.G4.replace("SELECT g, v, u FROM e0)", "SELECT g, v, u FROM e0 UNION SELECT g, v, v FROM n WHERE z = 0)")
_NO_LOOPS = "bare AS (SELECT g, v, list_filter(nbrs, lambda x: x <> v) nbrs FROM adj)"


@query(f"{R}{_LOOPS}, {_NO_LOOPS}, {fx.sql_walk(NW, 12).replace('JOIN adj a', 'JOIN bare a')} SELECT g, walk, pos, node FROM w")
def walk_non_backtracking(spark, d):
    """Walks that never take a self-loop, on graphs that have some."""
    graphs = fx.g4_packed(spark, d, self_loops=True)
    return walks.steps(lockstep.step_walks(graphs, NW, 12, drop_self_loops=True))


_STRICT = f"""size AS (SELECT g, count(*) n FROM n GROUP BY g),
w AS (SELECT g, CAST(k AS INT) walk, 0 pos, CAST({fx.sql_u32("0", "g", "k", "0")} % n AS INT) node, -1 back FROM size, range({NW}) t(k)
  UNION ALL SELECT g, walk, pos + 1, CASE WHEN len(near) = 0 THEN node ELSE near[CAST({fx.sql_u32("0", "g", "walk", "pos + 1")} % len(near) AS INT) + 1] END, node
  FROM (SELECT w.*, CASE WHEN len(list_filter(a.nbrs, lambda x: x <> w.back)) > 0 THEN list_filter(a.nbrs, lambda x: x <> w.back) ELSE a.nbrs END near FROM w JOIN bare a ON a.g = w.g AND a.v = w.node) q WHERE pos + 1 < 12)"""


@query(f"{R}{_LOOPS}, {_NO_LOOPS}, {_STRICT} SELECT g, walk, pos, node FROM w")
def walk_strict(spark, d):
    """Walks that never step straight back unless there is no other way, and take no self-loop."""
    graphs = fx.g4_packed(spark, d, self_loops=True)
    return walks.steps(lockstep.step_walks(graphs, NW, 12, drop_self_loops=True, strict=True))


_G3 = "h AS (SELECT DISTINCT concat('p', l_partkey) u, concat('s', l_suppkey) v FROM lineitem), e AS (SELECT u, v FROM h UNION ALL SELECT v, u FROM h), dg AS (SELECT u, count(*) d FROM e GROUP BY u)"
_SUMS = "cw AS (SELECT e.u, e.v, sum(1.0::DOUBLE / least(a.d, b.d)) OVER (PARTITION BY e.u ORDER BY e.v ROWS UNBOUNDED PRECEDING) c FROM e JOIN dg a ON a.u = e.u JOIN dg b ON b.u = e.v), cl AS (SELECT u, list(v ORDER BY v) vs, list(c ORDER BY v) cs FROM cw GROUP BY u)"


@query(f"{R}{_G3}, {_SUMS}, w AS (SELECT u walk, 0 pos, u node FROM dg WHERE starts_with(u, 'p') UNION ALL SELECT w.walk, w.pos + 1, vs[least(len(list_filter(cs, lambda y: y <= {fx.sql_u32('0', 'w.walk', 'w.pos + 1')} / 4294967296.0::DOUBLE * cs[-1])), len(vs) - 1) + 1] FROM w JOIN cl ON cl.u = w.node WHERE w.pos < 5) SELECT walk, pos, node FROM w")
def walk_edge_table_mdlr(spark, d):
    """Degree-weighted walks from every part on the one bipartite graph, whose suppliers are hubs."""
    edges = fx.g3_edges(spark, d)
    starts = edges.where("u like 'p%'").select(F.col("u").alias("walk"), F.col("u").alias("node")).distinct()
    return huge.huge_walks(edges, starts, 6, weighted=True)


_WL = """c0 AS (SELECT n.g, n.v, dense_rank() OVER (PARTITION BY n.g ORDER BY z, len(nbrs)) - 1 c FROM n JOIN adj USING (g, v)),
c1 AS (SELECT g, v, dense_rank() OVER (PARTITION BY g ORDER BY c, near) - 1 c FROM (SELECT c.g, c.v, any_value(c.c) c, coalesce(list(o.c ORDER BY o.c) FILTER (o.c IS NOT NULL), []) near
  FROM c0 c LEFT JOIN e ON e.g = c.g AND e.u = c.v LEFT JOIN c0 o ON o.g = e.g AND o.v = e.v GROUP BY c.g, c.v)),
r AS (SELECT adj.g, adj.v, c, nbrs FROM adj JOIN c1 USING (g, v)),
near AS (SELECT r.g, r.v, list(o.v ORDER BY o.c DESC, o.v DESC) nbrs FROM r JOIN e ON e.g = r.g AND e.u = r.v JOIN r o ON o.g = r.g AND o.v = e.v GROUP BY r.g, r.v),
s AS (SELECT g, 0 k, [first(v ORDER BY c, v)] todo, CAST([] AS INT[]) ids FROM r GROUP BY g
  UNION ALL SELECT s.g, k + 1, CASE WHEN list_contains(ids, todo[-1]) THEN todo[:-2] ELSE list_concat(todo[:-2], [x FOR x IN coalesce(nb.nbrs, []) IF NOT list_contains(ids, x) AND x <> todo[-1]]) END,
    CASE WHEN list_contains(ids, todo[-1]) THEN ids ELSE list_append(ids, todo[-1]) END
  FROM s LEFT JOIN near nb ON nb.g = s.g AND nb.v = todo[-1] WHERE len(todo) > 0)"""


@query(f"{R}{fx.G4}, {_WL} SELECT g, array_to_string(arg_max(ids, k), ',') ids FROM s GROUP BY g")
def traverse_canonical(spark, d):
    graphs = fx.g4_packed(spark, d)
    ranked = graphs.join(graph.wl_ranks_packed(graphs, 1), "g")
    return lockstep.search(ranked, 1, rank="rank").select("g", _text("ids").alias("ids"))


_T = "t AS (SELECT g, u i, v j, 1.0::DOUBLE / count(*) OVER (PARTITION BY g, u) p FROM e)"
_POWERS = ", ".join(["t1 AS (SELECT * FROM t)", *[f"t{k} AS (SELECT a.g, a.i, b.j, sum(a.p * b.p) p FROM t{k - 1} a JOIN t b ON b.g = a.g AND b.i = a.j GROUP BY a.g, a.i, b.j)" for k in range(2, 17)]])
_BACK = " UNION ALL ".join(f"SELECT g, i v, {k} step, p FROM t{k} WHERE i = j" for k in range(1, 17))


@query(f"WITH {fx.G1}, {_T}, {_POWERS}, h AS ({_BACK}) SELECT n.g, n.v, round(coalesce(sum(p) FILTER (step = 5), 0), 6) p5, round(coalesce(sum(p) FILTER (step = 8), 0), 6) p8, round(coalesce(sum(p) FILTER (step = 16), 0), 6) p16, round(coalesce(sum(p), 0), 6) total FROM n LEFT JOIN h ON h.g = n.g AND h.v = n.v GROUP BY n.g, n.v")
def rwse_powers(spark, d):
    """Returns after up to 16 steps, from stacked powers of packed graphs."""
    rows = graph.rwse(*fx.g1(spark, d), steps=16)
    at = lambda k: F.round(F.sum(F.when(F.col("step") == k, F.col("p"))), 6).alias(f"p{k}")
    return rows.groupBy("g", "v").agg(at(5), at(8), at(16), F.round(F.sum("p"), 6).alias("total"))


@query(f"WITH {fx.G4}, s AS (SELECT g, count(*) n FROM n GROUP BY g) SELECT g, CAST(k AS INT) k, CASE WHEN k < n THEN 1.0::DOUBLE ELSE 0.0 END norm, 0.0::DOUBLE residual, 0.0::DOUBLE overlap FROM s, range(6) t(k)")
def laplacian_residuals(spark, d):
    """Of each eigenpair: the vector's length, the largest |Lx - value x|, and the largest product with another vector, all from the edges."""
    nodes = fx.g4_nodes(spark, d)
    sums = graph.laplacian_residuals(nodes, graph.undirected(fx.g1_half(nodes)), 6)
    return sums.select("g", "k", *[F.round(c, 6).alias(c) for c in ("norm", "residual", "overlap")])


_EPOCHS, _RSD = 3, 0.05
_SEEN = f"""size AS (SELECT g, count(*) n FROM n GROUP BY g),
w AS (SELECT g, CAST(k AS INT) walk, CAST(q AS INT) epoch, 0 pos, CAST({fx.sql_u32("q", "g", "k", "0")} % n AS INT) node FROM size, range({NW}) t(k), range({_EPOCHS}) r(q)
  UNION ALL SELECT w.g, walk, epoch, pos + 1, CASE WHEN len(a.nbrs) = 0 THEN w.node ELSE a.nbrs[CAST({fx.sql_u32("epoch", "w.g", "walk", "pos + 1")} % len(a.nbrs) AS INT) + 1] END FROM w JOIN adj a ON a.g = w.g AND a.v = w.node WHERE pos + 1 < 40)"""


@query(f"{R}{fx.G4}, {_SEEN}, c AS (SELECT g, count(DISTINCT node) seen FROM w GROUP BY g) SELECT g, seen, n, round(seen / n::DOUBLE, 6) share, true AS within FROM c JOIN size USING (g)")
def coverage_sketches(spark, d):
    """Nodes of each graph that the walks of all epochs reach: exactly, and whether the union of the epochs' stored sketches says about the same."""
    graphs = fx.g4_packed(spark, d)
    steps = [walks.steps(lockstep.step_walks(graphs, NW, 40, seed=e)).withColumn("epoch", F.lit(e)) for e in range(_EPOCHS)]
    every = steps[0].unionByName(steps[1]).unionByName(steps[2])
    found = features.coverage(every).join(features.united(features.coverage_sketches(every, "epoch")), "g").join(graphs.select("g", "n"), "g")
    near = F.abs(F.col("about") - F.col("seen")) <= F.greatest(F.lit(1.0), 3 * _RSD * F.col("seen"))
    return found.select("g", "seen", F.col("n").cast("long").alias("n"), F.round(F.col("seen") / F.col("n"), 6).alias("share"), near.alias("within"))
