"""Queries on the order graphs (G1), their disconnected form, and the part-supplier graph (G3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.operators import features, graph, huge, walks
from walkloom.plans import fixtures as fx
from walkloom.plans.catalog import query

R = "WITH RECURSIVE "
NW, L = 2, 8


def _joined(ids: str) -> F.Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def _walks(spark: SparkSession, d: str) -> DataFrame:
    return walks.uniform(fx.g1_packed(spark, d), NW, L)


@query(f"WITH {fx.G1} SELECT g, u, v FROM e")
def undirect(spark, d):
    return fx.g1(spark, d)[1]


@query(f"WITH {fx.G1} SELECT g, v, array_to_string(nbrs, ',') nbrs FROM adj")
def adjacency(spark, d):
    return graph.adjacency(*fx.g1(spark, d)).withColumn("nbrs", _joined("nbrs"))


@query(f"WITH {fx.G1D} SELECT g, v, array_to_string(nbrs, ',') nbrs FROM adj")
def adjacency_isolated(spark, d):
    return graph.adjacency(*fx.g1(spark, d, chain=False)).withColumn("nbrs", _joined("nbrs"))


@query(f"WITH {fx.G1} SELECT g, u v, count(*) n_edges, count(DISTINCT v) n_nbrs FROM e GROUP BY g, u")
def degree(spark, d):
    return graph.degrees(fx.g1(spark, d)[1])


@query(f"WITH {fx.G1} SELECT g, count(*) n FROM n GROUP BY g")
def node_count(spark, d):
    return graph.node_counts(*fx.g1(spark, d))


@query(f"WITH {fx.G1} SELECT max(c) max_len FROM (SELECT count(*) c FROM n GROUP BY g)")
def max_len(spark, d):
    return fx.g1_nodes(spark, d).groupBy("g").count().agg(F.max("count").alias("max_len"))


_WL = """c0 AS (SELECT n.g, n.v, dense_rank() OVER (PARTITION BY n.g ORDER BY z, len(nbrs)) - 1 c FROM n JOIN adj USING (g, v))"""
_WLK = """, c{k} AS (SELECT g, v, dense_rank() OVER (PARTITION BY g ORDER BY c, near) - 1 c FROM (SELECT c.g, c.v, any_value(c.c) c, coalesce(list(o.c ORDER BY o.c) FILTER (o.c IS NOT NULL), []) near
  FROM c{p} c LEFT JOIN e ON e.g = c.g AND e.u = c.v LEFT JOIN c{p} o ON o.g = e.g AND o.v = e.v GROUP BY c.g, c.v))"""


@query(f"WITH {fx.G1}, {_WL}{''.join(_WLK.format(k=k, p=k - 1) for k in (1, 2, 3))} SELECT g, v, c FROM c3")
def wl_ranks(spark, d):
    ranks = graph.wl_ranks_packed(fx.g1_packed(spark, d))
    return ranks.select("g", F.posexplode_outer("rank").alias("v", "c"))


_KEY = """, k{k} AS (SELECT c.g, c.v, md5(concat_ws(';', any_value(c.c), coalesce(string_agg(o.c, ',' ORDER BY o.c), ''))) c
  FROM k{p} c LEFT JOIN e ON e.g = c.g AND e.u = c.v LEFT JOIN k{p} o ON o.g = e.g AND o.v = e.v GROUP BY c.g, c.v)"""


@query(f"WITH {fx.G1}, k0 AS (SELECT g, v, md5(CAST(z AS VARCHAR)) c FROM n){''.join(_KEY.format(k=k, p=k - 1) for k in (1, 2))} SELECT g, md5(string_agg(c, ',' ORDER BY c)) wl_key FROM k2 GROUP BY g")
def wl_graph_key(spark, d):
    return graph.wl_keys(*fx.g1(spark, d), F.col("z"))


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)} SELECT g, walk, pos, node FROM w")
def walk_uniform(spark, d):
    return walks.steps(_walks(spark, d))


@query(f"{R}{fx.G1D}, {fx.sql_walk(NW, L)} SELECT g, walk, pos, node FROM w")
def walk_stay(spark, d):
    return walks.steps(walks.uniform(fx.g1_packed(spark, d, chain=False), NW, L))


_MDLR = f"""size AS (SELECT g, count(*) n FROM n GROUP BY g),
wt AS (SELECT a.g, a.v, x.u nb, 1.0::DOUBLE / least(len(a.nbrs), len(b.nbrs)) w FROM adj a, LATERAL (SELECT unnest(a.nbrs) u) x JOIN adj b ON b.g = a.g AND b.v = x.u),
cum AS (SELECT g, v, list(nb ORDER BY nb) nbs, list(c ORDER BY nb) cs FROM (SELECT g, v, nb, sum(w) OVER (PARTITION BY g, v ORDER BY nb ROWS UNBOUNDED PRECEDING) c FROM wt) GROUP BY g, v),
w AS (SELECT g, CAST(k AS INT) walk, 0 pos, CAST({fx.sql_u32("0", "g", "k", "0")} % n AS INT) node FROM size, range({NW}) t(k)
  UNION ALL SELECT w.g, w.walk, w.pos + 1, CASE WHEN c.nbs IS NULL THEN w.node ELSE c.nbs[least(len(list_filter(c.cs, lambda y: y <= {fx.sql_u32("0", "w.g", "w.walk", "w.pos + 1")} / 4294967296.0::DOUBLE * c.cs[-1])), len(c.nbs) - 1) + 1] END
  FROM w LEFT JOIN cum c ON c.g = w.g AND c.v = w.node WHERE w.pos + 1 < {L})"""


@query(f"{R}{fx.G1}, {_MDLR} SELECT g, walk, pos, node FROM w")
def walk_mdlr(spark, d):
    return walks.steps(walks.sample("mdlr", fx.g1_packed(spark, d), NW, L))


_ANON = "dense_rank() OVER (PARTITION BY g, walk ORDER BY first) - 1"


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)}, f AS (SELECT *, min(pos) OVER (PARTITION BY g, walk, node) first FROM w) SELECT g, walk, pos, node, {_ANON} anon FROM f")
def walk_rum_anon(spark, d):
    rows = _walks(spark, d).select("g", "walk", F.posexplode(F.arrays_zip("ids", features.anonymised(F.col("ids")).alias("anon"))).alias("pos", "x"))
    return rows.select("g", "walk", "pos", F.col("x.ids").alias("node"), F.col("x.anon").alias("anon"))


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)} SELECT g, walk, string_agg(CASE WHEN first = pos THEN 1 ELSE 0 END, '' ORDER BY pos) fresh FROM (SELECT *, min(pos) OVER (PARTITION BY g, walk, node) first FROM w) GROUP BY g, walk")
def anonymize(spark, d):
    ids = features.anonymised(F.col("ids"))
    fresh = F.transform("a", lambda x, k: F.when((k == 0) | (x > F.array_max(F.slice("a", 1, F.greatest(k, F.lit(1))))), "1").otherwise("0"))
    return _walks(spark, d).select("g", "walk", ids.alias("a")).select("g", "walk", F.array_join(fresh, "").alias("fresh"))


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L, adaptive=True)} SELECT g, walk, count(*) length, rpad(string_agg(node, '' ORDER BY pos), 20, '-') ids FROM w GROUP BY g, walk")
def walk_adaptive_padded(spark, d):
    out = walks.padded(walks.sample("walk_ada", fx.g1_packed(spark, d), NW, 0), 20)
    real = F.filter("ids", lambda x: x >= 0)
    return out.select("g", "walk", F.col("length").cast("long").alias("length"), F.rpad(F.array_join(F.transform(real, lambda x: x.cast("string")), ""), 20, "-").alias("ids"))


def _found(spark: SparkSession, d: str, depth_first: bool, chain: bool = True) -> DataFrame:
    return walks.search(fx.g1_packed(spark, d, chain), NW, depth_first=depth_first)


@query(f"{R}{fx.G1}, {fx.sql_search(NW, False)} SELECT g, walk, array_to_string(ids, ',') ids FROM found")
def bfs_order(spark, d):
    return _found(spark, d, False).select("g", "walk", _joined("ids").alias("ids"))


@query(f"{R}{fx.G1}, {fx.sql_search(NW, True)} SELECT g, walk, array_to_string(ids, ',') ids FROM found")
def dfs_order(spark, d):
    return _found(spark, d, True).select("g", "walk", _joined("ids").alias("ids"))


@query(f"{R}{fx.G1}, {fx.sql_search(NW, True, cap=3)} SELECT g, walk, array_to_string(ids, ',') ids FROM found")
def dfs_capped(spark, d):
    return walks.sample("search", fx.g1_packed(spark, d), NW, 3).select("g", "walk", _joined("ids").alias("ids"))


@query(f"{R}{fx.G1D}, {fx.sql_search(NW, True)} SELECT g, walk, len(ids) length, array_to_string(ids, ',') ids FROM found")
def dfs_component_only(spark, d):
    return _found(spark, d, True, chain=False).select("g", "walk", F.size("ids").cast("long").alias("length"), _joined("ids").alias("ids"))


@query(f"{R}{fx.G1}, {fx.sql_search(1, True)}, x AS (SELECT g, unnest(generate_series(1, len(ids))) k, ids, parents FROM found) SELECT g, CAST(k - 2 AS INT) pos, parents[k] parent, ids[k] child FROM x WHERE k > 1")
def dfs_edges(spark, d):
    rows = walks.search(fx.g1_packed(spark, d), 1).select("g", F.posexplode(F.arrays_zip("parents", "ids")).alias("pos", "x"))
    return rows.where("pos > 0").select("g", (F.col("pos") - 1).alias("pos"), F.col("x.parents").alias("parent"), F.col("x.ids").alias("child"))


_CANON = """r AS (SELECT adj.g, adj.v, c, nbrs FROM adj JOIN c3 USING (g, v)),
near AS (SELECT r.g, r.v, list(o.v ORDER BY o.c DESC, o.v DESC) nbrs FROM r JOIN e ON e.g = r.g AND e.u = r.v JOIN r o ON o.g = r.g AND o.v = e.v GROUP BY r.g, r.v),
s AS (SELECT g, 0 k, [first(v ORDER BY c, v)] todo, CAST([] AS INT[]) ids FROM r GROUP BY g
  UNION ALL SELECT s.g, k + 1, CASE WHEN list_contains(ids, todo[-1]) THEN todo[:-2] ELSE list_concat(todo[:-2], [x FOR x IN coalesce(nb.nbrs, []) IF NOT list_contains(ids, x) AND x <> todo[-1]]) END,
    CASE WHEN list_contains(ids, todo[-1]) THEN ids ELSE list_append(ids, todo[-1]) END
  FROM s LEFT JOIN near nb ON nb.g = s.g AND nb.v = todo[-1] WHERE len(todo) > 0)"""


@query(f"{R}{fx.G1}, {_WL}{''.join(_WLK.format(k=k, p=k - 1) for k in (1, 2, 3))}, {_CANON} SELECT g, array_to_string(arg_max(ids, k), ',') ids FROM s GROUP BY g")
def dfs_canonical(spark, d):
    graphs = fx.g1_packed(spark, d)
    return walks.search(graphs.join(graph.wl_ranks_packed(graphs), "g"), 1, rank="rank").select("g", _joined("ids").alias("ids"))


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)} SELECT a.g, a.walk, a.pos, CAST(d AS INT) d, CASE WHEN b.node = a.node THEN 1 ELSE 0 END bit FROM w a CROSS JOIN range(1, 4) t(d) LEFT JOIN w b ON b.g = a.g AND b.walk = a.walk AND b.pos = a.pos - d")
def repeat_encoding(spark, d):
    return features.repeat_encoding(walks.steps(_walks(spark, d)), 3)


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)} SELECT a.g, a.walk, a.pos, CAST(d AS INT) d, CASE WHEN e.g IS NOT NULL THEN 1 ELSE 0 END bit FROM w a CROSS JOIN range(1, 4) t(d) LEFT JOIN w b ON b.g = a.g AND b.walk = a.walk AND b.pos = a.pos - d LEFT JOIN e ON e.g = a.g AND e.u = b.node AND e.v = a.node")
def edge_encoding(spark, d):
    return features.edge_encoding_packed(walks.uniform(fx.g1_packed(spark, d), NW, L, keep=("adj",)), 3)


_COVER = "SELECT g, walk, count(DISTINCT node) seen, round(count(DISTINCT node) / any_value(n)::DOUBLE, 6) share FROM w GROUP BY g, walk"


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)} {_COVER}")
def walk_coverage(spark, d):
    graphs = fx.g1_packed(spark, d)
    rows = walks.uniform(graphs, NW, L).join(graphs.select("g", "n"), "g")
    seen = F.size(F.array_distinct("ids"))
    return rows.select("g", "walk", seen.cast("long").alias("seen"), F.round(seen / F.col("n"), 6).alias("share"))


@query(f"{R}{fx.G1}, {fx.sql_walk(16, 1)}, o AS (SELECT n.g, n.v, count(w.node) o FROM n LEFT JOIN w ON w.g = n.g AND w.node = n.v GROUP BY n.g, n.v) SELECT o.g, round(sum((o - 16.0 / n) * (o - 16.0 / n) / (16.0 / n)), 6) chi2, min(o) least, max(o) most FROM o JOIN size USING (g) GROUP BY o.g")
def start_chi2(spark, d):
    graphs = fx.g1_packed(spark, d)
    hit = walks.uniform(graphs, 16, 1).select("g", F.get("ids", 0).alias("v")).groupBy("g", "v").agg(F.count("*").alias("o"))
    every = graphs.select("g", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("v")).join(hit, ["g", "v"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    want = 16.0 / F.col("n")
    return every.groupBy("g").agg(F.round(F.sum((F.col("o") - want) ** 2 / want), 6).alias("chi2"), F.min("o").alias("least"), F.max("o").alias("most"))


def _bags(rows: DataFrame, graphs: DataFrame) -> DataFrame:
    bag = F.array_join(F.array_sort(F.transform("ids", lambda x: F.get("z", x).cast("string"))), "")
    return rows.join(graphs.select("g", "z"), "g").select(bag.alias("bag")).groupBy("bag").agg(F.count("*").alias("n"))


_BAG = "SELECT string_agg(z, '' ORDER BY z) bag, w.g, walk FROM w JOIN n ON n.g = w.g AND n.v = w.node GROUP BY w.g, walk"


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)} SELECT bag, count(*) n FROM ({_BAG}) GROUP BY bag")
def walk_bags(spark, d):
    graphs = fx.g1_packed(spark, d)
    return _bags(walks.uniform(graphs, NW, L), graphs)


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)}, b AS (SELECT bag, count(*) FILTER (walk = 0) + 0.5 x, count(*) FILTER (walk = 1) + 0.5 y FROM ({_BAG}) GROUP BY bag) SELECT round(sum((x - (x + y) / 2) * (x - (x + y) / 2) / ((x + y) / 2) * 2), 4) chi2, count(*) - 1 df FROM b")
def two_sample_chi2(spark, d):
    graphs = fx.g1_packed(spark, d)
    rows = walks.uniform(graphs, NW, L)
    a, b = (_bags(rows.where(F.col("walk") == k), graphs).withColumnRenamed("n", f"n{k}") for k in (0, 1))
    both = a.join(b, "bag", "full").select((F.coalesce("n0", F.lit(0)) + 0.5).alias("x"), (F.coalesce("n1", F.lit(0)) + 0.5).alias("y"))
    mid = (F.col("x") + F.col("y")) / 2
    return both.agg(F.round(F.sum((F.col("x") - mid) ** 2 / mid * 2), 4).alias("chi2"), (F.count("*") - 1).alias("df"))


@query(f"{R}{fx.G1}, {fx.sql_walk(NW, L)} SELECT count(*) bad FROM w a JOIN w b ON b.g = a.g AND b.walk = a.walk AND b.pos = a.pos + 1 LEFT JOIN e ON e.g = a.g AND e.u = a.node AND e.v = b.node WHERE a.node <> b.node AND e.g IS NULL")
def transition_validity(spark, d):
    rows = walks.steps(_walks(spark, d)).withColumn("u", F.lag("node").over(features.along())).where("u is not null and u <> node")
    bad = rows.select("g", "u", F.col("node").alias("v")).join(fx.g1(spark, d)[1], ["g", "u", "v"], "left_anti")
    return bad.agg(F.count("*").alias("bad"))


def _valued(spark: SparkSession, d: str) -> DataFrame:
    return walks.steps(_walks(spark, d)).withColumn("x", (F.col("pos") * 3 + F.col("node")).cast("double"))


_X = f"{R}{fx.G1}, {fx.sql_walk(NW, L)}, x AS (SELECT g, walk, pos, node, CAST(pos * 3 + node AS DOUBLE) x FROM w), m AS (SELECT g, node, avg(x) mean FROM x GROUP BY g, node)"


@query(f"{_X} SELECT g, node, round(mean, 6) mean FROM m")
def node_mean(spark, d):
    return features.node_mean(_valued(spark, d), "x").withColumn("mean", F.round("mean", 6))


@query(f"{_X} SELECT g, walk, pos, node, round(mean, 6) mean FROM x JOIN m USING (g, node)")
def node_write_back(spark, d):
    return features.write_back(_valued(spark, d), "x").select("g", "walk", "pos", "node", F.round("mean", 6).alias("mean"))


@query(f"{_X} SELECT g, round(avg(mean), 6) mean, round(sum(mean), 6) total, round(max(mean), 6) most FROM m GROUP BY g")
def graph_pool(spark, d):
    return features.graph_pool(features.node_mean(_valued(spark, d), "x")).select("g", *[F.round(c, 6).alias(c) for c in ("mean", "total", "most")])


@query(f"{_X} SELECT g, round(sum(mean) / (max(node) + 1), 6) mean, round(sum(mean), 6) total, round(CASE WHEN count(*) <= max(node) THEN greatest(max(mean), 0.0) ELSE max(mean) END, 6) most FROM m GROUP BY g")
def graph_pool_zero_fill(spark, d):
    return features.graph_pool(features.node_mean(_valued(spark, d), "x"), zero_fill=True).select("g", *[F.round(c, 6).alias(c) for c in ("mean", "total", "most")])


@query(f"{_X}, p AS (SELECT g, walk, avg(x) x FROM x GROUP BY g, walk) SELECT g, round(avg(x), 6) mean, round(max(x), 6) most FROM p GROUP BY g")
def walk_pool(spark, d):
    per = _valued(spark, d).groupBy("g", "walk").agg(F.avg("x").alias("x"))
    return per.groupBy("g").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("most"))


_T = "t AS (SELECT g, u i, v j, 1.0::DOUBLE / count(*) OVER (PARTITION BY g, u) p FROM e)"


@query(f"WITH {fx.G1}, {_T}, t2 AS (SELECT a.g, a.i, b.j, sum(a.p * b.p) p FROM t a JOIN t b ON b.g = a.g AND b.i = a.j GROUP BY a.g, a.i, b.j), t3 AS (SELECT a.g, a.i, b.j, sum(a.p * b.p) p FROM t2 a JOIN t b ON b.g = a.g AND b.i = a.j GROUP BY a.g, a.i, b.j), h AS (SELECT g, i v, 1 step, p FROM t WHERE i = j UNION ALL SELECT g, i, 2, p FROM t2 WHERE i = j UNION ALL SELECT g, i, 3, p FROM t3 WHERE i = j) SELECT n.g, n.v, s.step, round(coalesce(h.p, 0.0), 6) p FROM n CROSS JOIN (SELECT unnest([1, 2, 3]) step) s LEFT JOIN h ON h.g = n.g AND h.v = n.v AND h.step = s.step")
def rwse(spark, d):
    return graph.rwse(*fx.g1(spark, d)).withColumn("p", F.round("p", 6))


@query()
def laplacian_eigs(spark, d):
    return graph.laplacian_eigs(*fx.g1(spark, d))


_G3 = "h AS (SELECT DISTINCT concat('p', l_partkey) u, concat('s', l_suppkey) v FROM lineitem), e AS (SELECT u, v FROM h UNION ALL SELECT v, u FROM h)"


@query(f"WITH {_G3}, dg AS (SELECT u, count(*) d FROM e GROUP BY u) SELECT e.u, count(*) n, round(sum(1.0 / least(a.d, b.d)), 6) weight FROM e JOIN dg a ON a.u = e.u JOIN dg b ON b.u = e.v GROUP BY e.u")
def mdlr_weights(spark, d):
    edges = fx.g3_edges(spark, d)
    deg = edges.groupBy("u").agg(F.count("*").alias("d"))
    rows = edges.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    return rows.groupBy("u").agg(F.count("*").alias("n"), F.round(F.sum(1.0 / F.least("d", "dv")), 6).alias("weight"))


@query(f"{R}{_G3}, k AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) - 1 k FROM e), dg AS (SELECT u, count(*) d FROM e GROUP BY u), w AS (SELECT u walk, 0 pos, u node FROM dg WHERE starts_with(u, 'p') UNION ALL SELECT w.walk, w.pos + 1, k.v FROM w JOIN dg ON dg.u = w.node JOIN k ON k.u = w.node AND k.k = {fx.sql_u32('0', 'w.walk', 'w.pos + 1')} % dg.d WHERE w.pos < 4) SELECT walk, pos, node FROM w")
def walk_edge_table(spark, d):
    edges = fx.g3_edges(spark, d)
    starts = edges.where("u like 'p%'").select(F.col("u").alias("walk"), F.col("u").alias("node")).distinct()
    return huge.huge_walks(edges, starts, 5)


@query()
def approx_coverage(spark, d):
    """Share of the bipartite graph's nodes that the walks visit, by sketches."""
    nodes = fx.g3_edges(spark, d).select(F.lit(0).alias("g"), F.col("u").alias("v"))
    return features.approx_coverage(walk_edge_table(spark, d).withColumn("g", F.lit(0)), nodes)
