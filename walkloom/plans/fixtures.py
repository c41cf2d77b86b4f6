"""Graphs, runs and epochs derived from the driver tables, in Spark; the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkloom.operators import graph


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def g1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One node per line of an order; z is the rank of its return flag."""
    order = Window.partitionBy("g").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    z = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", z.alias("z"))
    return lines.repartition("g").select("g", (F.row_number().over(order) - 1).alias("v"), "z")


def g1_half(nodes: DataFrame, chain: bool = True) -> DataFrame:
    """Edges in one direction: the chain, and nodes of one label three apart, from one pass of a window over the nodes."""
    along = Window.partitionBy("g").orderBy("v")
    far = F.when(F.lead("z", 3).over(along) == F.col("z"), F.col("v") + 3)
    ends = F.array(F.lead("v").over(along), far) if chain else F.array(far)
    return nodes.select("g", F.col("v").alias("u"), ends.alias("ends")).select("g", "u", F.explode_outer("ends").alias("v")).where("v is not null")


def g1(spark: SparkSession, d: str, chain: bool = True) -> tuple[DataFrame, DataFrame]:
    nodes = g1_nodes(spark, d)
    return nodes, graph.undirected(g1_half(nodes, chain))


def g1_packed(spark: SparkSession, d: str, chain: bool = True) -> DataFrame:
    return graph.packed(*g1(spark, d, chain))


def g4_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Graphs of about 20 to 150 nodes: one for each supplier and line number, a node per line."""
    order = Window.partitionBy("g", "l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice")
    z = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = read(spark, d, "lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("long").alias("g"), "l_suppkey", "l_linenumber", "l_orderkey", "l_partkey", "l_extendedprice", z.alias("z"))
    return lines.repartition("g").select("g", (F.row_number().over(order) - 1).alias("v"), "z")


def g4_packed(spark: SparkSession, d: str, self_loops: bool = False) -> DataFrame:
    nodes = g4_nodes(spark, d)
    half = g1_half(nodes)
    if self_loops:
        half = half.unionByName(nodes.where("z = 0").select("g", F.col("v").alias("u"), "v"))
    return graph.packed(nodes, graph.undirected(half))


def g2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """3-D points: three components of each embedding; a graph holds those of one label among 256 ids in a row, so that graphs keep their size
    as the table grows."""
    order = Window.partitionBy("label", F.expr("vec_id div 256")).orderBy("vec_id")
    at = [F.round(F.element_at("embedding", k).cast("double") * 10, 4) for k in (1, 2, 3)]
    return read(spark, d, "embeddings").select(F.expr("vec_id div 256 * 1000 + label").cast("long").alias("g"), (F.row_number().over(order) - 1).alias("v"), F.struct(*[x.alias(n) for x, n in zip(at, "xyz", strict=True)]).alias("pos"))


def g2_edges(nodes: DataFrame) -> DataFrame:
    near = graph.pair_distances(nodes).where("u <> v and (abs(u - v) = 1 or dist < 2.0)")
    return near.select("g", "u", "v")


def g3_edges(spark: SparkSession, d: str) -> DataFrame:
    """One bipartite graph of parts and suppliers, both ways."""
    half = read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v")).distinct()
    return half.unionByName(half.select(F.col("v").alias("u"), F.col("u").alias("v")))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A result per (model, target, m, seed, stage) from grouped lines; cells whose key hashes to 0 are missing."""
    x = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("target"), F.col("l_linenumber").alias("m"), (F.col("l_suppkey") % 3 + 42).alias("seed"), F.when(F.col("l_partkey") % 2 == 0, "final").otherwise("staged").alias("stage"), "l_discount", "l_tax", "l_quantity")
    out = x.groupBy("model", "target", "m", "seed", "stage").agg(F.round(F.avg("l_discount") + F.avg("l_tax"), 6).alias("mae"), F.round(F.avg("l_tax"), 6).alias("valid"), F.round(F.sum("l_quantity"), 2).alias("wall"))
    gone = F.substring(F.md5(F.concat_ws("|", "model", "target", F.col("m").cast("string"), F.col("seed").cast("string"), "stage")), 1, 1) == "0"
    return out.where(~gone)


def epochs(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select(F.col("user_id").alias("run"), (F.row_number().over(order) - 1).alias("epoch"), F.round("value", 4).alias("valid"), "ts")


# ---- the same fixtures for the oracles -------------------------------------------------------------------------------------------
G1 = """n AS (SELECT l_orderkey g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) v,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END z FROM lineitem),
e0 AS (SELECT a.g, a.v u, b.v v FROM n a JOIN n b ON a.g = b.g AND (b.v = a.v + 1 OR (a.z = b.z AND b.v = a.v + 3))),
e AS (SELECT g, u, v FROM e0 UNION SELECT g, v, u FROM e0),
adj AS (SELECT n.g, n.v, coalesce(list(e.v ORDER BY e.v) FILTER (e.v IS NOT NULL), []) nbrs FROM n LEFT JOIN e ON e.g = n.g AND e.u = n.v GROUP BY n.g, n.v)"""
G4 = G1.replace("l_orderkey g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)", "CAST(l_suppkey * 10 + l_linenumber AS BIGINT) g, CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice)")
G1D = G1.replace("(b.v = a.v + 1 OR (a.z = b.z AND b.v = a.v + 3))", "a.z = b.z AND b.v = a.v + 3")
G2 = """n AS (SELECT CAST(vec_id // 256 * 1000 + label AS BIGINT) g, CAST(row_number() OVER (PARTITION BY label, vec_id // 256 ORDER BY vec_id) - 1 AS INT) v, round(CAST(embedding[1] AS DOUBLE) * 10, 4) x,
  round(CAST(embedding[2] AS DOUBLE) * 10, 4) y, round(CAST(embedding[3] AS DOUBLE) * 10, 4) z FROM embeddings),
d AS (SELECT a.g, a.v u, b.v v, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) dist FROM n a JOIN n b ON a.g = b.g),
e AS (SELECT g, u, v FROM d WHERE u <> v AND (abs(u - v) = 1 OR dist < 2.0)),
adj AS (SELECT n.g, n.v, coalesce(list(e.v ORDER BY e.v) FILTER (e.v IS NOT NULL), []) nbrs FROM n LEFT JOIN e ON e.g = n.g AND e.u = n.v GROUP BY n.g, n.v)"""
RUNS = """runs AS (SELECT * FROM (SELECT l_returnflag model, l_linestatus target, l_linenumber m, l_suppkey % 3 + 42 seed, CASE WHEN l_partkey % 2 = 0 THEN 'final' ELSE 'staged' END stage,
  round(avg(l_discount) + avg(l_tax), 6) mae, round(avg(l_tax), 6) valid, round(sum(l_quantity), 2) wall FROM lineitem GROUP BY ALL)
  WHERE substr(md5(concat_ws('|', model, target, m, seed, stage)), 1, 1) <> '0')"""
EPOCHS = """epochs AS (SELECT user_id run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) epoch, round(value, 4) valid, ts FROM events)"""


def sql_u32(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def sql_walk(nw: int, length: int, seed: int = 0, adaptive: bool = False) -> str:
    """CTEs w(g, walk, pos, node) of uniform walks over n and adj; needs WITH RECURSIVE."""
    draw = sql_u32(str(seed), "w.g", "w.walk", "w.pos + 1")
    end = "w.pos + 1 < w.n" if adaptive else f"w.pos + 1 < {length}"
    return f"""size AS (SELECT g, count(*) n FROM n GROUP BY g),
w AS (SELECT g, CAST(k AS INT) walk, 0 pos, CAST({sql_u32(str(seed), "g", "k", "0")} % n AS INT) node, n FROM size, range({nw}) t(k)
  UNION ALL SELECT w.g, w.walk, w.pos + 1, CASE WHEN len(a.nbrs) = 0 THEN w.node ELSE a.nbrs[CAST({draw} % len(a.nbrs) AS INT) + 1] END, w.n
  FROM w JOIN adj a ON a.g = w.g AND a.v = w.node WHERE {end})"""


def sql_search(nw: int, depth_first: bool, seed: int = 0, cap: int = 1000000) -> str:
    """CTE found(g, walk, ids, parents) of keyed searches; needs WITH RECURSIVE."""
    top, rest = ("todo[-1]", "todo[:-2]") if depth_first else ("todo[1]", "todo[2:]")
    return f"""size AS (SELECT g, count(*) n FROM n GROUP BY g), ks AS (SELECT CAST(k AS INT) walk FROM range({nw}) t(k)),
near AS (SELECT adj.g, walk, adj.v, coalesce(list(x ORDER BY md5(concat_ws('|', {seed}, adj.g, walk, adj.v, x)), x) FILTER (x IS NOT NULL), []) nbrs
  FROM adj CROSS JOIN ks LEFT JOIN LATERAL (SELECT unnest(adj.nbrs) x) ON true GROUP BY adj.g, walk, adj.v),
s AS (SELECT g, walk, 0 k, [{{'v': CAST({sql_u32(str(seed), "g", "walk", "0")} % n AS INT), 'p': -1}}] todo, CAST([] AS INT[]) ids, CAST([] AS INT[]) parents FROM size, ks
  UNION ALL SELECT s.g, s.walk, k + 1,
    CASE WHEN list_contains(ids, ({top}).v) THEN {rest} ELSE list_concat({rest}, [{{'v': x, 'p': ({top}).v}} FOR x IN nb.nbrs IF NOT list_contains(ids, x) AND x <> ({top}).v]) END,
    CASE WHEN list_contains(ids, ({top}).v) THEN ids ELSE list_append(ids, ({top}).v) END,
    CASE WHEN list_contains(ids, ({top}).v) THEN parents ELSE list_append(parents, ({top}).p) END
  FROM s JOIN near nb ON nb.g = s.g AND nb.walk = s.walk AND nb.v = ({top}).v WHERE len(todo) > 0 AND len(ids) < {cap}),
found AS (SELECT g, walk, arg_max(ids, k) ids, arg_max(parents, k) parents FROM s GROUP BY g, walk)"""
