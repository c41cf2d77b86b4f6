"""Graphs as long tables: nodes (g, v, z, ...) and edges (g, u, v); packed: one row a graph with arrays in node order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions import geometry


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select("g", F.explode(ways).alias("e")).select("g", "e.u", "e.v").dropDuplicates(["g", "u", "v"])


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, v, nbrs: sorted distinct out-neighbours, empty for isolated nodes."""
    out = edges.groupBy("g", F.col("u").alias("v")).agg(F.array_sort(F.collect_set("v")).alias("nbrs"))
    return nodes.select("g", "v").join(out, ["g", "v"], "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<int>")))


def degrees(edges: DataFrame) -> DataFrame:
    """Edge count and number of distinct neighbours of each node that has edges."""
    return edges.groupBy("g", F.col("u").alias("v")).agg(F.count("*").alias("n_edges"), F.count_distinct("v").alias("n_nbrs"))


def node_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of nodes, or where a graph has none the largest edge end plus one."""
    a = nodes.groupBy("g").agg(F.count("*").alias("rows"))
    b = edges.groupBy("g").agg((F.max(F.greatest("u", "v")) + 1).cast("long").alias("ends"))
    return a.join(b, "g", "full").select("g", F.coalesce("rows", "ends").alias("n"))


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, n, adj (neighbours by node), z (label by node). Nodes and edges are grouped together and never joined; if both come from one table
    dealt by g, they stay where they are."""
    own = nodes.where("g is not null and v is not null").select("g", "v", F.struct("z").alias("own"), F.lit(None).cast("int").alias("near"))
    out = edges.where("g is not null").select("g", F.col("u").alias("v"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.col("v").cast("int").alias("near"))
    each = own.unionByName(out).groupBy("g", "v").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_set("near")).alias("nbrs")).where("own is not null")
    rows = F.array_sort(F.collect_list(F.struct("v", "nbrs", F.col("own")["z"].alias("z"))))
    return each.groupBy("g").agg(rows.alias("r")).select("g", F.size("r").alias("n"), F.transform("r", lambda x: x["nbrs"]).alias("adj"), F.transform("r", lambda x: x["z"]).alias("z"))


def wl_ranks(nodes: DataFrame, edges: DataFrame, label: Column, rounds: int = 3) -> DataFrame:
    """g, v, c: canonical colours by dense ranks of (own colour, sorted neighbour colours)."""
    adj = adjacency(nodes, edges)
    first = Window.partitionBy("g").orderBy("label", "deg")
    colours = nodes.withColumn("label", F.coalesce(label, F.lit(0))).select("g", "v", "label").join(adj, ["g", "v"]).withColumn("deg", F.size("nbrs"))
    colours = colours.select("g", "v", (F.dense_rank().over(first) - 1).alias("c"))
    pairs = edges.select("g", "u", "v").dropDuplicates()
    again = Window.partitionBy("g").orderBy("c", "near")
    for _ in range(rounds):
        near = pairs.join(colours, ["g", "v"]).groupBy("g", "u").agg(F.array_sort(F.collect_list("c")).alias("near"))
        near = colours.join(near.withColumnRenamed("u", "v"), ["g", "v"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
        colours = near.select("g", "v", (F.dense_rank().over(again) - 1).alias("c"))
    return colours


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def wl_ranks_packed(graphs: DataFrame, rounds: int = 3) -> DataFrame:
    """g, rank: the colours of wl_ranks by label z as an array in node order, of packed graphs, without a shuffle a round. Graphs too large for
    one row go through wl_ranks."""
    def dense(keys: Column) -> Column:
        return _let(keys, lambda k: _let(F.array_sort(F.array_distinct(k)), lambda order: F.transform(k, lambda x: (F.array_position(order, x) - 1).cast("int"))))

    rank = dense(F.transform("adj", lambda near, v: F.struct(F.coalesce(F.get("z", v), F.lit(0)).alias("c"), F.size(near).alias("near"))))
    if rounds:
        rank = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), rank, lambda c, _: dense(F.transform("adj", lambda near, v: F.struct(F.get(c, v).alias("c"), F.array_sort(F.transform(near, lambda x: F.get(c, x))).alias("near")))))
    return graphs.select("g", rank.alias("rank"))


def wl_keys(nodes: DataFrame, edges: DataFrame, label: Column, rounds: int = 2) -> DataFrame:
    """g, wl_key: a hash equal for graphs with the same labels and neighbourhoods, in any node order."""
    colours = nodes.select("g", "v", F.md5(label.cast("string")).alias("c"))
    pairs = edges.select("g", "u", "v").dropDuplicates()
    for _ in range(rounds):
        near = pairs.join(colours, ["g", "v"]).groupBy("g", "u").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("near")).withColumnRenamed("u", "v")
        colours = colours.join(near, ["g", "v"], "left").select("g", "v", F.md5(F.concat_ws(";", "c", F.coalesce("near", F.lit("")))).alias("c"))
    return colours.groupBy("g").agg(F.md5(F.array_join(F.array_sort(F.collect_list("c")), ",")).alias("wl_key"))


def rwse(nodes: DataFrame, edges: DataFrame, steps: int = 3, joins: bool = False) -> DataFrame:
    """g, v, step, p: probability that a uniform walk is back at its start after 1..steps steps, by powers of packed graphs. joins: by joins, for few
    steps on graphs that don't fit one row."""
    if not joins:
        from walkloom.operators import spectra

        return spectra.rwse(packed(nodes, edges), steps).select("g", "v", F.posexplode("p").alias("step", "p")).withColumn("step", F.col("step") + 1)
    pairs = edges.select("g", "u", "v").dropDuplicates()
    share = pairs.join(pairs.groupBy("g", "u").agg(F.count("*").alias("d")), ["g", "u"]).select("g", F.col("u").alias("i"), F.col("v").alias("j"), (1.0 / F.col("d")).alias("p"))
    at, found = share, []
    for k in range(1, steps + 1):
        found.append(at.where("i = j").select("g", F.col("i").alias("v"), F.lit(k).alias("step"), "p"))
        nxt = share.select("g", F.col("i").alias("j"), F.col("j").alias("to"), F.col("p").alias("q"))
        at = at.join(nxt, ["g", "j"]).groupBy("g", "i", F.col("to").alias("j")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    every = nodes.select("g", "v", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    hit = found[0]
    for x in found[1:]:
        hit = hit.unionByName(x)
    return every.join(hit, ["g", "v", "step"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def pair_distances(nodes: DataFrame) -> DataFrame:
    """g, u, v, dist for all ordered pairs of a graph."""
    a, b = nodes.select("g", F.col("v").alias("u"), F.col("pos").alias("p")), nodes.select("g", "v", F.col("pos").alias("q"))
    return a.join(b, "g").select("g", "u", "v", geometry.distance(F.col("p"), F.col("q")).alias("dist"))


def looked_up_bonds(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """Bond type of (u, v), else of (v, u), else 0; of repeated raw pairs the last counts."""
    last = raw.groupBy("g", "u", "v").agg(F.max_by("bond_type", "ord").alias("bond"))
    back = last.select("g", F.col("u").alias("v"), F.col("v").alias("u"), F.col("bond").alias("bond_back"))
    return pairs.join(last, ["g", "u", "v"], "left").join(back, ["g", "u", "v"], "left").select("g", "u", "v", F.coalesce("bond", "bond_back", F.lit(0)).alias("bond"))


def laplacian_eigs(nodes: DataFrame, edges: DataFrame, k: int = 4) -> DataFrame:
    """g, v, raw, scaled, values: the first k eigenpairs of the normalised Laplacian, zero-padded; vectors up to sign."""
    from walkloom.operators import spectra

    return spectra.laplacian_eigs(packed(nodes, edges), k)


def laplacian_residuals(nodes: DataFrame, edges: DataFrame, k: int = 4) -> DataFrame:
    """g, k, norm, residual, overlap: how far the pairs of laplacian_eigs are from orthonormal eigenpairs."""
    from walkloom.operators import spectra

    return spectra.laplacian_residuals(packed(nodes, edges), k)
