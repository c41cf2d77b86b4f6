"""Random walks and graph searches over packed graphs (g, n, adj), as folds inside the row: no shuffle after packing.

Every result row is a walk: g, walk, ids (nodes in order). Starts are uniform over the nodes, canonical searches excepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.functions.draws import key, pick, u32


def _starts(graphs: DataFrame, nw: int, seed: int) -> DataFrame:
    walks = graphs.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(nw - 1))))
    return walks.withColumn("start", pick(F.col("n"), seed, F.col("g"), F.col("walk"), 0))


def _last(ids: Column) -> Column:
    return F.element_at(ids, -1)


def uniform(graphs: DataFrame, nw: int, length: int | Column, seed: int = 0, drop_self_loops: bool = False, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Walks of `length` nodes; a node without neighbours keeps the walk in place. strict: no step straight back unless it is the only one.
    keep: columns of the graphs that go with their walks."""
    size = length if isinstance(length, Column) else F.lit(length)

    def step(ids: Column, j: Column) -> Column:
        near = F.get("adj", _last(ids))
        if drop_self_loops:
            near = F.filter(near, lambda x: x != _last(ids))
        if strict:
            back = F.when(F.size(ids) > 1, F.element_at(ids, -2)).otherwise(-1)
            other = F.filter(near, lambda x: x != back)
            near = F.when(F.size(other) > 0, other).otherwise(near)
        nxt = F.when(F.size(near) > 0, F.get(near, pick(F.size(near), seed, F.col("g"), F.col("walk"), j))).otherwise(_last(ids))
        return F.concat(ids, F.array(nxt))

    ids = F.when(size > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.array("start"), step)).otherwise(F.array("start"))
    return _starts(graphs, nw, seed).select("g", "walk", ids.alias("ids"), *keep)


def mdlr(graphs: DataFrame, nw: int, length: int | Column, seed: int = 0) -> DataFrame:
    """Walks with steps in proportion to 1 / min(degree here, degree there)."""
    size = length if isinstance(length, Column) else F.lit(length)

    def step(ids: Column, j: Column) -> Column:
        near = F.get("adj", _last(ids))
        weight = F.transform(near, lambda x: 1.0 / F.least(F.size(near), F.size(F.get("adj", x))))
        cum = F.transform(weight, lambda w, k: F.aggregate(F.slice(weight, 1, k + 1), F.lit(0.0), lambda a, b: a + b))
        u = u32(seed, F.col("g"), F.col("walk"), j) / F.lit(4294967296.0)
        at = F.size(F.filter(cum, lambda c: c <= u * _last(cum)))
        nxt = F.when(F.size(near) > 0, F.get(near, F.least(at, F.size(near) - 1))).otherwise(_last(ids))
        return F.concat(ids, F.array(nxt))

    ids = F.when(size > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), F.array("start"), step)).otherwise(F.array("start"))
    return _starts(graphs, nw, seed).select("g", "walk", ids.alias("ids"))


def started(graphs: DataFrame, nw: int, seed: int, rank: str | None) -> DataFrame:
    """A row for each search, with its start: drawn, or with rank the node of the smallest (rank, node)."""
    rows = _starts(graphs, nw, seed)
    if rank:
        best = F.array_min(F.transform(rank, lambda r, v: F.struct(r.alias("r"), v.alias("v"))))
        rows = rows.withColumn("start", best["v"])
    return rows


def ordered(near: Column, node: Column, seed: int, rank: str | None) -> Column:
    """The neighbours of a node in the order in which a search pushes them."""
    if rank:
        return F.transform(F.array_sort(F.transform(near, lambda x: F.struct((-F.get(rank, x)).alias("k"), (-x).alias("m")))), lambda s: -s["m"])
    return F.transform(F.array_sort(F.transform(near, lambda x: F.struct(key(seed, F.col("g"), F.col("walk"), node, x).alias("k"), x.alias("m")))), lambda s: s["m"])


def search(graphs: DataFrame, nw: int, cap: int | None = None, seed: int = 0, depth_first: bool = True, rank: str | None = None) -> DataFrame:
    """Search orders with the parent of each node (-1 for the start): g, walk, ids, parents.

    Nodes are marked when taken, so a stack may hold a node twice and the last push wins. Unvisited neighbours are pushed in an order keyed
    by (seed, graph, walk, node, neighbour). With `rank` (an array column of node ranks) the search is canonical: it starts at the smallest
    (rank, node) and visits neighbours in that order, without draws. Only the start's component is visited.
    """
    rows = started(graphs, nw, seed, rank)
    room = F.lit(cap) if cap else F.col("n")
    first = F.struct(F.array(F.struct(F.col("start").alias("v"), F.lit(-1).alias("p"))).alias("todo"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<int>").alias("parents"))

    def step(s: Column, _: Column) -> Column:
        top = F.element_at(s["todo"], -1 if depth_first else 1)
        rest = F.slice(s["todo"], 1, F.size(s["todo"]) - 1) if depth_first else F.slice(s["todo"], 2, F.size(s["todo"]))
        node = top["v"]
        fresh = F.filter(F.get("adj", node), lambda x: ~F.array_contains(s["ids"], x) & (x != node))
        push = F.transform(ordered(fresh, node, seed, rank), lambda x: F.struct(x.alias("v"), node.alias("p")))
        done = (F.size(s["todo"]) == 0) | (F.size(s["ids"]) >= room)
        seen = F.array_contains(s["ids"], node)
        return F.when(done, s).otherwise(F.when(seen, F.struct(rest.alias("todo"), s["ids"].alias("ids"), s["parents"].alias("parents"))).otherwise(F.struct(F.concat(rest, push).alias("todo"), F.concat(s["ids"], F.array(node)).alias("ids"), F.concat(s["parents"], F.array(top["p"])).alias("parents"))))

    pops = F.aggregate("adj", F.lit(0), lambda a, x: a + F.size(x))
    out = F.aggregate(F.sequence(F.lit(0), pops), first, step)
    return rows.select("g", "walk", out.alias("s")).select("g", "walk", "s.ids", "s.parents")


def padded(walks: DataFrame, most: int, pad: int = -1) -> DataFrame:
    """ids filled up to `most` with pad, and the true length."""
    return walks.select("g", "walk", F.size("ids").alias("length"), F.concat("ids", F.array_repeat(F.lit(pad), F.greatest(F.lit(most) - F.size("ids"), F.lit(0)))).alias("ids"))


def steps(walks: DataFrame) -> DataFrame:
    """Long form: g, walk, pos, node."""
    # the outer form, as the other makes the optimizer test ids for null and size first, which runs the walk's expression three times
    return walks.select("g", "walk", F.posexplode_outer("ids").alias("pos", "node")).where("pos is not null")


KINDS = {"walk": "uniform", "walk_ada": "uniform", "mdlr": "mdlr", "mdlr_ada": "mdlr", "rum": "uniform", "rum_ada": "uniform", "search": "search", "search_bfs": "search"}


def sample(kind: str, graphs: DataFrame, nw: int, length: int, seed: int = 0) -> DataFrame:
    """Walks of a named kind, of graphs of any size; adaptive kinds have as many nodes as the graph. An unknown kind is an error."""
    from walkloom.operators import lockstep

    if kind not in KINDS:
        raise ValueError(f"unknown walk kind {kind!r}")
    if KINDS[kind] == "search":
        return lockstep.search(graphs, nw, length, seed, depth_first=kind == "search").select("g", "walk", "ids")
    size = F.col("n") if kind.endswith("_ada") else length
    return lockstep.step_walks(graphs, nw, size, seed, weighted=KINDS[kind] == "mdlr")
