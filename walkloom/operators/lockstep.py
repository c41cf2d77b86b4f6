"""Walks and searches of packed graphs of any size, by numpy over Arrow batches; same rows as the folds of walks.py.

A fold copies its state at each step, which is quadratic in the length of a walk. Here all walks of a batch take each step together, over one
list of edges, and a search keeps a stack or queue of numbers. Every draw and every order comes from the JVM, keyed as in the folds, so
results don't depend on batches, partitions or retries, and no random numbers are made in Python.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.functions.draws import pick, u32
from walkloom.operators import walks

#: Graphs of more nodes than this are searched here, smaller ones by the fold.
BORDER = 16


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


class Edges:
    """The edges of all graphs of a batch: nodes are numbered through, `first` is where a node's neighbours start."""

    def __init__(self, adj: pa.Array, drop_self_loops: bool) -> None:
        near = adj.flatten()
        self.base, self.deg = _ends(_sizes(adj)), _sizes(near)
        u = np.repeat(np.arange(len(self.deg)), self.deg)
        v = near.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(self.base[:-1], np.diff(self.base))[u]
        if drop_self_loops:
            u, v = u[u != v], v[u != v]
            self.deg = np.bincount(u, minlength=len(self.deg))
        self.first, self.u, self.v = _ends(self.deg), u, v

    def sums(self) -> np.ndarray:
        """Of each edge the weights 1 / min(degree here, degree there) of its node's edges up to it, added in their order."""
        out = 1.0 / np.minimum(self.deg[self.u], self.deg[self.v])
        open_ = np.flatnonzero(self.deg > 1)
        k = 1
        while len(open_):
            at = self.first[open_] + k
            out[at] += out[at - 1]
            k += 1
            open_ = open_[self.deg[open_] > k]
        return out

    def below(self, at: np.ndarray, values: np.ndarray, t: np.ndarray, through: bool) -> np.ndarray:
        """How many of the node's values, which ascend, are below t, or with `through` at most t: one binary search for all."""
        low, high = self.first[at].copy(), self.first[at] + self.deg[at]
        while (open_ := low < high).any():
            mid = np.minimum((low + high) // 2, len(values) - 1)
            up = open_ & ((values[mid] <= t) if through else (values[mid] < t))
            low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
        return low - self.first[at]


def _walked(nw: int, weighted: bool, drop_self_loops: bool, strict: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = Edges(batch.column("adj"), drop_self_loops)
            row = np.repeat(np.arange(batch.num_rows), nw)
            base, size = edges.base[row], batch.column("size").to_numpy().astype(np.int64)[row]
            draws, drawn = batch.column("draws").flatten().to_numpy(zero_copy_only=False), _ends(np.maximum(size - 1, 1))
            at = base + batch.column("starts").flatten().to_numpy(zero_copy_only=False)
            ends, back = _ends(size), np.full(len(at), -1)
            ids = np.empty(ends[-1], np.int32)
            ids[ends[:-1]] = at - base
            sums = edges.sums() if weighted else None
            for j in range(1, int(size.max())):
                go = np.flatnonzero(size > j)
                here, draw = at[go], draws[drawn[go] + j - 1]
                deg = edges.deg[here]
                if weighted:
                    total = sums[np.clip(edges.first[here] + deg - 1, 0, None)] if len(sums) else np.zeros(len(go))
                    k = np.minimum(edges.below(here, sums, draw / 4294967296.0 * total, True), deg - 1)
                elif strict:
                    place = edges.below(here, edges.v, back[go], False)
                    there = np.minimum(edges.first[here] + place, max(len(edges.v) - 1, 0))
                    known = (place < deg) & (edges.v[there] == back[go]) & (deg > 1) if len(edges.v) else np.zeros(len(go), bool)
                    k = draw % np.maximum(deg - known, 1)
                    k += known & (k >= place)
                else:
                    k = draw % np.maximum(deg, 1)
                nxt = np.where(deg > 0, edges.v[np.minimum(edges.first[here] + np.maximum(k, 0), len(edges.v) - 1)], here) if len(edges.v) else here
                back[go], at[go] = here, nxt
                ids[ends[go] + j] = nxt - base[go]
            g = batch.column("g").take(pa.array(row))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([g, pa.array(np.tile(np.arange(nw, dtype=np.int32), batch.num_rows)), lists], names=["g", "walk", "ids"])

    return task


def step_walks(graphs: DataFrame, nw: int, length: int | Column, seed: int = 0, weighted: bool = False, drop_self_loops: bool = False, strict: bool = False) -> DataFrame:
    """g, walk, ids: the walks of walks.uniform or, weighted, of walks.mdlr. length may depend on the graph; neighbours stand in ascending order.

    One row a graph travels, with its draws; adjacency isn't repeated for its walks. The weights of a node are added up once a batch, and
    a weighted step is one binary search.
    """
    if weighted and (drop_self_loops or strict):
        raise ValueError("a weighted walk drops nothing")
    size = (length if isinstance(length, Column) else F.lit(length)).cast("int")
    every = F.sequence(F.lit(0), F.lit(nw - 1))
    starts = F.transform(every, lambda w: pick(F.col("n"), seed, F.col("g"), w, 0))
    draws = F.transform(every, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda j: u32(seed, F.col("g"), w, j)))
    rows = graphs.select("g", "adj", F.greatest(size, F.lit(1)).alias("size"), starts.alias("starts"), F.flatten(draws).alias("draws"))
    kind = graphs.schema["g"].dataType.simpleString()
    return rows.mapInArrow(_walked(nw, weighted, drop_self_loops, strict), f"g {kind}, walk int, ids array<int>")


def _traversed(cap: int | None, depth_first: bool) -> Callable:
    def one(flat: list[int], first: list[int], start: int) -> tuple[list[int], list[int]]:
        n = len(first) - 1
        room, seen = min(cap, n) if cap else n, bytearray(n)
        ids, parents, todo = [], [], deque([(start, -1)])
        take = todo.pop if depth_first else todo.popleft
        while todo and len(ids) < room:
            v, p = take()
            if not seen[v]:
                seen[v] = 1
                ids.append(v)
                parents.append(p)
                todo.extend((x, v) for x in flat[first[v] : first[v + 1]] if not seen[x])
        return ids, parents

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("near")
            near, base = lists.flatten(), _ends(_sizes(lists))
            first, flat = _ends(_sizes(near)), near.flatten().to_numpy(zero_copy_only=False)
            found = [one(flat[first[a] : first[b]].tolist(), (first[a : b + 1] - first[a]).tolist(), s) for a, b, s in zip(base[:-1], base[1:], batch.column("start").to_pylist(), strict=True)]
            ids, parents = (pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("walk"), ids, parents], names=["g", "walk", "ids", "parents"])

    return task


def traverse(graphs: DataFrame, nw: int, cap: int | None = None, seed: int = 0, depth_first: bool = True, rank: str | None = None) -> DataFrame:
    """g, walk, ids, parents: the searches of walks.search, with a stack or queue of numbers, in time linear in the edges."""
    rows = walks.started(graphs, nw, seed, rank)
    near = F.transform("adj", lambda near, v: walks.ordered(near, v, seed, rank))
    kind = graphs.schema["g"].dataType.simpleString()
    return rows.select("g", "walk", "start", near.alias("near")).mapInArrow(_traversed(cap, depth_first), f"g {kind}, walk int, ids array<int>, parents array<int>")


def search(graphs: DataFrame, nw: int, cap: int | None = None, seed: int = 0, depth_first: bool = True, rank: str | None = None, border: int = BORDER) -> DataFrame:
    """Searches of graphs of any size: the fold up to `border` nodes, traverse beyond. Both sides read the same shuffle of the packed graphs."""
    small = walks.search(graphs.where(F.col("n") <= border), nw, cap, seed, depth_first, rank)
    return small.unionByName(traverse(graphs.where(F.col("n") > border), nw, cap, seed, depth_first, rank))
