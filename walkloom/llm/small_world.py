"""A hierarchical navigable small-world graph over one shard of unit vectors, built and searched for many vectors at once with numpy.

Vectors are ordered by level, so a layer is a prefix. The top layer is searched in full, every other one by a beam that starts from the best
of the layer above. A layer takes its upper part by exact comparison and then batches of twice its size at most; links are chosen for
diversity first (a candidate counts if no nearer chosen one is nearer to it than the vector itself), the rest filled with the nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a vector in each layer; each layer has so many times fewer vectors than the one below; a layer this small is searched in full.
DEGREE, SHRINK, TOP = 16, 16, 512
#: Beam while linking, entries from one layer into the next, and vectors that move together.
BUILD_BEAM, ENTRIES, TOGETHER = 32, 4, 1024
#: Cells of the table of visited vectors, and floats of gathered vectors.
SEEN_CELLS, GATHERED = 1 << 24, 1 << 23


@dataclass
class Graph:
    x: np.ndarray
    links: list[np.ndarray]  # of each layer but the top one, from the lowest: neighbours of a prefix of x, -1 fills up
    top: int


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, live: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of the best found for each q among the first `live` vectors, unordered; -1 where there are fewer."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), live + 1), bool)
    seen[:, live] = True
    ids = np.full((len(q), max(beam, entry.shape[1])), -1)
    sims, todo = np.full(ids.shape, -np.inf, np.float32), np.zeros(ids.shape, bool)
    ids[:, : entry.shape[1]], todo[:, : entry.shape[1]] = entry, entry >= 0
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.matmul(x[entry], q[:, :, None])[:, :, 0], -np.inf)
    seen[rows[:, None], entry] = True
    while len(rows):
        best = np.where(todo[rows], sims[rows], -np.inf)
        at = best.argmax(axis=1)
        open_ = best[np.arange(len(rows)), at] > -np.inf
        rows, at = rows[open_], at[open_]
        if not len(rows):
            break
        todo[rows, at] = False
        near = links[ids[rows, at]]
        near = np.where((near >= 0) & (near < live), near, live)
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        near = np.where(fresh, near, 0)
        s = np.where(fresh, np.matmul(x[near], q[rows][:, :, None])[:, :, 0], -np.inf)
        every = np.concatenate((sims[rows], s), axis=1)
        keep = np.argpartition(-every, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
        sims[rows] = np.take_along_axis(every, keep, 1)
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], near), axis=1), keep, 1)
        todo[rows] = np.take_along_axis(np.concatenate((todo[rows], fresh), axis=1), keep, 1)
    return np.where(sims > -np.inf, ids, -1), sims


def _nearest(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _chosen(x: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """DEGREE links of each row's candidates (-1 or -inf: none)."""
    out = np.full((len(ids), DEGREE), -1, np.int32)
    step = max(1, GATHERED // (ids.shape[1] * x.shape[1]))
    for a in range(0, len(ids), step):
        order = np.argsort(-sims[a : a + step], axis=1, kind="stable")
        c, s = np.take_along_axis(ids[a : a + step], order, 1), np.take_along_axis(sims[a : a + step], order, 1)
        v = x[np.maximum(c, 0)]
        apart = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(c.shape, bool)
        for r in range(c.shape[1]):
            covered = np.where(taken, apart[:, r], -np.inf).max(axis=1)
            taken[:, r] = (s[:, r] > -np.inf) & (s[:, r] > covered) & (taken.sum(axis=1) < DEGREE)
        rank = np.where(taken, 0, 1) * c.shape[1] + np.arange(c.shape[1]) + np.where(s > -np.inf, 0, 4 * c.shape[1])
        pick = np.argsort(rank, axis=1)[:, :DEGREE]
        out[a : a + step, : pick.shape[1]] = np.where(np.take_along_axis(s, pick, 1) > -np.inf, np.take_along_axis(c, pick, 1), -1)
    return out


def _linked_back(x: np.ndarray, links: np.ndarray, first: int, end: int) -> None:
    """Links from the neighbours of the new vectors back to them, chosen anew where they no longer fit."""
    q, k = np.nonzero(links[first:end] >= 0)
    q += first
    c = links[q, k]
    s = np.einsum("ij,ij->i", x[q], x[c])
    order = np.lexsort((-s, c))
    q, c, s = q[order], c[order], s[order]
    owner, start = np.unique(c, return_index=True)
    rank = np.arange(len(c)) - np.repeat(start, np.diff(start, append=len(c)))
    row, keep = np.repeat(np.arange(len(owner)), np.diff(start, append=len(c))), rank < DEGREE
    ids, sims = np.full((len(owner), 2 * DEGREE), -1), np.full((len(owner), 2 * DEGREE), -np.inf, np.float32)
    ids[row[keep], rank[keep]], sims[row[keep], rank[keep]] = q[keep], s[keep]
    old = links[owner]
    for a in range(0, len(owner), TOGETHER):
        own, o = owner[a : a + TOGETHER], old[a : a + TOGETHER]
        known = (o >= 0) & ~(o[:, :, None] == ids[a : a + TOGETHER, None, :DEGREE]).any(axis=2)
        ids[a : a + TOGETHER, DEGREE:] = np.where(known, o, -1)
        sims[a : a + TOGETHER, DEGREE:] = np.where(known, np.matmul(x[np.maximum(o, 0)], x[own][:, :, None])[:, :, 0], -np.inf)
    links[owner] = _chosen(x, ids, sims)


def built(x: np.ndarray) -> Graph:
    """The graph of unit vectors (float32); places in x decide levels, so x should be in random order."""
    sizes = [len(x)]
    while sizes[-1] > TOP:
        sizes.append(max(1, sizes[-1] // SHRINK))
    graph = Graph(x, [], sizes[-1])
    for level in range(len(sizes) - 2, -1, -1):
        n, upper = sizes[level], sizes[level + 1]
        links = np.full((n, DEGREE), -1, np.int32)
        for a in range(0, upper, TOGETHER):
            sims = x[a : min(a + TOGETHER, upper)] @ x[:upper].T
            sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
            near = _nearest(sims, 2 * DEGREE)
            links[a : a + len(sims)] = _chosen(x, near, np.take_along_axis(sims, near, 1))
        first = upper
        while first < n:
            end = min(n, 2 * first, first + TOGETHER)
            q = x[first:end]
            ids, sims = _searched(graph, links, q, BUILD_BEAM, first)
            own = q @ q.T
            own[np.arange(len(q)), np.arange(len(q))] = -np.inf
            near = _nearest(own, DEGREE)
            ids = np.concatenate((ids, near + first), axis=1)
            links[first:end] = _chosen(x, ids, np.concatenate((sims, np.take_along_axis(own, near, 1)), axis=1))
            _linked_back(x, links, first, end)
            first = end
        graph.links.insert(0, links)
    return graph


def _searched(graph: Graph, links: np.ndarray | None, q: np.ndarray, beam: int, live: int) -> tuple[np.ndarray, np.ndarray]:
    """Down through the finished layers and, if given, into a layer of which the first `live` vectors are linked."""
    step = max(1, min(TOGETHER, SEEN_CELLS // (len(graph.x) + 1)))
    out = []
    for a in range(0, len(q), step):
        part = q[a : a + step]
        sims = part @ graph.x[: graph.top].T
        ids = _nearest(sims, ENTRIES if graph.links or links is not None else beam)
        sims = np.take_along_axis(sims, ids, 1)
        layers = [(x, len(x)) for x in reversed(graph.links)] + ([(links, live)] if links is not None else [])
        for k, (layer, n) in enumerate(layers):
            if ids.shape[1] > ENTRIES:
                ids = np.take_along_axis(ids, _nearest(sims, ENTRIES), 1)
            ids, sims = _beam(graph.x, layer, part, ids, beam if k == len(layers) - 1 else 2 * ENTRIES, n)
        out.append((ids, sims))
    return np.concatenate([i for i, _ in out]), np.concatenate([s for _, s in out])


def search(graph: Graph, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (-1: none) and similarities of about the nearest `beam` vectors of each q, unordered."""
    return _searched(graph, None, q, beam, 0)
