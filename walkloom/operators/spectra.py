"""Dense work on many small graphs: graphs of one size in an Arrow batch are stacked, so numpy runs over (count, n, n) at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from walkloom.operators.lockstep import Edges

#: Numbers in a stack (8 MB); a larger single graph is a stack of its own. Graphs taken from a batch at a time.
CELLS, ROWS = 1 << 20, 1024


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch and their 0/1 adjacency, one size after another."""
    edges = Edges(batch.column("adj"), False)
    n = np.diff(edges.base)
    row = np.repeat(np.arange(len(n)), n)
    first = edges.first[edges.base]
    for size in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == size)
        step = max(1, CELLS // int(size * size))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            a = np.zeros((len(some), size, size))
            at = np.concatenate([np.arange(first[r], first[r + 1]) for r in some])
            own = row[edges.u[at]]
            a[np.searchsorted(some, own), edges.u[at] - edges.base[own], edges.v[at] - edges.base[own]] = 1
            yield some, a


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a table as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _named(batch: pa.RecordBatch, rows: np.ndarray, size: int) -> list[pa.Array]:
    return [batch.column("g").take(pa.array(np.repeat(rows, size))), pa.array(np.tile(np.arange(size, dtype=np.int32), len(rows)))]


def _pairs(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each stack its rows, its adjacency, and the first k vectors and values, zero-padded."""
    for rows, a in _stacks(batch):
        size = a.shape[1]
        d = a.sum(axis=2)
        s = 1 / np.sqrt(np.where(d > 0, d, 1))
        values, vectors = np.linalg.eigh(np.eye(size) - s[:, :, None] * a * s[:, None, :])
        raw, top = np.zeros((len(rows), size, k)), np.zeros((len(rows), k))
        raw[:, :, : min(size, k)] = vectors[:, :, :k]
        top[:, : min(size, k)] = values[:, :k]
        yield rows, a, raw, top


def _eigen(k: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            for rows, a, raw, top in _pairs(batch, k):
                size = a.shape[1]
                lo, hi = raw.min(axis=1, keepdims=True), raw.max(axis=1, keepdims=True)
                scaled = np.where(hi > lo, 2 * (raw - lo) / np.where(hi > lo, hi - lo, 1) - 1, np.where(lo == 1, 1.0, -1.0))
                yield pa.RecordBatch.from_arrays([*_named(batch, rows, size), _lists(raw.reshape(-1, k)), _lists(scaled.reshape(-1, k)), _lists(np.repeat(top, size, axis=0))], names=["g", "v", "raw", "scaled", "values"])

    return task


def laplacian_eigs(graphs: DataFrame, k: int = 4) -> DataFrame:
    """g, v, raw, scaled, values of packed graphs: the first k eigenpairs of the normalised Laplacian, zero-padded; vectors up to sign."""
    kind = graphs.schema["g"].dataType.simpleString()
    return graphs.select("g", "adj").mapInArrow(_eigen(k), f"g {kind}, v int, raw array<double>, scaled array<double>, values array<double>")


def _residuals(k: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            for rows, a, x, values in _pairs(batch, k):
                r = np.sqrt(np.maximum(a.sum(axis=2), 1))[:, :, None]
                off = np.abs(x - a @ (x / r) / r - values[:, None, :] * x).max(axis=1)
                dots = np.abs(x.transpose(0, 2, 1) @ x)
                norm = np.sqrt(np.einsum("bii->bi", dots))
                dots[:, np.arange(k), np.arange(k)] = 0
                g, at = batch.column("g").take(pa.array(np.repeat(rows, k))), np.tile(np.arange(k, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([g, *map(pa.array, (at, norm.ravel(), off.ravel(), dots.max(axis=2).ravel()))], names=["g", "k", "norm", "residual", "overlap"])

    return task


def laplacian_residuals(graphs: DataFrame, k: int = 4) -> DataFrame:
    """g, k, norm, residual, overlap of packed graphs: of each pair that laplacian_eigs gives, the vector's length, the largest |Lx - value x| and
    the largest product with another vector, from the graph's edges and in the task that finds the pair, so that no vector is dealt out."""
    kind = graphs.schema["g"].dataType.simpleString()
    return graphs.select("g", "adj").mapInArrow(_residuals(k), f"g {kind}, k int, norm double, residual double, overlap double")


def _returns(steps: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            for rows, a in _stacks(batch):
                size, d = a.shape[1], a.sum(axis=2, keepdims=True)
                move = a / np.where(d > 0, d, 1)
                at, found = move, []
                for step in range(steps):
                    at = at if step == 0 else at @ move
                    found.append(np.einsum("bii->bi", at))
                yield pa.RecordBatch.from_arrays([*_named(batch, rows, size), _lists(np.stack(found, axis=2).reshape(-1, steps))], names=["g", "v", "p"])

    return task


def rwse(graphs: DataFrame, steps: int) -> DataFrame:
    """g, v, p of packed graphs: p holds the probabilities that a uniform walk is back at its start after 1..steps steps."""
    kind = graphs.schema["g"].dataType.simpleString()
    return graphs.select("g", "adj").mapInArrow(_returns(steps), f"g {kind}, v int, p array<double>")
