"""Vectorised text helpers used inside Arrow tasks: words, their hashes, and word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = U(0x5851F42D4C957F2D)
_tables: dict[str, np.ndarray] = {}
#: Bytes of text whose spans are hashed at a time.
_BLOCK = (1 << 18) - 1
_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_exact = np.arange(1, 257, dtype=np.uint64)
_lower = np.arange(256, dtype=np.uint64)
_lower[ord("A") : ord("Z") + 1] += U(32)
_lower += U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd constants, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GAP + U(salt)) | U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if len(_tables.get("up", ())) < n:
        n = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(n, U(base))
            out[0] = U(1)
            _tables[name] = np.multiply.accumulate(out)
    return _tables["up"], _tables["down"]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; one row at least."""
    col = batch.column(column)
    size = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), float)) + 64)
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 places where they start; a null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the texts."""
    space = _is_space[raw]
    inner = ~space
    first = inner.copy()
    first[1:] &= space[:-1]
    last = inner.copy()
    last[:-1] &= space[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inner[cuts]
    last[cuts - 1] = inner[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, at)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the bytes (A-Z lowered, if asked for) from each begin to its end; both ascend. Spans are taken in blocks of about
    `_BLOCK` bytes, one span at least, as each byte takes 40 more while its block is hashed."""
    codes, out, i = _lower if lower else _exact, np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        start = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, start + _BLOCK, side="right")))
        block, a, b = raw[start : int(end[j - 1])], begin[i:j] - start, end[i:j] - start
        up, down = _powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(codes[block] * up[: len(block)], out=sums[1:])
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _GAP)
        i = j
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lowered, split at ASCII white space) and the word offsets of the texts."""
    raw, at = text_bytes(texts)
    begin, end, offsets = word_spans(raw, at)
    return span_hashes(raw, begin, end), offsets


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's `width`-word shingles (of its whole sequence if shorter) and their offsets; repeats stay."""
    factor, count = seeds(width, 11), np.diff(offsets)
    total = len(words) - width + 1
    n_out = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    out_at = np.concatenate(([0], np.cumsum(n_out)))
    out = np.empty(out_at[-1], np.uint64)
    long = np.flatnonzero(count >= width)
    if len(long):
        rolled = np.zeros(total, np.uint64)
        for k in range(width):
            rolled += words[k : k + total] * factor[k]
        reps = n_out[long]
        step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out[np.repeat(out_at[long], reps) + step] = rolled[np.repeat(offsets[long], reps) + step]
    for k in np.flatnonzero((count > 0) & (count < width)):
        own = words[offsets[k] : offsets[k + 1]]
        out[out_at[k]] = np.concatenate((own * factor[: len(own)], seeds(len(own), 5)[-1:])).sum(dtype=np.uint64)
    return mix(out), out_at
