"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are computed once. Random Fourier features approximate a Gaussian kernel over them; the normal equations of
the ridge fit are summed per partition, then over groups of partitions, and solved on the driver (their size is fixed). Raw scores of the
labelled rows are counted in fixed bins and pooled into a monotone map to probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import summed, whole_text, written
from .textkit import shingles, slices, text_bytes, word_hashes, word_spans

#: Random features, ridge weight, kernel width in standard deviations, and bins of the calibration.
FEATURES, RIDGE, WIDTH, BINS = 192, 1e-3, 4.0, 1200
THRESHOLD = 0.3
_CLASSES = ("upper", "lower", "digit", "mark", "symbol", "pipe", "bang", "high", "space", "line", "stop", "comma")


def _tables() -> np.ndarray:
    """Byte classes: a row of 0/1 for each of _CLASSES."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!\"'(),-./:;?[]{}", "#$%&*+<=>@\\^_`~|", "|", "!", "", " \t\x0b\x0c\r\n", "\n", ".", ","]
    out = np.zeros((len(groups), 256), np.float32)
    for row, chars in zip(out, groups, strict=True):
        row[[ord(c) for c in chars]] = 1
    out[7, 128:] = 1
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of document statistics for each text; zeros for an empty one."""
    raw, at = text_bytes(texts)
    size = np.diff(at).astype(float)
    begin, end, words_at = word_spans(raw, at)
    n_words = np.diff(words_at).astype(float)

    def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    per_byte, per_word = np.maximum(size, 1), np.maximum(n_words, 1)
    counts = [per_text(row[raw], at) for row in _tables()]
    share = dict(zip(_CLASSES, (c / per_byte for c in counts), strict=True))
    last = raw[end - 1] if len(end) else raw[:0]
    tables = _tables()
    word_len = (end - begin).astype(float)
    hashes, offsets = word_hashes(texts)
    sh, sh_at = shingles(hashes, offsets, 3)

    def distinct(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        fresh = np.ones(len(v), bool)
        fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o, weights=fresh, minlength=len(offs) - 1) / np.maximum(np.diff(offs), 1)

    mean_len = per_text(word_len, words_at) / per_word
    columns = [
        np.log1p(size), np.log1p(n_words), mean_len, np.sqrt(np.maximum(per_text(word_len**2, words_at) / per_word - mean_len**2, 0)),
        *(share[c] for c in _CLASSES),
        share["upper"] / np.maximum(share["upper"] + share["lower"], 1e-9),
        per_text(tables[4][last], words_at) / per_word, per_text(tables[6][last], words_at) / per_word, per_text(tables[10][last], words_at) / per_word,
        counts[9] / per_word, distinct(hashes, offsets), distinct(sh, sh_at),
    ]
    return np.where(np.isfinite(out := np.stack(columns, axis=1)), out, 0.0)


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            stats = statistics(part.column("text"))
            n, k = stats.shape
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(stats.ravel()))], names=["doc_id", "held_out", "stats"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("stats")
    return col.flatten().to_numpy().reshape(batch.num_rows, -1)


class Model:
    """Scores statistics; without labels of both kinds it says the share of good labels (0.5 without any) for every text."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(20)
        self.w = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.coef: np.ndarray | None = None
        self.knots = (np.array([0.0]), np.array([0.5]))

    def inputs(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.inputs(stats) @ self.coef

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.coef is None:
            return np.full(len(stats), self.knots[1][0])
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def isotonic(n: np.ndarray, good: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; knots (place, probability) for linear interpolation."""
    pools: list[list[float]] = []
    for k, g, c in zip(n, good, centre, strict=True):
        if k:
            pools.append([g, k, c * k])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                top = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    x, y = np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])
    return x, y


def fit(train: DataFrame) -> Model:
    """A model from rows of stats (array<double>) and label (0 or 1)."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.concatenate(([len(x)], x.sum(0), (x**2).sum(0), [np.sum(batch.column("label").to_numpy())]))

    m = summed(train, moments)
    if m is None:
        return Model(np.zeros(1), np.ones(1))
    n, k = m[0], (len(m) - 2) // 2
    mean = m[1 : k + 1] / n
    model = Model(mean, np.sqrt(np.maximum(m[k + 1 : 2 * k + 1] / n - mean**2, 1e-12)) + 1e-6)
    if m[-1] in (0, n):
        model.knots = (np.array([0.0]), np.array([m[-1] / n]))
        return model

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        x = model.inputs(_matrix(batch))
        return np.concatenate(((x.T @ x).ravel(), x.T @ batch.column("label").to_numpy().astype(float)))

    sums = summed(train, normal)
    size = int((len(sums) + 0.25) ** 0.5)
    model.coef = np.linalg.solve(sums[: size * size].reshape(size, size) + RIDGE * n * np.diag([*([1.0] * (size - 1)), 0.0]) + 1e-9 * np.eye(size), sums[size * size :])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(batch)) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        y = batch.column("label").to_numpy().astype(float)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)))

    hist = summed(train, binned)
    model.knots = isotonic(hist[:BINS], hist[BINS:], (np.arange(BINS) + 0.5) / BINS * 3 - 1)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Labels are learned only from ids whose crc32 (as text) mod 5 is not 0; all of them, no sample. Only the text is an input. An id with several
    labels takes the smallest; null labels and labels of unknown ids count for nothing. Null and empty texts are scored like others, from
    statistics of zero. A null id has held_out null and no label. Columns besides these are not read. An empty table gives no rows.
    """
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), (F.crc32(doc.cast("string")) % 5 == 0).alias("held_out"), whole_text(text_col).alias("text"))
    stats = written(rows.mapInArrow(_stat_rows, "doc_id long, held_out boolean, stats array<double>"), "stats")
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    train = written(stats.where("not held_out").join(known, "doc_id").select("stats", "label"), "train")
    model = fit(train)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")
