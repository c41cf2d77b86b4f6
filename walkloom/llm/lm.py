"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Texts are tokenised once into chunks (a row holds about a million tokens as places in the chunk's own dictionary, and the dictionary).
Words are counted over all chunks; counts of words outside the head return to their chunks by a join, the head's by a broadcast.

The model's output is a tree over the whole vocabulary, so probabilities are normalised exactly: a group, a leaf in the group, and a word in
the leaf. A leaf is one frequent word, or all other words of one ending (known ones by their counts, and one unknown word). Both upper levels are
log-bilinear in the tokens before. The numbers of leaves and of words with an input vector grow with the square root of the vocabulary,
that of groups with its fourth root. Every chunk of training texts takes part in training: tasks start from the same parameters, train on
a few million tokens each in numpy, and parameters (with their step lengths) are averaged. Scores come from batched matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import summed, whole_text, written
from .textkit import slices, span_hashes, text_bytes, word_spans

#: Vector size, tokens before, least number of groups, words with an input vector for each leaf.
SIZE, BEFORE, LEAST, KNOWN = 24, 4, 16, 4
#: Noise tokens a step on each level, most and least tokens a step, step length.
NOISE, BATCH, SMALL_BATCH, RATE = 16, 16384, 2048, 0.1
#: Training tokens of one task; corpora below this size are passed over several times by one task.
LOT = 4_000_000
#: Passes over a corpus of less than a lot: as many as reach this number of tokens, within limits.
LEAST_PASSES, MOST_PASSES = 3, 12
FORMS = 4096  # word endings are told apart by 12 bits, the highest of a word's 64; F.expr and numpy agree on them
CHUNK = 1 << 23
_CHUNKS = "chunk long, docs array<long>, held array<boolean>, sizes array<int>, tokens binary, words array<long>, counts array<int>"
_PLACE = 1 << 24  # a chunk has fewer dictionary words than this
F32 = np.float32
_LOW = np.uint64((1 << 52) - 1)
END = 7046029254386353131 & int(_LOW)  # the dictionary word of the end token


def _planes(tokens: np.ndarray) -> bytes:
    """Places as four planes of bytes, of which the upper ones are nearly all zeros."""
    return tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word, the ending's first, and the word offsets of the texts."""
    raw, at = text_bytes(texts)
    begin, end, offsets = word_spans(raw, at)
    h = span_hashes(raw, begin, end)
    form = np.zeros(len(end), np.uint64)
    for k in (1, 2, 3):
        inside = end - k >= begin
        form = form * np.uint64(263) + np.where(inside, raw[np.maximum(end - k, 0)] | 32, 0).astype(np.uint64)
    form = (form * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    return ((h & _LOW) | (form << np.uint64(52))).view(np.int64), offsets


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 20
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            found, at = _words(part.column("text"))
            n = np.diff(at)
            codes, words = pd.factorize(np.insert(found, at[1:], END))  # an end token after each text
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small places, which pack well
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            tokens = place[codes]
            train = np.repeat(~part.column("held_out").fill_null(False).to_numpy(zero_copy_only=False), n + 1)
            counts = np.bincount(tokens[train], minlength=len(words)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"chunk": [number], "docs": [part.column("doc_id").to_pylist()], "held": [part.column("held_out").to_pylist()], "sizes": pa.array([(n + 1).astype(np.int32)], pa.list_(pa.int32())), "tokens": [_planes(tokens)], "words": pa.array([words[order]], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int32()))})
            number += 1


def _forms(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(52)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_shares(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its own column."""
    np.clip(logits, -80, 80, out=logits)
    at = logits[np.arange(len(logits)), own].astype(float)
    return at - np.log(np.exp(logits, out=logits).sum(axis=1))


class Model:
    """The tree and its parameters. words: the most frequent ones with their counts, in descending order; forms: counts of all known words
    by ending, and their number."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, vocabulary: int, form_tokens: np.ndarray, form_words: np.ndarray):
        self.groups = groups(vocabulary)
        self.leaves, self.known = self.groups**2, KNOWN * self.groups**2
        self.singles = min(self.leaves // 2, len(words))
        self.endings = self.leaves - self.leaves // 2
        order = np.argsort(words)
        self.words, self.rank = words[order], order
        ending = np.arange(FORMS) % self.endings
        tokens = np.bincount(ending, weights=form_tokens, minlength=self.endings)
        kinds = np.bincount(ending, weights=form_words, minlength=self.endings)
        single = _forms(words[: self.singles]) % self.endings
        tokens -= np.bincount(single, weights=counts[: self.singles], minlength=self.endings)
        kinds -= np.bincount(single, minlength=self.endings)
        self.within = tokens + kinds + 1  # over the known words of an ending and one unknown word, as counts + 1
        share = np.full(self.leaves, 1e-2)
        share[: self.singles] = counts[: self.singles]
        share[self.leaves - self.endings :] = np.maximum(tokens, 0.5)
        share = (share / share.sum()).reshape(-1, self.groups).T  # leaf: slot * groups + group
        self.top = share.sum(1)
        self.low = share / self.top[:, None]
        rng = np.random.default_rng(7)
        g = self.groups
        self.inputs = (rng.standard_normal((self.known + self.endings + 1, SIZE)) * 0.1).astype(F32)
        self.places = np.full((BEFORE, SIZE), 1 / BEFORE**0.5, F32)
        self.top_out, self.top_bias = (rng.standard_normal((g, SIZE)) * 0.1).astype(F32), np.log(self.top).astype(F32)
        self.low_out, self.low_bias = (rng.standard_normal((g, g, SIZE)) * 0.1).astype(F32), np.log(self.low).astype(F32)
        self.sums = [np.full_like(x, 1e-6) for x in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.places, self.top_out, self.top_bias, self.low_out, self.low_bias]

    def vector(self) -> np.ndarray:
        """Parameters, then the squared gradients so far."""
        return np.concatenate([x.ravel() for x in (*self.parts(), *self.sums)]).astype(float)

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for x in (*self.parts(), *self.sums):
            x[...] = vector[at : at + x.size].reshape(x.shape)
            at += x.size

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input row and leaf of each dictionary word."""
        rank = np.full(len(words), self.known)
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            rank = np.where(self.words[k] == words, self.rank[k], self.known)
        return self.placed(rank, _forms(words))

    def placed(self, rank: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ending = form % self.endings
        return np.where(rank < self.known, rank, self.known + ending), np.where(rank < self.singles, rank, self.leaves - self.endings + ending)

    def stream(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input rows of texts one after the other, each behind BEFORE rows for its start, and the place of each token in it."""
        at = np.arange(len(rows)) + BEFORE * (np.repeat(np.arange(len(sizes)), sizes) + 1)
        out = np.full(len(rows) + BEFORE * len(sizes), self.known + self.endings, np.int64)
        out[at] = rows
        return out, at

    def query(self, x: np.ndarray) -> np.ndarray:
        """Predicted vectors from the vectors of a stretch; the first is that of its place BEFORE."""
        n = len(x) - BEFORE
        q = x[BEFORE - 1 : BEFORE - 1 + n] * self.places[0]
        for j in range(1, BEFORE):
            q += x[BEFORE - 1 - j : BEFORE - 1 - j + n] * self.places[j]
        return q

    def by_group(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of tokens by group, and the n + 1 places where the groups start in it."""
        group = (leaf % self.groups).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        return order, np.searchsorted(group[order], np.arange(self.groups + 1))

    def logs(self, rows: np.ndarray, sizes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Log probability of the leaf of each token of texts."""
        stream, at = self.stream(rows, sizes)
        out = np.empty(len(leaf))
        for start in range(0, len(stream) - BEFORE, 1 << 16):
            lo, hi = np.searchsorted(at, (start + BEFORE, start + BEFORE + (1 << 16)))
            q = self.query(self.inputs[stream[start : start + BEFORE + (1 << 16)]])[at[lo:hi] - BEFORE - start]
            own = leaf[lo:hi]
            found = _log_shares(q @ self.top_out.T + self.top_bias, own % self.groups)
            order, cuts = self.by_group(own)
            q, slot = q[order], (own // self.groups)[order]
            low = np.empty(len(own))
            for g in range(self.groups):
                a, b = cuts[g], cuts[g + 1]
                if a < b:
                    low[a:b] = _log_shares(q[a:b] @ self.low_out[g].T + self.low_bias[g], slot[a:b])
            found[order] += low
            out[lo:hi] = found
        return out

    def _step(self, k: int, grad: np.ndarray, rows: np.ndarray | slice = slice(None), rate: float = RATE) -> None:
        s, x = self.sums[k], self.parts()[k]
        s[rows] += grad**2
        x[rows] -= F32(rate) * grad / np.sqrt(s[rows])

    def train(self, rows: np.ndarray, sizes: np.ndarray, leaf: np.ndarray, batch: int, rng: np.random.Generator) -> None:
        """Noise-contrastive steps over the tokens of texts, with per-parameter step lengths from the squared gradients so far."""
        stream, at = self.stream(rows, sizes)
        log_top, log_low = np.log(NOISE * self.top).astype(F32), np.log(NOISE * self.low).astype(F32)

        def errors(logits: np.ndarray, log_noise: np.ndarray, share: np.ndarray, own: np.ndarray) -> np.ndarray:
            """Gradient of the contrastive loss by each logit: noise drawn once for all rows, and each row's own column."""
            hit = _sigmoid(logits - log_noise)
            line = np.arange(len(own))
            up = hit[line, own] - 1
            hit *= rng.multinomial(NOISE, share).astype(F32)
            hit[line, own] += up
            return hit

        for start in range(0, len(stream) - BEFORE, batch):
            lo, hi = np.searchsorted(at, (start + BEFORE, start + BEFORE + batch))
            if lo == hi:
                continue
            part = stream[start : start + BEFORE + batch]
            x = self.inputs[part]
            keep, own, n = at[lo:hi] - BEFORE - start, leaf[lo:hi], F32(hi - lo)
            q = self.query(x)[keep]
            e = errors(q @ self.top_out.T + self.top_bias, log_top, self.top, own % self.groups)
            d_top, d_top_bias, d_q = e.T @ q / n, e.sum(0) / n, e @ self.top_out
            order, cuts = self.by_group(own)
            qs, slot = q[order], (own // self.groups)[order]
            d_low, d_low_bias, d_qs = np.zeros_like(self.low_out), np.zeros_like(self.low_bias), np.empty_like(qs)
            for g in range(self.groups):
                a, b = cuts[g], cuts[g + 1]
                if a < b:
                    e = errors(qs[a:b] @ self.low_out[g].T + self.low_bias[g], log_low[g], self.low[g], slot[a:b])
                    d_low[g], d_low_bias[g], d_qs[a:b] = e.T @ qs[a:b] / n, e.sum(0) / n, e @ self.low_out[g]
            d_q[order] += d_qs
            whole = np.zeros((len(part) - BEFORE, SIZE), F32)
            whole[keep] = d_q / n
            d_x, d_places = np.zeros_like(x), np.empty_like(self.places)
            for j in range(BEFORE):
                span = slice(BEFORE - 1 - j, BEFORE - 1 - j + len(whole))
                d_x[span] += whole * self.places[j]
                d_places[j] = np.einsum("ij,ij->j", whole, x[span])
            order = np.argsort(part, kind="stable")
            touched = part[order]
            begin = np.flatnonzero(np.concatenate(([True], touched[1:] != touched[:-1])))
            self._step(0, np.add.reduceat(d_x[order], begin, axis=0), touched[begin])
            self._step(1, d_places, rate=RATE / 5)
            for k, grad in ((2, d_top), (3, d_top_bias), (4, d_low), (5, d_low_bias)):
                self._step(k, grad)


def groups(vocabulary: int) -> int:
    """Groups of the tree, and leaves of a group: the fourth root of the vocabulary."""
    return max(LEAST, int(np.ceil(max(vocabulary, 1) ** 0.25)))


def _tokens(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of chunk k: tokens and sizes of texts."""
    planes = np.frombuffer(batch.column("tokens")[k].as_py(), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel(), batch.column("sizes")[k].values.to_numpy()


def _trained(model: Model, batch_size: int, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of one task: its parameters after training on its chunks, times its tokens, and its tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for k in range(batch.num_rows):
                tokens, sizes = _tokens(batch, k)
                rows, leaf = model.ids(batch.column("words")[k].values.to_numpy())
                rng = np.random.default_rng([turn, batch.column("chunk")[k].as_py()])
                texts = rng.permutation(np.flatnonzero(~batch.column("held")[k].values.fill_null(False).to_numpy(zero_copy_only=False)))
                own = sizes[texts].astype(np.int64)
                first = (np.cumsum(sizes) - sizes)[texts]
                tokens = tokens[np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())]
                model.train(rows[tokens], own, leaf[tokens], batch_size, rng)
                seen += len(tokens)
        if seen:
            yield pa.RecordBatch.from_pydict({"total": [np.append(model.vector() * seen, seen).astype("<f8").tobytes()]})

    return task


def _turns(chunks: DataFrame, n: int) -> Iterator[DataFrame]:
    """The chunks of each round of training. A small corpus: all of it, in one task, several times. Else a first lot in one task, which
    brings the parameters to a common start, then two halves of the rest, in tasks of about a lot each."""
    if n <= LOT:
        for _ in range(min(MOST_PASSES, max(LEAST_PASSES, LOT // max(n, 1)))):
            yield chunks.repartition(1)
        return
    draw = F.pmod(F.xxhash64("chunk"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    first = LOT / n
    yield chunks.where(draw < first).repartition(1)
    for k in (0, 1):
        lo, hi = first + k * (1 - first) / 2, first + (k + 1) * (1 - first) / 2
        yield chunks.where((draw >= lo) & (draw < hi)).coalesce(max(1, round((n - LOT) / 2 / LOT)))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    Tokens are a text's words (A-Z lowered, split at ASCII white space) and one end. The model and the counts learn from ids whose crc32 (as
    text) mod 7 is not 2; rows with a null id learn too and have held_out null. A null or empty text is its end token. Rows that repeat an id
    have a result each. Columns besides id and text are not read. An empty table gives no rows.
    """
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), (F.crc32(doc.cast("string")) % 7 == 2).alias("held_out"), whole_text(text_col).alias("text"))
    chunks = written(rows.mapInArrow(_chunks, _CHUNKS), "chunks")

    # A row for each chunk and word: a word has at most as many rows as there are chunks, which partial sums bring together.
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w"))
    counted = pairs.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("c"), (F.count("*") > 1).alias("shared")).where("c > 0")
    counted = written(counted, "counted")
    by_form = counted.groupBy(F.expr("cast(shiftrightunsigned(word, 52) as int)").alias("form")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # at most FORMS rows
    form_tokens, form_words = np.zeros(FORMS), np.zeros(FORMS)
    for r in by_form:
        form_tokens[r["form"]], form_words[r["form"]] = r["n"], r["v"]
    n, v = int(form_tokens.sum()), int(form_words.sum())
    # The square root of the vocabulary bounds the head, here and in its broadcast.
    head = written(counted.orderBy(F.col("c").desc(), "word").limit(KNOWN * groups(v) ** 2).select("word", "c"), "head")
    top = head.orderBy(F.col("c").desc(), "word").collect()
    model = Model(np.array([r["word"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64), v, form_tokens, form_words)

    batch_size = int(np.clip(n // 256, SMALL_BATCH, BATCH))
    for turn, own in enumerate(_turns(chunks.select("chunk", "held", "sizes", "tokens", "words"), n)):
        total = summed(own, _trained(model, batch_size, turn), whole=True)
        if total is not None and total[-1]:
            model.load(total[:-1] / total[-1])

    # A word of one chunk alone has its count there; only words of several chunks need theirs from the others.
    refs = pairs.select(F.col("w.words").alias("word"), F.expr(f"chunk * {_PLACE}L + k").alias("ref"))
    small = F.broadcast(head.select("word", "c"))
    common = refs.join(small, "word").select("ref", "word", "c")
    others = refs.join(small, "word", "left_anti").join(counted.where("shared").hint("merge"), "word").select("ref", F.lit(None).cast("long").alias("word"), "c")
    back = common.unionByName(others).select(F.expr(f"ref div {_PLACE}L").alias("chunk"), F.expr(f"cast(ref % {_PLACE}L as int)").alias("k"), "c", "word")

    def scored(chunk: pa.Table, found: pa.Table) -> pa.Table:
        batch = chunk.combine_chunks().to_batches()[0]
        tokens, sizes = _tokens(batch, 0)
        c = batch.column("counts")[0].values.to_numpy().astype(np.int64)
        forms = np.frombuffer(batch.column("forms")[0].as_py(), "<u2").astype(np.int64)
        k, word = found.column("k").to_numpy(), found.column("word")
        c[k] = found.column("c").to_numpy()
        rank = np.full(len(c), model.known)
        is_head = word.is_valid().to_numpy()
        rank[k[is_head]] = model.rank[np.searchsorted(model.words, word.drop_null().to_numpy())]
        row, leaf = model.placed(rank, forms)
        inside = np.where(rank < model.singles, 0.0, np.log((c + 1) / model.within[forms % model.endings]))
        logs = model.logs(row[tokens], sizes, leaf[tokens]) + inside[tokens]
        base = np.log10((c + 1) / (n + v + 1))[tokens]
        cut = np.cumsum(sizes) - sizes
        return pa.table({"doc_id": batch.column("docs")[0].values, "held_out": batch.column("held")[0].values, "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), cut)), "train_tokens": pa.array(np.full(len(sizes), n)), "base_score": pa.array(np.add.reduceat(base, cut)), "score": pa.array(np.add.reduceat(logs, cut) / np.log(10))})

    left = chunks.mapInArrow(_without_words, _CHUNKS.replace("words array<long>", "forms binary"))
    return left.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _without_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with 16 bits for the ending of each word instead of the words, which needn't travel again."""
    for batch in batches:
        at = batch.schema.get_field_index("words")
        forms = [_forms(words.values.to_numpy()).astype("<u2").tobytes() for words in batch.column(at)]
        yield batch.remove_column(at).add_column(at, "forms", pa.array(forms, pa.binary()))
