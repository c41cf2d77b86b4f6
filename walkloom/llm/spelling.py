"""Groups of spelling variants, by Bloom filters that say which edits of a word may be words.

Words are counted first. Their 64-bit polynomial hashes fill blocked Bloom filters, a shard for each length. Every word then generates its
shortenings and its replacements by a larger letter (each pair of neighbours is reached from one side that way) as hashes, without
building strings, and probes the shard of the edit's length. Only hits leave the task; they meet the vocabulary by a join on the hash, and
the two words are compared, so false hits and equal hashes are gone. Filters are broadcast a stretch of blocks at a time, at most
BROADCAST_BYTES each: a larger vocabulary takes more passes, each over the words whose edits can fall in its stretch.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written
from .textkit import U, mix

MIN_LENGTH, MIN_COUNT = 7, 2
#: A form occurs so many times as often as the word.
FORM_FACTOR = 10
#: Of so many runs, told by their hash, one loses a character.
LOSSY = 31
#: Words of this length and more share one shard.
LONG = 40
#: Bits of filter for each word; blocks are 8 lanes of 64 bits, with one bit set in each.
BITS, LANES, LEAST_BLOCKS = 16, 8, 64
#: Blocks in a row of the filter table (64 KB), and bytes of filter that one pass broadcasts.
SEGMENT, BROADCAST_BYTES = 1024, 64 << 20
#: Words counted in a task before their counts move on.
HELD_WORDS = 200_000
#: Words whose edits are generated together.
TOGETHER = 4096

_BASE, _GAP = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_BACK = U(pow(_BASE, -1, 1 << 64))
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")


def _counted(held: int) -> Callable:
    """Words and how often they occur in the rows of a task, some words several times: at most about `held` wait."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def moved() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():  # lower() of bytes knows A-Z alone
                    h = zlib.crc32(word.encode(), seed)
                    if h % LOSSY == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    total[word] += n
                if len(total) >= held:
                    yield moved()
        if total:
            yield moved()

    return task


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the places of its words and their code points, a row for each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), TOGETHER):
            some = at[k : k + TOGETHER]
            yield some, np.array([words[i] for i in some], f"<U{size}").view(np.uint32).reshape(len(some), size).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, U(_BASE))
    out[0] = U(1)
    return np.multiply.accumulate(out)


def _sealed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + U(length * _GAP % 2**64))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        h = np.zeros(len(words), np.uint64)
        for at, codes in _by_length(words):
            h[at] = _sealed((codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64), codes.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(np.minimum([len(w) for w in words], LONG).astype(np.int32)), pa.array(h.view(np.int64))], names=["word", "n", "shard", "h"])


class Layout:
    """Where the shards' blocks lie in one long row of blocks."""

    def __init__(self, sizes: dict[int, int], segment: int) -> None:
        self.segment = segment
        self.blocks = {s: max(LEAST_BLOCKS, -(-n * BITS // (64 * LANES))) for s, n in sizes.items()}
        self.first, self.total = {}, 0
        for s in sorted(self.blocks):
            self.first[s], self.total = self.total, self.total + self.blocks[s]

    def block(self, shard: int, h: np.ndarray) -> np.ndarray:
        return (((h >> U(32)) * U(self.blocks[shard])) >> U(32)).astype(np.int64) + self.first[shard]


def _lane_bits(h: np.ndarray, lane: int) -> np.ndarray:
    return U(1) << ((mix(h ^ U(0x9FB21C651E98DF25)) >> U(6 * lane)) & U(63))


def _marks(layout: Layout) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, shards = batch.column("h").to_numpy().view(np.uint64), batch.column("shard").to_numpy()
            at = np.zeros(len(h), np.int64)
            for s in np.unique(shards):
                own = shards == s
                at[own] = layout.block(int(s), h[own])
            yield pa.RecordBatch.from_arrays([pa.array(at // layout.segment), pa.array((at % layout.segment).astype(np.int32)), batch.column("h")], names=["segment", "at", "h"])

    return task


def _filled(blocks: int) -> Callable:
    def task(group: pa.Table) -> pa.Table:
        bits = np.zeros((blocks, LANES), np.uint64)
        h, at = group.column("h").to_numpy().view(np.uint64), group.column("at").to_numpy()
        for lane in range(LANES):
            np.bitwise_or.at(bits[:, lane], at, _lane_bits(h, lane))
        return pa.table({"segment": group.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    return task


def _probed(layout: Layout, low: int, high: int, bits, alphabet: np.ndarray) -> Callable:  # noqa: ANN001
    """Hits (a, b) of words a whose edits b may be in the filter's blocks from low to high."""
    wanted = {s for s in layout.blocks if layout.first[s] < high and layout.first[s] + layout.blocks[s] > low}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint64).reshape(-1, LANES)

        def hits(shard: int, own: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = layout.block(shard, h)
            keep = np.flatnonzero((at >= low) & (at < high))
            for lane in range(LANES):
                keep = keep[(table[at[keep] - low, lane] & _lane_bits(h[keep], lane)) != 0]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(own[keep].view(np.int64)), pa.array(h[keep].view(np.int64))], names=["a", "b"])

        for batch in batches:
            words = batch.column("word").to_pylist()
            for _, codes in _by_length(words):
                m, size = codes.shape
                power, same, less = _powers(size), min(size, LONG), min(size - 1, LONG)
                terms = codes * power
                whole = terms.sum(axis=1, dtype=np.uint64)
                own, before = _sealed(whole, size), np.zeros(m, np.uint64)
                for p in range(size):
                    if less in wanted:
                        fresh = np.flatnonzero(codes[:, p] != codes[:, p - 1]) if p else np.arange(m)
                        short = before[fresh] + (whole[fresh] - before[fresh] - terms[fresh, p]) * _BACK
                        yield from hits(less, own[fresh], _sealed(short, size - 1))
                    if same in wanted:
                        i, j = np.nonzero(alphabet > codes[:, p : p + 1])
                        yield from hits(same, own[i], _sealed(whole[i] + (alphabet[j] - codes[i, p]) * power[p], size))
                    before += terms[:, p]

    return task


def _neighbours(vocab: DataFrame) -> DataFrame:
    """word, n, other, other_n of every ordered pair of words one edit apart; vocab is a written table (word, n, shard, h)."""
    spark = vocab.sparkSession
    layout = Layout({r["shard"]: r["count"] for r in vocab.groupBy("shard").count().collect()}, SEGMENT)  # LONG rows at most
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c <> ''").collect()  # the runs' class: 90 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint64)
    segments = written(vocab.mapInArrow(_marks(layout), "segment long, at int, h long").groupBy("segment").applyInArrow(_filled(SEGMENT), "segment long, bits binary"), "filter")
    step, found = max(1, BROADCAST_BYTES // (SEGMENT * LANES * 8)), None
    for first in range(0, -(-layout.total // SEGMENT), step):
        end = min(first + step, -(-layout.total // SEGMENT))
        bits = np.zeros((end - first, SEGMENT * LANES), np.uint64)
        for r in segments.where(f"segment >= {first} and segment < {end}").toLocalIterator():
            bits[r["segment"] - first] = np.frombuffer(r["bits"], np.uint64)
        sent = spark.sparkContext.broadcast(bits.tobytes())
        low, high = first * SEGMENT, end * SEGMENT
        near = {s for s in layout.blocks if layout.first[s] < high and layout.first[s] + layout.blocks[s] > low}
        words = vocab.where(F.col("shard").isin([*near, *(s + 1 for s in near if s < LONG)])).select("word")
        hits = written(words.mapInArrow(_probed(layout, low, high, sent, alphabet), "a long, b long"), "hits")
        sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
    side = lambda key, *names: vocab.select(F.col("h").alias(key), *[F.col(c).alias(x) for c, x in zip(("word", "n"), names, strict=True)])
    pairs = found.join(side("b", "other", "other_n"), "b").join(side("a", "word", "n"), "a").where(F.levenshtein("word", "other", 1) == 1)
    pairs = written(pairs.select("word", "n", "other", "other_n").distinct(), "near")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow one another; each has ten times the count of the one before, so few do."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        moved = written(roots.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return roots
        roots = moved.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; columns besides id and text are not read.

    Words are runs of Latin letters with A-Z lowered, of 7 code points and 2 occurrences at least; where 31 divides the crc32 of
    `<doc_id>:<run>` the run's occurrences in that row lost the code point crc32 % length. Near words are one inserted, deleted or replaced code
    point apart. form: the near word of largest n, of equal ones the smallest, if its n is ten times the word's; root: the last form. A
    null text has no words, a null id counts as empty, repeated rows count each. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    counts = texts.mapInArrow(_counted(HELD_WORDS), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    vocab = written(counts.mapInArrow(_hashed, "word string, n long, shard int, h long"), "vocabulary")
    if vocab.isEmpty():
        return vocab.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = _neighbours(vocab).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    big = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    near = written(near.select("word", "n_near", F.when(big, F.col("best.other")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(near.where("form is not null"))
    out = vocab.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
