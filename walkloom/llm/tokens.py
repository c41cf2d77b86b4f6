"""Token ids by a public tokenizer, with a cache of text units.

A text is cut into units at places where the tokenizer's own pre-tokenization always cuts, so the ids of a text are those of its
units one after the other. Units are found, hashed and told apart in numpy, a batch at a time; each distinct unit goes through the tokenizer
once while the worker's cache, bounded in bytes, holds it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import span_hashes, text_bytes

#: Bytes of text that are encoded at a time.
SLICE = 1 << 20
#: Bytes of a worker's cache (24 a unit for its hash, size and place, and its ids, twice for the lookup table); a full one is emptied.
_MOST = 64 << 20
#: Longer units, in bytes, are told apart one by one and are not cached.
_LONG = 64
#: White space beyond ASCII; texts with it go through the tokenizer whole.
_WIDE = "[\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Letters that are their own composed form and whose lower case is one letter too, after at most one space: one pre-token, so the tokenizer's
#: model can take the characters that stand for its bytes.
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_is_letter = np.zeros(256, bool)
_is_letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: ASCII marks except the apostrophe; after letters they are always pre-tokens of their own.
_is_mark = np.zeros(256, bool)
_is_mark[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True
_shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
#: Byte-level tokenizers write a printable byte as its Latin-1 character and the others, in order, as the characters from 256 on.
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_shown)))}
_loaded: dict[str, _Cached] = {}


class _Cached:
    """A tokenizer, its bare model, and the ids of units seen so far by the hash of the unit."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # the same model, held once, without the steps before it
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        # The newest units stand in an index of their own, so that the lookup table of all others isn't built anew at every slice.
        self.index, self.newest = pd.Index([], dtype="uint64"), pd.Index([], dtype="uint64")
        self.size, self.place, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def used(self) -> int:
        return 2 * 24 * len(self.size) + self.flat.nbytes

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the cache, -1 for new ones."""
        place = self.index.get_indexer(hashes) if len(self.index) else np.full(len(hashes), -1)
        if len(self.newest):
            others = np.flatnonzero(place < 0)
            at = self.newest.get_indexer(hashes[others])
            place[others[at >= 0]] = at[at >= 0] + len(self.index)
        return place

    def add(self, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.place = np.concatenate((self.place, np.cumsum(size) - size + len(self.flat)))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))
        self.newest = pd.Index(np.concatenate((self.newest.to_numpy(), hashes)))
        if 4 * len(self.newest) > len(self.index):
            self.index, self.newest = pd.Index(np.concatenate((self.index.to_numpy(), self.newest.to_numpy()))), pd.Index([], dtype="uint64")

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of letters, all in one call; a line feed after each, which no token of letters holds, marks its end."""
        if self.kind == "word":
            words = [w.lower() for w in words]
        words = [w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in words]
        feed = chr(_BYTES[10])
        mark = self.bare.encode(feed, add_special_tokens=False).ids[0]
        ids = np.array(self.bare.encode_batch_fast([[x for w in words for x in (w, feed)]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == mark)
        return np.diff(at, prepend=-1) - 1, np.delete(ids, at)

    def encoded(self, plain: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units: first those of letters, then the others."""
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        if plain:
            size, flat = self.letters(plain)
            sizes.append(size)
            flats.append(flat)
        if other:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flats.append(np.fromiter((x for ids in found for x in ids), np.uint32))
        return np.concatenate(sizes), np.concatenate(flats)


def _runs(raw: np.ndarray, at: np.ndarray, odd: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and end. byte: a run has the space before it, and other white space is in runs of its own; word: it is left out.
    An odd text is one run."""
    space = _is_space[raw]
    starts = at[:-1][np.diff(at) > 0]
    fresh = np.zeros(len(raw) + 1, bool)
    if kind == "byte":
        # White space begins, its last character before other text, and other text after white space that is no single space.
        before = np.concatenate(([False], space[:-1]))
        after = np.concatenate((space[1:], [True]))
        after[starts[1:] - 1] = True  # the last character of a text has nothing after it
        fresh[:-1] = space & (~before | ~after)
        fresh[1:-1] |= ~space[1:] & space[:-1] & (raw[:-1] != 0x20)
    else:
        fresh[:-1] = ~space
        fresh[1:-1] &= space[:-1]
        fresh[starts] = ~space[starts]
    for k in np.flatnonzero(odd):
        fresh[at[k] : at[k + 1]] = False
    fresh[starts if kind == "byte" else at[:-1][odd & (np.diff(at) > 0)]] = True
    fresh[-1] = False
    begin = np.flatnonzero(fresh)
    if kind == "byte":
        return begin, np.append(begin[1:], len(raw))[: len(begin)]
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = ~space
    ends[1:-1] &= space[1:]
    ends[starts] |= np.concatenate(([False], ~space[starts[1:] - 1]))[: len(starts)]
    for k in np.flatnonzero(odd):
        ends[at[k] + 1 : at[k + 1]] = False
        ends[at[k + 1]] |= at[k + 1] > at[k]
    return begin, np.flatnonzero(ends)


def _units(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs, where those of letters and marks after them are two units."""
    letter = _is_letter[raw]
    lead = raw == 0xC3
    if lead.any():  # two bytes: the Latin-1 letters, without the signs for times and divide
        second = np.concatenate(([False], lead[:-1] & (raw[1:] != 0x97) & (raw[1:] != 0xB7)))
        letter |= second
        letter[:-1] |= second[1:]
    others = np.concatenate(([0], np.cumsum(~letter, dtype=np.int32)))
    no_mark = np.maximum.accumulate(np.where(_is_mark[raw], -1, np.arange(len(raw), dtype=np.int32)))
    core = np.maximum(no_mark[end - 1] + 1, begin)
    first = begin + (raw[begin] == 0x20)
    cut = core[(core < end) & (core > first) & (others[core] == others[np.minimum(first, core)])]
    return np.sort(np.concatenate((begin, cut))), np.sort(np.concatenate((end, cut)))


def encode(path: str, kind: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (uint32) of the whole texts (null: empty) one after the other, without special tokens added, and the n + 1 places where texts start."""
    if path not in _loaded:
        _loaded[path] = _Cached(path, kind)
    known = _loaded[path]
    texts = pc.fill_null(texts, "")
    # A special token's string cuts a text before anything else does; such texts, and those with wide white space, are taken whole.
    odd = pc.match_substring_regex(texts, "|".join([_WIDE, *map(re.escape, known.special)])).to_numpy(zero_copy_only=False).astype(bool)
    raw, at = text_bytes(texts)
    begin, end = _runs(raw, at, odd, kind)
    if not len(begin):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    begin, end = _units(raw, begin, end)
    if odd.any():  # a run of letters and marks can be an odd text too
        inside = odd[np.searchsorted(at, begin, side="right") - 1]
        keep = ~inside | np.isin(begin, at[:-1])
        end = np.where(inside, at[np.searchsorted(at, begin, side="right")], end)[keep]
        begin, inside = begin[keep], inside[keep]
    hashes = span_hashes(raw, begin, end, lower=False)
    single = end - begin > _LONG
    if odd.any():
        single |= inside
    single = np.flatnonzero(single)
    hashes[single] = np.arange(len(single), dtype=np.uint64)
    codes, distinct = pd.factorize(hashes)
    if known.used() > _MOST:
        known.clear()
    place = known.find(distinct)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    alone = np.zeros(len(distinct), bool)
    alone[codes[single]] = True
    fresh = np.flatnonzero((place < 0) | alone)
    size, flat, at_flat = known.size, known.flat, known.place
    if len(fresh):
        data = raw.tobytes()
        units = [data[a:b].decode() for a, b in zip(begin[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)]
        is_plain = np.fromiter((_PLAIN.fullmatch(u) is not None for u in units), bool, len(units))
        fresh = np.concatenate((fresh[is_plain], fresh[~is_plain]))
        new_size, new_flat = known.encoded(*([u for u, p in zip(units, is_plain.tolist(), strict=True) if p == want] for want in (True, False)))
        place[fresh] = len(size) + np.arange(len(fresh))
        keep = ~alone[fresh]
        new_at = np.cumsum(new_size) - new_size + len(flat)
        size, flat, at_flat = np.concatenate((size, new_size)), np.concatenate((flat, new_flat)), np.concatenate((at_flat, new_at))
        known.add(distinct[fresh][keep], new_size[keep], new_flat[np.repeat(keep, new_size)])
    own = place[codes]
    n = size[own]
    upto = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(at_flat[own] - upto[:-1], n) + np.arange(upto[-1])]
    return ids, upto[np.searchsorted(begin, at)]


def with_ends(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text, and the places where texts start in them."""
    return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
