"""Byte-pair merging of many distinct words at once, and a bounded cache of its results."""

from __future__ import annotations

import base64
import functools
import heapq
import json

import numpy as np
import pyarrow as pa

NONE = np.iinfo(np.int32).max
LONG_WORD = 96  # symbols; longer words are merged one by one with a heap


class PairTable:
    """Hash table (left id, right id) -> (rank, merged id), probed with arrays."""

    def __init__(self, left, right, rank, merged):
        n = len(left)
        self.bits = max(4, int(np.ceil(np.log2(max(n, 1) * 6))))
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        todo, slot = np.arange(n), self._slot(keys)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        while len(todo):
            free = self.key[slot] == -1
            self.key[slot[free]] = keys[todo[free]]  # of several, one stays
            won = free & (self.key[slot] == keys[todo])
            self.rank[slot[won]], self.merged[slot[won]] = rank[todo[won]], merged[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)

    def _slot(self, keys):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Slot of each pair; slots of absent pairs hold rank ``NONE``."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        at = self.key[slot]
        wrong = np.flatnonzero((at != keys) & (at != -1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.key) - 1)
            at = self.key[slot[wrong]]
            wrong = wrong[(at != keys[wrong]) & (at != -1)]
        return slot


class Vocabulary:
    """Byte symbols, merges and, where whole words come first, the words.

    ``inner`` and ``final`` give the id of a byte inside a word and at its end.
    """

    def __init__(self, inner, final, pairs: PairTable, whole: dict[bytes, int] | None, tokens: list[bytes]):
        self.inner, self.final, self.pairs, self.whole, self.tokens = inner, final, pairs, whole, tokens

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset: words.offset + n + 1].astype(np.int64)
        if n == 0 or offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        length = np.diff(offsets)
        done_word, done_sym, counts = [], [], np.zeros(n, np.int64)

        def emit(word, sym):
            done_word.append(word)
            done_sym.append(sym)

        plain = np.ones(n, bool)
        if self.whole is not None:
            ids = np.fromiter((self.whole.get(w, -1) for w in words.to_pylist()), np.int64, n)
            hit = np.flatnonzero(ids >= 0)
            emit(hit, ids[hit].astype(np.int32))
            plain[hit] = False
        for w in np.flatnonzero(plain & (length > LONG_WORD)):
            sym = self._merge_long(data[offsets[w]: offsets[w + 1]])
            emit(np.full(len(sym), w), sym)
            plain[w] = False
        word = np.flatnonzero(plain & (length > 0))
        lens = length[word]
        if len(word):
            ends = np.cumsum(lens)
            flat = np.arange(ends[-1]) + np.repeat(offsets[word] - (ends - lens), lens)
            sym = self.inner[data[flat]]
            sym[ends - 1] = self.final[data[flat[ends - 1]]]
            rank = np.full(len(sym), NONE, np.int32)
            into = np.zeros(len(sym), np.int32)
            slot = self.pairs.find(sym[:-1], sym[1:])
            rank[:-1], into[:-1] = self.pairs.rank[slot], self.pairs.merged[slot]
            rank[ends - 1] = NONE
            while len(word):
                starts = np.cumsum(lens) - lens
                least = np.minimum.reduceat(rank, starts)
                over = least == NONE
                if over.any():
                    keep = np.repeat(~over, lens)
                    emit(np.repeat(word[over], lens[over]), sym[~keep])
                    sym, rank, into = sym[keep], rank[keep], into[keep]
                    word, lens, least = word[~over], lens[~over], least[~over]
                    if not len(word):
                        break
                    starts = np.cumsum(lens) - lens
                owner = np.repeat(np.arange(len(word)), lens)
                at = np.flatnonzero(rank == least[owner])
                at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # leftmost of each word
                sym[at] = into[at]
                keep = np.ones(len(sym), bool)
                keep[at + 1] = False
                sym, rank, into = sym[keep], rank[keep], into[keep]
                at -= np.arange(len(at))
                lens = lens - 1
                starts = starts - np.arange(len(starts))
                for left, inside in ((at, at < starts + lens - 1), (at - 1, at > starts)):
                    p = left[inside]
                    slot = self.pairs.find(sym[p], sym[p + 1])
                    rank[p], into[p] = self.pairs.rank[slot], self.pairs.merged[slot]
                    if left is at:
                        rank[left[~inside]] = NONE
        all_words = np.concatenate(done_word)
        counts += np.bincount(all_words, minlength=n)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_sym)[order].astype(np.int32), counts

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """One long word: a heap of pairs over a linked list."""
        sym = self.inner[data].copy()
        sym[-1] = self.final[data[-1]]
        n = len(sym)
        slot = self.pairs.find(sym[:-1], sym[1:])
        rank, into = self.pairs.rank[slot], self.pairs.merged[slot]
        heap = [(int(rank[i]), i, int(into[i]), int(sym[i]), int(sym[i + 1])) for i in np.flatnonzero(rank != NONE)]
        heapq.heapify(heap)
        sym = sym.tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        while heap:
            _, i, merged, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = merged, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p in (before[i], i):
                q = after[p] if p >= 0 else n
                if p >= 0 and q < n:
                    s = int(self.pairs.find(np.array([sym[p]]), np.array([sym[q]]))[0])
                    if self.pairs.rank[s] != NONE:
                        heapq.heappush(heap, (int(self.pairs.rank[s]), p, int(self.pairs.merged[s]), sym[p], sym[q]))
        return np.array([s for s, a in zip(sym, alive) if a], np.int32)


class WordCache:
    """Ids of words seen before; emptied when it holds ``limit`` words."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 200_000):
        self.vocabulary, self.limit = vocabulary, limit
        self._clear()

    def _clear(self):
        self.at: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``Vocabulary.encode``."""
        if len(self.at) > self.limit:
            self._clear()
        listed = words.to_pylist()
        at = np.fromiter((self.at.get(w, -1) for w in listed), np.int64, len(listed))
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, count = self.vocabulary.encode(words.take(pa.array(new)))
            first = len(self.count)
            self.at.update((listed[w], first + k) for k, w in enumerate(new.tolist()))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, count)
            at[new] = first + np.arange(len(new))
        count = self.count[at]
        return self.ids[ragged(self.start[at], count)], count


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every slice, one after another."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(count) - count), count)


def binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    """The slices of ``data`` between neighbouring offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in tokenizer files (fixed rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def from_ranks(path: str) -> Vocabulary:
    """A vocabulary of bytes and ranks: any two neighbours whose bytes together have a rank merge."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rows = [(ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks]
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    return Vocabulary(single, single, PairTable(*zip(*rows)), ranks, tokens)


@functools.lru_cache(maxsize=4)
def from_json(path: str) -> tuple[Vocabulary, dict[str, int]]:
    """A vocabulary with listed merges, and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    rows = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)]
    inner, final = np.zeros(256, np.int32), np.zeros(256, np.int32)
    for letter, b in letters.items():
        inner[b], final[b] = vocab[letter], vocab[letter + end]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Vocabulary(inner, final, PairTable(*zip(*rows)), None, []), special
