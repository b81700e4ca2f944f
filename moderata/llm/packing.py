"""Packing token streams into sequences of a fixed length.

Documents are tokenised row by row and packed in the order in which their task
reads them; no row is moved. Cuts are chosen by dynamic programming over the
places where a sequence may end: ends of documents (free), ends of sentences
and, inside long stretches without either, a grid (each at a penalty). The cost
of a sequence is its padding; a length that is any power of two has none. Of
equally cheap cuts those with fewer sequences are taken.
``best[i] = penalty[i] + min(best[j] + length - (place[i] - place[j]))`` over
places j at most one length before i: the minimum of ``best[j] + place[j]`` in
a sliding window, which a monotone queue gives in constant time. The stream is
solved block by block; the last, open sequence is handed to the next block, so
memory is bounded by the block and the longest text.

Every document has at least one token (the end mark): null and empty texts have
just it. Repeated rows are packed like other rows. An empty table has no pieces.
Ties between cuts fall to the earlier place looked at, the same on every run. A
very long text is tokenised whole and kept until its last sequence is closed.
Columns other than key and text are left out, so their names cannot clash.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, textscan

LENGTH = 4096
SENTENCE, ANYWHERE = 16, 128  # penalties of a cut, in tokens of padding
SEQUENCE = 2.0 ** -20
GRID = 512
BLOCK_TOKENS = 1 << 18
CHARACTERS = 1 << 24  # tokenised at once
ENDINGS = np.zeros(256, bool)
ENDINGS[list(b".!?")] = True


def normalise(text: str) -> str:
    """Composed and lower case, without the context rule for final sigma."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def tokenise(texts: list[str], vocabulary: bpe.Vocabulary, strings: dict[str, int], end: int):
    """(ids of all texts, number of ids of each, whether a sentence ends after each id)."""
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(strings, key=len, reverse=True))) + ")") if strings else None
    parts, owner, fixed = [], [], {}
    for i, text in enumerate(texts):
        cut = special.split(text) if special is not None and "<|" in text else [text]
        for k, piece in enumerate(cut):
            if k % 2:
                fixed[len(parts)] = strings[piece]
                piece = ""
            parts.append(normalise(piece))
            owner.append(i)
        fixed[len(parts)] = end
        parts.append("")
        owner.append(i)
    # Words of all chunks are coded first, so that each distinct word is merged once.
    scanned, dictionaries, all_parts = [], [], []
    for chunk in textscan.chunks(parts):
        data, offsets, kind, token_of = textscan.slices([t for _, t in chunk], textscan.WORDS)
        real = kind < textscan.SPACE
        coded = bpe.binary(data, offsets).filter(pa.array(real)).dictionary_encode()
        ends_sentence = ENDINGS[np.frombuffer(data, np.uint8)[offsets[1:][real] - 1]]
        cuts = np.append(0, np.cumsum(real))[token_of]
        scanned.append((coded.indices.to_numpy(zero_copy_only=False), ends_sentence, cuts))
        dictionaries.append(coded.dictionary)
        all_parts += [i for i, _ in chunk]
    together = pa.concat_arrays(dictionaries or [pa.array([], pa.binary())]).dictionary_encode()
    code, words = together.indices.to_numpy(zero_copy_only=False), together.dictionary
    merged, count = vocabulary.encode(words)
    start = np.cumsum(count) - count
    all_ids, all_ends, all_counts, first = [], [], [], 0
    for (at, ends_sentence, cuts), own in zip(scanned, dictionaries):
        at = code[first: first + len(own)][at]
        first += len(own)
        each = count[at]
        total = np.append(0, np.cumsum(each))
        closing = np.zeros(total[-1], bool)
        closing[total[1:][ends_sentence] - 1] = True
        all_ids.append(merged[bpe.ragged(start[at], each)])
        all_ends.append(closing)
        all_counts.append(np.diff(total[cuts]))
    ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
    closing = np.concatenate(all_ends) if all_ends else np.zeros(0, bool)
    counts = np.concatenate(all_counts) if all_counts else np.zeros(0, np.int64)
    # Special strings and end marks go where their empty parts stand.
    at = np.cumsum(counts) - counts
    marks = [k for k, p in enumerate(all_parts) if p in fixed]
    ids = np.insert(ids, at[marks], [fixed[all_parts[k]] for k in marks]).astype(np.int32)
    closing = np.insert(closing, at[marks], False)
    counts[marks] += 1
    per_text = np.bincount(np.array(owner)[all_parts], counts, len(texts)).astype(np.int64)
    return ids, per_text, closing


def choose_cuts(places: np.ndarray, penalty: np.ndarray, length: int, open_end: bool) -> list[int]:
    """Places (ascending, the last is the stream's end) at which sequences end.

    With ``open_end`` the last sequence is not final and costs nothing.
    """
    where, cost = [0, *places.tolist()], [0, *penalty.tolist()]
    n = len(where)
    best, back = [0.0] * n, [0] * n
    powers = [p for p in (1 << k for k in range(length.bit_length())) if p < length]
    index = {p: i for i, p in enumerate(where)}
    queue: deque[int] = deque([0])
    value = [0.0] * n  # best + place
    for i in range(1, n):
        here = where[i]
        low = here - length
        while where[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        top = value[j] + length - here
        for p in powers:
            k = index.get(here - p)
            if k is not None and best[k] < top:
                top, j = best[k], k
        if i == n - 1 and open_end:
            j = min((k for k in range(i - 1, -1, -1) if where[k] >= low), key=best.__getitem__) \
                if i < 4 * length else _least(best, where, i, low)
            top = best[j]
        # Of equal costs, fewer sequences: all of a block's together count less than one token.
        best[i], back[i] = top + cost[i] + SEQUENCE, j
        v = value[i] = best[i] + here
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
    cuts, i = [], n - 1
    while i:
        cuts.append(where[i])
        i = back[i]
    return cuts[::-1]


def _least(best, where, i, low):
    j = k = i - 1
    while k >= 0 and where[k] >= low:
        if best[k] < best[j]:
            j = k
        k -= 1
    return j


class Packer:
    """Packs one task's stream of documents."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.keys: list = []
        self.base, self.size, self.total = (np.zeros(0, np.int64) for _ in range(3))
        self.ids, self.closing = np.zeros(0, np.int32), np.zeros(0, bool)

    def add(self, keys: list, ids: np.ndarray, counts: np.ndarray, closing: np.ndarray) -> None:
        self.keys += keys
        self.base = np.append(self.base, np.zeros(len(keys), np.int64))
        self.size, self.total = np.append(self.size, counts), np.append(self.total, counts)
        self.ids, self.closing = np.append(self.ids, ids), np.append(self.closing, closing)

    def pack(self, last: bool) -> list[tuple]:
        """Rows of all closed sequences; the open one stays unless ``last``."""
        if not len(self.ids):
            return []
        ends = np.cumsum(self.size)
        penalty = np.full(len(self.ids) + 1, -1, np.int16)
        penalty[np.flatnonzero(self.closing) + 1] = SENTENCE
        penalty[ends] = 0
        penalty[0] = -1
        known = np.append(0, np.flatnonzero(penalty >= 0))
        gap = np.diff(known)
        wide = np.flatnonzero(gap > GRID)
        steps = (gap[wide] - 1) // GRID
        penalty[known[wide].repeat(steps) + (bpe.ragged(np.ones(len(wide), np.int64), steps)) * GRID] = ANYWHERE
        places = np.flatnonzero(penalty >= 0)
        cuts = np.array(choose_cuts(places, penalty[places], self.length, not last), np.int64)
        closed = cuts if last else cuts[:-1]
        rows = self._rows(closed, ends)
        self._keep_from(int(closed[-1]) if len(closed) else 0, ends)
        return rows

    def _rows(self, cuts: np.ndarray, ends: np.ndarray) -> list[tuple]:
        if not len(cuts):
            return []
        stops = np.union1d(cuts, ends[ends < cuts[-1]])
        starts = np.append(0, stops[:-1])
        doc = np.searchsorted(ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        inside = starts - np.append(0, cuts[:-1])[window]
        offset = starts - (ends - self.size)[doc] + self.base[doc]
        raw = memoryview(self.ids.astype("<u4").tobytes())
        rows = [(self.keys[d], o, b - a, zlib.crc32(raw[4 * a: 4 * b]), t, self.sequence + w, i)
                for d, o, a, b, t, w, i in zip(doc.tolist(), offset.tolist(), starts.tolist(), stops.tolist(),
                                               self.total[doc].tolist(), window.tolist(), inside.tolist())]
        self.sequence += len(cuts)
        return rows

    def _keep_from(self, cut: int, ends: np.ndarray) -> None:
        d = int(np.searchsorted(ends, cut, side="right"))
        self.keys = self.keys[d:]
        if d < len(ends):
            gone = cut - int(ends[d] - self.size[d])
            self.base[d] += gone
            self.size[d] -= gone
        self.base, self.size, self.total = self.base[d:], self.size[d:], self.total[d:]
        self.ids, self.closing = self.ids[cut:], self.closing[cut:]


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = LENGTH,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start and length in its document, CRC of its ids, the document's
    tokens, the sequence and the offset there. Sequence ids are unique and start anew per task."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, strings = bpe.from_json(tokenizer)
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        names = ["key", *COLUMNS]
        key_type = None

        def table(found):
            columns = list(zip(*found))
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = size = 0
            for b, t in enumerate(texts, 1):
                size += len(t) + 1
                if size >= CHARACTERS or b == len(texts):
                    packer.add(keys[a:b], *tokenise(texts[a:b], vocabulary, strings, end))
                    a, size = b, 0
                    if len(packer.ids) >= BLOCK_TOKENS and (found := packer.pack(False)):
                        yield table(found)
        if found := packer.pack(True):
            yield table(found)

    out = rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} long" for c in COLUMNS))
    return out.withColumnRenamed("key", key)
