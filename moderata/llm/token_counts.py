"""Token counts by finite-state transducers.

Two deterministic transducers are run one after the other, and neither keeps
the tokens. The first is compiled from the split pattern: its states read
code-point symbols and mark where a word begins; the state maps of its blocks
are composed by a parallel prefix scan (``textscan``). The second is compiled
from the merges as words turn up: its transitions are whole words, each
annotated with the number of tokens the merges leave of it. A text's count is a
difference of two prefix sums over these annotations, plus one per special
string, which the library takes out before it splits.

Narrow; rows never meet. Null texts count as empty: no bytes, no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, textscan


class WordTransducer:
    """Word -> number of tokens, compiled on demand; emptied beyond ``limit`` words."""

    def __init__(self, vocabulary: bpe.Vocabulary, limit: int = 300_000):
        self.vocabulary, self.limit, self.emitted = vocabulary, limit, {}

    def counts(self, words: pa.Array) -> np.ndarray:
        if len(self.emitted) > self.limit:
            self.emitted = {}
        listed = words.to_pylist()
        out = np.fromiter((self.emitted.get(w, -1) for w in listed), np.int64, len(listed))
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.vocabulary.encode(words.take(pa.array(new)))[1]
            self.emitted.update((listed[i], int(out[i])) for i in new.tolist())
        return out


def split_special(texts: list[str], special: regex.Pattern | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(parts between special strings, number of the text of each, special strings per text)."""
    found = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        cut = special.split(text) if special is not None else [text]
        found[i] = len(cut) - 1
        parts += cut
        owner += [i] * len(cut)
    return parts, np.array(owner, np.int64), found


def count_tokens(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    ``tokenizer`` is the path, on every node, of a byte-level BPE tokenizer file
    whose words take one leading space.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, strings = bpe.from_json(tokenizer)
        words = WordTransducer(vocabulary)
        special = regex.compile("|".join(map(regex.escape, sorted(strings, key=len, reverse=True)))) if strings else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes = np.array([len(t.encode("utf-8")) for t in texts], np.int64)
            parts, owner, counts = split_special(texts, special)
            for chunk in textscan.chunks(parts):
                data, offsets, _, token_of = textscan.slices([t for _, t in chunk], textscan.ATTACHED)
                coded = bpe.binary(data, offsets).dictionary_encode()
                emitted = words.counts(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
                total = np.append(0, np.cumsum(emitted))
                np.add.at(counts, owner[[i for i, _ in chunk]], np.diff(total[token_of]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(counts)], ["key", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("key", key)
