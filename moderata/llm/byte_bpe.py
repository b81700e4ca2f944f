"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised (``textscan``): code-point classes and a scan of
transition functions give the byte slices of all texts of a batch, without a
regular expression. Distinct slices of a batch are merged once, and a bounded
cache keeps the ids of slices seen before. The ids of a text are gathered from
those of its slices; the byte offset at which every id ends can be kept.

Both operators are narrow: rows never meet. Null texts count as empty and give
no ids. Repeated rows give repeated results; an empty table gives an empty
result. Offsets count bytes in 32 bits, so one text may have up to 2 GiB; very
long texts are cut into parts at safe places and batches are kept small. Other
columns are left out, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, textscan


GROUP = 1 << 20  # characters of a batch that goes on


def encode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """(key, ids[, ends]): the ids of every whole text, and the byte offset at which each id ends.

    ``ranks`` is the path of a file of base64 tokens and ranks, present on every node.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.from_ranks(ranks)
        cache = bpe.WordCache(vocabulary)
        widths = np.array([len(t) for t in vocabulary.tokens], np.int32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in textscan.groups(texts, GROUP):  # small batches go on, so memory is bounded by a group
                count = np.zeros(b - a, np.int64)
                pieces = [np.zeros(0, np.int32)]
                for part in textscan.chunks(texts[a:b]):
                    ids, owner_count = _encode_part([t for _, t in part], cache)
                    np.add.at(count, [i for i, _ in part], owner_count)
                    pieces.append(ids)
                ids, cuts = np.concatenate(pieces), np.append(0, np.cumsum(count))
                columns = [batch.column(0).slice(a, b - a), _lists(cuts, ids)]
                if offsets:
                    total = np.append(0, np.cumsum(widths[ids], dtype=np.int64))
                    ends = total[1:] - np.repeat(total[cuts[:-1]], count)
                    columns.append(_lists(cuts, ends.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "ends"][: len(columns)])

    schema = f"key {kind}, ids array<int>" + (", ends array<int>" if offsets else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _encode_part(texts: list[str], cache: bpe.WordCache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    data, offsets, _, token_of = textscan.slices(texts, textscan.ATTACHED)
    words = bpe.binary(data, offsets).dictionary_encode()
    ids, count = cache.encode(words.dictionary)
    at = words.indices.to_numpy(zero_copy_only=False)
    start, each = np.cumsum(count) - count, count[at]
    total = np.append(0, np.cumsum(each))
    return ids[bpe.ragged(start[at], each)], np.diff(total[token_of])


def _lists(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", out: str = "bytes", ends: str | None = None) -> DataFrame:
    """``encoded`` with the bytes of its ids in ``out``; null ids count as none.

    With ``ends``, the column of byte offsets kept in encoding, the offset of
    every id must be where its bytes end; ids that do not fit them are an error.
    """
    position = encoded.columns.index(ids)
    kept = encoded.columns.index(ends) if ends else None
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(bpe.from_ranks(ranks).tokens, pa.large_binary())
        for batch in batches:
            lists = batch.column(position).fill_null([])
            flat = tokens.take(lists.flatten())
            at = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
            each = lists.value_lengths().to_numpy(zero_copy_only=False)
            cuts = at[np.append(0, np.cumsum(each))]
            if kept is not None:
                stored = batch.column(kept).fill_null([]).flatten().to_numpy(zero_copy_only=False)
                if not np.array_equal(stored, at[1:] - np.repeat(cuts[:-1], each)):
                    raise ValueError("ids do not end at the offsets kept with them")
            joined = pa.Array.from_buffers(pa.binary(), batch.num_rows,
                                           [None, pa.py_buffer(cuts.astype(np.int32)), flat.buffers()[2]])
            yield pa.RecordBatch.from_arrays([*batch.columns, joined], [*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the bytes they decode to."""
    back = decode(encode(docs, ranks), ranks, ends="ends")
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
