"""Exact deduplication against a minimal perfect hash of historical digests.

The history's distinct digests are dealt into parts by their first bytes; each
part is a minimal perfect hash (levels of bit arrays; a digest's slot is the
rank of its bit) whose slots hold the full digest and the locator of the
winner: the key that stays, the size of the group and the winner's copies. A
document probes its part's array; the stored digest is compared byte by byte,
so a stranger that falls on a slot is told apart. Strangers are grouped among
themselves.

Rows are counted per (key, digest) first, with partial sums. Digests held by
more than ``1 / HEAVY`` of all rows, fewer than HEAVY of them whatever the
size, form one small array that every task has; their rows are spread by key.
So a text on a third of all rows meets no task as a whole.

Keys may be of any ordered type (numbers, texts, dates); they are compared and
returned as they are. Very long texts are only hashed.

Texts are equal when identical; null counts as the empty text. Of equal texts
the row with the largest key stays. Rows that repeat key and text are one
record several times: exactly one of them stays. Null keys lose against others;
among null keys one row stays. An empty table gives an empty result. Other
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix
from .workspace import fresh, written

HEAVY = 10_000
PART_ROWS = 20_000
MIN_PARTS = 64
GAMMA = 2.0


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2].copy()


def pack_digests(digests) -> np.ndarray:
    """Binary digests of 32 bytes as rows of a byte matrix."""
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests, with the digests in its slots."""

    def __init__(self, digests: np.ndarray):
        n = len(digests)
        self.levels: list[np.ndarray] = []
        self.ranks: list[int] = []
        self.bits: list[np.ndarray] = []
        todo, base = np.arange(n), 0
        x, y = _halves(digests)
        slot = np.zeros(n, np.int64)
        while len(todo):
            size = max(64, int(GAMMA * len(todo)))
            at = self._place(x[todo], y[todo], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            placed = alone[at]
            before = np.cumsum(alone) - alone
            slot[todo[placed]] = base + before[at[placed]]
            self.levels.append(np.packbits(alone))
            self.bits.append(size)
            self.ranks.append(base)
            base += int(alone.sum())
            todo = todo[~placed]
        self.order = np.empty(n, np.int64)
        self.order[slot] = np.arange(n)  # slot -> number of the digest as given
        self.slots = digests[self.order]

    @staticmethod
    def _place(x, y, level, size):
        mixed = mix(x + y * np.uint64(2 * level + 1) + np.uint64(level))
        return (mixed % np.uint64(size)).astype(np.int64)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Number of each digest as given when the hash was built; -1 for strangers."""
        out = np.full(len(digests), -1, np.int64)
        todo = np.arange(len(digests))
        x, y = _halves(digests)
        for level, (packed, size, rank) in enumerate(zip(self.levels, self.bits, self.ranks)):
            alone = np.unpackbits(packed, count=size)
            at = self._place(x[todo], y[todo], level, size)
            hit = alone[at] == 1
            slot = rank + (np.cumsum(alone, dtype=np.int64) - alone)[at[hit]]
            same = (self.slots[slot] == digests[todo[hit]]).all(1)  # byte check
            found = todo[hit]
            out[found[same]] = self.order[slot[same]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, copies) of the distinct records."""
    return docs.select(
        F.col(key).alias("key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest")
    ).groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"))


def winners(found: DataFrame) -> DataFrame:
    """(digest, keep, size) of every distinct digest of ``records``."""
    return found.groupBy("digest").agg(F.max("key").alias("keep"), F.sum("copies").alias("size"))


def locate(found: DataFrame, history: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``found`` with the winner and group size of the history's digests; ``member`` is false for strangers.

    Keys stay Arrow values of their own type all the way, so nulls beside them change nothing.
    """
    total, distinct = history.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    parts = max(MIN_PARTS, (distinct or 0) // PART_ROWS, int(total // PART_ROWS))
    top = history.filter(F.col("size") * heavy > total).select("digest", "keep", "size").toArrow()  # fewer than ``heavy`` rows
    array = PerfectHash(pack_digests(top.column("digest").to_pylist())) if top.num_rows else None
    keep, size = (top.column(c).combine_chunks() for c in ("keep", "size"))
    kind = found.schema["key"].dataType.simpleString()
    shape = f"key {kind}, digest binary, copies long, keep {kind}, size long, member boolean"
    names = ["key", "digest", "copies", "keep", "size", "member"]

    def heavy_ones(batches):
        for batch in batches:
            at = np.full(batch.num_rows, -1)
            if array is not None and batch.num_rows:
                at = array.find(pack_digests(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_winner(at, keep, size, batch.column(0).type)], names)

    by_digest = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(parts))
    marked = found.select("key", "digest", "copies").mapInArrow(heavy_ones, shape).withColumn(
        "part", F.when(F.col("member"), F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(by_digest))
    index = history.filter(F.col("size") * heavy <= total).select("digest", "keep", "size").withColumn("part", by_digest)

    def probe(rows: pa.Table, listed: pa.Table) -> pa.Table:
        rows, listed = rows.select(names).combine_chunks(), listed.combine_chunks()
        todo = ~rows.column("member").to_numpy()
        if not (todo.any() and listed.num_rows):
            return rows
        at = np.full(rows.num_rows, -1)
        at[todo] = PerfectHash(pack_digests(listed.column("digest").to_pylist())).find(
            pack_digests(rows.column("digest").filter(pa.array(todo)).to_pylist()))
        won = _winner(at, listed.column("keep").combine_chunks(), listed.column("size").combine_chunks(), rows.column("key").type)
        known = rows.column("member").combine_chunks()
        return pa.table([*rows.columns[:3], *(pc.if_else(known, rows.column(n), w) for n, w in zip(names[3:], won))], names)

    return marked.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(probe, shape)


def _winner(at: np.ndarray, keep: pa.Array, size: pa.Array, kind: pa.DataType) -> list[pa.Array]:
    """(keep, size, member) of every row from the slots found; none for -1."""
    slot = pa.array(at, pa.int64(), mask=at < 0)
    return [keep.cast(kind).take(slot), size.cast(pa.int64()).take(slot).fill_null(0), pa.array(at >= 0)]


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, key: str = "doc_id", text: str = "text",
                heavy: int = HEAVY) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    ``history`` has the same columns. Without one, the documents are their own
    history. With one, texts that it holds are repeats of its winners and none
    of their rows stays; the other texts are grouped among themselves.
    """
    found = written(records(docs, key, text), "records")
    if history is None:
        located = locate(found, written(winners(found), "winners"), heavy)
    else:
        past = written(winners(records(history, key, text)), "winners")
        located = written(locate(found, past, heavy), "located")
        strangers = located.filter("NOT member").select("key", "digest", "copies")
        # The strangers are grouped like a history of their own.
        apart = locate(strangers, written(winners(strangers), "winners"), heavy).withColumn("member", F.lit(False))
        located = located.filter("member").union(apart)
    stays = F.col("key").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)
    if history is not None:
        stays = stays & ~F.col("member")
    return (
        located.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
                stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    judged = exact_dedup(docs, key=key, text=text)
    judged = written(judged.select(F.col(key).alias("key_"), "kept", "text_sha256"), "judged")
    each = judged.groupBy("key_", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    each = written(each, "each")
    own = fresh(docs, "digest")
    marked = docs.withColumn(own, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))

    def same(rows):
        return marked[key].eqNullSafe(rows["key_"]) & (marked[own] == rows["text_sha256"])

    gone = each.filter("NOT kept OR copies > 1")
    out = marked.join(gone, same(gone), "left_anti")
    repeated = each.filter("kept AND copies > 1")
    if not repeated.isEmpty():
        out = out.union(marked.join(repeated, same(repeated), "left_semi").dropDuplicates([key, own]))
    return out.drop(own)
