"""Exact similarity join of documents on their sets of word shingles, by grouped prefixes.

Two sets of sizes x and y with Jaccard similarity of at least t share at least
``ceil(t * max(x, y))`` members, so in any common order of all shingles their
prefixes of length ``size - ceil(t * size) + 1`` meet. The order puts shingles
that many documents share last and the most common ones at the very end, hence
a passage found everywhere does not make candidates. The steps:

1. Count the shingles and note those in more than ``common`` documents with
   their counts: sorted arrays whose size is checked before they are sent to the
   tasks. (If there were more than ``MAX_COMMON``, the bar is raised.)
2. Collapse documents with one prefix and one size into a group; the group's key
   stands for all of them. Spread (shingle, group) over buckets of the hash
   space, as arrays; in a bucket, groups that share a shingle and whose sizes
   allow it are a candidate pair. Where many groups share one, they are paired
   with a few pivots first, and their list is kept.
3. Expand groups to classes of equal sets, verify pairs with their whole sets.
4. Components of the links. Lists and groups that are not in one component yet
   are now paired across components, which finds every other link that could
   join two components. Pairs inside a component need no test. Lists are cut
   into blocks of groups, and each pair of blocks is work of its own.

Sets travel as 32-bit fingerprints. Equal codes of two sets raise the count of
shared members, equal codes inside a set lower it; pairs that either could move
across the threshold are verified again with 64 bits.

Contract: equal sets are one class. Documents without words have empty sets and
link with nothing. Null texts have no words. Rows that repeat a key are
separate documents under the same key and are joined by it. A document with a
null key links with nothing and has no component. An empty table gives an empty
result. Other columns are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, shingles, textscan
from .components import components
from .workspace import written

COMMON = 4
MAX_COMMON = 1_000_000
FEW = 8  # groups that share a shingle and are paired outright
BUCKET_ENTRIES = 400_000
MIN_BUCKETS = 64
SALT_PAIRS = 256  # partners of one document verified in one task
CALL_PAIRS = 2_000
BATCH = 1 << 20  # characters hashed at once
LAST_PLACE = (1 << 16) - 1  # places from here on are not told apart
LIST_CALL = 400_000  # list members in one call
LIST_PIECE = 1 << 17  # list members in one row
BLOCK = 1_000  # members of one list in a block, about
HELD_PAIRS = 1 << 20  # pairs kept for finding repeats
COUNT_CHARS = 24_000_000  # characters per bucket of the count
SPREAD = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("groups", pa.binary()), ("places", pa.binary()),
                    ("documents", pa.binary())])


class Threshold:
    """A similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, size):
        return -(-size * self.num // self.den)

    def prefix(self, size):
        return np.where(size > 0, size - self.needed(size) + 1, 0)

    def sizes_fit(self, small, large):
        return small * self.den >= large * self.num

    def overlap(self, x, y):
        """Members that sets of sizes x and y share at least."""
        return -(-(x + y) * self.num // (self.num + self.den))

    def reachable(self, x, y, place_x, place_y):
        """Whether a first common member at these places leaves enough behind it in both sets."""
        need = self.overlap(x, y)
        return (place_x <= x - need) & (place_y <= y - need)

    def holds(self, shared, x, y):
        return shared * self.den >= self.num * (x + y - shared)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, by its low bits."""
    return (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)


def _blobs(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row per bucket: the bytes of each array's part."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    parts = {name: [x.tobytes() for x in np.split(a[order], cut[1:])] if len(cut) else [] for name, a in arrays.items()}
    return pd.DataFrame({"bucket": bucket[cut].astype(np.int32), **parts})


def _prefixes(texts: list[str], k: int, t: Threshold, common: np.ndarray, often: np.ndarray):
    """(prefix hashes in order, prefix length, size and group key of each text, digests of the whole sets)."""
    value, size = shingles.shingle_sets(texts, k)
    owner = np.repeat(np.arange(len(texts)), size)
    digest = [np.zeros(len(texts), np.uint64) for _ in range(2)]
    for seed, d in enumerate(digest):
        np.add.at(d, owner, shingles.mix(value + np.uint64(seed * 0x5851F42D4C957F2D + 1)))
    if len(common):
        code = _short(value)
        at = np.searchsorted(common, code)
        at = np.minimum(at, len(common) - 1)
        held_by = np.where(common[at] == code, often[at], 0)
        order = np.lexsort((value, held_by, owner))
        value = value[order]
    length = t.prefix(size)
    place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    front = value[place < np.repeat(length, size)]
    owner = np.repeat(np.arange(len(texts)), length)
    mark = np.zeros(len(texts), np.uint64)
    np.add.at(mark, owner, shingles.mix(front ^ np.uint64(0x2545F4914F6CDD1D)))
    # 24 bits of size (sizes beyond count as "any"), 40 bits of digest.
    group = np.minimum(size, (1 << 24) - 1).astype(np.uint64) << np.uint64(40) | shingles.mix(mark) >> np.uint64(24)
    return front, length, size, group, digest


COUNTED = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("times", pa.binary())])


def common_shingles(docs: DataFrame, k: int, common: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ascending 32-bit codes of the shingles in more than ``common`` documents, documents of each, shingles in all)."""
    buckets = max(least, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // COUNT_CHARS)

    def emit(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, held = frame.column(1).to_pylist(), []
            for a, b in textscan.groups(texts, BATCH):
                held.append(_short(shingles.shingle_sets(texts[a:b], k)[0]))
            code, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = code.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)
            once = n == 1  # most are, and need no count
            rows = pd.concat([_blobs(bucket[once], {"codes": code[once]}).assign(times=None),
                              _blobs(bucket[~once], {"codes": code[~once], "times": n[~once].astype(np.uint32)})])
            yield pa.RecordBatch.from_pandas(rows[COUNTED.names], schema=COUNTED, preserve_index=False)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        codes = [np.frombuffer(x, np.uint32) for x in rows["codes"]]
        times = [np.ones(len(c), np.uint32) if x is None else np.frombuffer(x, np.uint32) for c, x in zip(codes, rows["times"])]
        code, times = np.concatenate(codes), np.concatenate(times)
        order = np.argsort(code)
        code, times = code[order], times[order].astype(np.int64)
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        code, n = code[start], np.add.reduceat(times, start)
        kept = n > common
        return pd.DataFrame({"codes": [code[kept].tobytes()], "n": [n[kept].tobytes()], "total": [n.sum()]})

    counted = docs.mapInArrow(emit, "bucket int, codes binary, times binary").groupBy("bucket").applyInPandas(
        count, "codes binary, n binary, total long")
    counted = written(counted, "common")  # a few arrays per bucket, not rows
    found, total = counted.agg(F.sum(F.octet_length("codes") / 4), F.sum("total")).first()

    def above(bar):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                code, n = ([np.frombuffer(x, kind) for x in frame[name]] for name, kind in (("codes", np.uint32), ("n", np.int64)))
                yield pd.DataFrame({"codes": [c[m > bar].tobytes() for c, m in zip(code, n)],
                                    "n": [m[m > bar].tobytes() for m in n]})
        return run

    bar = common
    while (found or 0) > MAX_COMMON:
        bar *= 2
        found = counted.mapInPandas(above(bar), "codes binary, n binary").agg(F.sum(F.octet_length("codes") / 4)).first()[0]
    rows = counted.mapInPandas(above(bar), "codes binary, n binary").collect()  # 12 MB at most
    codes = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r["codes"], np.uint32) for r in rows)])
    often = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["n"], np.int64) for r in rows)])
    order = np.argsort(codes)
    return codes[order], often[order], int(total or 0)


def _small_runs(length, size, place, group, t: Threshold):
    """Pairs in runs of at most FEW entries (arrays sorted by run, then size)."""
    start = np.cumsum(length) - length
    end = np.repeat(start + length, length)
    few = np.repeat(length <= FEW, length)
    at = np.arange(len(end))
    left, right = [], []
    for d in range(1, FEW):
        a = at[few & (at + d < end)]
        fits = t.sizes_fit(size[a], size[a + d]) & t.reachable(size[a], size[a + d], place[a], place[a + d])
        left.append(group[a[fits]])
        right.append(group[a[fits] + d])
    return left, right


def _star(size: np.ndarray, place: np.ndarray, t: Threshold):
    """(pivot, other) places of a long run: the member with the fewest rare shingles before the
    common one is likely the text that the others were made from; sizes that do not fit it get
    another pivot."""
    todo = np.lexsort((np.arange(len(size)), place))
    while len(todo) > 1:
        pivot, rest = todo[0], todo[1:]
        fits = t.sizes_fit(np.minimum(size[rest], size[pivot]), np.maximum(size[rest], size[pivot]))
        yield np.full(int(fits.sum()), pivot), rest[fits]
        todo = rest[~fits]


def _sizes(group: np.ndarray) -> np.ndarray:
    return (group >> np.uint64(40)).astype(np.int64)


LISTED = np.dtype([("group", "<u8"), ("code", "<u4"), ("place", "<u4")])


def bucket_pairs(rows: pd.DataFrame, t: Threshold) -> pd.DataFrame:
    """Candidate pairs of groups in one bucket (kind 0), long lists of groups (kind 1), documents passed on (kind 2)."""
    documents = rows["documents"].dropna()
    bucket = int(rows["bucket"].iloc[0])
    rows = rows[rows["documents"].isna()]
    passed = pd.DataFrame({"kind": 2, "a": 0, "b": 0, "members": documents})
    if not len(rows):
        return passed
    code, group, place = (np.concatenate([np.frombuffer(x, kind) for x in rows[name]])
                          for name, kind in (("codes", np.uint32), ("groups", np.uint64), ("places", np.uint16)))
    order = np.lexsort((group, code))
    code, group, place = code[order], group[order], place[order].astype(np.int64)
    place[place == LAST_PLACE] = 0  # may be anywhere
    fresh = np.append(True, (code[1:] != code[:-1]) | (group[1:] != group[:-1])) if len(code) else np.zeros(0, bool)
    code, group, place = code[fresh], group[fresh], place[fresh]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(code)))
    keep = length > 1
    at = np.repeat(keep, length)
    code, group, place, length = code[at], group[at], place[at], length[keep]
    start = np.cumsum(length) - length
    size = _sizes(group)  # ascending in a run
    left, right = _small_runs(length, size, place, group, t)
    lists = []
    for i in np.flatnonzero(length > FEW):
        run = slice(start[i], start[i] + length[i])
        for pivot, other in _star(size[run], place[run], t):
            left.append(group[run][pivot])
            right.append(group[run][other])
        table = np.empty(length[i], LISTED)
        table["group"], table["code"], table["place"] = group[run], code[run], place[run]
        lists += [table[j: j + LIST_PIECE].tobytes() for j in range(0, len(table), LIST_PIECE)]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    out = pd.DataFrame({"kind": 0, "a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64), "members": None})
    more = pd.DataFrame({"kind": 1, "a": bucket, "b": 0, "members": lists})
    return pd.concat([x for x in (out, more, passed) if len(x)] or [out], ignore_index=True)


BLOOM_BITS = 1 << 24


def _bloom(ids: DataFrame) -> DataFrame:
    """A bit set of hashed ids as a table (w, m) of at most 2^18 rows: a filter that may pass more, never less."""
    return ids.select((F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)) / 64).cast("int").alias("w"),
                      F.expr("shiftleft(1L, CAST(pmod(xxhash64(id), 64) AS INT))").alias("m")
                      ).groupBy("w").agg(F.bit_or("m").alias("m"))


def verify(docs: DataFrame, pairs: DataFrame, k: int, t: Threshold, wide: bool = False) -> DataFrame:
    """(a, b, sure) of the pairs of documents whose sets are similar enough.

    Without ``wide`` the sets are 32-bit fingerprints and ``sure`` is false near the threshold.
    """
    kind = np.uint64 if wide else np.uint32
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    salted = pairs.join(counts, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / SALT_PAIRS)).cast("int").alias("salt"))
    salted = written(salted, "pairs")
    wanted = salted.select(F.col("b").alias("id"), "a", "salt").union(
        salted.select(F.col("a").alias("id"), "a", "salt").distinct())
    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(1).to_pylist()
            for a, b in textscan.groups(texts, BATCH):
                value, size = shingles.shingle_sets(texts[a:b], k)
                cut = np.cumsum(size)[:-1]
                held = [np.unique(x if wide else _short(x)).tobytes() for x in np.split(value, cut)]
                yield pa.RecordBatch.from_arrays(
                    [frame.column(0).slice(a, b - a), pa.array(size), pa.array(held, pa.binary())], ["id", "size", "members"])

    passing = written(_bloom(wanted.select("id").distinct()), "passing")
    kept = (
        docs.withColumn("w", (F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS)) / 64).cast("int"))
        .join(F.broadcast(passing), "w")  # 4 MB at most, whatever the data
        .filter(F.expr("shiftright(m, CAST(pmod(xxhash64(id), 64) AS INT)) & 1") == 1)
        .select("id", "text").mapInArrow(sets, "id long, size long, members binary"))
    loaded = wanted.join(kept, "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": [], "b": [], "sure": []})]
        for _, part in rows.groupby(["a", "salt"], sort=False):
            own = part["id"].to_numpy() == part["a"].to_numpy()
            other = part[~own]
            ids, y = other["id"].to_numpy(), other["size"].to_numpy(np.int64)
            theirs = [np.frombuffer(m, kind) for m in other["members"]]
            for raw, x in set(zip(part["members"][own], part["size"][own])):  # several if a key repeats
                mine = np.frombuffer(raw, kind)
                holds, sure = similar(mine, x, theirs, y, t, wide)
                found.append(pd.DataFrame({"a": part["a"].iloc[0], "b": ids[holds], "sure": sure[holds]}))
        return pd.concat(found)

    # Many pivots share a task's call; one pivot's partners are in several.
    calls = max(MIN_BUCKETS, salted.count() // CALL_PAIRS)
    called = loaded.withColumn("call", F.pmod(F.xxhash64("a", "salt"), F.lit(calls)))
    return called.groupBy("call").applyInPandas(compare, "a long, b long, sure boolean")


def similar(mine: np.ndarray, x: int, theirs: list[np.ndarray], y: np.ndarray, t: Threshold,
            wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(may be similar enough, is so for sure) of one set and others, from their distinct codes and true sizes."""
    shared = np.array([_shared(mine, m) for m in theirs], np.int64)
    if wide:
        return t.holds(shared, x, y), t.holds(shared, x, y)
    # Members that share a code with another of their set are stored once.
    lost = x - len(mine) + y - np.array([len(m) for m in theirs], np.int64)
    return t.holds(shared + lost, x, y), t.holds(shared - 4 - (4 * x * y >> 32), x, y)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def links(docs: DataFrame, pairs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """The pairs that are similar enough, exactly."""
    first = written(verify(docs, pairs, k, t), "verified")
    doubtful = first.filter("NOT sure").select("a", "b")
    sure = first.filter("sure").select("a", "b")
    if doubtful.isEmpty():
        return sure
    return sure.union(verify(docs, doubtful, k, t, wide=True).select("a", "b"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller key first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5,
                 num: int = 75, den: int = 100, common: int = COMMON) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key reachable by links of similarity >= num / den."""
    t = Threshold(num, den)
    everything = _texts(docs, key, text)
    rows = everything.filter("id IS NOT NULL")
    buckets = max(MIN_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    *frequent, entries = common_shingles(rows, k, common, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most 12 MB
    buckets = max(MIN_BUCKETS, int(t.prefix(np.int64(entries))) // BUCKET_ENTRIES)

    def spread(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, frame in enumerate(frames):
            texts, fronts, groups, places, about = frame.column(1).to_pylist(), [], [], [], []
            seen = np.zeros(0, np.uint64)
            for a, b in textscan.groups(texts, BATCH):
                front, length, size, group, digest = _prefixes(texts[a:b], k, t, *shared.value)
                about.append(np.stack([size, *(x.view(np.int64) for x in (group, *digest))], 1))
                new = ~np.isin(group, seen)
                first = np.zeros(len(group), bool)
                first[np.unique(group, return_index=True)[1]] = True
                new &= first
                seen = np.append(seen, group[new])
                fronts.append(front[np.repeat(new, length)])
                groups.append(np.repeat(group[new], length[new]))
                places.append(np.minimum(bpe.ragged(np.zeros(int(new.sum()), np.int64), length[new]), LAST_PLACE))
            front, group, place = (np.concatenate(x) for x in (fronts, groups, places))
            blobs = _blobs(_ranges(front, buckets), {
                "codes": _short(front), "groups": group, "places": place.astype(np.uint16)})
            ids = frame.column(0)
            table = np.column_stack([ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64),
                                     ids.fill_null(0).to_numpy(), np.concatenate(about)])
            # Documents ride along in pieces, dealt over the buckets.
            pieces = np.array_split(table, max(1, len(table) // 500))
            to = (np.arange(len(pieces)) + int(table[0, 1]) + number) % buckets
            riders = pd.DataFrame({"bucket": to.astype(np.int32), "documents": [x.tobytes() for x in pieces]})
            both = pd.concat([blobs, riders], ignore_index=True)[SPREAD.names]
            yield pa.RecordBatch.from_pandas(both, schema=SPREAD, preserve_index=False)

    found = (
        everything.mapInArrow(spread, "bucket int, codes binary, groups binary, places binary, documents binary")
        .groupBy("bucket").applyInPandas(lambda x: bucket_pairs(x, t), "kind int, a long, b long, members binary"))
    found = written(found, "candidates")

    def unfold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for raw in frame.column(0).to_pylist():
                table = np.frombuffer(raw, np.int64).reshape(-1, 6)
                ids = pa.array(table[:, 1], mask=table[:, 0] == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(table[:, i]) for i in range(2, 6))], ["id", "n", "g", "d1", "d2"])

    members = found.filter("kind = 2").select("members").mapInArrow(unfold, "id long, n long, g long, d1 long, d2 long")
    members = written(members, "members")
    classes = written(members.filter("n > 0 AND id IS NOT NULL").groupBy("g", "d1", "d2").agg(
        F.min("id").alias("id")), "classes")
    group_pairs = found.filter("kind = 0").select("a", "b").distinct()
    lists = found.filter("kind = 1").select(F.col("a").alias("bucket"), "members")

    # First pass: a group's first class stands for it as the left side, all classes as the right side.
    leads = classes.groupBy("g").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("width"))
    leads = written(leads, "leads")
    left = leads.select(F.col("g").alias("a"), "lead")
    right = classes.select(F.col("g").alias("b"), F.col("id").alias("other"))
    across = group_pairs.join(left, "a").join(right, "b").select(F.col("lead").alias("a"), F.col("other").alias("b"))
    within = leads.filter("width > 1").join(classes, "g").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    tested = written(ordered(across.union(within)), "tested")
    linked = written(links(rows, tested, k, t), "linked")
    label = components(linked)

    # Second pass: what is left between components.
    placed = written(
        classes.join(label.withColumnRenamed("node", "id"), "id", "left")
        .select("id", "g", F.coalesce("component", "id").alias("c")), "placed")
    areas = placed.select("g", "c").distinct()
    open_pairs = _between_components(group_pairs, lists, leads, areas, t)
    near, far = (placed.select(F.col("g").alias(f"g{i}"), F.col("c").alias(f"c{i}"), F.col("id").alias(x))
                 for i, x in ((1, "a"), (2, "b")))
    rest = ordered(open_pairs.join(near, ["g1", "c1"]).join(far, ["g2", "c2"]).select("a", "b"))
    rest = written(rest.join(tested, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        linked = linked.union(links(rows, rest, k, t))
        label = components(linked)

    of_class = classes.join(label.withColumnRenamed("node", "id"), "id", "left").select(
        "g", "d1", "d2", F.coalesce("component", "id").alias("component"))
    return (
        members.join(of_class, ["g", "d1", "d2"], "left")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))


def _between_components(group_pairs: DataFrame, lists: DataFrame, leads: DataFrame, areas: DataFrame,
                        t: Threshold) -> DataFrame:
    """(g1, c1, g2, c2): pairs of groups that may hold an untested link between two components."""
    wide = leads.filter("width > 1").select("g")
    left = wide.withColumnRenamed("g", "a")
    right = wide.withColumnRenamed("g", "b")
    unsure = group_pairs.join(left, "a", "left_semi").union(group_pairs.join(right, "b", "left_semi"))
    unsure = unsure.union(wide.select(F.col("g").alias("a"), F.col("g").alias("b"))).distinct()
    one = areas.select(F.col("g").alias("a"), F.col("c").alias("c1"))
    two = areas.select(F.col("g").alias("b"), F.col("c").alias("c2"))
    pairs = unsure.join(one, "a").join(two, "b").filter("c1 <> c2").select(
        F.col("a").alias("g1"), "c1", F.col("b").alias("g2"), "c2")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bucket, raw in zip(frame["bucket"], frame["members"]):
                x = np.frombuffer(raw, LISTED)
                yield pd.DataFrame({"bucket": bucket, "code": x["code"].astype(np.int64), "place": x["place"].astype(np.int64),
                                    "g": x["group"].view(np.int64)})

    listed = lists.mapInPandas(unpack, "bucket long, code long, place long, g long").join(areas, "g")
    listed = written(listed, "listed")
    # Lists that are neighbours in the order of shingles share a call, as they have many pairs in common.
    calls = max(MIN_BUCKETS, listed.count() // LIST_CALL)
    mixed = listed.groupBy("bucket", "code").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    mixed = mixed.select("bucket", "code", "n", F.expr(f"CAST((code * {calls}) div {1 << 32} AS INT)").alias("call"))
    # All lists of a call are cut by the same blocks of groups, so that a pair's repeats still meet.
    blocks = mixed.groupBy("call").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("blocks"))
    cut = listed.join(mixed.drop("n"), ["bucket", "code"]).join(F.broadcast(blocks), "call")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        *CUT[:1], F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *CUT[3:])
    crossed = cut.repartition(*CUT[:3]).sortWithinPartitions(*CUT[:5]).mapInPandas(
        lambda frames: cross_lists(frames, t), "g1 long, c1 long, g2 long, c2 long")
    return pairs.union(crossed).distinct()


CUT = ["call", "lo", "hi", "bucket", "code", "block", "g", "c", "place"]


def cross_lists(frames: Iterator[pd.DataFrame], t: Threshold) -> Iterator[pd.DataFrame]:
    """(g1, c1, g2, c2) of rows in the order of ``CUT[:5]``; a list may go on in the next frame."""
    names = ["g1", "c1", "g2", "c2"]
    rest, held, n, about = np.zeros((0, len(CUT)), np.int64), [], 0, None
    for frame in itertools.chain(frames, [None]):
        table = rest if frame is None else np.concatenate([rest, frame[CUT].to_numpy(np.int64)])
        start = np.flatnonzero(np.append(True, (table[1:, :5] != table[:-1, :5]).any(1))) if len(table) else np.zeros(0, int)
        ends = np.append(start[1:], len(table))
        if frame is not None:  # the last list may be unfinished
            rest = table[start[-1]:] if len(start) else table
            start, ends = start[:-1], ends[:-1]
        for a, b in zip(start, ends):
            if about != (about := tuple(table[a, :3])) or n > HELD_PAIRS:
                if held:
                    yield pd.DataFrame(np.unique(np.concatenate(held), axis=0), columns=names)
                held, n = [], 0
            for found in cross(table[a:b], t):
                held.append(found)
                n += len(found)
                if n > HELD_PAIRS:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    n = len(held[0])
                    if n > HELD_PAIRS // 2:
                        yield pd.DataFrame(held[0], columns=names)
                        held, n = [], 0
    if held:
        yield pd.DataFrame(np.unique(np.concatenate(held), axis=0), columns=names)


def cross(rows: np.ndarray, t: Threshold) -> Iterator[np.ndarray]:
    """Pairs of one list between two blocks, or inside one, that lie in two components.

    One of a pair is outside the largest component, so only those members look for partners.
    """
    rows = rows[np.argsort(_sizes(rows[:, 6].copy().view(np.uint64)), kind="stable")]
    whole = rows[0, 1] == rows[0, 2]
    block, g, c, place = (np.ascontiguousarray(rows[:, i]) for i in range(5, 9))
    size = _sizes(g.view(np.uint64))
    component, members = np.unique(c, return_counts=True)
    outside = c != component[members.argmax()]
    since = np.searchsorted(size * t.den, size * t.num, "left")
    upto = np.searchsorted(size * t.num, size * t.den, "right")
    for i in np.flatnonzero(outside):
        other = np.arange(since[i], upto[i])
        other = other[(c[other] != c[i]) & (~outside[other] | (other > i))]
        if not whole:
            other = other[block[other] != block[i]]
        other = other[t.reachable(size[i], size[other], place[i], place[other])]
        if len(other):
            swap = g[other] < g[i]
            mine = np.stack([np.full(len(other), g[i]), np.full(len(other), c[i])], 1)
            theirs = np.stack([g[other], c[other]], 1)
            yield np.where(swap[:, None], np.hstack([theirs, mine]), np.hstack([mine, theirs]))
