"""Exact top-k by inner product: a Voronoi join of queries with all vectors.

At most PIVOTS vectors, a sample by hash, are pivots; every vector belongs to
the cell of its nearest pivot. Two summaries are taken: of the queries, their
number in every cell and the largest distance u from one of them to its pivot
p; of all vectors, for every such cell the k + 1 largest scores that are
certain for all its queries. For a query q of the cell and a vector x,
``|q - p| <= u`` gives

    p.x - u|x|  <=  q.x  <=  p.x + u|x|,

and the triangle inequality on distances gives
``(|q|^2 + |x|^2 - (u + |p - x|)^2) / 2 <= q.x <= (|q|^2 + |x|^2 - max(0, |p - x| - u)^2) / 2``.
The (k + 1)-th certain score of distinct ids bounds every query's k-th best
from below (one of them may be the query's own). A vector goes only to the
groups of cells where its upper bound reaches that; the rest cannot be an
answer. Cells are grouped, near pivots together, up to QUERY_BLOCK queries; a
cell with more is split. The vectors of a group are dealt in turn into slices,
so no vector or id, however common, gathers in one task; a task holds one
group's queries and streams its slice past them, keeping k answers a query. The
slices' answers are ranked once more.

Scores are exact: whole numbers in float64 products while these stay below
2^50, Python integers beyond; scores beyond 64 bits count as the largest or
least long.

Nulls: vectors that are null or hold a null or a component that is not finite
take no part (nor do those whose components leave the floats when scaled). A
null id is no query, and as a candidate comes after all others of its score. Ties go to the smaller id. Rows that repeat a query's id and
vector are asked once; no row with a query's id is its candidate; other repeated
rows are candidates each. Shorter vectors count as filled up with zeros; an
empty one scores 0 with all. Fewer than k candidates are all returned. An empty
table gives an empty result. Columns other than the two named are left out, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

PIVOTS = 64
QUERY_BLOCK = 4096
SLICE_ROWS = 1 << 20
CHUNK = 4096  # vectors scored at once
STRIP = 512  # queries scored at once
SEND = 1 << 18  # rows sent at once
ROUNDING = 1e-6  # relative, far above that of a distance from squares
EXACT = float(1 << 50)
LONG = (1 << 63) - 1


def quantised(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, vec): the vectors that take part, times ``scale``; their floors are taken in :func:`matrix`."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    named = rows.select(F.col(key).cast("long").alias("id"), scaled.alias("vec"))
    return named.filter(F.col("vec").isNotNull() & F.forall("vec", lambda x: F.abs(x) < float("inf")))


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Floors of a column of lists, shorter ones filled up with zeros."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out


def packed(x: np.ndarray, kind: str) -> pa.Array:
    """The rows of a matrix as byte strings."""
    raw = np.ascontiguousarray(x.astype(kind))
    width = raw.dtype.itemsize * x.shape[1]
    ends = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squares of the rows, products with the pivots, distances to them)."""
    square, product = (x * x).sum(1), x @ pivots.T
    apart = square[:, None] + (pivots * pivots).sum(1)[None] - 2 * product
    return square, product, np.sqrt(np.maximum(apart, 0))


class Cells:
    """What is known of the queries: per cell with queries its pivot, radius, and extreme squares of lengths."""

    def __init__(self, pivots: np.ndarray, found: list):
        self.number = [r["cell"] for r in found]
        self.pivots = pivots[self.number]
        self.low, self.high = np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
        self.length = np.sqrt((self.pivots * self.pivots).sum(1))
        self.radius = np.array([r["radius"] for r in found]) + ROUNDING * (self.length + np.sqrt(self.high))
        self.queries = [r["queries"] for r in found]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest possible score) of every row with the queries of every cell, allowing for rounding."""
        square, product, apart = distances(x, self.pivots)
        length = np.sqrt(square)[:, None]
        reach, error = self.radius * length, ROUNDING * (length + self.length)
        both = square[:, None] + np.stack([self.low, self.high])[:, None]
        least = np.maximum(product - reach, (both[0] - (self.radius + apart + error) ** 2) / 2)
        most = np.minimum(product + reach, (both[1] - np.maximum(0, apart - self.radius - error) ** 2) / 2)
        slack = ROUNDING * (1 + np.abs(product) + reach + both[1])
        # Values beyond the floats bound nothing; scores end at 64 bits.
        return (np.clip(np.nan_to_num(least - slack, nan=-np.inf), -float(LONG), float(LONG)),
                np.clip(np.nan_to_num(most + slack, nan=np.inf), -float(LONG), float(LONG)))

    def grouped(self) -> tuple[list[int], list[int], int]:
        """(first group, number of groups of every cell, all groups): near pivots share a group."""
        order, left = [], set(range(len(self.number)))
        while left:
            here = self.pivots[order[-1]] if order else self.pivots[0]
            nearest = min(left, key=lambda i: (((self.pivots[i] - here) ** 2).sum(), i))
            order.append(nearest)
            left.remove(nearest)
        first, parts, group, held = [0] * len(order), [1] * len(order), 0, 0
        for i in order:
            n = self.queries[i]
            if held and held + n > QUERY_BLOCK:
                group, held = group + 1, 0
            first[i], parts[i] = group, -(-n // QUERY_BLOCK)
            held += n
            if parts[i] > 1:
                group, held = group + parts[i], 0
        return first, parts, group + (held > 0)


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values."""
    if len(values) <= k:
        return np.arange(len(values))
    return np.argpartition(-values, k - 1)[:k]


class Best:
    """The k best candidates of some queries, while vectors stream past."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        n = len(ids)
        self.score = np.full((n, k), -np.inf)
        self.found = np.zeros((n, k), np.int64)
        self.none = np.ones((n, k), bool)
        self.peak = np.abs(queries).max(initial=0) * max(queries.shape[1], 1)
        self.whole = None  # Python integers, once products may be inexact

    def see(self, ids: np.ndarray, none: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((ids, none))
        ids, none, x = ids[order], none[order], x[order]
        if self.whole is not None or self.peak * np.abs(x).max(initial=0) * len(ids) >= EXACT:
            self._see_whole(ids, none, x)
            return
        real = ids[~none]
        low, high = np.searchsorted(real, self.ids), np.searchsorted(real, self.ids, "right")
        back = np.arange(len(ids))[::-1]
        for a in range(0, len(self.ids), STRIP):
            b = min(a + STRIP, len(self.ids))
            scores = self.queries[a:b] @ x.T
            for i in np.flatnonzero(high[a:b] > low[a:b]):
                scores[i, low[a + i]: high[a + i]] = -np.inf
            some = np.flatnonzero(scores.max(1) >= np.maximum(self.score[a:b, -1], -EXACT))
            if not len(some):
                continue
            scores = scores[some]
            if scores.shape[1] > self.k:
                # Among equal scores the smaller id: one whole number orders both.
                joint = np.where(np.isfinite(scores), scores, -EXACT / len(ids)) * len(ids) + back
                at = np.argpartition(joint, -self.k, axis=1)[:, -self.k:]
            else:
                at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
            rows = a + some
            score = np.concatenate([self.score[rows], np.take_along_axis(scores, at, 1)], 1)
            found = np.concatenate([self.found[rows], ids[at]], 1)
            nulls = np.concatenate([self.none[rows], none[at]], 1)
            top = np.lexsort((found, nulls, -score), axis=1)[:, : self.k]
            self.score[rows], self.found[rows], self.none[rows] = (
                np.take_along_axis(v, top, 1) for v in (score, found, nulls))

    def _see_whole(self, ids, none, x):
        if self.whole is None:
            self.whole = [[(-int(s), bool(o), int(f)) for s, o, f in zip(*row) if s > -np.inf]
                          for row in zip(self.score, self.none, self.found)]
            self.exact = [[int(v) for v in q] for q in self.queries]
        vectors = [[int(v) for v in row] for row in x]
        for i, q in enumerate(self.exact):
            new = [(-max(min(sum(map(int.__mul__, q, v)), LONG), -LONG - 1), bool(o), int(f))
                   for f, o, v in zip(ids, none, vectors) if o or f != self.ids[i]]
            self.whole[i] = sorted(self.whole[i] + new)[: self.k]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        """(number of the query, id, score)."""
        if self.whole is not None:
            for i, row in enumerate(self.whole):
                for s, o, f in row:
                    yield i, None if o else f, -s
            return
        for i, j in zip(*np.nonzero(self.score > -np.inf)):
            yield int(i), None if self.none[i, j] else int(self.found[i, j]), int(self.score[i, j])


def knn_join(rows: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding",
             pivots: int = PIVOTS, slices: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of ``rows`` with the highest score for every row of ``queries``."""
    data = quantised(rows, key, vector, scale)
    asked = quantised(queries, key, vector, scale).filter(F.col("id").isNotNull()).distinct()
    spark = rows.sparkSession
    widest = F.max(F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec"))))
    n, dims, peak = data.agg(F.count(F.lit(1)), F.max(F.size("vec")), widest).first()
    answers = "query long, id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, peak = max(dims, 1), (peak or 0.0) + 1
    kind = "<i2" if peak < 1 << 15 else "<i4" if peak < 1 << 31 else "<f8"

    sample = data.orderBy(F.xxhash64("id", "vec"), "id").limit(pivots).select("vec").toPandas()["vec"]
    centres = np.unique(matrix(pa.array([list(v) for v in sample], pa.list_(pa.float64())), dims), axis=0)

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            square, _, apart = distances(x, centres)
            cell = apart.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed(x, kind), pa.array(cell.astype(np.int32)),
                 pa.array(apart[np.arange(len(x)), cell]), pa.array(square)], ["id", "vec", "cell", "apart", "square"])

    placed = asked.mapInArrow(place, "id long, vec binary, cell int, apart double, square double")
    placed = written(placed.withColumn("query", F.monotonically_increasing_id()), "queries")
    about = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("queries"), F.max("apart").alias("radius"),
                                       F.min("square").alias("low"), F.max("square").alias("high")).orderBy("cell").collect()
    if not about:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = Cells(centres, about)

    def certain(batches):
        """Of every cell, the k + 1 largest scores that are certain, per task."""
        kept = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)) for _ in cells.number]
        for batch in batches:
            least, _ = cells.bounds(matrix(batch.column(1), dims))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for i in range(len(kept)):
                at = _largest(least[:, i], k + 1)
                new = [np.concatenate(pair) for pair in zip(kept[i], (ids[at], none[at], least[at, i]))]
                at = _largest(new[2], k + 1)
                kept[i] = tuple(v[at] for v in new)
        for i, (ids, none, least) in enumerate(kept):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=none), pa.array(least)], ["at", "id", "least"])

    sums = data.mapInArrow(certain, "at int, id long, least double").filter("id IS NOT NULL").groupBy("at", "id").agg(
        F.max("least").alias("least"))
    ranked = sums.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("least")))).filter(
        F.col("place") == k + 1)
    floor = np.full(len(cells.number), -np.inf)
    for r in ranked.collect():  # one row a cell
        floor[r["at"]] = r["least"]

    first, parts, groups = cells.grouped()
    slices = slices or max(-(-n // SLICE_ROWS), -(-2 * spark.sparkContext.defaultParallelism // groups))
    reaches = np.zeros((len(first), groups), np.float32)
    for i, (a, p) in enumerate(zip(first, parts)):
        reaches[i, a: a + p] = 1

    def send(batches):
        seen, size = 0, max(1, SEND // groups)
        for whole in batches:
            for batch in (whole.slice(a, size) for a in range(0, whole.num_rows, size)):
                x = matrix(batch.column(1), dims)
                _, most = cells.bounds(x)
                row, group = np.nonzero((most >= floor[None]).astype(np.float32) @ reaches > 0)
                turn = ((seen + row) % slices).astype(np.int32)
                seen += len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.astype(np.int32)), pa.array(turn), pa.nulls(len(row), pa.int64()),
                     batch.column(0).take(pa.array(row)), packed(x[row], kind)], ["group", "slice", "query", "id", "vec"])

    sent = data.mapInArrow(send, "group int, slice int, query long, id long, vec binary")
    where = spark.createDataFrame([(c, a, p) for c, a, p in zip(cells.number, first, parts)], "cell int, first int, parts int")
    own = placed.join(F.broadcast(where), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "query", "id", "vec")
    dealt = own.union(sent).repartition("group", "slice").sortWithinPartitions("group", "slice", F.col("query").asc_nulls_last())

    def solve(batches):
        def answered(numbers, best):
            out = list(best.rows())
            q, i, s = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array([numbers[x] for x in q], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())],
                ["query", "id", "score"])

        task, numbers, held, best = None, [], [], None
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
            asks = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            kinds = np.concatenate([at, asks[:, None]], 1)
            cuts = np.flatnonzero((kinds[1:] != kinds[:-1]).any(1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(at))):
                if task != tuple(at[a]):
                    if best is not None:
                        yield answered(numbers, best)
                    task, numbers, held, best = tuple(at[a]), [], [], None
                part = batch.slice(a, b - a)
                if asks[a]:
                    numbers += part.column(2).to_pylist()
                    held.append((part.column(3).to_numpy(zero_copy_only=False), unpacked(part.column(4), kind, dims)))
                    continue
                if best is None:
                    best = Best(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), k)
                for c in range(0, part.num_rows, CHUNK):
                    some = part.slice(c, CHUNK)
                    best.see(some.column(3).fill_null(0).to_numpy(zero_copy_only=False),
                             some.column(3).is_null().to_numpy(zero_copy_only=False), unpacked(some.column(4), kind, dims))
        if best is not None:
            yield answered(numbers, best)

    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    top = dealt.mapInArrow(solve, answers).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return top.join(placed.select("query", F.col("id").alias("query_id")), "query").select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
