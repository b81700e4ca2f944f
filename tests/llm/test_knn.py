"""The top-k join against all scores."""

import math
import random

import numpy as np
import pytest

from moderata.llm import knn_join as kj

SCHEMA = "vec_id long, embedding array<double>, id string, vec string, query string, rank string, `group` string, score string"
CLASH = ("a",) * 6
LONG = (1 << 63) - 1


def want(data, asked, k=20, scale=64):
    """Rows (query_id, rank, vec_id, score), each different query once."""
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    vectors = [(r[0], whole(r[1])) for r in data if whole(r[1]) is not None]
    out = []
    for q, v in {(r[0], tuple(whole(r[1]))) for r in asked if r[0] is not None and whole(r[1]) is not None}:
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, w)), LONG), -LONG - 1), i is None, i or 0)
                        for i, w in vectors if i != q)
        out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def clustered(n=900, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    return [(i, [float(x) for x in centres[i * i % 12] + rng.normal(size=dims) * 0.05], *CLASH) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def check(spark, data, asked=None, k=20, **options):
    asked = [r for r in data if r[0] is not None and r[0] % 20 == 0] if asked is None else asked
    got = kj.knn_join(frame(spark, data), frame(spark, asked), k, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == want(data, asked, k)


@pytest.mark.parametrize("block,slices", [(4096, None), (7, 3)])
def test_clusters(spark, monkeypatch, block, slices):
    monkeypatch.setattr(kj, "QUERY_BLOCK", block)
    check(spark, clustered(), k=5, slices=slices)


def test_awkward_rows(spark):
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1, 1) for _ in range(4)], *CLASH) for i in range(70)]
    data += [(i, v, *CLASH) for i, v in [
        (100, None), (101, [0.1, None, 0.2, 0.3]), (102, [math.nan, 0, 0, 0]), (103, [math.inf, 0, 0, 0]), (120, [-math.inf, 1, 1, 1]),
        (None, [5.0, 5.0, 5.0, 5.0]), (None, [5.0, 5.0, 5.0, 5.0]), (104, []), (140, []), (105, [9.0]), (106, [1.0, 1.0, 1.0, 1.0, 1.0]),
        (-20, [0.5, 0.5, 0.5, 0.5]), (20, [0.25, 0.5, 0.5, 0.5])]]
    data += [(40, [0.5, 0.5, 0.5, 0.5], *CLASH)] * 3 + [(41, [0.9, 0.9, 0.9, 0.9], *CLASH)] * 30  # repeated rows, ties
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], *c) for i, v, *c in data]
    check(spark, data)
    check(spark, data[:6], k=20)  # fewer than k candidates


def test_ties_of_a_hot_vector(spark):
    data = [(i, [0.5, 0.25], *CLASH) for i in range(400)] + [(i, [0.5, 0.25 + i / 5000], *CLASH) for i in range(400, 460)]
    check(spark, data, asked=[r for r in data if r[0] % 100 == 0])


@pytest.mark.parametrize("size", [1e7, 1e12, 1e30])
def test_large_components(spark, size):
    rng = random.Random(6)
    data = [(i, [rng.uniform(-size, size) for _ in range(3)], *CLASH) for i in range(60)]
    check(spark, data, k=7)


def test_only_needed_vectors_travel(spark):
    """Bounds of clusters that lie apart keep most vectors from most groups, and lose none of the answers."""
    data = clustered(600)
    found = np.array([r[1] for r in data])
    x = np.floor(64 * found)
    centres = np.unique(x[:40], axis=0)
    asked = x[::20]
    _, _, apart = kj.distances(asked, centres)
    cell = apart.argmin(1)
    about = [{"cell": int(c), "queries": int((cell == c).sum()), "radius": apart[cell == c, c].max(),
              "low": (asked[cell == c] ** 2).sum(1).min(), "high": (asked[cell == c] ** 2).sum(1).max()} for c in np.unique(cell)]
    cells = kj.Cells(centres, about)
    least, most = cells.bounds(x)
    scores = x @ asked.T
    for at, c in enumerate(cells.number):
        mine = scores[:, cell == c]
        assert (least[:, at] <= mine.min(1)).all() and (most[:, at] >= mine.max(1)).all()
    floor = np.sort(least, axis=0)[-6]
    assert (most >= floor).mean() < 0.5


def test_empty(spark):
    assert kj.knn_join(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).collect() == []
    none = [(1, [1.0], *CLASH)]
    assert kj.knn_join(frame(spark, none), spark.createDataFrame([], SCHEMA)).collect() == []
