"""Sampled Shapley values against all coalitions."""

import itertools
import math

import numpy as np
import pytest

from moderata.operators import explain

W = [0.7, -1.2, 2.0, 0.4, -0.3, 1.1, 0.9, -2.2]
ROWS = [(1, [0, 2, 5], [0.5, 0.5, 0.7]), (2, [1], [1.0]), (3, [], []), (4, [0, 1, 3, 4, 7], [0.1, 0.2, 0.3, 0.4, 0.5]),
        (5, [2, 6], [0.9, 0.1])]
BACKGROUND = [([0, 1], [0.6, 0.8]), ([2, 3, 6], [0.5, 0.5, 0.7]), ([], [])]


def scorer(kind):
    def make():
        w = np.array(W)

        def score(row, at, value, n):
            z = np.bincount(row, w[at] * value, n) - 0.2
            return {"linear": z, "prob": 1 / (1 + np.exp(-z)), "pairs": z + z * z}[kind]
        return score
    return make


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, at array<int>, value array<double>")


def exact(kind, at, value):
    """Shapley values of the row's features and of all others together, by all coalitions and the whole background."""
    score = scorer(kind)()
    players = [*at, None]

    def worth(inside):
        total = 0.0
        for b_at, b in BACKGROUND:
            row = dict(zip(b_at, b))
            mixed = {f: v for f, v in row.items() if (f in at and f not in inside) or (f not in at and None not in inside)}
            mixed |= {f: v for f, v in zip(at, value) if f in inside}
            f = sorted(mixed)
            total += score(np.zeros(len(f), np.int64), np.array(f, np.int64), np.array([mixed[x] for x in f]), 1)[0]
        return total / len(BACKGROUND)

    n = len(players)
    return {p: sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (worth({*s, p}) - worth(set(s)))
                   for k in range(n) for s in itertools.combinations([q for q in players if q != p], k)) for p in players}


@pytest.mark.parametrize("kind,pairs", [("linear", 1), ("pairs", 1), ("prob", 400)])
def test_against_all_coalitions(spark, kind, pairs):
    """A linear scorer and one with interactions of two are exact with one pair; others within four standard errors."""
    got = explain.shapley(frame(spark), scorer(kind), BACKGROUND, pairs).collect()
    for key, at, value in ROWS:
        want = exact(kind, at, value)
        mine = {r["at"]: r for r in got if r["doc_id"] == key}
        assert set(mine) == set(want)
        for p, phi in want.items():
            slack = 1e-9 if kind != "prob" else 4 * mine[p]["error"] + 1e-9
            assert abs(mine[p]["phi"] - phi) <= slack
        assert math.isclose(sum(r["phi"] for r in mine.values()), sum(want.values()), abs_tol=1e-9)


def test_same_values_wherever_a_document_lies(spark, monkeypatch):
    a = explain.shapley(frame(spark).repartition(1), scorer("prob"), BACKGROUND, 2).collect()
    b = explain.shapley(frame(spark, ROWS[::-1]).repartition(4), scorer("prob"), BACKGROUND, 2).collect()
    assert sorted(a, key=str) == sorted(b, key=str)
    assert {r["at"] for r in a if r["doc_id"] == 3} == {None}


def test_states_in_blocks_are_the_same():
    score = scorer("prob")()
    args = (score, np.array([0, 2, 5]), np.array([0.5, 0.5, 0.7]), np.array([2, 3]), np.array([0.5, 0.5]), np.array([3, 1, 0, 2]))
    whole = explain._walk(*args)
    kept, explain.STATE_ENTRIES = explain.STATE_ENTRIES, 7
    try:
        assert np.allclose(whole, explain._walk(*args))
    finally:
        explain.STATE_ENTRIES = kept


def test_background_is_needed(spark):
    with pytest.raises(ValueError, match="background"):
        explain.shapley(frame(spark), scorer("linear"), [])
    rows = explain.background_rows(frame(spark), 2)
    assert len(rows) == 2 and rows == explain.background_rows(frame(spark).repartition(3), 2)


def test_additive_scorers_are_summed_along_a_walk(spark):
    """The same permutations and values as row by row; every part is asked for once a walk, not once a state."""
    asked = []

    def make(asked=None):
        w = np.resize(np.array(W), 3000)

        def part(at, value):
            if asked is not None:
                asked.append(len(at))
            return w[at] * value
        return explain.AdditiveScore(part, lambda z: 1 / (1 + np.exp(-(z - 0.2))))

    additive = explain.shapley(frame(spark), make, BACKGROUND, 3).orderBy("doc_id", "at").collect()
    stepwise = explain.shapley(frame(spark), scorer("prob"), BACKGROUND, 3).orderBy("doc_id", "at").collect()
    assert [(r["doc_id"], r["at"]) for r in additive] == [(r["doc_id"], r["at"]) for r in stepwise]
    assert np.allclose([(r["phi"], r["error"]) for r in additive], [(r["phi"], r["error"]) for r in stepwise])
    at = np.arange(3000)
    rows_b = [(np.array(a, np.int64), np.array(v, float)) for a, v in BACKGROUND]
    orders = np.array([np.random.default_rng(i).permutation(3001) for i in range(3)])
    gains = explain._additive_walks(make(asked), at, np.full(3000, 0.01), rows_b, 1, orders)
    assert gains.shape == (3, 3001) and sum(asked) <= 3000 + 5
