"""Splits and folds that keep the copies of a key together."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from moderata.operators import split
from moderata.plans.training import load_and_split

NAMES = ("hash_", "bin_", "at_", "before_", "rank_", "n_", "key_of_row", "size", "stratum")


def rows(n=400, seed=2):
    rng = random.Random(seed)
    out = [(i, f"text {rng.randrange(150)}", rng.choice((0, 0, 1))) for i in range(n)]
    out += [(1000 + i, "hot text", 1) for i in range(200)]  # a third of all rows
    out += [(2000 + i, None, 0) for i in range(5)] + [(2100 + i, f"no label {i % 3}", None) for i in range(9)]
    return out


def frame(spark, data=None):
    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string, label int")
    return df.withColumns({c: F.lit("mine") for c in NAMES})


def strata(data):
    """Stratum of every key, and rows per stratum."""
    by = collections.defaultdict(collections.Counter)
    for _, text, label in data:
        by[text][label] += 1
    chosen = {t: min(c, key=lambda x: (-c[x], x is None, x or 0)) for t, c in by.items()}
    sizes = {t: sum(c.values()) for t, c in by.items()}
    return chosen, sizes


@pytest.mark.parametrize("hot_rows", [50, 10**6])
@pytest.mark.parametrize("frac", [0.0, 0.15, 0.5])
def test_split(spark, hot_rows, frac):
    out = split.group_split(frame(spark), "label", frac, key="text", hot_rows=hot_rows).collect()
    data = rows()
    assert sorted((r.doc_id, str(r.text), str(r.label)) for r in out) == sorted((i, str(t), str(y)) for i, t, y in data)
    assert all(r[c] == "mine" for r in out for c in NAMES)
    sides = collections.defaultdict(set)
    for r in out:
        sides[r.text].add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    chosen, sizes = strata(data)
    for stratum in set(chosen.values()):
        keys = [t for t in chosen if chosen[t] == stratum]
        total, target = sum(sizes[t] for t in keys), round(sum(sizes[t] for t in keys) * frac)
        test = sum(sizes[t] for t in keys if sides[t] == {"test"})
        assert target <= test <= target + max(sizes[t] for t in keys) or (target == 0 and test == 0)
        assert total >= test


def test_folds(spark):
    data = rows()
    out = split.group_folds(frame(spark), 5, key="text", hot_rows=50).collect()
    assert len(out) == len(data)
    folds = collections.defaultdict(set)
    for r in out:
        folds[r.text].add(r.fold)
    assert all(len(f) == 1 for f in folds.values()) and {f for s in folds.values() for f in s} == set(range(5))
    chosen, sizes = strata(data)
    for stratum in set(chosen.values()):
        keys = [t for t in chosen if chosen[t] == stratum]
        total, widest = sum(sizes[t] for t in keys), max(sizes[t] for t in keys)
        for k in range(5):
            mine = sum(sizes[t] for t in keys if folds[t] == {k})
            assert abs(mine - total / 5) <= widest + 1
    again = split.group_folds(frame(spark).repartition(7), 5, key="text").collect()
    assert {(r.doc_id, r.fold) for r in again} == {(r.doc_id, r.fold) for r in out}
    assert split.group_folds(frame(spark), 1, key="text").filter("fold IS NOT NULL").isEmpty()


def test_hot_key_stays_where_it_is(spark):
    """The rows of a hot key are told by a broadcast; only the others are dealt by key."""
    plan = split.group_split(frame(spark), "label", key="text", hot_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2


def test_load_and_split_has_no_leak(spark):
    data = [(i, f"  Some  TEXT {i % 40}" if i % 2 else f"some text {i % 40}", "yes" if i % 3 else "no") for i in range(200)]
    df = spark.createDataFrame(data, "n long, body string, mark string")
    out = load_and_split(df, "body", "mark", ("yes",)).collect()
    assert len(out) == 200
    sides = collections.defaultdict(set)
    for r in out:
        sides[" ".join(r.text.lower().split())].add(r.split)
    assert all(len(s) == 1 for s in sides.values()) and {"test", "train"} == {x for s in sides.values() for x in s}


def test_exact_split_leaves_the_callers_columns(spark):
    out = split.stratified_split(frame(spark), "label", 0.3).collect()
    assert all(r[c] == "mine" for r in out for c in NAMES)
    folds = split.assign_folds(frame(spark), label="label").collect()
    assert all(r[c] == "mine" for r in folds for c in NAMES)


def test_empty(spark):
    assert split.group_split(frame(spark, []), "label", key="text").collect() == []
