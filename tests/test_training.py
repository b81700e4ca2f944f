"""Gradient training against a plain optimiser, and the tuned run."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moderata.operators import gradient as g
from moderata.plans.training import run_tuned


def posts(n=120, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        text = " ".join(rng.choice(words[:12] if y and rng.random() < 0.7 else words) for _ in range(rng.randrange(0, 12)))
        out.append((i, text, y, ("train", "train", "train", "val", "test")[i % 5]))
    return out + [(900, "", 1, "train"), (901, "unseen words only", 0, "val"), (902, None, 0, "train")]


def frame(spark, data=None):
    return spark.createDataFrame(posts() if data is None else data, "doc_id long, text string, label int, split string")


def features(spark, **kw):
    return g.feature_table(frame(spark), **kw)


def plain(found, loss, epochs, patience, lr=0.05, decay=0.01, gamma=2.0, alpha=0.25, clip=1.0, schedule="linear"):
    """The same optimiser on dense arrays, by loops."""
    rows = found.table.collect()
    d = len(found.terms) + 1

    def dense(r):
        x = np.zeros(d)
        x[list(r["at"])] = r["value"]
        x[-1] = 1
        return x

    train = [(dense(r), r["y"]) for r in rows if r["part"] == "train"]
    val = [(dense(r), r["y"]) for r in rows if r["part"] == "val"]
    n = {c: sum(y == c for _, y in train) for c in (0, 1)}
    inverse = {c: 1 / n[c] for c in n}
    weight = {c: inverse[c] / sum(inverse.values()) * 2 for c in n}

    def value(w):
        total = over = 0.0
        for x, y in train:
            p = 1 / (1 + math.exp(-float(x @ w)))
            pt = p if y else 1 - p
            if loss == "weighted":
                total, over = total - weight[y] * math.log(pt), over + weight[y]
            else:
                total, over = total - (1 - alpha if y else alpha) * (1 - pt) ** gamma * math.log(pt), over + 1
        return total / over

    def numeric(w):
        out = np.zeros(d)
        for i in range(d):
            step = np.zeros(d)
            step[i] = 1e-5
            out[i] = (value(w + step) - value(w - step)) / 2e-5
        return out

    def f1(w):
        c = [[0, 0], [0, 0]]
        for x, y in val:
            c[y][int(x @ w > 0)] += 1
        (tn, fp), (fn, tp) = c
        parts = [2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0, 2 * tn / (2 * tn + fp + fn) if 2 * tn + fp + fn else 0]
        return sum(parts) / 2

    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    best, kept, since, history = f1(w), w, 0, [f1(w)]
    for t in range(1, epochs + 1):
        if since >= patience:
            break
        grad = numeric(w)
        grad *= min(1.0, clip / np.linalg.norm(grad))
        rate = lr * g.factor(t, epochs, schedule)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w = w * (1 - rate * decay) - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        history.append(f1(w))
        if history[-1] > best:
            best, kept, since = history[-1], w, 0
        else:
            since += 1
    return kept, history


@pytest.mark.parametrize("loss", g.LOSSES)
def test_against_plain_optimiser(spark, loss):
    found = features(spark)
    model = g.fit(found, loss, epochs=6, patience=9, lr=0.3)
    w, history = plain(found, loss, 6, 9, lr=0.3)
    assert np.allclose([*model.coef, model.intercept], w, atol=1e-4)
    assert np.allclose([h["val_macro_f1"] for h in model.history], history)
    losses = [h["loss"] for h in model.history]
    assert losses[-1] < losses[0]


def test_same_weights_for_any_partitions(spark):
    found = features(spark)
    fits = []
    for parts in (1, 7):
        table = found.table.repartition(parts, "doc")
        fits.append(g.fit(g.Features(table, found.terms, found.idf, found.settings), epochs=4))
    assert fits[0].coef == fits[1].coef and fits[0].intercept == fits[1].intercept and fits[0].history == fits[1].history


def test_early_stop_restores_the_best(spark):
    model = g.fit(features(spark), "weighted", epochs=40, patience=2, lr=0.5)
    f1 = [h["val_macro_f1"] for h in model.history]
    assert len(f1) < 41 and max(f1[-2:]) <= max(f1)
    best = f1.index(max(f1))
    assert len(f1) - 1 - best == 2
    again = g.fit(features(spark), "weighted", epochs=40, patience=50, lr=0.5)
    assert [h["val_macro_f1"] for h in again.history][: len(f1)] == f1


def test_goes_on_from_stored_steps(spark, tmp_path):
    found, folder = features(spark), f"file://{tmp_path}"
    whole = g.fit(found, epochs=5, patience=9)
    with pytest.raises(RuntimeError):
        real, calls = g.one_pass, []

        def fails(*args):
            calls.append(1)
            if len(calls) > 3:
                raise RuntimeError("lost driver")
            return real(*args)

        g.one_pass = fails
        try:
            g.fit(found, epochs=5, patience=9, state=folder)
        finally:
            g.one_pass = real
    resumed = g.fit(found, epochs=5, patience=9, state=folder)
    assert resumed.coef == whole.coef and resumed.history == whole.history


def test_model_round_trip(spark, tmp_path):
    model = g.fit(features(spark, clean=True), epochs=3)
    model.threshold = 0.35
    model.save(spark, f"file://{tmp_path}/model")
    again = g.LinearModel.load(spark, f"file://{tmp_path}/model")
    rows = frame(spark).withColumns({c: F.lit("mine") for c in ("words", "terms", "features", "model_input", "y_pred")})
    one, two = (m.transform(rows).orderBy("doc_id").collect() for m in (model, again))
    assert one == two and one[0].words == one[0].terms == one[0].features == "mine" and again.threshold == 0.35
    assert all(r.y_pred == int(r.prob >= 0.35) for r in one)


def test_bad_input(spark):
    with pytest.raises(ValueError, match="both labels"):
        g.fit(g.feature_table(frame(spark, [(1, "a word", 1, "train"), (2, "other word", 1, "train")])))
    with pytest.raises(ValueError, match="unknown loss"):
        g.fit(features(spark), "hinge")


def test_tuned_run(spark):
    df = frame(spark).drop("split")
    run = run_tuned(df, "doc_id", loss="focal", epochs=4)
    best = run.best.first()
    assert run.model.threshold == best["effective_threshold"]
    rows = run.predictions.collect()
    assert rows and all(r.y_pred == int(r.prob >= run.model.threshold) for r in rows)
    given = run_tuned(df, "doc_id", loss="focal", epochs=4, threshold=0.61)
    assert given.model.threshold == 0.61
    scored = run.model.transform(df).select("doc_id", "prob").collect()
    known = {r.doc_id: r.prob for r in scored}
    assert all(math.isclose(known[r.doc_id], r.prob, abs_tol=1e-12) for r in rows)


def folded(spark):
    data = [(i, text, y, i % 3) for i, (_, text, y, _) in enumerate(posts())]
    return spark.createDataFrame(data, "doc_id long, text string, label int, fold int")


@pytest.mark.parametrize("loss", g.LOSSES)
def test_folds_fitted_together_are_those_fitted_alone(spark, loss):
    df = folded(spark)
    found = g.fold_features(df)
    w = g.fit_folds(found, loss, epochs=4, lr=0.2)
    scored = {r["doc"]: r for r in g.out_of_fold(found, w).collect()}
    assert len(scored) == df.count()
    for f in range(3):
        part = df.withColumn("split", F.when(F.col("fold") == f, "test").otherwise("train"))
        alone = g.feature_table(part)
        model = g.fit(alone, loss, epochs=4, lr=0.2)
        at = {t: i for i, t in enumerate(found.terms)}
        assert {t for t, v in zip(found.terms, found.idf[f]) if v} == set(alone.terms)
        assert np.allclose([w[f][at[t]] for t in alone.terms], model.coef, atol=1e-9) and abs(w[f][-1] - model.intercept) < 1e-9
        for r in g.predictions(alone, model, "test").collect():
            assert scored[r["doc"]]["fold"] == f and abs(scored[r["doc"]]["prob"] - r["prob"]) < 1e-9


def test_folds_do_not_depend_on_partitions(spark):
    found = g.fold_features(folded(spark))
    other = g.FoldFeatures(found.table.repartition(5, "doc"), found.terms, found.idf)
    assert (g.fit_folds(found, epochs=3) == g.fit_folds(other, epochs=3)).all()
    with pytest.raises(ValueError, match="both labels"):
        g.fit_folds(g.fold_features(folded(spark).withColumn("label", F.lit(1))), epochs=1)


def test_pieces_of_a_pass_are_bounded(spark):
    """All rows in order, in pieces of bounded items; a longer row is a piece of its own; weights do not depend on them."""
    import pyarrow as pa

    sizes = [3, 0, 4, 25, 1, 9, 10, 0, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([[1] * n for n in sizes])], ["doc", "at"])
    found = list(g._pieces(iter([batch.slice(0, 4), batch.slice(4), batch.slice(9)]), 1, 10))
    assert [d for p in found for d in p.column(0).to_pylist()] == list(range(9))
    counts = [[len(x) for x in p.column(1).to_pylist()] for p in found]
    assert counts == [[3, 0, 4], [25], [1, 9], [10, 0, 0]]


def test_rows_of_long_arrays_are_stored_in_small_groups(spark, monkeypatch):
    """A reader unpacks up to 4 096 rows of a group at once, so a group holds few rows with many entries."""
    import pyarrow.parquet as pq

    from moderata.operators import model
    from moderata.sources import workspace

    monkeypatch.setattr(workspace, "ARRAY_BYTES", 1 << 16)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnpq"]
    rng = random.Random(3)
    data = [(i, " ".join(rng.choices(words, k=150)), i % 2) for i in range(1200)]
    rows = model._Rows(spark.createDataFrame(data, "doc_id long, text string, label int").repartition(2), "text", "label",
                       "doc_id", 1, 1, True, (), False)
    monkeypatch.setattr(rows, "dealt", rows.dealt.coalesce(1))
    stored, documents = rows.vectors(sorted({r["term"] for r in rows.term_counts(1, 1.0).collect()}))
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored.inputFiles()]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) == 1200 and max(sizes) <= 400
    assert documents.count() == len({t for r in stored.select("tf_vector").collect() for t in r["tf_vector"].indices})
