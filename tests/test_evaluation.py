"""Metrics and curves against hand-derived values and identities."""

import random

import pytest
from pyspark.sql import functions as F

from moderata.functions.ranges import range_bounds
from moderata.operators import curves, errors, metrics, profiling
from moderata.operators.feedback import severity_histogram


def from_counts(spark, tn, fp, fn, tp, model="m"):
    cells = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    df = spark.createDataFrame([c for c in cells if c[2]], "y_true int, y_pred int, n int")
    return df.select(F.lit(model).alias("model"), "y_true", "y_pred",
                     F.explode(F.sequence(F.lit(1), "n")).alias("i"))


@pytest.mark.parametrize("cells, accuracy, precision, recall", [
    ((1414, 485, 494, 1153), 0.7239142695995487, 0.703907203907204, 0.7000607164541591),
    ((2266, 899, 876, 1869), 0.6996615905245347, 0.6752167630057804, 0.6808743169398908),
    ((7, 0, 2, 6), 13 / 15, 1.0, 0.75),
    ((7, 0, 1, 7), 14 / 15, 1.0, 0.875),
])
def test_published_counts(spark, cells, accuracy, precision, recall):
    r = metrics.binary_metrics(from_counts(spark, *cells)).first()
    assert (r["accuracy"], r["precision"], r["recall"]) == (accuracy, precision, recall)
    assert r["specificity"] == cells[0] / (cells[0] + cells[1])


def test_report_of_published_counts(spark):
    rows = {r["class"]: r for r in metrics.classification_report(
        from_counts(spark, 2266, 899, 876, 1869)).collect()}
    assert rows["Hate"]["f1"] == pytest.approx(0.67803, abs=1e-5)
    assert rows["Non-Hate"]["precision"] == pytest.approx(0.72120, abs=1e-5)
    assert rows["macro avg"]["f1"] == pytest.approx(0.69830, abs=1e-5)
    assert rows["weighted avg"]["precision"] == pytest.approx(0.69984, abs=1e-5)
    assert rows["Non-Hate"]["support"] + rows["Hate"]["support"] == rows["accuracy"]["support"]


def test_nothing_predicted_gives_zero(spark):
    r = metrics.binary_metrics(from_counts(spark, 5, 0, 0, 0)).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def scored(spark, n, hot=0.0, seed=1, models=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for m in models:
        for i in range(n):
            y = int(rng.random() < 0.3)
            p = 0.25 if rng.random() < hot else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 3)
            rows.append((m, y, p))
    return rows, spark.createDataFrame(rows, "model string, y_true int, prob double")


def brute(rows, model):
    """Curves by sorting everything in one place."""
    data = sorted(((p, y) for m, y, p in rows if m == model), reverse=True)
    pos = sum(y for _, y in data)
    neg = len(data) - pos
    points, tp, fp = [], 0, 0
    for i, (p, y) in enumerate(data):
        tp, fp = tp + y, fp + 1 - y
        if i + 1 == len(data) or data[i + 1][0] != p:
            points.append((p, fp / neg, tp / pos, tp / (tp + fp)))
    return points


@pytest.mark.parametrize("parts", [1, 4, 32])
@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_curves_do_not_depend_on_ranges(spark, parts, hot):
    rows, df = scored(spark, 400, hot)
    for m in ("a", "b"):
        want = brute(rows, m)
        roc = curves.roc_curve(df, parts=parts).filter(F.col("model") == m).collect()
        got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in roc), reverse=True)
        assert got[0] == (float("inf"), 0.0, 0.0)
        assert got[1:] == [w[:3] for w in want]
        pr = curves.pr_curve(df, parts=parts).filter(F.col("model") == m).collect()
        got = sorted(((r["threshold"], r["precision"], r["recall"]) for r in pr if r["threshold"] is not None),
                     reverse=True)
        assert got == [(w[0], w[3], w[2]) for w in want]
        area, x0, y0 = 0.0, 0.0, 0.0
        for _, x, y, _ in want:
            area, x0, y0 = area + (x - x0) * (y + y0) / 2, x, y
        a = {r["model"]: r for r in curves.areas(df, parts=parts).collect()}[m]
        assert a["roc_auc"] == pytest.approx(area, abs=1e-12)
        area, r0, p0 = 0.0, 0.0, 1.0
        for _, _, rec, prec in want:
            area, r0, p0 = area + (rec - r0) * (prec + p0) / 2, rec, prec
        assert a["pr_auc"] == pytest.approx(area, abs=1e-12)


def test_auc_identities(spark):
    _, df = scored(spark, 300)
    up = curves.roc_auc(df).collect()
    down = {r["model"]: r["roc_auc"] for r in curves.roc_auc(
        df.withColumn("prob", 1 - F.col("prob"))).collect()}
    for r in up:
        assert 0 <= r["roc_auc"] <= 1
        assert r["roc_auc"] + down[r["model"]] == pytest.approx(1)
    perfect = df.withColumn("prob", F.col("y_true") * 0.5 + 0.25)
    assert {r["roc_auc"] for r in curves.roc_auc(perfect).collect()} == {1.0}
    single = df.filter("y_true = 1")
    assert all(r["roc_auc"] is None for r in curves.roc_auc(single).collect())


def test_sweep_equals_one_scan_per_threshold(spark):
    rows, df = scored(spark, 300, 0.2)
    sweep = {(r["model"], r["threshold"]): r for r in metrics.threshold_sweep(df).collect()}
    assert len(sweep) == 22
    for (m, t), r in sweep.items():
        one = metrics.binary_metrics(metrics.at_threshold(df.filter(F.col("model") == m), t)).first()
        assert (r["hate_f1"], r["macro_f1"]) == (one["f1"], one["macro_f1"])
    best = {r["model"]: r for r in metrics.best_threshold(metrics.threshold_sweep(df)).collect()}
    for m in ("a", "b"):
        top = max(r["hate_f1"] for (k, _), r in sweep.items() if k == m)
        assert best[m]["best_threshold"] == min(
            t for (k, t), r in sweep.items() if k == m and r["hate_f1"] == top)
    none = metrics.best_threshold(metrics.threshold_sweep(df.withColumn("y_true", F.lit(0)))).first()
    assert none["best_threshold"] == 0.5
    fixed = metrics.best_threshold(metrics.threshold_sweep(df), threshold=0.45).first()
    assert fixed["effective_threshold"] == 0.45


def test_slices_below_ten_rows_are_left_out(spark):
    df = from_counts(spark, 20, 3, 2, 9).withColumn("s", F.when(F.col("i") > 17, "few").otherwise("many"))
    got = {r["slice"]: r["n"] for r in metrics.slice_metrics(df, "s").collect()}
    assert got == {"many": 31, "all": 34}


def test_compare_first_wins_ties(spark):
    both = from_counts(spark, 5, 5, 5, 5, "b").unionByName(from_counts(spark, 5, 5, 5, 5, "a"))
    out = metrics.compare_models(metrics.binary_metrics(both, ["model"])).collect()
    assert {r["best_model"] for r in out} == {"a"} and len(out) == 8
    d = metrics.model_delta(metrics.binary_metrics(both, ["model"]), "a", "b").collect()
    assert {r["winner"] for r in d} == {"tie"} and {r["change"] for r in d} == {0.0}


def test_top_errors_limit_only_with_scores(spark):
    rows = [(i, "t", 0, 1, 0.5 + (i % 40) / 100) for i in range(80)] + [(99, "ok", 1, 1, 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, text_raw string, y_true int, y_pred int, prob double")
    top = errors.top_errors(df, 50).collect()
    assert len(top) == 50 and top[0]["doc_id"] == 39 and top[0]["prob_hate"] == 0.89
    assert errors.top_errors(df, 50, prob=None).count() == 80
    assert tuple(errors.error_counts(df).first()) == (80, 0, 80)


def test_losses(spark):
    import math

    df = spark.createDataFrame([("m", 1, 0.8), ("m", 0, 0.4), ("m", 0, 0.1)],
                               "model string, y_true int, prob double")
    r = metrics.loss_report(df).first()
    focal = (0.75 * 0.2**2 * -math.log(0.8) + 0.25 * 0.4**2 * -math.log(0.6)
             + 0.25 * 0.1**2 * -math.log(0.9)) / 3
    w0, w1 = 2 / 3, 4 / 3
    ce = (w1 * -math.log(0.8) + w0 * (-math.log(0.6) - math.log(0.9))) / (w1 + 2 * w0)
    assert r["focal_loss"] == pytest.approx(focal) and r["weighted_ce"] == pytest.approx(ce)
    even = metrics.loss_report(df, weights={0: 1.0, 1: 1.0}).first()
    assert even["weighted_ce"] == pytest.approx(-(math.log(0.8) + math.log(0.6) + math.log(0.9)) / 3)


def test_severity_100_bucket(spark):
    fb = spark.createDataFrame([(100.0, "HATE", "NON-HATE"), (9.0, "HATE", "NON-HATE"),
                                (50.0, "HATE", "HATE")],
                               "severity double, prediction string, user_label string")
    got = {r["bucket"]: (r["bucket_lo"], r["corrections"]) for r in severity_histogram(fb).collect()}
    assert got == {"100-109": (100, 1), "0-9": (0, 1)}


def test_profile_and_imbalance(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (0, "b")], "label int, text string")
    got = {r["column_name"]: (r["column_type"], r["n_missing"], r["n_rows"]) for r in profiling.profile(df).collect()}
    assert got == {"label": ("int", 0, 3), "text": ("string", 1, 3)}
    assert profiling.imbalance(df).first()["imbalance_ratio"] == 2.0


def test_ranges_of_one_hot_value(spark):
    df = spark.createDataFrame([(0.5,)] * 1000 + [(0.1,), (0.9,)], "p double")
    assert range_bounds(df, "p", 16) in ([0.5], [0.1, 0.5], [0.1, 0.5, 0.9], [0.5, 0.9])


def test_slice_of_rows_without_a_value(spark):
    """Null is a slice of its own, apart from the texts null and all."""
    rows = [("m", y, p, s) for s in (None, "null", "all") for y, p in [(0, 0), (1, 1), (1, 0)] * 4]
    df = spark.createDataFrame(rows, "model string, y_true int, y_pred int, part string")
    got = sorted((str(r["slice"]), r["n"]) for r in metrics.slice_metrics(df, "part").collect())
    assert got == [("None", 12), ("all", 12), ("all", 36), ("null", 12)]
