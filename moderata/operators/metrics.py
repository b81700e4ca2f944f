"""Classification metrics: conditional counts in one pass, ratios afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SWEEP_THRESHOLDS
from ..functions.scores import decide
from .curves import areas

COUNTS = ("tn", "fp", "fn", "tp")
COMPARED = ("accuracy", "precision", "recall", "f1")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _hits(y_true: Column, y_pred: Column) -> list[Column]:
    def n(t, p):
        return F.coalesce(F.sum(((y_true == t) & (y_pred == p)).cast("bigint")), F.lit(0))

    return [n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp")]


def confusion(
    pred: DataFrame, group: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred",
    percent: bool = False,
) -> DataFrame:
    """tn, fp, fn, tp per group, on request with each one's share in percent."""
    out = pred.groupBy(*group).agg(*_hits(F.col(y_true), F.col(y_pred)))
    if percent:
        total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
        out = out.withColumns({f"{c}_pct": ratio(F.col(c) * 100, total) for c in COUNTS})
    return out


def rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, F1 and error rates to confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    hate_f1 = ratio(2 * tp, 2 * tp + fp + fn)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "f1": hate_f1,
        "macro_f1": (hate_f1 + ratio(2 * tn, 2 * tn + fp + fn)) / 2,
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
    })


def binary_metrics(
    pred: DataFrame, group: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    return rates(confusion(pred, group, y_true, y_pred))


def classification_report(
    pred: DataFrame, group: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred",
    names: Sequence[str] = ("Non-Hate", "Hate"),
) -> DataFrame:
    """Long rows (class, precision, recall, f1, support): both classes,
    accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n0, n1 = tn + fp, fn + tp
    per = {  # class -> precision, recall, f1
        0: (ratio(tn, tn + fn), ratio(tn, n0), ratio(2 * tn, 2 * tn + fp + fn)),
        1: (ratio(tp, tp + fp), ratio(tp, n1), ratio(2 * tp, 2 * tp + fp + fn)),
    }
    acc = ratio(tp + tn, n0 + n1)

    def row(name, values, support):
        p, r, f1 = values
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f1.alias("f1"), support.alias("support"))

    rows = F.array(
        row(names[0], per[0], n0),
        row(names[1], per[1], n1),
        row("accuracy", (acc, acc, acc), n0 + n1),
        row("macro avg", [(a + b) / 2 for a, b in zip(per[0], per[1])], n0 + n1),
        row("weighted avg",
            [ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(per[0], per[1])], n0 + n1),
    )
    return confusion(pred, group, y_true, y_pred).select(*group, F.inline(rows))


def threshold_sweep(
    pred: DataFrame, by: Sequence[str] = ("model",),
    thresholds: Sequence[float] = SWEEP_THRESHOLDS, prob: str = "prob", y_true: str = "y_true",
) -> DataFrame:
    """hate-F1 and macro-F1 at every threshold from one pass over the rows.

    Each row falls into one of len(thresholds)+1 bins; everything after the
    grouping works on a dozen rows per model.
    """
    ts = sorted(thresholds)
    passed = sum((F.col(prob) >= t).cast("int") for t in ts)
    bins = (
        pred.filter(F.col(prob).isNotNull())
        .groupBy(*by, passed.alias("bin"))
        .agg(F.sum((F.col(y_true) == 1).cast("bigint")).alias("p"),
             F.sum((F.col(y_true) == 0).cast("bigint")).alias("n"))
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold"))
                      for i, t in enumerate(ts)])
    above = F.col("bin") >= F.col("i")

    def total(c, cond):
        return F.sum(F.when(cond, F.col(c)).otherwise(0))

    counts = (
        bins.select(*by, "bin", "p", "n", F.inline(steps))
        .groupBy(*by, "threshold")
        .agg(total("n", ~above).alias("tn"), total("n", above).alias("fp"),
             total("p", ~above).alias("fn"), total("p", above).alias("tp"))
    )
    return rates(counts).select(
        *by, "threshold", F.col("f1").alias("hate_f1"), "macro_f1")


def sweep_report(sweep: DataFrame) -> DataFrame:
    """The sweep as it is shown: two-digit thresholds, four-digit scores."""
    return sweep.withColumns({
        "threshold": F.round("threshold", 2), "hate_f1": F.round("hate_f1", 4),
        "macro_f1": F.round("macro_f1", 4)})


def best_threshold(
    sweep: DataFrame, by: Sequence[str] = ("model",), default: float = 0.5,
    threshold: float | None = None,
) -> DataFrame:
    """Lowest threshold of the highest hate-F1; ``default`` if all are 0.

    ``effective_threshold`` is the given one, or the tuned one when none is given.
    """
    best = F.max_by("threshold", F.struct("hate_f1", (-F.col("threshold")).alias("t")))
    out = sweep.groupBy(*by).agg(
        F.when(F.max("hate_f1") > 0, best).otherwise(F.lit(default)).alias("best_threshold"),
        F.max("hate_f1").alias("best_hate_f1"),
    )
    given = F.col("best_threshold") if threshold is None else F.lit(float(threshold))
    return out.withColumn("effective_threshold", given)


def slice_metrics(
    pred: DataFrame, slice_col: str, by: Sequence[str] = ("model",), min_n: int = 10,
    y_true: str = "y_true", y_pred: str = "y_pred",
) -> DataFrame:
    """Metrics per slice and for all rows; slices below ``min_n`` rows are left out.

    The slice of rows without a value has a null name, so no value can be mistaken for it.

    Confusion counts add up, so the total comes from the slice rows and the
    table is read and shuffled once.
    """
    fine = confusion(pred, [*by, slice_col], y_true, y_pred)
    named = fine.select(*by, F.col(slice_col).cast("string").alias("slice"), *COUNTS)
    total = named.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    # The total is known by a flag, as a slice may be called "all" as well.
    both = named.withColumn("whole", F.lit(False)).unionByName(
        total.withColumns({"slice": F.lit("all"), "whole": F.lit(True)})).withColumn("n", n)
    return rates(both.filter(F.col("whole") | (F.col("n") >= min_n)).drop("whole"))


def metric_rows(metrics: DataFrame, model: str = "model",
                names: Sequence[str] = COMPARED) -> DataFrame:
    """Wide metrics to (model, metric, value) rows."""
    return metrics.unpivot([model], list(names), "metric", "value")


def compare_models(
    metrics: DataFrame, model: str = "model", names: Sequence[str] = COMPARED
) -> DataFrame:
    """Metric x model values (as a map) and the best model of each metric.

    Metrics some model lacks are left out; ties go to the first model name.
    """
    long = metric_rows(metrics, model, names)
    first = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col(model))
    every = Window.partitionBy("metric")
    return (
        long.withColumns({
            "missing": F.sum(F.col("value").isNull().cast("int")).over(every),
            "best_model": F.first(model).over(first),
            "best_value": F.max("value").over(every),
        })
        .filter("missing = 0")
        .select(model, "metric", "value", "best_model", "best_value")
    )


def comparison_matrix(metrics: DataFrame, model: str = "model",
                      names: Sequence[str] = COMPARED) -> DataFrame:
    """One row per metric, one column per model."""
    return metric_rows(metrics, model, names).groupBy("metric").pivot(model).agg(F.first("value"))


def model_delta(metrics: DataFrame, a: str, b: str, model: str = "model",
                names: Sequence[str] = COMPARED) -> DataFrame:
    """Change of each metric from model a to model b, and which has the better F1."""
    long = metric_rows(metrics, model, names).filter(F.col(model).isin(a, b))

    def of(name):
        return F.max(F.when(F.col(model) == name, F.col("value")))

    both = long.groupBy("metric").agg(of(a).alias("value_a"), of(b).alias("value_b"))
    f1 = F.max(F.when(F.col("metric") == "f1", F.col("value_b") - F.col("value_a"))).over(
        Window.partitionBy())  # one row per metric name: a handful
    return both.withColumns({
        "change": F.col("value_b") - F.col("value_a"),
        "change_pct": F.try_divide((F.col("value_b") - F.col("value_a")) * 100, F.col("value_a")),
        "winner": F.when(f1 > 0, b).when(f1 < 0, a).otherwise("tie"),
    })


def add_up(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion counts of coarser groups."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def fold_scores(counts: DataFrame, by: Sequence[str], fold: str) -> DataFrame:
    return rates(counts).select(*by, fold, "macro_f1", F.col("f1").alias("hate_f1"))


def summarize_folds(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.groupBy(*by).agg(
        F.avg("macro_f1").alias("cv_macro_f1_mean"),
        F.stddev_pop("macro_f1").alias("cv_macro_f1_std"),
        F.avg("hate_f1").alias("cv_hate_f1_mean"),
        F.stddev_pop("hate_f1").alias("cv_hate_f1_std"),
    )


def cv_metrics(pred: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    return fold_scores(confusion(pred, [*by, fold]), by, fold)


def cv_summary(pred: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    return summarize_folds(cv_metrics(pred, by, fold), by)


def ablation_table(
    pred: DataFrame, slice_col: str = "is_slice", fold: str = "fold", min_n: int = 10
) -> DataFrame:
    """One row per model: CV scores, test scores, areas, and the slice's scores.

    Test, fold and slice scores all add up from one grouping of the rows.
    """
    fine = confusion(pred, ["model", fold, slice_col])
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    test = rates(add_up(fine, ["model"])).select(
        "model", F.col("macro_f1").alias("test_macro_f1"), F.col("f1").alias("test_hate_f1"),
        F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"))
    cv = summarize_folds(fold_scores(add_up(fine, ["model", fold]), ["model"], fold), ["model"])
    part = rates(add_up(fine.filter(F.col(slice_col)), ["model"]).filter(total >= min_n)).select(
        "model", F.col("macro_f1").alias("slice_macro_f1"), F.col("f1").alias("slice_hate_f1"))
    return (
        test.join(cv, "model", "left").join(areas(pred), "model", "left")
        .join(part, "model", "left")
    )


def loss_report(
    pred: DataFrame, by: Sequence[str] = ("model",), gamma: float = 2.0, alpha: float = 0.25,
    weights: dict[int, float] | None = None, prob: str = "prob", y_true: str = "y_true",
) -> DataFrame:
    """Mean focal loss and class-weighted mean cross-entropy.

    Label 1 carries focal weight ``1 - alpha``. Without ``weights`` the class
    weights are the inverse class counts rescaled to sum to the class count,
    taken per group. Probabilities of the truth are floored at 1e-12.
    """
    pt = F.greatest(F.when(F.col(y_true) == 1, F.col(prob)).otherwise(1 - F.col(prob)),
                    F.lit(1e-12))
    ce = -F.log(pt)
    at = F.when(F.col(y_true) == 1, 1 - alpha).otherwise(alpha)
    pos = F.col(y_true) == 1
    sums = pred.groupBy(*by).agg(
        F.avg(at * F.pow(1 - pt, F.lit(gamma)) * ce).alias("focal_loss"),
        F.sum(F.when(pos, ce).otherwise(0.0)).alias("ce1"),
        F.sum(F.when(~pos, ce).otherwise(0.0)).alias("ce0"),
        F.sum(pos.cast("bigint")).alias("n1"),
        F.sum((~pos).cast("bigint")).alias("n0"),
    )
    if weights:
        w0, w1 = F.lit(float(weights[0])), F.lit(float(weights[1]))
    else:
        inv0, inv1 = ratio(F.lit(1), F.col("n0")), ratio(F.lit(1), F.col("n1"))
        w0, w1 = inv0 / (inv0 + inv1) * 2, inv1 / (inv0 + inv1) * 2
    weighted = (w0 * F.col("ce0") + w1 * F.col("ce1")) / (
        w0 * F.col("n0") + w1 * F.col("n1"))
    return sums.select(*by, "focal_loss", weighted.alias("weighted_ce"))


def at_threshold(pred: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """Add ``y_pred`` for a fixed threshold."""
    return pred.withColumn("y_pred", decide(F.col(prob), threshold))
