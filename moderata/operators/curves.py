"""ROC and precision-recall curves from distributed cumulative counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_bounds, with_range


def cumsum_by(
    df: DataFrame, order: str, values: Sequence[str], by: Sequence[str], bounds: list[float],
    descending: bool = True,
) -> DataFrame:
    """Add ``cum_<value>``: running sums along ``order`` within ``by``, and ``all_<value>``: whole sums.

    The order column is cut into ranges at ``bounds``. Running sums inside a
    range are window sums of one (by, range) partition; sums of earlier ranges
    come from a table of one row per range. So no task sees a whole group,
    and the join and the window share one shuffle.
    """
    ranged = with_range(df, order, bounds, "rng")
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    before = Window.partitionBy(*by).orderBy(direction("rng")).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "rng").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
        .select(*by, "rng", *[
            F.coalesce(F.sum(f"t_{v}").over(before), F.lit(0)).alias(f"o_{v}") for v in values],
            *[F.sum(f"t_{v}").over(Window.partitionBy(*by)).alias(f"all_{v}") for v in values])
    )
    inside = Window.partitionBy(*by, "rng").orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(offsets, [*by, "rng"])
        .withColumns({f"cum_{v}": F.sum(v).over(inside) + F.col(f"o_{v}") for v in values})
        .drop("rng", *[f"o_{v}" for v in values])
    )


def _cumulative(pred: DataFrame, by: Sequence[str], prob: str, y_true: str,
                parts: int | None) -> DataFrame:
    """One row per distinct score: its positives and negatives, and running counts."""
    rows = pred.filter(F.col(prob).isNotNull() & F.col(y_true).isNotNull())
    # Cut points by row count: a range holds at most its share of rows, hence
    # of distinct scores; only the score column is read for them.
    bounds = range_bounds(rows, prob, parts)
    scores = rows.groupBy(*by, F.col(prob).alias("score")).agg(
        F.sum((F.col(y_true) == 1).cast("bigint")).alias("p"),
        F.sum((F.col(y_true) == 0).cast("bigint")).alias("n"))
    return cumsum_by(scores, "score", ["p", "n"], by, bounds)


def _groups(pred: DataFrame, by: Sequence[str], prob: str, y_true: str) -> DataFrame:
    return pred.filter(F.col(prob).isNotNull() & F.col(y_true).isNotNull()).select(*by).distinct()


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def roc_curve(
    pred: DataFrame, by: Sequence[str] = ("model",), prob: str = "prob",
    y_true: str = "y_true", parts: int | None = None,
) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, with the start point (inf, 0, 0)."""
    by = list(by)
    groups = _groups(pred, by, prob, y_true)
    points = (
        _cumulative(pred, by, prob, y_true, parts)
        .select(*by, F.col("score").alias("threshold"),
                _share(F.col("cum_n"), F.col("all_n")).alias("fpr"),
                _share(F.col("cum_p"), F.col("all_p")).alias("tpr"))
    )
    start = groups.select(*by, F.lit(float("inf")).alias("threshold"),
                          F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_curve(
    pred: DataFrame, by: Sequence[str] = ("model",), prob: str = "prob",
    y_true: str = "y_true", parts: int | None = None,
) -> DataFrame:
    """(threshold, precision, recall) per distinct score, with the end point (R=0, P=1).

    Recall is 1 throughout when there are no positives.
    """
    by = list(by)
    groups = _groups(pred, by, prob, y_true)
    points = (
        _cumulative(pred, by, prob, y_true, parts)
        .select(*by, F.col("score").alias("threshold"),
                _share(F.col("cum_p"), F.col("cum_p") + F.col("cum_n")).alias("precision"),
                F.coalesce(_share(F.col("cum_p"), F.col("all_p")), F.lit(1.0)).alias("recall"))
    )
    end = groups.select(*by, F.lit(None).cast("double").alias("threshold"),
                        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def areas(
    pred: DataFrame, by: Sequence[str] = ("model",), prob: str = "prob",
    y_true: str = "y_true", parts: int | None = None,
) -> DataFrame:
    """ROC-AUC and trapezoid PR-AUC, both from the same cumulative counts.

    The point before a score follows from its running counts, so no row looks
    at its neighbour. ROC-AUC is null when only one class occurs.
    """
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    tp, fp = F.col("cum_p").cast("double"), F.col("cum_n").cast("double")
    precision = tp / (tp + fp)
    previous = F.coalesce(F.try_divide(tp - p, tp + fp - p - n), F.lit(1.0))
    roc = F.sum(n * (tp - p / 2))
    pr = F.sum(p * (precision + previous) / 2)
    return _cumulative(pred, list(by), prob, y_true, parts).groupBy(*by).agg(
        F.try_divide(roc, F.sum(p) * F.sum(n)).alias("roc_auc"),
        F.try_divide(pr, F.sum(p)).alias("pr_auc"),
    )


def roc_auc(pred: DataFrame, by: Sequence[str] = ("model",), **kw) -> DataFrame:
    return areas(pred, by, **kw).select(*by, "roc_auc")


def pr_auc(pred: DataFrame, by: Sequence[str] = ("model",), **kw) -> DataFrame:
    return areas(pred, by, **kw).select(*by, "pr_auc")
