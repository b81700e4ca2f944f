"""Error mining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import errors_of


def error_rows(pred: DataFrame, prob: str | None = "prob", text: str = "text_raw",
               by: Sequence[str] = ()) -> DataFrame:
    """Misclassified rows with their FP/FN tag."""
    p = F.round(prob, 4) if prob else F.lit(None).cast("double")
    return errors_of(pred, "y_pred", "y_true").select(
        *by, "doc_id", F.col(text).alias("text"), F.col("y_true").alias("true_label"),
        F.col("y_pred").alias("pred_label"),
        F.when(F.col("y_pred") == 1, "FP").otherwise("FN").alias("error_type"),
        p.alias("prob_hate"))


def top_errors(
    pred: DataFrame, n: int = 50, prob: str | None = "prob", text: str = "text_raw",
    by: Sequence[str] = (),
) -> DataFrame:
    """The n most confident errors, of each ``by`` if given; all errors, unordered, without a score.

    Each task keeps its own first n of a group before rows are shuffled.
    """
    rows = error_rows(pred, prob, text, by)
    if prob is None:
        return rows
    order = (F.abs(F.col("prob_hate") - 0.5).desc(), F.col("doc_id"))
    if not by:
        return rows.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def error_counts(pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """False positives, false negatives and their sum in one pass."""
    wrong = ~F.col("y_pred").eqNullSafe(F.col("y_true"))

    def n(cond):
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    return pred.groupBy(*by).agg(
        n(wrong & (F.col("y_pred") == 1)).alias("fp"),
        n(wrong & ~(F.coalesce(F.col("y_pred"), F.lit(0)) == 1)).alias("fn"),
        n(wrong).alias("errors"))
