"""Whole jobs of a moderation service: batch scoring, scoring with context, retraining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import metrics
from ..operators.context import with_context
from ..operators.merge import apply_corrections, latest_corrections
from ..operators.model import BaselineModel, batch_summary, present, score_with, train_baseline
from ..sources.tables import explode_lines, write_table
from ..sources.workspace import materialize


def score_lines(df: DataFrame, make_predict_fn: Callable, col: str = "text") -> DataFrame:
    """Every non-blank line of ``col`` as a post of its own, cleaned, scored and presented."""
    lines = explode_lines(df, col).withColumn("cleaned", clean_text(F.col("line")))
    return present(score_with(lines, make_predict_fn, "cleaned"), "line")


def batch_job(df: DataFrame, make_predict_fn: Callable, path: str, col: str = "text") -> DataFrame:
    """Score the lines of a table, store them as CSV in ``path``, and return their summary.

    The stored rows are read back for the summary, so the scorer runs once.
    """
    scored = score_lines(df, make_predict_fn, col)
    write_table(scored, path, "csv")
    back = df.sparkSession.read.schema(scored.schema).option("header", True).option("multiLine", True).option(
        "escape", '"').csv(path)
    return batch_summary(back)


def score_in_context(df: DataFrame, make_predict_fn: Callable, by: str, order: str, n: int = 2, **kw) -> DataFrame:
    """Score each message together with the ``n`` before it in its conversation."""
    return present(score_with(with_context(df, by, order, n=n, **kw), make_predict_fn, "context_text"))


def retrain_from_corrections(
    train: DataFrame, feedback: DataFrame, test: DataFrame, old: BaselineModel, **fit,
) -> tuple[BaselineModel, DataFrame]:
    """(new model, metrics of the old and the new on ``test``): moderators' corrections become labels.

    ``train`` and ``test`` have text and label, ``test`` a ``doc_id`` as well.
    """
    fixes = materialize(latest_corrections(feedback), "corrections")
    corrected = apply_corrections(train, fixes).withColumn("doc_id", F.monotonically_increasing_id())
    corrected = materialize(corrected, "corrected")
    new = train_baseline(corrected.select("doc_id", "text", "label"), clean=True, **fit)
    scored = None
    for name, model in (("old", old), ("new", new)):
        rows = model.transform(test).select(
            F.lit(name).alias("model"), F.col("label").alias("y_true"), (F.col("prob") >= 0.5).cast("int").alias("y_pred"))
        scored = rows if scored is None else scored.unionByName(rows)
    return new, metrics.binary_metrics(scored, ["model"])
