"""From a raw labelled table to a fitted, evaluated baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.columns import fresh
from ..functions.labels import binarize, binarize_int
from ..functions.text import is_code_mixed, text_key
from ..operators import curves, errors, gradient, metrics
from ..operators.dedup import dedup_clean
from ..operators.filters import drop_blank, drop_missing
from ..operators.model import BaselineModel, cross_validate, train_baseline
from ..operators.split import group_split, nested_split, stratified_split
from ..sources.reports import write_json_report
from ..sources.roles import infer_roles, standardize
from ..sources.tables import write_table
from ..sources.workspace import materialize


def load_training(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, text_raw, label, text, is_hinglish): found columns, no missing
    or empty text, one row per cleaned text, code-mix tag from the raw text."""
    text, label = infer_roles(df)
    named = drop_missing(df.select(row_id, text, label), [text, label]).select(
        row_id, F.col(text).alias("text_raw"), F.col(label).alias("label"))
    unique = dedup_clean(named, row_id)
    return unique.withColumns({
        "label": binarize_int(F.col("label")), "is_hinglish": is_code_mixed(F.col("text_raw"))})


@dataclass
class BaselineRun:
    model: BaselineModel
    predictions: DataFrame
    metrics: DataFrame
    areas: DataFrame
    slices: DataFrame
    errors: DataFrame
    cv: DataFrame | None
    report: DataFrame
    sweep: DataFrame
    best: DataFrame
    roc: DataFrame
    pr: DataFrame
    error_totals: DataFrame

    def save(self, path: str) -> None:
        """Every report as JSON lines and every curve as Parquet under ``path``."""
        reports = {"metrics": self.metrics, "areas": self.areas, "slices": self.slices, "report": self.report,
                   "sweep": metrics.sweep_report(self.sweep), "best": self.best, "error_totals": self.error_totals}
        for name, df in reports.items() if self.cv is None else {**reports, "cv": self.cv}.items():
            write_json_report(df, f"{path}/{name}")
        for name, df in (("roc", self.roc), ("pr", self.pr), ("errors", self.errors), ("predictions", self.predictions)):
            write_table(df, f"{path}/{name}")


def run_baseline(
    df: DataFrame, row_id: str = "row_id", test_frac: float = 0.15, folds: int = 5, seed=42,
    threshold: float = 0.5, **fit,
) -> BaselineRun:
    """Hold-out split, cross-validation, final fit, and the hold-out's reports."""
    data = materialize(load_training(df, row_id), "training")
    split = stratified_split(data, "label", test_frac, seed, row_id)
    train, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    name = F.lit("baseline_word+char" if fit.get("char") else "baseline_word")
    cv = None
    if folds > 1:
        folded = cross_validate(train, folds, seed, doc=row_id, text="text_raw", clean=True, **fit)
        cv = metrics.cv_summary(folded.withColumn("model", name))
    model = train_baseline(train, doc=row_id, text="text_raw", clean=True, **fit)
    scored = model.transform(test, "text_raw").select(
        F.col(row_id).alias("doc_id"), "text_raw", "is_hinglish", name.alias("model"),
        F.col("label").alias("y_true"), "prob",
        scores.decide(F.col("prob"), threshold).alias("y_pred"))
    pred = materialize(scored, "predictions")
    sweep = metrics.threshold_sweep(pred)
    return BaselineRun(
        model, pred, metrics.binary_metrics(pred, ["model"]), curves.areas(pred),
        metrics.slice_metrics(pred, "is_hinglish"), errors.top_errors(pred), cv,
        metrics.classification_report(pred, ["model"]), sweep, metrics.best_threshold(sweep),
        curves.roc_curve(pred), curves.pr_curve(pred), errors.error_counts(pred, ("model",)))


@dataclass
class TunedRun:
    model: gradient.LinearModel
    sweep: DataFrame
    best: DataFrame
    predictions: DataFrame
    metrics: DataFrame


def run_tuned(
    df: DataFrame, row_id: str = "row_id", text: str = "text", label: str = "label", test_frac: float = 0.15,
    val_frac: float = 0.1, seed=42, threshold: float | None = None, name: str | None = None, features: dict | None = None, **fit,
) -> TunedRun:
    """Train with early stopping, tune the threshold, then score the test rows with it.

    Three parts of one split: train rows give terms, weights and gradients;
    validation rows stop the training and give the threshold of the highest
    hate-F1; test rows are read once, at the end. All are vectorised in one
    pass. A given ``threshold`` is used in place of the tuned one. The model
    keeps the threshold.
    """
    split = nested_split(df, label, test_frac, val_frac, seed, row_id)
    found = gradient.feature_table(split, text, label, row_id, **(features or {}))
    model = gradient.fit(found, **fit)
    tag = F.lit(name or f"linear_{fit.get('loss', 'focal')}")
    sweep = metrics.threshold_sweep(gradient.predictions(found, model, "val").withColumn("model", tag))
    best = metrics.best_threshold(sweep, threshold=threshold)
    row = best.first()  # one row a model
    model.threshold = threshold if threshold is not None else 0.5 if row is None else row["effective_threshold"]
    test = gradient.predictions(found, model, "test").select(
        F.col("doc").alias(row_id), tag.alias("model"), "y_true", "prob", scores.decide(F.col("prob"), model.threshold).alias("y_pred"))
    return TunedRun(model, sweep, best, test, metrics.binary_metrics(test, ["model"]))


def load_and_split(
    df: DataFrame, text_col: str, label_col: str, positives, frac: float = 0.2, seed=42,
    key: str | None = None,
) -> DataFrame:
    """Standard columns, no blank text, 0/1 labels, and a split column.

    Copies of a text stay on one side, whatever their case and spacing. With
    ``key``, a column of unique values, rows are dealt out one by one.
    """
    std = drop_blank(standardize(df, text_col, label_col), "text")
    labelled = std.withColumn("label", binarize(F.col("label"), positives)).na.drop(
        subset=["label"])
    if key is not None:
        return stratified_split(labelled, "label", frac, seed, key)
    (same,) = fresh(labelled, "text_key")
    keyed = labelled.withColumn(same, F.sha2(text_key(F.col("text")), 256))
    return group_split(keyed, "label", frac, seed, same).drop(same)
