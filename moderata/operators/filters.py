"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normalize_code
from ..functions.text import is_blank


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop null, empty and whitespace-only text."""
    return df.filter(~is_blank(F.col(col)))


def blank_report(df: DataFrame, col: str) -> DataFrame:
    """Rows before, removed by :func:`drop_blank`, and left, in one pass."""
    removed = F.coalesce(F.sum(is_blank(F.col(col)).cast("bigint")), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        removed.alias("removed"),
        (F.count(F.lit(1)) - removed).alias("rows_out"),
    )


def drop_empty_clean(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop rows whose cleaned text is empty."""
    return df.filter(F.col(col) != "")


def keep_labels(df: DataFrame, col: str, codes: Sequence[str]) -> DataFrame:
    return df.filter(normalize_code(F.col(col)).isin(list(codes)))


def errors_of(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """Rows whose prediction differs from the truth; null counts as a value."""
    return df.filter(~F.col(pred).eqNullSafe(F.col(truth)))
