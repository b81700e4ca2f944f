"""Dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, cols: Sequence[str] = ("label",)) -> DataFrame:
    """Rows and percentage of all rows per value of ``cols``."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    # Few rows: one per distinct combination of class and slice.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    """Majority and minority class size and their ratio."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max("n").alias("majority"), F.min("n").alias("minority"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows and missing values, from one aggregate."""
    aggs = [F.sum(F.col(c).isNull().cast("bigint")).alias(f"c{i}")
            for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("column_type"),
                 F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n_missing"))
        for i, (name, kind) in enumerate(df.dtypes)])
    return one.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.inline(rows))


def length_stats(df: DataFrame, by: str = "label", text: str = "text") -> DataFrame:
    """Length statistics per class. The exact median keeps one counter per
    distinct length, not one value per row."""
    n = F.length(text)
    return df.groupBy(by).agg(
        F.min(n).alias("min_len"), F.avg(n).alias("mean_len"),
        F.percentile(n, 0.5).alias("median_len"), F.max(n).alias("max_len"),
        F.stddev(n).alias("std_len"))


def top_words(df: DataFrame, tokens: str = "tokens", by: str = "label", k: int = 20) -> DataFrame:
    """The k most frequent words of each class; ties by word."""
    counts = (
        df.select(by, F.explode(tokens).alias("term"))
        .groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))
    )
    # Ranked per class; each task first cuts its own rows to k per class.
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)
