"""Splitting an ordered column into ranges of similar size.

Used wherever an order-dependent operator would otherwise put one key's rows,
or a whole table, into a single task.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fresh


def default_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, order: str, parts: int | None = None) -> list[float]:
    """At most ``parts - 1`` ascending cut points of ``order``.

    One distributed sketch over one column; only the cut points reach the
    driver. They become literals of the plan, so every branch of it, and every
    task that is run again, sees the same ranges.
    """
    parts = parts or default_parts(df)
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    col = df.select(F.col(order).cast("double").alias("v"))
    return sorted(set(col.approxQuantile("v", probs, 1 / (4 * parts))))


def with_range(df: DataFrame, order: str, bounds: list[float], out: str) -> DataFrame:
    """Add ``out``, the number of bounds not above the value: a monotone range number."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    splits = [-math.inf, *bounds, math.inf]
    (own,) = fresh(df, "range_value")
    value = df.withColumn(own, F.col(order).cast("double"))
    # Binary search in the JVM, for any number of bounds.
    cut = Bucketizer(splits=splits, inputCol=own, outputCol=out, handleInvalid="keep")
    return cut.transform(value).withColumn(out, F.col(out).cast("int")).drop(own)


def order_statistic(df: DataFrame, order: str, k: int, parts: int = 4096) -> int | None:
    """Exact k-th smallest value (k from 1) of an integer column.

    Narrows the value range with histograms of at most ``parts`` bins, a few
    one-column scans and no sort; the driver sees at most ``parts`` counts a round.
    """
    col = df.select(F.col(order).cast("bigint").alias("v")).filter("v IS NOT NULL")
    lo, hi, n = col.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k < 1 or n < k:
        return None
    while lo < hi:
        width = (hi - lo) // parts + 1
        hist = (
            col.filter(F.col("v").between(lo, hi))
            .groupBy(F.expr(f"(v - {lo}L) div {width}L").alias("b"))
            .count()
            .orderBy("b")
            .collect()
        )
        totals, run = [], 0
        for row in hist:
            run += row["count"]
            totals.append(run)
        at = bisect_left(totals, k)
        k -= totals[at - 1] if at else 0
        lo = lo + hist[at]["b"] * width
        hi = min(hi, lo + width - 1)
    return lo
