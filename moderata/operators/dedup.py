"""Order-stable deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text


def key_digest(key: Column) -> Column:
    """32-byte stand-in for a text of any length (SHA-256).

    Equal digests mean equal texts for any data that can exist, and shuffles
    move 32 bytes instead of whole posts. Never null, so that joins on it need
    no null test, which would evaluate the text expression once more.
    """
    return F.coalesce(F.unhex(F.sha2(key, 256)), F.lit(b""))


def first_orders(df: DataFrame, key: Column, order: str, exact_key: bool = False,
                 skip_empty: bool = False) -> DataFrame:
    """The smallest ``order`` of each key, as a one-column frame.

    Pre-aggregated before the shuffle, so a key held by a third of the rows
    costs one row per task.
    """
    keyed = df.select(order, key.alias("key"))
    k = F.col("key") if exact_key else key_digest(F.col("key"))
    first = (
        keyed.select(order, k.alias("k"), F.length("key").alias("n"))
        .groupBy("k").agg(F.min(order).alias(order), F.min("n").alias("n"))
    )
    # A filter on an aggregate stays above it; one on the key would be pushed
    # down and evaluate the key expression once more for every row.
    return (first.filter("n > 0") if skip_empty else first).select(order)


def dedup_first(df: DataFrame, key: Column, order: str, exact_key: bool = False) -> DataFrame:
    """Keep, for each key, the row with the smallest ``order``.

    ``order`` must be unique: the survivors are picked by it, not by the key,
    so this join cannot be skewed.
    """
    return df.join(first_orders(df, key, order, exact_key), order, "left_semi")


def dedup_clean(df: DataFrame, order: str, raw: str = "text_raw", out: str = "text",
                **flags) -> DataFrame:
    """Clean ``raw`` into ``out``, drop rows that become empty, keep the first
    row of each cleaned text.

    The empty text is one more key that is left out after the grouping: a
    filter on the cleaned column would run the cleaner again for every row.
    The column itself is made for the survivors only.
    """
    text = clean_text(F.col(raw), **flags)
    first = first_orders(df, text, order, skip_empty=True)
    return df.join(first, order, "left_semi").withColumn(out, text)


def dedup_clean_report(df: DataFrame, raw: str = "text_raw", **flags) -> DataFrame:
    """Rows with text, rows kept and near copies removed by :func:`dedup_clean`.

    Counts groups, so no row is looked up again.
    """
    cleaned = df.select(clean_text(F.col(raw), **flags).alias("text"))
    groups = cleaned.select(key_digest(F.col("text")).alias("k"), F.length("text").alias("n"))
    sizes = groups.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    return sizes.filter("n > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows_in"),
        F.count(F.lit(1)).alias("rows_out"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("removed"),
    )
