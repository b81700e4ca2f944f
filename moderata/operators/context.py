"""Conversation context: each text with the messages before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..functions.constants import CONTEXT_SEPARATOR
from ..functions.ranges import range_bounds, with_range
from ..functions.text import is_blank

HOT_ROWS = 1_000_000
HOT_BYTES = 256 << 20
RANGE_ROWS = 250_000
# Of texts per range, and per task on average.
RANGE_BYTES = 16 << 20
# Rows handed over to later ranges that may travel to every task.
HALO_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int, text: str | None = None, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(key, n, bytes) of keys with more rows or more text than one task should sort: at most rows / hot_rows + bytes / hot_bytes keys."""
    size = F.lit(0) if text is None else F.octet_length(text)
    per_key = df.filter(F.col(key).isNotNull()).select(key, size.alias("size")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return per_key.filter((F.col("n") > hot_rows) | (F.col("bytes") > hot_bytes))


def _last(items: Column, n: int) -> Column:
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def _handed_over(ids: DataFrame, by: str, order: str, rng: str, n: int) -> DataFrame:
    """(by, order, rng): the last ``n`` rows before each range, by their ids alone; ``rng`` is the range that they go to."""
    tail, place = fresh(ids, "tail", "place")
    backward = Window.partitionBy(by, rng).orderBy(F.col(order).desc())
    tails = ids.withColumn(place, F.row_number().over(backward)).filter(F.col(place) <= n).groupBy(by, rng).agg(
        F.sort_array(F.collect_list(order)).alias(tail))
    # A range that occurs has at least one row, so n earlier ranges are enough.
    earlier = Window.partitionBy(by).orderBy(rng).rowsBetween(-n, -1)
    return tails.select(by, rng, _last(F.flatten(F.collect_list(tail).over(earlier)), n).alias(tail)).select(
        by, rng, F.explode(tail).alias(order))


def with_context(
    df: DataFrame, by: str, order: str, text: str = "text", n: int = 2,
    sep: str = CONTEXT_SEPARATOR, hot_rows: int = HOT_ROWS, parts: int | None = None,
) -> DataFrame:
    """Add ``context`` (up to ``n`` previous texts, oldest first, blanks left
    out) and ``context_text`` (context and text joined).

    ``order`` is a whole number, unique within ``by``. A key with more than
    ``hot_rows`` rows, or more than ``HOT_BYTES`` of text, is cut into ranges of
    ``order``, each its own window partition with the last ``n`` rows of earlier
    ranges put before it; tasks grow in number with the texts, not in size. A row
    without a key belongs to no conversation and gets no context. Columns of the
    caller stay as they are, but for ones with the names of the two results.
    """
    if not by:
        raise ValueError("context needs a conversation or source column")
    # Rows without a key are spread over partitions of their own.
    alone = F.when(F.col(by).isNull(), F.col(order).cast("bigint")).otherwise(F.lit(0))
    rng, is_hot, halo, recent, said, joined = fresh(df, "rng", "is_hot", "halo", "recent", "said", "joined")
    hot = hot_keys(df, by, hot_rows, text, HOT_BYTES)
    keys, rows, size = hot.agg(F.count(F.lit(1)), F.sum("n"), F.sum("bytes")).first()
    if keys:
        parts = parts or max(2, rows // RANGE_ROWS, -(-size // RANGE_BYTES))
        named = hot.select(by, F.lit(True).alias(is_hot))
        named = F.broadcast(named) if keys <= HALO_ROWS else named
        narrow = df.select(by, order).join(named, by).drop(is_hot)
        bounds = range_bounds(narrow, order, parts)
        d = with_range(df.join(named, by, "left"), order, bounds, rng).withColumn(
            rng, F.when(F.col(is_hot), F.col(rng)).otherwise(alone)).drop(is_hot)
        handed = _handed_over(with_range(narrow, order, bounds, rng), by, order, rng, n)
        handed = F.broadcast(handed) if min(rows, keys * (len(bounds) + 1)) * n <= HALO_ROWS else handed
        before_range = df.select(by, order, text).join(handed, [by, order]).withColumn(halo, F.lit(True))
        d = d.withColumn(halo, F.lit(False)).unionByName(before_range, allowMissingColumns=True)
        # A number of parts of its own: adaptive execution would put small ranges together again.
        whole = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        d = d.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-whole // RANGE_BYTES)), by, rng)
    else:
        d = df.withColumn(rng, alone).withColumn(halo, F.lit(False))
    before = Window.partitionBy(by, rng).orderBy(order).rowsBetween(-n, -1)
    # Collects no nulls; they are blank as well.
    out = d.withColumn(recent, F.collect_list(text).over(before)).filter(~F.col(halo))
    out = out.withColumn(said, F.filter(recent, lambda m: ~is_blank(m)))
    out = out.withColumn(joined, F.array_join(F.concat(said, F.array(F.coalesce(F.col(text), F.lit("")))), sep))
    kept = [c for c in df.columns if c.lower() not in ("context", "context_text")]
    return out.select(*kept, F.col(said).alias("context"), F.col(joined).alias("context_text"))
