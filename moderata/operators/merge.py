"""Merging labelled sources into one training set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import label_value
from ..functions.text import is_blank, strip, text_key
from .dedup import dedup_first, key_digest
from .filters import drop_blank, errors_of
from .split import sample_n

# Row ids take the low 56 bits of an order id, the source number the rest.
ROW_BITS = 56


@dataclass(frozen=True)
class Source:
    """One input: its table, its column names, and how its labels map to 0/1."""

    name: str
    df: DataFrame
    text_col: str
    label_col: str
    map_label: Callable[[Column], Column]
    language_col: str | None = None
    row_id: str = "row_id"


def _stack(sources: Sequence[Source]) -> DataFrame:
    """All rows with a common schema and one order id: source first, then row."""
    frames = []
    for i, s in enumerate(sources):
        row = F.col(s.row_id).cast("bigint")
        fits = row.between(0, (1 << ROW_BITS) - 1)
        frames.append(
            s.df.select(
                F.when(fits, row + F.lit(i << ROW_BITS))
                .otherwise(F.raise_error(F.lit("row id outside 0..2^56-1")).cast("bigint"))
                .alias("ord"),
                F.lit(s.name).alias("source_dataset"),
                F.col(s.text_col).alias("raw"),
                F.col(s.label_col).cast("string").alias("original_label"),
                (F.col(s.language_col) if s.language_col else F.lit(None)).cast("string")
                .alias("language"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def _survivors(stacked: DataFrame) -> DataFrame:
    return dedup_first(drop_blank(stacked, "raw"), text_key(F.col("raw")), "ord")


def _label(sources: Sequence[Source]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for s in sources:
        out = out.when(F.col("source_dataset") == s.name, s.map_label(F.col("original_label")))
    return out


def merge_sources(sources: Sequence[Source]) -> DataFrame:
    """Trimmed, non-blank, first-seen rows of all sources with 0/1 labels.

    Labels are mapped after deduplication, so a bad label on a dropped row
    never fails the job.
    """
    return _survivors(_stack(sources)).select(
        strip(F.col("raw")).alias("text"), _label(sources).alias("label"),
        "source_dataset", "original_label",
        strip(F.coalesce("language", F.lit(""))).alias("language_hint"),
    )


def merge_report(sources: Sequence[Source], merged: DataFrame | None = None) -> DataFrame:
    """Per-source row counts and label counts, with a ``merged`` total row.

    Pass the written result of :func:`merge_sources` as ``merged`` to spare
    the second deduplication.
    """
    stacked = _stack(sources)
    merged = merge_sources(sources) if merged is None else merged
    # A narrow aggregate over the inputs, and one over the survivors.
    seen = stacked.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(is_blank(F.col("raw")).cast("bigint")).alias("dropped_empty_text"),
    )
    kept = merged.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("kept_rows"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("label_0"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("label_1"),
    )
    counts = ["total_rows", "kept_rows", "dropped_duplicates", "dropped_empty_text",
              "label_0", "label_1"]
    per_source = (
        seen.join(kept, "source_dataset", "left").na.fill(0)
        .withColumn("dropped_duplicates",
                    F.col("total_rows") - F.col("kept_rows") - F.col("dropped_empty_text"))
    )
    return (
        per_source.rollup("source_dataset")
        .agg(F.grouping("source_dataset").alias("g"), *[F.sum(c).alias(c) for c in counts])
        .select(F.when(F.col("g") == 1, "merged").otherwise(F.col("source_dataset"))
                .alias("source_dataset"), *counts)
    )


def add_negatives(
    df: DataFrame, extra: DataFrame, sample: int | None = None, seed: int = 42,
    sample_key: str = "row_id",
) -> DataFrame:
    """Append unlabelled texts as label 0 and drop blank texts."""
    extra = extra if sample is None else sample_n(extra, sample, seed, sample_key)
    extra = extra.withColumn("label", F.lit(0))
    return drop_blank(df.unionByName(extra, allowMissingColumns=True), "text")


def correction_rows(feedback: DataFrame) -> DataFrame:
    """(id, key, label, input_text) of every submission that corrects its prediction."""
    fixes = errors_of(feedback, "prediction", "user_label").select(
        "id", key_digest(text_key(F.col("input_text"))).alias("key"),
        label_value(F.col("user_label")).alias("label"), "input_text")
    return fixes.filter("label IS NOT NULL")


def latest_corrections(feedback: DataFrame) -> DataFrame:
    """The newest correction of each text: (key, id, label, input_text)."""
    fixes = correction_rows(feedback)
    # A hash aggregate over keys and ids; texts are read again for the winners only.
    newest = fixes.groupBy("key").agg(F.max("id").alias("id"))
    return fixes.join(newest, ["key", "id"], "left_semi").select("key", "id", "label", "input_text").dropDuplicates(
        ["key", "id"])


def apply_corrections(train: DataFrame, corrections: DataFrame, text: str = "text") -> DataFrame:
    """Training rows with corrected labels, plus corrected texts not among them.

    ``corrections`` comes from :func:`latest_corrections`, best stored first as
    it is read twice. Each correction has its own key, so a training text
    repeated many times can be split over tasks.
    """
    keyed = train.withColumn("key", key_digest(text_key(F.col(text))))
    fixed = keyed.join(
        corrections.select("key", F.col("label").alias("fix")), "key", "left"
    ).select(
        F.col(text).alias("text"),
        F.coalesce("fix", "label").cast("int").alias("label"),
        F.col("fix").isNotNull().alias("corrected"),
    )
    # Distinct keys: a text repeated many times is one row on the right.
    new = corrections.join(keyed.select("key").distinct(), "key", "left_anti").select(
        F.col("input_text").alias("text"),
        F.col("label").cast("int").alias("label"),
        F.lit(True).alias("corrected"),
    )
    return fixed.unionByName(new)
