"""Frame-level preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count, clean_text, is_code_mixed, word_count


def preprocess(
    df: DataFrame, text_col: str, *, tag: bool = True, tag_col: str = "is_hinglish", **flags
) -> DataFrame:
    """Add ``<text_col>_cleaned`` and a code-mix flag taken from the raw text."""
    if text_col not in df.columns:
        raise ValueError(f"column {text_col!r} not found in {df.columns}")
    cols = {f"{text_col}_cleaned": clean_text(F.col(text_col), **flags)}
    if tag:
        cols[tag_col] = is_code_mixed(F.col(text_col))
    return df.withColumns(cols)


def text_stats(df: DataFrame, text_col: str) -> DataFrame:
    c = F.col(text_col)
    return df.withColumns({"n_chars": char_count(c), "n_words": word_count(c)})
