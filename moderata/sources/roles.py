"""Finding and naming the text and label columns of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TEXT_WORDS = ("text",)
LABEL_WORDS = ("label", "class")


def _named(columns: list[str], words: tuple[str, ...]) -> str | None:
    """The first column whose name holds one of the words, whatever its case."""
    for column in columns:
        if any(word in column.lower() for word in words):
            return column
    return None


def infer_roles(df: DataFrame) -> tuple[str, str]:
    """(text column, label column), found by the words in their names."""
    found = _named(df.columns, TEXT_WORDS), _named(df.columns, LABEL_WORDS)
    if None in found:
        raise ValueError(f"no text or label column among {df.columns}")
    if found[0] == found[1]:
        raise ValueError(f"column {found[0]!r} matches both text and label")
    return found


def standardize(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Keep the two columns, named ``text`` and ``label``."""
    missing = {text_col, label_col} - set(df.columns)
    if missing:
        raise ValueError(f"the table lacks {sorted(missing)}; it has {df.columns}")
    return df.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
