"""JSON report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, omit_zeros: bool = False, omit_nulls: bool = False) -> DataFrame:
    """One JSON document per row; zero counters may be left out."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if omit_zeros and kind in ("int", "bigint"):
            c = F.when(c != 0, c)
        cols.append(c.alias(name))
    ignore = str(omit_zeros or omit_nulls).lower()
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": ignore}).alias("value"))


def write_json_report(df: DataFrame, path: str, omit_zeros: bool = False) -> None:
    """Write a report-sized table as JSON lines."""
    as_json(df, omit_zeros).coalesce(1).write.mode("overwrite").text(path)
