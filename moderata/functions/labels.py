"""Label mapping expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import HS_CODES, POSITIVE_LABELS
from .text import strip


def _unknown(c: Column, policy: str, what: str) -> Column:
    if policy == "zero":
        return F.lit(0)
    if policy == "drop":
        return F.lit(None).cast("int")
    if policy == "fail":
        shown = F.coalesce(c.cast("string"), F.lit("NULL"))
        return F.raise_error(F.concat(F.lit(f"Unexpected {what}: "), shown)).cast("int")
    raise ValueError(f"on_unknown must be zero, drop or fail, not {policy!r}")


def binarize(
    c: Column, positives: Sequence[str] = POSITIVE_LABELS, trimmed: bool = False
) -> Column:
    """1 for a listed name in any case, else 0; null stays null.

    Values are compared as they print, so ``1.0`` is not ``1``, and
    surrounding spaces count unless ``trimmed``.
    """
    s = F.lower(c.cast("string"))
    s = strip(s) if trimmed else s
    hit = s.isin([str(p).lower() for p in positives])
    return F.when(s.isNull(), None).otherwise(hit.cast("int")).cast("int")


def binarize_int(c: Column) -> Column:
    """0 stays 0, any other integer is 1; a value that is no integer fails."""
    return (c.cast("int") != 0).cast("int")


def strict_binary(c: Column, on_unknown: str = "fail") -> Column:
    s = strip(c.cast("string"))
    return (
        F.when(s == "0", 0).when(s == "1", 1).otherwise(_unknown(c, on_unknown, "label"))
    ).cast("int")


def normalize_code(c: Column) -> Column:
    """Label code without spaces and single quotes around it, upper case."""
    return F.upper(F.btrim(strip(c), F.lit("'")))


def map_codes(
    c: Column, mapping: Mapping[str, int] = HS_CODES, on_unknown: str = "fail"
) -> Column:
    code = normalize_code(c)
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, value in mapping.items():
        out = out.when(code == name, F.lit(value))
    return out.otherwise(_unknown(c, on_unknown, "label code")).cast("int")
