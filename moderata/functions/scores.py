"""Expressions over a hate probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import HATE, MODERATION_ROUTES, NON_HATE, SEVERITY_BANDS


def decide(prob: Column, threshold: float | Column = 0.5) -> Column:
    return (prob >= threshold).cast("int")


def label_name(y: Column) -> Column:
    return F.when(y == 1, HATE).otherwise(NON_HATE)


def label_value(name: Column) -> Column:
    return F.when(name == HATE, 1).when(name == NON_HATE, 0)


def argmax_label(prob: Column) -> Column:
    """The likelier class; an exact tie goes to the first, NON-HATE."""
    return F.when(prob > 1 - prob, HATE).otherwise(NON_HATE)


def confidence(prob: Column) -> Column:
    return F.greatest(prob, 1 - prob)


def severity(prob: Column) -> Column:
    """0..100, halves to even."""
    return F.least(F.lit(100), F.rint(prob * 100).cast("int"))


def _ladder(sev: Column, steps) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, name in steps:
        out = out.when(sev >= low, name)
    return out


def band(sev: Column) -> Column:
    return _ladder(sev, SEVERITY_BANDS)


def route(sev: Column) -> Column:
    return _ladder(sev, MODERATION_ROUTES)


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def split_hash(key: Column, seed) -> Column:
    """A stable 32-bit number per key and seed, the same on any cluster."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
