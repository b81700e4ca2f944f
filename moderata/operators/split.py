"""Deterministic splits, folds and samples.

Membership follows a hash of a key column and a seed: reruns, cluster size and
row order cannot change it. ``stratified_split`` and ``assign_folds`` deal out
rows, so exact shares may put two rows of one key on both sides (their hash
threshold forms do not); ``group_split`` and ``group_folds`` deal out keys, so
all copies of a key stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..functions.ranges import order_statistic
from ..functions.scores import split_hash
from ..sources.workspace import materialize

HASH_SPACE = 1 << 32
BIN_BITS = 16


def _below(frac: float) -> int:
    return round(frac * HASH_SPACE)


RANK = ("rank_of_row_", "rows_of_group_")  # columns that with_rank adds


def with_rank(df: DataFrame, by: list[str], seed, key: str) -> DataFrame:
    """Add the columns RANK: rank (from 1, in order of the key's hash, inside equal values of ``by``) and rows there.

    A histogram of the hash's top 16 bits gives the rows before each bin; rows
    are ranked inside their bin only, so no task sees a whole label. The join
    with the histogram and the window share one shuffle.
    """
    h = split_hash(F.col(key), seed)
    rank, n = RANK
    hashed, bin_, at, before, count, *groups = fresh(df, "hash_", "bin_", "at_", "before_", "c_", *[f"by{i}_" for i in range(len(by))])
    binned = df.withColumns({hashed: h, bin_: F.shiftright(h, 32 - BIN_BITS)})
    up_to = Window.partitionBy(*groups).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        binned.groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups)], bin_).agg(F.count(F.lit(1)).alias(count))
        .withColumns({before: F.coalesce(F.sum(count).over(up_to), F.lit(0)),
                      n: F.sum(count).over(Window.partitionBy(*groups))})
        .withColumnRenamed(bin_, at).drop(count)
    )
    same = binned[bin_] == hist[at]
    for c, g in zip(by, groups):
        same = same & binned[c].eqNullSafe(hist[g])
    inside = Window.partitionBy(*by, bin_).orderBy(hashed, key)
    return binned.join(hist, same).withColumn(rank, F.col(before) + F.row_number().over(inside)).drop(
        *groups, at, before, hashed, bin_)


def stratified_split(
    df: DataFrame, label: str, frac: float = 0.15, seed=42, key: str = "doc_id",
    exact: bool = True, out: str = "split",
) -> DataFrame:
    """Mark rows ``test`` or ``train``: of each label exactly ``rint(frac * rows)`` are test rows.

    Those with the smallest (hash, key); ``key`` should be unique. Without
    ``exact`` a hash threshold: one narrow pass, each label's share is ``frac``
    in expectation only.
    """
    if not exact:
        h = split_hash(F.col(key), seed)
        return df.withColumn(out, F.when(h < _below(frac), "test").otherwise("train"))
    test = F.col(RANK[0]) <= F.rint(F.col(RANK[1]) * frac)
    return with_rank(df, [label], seed, key).withColumn(out, F.when(test, "test").otherwise("train")).drop(*RANK)


def smallest_cut(df: DataFrame, group: str, h: str, tie: str, k: Column) -> DataFrame:
    """Per group, the (hash, tie) of its k-th smallest row; ``k`` may use ``n``.

    A histogram of the hash's top 16 bits finds the bin that holds the cut;
    only the rows of that bin, one in 65 536, are ranked.
    """
    binned = df.select(
        F.col(group).alias("cut_group"), F.col(h).alias("cut_h"), F.col(tie).alias("cut_tie"),
        F.shiftright(h, 32 - BIN_BITS).alias("b"),
    )
    up_to = Window.partitionBy("cut_group").orderBy("b")
    whole = Window.partitionBy("cut_group")
    hist = (
        binned.groupBy("cut_group", "b").agg(F.count(F.lit(1)).alias("c"))
        .withColumns({"cum": F.sum("c").over(up_to), "n": F.sum("c").over(whole)})
        .withColumn("k", k)
        .filter("cum >= k AND cum - c < k")
        .select(F.col("cut_group").alias("g"), F.col("b").alias("gb"),
                (F.col("k") - F.col("cum") + F.col("c")).alias("need"))
    )
    rank = F.row_number().over(Window.partitionBy("cut_group").orderBy("cut_h", "cut_tie"))
    return (
        binned.join(hist, binned["cut_group"].eqNullSafe(hist["g"]) & (binned["b"] == hist["gb"]))
        .withColumn("rank", rank)
        .filter("rank = need")
        .select("cut_group", "cut_h", "cut_tie")
    )


def nested_split(
    df: DataFrame, label: str, test_frac: float = 0.15, val_frac: float = 0.1, seed=42,
    key: str = "doc_id",
) -> DataFrame:
    """``test``, and of each label's other rows ``rint(val_frac * rows)`` are ``val``, with independent hashes."""
    out = with_rank(stratified_split(df, label, test_frac, seed, key), [label, "split"], f"{seed}:val", key)
    val = (F.col("split") == "train") & (F.col(RANK[0]) <= F.rint(F.col(RANK[1]) * val_frac))
    return out.withColumn("split", F.when(val, "val").otherwise(F.col("split"))).drop(*RANK)


def split_summary(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def assign_folds(df: DataFrame, k: int = 5, seed=42, key: str = "doc_id", label: str | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1; row r trains every fold but its own. k=1: no folds.

    With ``label`` a label's rows are dealt out in turn, so its folds differ by
    at most one row. Without, the fold is a hash and the pass is narrow.
    """
    if k <= 1:
        return df.withColumn("fold", F.lit(None).cast("int"))
    if label is None:
        h = split_hash(F.col(key), f"{seed}:fold")
        return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
    dealt = with_rank(df, [label], f"{seed}:fold", key)
    return dealt.withColumn("fold", ((F.col(RANK[0]) - 1) % k).cast("int")).drop(*RANK)


HOT_ROWS = 1_000_000


def key_ranks(df: DataFrame, label: str, seed, key: str) -> DataFrame:
    """(key, size, stratum, before, total): one row per distinct key.

    A key's stratum is the label most of its rows have, of several the
    smallest. ``before`` counts the rows of the stratum's keys that come earlier
    in order of (hash, key), ``total`` all of the stratum. Copies are
    pre-aggregated, so a key on a third of all rows is one row; sums over bins of
    the hash's top bits leave only the keys of one bin to a task.
    """
    counts = df.groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("c"))
    most = F.min(F.struct((-F.col("c")).alias("c"), F.col("label").isNull().alias("none"), "label"))
    keys = counts.groupBy("key").agg(F.sum("c").alias("size"), most["label"].alias("stratum"))
    h = split_hash(F.col("key"), seed)
    keys = materialize(keys.withColumns({"h": h, "bin": F.shiftright(h, 32 - BIN_BITS)}), "keys")
    up_to = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    hist = keys.groupBy("stratum", "bin").agg(F.sum("size").alias("c")).select(
        F.col("stratum").alias("of"), F.col("bin").alias("at"), F.coalesce(F.sum("c").over(up_to), F.lit(0)).alias("earlier"),
        F.sum("c").over(Window.partitionBy("stratum")).alias("total"))
    inside = Window.partitionBy("stratum", "bin").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    joined = keys.join(hist, keys["stratum"].eqNullSafe(hist["of"]) & (keys["bin"] == hist["at"]))
    return joined.select("key", "size", "stratum", (F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("before"),
                         "total")


def _told(df: DataFrame, key: str, known: DataFrame, out: str, hot_rows: int) -> DataFrame:
    """``df`` with the value its key has in ``known`` (key, size, value).

    Keys with more than ``hot_rows`` rows, at most rows / hot_rows of them, are
    broadcast, so their rows stay where they are; the others are joined.
    """
    own, value = fresh(df, "key_of_row", out)
    known = materialize(known, "dealt")
    hot, cold = (known.filter(c).select(F.col("key").alias(own), F.col("value").alias(value))
                 for c in (F.col("size") > hot_rows, F.col("size") <= hot_rows))
    same = df[key].eqNullSafe(F.col(own))
    kept = [F.col(c) for c in df.columns if c.lower() != out.lower()]
    parts = [df.join(F.broadcast(hot), same).select(*kept, F.col(value).alias(out)),
             df.join(F.broadcast(hot), same, "left_anti").join(cold, same).select(*kept, F.col(value).alias(out))]
    return parts[0].unionByName(parts[1])


def group_split(
    df: DataFrame, label: str, frac: float = 0.15, seed=42, key: str = "text", out: str = "split", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mark rows ``test`` or ``train``, all rows of one key alike.

    Keys are taken per stratum in order of (hash, key) until their rows reach
    ``rint(frac * rows)``; the last key may pass it, so every share is within
    one key of ``frac``.
    """
    ranks = key_ranks(df, label, seed, key)
    test = F.col("before") < F.rint(F.col("total") * frac)
    return _told(df, key, ranks.select("key", "size", F.when(test, "test").otherwise("train").alias("value")), out, hot_rows)


def group_folds(
    df: DataFrame, k: int = 5, seed=42, key: str = "text", label: str = "label", out: str = "fold", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``fold`` in 0..k-1, all rows of one key alike: k stretches of the keys, of nearly equal rows, per stratum."""
    if k <= 1:
        return df.withColumn(out, F.lit(None).cast("int"))
    ranks = key_ranks(df, label, f"{seed}:fold", key)
    fold = F.floor(F.col("before") * k / F.col("total")).cast("int")
    return _told(df, key, ranks.select("key", "size", fold.alias("value")), out, hot_rows)


def sample_n(df: DataFrame, n: int, seed=42, key: str = "doc_id") -> DataFrame:
    """A seeded sample of exactly n rows (all rows when there are no more).

    The n smallest (hash, key) pairs, ``key`` unique: found as a cut value, so
    the sample itself never passes through the driver.
    """
    h = split_hash(F.col(key), seed)
    cut = (
        smallest_cut(df.select(F.lit(0).alias("g"), h.alias("h"), key), "g", "h", key,
                     F.lit(n).cast("bigint")).first()
    )
    if cut is None:
        return df if n > 0 else df.limit(0)
    at, tie = cut["cut_h"], F.lit(cut["cut_tie"])
    return df.filter((h < at) | ((h == at) & (F.col(key) <= tie)))


def ordered_split(df: DataFrame, order: str, frac: float = 0.8) -> DataFrame:
    """The first ``int(frac * n)`` rows by a unique integer ``order`` are train."""
    cut = order_statistic(df, order, int(frac * df.count()))
    if cut is None:
        return df.withColumn("split", F.lit("test"))
    return df.withColumn("split", F.when(F.col(order) <= cut, "train").otherwise("test"))
