"""Document fingerprints by winnowing, in built-in functions only.

Words (runs without white space, cut after 32 code points) are hashed, hashes
of ``k`` neighbouring words are combined, and of every ``window`` neighbouring
k-grams the least hash is chosen, of equal ones the rightmost. The position
(number of its first word) of each chosen k-gram is kept. Two texts that share
``window + k - 1`` words in a row share a chosen k-gram there; that is the
match guarantee. A text with fewer than ``k`` words has one k-gram of all its
words; one without words has an empty fingerprint.

A chosen k-gram is one long: 33 bits of hash, then 30 bits that count positions
down, so that the least value is the least hash with the largest position. The
minimum of a window is built by doubling (of 2, 4, 8 values), so its cost does
not depend on the window's length.

Null texts count as empty. Likeness is the shared part of the distinct hashes
(Jaccard); 1 for two empty fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moderata.functions.ranges import range_bounds, with_range

K = 3
DOUBLINGS = 3  # window of 8
POSITIONS = (1 << 30) - 1
RANGE_ROWS = 2_000
MAX_RANGES = 100_000


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, doublings: int = DOUBLINGS) -> DataFrame:
    """Add the array of chosen k-grams of a text that is not null."""
    df = df.withColumn("words_", F.transform(F.regexp_extract_all(text, F.lit(r"[^\s]{1,32}"), F.lit(0)), lambda w: F.xxhash64(w)))
    # Rolling combination of neighbouring hashes; short texts keep what they have.
    for i in range(1, k):
        df = df.withColumn("words_", F.when(
            F.size("words_") > 1,
            F.zip_with(F.slice("words_", 1, F.greatest(F.size("words_") - 1, F.lit(0))),
                       F.expr("slice(words_, 2, greatest(size(words_) - 1, 0))"), lambda a, b: F.xxhash64(a, b))
        ).otherwise(F.col("words_")))
    df = df.withColumn("least_", F.transform("words_", lambda h, i: (
        F.shiftleft(F.shiftrightunsigned(h, 31), 30).bitwiseOR(F.lit(POSITIONS).cast("long") - i))))
    for d in range(doublings):
        step = 1 << d
        left = F.expr(f"slice(least_, 1, size(least_) - {step})")
        right = F.expr(f"slice(least_, {step + 1}, size(least_))")
        # A text with fewer k-grams than the window is one window.
        df = df.withColumn("least_", F.when(F.size("least_") > step, F.zip_with(left, right, lambda a, b: F.least(a, b)))
                           .when(F.size("least_") > 1, F.array(F.array_min("least_"))).otherwise(F.col("least_")))
    return df.withColumn(out, F.array_distinct("least_")).drop("words_", "least_")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda c: F.shiftright(c, 30)))


def positions(fingerprint: Column) -> Column:
    """First word of every chosen k-gram, in order."""
    return F.transform(fingerprint, lambda c: (F.lit(POSITIONS).cast("long") - c.bitwiseAND(F.lit(POSITIONS).cast("long"))).cast("int"))


def printed(fingerprint: Column) -> Column:
    """``hash@position`` of every chosen k-gram, in hexadecimal, in the order of the text."""
    return F.array_join(F.transform(fingerprint, lambda c: F.concat(
        F.lower(F.hex(F.shiftright(c, 30))), F.lit("@"),
        F.lower(F.hex(F.lit(POSITIONS).cast("long") - c.bitwiseAND(F.lit(POSITIONS).cast("long")))))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, fp, next_text, next_fp): each document with the one after it in order of the key.

    The key is cut into ranges whose bounds are keys, so a range's first row is
    known by its key alone and is also sent to the range before it; the first
    row of all closes the last range. Ties are put in order of their texts;
    null keys come first.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("order_", F.coalesce(F.col("key").cast("double"), F.lit(-1.7e308)))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    bounds = range_bounds(rows, "order_", ranges) if ranges > 1 else []
    first = rows.agg(F.min("order_")).first()[0]
    last = len(bounds)
    cut = with_range(rows, "order_", bounds, "range_").drop("range_value")
    starts = docs.sparkSession.createDataFrame([(b, True) for b in bounds], "order_ double, opens_ boolean")
    cut = cut.join(F.broadcast(starts), "order_", "left")  # fewer than MAX_RANGES rows
    places = F.array(F.struct(F.col("range_"), F.lit(0).alias("visit_")))
    places = F.when(F.coalesce("opens_", F.lit(False)) & (F.col("range_") > 0), F.concat(
        places, F.array(F.struct((F.col("range_") - 1).alias("range_"), F.lit(1).alias("visit_"))))).otherwise(places)
    places = F.when(F.col("order_") == F.lit(first), F.concat(
        places, F.array(F.struct(F.lit(last).alias("range_"), F.lit(2).alias("visit_"))))).otherwise(places)
    dealt = cut.withColumn("place_", places).select("key", "order_", "text", F.inline("place_")).repartition("range_")
    dealt = with_fingerprint(dealt, "text", "fp")
    along = Window.partitionBy("range_").orderBy("visit_", "order_", "key", "text")
    return dealt.select(
        "key", "text", "fp", "visit_", F.lead("text").over(along).alias("next_text"),
        F.lead("fp").over(along).alias("next_fp")).filter("visit_ = 0")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last ``floor(n / 2)`` code points replaced by the
    first as many of the next document.
    """
    pairs = with_next(docs, key, text).withColumn("n_chars", F.char_length("text").cast("long"))
    half = "CAST(n_chars div 2 AS INT)"
    edited = pairs.withColumn("edited", F.expr(
        f"concat(substring(text, 1, CAST(n_chars AS INT) - {half}), substring(coalesce(next_text, text), 1, {half}))"))
    edited = edited.select("key", "n_chars", "edited", "fp", hashes(F.col("fp")).alias("h"),
                           hashes(F.coalesce("next_fp", "fp")).alias("next_h"))
    edited = with_fingerprint(edited, "edited", "edited_fp").withColumn("edited_h", hashes(F.col("edited_fp")))
    return edited.select(
        F.col("key").alias(key), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness("h", "edited_h").alias("near_edited"), likeness("h", "next_h").alias("near_next"))
