"""License scans by diagonal voting, in built-in functions only.

Every word k-gram of every text is joined, by its hash, to the places where it
stands in the templates (and the words themselves are compared). A hit votes
for the diagonal ``place in the text - place in the template``; votes are
gathered per text, template and diagonal. A phrase stands at a diagonal if all
its k-grams voted for it. For the longer templates of the method, the diagonals
at most DRIFT from one (words left out or put in) are merged with it, and the
span is verified: every k-gram of the template counts once, at its place
nearest to the middle diagonal, and only if it comes after all those of earlier
k-grams. The span is accepted when the k-grams in order are enough of the
template and their stretch is not much longer than it.

The templates are a parameter with some tens of words, so they are broadcast.
Each text also sends one row with its number of words, so texts without a hit
stay. Rows are told apart by their place in the input, so repeated keys, null
keys and repeated rows each give a row of their own. Null texts count as empty;
an empty table gives an empty result. A very long text is one row of words, and
its votes are rows. Columns other than key and text are left out, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Labels of the method: longer wordings, matched with gaps.
TEMPLATES = {
    "under the mit license": "mit",
    "under the apache license version 2 0": "apache-2.0",
    "under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "dedicated to the public domain": "public-domain",
}
DRIFT = 2  # diagonals that are merged
ENOUGH = 0.75  # share of a template's k-grams
STRETCH = 1.5  # length of a span in lengths of the template


def template_grams(spark, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(gram, h, at, template, grams, label, base): every k-gram of every template."""
    rows = []
    for base, group in ((True, phrases), (False, templates)):
        for wording, label in group.items():
            words = wording.split(" ")
            n = len(words) - K + 1
            rows += [(" ".join(words[i: i + K]), i, wording, n, label, base) for i in range(n)]
    table = spark.createDataFrame(rows, "gram string, at int, template string, grams int, label string, base boolean")
    return table.withColumn("h", F.xxhash64("gram"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
         templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    ``score`` is the largest share of a template that a text holds; ``spans``
    are the accepted places as (label, first word, last word).
    """
    spark = docs.sparkSession
    known = template_grams(spark, phrases, templates)
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                        F.array_remove(F.split(lower, SEPARATORS), "").alias("words"))
    pairs = F.expr("zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), "
                   "(a, b) -> concat(a, ' ', b))")
    # Place 0 is the text's own row: its number of words, which is no k-gram.
    grams = words.select("row", "key", F.posexplode(F.concat(F.array(F.size("words").cast("string")), pairs)).alias("place", "gram"))
    votes = (
        grams.withColumn("h", F.xxhash64("gram"))
        .join(F.broadcast(known), ["h", "gram"], "left")  # some tens of rows
        .filter("place = 0 OR at IS NOT NULL")
        .select("row", "key", "template", "grams", "label", "base", (F.col("place") - 1 - F.col("at")).alias("diagonal"),
                F.when(F.col("place") == 0, F.col("gram").cast("long")).alias("n_words"), "at"))
    diagonals = votes.groupBy("row", "key", "template", "grams", "label", "base", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.collect_set("at").alias("ats"))  # as many as the template has
    around = Window.partitionBy("row", "template").orderBy(F.col("diagonal").cast("long")).rangeBetween(-DRIFT, DRIFT)
    near = F.when(~F.col("base"), F.collect_list(F.struct("diagonal", "ats")).over(around))
    # Per k-gram of the template the nearest of its places; then those that come after all before them.
    placed = F.expr("""filter(transform(sequence(0, grams - 1), i -> array_min(transform(
        filter(near, n -> array_contains(n.ats, i)), n -> struct(abs(n.diagonal - diagonal) AS off, n.diagonal + i AS place)))),
        p -> p IS NOT NULL)""")
    chained = F.aggregate("placed", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("first"), F.lit(-1).alias("last")), lambda c, p: F.when(
        p["place"] > c["last"], F.struct((c["n"] + 1).alias("n"), F.when(c["n"] == 0, p["place"]).otherwise(c["first"]).alias("first"),
                                         p["place"].alias("last"))).otherwise(c))
    found = diagonals.withColumn("near", near).withColumn("placed", F.when(F.col("near").isNotNull(), placed)).withColumn(
        "chain", F.when(F.col("near").isNotNull(), chained))
    found = found.select(
        "row", "key", "template", "label", "base", "diagonal", "n_words",
        (F.col("base") & (F.size("ats") == F.col("grams"))).alias("stands"),
        F.when(F.col("base"), F.size("ats")).otherwise(F.col("chain.n")).alias("hits"), "grams",
        F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("chain.first")).alias("first"),
        F.when(F.col("base"), F.col("diagonal") + F.col("grams") + K - 2).otherwise(F.col("chain.last") + K - 1).alias("last"))
    share = F.col("hits") / F.col("grams")
    verified = ~F.col("base") & (share >= ENOUGH) & (F.col("last") - F.col("first") + 1 <= STRETCH * (F.col("grams") + K - 1))
    # Of accepted spans at neighbouring diagonals, the one with the most k-grams is listed.
    most = F.max(F.when(F.col("near"), F.struct("hits", (-F.col("diagonal")).alias("d")))).over(around)
    found = found.withColumn("share", share).withColumn("near", F.coalesce(verified, F.lit(False))).withColumn(
        "listed", F.col("near") & (most["hits"] == F.col("hits")) & (most["d"] == -F.col("diagonal")))
    whole = F.col("base") & F.col("stands")
    accepted = whole | F.col("near")
    return found.groupBy("row", "key").agg(
        F.coalesce(F.max("n_words"), F.lit(0).cast("long")).alias("n_words"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(accepted, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(accepted, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(whole | F.col("listed"), F.struct("label", "first", "last")))).alias("spans"),
    ).drop("row").withColumnRenamed("key", key)
