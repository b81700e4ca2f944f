"""Tokens, n-grams, vocabulary and TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..functions.text import WORD, squash
from ..sources.workspace import materialize

# Largest vocabulary that may travel with a model and be broadcast.
MODEL_TERMS = 500_000


def tokens(c: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}{{2,}})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def default_stop_words() -> list[str]:
    """Spark's English list; pass another list where a given one must be matched."""
    return StopWordsRemover.loadDefaultStopWords("english")


def remove_stop(words: Column, stop: Sequence[str] | None = None) -> Column:
    """Drop listed words; repeats and order of the others stay."""
    listed = list(default_stop_words() if stop is None else stop)
    return F.filter(words, lambda w: ~w.isin(listed)) if listed else words


def ngrams(words: Column, lo: int = 1, hi: int = 2) -> Column:
    """Word n-grams for n in lo..hi: all unigrams first, then all bigrams, ...

    A lookahead captures n words and the match consumes one, so each length is
    one regex pass over the joined words. Words must not contain spaces.
    """
    joined = F.array_join(words, " ")
    grams = [
        words if n == 1 else F.regexp_extract_all(
            joined, F.lit(rf"(?=([^ ]+(?: [^ ]+){{{n - 1}}}))[^ ]+"), F.lit(1))
        for n in range(lo, hi + 1)
    ]
    return F.concat(*grams) if len(grams) > 1 else grams[0]


def char_ngrams(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams (lo >= 2) inside words padded with one space on each side.

    In a single-spaced text these are the windows with no space but at their
    ends. A padded word shorter than ``lo`` gives itself once.
    """
    padded = F.concat(F.lit(" "), squash(F.coalesce(c, F.lit(""))), F.lit(" "))
    grams = []
    for n in range(lo, hi + 1):
        window = rf"[^\n][^ ]{{{n - 2}}}[^\n]" if n > 2 else r"[^ ][^\n]|[^\n][^ ]"
        if n == lo and lo > 3:
            window += rf"| [^ ]{{1,{n - 3}}} "
        grams.append(F.regexp_extract_all(padded, F.lit(rf"(?=({window}))[^\n]"), F.lit(1)))
    return F.concat(*grams) if len(grams) > 1 else grams[0]


def unpacked(df: DataFrame, *rows: Column) -> DataFrame:
    """``explode_outer`` or ``inline_outer`` beside other columns, without the row of nulls that an empty array gives.

    For ``explode``, Spark infers a filter on the array's size and moves it down, even below an exchange,
    so what makes the array would run twice. Items must not be null.
    """
    out = df.select(*rows)
    return out.filter(F.col(out.columns[-1]).isNotNull())


def _char_rows(df: DataFrame, text: str, lo: int, hi: int, by: Sequence[str]) -> DataFrame:
    """(by..., n, term): the character n-grams of each distinct word, with the word's occurrences."""
    words = F.split(squash(F.coalesce(text, F.lit(""))), " ")
    counted = unpacked(df, *by, F.explode_outer(words).alias("word")).filter("word != ''").groupBy(*by, "word").agg(
        F.count(F.lit(1)).alias("n"))
    return unpacked(counted, *by, "n", F.explode_outer(char_ngrams(F.col("word"), lo, hi)).alias("term"))


def char_ngram_counts(df: DataFrame, text: str = "text", lo: int = 3, hi: int = 5) -> DataFrame:
    """(gram, n): occurrences of the character n-grams of all texts.

    N-grams lie inside words, so words are counted first and each distinct one is
    cut up once, with its number of occurrences.
    """
    return _char_rows(df, text, lo, hi, ()).groupBy(F.col("term").alias("gram")).agg(F.sum("n").alias("n"))


def add_terms(
    df: DataFrame, text: str = "text", lo: int = 1, hi: int = 2, char: bool = False,
    stop: Sequence[str] | None = (), out: str = "terms",
) -> DataFrame:
    """Add the array of word n-grams, on request followed by character n-grams."""
    (words,) = fresh(df, "words")
    d = df.withColumn(words, remove_stop(tokens(F.col(text)), stop))
    grams = ngrams(F.col(words), lo, hi)
    if char:
        grams = F.concat(grams, char_ngrams(F.col(text)))
    return d.withColumn(out, grams).drop(words)


def doc_terms(df: DataFrame, doc: str = "doc_id", terms: str = "terms") -> DataFrame:
    """Long table (doc, term, tf), made row by row without a shuffle.

    Sorts each row's terms and measures the runs of equal ones.
    """
    d = df.select(doc, F.sort_array(terms).alias("s")).withColumn("n", F.size("s"))
    # No filter on empty arrays: it would sort every row once more.
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    # Positions where a run starts. Nulls come first and start none.
    d = d.select(doc, "s", "n", F.filter(numbers, lambda i: ~F.get("s", i).eqNullSafe(F.get("s", i - 1))).alias("at"))
    end = F.concat(_but_first(F.col("at"), 2), F.array("n"))
    rows = d.select(doc, F.inline_outer(F.arrays_zip(
        F.transform("at", lambda i: F.get("s", i)).alias("term"),
        F.zip_with(end, "at", lambda z, a: z - a).alias("tf"))))
    return rows.filter(F.col("term").isNotNull())


def _but_first(items: Column, start: int) -> Column:
    """All items but one, from position ``start``; empty for an empty array."""
    return F.slice(items, F.lit(start), F.greatest(F.size(items) - 1, F.lit(0)))


def term_stats(df: DataFrame, by: Sequence[str] = (), terms: str = "terms") -> DataFrame:
    """(by..., term, df, cnt): documents with the term, and its occurrences.

    Each row is unpacked twice, once with all and once with distinct terms, so
    one grouping, pre-aggregated in every task, gives both counts.
    """
    both = F.array(
        F.struct(F.lit(0).alias("in_doc"), F.col(terms).alias("t")),
        F.struct(F.lit(1).alias("in_doc"), F.array_distinct(terms).alias("t")))
    return (
        unpacked(df.select(*by, F.inline_outer(both)), *by, "in_doc", F.explode_outer("t").alias("term"))
        .groupBy(*by, "term")
        .agg(F.sum("in_doc").alias("df"), F.sum(1 - F.col("in_doc")).alias("cnt"))
    )


def term_counts(
    df: DataFrame, by: Sequence[str] = (), text: str = "text", lo: int = 1, hi: int = 2, char: bool = False,
    stop: Sequence[str] | None = (),
) -> DataFrame:
    """(by..., term, cnt): occurrences of the terms that :func:`add_terms` gives.

    Each word n-gram is unpacked once, and character n-grams are those of the distinct words.
    """
    rows = unpacked(add_terms(df, text, lo, hi, False, stop), *by, F.lit(1).cast("bigint").alias("n"), F.explode_outer("terms").alias("term"))
    if char:
        # A word's inner part may be a word as well.
        rows = rows.unionByName(_char_rows(df, text, 3, 5, by))
    return rows.groupBy(*by, "term").agg(F.sum("n").alias("cnt"))


def select_vocab(
    stats: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.8,
    max_features: int | None = 50_000,
) -> DataFrame:
    """(term, df, cnt, idf) of the terms kept, from one row of counts per term.

    Terms in fewer than ``min_df`` documents or in more than the share
    ``max_df`` of them go; of the rest the most frequent stay, ties by term.
    """
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    kept = stats.filter(
        (F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)).withColumn("idf", idf)
    if max_features is None:
        return kept
    return kept.orderBy(F.col("cnt").desc(), "term").limit(max_features)


def vocab(
    df: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.8,
    max_features: int | None = 50_000, terms: str = "terms",
) -> DataFrame:
    """The vocabulary of a frame with a term array."""
    return select_vocab(term_stats(df, (), terms), n_docs, min_df, max_df, max_features)


def pin(vocabulary: DataFrame) -> DataFrame:
    """Fetch a vocabulary bounded by max_features once and reuse it as literal rows."""
    return vocabulary.sparkSession.createDataFrame(vocabulary.toPandas(), vocabulary.schema)


def tfidf(
    df: DataFrame, vocabulary: DataFrame, doc: str = "doc_id", terms: str = "terms",
    max_features: int | None = 50_000,
) -> DataFrame:
    """Long TF-IDF (doc, term, tf, weight): ``tf * idf``, rows of unit length.

    ``max_features`` states the bound :func:`vocab` was made with. Up to
    ``MODEL_TERMS`` terms each row is vectorised where it lies and unpacked
    again, without a shuffle of the table; a larger or unbounded vocabulary
    stays distributed and is joined (:func:`term_weights`).
    """
    if max_features is None or max_features > MODEL_TERMS:
        return _tfidf_joined(doc_terms(df, doc, terms), vocabulary, doc)
    rows = vocabulary.select("term", "idf").orderBy("term").collect()
    if not rows:
        return _tfidf_joined(doc_terms(df, doc, terms), vocabulary, doc)
    names = [r["term"] for r in rows]
    vectors = vectorizer(names, [r["idf"] for r in rows], terms).transform(df.select(doc, terms))
    index = df.sparkSession.createDataFrame(
        list(enumerate(names)), "idx int, term string")
    tf, unit = F.unwrap_udt(F.col("tf_vector")), F.unwrap_udt(F.col("features"))
    entries = (
        vectors.select(doc, tf.alias("t"), unit.alias("u"))
        .select(doc, F.inline(F.arrays_zip(
            F.col("t.indices").alias("idx"), F.col("t.values").alias("tf"),
            F.col("u.values").alias("weight"))))
    )
    return entries.join(F.broadcast(index), "idx").select(
        doc, "term", F.col("tf").cast("int").alias("tf"), "weight")


HEAVY_TERMS = 100_000
# Groups of documents that the rows of heavy terms are dealt by.
SPREAD_KEYS = 1 << 16
# Of (doc, term) per task that joins them or groups them by document.
TASK_ROWS = 2_000_000


def _row_parts(vocabulary: DataFrame) -> int | None:
    """Tasks for the rows of a vocabulary's terms, so many that a task's share does not grow with the table.

    The document counts add up to the number of rows; None where they are not known.
    """
    if "df" not in vocabulary.columns:
        return None
    rows = vocabulary.agg(F.sum("df")).first()[0] or 0
    return max(vocabulary.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _stored(vocabulary: DataFrame) -> DataFrame:
    return materialize(vocabulary.select("term", "idf", *[c for c in ("df",) if c in vocabulary.columns]), "vocabulary")


def _dealt(rows: DataFrame, parts: int | None, key: str) -> DataFrame:
    return rows if parts is None else rows.repartition(parts, key)


def term_weights(counts: DataFrame, vocabulary: DataFrame, doc: str, heavy_terms: int = HEAVY_TERMS) -> DataFrame:
    """(doc, term, tf, raw): ``tf * idf`` of the vocabulary's terms, for a vocabulary of any size.

    The terms of the most documents (least idf), ``heavy_terms`` of them whatever the table's
    size, are known to every task; their rows are dealt by document. All others
    are dealt by term, and none of them is in more documents than the heavy ones; a bit
    array keeps most rows of other terms from being dealt.
    """
    stored = _stored(vocabulary)
    return _term_weights(counts, stored, doc, heavy_terms, _row_parts(stored))


# Of the bit array that tells which terms may be in a vocabulary, and numbers of 64 bits in a row of it.
FILTER_BITS = 1 << 28
BIT_WORDS = 64


def _term_bits(stored: DataFrame) -> tuple[DataFrame, int]:
    """(row, words): a bit array of bounded size with the bit of every term set, and its size.

    Eight bits a term where there is room. Terms that share a bit only let rows through that the join drops.
    """
    row = 64 * BIT_WORDS
    size = min(FILTER_BITS, row * max(1, -(-8 * stored.count() // row)))
    bit = stored.select(F.pmod(F.xxhash64("term"), F.lit(size)).alias("bit")).selectExpr(
        f"bit div {row} AS row", f"cast(bit % {row} div 64 AS int) AS word", "shiftleft(1L, cast(bit % 64 AS int)) AS bits")
    words = bit.groupBy("row", "word").agg(F.bit_or("bits").alias("bits")).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    numbers = F.sequence(F.lit(0), F.lit(BIT_WORDS - 1))
    return words.select("row", F.transform(numbers, lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0).cast("bigint"))).alias("words")), size


def _term_weights(counts: DataFrame, stored: DataFrame, doc: str, heavy_terms: int, parts: int | None) -> DataFrame:
    heavy = stored.orderBy("idf", "term").limit(heavy_terms).select("term", F.col("idf").alias("heavy_idf"))
    light = _dealt(stored.select(F.col("term").alias("light_term"), "idf"), parts, "light_term")
    # The share of a bounded part is hashed, so rows are not sorted by term.
    light = light if parts is None else light.hint("shuffle_hash")
    told = counts.join(F.broadcast(heavy), "term", "left")
    # Most rows of terms that were not kept are dropped where they lie.
    bits, size = _term_bits(stored)
    at = F.pmod(F.xxhash64("term"), F.lit(size))
    of = F.when(F.col("heavy_idf").isNull(), F.floor(at / (64 * BIT_WORDS)))
    told = told.withColumns({"at_bit": at, "of_row": of}).join(
        F.broadcast(bits.withColumnRenamed("row", "of_row")), "of_row", "left")
    word = F.get("words", ((F.col("at_bit") % (64 * BIT_WORDS)) / 64).cast("int"))
    told = told.filter(F.col("heavy_idf").isNotNull() | (F.bit_get(word, (F.col("at_bit") % 64).cast("int")) == 1)).drop(
        "of_row", "at_bit", "words")
    # Terms hold no line breaks, so the keys of heavy rows meet no term.
    spread = F.concat(F.lit("\n"), F.hex(F.pmod(F.xxhash64(doc), F.lit(SPREAD_KEYS))))
    keyed = told.withColumn("at", F.when(F.col("heavy_idf").isNull(), F.col("term")).otherwise(spread))
    found = _dealt(keyed, parts, "at").join(light, F.col("at") == F.col("light_term"), "left")
    idf = F.coalesce("heavy_idf", "idf")
    return found.filter(idf.isNotNull()).select(doc, "term", "tf", (F.col("tf") * idf).alias("raw"))


def _tfidf_joined(counts: DataFrame, vocabulary: DataFrame, doc: str) -> DataFrame:
    stored = _stored(vocabulary)
    parts = _row_parts(stored)
    raw = _dealt(_term_weights(counts, stored, doc, HEAVY_TERMS, parts), parts, doc)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.withColumn("weight", F.col("raw") / norm).select(doc, "term", "tf", "weight")


def vectorizer(terms: Sequence[str], idf: Sequence[float], input_col: str = "terms",
               output_col: str = "features") -> PipelineModel:
    """The same TF-IDF as a fitted pipeline: counts, times idf, unit length.

    One narrow JVM pass per row; the vocabulary is bounded by max_features.
    """
    count = CountVectorizerModel.from_vocabulary(
        list(terms), inputCol=input_col, outputCol="tf_vector")
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(list(idf)), inputCol="tf_vector", outputCol="tfidf_vector")
    unit = Normalizer(p=2.0, inputCol="tfidf_vector", outputCol=output_col)
    return PipelineModel(stages=[count, scale, unit])


def sparse(rows: DataFrame, terms: Sequence[str], idf: Sequence[float], doc: str = "doc_id",
           input_col: str = "terms") -> DataFrame:
    """(doc, at, value): TF-IDF rows as two arrays, the numbers of the terms ascending."""
    v = F.unwrap_udt(F.col("features"))
    return vectorizer(terms, idf, input_col).transform(rows.select(doc, input_col)).select(
        doc, v["indices"].alias("at"), v["values"].alias("value"))


def term_of(number: Column, terms: Sequence[str]) -> Column:
    """The term of a number, from a literal of the plan; null for null. Terms hold no line breaks."""
    if len(terms) > MODEL_TERMS:
        raise ValueError(f"at most {MODEL_TERMS} terms")
    return F.get(F.split(F.lit("\n".join(terms)), "\n"), number)


def dot(vector: Column, weights: Sequence[float]) -> Column:
    """Product of a sparse vector column with one weight per term, row by row."""
    v = F.unwrap_udt(vector)
    return sparse_dot(v["indices"], v["values"], weights)


def sparse_dot(indices: Column, values: Column, weights: Sequence[float]) -> Column:
    """The same for a vector kept as two arrays.

    The weights travel as a literal of the plan, so their number is bounded like a model's vocabulary.
    """
    if len(weights) > MODEL_TERMS:
        raise ValueError(f"at most {MODEL_TERMS} weights")
    table = F.split(F.lit("\n".join(map(repr, map(float, weights)))), "\n").cast("array<double>")
    products = F.zip_with(indices, values, lambda i, x: x * F.get(table, i))
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def join_terms(rows: DataFrame, per_term: DataFrame, like: DataFrame | None = None,
               how: str = "inner") -> DataFrame:
    """Join a long table with one row per term.

    A vocabulary of at most ``MODEL_TERMS`` terms, counted on ``like`` or on
    the table itself, is broadcast, so that a word found in most documents does
    not pull a third of the rows into one task. A larger one is joined by hash.
    """
    size = (per_term if like is None else like).select("term").limit(MODEL_TERMS + 1).count()
    return rows.join(F.broadcast(per_term) if size <= MODEL_TERMS else per_term, "term", how)


def feature_stats(weights: DataFrame, n_docs: int) -> DataFrame:
    """Documents, vocabulary size, non-zero entries and sparsity."""
    per_term = weights.groupBy("term").count()
    one = per_term.agg(F.count(F.lit(1)).alias("n_terms"),
                       F.coalesce(F.sum("count"), F.lit(0)).alias("nnz"))
    cells = F.lit(n_docs).cast("double") * F.col("n_terms")
    return one.select(
        F.lit(n_docs).cast("bigint").alias("n_docs"), "n_terms", "nnz",
        (1 - F.try_divide(F.col("nnz"), cells)).alias("sparsity"))
