"""The TF-IDF + logistic regression baseline, and scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..functions.text import clean_text, preview
from ..sources.workspace import materialize
from .features import MODEL_TERMS, add_terms, join_terms, select_vocab, sparse_dot, term_counts, term_stats, unpacked, vectorizer
from .split import assign_folds


def class_weights(df: DataFrame, label: str = "label", kind: str = "balanced") -> DataFrame:
    """(label, n, weight): ``balanced`` is n/(k*n_c); ``inverse`` is 1/n_c
    rescaled so that the weights sum to the number of classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy()  # one row per class
    k = F.count(F.lit(1)).over(classes)
    if kind == "balanced":
        weight = F.sum("n").over(classes) / (k * F.col("n"))
    elif kind == "inverse":
        weight = (1.0 / F.col("n")) / F.sum(1.0 / F.col("n")).over(classes) * k
    else:
        raise ValueError(f"unknown weighting {kind!r}")
    return counts.withColumn("weight", weight)


# Feature bytes per partition below which a training task is mostly overhead.
PARTITION_BYTES = 32 << 20


def model_input(df: DataFrame, text: str, clean: bool) -> DataFrame:
    """Add ``model_input``: the text as a model reads it, in training and in scoring alike."""
    return df.withColumn("model_input", clean_text(F.col(text)) if clean else F.col(text))


class BaselineModel:
    """A fitted pipeline with the settings that turn text into its terms."""

    def __init__(self, pipeline: PipelineModel, settings: dict):
        self.pipeline = pipeline
        self.settings = settings

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``prob``, the probability of HATE."""
        s = self.settings
        d = add_terms(model_input(df, text, s["clean"]), "model_input", s["lo"], s["hi"], s["char"], s["stop"])
        out = self.pipeline.transform(d)
        prob = F.element_at(vector_to_array("probability"), 2)
        return out.withColumn("prob", prob).select(*df.columns, "prob")

    @property
    def vocabulary(self) -> list[str]:
        return self.pipeline.stages[0].vocabulary

    @property
    def intercept(self) -> float:
        return float(self.pipeline.stages[-1].intercept)

    def weights(self, spark: SparkSession) -> DataFrame:
        """(term, idf, coef), as many rows as the vocabulary has terms."""
        idf = self.pipeline.stages[1].getScalingVec().toArray().tolist()
        coef = self.pipeline.stages[-1].coefficients.toArray().tolist()
        return spark.createDataFrame(
            list(zip(self.vocabulary, idf, coef)), "term string, idf double, coef double")


# Of text per task that cuts it into terms, which take some 20 times its size.
PART_BYTES = 16 << 20


class _Rows:
    """The rows of a fit, cleaned and stored once: (doc, y_true, y, keep..., model_input), their counts, and their terms.

    ``dealt`` has them by document in tasks whose share does not grow with the table.
    """

    def __init__(self, df: DataFrame, text: str, label: str, doc: str, lo: int, hi: int, char: bool,
                 stop: Sequence[str] | None, clean: bool, keep: Sequence[str] = ()):
        named = df.select(F.col(doc).alias("doc"), F.col(label).alias("y_true"), F.col(label).cast("int").alias("y"), *keep,
                          F.col(text).alias("text"))
        stored = materialize(model_input(named, "text", clean).drop("text"), "training-rows")
        found = stored.groupBy(*keep, "y").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("model_input")), F.lit(0)).alias("bytes")).collect()
        if {r["y"] for r in found} - {0, 1}:
            raise ValueError(f"labels must be 0 or 1, found {sorted(str(r['y']) for r in found)}")
        self.counts = {tuple(r[:-2]): r["n"] for r in found}  # by (keep..., y)
        parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(r["bytes"] for r in found) / PART_BYTES))
        self.dealt, self.keep, self.settings = stored.repartition(parts, "doc"), list(keep), (lo, hi, char, stop)

    def terms(self) -> DataFrame:
        return add_terms(self.dealt, "model_input", *self.settings).drop("model_input")

    def term_counts(self, min_df: int, max_df: float) -> DataFrame:
        """(keep..., term, cnt), with df as well where documents decide which terms are kept."""
        if min_df <= 1 and max_df >= 1:
            return term_counts(self.dealt, self.keep, "model_input", *self.settings)
        return term_stats(self.terms(), self.keep)

    def vectors(self, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(doc, y_true, y, keep..., tf_vector) stored, and (keep..., at, df): documents with each of the terms."""
        count = vectorizer(names, [1.0] * len(names)).stages[0]
        stored = materialize(count.transform(self.terms()).drop("terms"), "vectors", arrays=True)
        at = F.explode_outer(F.unwrap_udt(F.col("tf_vector"))["indices"])
        return stored, unpacked(stored, *self.keep, at.alias("at")).groupBy(*self.keep, "at").agg(F.count(F.lit(1)).alias("df"))


def _vocabulary(counted: DataFrame, n: int, min_df: int, max_df: float, max_features: int) -> list[str]:
    """The terms that :func:`select_vocab` keeps; without document counts every term may stay."""
    if "df" in counted.columns:
        kept = select_vocab(counted, n, min_df, max_df, max_features)
    else:
        kept = counted.orderBy(F.col("cnt").desc(), "term").limit(max_features)
    names = [r["term"] for r in kept.select("term").collect()]
    if not names:
        raise ValueError("empty vocabulary")
    return names


def _idf(documents: DataFrame, n: int, size: int) -> tuple[list[float], int]:
    """Weights by the terms' numbers, and the entries of all vectors, from (at, df)."""
    idf, entries = [1.0] * size, 0
    for r in documents.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).collect():
        idf[r["at"]], entries = r["idf"], entries + r["df"]
    return idf, entries


def _fit_vectors(vectors: DataFrame, names: Sequence[str], idf: Sequence[float], counts: dict, entries: int,
                 C: float, max_iter: int, tol: float) -> PipelineModel:
    """Fit on stored term counts; every pass but the first two reads the solver's own blocks."""
    n = sum(counts.values())
    feats = vectorizer(names, idf)
    w = F.when(F.col("y") == 1, n / (len(counts) * counts.get(1, 1))).otherwise(
        n / (len(counts) * counts.get(0, 1)))
    train = PipelineModel(stages=feats.stages[1:]).transform(vectors).select(
        "features", F.col("y").cast("double").alias("y"), w.alias("w"))
    # Every iteration runs one task per partition. The vocabulary tells the size
    # of the vectors (12 bytes per entry), so small sets get few partitions.
    parts = max(1, math.ceil(entries * 12 / PARTITION_BYTES))
    if parts < vectors.sparkSession.sparkContext.defaultParallelism:
        train = train.repartition(parts)
    lr = LogisticRegression(
        featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / (C * n),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    return PipelineModel(stages=[*feats.stages, lr.fit(train)])


def train_baseline(
    df: DataFrame, text: str = "text", label: str = "label", doc: str = "doc_id",
    lo: int = 1, hi: int = 2, char: bool = False, stop: Sequence[str] | None = (),
    min_df: int = 1, max_df: float = 1.0, max_features: int = 50_000, C: float = 1.0,
    max_iter: int = 200, tol: float = 1e-6, clean: bool = False,
) -> BaselineModel:
    """Fit TF-IDF and a balanced L2 logistic regression.

    The loss is ``|w|^2/2 + C * sum(weight * logloss)``; Spark divides the sum
    by the total weight, which balanced weights make equal to the row count,
    hence the regularisation ``1 / (C * rows)``. The driver sees class counts,
    the vocabulary (at most ``max_features``) and the coefficients. With
    ``clean`` the model cleans its texts; the setting is stored and holds for
    scoring too. Texts are cleaned once, and cut into terms twice: to count
    them and to store the vectors, from which documents per term are counted.
    """
    rows = _Rows(df, text, label, doc, lo, hi, char, stop, clean)
    counts = {y: n for (y,), n in rows.counts.items()}
    n = sum(counts.values())
    names = _vocabulary(rows.term_counts(min_df, max_df), n, min_df, max_df, max_features)
    vectors, documents = rows.vectors(names)
    idf, entries = _idf(documents, n, len(names))
    fitted = _fit_vectors(vectors, names, idf, counts, entries, C, max_iter, tol)
    settings = {"lo": lo, "hi": hi, "char": char, "clean": clean,
                "stop": None if stop is None else list(stop)}
    return BaselineModel(fitted, settings)


def certificate(model: BaselineModel, df: DataFrame, text: str = "text", label: str = "label", C: float = 1.0) -> DataFrame:
    """(term, residual): the gradient of the penalised loss at the fitted weights; null is the intercept.

    All residuals of ``|w|^2 / (2 C n) + mean(weight * logloss)`` are 0 at its one
    optimum, so they certify a fit without a second solver. They are added up
    from the rows' features, with the model's weights as plain numbers, in one
    pass and one grouping of at most as many rows as there are terms.
    """
    s = model.settings
    y = F.col(label).cast("int")
    rows = add_terms(model_input(df.select(F.col(text).alias("text"), y.alias("y")), "text", s["clean"]), "model_input",
                     s["lo"], s["hi"], s["char"], s["stop"])
    counts = {r["y"]: r["count"] for r in df.groupBy(y.alias("y")).count().collect()}
    n = sum(counts.values())
    coef = model.pipeline.stages[-1].coefficients.toArray().tolist()
    v = F.unwrap_udt(F.col("features"))
    vectors = PipelineModel(stages=model.pipeline.stages[:-1]).transform(rows).select("y", v["indices"].alias("at"), v["values"].alias("x"))
    z = sparse_dot(F.col("at"), F.col("x"), coef) + F.lit(model.intercept)
    weight = F.when(F.col("y") == 1, n / (len(counts) * counts.get(1, 1))).otherwise(n / (len(counts) * counts.get(0, 1)))
    slopes = vectors.select("at", "x", (weight * (scores.sigmoid(z) - F.col("y")) / n).alias("d"))
    # The intercept is one more feature, with the value 1 in every row.
    entries = slopes.select(F.inline(F.arrays_zip(
        F.concat("at", F.array(F.lit(len(coef)))).alias("at"),
        F.concat(F.transform("x", lambda x: x * F.col("d")), F.array("d")).alias("g"))))
    sums = entries.groupBy("at").agg(F.sum("g").alias("g"))
    spark = df.sparkSession
    terms = spark.createDataFrame([*((i, t, c) for i, (t, c) in enumerate(zip(model.vocabulary, coef))), (len(coef), None, 0.0)],
                                  "at int, term string, coef double")
    return terms.join(sums, "at", "left").select(
        "term", (F.coalesce("g", F.lit(0.0)) + F.col("coef") / (C * n)).alias("residual"))


SETTINGS = "lo int, hi int, char boolean, clean boolean, stop array<string>"


def save_model(model: BaselineModel, path: str) -> None:
    """Store the pipeline, its settings, and the weights as a table."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    s = model.settings
    one = spark.createDataFrame([(s["lo"], s["hi"], s["char"], s["clean"], s["stop"])], SETTINGS)
    one.write.mode("overwrite").json(f"{path}/settings")
    model.weights(spark).write.mode("overwrite").parquet(f"{path}/weights")


def load_model(spark: SparkSession, path: str) -> BaselineModel:
    row = spark.read.schema(SETTINGS).json(f"{path}/settings").first()
    return BaselineModel(PipelineModel.load(f"{path}/pipeline"), row.asDict())


def cross_validate(
    df: DataFrame, k: int = 5, seed=42, doc: str = "doc_id", text: str = "text",
    label: str = "label", lo: int = 1, hi: int = 2, char: bool = False,
    stop: Sequence[str] | None = (), clean: bool = False, min_df: int = 1, max_df: float = 1.0,
    max_features: int = 50_000, C: float = 1.0, max_iter: int = 200, tol: float = 1e-6,
) -> DataFrame:
    """Out-of-fold predictions (doc, fold, y_true, prob, y_pred), one fit per fold.

    Terms are counted per fold in one pass and stored; the vocabulary of a fit is
    that of the other folds. All rows are vectorised once, over the terms of all
    fits (at most ``MODEL_TERMS``); a fit's weights of terms that are not its own are 0.
    """
    rows = _Rows(assign_folds(df, k, seed, doc, label), text, label, doc, lo, hi, char, stop, clean, ["fold"])
    stats = materialize(rows.term_counts(min_df, max_df), "fold-terms")
    known, sizes = [], []
    for i in range(k):
        counts = {y: sum(c for (f, z), c in rows.counts.items() if f != i and z == y) for y in (0, 1)}
        sizes.append({y: c for y, c in counts.items() if c})
        others = stats.filter(F.col("fold") != i).groupBy("term").agg(*[F.sum(c).alias(c) for c in stats.columns[2:]])
        known.append(set(_vocabulary(others, sum(counts.values()), min_df, max_df, max_features)))
    names = sorted(set().union(*known))
    if len(names) > MODEL_TERMS:
        raise ValueError(f"more than {MODEL_TERMS} terms in all folds together")
    vectors, documents = rows.vectors(names)
    documents = materialize(documents, "fold-documents")
    parts = []
    for i in range(k):
        others = F.col("fold") != i
        found = documents.filter(others).groupBy("at").agg(F.sum("df").alias("df"))
        idf, entries = _idf(found, sum(sizes[i].values()), len(names))
        idf = [x if t in known[i] else 0.0 for t, x in zip(names, idf)]
        fitted = _fit_vectors(vectors.filter(others), names, idf, sizes[i], entries, C, max_iter, tol)
        scored = PipelineModel(stages=fitted.stages[1:]).transform(vectors.filter(~others))
        parts.append(scored.select(F.col("doc").alias(doc), "fold", "y_true",
                                   F.element_at(vector_to_array("probability"), 2).alias("prob")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("y_pred", scores.decide(F.col("prob")))


def linear_scores(
    weights: DataFrame, coefs: DataFrame, intercept: float, doc: str = "doc_id"
) -> DataFrame:
    """(doc, logit, prob) from a long TF-IDF table and a (term, coef) table.

    Sums are pre-aggregated before the shuffle.
    """
    logit = F.coalesce(F.sum(F.col("weight") * F.col("coef")), F.lit(0.0)) + F.lit(intercept)
    return (
        join_terms(weights, coefs, how="left").groupBy(doc).agg(logit.alias("logit"))
        .withColumn("prob", scores.sigmoid(F.col("logit")))
    )


def present(df: DataFrame, text: str = "text", prob: str = "prob") -> DataFrame:
    """Add prediction, severity and preview to scored rows."""
    return df.withColumns({
        "prediction": scores.argmax_label(F.col(prob)),
        "severity": scores.severity(F.col(prob)),
        "preview": preview(F.col(text)),
    })


def score_batch(model: BaselineModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Score and present a table of posts; the model cleans them as in training, previews show the raw text."""
    return present(model.transform(df, text), text)


def score_with(
    df: DataFrame, make_predict_fn: Callable, text: str = "text", batch_size: int = 16
) -> DataFrame:
    """Add ``prob`` from an external model.

    ``make_predict_fn()`` runs once per Python worker and returns a function
    from a batch of texts to an array of probabilities.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size)
    return df.withColumn("prob", predict(F.col(text)))


def batch_summary(scored: DataFrame) -> DataFrame:
    hate = (F.col("prediction") == scores.HATE).cast("bigint")
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(hate), F.lit(0)).alias("hate"),
        (F.avg(hate) * 100).alias("hate_pct"), F.avg("severity").alias("avg_severity"))


def moderation_queue(scored: DataFrame) -> DataFrame:
    """Posts and mean severity per moderation route."""
    return scored.groupBy(scores.route(F.col("severity")).alias("route")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("severity").alias("avg_severity"))
