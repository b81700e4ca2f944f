"""Word attributions, computed for whole tables of documents."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import sigmoid
from .features import join_terms
from .split import sample_n

# Tasks get this module's helpers with their function, so executors need not
# have the package installed.
register_pickle_by_value(sys.modules[__name__])


def background_mean(weights: DataFrame, n_docs: int) -> DataFrame:
    """Mean TF-IDF weight of each term over the background documents."""
    return weights.groupBy("term").agg((F.sum("weight") / n_docs).alias("mean_weight"))


def linear_shap(
    weights: DataFrame, coefs: DataFrame, background: DataFrame, doc: str = "doc_id"
) -> DataFrame:
    """(doc, term, phi) in log-odds: ``coef * (x - mean)``, the exact Shapley
    value of a linear model with independent features (Lundberg & Lee 2017).

    Rows for the terms each document contains. The two per-term tables are
    joined first, so the long table meets one of the vocabulary's size.
    """
    per_term = coefs.join(background, "term", "left").select(
        "term", "coef", F.coalesce("mean_weight", F.lit(0.0)).alias("mean_weight"))
    return join_terms(weights, per_term, coefs).select(
        doc, "term", (F.col("coef") * (F.col("weight") - F.col("mean_weight"))).alias("phi"))


def base_value(coefs: DataFrame, background: DataFrame, intercept: float) -> DataFrame:
    """Log-odds of the average document: the attributions start from here."""
    return coefs.join(background, "term").agg(
        (F.coalesce(F.sum(F.col("coef") * F.col("mean_weight")), F.lit(0.0))
         + F.lit(intercept)).alias("base_value"))


def top_attributions(attr: DataFrame, k: int = 10, doc: str = "doc_id", token: str = "term",
                     weight: str = "phi") -> DataFrame:
    """Each document's k strongest words, with rank and direction."""
    strongest = Window.partitionBy(doc).orderBy(F.abs(weight).desc(), token)
    return (
        attr.withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= k)
        .select(doc, "rank", F.col(token).alias("token"), F.col(weight).alias("weight"),
                F.when(F.col(weight) > 0, "Hate").otherwise("Non-Hate").alias("direction"))
    )


def lime_drop_one(
    counts: DataFrame, coefs: DataFrame, intercept: float, doc: str = "doc_id"
) -> DataFrame:
    """(doc, term, weight): how far the score falls when one word is left out.

    ``counts`` is (doc, term, tf), ``coefs`` is (term, idf, coef). Leaving a
    word out also changes the row's length, so two sums per document give
    every masked score in closed form.
    """
    per_doc = Window.partitionBy(doc)
    a, ac = F.col("tf") * F.col("idf"), F.col("tf") * F.col("idf") * F.col("coef")
    d = join_terms(counts, coefs).withColumns({"a2": a * a, "ac": ac})
    d = d.withColumns({"s": F.sum("ac").over(per_doc), "q": F.sum("a2").over(per_doc),
                       "m": F.count(F.lit(1)).over(per_doc)})

    def prob(s, q):
        return sigmoid(F.lit(intercept) + s / F.sqrt(q))

    # Without its only word a document scores the intercept alone.
    without = F.when(F.col("m") == 1, sigmoid(F.lit(intercept))).otherwise(
        prob(F.col("s") - F.col("ac"), F.col("q") - F.col("a2")))
    return d.select(doc, "term", (prob(F.col("s"), F.col("q")) - without).alias("weight"))


def _ridge(z: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Weighted ridge coefficients with a free intercept, for a ``z`` of zeros and ones.

    Solves in the smaller of the two dimensions, so a long document costs no
    more than its number of samples squared. There the products of rows are
    whole numbers, exact in single precision, and centred afterwards.
    """
    n, d = z.shape
    u, r = w / w.sum(), np.sqrt(w)
    mean = u @ z
    yc = (y - u @ y) * r
    if d <= n:
        zc = (z - mean) * r[:, None]
        return np.linalg.solve(zc.T @ zc + alpha * np.eye(d), zc.T @ yc)
    short = z.astype(np.float32)
    common = (short @ short.T).astype(np.float64)
    part = common @ u
    common = (common - part[:, None] - part + u @ part) * r[:, None] * r
    common[np.diag_indices(n)] += alpha
    v = np.linalg.solve(common, yc) * r
    return v @ z - v.sum() * mean


def _generator(doc_key, seed: int) -> np.random.Generator:
    """Random numbers of a document, the same wherever it is explained."""
    key = int.from_bytes(hashlib.blake2b(str(doc_key).encode(), digest_size=8).digest(), "little")
    return np.random.default_rng([seed, key])


def _masks(doc_key: str, seed: int, n_samples: int, d: int) -> np.ndarray:
    """Keep-masks: all words first, then a uniform number of dropped words each."""
    rng = _generator(doc_key, seed)
    drops = rng.integers(1, d + 1, n_samples - 1)
    z = np.ones((n_samples, d), dtype=np.float64)
    draws = rng.random((n_samples - 1, d))
    # The words of the smallest draws go: values are sorted, which is faster than ranking them twice.
    last = np.take_along_axis(np.sort(draws, axis=1), drops[:, None] - 1, axis=1)
    np.greater(draws, last, out=z[1:])
    return z


def _local_weights(z: np.ndarray, prob: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of the k most influential words.

    Constants of Ribeiro et al. 2016: cosine distance times 100, kernel width
    25, ridge 0.01 to choose the words and 1 to weigh them.
    """
    d = z.shape[1]
    cosine = np.sqrt(z.sum(axis=1) / d)
    kernel = np.sqrt(np.exp(-((100 * (1 - cosine)) ** 2) / 25.0**2))
    rough = _ridge(z, prob, kernel, 0.01)
    chosen = np.argsort(-np.abs(rough), kind="stable")[:k]
    return chosen, _ridge(z[:, chosen], prob, kernel, 1.0)


def _frame(doc: str, parts: list[tuple]) -> pd.DataFrame:
    """Rows (doc, term, weight) of the (key, terms, weights) of several documents."""
    keys = [key for key, terms, _ in parts for _ in terms]
    terms = [t for _, terms, _ in parts for t in terms]
    weights = np.concatenate([w for *_, w in parts]) if parts else np.zeros(0)
    return pd.DataFrame({doc: pd.Series(keys, dtype=object),
                         "term": pd.Series(terms, dtype=object), "weight": weights})


def lime_linear(
    counts: DataFrame, coefs: DataFrame, intercept: float, n_samples: int = 300, k: int = 10,
    seed: int = 42, doc: str = "doc_id",
) -> DataFrame:
    """(doc, term, weight): local perturbation attribution of a linear TF-IDF model.

    A document's words are gathered into one row, as they were in its text;
    sampling and the small solve happen per row inside Arrow batches.
    """
    packed = join_terms(counts, coefs).groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct(
            "term", (F.col("tf") * F.col("idf")).alias("a"), "coef"))).alias("words"))
    kind = packed.schema[doc].dataType.simpleString()
    rows = packed.select(
        doc, F.col("words.term").alias("term"), F.col("words.a").alias("a"),
        F.col("words.coef").alias("coef"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, terms, a, c in zip(pdf[doc], pdf["term"], pdf["a"], pdf["coef"]):
                a, c = np.asarray(a, float), np.asarray(c, float)
                z = _masks(key, seed, n_samples, len(a))
                length = np.sqrt(z @ (a * a))
                logit = intercept + np.divide(
                    z @ (a * c), length, out=np.zeros(n_samples), where=length > 0)
                at, w = _local_weights(z, 1 / (1 + np.exp(-logit)), k)
                out.append((key, np.asarray(terms, dtype=object)[at], w))
            yield _frame(doc, out)

    return rows.mapInPandas(explain, f"{doc} {kind}, term string, weight double")


def lime_texts(
    df: DataFrame, make_predict_fn: Callable, words: str = "words", n_samples: int = 300,
    k: int = 10, seed: int = 42, doc: str = "doc_id", batch_size: int = 64,
) -> DataFrame:
    """The same for any scorer of texts: ``make_predict_fn()`` is built once per
    task and maps a list of texts to probabilities. ``words`` is a token array;
    leaving a word out removes all its occurrences. A narrow pass, no shuffle."""
    kind = df.schema[doc].dataType.simpleString()

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict_fn()
        for pdf in batches:
            out = []
            for key, seq in zip(pdf[doc], pdf[words]):
                if len(seq) == 0:
                    continue
                terms, at = np.unique(np.asarray(seq, dtype=object), return_inverse=True)
                z = _masks(key, seed, n_samples, len(terms))
                prob = []
                for i in range(0, n_samples, batch_size):
                    kept = z[i:i + batch_size][:, at] > 0
                    prob.extend(predict([
                        " ".join(w for w, keep in zip(seq, row) if keep) for row in kept]))
                chosen, w = _local_weights(z, np.asarray(prob, float), k)
                out.append((key, terms[chosen], w))
            yield _frame(doc, out)

    return df.select(doc, words).mapInPandas(
        explain, f"{doc} {kind}, term string, weight double")


def background_rows(vectors: DataFrame, n: int = 100, seed=42, doc: str = "doc_id") -> list[tuple[list[int], list[float]]]:
    """The background of :func:`shapley`: ``n`` rows of (doc, at, value), those with the smallest hash of the key."""
    return [(r["at"], r["value"]) for r in sample_n(vectors, n, seed, doc).select("at", "value").collect()]


STATE_ENTRIES = 1 << 20  # numbers handed to a scorer at once


def _walk(score, x_at, x, b_at, b, order: np.ndarray) -> np.ndarray:
    """Each player's gain when players turn from ``b`` to ``x`` in ``order``; the last player is all that x lacks."""
    d = len(x_at)
    rank = np.empty(d + 1, np.int64)
    rank[order] = np.arange(d + 1)
    at = np.concatenate([x_at, b_at])
    value = np.concatenate([x, b])
    # A feature of x counts from the step after its own on, one of b up to its player's step.
    player = np.concatenate([np.arange(d), np.where(np.isin(b_at, x_at), np.searchsorted(x_at, b_at), d)])
    since = np.concatenate([rank[:d] + 1, np.zeros(len(b_at), np.int64)])
    until = np.concatenate([np.full(d, d + 1), rank[player[d:]]])
    found = []
    step = max(1, STATE_ENTRIES // max(1, len(at)))
    for low in range(0, d + 2, step):
        states = np.arange(low, min(low + step, d + 2))
        row, col = np.nonzero((states[:, None] >= since) & (states[:, None] <= until))
        found.append(score(row, at[col], value[col], len(states)))
    gains = np.diff(np.concatenate(found))
    out = np.empty(d + 1)
    out[order] = gains
    return out


class AdditiveScore:
    """A scorer ``link(sum of part(feature, value))``, called as any other.

    Its form lets a walk keep the sum from state to state, so that one costs a
    step per player instead of a whole row.
    """

    def __init__(self, part: Callable, link: Callable = lambda z: z):
        self.part, self.link = part, link

    def __call__(self, row, at, value, n):
        return self.link(np.bincount(row, self.part(at, value), n))


def _additive_walks(score: AdditiveScore, x_at, x, rows_b, pairs: int, orders: np.ndarray) -> np.ndarray:
    """What :func:`_walk` gives for every order and its background row, the sums kept along the order."""
    n, d = len(rows_b), len(x_at)
    b_at = np.concatenate([at for at, _ in rows_b])
    b_row = np.repeat(np.arange(n), [len(at) for at, _ in rows_b])
    part = score.part(b_at, np.concatenate([v for _, v in rows_b]))
    player = np.searchsorted(x_at, b_at)
    player[~np.isin(b_at, x_at)] = d
    change = -np.bincount(b_row * (d + 1) + player, part, n * (d + 1)).reshape(n, d + 1)
    change[:, :d] += score.part(x_at, x)
    start = np.repeat(np.bincount(b_row, part, n), pairs)[:, None]
    z = np.concatenate([start, start + np.cumsum(np.take_along_axis(np.repeat(change, pairs, axis=0), orders, 1), 1)], 1)
    gains = np.diff(score.link(z), axis=1)
    out = np.empty_like(gains)
    np.put_along_axis(out, orders, gains, 1)
    return out


OUT_ROWS = 1 << 17  # of a frame handed back


def shapley(
    vectors: DataFrame, make_score_fn: Callable, background: list[tuple[list[int], list[float]]], pairs: int = 1,
    seed: int = 42, doc: str = "doc_id",
) -> DataFrame:
    """(doc, at, phi, error): Shapley values of any scorer of sparse rows, by sampled permutations.

    ``vectors`` is (doc, at, value) with ascending features; ``background``
    holds such rows, a bounded sample. ``make_score_fn()`` is built once per
    task and maps (row numbers, features, values, rows) to one score per row.
    Players are a row's own features and, as one player with a null ``at``, all
    others. Every background row is used ``pairs`` times, each time with a
    permutation and its reverse (Castro et al. 2009, antithetic), seeded by the
    document; so the values of a document add up to its score less the mean
    score of the background, whatever the permutations. ``error`` is the
    standard error over the pairs. A narrow pass in Arrow batches. A walk scores
    every state as a row of its own; those of an :class:`AdditiveScore` only
    change its sum.
    """
    kind = vectors.schema[doc].dataType.simpleString()
    rows_b = [(np.asarray(at, np.int64), np.asarray(v, float)) for at, v in background]
    if not rows_b:
        raise ValueError("an empty background")

    def samples_of(score, x_at, x, orders):
        if isinstance(score, AdditiveScore):
            return (_additive_walks(score, x_at, x, rows_b, pairs, orders)
                    + _additive_walks(score, x_at, x, rows_b, pairs, orders[:, ::-1])) / 2
        return np.array([
            (_walk(score, x_at, x, *rows_b[i // pairs], order) + _walk(score, x_at, x, *rows_b[i // pairs], order[::-1])) / 2
            for i, order in enumerate(orders)])

    def frame(parts):
        keys, ats, means, errors = zip(*parts)
        number = np.concatenate(ats)
        return pd.DataFrame({doc: np.repeat(np.array(keys, dtype=object), [len(m) for m in means]),
                             "at": pd.arrays.IntegerArray(number.astype(np.int32), number < 0),
                             "phi": np.concatenate(means), "error": np.concatenate(errors)})

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_score_fn()
        for pdf in batches:
            parts, size = [], 0
            for key, at, value in zip(pdf[doc], pdf["at"], pdf["value"]):
                x_at, x = np.asarray(at, np.int64), np.asarray(value, float)
                rng = _generator(key, seed)
                orders = np.array([rng.permutation(len(x_at) + 1) for _ in range(len(rows_b) * pairs)])
                samples = samples_of(score, x_at, x, orders)
                mean = np.mean(samples, axis=0)
                error = np.std(samples, axis=0, ddof=1) / np.sqrt(len(samples)) if len(samples) > 1 else np.full(len(mean), np.nan)
                parts.append((key, np.append(x_at, -1), mean, error))
                size += len(mean)
                if size >= OUT_ROWS:
                    yield frame(parts)
                    parts, size = [], 0
            if parts:
                yield frame(parts)

    return vectors.select(doc, "at", "value").mapInPandas(explain, f"{doc} {kind}, at int, phi double, error double")


def explainer_agreement(a: DataFrame, b: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document, Jaccard overlap of two top-k tables and the share of
    common words with the same sign (null without common words)."""
    left = a.select(doc, "token", F.col("weight").alias("wa"))
    right = b.select(doc, "token", F.col("weight").alias("wb"))
    both = F.col("wa").isNotNull() & F.col("wb").isNotNull()
    common = F.sum(both.cast("bigint"))
    same = F.sum((both & (F.signum("wa") == F.signum("wb"))).cast("bigint"))
    return left.join(right, [doc, "token"], "full").groupBy(doc).agg(
        (common / F.count(F.lit(1))).alias("jaccard"),
        F.try_divide(same, common).alias("sign_agreement"))
