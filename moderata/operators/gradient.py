"""Training a linear scorer by gradient steps, for losses that the baseline's solver does not have.

One step is one pass over a stored feature table. Every task adds up its rows'
gradient per slot as whole numbers (a contribution is rounded to 1 / SCALE), and
Spark adds up the tasks' sums as decimals. Whole sums do not depend on order, so
the fitted weights are the same for any number of partitions, any cluster, and
after lost tasks. The driver holds one number per slot, at most ``MODEL_TERMS``
of them, and takes the step (Adam with decoupled weight decay, Loshchilov &
Hutter 2019). A pass also counts the validation rows' confusion at the weights
it started from; training stops when their macro-F1 has not risen for
``patience`` passes, and the best weights are restored.

The state after every step is a table in the shared folder; a run that is given
the folder of an earlier one goes on after its last complete step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.workspace import materialize, new_folder
from .features import MODEL_TERMS, add_terms, dot, select_vocab, sparse_dot, term_stats, vectorizer
from .model import model_input

SCALE, LOSS_SCALE = float(1 << 44), float(1 << 24)
ROWS = 1 << 16  # added up in 64 bits at once; carried into two numbers after that
ENTRIES = 1 << 18  # of the features, held as plain numbers at once
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8
STATE = "epoch int, slot int, w double, m double, v double, total int"
LOSSES = ("focal", "weighted")


@dataclass
class LinearModel:
    """Weights per term, with the settings that turn text into terms and the threshold that was tuned."""

    terms: list[str]
    idf: list[float]
    coef: list[float]
    intercept: float
    settings: dict
    threshold: float = 0.5
    history: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add ``prob``, the probability of HATE, and ``y_pred``, the decision at the model's threshold."""
        s = self.settings
        kept = [c for c in df.columns if c.lower() not in ("prob", "y_pred")]
        # The caller's columns travel in one, so that no helper column can clash with them.
        packed = df.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))
        d = add_terms(model_input(packed, "text", s["clean"]), "model_input", s["lo"], s["hi"], s["char"], s["stop"])
        z = dot(F.col("features"), self.coef) + F.lit(self.intercept)
        out = vectorizer(self.terms, self.idf).transform(d).select("row.*", scores.sigmoid(z).alias("prob"))
        return out.withColumn("y_pred", scores.decide(F.col("prob"), self.threshold))

    def weights(self, spark: SparkSession) -> DataFrame:
        """(term, idf, coef); the intercept has the null term."""
        rows = [*zip(self.terms, self.idf, self.coef), (None, 0.0, self.intercept)]
        return spark.createDataFrame(rows, "term string, idf double, coef double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The weights as Parquet, settings and threshold as JSON."""
        self.weights(spark).write.mode("overwrite").parquet(f"{path}/weights")
        s = self.settings
        one = spark.createDataFrame([(s["lo"], s["hi"], s["char"], s["clean"], s["stop"], self.threshold)], SETTINGS)
        one.write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        s = spark.read.schema(SETTINGS).json(f"{path}/settings").first().asDict()
        rows = spark.read.parquet(f"{path}/weights").collect()
        known = sorted((r for r in rows if r["term"] is not None), key=lambda r: r["term"])
        return LinearModel([r["term"] for r in known], [r["idf"] for r in known], [r["coef"] for r in known],
                           next(r["coef"] for r in rows if r["term"] is None), s, s.pop("threshold"))


SETTINGS = "lo int, hi int, char boolean, clean boolean, stop array<string>, threshold double"


@dataclass
class Features:
    """A stored table (doc, part, y, at, value), one row a document, and the vocabulary of its train rows."""

    table: DataFrame
    terms: list[str]
    idf: list[float]
    settings: dict


def feature_table(
    df: DataFrame, text: str = "text", label: str = "label", doc: str = "doc_id", part: str = "split", lo: int = 1, hi: int = 2,
    char: bool = False, stop: Sequence[str] | None = (), min_df: int = 1, max_df: float = 1.0, max_features: int = 50_000,
    clean: bool = False,
) -> Features:
    """Vectorise train, validation and test rows once; terms and weights are those of the train rows.

    Texts are cleaned and cut into terms once: the term arrays are stored, counted, and vectorised from there.
    """
    if max_features > MODEL_TERMS:
        raise ValueError(f"at most {MODEL_TERMS} terms")
    named = model_input(df, text, clean).select(
        F.col(doc).alias("doc"), F.col(part).alias("part"), F.col(label).cast("int").alias("y"), F.col("model_input").alias("text"))
    rows = materialize(add_terms(named, "text", lo, hi, char, stop).drop("text"), "terms", arrays=True)
    train = rows.filter("part = 'train'")
    words = sorted(select_vocab(term_stats(train), train.count(), min_df, max_df, max_features).collect(), key=lambda r: r["term"])
    if not words:
        raise ValueError("empty vocabulary")
    terms, idf = [w["term"] for w in words], [w["idf"] for w in words]
    v = F.unwrap_udt(F.col("features"))
    table = vectorizer(terms, idf).transform(rows).select(
        "doc", "part", "y", v["indices"].alias("at"), v["values"].alias("value"))
    settings = {"lo": lo, "hi": hi, "char": char, "clean": clean, "stop": None if stop is None else list(stop)}
    return Features(materialize(table, "features", arrays=True), terms, idf, settings)


def slope(z: np.ndarray, y: np.ndarray, loss: str, weights: tuple[float, float], gamma: float, alpha: float):
    """(loss, derivative by the logit) of every row. Label 1 has the focal weight ``1 - alpha``."""
    s = np.where(y == 1, 1.0, -1.0)
    ce = np.logaddexp(0.0, -s * z)
    pt = np.exp(-ce)
    if loss == "weighted":
        w = np.where(y == 1, weights[1], weights[0])
        return w * ce, -w * s * (1 - pt)
    at = np.where(y == 1, 1 - alpha, alpha)
    hard = (1 - pt) ** gamma
    return at * hard * ce, -at * s * hard * (gamma * pt * ce + (1 - pt))


def factor(step: int, steps: int, schedule: str) -> float:
    """Share of the learning rate at a step (from 1): a rise over the first 6 %, then down in a line or a cosine."""
    warm = max(1, int(0.06 * steps))
    if step <= warm:
        return step / warm
    done = (step - warm) / max(1, steps + 1 - warm)
    return 1 - done if schedule == "linear" else (1 + math.cos(math.pi * done)) / 2


def _pieces(batches: Iterator[pa.RecordBatch], lists: int, entries: int = ENTRIES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces of at most ``ROWS`` rows and ``entries`` items of the list column, one row at least.

    Rows of long texts hold thousands of items, and a pass makes a dozen arrays
    of them. Sums are whole numbers, so they do not depend on the pieces.
    """
    for batch in batches:
        ends = np.cumsum(batch.column(lists).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            room = (ends[a - 1] if a else 0) + entries
            b = min(max(a + 1, int(np.searchsorted(ends, room, "right"))), a + ROWS)
            yield batch.slice(a, b - a)
            a = b


LOSS, COUNTS = -1, ("tn", "fp", "fn", "tp")  # slots -2 to -5 count validation rows


def one_pass(table: DataFrame, w: np.ndarray, loss: str, weights: tuple[float, float], gamma: float, alpha: float) -> dict:
    """Whole sums per slot of a pass at weights ``w`` (the last is the intercept)."""
    size = len(w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, marks = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(5, np.int64)
        for batch in _pieces(batches, 2):
            part, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            at = lists.flatten().to_numpy(zero_copy_only=False)
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False))
            z = np.bincount(row, w[at] * x, len(y)) + w[-1]
            train, val = np.array([p == "train" for p in part]), np.array([p == "val" for p in part])
            each, d = slope(z, y, loss, weights, gamma, alpha)
            d = np.where(train, d, 0.0)
            sums = np.zeros(size, np.int64)
            np.add.at(sums, at, np.rint(d[row] * x * SCALE).astype(np.int64))
            sums[-1] += np.rint(d * SCALE).astype(np.int64).sum()
            high += sums >> 32
            low += sums & 0xFFFFFFFF
            marks[0] += np.rint(each[train] * LOSS_SCALE).astype(np.int64).sum()
            marks[1:] += np.bincount(2 * y[val] + (z[val] > 0), minlength=4)
        slots = np.flatnonzero((high != 0) | (low != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([slots, -1 - np.arange(5)]).astype(np.int32)),
             pa.array(np.concatenate([high[slots], np.zeros(5, np.int64)])), pa.array(np.concatenate([low[slots], marks]))],
            ["slot", "high", "low"])

    found = table.select("part", "y", "at", "value").filter("part <> 'test'").mapInArrow(add, "slot int, high long, low long")
    sums = found.groupBy("slot").agg(*[F.sum(F.col(c).cast("decimal(28, 0)")).alias(c) for c in ("high", "low")])
    return {r["slot"]: (int(r["high"]) << 32) + int(r["low"]) for r in sums.collect()}


def macro_f1(n: dict) -> float:
    tn, fp, fn, tp = (n.get(LOSS - 1 - i, 0) for i in range(4))
    one, zero = 2 * tp + fp + fn, 2 * tn + fp + fn
    return ((2 * tp / one if one else 0.0) + (2 * tn / zero if zero else 0.0)) / 2


def fit(
    features: Features, loss: str = "focal", gamma: float = 2.0, alpha: float = 0.25, epochs: int = 20, patience: int = 3,
    lr: float = 0.05, weight_decay: float = 0.01, schedule: str = "linear", clip: float = 1.0, state: str | None = None,
) -> LinearModel:
    """The weights of the best validation macro-F1 among those after 0 to ``epochs`` steps.

    ``weighted`` is cross-entropy with inverse class counts, rescaled to sum to
    the number of classes, averaged by weight; ``focal`` is averaged by row. A
    gradient longer than ``clip`` is shortened to it. Without validation rows
    the last weights are kept.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}")
    spark = features.table.sparkSession
    counts = {(r["part"], r["y"]): r["count"] for r in features.table.groupBy("part", "y").count().collect()}
    n0, n1 = counts.get(("train", 0), 0), counts.get(("train", 1), 0)
    if not n0 or not n1:
        raise ValueError("train rows of both labels are needed")
    validated = any(part == "val" for part, _ in counts)
    weights = (2 * n1 / (n0 + n1), 2 * n0 / (n0 + n1))  # inverse counts, summing to two
    over = (n0 + n1) if loss == "focal" else weights[0] * n0 + weights[1] * n1
    size = len(features.terms) + 1
    w, m, v, done = np.zeros(size), np.zeros(size), np.zeros(size), 0
    state = state or new_folder(spark, "training")
    stored = _last_state(spark, state, size)
    if stored is not None:
        done, w, m, v = stored
    # What earlier steps scored is read again from their weights, not remembered.
    history, best, best_w, since = [], -1.0, w, 0
    steps = [(t, _read_state(spark, state, t, size)[1]) for t in range(1, done)]
    for t, old in ([(0, np.zeros(size))] + steps if done else []):
        found = one_pass(features.table, old, loss, weights, gamma, alpha)
        history, best, best_w, since = _judge(history, t, found, over, old, best, best_w, since)
    while True:
        found = one_pass(features.table, w, loss, weights, gamma, alpha)
        history, best, best_w, since = _judge(history, done, found, over, w, best, best_w, since)
        if done >= epochs or (validated and since >= patience):
            break
        g = np.zeros(size)
        for slot, n in found.items():
            if slot >= 0:
                g[slot] = n / SCALE / over
        done += 1
        w, m, v = step(w, m, v, g, done, lr * factor(done, epochs, schedule), weight_decay, clip)
        _write_state(spark, state, done, w, m, v)
    w = best_w if validated else w
    return LinearModel(features.terms, features.idf, w[:-1].tolist(), float(w[-1]), features.settings, history=history)


def step(w, m, v, g, t: int, rate: float, weight_decay: float, clip: float):
    """Weights and both moments after step ``t`` along the gradient ``g``."""
    length = math.sqrt(float((g * g).sum()))
    if length > clip:
        g = g * (clip / length)
    m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
    w = w * (1 - rate * weight_decay) - rate * (m / (1 - BETA1 ** t)) / (np.sqrt(v / (1 - BETA2 ** t)) + EPS)
    return w, m, v


def _judge(history, t, found, over, w, best, best_w, since):
    score = macro_f1(found)
    history = [*history, {"epoch": t, "loss": found.get(LOSS, 0) / LOSS_SCALE / over, "val_macro_f1": score}]
    return (history, score, w, 0) if score > best else (history, best, best_w, since + 1)


def _write_state(spark, folder, epoch, w, m, v):
    rows = zip([epoch] * len(w), range(len(w)), w.tolist(), m.tolist(), v.tolist(), [len(w)] * len(w))
    spark.createDataFrame(list(rows), STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{epoch}")


def _read_state(spark, folder, epoch, size):
    rows = sorted(spark.read.schema(STATE).parquet(f"{folder}/{epoch}").collect(), key=lambda r: r["slot"])
    if len(rows) != size:
        raise ValueError(f"step {epoch} in {folder} is not complete")
    return epoch, *(np.array([r[c] for r in rows]) for c in "wmv")


def _last_state(spark, folder, size):
    """The last complete step of a folder of one table a step."""
    epoch = 0
    while True:
        try:
            rows = spark.read.schema(STATE).parquet(f"{folder}/{epoch + 1}").count()
        except Exception as missing:  # only a missing table ends the list
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            break
        if rows != size:
            break
        epoch += 1
    return _read_state(spark, folder, epoch, size) if epoch else None


@dataclass
class FoldFeatures:
    """A stored table (doc, fold, y, at, tf) for all folds, and every fold's own idf over the common terms (0: not its term)."""

    table: DataFrame
    terms: list[str]
    idf: np.ndarray


def fold_features(
    df: DataFrame, text: str = "text", label: str = "label", doc: str = "doc_id", fold: str = "fold", lo: int = 1, hi: int = 2,
    char: bool = False, stop: Sequence[str] | None = (), min_df: int = 1, max_df: float = 1.0, max_features: int = 50_000,
    clean: bool = False,
) -> FoldFeatures:
    """Count terms once; the vocabulary and weights of a fold's model are those of the rows outside the fold."""
    named = model_input(df, text, clean).select(
        F.col(doc).alias("doc"), F.col(fold).alias("fold"), F.col(label).cast("int").alias("y"), F.col("model_input").alias("text"))
    rows = materialize(add_terms(named, "text", lo, hi, char, stop).drop("text"), "terms", arrays=True)
    stats = materialize(term_stats(rows, ["fold"]), "fold-terms")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    known = []
    for f in range(len(sizes)):
        others = stats.filter(F.col("fold") != f).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cnt").alias("cnt"))
        n = sum(c for x, c in sizes.items() if x != f)
        known.append({r["term"]: r["idf"] for r in select_vocab(others, n, min_df, max_df, max_features).collect()})
    terms = sorted(set().union(*known))
    if len(terms) > MODEL_TERMS:
        raise ValueError(f"more than {MODEL_TERMS} terms in all folds together")
    idf = np.array([[k.get(t, 0.0) for t in terms] for k in known])
    v = F.unwrap_udt(F.col("tf_vector"))
    counts = vectorizer(terms, [1.0] * len(terms)).stages[0].transform(rows)
    return FoldFeatures(materialize(counts.select("doc", "fold", "y", v["indices"].alias("at"), v["values"].alias("tf")), "fold-counts", arrays=True),
                        terms, idf)


def _fold_rows(batch: pa.RecordBatch, idf: np.ndarray, w: np.ndarray) -> Iterator[tuple]:
    """(fold's number, row of every entry, feature, value, logit of every row) for every fold's model."""
    lists = batch.column(3)
    at, tf = lists.flatten().to_numpy(zero_copy_only=False), batch.column(4).flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    for f in range(len(idf)):
        a = tf * idf[f][at]
        length = np.sqrt(np.bincount(row, a * a, batch.num_rows))
        x = a / np.where(length > 0, length, 1.0)[row]
        yield f, row, at, x, np.bincount(row, w[f][at] * x, batch.num_rows) + w[f][-1]


def fit_folds(
    features: FoldFeatures, loss: str = "weighted", gamma: float = 2.0, alpha: float = 0.25, epochs: int = 20, lr: float = 0.05,
    weight_decay: float = 0.01, schedule: str = "linear", clip: float = 1.0,
) -> np.ndarray:
    """One row of weights per fold (the last is the intercept), all fitted together: a pass carries every fold's gradient."""
    idf, (k, size) = features.idf, (features.idf.shape[0], features.idf.shape[1] + 1)
    counts = {(r["fold"], r["y"]): r["count"] for r in features.table.groupBy("fold", "y").count().collect()}
    n = np.array([[sum(c for (x, y), c in counts.items() if x != f and y == label) for label in (0, 1)] for f in range(k)])
    if not n.all():
        raise ValueError("rows of both labels are needed outside every fold")
    weights = 2 * n[:, ::-1] / n.sum(1, keepdims=True)
    over = n.sum(1) if loss == "focal" else (weights * n).sum(1)
    w, m, v = np.zeros((k, size)), np.zeros((k, size)), np.zeros((k, size))

    def gradients(w):
        def add(batches):
            high, low = np.zeros(k * size, np.int64), np.zeros(k * size, np.int64)
            for batch in _pieces(batches, 3):
                fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                for f, row, at, x, z in _fold_rows(batch, idf, w):
                    d = np.where(fold != f, slope(z, y, loss, tuple(weights[f]), gamma, alpha)[1], 0.0)
                    sums = np.zeros(size, np.int64)
                    np.add.at(sums, at, np.rint(d[row] * x * SCALE).astype(np.int64))
                    sums[-1] += np.rint(d * SCALE).astype(np.int64).sum()
                    high[f * size: (f + 1) * size] += sums >> 32
                    low[f * size: (f + 1) * size] += sums & 0xFFFFFFFF
            slots = np.flatnonzero((high != 0) | (low != 0))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(high[slots]), pa.array(low[slots])],
                                             ["slot", "high", "low"])

        found = features.table.mapInArrow(add, "slot int, high long, low long")
        sums = found.groupBy("slot").agg(*[F.sum(F.col(c).cast("decimal(28, 0)")).alias(c) for c in ("high", "low")])
        out = np.zeros(k * size)
        for r in sums.collect():
            out[r["slot"]] = ((int(r["high"]) << 32) + int(r["low"])) / SCALE
        return out.reshape(k, size)

    for t in range(1, epochs + 1):
        g = gradients(w)
        rate = lr * factor(t, epochs, schedule)
        for f in range(k):
            w[f], m[f], v[f] = step(w[f], m[f], v[f], g[f] / over[f], t, rate, weight_decay, clip)
    return w


def out_of_fold(features: FoldFeatures, w: np.ndarray) -> DataFrame:
    """(doc, fold, y_true, prob): every row scored by the model that has not seen its fold."""
    idf, kind = features.idf, features.table.schema["doc"].dataType.simpleString()

    def score(batches):
        for batch in _pieces(batches, 3):
            fold, own = batch.column(1).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            for f, *_, z in _fold_rows(batch, idf, w):
                own = np.where(fold == f, z, own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own)], ["doc", "fold", "y_true", "z"])

    scored = features.table.mapInArrow(score, f"doc {kind}, fold int, y_true int, z double")
    return scored.select("doc", "fold", "y_true", scores.sigmoid(F.col("z")).alias("prob"))


def predictions(features: Features, model: LinearModel, part: str) -> DataFrame:
    """(doc, y_true, prob) of one part, from the stored features."""
    total = sparse_dot(F.col("at"), F.col("value"), model.coef)
    return features.table.filter(F.col("part") == part).select(
        "doc", F.col("y").alias("y_true"), scores.sigmoid(total + F.lit(model.intercept)).alias("prob"))
