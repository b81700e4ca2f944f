"""Language identification in two steps: the family, then pairs of its languages.

A text is a vector of hashed byte bigrams and trigrams (square roots of counts,
length 1), over the whole lower-cased text. Linear support vector machines, one
against the rest, choose the family; inside it one machine per pair of
languages votes, and ties go to the larger sum of margins. The score is the
product of the family's and the weakest winning pair's logistic margins.

The machines are fitted on a bounded sample of labelled rows, ``SAMPLE_ROWS``
in all, chosen by a hash of the key; languages come from the labels. Languages
without a known family are families of their own. Prediction is narrow, reads
the text alone, and has no letterless texts: those, and null texts, are ``und``
with score 0, as is everything if there are no labelled rows.

The score says which language is likeliest, not that it is one of them. That is
told by ``Evidence``: the share of a text's letter trigrams that the winning
language's sample holds. Each sample text is measured against the others of its
language, and a text is unknown if its share is below what those texts reach.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 12
SAMPLE_ROWS = 3200
GRAM_BITS = 21
LEAST_GRAMS = 20  # texts with fewer trigrams say nothing about a language's usual share
# A language's bar is this part of the share that all but LOW of its own texts reach.
LOW, PART = 0.01, 0.8
FEW = 0.02  # trigrams in no more than this part of a language's texts do not count as its own
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
# Families of languages by code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz", "semitic": "ar he mt",
    "indic": "hi bn ur pa mr gu ne", "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of texts as rows."""
    data = [b" " + t.lower().encode("utf-8") + b" " for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, data), np.int64, len(data))
    owner = np.repeat(np.arange(len(data)) * FEATURES, size)
    out = np.zeros(len(data) * FEATURES, np.float32)
    ends = np.cumsum(size)
    for n in (2, 3):
        code = np.zeros(len(raw) - n + 1, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) ^ raw[i: len(raw) - n + 1 + i]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
        inside = np.ones(len(code), bool)  # no gram across two texts
        for i in range(1, n):
            inside[ends[:-1] - i] = False
        out += np.bincount((owner[: len(code)] + code)[inside], minlength=len(out)).astype(np.float32)
    out = np.sqrt(out.reshape(len(data), FEATURES))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code) of all trigrams of the texts' words, each word with a space on both sides."""
    joined = "".join(f" {t.lower()} " for t in texts)
    size = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    point = np.where(_letters()[np.minimum(point, 0x10FFFF)], point, np.uint32(0))
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.flatnonzero((point[1:-1] != 0) & ((point[:-2] != 0) | (point[2:] != 0))) + 1
    code = (point[at - 1] * np.uint32(0x01000193) ^ point[at]) * np.uint32(0x01000193) ^ point[at + 1]
    return owner[at], (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)


class Evidence:
    """Trigrams of each language's sample, and the share of them that a text of the language has at least."""

    def __init__(self, rows: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        """``rows``: (distinct codes, their counts) of each distinct sample text, by language."""
        self.place = {c: i for i, c in enumerate(sorted(rows))}
        self.bits = np.zeros((len(rows), 1 << GRAM_BITS >> 3), np.uint8)
        self.bar = np.zeros(len(rows))
        for c, i in self.place.items():
            held = np.zeros(1 << GRAM_BITS, np.int32)
            for code, _ in rows[c]:
                held[code] += 1
            # A passage in another language that a few of the texts quote is not the language.
            least = 1 + int(FEW * len(rows[c]))
            self.bits[i] = np.packbits(held >= least, bitorder="little")
            # A text's own trigrams do not vouch for it: the others must hold them.
            shares = [n[held[code] > least].sum() / n.sum() for code, n in rows[c] if n.sum() >= LEAST_GRAMS]
            self.bar[i] = PART * np.quantile(shares, LOW) if shares else 0

    def known(self, texts: list[str], languages: list[str]) -> np.ndarray:
        """Whether texts may be of the languages: few trigrams must miss the bar by more than chance."""
        owner, code = grams(texts)
        lang = np.fromiter((self.place[c] for c in languages), np.int64, len(texts))
        hit = self.bits[lang[owner], code >> np.uint32(3)] >> (code & np.uint32(7)).astype(np.uint8) & 1
        n = np.bincount(owner, minlength=len(texts))
        found = np.bincount(owner, weights=hit, minlength=len(texts))
        bar = self.bar[lang]
        return (found > 0) & (found + 3 * np.sqrt(n * bar * (1 - bar)) >= n * bar) | (bar == 0) | (n == 0)


def batches(texts: list[str], most: int = 512, size: int = 1 << 20):
    a = n = 0
    for b, t in enumerate(texts, 1):
        n += len(t)
        if n >= size or b - a == most or b == len(texts):
            yield a, b
            a, n = b, 0


def fit_machine(x: np.ndarray, positive: np.ndarray, rounds: int = 150, strength: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    cost = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = step = np.zeros(x.shape[1], np.float32)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ step))
        new = step + 0.2 * (x.T @ (2 * cost * slack * y) - strength * step)
        step, w = new + i / (i + 3) * (new - w), new
    return w


class Model:
    """Machines of families and of pairs of languages."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, evidence: Evidence | None = None):
        self.evidence = evidence
        self.languages = sorted(set(labels.tolist()))
        self.family = {c: FAMILY_OF.get(c, c) for c in self.languages}
        self.families = sorted(set(self.family.values()))
        mine = np.array([self.family[c] for c in labels.tolist()])
        self.of_family = {f: fit_machine(x, mine == f) for f in self.families} if len(self.families) > 1 else {}
        self.of_pair = {}
        for f in self.families:
            for a, b in combinations([c for c in self.languages if self.family[c] == f], 2):
                rows = (labels == a) | (labels == b)
                self.of_pair[a, b] = fit_machine(x[rows], labels[rows] == a)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each row."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1), np.float32)])
        if self.of_family:
            margins = x @ np.stack([self.of_family[f] for f in self.families], 1)
            family, score = margins.argmax(1), _logistic(margins.max(1))
        else:
            family, score = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            codes = [c for c in self.languages if self.family[c] == f]
            votes, total = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            weakest = np.full((len(rows), len(codes)), np.inf)
            for a, b in combinations(range(len(codes)), 2):
                m = x[rows] @ self.of_pair[codes[a], codes[b]]
                for c, own in ((a, m), (b, -m)):
                    votes[:, c] += own > 0
                    total[:, c] += own
                    weakest[:, c] = np.minimum(weakest[:, c], own)
            best = (votes + total / (1e-6 + 4 * np.abs(total).sum(1, keepdims=True))).argmax(1) if len(codes) > 1 else np.zeros(len(rows), int)
            out[rows] = np.array(codes, object)[best]
            if len(codes) > 1:
                score[rows] *= _logistic(weakest[np.arange(len(rows)), best])
        return out.tolist(), score


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_rows: int = SAMPLE_ROWS, evidence: bool = False) -> Model | None:
    """Fit on about ``sample_rows`` rows, as many of each language as there are, up to an equal share.

    ``evidence`` also learns which texts are of none of the languages.
    """
    rows = labelled.select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().toPandas()
    if not len(counts):
        return None
    share = max(50, sample_rows // len(counts))
    bars = {c: int(min(1.0, share / n) * (1 << 30)) for c, n in counts.itertuples(index=False)}
    bar = F.create_map(*[F.lit(x) for pair in bars.items() for x in pair])[F.col("lang")]
    sample = rows.filter(F.pmod("h", F.lit(1 << 30)) < bar).select("text", "lang")

    def vectors(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(0).to_pylist()
            for a, b in batches(texts):
                held = [v.tobytes() for v in features(texts[a:b]).astype(np.float16)]
                codes, times = [], []
                for t in texts[a:b]:
                    code, n = np.unique(grams([t])[1] if evidence else np.zeros(0, np.uint32), return_counts=True)
                    codes.append(code.tobytes())
                    times.append(n.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [frame.column(1).slice(a, b - a), *(pa.array(z, pa.binary()) for z in (held, codes, times))],
                    ["lang", "v", "codes", "times"])

    found = sample.mapInArrow(vectors, "lang string, v binary, codes binary, times binary").toPandas()
    found = found.sort_values(["lang", "v"])
    if not len(found):
        return None
    x = np.frombuffer(b"".join(found["v"]), np.float16).reshape(len(found), FEATURES).astype(np.float32)
    learned = None
    if evidence:
        once = found.drop_duplicates(["lang", "codes", "times"])  # a copy does not vouch for its twin
        learned = Evidence({c: [(np.frombuffer(y, np.uint32), np.frombuffer(z, np.uint32))
                                for y, z in zip(part["codes"], part["times"])] for c, part in once.groupby("lang")})
    return Model(x, found["lang"].to_numpy(object), learned)


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "lang_pred", score: str = "score",
             known: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score, and on demand whether the text may be of that language."""
    position = docs.columns.index(text)
    names = [*docs.columns, out, score, *([known] if known else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out}` string, `{score}` double" + (
        f", `{known}` boolean" if known else "")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(position).to_pylist()
            code, sure = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            told = np.zeros(len(texts), bool)
            able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model else []
            for a, b in batches([texts[i] for i in able]):
                at = able[a:b]
                code[at], sure[at] = model.predict(features([texts[i] for i in at]))
                if known:
                    told[at] = model.evidence.known([texts[i] for i in at], code[at].tolist())
            more = [pa.array(code, pa.string()), pa.array(sure), *([pa.array(told)] if known else [])]
            yield pa.RecordBatch.from_arrays([*frame.columns, *more], names)

    return docs.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows of the fold that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
