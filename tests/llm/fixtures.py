"""Small tables with the awkward cases every operator has to take."""

import random

from pyspark.sql import types as T

# Extra columns whose names clash with ones that operators use inside.
EXTRA = ("key", "id", "row", "words", "digest_", "part", "kind", "h", "range_", "score", "kept", "n", "label", "copies")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA])


def rows(n: int = 120, seed: int = 5):
    rng = random.Random(seed)
    words = [a + b for a in ("th", "er", "on", "st", "ing", "é", "ß") for b in ("an", "ou", "le", "x", "日", "'s")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 8, 40, 90)))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies of the text before: one word changed
        if i and len(texts[i - 1].split()) > 30:
            w = texts[i - 1].split()
            w[rng.randrange(len(w))] = "changed"
            texts[i] = " ".join(w)
    for i in range(0, n, 10):  # exact copies
        texts[i] = texts[(i * 7 + 3) % n]
    out = [(i, t, rng.choice(("en", "de", None)), f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    out += [(n + i, t, "en", "odd", 0) for i, t in enumerate(
        [None, "", "   \n\t", "a", "A a", "123 456", "!!!", "the same text", "The Same Text", "the  same\ttext", "x" * 3000,
         "it's they've we'll 'tis '", " lead", "trail ", "tab\tand\nline\n\n", "ǅ İ Σ ς É é 😡😡", "<|endoftext|> a <|startoftext|>",
         "Licensed under CC BY 4.0. All rights reserved. CC-BY cc by", "GNU General Public License", "no license"])]
    out += [(3, texts[3], "en", "again", 1)] * 2  # repeated rows
    out += [(None, "a row without a key", "en", None, None), (None, None, None, None, None)]
    return out


def docs(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, *EXTRA) for r in data], SCHEMA)


def empty(spark):
    return docs(spark, [])
