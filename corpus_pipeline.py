"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and reads the rows its predecessor
kept; all but the last return the columns of documents. Nulls: a text without a
letter, or unlike the texts of its likeliest labelled language, is rejected by
the first stage; a null key is an ordinary row until the join, where it links
with nothing and stays. Repeated rows end in the second stage. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderata.llm import exact_dedup, language_id, ngram_join, packing
from moderata.llm.queries import vocabulary
from moderata.llm.workspace import fresh, shared_folder, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the machines learn from the labels outside the held-out fold."""
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))), evidence=True)
    lang, score, known = (fresh(docs, x) for x in ("lang_pred", "lang_score", "lang_known"))
    judged = language_id.identify(docs, model, out=lang, score=score, known=known)
    return judged.filter(F.col(known)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, the document with the smallest doc_id."""
    groups = ngram_join.jaccard_join(docs)
    gone = written(groups.filter("doc_id <> component_id").select("doc_id"), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]
# Language models and tokenizers have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
