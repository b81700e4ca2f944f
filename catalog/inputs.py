"""Input tables derived from the driver's tables.

Each exists as a DataFrame for the Spark side and as a CTE for the SQL side.
All read whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that is one file out to all cores.

    A file with one row group is one task, whatever the work per row. Tables of
    many files are read as they are.
    """
    if len(df.inputFiles()) > 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


# Of texts per task. Term counts of a part take some 20 times their size.
PART_BYTES = 8 << 20


def dealt_documents(spark: SparkSession, sf: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents dealt by id, in tasks whose share of the table does not grow with it.

    What unpacks a text takes many times its size: in tasks as large as a
    file's split, counts of terms outgrow memory and fall back to sorting. The
    texts themselves are measured, as repeated ones may be stored in a
    fraction of their size. The parts also keep each document's rows together,
    so later groupings by document shuffle nothing.
    """
    docs = table(spark, sf, "documents")
    files = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    stored = files.agg(F.sum("size")).first()[0] or 0
    size = max(stored, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return docs.repartition(max(spark.sparkContext.defaultParallelism, -(-size // part_bytes)), "doc_id")


# A document dressed up as a post: links, mentions, hashtags, emoji, Devanagari,
# elongations, kept symbols, and some blank and missing texts.
POST_TEXT = """
CASE WHEN doc_id % 97 = 0 THEN '   ' WHEN doc_id % 89 = 0 THEN NULL ELSE concat(
  CASE WHEN doc_id % 7 = 0 THEN concat('http://t.co/x', CAST(doc_id AS STRING), chr(160), 'seen ') ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN concat('@user', CAST(doc_id AS STRING), ' ') ELSE '' END,
  CASE WHEN doc_id % 17 = 0 THEN '@नदी ' ELSE '' END,
  text,
  CASE WHEN doc_id % 3 = 0 THEN ' waaaait noooow!!! Sure??' ELSE '' END,
  CASE WHEN doc_id % 4 = 0 THEN ' #OpenDoors #tag_1' ELSE '' END,
  CASE WHEN doc_id % 6 = 0 THEN ' 😀😀 🤠' ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN ' नदी शांत है' ELSE '' END,
  CASE WHEN doc_id % 13 = 0 THEN ' kya scene hai bhai' ELSE '' END,
  CASE WHEN doc_id % 19 = 0 THEN ' <b>x_y</b>' ELSE '' END) END"""

POSTS_SQL = f"posts AS (SELECT doc_id AS post_id, lang, source, {POST_TEXT} AS text_raw FROM documents)"


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).selectExpr(
        "doc_id AS post_id", "lang", "source", f"{POST_TEXT} AS text_raw")


LABELLED_SQL = """labelled AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", "lang", "source", "quality", F.col("toxic").alias("label"))


# Two labelled sources. Every third row of the second is a re-spaced, lower-case
# copy of the first's; both have blank texts, the second untidy label codes.
A_TEXT = "CASE WHEN d.doc_id % 62 = 0 THEN '  ' ELSE d.text END"
B_TEXT = """CASE WHEN doc_id % 31 = 0 THEN NULL
  WHEN doc_id % 3 = 0 THEN concat('  ', lower(replace(text, ' ', '  ')))
  ELSE concat(text, ' #', source) END"""
B_LABEL = "CASE doc_id % 4 WHEN 0 THEN 'HS0' WHEN 1 THEN concat(chr(39), 'HS1', chr(39)) WHEN 2 THEN ' hsn ' ELSE 'HS0' END"

SOURCES_SQL = f"""source_a AS (SELECT d.doc_id AS row_id, {A_TEXT} AS text,
    CAST(coalesce(l.toxic, 0) AS STRING) AS hate_label, d.lang AS language
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  source_b AS (SELECT doc_id AS row_id, {B_TEXT} AS Comment, {B_LABEL} AS Label FROM documents)"""


def source_a(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).alias("d")
    labels = table(spark, sf, "labels").select("doc_id", "toxic").alias("l")
    return d.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left").selectExpr(
        "d.doc_id AS row_id", f"{A_TEXT} AS text",
        "CAST(coalesce(toxic, 0) AS STRING) AS hate_label", "lang AS language")


def source_b(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).selectExpr(
        "doc_id AS row_id", f"{B_TEXT} AS Comment", f"{B_LABEL} AS Label")


PRED_PROB = "(35 * label + (doc_id * 7919 + 31 * k) % 61) / 100.0e0"
PREDICTIONS_SQL = f"""{LABELLED_SQL}, predictions AS (
  SELECT *, CASE WHEN prob >= 0.5e0 THEN 1 ELSE 0 END AS y_pred FROM (
  SELECT doc_id, model, label AS y_true, {PRED_PROB} AS prob, doc_id % 5 AS fold,
    lang = 'en' AS is_slice, source, text AS text_raw
  FROM labelled, (VALUES ('m1', 1), ('m2', 7)) AS m(model, k)))"""


def predictions(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Two models' scores with many ties, exact in both engines."""
    rows = labelled(spark, sf) if rows is None else rows
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"))
                       for m, k in (("m1", 1), ("m2", 7))])
    return rows.select("*", F.inline(models)).selectExpr(
        "doc_id", "model", "label AS y_true", f"{PRED_PROB} AS prob", "doc_id % 5 AS fold",
        "lang = 'en' AS is_slice", "source", "text AS text_raw"
    ).withColumn("y_pred", (F.col("prob") >= 0.5).cast("int"))


FEEDBACK_COLS = """event_id AS id, ts, text AS input_text,
  CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'transformer' END AS model_type,
  CASE WHEN value >= 20 THEN 'HATE' ELSE 'NON-HATE' END AS prediction,
  least(100.0e0, floor(value)) AS severity,
  CASE WHEN event_type = 'error' THEN CASE WHEN value >= 20 THEN 'NON-HATE' ELSE 'HATE' END
    ELSE CASE WHEN value >= 20 THEN 'HATE' ELSE 'NON-HATE' END END AS user_label,
  props AS comment, event_type"""
FEEDBACK_SQL = f"""feedback AS (SELECT {FEEDBACK_COLS} FROM events e
  JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""


def feedback(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """Events with the text each is about; ``parts`` is the number of tasks that join them, each table dealt once."""
    n_docs = table(spark, sf, "documents").count()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    events = table(spark, sf, "events").withColumn("doc_id", F.col("event_id") % n_docs)
    docs, events = (spread(d) if parts is None else d.repartition(parts, "doc_id") for d in (docs, events))
    return events.join(docs, "doc_id").selectExpr(*_split_select(FEEDBACK_COLS)).withColumn(
        "ts", F.col("ts").cast("timestamp"))


def _split_select(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(text[last:i].strip())
            last = i + 1
    return [*parts, text[last:].strip()]
