"""Deduplication, merging, corrections, splits, samples, dataset statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.functions.labels import map_codes, strict_binary
from moderata.functions.text import is_code_mixed, text_key
from moderata.operators import merge, profiling, split
from moderata.operators.dedup import dedup_first
from moderata.operators.features import tokens
from moderata.sources.workspace import materialize

from . import duck
from .inputs import (
    FEEDBACK_SQL,
    LABELLED_SQL,
    SOURCES_SQL,
    documents,
    feedback,
    labelled,
    source_a,
    source_b,
    table,
)
from .registry import query
from .text import CODE_MIXED

UNION_SQL = f"""{SOURCES_SQL}, raw AS (
  SELECT 1 AS src, 'source_a' AS source_dataset, row_id, {duck.strip("coalesce(text, '')")} AS text,
    hate_label AS original_label, {duck.strip("coalesce(language, '')")} AS language_hint FROM source_a
  UNION ALL
  SELECT 2, 'source_b', row_id, {duck.strip("coalesce(Comment, '')")}, Label, '' FROM source_b),
keyed AS (SELECT *, {duck.key("text")} AS key FROM raw),
kept AS (SELECT *, CASE upper(trim(trim(original_label), chr(39)))
    WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN 'HS0' THEN 0 WHEN 'HS1' THEN 1 WHEN 'HSN' THEN 1 END AS label
  FROM keyed WHERE text <> ''
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, row_id) = 1)"""


def sources(spark, sf):
    return [
        merge.Source("source_a", source_a(spark, sf), "text", "hate_label", strict_binary,
                     "language"),
        merge.Source("source_b", source_b(spark, sf), "Comment", "Label", map_codes),
    ]


@query("dedup_first", f"""SELECT doc_id, text FROM documents
  QUALIFY row_number() OVER (PARTITION BY {duck.key("text")} ORDER BY doc_id) = 1""")
def _dedup_first(spark, sf):
    df = documents(spark, sf).select("doc_id", "text")
    return dedup_first(df, text_key(F.col("text")), "doc_id")


@query("merge_sources", f"""WITH {UNION_SQL} SELECT text, label, source_dataset, original_label,
  language_hint FROM kept""")
def _merge(spark, sf):
    return merge.merge_sources(sources(spark, sf))


@query("merge_report", f"""WITH {UNION_SQL}, per AS (
  SELECT source_dataset, count(*) AS total_rows,
    count(*) FILTER (text = '') AS dropped_empty_text,
    (SELECT count(*) FROM kept k WHERE k.source_dataset = keyed.source_dataset) AS kept_rows,
    (SELECT count(*) FROM kept k WHERE k.source_dataset = keyed.source_dataset AND label = 0) AS label_0,
    (SELECT count(*) FROM kept k WHERE k.source_dataset = keyed.source_dataset AND label = 1) AS label_1
  FROM keyed GROUP BY source_dataset)
  SELECT coalesce(source_dataset, 'merged') AS source_dataset, sum(total_rows)::BIGINT AS total_rows,
    sum(kept_rows)::BIGINT AS kept_rows,
    sum(total_rows - kept_rows - dropped_empty_text)::BIGINT AS dropped_duplicates,
    sum(dropped_empty_text)::BIGINT AS dropped_empty_text, sum(label_0)::BIGINT AS label_0,
    sum(label_1)::BIGINT AS label_1
  FROM per GROUP BY GROUPING SETS ((source_dataset), ())""")
def _merge_report(spark, sf):
    return merge.merge_report(sources(spark, sf))


@query("add_negatives", f"""WITH {LABELLED_SQL} SELECT doc_id, text, label FROM labelled
  WHERE regexp_matches(text, '{duck.NON_WS}')
  UNION ALL SELECT NULL, text, 0 FROM conversations WHERE regexp_matches(text, '{duck.NON_WS}')""")
def _add_negatives(spark, sf):
    return merge.add_negatives(
        labelled(spark, sf).select("doc_id", "text", "label"),
        table(spark, sf, "conversations").select("text"))


@query("add_negatives_sampled", f"""WITH {LABELLED_SQL}, extra AS (
    SELECT text FROM documents ORDER BY ('0x' || substr(md5(concat_ws(':', '42', doc_id)), 1, 8))::BIGINT,
      doc_id LIMIT 50)
  SELECT text, label FROM labelled WHERE regexp_matches(text, '{duck.NON_WS}')
  UNION ALL SELECT text, 0 FROM extra WHERE regexp_matches(text, '{duck.NON_WS}')""")
def _add_negatives_sampled(spark, sf):
    extra = documents(spark, sf).select("doc_id", "text")
    return merge.add_negatives(
        labelled(spark, sf).select("doc_id", "text", "label"), extra, 50, 42, "doc_id"
    ).select("text", "label")


FIXES_SQL = f"""{FEEDBACK_SQL}, fixes AS (
  SELECT {duck.key("input_text")} AS key, input_text, id,
    CASE user_label WHEN 'HATE' THEN 1 WHEN 'NON-HATE' THEN 0 END AS fix
  FROM feedback WHERE prediction IS DISTINCT FROM user_label
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) = 1)"""
CORRECTED_SQL = f"""WITH {LABELLED_SQL}, {FIXES_SQL},
  train AS (SELECT text, label, {duck.key("text")} AS key FROM labelled)
  SELECT t.text, CAST(coalesce(f.fix, t.label) AS INT) AS label, f.fix IS NOT NULL AS corrected
  FROM train t LEFT JOIN fixes f ON t.key = f.key
  UNION ALL SELECT input_text, fix, true FROM fixes WHERE key NOT IN (SELECT key FROM train)"""


@query("apply_corrections", CORRECTED_SQL)
def _apply_corrections(spark, sf):
    fixes = materialize(merge.latest_corrections(feedback(spark, sf)), "corrections")
    return merge.apply_corrections(labelled(spark, sf).select("text", "label"), fixes)


def h(seed, key="doc_id"):
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {key})), 1, 8))::BIGINT"


TEST = f"{h(42)} < {round(0.15 * 2**32)}"


SPLIT_SQL = f"""{LABELLED_SQL}, halves AS (SELECT doc_id, label, CASE WHEN
  row_number() OVER (PARTITION BY label ORDER BY {h(42)}, doc_id)
    <= round_even(count(*) OVER (PARTITION BY label) * 0.15e0, 0) THEN 'test' ELSE 'train' END AS split
  FROM labelled)"""


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT * FROM halves")
def _stratified(spark, sf):
    return split.stratified_split(labelled(spark, sf).select("doc_id", "label"), "label")


@query("stratified_split_hash", f"""WITH {LABELLED_SQL} SELECT doc_id, label,
  CASE WHEN {TEST} THEN 'test' ELSE 'train' END AS split FROM labelled""")
def _stratified_hash(spark, sf):
    return split.stratified_split(labelled(spark, sf).select("doc_id", "label"), "label", exact=False)


@query("stratified_split_exact", f"WITH {SPLIT_SQL} SELECT * FROM halves")
def _stratified_exact(spark, sf):
    return split.stratified_split(
        labelled(spark, sf).select("doc_id", "label"), "label", exact=True)


@query("split_summary", f"WITH {SPLIT_SQL} SELECT split, label, count(*) AS n FROM halves GROUP BY ALL")
def _split_summary(spark, sf):
    return split.split_summary(
        split.stratified_split(labelled(spark, sf).select("doc_id", "label"), "label"), "label")


@query("nested_split", f"""WITH {SPLIT_SQL} SELECT doc_id, label, CASE WHEN split = 'train' AND
  row_number() OVER (PARTITION BY label, split ORDER BY {h('42:val')}, doc_id)
    <= round_even(count(*) OVER (PARTITION BY label, split) * 0.1e0, 0) THEN 'val' ELSE split END AS split
  FROM halves""")
def _nested(spark, sf):
    return split.nested_split(labelled(spark, sf).select("doc_id", "label"), "label")


@query("kfold_assign", f"""WITH {LABELLED_SQL} SELECT doc_id, label, CAST((row_number() OVER (
  PARTITION BY label ORDER BY {h('42:fold')}, doc_id) - 1) % 5 AS INT) AS fold FROM labelled""")
def _kfold(spark, sf):
    return split.assign_folds(labelled(spark, sf).select("doc_id", "label"), label="label")


def groups_sql(rows, label, key, seed):
    """ranks(key, size, stratum, before, total) of the distinct keys of ``rows``."""
    return f"""counts AS (SELECT {key} AS key, {label} AS label, count(*) AS c FROM {rows} GROUP BY ALL),
  keys AS (SELECT key, sum(c) AS size, first(label ORDER BY c DESC, label) AS stratum FROM counts GROUP BY key),
  ranks AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY {h(seed, "key")}, key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY stratum) AS total FROM keys)"""


KEYED = f"keyed AS (SELECT *, sha256({duck.key('text')}) AS text_key FROM labelled)"


def keyed(spark, sf):
    return labelled(spark, sf).select("doc_id", "label", F.sha2(text_key(F.col("text")), 256).alias("text_key"))


@query("group_split", f"""WITH {LABELLED_SQL}, {KEYED}, {groups_sql("keyed", "label", "text_key", 42)}
  SELECT doc_id, label, text_key, CASE WHEN before < round_even(total * 0.15e0, 0) THEN 'test' ELSE 'train' END AS split
  FROM keyed JOIN ranks ON key = text_key""")
def _group_split(spark, sf):
    return split.group_split(keyed(spark, sf), "label", key="text_key")


@query("group_folds", f"""WITH {LABELLED_SQL}, {KEYED}, {groups_sql("keyed", "label", "text_key", "42:fold")}
  SELECT doc_id, label, text_key, CAST(floor(before * 5.0e0 / total) AS INT) AS fold FROM keyed JOIN ranks ON key = text_key""")
def _group_folds(spark, sf):
    """A key with many rows is told by broadcast."""
    return split.group_folds(keyed(spark, sf), key="text_key", hot_rows=1)


@query("kfold_hash", f"""WITH {LABELLED_SQL} SELECT doc_id, label, CAST({h('42:fold')} % 5 AS INT) AS fold
  FROM labelled""")
def _kfold_hash(spark, sf):
    return split.assign_folds(labelled(spark, sf).select("doc_id", "label"))


@query("sample_n", f"SELECT doc_id, lang FROM documents ORDER BY {h(42)}, doc_id LIMIT 100")
def _sample(spark, sf):
    return split.sample_n(documents(spark, sf).select("doc_id", "lang"), 100)


@query("ordered_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id)
  <= floor(0.8e0 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents""")
def _ordered(spark, sf):
    return split.ordered_split(documents(spark, sf).select("doc_id"), "doc_id")


@query("class_distribution", f"""WITH {LABELLED_SQL} SELECT label, count(*) AS n,
  round(count(*) * 100.0e0 / sum(count(*)) OVER (), 9) AS pct FROM labelled GROUP BY label""")
def _classes(spark, sf):
    return profiling.class_distribution(labelled(spark, sf)).withColumn("pct", F.round("pct", 9))


@query("class_slice_distribution", f"""WITH {LABELLED_SQL}, tagged AS (SELECT label, {
  CODE_MIXED.replace("text_raw", "text")} AS is_hinglish FROM labelled)
  SELECT label, is_hinglish, count(*) AS n,
    round(count(*) * 100.0e0 / sum(count(*)) OVER (), 9) AS pct FROM tagged GROUP BY ALL""")
def _class_slices(spark, sf):
    df = labelled(spark, sf).withColumn("is_hinglish", is_code_mixed(F.col("text")))
    return profiling.class_distribution(df, ["label", "is_hinglish"]).withColumn(
        "pct", F.round("pct", 9))


@query("class_imbalance", f"""WITH {LABELLED_SQL}, c AS (SELECT count(*) AS n FROM labelled GROUP BY label)
  SELECT max(n) AS majority, min(n) AS minority,
    round(max(n)::DOUBLE / min(n), 9) AS imbalance_ratio FROM c""")
def _imbalance(spark, sf):
    return profiling.imbalance(labelled(spark, sf)).withColumn(
        "imbalance_ratio", F.round("imbalance_ratio", 9))


@query("profile", """WITH p AS (SELECT d.doc_id, text, lang, source, n_chars, toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
  SELECT count(*) AS n_rows, 6 AS n_columns, 'doc_id' AS column_name, 'bigint' AS column_type,
    count(*) FILTER (doc_id IS NULL) AS n_missing FROM p
  UNION ALL SELECT count(*), 6, 'text', 'string', count(*) FILTER (text IS NULL) FROM p
  UNION ALL SELECT count(*), 6, 'lang', 'string', count(*) FILTER (lang IS NULL) FROM p
  UNION ALL SELECT count(*), 6, 'source', 'string', count(*) FILTER (source IS NULL) FROM p
  UNION ALL SELECT count(*), 6, 'n_chars', 'bigint', count(*) FILTER (n_chars IS NULL) FROM p
  UNION ALL SELECT count(*), 6, 'toxic', 'int', count(*) FILTER (toxic IS NULL) FROM p""")
def _profile(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return profiling.profile(documents(spark, sf).join(labels, "doc_id", "left"))


@query("length_stats", f"""WITH {LABELLED_SQL} SELECT label, CAST(min(length(text)) AS INT) AS min_len,
  round(avg(length(text)), 6) AS mean_len, quantile_cont(length(text), 0.5) AS median_len,
  CAST(max(length(text)) AS INT) AS max_len, round(stddev_samp(length(text)), 6) AS std_len
  FROM labelled GROUP BY label""")
def _length_stats(spark, sf):
    return profiling.length_stats(labelled(spark, sf)).withColumns({
        "mean_len": F.round("mean_len", 6), "std_len": F.round("std_len", 6)})


@query("top_words", f"""WITH {LABELLED_SQL}, w AS (SELECT label,
    unnest(regexp_extract_all(lower(text), '{duck.WORD}{{2,}}')) AS term FROM labelled),
  c AS (SELECT label, term, count(*) AS n FROM w GROUP BY ALL)
  SELECT label, term, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS INT) AS rank
  FROM c QUALIFY rank <= 20""")
def _top_words(spark, sf):
    df = labelled(spark, sf).select("label", tokens(F.col("text")).alias("tokens"))
    return profiling.top_words(df)
