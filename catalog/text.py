"""Text cleaning, filters and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.functions import labels as L
from moderata.functions import text as T
from moderata.functions.constants import CODE_MIX_TOKENS, NA_TOKENS
from moderata.operators import filters
from moderata.operators.dedup import dedup_clean, dedup_clean_report
from moderata.operators.prepare import preprocess, text_stats
from moderata.sources import roles, tables

from . import duck
from .inputs import POSTS_SQL, SOURCES_SQL, documents, labelled, posts, source_a, source_b, table
from .registry import query


def _column(name, expr, sql):
    """A query that applies one text function to every post."""

    @query(name, f"WITH {POSTS_SQL} SELECT post_id, {sql} AS result FROM posts")
    def run(spark, sf):
        return posts(spark, sf).select("post_id", expr(F.col("text_raw")).alias("result"))


_column("strip_urls", T.strip_urls, duck.urls("text_raw"))
_column("strip_mentions", T.strip_mentions, duck.mentions("text_raw"))
_column("unwrap_hashtags", T.unwrap_hashtags, duck.hashtags("text_raw"))
_column("emoji_tokens", lambda c: T.emoji(c, keep=True), duck.emoji("text_raw", True))
_column("emoji_spaces", T.emoji, duck.emoji("text_raw"))
_column("emphasis_tokens", T.emphasis, duck.emphasis("text_raw"))
_column("emphasis_spaces", lambda c: T.emphasis(c, keep=False), duck.emphasis("text_raw", False))
_column("collapse_runs", T.collapse_runs, duck.runs("text_raw"))
_column("collapse_vowels", T.collapse_vowels, duck.vowels("text_raw"))
_column("charset_filter", T.charset, duck.charset("text_raw"))
_column("charset_filter_basic", lambda c: T.charset(c, "basic"),
        duck.charset("text_raw", "basic"))
_column("squash_ws", T.squash, duck.squash("text_raw"))
_column("clean_text", T.clean_text, duck.clean("text_raw"))
_column("clean_text_emoji", lambda c: T.clean_text(c, keep_emojis=True),
        duck.clean("text_raw", keep_emojis=True))
_column("clean_text_plain",
        lambda c: T.clean_text(c, normalize_repeated=False, keep_emphasis=False),
        duck.clean("text_raw", keep_emphasis=False, repeated=False))
_column("clean_text_basic", lambda c: T.clean_text(c, profile="basic"),
        duck.clean("text_raw", profile="basic"))
_column("text_key", T.text_key, duck.key("text_raw"))
_column("preview", T.preview,
        "CASE WHEN length(text_raw) > 60 THEN concat(substr(text_raw, 1, 60), '…') ELSE text_raw END")

LISTED = ", ".join(f"'{t}'" for t in CODE_MIX_TOKENS)
CODE_MIXED = f"""coalesce(regexp_matches(text_raw, '[\\x{{900}}-\\x{{97F}}]') OR (
  list_has_any(regexp_extract_all(lower(text_raw), '[a-z]+'), [{LISTED}]) AND
  len(list_filter(list_distinct(regexp_extract_all(lower(text_raw), '[a-z]+')),
    lambda t: t NOT IN ({LISTED}))) > 0), false)"""
_column("code_mixed", T.is_code_mixed, CODE_MIXED)


@query("text_stats", f"""WITH {POSTS_SQL} SELECT post_id, CAST(coalesce(length(text_raw), 0) AS INT) AS n_chars,
  CAST(coalesce(len(regexp_extract_all(text_raw, '{duck.NON_WS}+')), 0) AS INT) AS n_words FROM posts""")
def _text_stats(spark, sf):
    return text_stats(posts(spark, sf), "text_raw").select("post_id", "n_chars", "n_words")


@query("preprocess_frame", f"""WITH {POSTS_SQL} SELECT post_id, lang, source, text_raw,
  {duck.clean("text_raw")} AS text_raw_cleaned, {CODE_MIXED} AS is_hinglish FROM posts""")
def _preprocess(spark, sf):
    return preprocess(posts(spark, sf), "text_raw")


@query("drop_missing", f"WITH {POSTS_SQL} SELECT post_id, text_raw FROM posts WHERE text_raw IS NOT NULL")
def _drop_missing(spark, sf):
    return filters.drop_missing(posts(spark, sf), ["text_raw"]).select("post_id", "text_raw")


KEPT = f"coalesce(regexp_matches(text_raw, '{duck.NON_WS}'), false)"


@query("drop_blank", f"WITH {POSTS_SQL} SELECT post_id FROM posts WHERE {KEPT}")
def _drop_blank(spark, sf):
    return filters.drop_blank(posts(spark, sf), "text_raw").select("post_id")


@query("drop_blank_report", f"""WITH {POSTS_SQL} SELECT count(*) AS rows_in,
  count(*) FILTER (NOT {KEPT}) AS removed, count(*) FILTER ({KEPT}) AS rows_out FROM posts""")
def _drop_blank_report(spark, sf):
    return filters.blank_report(posts(spark, sf), "text_raw")


CLEANED_SQL = f"""{POSTS_SQL}, cleaned AS (
  SELECT * FROM (SELECT post_id, {duck.clean("text_raw")} AS text FROM posts) WHERE text <> '')"""


def cleaned(spark, sf):
    df = posts(spark, sf).select("post_id", T.clean_text(F.col("text_raw")).alias("text"))
    return filters.drop_empty_clean(df)


@query("drop_empty_clean", f"WITH {CLEANED_SQL} SELECT post_id, text FROM cleaned")
def _drop_empty_clean(spark, sf):
    return cleaned(spark, sf)


@query("dedup_clean", f"""WITH {CLEANED_SQL} SELECT post_id, text FROM cleaned
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1""")
def _dedup_clean(spark, sf):
    return dedup_clean(posts(spark, sf), "post_id").select("post_id", "text")


@query("dedup_clean_report", f"""WITH {CLEANED_SQL} SELECT count(*) AS rows_in,
  count(DISTINCT text) AS rows_out, count(*) - count(DISTINCT text) AS removed FROM cleaned""")
def _dedup_clean_report(spark, sf):
    return dedup_clean_report(posts(spark, sf))


CODE = "upper(trim({}, chr(39)))".format(duck.strip("Label"))


@query("label_whitelist", f"""WITH {SOURCES_SQL} SELECT row_id, Label FROM source_b
  WHERE {CODE} IN ('HS1', 'HSN')""")
def _label_whitelist(spark, sf):
    return filters.keep_labels(source_b(spark, sf), "Label", ["HS1", "HSN"]).select(
        "row_id", "Label")


# A named label per document: names in odd case, padded names, unknown names, nulls.
NAMED = """CASE doc_id % 7 WHEN 0 THEN 'Hate' WHEN 1 THEN 'clean' WHEN 2 THEN 'OFFENSIVE'
  WHEN 3 THEN NULL WHEN 4 THEN '1' WHEN 5 THEN '1.0' ELSE ' abusive ' END"""


@query("binarize_labels", f"""SELECT doc_id, CASE WHEN lower(name) IN
  ('hate', 'offensive', '1', 'abusive', 'hateful') THEN 1 ELSE 0 END AS label
  FROM (SELECT doc_id, {NAMED} AS name FROM documents) WHERE name IS NOT NULL""")
def _binarize(spark, sf):
    df = documents(spark, sf).selectExpr("doc_id", f"{NAMED} AS name")
    return filters.drop_missing(
        df.select("doc_id", L.binarize(F.col("name")).alias("label")), ["label"])


@query("binarize_labels_trimmed", f"""SELECT doc_id, CASE WHEN lower(trim(name)) IN
  ('hate', 'offensive', '1', 'abusive', 'hateful') THEN 1 ELSE 0 END AS label
  FROM (SELECT doc_id, {NAMED} AS name FROM documents) WHERE name IS NOT NULL""")
def _binarize_trimmed(spark, sf):
    df = documents(spark, sf).selectExpr("doc_id", f"{NAMED} AS name")
    return filters.drop_missing(
        df.select("doc_id", L.binarize(F.col("name"), trimmed=True).alias("label")), ["label"])


@query("binarize_int", """SELECT doc_id, CASE WHEN quality + 2 * toxic = 0 THEN 0 ELSE 1 END AS label
  FROM labels""")
def _binarize_int(spark, sf):
    raw = (F.col("quality") + 2 * F.col("toxic")).cast("string")
    return table(spark, sf, "labels").select("doc_id", L.binarize_int(raw).alias("label"))


@query("strict_labels", f"""WITH {SOURCES_SQL} SELECT row_id, CAST(hate_label AS INT) AS label
  FROM source_a""")
def _strict(spark, sf):
    return source_a(spark, sf).select("row_id", L.strict_binary(F.col("hate_label")).alias("label"))


@query("map_codes", f"""WITH {SOURCES_SQL} SELECT row_id,
  CASE {CODE} WHEN 'HS0' THEN 0 WHEN 'HS1' THEN 1 WHEN 'HSN' THEN 1 END AS label FROM source_b""")
def _map_codes(spark, sf):
    return source_b(spark, sf).select("row_id", L.map_codes(F.col("Label")).alias("label"))


@query("map_codes_drop", """SELECT doc_id, CASE source WHEN 'src0' THEN 0 ELSE 1 END AS label
  FROM documents WHERE source IN ('src0', 'src1')""")
def _map_codes_drop(spark, sf):
    label = L.map_codes(F.col("source"), {"SRC0": 0, "SRC1": 1}, on_unknown="drop")
    return filters.drop_missing(
        documents(spark, sf).select("doc_id", label.alias("label")), ["label"])


NA = ", ".join(f"'{t}'" for t in NA_TOKENS)
MAYBE_NA = "CASE doc_id % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN 'none' ELSE source END"


@query("na_tokens", f"""SELECT doc_id, CASE WHEN v NOT IN ({NA}) THEN v END AS v, lang
  FROM (SELECT doc_id, {MAYBE_NA} AS v, lang FROM documents)""")
def _na_tokens(spark, sf):
    df = documents(spark, sf).selectExpr("doc_id", f"{MAYBE_NA} AS v", "lang")
    return tables.normalize_na(df, ["v", "lang"])


@query("infer_roles", """SELECT text AS text_raw, toxic AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def _infer_roles(spark, sf):
    df = labelled(spark, sf).selectExpr(
        "doc_id", "text AS `Tweet_Text`", "lang", "label AS `Class Name`")
    text, label = roles.infer_roles(df)
    return df.select(F.col(text).alias("text_raw"), F.col(label).alias("label"))


@query("standardize_columns", "SELECT text, lang AS label FROM documents")
def _standardize(spark, sf):
    return roles.standardize(documents(spark, sf), "text", "lang")


@query("nested_pairs", "SELECT text, 0 AS label FROM documents")
def _nested(spark, sf):
    nested = documents(spark, sf).select(
        F.struct(F.col("text").alias("hi_ng"), F.col("lang").alias("en")).alias("translation"))
    return tables.from_translation_pairs(nested, "translation.hi_ng")


@query("explode_lines", f"""WITH lines AS (SELECT doc_id, unnest(l) AS line,
    unnest(range(len(l))) AS line_no FROM (SELECT doc_id,
      string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\f\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l
      FROM documents))
  SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM (SELECT doc_id, line_no, {duck.strip("line")} AS line FROM lines)
  WHERE line <> ''""")
def _explode_lines(spark, sf):
    return tables.explode_lines(documents(spark, sf).select("doc_id", "text"), "text")
