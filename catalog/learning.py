"""Features, the baseline model, scoring, context and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.operators import explain, features, model
from moderata.operators.context import with_context
from moderata.operators.metrics import binary_metrics
from moderata.operators.split import stratified_split
from moderata.plans.training import load_training
from moderata.sources.workspace import materialize, new_folder

from . import duck
from .datasets import SPLIT_SQL, h
from .inputs import LABELLED_SQL, POSTS_SQL, dealt_documents, documents, labelled, posts, table
from .registry import query
from .text import CODE_MIXED

TERMS = 50_000  # largest vocabulary
STOP = ["the", "of", "and", "to", "is", "le", "la", "de", "un", "une", "des", "der", "die", "das",
        "und", "el", "los", "en"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
WORDS = f"regexp_extract_all(lower(text), '{duck.WORD}{{2,}}')"
KEPT = f"list_filter({WORDS}, lambda t: t NOT IN ({STOP_SQL}))"


@query("word_tokens", f"SELECT doc_id, array_to_string({WORDS}, '|') AS tokens FROM documents")
def _tokens(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.array_join(features.tokens(F.col("text")), "|").alias("tokens"))


@query("stop_words", f"SELECT doc_id, array_to_string({KEPT}, '|') AS tokens FROM documents")
def _stop(spark, sf):
    kept = features.remove_stop(features.tokens(F.col("text")), STOP)
    return documents(spark, sf).select("doc_id", F.array_join(kept, "|").alias("tokens"))


GRAMS2 = "list_transform(list_zip(w[:-2], w[2:]), lambda p: concat_ws(' ', p[1], p[2]))"
GRAMS3 = "list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda p: concat_ws(' ', p[1], p[2], p[3]))"


@query("word_ngrams", f"""WITH t AS (SELECT doc_id, {KEPT} AS w FROM documents)
  SELECT doc_id, array_to_string(list_concat(w, {GRAMS2}, {GRAMS3}), '|') AS grams FROM t""")
def _ngrams(spark, sf):
    df = features.add_terms(documents(spark, sf), "text", 1, 3, stop=STOP)
    return df.select("doc_id", F.array_join("terms", "|").alias("grams"))


CHARS = " UNION ALL ".join(
    f"""SELECT unnest(list_transform(range(1, greatest(length(w) - {n} + 1, 1) + 1),
      lambda i: substr(w, i, {n}))) AS gram FROM words {'' if n == 3 else f'WHERE length(w) >= {n}'}"""
    for n in (3, 4, 5))


@query("char_ngrams", f"""WITH words AS (SELECT concat(' ', x, ' ') AS w FROM (SELECT
    unnest(regexp_extract_all(lower(text), '{duck.NON_WS}+')) AS x FROM documents)),
  g AS ({CHARS}) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def _chars(spark, sf):
    return features.char_ngram_counts(documents(spark, sf))


COUNTS = f"""tok AS (SELECT doc_id, {KEPT} AS w FROM documents),
  counts AS (SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM (
    SELECT doc_id, unnest(w) AS term FROM tok
    UNION ALL SELECT doc_id, unnest({GRAMS2}) FROM tok) GROUP BY ALL),
  nd AS (SELECT count(*) AS n FROM documents)"""


def vocab_sql(limit=None, unigrams=False):
    top = f"ORDER BY cnt DESC, term LIMIT {limit}" if limit else ""
    return f"""{COUNTS}, vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cnt,
    ln((1e0 + any_value(n)) / (1e0 + count(*))) + 1e0 AS idf FROM counts, nd GROUP BY term
    HAVING count(*) >= 2 AND count(*) <= 0.8e0 * any_value(n) {top})"""


def term_table(spark, sf):
    docs = dealt_documents(spark, sf).select("doc_id", "text")
    return features.add_terms(docs, "text", 1, 2, stop=STOP).select("doc_id", "terms")


def vocabulary(spark, sf, max_features):
    n = table(spark, sf, "documents").count()
    return features.vocab(term_table(spark, sf), n, max_features=max_features)


@query("doc_terms", f"""WITH {COUNTS} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens,
  max(tf) AS max_tf, min(term) AS first_term, max(term) AS last_term FROM counts GROUP BY doc_id""")
def _doc_terms(spark, sf):
    return features.doc_terms(term_table(spark, sf)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"),
        F.max("tf").alias("max_tf"), F.min("term").alias("first_term"),
        F.max("term").alias("last_term"))


@query("vocab_prune", f"WITH {vocab_sql()} SELECT term, df, cnt, round(idf, 9) AS idf FROM vocab")
def _vocab_prune(spark, sf):
    return vocabulary(spark, sf, None).withColumn("idf", F.round("idf", 9))


@query("vocab_topk", f"WITH {vocab_sql(TERMS)} SELECT term, df, cnt, round(idf, 9) AS idf FROM vocab")
def _vocab_topk(spark, sf):
    return vocabulary(spark, sf, TERMS).withColumn("idf", F.round("idf", 9))


def tfidf_sql(limit=None):
    return f"""{vocab_sql(limit)}, raw AS (SELECT doc_id, term, tf, idf, tf * idf AS a FROM counts JOIN vocab USING (term)),
  tfidf AS MATERIALIZED (SELECT doc_id, term, tf, idf, a, a / sqrt(sum(a * a) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def weights(spark, sf, max_features=TERMS, terms=None):
    """TF-IDF rows, over a vocabulary made before or made here."""
    terms = vocabulary(spark, sf, max_features) if terms is None else terms
    return features.tfidf(term_table(spark, sf), terms, max_features=max_features)


@query("tfidf", f"WITH {tfidf_sql(TERMS)} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM tfidf")
def _tfidf(spark, sf):
    return weights(spark, sf).withColumn("weight", F.round("weight", 6))


@query("tfidf_all_terms", f"""WITH {tfidf_sql()} SELECT doc_id, count(*) AS n_terms,
  round(sum(weight), 6) AS weight_sum, round(sum(weight * weight), 6) AS length FROM tfidf GROUP BY doc_id""")
def _tfidf_all(spark, sf):
    return weights(spark, sf, None).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("length"))


@query("feature_stats", f"""WITH {tfidf_sql(TERMS)} SELECT (SELECT n FROM nd) AS n_docs,
  count(DISTINCT term) AS n_terms, count(*) AS nnz,
  round(1 - count(*)::DOUBLE / ((SELECT n FROM nd)::DOUBLE * count(DISTINCT term)), 9) AS sparsity FROM tfidf""")
def _stats(spark, sf):
    n = table(spark, sf, "documents").count()
    return features.feature_stats(weights(spark, sf), n).withColumn(
        "sparsity", F.round("sparsity", 9))


@query("class_weights", f"""WITH {LABELLED_SQL}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
  SELECT label, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 9) AS weight FROM c""")
def _class_weights(spark, sf):
    return model.class_weights(labelled(spark, sf)).withColumn("weight", F.round("weight", 9))


@query("class_weights_inverse", f"""WITH {LABELLED_SQL}, c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label)
  SELECT label, n, round((1e0 / n) / sum(1e0 / n) OVER () * count(*) OVER (), 9) AS weight FROM c""")
def _class_weights_inverse(spark, sf):
    return model.class_weights(labelled(spark, sf), kind="inverse").withColumn(
        "weight", F.round("weight", 9))


# A fixed linear scorer over the vocabulary.
COEF = "((length(term) * 37) % 21 - 10) / 10.0e0"
INTERCEPT = -0.5


def linear_model(spark, sf):
    """(TF-IDF rows, coefficients) sharing one fitted vocabulary."""
    terms = features.pin(vocabulary(spark, sf, TERMS))
    return weights(spark, sf, terms=terms), terms.selectExpr("term", "idf", f"{COEF} AS coef")


@query("score_linear", f"""WITH {tfidf_sql(TERMS)}, s AS (SELECT doc_id, sum(weight * {COEF}) - 0.5e0 AS logit
    FROM tfidf GROUP BY doc_id)
  SELECT doc_id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS prob FROM s""")
def _score_linear(spark, sf):
    w, coefs = linear_model(spark, sf)
    out = model.linear_scores(w, coefs.drop("idf"), INTERCEPT)
    return out.withColumns({"logit": F.round("logit", 6), "prob": F.round("prob", 6)})


SHAP = f"""{tfidf_sql(TERMS)}, shap AS (SELECT doc_id, term,
    {COEF} * (weight - sum(weight) OVER (PARTITION BY term) / n) AS phi FROM tfidf, nd)"""


def shap(spark, sf, fitted=None):
    w, coefs = fitted or linear_model(spark, sf)
    bg = explain.background_mean(w, table(spark, sf, "documents").count())
    return explain.linear_shap(w, coefs.drop("idf"), bg)


@query("linear_shap", f"WITH {SHAP} SELECT doc_id, term, round(phi, 6) AS phi FROM shap")
def _shap(spark, sf):
    return shap(spark, sf).withColumn("phi", F.round("phi", 6))


@query("shap_base", f"""WITH {tfidf_sql(TERMS)}, bg AS (SELECT term, sum(weight) / any_value(n) AS mean_weight FROM tfidf, nd GROUP BY term)
  SELECT round(sum({COEF} * mean_weight) - 0.5e0, 6) AS base_value FROM bg""")
def _shap_base(spark, sf):
    w, coefs = linear_model(spark, sf)
    bg = explain.background_mean(w, table(spark, sf, "documents").count())
    return explain.base_value(coefs.drop("idf"), bg, INTERCEPT).withColumn(
        "base_value", F.round("base_value", 6))


def top_sql(source, weight, name):
    # Ranked on rounded weights, so that equal words tie in both engines.
    return f"""{name} AS (SELECT doc_id, term AS token, round({weight}, 6) AS weight,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs(round({weight}, 6)) DESC, term) AS INT) AS rank
    FROM {source} QUALIFY rank <= 10)"""


@query("top_attributions", f"""WITH {SHAP}, {top_sql("shap", "phi", "t")} SELECT *,
  CASE WHEN weight > 0 THEN 'Hate' ELSE 'Non-Hate' END AS direction FROM t""")
def _top_attr(spark, sf):
    return explain.top_attributions(shap(spark, sf).withColumn("phi", F.round("phi", 6)))


DROP = f"""{SHAP}, sums AS (SELECT *, {COEF} AS coef, sum(a * {COEF}) OVER d AS s, sum(a * a) OVER d AS q,
    count(*) OVER d AS m FROM tfidf WINDOW d AS (PARTITION BY doc_id)),
  lime AS (SELECT doc_id, term, 1 / (1 + exp(0.5e0 - s / sqrt(q))) - 1 / (1 + exp(0.5e0 -
    CASE WHEN m = 1 THEN 0 ELSE (s - a * coef) / sqrt(q - a * a) END)) AS weight FROM sums)"""


def drop_one(spark, sf, fitted=None):
    w, coefs = fitted or linear_model(spark, sf)
    return explain.lime_drop_one(w.select("doc_id", "term", "tf"), coefs, INTERCEPT)


@query("lime_drop_one", f"WITH {DROP} SELECT doc_id, term, round(weight, 6) + 0e0 AS weight FROM lime")
def _drop_one(spark, sf):
    # Adding zero turns -0.0 into 0.0.
    return drop_one(spark, sf).withColumn("weight", F.round("weight", 6) + 0.0)


@query("explainer_agreement", f"""WITH {DROP}, {top_sql("shap", "phi", "a")}, {top_sql("lime", "weight", "b")},
  j AS (SELECT doc_id, token, a.weight AS wa, b.weight AS wb FROM a FULL JOIN b USING (doc_id, token))
  SELECT doc_id, round(count(*) FILTER (wa IS NOT NULL AND wb IS NOT NULL)::DOUBLE / count(*), 9) AS jaccard,
    round(count(*) FILTER (sign(wa) = sign(wb))::DOUBLE /
      nullif(count(*) FILTER (wa IS NOT NULL AND wb IS NOT NULL), 0), 9) AS sign_agreement
  FROM j GROUP BY doc_id""")
def _agreement(spark, sf):
    fitted = linear_model(spark, sf)
    a = explain.top_attributions(shap(spark, sf, fitted).withColumn("phi", F.round("phi", 6)))
    b = explain.top_attributions(
        drop_one(spark, sf, fitted).withColumn("weight", F.round("weight", 6)), weight="weight")
    return explain.explainer_agreement(a, b).withColumns({
        "jaccard": F.round("jaccard", 9), "sign_agreement": F.round("sign_agreement", 9)})


@query("lime_batch", f"""WITH {tfidf_sql(TERMS)} SELECT doc_id, least(10, count(*)) AS words, true AS finite
  FROM tfidf GROUP BY doc_id""")
def _lime(spark, sf):
    """Words and finite weights per document; their signs are tested against ``lime_drop_one``."""
    w, coefs = linear_model(spark, sf)
    return explained(explain.lime_linear(w.select("doc_id", "term", "tf"), coefs, INTERCEPT))


def explained(rows):
    return rows.groupBy("doc_id").agg(
        F.countDistinct("term").alias("words"),
        F.bool_and(F.abs("weight") < float("inf")).alias("finite"))


@query("lime_texts", f"""WITH t AS (SELECT concat(conv_id, '/', turn) AS doc_id, regexp_extract_all(lower(text),
    '{duck.WORD}{{2,}}') AS w FROM conversations)
  SELECT doc_id, least(10, len(list_distinct(w))) AS words, true AS finite FROM t WHERE len(w) > 0""")
def _lime_texts(spark, sf):
    def make():
        # Stands for any external scorer: share of words longer than five letters.
        def predict(texts):
            return [sum(len(w) > 5 for w in t.split(" ")) / (1 + t.count(" ")) for t in texts]
        return predict

    keyed = table(spark, sf, "conversations").select(
        F.concat("conv_id", F.lit("/"), "turn").alias("doc_id"),
        features.tokens(F.col("text")).alias("words"))
    return explained(explain.lime_texts(keyed, make))


BACKGROUND = 20  # rows
SHAPLEY = f"""{tfidf_sql(TERMS)}, chosen AS (SELECT doc_id FROM documents ORDER BY {h(42)}, doc_id LIMIT {BACKGROUND})"""


def shapley(spark, sf, probability):
    """Sampled Shapley values of the fixed linear scorer, in log-odds or as a probability, with the vocabulary's terms."""
    rows = materialize(term_table(spark, sf), "terms", arrays=True)
    found = features.vocab(rows, rows.count(), max_features=TERMS).selectExpr("term", "idf", f"{COEF} AS coef").orderBy("term").collect()
    terms, coef = [r["term"] for r in found], [r["coef"] for r in found]
    vectors = materialize(features.sparse(rows, terms, [r["idf"] for r in found]), "vectors", arrays=True)

    additive = explain.AdditiveScore

    def make():
        import numpy as np

        w = np.array(coef)
        return additive(
            lambda at, value: w[at] * value,
            lambda z: 1 / (1 + np.exp(-(z + INTERCEPT))) if probability else z + INTERCEPT)

    return explain.shapley(vectors, make, explain.background_rows(vectors, BACKGROUND)), terms


@query("shapley_linear", f"""WITH {SHAPLEY}, bg AS (SELECT term, {COEF} AS coef, sum(weight) / {BACKGROUND}e0 AS m
    FROM tfidf SEMI JOIN chosen USING (doc_id) GROUP BY term),
  own AS (SELECT doc_id, term, {COEF} * (weight - coalesce(m, 0)) AS phi, coef * m AS expected FROM tfidf LEFT JOIN bg USING (term))
  SELECT doc_id, term, round(phi, 6) + 0e0 AS phi FROM own
  UNION ALL SELECT doc_id, NULL, round(coalesce(sum(expected), 0) - (SELECT sum(coef * m) FROM bg), 6) + 0e0
  FROM documents LEFT JOIN own USING (doc_id) GROUP BY doc_id""")
def _shapley_linear(spark, sf):
    """Without interactions the sample is the closed form, in every term."""
    found, terms = shapley(spark, sf, False)
    return found.select("doc_id", features.term_of(F.col("at"), terms).alias("term"), (F.round("phi", 6) + 0.0).alias("phi"))


@query("shapley_prob", f"""WITH {SHAPLEY}, z AS (SELECT doc_id, count(term) AS players,
    1e0 / (1e0 + exp(-(coalesce(sum(weight * {COEF}), 0e0) - 0.5e0))) AS p FROM documents LEFT JOIN tfidf USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, players + 1 AS players, round(p - (SELECT avg(p) FROM z SEMI JOIN chosen USING (doc_id)), 6) + 0e0 AS total FROM z""")
def _shapley_prob(spark, sf):
    """Values of a document add up to its probability less the background's mean."""
    found, _ = shapley(spark, sf, True)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("players"), (F.round(F.sum("phi"), 6) + 0.0).alias("total"))


@query("score_plugin", "SELECT doc_id, (length(text) % 100) / 100.0e0 AS prob FROM documents")
def _plugin(spark, sf):
    def make():
        def predict(texts):
            import numpy as np

            return np.array([len(t) % 100 / 100.0 for t in texts])
        return predict

    df = documents(spark, sf).select("doc_id", "text")
    return model.score_with(df, make).select("doc_id", "prob")


def conversation_sql(source, by, order, n=2):
    return f"""WITH m AS (SELECT *, coalesce(text, '') AS msg FROM {source}),
  c AS (SELECT {by}, {order}, msg, list_filter(coalesce(list(msg) OVER (PARTITION BY {by} ORDER BY {order}
    ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), []), lambda x: regexp_matches(x, '{duck.NON_WS}')) AS context FROM m)
  SELECT {by}, {order}, len(context) AS n_context,
    array_to_string(list_concat(context, [msg]), ' [CTX] ') AS context_text FROM c"""


@query("context_window", conversation_sql("conversations", "conv_id", "turn"))
def _context(spark, sf):
    out = with_context(table(spark, sf, "conversations"), "conv_id", "turn")
    return out.select("conv_id", "turn", F.size("context").cast("bigint").alias("n_context"),
                      "context_text")


# Blank texts among the messages, and every source large enough to be cut into ranges.
BLANKED = "CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 41 = 0 THEN NULL ELSE text END"


@query("pseudo_context", conversation_sql(
    f"(SELECT doc_id, source, {BLANKED} AS text FROM documents)", "source", "doc_id", 3))
def _pseudo(spark, sf):
    df = documents(spark, sf).selectExpr("doc_id", "source", f"{BLANKED} AS text")
    out = with_context(df, "source", "doc_id", n=3, hot_rows=10)
    return out.select("source", "doc_id", F.size("context").cast("bigint").alias("n_context"),
                      "context_text")


@query("load_training", f"""WITH {POSTS_SQL}, raw AS (SELECT post_id AS row_id, text_raw,
    CAST(toxic <> 0 AS INT) AS label, {duck.clean("text_raw")} AS text, {CODE_MIXED} AS is_hinglish
    FROM posts JOIN labels ON doc_id = post_id WHERE text_raw IS NOT NULL)
  SELECT * FROM raw WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1""")
def _load_training(spark, sf):
    df = posts(spark, sf).join(
        table(spark, sf, "labels").select(F.col("doc_id").alias("post_id"), "toxic"), "post_id")
    return load_training(df.select(
        F.col("post_id").alias("row_id"), "text_raw", F.col("toxic").cast("string").alias("label")))


def trained(spark, sf, rows=None, **kw):
    rows = labelled(spark, sf) if rows is None else rows
    return model.train_baseline(rows, clean=True, **kw)


@query("train_baseline")
def _train(spark, sf):
    return trained(spark, sf).weights(spark)


@query("train_baseline_char")
def _train_char(spark, sf):
    return trained(spark, sf, hi=3, char=True).weights(spark)


@query("score_batch", """SELECT doc_id, CASE WHEN length(text) > 60 THEN concat(substr(text, 1, 60), '…') ELSE text END
  AS preview, true AS scored, true AS severity_fits, true AS label_fits FROM documents""")
def _score_batch(spark, sf):
    """Previews, and whether severity and label follow from the probability."""
    out = model.score_batch(trained(spark, sf), documents(spark, sf))
    return out.select(
        "doc_id", "preview", F.col("prob").between(0, 1).alias("scored"),
        (F.abs(F.col("severity") - 100 * F.col("prob")) <= 0.5 + 1e-9).alias("severity_fits"),
        (F.col("prediction") == F.when(F.col("prob") > 0.5, "HATE").otherwise("NON-HATE")).alias("label_fits"))


@query("train_metrics", f"""WITH {SPLIT_SQL} SELECT count(*) AS rows, count(*) FILTER (label = 1) AS positives,
  true AS rates_fit FROM halves WHERE split = 'test'""")
def _train_metrics(spark, sf):
    """Metrics of held-out rows: their counts, and whether the rates follow from them."""
    split = stratified_split(labelled(spark, sf), "label")
    scored = trained(spark, sf, split.filter("split = 'train'")).transform(split.filter("split = 'test'"))
    m = binary_metrics(scored.select(
        F.col("label").alias("y_true"), (F.col("prob") >= 0.5).cast("int").alias("y_pred")))
    n = F.expr("tn + fp + fn + tp")
    return m.select(n.alias("rows"), F.expr("tp + fn").alias("positives"),
                    (F.abs(F.col("accuracy") - F.expr("tn + tp") / n) < 1e-9).alias("rates_fit"))


@query("cv_train", f"""WITH {LABELLED_SQL}, f AS (SELECT label, CAST((row_number() OVER (PARTITION BY label
    ORDER BY {h('42:fold')}, doc_id) - 1) % 5 AS INT) AS fold FROM labelled)
  SELECT fold, count(*) AS rows, count(*) FILTER (label = 1) AS positives, true AS scored FROM f GROUP BY fold""")
def _cv_train(spark, sf):
    """Out-of-fold rows and labels of five folds; every row has a probability."""
    folds = model.cross_validate(labelled(spark, sf), clean=True)
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("y_true") == 1, 1)).alias("positives"),
        F.bool_and(F.col("prob").between(0, 1)).alias("scored"))


@query("model_roundtrip", f"WITH {LABELLED_SQL} SELECT doc_id, true AS same FROM labelled")
def _roundtrip(spark, sf):
    data = labelled(spark, sf).select("doc_id", "text")
    fitted = trained(spark, sf)
    path = new_folder(spark, "model")
    model.save_model(fitted, path)
    again = model.load_model(spark, path).transform(data).select("doc_id", F.col("prob").alias("q"))
    both = fitted.transform(data).join(again, "doc_id")
    return both.select("doc_id", (F.col("prob") == F.col("q")).alias("same"))
