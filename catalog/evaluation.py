"""Metrics, curves, sweeps, errors, severity and feedback reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.functions import scores
from moderata.functions.constants import MODEL_IS_CORRECT, SWEEP_THRESHOLDS
from moderata.operators import curves, errors, feedback as fbk, metrics
from moderata.operators.dedup import dedup_clean
from moderata.operators.model import batch_summary, moderation_queue, present

from . import duck
from .inputs import FEEDBACK_SQL, PREDICTIONS_SQL, feedback, labelled, predictions
from .registry import query

P = PREDICTIONS_SQL
HITS = """count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp"""


def r(a, b):
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


F1 = r("2*tp", "2*tp+fp+fn")
MACRO = f"({F1} + {r('2*tn', '2*tn+fp+fn')}) / 2"
RATES = f"""{r("tp+tn", "tp+tn+fp+fn")} AS accuracy, {r("tp", "tp+fp")} AS precision,
  {r("tp", "tp+fn")} AS recall, {r("tn", "tn+fp")} AS specificity, {F1} AS f1, {MACRO} AS macro_f1,
  {r("fp", "fp+tn")} AS false_positive_rate, {r("fn", "fn+tp")} AS false_negative_rate"""


@query("confusion", f"""WITH {P}, c AS (SELECT model, {HITS} FROM predictions GROUP BY model)
  SELECT *, {r("tn*100", "tn+fp+fn+tp")} AS tn_pct, {r("fp*100", "tn+fp+fn+tp")} AS fp_pct,
    {r("fn*100", "tn+fp+fn+tp")} AS fn_pct, {r("tp*100", "tn+fp+fn+tp")} AS tp_pct FROM c""")
def _confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf), ["model"], percent=True)


@query("binary_metrics", f"""WITH {P}, c AS (SELECT model, {HITS} FROM predictions GROUP BY model)
  SELECT *, {RATES} FROM c""")
def _binary(spark, sf):
    return metrics.binary_metrics(predictions(spark, sf), ["model"])


@query("flagship", f"""WITH {P}, cleaned AS (SELECT *, {duck.clean("text")} AS t FROM labelled),
  kept AS (SELECT doc_id FROM cleaned WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1),
  c AS (SELECT model, {HITS} FROM predictions SEMI JOIN kept USING (doc_id) GROUP BY model)
  SELECT *, {RATES} FROM c""")
def _flagship(spark, sf):
    unique = dedup_clean(labelled(spark, sf), "doc_id", raw="text", out="cleaned")
    return metrics.binary_metrics(predictions(spark, sf, unique), ["model"])


N0, N1 = "(tn+fp)", "(fn+tp)"
ROW0 = (r("tn", "tn+fn"), r("tn", "tn+fp"), r("2*tn", "2*tn+fp+fn"))
ROW1 = (r("tp", "tp+fp"), r("tp", "tp+fn"), F1)


def _line(name, values, support):
    p, rec, f1 = values
    return (f"SELECT model, '{name}' AS class, {p} AS precision, {rec} AS recall, {f1} AS f1, "
            f"{support} AS support FROM c")


REPORT = " UNION ALL ".join([
    _line("Non-Hate", ROW0, N0), _line("Hate", ROW1, N1),
    _line("accuracy", [r("tp+tn", "tn+fp+fn+tp")] * 3, f"{N0}+{N1}"),
    _line("macro avg", [f"({a} + {b}) / 2" for a, b in zip(ROW0, ROW1)], f"{N0}+{N1}"),
    _line("weighted avg", [r(f"{a} * {N0} + {b} * {N1}", f"{N0}+{N1}") for a, b in zip(ROW0, ROW1)],
          f"{N0}+{N1}"),
])


@query("classification_report",
       f"WITH {P}, c AS (SELECT model, {HITS} FROM predictions GROUP BY model) {REPORT}")
def _report(spark, sf):
    return metrics.classification_report(predictions(spark, sf), ["model"])


CUM = f"""{P}, g AS (SELECT model, prob AS score, sum(y_true)::BIGINT AS p,
    sum(1 - y_true)::BIGINT AS n FROM predictions GROUP BY ALL),
  cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp,
    sum(p) OVER (PARTITION BY model) AS pos, sum(n) OVER (PARTITION BY model) AS neg
    FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query("roc_curve", f"""WITH {CUM} SELECT model, score AS threshold, fp::DOUBLE / neg::DOUBLE AS fpr,
    tp::DOUBLE / pos::DOUBLE AS tpr FROM cum
  UNION ALL SELECT DISTINCT model, 'infinity'::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM cum""")
def _roc_curve(spark, sf):
    return curves.roc_curve(predictions(spark, sf))


@query("pr_curve", f"""WITH {CUM} SELECT model, score AS threshold,
    tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / pos::DOUBLE AS recall FROM cum
  UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM cum""")
def _pr_curve(spark, sf):
    return curves.pr_curve(predictions(spark, sf))


ROC_AUC = "sum(n::DOUBLE * (tp::DOUBLE - p::DOUBLE / 2)) / nullif(max(pos)::DOUBLE * max(neg)::DOUBLE, 0)"
PR_AUC = """sum(p::DOUBLE / pos::DOUBLE * (tp::DOUBLE / (tp + fp)::DOUBLE +
  coalesce((tp - p)::DOUBLE / nullif(tp + fp - p - n, 0)::DOUBLE, 1)) / 2)"""


@query("roc_auc", f"WITH {CUM} SELECT model, round({ROC_AUC}, 9) AS roc_auc FROM cum GROUP BY model")
def _roc_auc(spark, sf):
    return curves.roc_auc(predictions(spark, sf)).withColumn("roc_auc", F.round("roc_auc", 9))


@query("pr_auc", f"WITH {CUM} SELECT model, round({PR_AUC}, 9) AS pr_auc FROM cum GROUP BY model")
def _pr_auc(spark, sf):
    return curves.pr_auc(predictions(spark, sf)).withColumn("pr_auc", F.round("pr_auc", 9))


THRESHOLDS = ", ".join(f"({t!r}e0)" for t in SWEEP_THRESHOLDS)
SWEEP = f"""{P}, t(threshold) AS (VALUES {THRESHOLDS}),
  c AS (SELECT model, threshold, {HITS.replace("y_pred = 0", "prob < threshold").replace("y_pred = 1", "prob >= threshold")}
    FROM predictions, t GROUP BY ALL),
  sweep AS (SELECT model, threshold, {F1} AS hate_f1, {MACRO} AS macro_f1 FROM c)"""


@query("threshold_sweep", f"WITH {SWEEP} SELECT * FROM sweep")
def _sweep(spark, sf):
    return metrics.threshold_sweep(predictions(spark, sf))


@query("threshold_sweep_report", f"""WITH {SWEEP} SELECT model, round(threshold, 2) AS threshold,
  round(hate_f1, 4) AS hate_f1, round(macro_f1, 4) AS macro_f1 FROM sweep""")
def _sweep_report(spark, sf):
    return metrics.sweep_report(metrics.threshold_sweep(predictions(spark, sf)))


@query("best_threshold", f"""WITH {SWEEP}, b AS (SELECT model, max(hate_f1) AS best_hate_f1,
    CASE WHEN max(hate_f1) > 0 THEN first(threshold ORDER BY hate_f1 DESC, threshold) ELSE 0.5e0 END
      AS best_threshold FROM sweep GROUP BY model)
  SELECT *, best_threshold AS effective_threshold FROM b""")
def _best(spark, sf):
    return metrics.best_threshold(metrics.threshold_sweep(predictions(spark, sf)))


@query("slice_metrics", f"""WITH {P}, c AS (SELECT model, CASE WHEN GROUPING(is_slice) = 1 THEN 'all'
    ELSE CAST(is_slice AS VARCHAR) END AS slice, {HITS}, count(*) AS n
    FROM predictions GROUP BY GROUPING SETS ((model, is_slice), (model)))
  SELECT *, {RATES} FROM c WHERE slice = 'all' OR n >= 10""")
def _slices(spark, sf):
    return metrics.slice_metrics(predictions(spark, sf), "is_slice")


@query("slice_metrics_by_source", f"""WITH {P}, c AS (SELECT model, CASE WHEN GROUPING(source) = 1 THEN 'all'
    ELSE source END AS slice, {HITS}, count(*) AS n
    FROM predictions GROUP BY GROUPING SETS ((model, source), (model)))
  SELECT *, {RATES} FROM c WHERE slice = 'all' OR n >= 10""")
def _slices_source(spark, sf):
    return metrics.slice_metrics(predictions(spark, sf), "source")


LONG = f"""{P}, c AS (SELECT model, {HITS} FROM predictions GROUP BY model),
  m AS (SELECT model, {RATES} FROM c),
  long AS (SELECT model, metric, value FROM m UNPIVOT INCLUDE NULLS
    (value FOR metric IN (accuracy, precision, recall, f1)))"""


@query("compare_models", f"""WITH {LONG} SELECT model, metric, value,
  first_value(model) OVER (PARTITION BY metric ORDER BY value DESC, model) AS best_model,
  max(value) OVER (PARTITION BY metric) AS best_value FROM long""")
def _compare(spark, sf):
    return metrics.compare_models(metrics.binary_metrics(predictions(spark, sf), ["model"]))


@query("comparison_matrix", f"""WITH {LONG} SELECT metric, max(value) FILTER (model = 'm1') AS m1,
  max(value) FILTER (model = 'm2') AS m2 FROM long GROUP BY metric""")
def _matrix(spark, sf):
    return metrics.comparison_matrix(metrics.binary_metrics(predictions(spark, sf), ["model"]))


@query("model_delta", f"""WITH {LONG}, d AS (SELECT metric, max(value) FILTER (model = 'm1') AS value_a,
    max(value) FILTER (model = 'm2') AS value_b FROM long GROUP BY metric),
  f AS (SELECT value_b - value_a AS gain FROM d WHERE metric = 'f1')
  SELECT metric, value_a, value_b, value_b - value_a AS change,
    (value_b - value_a) * 100 / nullif(value_a, 0) AS change_pct,
    CASE WHEN gain > 0 THEN 'm2' WHEN gain < 0 THEN 'm1' ELSE 'tie' END AS winner FROM d, f""")
def _delta(spark, sf):
    return metrics.model_delta(
        metrics.binary_metrics(predictions(spark, sf), ["model"]), "m1", "m2")


CV = f"""cf AS (SELECT model, fold, {HITS} FROM predictions GROUP BY ALL),
  cv AS (SELECT model, round(avg({MACRO}), 9) AS cv_macro_f1_mean,
    round(stddev_pop({MACRO}), 9) AS cv_macro_f1_std, round(avg({F1}), 9) AS cv_hate_f1_mean,
    round(stddev_pop({F1}), 9) AS cv_hate_f1_std FROM cf GROUP BY model)"""
CV_COLS = ["cv_macro_f1_mean", "cv_macro_f1_std", "cv_hate_f1_mean", "cv_hate_f1_std"]


@query("cv_summary", f"WITH {P}, {CV} SELECT * FROM cv")
def _cv(spark, sf):
    return metrics.cv_summary(predictions(spark, sf)).withColumns(
        {c: F.round(c, 9) for c in CV_COLS})


@query("ablation_table", f"""WITH {CUM}, {CV}, c AS (SELECT model, {HITS} FROM predictions GROUP BY model),
  s AS (SELECT model, {HITS} FROM predictions WHERE is_slice GROUP BY model HAVING count(*) >= 10),
  a AS (SELECT model, round({ROC_AUC}, 9) AS roc_auc, round({PR_AUC}, 9) AS pr_auc FROM cum GROUP BY model),
  test AS (SELECT model, {MACRO} AS test_macro_f1, {F1} AS test_hate_f1, {r("tp", "tp+fp")} AS test_precision,
    {r("tp", "tp+fn")} AS test_recall FROM c),
  part AS (SELECT model, {MACRO} AS slice_macro_f1, {F1} AS slice_hate_f1 FROM s)
  SELECT * FROM test LEFT JOIN cv USING (model) LEFT JOIN a USING (model) LEFT JOIN part USING (model)""")
def _ablation(spark, sf):
    out = metrics.ablation_table(predictions(spark, sf))
    return out.withColumns({c: F.round(c, 9) for c in [*CV_COLS, "roc_auc", "pr_auc"]})


PT = "CASE WHEN y_true = 1 THEN prob ELSE 1 - prob END"


@query("loss_report", f"""WITH {P}, x AS (SELECT *, greatest({PT}, 1e-12) AS pt FROM predictions),
  w AS (SELECT model, count(*) FILTER (y_true = 0) AS n0, count(*) FILTER (y_true = 1) AS n1,
    sum(-ln(pt)) FILTER (y_true = 0) AS ce0, sum(-ln(pt)) FILTER (y_true = 1) AS ce1,
    avg(CASE WHEN y_true = 1 THEN 0.75 ELSE 0.25 END * (1 - pt) * (1 - pt) * -ln(pt)) AS focal
    FROM x GROUP BY model)
  SELECT model, round(focal, 9) AS focal_loss,
    round((ce0 / n0 + ce1 / n1) / 2, 9) AS weighted_ce FROM w""")
def _loss(spark, sf):
    return metrics.loss_report(predictions(spark, sf)).withColumns({
        "focal_loss": F.round("focal_loss", 9), "weighted_ce": F.round("weighted_ce", 9)})


@query("decide", f"""WITH {P} SELECT doc_id, model, CASE WHEN prob >= 0.45e0 THEN 1 ELSE 0 END AS decided,
  CASE WHEN prob > 1 - prob THEN 'HATE' ELSE 'NON-HATE' END AS label,
  greatest(prob, 1 - prob) AS confidence FROM predictions""")
def _decide(spark, sf):
    p = F.col("prob")
    return predictions(spark, sf).select(
        "doc_id", "model", scores.decide(p, 0.45).alias("decided"),
        scores.argmax_label(p).alias("label"), scores.confidence(p).alias("confidence"))


SEV = "least(100, CAST(round_even(prob * 100, 0) AS INT))"


@query("severity", f"WITH {P} SELECT doc_id, model, {SEV} AS severity FROM predictions")
def _severity(spark, sf):
    return predictions(spark, sf).select(
        "doc_id", "model", scores.severity(F.col("prob")).alias("severity"))


BAND = "CASE WHEN s >= 80 THEN 'extreme' WHEN s >= 51 THEN 'likely' WHEN s >= 21 THEN 'mild' ELSE 'safe' END"
ROUTE = """CASE WHEN s > 80 THEN 'auto_remove' WHEN s >= 50 THEN 'human_review'
  WHEN s >= 20 THEN 'log' ELSE 'none' END"""


@query("severity_bands", f"""WITH {P}, x AS (SELECT *, {SEV} AS s FROM predictions)
  SELECT doc_id, model, {BAND} AS band, {ROUTE} AS route FROM x""")
def _bands(spark, sf):
    s = scores.severity(F.col("prob"))
    return predictions(spark, sf).select(
        "doc_id", "model", scores.band(s).alias("band"), scores.route(s).alias("route"))


@query("moderation_queue", f"""WITH {P}, x AS (SELECT *, {SEV} AS s FROM predictions)
  SELECT {ROUTE} AS route, count(*) AS n, round(avg(s), 9) AS avg_severity FROM x GROUP BY 1""")
def _queue(spark, sf):
    scored = present(predictions(spark, sf), "text_raw")
    return moderation_queue(scored).withColumn("avg_severity", F.round("avg_severity", 9))


@query("batch_summary", f"""WITH {P} SELECT count(*) AS total, count(*) FILTER (prob > 1 - prob) AS hate,
  round(count(*) FILTER (prob > 1 - prob) * 100.0e0 / count(*), 9) AS hate_pct,
  round(avg({SEV}), 9) AS avg_severity FROM predictions""")
def _summary(spark, sf):
    return batch_summary(present(predictions(spark, sf), "text_raw")).withColumns({
        "hate_pct": F.round("hate_pct", 9), "avg_severity": F.round("avg_severity", 9)})


ERR = f"""{P}, e AS (SELECT model, doc_id, text_raw AS text, y_true AS true_label, y_pred AS pred_label,
  CASE WHEN y_pred = 1 THEN 'FP' ELSE 'FN' END AS error_type, round(prob, 4) AS prob_hate
  FROM predictions WHERE y_pred IS DISTINCT FROM y_true)"""


@query("top_errors", f"""WITH {ERR} SELECT * FROM e
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY abs(prob_hate - 0.5) DESC, doc_id) <= 50""")
def _top_errors(spark, sf):
    return errors.top_errors(predictions(spark, sf), by=["model"])


@query("all_errors", f"WITH {ERR} SELECT * REPLACE (NULL::DOUBLE AS prob_hate) FROM e")
def _all_errors(spark, sf):
    return errors.top_errors(predictions(spark, sf), prob=None, by=["model"])


@query("error_counts", f"""WITH {P} SELECT model, count(*) FILTER (y_pred = 1 AND y_true = 0) AS fp,
  count(*) FILTER (y_pred = 0 AND y_true = 1) AS fn, count(*) FILTER (y_pred <> y_true) AS errors
  FROM predictions GROUP BY model""")
def _error_counts(spark, sf):
    return errors.error_counts(predictions(spark, sf), ("model",))


FB = FEEDBACK_SQL
WRONG = "prediction IS DISTINCT FROM user_label"


@query("feedback_summary", f"""WITH {FB} SELECT count(*) AS submissions, count(*) FILTER ({WRONG}) AS corrections,
  round((count(*) FILTER ({WRONG}))::DOUBLE / count(*), 9) AS error_rate,
  round(avg(severity), 9) AS avg_severity FROM feedback""")
def _fb_summary(spark, sf):
    return fbk.feedback_summary(feedback(spark, sf)).withColumns({
        "error_rate": F.round("error_rate", 9), "avg_severity": F.round("avg_severity", 9)})


@query("corrections_by_model", f"""WITH {FB} SELECT model_type, count(*) AS corrections FROM feedback
  WHERE {WRONG} GROUP BY model_type""")
def _fb_model(spark, sf):
    return fbk.corrections_by_model(feedback(spark, sf))


@query("correction_direction", f"""WITH {FB} SELECT concat_ws(' → ', prediction, user_label) AS direction,
  count(*) AS corrections FROM feedback WHERE {WRONG} GROUP BY 1""")
def _fb_direction(spark, sf):
    return fbk.correction_direction(feedback(spark, sf))


@query("severity_histogram", f"""WITH {FB}, b AS (SELECT CAST(floor(severity / 10) * 10 AS INT) AS bucket_lo
    FROM feedback WHERE {WRONG})
  SELECT bucket_lo, count(*) AS corrections, concat_ws('-', bucket_lo, bucket_lo + 9) AS bucket
  FROM b GROUP BY bucket_lo""")
def _fb_histogram(spark, sf):
    return fbk.severity_histogram(feedback(spark, sf))


@query("feedback_listing", f"""WITH {FB} SELECT ts AS Timestamp, model_type AS Model, prediction AS Prediction,
  user_label AS "User Label", severity AS Severity, comment AS Comment, input_text AS "Input Text"
  FROM feedback ORDER BY id DESC LIMIT 25""")
def _fb_listing(spark, sf):
    return fbk.feedback_listing(feedback(spark, sf), 25)


@query("resolve_label", f"""WITH {FB} SELECT id, CASE WHEN event_type = 'error' THEN
  CASE prediction WHEN 'HATE' THEN 'NON-HATE' ELSE 'HATE' END ELSE prediction END AS user_label FROM feedback""")
def _resolve(spark, sf):
    choice = F.when(F.col("event_type") == "error", F.col("user_label")).otherwise(MODEL_IS_CORRECT)
    return fbk.resolve_label(feedback(spark, sf).withColumn("choice", choice)).select(
        "id", "user_label")
