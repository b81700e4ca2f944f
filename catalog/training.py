"""Training runs whose weights SQL recomputes step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.operators import gradient
from moderata.operators.split import assign_folds, nested_split
from moderata.plans.training import run_tuned

from .datasets import SPLIT_SQL, h
from .evaluation import F1, HITS, RATES, THRESHOLDS
from .inputs import LABELLED_SQL, labelled
from .learning import GRAMS2, TERMS, WORDS
from .registry import query

EPOCHS = 3
OPTIONS = {"epochs": EPOCHS, "patience": EPOCHS + 1}
NESTED_SQL = f"""{SPLIT_SQL}, parts AS (SELECT doc_id, label AS y, CASE WHEN split = 'train' AND
    row_number() OVER (PARTITION BY label, split ORDER BY {h('42:val')}, doc_id)
    <= round_even(count(*) OVER (PARTITION BY label, split) * 0.1e0, 0) THEN 'val' ELSE split END AS part FROM halves)"""


def features_sql(max_features: int = TERMS) -> str:
    """x(doc_id, term, x): unit rows over the terms of the train rows."""
    return f"""{NESTED_SQL}, tok AS (SELECT doc_id, part, {WORDS} AS w FROM parts JOIN labelled USING (doc_id)),
  counts AS MATERIALIZED (SELECT doc_id, part, term, count(*) AS tf FROM (SELECT doc_id, part, unnest(w) AS term FROM tok
    UNION ALL SELECT doc_id, part, unnest({GRAMS2}) FROM tok) GROUP BY ALL),
  nt AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) AS n FROM parts WHERE part = 'train'),
  terms AS MATERIALIZED (SELECT term, ln((1e0 + any_value(n)) / (1e0 + count(*))) + 1e0 AS idf FROM counts, nt
    WHERE part = 'train' GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {max_features}),
  x AS MATERIALIZED (SELECT doc_id, term, a / sqrt(sum(a * a) OVER (PARTITION BY doc_id)) AS x
    FROM (SELECT doc_id, term, tf * idf AS a FROM counts JOIN terms USING (term)))"""


def factor_sql(step: int) -> float:
    return gradient.factor(step, EPOCHS, "linear")


def steps_sql(loss: str) -> str:
    """w0, w1, ...: weights (null term: intercept) after every step; f0, f1, ...: their macro-F1 on validation rows."""
    out = [features_sql(), """w0 AS (SELECT term, 0e0 AS w, 0e0 AS m, 0e0 AS v FROM terms UNION ALL SELECT NULL, 0e0, 0e0, 0e0)"""]
    over = "n" if loss == "focal" else "4e0 * n0 * n1 / (n0 + n1)"
    if loss == "focal":
        d = "-(CASE WHEN y = 1 THEN 0.75e0 ELSE 0.25e0 END) * s * (1 - pt) * (1 - pt) * (-2e0 * pt * ln(pt) + (1 - pt))"
    else:
        d = "-(CASE WHEN y = 1 THEN 2e0 * n0 ELSE 2e0 * n1 END / (n0 + n1)) * s * (1 - pt)"
    for e in range(EPOCHS + 1):
        out.append(f"""z{e} AS MATERIALIZED (SELECT doc_id, any_value(part) AS part, any_value(y) AS y,
    coalesce(sum(x * w), 0e0) + (SELECT w FROM w{e} WHERE term IS NULL) AS z
    FROM parts LEFT JOIN x USING (doc_id) LEFT JOIN w{e} USING (term) GROUP BY doc_id),
  f{e} AS (SELECT {e} AS e, coalesce(tp / nullif(2e0 * tp + fp + fn, 0), 0) + coalesce(tn / nullif(2e0 * tn + fp + fn, 0), 0) AS f
    FROM (SELECT count(*) FILTER (y = 1 AND z > 0) AS tp, count(*) FILTER (y = 0 AND z > 0) AS fp,
      count(*) FILTER (y = 1 AND z <= 0) AS fn, count(*) FILTER (y = 0 AND z <= 0) AS tn FROM z{e} WHERE part = 'val'))""")
        if e == EPOCHS:
            break
        rate = 0.05 * factor_sql(e + 1)
        out.append(f"""d{e} AS (SELECT doc_id, {d} AS d FROM (SELECT *, CASE WHEN y = 1 THEN 1e0 ELSE -1e0 END AS s,
      1e0 / (1e0 + exp(-(CASE WHEN y = 1 THEN 1e0 ELSE -1e0 END) * z)) AS pt FROM z{e} WHERE part = 'train'), nt),
  s{e} AS (SELECT term, sum(round(d * x * 17592186044416e0)::HUGEINT)::DOUBLE / 17592186044416e0 / any_value({over}) AS g
      FROM d{e} JOIN x USING (doc_id), nt GROUP BY term
    UNION ALL SELECT NULL, sum(round(d * 17592186044416e0)::HUGEINT)::DOUBLE / 17592186044416e0 / any_value({over}) FROM d{e}, nt),
  g{e} AS (SELECT term, g / greatest(1e0, sqrt(sum(g * g) OVER ())) AS g FROM s{e}),
  w{e + 1} AS MATERIALIZED (SELECT term, w * (1 - {rate!r} * 0.01e0) - {rate!r} * (m1 / (1 - 0.9e0 ** {e + 1}))
      / (sqrt(v1 / (1 - 0.999e0 ** {e + 1})) + 1e-8) AS w, m1 AS m, v1 AS v
    FROM (SELECT a.term, w, 0.9e0 * m + (1 - 0.9e0) * coalesce(g, 0e0) AS m1, 0.999e0 * v + (1 - 0.999e0) * coalesce(g, 0e0) * coalesce(g, 0e0) AS v1
      FROM w{e} a LEFT JOIN g{e} b ON a.term IS NOT DISTINCT FROM b.term))""")
    scores = " UNION ALL ".join(f"SELECT * FROM f{e}" for e in range(EPOCHS + 1))
    out.append(f"best AS (SELECT first(e ORDER BY f DESC, e) AS e FROM ({scores}))")
    chosen = " UNION ALL ".join(f"SELECT term, w FROM w{e} WHERE (SELECT e FROM best) = {e}" for e in range(EPOCHS + 1))
    out.append(f"chosen AS ({chosen})")
    return ", ".join(out)


def fitted(spark, sf, loss):
    split = nested_split(labelled(spark, sf), "label")
    return gradient.fit(gradient.feature_table(split), loss=loss, **OPTIONS)


@query("train_focal", f"WITH {steps_sql('focal')} SELECT term, round(w, 6) + 0e0 AS coef FROM chosen")
def _focal(spark, sf):
    return fitted(spark, sf, "focal").weights(spark).select("term", (F.round("coef", 6) + 0.0).alias("coef"))


@query("train_weighted", f"WITH {steps_sql('weighted')} SELECT term, round(w, 6) + 0e0 AS coef FROM chosen")
def _weighted(spark, sf):
    return fitted(spark, sf, "weighted").weights(spark).select("term", (F.round("coef", 6) + 0.0).alias("coef"))


def folds_sql() -> str:
    """z3(f, doc_id, fold, y, z): logits of every fold's model for all rows, after EPOCHS steps."""
    out = [f"""{LABELLED_SQL}, parts AS (SELECT doc_id, label AS y, CAST((row_number() OVER (PARTITION BY label
    ORDER BY {h('42:fold')}, doc_id) - 1) % 5 AS INT) AS fold FROM labelled),
  fs(f) AS (SELECT CAST(unnest(range(5)) AS INT)), tok AS (SELECT doc_id, fold, {WORDS} AS w FROM parts JOIN labelled USING (doc_id)),
  counts AS MATERIALIZED (SELECT doc_id, fold, term, count(*) AS tf FROM (SELECT doc_id, fold, unnest(w) AS term FROM tok
    UNION ALL SELECT doc_id, fold, unnest({GRAMS2}) FROM tok) GROUP BY ALL),
  nt AS (SELECT f, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) AS n FROM parts JOIN fs ON fold <> f GROUP BY f),
  terms AS MATERIALIZED (SELECT f, term, ln((1e0 + any_value(n)) / (1e0 + count(*))) + 1e0 AS idf FROM counts JOIN nt ON fold <> f
    GROUP BY f, term QUALIFY row_number() OVER (PARTITION BY f ORDER BY sum(tf) DESC, term) <= {TERMS}),
  x AS MATERIALIZED (SELECT f, doc_id, term, a / sqrt(sum(a * a) OVER (PARTITION BY f, doc_id)) AS x
    FROM (SELECT f, doc_id, term, tf * idf AS a FROM counts JOIN terms USING (term))),
  w0 AS (SELECT f, term, 0e0 AS w, 0e0 AS m, 0e0 AS v FROM terms UNION ALL SELECT f, NULL, 0e0, 0e0, 0e0 FROM fs)"""]
    for e in range(EPOCHS + 1):
        out.append(f"""z{e} AS MATERIALIZED (SELECT f, doc_id, any_value(fold) AS fold, any_value(y) AS y,
    coalesce(sum(x * w.w), 0e0) + any_value(b.w) AS z FROM parts CROSS JOIN fs JOIN (SELECT f, w FROM w{e} WHERE term IS NULL) b USING (f)
    LEFT JOIN x USING (f, doc_id) LEFT JOIN w{e} w USING (f, term) GROUP BY f, doc_id)""")
        if e == EPOCHS:
            break
        rate = 0.05 * factor_sql(e + 1)
        out.append(f"""d{e} AS (SELECT f, doc_id, -(CASE WHEN y = 1 THEN 2e0 * n0 ELSE 2e0 * n1 END / (n0 + n1)) * s
      * (1 - 1e0 / (1e0 + exp(-s * z))) AS d FROM (SELECT *, CASE WHEN y = 1 THEN 1e0 ELSE -1e0 END AS s FROM z{e} WHERE fold <> f) JOIN nt USING (f)),
  s{e} AS (SELECT f, term, sum(round(d * x * 17592186044416e0)::HUGEINT)::DOUBLE AS g FROM d{e} JOIN x USING (f, doc_id) GROUP BY f, term
    UNION ALL SELECT f, NULL, sum(round(d * 17592186044416e0)::HUGEINT)::DOUBLE FROM d{e} GROUP BY f),
  o{e} AS (SELECT f, term, g / 17592186044416e0 / (4e0 * n0 * n1 / (n0 + n1)) AS g FROM s{e} JOIN nt USING (f)),
  g{e} AS (SELECT f, term, g / greatest(1e0, sqrt(sum(g * g) OVER (PARTITION BY f))) AS g FROM o{e}),
  w{e + 1} AS MATERIALIZED (SELECT f, term, w * (1 - {rate!r} * 0.01e0) - {rate!r} * (m1 / (1 - 0.9e0 ** {e + 1}))
      / (sqrt(v1 / (1 - 0.999e0 ** {e + 1})) + 1e-8) AS w, m1 AS m, v1 AS v
    FROM (SELECT a.f, a.term, w, 0.9e0 * m + (1 - 0.9e0) * coalesce(g, 0e0) AS m1, 0.999e0 * v + (1 - 0.999e0) * coalesce(g, 0e0) * coalesce(g, 0e0) AS v1
      FROM w{e} a LEFT JOIN g{e} b ON a.f = b.f AND a.term IS NOT DISTINCT FROM b.term))""")
    return ", ".join(out)


@query("cv_gradient", f"""WITH {folds_sql()}, scored AS (SELECT fold, y AS y_true, 1e0 / (1e0 + exp(-z)) AS prob FROM z{EPOCHS} WHERE f = fold),
  c AS (SELECT fold, count(*) AS rows, round(avg(prob), 6) AS mean_prob, {HITS.replace("y_pred = 0", "prob < 0.5e0").replace("y_pred = 1", "prob >= 0.5e0")}
    FROM scored GROUP BY fold)
  SELECT fold, rows, mean_prob, tn, fp, fn, tp FROM c""")
def _cv_gradient(spark, sf):
    """Out-of-fold confusion and mean probability of five models that one pass a step fits together."""
    found = gradient.fold_features(assign_folds(labelled(spark, sf), label="label"))
    scored = gradient.out_of_fold(found, gradient.fit_folds(found, epochs=EPOCHS))
    hit, true = F.col("prob") >= 0.5, F.col("y_true") == 1
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.count_if(~hit & ~true).alias("tn"),
        F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(hit & true).alias("tp"))


SCORED = " UNION ALL ".join(
    f"SELECT part, y AS y_true, 1e0 / (1e0 + exp(-z)) AS prob FROM z{e} WHERE (SELECT e FROM best) = {e}" for e in range(EPOCHS + 1))
AT = HITS.replace("y_pred = 0", "prob < threshold").replace("y_pred = 1", "prob >= threshold")


@query("tuned_run", f"""WITH {steps_sql('weighted')}, scored AS MATERIALIZED ({SCORED}), t(threshold) AS (VALUES {THRESHOLDS}),
  c AS (SELECT threshold, {AT} FROM scored, t WHERE part = 'val' GROUP BY threshold),
  tuned AS (SELECT max(f) AS best_hate_f1, CASE WHEN max(f) > 0 THEN first(threshold ORDER BY f DESC, threshold) ELSE 0.5e0 END AS threshold
    FROM (SELECT threshold, {F1} AS f FROM c)),
  held AS (SELECT any_value(threshold) AS threshold, any_value(best_hate_f1) AS best_hate_f1, {AT} FROM scored, tuned WHERE part = 'test')
  SELECT threshold, best_hate_f1, tn, fp, fn, tp, {RATES} FROM held""")
def _tuned(spark, sf):
    """The threshold of the validation rows, and the test rows' metrics at it."""
    run = run_tuned(labelled(spark, sf), "doc_id", loss="weighted", **OPTIONS)
    best = run.best.select(F.col("effective_threshold").alias("threshold"), "best_hate_f1", "model")
    return run.metrics.join(F.broadcast(best), "model").drop("model")


@query("tuned_predictions", f"""WITH {steps_sql('focal')}, scored AS ({SCORED.replace("SELECT part", "SELECT doc_id, part")})
  SELECT doc_id, y_true, round(prob, 6) AS prob FROM scored WHERE part = 'test'""")
def _tuned_predictions(spark, sf):
    run = run_tuned(labelled(spark, sf), "doc_id", loss="focal", **OPTIONS)
    return run.predictions.select("doc_id", "y_true", F.round("prob", 6).alias("prob"))
