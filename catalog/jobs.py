"""Whole jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.operators.split import stratified_split
from moderata.plans import jobs
from moderata.plans.training import load_and_split
from moderata.sources.workspace import new_folder

from . import duck
from .datasets import SPLIT_SQL, groups_sql
from .inputs import documents, feedback, labelled, table
from .learning import conversation_sql, trained
from .registry import ORACLES, query


def by_length():
    """A scorer that SQL can repeat: the length of the text, modulo 100, in hundredths."""
    def predict(texts):
        import numpy as np

        return np.array([len(t) % 100 / 100.0 for t in texts])
    return predict


PROB = "(length(cleaned) % 100) / 100.0e0"


@query("batch_job", f"""WITH lines AS ({ORACLES["explode_lines"]}),
  c AS (SELECT {duck.clean("line")} AS cleaned FROM lines), p AS (SELECT {PROB} AS prob, length(cleaned) % 100 AS sev FROM c)
  SELECT count(*) AS total, count(*) FILTER (prob > 1 - prob) AS hate,
    round(count(*) FILTER (prob > 1 - prob) * 100.0e0 / count(*), 9) AS hate_pct,
    round(avg(sev::DOUBLE), 9) AS avg_severity FROM p""")
def _batch_job(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text")
    return jobs.batch_job(rows, by_length, new_folder(spark, "batch")).withColumns({
        "hate_pct": F.round("hate_pct", 9), "avg_severity": F.round("avg_severity", 9)})


@query("context_scores", f"""WITH c AS ({conversation_sql("conversations", "conv_id", "turn")})
  SELECT conv_id, turn, (length(context_text) % 100) / 100.0e0 AS prob FROM c""")
def _context_scores(spark, sf):
    out = jobs.score_in_context(table(spark, sf, "conversations"), by_length, "conv_id", "turn")
    return out.select("conv_id", "turn", "prob")


@query("load_and_split", f"""WITH l AS (SELECT text, CASE WHEN lang IS NULL THEN NULL WHEN lower(lang) IN ('en', 'de') THEN 1
    ELSE 0 END AS label FROM documents WHERE regexp_matches(coalesce(text, ''), '{duck.NON_WS}')), keyed AS (SELECT *, sha256({duck.key("text")}) AS text_key FROM l WHERE label IS NOT NULL),
  {groups_sql("keyed", "label", "text_key", 42)}
  SELECT text, label, CASE WHEN before < round_even(total * 0.2e0, 0) THEN 'test' ELSE 'train' END AS split
  FROM keyed JOIN ranks ON key = text_key""")
def _load_and_split(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text", "lang")
    return load_and_split(rows, "text", "lang", ("en", "de")).select("text", "label", "split")


@query("retrain", f"""WITH {SPLIT_SQL} SELECT model, count(*) AS rows, count(*) FILTER (label = 1) AS positives, true AS rates_fit
  FROM halves, (VALUES ('old'), ('new')) AS m(model) WHERE split = 'test' GROUP BY model""")
def _retrain(spark, sf):
    """The held-out rows that both models were compared on, and whether their rates follow from the counts."""
    halves = stratified_split(labelled(spark, sf), "label")
    train, test = (halves.filter(F.col("split") == s) for s in ("train", "test"))
    _, compared = jobs.retrain_from_corrections(
        train.select("text", "label"), feedback(spark, sf), test.select("doc_id", "text", "label"),
        trained(spark, sf, train))
    n = F.expr("tn + fp + fn + tp")
    return compared.select("model", n.alias("rows"), F.expr("tp + fn").alias("positives"),
                           (F.abs(F.col("accuracy") - F.expr("tn + tp") / n) < 1e-9).alias("rates_fit"))
