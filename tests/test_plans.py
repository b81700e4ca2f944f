"""The whole baseline run, and properties of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from catalog.inputs import labelled, predictions
from moderata.operators import curves, metrics, split
from moderata.operators.dedup import dedup_first
from moderata.plans.training import run_baseline

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_baseline(spark, tmp_path):
    df = labelled(spark, SF).select(F.col("doc_id").alias("row_id"), "text", "label")
    run = run_baseline(df, folds=2, test_frac=0.3, max_features=500, max_iter=10)
    m = run.metrics.first()
    assert m["model"] == "baseline_word"
    assert m["tn"] + m["fp"] + m["fn"] + m["tp"] == run.predictions.count()
    assert run.cv.count() == 1 and run.areas.count() == 1
    assert {r["slice"] for r in run.slices.collect()} >= {"all"}
    assert run.errors.columns[0] == "doc_id"
    assert run.report.count() == 5 and run.best.count() == run.error_totals.count() == 1
    run.save(str(tmp_path / "run"))
    saved = {p.name for p in (tmp_path / "run").iterdir()}
    assert saved == {"metrics", "areas", "slices", "report", "sweep", "best", "error_totals", "cv",
                     "roc", "pr", "errors", "predictions"}


def test_no_exchange_of_rows_on_a_hot_column(spark):
    pred = predictions(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (curves.roc_curve(pred), curves.pr_curve(pred)):
            text = plan(df)
            joins = [line for line in text.splitlines() if "SortMergeJoin" in line and "model" in line]
            assert joins and all("rng" in line for line in joins), text
        assert not re.search(r"hashpartitioning\(y_true#\d+, \d", plan(split.stratified_split(pred, "y_true")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_cross_joins_and_no_single_task_windows(spark):
    pred = predictions(spark, SF)
    for df in (curves.roc_curve(pred), curves.pr_curve(pred), curves.areas(pred),
               metrics.threshold_sweep(pred), metrics.slice_metrics(pred, "source"),
               dedup_first(pred, F.col("text_raw"), "doc_id"),
               split.stratified_split(pred, "y_true", exact=True)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
        assert "SinglePartition" not in text


def test_narrow_operators_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from moderata.operators.features import add_terms, doc_terms
    from moderata.operators.prepare import preprocess

    for df in (preprocess(docs, "text"), split.stratified_split(docs, "lang", exact=False),
               split.assign_folds(docs), doc_terms(add_terms(docs))):
        assert "Exchange" not in plan(df)


def test_scans_read_only_what_they_need(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(split.assign_folds(docs).groupBy("fold").count())
    assert "ReadSchema: struct<doc_id:bigint>" in text


@pytest.mark.parametrize("partitions", ["1", "4", "32"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pred = predictions(spark, SF).repartition(int(partitions))
        got = sorted(map(tuple, curves.roc_curve(pred).collect()))
        sweep = sorted(map(tuple, metrics.threshold_sweep(pred).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(map(tuple, curves.roc_curve(predictions(spark, SF), parts=3).collect()))
    assert sweep == sorted(map(tuple, metrics.threshold_sweep(predictions(spark, SF)).collect()))
