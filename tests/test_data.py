"""Sources, deduplication, merging and splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from moderata.functions.labels import map_codes, strict_binary
from moderata.functions.ranges import order_statistic, range_bounds, with_range
from moderata.operators import merge, split
from moderata.operators.dedup import dedup_clean, dedup_clean_report, dedup_first
from moderata.plans.training import load_and_split, load_training
from moderata.sources import reports, roles, tables


def test_csv_with_newlines_quotes_and_missing_words(spark, tmp_path):
    path = str(tmp_path / "posts.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write('text,label\n"a ""quoted""\nsecond line, é",1\nNA,0\nplain,null\n"",1\n')
    got = [tuple(r) for r in tables.read_posts(spark, path).collect()]
    assert got == [('a "quoted"\nsecond line, é', "1"), (None, "0"), ("plain", None), (None, "1")]
    raw = [tuple(r) for r in tables.read_posts(spark, path, na_tokens=()).collect()]
    assert raw[1:3] == [("NA", "0"), ("plain", "null")]
    with pytest.raises(Exception):
        tables.read_posts(spark, str(tmp_path / "absent.csv")).count()


def test_csv_round_trip_and_landed_order(spark, tmp_path):
    texts = ['x "y"', "a\nb", "c,d", "", " lead", "back\\slash", "é 😡", None]
    for i, name in enumerate(("b part.csv", "a.csv")):
        df = spark.createDataFrame([(t, str(i)) for t in texts], "text string, label string")
        tables.write_table(df, str(tmp_path / f"t{i}"), "csv", single_file=True)
        made = next((tmp_path / f"t{i}").glob("*.csv"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(made.read_bytes())
    back = tables.read_posts(spark, str(tmp_path / "in"), na_tokens=())
    landed = tables.land_posts(back, str(tmp_path / "landed")).orderBy("row_id").collect()
    assert [r["text"] for r in landed] == texts * 2
    assert [r["label"] for r in landed] == ["1"] * 8 + ["0"] * 8  # files by name
    assert [r["row_id"] for r in landed] == list(range(16))


def test_landed_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, first in (("b.csv", 20_000), ("a.csv", 0)):
        (tmp_path / "in" / name).write_text("".join(f"{i},row {i}\n" for i in range(first, first + 20_000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        scan = spark.read.schema("n bigint, text string").csv(str(tmp_path / "in"))
        assert scan.rdd.getNumPartitions() > 10
        landed = tables.land_posts(scan, str(tmp_path / "landed"))
        assert landed.filter("n <> row_id").count() == 0 and landed.count() == 40_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_roles(spark):
    df = spark.createDataFrame([("a", "b", "c")], " Tweet_TEXT string, Class string, x string")
    assert [c.strip() for c in roles.infer_roles(df)] == ["Tweet_TEXT", "Class"]
    with pytest.raises(ValueError):
        roles.infer_roles(df.select("x"))
    with pytest.raises(ValueError):
        roles.infer_roles(spark.createDataFrame([("a",)], "text_label string"))
    with pytest.raises(ValueError, match="the table lacks"):
        roles.standardize(df, "nope", "Class")


def two_sources(spark, shuffle=None):
    a = [(0, "Hello  World", "1", "en"), (1, " hello world ", "0", None), (2, "  ", "1", "en"),
         (3, "other", "0", " hi ")]
    b = [(0, "HELLO WORLD", "bad label", ), (1, "new one", "'HS1'"), (2, None, "HS0"),
         (3, "new  ONE", "hs0"), (4, "third", " hsn ")]
    if shuffle is not None:
        random.Random(shuffle).shuffle(a)
        random.Random(shuffle).shuffle(b)
    return [
        merge.Source("a", spark.createDataFrame(a, "row_id long, text string, l string, g string"),
                     "text", "l", strict_binary, "g"),
        merge.Source("b", spark.createDataFrame(b, "row_id long, Comment string, Label string"),
                     "Comment", "Label", map_codes),
    ]


def test_merge_keeps_first_and_ignores_bad_labels_of_copies(spark):
    want = [("Hello  World", 1, "a", "1", "en"), ("new one", 1, "b", "'HS1'", ""),
            ("other", 0, "a", "0", "hi"), ("third", 1, "b", " hsn ", "")]
    for seed in (None, 1, 2):
        got = merge.merge_sources(two_sources(spark, seed)).collect()
        assert sorted(tuple(r) for r in got) == want


def test_merge_report_adds_up(spark, tmp_path):
    rep = merge.merge_report(two_sources(spark))
    rows = {r["source_dataset"]: r.asDict() for r in rep.collect()}
    for r in rows.values():
        assert r["total_rows"] == r["kept_rows"] + r["dropped_duplicates"] + r["dropped_empty_text"]
        assert r["kept_rows"] == r["label_0"] + r["label_1"]
    assert rows["merged"]["total_rows"] == 9 and rows["merged"]["kept_rows"] == 4
    assert rows["b"]["dropped_duplicates"] == 2 and rows["b"]["dropped_empty_text"] == 1
    reports.write_json_report(rep, str(tmp_path / "r"), omit_zeros=True)
    lines = [json.loads(x[0]) for x in spark.read.text(str(tmp_path / "r")).collect()]
    assert "label_0" not in next(x for x in lines if x["source_dataset"] == "b")


def test_bad_label_on_a_kept_row_fails(spark):
    s = two_sources(spark)
    bad = s[1].df.withColumn("Label", F.lit("XX"))
    with pytest.raises(Exception, match="Unexpected label code"):
        merge.merge_sources([s[0], merge.Source("b", bad, "Comment", "Label", map_codes)]).collect()


def test_dedup_with_a_hot_key_is_order_stable(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(600)]
    want = sorted([1] + [i for i in range(0, 600, 3)])
    for parts in (1, 4, 32):
        random.Random(parts).shuffle(rows)
        df = spark.createDataFrame(rows, "id long, t string").repartition(parts)
        for exact in (False, True):
            got = dedup_first(df, F.col("t"), "id", exact).collect()
            assert sorted(r["id"] for r in got) == want


def test_dedup_clean_drops_empty(spark):
    rows = [(0, "@only"), (1, "Haaate!!"), (2, "haate!"), (3, None), (4, "b")]
    df = spark.createDataFrame(rows, "id long, text_raw string")
    got = sorted((r["id"], r["text"]) for r in dedup_clean(df, "id").collect())
    assert got == [(1, "hate <excl>"), (4, "b")]
    assert tuple(dedup_clean_report(df).first()) == (3, 2, 1)


def test_load_training(spark):
    rows = [(0, "the cat!", "2"), (1, "THE CAT!!", "0"), (2, None, "1"), (3, "http://x", "1"),
            (4, "plain", "0"), (5, "x", None)]
    out = load_training(spark.createDataFrame(rows, "row_id long, tweet_text string, class string"))
    got = sorted((r["row_id"], r["text"], r["label"], r["is_hinglish"]) for r in out.collect())
    assert got == [(0, "the cat <excl>", 1, True), (4, "plain", 0, False)]


def test_loader_demo_counts(spark):
    data = [("t%d" % i, s) for i, s in enumerate(
        ["clean", "hate", "clean", "hate", "clean", "offensive", "clean", "hate"])]
    rows = [*data, (None, "clean"), ("", "clean")]
    out = load_and_split(spark.createDataFrame(rows, "tweet string, sentiment string"),
                         "tweet", "sentiment", ["hate", "offensive", "abusive"])
    assert out.count() == 8 and out.filter("label = 1").count() == 4


def test_corrections_latest_wins_and_survive_replay(spark):
    train = spark.createDataFrame([("A b", 0), ("keep", 1), ("a  B", 0)], "text string, label int")
    fb = [(1, "a b", "NON-HATE", "HATE"), (3, "A B", "HATE", "NON-HATE"), (2, "new", "HATE", "NON-HATE"),
          (9, "keep", "HATE", "HATE")]
    fb = spark.createDataFrame(fb * 2, "id long, input_text string, prediction string, user_label string")
    out = merge.apply_corrections(train, merge.latest_corrections(fb))
    assert sorted(tuple(r) for r in out.collect()) == [
        ("A b", 0, True), ("a  B", 0, True), ("keep", 1, False), ("new", 0, True)]


def test_splits(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "cast(id % 10 = 0 AS int) AS label")
    a = split.stratified_split(df, "label", 0.15, exact=False)
    share = {r["label"]: r["f"] for r in a.groupBy("label").agg(
        F.avg((F.col("split") == "test").cast("int")).alias("f")).collect()}
    assert abs(share[0] - 0.15) < 0.03 and abs(share[1] - 0.15) < 0.06
    exact = split.stratified_split(df, "label", 0.15, exact=True)
    n = {(r["label"], r["split"]): r["n"] for r in split.split_summary(exact, "label").collect()}
    assert n[(0, "test")] == 540 and n[(1, "test")] == 60
    again = split.stratified_split(df.repartition(7), "label", 0.15, exact=True)
    assert exact.exceptAll(again).count() == 0
    folds = {r["fold"]: r["count"] for r in split.assign_folds(df).groupBy("fold").count().collect()}
    assert set(folds) == set(range(5)) and sum(folds.values()) == 4000
    even = split.assign_folds(df, label="label").groupBy("label", "fold").count().groupBy("label").agg(
        F.count("fold").alias("k"), (F.max("count") - F.min("count")).alias("gap")).collect()
    assert all(r["k"] == 5 and r["gap"] <= 1 for r in even)
    nested = split.split_summary(split.nested_split(df, "label"), "label").collect()
    assert {r["split"] for r in nested} == {"train", "val", "test"} and sum(r["n"] for r in nested) == 4000
    assert split.assign_folds(df, 1).filter("fold IS NOT NULL").count() == 0
    assert split.sample_n(df, 123).count() == 123
    assert split.sample_n(df, 9999).count() == 4000
    assert split.sample_n(df, 0).count() == 0
    assert split.ordered_split(df, "doc_id").filter("split = 'train'").count() == 3200


def test_order_statistic_and_ranges(spark):
    rng = random.Random(5)
    values = sorted({rng.randrange(-10**15, 10**15) for _ in range(500)} | {2**60 + i for i in range(200)})
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 7, 350, len(values)):
        assert order_statistic(df, "v", k, parts=16) == values[k - 1]
    assert order_statistic(df, "v", len(values) + 1) is None
    bounds = range_bounds(df, "v", 8)
    assert 2 <= len(bounds) <= 7
    got = with_range(df, "v", bounds, "r").orderBy("v").collect()
    assert [r["r"] for r in got] == sorted(r["r"] for r in got)


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    """A task's rows go to several files, as each file is read by one task; a single file stays one."""
    monkeypatch.setattr(tables, "CSV_ROWS", 40)
    df = spark.range(100).selectExpr("concat('a \"b\"\n', id) AS text", "CAST(id AS STRING) AS label").coalesce(1)
    for name, single in (("many", False), ("one", True)):
        tables.write_table(df, f"{tmp_path}/{name}", "csv", single_file=single)
        assert len(list((tmp_path / name).glob("part-*"))) == (1 if single else 3)
        back = tables.read_posts(spark, f"{tmp_path}/{name}", na_tokens=())
        assert back.count() == 100 and back.exceptAll(df).count() == 0
