"""Cleaner, labels and scalar functions against hand-derived values."""

import pytest
from pyspark.sql import functions as F

from moderata.functions import labels as L
from moderata.functions import scores as S
from moderata.functions import text as T
from moderata.operators.prepare import preprocess

# raw, cleaned, cleaned with emoji tokens, code-mixed
GOLDEN = [
    ("Zoom call with @anna92 at https://a.example/p #Whaaat yaar?! 😀😀", "zom call with at what yar <ques> <excl>",
     "zom call with at what yar <ques> <excl> <emoji> <emoji>", True),
    ("Weekly notes www.site.test/page #OpenDoors_2 @k", "wekly notes opendors_2", "wekly notes opendors_2", False),
    ("नदी बहुत शांत है??? 🚀 #Subah", "नदी बहुत शांत है <ques> subah", "नदी बहुत शांत है <ques> <emoji> subah", True),
    ("kya scene hai bhai, jaldi batao!!", "kya scene hai bhai jaldi batao <excl>",
     "kya scene hai bhai jaldi batao <excl>", True),
    ("hmmmm that was sloooow and niiiice", "hmm that was slow and nice", "hmm that was slow and nice", False),
    ("grrrr my bus left earrrrly!!! 😕", "grr my bus left earrly <excl>",
     "grr my bus left earrly <excl> <emoji>", False),
    ("A calm sentence about boats", "a calm sentence about boats", "a calm sentence about boats", False),
    ("#शहर में dinner at nine 🎉🎉", "शहर में dinner at nine", "शहर में dinner at nine <emoji> <emoji>", True),
    ("the", "the", "the", False),
    ("the cat", "the cat", "the cat", True),
    (None, "", "", False),
    ("    ", "", "", False),
]


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def test_golden_cleaner(spark):
    df = spark.createDataFrame([(g[0],) for g in GOLDEN], "raw string").select(
        T.clean_text(F.col("raw")), T.clean_text(F.col("raw"), keep_emojis=True),
        T.is_code_mixed(F.col("raw")))
    assert [tuple(r) for r in df.collect()] == [g[1:] for g in GOLDEN]


def test_fused_cleaner_equals_its_steps(spark):
    awkward = ["@http://x foo", "#@a#b", "@#tag", "##b", "a!?!b", "<<!!!", "wwwx @www.y", "AaAa ooO",
               "x\n\n\n\ny", "...!!!...", "é́é́é́", "😡😡😡😡", "a b\u0085c", "!!\n!!", "❶❶❶❶ #❶x",
               "@नदी ठीक", "http x", "a\x1cb", "bookkeeper", "???!!!???", "_<>_", ""]
    df = spark.createDataFrame([(a,) for a in awkward], "c string")
    c = F.col("c")
    for emojis in (False, True):
        for runs in (False, True):
            for marks in (False, True):
                kw = dict(keep_emojis=emojis, normalize_repeated=runs, keep_emphasis=marks)
                pairs = df.select("c", T.clean_text(c, **kw), T.clean_steps(c, **kw)).collect()
                assert [r[1] for r in pairs] == [r[2] for r in pairs], kw


def test_cleaner_alphabet(spark):
    raw = "".join(chr(i) for i in range(1, 0x3000) if chr(i).isprintable())
    out = one(spark, raw, T.clean_text)
    assert not set(out) - set("abcdefghijklmnopqrstuvwxyz0123456789<>_ ") - {
        chr(i) for i in range(0x900, 0x980)}


def test_runs_and_profiles(spark):
    assert one(spark, "aaaa!!!!\n\n\n", T.collapse_runs) == "aa!!\n\n\n"
    assert one(spark, "aaaaa", lambda c: T.collapse_runs(c, 3)) == "aaa"
    assert one(spark, "a.b!c", lambda c: T.clean_text(c, profile="basic")) == "abc"
    assert one(spark, "a.b", T.clean_text) == "a b"
    with pytest.raises(ValueError):
        T.charset(F.lit(""), "other")


def test_stats_preview_key(spark):
    assert one(spark, " a b  c ", T.word_count) == 3
    assert one(spark, "😡é", T.char_count) == 2
    assert one(spark, None, T.word_count) == 0
    assert one(spark, "x" * 61, T.preview) == "x" * 60 + "…"
    assert one(spark, "x" * 60, T.preview) == "x" * 60
    assert one(spark, "  Ab   C\n", T.text_key) == "ab c"
    assert one(spark, None, T.text_key) == ""


def test_preprocess_names_and_errors(spark):
    df = spark.createDataFrame([("the cat",)], "t string")
    assert preprocess(df, "t").columns == ["t", "t_cleaned", "is_hinglish"]
    assert preprocess(df, "t", tag=False).columns == ["t", "t_cleaned"]
    with pytest.raises(ValueError):
        preprocess(df, "nope")


def test_label_maps(spark):
    rows = [("1",), ("1.0",), ("HATE",), ("hate speech",), (None,)]
    got = spark.createDataFrame(rows, "l string").select(L.binarize(F.col("l"))).collect()
    assert [r[0] for r in got] == [1, 0, 1, 0, None]
    assert one(spark, "'HS1'", L.map_codes) == 1
    assert one(spark, " hsn ", L.map_codes) == 1
    assert one(spark, "hs0", L.map_codes) == 0
    assert one(spark, "XX", lambda c: L.map_codes(c, on_unknown="zero")) == 0
    assert one(spark, "XX", lambda c: L.map_codes(c, on_unknown="drop")) is None
    for bad in (lambda c: L.map_codes(c), L.strict_binary, L.binarize_int):
        with pytest.raises(Exception):
            one(spark, "XX", bad)
    assert one(spark, " 1 ", L.strict_binary) == 1
    assert one(spark, "2", L.binarize_int) == 1


def test_severity_and_routes(spark):
    rows = [(p,) for p in (0.005, 0.125, 0.135, 0.5, 1.0)]
    got = spark.createDataFrame(rows, "p double").select(S.severity(F.col("p"))).collect()
    assert [r[0] for r in got] == [0, 12, 14, 50, 100]
    steps = spark.createDataFrame([(s,) for s in (0, 19, 20, 21, 49, 50, 51, 79, 80, 81)], "s int")
    got = steps.select(S.band(F.col("s")), S.route(F.col("s"))).collect()
    assert [r[0] for r in got] == ["safe"] * 3 + ["mild"] * 3 + ["likely"] * 2 + ["extreme"] * 2
    assert [r[1] for r in got] == (["none"] * 2 + ["log"] * 3 + ["human_review"] * 4
                                   + ["auto_remove"])
