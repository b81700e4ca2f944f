"""Features, model, context and explanations."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moderata.operators import context, explain, features, model
from moderata.operators.context import with_context

TEXTS = ["the cat sat", "the cat ran fast", "a dog ran", "cat cat dog", "the the the", "", "dog fast"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Ab a bcd_1 é2 मोदी", ), (None,)], "text string")
    got = df.select(features.tokens(F.col("text"))).collect()
    assert [r[0] for r in got] == [["ab", "bcd_1", "é2"], []]
    w = spark.createDataFrame([(["ab", "cd", "ab"],), (["ab"],), ([],)], "w array<string>")
    got = [r[0] for r in w.select(features.ngrams(F.col("w"), 1, 3)).collect()]
    assert got == [["ab", "cd", "ab", "ab cd", "cd ab", "ab cd ab"], ["ab"], []]
    stop = w.select(features.remove_stop(F.col("w"), ["cd"])).first()[0]
    assert stop == ["ab", "ab"]
    assert "the" in features.default_stop_words()


def char_reference(text, lo, hi):
    out = []
    for n in range(lo, hi + 1):
        for word in text.lower().split():
            p = f" {word} "
            if len(p) < n:
                out += [p] if n == lo else []
            else:
                out += [p[i:i + n] for i in range(len(p) - n + 1)]
    return out


@pytest.mark.parametrize("lo, hi", [(3, 5), (2, 2), (5, 6), (3, 3)])
def test_char_ngrams(spark, lo, hi):
    texts = ["Hi  abc\ta", "😡a b😡c 😡😡", "", "x", "यह है"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(features.char_ngrams(F.col("t"), lo, hi)).collect()]
    assert [sorted(g) for g in got] == [sorted(char_reference(t, lo, hi)) for t in texts]


def tfidf_reference(max_df=1.0, min_df=1):
    docs = [t.split() for t in TEXTS]
    docs = [[w for w in d if len(w) > 1] for d in docs]
    n = len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items() if min_df <= c <= max_df * n}
    out = {}
    for i, d in enumerate(docs):
        raw = {w: d.count(w) * idf[w] for w in set(d) if w in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, w): v / norm for w, v in raw.items()})
    return out


def test_tfidf_vector_path_equals_joined_path_and_definition(docs):
    terms = features.add_terms(docs, "text", 1, 1)
    counts = {(r["doc_id"], r["term"]): r["tf"] for r in features.doc_terms(terms).collect()}
    assert counts[(3, "cat")] == 2 and counts[(4, "the")] == 3 and len(counts) == 14
    for kw in ({"min_df": 1, "max_df": 1.0}, {"min_df": 2, "max_df": 0.5}):
        want = tfidf_reference(kw["max_df"], kw["min_df"])
        voc = features.vocab(terms, len(TEXTS), **kw)
        for bound in (50, None):
            got = {(r["doc_id"], r["term"]): r["weight"] for r in features.tfidf(
                terms, voc, max_features=bound).collect()}
            assert got == pytest.approx(want, abs=1e-12)


def test_vocabulary_limit_breaks_ties_by_term(docs):
    terms = features.add_terms(docs, "text", 1, 1)
    top = features.vocab(terms, len(TEXTS), 1, 1.0, 3).collect()
    assert [(r["term"], r["cnt"]) for r in top] == [("the", 5), ("cat", 4), ("dog", 3)]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert {r["label"]: r["weight"] for r in model.class_weights(df).collect()} == {0: 4 / 6, 1: 2.0}
    assert {r["label"]: r["weight"] for r in model.class_weights(df, kind="inverse").collect()} == {
        0: pytest.approx(0.5), 1: pytest.approx(1.5)}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(120):
        bad = i % 3 == 0
        words = ["you are vile trash", "go away vile scum"][i % 2] if bad else ["nice sunny day", "good day friend"][i % 2]
        rows.append((i, f"{words} w{i % 7} z{i % 5}", int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_regression_reaches_the_optimum(spark, labelled):
    fitted = model.train_baseline(labelled, hi=1, tol=1e-10, max_iter=500)
    voc = {r["term"]: (r["idf"], r["coef"]) for r in fitted.weights(spark).collect()}
    rows = labelled.collect()
    n, names = len(rows), sorted(voc)
    x = np.zeros((n, len(names)))
    for i, r in enumerate(rows):
        for w in r["text"].split():
            x[i, names.index(w)] += voc[w][0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r["label"] for r in rows])
    coef = np.array([voc[t][1] for t in names])
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    p = 1 / (1 + np.exp(-(x @ coef + fitted.intercept)))
    # Gradient of |w|^2/2 + sum(weight * logloss), for weights and intercept.
    assert np.abs(coef + x.T @ (weight * (p - y))).max() < 1e-3
    assert abs((weight * (p - y)).sum()) < 1e-3
    probs = {r["doc_id"]: r["prob"] for r in fitted.transform(labelled).collect()}
    assert max(abs(probs[r["doc_id"]] - p[i]) for i, r in enumerate(rows)) < 1e-9


def test_save_load_score(spark, labelled, tmp_path):
    fitted = model.train_baseline(labelled, char=True, hi=3, max_features=300, stop=["are"], clean=True)
    model.save_model(fitted, str(tmp_path / "m"))
    again = model.load_model(spark, str(tmp_path / "m"))
    assert again.settings == fitted.settings
    raw = spark.createDataFrame([(1, "You are VILE trash!!! http://x"), (2, "nice sunny day")],
                                "doc_id long, text string")
    a, b = (model.score_batch(m, raw).orderBy("doc_id").collect() for m in (fitted, again))
    assert a == b
    assert [r["prediction"] for r in a] == ["HATE", "NON-HATE"]
    assert a[0]["preview"] == "You are VILE trash!!! http://x"
    # Scoring reads a text as training did: doubled vowels and links play no part.
    noisy = labelled.withColumn("text", F.concat(F.replace("text", F.lit("oo"), F.lit("ooooo")), F.lit(" http://x")))
    plain, other = ({r["doc_id"]: r["prob"] for r in rows.collect()} for rows in (
        fitted.transform(labelled), model.score_batch(again, noisy)))
    assert plain == pytest.approx(other, abs=1e-12)
    with pytest.raises(ValueError, match="labels"):
        model.train_baseline(labelled.withColumn("label", F.lit(2)))


def test_cross_validation_covers_every_row_once(labelled):
    pred = model.cross_validate(labelled, 3, max_iter=20)
    assert pred.count() == 120 and pred.select("doc_id").distinct().count() == 120
    assert pred.filter("y_pred = y_true").count() > 110


def test_external_scorer(spark):
    def make():
        def predict(texts):
            return np.array([float(len(t)) for t in texts])
        return predict

    df = spark.createDataFrame([("abc",), ("",)], "text string")
    assert sorted(r["prob"] for r in model.score_with(df, make).collect()) == [0.0, 3.0]


@pytest.mark.parametrize("hot_rows", [5, 10**6])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_context_of_hot_and_cold_keys(spark, hot_rows, n):
    rows = [("hot", i * 7, None if i % 11 == 0 else f"h{i}" if i % 5 else " ") for i in range(200)]
    rows += [(f"c{j}", i, f"{j}.{i}") for j in range(20) for i in range(4)]
    df = spark.createDataFrame(rows, "conv string, turn long, text string").repartition(5)
    got = {(r["conv"], r["turn"]): (r["context"], r["context_text"]) for r in with_context(
        df, "conv", "turn", n=n, hot_rows=hot_rows, parts=16).collect()}
    assert len(got) == len(rows)
    by = {}
    for c, t, x in rows:
        by.setdefault(c, []).append((t, x or ""))
    for c, items in by.items():
        for i, (t, x) in enumerate(items):
            ctx = [m for _, m in items[max(0, i - n):i] if m.strip()]
            assert got[(c, t)] == (ctx, " [CTX] ".join([*ctx, x]))


@pytest.mark.parametrize("hot_rows", [2, 100])
def test_rows_without_a_conversation_have_no_context(spark, hot_rows):
    rows = [(None, i, f"n{i}") for i in range(6)] + [("c", i, f"c{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "conv string, turn long, text string")
    got = {(r["conv"], r["turn"]): r["context"] for r in with_context(
        df, "conv", "turn", hot_rows=hot_rows, parts=3).collect()}
    assert all(got[(None, i)] == [] for i in range(6))
    assert got[("c", 5)] == ["c3", "c4"] and got[("c", 0)] == []


def test_context_needs_a_key(spark):
    with pytest.raises(ValueError):
        with_context(spark.range(3).selectExpr("id", "'a' AS text"), "", "id")


@pytest.fixture(scope="module")
def linear(docs):
    terms = features.add_terms(docs, "text", 1, 1)
    voc = features.pin(features.vocab(terms, len(TEXTS), 1, 1.0))
    coefs = voc.selectExpr("term", "idf", "CASE term WHEN 'cat' THEN 2.0e0 WHEN 'the' THEN -1.5e0 "
                           "WHEN 'dog' THEN 0.7e0 WHEN 'fast' THEN -0.2e0 ELSE 0.1e0 END AS coef")
    return features.tfidf(terms, voc), coefs


def test_shap_sums_to_the_log_odds(linear):
    w, coefs = linear
    bg = explain.background_mean(w, len(TEXTS))
    base = explain.base_value(coefs, bg, -0.5).first()[0]
    # Terms a document lacks contribute too: -coef * mean.
    means = {r["term"]: r["mean_weight"] for r in bg.collect()}
    c = {r["term"]: r["coef"] for r in coefs.collect()}
    phi = {}
    for r in explain.linear_shap(w, coefs, bg).collect():
        phi.setdefault(r["doc_id"], {})[r["term"]] = r["phi"]
    logits = {r["doc_id"]: r["logit"] for r in model.linear_scores(w, coefs, -0.5).collect()}
    for d, parts in phi.items():
        absent = sum(-c[t] * means[t] for t in c if t not in parts)
        assert base + sum(parts.values()) + absent == pytest.approx(logits[d])


def test_drop_one_is_the_change_of_the_score(linear):
    w, coefs = linear
    got = {(r["doc_id"], r["term"]): r["weight"] for r in explain.lime_drop_one(
        w.select("doc_id", "term", "tf"), coefs, -0.5).collect()}
    rows = {r["term"]: (r["idf"], r["coef"]) for r in coefs.collect()}

    def score(words):
        a = {t: words.count(t) * rows[t][0] for t in set(words)}
        norm = math.sqrt(sum(v * v for v in a.values())) or 1.0
        z = -0.5 + sum(v * rows[t][1] for t, v in a.items()) / norm
        return 1 / (1 + math.exp(-z))

    for i, t in enumerate(TEXTS):
        words = [x for x in t.split() if len(x) > 1]
        for term in set(words):
            assert got[(i, term)] == pytest.approx(
                score(words) - score([x for x in words if x != term]))


def test_lime_agrees_with_a_linear_model(spark, linear):
    w, coefs = linear
    counts = w.select("doc_id", "term", "tf")
    a = explain.lime_linear(counts, coefs, -0.5, n_samples=400)
    assert a.exceptAll(explain.lime_linear(counts.repartition(5), coefs, -0.5, n_samples=400)).count() == 0
    got = {(r["doc_id"], r["term"]): r["weight"] for r in a.collect()}
    assert got[(0, "cat")] > 0 > got[(0, "the")]
    assert got[(1, "cat")] == max(v for (d, _), v in got.items() if d == 1)

    def make():
        return lambda texts: [0.9 if "cat" in t.split() else 0.2 for t in texts]

    words = spark.createDataFrame([(1, "the cat ran fast the".split()), (2, [])],
                                  "doc_id long, words array<string>")
    rows = explain.lime_texts(words, make, n_samples=200, k=2).collect()
    assert len(rows) == 2 and max(rows, key=lambda r: r["weight"])["term"] == "cat"


def test_lime_long_document_uses_the_dual_solve():
    z = explain._masks("7", 1, 60, 400)
    y = z[:, 3] * 0.8
    w = np.ones(60)
    a = explain._ridge(z, y, w, 0.5)
    zc, yc = z - z.mean(0), y - y.mean()
    assert np.allclose(a, np.linalg.solve(zc.T @ zc + 0.5 * np.eye(400), zc.T @ yc))


def test_lime_masks_and_solve_need_less_than_the_draws():
    """Masks are those of ranked draws; a long document's solve makes no second copy of its samples."""
    import tracemalloc

    rng = explain._generator("7", 1)
    drops, ranks = rng.integers(1, 5001, 299), rng.random((299, 5000)).argsort(axis=1).argsort(axis=1)
    z = explain._masks("7", 1, 300, 5000)
    assert z[0].all() and (z[1:] == (ranks >= drops[:, None])).all()
    tracemalloc.start()
    explain._ridge(z, z[:, 3] * 0.8, np.ones(300), 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < z.nbytes


def test_agreement(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", -1.0)], "doc_id long, token string, weight double")
    b = spark.createDataFrame([(1, "x", 0.5), (1, "z", 1.0), (2, "q", 1.0)], "doc_id long, token string, weight double")
    got = {r["doc_id"]: (r["jaccard"], r["sign_agreement"]) for r in explain.explainer_agreement(a, b).collect()}
    assert got == {1: (1 / 3, 1.0), 2: (0.0, None)}


def test_fold_vocabularies_equal_separate_counting(spark, labelled):
    from moderata.operators.split import assign_folds

    one_pass = {r["doc_id"]: r["prob"] for r in model.cross_validate(
        labelled, 2, hi=1, min_df=2, max_features=8, max_iter=15).collect()}
    folded = assign_folds(labelled, 2, label="label")
    for i in (0, 1):
        fitted = model.train_baseline(folded.filter(F.col("fold") != i), hi=1, min_df=2,
                                      max_features=8, max_iter=15)
        for r in fitted.transform(folded.filter(F.col("fold") == i)).collect():
            assert one_pass[r["doc_id"]] == pytest.approx(r["prob"], abs=1e-9)


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_context_leaves_the_callers_columns(spark, hot_rows):
    names = ("msg", "rng", "is_hot", "recent", "halo", "tail", "from_end", "range_value", "said")
    df = spark.createDataFrame([(1, i, f"t{i}", *[f"{n}{i}" for n in names]) for i in range(6)],
                               ["conv", "turn", "text", *names])
    out = with_context(df, "conv", "turn", hot_rows=hot_rows, parts=2).orderBy("turn").collect()
    for i, r in enumerate(out):
        assert [r[n] for n in names] == [f"{n}{i}" for n in names]
        assert r["context"] == [f"t{j}" for j in range(max(0, i - 2), i)]


@pytest.mark.parametrize("heavy_terms", [0, 3, 10_000])
def test_a_common_word_meets_no_task_alone(spark, heavy_terms):
    """A word in four of five rows: with heavy terms no task has three times the median's rows; weights are the same."""
    rng = random.Random(3)
    rows = [(i, (["common"] if i % 5 else []) + [f"w{rng.randrange(3000)}" for _ in range(3)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(8)
    counts = features.doc_terms(df)
    vocabulary = features.vocab(df, len(rows), min_df=1, max_df=1.0, max_features=None)
    want = {(i, t): n for i, terms in rows for t, n in collections.Counter(terms).items()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = features.term_weights(counts, vocabulary, "doc_id", heavy_terms).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.doc_id, r.term): r.tf for r in out} == want and len(out) == len(want)
    idf = {r.term: r.idf for r in vocabulary.collect()}
    assert all(abs(r.raw - r.tf * idf[r.term]) < 1e-12 for r in out)
    sizes = sorted(collections.Counter(r.part for r in out).values())
    if heavy_terms:
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    else:
        assert sizes[-1] > 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("C", [0.5, 1.0, 20.0])
def test_certificate_of_the_fit(spark, C):
    """Residuals vanish at the optimum, equal a plain gradient, and tell a model that was not fitted to the end."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("good", "bad", "film", "plot", "cast")) for _ in range(rng.randrange(8))), int(rng.random() < 0.3))
            for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    fitted = model.train_baseline(df, C=C, tol=1e-10)
    found = {r.term: r.residual for r in model.certificate(fitted, df, C=C).collect()}
    assert set(found) == {*fitted.vocabulary, None} and max(map(abs, found.values())) < 1e-6
    early = model.train_baseline(df, C=C, max_iter=1)
    rough = {r.term: r.residual for r in model.certificate(early, df, C=C).collect()}
    assert max(map(abs, rough.values())) > 1e-4
    # The same gradient by numpy.
    idf = early.pipeline.stages[1].getScalingVec().toArray()
    w = early.pipeline.stages[-1].coefficients.toArray()
    at = {t: i for i, t in enumerate(early.vocabulary)}
    n, ones = len(rows), sum(y for *_, y in rows)
    total = np.append(w / (C * n), 0.0)
    for _, text, y in rows:
        x = np.zeros(len(w))
        words = text.split()
        for t in [*words, *map(" ".join, zip(words, words[1:]))]:
            x[at[t]] += 1
        x *= idf
        x /= np.linalg.norm(x) or 1.0
        d = (n / (2 * ones) if y else n / (2 * (n - ones))) * (1 / (1 + math.exp(-(x @ w + early.intercept))) - y) / n
        total += np.append(x * d, d)
    assert np.allclose([rough[t] for t in [*early.vocabulary, None]], total, atol=1e-9)


def test_char_ngram_counts_cut_each_word_once(spark):
    """As from whole texts, for all lengths, odd spaces and characters outside the basic plane; grams are made of distinct words."""
    texts = ["a ab  abc\tABCDE abcde", " ", "", None, "éİ \U0001F600x\U0001F600 ab", "a\n b\x1cc a-b", "abcde " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for lo, hi in ((3, 5), (2, 2), (2, 4), (4, 6), (5, 5)):
        whole = df.select(F.explode(features.char_ngrams(F.col("text"), lo, hi)).alias("gram")).groupBy("gram").agg(
            F.count(F.lit(1)).alias("n"))
        got = features.char_ngram_counts(df, "text", lo, hi)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_documents_are_dealt_in_bounded_parts_by_id(spark, tmp_path):
    from catalog.inputs import dealt_documents

    rows = [(i, f"word{i} other") for i in range(2_000)] + [(None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    stored = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))
    dealt = dealt_documents(spark, str(tmp_path), stored // 20)
    assert dealt.rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(rows, key=str)
    # Rows of a document stay where its text is: what groups by document moves nothing.
    counts = features.doc_terms(features.add_terms(dealt, "text"))
    plan = counts.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_explainers_share_one_vocabulary(spark, monkeypatch):
    from catalog import learning

    made = []
    pin = features.pin
    monkeypatch.setattr(features, "pin", lambda v: made.append(v) or pin(v))
    learning._agreement(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


@pytest.mark.parametrize("char", [False, True])
def test_a_fit_cleans_once_and_cuts_terms_in_bounded_parts(spark, labelled, monkeypatch, char):
    """Texts are cleaned once and cut twice; parts are bounded; weights are those of counting all terms of all texts."""
    calls, dealt = [], []
    clean, add = model.clean_text, model.add_terms
    monkeypatch.setattr(model, "clean_text", lambda c: calls.append("clean") or clean(c))
    monkeypatch.setattr(model, "add_terms", lambda d, *a: dealt.append(d.rdd.getNumPartitions()) or add(d, *a))
    monkeypatch.setattr(model, "PART_BYTES", 200)
    fitted = model.train_baseline(labelled, char=char, max_features=60, clean=True, max_iter=5)
    assert calls == ["clean"] and dealt and min(dealt) > 8
    terms = features.add_terms(labelled.withColumn("t", clean(F.col("text"))), "t", 1, 2, char, ())
    want = {r["term"]: r["idf"] for r in features.vocab(terms, labelled.count(), 1, 1.0, 60).collect()}
    assert {r["term"]: r["idf"] for r in fitted.weights(spark).collect()} == want


def test_folds_vectorise_once(spark, labelled, monkeypatch):
    calls = []
    clean = model.clean_text
    monkeypatch.setattr(model, "clean_text", lambda c: calls.append("clean") or clean(c))
    out = model.cross_validate(labelled, 3, clean=True, max_iter=5, max_features=20)
    assert out.count() == 120 and calls == ["clean"]


def test_terms_are_made_once_where_they_are_unpacked(spark):
    """No size test of the arrays is moved below the exchange, where it would make all terms a second time."""
    df = spark.createDataFrame([(1, "ab cd ab"), (2, ""), (3, None), (4, "ab")], "doc_id long, text string").repartition(3, "doc_id")
    rows = features.add_terms(df, "text", 1, 2)
    for out in (features.doc_terms(rows), features.term_stats(rows), features.term_counts(df, (), "text", 1, 2, True)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "size(" not in "".join(line for line in plan.splitlines() if "Filter" in line)
    assert sorted(map(tuple, features.doc_terms(rows).collect())) == [
        (1, "ab", 2), (1, "ab cd", 1), (1, "cd", 1), (1, "cd ab", 1), (4, "ab", 1)]


@pytest.mark.parametrize("hot_rows", [10, 10**6])
@pytest.mark.parametrize("n", [1, 3])
def test_context_of_long_texts_is_cut_by_their_size(spark, monkeypatch, hot_rows, n):
    """Ranges and tasks follow the bytes of the texts, and adaptive execution does not put them together."""
    monkeypatch.setattr(context, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(context, "HOT_BYTES", 10_000)
    rows = [(c, i, None if i % 7 == 0 else " " if i % 11 == 0 else f"{c}{i} " + "x" * 400) for c in "ab" for i in range(100)]
    rows += [("cold", i, f"c{i}") for i in range(4)] + [(None, i, f"n{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "conv string, turn long, text string").repartition(3)
    out = with_context(df, "conv", "turn", n=n, hot_rows=hot_rows)
    assert out.rdd.getNumPartitions() >= 30
    by = {c: [x for k, _, x in rows if k == c] for c in ("a", "b", "cold")}
    want = {(c, i): [] if c is None else [x for x in by[c][max(0, i - n):i] if x and x.strip()] for c, i, _ in rows}
    got = out.collect()
    assert {(r.conv, r.turn): r.context for r in got} == want and len(got) == len(rows)
    assert {(r.conv, r.turn): r.text for r in got} == {(c, i): x for c, i, x in rows}


def test_parts_follow_the_texts_not_their_stored_size(spark, tmp_path):
    """Repeated texts are stored in a fraction of their size, and take as many tasks as others."""
    from catalog.inputs import dealt_documents

    text = " ".join(f"word{i}" for i in range(200))
    spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    size = 2_000 * len(text)
    stored = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))
    assert stored < size / 20
    dealt = dealt_documents(spark, str(tmp_path), size // 40)
    assert dealt.rdd.getNumPartitions() >= 40 and dealt.count() == 2_000


def test_rows_of_all_terms_take_as_many_tasks_as_they_need(spark, monkeypatch):
    """Joined by hash in tasks that follow the number of rows, whatever the session's shuffle partitions are."""
    rng = random.Random(5)
    rows = [(i, ["common"] * (i % 3) + [f"w{rng.randrange(500)}" for _ in range(5)]) for i in range(600)] + [(600, []), (601, None)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(4)
    vocabulary = features.vocab(df, len(rows), max_features=None)
    monkeypatch.setattr(features, "TASK_ROWS", 100)
    monkeypatch.setattr(features, "HEAVY_TERMS", 5)
    out = features.tfidf(df, vocabulary, max_features=None)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert out.rdd.getNumPartitions() >= len(got) / 100 > 20
    idf = {r.term: r.idf for r in vocabulary.collect()}
    want = {}
    for i, terms in rows:
        raw = {t: n * idf[t] for t, n in collections.Counter(terms or []).items() if t in idf}
        norm = math.sqrt(sum(a * a for a in raw.values()))
        want |= {(i, t): a / norm for t, a in raw.items()}
    assert len(got) == len(want) and all(abs(r.weight - want[r.doc_id, r.term]) < 1e-9 for r in got)


def test_terms_that_were_not_kept_are_dropped_before_rows_are_dealt(spark, monkeypatch):
    """A bit array of any size lets every kept term through; with room, nearly no other."""
    counts = spark.range(4000).selectExpr("id div 20 AS doc_id", "concat('t', id % 1000) AS term", "1 + cast(id % 3 AS int) AS tf")
    counts = counts.unionByName(counts.select("doc_id", F.lit("all").alias("term"), "tf").distinct())
    vocabulary = counts.filter("term = 'all' OR term LIKE '%7'").groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", 5 - F.log("df"))
    want = sorted((r.doc_id, r.term, r.tf, r.tf * r.idf) for r in counts.join(vocabulary, "term").collect())
    keys, dealt = [], features._dealt

    def spy(rows, parts, key):
        if key == "at":
            keys.append(rows.select("term").distinct().count())
        return dealt(rows, parts, key)

    monkeypatch.setattr(features, "_dealt", spy)
    for bits in (1 << 28, 64 * features.BIT_WORDS):
        monkeypatch.setattr(features, "FILTER_BITS", bits)
        got = features.term_weights(counts, vocabulary, "doc_id", 1).select("doc_id", "term", "tf", "raw")
        assert sorted(map(tuple, got.collect())) == want
    bits, size = features._term_bits(vocabulary)
    assert size == 64 * features.BIT_WORDS
    assert bits.selectExpr("explode(words) AS w").agg(F.sum(F.bit_count("w"))).first()[0] <= 101
    assert max(keys) < 200 < counts.select("term").distinct().count()
