"""Exact dedup, the n-gram join and the pipeline against brute force."""

import collections
import datetime
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moderata.llm import exact_dedup, ngram_join, shingles
from moderata.llm.components import components
from tests.llm import fixtures


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    table = exact_dedup.PerfectHash(digests[:4000])
    got = table.find(digests)
    assert got[:4000].tolist() == list(range(4000)) and (got[4000:] == -1).all()
    assert len(table.slots) == 4000  # minimal
    assert (exact_dedup.PerfectHash(digests[:0]).find(digests[:5]) == -1).all()


def dedup_want(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return groups


@pytest.mark.parametrize("heavy", [1, 10_000])
def test_exact_dedup(spark, heavy):
    rows = fixtures.rows() + [(500 + i, "held by many", None, None, None) for i in range(80)]
    groups = dedup_want(rows)
    out = exact_dedup.exact_dedup(fixtures.docs(spark, rows), heavy=heavy).collect()
    assert len(out) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in out) == len(groups)
    assert len({r.text_sha256 for r in out if r.kept}) == len(groups)


@pytest.mark.parametrize("heavy", [1, 10_000])
@pytest.mark.parametrize("kind,keys", [
    ("long", [2**53 + 1, 2**53 + 2, 2**53 + 3, 5, 2**63 - 1, 2**63 - 2, -(2**63), None, None]),
    ("string", ["b", "", "10", "9", None, "é", None, "z", "a"]),
    ("date", [datetime.date(2020, 1, d) for d in range(1, 9)] + [None])])
def test_keys_beside_nulls_stay_exact(spark, heavy, kind, keys):
    """All keys in one batch; every text keeps exactly one row, that of its largest key."""
    data = [(k, t) for i, k in enumerate(keys) for t in ("a", "b" if i % 2 else "c")]
    df = spark.createDataFrame(data, f"doc_id {kind}, text string").coalesce(1)
    out = exact_dedup.exact_dedup(df, heavy=heavy).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in out) == sorted(
        (str(k), hashlib.sha256(t.encode()).hexdigest()) for k, t in data)
    for t in "abc":
        mine = [r for r in out if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        largest = max(k for k, x in data if x == t and k is not None)
        assert {r.keep_id for r in mine} == {largest} and {r.group_size for r in mine} == {len(mine)}
        assert [r.doc_id for r in mine if r.kept] == [largest]
    left = exact_dedup.survivors(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted(
        (str(max(k for k, x in data if x == t and k is not None)), t) for t in "abc")


def test_history(spark):
    rows = fixtures.rows()
    past = [(r[0], r[1], *r[2:]) for r in rows[:60]]
    new = rows[40:]
    out = exact_dedup.exact_dedup(fixtures.docs(spark, new), fixtures.docs(spark, past), heavy=3).collect()
    old, fresh = dedup_want(past), dedup_want([r for r in new if (r[1] or "") not in dedup_want(past)])
    assert len(out) == len(new)
    names = {hashlib.sha256((r[1] or "").encode()).hexdigest(): r[1] or "" for r in rows}
    for r in out:
        text = names[r.text_sha256]
        ids = old.get(text) or fresh[text]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not (text in old and r.kept)
    assert sum(r.kept for r in out) == len(fresh)


def test_survivors_keep_columns(spark):
    docs = fixtures.docs(spark)
    out = exact_dedup.survivors(docs)
    assert out.columns == docs.columns
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len(dedup_want(fixtures.rows()))
    assert out.filter("digest_ <> 'digest_'").count() == 0


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def join_want(rows):
    """{key: (sizes, component)} by comparing all pairs."""
    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(x), find(i)) for i, x in sets] + [(None, len(shingle_set(r[1])), None) for r in rows if r[0] is None]


def check_join(spark, rows, **kw):
    out = ngram_join.jaccard_join(fixtures.docs(spark, rows), **kw).collect()
    assert collections.Counter(tuple(r) for r in out) == collections.Counter(join_want(rows))


def near_family(rng, n, words, edits, first):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        out.append((first + i, " ".join(w), None, None, None))
    return out


def test_join_small(spark):
    check_join(spark, fixtures.rows())


@pytest.mark.parametrize("few,common", [(8, 4), (2, 1)])
def test_join_families_and_passages(spark, monkeypatch, few, common):
    """Large families whose members are linked through others only, and a passage that many texts share."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "SALT_PAIRS", 7)
    rng = random.Random(11)
    rows = near_family(rng, 60, 60, 4, 0) + near_family(rng, 40, 200, 8, 100) + near_family(rng, 12, 30, 1, 200)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(300 + i, passage + " " + " ".join(f"q{rng.randrange(500)}" for _ in range(n)), None, None, None)
             for i, n in enumerate([5, 8, 12, 15, 20, 25, 30, 60] * 8)]
    chain = [f"c{i}" for i in range(300)]  # each near the next, the ends far apart
    rows += [(400 + i, " ".join(chain[10 * i: 10 * i + 100]), None, None, None) for i in range(20)]
    check_join(spark, rows, common=common)


@pytest.mark.parametrize("block", [3, 1000])
def test_join_of_lists_in_blocks(spark, monkeypatch, block):
    """A stock passage in many texts that stay apart, and lists whose blocks are paired in tasks of their own."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(4)
    stock, other = ([f"{x}{i}" for i in range(90)] for x in "pq")
    rows = [(i, " ".join([f"u{i}", *stock[: rng.randint(60, 90)], *other[: rng.randint(0, 30)]]), None, None, None)
            for i in range(70)]
    rows += [(100 + i, " ".join([f"v{i}", *stock, *(f"w{i}-{j}" for j in range(60))]), None, None, None) for i in range(30)]
    check_join(spark, rows + near_family(rng, 30, 80, 6, 200))


def test_common_shingles_are_ordered_by_their_documents():
    t = ngram_join.Threshold(75, 100)
    text = " ".join(f"w{i}" for i in range(40))
    value = shingles.shingle_sets([text])[0]
    codes = np.sort((value >> np.uint64(32)).astype(np.uint32))
    often = np.random.default_rng(2).permutation(len(codes)) + 10
    front = ngram_join._prefixes([text], 5, t, codes, often)[0]
    by_count = dict(zip(codes.tolist(), often.tolist()))
    assert [by_count[int(x) >> 32] for x in front] == sorted(often.tolist())[: len(front)]


def test_crossing_of_components():
    """Frames cut lists anywhere; a list that is nearly one component costs no pair inside it."""
    t, rng = ngram_join.Threshold(75, 100), np.random.default_rng(3)
    n = 3000
    g = (rng.integers(100, 160, n) << 40) + np.arange(n)
    c = np.where(np.arange(n) < 5, np.arange(n), 99)
    rows = np.stack([np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), np.zeros(n, int), np.zeros(n, int),
                     np.zeros(n, int), g, c, np.zeros(n, int)], 1)
    frames = [pd.DataFrame(x, columns=ngram_join.CUT) for x in np.array_split(rows, 7)]
    got = [tuple(sorted(((a, b), (d, e)))) for f in ngram_join.cross_lists(iter(frames), t) for a, b, d, e in f.itertuples(index=False)]
    size = g >> 40
    want = {tuple(sorted(((g[i], c[i]), (g[j], c[j])))) for i in range(5) for j in range(n)
            if c[i] != c[j] and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j])
            and t.reachable(size[i], size[j], 0, 0)}
    assert len(got) == len(set(got)) and set(got) == want


def test_shingles_of_any_text():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB \n\té\x0b\x1c ") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["", " "]
    value, size = shingles.shingle_sets(texts)
    assert size.tolist() == [len(shingle_set(t)) for t in texts]
    assert len(np.unique(value)) == len(set().union(*map(shingle_set, texts)))


def test_verification_is_exact_at_the_threshold(spark):
    # 75 of 100 shingles shared, and 74 of 99 (below).
    words = [f"w{i}" for i in range(104)]
    base = " ".join(words)
    rows = [(0, base, None, None, None)]
    for cut in range(1, 60):
        rows.append((cut, " ".join(words[: 104 - cut]), None, None, None))
    check_join(spark, [rows[0], rows[25]])
    check_join(spark, [rows[0], rows[26]])


def test_codes_lost_inside_a_set_leave_the_pair_to_the_second_pass():
    t = ngram_join.Threshold(75, 100)
    members = np.array([1 << 32, (1 << 32) + 1, 2 << 32, 3 << 32], np.uint64)  # the first two have one code
    short = np.unique(ngram_join._short(members))
    may, sure = ngram_join.similar(short, 4, [short], np.array([4]), t, wide=False)
    assert may.tolist() == [True] and sure.tolist() == [False]
    may, sure = ngram_join.similar(members, 4, [members, members[:2]], np.array([4, 2]), t, wide=True)
    assert may.tolist() == sure.tolist() == [True, False]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(100, j) for j in range(101, 140)] + [(7, 3), (3, 9), (9, 200), (1, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(50, 91)} == {50} and {got[i] for i in range(100, 140)} == {100}
    assert {got[i] for i in (3, 7, 9, 200)} == {3} and 1 not in got


def test_empty_tables(spark):
    none = fixtures.empty(spark)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.survivors(none).count() == 0
    assert ngram_join.jaccard_join(none).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage on the awkward table, each against its brute-force version."""
    spark_docs = fixtures.docs(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_join", "packing"]
    docs, rows = spark_docs, fixtures.rows()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == spark_docs.columns
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = collections.Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "language_id":
            assert all(re.search(r"[^\W\d_]", t or "") for _, t in got)
            assert sum(got.values()) >= 0.9 * sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in rows)
        elif name == "exact_dedup":
            want = {}
            for i, t in before:
                want[t] = max((x for x in (want.get(t), i) if x is not None), default=None)
            assert got == collections.Counter((i, t) for t, i in want.items())
        else:
            kept = {i for i, _, c in join_want([(i, t) for i, t in before.elements()]) if i == c}
            assert set(got) == {(i, t) for i, t in before if i in kept or i is None}
        before = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {i for i, _ in before}


@pytest.mark.parametrize("unlearned", ["de", "fr"])
def test_pipeline_rejects_languages_it_has_not_learned(spark, unlearned):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(8)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)) for _ in range(20)]
    others = ["привет как дела, сегодня хорошая погода", "日本語の文章です。", *noise]
    odd = spark.createDataFrame([(-1 - i, t, None, "odd", len(t)) for i, t in enumerate(others)], docs.schema)
    strange = docs.filter(f"lang = '{unlearned}'").withColumn("lang", F.lit(None).cast("string"))
    learned = docs.filter(f"lang <> '{unlearned}'")
    out = corpus_pipeline.identify_language(spark, learned.union(strange).union(odd), "")
    kept = collections.Counter("odd" if r.source == "odd" else r.lang for r in out.collect())
    n = learned.count()
    assert kept.total() - kept["odd"] - kept[None] == n  # all texts of learned languages stay
    assert kept["odd"] == 0 and kept[None] <= 0.05 * strange.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    fixtures.empty(spark).write.parquet(path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
