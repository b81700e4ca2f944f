"""Collocations against counts and scores by definition."""

import collections
import random
import re

import numpy as np
import pytest

from moderata.llm import phrases
from tests.llm import fixtures


def texts(seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "a", "\x01", "日本", "x\x00y", "river"]
    out = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts += rng.choice((["new", "York", "city", "hall"], ["the", "river"], ["of", "the"], [rng.choice(words)]))
            parts[-1] += rng.choice(("", "", "", ".", ",", "\n", "\t", ";!"))
        out.append((i, " ".join(parts), rng.choice(("en", "en", "de", None, "", "und")), "s", 1))
    hot = "one line that very many documents hold"
    out += [(100 + i, hot, "en", "hot", 1) for i in range(40)]
    return out + [(900, None, "en", None, None), (901, "", None, None, None), (None, " . ", "en", None, None), (902, "end", "fr", None, 1)]


def want(data, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, 6):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    kept = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    rows = collections.defaultdict(list)
    for (lang, p), a in kept.items():
        inside = any(x == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                     for (x, q), b in kept.items())
        if not inside:
            cuts = [((1000 * a * n[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score)
                  for lang, found in rows.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("least,top,parts", [(3, 2000, 1), (2, 7, 23), (30, 50, 5)])
def test_against_definition(spark, monkeypatch, least, top, parts):
    """Many ranges cut the streams inside prefixes; small chunks cut the counting; a tiny filter lets all through."""
    monkeypatch.setattr(phrases, "SALTS", 3)
    if parts > 5:
        monkeypatch.setattr(phrases, "FILTER_BITS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = texts()
        got = phrases.collocations(fixtures.docs(spark, data).repartition(3), least, top, characters=300).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in got) == want(data, least, top)


def test_long_text_and_fixture(spark):
    rng = random.Random(4)
    data = fixtures.rows() + [(7000, " ".join(rng.choice("abc") for _ in range(60_000)), "en", "long", 1)]
    got = phrases.collocations(fixtures.docs(spark, data), 20, 300).collect()
    assert sorted(tuple(r) for r in got) == want(data, 20, 300)


def test_empty(spark):
    assert phrases.collocations(fixtures.empty(spark)).collect() == []


def test_filter_never_loses_a_code(spark):
    codes = np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64)
    found = phrases.Filter.of(spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long"))
    assert found(codes).all()
    others = np.random.default_rng(2).integers(0, 1 << 64, 5000, np.uint64)
    assert found(others).mean() < 0.1


def test_exact_beyond_64_bits(spark):
    f, n, left, right = 10**14, 9 * 10**15, 3 * 10**14, 7 * 10**14
    df = spark.createDataFrame([(f, n, left, right)], "f long, n long, l long, r long").selectExpr(
        "named_struct('f', f, 'n', n, 'l', l, 'r', r) AS c")
    assert df.selectExpr(phrases._score("c")).first()[0] == (1000 * f * n) // (left * right)
