"""Sharding, language ID, URL filters, fingerprints and license scans against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moderata.llm import fingerprints, language_id, license_scan, sharding, url_filter
from tests.llm import fixtures


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_ROWS", 3)  # many bins
    rows = fixtures.rows() + [(5000 + i, f"text {i}", None, None, None) for i in range(2000)]
    out = sharding.shard(fixtures.docs(spark, rows), [1.0, 1.0, 2.0]).collect()
    assert len(out) == len(rows)
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    shares, by_key = collections.Counter(), collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in out:
        shares[r.shard] += 1
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 3)
    assert all(len(v) == 1 for v in by_key.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert abs(shares[2] / len(out) - 0.5) < 0.05 and abs(shares[0] / len(out) - 0.25) < 0.05
    moved = sum(r.grown_shard == 3 for r in out) / len(out)
    assert abs(moved - 0.2) < 0.05
    grown = {r.doc_id: r.shard for r in sharding.shard(fixtures.docs(spark, rows), [1.0, 1.0, 2.0, 1.0]).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in out)
    assert sharding.shard(fixtures.empty(spark), [1.0]).count() == 0


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.filter(~held), sample_rows=600)
    assert model.families == ["germanic", "romance"] and set(model.of_pair) == {("de", "en"), ("es", "fr")}
    out = language_id.identify(docs.filter(held).select("doc_id", "text", "lang"), model).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    # The label, the key and the neighbours play no part.
    twice = language_id.identify(docs.filter(held).select((-F.col("doc_id")).alias("doc_id"), "text").orderBy("text"), model)
    assert {(r.text, r.lang_pred) for r in twice.collect()} == {(r.text, r.lang_pred) for r in out}


def test_language_of_awkward_rows(spark):
    docs = fixtures.docs(spark)
    model = language_id.train(docs)
    out = language_id.identify(docs, model, score="sure")
    assert out.columns == [*docs.columns, "lang_pred", "sure"]
    for r in out.collect():
        letters = re.search(r"[^\W\d_]", r.text or "")
        assert (r.lang_pred == "und" and r.sure == 0) if not letters else r.lang_pred in ("de", "en")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.train(unlabelled) is None
    assert {r.lang_pred for r in language_id.identify(docs, None, score="sure").collect()} == {"und"}
    one = language_id.Model(language_id.features(["some words", "more words"]), np.array(["en", "en"], object))
    assert one.predict(language_id.features(["other"]))[0] == ["en"]
    assert language_id.identify(fixtures.empty(spark), model, score="sure").count() == 0


ENTRIES = [("net", "/", "block", True), ("example.net", "/en/", "allow", True), ("example.com", "/de/", "block", True),
           ("org", "/fr/", "allow", True), ("bad.org", "", "block", False), ("a.b.bad.org", "", "allow", False)]
URLS = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://x.Example.NET/en/1?q", "https://example.net/EN/",
        "http://example.com/de", "http://example.com/de/x#y", "http://notexample.com/de/", "ftp://org/fr/?a", "http://bad.org/fr/z",
        "http://www.bad.org/x", "http://a.b.bad.org/", "http://worsebad.org/", "http://x..net/", "http://.net/", "http://net./",
        "http://u:p@h.net:80/en/", "http://é.NET/", "a://b://net/", "http://org?/fr/", "http://org/fr/#", "://net/"]


def url_want(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(e[3], len(e[0] + e[1]), e) for e in ENTRIES if (host == e[0] or host.endswith("." + e[0])) and path.startswith(e[1])]
    if not fit:
        return host, path, None, "allow"
    e = max(fit)[2]
    return host, path, e[0] + e[1] if e[3] else None, e[2]


@pytest.mark.parametrize("part_keys", [1, 100_000])
def test_url_filter(spark, monkeypatch, part_keys):
    monkeypatch.setattr(url_filter, "PART_KEYS", part_keys)
    entries = spark.createDataFrame(ENTRIES, "host string, path string, verdict string, ruled boolean")
    data = [(i, u, "x", "y") for i, u in enumerate(URLS * 3)] + [(None, "http://net/", "x", "y")]
    pages = spark.createDataFrame(data, "page_id long, url string, host string, name string")
    out = url_filter.judge(pages, entries).collect()
    assert collections.Counter(tuple(r) for r in out) == collections.Counter((i, *url_want(u)) for i, u, *_ in data)
    assert url_filter.judge(pages.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, entries.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_a_host_of_very_many_labels(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", broadcast)
    long = ".".join(["a"] * 100_000) + ".example.net"
    pages = spark.createDataFrame([(1, f"http://{long}/en/x"), (2, f"http://{long}/de"), (3, "http://" + "." * 50_000)],
                                  "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block", True), ("example.net", "/en/", "allow", True)],
                                  "host string, path string, verdict string, ruled boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow")}


def test_digests_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda s: np.array([len(x) for x in s], np.uint64))
    with url_filter.SortedDigests(["aa", "bb", "ccc", "dd"]) as table:
        assert table.find(["dd", "aa", "xx", "ccc", "zzzz", "bb"]).tolist() == [3, 0, -1, 2, -1, 1]


def winnow(text, k=fingerprints.K, window=1 << fingerprints.DOUBLINGS, grams=None):
    """Places chosen by the definition: the rightmost least hash of every window."""
    n = len(grams)
    if n <= window:
        spans = [(0, n)] if n else []
    else:
        spans = [(i, i + window) for i in range(n - window + 1)]
    return sorted({min(range(a, b), key=lambda j: (grams[j], -j)) for a, b in spans})


def test_winnowing_follows_the_definition(spark):
    rows = fixtures.rows() + [(900, "same " * 200, None, None, None), (901, "w" * 100, None, None, None)]
    df = fixtures.docs(spark, rows).select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    out = fingerprints.with_fingerprint(df, "text", "fp").withColumn("at", fingerprints.positions(F.col("fp")))
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[^\s]{1,32}"), F.lit(0)), lambda w: F.xxhash64(w))
    for r in out.withColumn("w", words).collect():
        pair = spark.createDataFrame([(r.w,)], "w array<long>") if r.text.startswith("same") else None
        if pair is not None:  # all equal: the rightmost of every window
            n = 200 - fingerprints.K + 1
            assert sorted(r["at"]) == list(range(7, n))
        assert len(r.fp) == len(set(r.fp))
        assert (not r.w) == (not r.fp)


def test_any_common_passage_shares_a_fingerprint(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range((1 << fingerprints.DOUBLINGS) + fingerprints.K - 1)]
    rows = []
    for i in range(40):
        w = [f"r{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(w) + 1)
        rows.append((i, " ".join(w[:at] + passage + w[at:]), None, None, None))
    out = fingerprints.with_fingerprint(fixtures.docs(spark, rows).select("text"), "text", "fp")
    sets = [set(r.h) for r in out.select(fingerprints.hashes(F.col("fp")).alias("h")).collect()]
    assert set.intersection(*sets)


@pytest.mark.parametrize("range_rows", [5, 10_000])
def test_edited_texts(spark, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    data = [r for r in fixtures.rows() if r[3] != "again"]
    data = [r for r in data if r[0] is not None] + [(None, "a row without a key", "en", None, None)]
    out = fingerprints.edited_fingerprints(fixtures.docs(spark, data)).collect()
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in out}
    assert len(out) == len(data) == len(got)
    prints = collections.defaultdict(set)
    for i, (doc_id, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (following[1] or "")[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(r.fingerprint)

        def bare(s):
            return {x.split("@")[0] for x in s.split()}

        for a, b, likeness in ((r.fingerprint, r.edited_fingerprint, r.near_edited),
                               (r.fingerprint, got[following[0]].fingerprint, r.near_next)):
            x, y = bare(a), bare(b)
            assert abs(likeness - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.edited_fingerprints(fixtures.docs(spark)).count() == len(fixtures.rows())
    assert fingerprints.edited_fingerprints(fixtures.empty(spark)).count() == 0


def license_want(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i: i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def method_labels(text):
    """Labels of templates of which enough 2-grams stand in order near one diagonal."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = set()
    for wording, label in license_scan.TEMPLATES.items():
        t = wording.split()
        grams = list(zip(t, t[1:]))
        places = [[i for i in range(len(w) - 1) if (w[i], w[i + 1]) == g] for g in grams]
        for d in {p - i for i, ps in enumerate(places) for p in ps}:
            kept = []
            for i, ps in enumerate(places):
                close = [(abs(p - i - d), p - i, p) for p in ps if abs(p - i - d) <= license_scan.DRIFT]
                if close and min(close)[2] > (kept[-1] if kept else -1):
                    kept.append(min(close)[2])
            if len(kept) >= license_scan.ENOUGH * len(grams) and kept[-1] + 1 - kept[0] + 1 <= license_scan.STRETCH * len(t):
                found.add(label)
    return sorted(found)


def test_license_scan(spark):
    data = fixtures.rows() + [
        (800, "All rights reserved, all rights-reserved; all Rights Reserved", None, None, None),
        (801, "Released under the MIT License.", None, None, None),
        (802, "under the terms of the apache license, version 2.0", None, None, None),
        (803, "dedicated now to the public domain", None, None, None),
        (804, "cc by " * 2000, None, None, None), (805, "general license public", None, None, None),
        (806, "public domain public domain public domain", None, None, None),  # one k-gram, three times
        (807, "public domain the to dedicated", None, None, None), (808, "domain public the public domain dedicated to", None, None, None),
        (809, "the public domain dedicated to the public domain the public domain", None, None, None),
        (810, "the public domain " * 40 + "is dedicated to the public domain", None, None, None),  # a long lead-in
        (811, "permission is granted free of charge to any one person obtaining a copy", None, None, None)]
    out = license_scan.scan(fixtures.docs(spark, data)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out)
    assert got == collections.Counter((r[0], *license_want(r[1])) for r in data)
    by_id = {r.doc_id: r for r in out}
    assert by_id[801].labels == "mit" and by_id[801].score == 1.0
    assert by_id[802].labels == "apache-2.0" and 0.75 <= by_id[802].score <= 1
    assert by_id[803].labels == "public-domain" and by_id[805].labels == "" and by_id[805].score == 0
    assert by_id[804].n_base == 2000
    assert {i: by_id[i].labels for i in range(806, 812)} == {
        806: "", 807: "", 808: "", 809: "public-domain", 810: "public-domain", 811: "mit"}
    for r in out:
        got = sorted({(s.label) for s in r.spans if s.label not in license_scan.PHRASES.values()})
        assert got == method_labels([x[1] for x in data if x[0] == r.doc_id][0])
    assert [tuple(s) for s in by_id[810].spans] == [("public-domain", 121, 125)]
    for r in out:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert {s.label for s in r.spans} == set(r.labels.split(",")) - {""}
    assert license_scan.scan(fixtures.empty(spark)).count() == 0
