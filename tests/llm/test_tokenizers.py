"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moderata.llm import bpe, byte_bpe, packing, textscan, token_counts
from tests.llm import fixtures

RANKS = P.path("byte_bpe_50k.tiktoken")
LONG = ("word and other words, " * 60_000) + "x" * 50_000


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "s", "t", "re", "ve", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", ".", "!!", "é", "ß", "日",
             " ", "́", "😡", "'d", "S", "the", "ing", "\x1c", "\x85", "Σ", "İ", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_boundaries_match_the_pattern():
    texts = noise(3000, 1) + ["", "'", "'s", " ", "a'", "a'r", "  "]
    pattern = regex.compile(P.PATTERN)
    data, offsets, _, token_of = textscan.slices(texts, textscan.ATTACHED)
    words = bpe.binary(data, offsets).to_pylist()
    for i, text in enumerate(texts):
        assert words[token_of[i]: token_of[i + 1]] == [w.encode() for w in pattern.findall(text)]


def test_block_scan_does_not_depend_on_blocks(monkeypatch):
    texts = noise(300, 2)
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    symbol = textscan.symbols(points, np.array([0]))
    want = textscan.begins(symbol, textscan.ATTACHED)
    for block in (1, 7, 100_000):
        monkeypatch.setattr(textscan, "BLOCK", block)
        assert (textscan.begins(symbol, textscan.ATTACHED) == want).all()


def test_long_texts_are_cut_where_a_token_begins():
    parts = [p for chunk in textscan.chunks([LONG, "short", ""], 10_000) for p in chunk]
    assert "".join(t for i, t in parts if i == 0) == LONG
    assert [i for i, _ in parts][-2:] == [1, 2]
    cut = [t for i, t in parts if i == 0]
    assert len(cut) > 50
    pattern = regex.compile(P.PATTERN)
    assert sum(len(pattern.findall(t)) for t in cut) == len(pattern.findall(LONG))


def test_encode_and_decode(spark, encoding):
    rows = fixtures.rows() + [(1000 + i, t, None, None, None) for i, t in enumerate(noise(300, 3))] + [(2000, LONG, None, None, None)]
    out = byte_bpe.decode(byte_bpe.encode(fixtures.docs(spark, rows), RANKS), RANKS).collect()
    assert len(out) == len(rows)
    want = collections.Counter((r[0], tuple(encoding.encode_ordinary(r[1] or ""))) for r in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in out) == want
    tokens = bpe.from_ranks(RANKS).tokens
    for r in out:
        assert bytes(r.bytes) == b"".join(tokens[i] for i in r.ids)
        assert r.ends == np.cumsum([len(tokens[i]) for i in r.ids]).tolist()
    by_text = {r[0]: r[1] for r in rows}
    assert all(bytes(r.bytes).decode() == (by_text[r.doc_id] or "") for r in out if r.doc_id not in (3, None))


def test_digests(spark, encoding):
    got = {r.doc_id: r for r in byte_bpe.digests(fixtures.docs(spark), RANKS).collect()}
    for doc_id, text, *_ in fixtures.rows():
        if doc_id is None:
            continue
        ids = encoding.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_counts(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = fixtures.rows() + [(1000 + i, t, None, None, None) for i, t in enumerate(noise(300, 4))] + [(2000, LONG, None, None, None)]
    out = token_counts.count_tokens(fixtures.docs(spark, rows), P.path("byte_bpe_50k.json")).collect()
    got = collections.Counter(tuple(r) for r in out)
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[doc_id, len((text or "").encode()), n, n > 1024] += 1
    assert got == want


def padding(sequences):
    return sum(0 if n & (n - 1) == 0 else packing.LENGTH - n for n in sequences.values())


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [r for r in fixtures.rows() if r[0] is not None and r[3] != "again"]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(noise(300, 5))] + [(2000, LONG, None, None, None)]
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    out = packing.pack(fixtures.docs(spark, rows), path).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        ids = want[r.doc_id][r.start: r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for found, total in [*((p, len(want[d])) for d, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == total if total is not None else at <= packing.LENGTH


def test_decoding_checks_the_offsets(spark):
    good = byte_bpe.encode(fixtures.docs(spark), RANKS)
    assert byte_bpe.decode(good, RANKS, ends="ends").count() == good.count()
    moved = good.withColumn("ends", F.transform("ends", lambda e: e + (F.col("doc_id") == 7).cast("int")))
    with pytest.raises(Exception, match="offsets"):
        byte_bpe.decode(moved, RANKS, ends="ends").collect()


def test_cuts_are_optimal():
    rng = random.Random(6)
    for _ in range(60):
        places = np.array(sorted(rng.sample(range(1, 90), 25)) + [90])
        penalty = np.array([rng.choice((0, 3, 9)) for _ in range(25)] + [0])
        length = 32
        if np.diff(np.append(0, places)).max() > length:
            continue

        def cost(cuts):
            total, last = 0, 0
            for c in cuts:
                n = c - last
                assert 0 < n <= length
                total += int(penalty[np.searchsorted(places, c)])
                total += 0 if n & (n - 1) == 0 else length - n
                last = c
            return total

        best = {0: 0}
        for i, here in enumerate(places.tolist()):
            options = [v + (0 if (n := here - p) & (n - 1) == 0 else length - n)
                       for p, v in best.items() if here - p <= length]
            best[here] = min(options) + int(penalty[i])
        assert cost(packing.choose_cuts(places, penalty, length, False)) == best[90]


def test_short_powers_need_no_padding():
    places = np.array([256, 300, 4352])
    assert packing.choose_cuts(places, np.zeros(3), 4096, False) == [256, 4352]
    # Of equal padding, the fewest sequences.
    assert packing.choose_cuts(np.array([1, 2, 3, 4, 8]), np.zeros(5), 16, False) == [8]


def test_padding_is_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack(docs.coalesce(1), P.path("word_bpe_49k.json")).collect()
    sequences, tokens = collections.Counter(), 0
    for r in out:
        sequences[r.sequence_id] += r.length
        tokens += r.length
    assert padding(sequences) < 0.01 * tokens


def test_empty_tables(spark):
    none = fixtures.empty(spark)
    assert byte_bpe.digests(none, RANKS).count() == 0
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
