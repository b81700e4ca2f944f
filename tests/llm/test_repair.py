"""Conversation repair against a brute-force search over edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from moderata.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, part string, no string, conv string, digest string, n string"


def rows(n=160, seed=3):
    rng = random.Random(seed)
    texts = ["Hello.", "Hello", "", " \t\n", "So what?", "cut off", "é!", "...", None, "ends with space. \n", "x" * 2000]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u2", "User"]
    out = [(rng.randrange(20), rng.randrange(9), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    out += [(77, i, rng.choice(roles[:5]), f"{rng.randrange(60)}{rng.choice('.?!x')}") for i in range(120)]  # one long conversation
    out += [(77, 5, "user", "again."), (77, 5, "user", "again.")] * 9  # repeated rows
    out += [(None, 1, "user", "no key."), (None, None, "assistant", "no turn."), (78, None, "user", "a."), (78, None, None, None)]
    out += [(79, t, "user", "same.") for t in (2**63 - 1, -(2**63))]
    return [(*r, *"clash") for r in out]


def damaged(data):
    for conv, turn, role, text, *_ in data:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(k, 1)):
            yield conv, turn, role, text


def want(items):
    """The contract's columns, by trying all edits."""
    items = sorted(items, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in items:
        kept = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, left, inserted):
        """Least (cost, audit, repaired) after rows i.. when the last kept initials are ``left`` ('' for none)."""
        out = []
        if i == len(items) and left in ("", "a"):
            out.append((0, "", ()))
        follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}[left]
        if inserted < 3:
            c, a, r = best(i, follow[0], inserted + 1)
            out.append((c + 3, "I" + a, ((follow, ""), *r)))
        if i < len(items):
            _, role, text = items[i]
            c, a, r = best(i + 1, left, 0)
            out.append((c + 4, "D" + a, r))
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                if (role[:1] == "s" and left == "") or (role[:1] == "u" and left in ("", "s", "a")) or (role[:1] == "a" and left == "u"):
                    c, a, r = best(i + 1, role[0], 0)
                    out.append((c + extra, "K" + a, ((role, text), *r)))
                c, a, r = best(i + 1, follow[0], 0)
                out.append((c + extra + 3, "R" + a, ((follow, text), *r)))
        return min(out, key=lambda x: x[:2], default=(10**9, "", ()))

    cost, audit, repaired = best(0, "", 0)
    turns = [t for t, _, _ in items if t is not None]
    initials = [role[:1] for _, role, _ in items]
    return (min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()), repaired


def grouped(data):
    groups = {r[0]: [] for r in data}
    for conv, *rest in damaged(data):
        groups[conv].append(tuple(rest))
    return {c: want(items) for c, items in groups.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_against_all_edits(spark, block):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = cr.summaries(cr.damage(df), copies="copies", block_rows=block).collect()
    expected = grouped(data)
    assert len(out) == len(expected)
    for r in out:
        assert tuple(r)[1:] == expected[r.conv_id][0], r.conv_id


def test_messages(spark):
    data = rows(60, 9)
    left = cr.messages(cr.damage(spark.createDataFrame(data, SCHEMA)), copies="copies", block_rows=4).collect()
    found = {}
    for r in sorted(left, key=lambda r: (r.part, r.no, r["at"])):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    assert found == {c: list(repaired) for c, (_, repaired) in grouped(data).items() if repaired}


def test_one_conversation_in_many_tasks(spark):
    """A conversation with nearly all rows, dealt over all ranges, and a row that repeats without end."""
    rng = random.Random(1)
    data = [(1, i, rng.choice(("user", "assistant")), f"{rng.randrange(900)}.", *"clash") for i in range(3000)]
    data += [(1, 17, "user", "hot.", *"clash")] * 2000 + [(2, 0, "user", "hi.", *"clash"), (2, 1, "assistant", "ho.", *"clash")]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = cr.blocks(df, "conv_id", "turn", "role", "text", block_rows=64).filter("conv = 1")
        out = {r.conv_id: r for r in cr.summaries(df, block_rows=64).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.select("part").distinct().count() > 1
    rows_in = parts.selectExpr("sum(aggregate(times, 0L, (a, b) -> a + b)) AS n", "max(length(codes)) AS most").first()
    assert rows_in.n == 5000 and rows_in.most <= 65
    assert len(out[1].audit.replace("I", "")) == 5000 and out[2].audit == "KK"
    cost = {"K": 0, "R": 3, "I": 3, "D": 4}
    assert out[1].cost == sum(map(cost.get, out[1].audit))
    # The same conversation in one block.
    assert {r.conv_id: r for r in cr.summaries(df.coalesce(1), block_rows=1 << 20).collect()} == out


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.summaries(cr.damage(df), copies="copies").collect() == []


def test_walk_needs_no_vectors_but_checkpoints():
    rng = random.Random(8)
    codes = bytes(rng.choice((0, 1, 2, 3, 5, 6, 8)) for _ in range(500))
    letters = "".join(x for x, _, _ in cr.walk(codes, cr.END, cr.START))
    vector = cr.END
    marks = {}
    for i in range(len(codes) - 1, -1, -1):
        marks[i], vector = vector, cr.back(codes[i], vector)
    s, plain = cr.START, ""
    for i, code in enumerate(codes):
        x, _, s = cr.choose(code, marks[i], s)
        plain += x
    assert letters == plain
    costs = cr.matrix(codes)
    assert cr.through(costs, cr.END) == vector
