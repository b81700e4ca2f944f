"""Cheapest edits that turn a conversation into alternating turns.

A conversation's rows are taken by turn, nulls first; rows of one turn in the
order of the digest of role and text. Keep costs 0, Rerole 3, Insert 3, Delete
4; a truncated row that stays adds 3; blank rows and rows whose role and text
were seen before must go. What is left has role initials ``(s?(ua)+)?``, which
four states check. ``vector[s]`` is the least cost from state s to the end;
going backward over a row is a function of the row's code and the vector.

The rows are sorted by ranges of (conversation, turn, digest) and cut into
blocks of about BLOCK_ROWS rows or BLOCK_BYTES bytes of one conversation, so
a conversation of any size lies in many tasks. Vectors are stored only at the
ends of blocks: every block of a cut conversation gives its least costs from
state to state, these are composed from the conversation's end backward (one
small row per block), and then every block is recomputed with its own end
vector. Inside a block the same is done with about sqrt(rows) checkpoints. Of
equally cheap edits the ASCII-least initials are emitted going forward: a
letter is taken if it is tight, i.e. its cost plus the rest's equals the
vector. States at the starts of blocks come from the blocks' maps from state to
state, composed forward. Whole conversations inside one task skip both chains.

Nulls: roles and texts count as one space; a null turn comes first and has no
part in gaps; a null conversation key is a conversation. Ties (rows of one
turn) follow the digest, so equal rows are neighbours; repeated rows are
duplicates of the first. Very long texts are only hashed and copied. A row with
no copies (``copies`` of 0) names its conversation and is no message; a
conversation without messages has zeros and an empty audit. An empty table
gives an empty result. Columns other than the named ones are left out, so their
names cannot clash. Gaps beyond 64 bits are cut to the largest long.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written

BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
RATHER = 1 << 40  # more than any difference of costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what came last
FOLLOWS = (USER, USER, ASSISTANT, USER)  # state after an inserted or changed row
KEEPS = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})  # by initial s, u, a, other
NAMES = {USER: "user", ASSISTANT: "assistant"}
TRUNCATED, FORCED = 4, 8  # code of a row: initial, plus TRUNCATED; FORCED for all that must go
END = (0, 6, 3, 0)
LONG = (1 << 63) - 1

_INK = re.compile("[^\x20\x09-\x0d]")
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def level(vector) -> tuple[int, ...]:
    low = min(vector)
    return tuple(v - low if v - low < RATHER // 2 else RATHER for v in vector)


def _options(code: int, after: tuple[int, ...], s: int) -> list[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of the edits of one row, the letters ascending."""
    out = [("D", 4 + after[s], s)]
    if code != FORCED:
        extra = 3 if code >= TRUNCATED else 0
        if s in KEEPS[code % TRUNCATED]:
            to = KEEPS[code % TRUNCATED][s]
            out.append(("K", extra + after[to], to))
        out.append(("R", 3 + extra + after[FOLLOWS[s]], FOLLOWS[s]))
    return out


@functools.lru_cache(maxsize=1 << 16)
def _costs(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost to the end from every state before the row."""
    row = [min(cost for _, cost, _ in _options(code, after, s)) for s in range(4)]
    return tuple(min(row[s], 3 + row[FOLLOWS[s]], 6 + row[FOLLOWS[FOLLOWS[s]]]) for s in range(4))


@functools.lru_cache(maxsize=1 << 16)
def back(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return level(_costs(code, after))


@functools.lru_cache(maxsize=1 << 16)
def choose(code: int, after: tuple[int, ...], s: int) -> tuple[str, int, int]:
    """(tight letters up to and with the row's own, their cost, next state)."""
    costs, letters, paid = _costs(code, after), "", 0
    while True:
        tight = {letter: (cost - after[to], to) for letter, cost, to in _options(code, after, s) if cost == costs[s]}
        if 3 + costs[FOLLOWS[s]] == costs[s] and "D" not in tight:
            letters, paid, s = letters + "I", paid + 3, FOLLOWS[s]
            continue
        letter = min(tight)
        return letters + letter, paid + tight[letter][0], tight[letter][1]


def matrix(codes: bytes) -> list[int]:
    """Least costs of a block from state s to state t, as 16 numbers; inserts only before its rows."""
    columns = []
    for t in range(4):
        vector, base = tuple(0 if s == t else RATHER for s in range(4)), 0
        for code in reversed(codes):
            costs = _costs(code, vector)
            base += min(costs)
            vector = level(costs)
        columns.append([v + base if v < RATHER else RATHER for v in vector])  # RATHER: no way
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a block from the one after it."""
    return level([min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4)])


def walk(codes: bytes, after: tuple[int, ...], s: int) -> Iterator[tuple[str, int, int]]:
    """(letters, cost, next state) of every row of a block that ends with vector ``after``."""
    step = math.isqrt(len(codes)) + 1
    marks, vector = {}, after
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0 or i + 1 == len(codes):
            marks[i + 1] = vector
        vector = back(codes[i], vector)
    for low in range(0, len(codes), step):
        high = min(low + step, len(codes))
        inner = [marks[high]]
        for i in range(high - 1, low, -1):
            inner.append(back(codes[i], inner[-1]))
        for i in range(low, high):
            found = choose(codes[i], inner[high - 1 - i], s)
            yield found
            s = found[2]


class Block:
    """Rows of one conversation, in order, as they pass by."""

    def __init__(self, conv, part: int, no: int):
        self.conv, self.part, self.no = conv, part, no
        self.codes, self.times, self.roles, self.texts = bytearray(), [], [], []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, turn, role: str, text: str, times: int, seen: bool) -> None:
        if not times:
            return
        self.size += len(text)
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in ("su", "ua", "au")
        self.illegal += times - 1  # a row and its copy have one initial
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        stays = 0
        if not _INK.search(text):
            self.blank += times
        else:
            stays = 0 if seen else 1
            self.duplicate += times - stays
        if stays:
            cut = text.rstrip(_WHITE)[-1] not in ".!?"
            self.truncated += cut
            kind = "sua".find(initial) % 4 if initial else 3
            self._append(kind + (TRUNCATED if cut else 0), 1, role, text)
        if times > stays:
            self._append(FORCED, times - stays, None, None)

    def _append(self, code, times, role, text):
        self.codes.append(code)
        self.times.append(times)
        self.roles.append(role)
        self.texts.append(text)

    def full(self, limit: int) -> bool:
        return len(self.codes) >= limit or self.size >= BLOCK_BYTES

    def row(self, whole: bool) -> dict:
        return {"conv": self.conv, "part": self.part, "no": self.no, "whole": whole, "codes": bytes(self.codes),
                "times": self.times, "roles": self.roles, "texts": self.texts,
                "matrix": None if whole else matrix(bytes(self.codes)), "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "turns": self.turns, "first_turn": self.first_turn,
                "last_turn": self.last_turn, "first_role": self.first_role, "last_role": self.last_role}


COUNTS = ("blank", "duplicate", "truncated", "illegal")
ABOUT = ("blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
         "first_role string, last_role string")
BLOCK = f"part int, no long, whole boolean, codes binary, times array<long>, roles array<string>, texts array<string>, " \
        f"matrix array<long>, {ABOUT}"
PIECE = f"part int, no long, audit string, cost long, roles array<string>, texts array<string>, {ABOUT}"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _to_batches(spark_schema: str, kind: str):
    """A function from dicts to record batches of (conv ``kind``, ``spark_schema``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"conv {kind}, {spark_schema}"))

    def batches(rows, size: int = 512, limit: int = 8 << 20):
        kept, held = [], 0
        for row in rows:
            kept.append(row)
            held += sum(map(len, filter(None, row.get("texts") or ())))
            if len(kept) >= size or held >= limit:
                yield pa.RecordBatch.from_pylist(kept, schema)
                kept, held = [], 0
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema)

    return batches


def _rows(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch become one, so that a row that repeats without end is few rows to sort."""
    for batch in batches:
        keys = [c for c in batch.schema.names if c != "n"]
        table = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        yield from table.rename_columns([*keys, "n"]).select(batch.schema.names).combine_chunks().to_batches()


def blocks(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None = None,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The table of blocks; a block marked ``whole`` is all of its conversation."""
    n = F.lit(1) if copies is None else F.col(copies)
    named = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), n.cast("long").alias("n"))
    named = named.withColumn("digest", F.unhex(F.sha2(
        F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    kind = named.schema["conv"].dataType.simpleString()
    # Where every (conversation, role, text) comes first: one marker row, sorted before its rows.
    first = named.filter("n > 0").groupBy("conv", "digest").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    marks = first.select("conv", F.expr("IF(unnumbered, NULL, least)").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "digest")
    shape = f"conv {kind}, turn long, role string, text string, n long, digest binary"
    order = ["conv", "turn", "digest"]
    ordered = marks.union(named.mapInArrow(_combined, shape)).repartitionByRange(*order).sortWithinPartitions(*order, "role")
    to_batches = _to_batches(BLOCK, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found():
            block, no, alone, mark = None, 0, False, None
            for r in _rows(batches):
                if block is None or r["conv"] != block.conv:
                    if block is not None:
                        yield block.row(alone and block.no == no)
                    # The first conversation of a task may have begun in the task before.
                    alone = block is not None
                    no += 1
                    block, mark = Block(r["conv"], part, no), None
                if r["role"] is None:
                    mark = (r["turn"], r["digest"])
                    continue
                fresh = mark == (r["turn"], r["digest"])
                if r["n"]:
                    mark = None
                block.add(r["turn"], r["role"], r["text"], r["n"], not fresh)
                if block.full(block_rows):
                    yield block.row(False)
                    no += 1
                    alone, block = False, Block(r["conv"], part, no)
            if block is not None:
                yield block.row(False)  # and the last may go on in the next

        yield from to_batches(found())

    return written(ordered.mapInArrow(cut, f"conv {kind}, {BLOCK}"), "blocks")


def _by_conversation(df: DataFrame, backward: bool = False) -> DataFrame:
    order = [F.col("part").desc(), F.col("no").desc()] if backward else ["part", "no"]
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bool]]:
    """(row, whether it is the first of its conversation)."""
    before = None
    for row in _rows(batches):
        yield row, before is None or row["conv"] != before["conv"]
        before = row


def chain(cut: DataFrame) -> DataFrame:
    """``cut`` blocks with the vector at their end, their state at the start, and whether they are the last."""
    kind = cut.schema["conv"].dataType.simpleString()
    ends_of, maps_of, starts_of = (_to_batches(s, kind) for s in (
        "part int, no long, ends array<long>, last boolean", "part int, no long, map array<int>", "part int, no long, state int"))

    def backward(batches):
        def found():
            vector = END
            for row, new in _runs(batches):
                vector = END if new else vector
                yield {**row, "ends": list(vector), "last": new}
                vector = through(row["matrix"], vector)
        yield from ends_of(found())

    def mapped(batches):
        def found():
            for r in _rows(batches):
                to = []
                for s in range(4):
                    for _, _, s in walk(r["codes"], tuple(r["ends"]), s):
                        pass
                    to.append(s)
                yield {**r, "map": to}
        yield from maps_of(found())

    def forward(batches):
        def found():
            state = START
            for row, new in _runs(batches):
                state = START if new else state
                yield {**row, "state": state}
                state = row["map"][state]
        yield from starts_of(found())

    ends = _by_conversation(cut.select("conv", "part", "no", "matrix"), backward=True).mapInArrow(
        backward, f"conv {kind}, part int, no long, ends array<long>, last boolean")
    ends = written(ends, "block-ends").drop("conv")
    maps = cut.select("conv", "part", "no", "codes").join(ends, ["part", "no"]).select("conv", "part", "no", "codes", "ends")
    starts = _by_conversation(maps.mapInArrow(mapped, f"conv {kind}, part int, no long, map array<int>")).mapInArrow(
        forward, f"conv {kind}, part int, no long, state int").drop("conv")
    return cut.join(ends, ["part", "no"]).join(starts, ["part", "no"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for r in _rows(batches):
        state, audit, cost, roles, texts = r["state"], [], 0, [], []
        rows = zip(walk(r["codes"], tuple(r["ends"]), state), r["times"], r["roles"], r["texts"])
        for (letters, paid, after), times, role, text in rows:
            for _ in letters[:-1]:
                state = FOLLOWS[state]
                roles.append(NAMES[state])
                texts.append("")
            if letters[-1] == "D":
                letters, paid = letters + "D" * (times - 1), paid + 4 * (times - 1)
            else:
                roles.append(role if letters[-1] == "K" else NAMES[after])
                texts.append(text)
            audit.append(letters)
            cost += paid
            state = after
        if r["last"]:
            while END[state]:
                state = FOLLOWS[state]
                audit.append("I")
                cost += 3
                roles.append(NAMES[state])
                texts.append("")
        yield {**r, "audit": "".join(audit), "cost": cost, "roles": roles, "texts": texts}


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: str | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Pieces of repaired conversations: (pieces of cut conversations, whole conversations).

    A piece holds the edits' initials (``audit``), their cost, the roles and
    texts left by them, and counts; (part, no) orders the pieces of ``conv``.
    """
    all_blocks = blocks(rows, conv, turn, role, text, copies, block_rows)
    kind = all_blocks.schema["conv"].dataType.simpleString()
    to_batches = _to_batches(PIECE, kind)

    def solve(batches):
        yield from to_batches(_solved(batches))

    def pieces(df):
        return df.drop("matrix", "whole").mapInArrow(solve, f"conv {kind}, {PIECE}")

    alone = all_blocks.filter("whole").withColumns({
        "ends": F.array(*[F.lit(v).cast("long") for v in END]), "last": F.lit(True), "state": F.lit(START)})
    return _by_conversation(pieces(chain(all_blocks.filter("NOT whole")))), pieces(alone)


def messages(rows: DataFrame, conv: str = "conv_id", **columns) -> DataFrame:
    """The repaired conversations: (conv, part, no, at, role, text), ordered by the three numbers."""
    cut, alone = repair(rows, conv, **columns)
    both = cut.union(alone).select(F.col("conv").alias(conv), "part", "no", F.posexplode(F.arrays_zip("roles", "texts")))
    return both.select(conv, "part", "no", F.col("pos").alias("at"), F.col("col.roles").alias("role"),
                       F.col("col.texts").alias("text"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    def closed():
        span = 0 if low is None else high - low + 1 - turns
        return {"conv": conv, **counts, "gaps": min(span, LONG), "cost": cost, "audit": "".join(audit),
                "repaired_sha256": digest.hexdigest()}

    conv = digest = None
    for r, new in _runs(batches):
        if new:
            if digest is not None:
                yield closed()
            conv, digest, empty, audit, cost, turns = r["conv"], hashlib.sha256(), True, [], 0, 0
            counts, low, high, role = dict.fromkeys(COUNTS, 0), None, None, None
        for c in COUNTS:
            counts[c] += r[c]
        if r["first_role"] is not None:
            counts["illegal"] += role is not None and role + r["first_role"] not in ("su", "ua", "au")
            role = r["last_role"]
        if r["first_turn"] is not None:
            turns += r["turns"] - (high == r["first_turn"])
            low, high = r["first_turn"] if low is None else low, r["last_turn"]
        audit.append(r["audit"])
        cost += r["cost"]
        for a, b in zip(r["roles"], r["texts"]):
            digest.update(("" if empty else "\n").encode() + f"{a}:{b}".encode())
            empty = False
    if digest is not None:
        yield closed()


def summaries(rows: DataFrame, conv: str = "conv_id", **columns) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit, and the digest of what is left.

    A cut conversation's pieces are read in order by one task, which keeps the
    audit and a running digest.
    """
    cut, alone = repair(rows, conv, **columns)
    kind = cut.schema["conv"].dataType.simpleString()
    to_batches = _to_batches(SUMMARY, kind)

    def run(batches):
        yield from to_batches(_summaries(batches))

    out = cut.mapInArrow(run, f"conv {kind}, {SUMMARY}").union(alone.mapInArrow(run, f"conv {kind}, {SUMMARY}"))
    return out.withColumnRenamed("conv", conv)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults by the checksum of ``conv_id:turn``."""
    space = F.lit(" ")
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), space), F.lit(":"))][:3])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
