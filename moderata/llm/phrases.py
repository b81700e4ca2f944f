"""Phrases whose words stand together more often than their parts' counts explain.

Counting. Phrases of up to LONGEST words seen at least ``least`` times are
counted exactly, length by length: a place counts for length m only if both of
its phrases of m - 1 words are frequent. Frequent ones of the last length are
known to every task as a bit array of bounded size (at most FILTER_BITS bits)
over 64-bit codes; a code that shares its bit with another only makes more
rows. Codes are counted per chunk of texts, then summed in one pre-aggregated
grouping. For length three only the texts' runs of three or more words with
frequent pairs are read, from length four on only those with frequent triples;
both are written once, one row a text. In the end the phrases themselves, no codes, are counted.

Streams. The counts are kept in two orders, by their words from left to right
(prefix order) and from right to left (suffix order), both sorted by ranges,
so a word with a third of all phrases lies in many tasks. A task goes through
its part of a stream once and keeps the open prefixes on a stack: in prefix
order these are a phrase's first words, whose counts are the left counts of
all its cuts; in suffix order its last words, hence the right counts. A stream's
part lacks at most the four prefixes of its first phrase; they are looked up
apart (four rows per part) and filled in. The two streams then meet in a merge
join on the phrase, in lockstep; no table of counts is hashed. A phrase that is
as frequent as the phrase it extends by one word at its right (prefix order) or
left (suffix order) removes it: counts cannot grow with length, so a longer
phrase that is as frequent lies behind a one-word extension that is, too.

Everything is per language; null counts as ``und``, a null text as empty.
Empty texts have no words. Texts are read whole, in chunks of CHARACTERS; one
long text is one chunk. Repeated rows count each time. Ties in score and count
follow the phrase's UTF-8 bytes. An empty table gives an empty result. Columns
other than the named ones are left out, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import mix, powers
from .workspace import written

LONGEST = 5
CHARACTERS = 4 << 20
HELD = 200_000  # different phrases that a task adds up before it passes them on
FILTER_BITS = 1 << 27
BITMAP_BITS = 32768  # of one bitmap of bitmap_construct_agg
SALTS = 64
WORD, BLANK, BREAK = range(3)
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a batch of texts: numbers of distinct words, their codes, and where pieces end."""

    def __init__(self, texts: list[str], langs: list[str]):
        """``langs``: the language of every text; texts and pieces end at breaks."""
        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8"), np.uint8)
        kind = KIND[raw]
        word = kind == WORD
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        self.letters, self.start = LOWER[raw[word]], np.append(0, np.cumsum(size)).astype(np.int64)
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(self.start), pa.py_buffer(self.letters)]).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        self.piece = np.cumsum(kind == BREAK)[start]
        lengths = np.array([len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts], np.int64)
        per_text = np.diff(np.append(0, np.searchsorted(start, np.cumsum(lengths + 1))))
        named = pa.array(langs, pa.string()).dictionary_encode()
        self.langs, of_text = named.dictionary.to_numpy(zero_copy_only=False), named.indices.to_numpy(zero_copy_only=False)
        self.lang, self.text = np.repeat(of_text, per_text), np.repeat(np.arange(len(texts)), per_text)
        self.of_text = of_text
        self.counts = np.bincount(of_text, per_text, len(self.langs)).astype(np.int64)
        seeds = mix(codes_of(pa.array([b"in " + x.encode() for x in self.langs], pa.large_binary())) + np.uint64(1))
        known = codes_of(self.words)
        self.code = mix(known[self.ids] ^ seeds[self.lang]) if len(self.ids) else np.zeros(0, np.uint64)

    def joined(self, m: int) -> np.ndarray:
        """Whether a phrase of m words begins at each place but the last m - 1."""
        if len(self.ids) < m:
            return np.zeros(0, bool)
        return self.piece[m - 1:] == self.piece[: len(self.piece) - m + 1]

    def reduced(self, good: np.ndarray, m: int, least: int) -> pa.RecordBatch:
        """(lang, text) of every text with a run of at least ``least`` words in which all ``m`` neighbours are ``good``.

        Runs are parted by line feeds, so each is a piece of its own.
        """
        edge = np.flatnonzero(np.diff(good, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2] + m - 1
        start, end = start[end - start >= least], end[end - start >= least]
        size = end - start  # two runs may share words: the last of one are the first of the next
        word = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        length = self.start[word + 1] - self.start[word]
        stop = np.cumsum(length + 1)
        out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        letters = np.ones(len(out), bool)
        letters[stop - 1] = False
        out[letters] = self.letters[np.arange(int(length.sum())) + np.repeat(self.start[word] - (np.cumsum(length) - length), length)]
        out[stop[np.cumsum(size) - 1] - 1] = 0x0A
        text, first = np.unique(self.text[word], return_index=True)
        cuts = np.append(np.append(0, stop)[first], len(out)).astype(np.int64)
        joined = pa.Array.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(cuts), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays(
            [pa.array(self.langs[self.of_text[text]], pa.string()), joined.cast(pa.binary()).cast(pa.string())], ["lang", "text"])

    def codes(self, m: int) -> np.ndarray:
        """The code of the m words from each place but the last m - 1."""
        n = max(len(self.ids) - m + 1, 0)
        out = self.code[:n]
        for i in range(1, m):
            out = mix(out * np.uint64(3) + self.code[i: i + n] + np.uint64(i))
        return out


def codes_of(words: pa.Array) -> np.ndarray:
    """64-bit codes of byte strings."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset: words.offset + len(words) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0]: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    size = np.diff(ends)
    if not size.all():
        raise ValueError("empty word")
    place = np.arange(len(flat)) - np.repeat(ends[:-1], size)
    terms = (flat.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1)[place]
    return mix(np.add.reduceat(terms, ends[:-1]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Filter:
    """A bit array of bounded size over codes."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = codes % np.uint64(self.size)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @staticmethod
    def of(codes: DataFrame) -> Filter:
        """The bits of a table of codes; at most FILTER_BITS of them, two bytes per code where that is less."""
        n, size = codes.count(), BITMAP_BITS
        while size < min(FILTER_BITS, 16 * n):
            size *= 2
        at = F.pmod(F.col("code"), F.lit(size))  # a power of two: the same for signed and unsigned codes
        found = codes.select(at.alias("at")).groupBy(F.expr(f"at div {BITMAP_BITS}").alias("no")).agg(
            F.bitmap_construct_agg(F.expr(f"at % {BITMAP_BITS}")).alias("bits")).collect()
        bits = np.zeros(size // 8, np.uint8)
        for r in found:
            part = np.frombuffer(bytes(r["bits"]), np.uint8)
            bits[r["no"] * BITMAP_BITS // 8:][: len(part)] = part
        return Filter(bits, size)


def _texts(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[Words]:
    """The words of chunks of the rows (lang, text)."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = size = 0
        for b, text in enumerate(texts, 1):
            size += len(text) + 1
            if size >= characters or b == len(texts):
                yield Words(texts[a:b], langs[a:b])
                a, size = b, 0


CODES = "lang string, code long, n long"


def _code_rows(words: Words, places: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    found, at, n = np.unique(codes[places], return_index=True, return_counts=True)
    lang = words.langs[words.lang[places][at]]
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])


def _frequent(words: Words, m: int, known: Filter) -> np.ndarray:
    """Whether a phrase of m words that may be frequent begins at each place."""
    good = words.joined(m)
    return good & known(words.codes(m)) if len(good) else good


def frequent_codes(texts: DataFrame, m: int, least: int, shorter: Filter | None, characters: int) -> DataFrame:
    """(lang, code, n) of phrases of m words; null codes count all words. ``shorter`` holds those of m - 1 words."""

    def count(batches):
        for words in _texts(batches, characters):
            good = words.joined(m)
            if shorter is not None and len(good):
                ok = shorter(words.codes(m - 1))
                good &= ok[: len(good)] & ok[1: len(good) + 1]
            yield _code_rows(words, np.flatnonzero(good), words.codes(m))
            if m == 1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.langs, pa.string()), pa.nulls(len(words.langs), pa.int64()),
                     pa.array(words.counts, pa.int64())], ["lang", "code", "n"])

    counted = texts.mapInArrow(count, CODES).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("code").isNull() | (F.col("n") >= least))


def reduced(texts: DataFrame, m: int, known: Filter, characters: int) -> DataFrame:
    """The texts without all that cannot be in a frequent phrase of three words or more: runs of m-word phrases that may be
    frequent, of at least three words. At most one row a text."""

    def cut(batches):
        for words in _texts(batches, characters):
            yield words.reduced(_frequent(words, m, known), m, 3)

    return texts.mapInArrow(cut, "lang string, text string")


def tallied(texts: DataFrame, filters: dict[int, Filter], characters: int) -> DataFrame:
    """(lang, text, n): counts of the phrases, for every length in ``filters``, told apart by their words; per task."""

    def add(words: Words, held: Counter) -> None:
        rank, listed, langs = words.ids, words.words.to_pylist(), words.langs
        for m in range(1, max(filters) + 1):
            n = len(words.ids) - m + 1
            if n < 1:
                return
            if m > 1:
                # Number of m words = number of (number of the first m - 1, last word).
                _, rank = np.unique(rank[:n] * len(listed) + words.ids[m - 1:], return_inverse=True)
            if m not in filters:
                continue
            good = np.flatnonzero(_frequent(words, m, filters[m]))
            _, at, count = np.unique(rank[good] * len(langs) + words.lang[good], return_index=True, return_counts=True)
            at = good[at]
            for lang, a, k in zip(langs[words.lang[at]], at.tolist(), count.tolist()):
                held[lang, b" ".join([listed[i] for i in words.ids[a: a + m].tolist()])] += k

    def rows(held: Counter) -> pa.RecordBatch:
        lang, text = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())],
            ["lang", "text", "n"])

    def count(batches):
        held = Counter()
        for words in _texts(batches, characters):
            add(words, held)
            if len(held) >= HELD:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)

    return texts.mapInArrow(count, "lang string, text string, n long")


def phrase_counts(docs: DataFrame, least: int, text: str = "text", lang: str = "lang",
                  characters: int = CHARACTERS) -> tuple[DataFrame, DataFrame]:
    """((lang, words, f) of all phrases of 1 to LONGEST words with f >= least, (lang, n) of all words)."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = written(frequent_codes(texts, 1, least, None, characters), "words")
    totals = first.filter("code IS NULL").select("lang", "n")
    filters = {1: Filter.of(first.filter("code IS NOT NULL"))}
    filters[2] = Filter.of(written(frequent_codes(texts, 2, least, filters[1], characters), "codes"))
    left = written(reduced(texts, 2, filters[2], characters), "texts-of-pairs")
    for m in range(3, LONGEST + 1):
        filters[m] = Filter.of(written(frequent_codes(left, m, least, filters[m - 1], characters), "codes"))
        if m == 3:
            left = written(reduced(left, 3, filters[3], characters), "texts-of-triples")
    short, long = ({m: f for m, f in filters.items() if (m < 3) == few} for few in (True, False))
    counts = tallied(texts, short, characters).union(tallied(left, long, characters)).select(
        "lang", F.split("text", " ").alias("words"), "n")
    counts = counts.groupBy("lang", "words").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return written(counts, "phrase-counts"), totals


WALKED = "lang string, words array<string>, f long, part int, head boolean, shorter array<long>"


def stream(counts: DataFrame, backward: bool = False) -> DataFrame:
    """(lang, words, f, shorter): the counts of the phrase's first 1, 2, ... words (``backward``: of its last ones)."""
    order = F.reverse("words") if backward else F.col("words")
    rows = counts.select("lang", order.alias("words"), "f").repartitionByRange("lang", "words").sortWithinPartitions(
        "lang", "words")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head = TaskContext.get().partitionId(), True
        lang, words, open_counts = None, [], []
        for batch in batches:
            shorter, heads = [], []
            for new_lang, new, f in zip(*(c.to_pylist() for c in batch.columns)):
                common = 0
                if new_lang == lang:
                    for a, b in zip(words, new):
                        if a != b:
                            break
                        common += 1
                # Prefixes of the last phrase stay known; those between were not passed, they are in the part before.
                open_counts = open_counts[:common] + [None] * (len(new) - 1 - common)
                shorter.append(open_counts[: len(new) - 1])
                open_counts.append(f)
                heads.append(head)
                lang, words, head = new_lang, new, False
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(heads, pa.bool_()),
                 pa.array(shorter, pa.list_(pa.int64()))], ["lang", "words", "f", "part", "head", "shorter"])

    walked = written(rows.mapInArrow(go, WALKED), "stream")
    # The counts that a part's first phrases lack: of the prefixes of its first phrase, at most four rows a part.
    heads = walked.filter("head").select("lang", "part", F.explode(F.expr(
        "transform(sequence(1, size(words)), k -> slice(words, 1, k))")).alias("words"))
    known = counts.select("lang", order.alias("words"), "f")
    lacking = known.join(F.broadcast(heads), ["lang", "words"]).groupBy(F.col("part").alias("at"), F.col("lang").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.size("words"), "f"))).alias("known"))
    filled = walked.join(F.broadcast(lacking), F.expr("part = at AND lang = of"), "left")
    return filled.select(
        "lang", order.alias("words"), "f", F.expr("transform(shorter, (c, i) -> coalesce(c, known[i + 1]))").alias("shorter"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang",
                 characters: int = CHARACTERS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language."""
    counts, totals = phrase_counts(docs, least, text, lang, characters)
    forward, backward = stream(counts), stream(counts, backward=True)
    both = forward.withColumnRenamed("shorter", "firsts").join(
        backward.select("lang", "words", F.col("shorter").alias("lasts")).hint("merge"), ["lang", "words"])
    # lasts[i] counts the last i + 1 words: the cut after k words has lasts[size - k - 1].
    both = written(both.filter("size(words) > 1"), "phrases")
    whole = both.filter("size(words) > 2")
    covered = whole.filter("element_at(firsts, -1) = f").select("lang", F.expr("slice(words, 1, size(words) - 1)").alias("words")).union(
        whole.filter("element_at(lasts, -1) = f").select("lang", F.expr("slice(words, 2, size(words) - 1)").alias("words")))
    left = both.join(covered.distinct().hint("merge"), ["lang", "words"], "left_anti")
    cuts = left.join(F.broadcast(totals.withColumnRenamed("lang", "of")), F.col("lang") == F.col("of")).withColumn("cuts", F.expr(
        "transform(sequence(1, size(words) - 1), k -> named_struct('k', k, 'l', firsts[k - 1], 'r', lasts[size(words) - k - 1]))"))
    lowest = cuts.withColumn("cut", F.expr(
        f"array_min(transform(transform(cuts, c -> named_struct('k', c.k, 'l', c.l, 'r', c.r, 'f', f, 'n', n)), "
        f"c -> named_struct('score', {_score('c')}, 'k', c.k, 'l', c.l, 'r', c.r)))"))
    found = lowest.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"),
                          F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # First inside shares of a language, so that none is ranked in one task.
    some = found.withColumn("salt_", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "salt_").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(c: str) -> str:
    """floor(1000 * f * n / (l * r)), exact: whole decimals of up to 38 digits."""
    def wide(x):
        return f"CAST({c}.{x} AS DECIMAL(17, 0))"

    return f"CAST(({wide('f')} * {wide('n')} * 1000BD) div ({wide('l')} * {wide('r')}) AS BIGINT)"
