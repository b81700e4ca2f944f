"""The queries of the operators, each with its SQL where SQL can express it.

The SQL of each stands next to the query and works on the same whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, conversation_repair, exact_dedup, fingerprints, knn_join, language_id, license_scan, ngram_join,
               packing, phrases, sharding, token_counts, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# CRC-32 of the UTF-8 bytes of a text, byte by byte from its code points.
CRC_STEPS = ("(SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), "
             "lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) FROM range(256) t(i))")
TEXT_BYTES = ("flatten(list_transform(list_transform(string_split(t, ''), lambda ch: unicode(ch)::BIGINT), lambda u: "
              "CASE WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 + (u >> 6), 128 + (u & 63)] "
              "WHEN u < 65536 THEN [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)] "
              "ELSE [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63), 128 + (u & 63)] END))")
OP1_SQL = f"""
WITH crc AS (SELECT {CRC_STEPS} AS steps),
docs AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t, steps FROM documents, crc),
summed AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], CASE WHEN t = '' THEN [] ELSE {TEXT_BYTES} END),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM docs),
costs AS (SELECT doc_id, size, text_crc32, list_transform(range({SHARDS + 1}), lambda i: {{
    'cost': -ln((('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5e0) / 4503599627370496e0),
    'shard': i::INT}}) AS c FROM summed),
placed AS (SELECT doc_id, size, text_crc32, list_min(c[1:{SHARDS}]).shard AS shard, list_min(c).shard AS grown_shard FROM costs)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws(':', doc_id, text_crc32, size)), doc_id) - 1 AS slot
FROM placed"""


@query("op1_sharding", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"), [1.0] * SHARDS)


RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_LONGEST = "\n    ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h + p}:{v}'"
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
OP3_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
ruled AS (SELECT *, CASE {_LONGEST} END AS hit FROM split)
SELECT page_id, host, path, split_part(hit, ':', 1) AS rule,
    CASE WHEN hit IS NOT NULL THEN split_part(hit, ':', 2)
         WHEN regexp_matches(host, '(^|[.-])({"|".join(url_filter.UNWANTED)})([.-]|$)') THEN 'block'
         ELSE 'allow' END AS verdict FROM ruled"""


@query("op3_url_filter", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    rules = spark.createDataFrame([(h, p, v, True) for h, p, v in RULES],
                                  "host string, path string, verdict string, ruled boolean")
    return url_filter.judge(pages, rules.unionByName(url_filter.block_list(pages)))


@query("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op6_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


OP8_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(list_zip(w[:-5], w[2:-4], w[3:-3], w[4:-2], w[5:]),
      lambda p: concat_ws(' ', p[1], p[2], p[3], p[4], p[5])) END) AS s FROM words),
every_member AS (SELECT doc_id, len(s) AS n, unnest(s) AS m FROM sets),
frequent AS (SELECT m, row_number() OVER () AS k FROM every_member GROUP BY m HAVING count(*) > 1),
members AS MATERIALIZED (SELECT doc_id, n, k AS m FROM every_member JOIN frequent USING (m)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
    FROM members a JOIN members b ON a.m = b.m AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 75 * (na + nb - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)"""


@query("op8_ngram_join", OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


@query("op9_fingerprints")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


@query("op2_language_id")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.filter(~held))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return language_id.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


_KNOWN = ", ".join(
    f"('{' '.join(w[i:i + 2])}', {i}, '{wording}', {len(w) - 1}, '{label}', {base})"
    for base, group in (("true", license_scan.PHRASES), ("false", license_scan.TEMPLATES))
    for wording, label in group.items() for w in [wording.split(" ")] for i in range(len(w) - 1))
OP10_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{license_scan.SEPARATORS}'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT r, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: concat(p[1], ' ', p[2]))) AS gram,
    unnest(range(len(w) - 1)) AS place FROM words WHERE len(w) > 1),
known(gram, pos, template, k, label, base) AS (VALUES {_KNOWN}),
hits AS MATERIALIZED (SELECT DISTINCT r, template, k, label, base, place - pos AS d, pos FROM grams JOIN known USING (gram)),
stands AS (SELECT r, label, d AS a, true AS whole, 1e0 AS share, true AS accepted FROM hits WHERE base
    GROUP BY r, template, k, label, d HAVING count(*) = k),
nearest AS (SELECT a.r, a.template, a.k, a.label, a.d, h.pos, first(h.d + h.pos ORDER BY abs(h.d - a.d), h.d) AS place
    FROM (SELECT DISTINCT r, template, k, label, d FROM hits WHERE NOT base) a
    JOIN hits h ON h.r = a.r AND h.template = a.template AND NOT h.base AND abs(h.d - a.d) <= {license_scan.DRIFT} GROUP BY ALL),
ordered AS (SELECT *, place > coalesce(max(place) OVER (PARTITION BY r, template, d ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS follows FROM nearest),
spans AS (SELECT r, label, k, count(*) AS n, min(place) AS a, max(place) + 1 AS b FROM ordered WHERE follows GROUP BY r, template, k, label, d),
found AS (SELECT r, label, a, whole, share, accepted FROM stands UNION ALL
    SELECT r, label, a, false, n::DOUBLE / k, true FROM spans
    WHERE n::DOUBLE / k >= {license_scan.ENOUGH}e0 AND b - a + 1 <= {license_scan.STRETCH}e0 * (k + 1))
SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (whole) AS n_base, min(a) FILTER (whole) AS first_word,
    max(a) FILTER (whole) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (accepted), '') AS labels,
    coalesce(max(share) FILTER (accepted), 0e0) AS score
FROM words LEFT JOIN found USING (r) GROUP BY r, doc_id, w"""


@query("op10_license_scan", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(table(spark, sf, "documents")).drop("spans")


_CRC = (f"xor(list_reduce(list_concat([4294967295::BIGINT], {TEXT_BYTES.replace('string_split(t', 'string_split(key')}), "
        "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)")
_INK = r"'[^\x20\x09-\x0D]'"


def _edits(i: str) -> str:
    """Least (cost, audit, repaired) from state ``i`` (1: start, 2: system, 3: user, 4: assistant) over the next row,
    of the same from the states after it (``after``)."""
    def step(letter, cost, to, left):
        return f"{{'c': {cost} + after[{to}].c, 'a': '{letter}' || after[{to}].a, 'r': {left} || after[{to}].r}}"

    to, name = (3, "user") if i != "3" else (4, "assistant")
    keeps = {"1": "CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 END", "2": "CASE initial WHEN 'u' THEN 3 END",
             "3": "CASE initial WHEN 'a' THEN 4 END", "4": "CASE initial WHEN 'u' THEN 3 END"}[i]
    own = "chr(10) || role || ':' || text"
    return (f"list_min(list_filter([{step('D', 4, i, chr(39) * 2)}, "
            f"CASE WHEN fault < 2 AND ({keeps}) IS NOT NULL THEN {step('K', '3 * fault', f'({keeps})', own)} END, "
            f"CASE WHEN fault < 2 THEN {step('R', '3 + 3 * fault', to, f'chr(10) || {chr(39)}{name}:{chr(39)} || text')} END], "
            "lambda e: e IS NOT NULL))")


def _inserts(row: str) -> str:
    """``row``: least edits of the four states with a row first; one or two inserted rows may come before it."""
    def put(n, i, j, name):
        return f"{{'c': 3 + {n}[{j}].c, 'a': 'I' || {n}[{j}].a, 'r': chr(10) || '{name}:' || {n}[{j}].r}}"

    def once(n, src):
        nexts = ((1, 3, "user"), (2, 3, "user"), (3, 4, "assistant"), (4, 3, "user"))
        return "[" + ", ".join(f"least({src}[{i}], {put(n, i, j, name)})" for i, j, name in nexts) + "]"

    inner = f"list_transform([{row}], lambda n: {once('n', 'n')})[1]"
    return f"list_transform([{inner}], lambda n: {once('n', 'n')})[1]"


_NONE = "{'c': 1000000000000::BIGINT, 'a': '', 'r': ''}"
_STOP = "{'c': 0::BIGINT, 'a': '', 'r': ''}"
OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_STEPS} AS steps),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS k
    FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
    FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy)),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, {_INK}) THEN 2 WHEN again THEN 3
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
best AS (SELECT conv_id, n AS i, {_inserts(f"[{_STOP}, {_NONE}, {_NONE}, {_STOP}]")} AS after FROM counted
    UNION ALL SELECT b.conv_id, b.i - 1, {_inserts("[" + ", ".join(map(_edits, "1234")) + "]")}
    FROM best b JOIN judged r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(after[1].c, 0)::BIGINT AS cost,
    coalesce(after[1].a, '') AS audit, sha256(coalesce(substr(after[1].r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0"""


@query("op11_conversation_repair", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf, "conversations"))
    return conversation_repair.summaries(damaged, copies="copies")


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM words, range(1, 6) t(m))),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, n,
    (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN totals USING (lang)
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (SELECT DISTINCT p.lang, p.phrase FROM f p JOIN f x ON x.lang = p.lang AND x.m > p.m AND x.f >= p.f
    AND contains(' ' || x.phrase || ' ', ' ' || p.phrase || ' ') WHERE p.m > 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest ANTI JOIN covered USING (lang, phrase)) WHERE rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""


@query("op13_topk", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return knn_join.knn_join(vectors, vectors.filter("vec_id % 20 = 0"))
