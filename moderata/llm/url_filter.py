"""URL filters on sorted digest arrays.

A filter list is a table (host, path, verdict, source) of hosts and path
prefixes. Its hosts are keyed by 64-bit xxhash digests; a part of the key range
is one sorted array of digests next to the full host strings. A task writes its
part to its own temporary file, memory-maps it, probes it with vectorised
binary search, compares the full strings (a digest may be shared), and removes
the file. Only distinct hosts are probed, each with all the domains above it,
so a host on a third of all pages is one probe. Of these domains only those with
as many labels as some entry are probed, so a host of very many labels costs no
more than its length. The entries of matched hosts are broadcast to the pages if
they are at most BROADCAST_ENTRIES; else both are joined on the host, and Spark
splits a skewed one.

An entry fits a host and all its subdomains if the path starts with the entry's
path. Rules beat list entries; the longest host + path wins. Null urls and urls
without ``://`` have empty host and path, fit no entry, and are allowed. Empty
hosts and labels fit nothing but themselves. Repeated pages are judged alike; an
empty table gives an empty result. Columns other than key and url are left out,
so their names cannot clash.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written

PART_KEYS = 200_000
BROADCAST_ENTRIES = 200_000


def split_urls(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(key, url, host, path); A-Z of the host lower-cased."""
    found = F.instr("url", "://")
    return (
        pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
        .withColumn("rest", F.when(found > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit("")))
        .withColumn("host", F.regexp_extract("rest", r"^[^/?#]*", 0))
        .select("key",
                F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"^[^?#]*", 0).alias("path")))


def digest(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8")) for s in strings), np.uint64, len(strings))


class SortedDigests:
    """A memory-mapped, sorted array of digests with the strings they stand for."""

    def __init__(self, strings: list[str], digests: np.ndarray | None = None):
        keys = digest(strings) if digests is None else digests
        order = np.argsort(keys, kind="stable")
        self.strings = pa.array(strings, pa.large_string()).take(pa.array(order))
        self.order = order
        handle, self.path = tempfile.mkstemp(suffix=".digests")
        with os.fdopen(handle, "wb") as f:
            f.write(keys[order].tobytes())
        self.keys = np.memmap(self.path, np.uint64, "r") if len(keys) else np.zeros(0, np.uint64)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.keys = np.zeros(0, np.uint64)
        os.unlink(self.path)

    def find(self, strings: list[str], digests: np.ndarray | None = None) -> np.ndarray:
        """Number of each string in the list that was given, or -1."""
        keys = digest(strings) if digests is None else digests
        low = np.searchsorted(self.keys, keys, "left")
        high = np.searchsorted(self.keys, keys, "right")
        out = np.full(len(strings), -1, np.int64)
        todo = np.flatnonzero(low < high)
        while len(todo):  # more than one round only where digests collide
            stored = self.strings.take(pa.array(low[todo])).to_pylist()
            same = np.array([a == strings[i] for a, i in zip(stored, todo.tolist())], bool)
            out[todo[same]] = self.order[low[todo[same]]]
            todo = todo[~same]
            low[todo] += 1
            todo = todo[low[todo] < high[todo]]
        return out


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(digest=digest(batch["name"].tolist()).view(np.int64))


def match_hosts(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, entry) for every host of ``hosts`` and every distinct host of ``entries`` that is it or above it."""
    # The host itself and those domains above it that have as many labels as some entry: few numbers, so that a host of
    # very many labels gives no more rows than a short one.
    depths = entries.groupBy(F.size(F.split("host", "[.]")).alias("labels")).count().collect()
    parts = max(1, sum(r["count"] for r in depths) // PART_KEYS)
    wanted = F.array(*[F.lit(n) for n in sorted(r["labels"] for r in depths)]).cast("array<int>")
    domains = hosts.withColumn("labels", F.split("host", "[.]")).select("host", F.explode(F.transform(
        F.filter(wanted, lambda n: n <= F.size("labels")), lambda n: F.array_join(F.slice("labels", -n, n), "."))).alias("name"))

    def keyed(names: DataFrame) -> DataFrame:
        done = names.mapInPandas(_digests, "name string, digest long")
        return done.withColumn("part", F.pmod("digest", F.lit(parts)))

    probes = keyed(domains.select("name").distinct())
    index = keyed(entries.select(F.col("host").alias("name")).distinct())

    def probe(mine: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        names = mine["name"].tolist()
        with SortedDigests(listed["name"].tolist(), listed["digest"].to_numpy(np.int64).view(np.uint64)) as array:
            hit = array.find(names, mine["digest"].to_numpy(np.int64).view(np.uint64)) >= 0
        return mine.loc[hit, ["name"]]

    # Salted, so that a short list (one part) is probed by many tasks.
    salts = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions")) if parts == 1 else 1
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = probes.groupBy("part", "salt").cogroup(index.groupBy("part", "salt")).applyInPandas(probe, "name string")
    return domains.join(found, "name").select("host", F.col("name").alias("entry"))


def judge(pages: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every page.

    ``entries``: host, path, verdict, ruled (true for rules; false for the list).
    """
    split = split_urls(pages, key, url)
    matched = match_hosts(split.select("host").filter("host != ''").distinct(), entries)
    listed = entries.groupBy(F.col("host").alias("entry")).agg(
        F.collect_list(F.struct("ruled", F.length(F.concat("host", "path")).alias("size"), "host", "path", "verdict"))
        .alias("listed"))
    per_host = matched.join(listed, "entry").groupBy("host").agg(F.flatten(F.collect_list("listed")).alias("listed"))
    # Matched hosts are few beside the pages: broadcast if their entries are, so that a hot host's pages stay where they are.
    per_host = written(per_host, "matched-hosts")
    size = per_host.agg(F.sum(F.size("listed"))).first()[0] or 0
    per_host = F.broadcast(per_host) if size <= BROADCAST_ENTRIES else per_host
    fits = F.filter("listed", lambda e: F.col("path").startswith(e["path"]))
    return (
        split.join(per_host, "host", "left")
        .withColumn("best", F.array_max(fits))
        .select(F.col("key").alias(key), "host", "path",
                F.when(F.col("best.ruled"), F.concat("best.host", "best.path")).alias("rule"),
                F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))


# Host labels that put a host on the list of the query.
UNWANTED = ("spam", "pills", "casino", "warez")


def block_list(pages: DataFrame, words: tuple[str, ...] = UNWANTED, url: str = "url") -> DataFrame:
    """List entries for the hosts whose labels hold one of the words between hyphens or dots."""
    hosts = split_urls(pages, url, url).select("host").distinct()
    return hosts.filter(F.col("host").rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")).select(
        "host", F.lit("").alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("ruled"))
