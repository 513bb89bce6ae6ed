"""URL filters on a sorted digest array.

The list (keys such as `example.org/es/`, with a verdict each) becomes three
arrays sorted by the key's 64-bit xxhash. Each task memory-maps them, probes all
keys a url could match (host and parent domains x path prefixes of the listed
lengths) by one vectorised binary search, and compares the stored string of every
hit, so that a digest collision changes nothing.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

#: The lists are the operator's parameters: ordered rules, and host names to block.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))


class Listed(NamedTuple):
    key: str
    verdict: str
    kind: str  # "rule", or "list" for what the rules leave open


def listed(rules: Iterable[tuple[str, str]] = RULES, hosts: Iterable[str] = BLOCKED_HOSTS) -> list[Listed]:
    return [Listed(k, v, "rule") for k, v in rules] + [Listed(h.lower(), "block", "list") for h in hosts]


def digest64(key: bytes) -> int:
    """As Spark's xxhash64 of the string."""
    return xxhash.xxh64_intdigest(key, 42)


def write_index(entries: list[Listed], folder: str, digest=digest64) -> list[str]:
    """The sorted digest array with offsets into the stored strings; returns the files. Where a key comes twice, its first entry holds."""
    first: dict[tuple[str, str], Listed] = {}
    for e in entries:
        first.setdefault((e.key, e.kind), e)
    rows = sorted(first.values(), key=lambda e: (digest(e.key.encode()), e.key, e.kind))
    size = sum(len(_stored(e)) for e in rows)
    return _write(((digest(e.key.encode()), e) for e in rows), len(rows), size, {_tail(e.key) for e in rows}, max(map(_labels, (e.key for e in rows)), default=0), folder)


def write_index_of(table: DataFrame, folder: str) -> list[str]:
    """As write_index from a table (key, verdict, kind), of any size: Spark sorts it, and the driver's disk gets the rows one partition after another.

    Of several verdicts of a key of one kind, the smallest holds; rows without a key or verdict are left out.
    """
    once = table.filter("key is not null and verdict is not null").groupBy("key", F.coalesce("kind", F.lit("list")).alias("kind")).agg(F.min("verdict").alias("verdict"))
    digest = F.xxhash64("key")
    rows = settle(once.withColumn("digest", digest).orderBy(digest.bitwiseXOR(F.lit(-(2**63))), "key", "kind"))
    slash = F.locate("/", "key")
    sizes = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("key") + F.octet_length("verdict") + F.octet_length("kind") + 2), F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))).first()
    tails = rows.select(F.when(slash > 0, F.length("key") - slash + 1).otherwise(0).alias("n")).distinct().collect()  # as many as the longest path is long
    ordered = rows.orderBy(F.col("digest").bitwiseXOR(F.lit(-(2**63))), "key", "kind")
    stream = ((r.digest % 2**64, Listed(r.key, r.verdict, r.kind)) for r in ordered.toLocalIterator(prefetchPartitions=True))
    return _write(stream, sizes[0], sizes[1] or 0, {r.n for r in tails}, sizes[2] or 0, folder)


def _stored(e: Listed) -> bytes:
    return f"{e.kind}\n{e.verdict}\n{e.key}".encode()


def _tail(key: str) -> int:
    return len(key) - key.find("/") if "/" in key else 0


def _labels(key: str) -> int:
    return key.partition("/")[0].count(".") + 1


def _write(rows: Iterable[tuple[int, Listed]], n: int, size: int, tails: set[int], labels: int, folder: str) -> list[str]:
    files = {"digests": (np.uint64, n), "offsets": (np.int64, n + 1), "strings": (np.uint8, size), "lengths": (np.int64, len(tails)), "labels": (np.int64, 1)}
    paths = {name: os.path.join(folder, f"{name}.npy") for name in files}
    out = {name: np.lib.format.open_memmap(paths[name], "w+", kind, (m,)) if m else np.zeros(0, kind) for name, (kind, m) in files.items()}
    out["lengths"][:], out["labels"][:] = sorted(tails), labels
    at = 0
    for i, (digest, e) in enumerate(rows):
        blob = _stored(e)
        out["digests"][i], out["strings"][at : at + len(blob)], at = digest, np.frombuffer(blob, np.uint8), at + len(blob)
        out["offsets"][i + 1] = at
    for name, array in out.items():
        array.flush() if isinstance(array, np.memmap) else np.save(paths[name], array)
    return list(paths.values())


class Index:
    """The arrays, memory-mapped; `find` returns the entries of each key."""

    def __init__(self, paths: list[str], digest=digest64):
        self.digests, self.offsets, self.strings, self.lengths, labels = (np.load(p, mmap_mode="r" if os.path.getsize(p) > 128 else None) for p in paths)
        self.labels, self.digest = int(labels[0]), digest

    def find(self, keys: list[str]) -> list[list[Listed]]:
        probes = np.fromiter((self.digest(k.encode()) for k in keys), np.uint64, len(keys))
        at, end = (np.searchsorted(self.digests, probes, side) for side in ("left", "right"))
        out: list[list[Listed]] = [[] for _ in keys]
        for i in np.flatnonzero(end > at):
            for j in range(at[i], end[i]):
                kind, verdict, key = bytes(self.strings[self.offsets[j] : self.offsets[j + 1]]).decode().split("\n", 2)
                if key == keys[i]:
                    out[i].append(Listed(key, verdict, kind))
        return out

    def keys(self, host: str, path: str) -> list[str]:
        """The keys that would fit: the host and each parent domain of no more labels than a listed one has, with the path's prefixes of the listed lengths."""
        tails = [path[:n] for n in self.lengths if n <= len(path)]
        labels = host.rsplit(".", self.labels)[-self.labels :]
        return [".".join(labels[i:]) + t for i in range(len(labels)) for t in tails] if host else []


def judge(index: Index, hosts: Iterable[str], paths: Iterable[str]) -> list[tuple[str | None, str]]:
    """(rule or None, verdict) of each url; the longest rule wins, then the list, then allow."""
    probes = [index.keys(h, p) for h, p in zip(hosts, paths)]
    flat = list(dict.fromkeys(k for ks in probes for k in ks))
    hits = {k: found for k, found in zip(flat, index.find(flat)) if found}
    out = []
    for ks in probes:
        found = [e for k in ks for e in hits.get(k, ())]
        rule = max((e for e in found if e.kind == "rule"), key=lambda e: len(e.key), default=None)
        out.append((rule.key, rule.verdict) if rule else (None, "block" if any(e.kind == "list" for e in found) else "allow"))
    return out


def ship_index(spark: SparkSession, entries: list[Listed] | DataFrame) -> list[str]:
    """Write the arrays and have Spark hand them to every executor; returns the names for SparkFiles.get. The driver's copy goes when it ends."""
    folder = tempfile.mkdtemp(prefix="urls-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    paths = write_index_of(entries, folder) if isinstance(entries, DataFrame) else write_index(entries, folder)
    names = []
    for p in paths:
        name = f"{os.path.basename(folder)}-{os.path.basename(p)}"
        os.rename(p, to := os.path.join(folder, name))
        spark.sparkContext.addFile(to)
        names.append(name)
    return names


def filter_urls(pages: DataFrame, entries: list[Listed] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages.

    `entries` is a list, or a table (key, verdict, kind) of any size that fits a disk; it
    reaches the executors as files. Null urls and those without
    `://` have empty host and path and are allowed. Repeated rows stay; an empty
    table gives an empty one; other columns are not read.
    """
    names = ship_index(pages.sparkSession, listed() if entries is None else entries)
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    cut = pages.select(
        F.col(id_col).alias("page_id"),
        F.translate(F.coalesce(F.regexp_extract(url_col, rest, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.coalesce(F.regexp_extract(url_col, rest, 2), F.lit("")).alias("path"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index([SparkFiles.get(n) for n in names])
        for b in batches:
            found = judge(index, b["host"], b["path"])
            yield b.assign(rule=[x[0] for x in found], verdict=[x[1] for x in found])

    return cut.mapInPandas(run, f"page_id {cut.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


_LIST = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
_RULES = ", ".join(f"('{k[: k.find('/')]}', '{k[k.find('/') :]}', '{v}')" for k, v in RULES)
ORACLE = rf"""
WITH u AS (SELECT page_id, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1)), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, p, v) AS (VALUES {_RULES}), l(h) AS (VALUES {_LIST}),
best AS (SELECT u.page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.v, length(r.h || r.p)) AS v
         FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY 1),
bad AS (SELECT DISTINCT u.page_id FROM u JOIN l ON u.host = l.h OR ends_with(u.host, '.' || l.h))
SELECT u.page_id, u.host, u.path, best.rule, CASE WHEN best.rule IS NOT NULL THEN best.v WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN best USING (page_id) LEFT JOIN bad USING (page_id)
"""
