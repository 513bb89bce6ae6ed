"""Kneser-Ney losses with a symbol for every character, for languages that have more of them than an alphabet of quality.py.

The model is that of quality.KneserNey, but its counts, contexts and probabilities are tables: nothing bounds the
characters or trigrams of a language, and no task holds its model. Texts meet the probabilities of their trigrams in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import settle

BITS = 21  # a code point; three of them are a long
EDGE = 2**BITS - 1
_PAIR = 2 ** (2 * BITS) - 1
_AT_ONCE = 2**21
_UNIT = 10**9  # logarithms are added as whole numbers of this share, so sums don't depend on the order of tasks


def trigrams(text: str) -> np.ndarray:
    """Of the folded characters, runs of white space as one, with two edges before and one after."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = quality.folded(cp).astype(np.int64)
    blank = s == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    s = np.concatenate([[EDGE, EDGE], s[keep], [EDGE]]).astype(np.int64)
    return s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, code, n, failed), as quality.count_trigrams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                part, size = ([], []), 0
                for t in [*texts, None]:
                    if t:
                        words = t.encode("utf-8", "surrogatepass").split()
                        own = trigrams(t)
                        part[int(quality.base_failed(len(words), quality.repeated_words(words)))].append(own)
                        size += len(own)
                    if size and (t is None or size > _AT_ONCE):
                        for k in (0, 1):
                            code, n = np.unique(np.concatenate([*part[k], np.zeros(0, np.int64)]), return_counts=True)
                            yield pd.DataFrame({"lang": lang, "code": code, "n": n * (1 - k), "failed": n * k})
                            part[k].clear()
                        size = 0

    counted = docs.select("lang", "text").mapInPandas(run, "lang string, code long, n long, failed long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def _discounted(df: DataFrame, n: str) -> DataFrame:
    """df with the modified Kneser-Ney discount d_ of each count, as quality has them; a row for each language is sent to all tasks."""
    times = df.filter(F.col(n) > 0).groupBy("lang").agg(*(F.count(F.when(F.col(n) == k, 1)).alias(f"n{k}_") for k in (1, 2, 3, 4)))
    n1, n2, n3, n4 = (F.col(f"n{k}_") for k in (1, 2, 3, 4))
    gap, y = F.least(n1, n2, n3, n4) == 0, n1 / (n1 + 2 * n2)
    clip = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    kinds = [F.when(gap, F.lit(fixed)).otherwise(clip(k - (k + 1) * y * b / a, 0.05, high)).alias(f"d{k}_") for k, a, b, fixed, high in ((1, n1, n2, 0.5, 0.95), (2, n2, n3, 0.75, 1.9), (3, n3, n4, 0.9, 2.8))]
    d = F.when(F.col(n) == 1, F.col("d1_")).when(F.col(n) == 2, F.col("d2_")).otherwise(F.col("d3_"))
    return df.join(F.broadcast(times.select("lang", *kinds)), "lang").withColumn("d_", d).drop("d1_", "d2_", "d3_")


def _shares(df: DataFrame, keys: list[str], n: str, level: int) -> DataFrame:
    """(keys, total, share): of each context the sum of its counts and the share of the lower order. Discounts are added as decimals, so in any order."""
    return df.groupBy(*keys).agg(F.sum(n).alias(f"total{level}"), (F.sum(F.col("d_").cast("decimal(12,11)")).cast("double") / F.sum(n)).alias(f"share{level}"))


def log_probabilities(counts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(lang, code, log long) of all rows of count_trigrams, in units of 1 / _UNIT of log10; symbols: (lang, v), the number of symbols of each language."""
    c = F.col
    passes = F.broadcast(counts.groupBy("lang").agg((F.max("n") > 0).alias("passes_")))
    rows = counts.join(passes, "lang").select("lang", "code", F.when(c("passes_"), c("n")).otherwise(c("failed")).alias("n"))
    rows = rows.withColumns({"ab": F.shiftright("code", BITS), "bc": c("code").bitwiseAND(F.lit(_PAIR))})
    # of every bigram, in texts that are not counted too, and its lower orders
    pairs = settle(rows.groupBy("lang", "bc").agg(F.count(F.when(c("n") > 0, 1)).alias("left")).withColumns({"b": F.shiftright("bc", BITS), "c": c("bc").bitwiseAND(F.lit(EDGE))}))
    left = _discounted(pairs.filter("left > 0"), "left")
    first = _discounted(left.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("first")), "first")
    of_lang = _shares(first, ["lang"], "first", 1).join(symbols, "lang").select("lang", "total1", (c("share1") / c("v")).alias("floor"))
    zero, one = F.lit(0.0), F.lit(1.0)
    own = lambda n, total: F.when(c(n) > 0, (c(n) - c("d_")) / c(total)).otherwise(zero)
    lower = first.join(F.broadcast(of_lang), "lang").select("lang", "c", ((c("first") - c("d_")) / c("total1")).alias("o1"))
    p1 = F.coalesce("o1", zero) + c("floor")
    two = _discounted(pairs, "left").join(_shares(left, ["lang", "b"], "left", 2), ["lang", "b"], "left").join(lower, ["lang", "c"], "left").join(F.broadcast(of_lang), "lang")
    two = two.select("lang", "bc", (own("left", "total2") + F.coalesce("share2", one) * p1).alias("p2"))
    full = _discounted(rows, "n").repartition("lang", "ab")
    three = full.join(_shares(full.filter("n > 0"), ["lang", "ab"], "n", 3), ["lang", "ab"], "left").select("lang", "code", "bc", own("n", "total3").alias("o3"), F.coalesce("share3", one).alias("share3"))
    return three.join(two, ["lang", "bc"]).select("lang", "code", F.round(F.log10(c("o3") + c("share3") * c("p2")) * _UNIT).cast("long").alias("log"))


def score(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of quality.SCORED from (doc_id, lang, text) of the languages in symbols (lang, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row, doc_id, lang, text in zip(b["row_"], b["doc_id"].astype("Int64"), b["lang"], b["text"]):
                f = quality.features(text)
                rows.append((row, doc_id, lang, *f, quality.base_failed(f[0], f[4]), len(trigrams(text)) if f[0] else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in told.split(", ")]).astype({"doc_id": "Int64", "size_": "Int64"})

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 256):
                some = b[low : low + 256]
                code, n = zip(*(np.unique(trigrams(text), return_counts=True) for text in some["text"]))
                size = [len(x) for x in code]
                yield pd.DataFrame({"row_": np.repeat(some["row_"].to_numpy(), size), "lang": np.repeat(some["lang"].to_numpy(), size), "code": np.concatenate(code), "k": np.concatenate(n)})

    told = "row_ long, " + quality.SCORED.replace("loss double", "size_ long")
    rows = settle(docs.withColumn("row_", F.monotonically_increasing_id()))  # identifiers may repeat or be null
    logs = log_probabilities(settle(count_trigrams(rows)), symbols)
    met = rows.select("row_", "lang", "text").mapInPandas(dealt, "row_ long, lang string, code long, k long").join(logs, ["lang", "code"])
    sums = met.groupBy("row_").agg(F.sum(F.col("k") * F.col("log")).alias("sum_"))
    judged = rows.mapInPandas(run, told).join(sums, "row_", "left")
    names = [x.split()[0] for x in quality.SCORED.split(", ")][:-1]
    return judged.select(*names, F.when(F.col("size_").isNotNull(), -F.col("sum_") / _UNIT / F.col("size_")).alias("loss"))
