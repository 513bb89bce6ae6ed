"""Rank statistics of many replicates at once.

A replicate counts each cluster's rows so many times. The average rank of a value is then
linear in those counts: one half, the counts of the rows below it, and half the counts of
the rows equal to it. So values are put in order once, and a walk over them adds up, for
each distinct value, either the rows of each cluster (a vector as long as the clusters
are many) or, where replicates are fewer than clusters, the counts of all replicates.
Rows meet the vectors of their two values, and all statistics of all replicates are sums
over the rows: none is copied, ranked or sorted for a replicate. Bootstraps, sign flips
(each row stands once with its value and once with its negative, of which a replicate
counts one) and leaving out a cluster differ only in the counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running
from .settling import settle

#: Numbers of a matrix of counts (clusters x replicates) that are sent to the tasks at once; of a block of vectors in a task.
COUNTS, BLOCK = 1 << 22, 1 << 21


def numbered_clusters(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, i): the distinct clusters, numbered from 0 in their order; counted in ranges."""
    return running(df.select(cluster).filter(F.col(cluster).isNotNull()).distinct(), [F.col(cluster)], {"i": F.lit(1)}).select(cluster, (F.col("i") - 1).cast("int").alias("i"))


def counts_of(times: DataFrame, clusters: int, first: int, last: int) -> np.ndarray:
    """The matrix of counts of replicates from first to before last of a table (replicate, i, times)."""
    got = times.filter((F.col("replicate") >= first) & (F.col("replicate") < last)).select(F.col("i").cast("long"), F.col("replicate").cast("long"), F.col("times").cast("double")).toArrow()
    out = np.zeros((clusters, last - first))
    out[got.column(0).to_numpy(), got.column(1).to_numpy() - first] = got.column(2).to_numpy()
    return out


def blocks(clusters: int, replicates: int) -> list[tuple[int, int]]:
    """Ranges of replicates whose counts are sent at once."""
    step = max(1, COUNTS // max(1, clusters))
    return [(a, min(a + step, replicates)) for a in range(0, replicates, step)] or [(0, 0)]


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _vectors(of: pa.Array) -> np.ndarray:
    """Vectors that were written as the bytes of their doubles."""
    return np.frombuffer(b"".join(of.to_pylist()), np.float64).reshape(len(of), -1)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """The places where a sorted run of rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class Order:
    """Distinct values in their order, with the clusters that have them."""

    NAMES = ("range_", "key", "v", "c", "n")

    def __init__(self, values: DataFrame):
        """values: (key, v, c, n), cluster c has value v n times; orders are inside keys. Rows with n 0 only ask for a value's place."""
        each = values.groupBy("key", "v", "c").agg(F.sum("n").alias("n"))
        self.rows = settle(each.repartitionByRange("key", "v").withColumn("range_", F.spark_partition_id()))

    def walk(self, counts: np.ndarray | None, clusters: int) -> DataFrame:
        """(key, v, at): for each value the counts below it and half of those beside it, as bytes; of each replicate, or without `counts` of each cluster."""
        encode = np.eye(clusters) if counts is None else counts
        inside = self.rows.repartition("range_").sortWithinPartitions("range_", "key", "v")
        sums: dict[str, np.ndarray] = {}
        starts = {}
        for r in sorted(inside.mapInArrow(lambda batches: _totals(batches, encode), "range_ int, key string, sum binary").collect()):
            starts[r.range_, r.key] = sums.get(r.key, np.zeros(encode.shape[1]))
            sums[r.key] = starts[r.range_, r.key] + np.frombuffer(r.sum, np.float64)
        sent = self.rows.sparkSession.sparkContext.broadcast((encode, starts))
        return inside.mapInArrow(lambda batches: _walk(batches, *sent.value), "key string, v double, at binary")


def _totals(batches: Iterable[pa.RecordBatch], encode: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(range_, key, sum) of a task's rows."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        ranges, keys, c, n = _columns(batch, ("range_", "key", "c", "n"))
        for a, b in zip(s := _changes(ranges, keys), [*s[1:], len(ranges)]):
            own = np.bincount(c[a:b], n[a:b], len(encode)) @ encode
            sums[ranges[a], keys[a]] = sums.get((ranges[a], keys[a]), 0) + own
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.string()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())], names=["range_", "key", "sum"])


def _walk(batches: Iterable[pa.RecordBatch], encode: np.ndarray, starts: dict) -> Iterator[pa.RecordBatch]:
    """Running sums over sorted rows. The rows of a value that a batch may have cut wait for the next batch."""
    wait: list[np.ndarray] | None = None
    group, carry = None, None
    for batch in chain(batches, [None]):
        rows = _columns(batch, Order.NAMES) if batch is not None else None
        rows = rows if wait is None else wait if rows is None else [np.concatenate(x) for x in zip(wait, rows)]
        if rows is None:
            return
        runs = _changes(*rows[:3])
        end = len(rows[0]) if batch is None else int(runs[-1]) if len(runs) else 0
        wait = [x[end:] for x in rows]
        a = 0
        while a < end:
            later = runs[(runs > a) & (runs < end)]
            most = max(1, BLOCK // encode.shape[1])
            fit = later[later <= a + most]
            b = end if end - a <= most or not len(later) else int(fit[-1]) if len(fit) else int(later[0])
            ranges, keys, v, c, n = (x[a:b] for x in rows)
            total = np.vstack([np.zeros(encode.shape[1]), np.cumsum(encode[c] * n[:, None], axis=0)])
            first = _changes(ranges, keys, v)
            last = np.append(first[1:], len(v))
            heads = _changes(ranges, keys)
            base = []
            for h in heads:
                base.append((carry if (ranges[h], keys[h]) == group else starts[ranges[h], keys[h]]) - total[h])
                group = ranges[h], keys[h]
            at = (total[first] + total[last]) / 2 + np.array(base)[np.searchsorted(heads, first, "right") - 1]
            carry = base[-1] + total[-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first], pa.string()), pa.array(v[first]), pa.array([x.tobytes() for x in at], pa.binary())], names=["key", "v", "at"])
            a = b


_SUMS = ("sxy", "sxx", "syy", "same", "positive", "upper")


def _sum_up(batches: Iterable[pa.RecordBatch], counts: np.ndarray, sizes: dict[str, np.ndarray], projected: bool, first: int) -> Iterator[pa.RecordBatch]:
    """(key, replicate, sums) of a task's rows."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for a in range(0, batch.num_rows, step := max(1, BLOCK // max(counts.shape))):
            part = batch.slice(a, step)
            keys, c, x, y, label = _columns(part, ("key", "c", "x", "y", "label"))
            rx, ry = (_vectors(part.column(part.schema.get_field_index(k))) for k in ("at_x", "at_y"))
            if not projected:
                rx, ry = rx @ counts, ry @ counts
            for key in dict.fromkeys(keys):
                own = np.flatnonzero(keys == key)
                middle = sizes[key] @ counts / 2  # of all ranks, less the half that ranks have and sums have not
                u, v, w = rx[own] - middle, ry[own] - middle, counts[c[own]]
                up = w * label[own][:, None]
                got = np.array([(w * u * v).sum(0), (w * u * u).sum(0), (w * v * v).sum(0), (w * (np.sign(x[own]) == np.sign(y[own]))[:, None]).sum(0), up.sum(0), (up * rx[own]).sum(0)])
                totals[key] = totals.get(key, 0) + got
    for key, got in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([key] * counts.shape[1], pa.string()), pa.array(np.arange(first, first + counts.shape[1])), *(pa.array(g) for g in got)], names=["key", "replicate", *_SUMS])


def statistics(rows: DataFrame, times: DataFrame | None, clusters: int, replicates: int) -> DataFrame:
    """(key, replicate, n, rho, concordance, auc) of rows (key, c, x, y, label).

    times: (replicate, i, times), how often each replicate counts the rows of cluster i;
    None leaves out cluster i in replicate i. rho is Spearman's with average ranks, null
    under three rows or without spread; concordance the share of rows whose x and y have
    one sign; auc the area under the ROC curve of x for label 1, null without both
    classes. Rows whose x or y is null or NaN don't count.
    """
    sound = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & F.col("c").isNotNull()
    # 0 and -0 are equal, but not as bytes of a key
    rows = settle(rows.filter(sound).select(F.col("key").cast("string").alias("key"), "c", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), F.col("label").cast("double").alias("label")))
    sizes: dict[str, np.ndarray] = {}
    for r in rows.groupBy("key", "c").count().collect():
        sizes.setdefault(r.key, np.zeros(clusters))[r.c] = r["count"]
    orders = [Order(rows.select("key", F.col(k).alias("v"), "c", F.lit(1).alias("n"))) for k in "xy"]
    sc = rows.sparkSession.sparkContext
    out = None
    for first, last in blocks(clusters, replicates):
        counts = counts_of(times, clusters, first, last) if times is not None else 1 - np.eye(clusters)[:, first:last]
        projected = last - first < clusters
        at_x, at_y = (o.walk(counts if projected else None, clusters).select("key", F.col("v").alias(k), F.col("at").alias(f"at_{k}")) for o, k in zip(orders, "xy"))
        met = rows.join(at_x, ["key", "x"]).join(at_y, ["key", "y"])
        sent = sc.broadcast(counts)
        schema = "key string, replicate long, " + ", ".join(f"{s} double" for s in _SUMS)
        summed = met.mapInArrow(lambda batches, sent=sent, projected=projected, first=first: _sum_up(batches, sent.value, sizes, projected, first), schema)
        n = rows.sparkSession.createDataFrame(pa.table({"key": [k for k in sizes for _ in range(first, last)], "replicate": np.tile(np.arange(first, last), len(sizes)), "n": np.concatenate([s @ counts for s in sizes.values()])}) if sizes else [], "key string, replicate long, n double")
        block = summed.groupBy("key", "replicate").agg(*(F.sum(s).alias(s) for s in _SUMS)).join(n, ["key", "replicate"])
        out = block if out is None else out.unionByName(block)
    n, p = F.col("n"), F.col("positive")
    rho = F.when((n >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    # ranks are the counted sums and one half
    auc = F.when((p > 0) & (p < n), (F.col("upper") + p / 2 - p * (p + 1) / 2) / (p * (n - p)))
    return out.select("key", F.col("replicate").cast("int").alias("replicate"), n.cast("long").alias("n"), rho.alias("rho"), F.when(n > 0, F.col("same") / n).alias("concordance"), auc.alias("auc"))


def wins(positives: DataFrame, negatives: DataFrame, group: str, score: str) -> DataFrame:
    """(i_block, j_block, wins): how often a positive of group i (a string) is above a negative of group j, ties a half."""
    names = settle(numbered_clusters(negatives, group))
    k = names.count()
    v = (F.col(score) + 0.0).alias("v")
    pos = settle(positives.groupBy(F.col(group).alias("i_block"), v).agg(F.count(F.lit(1)).alias("p")).filter("v is not null"))
    neg = negatives.filter(F.col(score).isNotNull()).join(names, group).select(F.lit("").alias("key"), v, F.col("i").alias("c"), F.lit(1).alias("n"))
    asked = pos.select(F.lit("").alias("key"), "v", F.lit(0).alias("c"), F.lit(0).alias("n"))
    met = pos.join(Order(neg.unionByName(asked)).walk(None, k).select("v", "at"), "v")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, step := max(1, BLOCK // max(1, k))):
                part = batch.slice(a, step)
                name, p = _columns(part, ("i_block", "p"))
                at = _vectors(part.column(part.schema.get_field_index("at"))) * p[:, None]
                for g in dict.fromkeys(name):
                    sums[g] = sums.get(g, 0) + at[name == g].sum(axis=0)
        for g, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * k, pa.string()), pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], names=["i_block", "i", "wins"])

    met = met.withColumn("i_block", F.col("i_block").cast("string"))
    return met.mapInArrow(add, "i_block string, i int, wins double").groupBy("i_block", "i").agg(F.sum("wins").alias("wins")).join(names, "i").select("i_block", F.col(group).alias("j_block"), "wins")
