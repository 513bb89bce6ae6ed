"""SimHash near-duplicates with pivot distance tables.

A fingerprint's coordinates are its Hamming distances to reference fingerprints
(pivots), computed once for each distinct fingerprint and kept in a table. By the
triangle inequality two fingerprints within r differ by r at most in every coordinate,
so a pair with a larger difference is discarded unseen; survivors are verified.
Coordinates of random fingerprints lie close together, so they can't deal out the work
alone: fingerprints meet where `blocks - r` of `blocks` bit blocks are equal (which r
differing bits can't prevent) and the first pivot's cells are the same or next to each
other. A task returns a spanning forest of its links, not the pairs.

`similar_documents` finds texts by the Jaccard similarity of their shingles. Such pairs
differ in many bits, so wide fingerprints are compared where they agree in sampled
bits, in as many samples as a bound of missed pairs asks for. Members of a bucket are
its pivots there, as only those have some texts near and others far; survivors are
verified by their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty, words_of
from .graph import components

PIVOTS = np.random.default_rng(20240229).integers(0, 2**64, 16, dtype=np.uint64)
#: Words of a wide fingerprint, and the bits in which those of similar texts may differ: 39 +- 6 at a similarity of 0.8.
WIDE, BOUND = 4, 56
#: Rows from which on a bucket is crowded; its texts get fingerprints of FINE words, which may differ in FINE_BOUND bits: 155 +- 12 at 0.8.
CROWD, FINE, FINE_BOUND = 64, 16, 190
#: Rows of a crowded bucket, and bytes of their shingles' hashes, that a task compares with as many others; the rows that are its pivots.
GROUP, GROUP_BYTES, PIVOT_ROWS = 8192, 1 << 23, 8
CELL = ["t", "bucket", "i", "j"]
_TIE = np.random.default_rng(20240301).integers(0, 2, 64 * FINE).astype(bool)
_ODD = np.random.default_rng(20240302).integers(0, 2**63, (2, FINE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Wanted texts up to this number (4 MB of hashes) are looked up without shuffling the others.
FEW = 1 << 18


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the runs of `shingle` words, or of a shorter text as a whole; repeated ones stay."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    whole, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(whole[a:z], 42) for a, z in zip(starts, ends[len(words) - n :])), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    h = shingle_hashes(text, shingle)
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """One mask for each choice of `blocks - radius` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(c) for c in combinations(bits, blocks - radius)]


def coordinates(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.uint8)


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, c binary): the coordinates of each fingerprint, one byte for each pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"fp": b["fp"], "c": [x.tobytes() for x in coordinates(b["fp"].to_numpy().view(np.uint64))]})

    return fps.select("fp").mapInPandas(run, "fp long, c binary")


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of all edges one label, that of the smallest position."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (label[label] != label).any():
            label[:] = label[label]


def _balls(fp: np.ndarray, label: np.ndarray, radius: int) -> None:
    """Labels of a crowded cell: fingerprints within half the radius of a centre are linked without a comparison of pairs.

    Another one can be linked to such a ball only within one and a half radii of its
    centre; of these, those with another label are compared with the ball.
    """
    free = np.ones(len(fp), bool)
    while free.any():
        centre = int(np.argmax(free))
        d = np.bitwise_count(fp ^ fp[centre])
        ball = np.flatnonzero(d <= radius // 2)
        free[ball] = False
        _join(label, np.full(len(ball), centre), ball)
        near = np.flatnonzero((d <= radius + radius // 2) & (label != label[centre]))
        for at in range(0, len(near), 1024):
            x = near[at : at + 1024]
            i, j = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[ball][None, :]) <= radius)
            _join(label, x[i], ball[j])


def _forest(fp: np.ndarray, guest: np.ndarray, radius: int, c: np.ndarray | None = None, crowded: int = 4096) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in one cell; c: the coordinates. Guests come from the cell before and don't meet each other here."""
    c = coordinates(fp) if c is None else c
    order = np.argsort(c[:, 0], kind="stable")
    fp, guest, c = fp[order], guest[order], c[order].astype(np.int8)
    label = np.arange(len(fp))
    if len(fp) > crowded:
        _balls(fp, label, radius)
    else:
        for at in range(0, len(fp), 256):
            rows = slice(at, min(at + 256, len(fp)))
            high = int(np.searchsorted(c[:, 0], c[rows.stop - 1, 0] + radius, "right"))
            near = np.abs(c[rows, None, 1] - c[None, at:high, 1]) <= radius
            near &= np.abs(c[rows, None, 0] - c[None, at:high, 0]) <= radius
            i, j = np.nonzero(near)
            i, j = i + at, j + at
            keep = (i < j) & ~(guest[i] & guest[j])
            i, j = i[keep], j[keep]
            for k in range(2, c.shape[1]):
                keep = np.abs(c[i, k] - c[j, k]) <= radius
                i, j = i[keep], j[keep]
            keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            _join(label, i[keep], j[keep])
    far = np.flatnonzero(label != np.arange(len(fp)))
    return list(zip(fp[far].view(np.int64).tolist(), fp[label[far]].view(np.int64).tolist()))


def links(fps: DataFrame, n: int, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that join all of fps (distinct column fp; n rows) within `radius`, directly or by others.

    `blocks` is a number above the radius; any finds all links. More, smaller blocks
    make more copies of a row and smaller cells; the default goes by n.
    """
    blocks = blocks or radius + (1 if n < 2**22 else 2 if n < 2**28 else 3 if n < 2**34 else 4)
    table = settle(pivot_table(fps))
    signed = [m - 2**64 if m >= 2**63 else m for m in block_masks(blocks, radius)]
    cell = F.floor(F.conv(F.hex(F.substring("c", 1, 1)), 16, 10).cast("int") / (radius + 1)).cast("int")
    meet = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)))).alias("k")
    side = F.explode(F.array(F.struct(cell.alias("cell"), F.lit(False).alias("guest")), F.struct((cell + 1).alias("cell"), F.lit(True).alias("guest")))).alias("s")
    dealt = table.select("fp", "c", side).select("fp", "c", "s.*", meet).select("fp", "c", "cell", "guest", "k.*").repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def edges(b: pd.DataFrame) -> pd.DataFrame:
            t, key, cell_, fp, guest = (b[x].to_numpy() for x in ("t", "key", "cell", "fp", "guest"))
            c = np.frombuffer(b"".join(b["c"]), np.uint8).reshape(len(b), -1)
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(cell_) != 0)) + 1
            out: list[tuple[int, int]] = []
            for a, z in zip([0, *cuts], [*cuts, len(b)]):
                if z - a > 1 and not guest[a:z].all():
                    out += _forest(fp[a:z].view(np.uint64), guest[a:z], radius, c[a:z])
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for b in batches:
            if not len(b):
                continue
            last = b.iloc[-1]
            same = ((b["t"] == last["t"]) & (b["key"] == last["key"]) & (b["cell"] == last["cell"])).to_numpy()
            at = int(len(b) - np.argmin(same[::-1])) if not same.all() else 0
            if at:
                yield edges(pd.concat([*rest, b.iloc[:at]]))
                rest = [b.iloc[at:]]
            elif rest and tuple(rest[-1].iloc[-1][["t", "key", "cell"]]) != tuple(last[["t", "key", "cell"]]):
                yield edges(pd.concat(rest))
                rest = [b]
            else:
                rest.append(b)
        if rest:
            yield edges(pd.concat(rest))

    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Null text counts as empty and has fingerprint zero, which links like any other.
    Rows with a null identifier take part in links; a component of such rows alone has
    a null component_id. Repeated rows stay; an empty table gives an empty one; other
    columns are not read.
    """
    sig = settle(fingerprints(docs, id_col, text_col, shingle))
    fps = settle(sig.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(fps.select("fp"), n := fps.count(), radius, blocks))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    # a fingerprint may have any number of rows: where the distinct ones are few, none is shuffled; else Spark splits it
    return sig.join(F.broadcast(of) if n <= FEW else of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(h: np.ndarray, words: int = WIDE) -> np.ndarray:
    """Words whose bits are the majorities of the bits of so many hashes of each shingle; ties go by a fixed pattern."""
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(h), 1 << 12):
        x = h[i : i + (1 << 12), None]
        x = (x ^ (x >> np.uint64(29))) * _ODD[None, 0, :words]
        x = (x ^ (x >> np.uint64(32))) * _ODD[None, 1, :words]
        ones += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits((2 * ones > len(h)) | ((2 * ones == len(h)) & _TIE[: 64 * words]), bitorder="little").view(np.uint64)


def sampling(n: int, similarity: float, missed: float) -> tuple[int, int]:
    """(bits of a sample, samples) for n fingerprints: buckets of about 32, and samples until a pair of the similarity meets in none with a probability of `missed`."""
    bits = max(8, math.ceil(math.log2(max(2, n))) - 5)
    same = (1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - same)) if same < 1 else 1


def _masks(bits: int, samples: int) -> np.ndarray:
    """The sampled bits, in WIDE words."""
    rng = np.random.default_rng(20240303)
    return np.array([np.packbits(np.isin(np.arange(64 * WIDE), rng.permutation(64 * WIDE)[:bits]), bitorder="little").view(np.uint64) for _ in range(samples)])


def _dealt(once: DataFrame, masks: np.ndarray) -> DataFrame:
    """(t, bucket, key, root, w0, ...): each fingerprint in its bucket of each sample."""
    samples, wide = len(masks), [f"w{k}" for k in range(WIDE)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                w = part[wide].to_numpy(np.int64).view(np.uint64)
                bucket = np.zeros((samples, len(part)), np.uint64)
                for k in range(WIDE):
                    bucket = (bucket ^ (bucket >> np.uint64(29)) ^ (w[None, :, k] & masks[:, None, k])) * _ODD[0, k]
                out = {"t": np.repeat(np.arange(samples, dtype=np.int16), len(part)), "bucket": bucket.reshape(-1).view(np.int64)}
                yield pd.DataFrame(out | {c: np.tile(part[c].to_numpy(), samples) for c in ("key", "root", *wide)})

    columns = ", ".join(f"{c} long" for c in ("bucket", "key", "root", *wide))
    return once.select("key", "root", *wide).mapInPandas(run, f"t short, {columns}")


def _neighbours(dealt: DataFrame) -> DataFrame:
    """Pairs (a, b, d) next to each other in a bucket in the order of fingerprints, within BOUND; a crowded bucket may go through many tasks."""
    order = ["t", "bucket", "w0", "key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            if not len(b):
                continue
            joined = b if last is None else pd.concat([last, b])
            last = b.iloc[-1:]
            t, bucket, key = (joined[c].to_numpy() for c in ("t", "bucket", "key"))
            w = joined[[f"w{k}" for k in range(WIDE)]].to_numpy(np.int64).view(np.uint64)
            d = np.bitwise_count(w[1:] ^ w[:-1]).sum(axis=1, dtype=np.int32)
            same = (t[1:] == t[:-1]) & (bucket[1:] == bucket[:-1])
            at = np.flatnonzero(same & (key[1:] != key[:-1]) & (d <= BOUND))
            x, y = key[at], key[at + 1]
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "d": d[at]})

    return dealt.drop("root").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long, d int").distinct()


def _whole(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut so that rows that agree in `by` come together."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b.iloc[-1]
        at = int(np.argmax((b[by] == last[by]).to_numpy().all(axis=1)))
        if held and (at or (held[-1].iloc[-1][by] != last[by]).any()):
            yield pd.concat([*held, b.iloc[:at]])
            held = []
        elif at:
            yield b.iloc[:at]
        held.append(b.iloc[at:])
    if held:
        yield pd.concat(held)


def _across(dealt: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket that isn't crowded, within BOUND, that have different roots.

    A bucket's first rows are its pivots: a pair whose distances to one of them differ by over BOUND is discarded uncompared.
    """
    rest = dealt.join(crowded, ["t", "bucket"], "left_anti").repartition("t", "bucket").sortWithinPartitions("t", "bucket", "root")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole(batches, ["t", "bucket"]):
            t, bucket, key, root = (part[c].to_numpy() for c in ("t", "bucket", "key", "root"))
            w = part[[f"w{k}" for k in range(WIDE)]].to_numpy(np.int64).view(np.uint64)
            first = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])) + 1])
            size = np.diff(np.append(first, len(part)))
            start, end = np.repeat(first, size), np.repeat(first + size, size)
            c = [np.bitwise_count(w ^ w[np.minimum(start + k, end - 1)]).sum(axis=1, dtype=np.int16) for k in range(3)]
            at = np.arange(len(part))
            for step in range(1, int(size.max())):
                at = at[at + step < end[at]]
                i, j = at, at + step
                keep = root[i] != root[j]
                for x in c:
                    keep &= np.abs(x[i] - x[j]) <= BOUND
                i, j = i[keep], j[keep]
                near = np.bitwise_count(w[i] ^ w[j]).sum(axis=1, dtype=np.int16) <= BOUND
                x, y = key[i[near]], key[j[near]]
                if len(x):
                    yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return rest.mapInPandas(run, "a long, b long").distinct()


def _met(w: np.ndarray, group: np.ndarray, label: np.ndarray, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of pairs of a cell of a crowded bucket that are within both bounds and differ in a bit of each of the masks; not those that have one label or, where the cell has two groups, one group.

    Rows in even steps of the cell are its pivots: a pair whose distances to one of them differ by over FINE_BOUND is discarded uncompared. label may change between steps.
    """
    n = len(w)
    two = bool((group != group[0]).any())
    c = np.stack([np.bitwise_count(w ^ w[p]).sum(axis=1, dtype=np.int16) for p in np.unique(np.linspace(0, n - 1, PIVOT_ROWS).astype(int))])
    for at in range(n - 1):
        j = at + 1 + np.flatnonzero((label[at + 1 :] != label[at]) & (~two | (group[at + 1 :] != group[at])))
        for x in c:
            j = j[np.abs(x[j] - x[at]) <= FINE_BOUND]
        j = j[np.bitwise_count(w[j, :WIDE] ^ w[at, :WIDE]).sum(axis=1, dtype=np.int16) <= BOUND]
        j = j[np.bitwise_count(w[j] ^ w[at]).sum(axis=1, dtype=np.int16) <= FINE_BOUND]
        if len(j) and len(masks):
            j = j[((w[j, None, :WIDE] ^ w[at, :WIDE]) & masks).any(axis=2).all(axis=1)]
        if len(j):
            yield np.full(len(j), at), j


def _groups(size: Column) -> Column:
    """n_: the groups of a bucket, by the sum of size."""
    return F.greatest(F.ceil(F.sum(size)), F.lit(1)).cast("int").alias("n_")


def _celled(rows: DataFrame, size: Column) -> DataFrame:
    """rows (t, bucket, key, root, ...) of crowded buckets with (own, i, j): a bucket is dealt into n_ groups, by the sum of size where rows don't have that column, and each two groups meet in a cell."""
    if "n_" not in rows.columns:
        rows = rows.join(rows.groupBy("t", "bucket").agg(_groups(size)), ["t", "bucket"])
    own = F.pmod(F.xxhash64("key"), F.col("n_")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("other")
    dealt = rows.select(*rows.columns, own.alias("own"), other).drop("n_")
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other").repartition(*CELL).sortWithinPartitions(*CELL, "root")


def _partnered(members: DataFrame, fine: DataFrame, masks: np.ndarray) -> DataFrame:
    """The rows of members (t, bucket, key, root) of crowded buckets that have a partner of another root within both bounds, with their fine words.

    Only the first sample in which a pair agrees tells of it. A cell has at most about two groups of GROUP rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parts in _whole(batches, CELL):
            for _, part in parts.groupby(CELL, sort=False):
                w = np.frombuffer(b"".join(part["words"]), np.uint64).reshape(len(part), FINE)
                has = np.zeros(len(part), bool)
                for i, j in _met(w, part["own"].to_numpy(), part["root"].to_numpy(), masks[: part["t"].iloc[0]]):
                    has[i[0]] = True
                    has[j] = True
                if has.any():
                    yield part.loc[has, ["t", "bucket", "key", "root", "words"]]

    return _celled(members.join(fine, "key"), F.lit(1 / GROUP)).mapInPandas(run, "t short, bucket long, key long, root long, words binary").dropDuplicates(["t", "bucket", "key"])


def _forest_of_similar(rows: DataFrame, masks: np.ndarray, similarity: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of the similar pairs of rows (_partnered, with hashes of the shingles), for each cell.

    Pairs are verified where they meet, and none that the cell's edges already join is looked at, so a cell gives fewer rows than it
    has, however many of its pairs are similar or nearly so. A cell holds the hashes of at most about two groups of GROUP_BYTES.
    """

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(part["words"]), np.uint64).reshape(len(part), FINE)
        size = part["hashes"].str.len().to_numpy() // 8
        ends = np.cumsum(size)
        distinct, ids = np.unique(np.frombuffer(b"".join(part["hashes"]), np.uint64), return_inverse=True)
        mine = np.zeros(len(distinct), bool)
        key = part["key"].to_numpy()
        label = np.unique(part["root"].to_numpy(), return_inverse=True)[1]
        a: list[int] = []
        b: list[int] = []
        for i, j in _met(w, part["own"].to_numpy(), label, masks[: part["t"].iloc[0]]):
            x = i[0]
            own = ids[ends[x] - size[x] : ends[x]]
            mine[own] = True
            shared = np.concatenate([[0], np.cumsum(mine[np.concatenate([ids[ends[y] - size[y] : ends[y]] for y in j])])])
            mine[own] = False
            upto = np.cumsum(size[j])
            both = shared[upto] - shared[upto - size[j]]
            for y in j[both >= similarity * (size[x] + size[j] - both)]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    a.append(min(key[x], key[y]))
                    b.append(max(key[x], key[y]))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parts in _whole(batches, CELL):
            for _, part in parts.groupby(CELL, sort=False):
                yield edges(part)

    return _celled(rows, F.greatest(F.length("hashes") / GROUP_BYTES, F.lit(1 / GROUP))).mapInPandas(run, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, missed: float = 1e-3) -> DataFrame:
    """(id_col, component_id), one row for each row of docs: groups joined by pairs of texts whose sets of shingles have the Jaccard similarity or more.

    Wide fingerprints are compared in the buckets of sampled bits; what is within BOUND
    is verified by the shingles, so no link is wrong. A pair of the similarity, in
    sets of equal size, meets in no bucket with a probability of `missed`, and has more than BOUND
    different bits with 3e-3 (at 0.8). First each text's nearest neighbour in the
    order of a bucket is tried; what that joins needs no more pairs, and of the rest all
    pairs of a bucket are that its pivots don't discard, those of crowded buckets by finer
    fingerprints and in the task where they meet, which gives back a forest. component_id is a group's smallest identifier, nulls last; it may
    be of any type that has an order. Texts without words are alike. Repeated rows
    and null identifiers stay; an empty table gives an empty one; other columns are not read.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    wide = [f"w{k}" for k in range(WIDE)]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b["text"]]
            keys = np.fromiter((xxhash.xxh64_intdigest(h.tobytes()) for h in sets), np.uint64, len(b)).view(np.int64)
            w = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(len(b), WIDE).view(np.int64)
            yield pd.DataFrame({"text_hash": b["text_hash"], "set_": keys} | {c: w[:, k] for k, c in enumerate(wide)})

    signed = settle(rows.select("text", "text_hash").mapInPandas(sign, "text_hash long, set_ long, " + ", ".join(f"{c} long" for c in wide)).dropDuplicates(["text_hash"]))
    # texts of one set of shingles are one node, known by a text of theirs, so that its text is found without another join
    once = settle(signed.groupBy("set_").agg(F.min("text_hash").alias("key"), *(F.first(c).alias(c) for c in wide)))
    masks = _masks(*sampling(once.count(), similarity, missed))

    def texts_of(keys: DataFrame) -> DataFrame:
        """(key, text): a text of each of the keys."""
        wanted = settle(keys.select(F.col("key").alias("text_hash")))
        return rows.select("text", "text_hash").join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "text_hash").dropDuplicates(["text_hash"]).select(F.col("text_hash").alias("key"), "text")

    def fine_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "words": [wide_fingerprint(np.unique(shingle_hashes(t, shingle)), FINE).tobytes() for t in b["text"]]})

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "hashes": [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b["text"]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those that are similar."""
        pairs = settle(pairs.select("a", "b"))
        sets = settle(texts_of(pairs.select(F.col("a").alias("key")).distinct().unionByName(pairs.select(F.col("b").alias("key")).distinct()).distinct()).mapInPandas(sets_of, "key long, hashes binary"))
        sided = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
        return settle(sided.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long"))

    def crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends have different roots."""
        ends = pairs
        for end in "ab":
            ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        return ends.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)

    def rooted(of: DataFrame, roots: DataFrame) -> DataFrame:
        return of.join(roots, F.col("key") == F.col("node"), "left").select(*of.columns, F.coalesce("root", "key").alias("root"))

    own = once.withColumn("root", F.col("key"))
    near = settle(_neighbours(_dealt(own, masks)))
    best = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b")).unionByName(near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"))
    edges = verified(best.distinct())
    roots = settle(components(edges))
    edges = edges.unionByName(verified(crossing(near, roots)))
    roots = settle(components(edges))
    dealt = _dealt(rooted(once, roots), masks)
    of = dealt.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("rows_"), F.min("root").alias("low"), F.max("root").alias("high"), _groups(F.lit(1 / GROUP)))
    crowded = settle(of.filter(F.col("rows_") >= CROWD))
    edges = edges.unionByName(verified(_across(dealt, crowded.select("t", "bucket"))))
    several = crowded.filter("low < high").select("t", "bucket", "n_")  # buckets of one root have no pair to try
    if not several.isEmpty():
        members = settle(dealt.join(several, ["t", "bucket"]).select("t", "bucket", "key", "root", "n_"))
        fine = settle(texts_of(members.select("key").distinct()).mapInPandas(fine_words, "key long, words binary"))
        partnered = settle(_partnered(members, fine, masks))
        sets = texts_of(partnered.select("key").distinct()).mapInPandas(sets_of, "key long, hashes binary")
        edges = edges.unionByName(settle(_forest_of_similar(partnered.join(sets, "key"), masks, similarity)))
    roots = settle(components(edges))
    placed = settle(rows.select(id_col, "text_hash").join(rooted(signed.select("text_hash", "set_").join(once.select("set_", "key"), "set_"), roots).drop("key", "set_"), "text_hash").select(id_col, "root"))
    least = placed.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"))).alias("least"))
    return placed.join(least, "root").select(id_col, F.col("least.id").alias("component_id"))
