import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import simhash
from strandloom.llm.graph import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, radius=4):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[top(a)] = top(b)
    return {v: top(v) for v in values}


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    for _ in range(300):
        text = rng.choice(["", " "]).join(rng.choices(["A", "bé", " ", " ", "\n", "cc", "\t"], k=rng.randint(0, 30)))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_components_follow_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_links_lose_nothing(spark):
    rng = random.Random(2)
    values = set()
    while len(values) < 600:
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 30])):
            values.add(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
    values = sorted(values)
    want = roots(values)
    fps = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for n in (len(values), 2**25):  # either number of blocks finds all
        got = {r.node % 2**64: r.root for r in components(simhash.links(fps, n)).collect()}
        groups, wanted = {}, {}
        for v in values:
            groups.setdefault(got.get(v, ("own", v)), set()).add(v)
            wanted.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("fp", F.lit("clash"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "one two"), (-5, "word " * 30000)], "doc_id long, text string")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    got = simhash.near_duplicates(rows).collect()
    texts = [(r.doc_id, simhash.fingerprint(r.text)) for r in rows.collect()]
    want = roots(sorted({f for _, f in texts}))
    least = {}
    for d, f in texts:
        if d is not None:
            least[want[f]] = min(d, least.get(want[f], d))
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(map(str, ((d, f"{f:016x}", least.get(want[f])) for d, f in texts)))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_forest_of_guests():
    fp = np.array([0, 1, 3], np.uint64)
    assert len(simhash._forest(fp, np.array([True, True, False]), 4)) == 2


def test_crowded_cells_lose_nothing():
    rng = np.random.default_rng(5)
    for radius in (4, 5):
        fp = np.zeros(0, np.uint64)
        while len(fp) < 500:
            v = rng.integers(0, 2**64, dtype=np.uint64)
            flips = np.left_shift(np.uint64(1), rng.integers(0, 64, (60, 5), dtype=np.uint64))
            fp = np.unique(np.concatenate([fp, v ^ np.bitwise_xor.reduce(flips[:, : int(rng.integers(1, 6))], axis=1)]))
        label, other = np.arange(len(fp)), np.arange(len(fp))
        simhash._balls(fp, label, radius)
        i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
        simhash._join(other, i, j)
        assert (label == other).all()
