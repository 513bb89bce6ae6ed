import random
import re

import corpus_pipeline
import numpy as np
from strandloom.llm import simhash
from strandloom.llm.common import words_of


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """Smallest position that each position reaches by pairs of 0.8 or more."""
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y) > 0:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return top


def joined(n, edges):
    """Smallest position that each of n positions reaches by edges."""
    top = list(range(n))
    for i, j in edges:
        a, b = sorted((top[i], top[j]))
        top = [a if t == b else t for t in top]
    return top


def near_texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = ["", " \n", "one two", "One two"]
    for n in (60, 200, 900):
        for _ in range(12):
            words = rng.choices(vocabulary, k=n)
            texts.append(" ".join(words))
            for share in (0.008, 0.015, 0.02, 0.03):
                texts.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words))
    return texts


def test_stage_against_brute_force_jaccard(spark, sf_dir):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    top = groups(texts)
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == dict(enumerate(top))
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()} == set(top)
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_many_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join("x" if i == at else w for i, w in enumerate(words)) for at in rng.sample(range(400), 150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_documents(docs).collect()} == {0}


def test_a_crowded_bucket_gives_a_forest_and_not_pairs(spark, monkeypatch):
    rng = random.Random(10)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for n in range(300):  # most pairs have a similarity of 0.7 to 0.8
        at = set(rng.sample(range(400), 6))
        texts.append(" ".join(f"x{n}" if i in at else w for i, w in enumerate(base)))
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    rows = [(0, 7, i, i, bytearray(simhash.wide_fingerprint(h, simhash.FINE).tobytes()), bytearray(h.tobytes())) for i, h in enumerate(sets)]
    rows = spark.createDataFrame(rows, "t short, bucket long, key long, root long, words binary, hashes binary").cache()
    partnered = simhash._partnered(rows.select("t", "bucket", "key", "root"), rows.select("key", "words"), simhash._masks(8, 2))
    assert partnered.count() == len(texts)
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    w = np.array([simhash.wide_fingerprint(h, simhash.FINE) for h in sets])
    apart = np.bitwise_count(w[:, None] ^ w[None])
    near = (apart[:, :, : simhash.WIDE].sum(axis=2) <= simhash.BOUND) & (apart.sum(axis=2) <= simhash.FINE_BOUND)
    links = [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1))) if alike(a, b)]
    top = joined(len(texts), links)
    for size in (1 << 23, 1 << 18):  # one cell, several cells
        monkeypatch.setattr(simhash, "GROUP_BYTES", size)
        edges = simhash._forest_of_similar(rows, simhash._masks(8, 2), 0.8)
        found = [(r.a, r.b) for r in edges.collect()]
        cells = max(1, -(-sum(h.nbytes for h in sets) // size))
        assert 0 < len(found) < len(texts) * cells
        assert set(found) <= set(links)
        assert joined(len(texts), found) == top


def rows_of_joins(spark, on):
    """Rows that all inner joins of the session on these fields have made."""
    store = spark._jsparkSession.sharedState().statusStore()
    total, runs = 0, store.executionsList()
    for i in range(runs.size()):
        id_ = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(id_), store.planGraph(id_).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and " Inner" in node.desc() and re.sub(r"#\d+L?", "", node.desc()).split(" ", 1)[1].startswith(f"{on}, {on}"):
                metrics = node.metrics()
                for m in (metrics.apply(k) for k in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_rows_of_crowded_buckets_of_one_root_are_not_joined(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join("x" if i == at else w for i, w in enumerate(words)) for at in rng.sample(range(400), 200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before = rows_of_joins(spark, "[t, bucket]")
    assert {r.component_id for r in simhash.similar_documents(docs).collect()} == {0}
    assert rows_of_joins(spark, "[t, bucket]") - before < len(texts)
