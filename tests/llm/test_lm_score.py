import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from strandloom.llm import lm_score


def fold_of(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5


def tokens_of(text):
    return [*(text or "").encode().lower().split(), lm_score.END]


def plain(rows):
    """Base columns by their definition."""
    tokens = [(d, tokens_of(t)) for d, t in rows]
    c = Counter(w for d, ws in tokens if fold_of(d) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, fold_of(d) == 1, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in tokens]


def estimates(rows):
    """(unigrams, bigrams) of some texts."""
    texts = [tokens_of(t) for _, t in rows]
    return Counter(w for ws in texts for w in ws), Counter(x for ws in texts for x in zip([lm_score.END, *ws], ws))


def bucket(n):
    return 1 + int(math.log2(n)) if n else 0


def slow_scores(rows, weights):
    """The mixture by its definition, given the learned weights: every word is a context."""
    one, two = estimates([r for r in rows if fold_of(r[0]) != 1])
    n, v = sum(one.values()), len(one)
    out = []
    for _, text in rows:
        ws, total = tokens_of(text), 0.0
        for a, b in zip([lm_score.END, *ws], ws):
            w = weights[bucket(one[a])]
            total += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + w[2] * two[a, b] / max(1, one[a]))
        out.append(total)
    return out


def slow_histogram(rows):
    """Held-out tokens of the weights' fold by bucket and levels, against the other folds."""
    one, two = estimates([r for r in rows if fold_of(r[0]) > 1])
    n = sum(one.values())
    step = lambda p: 1 + min(510, max(0, round(-lm_score.STEPS * math.log2(p)))) if p else 0
    out = Counter()
    for d, text in rows:
        if fold_of(d) == 0:
            ws = tokens_of(text)
            for a, b in zip([lm_score.END, *ws], ws):
                out[bucket(one[a]), step(one[b] / n) << 10 | step(two[a, b] / one[a] if one[a] else 0)] += 1
    return out


def test_documents_against_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-3, None), (-4, ""), (-4, ""), (None, "the end"), (10**9, "the of the " * 20000)], "doc_id long, text string")
    rows = docs.unionByName(extra)
    kept = {}
    learn = lm_score.weights_of
    monkeypatch.setattr(lm_score, "weights_of", lambda h, n: kept.setdefault("w", learn(kept.setdefault("h", h), n)))
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in lm_score.score_documents(rows.withColumn("block", rows.doc_id), block_chars=20000, shard_keys=2000).collect()), key=key)
    source = sorted(((r.doc_id, r.text) for r in rows.collect()), key=key)
    for g, w in zip(got, plain(source)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    assert {(r.ctx, r.key): r.n for r in kept["h"].itertuples()} == slow_histogram(source)
    for g, s in zip(got, slow_scores(source, kept["w"])):
        assert math.isclose(g[6], s, rel_tol=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the base on held-out documents
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def test_weights_reach_the_best_likelihood():
    h = pd.DataFrame({"ctx": [1, 1, 1], "key": [17 << 10 | 9, 33 << 10, 0], "n": [60.0, 30.0, 10.0]})
    w = lm_score.learn_weights(h, 2, 99, rounds=2000)[1]
    p = np.array([[0.01, 0.25, 0.5], [0.01, 0.0625, 0], [0.01, 0, 0]])
    best = (np.array([60, 30, 10]) * np.log(p @ w)).sum()
    for d in np.random.default_rng(1).dirichlet([1, 1, 1], 3000):
        assert (np.array([60, 30, 10]) * np.log(p @ d)).sum() <= best + 1e-6


def test_a_bucket_without_held_out_tokens_has_the_weights_below():
    w = lm_score.weights_of(pd.DataFrame({"ctx": [1, 3], "key": [17 << 10 | 9, 17 << 10 | 9], "n": [5.0, 5.0]}), 9)
    assert (w[2] == w[1]).all() and (w[64] == w[3]).all() and np.allclose(w.sum(axis=1), 1)
