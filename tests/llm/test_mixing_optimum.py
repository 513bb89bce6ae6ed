import numpy as np

from strandloom.llm import mixing

SF = "/root/testdata/sf0.01"


def test_recall_totals_and_rates(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    mixed = mixing.mix(docs, labels).collect()
    of = {r.doc_id: 2 * r.quality + r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in mixed}
    for domain in set(of.values()):
        own = [got[i] for i, x in of.items() if x == domain and i in got and got[i].n_tokens >= 50]
        recall = np.mean([int(np.argmax(r.p)) == domain for r in own])
        print(domain, len(own), recall)
        assert recall > 0.8
    total = sum(r.n_tokens for r in mixed)
    reached = sum(np.array(r.p) * r.n_tokens * r.rate for r in mixed)
    print(reached / total, np.mean([r.rate == 0 for r in mixed]), max(r.rate for r in mixed))
    assert np.abs(reached / total - [0.15, 0.02, 0.8, 0.03]).max() < 2e-4


def test_rates_against_alternating_projections(spark):
    """Of all rates >= 0 that meet the totals the nearest to 1, by Dykstra's projections on a dense table."""
    rng = np.random.default_rng(8)
    p, t = rng.dirichlet([0.4] * 3, 60), rng.integers(1, 400, 60).astype(float)
    targets = np.array([0.5, 0.1, 0.4]) * t.sum()
    a = (p * t[:, None]).T  # totals are a @ r; distances are weighed by t
    inverse = np.linalg.inv(a / t @ a.T)
    r, held = np.ones(60), np.zeros(60)
    for _ in range(20000):
        flat = r - (a.T / t[:, None]) @ (inverse @ (a @ r - targets))
        r = np.maximum(0, flat + held)
        held = flat + held - r
    weighed = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p))], "doc_id long, n_tokens long, p array<double>")
    steps, reached = mixing.fit_rates(weighed, targets)
    assert np.allclose(a @ r, targets, rtol=1e-6) and np.allclose(reached, targets, rtol=1e-5)
    assert (r < 1e-9).any() and np.abs(mixing.replay(t, p, steps)[0] - r).max() < 1e-3
