import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]


def test_rates_match_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    t = rng.integers(0, 900, 500)
    weighed = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p))], "doc_id long, n_tokens long, p array<double>")
    for targets in (np.array([0.1, 0.2, 0.7]) * t.sum(), np.array([0.0, 0.5, 1.5]) * t.sum()):
        steps, reached = mixing.fit_rates(weighed, targets, rounds=200, close=1e-3)
        r = mixing.replay(t.astype(float), p, steps)[0]
        assert (r >= 0).all() and np.allclose((r * t) @ p, reached, rtol=1e-6)
        # no smaller weighted residual nearby: the projected gradient vanishes
        scale = 1 / np.maximum(targets, max(1.0, 1e-3 * targets.sum()))
        g = p @ ((reached - targets) * scale)
        assert np.abs(np.where((r > 0) & (t > 0), g, np.minimum(g, 0))).max() < 0.05


def test_classifier_on_held_out_labels(tables):
    docs, labels = tables
    test = labels.filter("doc_id % 4 = 0")
    model = mixing.train(docs, labels.filter("doc_id % 4 <> 0"))
    rows = mixing.posteriors(docs, model).join(test, "doc_id").collect()
    right = np.mean([int(np.argmax(r.p)) == 2 * r.quality + r.toxic for r in rows])
    common = max(np.bincount([2 * r.quality + r.toxic for r in rows])) / len(rows)
    assert right > common


def test_rows_and_copies(spark, tables):
    docs, labels = tables
    extra = spark.createDataFrame([(-1, None, 1.0), (-2, "", 1.0), (-2, "", 1.0), (None, "a b", 1.0), (-3, "long " * 30000, 1.0)], "doc_id long, text string, rate double")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    mixed = mixing.mix(rows, labels).cache()
    assert mixed.count() == rows.count()
    got = mixed.collect()
    assert all(r.rate == 1 for r in got if r.n_tokens == 0)
    total = sum(r.n_tokens for r in got)
    reached = sum(np.array(r.p) * r.n_tokens * r.rate for r in got)
    assert abs(reached.sum() / total - 1) < 0.05
    out = mixing.resample(rows, mixed)
    assert out.columns == rows.columns and abs(out.count() - sum(r.rate for r in got)) < 0.2 * len(got)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert {round(x, 6) for r in mixing.mix(docs.limit(5), labels.limit(0), shares=(1, 1, 1, 1)).collect() for x in r.p} == {0.25}


def test_copies(spark):
    r = spark.range(10000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(r[0] - 1.25) < 0.02 and (r[1], r[2]) == (1, 2)
