import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.operators import metrics, ml, ranks


def test_percentiles_and_ranks_of_keys(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b", "c"], n, p=[0.9, 0.09, 0.01]), "v": np.round(rng.normal(size=n), 2)})
    pdf.loc[::7, "v"] = 0.5
    rows = [(k, None if i % 50 == 0 else float(v)) for i, (k, v) in enumerate(zip(pdf.k, pdf.v))] + [(None, 2.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in ranks.percentiles(df, ["k"], "v", [0, 0.1, 0.5, 0.95, 1], list("abcde")).collect()}
    whole = pd.DataFrame(rows, columns=["k", "v"])
    for k in ("hot", "b", "c"):
        want = np.quantile(whole.v[whole.k == k].dropna(), [0, 0.1, 0.5, 0.95, 1])
        assert np.allclose([got[k][x] for x in "abcde"], want)
    assert got[None].c == 2.5 and "none" not in got
    ranked = ranks.keyed_average_rank(df, ["k"], "v").toPandas()
    for k in ("hot", "c"):
        own = ranked[ranked.k == k]
        assert np.allclose(own["rank"].dropna(), own.v.rank().dropna()) and own["rank"].isna().equals(own.v.isna())
    e = metrics.error_metrics(df.withColumn("t", F.lit(0.0)), ["k"], F.col("v"), F.col("t"))
    assert {r.k: r.n for r in e.collect()}["none"] == 0 and e.count() == 5
    assert ranks.percentiles(df.limit(0), [], "v", [0.5], ["m"]).count() in (0, 1)


def test_each_candidate_has_each_seed(spark):
    rows = [(u, s, m, float(u * s - 3)) for m in "ab" for u in (1, 2, 3) for s in (1, 2)]
    df = spark.createDataFrame(rows, "uid int, seed int, model string, delta double")
    assert metrics.seed_summary(df, keys=("model",)).count() == 6
    for broken in (df.filter("not (uid = 2 and seed = 1 and model = 'b')"), df.unionByName(df.limit(1))):
        with pytest.raises(ValueError, match="candidate"):
            metrics.seed_summary(broken, keys=("model",))
        assert metrics.seed_summary(broken, all_seeds=False, keys=("model",)).count() == 6


def dense(x, a, b, y, rounds=4000):
    """The same mixture by plain expectation-maximisation in one array, with small gradient steps of the gate."""
    w, s = np.zeros(x.shape[1]), [np.sqrt(((y - a) ** 2).mean()), np.sqrt(((y - b) ** 2).mean())]
    bound = np.linalg.inv(x.T @ x / 4)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-x @ w))
        d = [np.exp(-0.5 * ((y - m) / t) ** 2) / t / np.sqrt(2 * np.pi) for m, t in zip((a, b), s)]
        r = g * d[0] / (g * d[0] + (1 - g) * d[1])
        s = [np.sqrt((r * (y - a) ** 2).sum() / r.sum()), np.sqrt(((1 - r) * (y - b) ** 2).sum() / (1 - r).sum())]
        w = w + bound @ (x.T @ (r - g))
    g = 1 / (1 + np.exp(-x @ w))
    d = [np.exp(-0.5 * ((y - m) / t) ** 2) / t / np.sqrt(2 * np.pi) for m, t in zip((a, b), s)]
    return np.log(g * d[0] + (1 - g) * d[1]).sum(), g


def test_gate_against_a_dense_fit(spark):
    rng = np.random.default_rng(1)
    n = 1500
    u, v = rng.normal(size=n), rng.normal(size=n)
    a, b = rng.normal(size=n), rng.normal(size=n)
    pick = rng.random(n) < 1 / (1 + np.exp(-(0.5 + 2 * u)))
    y = np.where(pick, a + 0.2 * rng.normal(size=n), b + 0.5 * rng.normal(size=n))
    pdf = pd.DataFrame({"u": u, "v": v, "const": 3.0, "a": a, "b": b, "y": y})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0, 3.0, 0.0, 0.0, 0.0)], "u double, v double, const double, a double, b double, y double"))
    gate = ml.fit_gate(df, ["u", "v", "const"], "a", "b", "y", tolerance=1e-10)
    assert all(x <= z + 1e-9 for x, z in zip(gate.likelihoods, gate.likelihoods[1:]))
    best, share = dense(np.column_stack([np.ones(n), u, v]), a, b, y)
    assert abs(gate.likelihoods[-1] - best) < 1e-3
    out = gate.apply(df, "a", "b").toPandas()
    assert np.allclose(out.share.dropna(), share, atol=5e-3) and out.share.isna().sum() == 1
    assert np.allclose((out.share * out.a + (1 - out.share) * out.b).dropna(), out.m_fusion.dropna())
    one = np.sqrt(((out.m_fusion.iloc[:n] - y) ** 2).mean())
    assert one < min(np.sqrt(((a - y) ** 2).mean()), np.sqrt(((b - y) ** 2).mean()))
    with pytest.raises(ValueError):
        ml.fit_gate(df.limit(0), ["u"], "a", "b", "y")


def test_heads_are_calibrated_on_unseen_rows(spark):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=n)
    state = (rng.random(n) < 1 / (1 + np.exp(-3 * x))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "x_Missing": 0, "m_value": 2 * x, "binary_state": state, "part": np.arange(n) % 3}))
    heads = ml.fit_context_heads(df.filter("part = 0"), df.filter("part = 1"), ["x", "x_Missing"])
    out = heads.apply(df.filter("part = 2")).toPandas()
    assert np.corrcoef(out.m_context, out.m_value)[0, 1] > 0.95 and out.prob_context.between(0, 1).all()
    order = out.sort_values("raw_context").prob_context
    assert (order.diff().dropna() >= -1e-12).all()
    assert abs(out.prob_context.mean() - out.binary_state.mean()) < 0.1 and ((out.prob_context > 0.5) == out.binary_state).mean() > 0.75
