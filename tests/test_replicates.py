import numpy as np
import pandas as pd
import pytest

from strandloom.operators import replicates, resample


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def rho(a, b):
    a, b = ranks(a), ranks(b)
    return None if len(a) < 3 or np.ptp(a) == 0 or np.ptp(b) == 0 else float(np.corrcoef(a, b)[0, 1])


def area(x, label):
    p = label.sum()
    return None if p in (0, len(x)) else float((ranks(x)[label == 1].sum() - p * (p + 1) / 2) / (p * (len(x) - p)))


def close(a, b):
    return (a is None and b is None) or abs(a - b) < 1e-9


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 400
    return pd.DataFrame({"k": np.array(["p", "q"])[rng.integers(0, 2, n)], "c": rng.integers(0, 23, n) * 10, "a": rng.integers(-6, 7, n).astype(float), "b": np.round(rng.normal(size=n), 1)})


@pytest.mark.parametrize(("n", "block"), [(9, 50), (60, 1 << 21)])  # fewer and more replicates than clusters
def test_bootstrap_against_resampled_rows(spark, rows, monkeypatch, n, block):
    monkeypatch.setattr(replicates, "BLOCK", block)
    monkeypatch.setattr(replicates, "COUNTS", 23 * 30)  # 60 replicates in two parts
    df = spark.createDataFrame(rows)
    got = {(r.k, r.replicate): r for r in resample.cluster_bootstrap(df, "c", "a", "b", n, keys=("k",)).collect()}
    names = sorted(rows.c.unique())
    drawn = resample.draws(df.select("c").distinct(), n, 42).collect()
    for k in "pq":
        own = rows[rows.k == k]
        for r in range(n):
            times = {names[d.i]: d.times for d in drawn if d.replicate == r}
            x = own.loc[own.index.repeat(own.c.map(times).fillna(0).astype(int))]
            a, b = x.a.to_numpy(), x.b.to_numpy()
            g = got[k, r]
            assert close(g.rho, rho(a, b)) and close(g.rho_abs, rho(abs(a), abs(b))) and close(g.auc, area(a, (b > 0).astype(int)))
            assert close(g.concordance, float((np.sign(a) == np.sign(b)).mean()))


def test_each_cluster_left_out(spark, rows):
    df = spark.createDataFrame(rows).selectExpr("c", "a", "b", "cast(b > 0.3 as int) as y")
    got = resample.leave_one_out_metrics(df, "c", "a", "b", "y").first()
    kept = [rows[rows.c != c] for c in rows.c.unique()]
    for name, of in {"rho": lambda x: rho(x.a, x.b), "concordance": lambda x: (np.sign(x.a) == np.sign(x.b)).mean(), "auc": lambda x: area(abs(x.a.to_numpy()), (x.b > 0.3).astype(int).to_numpy())}.items():
        values = [of(x) for x in kept]
        assert close(got[f"worst_{name}"], min(values)) and close(got[f"best_{name}"], max(values))
    assert got.n_left_out == rows.c.nunique()


def test_sign_flips_against_flipped_rows(spark, rows):
    df = spark.createDataFrame(rows)
    got = resample.sign_flip_p(df, "c", "a", "b", 40).first()
    from hashlib import md5

    seen = round(rho(rows.a, rows.b), 12)
    odd = lambda r, c: int(md5(f"42|{r}|{c}".encode()).hexdigest()[:8], 16) % 2
    flipped = [round(rho(rows.a * np.array([-1 if odd(r, c) else 1 for c in rows.c]), rows.b), 12) for r in range(40)]
    assert close(got.observed, seen) and got.exceed == sum(abs(f) >= abs(seen) for f in flipped)


def test_nulls_constants_and_empty(spark):
    df = spark.createDataFrame([("c1", None, 1.0), ("c1", float("nan"), 2.0), ("c2", 1.0, 1.0), (None, 2.0, 1.0), ("c3", 1.0, -1.0), ("c3", 1.0, 0.0)], "c string, a double, b double")
    got = resample.cluster_bootstrap(df, "c", "a", "b", 8).collect()
    assert len(got) == 8 and all(r.rho is None for r in got)  # a is the same everywhere
    assert resample.cluster_bootstrap(df.limit(0), "c", "a", "b", 3).collect() == []
    none = resample.leave_one_out_metrics(df.limit(0).selectExpr("c", "a", "b", "1 as y"), "c", "a", "b", "y").first()
    assert none.n_left_out == 0 and none.worst_rho is None
    wins = {(r.i_block, r.j_block): r.wins for r in resample.auc_matrix(spark.createDataFrame([("x", 1, 2.0), ("x", 0, 2.0), ("y", 0, 1.0), ("y", 1, -0.0), ("x", 0, 0.0)], "block string, y int, score double"), "block").collect()}
    assert wins == {("x", "x"): 1.5, ("x", "y"): 1.0, ("y", "x"): 0.5, ("y", "y"): 0.0}
