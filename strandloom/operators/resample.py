"""Bootstraps and permutations on counter-based hashes, so that any engine draws the same.

Rows are summed to blocks (clusters, sets) first; replicates resample the sums and never
touch rows again. Rank statistics of replicates are linear in the counts of the clusters
(`replicates`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from . import metrics
from . import replicates as R
from .ranks import global_average_rank, running
from .settling import settle


def numbered(df: DataFrame, block: str) -> DataFrame:
    """df, one row for each block, with its number i from 0, in the order of the blocks."""
    return df.join(R.numbered_clusters(df, block), block)


def draws(blocks: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, i, times): how often each of n numbered blocks is drawn in n draws."""
    spark = blocks.sparkSession
    n = blocks.agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(n)).filter("n > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    i = hash32(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string")) % F.col("n")
    return grid.groupBy("replicate", i.alias("i")).agg(F.count(F.lit(1)).alias("times"))


def block_bootstrap(df: DataFrame, block: str, sums: dict[str, Column], replicates: int, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, replicate, sums): each sum over the rows of the drawn blocks; all keys draw the same blocks."""
    per = df.groupBy(*keys, block).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    names = settle(R.numbered_clusters(df, block))
    return draws(names, replicates, seed).join(per.join(names, block), "i").groupBy(*keys, "replicate").agg(*(F.sum(F.col("times") * F.col(k)).alias(k) for k in sums))


def stratum_bootstrap(df: DataFrame, stratum: str, block: str, gain: str, replicates: int, seed: int = 42) -> DataFrame:
    """(stratum, n_blocks, low, high) of the mean gain; null under two blocks."""
    per = df.groupBy(stratum, block).agg(F.sum(gain).alias("g_"), F.count(F.lit(1)).alias("c_"))
    w = Window.partitionBy(stratum)
    per = per.withColumn("i", F.row_number().over(w.orderBy(block)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    sizes = per.groupBy(stratum).agg(F.max("n").alias("n"))
    grid = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    i = hash32(F.lit(str(seed)), F.col(stratum).cast("string"), F.col("replicate").cast("string"), F.col("draw").cast("string")) % F.col("n")
    times = grid.groupBy(stratum, "replicate", i.alias("i")).agg(F.count(F.lit(1)).alias("times"))
    boot = times.join(per.drop("n"), [stratum, "i"]).groupBy(stratum, "replicate").agg((F.sum(F.col("times") * F.col("g_")) / F.sum(F.col("times") * F.col("c_"))).alias("m_"))
    q = F.percentile("m_", F.array(F.lit(0.025), F.lit(0.975)))
    return sizes.join(boot.groupBy(stratum).agg(q[0].alias("a_"), q[1].alias("b_")), stratum).select(stratum, F.col("n").alias("n_blocks"), F.when(F.col("n") > 1, F.col("a_")).alias("low"), F.when(F.col("n") > 1, F.col("b_")).alias("high"))


def interval(boot: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(n, low, high, p_not_negative): 2.5 and 97.5 percentiles, NaN and null left out."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    return boot.groupBy(*keys).agg(F.count(v).alias("n"), q[0].alias("low"), q[1].alias("high"), F.avg((v >= 0).cast("double")).alias("p_not_negative"))


def auc_matrix(df: DataFrame, block: str, y: str = "y", score: str = "score") -> DataFrame:
    """(i_block, j_block, wins): positives of block i that beat negatives of block j, ties a half."""
    return R.wins(df.filter(F.col(y) == 1), df.filter(F.col(y) == 0), block, score)


def _ranked(df: DataFrame, keys: tuple[str, ...], cluster: str, names: DataFrame, x: Column, y: Column, label: Column) -> DataFrame:
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    return df.join(names, cluster).select(key.alias("key"), F.col("i").alias("c"), x.cast("double").alias("x"), y.cast("double").alias("y"), label.cast("double").alias("label"))


def _unkeyed(got: DataFrame, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """got with the columns of its key in place of it."""
    if not keys:
        return got.drop("key")
    return got.withColumn("key", F.from_json("key", df.select(*keys).schema)).select("key.*", *(c for c in got.columns if c != "key"))


def cluster_bootstrap(df: DataFrame, cluster: str, a: str, b: str, replicates: int, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, replicate, rho, rho_abs, concordance, auc) when clusters are drawn, each with its rows.

    rho is Spearman's of a and b, rho_abs of their sizes, concordance the share of equal
    signs, auc that of b above zero by a. All keys draw the same clusters.
    """
    names = settle(R.numbered_clusters(df, cluster))
    n = names.count()
    times = settle(draws(names, replicates, seed))
    of = lambda x, y: R.statistics(_ranked(df, keys, cluster, names, x, y, F.col(b) > 0), times, n, replicates)
    sizes = of(F.abs(a), F.abs(b)).select("key", "replicate", F.col("rho").alias("rho_abs"))
    return _unkeyed(of(F.col(a), F.col(b)).join(sizes, ["key", "replicate"]).select("key", "replicate", "rho", "rho_abs", "concordance", "auc"), df, keys)


def auc_bootstrap(df: DataFrame, block: str, replicates: int, seed: int = 42, y: str = "y", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, replicate, auc) of resampled blocks; null without both classes. All keys draw the same blocks."""
    names = settle(R.numbered_clusters(df, block))
    times = settle(draws(names, replicates, seed))
    rows = _ranked(df.filter(F.col(y).isNotNull()), keys, block, names, F.col(score), F.col(score), F.col(y))
    return _unkeyed(R.statistics(rows, times, names.count(), replicates).select("key", "replicate", "auc"), df, keys)


def paired_bootstrap(df: DataFrame, model: str, block: str, replicates: int, seed: int = 42, keys: tuple[str, ...] = (), pred: str = "pred", truth: str = "truth", y: str = "y") -> DataFrame:
    """(keys, model_a, model_b, metric, difference, n, low, high, p_not_negative) of all pairs of models: mae, rmse and auc of a less those of b, observed and over resampled blocks. All models and keys draw the same blocks."""
    e, of = F.col(pred) - F.col(truth), (*keys, model)
    sums = {"n_": F.lit(1), "e_": F.abs(e), "e2_": e * e}
    errors = lambda t: t.withColumns({"mae": F.col("e_") / F.col("n_"), "rmse": F.sqrt(F.col("e2_") / F.col("n_"))})
    observed = errors(df.groupBy(*of).agg(*(F.sum(c).alias(k) for k, c in sums.items())))
    area = metrics.auc(df.select(*of, F.col(y).alias("y"), F.col(pred).alias("score")), keys=of).select(*of, "auc")
    drawn = errors(block_bootstrap(df, block, sums, replicates, seed, of)).join(auc_bootstrap(df, block, replicates, seed, y, pred, of), [*of, "replicate"])
    names = ["mae", "rmse", "auc"]
    every = observed.join(area, list(of)).withColumn("replicate", F.lit(-1)).select(*of, "replicate", *names).unionByName(drawn.select(*of, "replicate", *names))
    long_ = settle(every.unpivot([*of, "replicate"], names, "metric", "x"))
    a, b = (long_.select(*keys, "replicate", "metric", F.col(model).alias(f"model_{k}"), F.col("x").alias(f"x_{k}")) for k in "ab")
    both = a.join(b, [*keys, "replicate", "metric"]).filter("model_a < model_b").withColumn("d_", F.col("x_a") - F.col("x_b"))
    pair = (*keys, "model_a", "model_b", "metric")
    return both.filter("replicate < 0").select(*pair, F.col("d_").alias("difference")).join(interval(both.filter("replicate >= 0"), "d_", pair), list(pair))


def cluster_bootstrap_spearman(df: DataFrame, cluster: str, a: str, b: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, rho): rows follow their cluster, as often as it is drawn."""
    names = settle(R.numbered_clusters(df, cluster))
    rows = _ranked(df, (), cluster, names, F.col(a), F.col(b), F.col(b) > 0)
    return R.statistics(rows, settle(draws(names, replicates, seed)), names.count(), replicates).select("replicate", "rho")


def sign_flip_p(df: DataFrame, cluster: str, effect: str, slope: str, replicates: int, seed: int = 42) -> DataFrame:
    """(observed, exceed, p): clusters change the sign of their effects together; rank correlation with the slope.

    Each row stands with its effect (cluster 2i) and with the opposite (2i + 1), of which a
    replicate counts one; the first replicate counts all as they are.
    """
    names = settle(R.numbered_clusters(df, cluster))
    n = names.count()
    rows = _ranked(df, (), cluster, names, F.col(effect), F.col(slope), F.col(slope) > 0)
    both = rows.withColumn("c", 2 * F.col("c")).unionByName(rows.withColumns({"c": 2 * F.col("c") + 1, "x": -F.col("x")}))
    odd = hash32(F.lit(str(seed)), F.col("replicate").cast("string"), F.col(cluster).cast("string")) % 2
    flips = names.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    times = flips.select((F.col("replicate") + 1).alias("replicate"), (2 * F.col("i") + F.when(F.col("replicate") >= 0, odd).otherwise(0)).alias("i"), F.lit(1).alias("times"))
    rho = R.statistics(both, settle(times), 2 * n, replicates + 1).select("replicate", F.round("rho", 12).alias("r"))
    seen = rho.agg(F.max(F.when(F.col("replicate") == 0, F.col("r"))).alias("o"))
    exceed = F.count(F.when((F.col("replicate") > 0) & (F.abs("r") >= F.abs("o")), 1))
    return rho.crossJoin(F.broadcast(seen)).agg(F.max("o").alias("observed"), exceed.alias("exceed"), ((exceed + 1) / (replicates + 1)).alias("p"))


def _picks(rows: DataFrame, set_col: str, replicates: int, seed: int) -> DataFrame:
    """(set, replicate, i_): the place, from 0, of the row that each set takes in each replicate."""
    sets = rows.groupBy(set_col).agg(F.first("n_").alias("n_"))
    pick = hash32(F.lit(str(seed)), F.col("replicate").cast("string"), F.col(set_col).cast("string")) % F.col("n_")
    return sets.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).select(set_col, "replicate", pick.alias("i_"))


def within_set_permutation_p(df: DataFrame, set_col: str, id_col: str, replicates: int, seed: int = 42, y: str = "y", score: str = "score") -> DataFrame:
    """(observed, exceed, p) of the AUC by |score| when one row of each set, by hash, is the positive. Ranks are made once; a replicate is the picks, one row of each set."""
    w = Window.partitionBy(set_col)
    ranked = global_average_rank(df.withColumn("a_", F.abs(score)), "a_", "r_")
    rows = settle(ranked.select(set_col, id_col, y, "r_").withColumn("i_", F.row_number().over(w.orderBy(id_col)) - 1).withColumn("n_", F.count(F.lit(1)).over(w)))
    total = rows.agg(F.count(F.lit(1)).alias("t_"), F.countDistinct(set_col).alias("k_"), F.sum(F.when(F.col(y) == 1, F.col("r_"))).alias("o_"), F.sum(y).alias("p_"))
    chosen = _picks(rows, set_col, replicates, seed).join(rows.select(set_col, "i_", "r_"), [set_col, "i_"])
    sums = chosen.groupBy("replicate").agg(F.sum("r_").alias("s_")).crossJoin(F.broadcast(total))  # one row
    auc = lambda s, k: (s - k * (k + 1) / 2.0) / (k * (F.col("t_") - k))
    null, seen = auc(F.col("s_"), F.col("k_")), auc(F.col("o_"), F.col("p_"))
    exceed = F.count(F.when(null >= seen, 1))
    return sums.agg(F.max(seen).alias("observed"), exceed.alias("exceed"), ((exceed + 1) / (replicates + 1)).alias("p"))


def weighted_auc_ap(rows: DataFrame, keys: list[str], y: str, by: str, weight: str) -> DataFrame:
    """(keys, auc, ap): the ROC area and the average precision by descending score, ties together, of rows counted `weight` times; null without both classes."""
    v = rows.groupBy(*keys, by).agg(F.sum(F.when(F.col(y) == 1, F.col(weight)).otherwise(0)).cast("double").alias("p_"), F.sum(F.when(F.col(y) == 1, 0).otherwise(F.col(weight))).cast("double").alias("q_"))
    down = Window.partitionBy(*keys).orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = v.withColumns({"tp_": F.sum("p_").over(down), "fp_": F.sum("q_").over(down)})
    p, q = F.sum("p_"), F.sum("q_")
    # a negative loses to the positives above it, and half to those beside it
    wins = F.sum(F.col("q_") * (F.col("tp_") - F.col("p_") / 2))
    ap = F.sum(F.when(F.col("p_") > 0, F.col("p_") * F.col("tp_") / (F.col("tp_") + F.col("fp_"))).otherwise(0.0))
    return run.groupBy(*keys).agg(F.when((p > 0) & (q > 0), wins / (p * q)).alias("auc"), F.when(p > 0, ap / p).alias("ap"))


def set_bootstrap(df: DataFrame, set_col: str, replicates: int, seed: int = 42, y: str = "y", score: str = "score") -> DataFrame:
    """(replicate, auc, ap, wins): matched sets drawn whole; AUC and average precision by |score|, and the share of drawn sets whose positive lies above the median of the others."""
    a = F.abs(score)
    per = df.groupBy(set_col).agg(F.max(F.when(F.col(y) == 1, a)).alias("top_"), F.median(F.when(F.col(y) == 0, a)).alias("mid_"))
    sets = numbered(per, set_col)
    drawn = draws(sets.select("i"), replicates, seed).join(sets, "i")
    known = F.col("top_").isNotNull() & F.col("mid_").isNotNull()
    wins = drawn.groupBy("replicate").agg((F.sum(F.when(known & (F.col("top_") > F.col("mid_")), F.col("times")).otherwise(0)) / F.sum(F.when(known, F.col("times")))).alias("wins"))
    rows = df.select(set_col, F.col(y).alias("y_"), a.alias("a_")).join(drawn.select("replicate", set_col, "times"), set_col)
    return weighted_auc_ap(rows, ["replicate"], "y_", "a_", "times").join(wins, "replicate")


def within_set_permutation_ap(df: DataFrame, set_col: str, id_col: str, replicates: int, seed: int = 42, y: str = "y", score: str = "score") -> DataFrame:
    """(observed, exceed, p) of the average precision by |score| when one row of each set, by hash, is the positive.

    A replicate is the picks, one row of each set; negatives are counted once for all replicates, so nothing is copied by replicate but the picks.
    """
    w = Window.partitionBy(set_col)
    rows = df.select(set_col, id_col, F.col(y).alias("y_"), F.abs(score).alias("a_")).withColumn("i_", F.row_number().over(w.orderBy(id_col)) - 1).withColumn("n_", F.count(F.lit(1)).over(w))
    chosen = _picks(rows, set_col, replicates, seed).join(rows.select(set_col, "i_", "a_"), [set_col, "i_"]).select("replicate", "a_")
    seen = rows.filter("y_ = 1").select(F.lit(-1).alias("replicate"), "a_")
    positives = chosen.unionByName(seen).groupBy("replicate", "a_").agg(F.count(F.lit(1)).cast("double").alias("p_"))
    # how many of all rows lie at or above each value: counted over the values in ranges
    values = rows.groupBy("a_").agg(F.count(F.lit(1)).alias("n_"))
    above = running(values, [-F.col("a_")], {"above_": F.col("n_")}).select("a_", "above_")
    down = Window.partitionBy("replicate").orderBy(F.col("a_").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = positives.join(above, "a_").withColumn("tp_", F.sum("p_").over(down))
    ap = at.groupBy("replicate").agg(F.round(F.sum(F.col("p_") * F.col("tp_") / F.col("above_")) / F.sum("p_"), 12).alias("ap"))
    both = ap.crossJoin(F.broadcast(ap.agg(F.max(F.when(F.col("replicate") < 0, F.col("ap"))).alias("o_"))))
    exceed = F.count(F.when((F.col("replicate") >= 0) & (F.col("ap") >= F.col("o_")), 1))
    return both.agg(F.max("o_").alias("observed"), exceed.alias("exceed"), ((exceed + 1) / (replicates + 1)).alias("p"))


def leave_one_out_metrics(df: DataFrame, cluster: str, a: str, b: str, y: str) -> DataFrame:
    """(n_left_out, worst_ and best_ rho, concordance, auc) over the clusters, each left out once; auc is of y by |a|. The ranks without a cluster are those of all less what it had below."""
    names = settle(R.numbered_clusters(df, cluster))
    n = names.count()
    rows = _ranked(df, (), cluster, names, F.col(a), F.col(b), F.col(y) == 1)
    m = R.statistics(rows, None, n, n).select("replicate", "rho", "concordance").join(R.statistics(rows.withColumns({"x": F.abs("x"), "y": F.abs("x")}), None, n, n).select("replicate", "auc"), "replicate")
    return m.agg(F.count(F.lit(1)).alias("n_left_out"), *(f(k).alias(f"{name}_{k}") for k in ("rho", "concordance", "auc") for f, name in ((F.min, "worst"), (F.max, "best"))))
