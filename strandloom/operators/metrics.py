"""Aggregates and metrics; all partial-aggregable but for ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranks import by_keys, keyed_average_rank, percentiles, running
from .settling import settle


def probe_medians(normals: DataFrame, probe: str = "part_key") -> DataFrame:
    """(probe, n_observed, beta, m_value, binary_state): the median over samples, NaN and null left out; probes without a value drop."""
    m = F.median("beta").alias("beta")
    return normals.groupBy(probe).agg(F.count("beta").alias("n_observed"), m).filter("n_observed > 0").withColumns({"m_value": S.beta_to_m(F.col("beta")), "binary_state": S.binary_state(F.col("beta"))})


def participant_medians(normals: DataFrame, probe: str = "part_key", participant: str = "participant") -> DataFrame:
    """(probe, beta): the median over participants of their medians."""
    return normals.groupBy(probe, participant).agg(F.median("beta").alias("b_")).groupBy(probe).agg(F.median("b_").alias("beta"))


def fit_medians(df: DataFrame, features: list[str], fit: Column, pooled: list[tuple[str, ...]] = ()) -> DataFrame:
    """One row of medians on the rows of `fit` alone; pooled features share one; without values 0."""
    group = {f: g for g in pooled for f in g}
    long_ = df.filter(fit).select(F.explode(F.array(*(F.struct(F.lit("+".join(group.get(f, (f,)))).alias("f"), F.col(f).alias("v")) for f in features))).alias("x")).select("x.*")
    med = percentiles(long_, ["f"], "v", [0.5], ["v"])
    names = {f: "+".join(group.get(f, (f,))) for f in features}
    return med.agg(*(F.coalesce(F.max(F.when(F.col("f") == names[f], F.col("v"))), F.lit(0.0)).alias(f) for f in features))


def impute(df: DataFrame, features: list[str], fit: Column, pooled: list[tuple[str, ...]] = (), of: DataFrame | None = None) -> DataFrame:
    """df with 0/1 `_Missing` indicators and features filled by fit_medians, of df's rows or of those of another table."""
    med = fit_medians(df if of is None else of, features, fit, pooled).select(*(F.col(f).alias(f"{f}_med_") for f in features))
    out = df.crossJoin(F.broadcast(med))  # one row
    return out.withColumns({f"{f}_Missing": F.col(f).isNull().cast("int") for f in features}).withColumns({f: F.coalesce(f, f"{f}_med_") for f in features}).drop(*(f"{f}_med_" for f in features))


def split_summary(df: DataFrame, split: str = "split", chrom: str = "chr", beta: str = "beta") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(chrom).alias("n_chr"), F.array_join(F.array_sort(F.collect_set(chrom)), ",").alias("chromosomes"), F.avg(beta).alias("mean_beta"), F.avg((F.col(beta) > 0.5).cast("double")).alias("methylated_fraction"))


def numeric_stats(x: Column) -> list[Column]:
    n = lambda c: F.count(F.when(c, 1))
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), n(x == 0).alias("n_zero"), n(x < 0).alias("n_negative"), n(x.isNull()).alias("n_missing")]


def error_metrics(df: DataFrame, keys: list[str], pred: Column, truth: Column) -> DataFrame:
    """(keys, n, mae, rmse, mean_signed, median_abs); the median by ranges of values, so no task holds a key's errors."""
    e = F.col("e_")
    rows = df.select(*keys, (pred - truth).alias("e_"), F.abs(pred - truth).alias("a_"))
    sums = rows.groupBy(*keys).agg(F.count(e).alias("n"), F.avg("a_").alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_signed"))
    return by_keys(sums, percentiles(rows, keys, "a_", [0.5], ["median_abs"]), keys, "left")


def grouped_errors(df: DataFrame, groupings: dict[str, Column], pred: str = "pred", truth: str = "truth", keys: tuple[str, ...] = ()) -> DataFrame:
    """Metrics by each of several groupings, in one pass; null strata drop."""
    g = F.explode(F.array(*(F.struct(F.lit(n).alias("grouping"), c.cast("string").alias("stratum")) for n, c in groupings.items()))).alias("g_")
    rows = df.select(*keys, pred, truth, g).select(*keys, pred, truth, "g_.*").filter("stratum is not null")
    return error_metrics(rows, [*keys, "grouping", "stratum"], F.col(pred), F.col(truth))


def threshold_errors(df: DataFrame, coverage: str, thresholds: list[int], keys: tuple[str, ...] = (), pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Metrics of the overlapping subsets with coverage at or above each threshold."""
    at = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(coverage) >= t)).alias("threshold")
    return error_metrics(df.select(*keys, pred, truth, at), [*keys, "threshold"], F.col(pred), F.col(truth))


def right_closed_bin(x: Column, edges: list[int]) -> Column:
    out = None
    for a, b in zip(edges, edges[1:]):
        out = (F.when if out is None else out.when)((x > a) & (x <= b), F.lit(f"({a},{b}]"))
    return out


def auc(df: DataFrame, y: str = "y", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, n_positive, auc): ties count a half; null if a class is empty."""
    rows = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    ranked = keyed_average_rank(rows, list(keys), score)
    p, n = F.sum(y), F.count(F.lit(1))
    up = F.sum(F.when(F.col(y) == 1, F.col("rank"))) - p * (p + 1) / 2.0
    return ranked.groupBy(*keys).agg(n.alias("n"), p.alias("n_positive"), F.when((p > 0) & (p < n), up / (p * (n - p))).alias("auc"))


def curve(df: DataFrame, y: str = "y", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """ROC and precision-recall points at each distinct score, from the highest down."""
    per = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(y).cast("long").alias("p_"), F.count(F.lit(1)).alias("n_"))
    down = F.col(score).desc()
    if keys:
        w = Window.partitionBy(*keys).orderBy(down).rowsBetween(Window.unboundedPreceding, 0)
        run = per.withColumns({"tp_": F.sum("p_").over(w), "k_": F.sum("n_").over(w)})
    else:
        run = running(per, [down], {"tp_": F.col("p_"), "k_": F.col("n_")})
    total = per.groupBy(*keys).agg(F.sum("p_").alias("pos_"), F.sum("n_").alias("all_"))
    run = run.join(total, list(keys)) if keys else run.crossJoin(F.broadcast(total))
    tp, n, pos = F.col("tp_"), F.col("k_"), F.col("pos_")
    return run.select(*keys, score, F.col("p_").alias("positives"), tp.alias("tp"), (n - tp).alias("fp"), F.when(pos > 0, tp / pos).alias("tpr"), F.when(F.col("all_") > pos, (n - tp) / (F.col("all_") - pos)).alias("fpr"), (tp / n).alias("precision"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Tie-grouped: the precision at each distinct score, weighted by its positives."""
    c = curve(df, y, score, keys)
    return c.groupBy(*keys).agg(F.try_divide(F.sum(F.col("positives") * F.col("precision")), F.sum("positives")).alias("average_precision"))


def ordered_average_precision(df: DataFrame, tie: str, y: str = "y", score: str = "score", keys: tuple[str, ...] = ()) -> DataFrame:
    """Tie-ordered: the mean over positives of the precision at their place."""
    order = [F.col(score).desc(), F.col(tie)]
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        placed = df.select(*keys, y, F.row_number().over(w).alias("k_"), F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp_"))
    else:
        placed = running(df.select(y, score, tie), order, {"k_": F.lit(1), "tp_": F.col(y)})
    return placed.groupBy(*keys).agg(F.avg(F.when(F.col(y) == 1, F.col("tp_") / F.col("k_"))).alias("average_precision"))


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson; null under three pairs or without spread."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.when(F.count(a) >= 3, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, rho) with average ranks."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = keyed_average_rank(keyed_average_rank(rows.select(*keys, a, b), list(keys), a, "ra_"), list(keys), b, "rb_")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded_corr(F.col("ra_"), F.col("rb_")).alias("rho"))


def concordance(a: Column, b: Column) -> list[Column]:
    same = F.signum(a) == F.signum(b)
    both = (a != 0) & (b != 0)
    return [F.avg(same.cast("double")).alias("concordance"), F.count(F.when(same, 1)).alias("n_same"), F.count(F.when(both, 1)).alias("n_nonzero"), F.count(F.when(both & same, 1)).alias("n_nonzero_same")]


def response(df: DataFrame, keys: list[str], predicted: str, observed: str) -> DataFrame:
    """(keys, n, rho, rho_abs, concordance, mean_abs, median_abs, positive_fraction) of predicted effects against observed ones, by keys."""
    rows = settle(df.select(*keys, predicted, observed, F.abs(predicted).alias("p_abs_"), F.abs(observed).alias("o_abs_")))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), concordance(F.col(predicted), F.col(observed))[0], F.avg("p_abs_").alias("mean_abs"), F.avg((F.col(predicted) > 0).cast("double")).alias("positive_fraction"))
    out = by_keys(base, spearman(rows, predicted, observed, tuple(keys)).drop("n"), keys, "left")
    out = by_keys(out, spearman(rows, "p_abs_", "o_abs_", tuple(keys)).drop("n").withColumnRenamed("rho", "rho_abs"), keys, "left")
    return by_keys(out, percentiles(rows, keys, "p_abs_", [0.5], ["median_abs"]), keys, "left")


def binomial_tails(df: DataFrame, k: str, n: str) -> DataFrame:
    """df with p_greater = P(X >= k) and p_two_sided, X binomial (n, 1/2). The chances are added up as they are made, so a row costs time linear in n; a k outside 0 to n is an error."""
    i, wide = F.sequence(F.lit(0), F.col(n)), F.log(F.lit(2.0)) * F.col(n)
    step = lambda c, j: c + F.log((F.col(n) - j).cast("double")) - F.log((j + 1).cast("double"))
    own = F.exp(F.aggregate(i, F.lit(0.0), lambda c, j: F.when(j < F.col(k), step(c, j)).otherwise(c)) - wide)
    own = F.when((F.col(k) < 0) | (F.col(k) > F.col(n)), F.raise_error(F.lit(f"{k} is not between 0 and {n}")).cast("double")).otherwise(own)

    def add(s: Column, j: Column) -> Column:
        p = F.exp(s["c"] - wide)
        return F.struct(step(s["c"], j).alias("c"), s["own"].alias("own"), (s["tail"] + F.when(j >= F.col(k), p).otherwise(0.0)).alias("tail"), (s["two"] + F.when(p <= s["own"] * (1 + 1e-7), p).otherwise(0.0)).alias("two"))

    # the own chance starts with the sums, as a column it could be made again for each term
    sums = F.aggregate(i, F.struct(F.lit(0.0).alias("c"), own.alias("own"), F.lit(0.0).alias("tail"), F.lit(0.0).alias("two")), add)
    p = df.withColumn("p_", F.when(F.col(k).isNotNull(), sums))
    return p.withColumns({"p_greater": F.least(F.col("p_.tail"), F.lit(1.0)), "p_two_sided": F.least(F.col("p_.two"), F.lit(1.0))}).drop("p_")


def seed_summary(scores: DataFrame, uid: str = "uid", seed: str = "seed", delta: str = "delta", ks: tuple[int, ...] = (10, 20), all_seeds: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """By candidate (uid and keys) over seeds: mean, population SD, median, range, sign consistency, ranks by the delta's size inside a seed (and keys) and top-k frequencies. With all_seeds an error unless each candidate has each seed of its keys once."""
    scores = settle(scores.withColumn("by_", -F.abs(delta)))
    if all_seeds:
        seeds = scores.groupBy(*keys).agg(F.countDistinct(seed).alias("want_"))
        each = scores.groupBy(*keys, uid).agg(F.count(F.lit(1)).alias("n_"), F.countDistinct(seed).alias("seeds_"))
        wrong = by_keys(each, seeds, list(keys)).filter("n_ <> want_ or seeds_ <> want_").first()
        if wrong is not None:
            raise ValueError(f"candidate {wrong[uid]} has {wrong.n_} scores of {wrong.seeds_} seeds where {wrong.want_} are due")
    ranked = keyed_average_rank(scores, [*keys, seed], "by_", "rank_", ties="first")
    d, r = F.col(delta), F.col("rank_")
    pos, neg = F.count(F.when(d > 0, 1)), F.count(F.when(d < 0, 1))
    return ranked.groupBy(*keys, uid).agg(
        F.countDistinct(seed).alias("n_seeds"), F.avg(d).alias("mean_delta"), F.stddev_pop(d).alias("sd_delta"), F.median(d).alias("median_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"),
        F.when(pos + neg == 0, 1.0).otherwise(F.greatest(pos, neg) / (pos + neg)).alias("sign_consistency"), F.avg(F.abs(d)).alias("mean_abs_delta"), F.avg(r).alias("mean_rank"), F.stddev_pop(r).alias("sd_rank"), F.min(r).alias("best_rank"), F.max(r).alias("worst_rank"),
        *(F.avg((r <= k).cast("double")).alias(f"top{k}_frequency") for k in ks),
    )


def orientation_agreement(fwd: Column, rc: Column) -> list[Column]:
    d = F.abs(fwd - rc)
    return [F.avg(d).alias("mae"), F.max(d).alias("max_abs"), guarded_corr(fwd, rc).alias("pearson")]


def quantiles(df: DataFrame, keys: list[str], x: str, prefix: str, ps=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(keys, mean, percentiles, share above one half), their names after the prefix."""
    base = df.groupBy(*keys).agg(F.avg(x).alias(f"{prefix}_mean"), F.avg((F.col(x) > 0.5).cast("double")).alias(f"{prefix}_dominant"))
    return by_keys(base, percentiles(df, keys, x, list(ps), [f"{prefix}_q{int(p * 100)}" for p in ps]), keys, "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent) with missing values as one."""
    n = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t_"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", (100.0 * F.col("n") / F.col("t_")).alias("percent"))


def multiplicity(df: DataFrame, entity: str) -> DataFrame:
    n = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_"))
    return n.agg(F.count(F.lit(1)).alias("n_entities"), F.min("n_").alias("low"), F.max("n_").alias("high"), F.avg("n_").alias("mean"), F.median("n_").alias("median"), F.count(F.when(F.col("n_") > 1, 1)).alias("n_multiple"))


def difference_distribution(df: DataFrame, d: Column, over: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """One row of a difference's size: mean, percentiles, the largest, and shares beyond bounds."""
    rows = df.select(F.abs(d).alias("a_"))
    base = rows.agg(F.avg("a_").alias("mean"), F.max("a_").alias("max"), *(F.avg((F.col("a_") > t).cast("double")).alias(f"over_{str(t).replace('.', '_')}") for t in over))
    none = base.sparkSession.range(1).select(F.lit("p").alias("p_"))  # a row, even where there are no values
    q = percentiles(rows.withColumn("p_", F.lit("p")), ["p_"], "a_", [0.5, 0.9, 0.95, 0.99], ["p50", "p90", "p95", "p99"])
    return base.crossJoin(F.broadcast(none.join(q, "p_", "left").drop("p_")))


def balance(pairs: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_positive, mean_negative, mean_difference, smd, median_abs_difference) of rows with positive_ and negative_ columns."""
    long_ = pairs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"positive_{f}").alias("a"), F.col(f"negative_{f}").alias("b")) for f in features))).alias("x")).select("x.*")
    sd = F.sqrt((F.var_samp("a") + F.var_samp("b")) / 2)
    return long_.groupBy("feature").agg(F.avg("a").alias("mean_positive"), F.avg("b").alias("mean_negative"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"), F.when(sd > 0, F.avg(F.col("a") - F.col("b")) / sd).alias("smd"), F.median(F.abs(F.col("a") - F.col("b"))).alias("median_abs_difference"))


def set_wins(df: DataFrame, set_col: str, y: str = "y", score: str = "score") -> DataFrame:
    """The share of sets whose one positive's |score| is above the median of the negatives'."""
    a = F.abs(score)
    per = df.groupBy(set_col).agg(F.count(F.when(F.col(y) == 1, 1)).alias("np_"), F.max(F.when(F.col(y) == 1, a)).alias("p_"), F.median(F.when(F.col(y) == 0, a)).alias("m_"))
    return per.filter("np_ = 1 and m_ is not null").agg(F.count(F.lit(1)).alias("n_sets"), F.avg((F.col("p_") > F.col("m_")).cast("double")).alias("win_fraction"))


def top_enrichment(df: DataFrame, fractions: tuple[float, ...], tie: str, y: str = "y", score: str = "score") -> DataFrame:
    """(fraction, n_top, positive_fraction, enrichment) of the highest scores."""
    total = df.agg(F.count(F.lit(1)).alias("n_"), F.avg(F.col(y).cast("double")).alias("base_"))
    placed = running(df.select(y, score, tie), [F.col(score).desc(), F.col(tie)], {"k_": F.lit(1)}).crossJoin(F.broadcast(total))
    f = F.explode(F.array(*map(F.lit, fractions))).alias("fraction")
    top = placed.select("*", f).filter(F.col("k_") <= F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("n_"))))
    share = F.avg(F.col(y).cast("double"))
    return top.groupBy("fraction").agg(F.count(F.lit(1)).alias("n_top"), share.alias("positive_fraction"), F.try_divide(share, F.max("base_")).alias("enrichment"))


def leave_one_out(df: DataFrame, cluster: str, a: str, b: str) -> DataFrame:
    """(omitted, n, pearson, change): the metric without each cluster, and its change. Sums of all less those of the cluster, so rows aren't multiplied."""
    x, y = F.col(a), F.col(b)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy")]
    per = df.groupBy(F.col(cluster).alias("omitted")).agg(*sums)
    whole = df.agg(*(s.alias(f"t_{i}") for i, s in enumerate(sums)))

    def r(n, x, y, xx, yy, xy):
        return F.try_divide(n * xy - x * y, F.sqrt((n * xx - x * x) * (n * yy - y * y)))

    names = ("n", "x", "y", "xx", "yy", "xy")
    j = per.crossJoin(F.broadcast(whole))
    left = [F.col(f"t_{i}") - F.col(c) for i, c in enumerate(names)]
    full = [F.col(f"t_{i}") for i in range(6)]
    return j.select("omitted", left[0].alias("n"), r(*left).alias("pearson"), (r(*left) - r(*full)).alias("change"))


# Curve and figure data ------------------------------------------------------


def calibration(df: DataFrame, y: str, p: str, n: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * n), F.lit(n - 1)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def histogram(df: DataFrame, x: str, low: float, high: float, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(bin, n, density) on fixed edges, the last bin closed; values outside drop."""
    width = (high - low) / n
    c = F.col(x)
    b = F.least(F.floor((c - low) / width), F.lit(n - 1)).cast("int").alias("bin")
    counts = df.filter(c.between(low, high)).groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * width))


def density_grid(df: DataFrame, x: str, y: str, low: float, high: float, n: int) -> DataFrame:
    cell = lambda c, name: F.least(F.floor((F.col(c) - low) / ((high - low) / n)), F.lit(n - 1)).cast("int").alias(name)
    return df.filter(F.col(x).between(low, high) & F.col(y).between(low, high)).groupBy(cell(x, "x_bin"), cell(y, "y_bin")).agg(F.count(F.lit(1)).alias("n"))


def gain_panel(intervals: DataFrame, order: list[str], stratum: str = "stratum", gain: str = "gain") -> DataFrame:
    """(place, stratum, change, low, high): gains as changes of the error, so signs and ends of the intervals swap; strata in a given order, others drop."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(stratum))
    return intervals.select(place.alias("place"), stratum, (-F.col(gain)).alias("change"), (-F.col("high")).alias("low"), (-F.col("low")).alias("high")).filter("place > 0")


def consensus(df: DataFrame, key: str, run: str, effect: str, top: int) -> DataFrame:
    """(key, n_runs, mean_rank, top<k>_frequency, mean_effect, sign_consistency) over runs; ranks are by absolute effect inside a run, ties at their smallest.

    Ranks are counted over the distinct values of all runs in ranges, so no run is sorted in one task.
    """
    marked = df.withColumn("by_", -F.abs(effect))
    values = marked.groupBy(run, "by_").agg(F.count(F.lit(1)).alias("n_"))
    counted = running(values, [F.col(run), F.col("by_")], {"upto_": F.col("n_")})
    first = counted.groupBy(run).agg(F.min(F.col("upto_") - F.col("n_")).alias("start_"))
    rank = counted.join(F.broadcast(first), run).select(run, "by_", (F.col("upto_") - F.col("n_") - F.col("start_") + 1).alias("r_"))
    x = F.col(effect)
    up, down, moved = (F.count(F.when(c, 1)) for c in (x > 0, x < 0, x != 0))
    steady = F.when(moved == 0, 1.0).otherwise(F.greatest(up, down) / moved)
    return marked.join(rank, [run, "by_"]).groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("r_").alias("mean_rank"), F.avg((F.col("r_") <= top).cast("double")).alias(f"top{top}_frequency"), F.avg(x).alias("mean_effect"), steady.alias("sign_consistency"))
