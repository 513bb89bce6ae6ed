"""Ranks, picks, top-k and set comparison. Every order has a tie-break."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settling import settle


def average_rank(by: Column, keys: list[str] | None = None) -> Column:
    """Rank with ties at their mean, within keys."""
    keys = keys or []
    return F.rank().over(Window.partitionBy(*keys).orderBy(by)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, by)) - 1) / 2.0


def running(df: DataFrame, by: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with inclusive running sums over the whole table in an order without ties.

    The table is range-partitioned and written once with its partition's number; sums
    run inside partitions and start from the totals of those before, one row each.
    """
    own = {f"{k}_own_": c for k, c in sums.items()}
    ranged = settle(df.withColumns(own).repartitionByRange(*by).withColumn("range_", F.spark_partition_id()))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range_").agg(*(F.sum(c).alias(c) for c in own))
    starts = totals.select("range_", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}start_") for c in own))
    inside = Window.partitionBy("range_").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(F.broadcast(starts), "range_").withColumns({k: F.col(f"{k}_own_start_") + F.sum(f"{k}_own_").over(inside) for k in sums})
    return run.drop("range_", *own, *(f"{c}start_" for c in own))


def number_in(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", groups: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """df with the place of each row inside its keys, from 1, in an order without ties; counted in ranges, so no key is sorted in one task.

    `groups` (columns with their order) names the first of the order, or coarser steps of it, where their values are few
    and each can be sorted in one task (no floating numbers, whose zeros Spark makes equal in a shuffle of its own). Rows are shuffled once then, by keys and groups, and neither sampled nor written:
    the sizes of groups are counted on that same shuffle, and a group's numbers start behind those of the groups before it. `parts`: of the shuffle, by default the session's.
    """
    if groups:
        at = [*keys, *groups]
        dealt = df.repartition(parts, *at) if parts else df.repartition(*at)
        one = F.xxhash64(*df.columns).bitwiseAND(F.lit(0)) + 1  # of all columns, as a count of fewer would be a shuffle of its own
        earlier = Window.partitionBy(*keys).orderBy(*groups.values()).rowsBetween(Window.unboundedPreceding, -1)
        starts = dealt.groupBy(*at).agg(F.sum(one).alias("n_")).select(*at, F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("start_"))
        numbered = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*at).orderBy(*order)).cast("long"))
        return by_keys(numbered, F.broadcast(starts), at).withColumn(name, F.col(name) + F.col("start_")).drop("start_")
    run = running(df, [*map(F.col, keys), *order], {name: F.lit(1)})
    first = run.groupBy(*keys).agg((F.min(name) - 1).alias("before_"))
    return run.join(first, keys).withColumn(name, F.col(name) - F.col("before_")).drop("before_")


def global_average_rank(df: DataFrame, by: str, out: str = "rank") -> DataFrame:
    """As average_rank over the whole table, without sorting it in one task: distinct values are counted and summed in order."""
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n_"))
    ranked = running(counts, [F.col(by)], {"r_": F.col("n_")})
    return df.join(ranked.select(by, (F.col("r_") - (F.col("n_") - 1) / 2.0).alias(out)), by, "left")


def by_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the columns of b, one row for each of its keys; null keys are keys too, and without keys b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    named = b.withColumnsRenamed({k: f"{k}_key_" for k in keys})
    met = reduce(lambda x, y: x & y, [a[k].eqNullSafe(named[f"{k}_key_"]) for k in keys])
    return a.join(named, met, how).drop(*(f"{k}_key_" for k in keys))


def placed_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n_, below_, all_): the distinct values of each key, how often each is there, how many lie below, and how many there are. Values are counted first and put in order in ranges, so no task holds a key's values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_"))
    run = settle(running(counts, [*map(F.col, keys), F.col(value)], {"upto_": F.col("n_")}))
    of = run.groupBy(*keys).agg(F.min(F.col("upto_") - F.col("n_")).alias("start_"), F.sum("n_").alias("all_"))
    return by_keys(run, of, keys).select(*keys, value, "n_", (F.col("upto_") - F.col("n_") - F.col("start_")).alias("below_"), "all_")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], names: list[str]) -> DataFrame:
    """(keys, names): exact percentiles of each key's values that are there, between two neighbours by their distance; keys without any have no row."""
    v = placed_values(df, keys, value)
    at = [F.lit(float(p)) * (F.col("all_") - 1) for p in shares]
    holds = lambda place: (F.col("below_") <= place) & (place < F.col("below_") + F.col("n_"))
    ends = [(F.max(F.when(holds(F.floor(a)), F.col(value))), F.max(F.when(holds(F.ceil(a)), F.col(value)))) for a in at]
    asked = reduce(lambda x, y: x | y, [holds(f(a)) for a in at for f in (F.floor, F.ceil)])
    got = v.filter(asked).groupBy(*keys).agg(F.max("all_").alias("all_"), *(e.cast("double").alias(f"{s}{i}_") for i, two in enumerate(ends) for s, e in zip("lh", two)))
    rest = lambda a: a - F.floor(a)
    return got.select(*keys, *(F.when(F.col(f"l{i}_") == F.col(f"h{i}_"), F.col(f"l{i}_")).otherwise(F.col(f"l{i}_") * (1 - rest(a)) + F.col(f"h{i}_") * rest(a)).alias(n) for i, (a, n) in enumerate(zip(at, names))))


def keyed_average_rank(df: DataFrame, keys: list[str], by: str, out: str = "rank", ties: str = "average") -> DataFrame:
    """df with the rank of `by` inside its keys, counted in ranges; ties at their mean, or with "first" at their smallest; null for null."""
    v = placed_values(df, keys, by)
    rank = F.col("below_") + (1 if ties == "first" else (F.col("n_") + 1) / 2.0)
    return by_keys(df, v.select(*keys, by, rank.alias(out)), [*keys, by], "left")


def percentile_rank(rank: Column, n: Column, convention: str = "from_zero") -> Column:
    """from_zero: 100 (r - 1) / (n - 1), 50 for one row; share: 100 r / n."""
    return F.when(n == 1, 50.0).otherwise(100.0 * (rank - 1) / (n - 1)) if convention == "from_zero" else 100.0 * rank / n


def quartile_strata(df: DataFrame, x: str, out: str = "stratum", labels=("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """df with right-closed quartiles of the percentile rank among values that are there; others are Missing."""
    n = df.agg(F.count(x).alias("n_"))
    share = F.col("rank_") / F.col("n_")
    label = F.when(F.col(x).isNull(), "Missing").when(share <= 0.25, labels[0]).when(share <= 0.5, labels[1]).when(share <= 0.75, labels[2]).otherwise(labels[3])
    return global_average_rank(df, x, "rank_").crossJoin(F.broadcast(n)).withColumn(out, label).drop("rank_", "n_")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has a tie-break."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth_ = 1").drop("nth_")


def zero_boundary(value: Column, rank: Column) -> Column:
    """Aggregate: the middle between the highest rank below zero and the lowest above, else 50."""
    return F.coalesce((F.max(F.when(value < 0, rank)) + F.min(F.when(value > 0, rank))) / 2, F.lit(50.0))


def top_k(df: DataFrame, k: int, by: Column, tie: str) -> DataFrame:
    return df.orderBy(by.desc(), tie).limit(k)


def top_overlap(runs: DataFrame, k: int, run: str = "run", id_col: str = "id", score: str = "score") -> DataFrame:
    """(run_a, run_b, overlap, jaccard) of the top k by |score| of all pairs of runs."""
    # of each of 64 parts of a run the first k, so no run sorts in one task
    order = [F.abs(score).desc(), F.col(id_col)]
    few = runs.withColumn("part_", F.pmod(F.xxhash64(id_col), F.lit(64))).withColumn("nth_", F.row_number().over(Window.partitionBy(run, "part_").orderBy(*order))).filter(F.col("nth_") <= k)
    best = settle(few.withColumn("nth_", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("nth_") <= k).select(run, id_col))
    a, b = best.select(F.col(run).alias("run_a"), id_col), best.select(F.col(run).alias("run_b"), id_col)
    both = a.join(b, id_col).filter("run_a < run_b").groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("overlap"))
    size = best.groupBy(run).agg(F.count(F.lit(1)).alias("n_"))
    names = size.select(F.col(run).alias("run_a"), F.col("n_").alias("na_")).join(size.select(F.col(run).alias("run_b"), F.col("n_").alias("nb_")), F.col("run_a") < F.col("run_b"))
    n = F.coalesce("overlap", F.lit(0))
    return names.join(both, ["run_a", "run_b"], "left").select("run_a", "run_b", n.alias("overlap"), (n / (F.col("na_") + F.col("nb_") - n)).alias("jaccard"))


def set_difference_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both, equal) of the distinct keys of two tables."""
    x, y = a.select(key).distinct().withColumn("a_", F.lit(1)), b.select(key).distinct().withColumn("b_", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    j = x.join(y, key, "full")
    only_a, only_b = n(F.col("b_").isNull()), n(F.col("a_").isNull())
    return j.agg(only_a.alias("only_a"), only_b.alias("only_b"), n(F.col("a_").isNotNull() & F.col("b_").isNotNull()).alias("both"), ((only_a == 0) & (only_b == 0)).alias("equal"))


def distinct_in_order(df: DataFrame, key: str, value: str, order: str, separator: str = " | ") -> DataFrame:
    """(key, value): distinct values of a key joined as first seen."""
    seen = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o_"))
    return seen.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_", value))), lambda s: s[value]), separator).alias(value))
