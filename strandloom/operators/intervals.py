"""Range, nearest, as-of and overlap joins as equi-joins on bins or as windows; none plans a nested loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(low: Column, high: Column, width: int) -> Column:
    """The bins that a closed range touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def window_join(points: DataFrame, others: DataFrame, low: int, high: int, point: str = "pos", other: str = "pos", key: str = "chr", width: int | None = None) -> DataFrame:
    """Pairs of one key with low <= point - other <= high; columns of points, then of others prefixed `o_`.

    Each of points is in one bin and each of others in the bins its window touches, so a
    pair meets once.
    """
    width = width or max(1, high - low + 1)
    left = points.withColumn("bin_", F.floor(F.col(point) / width))
    right = others.select(*(F.col(c).alias(f"o_{c}") for c in others.columns)).withColumn("bin_", F.explode(bins(F.col(f"o_{other}") + low, F.col(f"o_{other}") + high, width)))
    d = F.col(point) - F.col(f"o_{other}")
    return left.join(right, (F.col(key) == F.col(f"o_{key}")) & (left["bin_"] == right["bin_"]) & d.between(low, high)).drop("bin_")


def containing(points: DataFrame, intervals: DataFrame, point: str = "pos", start: str = "start", end: str = "end", key: str = "chr", width: int = 10_000, how: str = "inner") -> DataFrame:
    """Points with the closed intervals that hold them (`o_` columns); left_semi: points in any interval.

    An interval is in all bins that it touches. One that covers over 64 bins goes to
    bins 64 times as wide, so that long intervals don't multiply.
    """
    wide = width * 64
    named = intervals.select(*(F.col(c).alias(f"o_{c}") for c in intervals.columns))
    s, e = F.col(f"o_{start}"), F.col(f"o_{end}")
    long_ = (F.floor(e / width) - F.floor(s / width)) >= 64
    right = named.filter(s <= e).withColumn("level_", long_.cast("int")).withColumn("bin_", F.explode(F.when(long_, bins(s, e, wide)).otherwise(bins(s, e, width))))
    p = F.col(point)
    left = points.withColumn("at_", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.floor(p / width).alias("bin")), F.struct(F.lit(1).alias("level"), F.floor(p / wide).alias("bin")))))
    on = (left[key] == right[f"o_{key}"]) & (left["at_.level"] == right["level_"]) & (left["at_.bin"] == right["bin_"]) & p.between(s, e)
    if how == "left_semi":
        return left.join(right, on, "left_semi").drop("at_").distinct()
    return left.join(right, on).drop("at_", "level_", "bin_")


def count_containing(points: DataFrame, intervals: DataFrame, name: str, point: str = "pos", start: str = "start", end: str = "end", key: str = "chr", width: int = 4096) -> DataFrame:
    """points with the number of closed intervals that hold them, without making pairs: starts up to a point less ends before it, as running sums inside bins of `width`; those of earlier bins are carried over."""
    c = F.col
    valid = intervals.filter((c(start) <= c(end)) & c(key).isNotNull())
    side = lambda df, at, order, n: df.select(c(key).alias("k_"), c(at).alias("p_"), F.lit(order).alias("order_"), F.lit(n).alias("n_"))
    marks = side(valid, start, 0, 1).unionByName(side(valid, end, 2, -1)).groupBy("k_", "p_", "order_").agg(F.sum("n_").alias("n_"))
    asked = side(points.select(key, point).dropna().distinct(), point, 1, 0).withColumn("n_", F.lit(0).cast("long"))
    both = marks.unionByName(asked).withColumn("bin_", F.floor(c("p_") / width))
    earlier = Window.partitionBy("k_").orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("k_", "bin_").agg(F.sum("n_").alias("n_")).select("k_", "bin_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    upto = Window.partitionBy("k_", "bin_").orderBy("p_", "order_").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.select("k_", "bin_", "p_", "order_", F.sum("n_").over(upto).alias("own_")).filter("order_ = 1")
    told = inside.join(carried, ["k_", "bin_"]).select("k_", "p_", (c("own_") + c("before_")).alias(name))
    return points.join(told, (c(key) == c("k_")) & (c(point) == c("p_")), "left").drop("k_", "p_").withColumn(name, F.coalesce(name, F.lit(0)))


def nearest(points: DataFrame, others: DataFrame, point: str = "pos", pos: str = "pos", name: str = "probe_id", key: str = "chr", bucket: int = 1 << 16) -> DataFrame:
    """points with near_id, near_pos, distance of the nearest of others: of equal distances the left one; left of equal positions the largest name, right the smallest.

    Runs inside buckets of the key; the last (first) of each earlier (later) bucket is
    carried over, so no key, however large, has to be sorted in one task.
    """
    side = lambda df, p, is_point: df.select(F.col(key), F.col(p).cast("long").alias("p_"), is_point.alias("pt_"))
    o = F.struct(F.col(pos).cast("long").alias("pos"), F.col(name).alias("name"))
    known = others.filter(F.col(pos).isNotNull()).select(F.col(key), o.alias("o_"), F.floor(F.col(pos) / bucket).alias("b_"))
    asked = side(points, point, F.lit(True)).distinct().select(key, "p_", F.floor(F.col("p_") / bucket).alias("b_"))
    ends = known.groupBy(key, "b_").agg(F.max("o_").alias("last_"), F.min("o_").alias("first_"))
    marks = ends.unionByName(asked.select(key, "b_").distinct(), allowMissingColumns=True).groupBy(key, "b_").agg(F.max("last_").alias("last_"), F.min("first_").alias("first_"))
    before = Window.partitionBy(key).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy(F.col("b_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(key, "b_", F.max("last_").over(before).alias("left_"), F.min("first_").over(after).alias("right_"))
    both = known.select(key, "b_", F.col("o_.pos").alias("p_"), "o_").unionByName(asked, allowMissingColumns=True)
    up = Window.partitionBy(key, "b_").orderBy("p_").rangeBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(key, "b_").orderBy(F.col("p_").desc()).rangeBetween(Window.unboundedPreceding, 0)
    found = both.select(key, "b_", "p_", "o_", F.max("o_").over(up).alias("l_"), F.min("o_").over(down).alias("r_")).filter("o_ is null")
    got = found.join(carried, [key, "b_"]).select(key, "p_", F.coalesce("l_", "left_").alias("l_"), F.coalesce("r_", "right_").alias("r_"))
    go_left = F.col("r_").isNull() | (F.col("p_") - F.col("l_.pos") <= F.col("r_.pos") - F.col("p_"))
    best = F.when(go_left & F.col("l_").isNotNull(), F.col("l_")).otherwise(F.col("r_"))
    near = got.select(F.col(key).alias("k_"), "p_", best["name"].alias("near_id"), best["pos"].alias("near_pos"), F.abs(best["pos"] - F.col("p_")).alias("distance"))
    return points.join(near, (F.col(key) == F.col("k_")) & (F.col(point).cast("long") == F.col("p_")), "left").drop("k_", "p_")


def merge_intervals(intervals: DataFrame, start: str = "start", end: str = "end", keys: tuple[str, ...] = ("chr",), bucket: int = 1 << 16) -> DataFrame:
    """Closed intervals merged where they overlap or touch (the next starts one after the end).

    Runs inside buckets of the start; the furthest end and the number of islands of earlier
    buckets are carried over, so no key has to be sorted in one task.
    """
    at = [*keys, "b_"]
    rows = intervals.filter(F.col(start) <= F.col(end)).select(*keys, start, end).withColumn("b_", F.floor(F.col(start) / bucket))
    earlier = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    furthest = rows.groupBy(*at).agg(F.max(end).alias("end_")).select(*at, F.max("end_").over(earlier).alias("top0_"))
    w = Window.partitionBy(*at).orderBy(start, end)
    top = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("top0_"))  # nulls don't count
    marked = rows.join(furthest, at).withColumn("top_", top).withColumn("new_", (F.col("top_").isNull() | (F.col(start) > F.col("top_") + 1)).cast("long"))
    islands = marked.groupBy(*at).agg(F.sum("new_").alias("n_")).select(*at, F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("island0_"))
    placed = marked.join(islands, at).withColumn("island_", F.col("island0_") + F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(*keys, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")


def inside_merged(points: DataFrame, merged: DataFrame, flag: str, point: str = "pos", key: str = "chr") -> DataFrame:
    """points with a boolean: inside one of the merged (disjoint) intervals."""
    hit = containing(points.select(key, point).distinct(), merged, point, key=key, how="left_semi").withColumn(flag, F.lit(True))
    return points.join(hit, [key, point], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def named_as(df: DataFrame, known: DataFrame, key: str = "chr") -> DataFrame:
    """df with `key` as `known` spells it: a name that is there stays; else `chr` is taken off or put before it, where that name is there; others (and nulls) stay."""
    c = F.col(key)
    other = F.when(c.startswith("chr"), c.substr(F.lit(4), F.length(c))).otherwise(F.concat(F.lit("chr"), c))
    spelled = F.explode(F.array(F.struct(F.lit(0).alias("nth"), c.alias("name")), F.struct(F.lit(1).alias("nth"), other.alias("name")))).alias("o_")
    names = df.select(key).distinct().select(c.alias("from_"), spelled)
    best = names.join(known.select(c.alias("there_")).distinct(), F.col("o_.name") == F.col("there_")).groupBy("from_").agg(F.min("o_")["name"].alias("as_"))
    return df.join(best, c == F.col("from_"), "left").withColumn(key, F.coalesce("as_", key)).drop("from_", "as_")


def interval_mean(windows: DataFrame, track: DataFrame, start: str = "start", end: str = "end", value: str = "value", id_col: str = "id", key: str = "chr", width: int = 4096, contig_length: Column | None = None) -> DataFrame:
    """(id, mean): the mean over a half-open window's bases that intervals [start, end) cover, weighted by overlap; null if none.

    Interval bases at negative positions don't count, nor those from `contig_length` on (a column of windows). No pairs are made:
    inside a bin of `width` (at most 2**14) bases the sum up to a place is a running sum over the ends of intervals, and a window
    is a difference of two such sums. They are exact, as values count in 2**-70 of the largest one, so nothing is lost in the difference.
    """
    c = F.col
    place = lambda x: x.cast("long")
    left = windows.select(c(id_col).alias("id_"), c(key).alias("k_"), F.greatest(place(c(start)), F.lit(0)).alias("a_"), (place(c(end)) if contig_length is None else F.least(place(c(end)), place(contig_length))).alias("z_"))
    right = track.filter(c(value).isNotNull()).select(c(key).alias("k_"), F.greatest(place(c(start)), F.lit(0)).alias("a_"), place(c(end)).alias("z_"), c(value).cast("double").alias("v_"))
    finite = F.abs("v_") < float("inf")
    top = right.agg(F.max(F.when(finite, F.abs("v_")))).first()[0]
    scale = 2.0 ** min(70 - math.frexp(top or 1.0)[1], 1000)

    def dealt(df: DataFrame, *ends: tuple[int, str]) -> DataFrame:
        """Both ends of each piece that a bin cuts out, from the bin's start, with a sign; where they are 0 they add nothing."""
        cut = df.filter("z_ > a_").withColumn("bin_", F.explode(bins(c("a_"), c("z_") - 1, width)))
        at = lambda x: x - c("bin_") * width
        both = {"a_": at(F.greatest("a_", c("bin_") * width)), "z_": at(F.least("z_", (c("bin_") + 1) * width))}
        return cut.withColumn("e_", F.explode(F.array(*(F.struct(F.lit(g).alias("sign_"), both[e].alias("at_")) for g, e in ends)))).select("*", "e_.*").drop("a_", "z_", "e_")

    # infinite values are counted, a missing number as both of them
    sums = {"n_": F.lit(1), "q_": F.when(finite, c("v_") * scale).otherwise(0.0).cast("decimal(22,0)"), "up_": (F.isnan("v_") | (c("v_") == float("inf"))).cast("int"), "down_": (F.isnan("v_") | (c("v_") == float("-inf"))).cast("int")}
    exact = lambda name, x: x.cast("decimal(38,0)" if name == "q_" else "long")
    marks = dealt(right, (1, "a_"), (-1, "z_")).withColumns(sums).select("k_", "bin_", "at_", *(exact(n, c("sign_") * c(n)).alias(n) for n in sums))
    marks = marks.withColumns({f"{n}at_": exact(n, c(n) * c("at_")) for n in sums})
    asked = dealt(left, (-1, "a_"), (1, "z_")).filter("at_ > 0")
    upto = Window.partitionBy("k_", "bin_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)  # an end at the place itself adds nothing, so ties have any order
    run = marks.unionByName(asked, allowMissingColumns=True)
    told = run.select("id_", "sign_", *(exact(n, c("at_") * F.sum(n).over(upto) - F.sum(f"{n}at_").over(upto)).alias(n) for n in sums)).filter("sign_ is not null")
    total = told.groupBy("id_").agg(*(F.sum(exact(n, c("sign_") * c(n))).alias(n) for n in sums)).filter("n_ > 0")
    infinite = F.when((c("up_") > 0) & (c("down_") > 0), float("nan")).when(c("up_") > 0, float("inf")).when(c("down_") > 0, float("-inf"))
    mean = total.select("id_", F.coalesce(infinite, c("q_").cast("double") / c("n_") / scale).alias("mean"))
    return left.select("id_").join(mean, "id_", "left").withColumnRenamed("id_", id_col)


def span_overlap(pos: Column, begin: Column, end: Column) -> Column:
    """struct of three rules for a position in a probe's span, whose ends come in any order: half-open, closed, closed with one base around."""
    low, high = F.least(begin, end), F.greatest(begin, end)
    return F.struct(((pos >= low) & (pos < high)).alias("half_open"), pos.between(low, high).alias("closed"), pos.between(low - 1, high + 1).alias("around"))
