"""Joins and filters that fail when a table isn't what they need: at the first row that breaks the promise, inside the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import require


def unique(df: DataFrame, keys: list[str], what: str = "rows") -> DataFrame:
    """df, failing if a key comes more than once; null keys count as one key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), *(F.first(c).alias(c) for c in df.columns if c not in keys))
    return require(counted, F.col("n_") == 1, f"{what}: a key of {keys} comes more than once").select(*df.columns)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join, failing if right has a key twice."""
    return left.join(unique(right, keys, "the right side"), keys, how)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join, failing if either side has a key twice."""
    return unique(left, keys, "the left side").join(unique(right, keys, "the right side"), keys, how)


def complete(left: DataFrame, right: DataFrame, keys: list[str], needed: list[str] | None = None) -> DataFrame:
    """left with right's columns, failing if a row of left has no partner or a null in the `needed` columns (by default all of right's)."""
    needed = [c for c in right.columns if c not in keys] if needed is None else needed
    joined = many_to_one(left, right.withColumn("there_", F.lit(True)), keys, "left")
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("there_", *needed)])
    # of a row number, which keeps its place, so that neither this test nor a later filter reaches the join, which it would make an inner one that drops what is missing
    told = joined.withColumn("ok_", F.when(F.monotonically_increasing_id() >= 0, ok))
    return require(told, F.col("ok_"), f"a row has no partner, or nulls, by {keys}").drop("there_", "ok_")


def masked_out(rows: DataFrame, masks: DataFrame, key: str, mask: str, include_masked: bool = False) -> DataFrame:
    """rows with their mask, which each must have; masked ones are dropped unless `include_masked`."""
    told = complete(rows, masks.select(key, mask), [key])
    return told if include_masked else told.filter(~F.col(mask))


def _missing(df: DataFrame, column: str) -> Column:
    """Null, or a number that is NaN or infinite."""
    odd = F.isnan(column) | (F.abs(column) == float("inf")) if dict(df.dtypes)[column] in ("double", "float") else F.lit(False)
    return F.col(column).isNull() | F.coalesce(odd, F.lit(False))


def without_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value, finite if it is a number, in all of the columns."""
    return df.filter(~reduce(lambda a, b: a | b, [_missing(df, c) for c in columns], F.lit(False)))


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_rows, n_kept): missing values of each column, all rows, and those that without_nulls keeps."""
    missing = {c: _missing(df, c) for c in columns}
    any_missing = reduce(lambda a, b: a | b, missing.values(), F.lit(False))
    n = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~any_missing, 1)).alias("n_kept"), *(F.count(F.when(m, 1)).alias(c) for c, m in missing.items()))
    return n.unpivot(["n_rows", "n_kept"], columns, "column", "n_null").select("column", "n_null", "n_rows", "n_kept")


def masks_by_split(probes: DataFrame, manifest: DataFrame, key: str, mask: str, split: str = "split") -> DataFrame:
    """(split, n_rows, n_missing, n_masked) of probes against a manifest; an error if it has a key twice."""
    joined = many_to_one(probes.select(split, key), manifest.select(key, mask, F.lit(True).alias("there_")), [key], "left")
    return joined.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("there_").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col(mask), 1)).alias("n_masked"))


def first_present(df: DataFrame, columns: list[str]) -> Column:
    """The first of the columns that df has and that isn't empty in the row."""
    there = [c for c in columns if c in df.columns]
    if not there:
        raise ValueError(f"none of {columns}")
    return F.coalesce(*(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in there))


def with_id(df: DataFrame, columns: list[str], parts: list[str], name: str = "id") -> DataFrame:
    """df with an identifier: the first present of `columns`, else the `parts` joined by |."""
    made = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in parts))
    return df.withColumn(name, F.coalesce(first_present(df, columns), made) if any(c in df.columns for c in columns) else made)
