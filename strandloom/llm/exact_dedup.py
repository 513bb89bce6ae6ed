"""Exact deduplication by content sort, in DataFrame functions alone.

Rows are range-partitioned by the first characters of the normalised text, its
64-bit hash and a salt of the identifier; Spark samples the splitters. Each
partition is sorted externally, so that equal texts stand next to each other, and
the window compares the full text with its neighbour's. The salt cuts a group of
copies, however large, into `salts` runs; their leaders (no text, but its SHA-256
and length) are then merged, one row for each run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, squeeze, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, head_chars: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Null text counts as empty; a null identifier sorts after all others. Of rows
    repeated with the same identifier and text one stays. An empty table gives an
    empty one; other columns of docs are not read.
    """
    norm = squeeze(text_or_empty(text_col))
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        "norm",
        F.substring("norm", 1, head_chars).alias("head"),
        F.xxhash64("norm").alias("h"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    run = Window.partitionBy("head", "h", "salt", "norm").orderBy(F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = settle(
        keyed.repartitionByRange("head", "h", "salt").select(
            "doc_id",
            "salt",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.octet_length("norm").alias("size"),
            F.row_number().over(run).alias("nth"),
            F.first("doc_id").over(whole).alias("lead"),
            F.count(F.lit(1)).over(whole).alias("n"),
        )
    )
    same = Window.partitionBy("sha", "size").orderBy(F.col("lead").asc_nulls_last(), "salt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = rows.filter("nth = 1").select(
        "sha", "size", "salt", F.first("lead").over(same).alias("keep_id"), F.first("salt").over(same).alias("keep_salt"), F.sum("n").over(same).alias("group_size")
    )
    return rows.join(merged, ["sha", "size", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("nth") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
