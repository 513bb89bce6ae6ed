"""Writers and manifests. A Spark job's commit is atomic, so readers see all of a table or nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .storage import digest, file_system


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def json_summary(df: DataFrame, path: str) -> None:
    """One JSON object a row, with nulls for what isn't finite."""
    finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def fasta(df: DataFrame, path: str, id_col: str, seq: str, length: int | None = None) -> None:
    """Records of two lines; fails on a sequence of another length."""
    ok = F.lit(True) if length is None else F.length(seq) == length
    text = F.when(ok, F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq))).otherwise(F.raise_error(F.concat(F.lit("wrong length: "), F.col(id_col))))
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def by_split(df: DataFrame, path: str, split: str = "split", chrom: str = "chr", pos: str = "pos", tie: str = "probe_id") -> None:
    """One folder for each split, in natural chromosome order; range-partitioned, so a large split has many files in order."""
    order = S.chromosome_order(F.col(chrom))
    df.withColumn("o_", order).repartitionByRange(split, "o_", pos).sortWithinPartitions(split, "o_", pos, tie).drop("o_").write.mode("overwrite").partitionBy(split).parquet(path)


def indexed_fasta(df: DataFrame, path: str, id_col: str, seq: str, bases: int = 60) -> None:
    """A folder of FASTA files, one for each partition of df that isn't empty, with an index `.fai` each; lines have `bases` bases. The folder must be new.

    A task writes its files under names of its own and renames them when they are whole, so
    a task that runs again replaces them by equal ones. Sequences are ASCII; a null one is empty.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(seq), F.lit("")).alias("seq")).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = file_system(path)
        own = f"{folder}/.{uuid.uuid4().hex}"
        name, at = None, 0
        with files.open_output_stream(own + ".fa") as out, files.open_output_stream(own + ".fai") as index:
            for b in batches:
                for i, text, part in zip(b["id"], b["seq"], b["part"]):
                    name = f"{folder}/part-{part:05d}.fa"
                    head, raw = f">{i}\n".encode(), text.encode("ascii")
                    lines = b"".join(raw[k : k + bases] + b"\n" for k in range(0, len(raw), bases))
                    index.write(f"{i}\t{len(raw)}\t{at + len(head)}\t{bases}\t{bases + 1}\n".encode())
                    out.write(head + lines)
                    at += len(head) + len(lines)
        if name is None:
            files.delete_file(own + ".fa")
            files.delete_file(own + ".fai")
        else:
            files.move(own + ".fai", name + ".fai")
            files.move(own + ".fa", name)
        yield from ()

    files, folder = file_system(path)
    files.create_dir(folder)
    if files.get_file_info(fs.FileSelector(folder)):
        raise ValueError(f"{path} isn't empty")
    rows.mapInPandas(run, "done boolean").write.format("noop").mode("overwrite").save()


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a path, of any size: Spark lists them (but those of no bytes, as in any scan), and tasks stream them through the hash."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sha256=[digest(p) for p in b["path"]])

    return listed.mapInPandas(run, "path string, size long, sha256 string")


def embed_records(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Manifest rows with the JSON text of the records (path, record) of the same path."""
    return manifest.join(records, "path", "left")


def record_hash(df: DataFrame, columns: list[str]) -> Column:
    """sha256 of the JSON of columns in sorted order, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def package_manifest(items: DataFrame, files: DataFrame) -> DataFrame:
    """items (name, required) with (size, sha256, status): present, optional_missing or required_missing."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")
    status = F.when(F.col("sha256").isNotNull(), "present").when(F.col("required"), "required_missing").otherwise("optional_missing")
    return items.join(named, "name", "left").withColumn("status", status)


def filtered_derivative(df: DataFrame, flag: str | None, keep: DataFrame | None = None, keys: tuple[str, ...] = ("variant_id", "cpg_id")) -> DataFrame:
    """Rows whose flag is false-like; without the flag, those with their keys in keep."""
    if flag and flag in df.columns:
        return df.filter(F.lower(F.trim(F.col(flag).cast("string"))).isin("false", "f", "0", "no", "n"))
    if keep is None:
        raise ValueError("neither a flag nor keys to keep")
    return df.join(keep.select(*keys).distinct(), list(keys), "left_semi")
