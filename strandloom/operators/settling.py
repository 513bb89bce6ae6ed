"""Tables that are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset: a new folder of this machine in local mode, else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        sc.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df once and read it back: cuts lineage, is computed once, and survives a lost executor. `compression` is the files', by default the session's; `zstd` takes long sequences in about half the bytes."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_in(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """As settle, in `parts` buckets by the hash of keys, so that joins on them don't shuffle df; also a table of the catalog. One file for each bucket if df is dealt by them (`repartition(parts, *keys)`)."""
    name = f"strandloom_parts_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, *keys).option("path", f"{shared_dir(df.sparkSession)}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def unsettle(df: DataFrame) -> None:
    """Remove the files of a settled table that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("settled-"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
