"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, mixing, pieces, quality, simhash
from strandloom.llm.common import settle


#: Rows of a file have numbers below this.
_FILE_ROWS = 1 << 40


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row (row_): identifiers may repeat or be null, so verdicts are of rows.

    It is made of the number of the row's file, in the order of their names, and its place
    there, so that a table in files needs no copy; any other is settled first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = settle(docs)
    path = F.col("_metadata.file_path").alias("file_")
    names = sorted(r.file_ for r in docs.select(path).distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(names)), "n_ long, file_ string")
    rows = docs.select(*docs.columns, path, F.col("_metadata.row_index").alias("at_"))
    # a row for each file, whose names the driver has
    return rows.join(F.broadcast(files), "file_").select(*docs.columns, (F.col("n_") * _FILE_ROWS + F.col("at_") + 1).alias("row_"))


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The numbered rows whose number is in kept (row_), without it.

    Numbers kept are sent as bits, 32,768 to a bitmap, so a table of a hundred million rows sends 13 MB and no text is shuffled.
    """
    block, place = F.bitmap_bucket_number("row_"), F.bitmap_bit_position("row_")
    tasks = 4 * kept.sparkSession.sparkContext.defaultParallelism
    dealt = kept.select(block.alias("block_"), place.alias("place_")).repartition(tasks, "block_")
    bits = dealt.groupBy("block_").agg(F.bitmap_construct_agg("place_").alias("bits_"))
    byte = F.conv(F.hex(F.substring("bits_", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("block_", block).join(F.broadcast(bits), "block_")
    return met.filter(F.getbit(byte, (place % 8).cast("int")) == 1).drop("block_", "bits_", "row_")


def _ordered() -> F.Column:
    """A row's key in the order of identifiers, nulls last; no two rows share it."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_").alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules and the perplexity bands keep."""
    rows = _numbered(docs)
    judged = quality.quality(rows.select(F.col("row_").alias("doc_id"), "lang", "text"))
    return _only(rows, judged.filter("kept").select(F.col("doc_id").alias("row_")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one row with the smallest identifier."""
    rows = _numbered(docs)
    judged = exact_dedup.exact_dedup(rows.select(_ordered().alias("key"), "text"), id_col="key")
    return _only(rows, judged.filter("kept").select(F.col("doc_id.row").alias("row_")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more of the shingles of five words shared) the one row with the smallest identifier."""
    rows = _numbered(docs)
    found = simhash.similar_documents(rows.select(_ordered().alias("key"), "text"), id_col="key")
    return _only(rows, found.filter("key = component_id").select(F.col("key.row").alias("row_")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rate says."""
    rows, labels = _numbered(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resample(rows, mixing.mix(rows.select("doc_id", "text", "row_"), labels, key="row_"), key="row_").drop("row_")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text."""
    return pieces.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", encoded),
]
ORACLE_SQL = None  # perplexity, fingerprints, rates and pieces are beyond SQL; see the tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
