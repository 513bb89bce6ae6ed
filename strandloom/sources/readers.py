"""Readers of the formats that locus and variant data come in, as Spark scans."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as S
from ..operators.checked import unique
from .storage import file_system, open_file


def delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A CSV or TSV (compressed or not) with a header, by names, NaN as null."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, nullValue="", enforceSchema=False)
    df = df.select(*columns) if columns else df
    return df.select(*(S.nan_to_null(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def first_present(df: DataFrame, names: tuple[str, ...], default: Column | None = None) -> Column:
    """The first of several column names that df has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    if default is None:
        raise ValueError(f"none of {names} in {df.columns}")
    return default


def sample_columns(df: DataFrame, taken: str = r"(?i)^TCGA[-.][A-Z0-9]{2}[-.][A-Z0-9]{4}[-.]11[A-Z]") -> list[str]:
    import re

    return [c for c in df.columns if re.search(taken, c)]


def long_matrix(df: DataFrame, probe: str, samples: list[str]) -> DataFrame:
    """(probe_id, sample_id, beta) of a wide matrix; empty cells drop."""
    if not samples:
        raise ValueError("no sample columns")
    one = df.select(F.col(probe).alias("probe_id"), *(F.col(f"`{c}`").cast("double").alias(c) for c in samples))
    return one.unpivot("probe_id", [F.col(f"`{c}`") for c in samples], "sample_id", "beta").withColumn("beta", S.nan_to_null(F.col("beta"))).filter("beta is not null")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """(chr, source, feature, start, end, strand, phase, attributes map<string, array<string>>): repeated keys keep all values; comments and short lines drop."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(f) >= 9))
    # a field without a space, or empty, is no attribute
    fields = F.filter(F.transform(F.split(f[8], ";"), lambda x: F.trim(x)), lambda x: F.instr(x, " ") > 0)
    pairs = F.transform(fields, lambda x: F.struct(F.substring_index(x, " ", 1).alias("k"), F.regexp_replace(F.trim(F.substring(x, F.instr(x, " ") + 1, F.length(x))), '^"+|"+$', "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    attributes = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))
    return lines.select(S.normal_chromosome(f[0]).alias("chr"), f[1].alias("source"), f[2].alias("feature"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"), f[7].alias("phase"), attributes.alias("attributes"))


def first_attribute(key: str, default: str = "") -> Column:
    return F.coalesce(F.get(F.element_at("attributes", key), F.lit(0)), F.lit(default))


def fasta(spark: SparkSession, path: str, chunk: int = 10_000, chunks: int = 100, regions: Iterable[tuple[str | None, int, int | None]] | None = None) -> DataFrame:
    """(chrom, chunk_id, start, seq) of an indexed FASTA file, or of all `.fa` files of a folder with an index `.fai` each.

    Of `regions` (contig or None for each, low, high or None for its end), only the bytes of chunks that lie in one in part
    are read, each chunk once; without regions, all. They are asked for here and not by filters, as
    Spark 4.1 keeps the filters that it pushed to a Python source for every later plan of the same DataFrame.
    """
    spark.dataSource.register(FastaSource)
    asked = {} if regions is None else {"regions": json.dumps(list(regions))}
    return spark.read.format("fasta_chunks").options(path=path, chunk=chunk, chunks=chunks, **asked).load()


class FastaSource(DataSource):
    """Format `fasta_chunks`: (chrom, chunk_id, start, seq), upper-cased, one partition for each `chunks` chunks asked for of a file. Options: path, chunk (bases in a row), chunks, regions (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def schema(self) -> str:
        return "chrom string, chunk_id long, start long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader(self.options["path"], int(self.options.get("chunk", 10_000)), int(self.options.get("chunks", 100)), json.loads(self.options.get("regions", "null")))


class Contig(NamedTuple):
    """A line of an index: `bases` of a line of `width` bytes."""

    chrom: str
    length: int
    offset: int
    bases: int
    width: int

    def byte(self, base: int) -> int:
        return self.offset + base // self.bases * self.width + base % self.bases


class _Ranges(InputPartition):
    """Chunks [first, last) of contigs of one file."""

    def __init__(self, path: str, ranges: list[tuple[Contig, int, int]]):
        self.path, self.ranges = path, ranges


class _FastaReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, chunks: int, regions: list | None):
        self.path, self.chunk, self.chunks = path, chunk, chunks
        self.regions: dict[str | None, list] | None = None if regions is None else {}
        for chrom, low, high in regions or ():
            self.regions.setdefault(chrom, []).append((low, high))

    def _spans(self, contig: Contig) -> Iterator[tuple[int, int]]:
        """Ranges of the contig's chunks that are asked for, in order and apart."""
        asked = [(0, None)] if self.regions is None else [*self.regions.get(None, []), *self.regions.get(contig.chrom, [])]
        done = 0
        for low, high in sorted((max(0, low), contig.length if high is None else min(high, contig.length)) for low, high in asked):
            first, last = max(done, low // self.chunk), -(-high // self.chunk)
            if low < high and first < last:
                yield first, last
                done = last

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in fasta_files(self.path):
            ranges: list[tuple[Contig, int, int]] = []
            room = self.chunks
            for contig in _index(path):
                for at, end in self._spans(contig):
                    while at < end:
                        to = min(end, at + room)
                        ranges.append((contig, at, to))
                        room, at = room - (to - at), to
                        if not room:
                            out.append(_Ranges(path, ranges))
                            ranges, room = [], self.chunks
            if ranges:
                out.append(_Ranges(path, ranges))
        return out or [_Ranges(self.path, [])]

    def read(self, p: _Ranges) -> Iterator[tuple]:
        if not p.ranges:
            return
        with open_file(p.path) as f:
            for contig, first, last in p.ranges:
                for i in range(first, last):
                    start, end = i * self.chunk, min(contig.length, (i + 1) * self.chunk)
                    f.seek(contig.byte(start))
                    raw = f.read(contig.byte(end - 1) + 1 - contig.byte(start))
                    yield contig.chrom, i, start, raw.replace(b"\n", b"").replace(b"\r", b"").decode().upper()


def fasta_files(path: str) -> list[str]:
    """The file itself, or the `.fa` files of a folder."""
    files, at = file_system(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".fa"))
    return [f"{path.rstrip('/')}/{name}" for name in names]


def _index(path: str) -> Iterator[Contig]:
    with open_file(path + ".fai") as index:
        for line in index.read().decode().splitlines():
            chrom, *numbers = line.split("\t")[:5]
            yield Contig(chrom, *map(int, numbers))


def genome_slices(genome: DataFrame, wanted: DataFrame, chunk: int, low: str = "low", high: str = "high", key: str = "chr") -> DataFrame:
    """wanted with `seq` of [low, high), from chunk rows: the few chunks that a slice touches are joined by number and cut. Null beyond the contig.

    A slice of one chunk is cut where it meets it, so only pieces of the others are shuffled; nor is a genome in buckets of (chrom, chunk_id).
    """
    c = F.col
    first, last = F.floor(c(low) / chunk), F.floor((c(high) - 1) / chunk)
    alone = F.coalesce((c(high) > c(low)) & (c(low) >= 0) & (first == last), F.lit(False))
    chunks = genome.select(c("chrom").alias("k_"), c("chunk_id").alias("i_"), c("start").alias("s_"), c("seq").alias("q_"))
    cut = F.substring("q_", (c(low) - c("s_") + 1).cast("int"), (c(high) - c(low)).cast("int"))
    one = wanted.filter(alone).join(chunks, (c(key) == c("k_")) & (first == c("i_")), "left").select(*wanted.columns, F.when(F.length(cut) == c(high) - c(low), cut).alias("seq"))
    rest = wanted.filter(~alone)
    ids = F.explode(F.sequence(F.floor(c("a_") / chunk), F.floor((c("z_") - 1) / chunk))).alias("chunk_id")
    asked = rest.select(c(key).alias("k_"), c(low).alias("a_"), c(high).alias("z_")).distinct().filter("z_ > a_ and a_ >= 0")
    hit = asked.select("*", ids).join(genome.select(c("chrom").alias("k_"), "chunk_id", "start", "seq"), ["k_", "chunk_id"])
    part = F.substring("seq", (F.greatest(c("a_"), c("start")) - c("start") + 1).cast("int"), (F.least(c("z_"), c("start") + chunk) - F.greatest(c("a_"), c("start"))).cast("int"))
    whole = hit.groupBy("k_", "a_", "z_").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", part.alias("s")))), lambda x: x["s"]), "").alias("seq"))
    whole = whole.withColumn("seq", F.when(F.length("seq") == c("z_") - c("a_"), c("seq")))
    return one.unionByName(rest.join(whole, (c(key) == c("k_")) & (c(low) == c("a_")) & (c(high) == c("z_")), "left").drop("k_", "a_", "z_"))


def variant_hits(hits: DataFrame) -> DataFrame:
    """(chr, pos1, ref, alt, ssm_ids, case_ids, submitter_ids): nested hit documents grouped by change, with sorted distinct ids; hits without a single-base change drop."""
    one = hits.select("ssm_id", S.genomic_change_fields(F.col("genomic_dna_change"), F.col("chromosome"), F.col("start_position"), F.col("reference_allele"), F.col("tumor_allele")).alias("v"), F.explode_outer("occurrence").alias("o"))
    flat = one.select("v.*", "ssm_id", F.coalesce("o.case.case_id", "o.case.id").alias("case_id"), F.col("o.case.submitter_id").alias("submitter_id")).filter(F.col("ref").isin(*S.BASES) & F.col("alt").isin(*S.BASES) & (F.col("ref") != F.col("alt")))
    return flat.groupBy("chr", "pos1", "ref", "alt").agg(*(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("ssm_id", "case_id", "submitter_id")))


def spdi_variants(records: DataFrame, accessions: DataFrame) -> DataFrame:
    """(record_id, chr, pos1, ref, alt) of records (record_id, variation_set[].canonical_spdi); accessions: (accession, chr). Single bases alone."""
    parts = records.select("record_id", F.explode("variation_set.canonical_spdi").alias("spdi")).select("record_id", F.split("spdi", ":").alias("s")).filter(F.size("s") == 4)
    rows = parts.select("record_id", F.col("s")[0].alias("accession"), (F.col("s")[1].try_cast("long") + 1).alias("pos1"), F.col("s")[2].alias("ref"), F.col("s")[3].alias("alt"))
    ok = rows.filter(F.col("ref").isin(*S.BASES) & F.col("alt").isin(*S.BASES) & (F.col("ref") != F.col("alt")) & F.col("pos1").isNotNull())
    return ok.join(accessions, "accession").select("record_id", "chr", "pos1", "ref", "alt").distinct()


def placements(records: DataFrame, accessions: DataFrame) -> DataFrame:
    """(rsid, chr, pos1, ref, alt) of records (rsid, placements[] of (seq_id, is_ptlp, refseq_chromosome, alleles[] of (position, deleted, inserted)))."""
    p = records.select("rsid", F.explode("placements").alias("p")).filter(F.coalesce("p.is_ptlp", F.lit(False)) | F.coalesce("p.refseq_chromosome", F.lit(False)))
    ref = F.get(F.filter("p.alleles", lambda a: a["deleted"] == a["inserted"]), F.lit(0))
    rows = p.select("rsid", F.col("p.seq_id").alias("accession"), ref["inserted"].alias("ref"), F.explode("p.alleles").alias("a")).select("rsid", "accession", "ref", (F.col("a.position") + 1).alias("pos1"), F.col("a.inserted").alias("alt"), F.col("a.deleted").alias("deleted"))
    ok = rows.filter((F.col("alt") != F.col("deleted")) & F.col("ref").isin(*S.BASES) & F.col("alt").isin(*S.BASES))
    return ok.join(accessions, "accession").select("rsid", "chr", "pos1", "ref", "alt").distinct()


def resolve_seeds(seeds: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, audit) of seeds (rsid, expected_alt) against placements: several alleles and none expected is ambiguous."""
    n = resolved.groupBy("rsid").agg(F.count(F.lit(1)).alias("n_"))
    j = seeds.join(resolved, "rsid", "left").join(n, "rsid", "left")
    status = F.when(F.col("alt").isNull(), "unresolved").when(F.col("expected_alt").isNotNull() & (F.col("alt") != F.col("expected_alt")), "other_allele").when(F.col("expected_alt").isNull() & (F.col("n_") > 1), "ambiguous").otherwise("resolved")
    marked = j.withColumn("status", status)
    return marked.filter("status = 'resolved'").drop("n_", "status"), marked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample) of a JSON list, or an object with the list under one of four keys."""
    raw = spark.read.text(path, wholetext=True)
    keys = ("samples", "selected_samples", "columns", "sample_columns")
    under = [F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in keys]
    return raw.select(F.explode(F.coalesce(F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")), *under)).alias("sample"))


def predictions(spark: SparkSession, path: str, seeds: list[int] | None = None, models: list[str] | None = None) -> DataFrame:
    """Predictions in folders seed=/model=, one read of the folders asked for; fails where a probe comes twice in a run, and at once where a run asked for isn't there."""
    df = spark.read.parquet(path)
    missing = {"probe_id", "truth", "pred", "seed", "model"} - set(df.columns)
    if missing:
        raise ValueError(f"missing {sorted(missing)}")
    for column, asked in (("seed", seeds), ("model", models)):
        df = df.filter(F.col(column).isin(*asked)) if asked is not None else df
    if seeds is not None and models is not None:
        there = {(r.seed, r.model) for r in df.select("seed", "model").distinct().collect()}  # as many as there are folders
        if lost := {(s, m) for s in seeds for m in models} - there:
            raise ValueError(f"runs without predictions: {sorted(lost)}")
    return unique(df, ["probe_id", "seed", "model"], "predictions")


def loci(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Loci in folders split=, tagged by it; fails where a probe comes twice, in one split or in two."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("split").isin(*splits)) if splits is not None else df
    return unique(df, ["probe_id"], "loci")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def publication_links(docs: DataFrame) -> DataFrame:
    """(record_id, publication_id) of link documents (record_id, xml), distinct."""
    return docs.select("record_id", F.explode(F.array_distinct(F.xpath("xml", F.lit("//LinkSetDb/Link/Id/text()")))).alias("publication_id")).distinct()
