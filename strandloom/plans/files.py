"""Queries of sources and sinks: what Spark derives from the tables is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.settling import shared_dir
from ..sources import readers, writers
from .derived import Derived, with_tables
from .queries import query, rounded


def scratch(d: Derived, name: str) -> str:
    return f"{shared_dir(d.spark)}/files-{uuid.uuid4().hex}/{name}"


@query(with_tables("loci") + " SELECT probe_id, chr, pos, split, seq FROM loci")
def delimited_round_trip(d: Derived) -> DataFrame:
    path = scratch(d, "loci.csv")
    writers.csv(d.loci.drop("part_key"), path)
    return readers.delimited(d.spark, path, "probe_id string, chr string, pos long, split string, seq string", ["probe_id", "chr", "pos", "split", "seq"], ",")


@query("SELECT 'p' || l_partkey AS probe_id, 'TCGA-AA-000' || l_linenumber || '-11A' AS sample_id, round(max(l_discount), 6) AS beta FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2")
def wide_matrix(d: Derived) -> DataFrame:
    """Normal samples of a wide table with tumour columns beside them."""
    names = [f"TCGA-AA-000{i}-11A" for i in (1, 2, 3)]
    of = lambda i, scale: F.max(F.when(F.col("l_linenumber") == i, F.col("l_discount") * scale))
    wide = d.table("lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("probe")).agg(*(of(i + 1, 1).alias(n) for i, n in enumerate(names)), of(4, 2).alias("TCGA-AA-0004-01A"))
    path = scratch(d, "matrix.csv")
    writers.csv(wide, path)
    read = readers.delimited(d.spark, path, "probe string, " + ", ".join(f"`{c}` double" for c in wide.columns[1:]), None, ",")
    return rounded(readers.long_matrix(read, "probe", readers.sample_columns(read)))


@query(with_tables("signals") + """ SELECT event_id AS tx, chr, "start", "end", CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, 'G' || event_id % 9 AS gene, CASE WHEN event_id % 3 = 0 THEN 'basic,CCDS' ELSE 'basic' END AS tags FROM signals""")
def annotation_lines(d: Derived) -> DataFrame:
    k = F.col("event_id")
    fields = F.concat(F.lit('gene_id "G'), k % 9, F.lit('"; transcript_id "'), k, F.lit('"; tag "basic";'), F.when(k % 3 == 0, ' tag "CCDS";').otherwise(""))
    line = F.concat_ws("\t", F.regexp_replace("chr", "chr", ""), F.lit("made"), F.lit("transcript"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("."), fields)
    path = scratch(d, "genes.gtf")
    d.signals.select(line.alias("value")).write.text(path)
    g = readers.gtf(d.spark, path)
    return g.select(readers.first_attribute("transcript_id").cast("long").alias("tx"), "chr", "start", "end", "strand", readers.first_attribute("gene_id").alias("gene"), F.array_join(F.element_at("attributes", "tag"), ",").alias("tags"))


@query(
    with_tables("variants")
    + """, o AS (SELECT v.*, 'case' || i.i AS case_id FROM variants v, range(0, 2) i(i)) SELECT chr, pos1, ref, alt, string_agg(DISTINCT 's' || variant_id, ',' ORDER BY 's' || variant_id) AS ssm_ids, string_agg(DISTINCT case_id, ',' ORDER BY case_id) AS case_ids FROM o GROUP BY 1, 2, 3, 4"""
)
def variant_documents(d: Derived) -> DataFrame:
    """Nested documents written as JSON lines and read again."""
    change = F.concat("chr", F.lit(":g."), "pos1", "ref", F.lit(">"), "alt")
    cases = F.array(*(F.struct(F.struct(F.lit(f"case{i}").alias("case_id"), F.lit(None).cast("string").alias("id"), F.lit("s").alias("submitter_id")).alias("case")) for i in range(2)))
    path = scratch(d, "hits.json")
    none = F.lit(None).cast("string")
    writers.json_summary(d.variants.select(F.concat(F.lit("s"), "variant_id").alias("ssm_id"), change.alias("genomic_dna_change"), none.alias("chromosome"), F.lit(None).cast("long").alias("start_position"), none.alias("reference_allele"), none.alias("tumor_allele"), cases.alias("occurrence")), path)
    schema = "ssm_id string, genomic_dna_change string, chromosome string, start_position long, reference_allele string, tumor_allele string, occurrence array<struct<case: struct<case_id: string, id: string, submitter_id: string>>>"
    hits = readers.variant_hits(d.spark.read.schema(schema).json(path))
    return hits.select("chr", "pos1", "ref", "alt", F.array_join("ssm_ids", ",").alias("ssm_ids"), F.array_join("case_ids", ",").alias("case_ids"))


def _accessions(d: Derived) -> DataFrame:
    return d.variants.select("chr").distinct().select(F.concat(F.lit("NC_"), F.substring("chr", 4, 2)).alias("accession"), "chr")


@query(with_tables("variants") + " SELECT variant_id AS record_id, chr, pos1, ref, alt FROM variants WHERE variant_id % 5 <> 0")
def spdi_records(d: Derived) -> DataFrame:
    """Every fifth record has a longer change, which drops."""
    base = F.when(F.col("variant_id") % 5 == 0, F.concat("ref", "alt")).otherwise(F.col("ref"))
    spdi: Column = F.concat_ws(":", F.concat(F.lit("NC_"), F.substring("chr", 4, 2)), (F.col("pos1") - 1).cast("string"), base, "alt")
    records = d.variants.select(F.col("variant_id").alias("record_id"), F.array(F.struct(spdi.alias("canonical_spdi"))).alias("variation_set"))
    return readers.spdi_variants(records, _accessions(d))


def _seeds(d: Derived) -> tuple[DataFrame, DataFrame]:
    """Seeds against placements: some have two alleles, some none, some expect one."""
    k = F.col("variant_id")
    third = F.translate("ref", "ACGT", "TTAC")
    allele = lambda x: F.struct((F.col("pos1") - 1).alias("position"), F.col("ref").alias("deleted"), x.alias("inserted"))
    alleles = F.when(k % 4 == 1, F.array(allele(F.col("ref")), allele(F.col("alt")), allele(third))).otherwise(F.array(allele(F.col("ref")), allele(F.col("alt"))))
    records = d.variants.filter("variant_id % 11 <> 0").select(k.alias("rsid"), F.array(F.struct(F.concat(F.lit("NC_"), F.substring("chr", 4, 2)).alias("seq_id"), F.lit(True).alias("is_ptlp"), F.lit(False).alias("refseq_chromosome"), alleles.alias("alleles"))).alias("placements"))
    seeds = d.variants.select(k.alias("rsid"), F.when(k % 3 != 0, F.col("alt")).alias("expected_alt"))
    return readers.resolve_seeds(seeds, readers.placements(records, _accessions(d)))


@query(
    with_tables("variants")
    + """, s AS (SELECT CASE WHEN variant_id % 11 = 0 THEN 'unresolved' WHEN variant_id % 4 = 1 THEN CASE WHEN variant_id % 3 = 0 THEN 'ambiguous' ELSE 'one' END WHEN variant_id % 3 = 0 THEN 'resolved' ELSE 'one' END AS x, variant_id % 11 = 0 AS none, variant_id % 4 = 1 AS two, variant_id % 3 = 0 AS free FROM variants),
r AS (SELECT CASE WHEN none THEN 'unresolved' WHEN NOT free THEN 'resolved' WHEN two THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN none THEN 1 WHEN two AND free THEN 2 ELSE 1 END AS n, NOT none AND two AND NOT free AS also FROM s)
SELECT status, cast(sum(n) AS bigint) AS n FROM (SELECT status, n FROM r UNION ALL SELECT 'other_allele', 1 FROM r WHERE also) GROUP BY 1"""
)
def seed_placements(d: Derived) -> DataFrame:
    return _seeds(d)[1]


@query(with_tables("variants") + " SELECT variant_id AS rsid, CASE WHEN variant_id % 3 <> 0 THEN alt END AS expected_alt, chr, pos1, ref, alt FROM variants WHERE variant_id % 11 <> 0 AND NOT (variant_id % 4 = 1 AND variant_id % 3 = 0)")
def resolved_seeds(d: Derived) -> DataFrame:
    return _seeds(d)[0]


@query(with_tables("predictions") + " SELECT probe_id, seed, model, round(truth, 6) AS truth, round(pred, 6) AS pred FROM predictions WHERE seed IN (42, 43) AND model IN ('fusion', 'sequence')")
def predictions_by_run(d: Derived) -> DataFrame:
    path = scratch(d, "predictions")
    d.predictions.select("probe_id", "seed", "model", "truth", "pred").write.partitionBy("seed", "model").parquet(path)
    return rounded(readers.predictions(d.spark, path, [42, 43], ["fusion", "sequence"]).select("probe_id", "seed", "model", "truth", "pred"))


@query(with_tables("loci") + " SELECT probe_id, chr, pos, split FROM loci WHERE split <> 'val'")
def loci_by_split(d: Derived) -> DataFrame:
    path = scratch(d, "loci")
    writers.by_split(d.loci, path)
    return readers.loci(d.spark, path, ["train", "test"]).select("probe_id", "chr", "pos", "split")


@query(with_tables("loci") + " SELECT '>' || probe_id AS head, seq FROM loci")
def sequence_records(d: Derived) -> DataFrame:
    path = scratch(d, "loci.fa")
    writers.fasta(d.loci, path, "probe_id", "seq", 100)
    lines = d.spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    part = F.split(F.trim("value"), "\n")
    return lines.select(F.concat(F.lit(">"), part[0]).alias("head"), part[1].alias("seq"))


_CONTIGS = """, placed AS (SELECT part_key, 'ctg' || part_key // 50 AS contig, seq, 100 * (row_number() OVER (PARTITION BY part_key // 50 ORDER BY part_key) - 1) AS place FROM loci),
contigs AS (SELECT contig, string_agg(seq, '' ORDER BY place) AS seq FROM placed GROUP BY 1)"""


def _contigs(d: Derived) -> tuple[DataFrame, str]:
    """(part_key, contig, at), and a folder of FASTA files of contigs: the sequences of 50 keys in a row."""
    group = F.floor(F.col("part_key") / 50)
    placed = d.loci.select("part_key", F.concat(F.lit("ctg"), group).alias("contig"), "seq", (100 * (F.row_number().over(Window.partitionBy(group).orderBy("part_key")) - 1)).cast("long").alias("at"))
    path = scratch(d, "contigs")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", F.lower("seq").alias("s")))), lambda x: x["s"])
    writers.indexed_fasta(placed.groupBy("contig").agg(F.array_join(parts, "").alias("seq")), path, "contig", "seq")
    return placed.drop("seq"), path


@query(
    with_tables("loci")
    + _CONTIGS
    + """, c AS (SELECT contig AS chrom, seq, unnest(range(2, 7)) AS i FROM contigs) SELECT chrom, i AS chunk_id, i * 50 AS start, substr(seq, i * 50 + 1, 50) AS seq FROM c WHERE length(seq) > greatest(i * 50, 120)"""
)
def ranged_sequences(d: Derived) -> DataFrame:
    """Of each contig only the chunks of 50 bases are read that touch the bases from 120 to 330."""
    return readers.fasta(d.spark, _contigs(d)[1], 50, 5000, [(None, 120, 330)])


@query(
    with_tables("in_window")
    + _CONTIGS
    + """, w AS (SELECT variant_id, contig, place + 44 + "offset" AS low FROM in_window JOIN placed USING (part_key)) SELECT variant_id, contig AS chr, low, low + 11 AS high, CASE WHEN low >= 0 AND low + 11 <= length(seq) THEN substr(seq, low + 1, 11) END AS seq FROM w JOIN contigs USING (contig)"""
)
def sequence_around_variants(d: Derived) -> DataFrame:
    """Five bases on both sides of each variant, from the chunks of an indexed FASTA; null where they leave the contig."""
    placed, path = _contigs(d)
    low = F.col("at") + 44 + F.col("offset")
    wanted = d.in_window.join(placed, "part_key").select("variant_id", F.col("contig").alias("chr"), low.alias("low"), (low + 11).alias("high"))
    return readers.genome_slices(readers.fasta(d.spark, path, 200, 5000), wanted, 200)


@query(
    """WITH f AS (SELECT o_orderstatus AS name, string_agg(cast(o_orderkey AS varchar), chr(10) ORDER BY o_orderkey) || chr(10) AS body FROM orders GROUP BY 1)
SELECT name, true AS required, strlen(body) AS size, sha256(body) AS sha256, 'present' AS status FROM f
UNION ALL SELECT 'lost', true, NULL, NULL, 'required_missing' UNION ALL SELECT 'spare', false, NULL, NULL, 'optional_missing'"""
)
def package_of_files(d: Derived) -> DataFrame:
    """A file for each order status, its keys in order; the package asks for two more."""
    items = d.table("orders").select(F.col("o_orderstatus").alias("name")).distinct().withColumn("required", F.lit(True)).unionByName(d.spark.createDataFrame([("lost", True), ("spare", False)], "name string, required boolean"))
    return writers.package_manifest(items, _status_files(d)).select("name", "required", "size", "sha256", "status")


def _status_files(d: Derived) -> DataFrame:
    """The manifest (path, size, sha256) of a file for each order status; its path is the status."""
    path = scratch(d, "package")
    d.table("orders").select("o_orderstatus", "o_orderkey", F.col("o_orderkey").cast("string").alias("value")).repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey").drop("o_orderkey").write.partitionBy("o_orderstatus").text(path)
    files = writers.file_manifest(d.spark, path).filter(F.col("size") > 0)
    return files.select(F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1).alias("path"), "size", "sha256")


@query(
    """WITH f AS (SELECT o_orderstatus AS path, string_agg(cast(o_orderkey AS varchar), chr(10) ORDER BY o_orderkey) || chr(10) AS body, '{"n":' || count(*) || ',"status":"' || o_orderstatus || '"}' AS record FROM orders GROUP BY 1)
SELECT path, strlen(body) AS size, sha256(body) AS sha256, record, sha256(record) AS record_sha256 FROM f"""
)
def files_with_records(d: Derived) -> DataFrame:
    """Manifest rows with a JSON record of each file, and the record's digest."""
    counted = d.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    records = counted.select(F.col("o_orderstatus").alias("path"), F.to_json(F.struct("n", F.col("o_orderstatus").alias("status"))).alias("record"))
    return writers.embed_records(_status_files(d), records).withColumn("record_sha256", F.sha2("record", 256))


@query(with_tables("loci") + " SELECT probe_id, pos FROM loci")
def renamed_columns(d: Derived) -> DataFrame:
    """Three files that call the probe by three names."""
    names, out = ("probeID", "IlmnID", "Name"), []
    for i, name in enumerate(names):
        path = scratch(d, f"{name}.csv")
        writers.csv(d.loci.filter(F.col("part_key") % 3 == i).select(F.col("probe_id").alias(name), "pos"), path)
        df = readers.delimited(d.spark, path, f"{name} string, pos long", None, ",")
        out.append(df.select(readers.first_present(df, names).alias("probe_id"), "pos"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT 's' || s_suppkey AS sample FROM supplier")
def selected_samples(d: Derived) -> DataFrame:
    """Lists of up to 100 samples, a file each: as a JSON list, or in an object under one of four keys."""
    path = scratch(d, "samples")
    lists = d.table("supplier").groupBy(F.floor(F.col("s_suppkey") / 100).alias("list")).agg(F.collect_list(F.concat(F.lit("s"), "s_suppkey")).alias("x"))
    text = F.to_json("x")
    for i, key in enumerate(("samples", "selected_samples", "columns", "sample_columns")):
        text = F.when(F.col("list") % 5 == i, F.to_json(F.struct(F.col("x").alias(key)))).otherwise(text)
    lists.select("list", text.alias("value")).write.partitionBy("list").text(path)
    return readers.sample_list(d.spark, path)


@query("""SELECT 'region' AS "table", cast(5 AS bigint) AS wanted, count(*) AS n, count(*) = 5 AS ok FROM region UNION ALL SELECT 'nation', 25, count(*), count(*) = 25 FROM nation UNION ALL SELECT 'lineitem', 1, count(*), count(*) = 1 FROM lineitem""")
def table_counts(d: Derived) -> DataFrame:
    """Row counts that tables must have; the last one is wrong."""
    wanted = {"region": 5, "nation": 25, "lineitem": 1}
    return audit.count_contract({name: d.table(name) for name in wanted}, wanted)


@query(with_tables("in_window") + """ SELECT variant_id, probe_id AS cpg_id, way FROM in_window, (VALUES ('flag'), ('keys')) w(way) WHERE "offset" NOT IN (0, 1)""")
def variants_off_the_pair(d: Derived) -> DataFrame:
    """Variants that don't change the locus's own pair: by a flag in several spellings, and without the flag by keys."""
    k, pair = F.col("variant_id"), F.col("offset").isin(0, 1)
    rows = d.in_window.select("variant_id", F.col("probe_id").alias("cpg_id"), F.when(pair, F.when(k % 2 == 0, "TRUE").otherwise("1")).when(k % 3 == 0, " False ").when(k % 3 == 1, "0").otherwise("no").alias("on_pair"), pair.alias("hit"))
    by_flag = writers.filtered_derivative(rows, "on_pair").withColumn("way", F.lit("flag"))
    by_keys = writers.filtered_derivative(rows.drop("on_pair"), "on_pair", rows.filter(~F.col("hit"))).withColumn("way", F.lit("keys"))
    return by_flag.select("variant_id", "cpg_id", "way").unionByName(by_keys.select("variant_id", "cpg_id", "way"))
