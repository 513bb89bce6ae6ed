import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandloom.functions import scalars as S
from strandloom.sources import readers, writers


def test_delimited_and_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("IlmnID\tvalue\textra\ncg1\t0.5\tx\ncg2\tNaN\ty\ncg3\t\tz\n")
    df = readers.delimited(spark, str(tmp_path / "a.tsv"), "IlmnID string, value double, extra string", ["IlmnID", "value"])
    assert [tuple(r) for r in df.orderBy("IlmnID").collect()] == [("cg1", 0.5), ("cg2", None), ("cg3", None)]
    assert df.select(readers.first_present(df, ("probeID", "IlmnID", "Name")).alias("id")).count() == 3
    with pytest.raises(ValueError):
        readers.first_present(df, ("nothing",))


def test_wide_matrix(spark):
    df = spark.createDataFrame([("cg1", 0.1, float("nan"), 0.9), ("cg2", None, 0.4, 0.8)], ["probe", "TCGA-A1-0001-11A", "tcga.A1.0002.11B", "TCGA-A1-0003-01A"])
    cols = readers.sample_columns(df)
    assert cols == ["TCGA-A1-0001-11A", "tcga.A1.0002.11B"]
    got = {(r.probe_id, r.sample_id): r.beta for r in readers.long_matrix(df, "probe", cols).collect()}
    assert got == {("cg1", "TCGA-A1-0001-11A"): 0.1, ("cg2", "tcga.A1.0002.11B"): 0.4}


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(
        "#comment\n1\tH\ttranscript\t10\t90\t.\t-\t.\tgene_id \"G1\"; transcript_id \"T1\"; tag \"basic\"; tag \"MANE_Select\"; bare\nshort\tline\nchr2\tH\tCDS\t5\t7\t.\t+\t2\tnote \"a b\";\n"
    )
    rows = readers.gtf(spark, str(tmp_path / "a.gtf")).orderBy("chr").collect()
    assert [(r.chr, r.feature, r.start, r.end, r.strand) for r in rows] == [("chr1", "transcript", 10, 90, "-"), ("chr2", "CDS", 5, 7, "+")]
    assert rows[0].attributes == {"gene_id": ["G1"], "transcript_id": ["T1"], "tag": ["basic", "MANE_Select"]} and rows[1].attributes == {"note": ["a b"]}
    df = readers.gtf(spark, str(tmp_path / "a.gtf"))
    assert {r[0] for r in df.select(readers.first_attribute("transcript_id", "none")).collect()} == {"T1", "none"}


def test_fasta_round_trip_and_slices(spark, tmp_path):
    seqs = {"chr1": "acgtn" * 47, "chr2": "GGCA" * 5}
    text, index, at = "", "", 0
    for name, s in seqs.items():
        head = f">{name}\n"
        lines = [s[i : i + 60] for i in range(0, len(s), 60)]
        index += f"{name}\t{len(s)}\t{at + len(head)}\t60\t61\n"
        block = head + "\n".join(lines) + "\n"
        text, at = text + block, at + len(block)
    (tmp_path / "g.fa").write_text(text)
    (tmp_path / "g.fa.fai").write_text(index)
    genome = readers.fasta(spark, str(tmp_path / "g.fa"), 50, 2)
    assert genome.rdd.getNumPartitions() == 3  # five chunks and one, in twos
    whole = {}
    for r in sorted(genome.collect(), key=lambda r: (r.chrom, r.chunk_id)):
        whole[r.chrom] = whole.get(r.chrom, "") + r.seq
    assert whole == {k: v.upper() for k, v in seqs.items()}
    wanted = spark.createDataFrame([("chr1", 0, 5), ("chr1", 45, 160), ("chr2", 10, 30), ("chr2", -1, 3), ("chr2", 3, 20)], "chr string, low long, high long")
    got = {(r.chr, r.low, r.high): r.seq for r in readers.genome_slices(genome, wanted, 50).collect()}
    assert got == {(c, a, z): (seqs[c].upper()[a:z] if a >= 0 and z <= len(seqs[c]) else None) for c, a, z in [("chr1", 0, 5), ("chr1", 45, 160), ("chr2", 10, 30), ("chr2", -1, 3), ("chr2", 3, 20)]}


def test_fasta_regions_choose_the_ranges_that_are_read(spark, tmp_path):
    seqs = {f"c{i}": "acgtn" * (i * 3) for i in range(7)}  # c0 is empty
    df = spark.createDataFrame(list(seqs.items()), "name string, seq string").repartition(3, "name")
    folder = str(tmp_path / "contigs")
    writers.indexed_fasta(df, folder, "name", "seq", 7)
    rows = [(c, i, 10 * i, s.upper()[10 * i : 10 * i + 10]) for c, s in seqs.items() for i in range(-(-len(s) // 10))]
    for regions in (None, [], [("c3", 0, None)], [("c5", 11, 12), ("c6", 35, 51)], [("c5", 5, 31), ("c5", 8, 12), ("c5", 39, 40), ("c5", -4, 3)], [("c0", 0, None), ("none", 0, 9), ("c1", 15, 99), ("c1", 7, 7)], [("c6", 88, 1000)], [(None, 12, 25), ("c4", 50, 51)]):
        hit = lambda c, i: regions is None or any(k in (None, c) and max(a, 10 * i) < min(len(seqs[c]) if z is None else z, 10 * i + 10, len(seqs[c])) for k, a, z in regions)  # noqa: B023, E731
        assert sorted(map(tuple, readers.fasta(spark, folder, 10, 4, regions).collect())) == [r for r in rows if hit(*r[:2])], regions
    assert readers.fasta(spark, folder, 10, 4, [("c3", 0, None)]).rdd.getNumPartitions() == 2 and readers.fasta(spark, folder, 10, 4, [("c6", 3, 33)]).rdd.getNumPartitions() == 1
    genome = readers.fasta(spark, folder, 10, 4)  # filters of one plan don't reach another
    assert genome.filter("chrom = 'c3'").union(genome.filter("chrom = 'c4'")).groupBy("chrom").count().count() == 2 and genome.count() == len(rows)
    one = sorted((tmp_path / "contigs").glob("*.fa"))[0]
    assert readers.fasta(spark, str(one), 10, 4).count() > 0
    writers.indexed_fasta(df.limit(0), str(tmp_path / "none"), "name", "seq")
    assert readers.fasta(spark, str(tmp_path / "none")).count() == 0


def test_variant_documents(spark, tmp_path):
    hits = [
        {"ssm_id": "s1", "genomic_dna_change": "chr1:g.5C>T", "chromosome": "chr1", "start_position": 5, "reference_allele": "C", "tumor_allele": "T", "occurrence": [{"case": {"case_id": "c2", "id": None, "submitter_id": "b"}}, {"case": {"case_id": None, "id": "c1", "submitter_id": "a"}}]},
        {"ssm_id": "s2", "genomic_dna_change": "x", "chromosome": "1", "start_position": 5, "reference_allele": "C", "tumor_allele": "T", "occurrence": []},
        {"ssm_id": "s3", "genomic_dna_change": "chr1:g.9del", "chromosome": "1", "start_position": 9, "reference_allele": "CA", "tumor_allele": "C", "occurrence": []},
    ]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, hits)))
    schema = "ssm_id string, genomic_dna_change string, chromosome string, start_position long, reference_allele string, tumor_allele string, occurrence array<struct<case:struct<case_id:string,id:string,submitter_id:string>>>"
    rows = readers.variant_hits(spark.read.schema(schema).json(str(tmp_path / "h.json"))).collect()
    assert [(r.chr, r.pos1, r.ref, r.alt, r.ssm_ids, r.case_ids, r.submitter_ids) for r in rows] == [("chr1", 5, "C", "T", ["s1", "s2"], ["c1", "c2"], ["a", "b"])]


def test_spdi_placements_and_seeds(spark):
    acc = spark.createDataFrame([("NC_1", "chr1")], "accession string, chr string")
    rec = spark.createDataFrame([("r1", [("NC_1:4:C:T",), ("NC_1:4:CA:T",), (None,)]), ("r2", [("NC_9:4:C:T",)])], "record_id string, variation_set array<struct<canonical_spdi:string>>")
    assert [tuple(r) for r in readers.spdi_variants(rec, acc).collect()] == [("r1", "chr1", 5, "C", "T")]
    alleles = [(9, "G", "G"), (9, "G", "A"), (9, "G", "T")]
    p = spark.createDataFrame([("rs1", [("NC_1", True, False, alleles), ("NC_1", False, False, alleles)])], "rsid string, placements array<struct<seq_id:string,is_ptlp:boolean,refseq_chromosome:boolean,alleles:array<struct<position:long,deleted:string,inserted:string>>>>")
    found = readers.placements(p, acc)
    assert {tuple(r) for r in found.collect()} == {("rs1", "chr1", 10, "G", "A"), ("rs1", "chr1", 10, "G", "T")}
    seeds = spark.createDataFrame([("rs1", "T"), ("rs2", None)], "rsid string, expected_alt string")
    rows, audit = readers.resolve_seeds(seeds, found)
    assert [r.alt for r in rows.collect()] == ["T"]
    assert {tuple(r) for r in audit.collect()} == {("resolved", 1), ("other_allele", 1), ("unresolved", 1)}
    _, audit = readers.resolve_seeds(seeds.withColumn("expected_alt", F.lit(None).cast("string")), found)
    assert {tuple(r) for r in audit.collect()} == {("ambiguous", 2), ("unresolved", 1)}


def test_sample_lists_links_and_predictions(spark, tmp_path):
    for i, text in enumerate(('["a", "b"]', '{"selected_samples": ["a", "b"]}')):
        (tmp_path / f"{i}.json").write_text(text)
        assert sorted(r[0] for r in readers.sample_list(spark, str(tmp_path / f"{i}.json")).collect()) == ["a", "b"]
    xml = "<r><LinkSet><LinkSetDb><Link><Id>7</Id></Link><Link><Id>7</Id></Link><Link><Id>9</Id></Link></LinkSetDb></LinkSet></r>"
    docs = spark.createDataFrame([("x", xml)], "record_id string, xml string")
    assert sorted(r.publication_id for r in readers.publication_links(docs).collect()) == ["7", "9"]
    df = spark.createDataFrame([("cg1", 0.1, 0.2, 42, "fusion"), ("cg1", 0.1, 0.3, 43, "fusion")], "probe_id string, truth double, pred double, seed int, model string")
    df.write.partitionBy("seed", "model").parquet(str(tmp_path / "p"))
    got = readers.predictions(spark, str(tmp_path / "p"))
    assert got.count() == 2 and readers.duplicates(got, ["probe_id", "seed", "model"]).count() == 0 and readers.duplicates(got, ["probe_id"]).count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("cg2", "chr10", 5, "val", "ACGT", float("nan")), ("cg1", "chr2", 7, "train", "CCGG", 1.5)], "probe_id string, chr string, pos long, split string, seq string, v double")
    writers.fasta(df, str(tmp_path / "fa"), "probe_id", "seq", 4)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "fa")).collect()) == [">cg1", ">cg2", "ACGT", "CCGG"]
    with pytest.raises(Exception, match="wrong length"):
        writers.fasta(df, str(tmp_path / "fb"), "probe_id", "seq", 5)
    writers.json_summary(df, str(tmp_path / "j"))
    assert {json.loads(r[0])["v"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {None, 1.5}
    writers.by_split(df, str(tmp_path / "s"))
    assert {r.split for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"train", "val"}
    writers.csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.txt").write_text("abc")
    (tmp_path / "n").mkdir()
    big, odd = tmp_path / "n/a b%20.bin", tmp_path / "n/empty.gz"
    big.write_bytes(bytes(range(251)) * 20_000)
    odd.write_bytes(b"")
    found = {r["path"].rpartition("/")[2]: (r["size"], r.sha256) for r in writers.file_manifest(spark, str(tmp_path / "n")).collect()}
    assert found == {f.name: (f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in (big,)}
    files = writers.file_manifest(spark, str(tmp_path / "m"))
    row = files.first()
    assert (row["size"], row.sha256) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    items = spark.createDataFrame([("x.txt", True), ("y.txt", True), ("z.txt", False)], "name string, required boolean")
    assert {r.name: r.status for r in writers.package_manifest(items, files).collect()} == {"x.txt": "present", "y.txt": "required_missing", "z.txt": "optional_missing"}
    hashes = df.select(writers.record_hash(df, ["pos", "chr"]).alias("a")), df.select(writers.record_hash(df, ["chr", "pos"]).alias("a"))
    assert hashes[0].collect() == hashes[1].collect()
    assert writers.embed_records(files, spark.createDataFrame([(row.path, "{}")], "path string, record string")).first().record == "{}"


def test_filtered_derivative(spark):
    df = spark.createDataFrame([("v1", "c1", " False "), ("v2", "c2", "true")], "variant_id string, cpg_id string, overlaps string")
    assert [r.variant_id for r in writers.filtered_derivative(df, "overlaps").collect()] == ["v1"]
    assert [r.variant_id for r in writers.filtered_derivative(df, "other", df.filter("variant_id = 'v2'")).collect()] == ["v2"]


def test_booleans(spark):
    df = spark.createDataFrame([(" Yes ",), ("0",), ("T",)], "x string")
    assert [r[0] for r in df.select(S.to_boolean(F.col("x"))).collect()] == [True, False, True]
    blank = spark.createDataFrame([(None,), ("",)], "x string")
    assert [r[0] for r in blank.select(S.to_boolean(F.col("x"), "blank_is_false")).collect()] == [False, False]
    for bad in (blank, spark.createDataFrame([("maybe",)], "x string")):
        with pytest.raises(Exception, match="not a boolean"):
            bad.select(S.to_boolean(F.col("x"), "strict")).collect()
