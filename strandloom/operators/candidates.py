"""Candidates from raw variants: reference check, consequences in transcripts, the nearest probe and its window. Each variant that is lost has its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.readers import genome_slices
from . import cohort, intervals
from .settling import settle


def unique_substitutions(rows: DataFrame, chunk: int | None = None, parts: int | None = None) -> DataFrame:
    """(variant_id, chr, pos1, ref, alt, n_cases): each change of one base into another once, with the number of its different cases (case_id). Other changes and rows with a null drop.

    With `chunk` and `parts` rows are dealt by (chr, chunk) alone, with the chunk's number as `chunk_id`: they are
    shuffled once, and meet a genome in `parts` buckets of both where they are.
    """
    c = F.col
    ok = rows.filter(c("chr").isNotNull() & c("pos1").isNotNull() & c("ref").isin(*S.BASES) & c("alt").isin(*S.BASES) & (c("ref") != c("alt")))
    keys = ["chr", "pos1", "ref", "alt"]
    if chunk and parts:
        ok = ok.select(*keys, "case_id", F.floor((c("pos1") - 1) / chunk).alias("chunk_id")).repartition(parts, "chr", "chunk_id")
        keys = ["chr", "chunk_id", *keys[1:]]
    one = ok.groupBy(*keys).agg(F.countDistinct("case_id").alias("n_cases"))
    return one.select(F.concat_ws("_", "chr", c("pos1").cast("string"), "ref", "alt").alias("variant_id"), *one.columns)


def with_base(variants: DataFrame, genome: DataFrame, chunk: int, name: str = "base") -> DataFrame:
    """variants (chr, pos1, and perhaps chunk_id, which is left out) with the genome's base in capitals, from chunk rows (chrom, chunk_id, start, seq); null off the contig. The sequence is cut where it is met, so it isn't shuffled with the variants."""
    chunks = genome.select(F.col("chrom").alias("k_"), F.col("chunk_id").alias("i_"), F.col("start").alias("s_"), F.col("seq").alias("q_"))
    at = F.col("pos1") - 1
    number = F.col("chunk_id") if "chunk_id" in variants.columns else F.floor(at / chunk)
    met = variants.join(chunks, (F.col("chr") == F.col("k_")) & (number == F.col("i_")), "left")
    base = F.upper(F.substring("q_", (at - F.col("s_") + 1).cast("int"), F.lit(1)))
    return met.select(*(x for x in variants.columns if x != "chunk_id"), F.when(base != "", base).alias(name))


def transcript_models(lines: DataFrame, genome: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(segments (tx, chr, start, end, strand, before), transcripts (tx, cds, cds_length, n_segments, kind, support, tags)) of coding lines (tx, chr, start, end, strand, phase, kind, support, tags; 1-based, closed).

    Tags of all lines are united; of kinds and supports that differ the largest counts, a missing support is `NA`. Only
    protein-coding transcripts without `cds_start_NF` whose first segment has phase 0 (or none) have a model, and only
    if all their segments lie on the contig; the segments may be of some that don't. Repeated lines count once.
    Lines that are dealt by tx aren't shuffled.
    """
    c = F.col
    at = F.when(c("strand") == "-", -c("start")).otherwise(c("start"))
    seg = lines.select("tx", "chr", "start", "end", "strand", "phase", "kind", "support", "tags").withColumn("at_", at)
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags"))))
    parts = F.collect_set(F.struct("chr", "start", "end", "strand", "at_"))
    of = seg.groupBy("tx").agg(F.max("kind").alias("kind"), F.coalesce(F.max("support"), F.lit("NA")).alias("support"), tags.alias("tags"), F.min_by(F.coalesce("phase", F.lit(".")), "at_").alias("phase_"), parts.alias("parts_"))
    cut = F.exists("tags", lambda t: F.lower(t) == "cds_start_nf")
    usable = of.filter((c("kind") == "protein_coding") & ~cut & c("phase_").isin("0", ".")).drop("phase_")
    length = F.aggregate("parts_", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["end"] - x["start"] + 1, F.lit(0)))
    own = usable.select("tx", "kind", "support", "tags", length.alias("cds_length"), F.posexplode("parts_").alias("nth_", "p_")).filter("cds_length >= 3")
    own = own.select("*", "p_.*").drop("p_").withColumn("len", c("end") - c("start") + 1)
    placed = settle(cohort.segment_offsets(own, ["tx"], ["at_"]).drop("at_", "len"), "zstd")
    read = genome_slices(genome, placed.select("tx", "chr", "start", "strand", (c("start") - 1).alias("low_"), c("end").alias("high_")), chunk, "low_", "high_")
    spliced = cohort.splice(read, "tx", "start", "seq", "strand")
    told = placed.filter("nth_ = 0").select("tx", "cds_length", "kind", "support", "tags")
    whole = spliced.join(told, "tx").filter(F.length("cds") == c("cds_length")).select("tx", "cds", "n_segments", "cds_length", "kind", "support", "tags")
    return placed.select("tx", "chr", "start", "end", "strand", "before"), settle(whole, "zstd")


def synonymous_choice(variants: DataFrame, segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(variant_id, tx, codon, alt_codon, amino, n_transcripts, transcripts) of variants that some transcript reads as synonymous: the first of these by cohort.priority, and the sorted names of all."""
    hits = cohort.consequences(variants, segments, transcripts.select("tx", "cds")).filter("is_synonymous")
    rows = hits.join(transcripts.select("tx", "kind", "support", "tags", "cds_length"), "tx")
    order = cohort.priority(*(F.col(c) for c in ("tags", "kind", "support", "cds_length", "tx")))
    best = rows.groupBy("variant_id").agg(F.min_by(F.struct("tx", "codon", "alt_codon", "amino"), order).alias("b_"), F.array_sort(F.collect_set("tx")).alias("transcripts"))
    return best.select("variant_id", "b_.*", F.size("transcripts").cast("long").alias("n_transcripts"), "transcripts")


def traced(variants: DataFrame, lines: DataFrame, genome: DataFrame, chunk: int, probes: DataFrame, width: int = 5000) -> DataFrame:
    """Each of variants (unique_substitutions) with `reason`, null if it becomes a candidate, and what was found until it was lost.

    In this order: the genome has the reference base; a transcript reads the change as synonymous; there is a probe
    (probe_id, chr, pos of its C, 0-based) on the contig, whose window of `width` bases holds the variant, not on the
    pair itself, lies on the contig, is centred on CG on both strands and has the reference base.
    Columns added: base, tx, codon, alt_codon, amino, n_transcripts, transcripts, probe_id, pos, offset, index, wt, mut.
    """
    c = F.col
    middle = width // 2 - 1
    based = settle(with_base(variants, genome, chunk), "zstd")
    valid = based.filter(c("base") == c("ref"))
    chosen = synonymous_choice(valid.select("variant_id", "chr", "pos1", "ref", "alt"), *transcript_models(lines, genome, chunk))
    read = settle(valid.join(chosen, "variant_id", "left"), "zstd")
    points = read.filter("tx is not null").withColumn("v_", c("pos1") - 1)
    near = intervals.nearest(points, probes, point="v_").withColumns({"probe_id": c("near_id"), "pos": c("near_pos"), "offset": c("v_") - c("near_pos")}).drop("v_", "near_id", "near_pos", "distance")
    near = settle(near.withColumns({"low_": c("pos") - middle, "high_": c("pos") - middle + width}))
    # rows that were lost go on as they are, so that only those with a window have sequences, which are where they were cut
    has_window = F.coalesce((F.abs("offset") <= middle) & ~c("offset").isin(0, 1), F.lit(False))
    windows = genome_slices(genome, near.filter(has_window), chunk, "low_", "high_").withColumn("wt", F.upper("seq")).withColumn("index", (c("offset") + middle).cast("int"))
    windows = windows.drop("seq").withColumn("mut", S.substitute(c("wt"), c("index"), c("alt")))
    found = windows
    for lost in (near.filter(~has_window), read.filter("tx is null"), based.filter(~F.coalesce(c("base") == c("ref"), F.lit(False)))):
        found = found.unionByName(lost, allowMissingColumns=True)
    centred = lambda s: F.substring(s, middle + 1, 2) == "CG"
    reason = cohort.first_reason(
        [
            ("reference_mismatch", c("base") != c("ref")),
            ("no_synonymous_transcript", c("tx").isNull()),
            ("no_probe", c("probe_id").isNull()),
            ("outside_window", F.abs("offset") > middle),
            ("overlaps_cpg", c("offset").isin(0, 1)),
            ("out_of_bounds", c("wt").isNull()),
            ("not_cg_centred", ~centred(c("wt"))),
            ("window_reference_mismatch", F.substring("wt", c("index") + 1, F.lit(1)) != c("ref")),
            ("rc_not_cg_centred", ~centred(S.reverse_complement(c("mut")))),
        ]
    )
    made = ("tx", "codon", "alt_codon", "amino", "n_transcripts", "transcripts", "probe_id", "pos", "offset", "index", "wt", "mut")
    return found.select(*based.columns, *made, reason.alias("reason"))


def candidate_id() -> Column:
    """Of traced rows: the change, its probe and its transcript."""
    name = F.concat_ws("__", F.concat_ws("_", "chr", F.col("pos1").cast("string"), "ref", "alt"), "probe_id", F.col("tx").cast("string"))
    return F.translate(name, ".", "_")
