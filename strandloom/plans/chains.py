"""Queries of whole chains: from raw variants, coding lines, a genome and probes to the table of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assembly, candidates
from ..operators.settling import settle, settle_in
from .backgrounds import _AMINO
from .derived import Derived, h, h_sql, with_tables
from .queries import query, rounded
from .tables import _RC, _WIDE, BASE_TRACK, TRACKS, _features_sql, _filled_sql, _medians_sql, wide_sequence

CHUNK = 5000
_TAGS = ("MANE_Select", "Ensembl_canonical", "appris_principal_1", "basic", "CCDS", "cds_start_NF")


def _parts(d: Derived) -> int:
    """Buckets of the genome: 8,192 chunks (41 MB) to one where it is large."""
    return max(4 * d.spark.sparkContext.defaultParallelism, d.table("part").count() // 8192)


def _genome(d: Derived, parts: int) -> DataFrame:
    """The 5,000 bases of each locus, one behind the other on its chromosome. Written once, where they are made, in buckets of (chrom, chunk_id)."""
    k = d.loci.select(F.col("chr").alias("chrom"), F.floor(F.col("part_key") / 22).alias("chunk_id"), "part_key", "seq").repartition(parts, "chrom", "chunk_id")
    return settle_in(k.select("chrom", "chunk_id", (F.col("chunk_id") * CHUNK).alias("start"), wide_sequence().alias("seq")), parts, "chrom", "chunk_id")


def _probes(d: Derived) -> DataFrame:
    """A probe in each chunk; some are off their CG, some too near to an end."""
    k = F.col("part_key")
    return d.loci.select("probe_id", "chr", (F.floor(k / 22) * CHUNK + 2499 + F.when(k % 9 == 0, -11).when(k % 4 == 0, 7).otherwise(0)).alias("pos"), "split")


def _with_length(d: Derived, df: DataFrame, key: str) -> DataFrame:
    """df with chr and the contig's length `size_`, by a key."""
    sizes = d.loci.groupBy("chr").agg((F.count(F.lit(1)) * CHUNK).alias("size_"))
    return df.withColumn("chr", F.concat(F.lit("chr"), 1 + F.col(key) % 22)).join(F.broadcast(sizes), "chr")  # a row for each of 22


def _raw(d: Derived) -> DataFrame:
    """Each order is a place, seen as a transition of each base, so that one of four has the genome's; every third in two cases."""
    k = F.col("variant")
    at = _with_length(d, d.table("orders").select(F.col("o_orderkey").alias("variant"), F.col("o_custkey").alias("cust")), "variant")
    cases = F.explode(F.when(k % 3 == 0, F.array("cust", F.col("cust") + 1)).otherwise(F.array("cust"))).alias("case_id")
    one = at.select("chr", (1 + h(k, "raw") % F.col("size_")).alias("pos1"), cases)
    return one.select("*", F.explode(F.array(*map(F.lit, "ACGT"))).alias("ref")).withColumn("alt", F.translate("ref", "ACGT", "GTAC"))


def _lines(d: Derived) -> DataFrame:
    """Line items as coding segments of their order, 90 bases apart."""
    c = F.col
    dealt = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").repartition("l_orderkey")
    of = dealt.groupBy(c("l_orderkey").alias("tx"), c("l_linenumber").alias("nth")).agg(F.max("l_quantity").cast("long").alias("n"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    start = h(c("tx"), "tx") % c("size_") + 90 * (c("nth") - 1) + 1
    tag = F.when(c("p") % 24 == 0, _TAGS[5]).otherwise(F.array(*map(F.lit, _TAGS[:5]))[(c("p") % 5).cast("int")])
    return _with_length(d, of, "tx").select(
        "tx", "chr", start.alias("start"), (start + 2 + c("n")).alias("end"), F.when(c("tx") % 2 == 0, "+").otherwise("-").alias("strand"), F.when(c("s") % 9 == 0, "1").when(c("s") % 2 == 0, ".").otherwise("0").alias("phase"),
        F.when(c("tx") % 7 == 0, "lncRNA").otherwise("protein_coding").alias("kind"), F.when(c("tx") % 5 == 0, None).otherwise(F.concat((c("tx") % 5).cast("string"), F.lit(" (assigned)"))).alias("support"), F.array(tag).alias("tags"),
    )


def _traced(d: Derived) -> DataFrame:
    parts = _parts(d)
    return candidates.traced(candidates.unique_substitutions(_raw(d), CHUNK, parts), _lines(d), _genome(d, parts), CHUNK, _probes(d))


_CHAIN = (
    with_tables("loci", "signals")
    + _WIDE
    + f""", gen AS MATERIALIZED (SELECT chr, part_key // 22 AS q, dna_5000 || coalesce(lead(dna_5000) OVER (PARTITION BY chr ORDER BY part_key), '') AS two FROM wide),
size AS (SELECT chr, 5000 * count(*) AS n FROM loci GROUP BY 1),
probe AS MATERIALIZED (SELECT probe_id, chr, 5000 * (part_key // 22) + 2499 + CASE WHEN part_key % 9 = 0 THEN -11 WHEN part_key % 4 = 0 THEN 7 ELSE 0 END AS pos, split FROM loci),
place AS (SELECT s.chr, 1 + {h_sql("o_orderkey", "raw")} % n AS pos1, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_custkey, o_custkey + 1] ELSE [o_custkey] END) AS case_id FROM orders JOIN size s ON s.chr = 'chr' || (1 + o_orderkey % 22)),
raw AS MATERIALIZED (SELECT chr || '_' || pos1 || '_' || ref || '_' || translate(ref, 'ACGT', 'GTAC') AS variant_id, chr, pos1, ref, translate(ref, 'ACGT', 'GTAC') AS alt, count(DISTINCT case_id) AS n_cases FROM place, (VALUES ('A'), ('C'), ('G'), ('T')) r(ref) GROUP BY ALL),
based AS MATERIALIZED (SELECT raw.*, substr(two, (pos1 - 1) % 5000 + 1, 1) AS base FROM raw JOIN gen ON gen.chr = raw.chr AND q = (pos1 - 1) // 5000),
item AS (SELECT l_orderkey AS tx, l_linenumber AS nth, cast(max(l_quantity) AS bigint) AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
line AS MATERIALIZED (SELECT tx, s0.chr, {h_sql("tx", "tx")} % s0.n + 90 * (nth - 1) + 1 AS a, item.n + 3 AS len, tx % 2 = 1 AS minus, CASE WHEN s % 9 = 0 THEN '1' ELSE '0' END AS phase, CASE WHEN p % 24 = 0 THEN 'cds_start_NF' ELSE (['MANE_Select', 'Ensembl_canonical', 'appris_principal_1', 'basic', 'CCDS'])[p % 5 + 1] END AS tag,
  CASE WHEN tx % 5 = 0 THEN 99 ELSE tx % 5 END AS tsl FROM item JOIN size s0 ON s0.chr = 'chr' || (1 + tx % 22) WHERE tx % 7 <> 0),
cut AS (SELECT line.*, substr(two, (a - 1) % 5000 + 1, len) AS seq FROM line LEFT JOIN gen ON gen.chr = line.chr AND q = (a - 1) // 5000),
model AS MATERIALIZED (SELECT tx, string_agg(CASE WHEN minus THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, '' ORDER BY CASE WHEN minus THEN -a ELSE a END) AS cds, sum(len) AS cds_length, list(tag) AS tags FROM cut GROUP BY 1
  HAVING NOT list_contains(list(tag), 'cds_start_NF') AND arg_min(phase, CASE WHEN minus THEN -a ELSE a END) = '0' AND bool_and(coalesce(length(seq) = len, false))),
seg AS (SELECT tx, chr, a, len, minus, tsl, coalesce(sum(len) OVER (PARTITION BY tx ORDER BY CASE WHEN minus THEN -a ELSE a END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM line),
hit AS (SELECT b.variant_id, seg.tx, cds, cds_length, tags, tsl, cast(before + CASE WHEN minus THEN a + len - 1 - pos1 ELSE pos1 - a END AS bigint) AS off, CASE WHEN minus THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS r, CASE WHEN minus THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS x
  FROM based b JOIN seg ON seg.chr = b.chr AND pos1 BETWEEN a AND a + len - 1 JOIN model USING (tx) WHERE base = ref),
codons AS (SELECT *, substr(cds, off // 3 * 3 + 1, 3) AS codon, substr(cds, off // 3 * 3 + 1, off % 3) || x || substr(cds, off + 2, 2 - off % 3) AS alt_codon FROM hit),
syn AS (SELECT *, {_AMINO.format("codon")} AS amino FROM codons WHERE length(codon) = 3 AND substr(cds, off + 1, 1) = r AND {_AMINO.format("codon")} = {_AMINO.format("alt_codon")}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY variant_id) AS n_transcripts, row_number() OVER (PARTITION BY variant_id ORDER BY CASE WHEN list_contains(tags, 'MANE_Select') THEN 0 ELSE 1 END, CASE WHEN list_contains(tags, 'Ensembl_canonical') THEN 0 ELSE 1 END, CASE WHEN list_contains(tags, 'appris_principal_1') THEN 0 ELSE 1 END,
  CASE WHEN list_contains(tags, 'basic') THEN 0 ELSE 1 END, tsl, -cds_length, tx) AS nth FROM syn),
chosen AS MATERIALIZED (SELECT variant_id, tx, codon, alt_codon, amino, n_transcripts FROM ranked WHERE nth = 1),
far AS (SELECT variant_id, probe_id, p.pos, pos1 - 1 - p.pos AS "offset", row_number() OVER (PARTITION BY variant_id ORDER BY abs(pos1 - 1 - p.pos), p.pos) AS nth FROM chosen JOIN based USING (variant_id) JOIN probe p USING (chr)),
near AS MATERIALIZED (SELECT * EXCLUDE (nth) FROM far WHERE nth = 1),
seen AS MATERIALIZED (SELECT based.*, tx, codon, alt_codon, amino, n_transcripts, probe_id, pos, "offset", cast("offset" + 2499 AS int) AS index, CASE WHEN pos >= 2499 THEN nullif(substr(two, (pos - 2499) % 5000 + 1, 5000), '') END AS wt
  FROM based LEFT JOIN chosen USING (variant_id) LEFT JOIN near USING (variant_id) LEFT JOIN gen ON gen.chr = based.chr AND q = (pos - 2499) // 5000),
changed AS (SELECT *, substr(wt, 1, index) || alt || substr(wt, index + 2) AS mut FROM seen),
traced AS MATERIALIZED (SELECT *, CASE WHEN base <> ref THEN 'reference_mismatch' WHEN tx IS NULL THEN 'no_synonymous_transcript' WHEN probe_id IS NULL THEN 'no_probe' WHEN abs("offset") > 2499 THEN 'outside_window' WHEN "offset" IN (0, 1) THEN 'overlaps_cpg' WHEN length(wt) IS DISTINCT FROM 5000 THEN 'out_of_bounds'
  WHEN substr(wt, 2500, 2) <> 'CG' THEN 'not_cg_centred' WHEN substr(wt, index + 1, 1) <> ref THEN 'window_reference_mismatch' WHEN substr(reverse(translate(mut, 'ACGT', 'TGCA')), 2500, 2) <> 'CG' THEN 'rc_not_cg_centred' END AS reason FROM changed)"""
)


@query(_CHAIN + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM traced GROUP BY 1")
def candidate_losses(d: Derived) -> DataFrame:
    """How many raw variants each step of the chain loses, and how many are left."""
    return _traced(d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_CONTEXT = """, kept AS MATERIALIZED (SELECT * EXCLUDE (reason) FROM traced WHERE reason IS NULL),
t0 AS (SELECT *, CASE WHEN index <= 0 OR index >= 4999 THEN 'NNN' ELSE substr(wt, cast(index AS bigint), 3) END AS tri,
  index - 1 >= 0 AND substr(wt, cast(index AS bigint), 2) = 'CG' AS w1, index < 4999 AND substr(wt, cast(index + 1 AS bigint), 2) = 'CG' AS w2, index - 1 >= 0 AND substr(mut, cast(index AS bigint), 2) = 'CG' AS m1, index < 4999 AND substr(mut, cast(index + 1 AS bigint), 2) = 'CG' AS m2 FROM kept),
t1 AS (SELECT *, CASE WHEN tri = 'NNN' THEN tri WHEN ref IN ('A', 'G') THEN reverse(translate(tri, 'ACGT', 'TGCA')) ELSE tri END AS ctri,
  CASE WHEN ref IN ('A', 'G') AND tri <> 'NNN' THEN translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END AS sbs6 FROM t0),
t2 AS (SELECT *, CASE WHEN tri = 'NNN' THEN 'N[' || ref || '>' || alt || ']N' ELSE substr(ctri, 1, 1) || '[' || sbs6 || ']' || substr(ctri, 3, 1) END AS sbs96,
  CASE WHEN ((m1 AND NOT w1) OR (m2 AND NOT w2)) AND ((w1 AND NOT m1) OR (w2 AND NOT m2)) THEN 'both_created_and_destroyed' WHEN (m1 AND NOT w1) OR (m2 AND NOT w2) THEN 'created' WHEN (w1 AND NOT m1) OR (w2 AND NOT m2) THEN 'destroyed' ELSE 'unchanged' END AS cpg_effect FROM t1)"""
_SEQS = ("wt", "mut", "wt_100", "mut_100")


@query(
    _CHAIN
    + _CONTEXT
    + _features_sql("probe")
    + ", fl AS MATERIALIZED (SELECT fv.*, split FROM fv JOIN probe USING (probe_id)), "
    + _medians_sql("fl")
    + ", x AS MATERIALIZED (SELECT t2.*, substr(wt, 2451, 100) AS wt_100, substr(mut, 2451, 100) AS mut_100, probe.split, fv.* EXCLUDE (probe_id) FROM t2 JOIN probe USING (probe_id) JOIN fv USING (probe_id))"
    + """ SELECT variant_id || '__' || probe_id || '__' || tx AS candidate_id, chr, pos1, ref, alt, n_cases, tx, codon, alt_codon, amino, n_transcripts, probe_id, pos, split, "offset", index, tri, sbs6, sbs96, 'transition' AS titv, cpg_effect, """
    + ", ".join([*_SEQS, *(f"{_RC.format(s)} AS {s}_RC" for s in _SEQS)])
    + f", {_filled_sql('x')} FROM x, med"
)
def candidates_from_raw(d: Derived) -> DataFrame:
    """Raw variants that pass every step, with the transcript chosen, both windows on both strands, context and features of the locus."""
    kept = _traced(d).filter("reason is null").drop("reason", "base", "transcripts", "mut")
    loci = settle(assembly.signal_features(_probes(d), d.signals, BASE_TRACK, TRACKS).join(_probes(d).select("probe_id", "split"), "probe_id"))
    made = {"mut": S.substitute(F.col("wt"), F.col("index"), F.col("alt"))} | {f"{s}_100": F.substring(s, 2451, 100) for s in ("wt", "mut")}
    full = assembly.described(kept, d.signals, BASE_TRACK, TRACKS, loci, _SEQS, loci, made)
    return rounded(full.select(candidates.candidate_id().alias("candidate_id"), *(c for c in full.columns if c != "variant_id")))
