"""Registered queries over the given tables, each with its SQL for the check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, checked, cohort, intervals, matching, metrics, ml, ranks, resample
from .derived import Derived, h, h_sql, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Added before rounding in both engines, so that sums taken in another order don't fall on two sides of a tie.
NUDGE = 3.7e-10


def query(sql: str | None = None):
    """Register a function of the derived tables."""

    def add(f: Callable[[Derived], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace(", 6)", f" + {NUDGE!r}, 6)")
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, 6)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c) + NUDGE, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Locus table -----------------------------------------------------------------


@query(
    with_tables("loci", "normals")
    + """, med AS (SELECT part_key, count(beta) AS n_observed, median(beta) AS beta FROM normals GROUP BY 1),
t AS (SELECT l.*, n_observed, beta, log2(least(greatest(beta, 0.0001), 0.9999) / (1 - least(greatest(beta, 0.0001), 0.9999))) AS m_value FROM loci l JOIN med USING (part_key))
SELECT split, count(*) AS n_rows, count(DISTINCT chr) AS n_chr, string_agg(DISTINCT chr, ',' ORDER BY chr) AS chromosomes, round(avg(beta), 6) AS mean_beta, round(avg(m_value), 6) AS mean_m,
       round(avg(CASE WHEN beta > 0.5 THEN 1.0::double ELSE 0 END), 6) AS methylated_fraction, cast(sum(n_observed) AS bigint) AS n_observed FROM t GROUP BY 1"""
)
def locus_split_summary(d: Derived) -> DataFrame:
    med = metrics.probe_medians(d.normals)
    t = d.loci.join(med, "part_key")
    extra = t.groupBy("split").agg(r6(F.avg("m_value")).alias("mean_m"), F.sum("n_observed").alias("n_observed"))
    return rounded(metrics.split_summary(t)).join(extra, "split").select("split", "n_rows", "n_chr", "chromosomes", "mean_beta", "mean_m", "methylated_fraction", "n_observed")


@query(with_tables("normals") + " SELECT part_key, count(beta) AS n_observed, round(median(beta), 6) AS beta, CASE WHEN median(beta) > 0.5 THEN 1 ELSE 0 END AS binary_state FROM normals GROUP BY 1")
def median_over_samples(d: Derived) -> DataFrame:
    return rounded(metrics.probe_medians(d.normals)).select("part_key", "n_observed", "beta", "binary_state")


@query(with_tables("normals") + ", p AS (SELECT part_key, participant, median(beta) AS b FROM normals GROUP BY 1, 2) SELECT part_key, round(median(b), 6) AS beta FROM p GROUP BY 1")
def median_of_participants(d: Derived) -> DataFrame:
    return rounded(metrics.participant_medians(d.normals))


@query(
    with_tables("normals")
    + """, a AS (SELECT part_key, median(beta) AS x FROM normals GROUP BY 1), p AS (SELECT part_key, participant, median(beta) AS b FROM normals GROUP BY 1, 2),
b AS (SELECT part_key, median(b) AS y FROM p GROUP BY 1), dd AS (SELECT abs(x - y) AS e FROM a JOIN b USING (part_key))
SELECT round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95, round(quantile_cont(e, 0.99), 6) AS p99, round(max(e), 6) AS max,
round(avg(CASE WHEN e > 0.01 THEN 1.0::double ELSE 0 END), 6) AS over_0_01, round(avg(CASE WHEN e > 0.05 THEN 1.0::double ELSE 0 END), 6) AS over_0_05 FROM dd"""
)
def participant_sensitivity(d: Derived) -> DataFrame:
    j = metrics.probe_medians(d.normals).select("part_key", F.col("beta").alias("x")).join(metrics.participant_medians(d.normals).withColumnRenamed("beta", "y"), "part_key")
    return rounded(metrics.difference_distribution(j, F.col("x") - F.col("y")))


@query(with_tables("normals") + ", n AS (SELECT participant, count(*) AS c FROM (SELECT DISTINCT participant, sample_id FROM normals) GROUP BY 1) SELECT count(*) AS n_entities, min(c) AS low, max(c) AS high, round(avg(c), 6) AS mean, cast(median(c) AS double) AS median, count(*) FILTER (c > 1) AS n_multiple FROM n")
def samples_per_participant(d: Derived) -> DataFrame:
    return rounded(metrics.multiplicity(d.normals.select("participant", "sample_id").distinct(), "participant"))


@query(
    with_tables("loci", "signals")
    + """, w AS (SELECT probe_id, chr, greatest(pos - 2000, 0) AS a, least(pos + 2000, 1000000) AS z FROM loci)
SELECT probe_id, round(sum(value * (least(z, "end") - greatest(a, "start"))) / sum(CASE WHEN value IS NULL THEN NULL ELSE least(z, "end") - greatest(a, "start") END), 6) AS mean_signal
FROM w LEFT JOIN signals s ON s.chr = w.chr AND s."start" < z AND s."end" > a AND value IS NOT NULL GROUP BY 1"""
)
def interval_mean_signal(d: Derived) -> DataFrame:
    w = d.loci.select("probe_id", "chr", (F.col("pos") - 2000).alias("start"), (F.col("pos") + 2000).alias("end"))
    return intervals.interval_mean(w, d.signals, id_col="probe_id", contig_length=F.lit(1_000_000)).select("probe_id", r6("mean").alias("mean_signal"))


_OTHER_NAMES = """, named AS (SELECT CASE WHEN cast(substr(chr, 4) AS int) % 3 = 0 OR (chr = 'chr7' AND event_id % 2 = 0) THEN substr(chr, 4) ELSE chr END AS name, "start", "end", value FROM signals WHERE chr NOT IN ('chr5', 'chr10')),
asked AS (SELECT probe_id, CASE WHEN part_key % 2 = 0 THEN chr ELSE substr(chr, 4) END AS chr, greatest(pos - 2000, 0) AS a, pos + 2000 AS z FROM loci),
there AS (SELECT DISTINCT name FROM named), w AS (SELECT probe_id, CASE WHEN chr IN (SELECT name FROM there) THEN chr WHEN starts_with(chr, 'chr') THEN substr(chr, 4) ELSE 'chr' || chr END AS name, a, z FROM asked)"""


@query(
    with_tables("loci", "signals")
    + _OTHER_NAMES
    + """ SELECT probe_id, round(sum(value * (least(z, "end") - greatest(a, "start"))) / sum(least(z, "end") - greatest(a, "start")), 6) AS mean_signal FROM w LEFT JOIN named s ON s.name = w.name AND s."start" < z AND s."end" > a AND value IS NOT NULL GROUP BY 1"""
)
def interval_mean_other_names(d: Derived) -> DataFrame:
    """Loci and signals spell some contigs differently; one is spelled both ways in the signals, two are not there."""
    c, bare = F.col("chr"), F.substring("chr", 4, 9)
    both = (c == "chr7") & (F.col("event_id") % 2 == 0)
    track = d.signals.filter(~c.isin("chr5", "chr10")).withColumn("chr", F.when((bare.cast("int") % 3 == 0) | both, bare).otherwise(c))
    w = d.loci.select("probe_id", F.when(F.col("part_key") % 2 == 0, c).otherwise(bare).alias("chr"), (F.col("pos") - 2000).alias("start"), (F.col("pos") + 2000).alias("end"))
    return intervals.interval_mean(intervals.named_as(w, track), track, id_col="probe_id").select("probe_id", r6("mean").alias("mean_signal"))


_SIGNAL_SQL = (
    with_tables("loci", "signals")
    + """, w AS (SELECT probe_id, split, chr, greatest(pos - 2000, 0) AS a, pos + 2000 AS z FROM loci),
x AS (SELECT probe_id, split, sum(value * (least(z, "end") - greatest(a, "start"))) / sum(least(z, "end") - greatest(a, "start")) AS v
      FROM w LEFT JOIN signals s ON s.chr = w.chr AND s."start" < z AND s."end" > a AND value IS NOT NULL GROUP BY 1, 2)"""
)


@query(_SIGNAL_SQL + ", m AS (SELECT median(v) AS m FROM x WHERE split = 'train') SELECT probe_id, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS signal_Missing, round(coalesce(v, m, 0), 6) AS signal FROM x, m")
def train_only_imputation(d: Derived) -> DataFrame:
    w = d.loci.select("probe_id", "chr", (F.col("pos") - 2000).alias("start"), (F.col("pos") + 2000).alias("end"))
    x = intervals.interval_mean(w, d.signals, id_col="probe_id").join(d.loci.select("probe_id", "split"), "probe_id").withColumnRenamed("mean", "signal")
    return metrics.impute(x, ["signal"], F.col("split") == "train").select("probe_id", "signal_Missing", r6("signal").alias("signal"))


@query(
    _SIGNAL_SQL
    + """, k AS (SELECT probe_id, v, (rank() OVER (PARTITION BY v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::double) / count(*) OVER (PARTITION BY v IS NULL) AS p FROM x)
SELECT probe_id, CASE WHEN v IS NULL THEN 'Missing' WHEN p <= 0.25 THEN 'Q1' WHEN p <= 0.5 THEN 'Q2' WHEN p <= 0.75 THEN 'Q3' ELSE 'Q4' END AS stratum FROM k"""
)
def signal_quartiles(d: Derived) -> DataFrame:
    w = d.loci.select("probe_id", "chr", (F.col("pos") - 2000).alias("start"), (F.col("pos") + 2000).alias("end"))
    x = intervals.interval_mean(w, d.signals, id_col="probe_id")
    return ranks.quartile_strata(x, "mean").select("probe_id", "stratum")


@query(
    with_tables("loci")
    + """, r AS (SELECT probe_id, CASE WHEN pos - 50 < 0 OR pos + 50 > 990000 THEN 'out_of_bounds' WHEN substr(seq, 50, 2) <> 'CG' THEN 'not_cg_centred' ELSE 'kept' END AS reason FROM loci) SELECT reason, count(*) AS n FROM r GROUP BY 1"""
)
def window_funnel(d: Derived) -> DataFrame:
    reason = cohort.window_reason(F.lit(990_000), F.col("pos") - 50, F.col("pos") + 50, F.col("seq"))
    return cohort.funnel(d.loci.withColumn("reason", reason))


@query(with_tables("loci") + " SELECT probe_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, substr(seq, 26, 50) AS crop, substr(reverse(translate(seq, 'ACGT', 'TGCA')), 50, 2) AS rc_centre, sha256(seq) AS seq_sha256 FROM loci")
def sequence_views(d: Derived) -> DataFrame:
    rc = S.reverse_complement(F.col("seq"))
    return d.loci.select("probe_id", rc.alias("rc"), S.centered_crop(F.col("seq"), 50).alias("crop"), F.substring(rc, 50, 2).alias("rc_centre"), F.sha2("seq", 256).alias("seq_sha256"))


# Variants --------------------------------------------------------------------

_COMP = "translate({}, 'ACGT', 'TGCA')"
_CONTEXT = (
    with_tables("in_window")
    + """, v AS (SELECT *, cast("offset" + 49 AS bigint) AS i FROM in_window), t AS (SELECT *, CASE WHEN i <= 0 OR i >= 99 THEN 'NNN' ELSE substr(wt, i, 3) END AS tri,
  i - 1 >= 0 AND substr(wt, i, 2) = 'CG' AS w1, i < 99 AND substr(wt, i + 1, 2) = 'CG' AS w2, i - 1 >= 0 AND substr(mut, i, 2) = 'CG' AS m1, i < 99 AND substr(mut, i + 1, 2) = 'CG' AS m2 FROM v),
c AS (SELECT *, CASE WHEN tri = 'NNN' THEN tri WHEN ref IN ('A', 'G') THEN reverse(translate(tri, 'ACGT', 'TGCA')) ELSE tri END AS ctri,
  CASE WHEN ref IN ('A', 'G') AND tri <> 'NNN' THEN translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END AS sbs6 FROM t),
a AS (SELECT variant_id, part_key, chr, pos, "offset", split, i, ref, alt, tri, sbs6, CASE WHEN tri = 'NNN' THEN 'N[' || ref || '>' || alt || ']N' ELSE substr(ctri, 1, 1) || '[' || sbs6 || ']' || substr(ctri, 3, 1) END AS sbs96,
  CASE WHEN least(ref, alt) || greatest(ref, alt) IN ('AG', 'CT') THEN 'transition' ELSE 'transversion' END AS titv,
  CASE WHEN ((m1 AND NOT w1) OR (m2 AND NOT w2)) AND ((w1 AND NOT m1) OR (w2 AND NOT m2)) THEN 'both_created_and_destroyed' WHEN (m1 AND NOT w1) OR (m2 AND NOT w2) THEN 'created' WHEN (w1 AND NOT m1) OR (w2 AND NOT m2) THEN 'destroyed' ELSE 'unchanged' END AS cpg_effect FROM c)"""
)


def _annotated(d: Derived) -> DataFrame:
    return cohort.annotate_change(d.in_window.withColumn("index", F.col("offset") + 49))


@query(_CONTEXT + " SELECT variant_id, tri, sbs6, sbs96, titv, cpg_effect FROM a")
def variant_context(d: Derived) -> DataFrame:
    return _annotated(d).select("variant_id", "tri", "sbs6", "sbs96", "titv", "cpg_effect")


@query(with_tables("in_window") + """ SELECT variant_id, cast("offset" + 49 AS bigint) AS index, ref, alt FROM in_window""")
def single_differences(d: Derived) -> DataFrame:
    x = S.single_difference(F.col("wt"), F.col("mut"))
    return d.in_window.select("variant_id", x.alias("x")).select("variant_id", F.col("x.index").cast("long").alias("index"), "x.ref", "x.alt")


@query(
    with_tables("in_window")
    + """, r AS (SELECT CASE WHEN NOT "offset" BETWEEN -49 AND 50 THEN 'outside_window' WHEN "offset" IN (0, 1) THEN 'overlaps_cpg' WHEN substr(reverse(translate(mut, 'ACGT', 'TGCA')), 50, 2) <> 'CG' THEN 'rc_not_cg_centred' ELSE 'kept' END AS reason FROM in_window) SELECT reason, count(*) AS n FROM r GROUP BY 1"""
)
def candidate_funnel(d: Derived) -> DataFrame:
    return cohort.funnel(d.in_window.withColumn("reason", cohort.candidate_reason()))


@query(
    with_tables("in_window")
    + """ SELECT CASE WHEN "offset" NOT BETWEEN -24 AND 25 THEN 'outside_crop' WHEN "offset" IN (0, 1) THEN 'invalid_change' ELSE 'kept' END AS reason, count(*) AS n FROM in_window GROUP BY 1"""
)
def model_visible_funnel(d: Derived) -> DataFrame:
    return cohort.funnel(cohort.model_visible(d.in_window.withColumn("uid", F.col("variant_id")), 50))


@query(
    with_tables("variants", "loci")
    + """ SELECT v.variant_id, l.probe_id, v.pos1 - 1 - l.pos AS "offset", v.pos1 - 1 - l.pos NOT IN (0, 1) AS visible FROM variants v JOIN loci l ON v.chr = l.chr AND v.pos1 - 1 - l.pos BETWEEN -499 AND 500"""
)
def distance_window_join(d: Derived) -> DataFrame:
    v = d.variants.withColumn("pos", F.col("pos1") - 1)
    pairs = intervals.window_join(v, d.loci, -499, 500)
    off = F.col("pos") - F.col("o_pos")
    return pairs.select("variant_id", F.col("o_probe_id").alias("probe_id"), off.alias("offset"), (~off.isin(0, 1)).alias("visible"))


@query(
    with_tables("variants", "loci")
    + """, l AS (SELECT v.variant_id, max(l.pos) AS p FROM variants v JOIN loci l ON v.chr = l.chr AND l.pos < v.pos1 - 1 GROUP BY 1), r AS (SELECT v.variant_id, min(l.pos) AS p FROM variants v JOIN loci l ON v.chr = l.chr AND l.pos >= v.pos1 - 1 GROUP BY 1),
b AS (SELECT v.variant_id, v.chr, v.pos1 - 1 AS q, l.p AS lp, r.p AS rp FROM variants v LEFT JOIN l USING (variant_id) LEFT JOIN r USING (variant_id)),
c AS (SELECT variant_id, chr, q, rp IS NULL OR q - lp <= rp - q AS go_left, lp, rp FROM b),
n AS (SELECT variant_id, chr, q, coalesce(go_left AND lp IS NOT NULL, false) AS is_left, CASE WHEN go_left AND lp IS NOT NULL THEN lp ELSE rp END AS near_pos FROM c)
SELECT n.variant_id, CASE WHEN any_value(is_left) THEN max(l.probe_id) ELSE min(l.probe_id) END AS near_id, any_value(near_pos) AS near_pos, abs(any_value(near_pos) - any_value(q)) AS distance FROM n LEFT JOIN loci l ON l.chr = n.chr AND l.pos = n.near_pos GROUP BY 1"""
)
def nearest_probe(d: Derived) -> DataFrame:
    v = d.variants.withColumn("pos", F.col("pos1") - 1)
    return intervals.nearest(v, d.loci).select("variant_id", "near_id", "near_pos", "distance")


@query(with_tables("signals") + """, m AS (SELECT chr, "start", "end", CASE WHEN "start" > max("end") OVER w + 1 OR max("end") OVER w IS NULL THEN 1 ELSE 0 END AS new FROM signals WINDOW w AS (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chr, min("start") AS "start", max("end") AS "end" FROM g GROUP BY chr, island""")
def merged_intervals(d: Derived) -> DataFrame:
    return intervals.merge_intervals(d.signals)


@query(with_tables("loci", "signals") + """ SELECT l.probe_id, count(s.event_id) AS n_intervals, count(s.event_id) > 0 AS inside FROM loci l LEFT JOIN signals s ON s.chr = l.chr AND l.pos BETWEEN s."start" AND s."end" GROUP BY 1""")
def point_in_intervals(d: Derived) -> DataFrame:
    counted = intervals.count_containing(d.loci.select("probe_id", "chr", "pos"), d.signals, "n_intervals")
    return intervals.inside_merged(counted, intervals.merge_intervals(d.signals), "inside").select("probe_id", "n_intervals", "inside")


_GENES = """, tx AS (SELECT event_id AS tx, chr, "start", "start" + 3000 + event_id % 5000 AS "end", CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM signals WHERE event_id % 10 = 0),
utr AS (SELECT chr, "start", "start" + 200 AS "end" FROM tx), pr AS (SELECT chr, CASE WHEN strand = '+' THEN greatest(1, "start" - 1500) ELSE greatest(1, "end" - 200) END AS a, CASE WHEN strand = '+' THEN "start" + 200 ELSE "end" + 1500 END AS z FROM tx)"""


def _transcripts(d: Derived) -> DataFrame:
    k = F.col("event_id")
    return d.signals.filter(k % 10 == 0).select(k.alias("tx"), "chr", "start", (F.col("start") + 3000 + k % 5000).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


@query(
    with_tables("loci", "signals")
    + _GENES
    + """, f AS (SELECT probe_id, EXISTS (SELECT 1 FROM pr WHERE pr.chr = l.chr AND l.pos + 1 BETWEEN pr.a AND pr.z) AS p, EXISTS (SELECT 1 FROM utr u WHERE u.chr = l.chr AND l.pos + 1 BETWEEN u."start" AND u."end") AS u,
EXISTS (SELECT 1 FROM tx WHERE tx.chr = l.chr AND l.pos + 1 BETWEEN tx."start" AND tx."end") AS t FROM loci l)
SELECT probe_id, CASE WHEN p THEN 'Promoter/TSS' WHEN u THEN 'UTR' WHEN t THEN 'Gene body' ELSE 'Intergenic' END AS region, coalesce(nullif(concat_ws('; ', CASE WHEN p THEN 'Promoter/TSS' END, CASE WHEN u THEN 'UTR' END, CASE WHEN t AND NOT u THEN 'Transcript span' END), ''), 'None') AS region_set FROM f"""
)
def genomic_regions(d: Derived) -> DataFrame:
    tx = _transcripts(d)
    utr = tx.select("chr", "start", (F.col("start") + 200).alias("end"))
    return cohort.regions(d.loci.select("probe_id", "chr", "pos"), tx, utr).select("probe_id", "region", "region_set")


@query(
    with_tables("loci")
    + """ SELECT probe_id, pos >= least(b, e) AND pos < greatest(b, e) AS half_open, pos BETWEEN least(b, e) AND greatest(b, e) AS closed, pos BETWEEN least(b, e) - 1 AND greatest(b, e) + 1 AS around FROM (SELECT probe_id, pos, pos + part_key % 5 - 3 AS b, pos + part_key % 7 - 3 AS e FROM loci)"""
)
def probe_span_rules(d: Derived) -> DataFrame:
    b, e = F.col("pos") + F.col("part_key") % 5 - 3, F.col("pos") + F.col("part_key") % 7 - 3
    return d.loci.select("probe_id", intervals.span_overlap(F.col("pos"), b, e).alias("s")).select("probe_id", "s.*")


@query(with_tables("segments") + " SELECT tx, part, l_partkey, l_suppkey, l_extendedprice, len, cast(coalesce(sum(len) OVER (PARTITION BY tx ORDER BY part, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before FROM segments")
def coding_offsets(d: Derived) -> DataFrame:
    return cohort.segment_offsets(d.segments, ["tx"], ["part", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("strand")


_CDS = """, s0 AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY part, l_partkey, l_suppkey, l_extendedprice) AS k FROM segments),
s1 AS (SELECT tx, strand, k, len, substr(translate(md5(tx || '|' || k), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, least(len, 32)) AS seq FROM s0)"""


def _segments(d: Derived) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("tx").orderBy("part", "l_partkey", "l_suppkey", "l_extendedprice"))
    s = d.segments.withColumn("k", k)
    text = F.translate(F.md5(F.concat_ws("|", F.col("tx").cast("string"), F.col("k").cast("string"))), "0123456789abcdef", "ACGT" * 4)
    return s.select("tx", "strand", "k", "len", F.substring(text, F.lit(1), F.least(F.col("len"), F.lit(32)).cast("int")).alias("seq"))


@query(
    with_tables("segments")
    + _CDS
    + """, c AS (SELECT tx, string_agg(CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, '' ORDER BY CASE WHEN strand = '-' THEN -k ELSE k END) AS cds FROM s1 GROUP BY 1) SELECT tx, length(cds) AS cds_length, substr(cds, 1, 3) AS first_codon, sha256(cds) AS cds_sha256 FROM c"""
)
def spliced_transcripts(d: Derived) -> DataFrame:
    c = cohort.splice(_segments(d), "tx", "k", "seq", "strand")
    return c.select("tx", F.length("cds").cast("long").alias("cds_length"), F.substring("cds", 1, 3).alias("first_codon"), F.sha2("cds", 256).alias("cds_sha256"))


@query(
    with_tables("variants")
    + """ SELECT variant_id, CASE substr(chr, 4) WHEN 'X' THEN 23 WHEN 'Y' THEN 24 ELSE cast(substr(chr, 4) AS int) END AS chr_order, chr || ':' || pos1 || ':' || least(ref, alt) || ':' || greatest(ref, alt) AS locus_key, chr || ':' || cast(floor(pos1 / 100000) AS bigint) AS block, chr AS parsed_chr, pos1 AS parsed_pos, ref AS parsed_ref, alt AS parsed_alt FROM variants"""
)
def variant_names(d: Derived) -> DataFrame:
    v = d.variants
    parsed = S.variant_id_fields(F.concat_ws("_", "chr", F.col("pos1").cast("string"), "ref", "alt", F.lit("b38")))
    change = S.genomic_change_fields(F.concat("chr", F.lit(":g."), F.col("pos1").cast("string"), "ref", F.lit(">"), "alt"), F.lit("1"), F.lit(0).cast("long"), F.lit("N"), F.lit("N"))
    return v.select("variant_id", S.chromosome_order(F.col("chr")).alias("chr_order"), S.locus_key(F.regexp_replace("chr", "^chr", ""), F.col("pos1"), F.col("alt"), F.col("ref")).alias("locus_key"), S.block_id(F.col("chr"), F.col("pos1"), 100_000).alias("block"), parsed["chr"].alias("parsed_chr"), parsed["pos1"].alias("parsed_pos"), change["ref"].alias("parsed_ref"), change["alt"].alias("parsed_alt"))


@query(
    """SELECT s_suppkey, 'TCGA-A' || s_suppkey % 10 || '-' || lpad(cast(s_suppkey AS varchar), 4, '0') AS participant_id, 'TCGA-A' || s_suppkey % 10 || '-' || lpad(cast(s_suppkey AS varchar), 4, '0') || '-' || CASE WHEN s_suppkey % 3 = 0 THEN '11' ELSE '01' END || 'A' AS sample_id,
CASE WHEN s_suppkey % 3 = 0 THEN '11' ELSE '01' END AS sample_type, 'A' AS vial, '12' AS portion, 'D' AS analyte, 6 AS n_components, s_suppkey % 3 = 0 AS is_normal FROM supplier"""
)
def sample_barcodes(d: Derived) -> DataFrame:
    k = F.col("s_suppkey")
    code = F.concat(F.lit("tcga-A"), k % 10, F.lit("."), F.lpad(k.cast("string"), 4, "0"), F.lit("-"), F.when(k % 3 == 0, "11").otherwise("01"), F.lit("A-12D-99"))
    b = S.barcode_fields(code)
    return d.table("supplier").select("s_suppkey", *(b[c].alias(c) for c in ("participant_id", "sample_id", "sample_type", "vial", "portion", "analyte", "n_components")), S.normal_sample(code).alias("is_normal"))


_ISLANDS = ["Island", "N_Shore", "S-Shelf", "OpenSea", "cgi", "NA", "other", ""]


@query(
    "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Island' WHEN 1 THEN 'Shore' WHEN 2 THEN 'Shelf' WHEN 3 THEN 'Open sea' WHEN 4 THEN 'Island' WHEN 5 THEN 'Open sea' WHEN 6 THEN 'Unclassified' ELSE 'Open sea' END AS island, CASE WHEN p_size <= 10 THEN true ELSE false END AS flag FROM part"
)
def island_context(d: Derived) -> DataFrame:
    raw = F.array(*map(F.lit, _ISLANDS))[(F.col("p_partkey") % 8).cast("int")]
    return d.table("part").select("p_partkey", S.island_context(raw).alias("island"), S.to_boolean(F.when(F.col("p_size") <= 10, " Yes ").otherwise("F")).alias("flag"))


@query("SELECT event_id, cast(props->>'k' AS bigint) AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 + 1 END AS n_items FROM events")
def json_fields(d: Derived) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 3 == 0, "not json").when(k % 3 == 1, '["a", "b"]').otherwise('["a", "b", "c"]')
    items = S.json_list(text)
    return d.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(items.isNotNull(), F.size(items)).cast("long").alias("n_items"))


@query(
    with_tables("leads")
    + """ SELECT lead_id, round(slope, 6) AS slope, round(CASE WHEN lead_id % 2 = 0 THEN slope ELSE -slope END, 6) AS aligned, CASE WHEN qval < 0.05 THEN 'significant' WHEN qval >= 0.5 THEN 'nonsignificant' END AS q_class, round(1 / (1 + pow(2.0, -slope)), 6) AS beta FROM leads"""
)
def lead_classes(d: Derived) -> DataFrame:
    effect = F.when(F.col("lead_id") % 2 == 0, "T").otherwise("C")
    return d.leads.select("lead_id", r6("slope").alias("slope"), r6(S.aligned_slope(F.col("slope"), effect, F.lit("C"), F.lit("T"))).alias("aligned"), S.q_class(F.col("qval")).alias("q_class"), r6(S.m_to_beta(F.col("slope"))).alias("beta"))


@query(
    with_tables("loci")
    + """ SELECT probe_id, cast('0x' || substr(md5('42|3|' || probe_id), 1, 8) AS bigint) < 2147483648 AS rc, CASE WHEN cast('0x' || substr(md5('42|3|' || probe_id), 1, 8) AS bigint) < 2147483648 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN cast('0x' || substr(md5('42|3|' || probe_id), 1, 8) AS bigint) < 2147483648 THEN pos + 1 ELSE pos END AS first, CASE WHEN cast('0x' || substr(md5('42|3|' || probe_id), 1, 8) AS bigint) < 2147483648 THEN pos ELSE pos + 1 END AS second FROM loci"""
)
def orientation_augmented(d: Derived) -> DataFrame:
    both = d.loci.select("probe_id", "seq", F.col("pos").alias("first"), (F.col("pos") + 1).alias("second"))
    return cohort.augmented(both, "seq", [("first", "second")], "probe_id", 42, 3)


# Ranks and sets ---------------------------------------------------------------


@query(
    with_tables("leads")
    + """ SELECT lead_id, rank() OVER (PARTITION BY chr ORDER BY abs(effect) DESC) AS competition_rank, row_number() OVER (PARTITION BY chr ORDER BY abs(effect) DESC, lead_id) AS positional_rank, dense_rank() OVER (ORDER BY cluster) AS cluster_rank, rank() OVER (ORDER BY effect) + (count(*) OVER (PARTITION BY effect) - 1) / 2.0::double AS average_rank,
round(100.0::double * (rank() OVER (ORDER BY effect) + (count(*) OVER (PARTITION BY effect) - 1) / 2.0::double - 1) / (count(*) OVER () - 1), 6) AS percentile, count(*) OVER (PARTITION BY cluster) AS cluster_size, bool_or(qval < 0.05) OVER (PARTITION BY cluster) AS cluster_has_significant FROM leads"""
)
def lead_ranks(d: Derived) -> DataFrame:
    t = ranks.global_average_rank(d.leads, "effect", "average_rank")
    n = d.leads.agg(F.count(F.lit(1)).alias("n_"))
    c = ranks.running(d.leads.select("cluster").distinct(), [F.col("cluster")], {"cluster_rank": F.lit(1)})
    t = ranks.number_in(t.crossJoin(F.broadcast(n)).join(c, "cluster").withColumn("a_", -F.abs("effect")), ["chr"], [F.col("a_"), F.col("lead_id")], "positional_rank")
    t = t.join(t.groupBy("chr", "a_").agg(F.min("positional_rank").alias("competition_rank")), ["chr", "a_"])
    return t.select(
        "lead_id", "competition_rank", "positional_rank", "cluster_rank", "average_rank",
        r6(ranks.percentile_rank(F.col("average_rank"), F.col("n_"))).alias("percentile"), F.count(F.lit(1)).over(Window.partitionBy("cluster")).alias("cluster_size"), F.bool_or(F.col("qval") < 0.05).over(Window.partitionBy("cluster")).alias("cluster_has_significant"),
    )


@query(with_tables("leads") + " SELECT cluster, lead_id, effect FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(effect) DESC, lead_id) AS k FROM leads) WHERE k = 1")
def first_per_cluster(d: Derived) -> DataFrame:
    return ranks.first_per_key(d.leads, ["cluster"], [F.abs("effect").desc(), F.col("lead_id")]).select("cluster", "lead_id", "effect")


@query(with_tables("leads") + " SELECT lead_id, effect FROM leads ORDER BY abs(effect) DESC, lead_id LIMIT 20")
def top_twenty_leads(d: Derived) -> DataFrame:
    return ranks.top_k(d.leads.select("lead_id", "effect"), 20, F.abs("effect"), "lead_id")


_RUNS = """, runs AS (SELECT seed || '-' || model AS run, part_key AS id, pred - 0.5 AS score FROM predictions), best AS (SELECT run, id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(score) DESC, id) AS k FROM runs) WHERE k <= 50)"""


@query(
    with_tables("predictions")
    + _RUNS
    + """, names AS (SELECT DISTINCT run FROM best) SELECT a.run AS run_a, b.run AS run_b, count(x.id) AS overlap, round(count(x.id) / (100.0::double - count(x.id)), 6) AS jaccard FROM names a JOIN names b ON a.run < b.run LEFT JOIN (SELECT p.run AS ra, q.run AS rb, p.id FROM best p JOIN best q ON p.id = q.id) x ON x.ra = a.run AND x.rb = b.run GROUP BY 1, 2"""
)
def top_overlap_of_runs(d: Derived) -> DataFrame:
    runs = d.predictions.select(F.concat_ws("-", F.col("seed").cast("string"), "model").alias("run"), F.col("part_key").alias("id"), (F.col("pred") - 0.5).alias("score"))
    return rounded(ranks.top_overlap(runs, 50))


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_a, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_b, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AND (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS equal")
def key_set_difference(d: Derived) -> DataFrame:
    return ranks.set_difference_counts(d.table("customer").select(F.col("c_custkey").alias("k")), d.table("orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT o_custkey, string_agg(o_orderpriority, ' | ' ORDER BY o) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_text(d: Derived) -> DataFrame:
    return ranks.distinct_in_order(d.table("orders"), "o_custkey", "o_orderpriority", "o_orderkey").withColumnRenamed("o_orderpriority", "priorities")


@query(with_tables("variants") + """ SELECT chr, ref, alt, count(*) AS n, list_aggregate(list_sort(list_distinct(list(pos1 % 10))), 'string_agg', ',') AS digits FROM variants GROUP BY 1, 2, 3""")
def grouped_id_sets(d: Derived) -> DataFrame:
    return d.variants.groupBy("chr", "ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("pos1") % 10)), ",").alias("digits"))


@query(with_tables("loci") + " SELECT chr AS value, count(*) AS n, round(100.0::double * count(*) / (SELECT count(*) FROM loci), 6) AS percent FROM loci GROUP BY 1")
def chromosome_counts(d: Derived) -> DataFrame:
    return rounded(metrics.value_counts(d.loci, "chr"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) FILTER (value = 0) AS n_zero, count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value IS NULL) AS n_missing FROM events GROUP BY 1")
def signal_statistics(d: Derived) -> DataFrame:
    return rounded(d.table("events").groupBy("event_type").agg(*metrics.numeric_stats(F.col("value"))))


# Evaluation --------------------------------------------------------------------

_METRICS = "count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(pred - truth), 6) AS mean_signed, round(median(abs(pred - truth)), 6) AS median_abs"


@query(with_tables("predictions") + f" SELECT model, seed, {_METRICS} FROM predictions GROUP BY 1, 2")
def model_errors(d: Derived) -> DataFrame:
    return rounded(metrics.error_metrics(d.predictions, ["model", "seed"], F.col("pred"), F.col("truth")))


@query(with_tables("predictions") + f", g AS (SELECT *, unnest([{{'grouping': 'split', 'stratum': split}}, {{'grouping': 'chr', 'stratum': chr}}, {{'grouping': 'distance', 'stratum': CASE WHEN pos % 600 <= 50 THEN '0-50' WHEN pos % 600 <= 100 THEN '51-100' WHEN pos % 600 <= 250 THEN '101-250' WHEN pos % 600 <= 500 THEN '251-500' END}}]) AS x FROM predictions) SELECT model, x.grouping AS grouping, x.stratum AS stratum, {_METRICS} FROM g WHERE x.stratum IS NOT NULL GROUP BY 1, 2, 3")
def errors_by_grouping(d: Derived) -> DataFrame:
    groups = {"split": F.col("split"), "chr": F.col("chr"), "distance": S.distance_bin(F.col("pos") % 600)}
    return rounded(metrics.grouped_errors(d.predictions, groups, keys=("model",)))


_COVERAGE = ", cov AS (SELECT part_key, count(beta) AS coverage FROM normals GROUP BY 1), p AS (SELECT * FROM predictions JOIN cov USING (part_key))"


def _covered(d: Derived) -> DataFrame:
    return d.predictions.join(metrics.probe_medians(d.normals).select("part_key", F.col("n_observed").alias("coverage")), "part_key")


@query(with_tables("predictions") + _COVERAGE + f" SELECT model, threshold, {_METRICS} FROM p JOIN (VALUES (1), (20), (28), (35)) t(threshold) ON coverage >= threshold GROUP BY 1, 2")
def errors_by_coverage_threshold(d: Derived) -> DataFrame:
    return rounded(metrics.threshold_errors(_covered(d), "coverage", [1, 20, 28, 35], ("model",)))


@query(with_tables("predictions") + _COVERAGE + f" SELECT model, CASE WHEN coverage <= 20 THEN '(0,20]' WHEN coverage <= 28 THEN '(20,28]' WHEN coverage <= 35 THEN '(28,35]' ELSE '(35,200]' END AS bin, {_METRICS} FROM p GROUP BY 1, 2")
def errors_by_coverage_bin(d: Derived) -> DataFrame:
    b = metrics.right_closed_bin(F.col("coverage"), [0, 20, 28, 35, 200])
    return rounded(metrics.error_metrics(_covered(d).withColumn("bin", b), ["model", "bin"], F.col("pred"), F.col("truth")))


_AUC_SQL = "round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))), 6) AS auc"


@query(with_tables("scored") + f", k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS r FROM scored) SELECT count(*) AS n, cast(sum(y) AS bigint) AS n_positive, {_AUC_SQL} FROM k")
def roc_auc(d: Derived) -> DataFrame:
    return rounded(metrics.auc(d.scored))


@query(with_tables("predictions") + f", b AS (SELECT *, CASE WHEN truth > 0.5 THEN 1 ELSE 0 END AS y FROM predictions), k AS (SELECT *, rank() OVER (PARTITION BY model, seed ORDER BY pred) + (count(*) OVER (PARTITION BY model, seed, pred) - 1) / 2.0::double AS r FROM b) SELECT model, seed, count(*) AS n, cast(sum(y) AS bigint) AS n_positive, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN {_AUC_SQL.removesuffix(' AS auc')} END AS auc FROM k GROUP BY 1, 2")
def model_auc(d: Derived) -> DataFrame:
    return rounded(metrics.auc(d.predictions.withColumn("y", S.binary_state(F.col("truth"))), "y", "pred", ("model", "seed")))


_CURVE = ", s AS (SELECT score, sum(y) AS p, count(*) AS c FROM scored GROUP BY 1), u AS (SELECT score, p, cast(sum(p) OVER w AS double) AS tp, cast(sum(c) OVER w AS double) AS n, cast(sum(p) OVER () AS double) AS pos, cast(sum(c) OVER () AS double) AS total FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(with_tables("scored") + _CURVE + " SELECT score, cast(p AS bigint) AS positives, cast(tp AS bigint) AS tp, cast(n - tp AS bigint) AS fp, round(tp / pos, 6) AS tpr, round((n - tp) / (total - pos), 6) AS fpr, round(tp / n, 6) AS precision FROM u")
def roc_pr_points(d: Derived) -> DataFrame:
    return rounded(metrics.curve(d.scored))


@query(with_tables("scored") + _CURVE + ", o AS (SELECT y, row_number() OVER w AS k, sum(y) OVER w AS tp FROM scored WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT (SELECT round(sum(p * tp / n) / sum(p), 6) FROM u) AS tie_grouped, (SELECT round(avg(tp / cast(k AS double)), 6) FROM o WHERE y = 1) AS tie_ordered")
def average_precisions(d: Derived) -> DataFrame:
    a = metrics.average_precision(d.scored).withColumnRenamed("average_precision", "tie_grouped")
    return rounded(a.crossJoin(metrics.ordered_average_precision(d.scored, "doc_id").withColumnRenamed("average_precision", "tie_ordered")))


@query(with_tables("leads") + ", k AS (SELECT rank() OVER (ORDER BY effect) + (count(*) OVER (PARTITION BY effect) - 1) / 2.0::double AS a, rank() OVER (ORDER BY slope) + (count(*) OVER (PARTITION BY slope) - 1) / 2.0::double AS b FROM leads) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM k")
def spearman_effect_slope(d: Derived) -> DataFrame:
    return rounded(metrics.spearman(d.leads, "effect", "slope"))


@query(with_tables("leads") + " SELECT chr, round(avg(CASE WHEN sign(effect) = sign(slope) THEN 1.0::double ELSE 0 END), 6) AS concordance, count(*) FILTER (sign(effect) = sign(slope)) AS n_same, count(*) FILTER (effect <> 0 AND slope <> 0) AS n_nonzero, count(*) FILTER (effect <> 0 AND slope <> 0 AND sign(effect) = sign(slope)) AS n_nonzero_same FROM leads GROUP BY 1")
def direction_concordance(d: Derived) -> DataFrame:
    return rounded(d.leads.groupBy("chr").agg(*metrics.concordance(F.col("effect"), F.col("slope"))))


@query(
    with_tables("leads")
    + """, c AS (SELECT cluster, count(*) AS n, count(*) FILTER (sign(effect) = sign(slope)) AS k FROM leads GROUP BY 1), t AS (SELECT cluster, c.n, c.k, i.i, exp(lgamma(c.n + 1) - lgamma(i.i + 1) - lgamma(c.n - i.i + 1) - c.n * ln(2.0)) AS p FROM c, range(0, 10000) i(i) WHERE i.i <= c.n)
SELECT cluster, n, k, round(least(sum(CASE WHEN i >= k THEN p END), 1), 6) AS p_greater, round(least(sum(CASE WHEN p <= o.op * (1 + 1e-7) THEN p END), 1), 6) AS p_two_sided FROM t JOIN (SELECT cluster AS oc, p AS op FROM t WHERE i = k) o ON o.oc = t.cluster GROUP BY 1, 2, 3"""
)
def binomial_concordance(d: Derived) -> DataFrame:
    c = d.leads.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.signum("effect") == F.signum("slope"), 1)).alias("k"))
    return rounded(metrics.binomial_tails(c, "k", "n"))


_DELTAS = ", dl AS (SELECT part_key AS uid, seed, (pred - truth) * 1.0::double AS delta FROM predictions WHERE model = 'fusion')"


@query(
    with_tables("predictions")
    + _DELTAS
    + """, k AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY abs(delta) DESC) AS r FROM dl)
SELECT uid, count(DISTINCT seed) AS n_seeds, round(avg(delta), 6) AS mean_delta, round(stddev_pop(delta), 6) AS sd_delta, round(median(delta), 6) AS median_delta, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta,
round(CASE WHEN count(*) FILTER (delta <> 0) = 0 THEN 1 ELSE greatest(count(*) FILTER (delta > 0), count(*) FILTER (delta < 0)) / cast(count(*) FILTER (delta <> 0) AS double) END, 6) AS sign_consistency, round(avg(abs(delta)), 6) AS mean_abs_delta,
round(avg(r), 6) AS mean_rank, round(stddev_pop(r), 6) AS sd_rank, min(r) AS best_rank, max(r) AS worst_rank, round(avg(CASE WHEN r <= 10 THEN 1.0::double ELSE 0 END), 6) AS top10_frequency, round(avg(CASE WHEN r <= 20 THEN 1.0::double ELSE 0 END), 6) AS top20_frequency FROM k GROUP BY 1"""
)
def seed_summary(d: Derived) -> DataFrame:
    s = d.predictions.filter("model = 'fusion'").select(F.col("part_key").alias("uid"), "seed", (F.col("pred") - F.col("truth")).alias("delta"))
    return rounded(metrics.seed_summary(s))


@query(
    with_tables("predictions")
    + """, dl AS (SELECT part_key AS uid, model, seed, pred - truth AS delta FROM predictions), k AS (SELECT *, rank() OVER (PARTITION BY model, seed ORDER BY abs(delta) DESC) AS r FROM dl)
SELECT model, uid, count(DISTINCT seed) AS n_seeds, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, round(avg(r), 6) AS mean_rank, min(r) AS best_rank, round(avg(CASE WHEN r <= 10 THEN 1.0::double ELSE 0 END), 6) AS top10_frequency FROM k GROUP BY 1, 2"""
)
def seed_summary_by_model(d: Derived) -> DataFrame:
    """Each model's candidates over its seeds; an error unless all seeds are there."""
    s = d.predictions.select(F.col("part_key").alias("uid"), "model", "seed", (F.col("pred") - F.col("truth")).alias("delta"))
    return rounded(metrics.seed_summary(s, keys=("model",)).select("model", "uid", "n_seeds", "mean_delta", "median_delta", "mean_rank", "best_rank", "top10_frequency"))


@query(
    with_tables("predictions")
    + f""", e AS (SELECT part_key, model, avg(pred) AS pred, min(truth) AS truth FROM predictions GROUP BY 1, 2) SELECT model, {_METRICS} FROM e GROUP BY 1"""
)
def ensemble_errors(d: Derived) -> DataFrame:
    e = d.predictions.groupBy("part_key", "model").agg(F.avg("pred").alias("pred"), F.min("truth").alias("truth"))
    return rounded(metrics.error_metrics(e, ["model"], F.col("pred"), F.col("truth")))


@query(with_tables("predictions") + ", w AS (SELECT part_key, max(CASE WHEN seed = 42 THEN pred END) AS a, max(CASE WHEN seed = 43 THEN pred END) AS b FROM predictions WHERE model = 'sequence' GROUP BY 1) SELECT round(avg(abs(a - b)), 6) AS mae, round(max(abs(a - b)), 6) AS max_abs, round(corr(a, b), 6) AS pearson FROM w")
def run_agreement(d: Derived) -> DataFrame:
    w = d.predictions.filter("model = 'sequence'").groupBy("part_key").pivot("seed", [42, 43]).agg(F.max("pred"))
    return rounded(w.agg(*metrics.orientation_agreement(F.col("`42`"), F.col("`43`"))))


@query(with_tables("predictions") + ", g AS (SELECT model, pred / greatest(pred + truth, 1e-12) AS s FROM predictions) SELECT model, round(avg(s), 6) AS share_mean, round(quantile_cont(s, 0.1), 6) AS share_q10, round(quantile_cont(s, 0.25), 6) AS share_q25, round(quantile_cont(s, 0.5), 6) AS share_q50, round(quantile_cont(s, 0.75), 6) AS share_q75, round(quantile_cont(s, 0.9), 6) AS share_q90, round(avg(CASE WHEN s > 0.5 THEN 1.0::double ELSE 0 END), 6) AS share_dominant FROM g GROUP BY 1")
def gate_shares(d: Derived) -> DataFrame:
    g = d.predictions.withColumn("s", S.gate_share(F.col("pred"), F.col("truth")))
    return rounded(metrics.quantiles(g, ["model"], "s", "share"))


@query(with_tables("predictions") + ", m AS (SELECT seed, model, avg(abs(pred - truth)) AS e FROM predictions GROUP BY 1, 2), p AS (SELECT seed, max(CASE WHEN model = 'sequence' THEN e END) - max(CASE WHEN model = 'fusion' THEN e END) AS gain FROM m GROUP BY 1) SELECT round(avg(gain), 6) AS mean_gain, round(stddev_samp(gain), 6) AS sd_gain, count(*) AS n_seeds FROM p")
def incremental_value(d: Derived) -> DataFrame:
    m = d.predictions.groupBy("seed").pivot("model", ["sequence", "fusion"]).agg(F.avg(F.abs(F.col("pred") - F.col("truth"))))
    return rounded(m.select((F.col("sequence") - F.col("fusion")).alias("g")).agg(F.avg("g").alias("mean_gain"), F.stddev_samp("g").alias("sd_gain"), F.count(F.lit(1)).alias("n_seeds")))


@query(with_tables("scored") + ", n AS (SELECT count(*) AS n, avg(y) AS base FROM scored), k AS (SELECT y, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM scored) SELECT fraction, count(*) AS n_top, round(avg(y), 6) AS positive_fraction, round(avg(y) / min(base), 6) AS enrichment FROM k, n, (VALUES (0.1::double), (0.2::double)) f(fraction) WHERE k <= greatest(1, ceil(fraction * n)) GROUP BY 1")
def top_fraction_enrichment(d: Derived) -> DataFrame:
    return rounded(metrics.top_enrichment(d.scored, (0.1, 0.2), "doc_id"))


@query(with_tables("leads") + ", g AS (SELECT cluster, o FROM (SELECT DISTINCT cluster FROM leads) x(cluster), (SELECT DISTINCT cluster FROM leads) y(o)) SELECT o AS omitted, count(*) AS n, round(corr(effect, slope), 6) AS pearson, round(corr(effect, slope) - (SELECT corr(effect, slope) FROM leads), 6) AS change FROM leads JOIN g USING (cluster) WHERE cluster <> o GROUP BY 1")
def leave_one_cluster_out(d: Derived) -> DataFrame:
    return rounded(metrics.leave_one_out(d.leads, "cluster", "effect", "slope"))


@query(with_tables("predictions") + ", b AS (SELECT model, least(floor(pred * 10), 9) AS bin, pred, CASE WHEN truth > 0.5 THEN 1.0::double ELSE 0 END AS y FROM predictions WHERE model = 'fusion') SELECT cast(bin AS bigint) AS bin, count(*) AS n, round(avg(pred), 6) AS mean_predicted, round(avg(y), 6) AS observed FROM b GROUP BY 1")
def calibration_bins(d: Derived) -> DataFrame:
    return rounded(metrics.calibration(d.predictions.filter("model = 'fusion'").withColumn("y", S.binary_state(F.col("truth"))), "y", "pred"))


@query(with_tables("predictions") + ", b AS (SELECT model, cast(least(floor(pred / 0.05), 19) AS int) AS bin FROM predictions), c AS (SELECT model, bin, count(*) AS n FROM b GROUP BY 1, 2) SELECT model, bin, n, round(n / (sum(n) OVER (PARTITION BY model) * 0.05), 6) AS density FROM c")
def prediction_histogram(d: Derived) -> DataFrame:
    return rounded(metrics.histogram(d.predictions, "pred", 0.0, 1.0, 20, ("model",)))


@query(with_tables("predictions") + " SELECT cast(least(floor(truth / 0.1), 9) AS int) AS x_bin, cast(least(floor(pred / 0.1), 9) AS int) AS y_bin, count(*) AS n FROM predictions WHERE model = 'fusion' GROUP BY 1, 2")
def density_grid(d: Derived) -> DataFrame:
    return metrics.density_grid(d.predictions.filter("model = 'fusion'"), "truth", "pred", 0.0, 1.0, 10)


# Audits ------------------------------------------------------------------------


@query(with_tables("predictions") + ", k AS (SELECT part_key, count(DISTINCT (seed, model)) AS r, max(truth) - min(truth) AS e FROM predictions GROUP BY 1) SELECT count(*) AS n_keys, count(*) FILTER (r <> 9) AS n_incomplete, count(*) FILTER (e > 1e-10) AS n_truth_differs FROM k")
def run_alignment(d: Derived) -> DataFrame:
    return audit.alignment(d.predictions, "part_key", ["seed", "model"], "truth", 9)


@query("SELECT 'big' AS mask, count(*) FILTER (p_size > 25) AS n_true, count(*) FILTER (p_size <= 25) AS n_false FROM part UNION ALL SELECT 'dear', count(*) FILTER (p_retailprice > 1200), count(*) FILTER (p_retailprice <= 1200) FROM part")
def mask_counts(d: Derived) -> DataFrame:
    return audit.mask_counts(d.table("part").select((F.col("p_size") > 25).alias("big"), (F.col("p_retailprice") > 1200).alias("dear")), ["big", "dear"])


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) SELECT (SELECT count(*) FROM orders) AS n_saved, (SELECT count(*) FROM b) AS n_expected, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS n_unexpected, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_omitted, (SELECT count(*) FROM orders) - (SELECT count(*) FROM a) AS n_duplicate, false AS same_order")
def selection_audit(d: Derived) -> DataFrame:
    saved = d.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    expected = d.table("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("o"))
    return audit.selection_audit(saved, expected, "k", "o")


@query(
    with_tables("loci")
    + """ SELECT split, count(*) AS n_rows, count(*) FILTER (p_partkey IS NULL) AS n_missing, count(*) FILTER (p_size > 25) AS n_masked FROM loci LEFT JOIN (SELECT * FROM part WHERE p_partkey % 13 <> 0) ON p_partkey = part_key GROUP BY 1"""
)
def masks_by_split(d: Derived) -> DataFrame:
    """Loci of each split against a manifest that lacks some of them."""
    manifest = d.table("part").filter("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("part_key"), (F.col("p_size") > 25).alias("masked"))
    return checked.masks_by_split(d.loci, manifest, "part_key", "masked")


_RECORDS = "r AS (SELECT c_custkey AS record_id, CASE WHEN c_custkey % 4 = 0 THEN 'http://example.org/' || c_custkey WHEN c_custkey % 4 = 1 THEN '  ' END AS url FROM customer), p AS (SELECT o_custkey AS record_id, string_agg(DISTINCT cast(o_orderkey AS varchar), ',' ORDER BY cast(o_orderkey AS varchar)) AS ids FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1), e AS (SELECT record_id, coalesce(ids, '') AS publication_ids, coalesce(trim(url) <> '', false) AS has_url FROM r LEFT JOIN p USING (record_id))"


def _published(d: Derived) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    records = d.table("customer").select(k.alias("record_id"), F.when(k % 4 == 0, F.concat(F.lit("http://example.org/"), k)).when(k % 4 == 1, "  ").alias("url"))
    return cohort.published(records, d.table("orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").cast("string").alias("publication_id")))


@query(f"WITH {_RECORDS} SELECT record_id, publication_ids FROM e WHERE publication_ids <> '' OR has_url")
def published_records(d: Derived) -> DataFrame:
    return _published(d)[0].select("record_id", F.array_join("publication_ids", ",").alias("publication_ids"))


@query(f"WITH {_RECORDS} SELECT CASE WHEN publication_ids <> '' THEN 'publication' WHEN has_url THEN 'url' ELSE 'none' END AS evidence, count(*) AS n FROM e GROUP BY 1")
def published_evidence(d: Derived) -> DataFrame:
    return _published(d)[1]


@query("SELECT lang, count(*) AS n, count(*) FILTER (contains(lower(coalesce(text, '')), 'password') OR contains(lower(coalesce(text, '')), 'licen')) AS n_mentioning FROM documents GROUP BY 1")
def term_mentions(d: Derived) -> DataFrame:
    """Documents of each language that mention one of two terms."""
    return d.table("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(S.mentions_any(F.col("text"), ["password", "licen"]), 1)).alias("n_mentioning"))


# Resampling --------------------------------------------------------------------

REPLICATES = 50


def _draws_sql(blocks: str, replicates: int = REPLICATES, seed: int = 42) -> str:
    return f"""nb AS (SELECT count(*) AS n FROM {blocks}), draws AS (SELECT replicate, i, count(*) AS times FROM (SELECT r.r AS replicate, cast('0x' || substr(md5('{seed}|' || r.r || '|' || dd.d), 1, 8) AS bigint) % n AS i
        FROM nb, range(0, {replicates}) r(r), range(0, 100000) dd(d) WHERE dd.d < n) GROUP BY 1, 2)"""


@query(
    with_tables("predictions")
    + ", blk AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i FROM (SELECT chr || ':' || cast(floor(pos / 100000) AS bigint) AS block, count(*) AS n, sum(abs(pred - truth)) AS e, sum((pred - truth) * (pred - truth)) AS e2 FROM predictions WHERE model = 'fusion' AND seed = 42 GROUP BY 1)), "
    + _draws_sql("blk")
    + " SELECT cast(replicate AS int) AS replicate, round(sum(times * e) / sum(times * blk.n), 6) AS mae, round(sqrt(sum(times * e2) / sum(times * blk.n)), 6) AS rmse FROM draws JOIN blk USING (i) GROUP BY 1"
)
def block_bootstrap_errors(d: Derived) -> DataFrame:
    p = d.predictions.filter("model = 'fusion' and seed = 42").withColumn("block", S.block_id(F.col("chr"), F.col("pos"), 100_000))
    e = F.col("pred") - F.col("truth")
    boot = resample.block_bootstrap(p, "block", {"n": F.lit(1), "e": F.abs(e), "e2": e * e}, REPLICATES)
    return rounded(boot.select("replicate", (F.col("e") / F.col("n")).alias("mae"), F.sqrt(F.col("e2") / F.col("n")).alias("rmse")))


@query(
    with_tables("predictions")
    + """, gp AS (SELECT part_key, split, chr || ':' || cast(floor(min(pos) / 100000) AS bigint) AS block, max(CASE WHEN model = 'sequence' THEN abs(pred - truth) END) - max(CASE WHEN model = 'fusion' THEN abs(pred - truth) END) AS g FROM predictions WHERE seed = 42 GROUP BY part_key, split, chr),
b AS (SELECT split, block, sum(g) AS g, count(*) AS c, row_number() OVER (PARTITION BY split ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY split) AS n FROM gp GROUP BY 1, 2), z AS (SELECT split, max(n) AS n FROM b GROUP BY 1),
t AS (SELECT split, r.r AS replicate, cast('0x' || substr(md5('42|' || split || '|' || r.r || '|' || dd.d), 1, 8) AS bigint) % n AS i, count(*) AS times FROM z, range(0, 50) r(r), range(0, 100000) dd(d) WHERE dd.d < n GROUP BY 1, 2, 3),
m AS (SELECT split, replicate, sum(times * g) / sum(times * c) AS m FROM t JOIN b USING (split, i) GROUP BY 1, 2)
SELECT split, z.n AS n_blocks, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(min(gain), 6) AS gain FROM m JOIN z USING (split) JOIN (SELECT split, avg(g) AS gain FROM gp GROUP BY 1) USING (split) GROUP BY 1, 2"""
)
def stratum_bootstrap_gain(d: Derived) -> DataFrame:
    e = F.abs(F.col("pred") - F.col("truth"))
    of = lambda m: F.max(F.when(F.col("model") == m, e))
    g = d.predictions.filter("seed = 42").groupBy("part_key", "split", "chr", "pos").agg((of("sequence") - of("fusion")).alias("g")).withColumn("block", S.block_id(F.col("chr"), F.col("pos"), 100_000))
    intervals_of = resample.stratum_bootstrap(g, "split", "block", "g", REPLICATES)
    return rounded(intervals_of.join(g.groupBy("split").agg(F.avg("g").alias("gain")), "split"))


@query("SELECT CASE stratum WHEN 'test' THEN 1 WHEN 'val' THEN 2 END AS place, stratum, -gain AS change, -high AS low, -low AS high FROM (SELECT split AS stratum, gain, low, high FROM (" + ORACLE_SQL["stratum_bootstrap_gain"] + ")) WHERE stratum IN ('test', 'val')")
def gain_panel(d: Derived) -> DataFrame:
    """The figure's rows: gains as changes of the error, in its order of strata."""
    return metrics.gain_panel(stratum_bootstrap_gain(d).withColumnRenamed("split", "stratum"), ["test", "val"])


_AUC_BLOCKS = ", y AS (SELECT chr AS block, pred AS score, CASE WHEN truth > 0.5 THEN 1 ELSE 0 END AS y FROM predictions WHERE model = 'fusion' AND seed = 42)"


@query(with_tables("predictions") + _AUC_BLOCKS + " SELECT p.block AS i_block, n.block AS j_block, round(sum(CASE WHEN p.score > n.score THEN 1.0::double WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS wins FROM y p, y n WHERE p.y = 1 AND n.y = 0 GROUP BY 1, 2")
def auc_block_matrix(d: Derived) -> DataFrame:
    p = d.predictions.filter("model = 'fusion' and seed = 42").select(F.col("chr").alias("block"), F.col("pred").alias("score"), S.binary_state(F.col("truth")).alias("y"))
    return rounded(resample.auc_matrix(p, "block"))


@query(
    with_tables("predictions")
    + _AUC_BLOCKS
    + ", blk AS (SELECT block, sum(y) AS p, sum(1 - y) AS q, row_number() OVER (ORDER BY block) - 1 AS i FROM y GROUP BY 1), "
    + _draws_sql("blk")
    + """, m AS (SELECT a.i AS bi, b.i AS bj, sum(CASE WHEN p.score > n.score THEN 1.0::double WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS w FROM y p JOIN blk a ON a.block = p.block, y n JOIN blk b ON b.block = n.block WHERE p.y = 1 AND n.y = 0 GROUP BY 1, 2),
s AS (SELECT replicate, cast(sum(times * p) AS double) AS p, cast(sum(times * q) AS double) AS q FROM draws JOIN blk USING (i) GROUP BY 1), t AS (SELECT x.replicate, sum(x.times * z.times * w) AS w FROM draws x JOIN draws z USING (replicate) JOIN m ON m.bi = x.i AND m.bj = z.i GROUP BY 1)
SELECT cast(replicate AS int) AS replicate, CASE WHEN p * q > 0 THEN round(coalesce(w, 0) / (p * q), 6) END AS auc FROM s LEFT JOIN t USING (replicate)"""
)
def block_bootstrap_auc(d: Derived) -> DataFrame:
    p = d.predictions.filter("model = 'fusion' and seed = 42").select(F.col("chr").alias("block"), F.col("pred").alias("score"), S.binary_state(F.col("truth")).alias("y"))
    return rounded(resample.auc_bootstrap(p, "block", REPLICATES))


@query(
    with_tables("leads")
    + ", blk AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i FROM (SELECT DISTINCT cluster FROM leads)), "
    + _draws_sql("blk")
    + """, x AS (SELECT replicate, effect, slope FROM draws JOIN blk USING (i) JOIN leads USING (cluster), range(0, 1000) g(g) WHERE g.g < times),
k AS (SELECT replicate, rank() OVER (PARTITION BY replicate ORDER BY effect) + (count(*) OVER (PARTITION BY replicate, effect) - 1) / 2.0::double AS a, rank() OVER (PARTITION BY replicate ORDER BY slope) + (count(*) OVER (PARTITION BY replicate, slope) - 1) / 2.0::double AS b FROM x)
SELECT cast(replicate AS int) AS replicate, round(corr(a, b), 6) AS rho FROM k GROUP BY 1"""
)
def cluster_bootstrap_rho(d: Derived) -> DataFrame:
    return rounded(resample.cluster_bootstrap_spearman(d.leads, "cluster", "effect", "slope", REPLICATES))


_STATISTICS = ("rho", "rho_abs", "concordance", "auc")


@query(
    with_tables("leads")
    + ", blk AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i FROM (SELECT DISTINCT cluster FROM leads)), "
    + _draws_sql("blk")
    + """, x AS (SELECT replicate, effect, slope FROM draws JOIN blk USING (i) JOIN leads USING (cluster), range(0, 1000) g(g) WHERE g.g < times),
k AS (SELECT replicate, effect, slope, CASE WHEN slope > 0 THEN 1 ELSE 0 END AS y, """
    + ", ".join(f"rank() OVER (PARTITION BY replicate ORDER BY {v}) + (count(*) OVER (PARTITION BY replicate, {v}) - 1) / 2.0::double AS {n}" for n, v in (("a", "effect"), ("b", "slope"), ("a2", "abs(effect)"), ("b2", "abs(slope)")))
    + f""" FROM x), s AS (SELECT replicate, corr(a, b) AS rho, corr(a2, b2) AS rho_abs, avg(CASE WHEN sign(effect) = sign(slope) THEN 1.0::double ELSE 0 END) AS concordance,
(sum(CASE WHEN y = 1 THEN a END) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))) AS auc FROM k GROUP BY 1),
u AS (UNPIVOT s ON {", ".join(_STATISTICS)} INTO NAME statistic VALUE x) SELECT statistic, count(x) AS n, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(avg(CASE WHEN x >= 0 THEN 1.0::double ELSE 0 END), 6) AS p_not_negative FROM u GROUP BY 1"""
)
def cluster_bootstrap_intervals(d: Derived) -> DataFrame:
    boot = resample.cluster_bootstrap(d.leads, "cluster", "effect", "slope", REPLICATES)
    return rounded(resample.interval(boot.unpivot(["replicate"], list(_STATISTICS), "statistic", "x"), "x", ("statistic",)))


_RUN_SUMS = "sum(abs(pred - truth)) AS e, sum((pred - truth) * (pred - truth)) AS e2, count(*) AS c"
_RUN_METRICS = "sum(times * e) / sum(times * c) AS mae, sqrt(sum(times * e2) / sum(times * c)) AS rmse"


@query(
    with_tables("predictions")
    + ", y AS (SELECT *, CASE WHEN truth > 0.5 THEN 1 ELSE 0 END AS y FROM predictions), blk AS (SELECT chr, row_number() OVER (ORDER BY chr) - 1 AS i FROM (SELECT DISTINCT chr FROM y)), "
    + _draws_sql("blk")
    + f""", every AS (SELECT replicate, i, times FROM draws UNION ALL SELECT -1, i, 1 FROM blk), per AS (SELECT seed, model, i, {_RUN_SUMS}, sum(y) AS p, sum(1 - y) AS q FROM y JOIN blk USING (chr) GROUP BY 1, 2, 3),
m AS (SELECT a.seed, a.model, ai.i AS bi, bi.i AS bj, sum(CASE WHEN a.pred > b.pred THEN 1.0::double WHEN a.pred = b.pred THEN 0.5 ELSE 0 END) AS w FROM y a JOIN blk ai ON ai.chr = a.chr JOIN y b ON b.seed = a.seed AND b.model = a.model AND a.y = 1 AND b.y = 0 JOIN blk bi ON bi.chr = b.chr GROUP BY 1, 2, 3, 4),
s AS (SELECT seed, model, replicate, {_RUN_METRICS}, cast(sum(times * p) AS double) * sum(times * q) AS pq FROM every JOIN per USING (i) GROUP BY 1, 2, 3),
t AS (SELECT seed, model, x.replicate, sum(x.times * z.times * w) AS w FROM m JOIN every x ON x.i = m.bi JOIN every z ON z.i = m.bj AND z.replicate = x.replicate GROUP BY 1, 2, 3),
g AS (SELECT s.*, w / CASE WHEN pq > 0 THEN pq END AS auc FROM s LEFT JOIN t USING (seed, model, replicate)), u AS (UNPIVOT (SELECT seed, model, replicate, mae, rmse, auc FROM g) ON mae, rmse, auc INTO NAME metric VALUE x),
dd AS (SELECT a.seed, a.model AS model_a, b.model AS model_b, a.metric, a.replicate, a.x - b.x AS x FROM u a JOIN u b ON a.seed = b.seed AND a.replicate = b.replicate AND a.metric = b.metric AND a.model < b.model)
SELECT seed, model_a, model_b, metric, round(min(x) FILTER (replicate < 0), 6) AS difference, count(x) FILTER (replicate >= 0) AS n, round(quantile_cont(x, 0.025) FILTER (replicate >= 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (replicate >= 0), 6) AS high,
round(avg(CASE WHEN x >= 0 THEN 1.0::double ELSE 0 END) FILTER (replicate >= 0), 6) AS p_not_negative FROM dd GROUP BY 1, 2, 3, 4"""
)
def paired_model_bootstrap(d: Derived) -> DataFrame:
    p = d.predictions.withColumn("y", S.binary_state(F.col("truth")))
    return rounded(resample.paired_bootstrap(p, "model", "chr", REPLICATES, keys=("seed",)))


@query(
    with_tables("leads")
    + """, x AS (SELECT r.r AS replicate, CASE WHEN r.r >= 0 AND cast('0x' || substr(md5('42|' || r.r || '|' || cluster), 1, 8) AS bigint) % 2 = 1 THEN -effect ELSE effect END AS e, slope FROM leads, range(-1, 50) r(r)),
k AS (SELECT replicate, rank() OVER (PARTITION BY replicate ORDER BY e) + (count(*) OVER (PARTITION BY replicate, e) - 1) / 2.0::double AS a, rank() OVER (PARTITION BY replicate ORDER BY slope) + (count(*) OVER (PARTITION BY replicate, slope) - 1) / 2.0::double AS b FROM x),
s AS (SELECT replicate, round(corr(a, b), 12) AS r FROM k GROUP BY 1), o AS (SELECT r AS o FROM s WHERE replicate = -1)
SELECT round(min(o), 6) AS observed, count(*) FILTER (replicate >= 0 AND abs(r) >= abs(o)) AS exceed, round((count(*) FILTER (replicate >= 0 AND abs(r) >= abs(o)) + 1) / 51.0::double, 6) AS p FROM s, o"""
)
def sign_flip_test(d: Derived) -> DataFrame:
    return rounded(resample.sign_flip_p(d.leads, "cluster", "effect", "slope", REPLICATES))


_SETS = ", m AS (SELECT lead_id, cluster AS set_id, effect AS score, CASE WHEN row_number() OVER (PARTITION BY cluster ORDER BY lead_id DESC) = 1 THEN 1 ELSE 0 END AS y FROM leads)"


def _sets(d: Derived) -> DataFrame:
    y = (F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("lead_id").desc())) == 1).cast("int")
    return d.leads.select("lead_id", F.col("cluster").alias("set_id"), F.col("effect").alias("score"), y.alias("y"))


@query(
    with_tables("leads")
    + _SETS
    + """, k AS (SELECT *, rank() OVER (ORDER BY abs(score)) + (count(*) OVER (PARTITION BY abs(score)) - 1) / 2.0::double AS r, row_number() OVER (PARTITION BY set_id ORDER BY lead_id) - 1 AS i, count(*) OVER (PARTITION BY set_id) AS n FROM m),
o AS (SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))) AS o, count(*) AS t, count(DISTINCT set_id) AS c FROM k),
s AS (SELECT p.r AS replicate, sum(k.r) AS s FROM k, range(0, 50) p(r) WHERE i = cast('0x' || substr(md5('42|' || p.r || '|' || set_id), 1, 8) AS bigint) % n GROUP BY 1), a AS (SELECT (s - c * (c + 1) / 2.0::double) / (c * (t - c)) AS a, o FROM s, o)
SELECT round(min(o), 6) AS observed, count(*) FILTER (a >= o) AS exceed, round((count(*) FILTER (a >= o) + 1) / 51.0::double, 6) AS p FROM a"""
)
def within_set_permutation(d: Derived) -> DataFrame:
    return rounded(resample.within_set_permutation_p(_sets(d), "set_id", "lead_id", REPLICATES))


@query(with_tables("leads") + _SETS + ", g AS (SELECT set_id, max(CASE WHEN y = 1 THEN abs(score) END) AS p, median(CASE WHEN y = 0 THEN abs(score) END) AS q FROM m GROUP BY 1) SELECT count(*) AS n_sets, round(avg(CASE WHEN p > q THEN 1.0::double ELSE 0 END), 6) AS win_fraction FROM g WHERE q IS NOT NULL")
def matched_set_wins(d: Derived) -> DataFrame:
    return rounded(metrics.set_wins(_sets(d), "set_id"))


# Matching -----------------------------------------------------------------------

_CAND = _CONTEXT + """, cand AS (SELECT variant_id AS uid, chr AS gene, sbs96, sbs6, titv, cpg_effect, abs("offset") AS distance, round((variant_id % 1999 - 999) / 1000.0::double, 3) AS delta FROM a WHERE "offset" NOT IN (0, 1))"""


def _candidates(d: Derived) -> DataFrame:
    t = _annotated(d).filter("offset not in (0, 1)")
    return t.select(F.col("variant_id").alias("uid"), F.col("chr").alias("gene"), "sbs96", "sbs6", "titv", "cpg_effect", F.abs("offset").alias("distance"), F.round((F.col("variant_id") % 1999 - 999) / 1000.0, 3).alias("delta"))


_TIER_SQL = [(t.name, " AND ".join([*(f"x.{f} = y.{f}" for f in t.same), f"abs(x.distance - y.distance) <= {t.within}"])) for t in matching.TIERS]


@query(
    _CAND
    + ", n AS (SELECT x.uid, "
    + ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS t{i}" for i, (_, c) in enumerate(_TIER_SQL))
    + " FROM cand x JOIN cand y ON x.cpg_effect = y.cpg_effect AND x.uid <> y.uid GROUP BY 1), w AS (SELECT c.uid, CASE "
    + " ".join(f"WHEN t{i} >= 20 THEN '{name}'" for i, (name, _) in enumerate(_TIER_SQL))
    + f" ELSE '{matching.ALL}' END AS tier FROM cand c LEFT JOIN n USING (uid)) SELECT tier, count(*) AS n FROM w GROUP BY 1"
)
def comparator_tiers(d: Derived) -> DataFrame:
    c = matching.choose_tiers(_candidates(d))
    names = F.array(*(F.lit(t.name) for t in matching.TIERS), F.lit(matching.ALL))
    return c.select(names[F.col("k")].alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("leads") + ", e AS (SELECT p.lead_id AS p, q.lead_id AS q, round(abs(p.maf - q.maf) / 0.01, 6) AS cost FROM leads p JOIN leads q ON p.chr = q.chr AND p.qval < 0.05 AND q.qval >= 0.5 AND abs(p.maf - q.maf) <= 0.01) SELECT p, q, cost FROM e")
def caliper_edges(d: Derived) -> DataFrame:
    return rounded(matching.caliper_edges(d.leads.filter("qval < 0.05"), d.leads.filter("qval >= 0.5"), 0.01))


@query(with_tables("leads") + ", m AS (SELECT cluster, max(CASE WHEN lead_id % 2 = 0 THEN maf END) AS a, max(CASE WHEN lead_id % 2 = 1 THEN maf END) AS b FROM leads GROUP BY 1) SELECT 'maf' AS feature, round(avg(a), 6) AS mean_positive, round(avg(b), 6) AS mean_negative, round(avg(a - b), 6) AS mean_difference, round(avg(a - b) / sqrt((var_samp(a) + var_samp(b)) / 2), 6) AS smd, round(median(abs(a - b)), 6) AS median_abs_difference FROM m")
def balance_table(d: Derived) -> DataFrame:
    of = lambda k: F.max(F.when(F.col("lead_id") % 2 == k, F.col("maf")))
    return rounded(metrics.balance(d.leads.groupBy("cluster").agg(of(0).alias("positive_maf"), of(1).alias("negative_maf")), ["maf"]))


# Screens and models ---------------------------------------------------------------


@query(
    with_tables("variants", "loci")
    + """, n AS (SELECT v.variant_id, count(l.probe_id) AS n_loci, string_agg(DISTINCT l.split, ',' ORDER BY l.split) AS splits FROM variants v LEFT JOIN loci l ON v.chr = l.chr AND v.pos1 - 1 - l.pos BETWEEN -499 AND 500 GROUP BY 1)
SELECT CASE WHEN variant_id % 11 = 0 THEN 'already_in_cohort' WHEN variant_id % 13 = 0 THEN 'already_in_benchmark' WHEN n_loci = 0 THEN 'no_locus_in_window' ELSE 'eligible' END AS status, count(*) AS n, cast(sum(n_loci) AS bigint) AS n_loci, count(DISTINCT splits) AS n_split_sets FROM n GROUP BY 1"""
)
def exclusion_prescreen(d: Derived) -> DataFrame:
    v = d.variants.withColumn("pos", F.col("pos1") - 1)
    near = intervals.window_join(v, d.loci, -499, 500).groupBy("variant_id").agg(F.count(F.lit(1)).alias("n_loci"), F.array_join(F.array_sort(F.collect_set("o_split")), ",").alias("splits"))
    cohort_ids = d.variants.filter("variant_id % 11 = 0").select("variant_id", F.lit(True).alias("in_cohort"))
    bench = d.variants.filter("variant_id % 13 = 0").select("variant_id", F.lit(True).alias("in_bench"))
    t = d.variants.join(near, "variant_id", "left").join(cohort_ids, "variant_id", "left").join(bench, "variant_id", "left")
    n = F.coalesce("n_loci", F.lit(0))
    status = F.when(F.col("in_cohort"), "already_in_cohort").when(F.col("in_bench"), "already_in_benchmark").when(n == 0, "no_locus_in_window").otherwise("eligible")
    return t.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("n_loci"), F.countDistinct("splits").alias("n_split_sets"))


@query(
    with_tables("variants", "loci")
    + """, p AS (SELECT v.variant_id, l.probe_id, l.split, abs(v.pos1 - 1 - l.pos) AS dist, (v.variant_id + l.part_key) % 7 = 0 AS ext, round(((v.variant_id * 31 + l.part_key) % 1000) / 1000.0::double, 3) AS effect FROM variants v JOIN loci l ON v.chr = l.chr AND v.pos1 - 1 - l.pos BETWEEN -499 AND 500 AND v.pos1 - 1 - l.pos NOT IN (0, 1)),
q AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY dist, probe_id) = 1 AS nearest, bool_or(ext) OVER (PARTITION BY variant_id) AS has_ext FROM p), s AS (SELECT *, CASE WHEN split = 'test' AND ext THEN '1_heldout_test_plus_external_breast_mQTL' WHEN split = 'test' THEN '2_heldout_test_exploratory' WHEN split = 'val' THEN '3_validation_split_exploratory' ELSE '4_training_split_illustration_only' END AS tier FROM q WHERE CASE WHEN has_ext THEN ext ELSE nearest END)
SELECT variant_id, probe_id, tier, effect, row_number() OVER (PARTITION BY tier ORDER BY effect DESC, variant_id, probe_id) AS rank_in_tier FROM s"""
)
def literature_screen(d: Derived) -> DataFrame:
    v = d.variants.withColumn("pos", F.col("pos1") - 1)

    def pairs(points: DataFrame) -> DataFrame:
        p = intervals.window_join(points, d.loci, -499, 500).withColumn("off", F.col("pos") - F.col("o_pos")).filter("off not in (0, 1)")
        return p.withColumns({"ext": (F.col("variant_id") + F.col("o_part_key")) % 7 == 0, "mills": (F.col("variant_id") * 31 + F.col("o_part_key")) % 1000, "dist": F.abs("off")})

    # pairs are neither shuffled nor sorted by variant: numbers alone are kept of a variant's, and the nearest are looked up for the variants without external ones
    p, x = pairs(v), ("o_probe_id", "o_split", "ext", "mills")
    alone = p.groupBy("variant_id").agg(F.min("dist").alias("least"), F.bool_or("ext").alias("has_ext")).filter("not has_ext").select("variant_id", "least")
    nearest = pairs(v.join(alone, "variant_id")).filter("dist = least").groupBy("variant_id").agg(F.min(F.struct(*x)).alias("m"))
    q = p.filter("ext").select("variant_id", *x).unionByName(nearest.select("variant_id", "m.*"))
    t = q.withColumn("tier", S.selection_tier(F.col("o_split"), F.col("ext")))
    # a group has one of a thousand effects and 2**20 variants or so
    ends = d.table("orders").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, ((ends.high or 0) - (ends.low or 0) + 1) * 2**20 // max(ends.n, 2**20))
    # a window is 1,000 of 22 million bases and a seventh of pairs is external: parts of about a million rows, which a task sorts in memory
    parts = ends.n * d.table("part").count() // 154_000 >> 20
    few = int(d.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = t.select("variant_id", F.col("o_probe_id").alias("probe_id"), "tier", "mills", F.floor(F.col("variant_id") / width).alias("part_"))
    ranked = ranks.number_in(rows, ["tier"], [-F.col("mills"), F.col("variant_id"), F.col("probe_id")], "rank_in_tier", {"mills": F.col("mills").desc(), "part_": F.col("part_")}, parts if parts > few else None)
    return ranked.select("variant_id", "probe_id", "tier", F.round(F.col("mills") / 1000.0, 3).alias("effect"), *(c for c in ranked.columns if c == "rank_in_tier"))


@query(with_tables("leads") + " SELECT lead_id, chr, maf FROM leads WHERE qval < 0.05 AND lead_id IN (SELECT o_custkey FROM orders)")
def external_hits(d: Derived) -> DataFrame:
    return d.leads.filter("qval < 0.05").join(d.table("orders").select(F.col("o_custkey").alias("lead_id")), "lead_id", "left_semi").select("lead_id", "chr", "maf")


def _cg_scorer(b):
    """A stand-in model: the share of C and G, and of CG pairs."""
    import pandas as pd

    gc = b["seq"].str.count("[CG]") / b["seq"].str.len()
    m = 4 * gc - 2 - b["seq"].str.count("CG") / 10 + b["seq"].str.slice(0, 50).str.count("A") / 100
    beta = 1 / (1 + 2.0**-m)
    return pd.DataFrame({"m": m, "beta": beta, "prob": beta})


@query()
def counterfactual_scores(d: Derived) -> DataFrame:
    return rounded(ml.counterfactual(d.in_window.select("variant_id", "wt", "mut"), _cg_scorer, "variant_id"), 9)


@query()
def label_classifier(d: Derived) -> DataFrame:
    e = d.table("embeddings").withColumn("y", (F.col("label") > 0).cast("int"))
    scored = ml.classify(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding", "y")
    return rounded(scored.select("vec_id", "y", "prob"), 9)


@query()
def fusion_model(d: Derived) -> DataFrame:
    """Held-out errors of the context, sequence and fusion fits."""
    t = d.loci.join(metrics.probe_medians(d.normals), "part_key").withColumns({"gc": F.length(F.translate("seq", "AT", "")) / 100.0, "depth": F.col("n_observed").cast("double")})
    model = ml.fit_fusion(t.filter("split = 'train'"), ["gc", "depth"])
    scored = model.transform(ml.kmers(t.filter("split <> 'train'"), "seq"))
    return rounded(scored.groupBy("split").agg(*(F.avg(F.abs(S.m_to_beta(F.col(f"m_{m}")) - F.col("beta"))).alias(f"mae_{m}") for m in ("context", "sequence", "fusion")), F.count(F.lit(1)).alias("n")))


# Comparisons and reports -----------------------------------------------------------

_ENSEMBLES = ", e AS (SELECT part_key, model, avg(pred) - min(truth) AS x FROM predictions GROUP BY 1, 2), w AS (SELECT part_key, max(CASE WHEN model = 'sequence' THEN x END) AS a, max(CASE WHEN model = 'fusion' THEN x END) AS b FROM e GROUP BY 1)"


def _ensembles(d: Derived) -> DataFrame:
    e = d.predictions.groupBy("part_key", "model").agg((F.avg("pred") - F.min("truth")).alias("x")).filter("model <> 'context'")
    of = lambda m: F.round(F.max(F.when(F.col("model") == m, F.col("x"))) + NUDGE, 6)
    return e.groupBy("part_key").agg(of("sequence").alias("a"), of("fusion").alias("b"))


@query(
    with_tables("predictions")
    + _ENSEMBLES
    + """, v AS (SELECT part_key, round(a, 6) AS a, round(b, 6) AS b FROM w), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::double AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::double AS rb,
rank() OVER (ORDER BY abs(a)) + (count(*) OVER (PARTITION BY abs(a)) - 1) / 2.0::double AS qa, rank() OVER (ORDER BY abs(b)) + (count(*) OVER (PARTITION BY abs(b)) - 1) / 2.0::double AS qb FROM v)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS signed_rho, round(corr(qa, qb), 6) AS absolute_rho, round(avg(CASE WHEN sign(a) = sign(b) THEN 1.0::double ELSE 0 END), 6) AS sign_agreement, round(avg(abs(qa - qb)), 6) AS mean_rank_change, round(max(abs(qa - qb)), 6) AS max_rank_change FROM k"""
)
def model_comparison(d: Derived) -> DataFrame:
    t = _ensembles(d)
    for column, by, name in (("a", F.col("a"), "ra"), ("b", F.col("b"), "rb"), ("a", F.abs("a"), "qa"), ("b", F.abs("b"), "qb")):
        t = ranks.global_average_rank(t.withColumn("by_", by), "by_", name).drop("by_")
    change = F.abs(F.col("qa") - F.col("qb"))
    return rounded(t.agg(F.count(F.lit(1)).alias("n"), metrics.guarded_corr(F.col("ra"), F.col("rb")).alias("signed_rho"), metrics.guarded_corr(F.col("qa"), F.col("qb")).alias("absolute_rho"), metrics.concordance(F.col("a"), F.col("b"))[0].alias("sign_agreement"), F.avg(change).alias("mean_rank_change"), F.max(change).alias("max_rank_change")))


@query(
    with_tables("leads")
    + f""", b AS (SELECT CASE WHEN dist <= 50 THEN '0-50' WHEN dist <= 100 THEN '51-100' WHEN dist <= 250 THEN '101-250' ELSE '251-500' END AS bin, effect, slope FROM (SELECT *, {h_sql("lead_id", "dist")} % 500 AS dist FROM leads)),
k AS (SELECT *, """
    + ", ".join(f"rank() OVER (PARTITION BY bin ORDER BY {v}) + (count(*) OVER (PARTITION BY bin, {v}) - 1) / 2.0::double AS {n}" for n, v in (("a", "effect"), ("b", "slope"), ("a2", "abs(effect)"), ("b2", "abs(slope)")))
    + """ FROM b) SELECT bin, count(*) AS n, round(corr(a, b), 6) AS rho, round(corr(a2, b2), 6) AS rho_abs, round(avg(CASE WHEN sign(effect) = sign(slope) THEN 1.0::double ELSE 0 END), 6) AS concordance, round(avg(abs(effect)), 6) AS mean_abs,
round(median(abs(effect)), 6) AS median_abs, round(avg(CASE WHEN effect > 0 THEN 1.0::double ELSE 0 END), 6) AS positive_fraction FROM k GROUP BY 1"""
)
def lead_response_by_distance(d: Derived) -> DataFrame:
    """Predicted effects against observed slopes by the distance of variant and locus."""
    return rounded(metrics.response(d.leads.withColumn("bin", S.distance_bin(h(F.col("lead_id"), "dist") % 500)), ["bin"], "effect", "slope"))


@query(
    _CAND
    + """, b AS (SELECT CASE WHEN distance <= 12 THEN '0-12' WHEN distance <= 25 THEN '13-25' ELSE '26-50' END AS bin, cpg_effect, delta FROM cand) SELECT bin, cpg_effect, count(*) AS n, round(avg(abs(delta)), 6) AS mean_abs, round(median(abs(delta)), 6) AS median_abs, round(avg(CASE WHEN delta > 0 THEN 1.0::double ELSE 0 END), 6) AS positive_fraction FROM b GROUP BY 1, 2"""
)
def response_by_distance(d: Derived) -> DataFrame:
    b = F.when(F.col("distance") <= 12, "0-12").when(F.col("distance") <= 25, "13-25").otherwise("26-50")
    return rounded(_candidates(d).groupBy(b.alias("bin"), "cpg_effect").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("delta")).alias("mean_abs"), F.median(F.abs("delta")).alias("median_abs"), F.avg((F.col("delta") > 0).cast("double")).alias("positive_fraction")))


@query(
    with_tables("leads")
    + """, k AS (SELECT lead_id, round(100.0::double * (rank() OVER (ORDER BY effect) + (count(*) OVER (PARTITION BY effect) - 1) / 2.0::double - 1) / (count(*) OVER () - 1), 6) AS x, round(100.0::double * (rank() OVER (ORDER BY slope) + (count(*) OVER (PARTITION BY slope) - 1) / 2.0::double - 1) / (count(*) OVER () - 1), 6) AS y, sign(effect) = sign(slope) AS concordant, effect, slope FROM leads)
SELECT lead_id, x, y, concordant, round((SELECT coalesce((max(CASE WHEN effect < 0 THEN x END) + min(CASE WHEN effect > 0 THEN x END)) / 2, 50) FROM k), 6) AS x_zero, round((SELECT coalesce((max(CASE WHEN slope < 0 THEN y END) + min(CASE WHEN slope > 0 THEN y END)) / 2, 50) FROM k), 6) AS y_zero FROM k"""
)
def rank_scatter(d: Derived) -> DataFrame:
    n = d.leads.agg(F.count(F.lit(1)).alias("n_"))
    t = ranks.global_average_rank(ranks.global_average_rank(d.leads.select("lead_id", "effect", "slope"), "effect", "rx_"), "slope", "ry_").crossJoin(F.broadcast(n))
    t = t.withColumns({k: r6(ranks.percentile_rank(F.col(f"r{k}_"), F.col("n_"))) for k in "xy"})
    zero = t.agg(r6(ranks.zero_boundary(F.col("effect"), F.col("x"))).alias("x_zero"), r6(ranks.zero_boundary(F.col("slope"), F.col("y"))).alias("y_zero"))
    return t.crossJoin(F.broadcast(zero)).select("lead_id", "x", "y", (F.signum("effect") == F.signum("slope")).alias("concordant"), "x_zero", "y_zero")


@query(
    with_tables("variants", "loci")
    + """, p AS (SELECT DISTINCT v.chr, v.pos1, v.ref, v.alt, v.variant_id % 5 = 0 AS marked FROM variants v), n AS (SELECT chr, count(DISTINCT probe_id) AS n_loci FROM loci GROUP BY 1) SELECT chr, count(*) AS n_screened, count(*) FILTER (marked) AS n_marked, min(pos1) AS first_pos, max(pos1) AS last_pos, min(n_loci) AS n_loci FROM p LEFT JOIN n USING (chr) GROUP BY 1"""
)
def screened_pool(d: Derived) -> DataFrame:
    p = d.variants.select("chr", "pos1", "ref", "alt", (F.col("variant_id") % 5 == 0).alias("marked")).distinct()
    n = d.loci.groupBy("chr").agg(F.countDistinct("probe_id").alias("n_loci"))
    s = p.groupBy("chr").agg(F.count(F.lit(1)).alias("n_screened"), F.count(F.when(F.col("marked"), 1)).alias("n_marked"), F.min("pos1").alias("first_pos"), F.max("pos1").alias("last_pos"))
    return s.join(n, "chr", "left").select("chr", "n_screened", "n_marked", "first_pos", "last_pos", "n_loci")


FLAGSHIP = "locus_table"


from . import backgrounds, chains, eligibility, files, tables  # noqa: E402,F401  they register more queries
