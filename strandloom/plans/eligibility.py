"""Queries of checked joins, eligibility and whole reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, checked, cohort, intervals, metrics, ranks, resample
from .derived import Derived, with_tables
from .queries import REPLICATES, _draws_sql, query, rounded
from .tables import _WIDE, _both, _planted, _planted_sql, _rules_sql, wide_loci


@query(with_tables("loci") + " SELECT probe_id, chr, pos, p_size > 25 AS mask FROM loci JOIN part ON p_partkey = part_key WHERE p_size <= 25")
def masked_loci(d: Derived) -> DataFrame:
    masks = d.table("part").select(F.col("p_partkey").alias("part_key"), (F.col("p_size") > 25).alias("mask"))
    return checked.masked_out(d.loci, masks, "part_key", "mask").select("probe_id", "chr", "pos", "mask")


@query("SELECT o_orderkey, o_custkey, c_nationkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def complete_lookups(d: Derived) -> DataFrame:
    """Each order has its customer and each customer its nation, or the job fails."""
    orders = d.table("orders").select("o_orderkey", "o_custkey")
    customers = d.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = d.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return checked.complete(checked.complete(orders, customers, ["o_custkey"]), nations, ["c_nationkey"])


@query(with_tables("loci") + ", t AS (SELECT l_partkey AS part_key, count(*) AS n FROM lineitem GROUP BY 1) SELECT probe_id, n FROM loci JOIN t USING (part_key)")
def one_to_one_targets(d: Derived) -> DataFrame:
    t = d.table("lineitem").groupBy(F.col("l_partkey").alias("part_key")).agg(F.count(F.lit(1)).alias("n"))
    return checked.one_to_one(d.loci.select("part_key", "probe_id"), t, ["part_key"]).select("probe_id", "n")


_HOLES = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'infinity'::double ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind FROM events"


@query(
    f"""WITH t AS ({_HOLES}) SELECT 'value' AS "column", count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS n_null, count(*) AS n_rows, count(*) FILTER (isfinite(value) AND kind IS NOT NULL) AS n_kept FROM t
UNION ALL SELECT 'kind', count(*) FILTER (kind IS NULL), count(*), count(*) FILTER (isfinite(value) AND kind IS NOT NULL) FROM t"""
)
def null_report(d: Derived) -> DataFrame:
    k = F.col("event_id")
    t = d.table("events").select("event_id", F.when((k % 5 != 0) & (k % 11 == 0), float("inf")).when(k % 5 != 0, F.col("value")).alias("value"), F.when(k % 7 != 0, F.col("event_type")).alias("kind"))
    return checked.null_report(t, ["value", "kind"])


@query(f"WITH t AS ({_HOLES}) SELECT event_id, value, kind FROM t WHERE isfinite(value) AND kind IS NOT NULL")
def rows_without_nulls(d: Derived) -> DataFrame:
    k = F.col("event_id")
    t = d.table("events").select("event_id", F.when((k % 5 != 0) & (k % 11 == 0), float("inf")).when(k % 5 != 0, F.col("value")).alias("value"), F.when(k % 7 != 0, F.col("event_type")).alias("kind"))
    return checked.without_nulls(t, ["value", "kind"])


@query(with_tables("variants") + " SELECT variant_id, CASE WHEN variant_id % 3 = 0 THEN 'rs' || variant_id WHEN variant_id % 3 = 1 THEN 'c' || variant_id ELSE chr || '|' || pos1 || '|' || ref || '|' || alt END AS id FROM variants")
def synthesised_ids(d: Derived) -> DataFrame:
    k = F.col("variant_id")
    v = d.variants.withColumns({"rs": F.when(k % 3 == 0, F.concat(F.lit("rs"), k)).otherwise(" "), "candidate": F.when(k % 3 == 1, F.concat(F.lit("c"), k))})
    return checked.with_id(v, ["name", "rs", "candidate"], ["chr", "pos1", "ref", "alt"]).select("variant_id", "id")


_LEAD_ROWS = (
    with_tables("leads", "loci")
    + _WIDE
    + """, x AS (SELECT lead_id, qval, w.chr AS lchr, w.pos, w.part_key, w.dna_5000, CASE WHEN lead_id % 17 = 0 THEN 'chr23' ELSE w.chr END AS vchr, lead_id % 1200 - 600 AS off, p_size > 45 AS mask FROM leads
  JOIN wide w ON w.part_key = lead_id % (SELECT count(*) FROM part) JOIN part ON p_partkey = w.part_key),
y AS (SELECT *, translate(substr(dna_5000, cast(2500 + off AS bigint), 1), CASE WHEN lead_id % 19 = 0 THEN 'ACGT' ELSE '' END, CASE WHEN lead_id % 19 = 0 THEN 'CGTA' ELSE '' END) AS ref FROM x)"""
)


@query(
    _LEAD_ROWS
    + """, r AS (SELECT CASE WHEN lead_id % 23 = 0 OR pos + off + 1 < 0 THEN 'unparsable_id' WHEN vchr <> lchr THEN 'other_chromosome' WHEN NOT off BETWEEN -499 AND 500 THEN 'outside_window' WHEN off IN (0, 1) THEN 'protected'
  WHEN ref <> substr(dna_5000, cast(2500 + off AS bigint), 1) THEN 'reference_mismatch' WHEN qval >= 0.05 AND qval < 0.5 THEN 'unclear_association' WHEN mask THEN 'masked_probe' WHEN off BETWEEN -(part_key % 50) AND 2 THEN 'in_probe_span' ELSE 'kept' END AS reason,
  CASE WHEN qval < 0.05 THEN 'significant' WHEN qval >= 0.5 THEN 'nonsignificant' END AS q_class FROM y) SELECT reason, count(*) AS n, count(*) FILTER (q_class = 'significant') AS n_significant FROM r GROUP BY 1"""
)
def lead_eligibility(d: Derived) -> DataFrame:
    """Leads by their identifiers, against the locus they were tested with: the first reason against each."""
    n = d.table("part").agg(F.count(F.lit(1)).alias("n_"))
    k, wrong = F.col("lead_id"), F.col("lead_id") % 19 == 0
    loci = wide_loci(d).join(d.loci.select("probe_id", "part_key"), "probe_id")
    masks = d.table("part").select(F.col("p_partkey").alias("part_key"), (F.col("p_size") > 45).alias("mask"))
    at = d.leads.drop("chr").crossJoin(F.broadcast(n)).withColumn("part_key", k % F.col("n_")).join(loci, "part_key").withColumn("off_", k % 1200 - 600)
    base = F.substring("dna_5000", (2500 + F.col("off_")).cast("int"), F.lit(1))
    ref = F.when(wrong, F.translate(base, "ACGT", "CGTA")).otherwise(base)
    name = F.when(k % 23 == 0, F.concat(F.lit("lead"), k)).otherwise(F.concat_ws("_", F.when(k % 17 == 0, "chr23").otherwise(F.col("chr")), (F.col("pos") + F.col("off_") + 1).cast("string"), ref, F.lit("T"), F.lit("b38")))
    v = checked.complete(at.withColumn("variant", name), masks, ["part_key"]).withColumn("v", S.variant_id_fields(F.col("variant")))
    off = F.col("v.pos1") - 1 - F.col("pos")
    span = intervals.span_overlap(F.col("v.pos1") - 1, F.col("pos") - F.col("part_key") % 50, F.col("pos") + 2)
    reasons = [
        ("unparsable_id", F.col("v.pos1").isNull()),
        ("other_chromosome", F.col("v.chr") != F.col("chr")),
        ("outside_window", ~off.between(-499, 500)),
        ("protected", off.isin(0, 1)),
        ("reference_mismatch", F.col("v.ref") != F.substring("dna_5000", (2500 + off).cast("int"), F.lit(1))),
        ("unclear_association", S.q_class(F.col("qval")).isNull()),
        ("masked_probe", F.col("mask")),
        ("in_probe_span", span["closed"]),
    ]
    told = v.withColumns({"reason": F.coalesce(cohort.first_reason(reasons), F.lit("kept")), "q_class": S.q_class(F.col("qval"))})
    return told.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q_class") == "significant", 1)).alias("n_significant"))


BENCHMARK_FAULTS = {
    "qval": {1: "cast(2 as double)", 2: "NULL"},
    "slope": {3: "cast(0 as double)", 4: "NULL"},
    "maf": {5: "cast(0.7 as double)"},
    "pos0": {6: "pos0 + 1", 7: "NULL"},
    "pos1": {8: "pos1 + 0.5"},
    "offset_": {9: "offset_ + 1", 10: "2000"},
    "chr": {11: "'chrM'"},
    "split": {12: "'hold'", 13: "'val'"},
    "flag": {14: "2"},
    "ref": {15: "'N'", 16: "alt"},
    "alt": {17: "NULL"},
    "probe_id": {18: "''"},
    "lead_id": {},
    "locus_pos": {19: "-1"},
}
_BENCHMARK_RULES = {
    "duplicate_id": ("error", "n_same_ > 1"),
    "q_finite": ("error", "qval IS NULL OR isnan(qval)"),
    "q_range": ("error", "NOT qval BETWEEN 0 AND 1"),
    "not_significant": ("error", "qval >= 0.05"),
    "slope_finite": ("error", "slope IS NULL OR isnan(slope)"),
    "slope_zero": ("error", "slope = 0"),
    "maf_range": ("error", "NOT maf BETWEEN 0 AND 0.5"),
    "places_missing": ("error", "pos0 IS NULL OR pos1 IS NULL OR locus_pos IS NULL OR offset_ IS NULL"),
    "places_integral": ("error", "pos0 <> floor(pos0) OR pos1 <> floor(pos1)"),
    "place_negative": ("error", "locus_pos < 0"),
    "pos0_of_pos1": ("error", "pos0 <> pos1 - 1"),
    "offset_of_places": ("error", "offset_ <> pos0 - locus_pos"),
    "outside_window": ("error", "NOT offset_ BETWEEN -499 AND 500"),
    "protected_pair": ("error", "offset_ IN (0, 1)"),
    "chromosome": ("error", "NOT regexp_full_match(chr, 'chr([1-9]|1[0-9]|2[0-2]|X|Y)')"),
    "split_label": ("error", "split NOT IN ('train', 'val', 'test')"),
    "split_of_chromosome": ("error", "split <> CASE WHEN chr IN ('chr8', 'chr9') THEN 'test' WHEN chr IN ('chr10', 'chr11') THEN 'val' ELSE 'train' END"),
    "flag_binary": ("error", "flag NOT IN (0, 1)"),
    "alleles": ("error", "NOT (ref IN ('A', 'C', 'G', 'T') AND alt IN ('A', 'C', 'G', 'T')) OR ref = alt"),
    "locus_missing": ("error", "probe_id = ''"),
}
_BENCH = (
    with_tables("leads", "loci")
    + """, made AS (SELECT lead_id, qval / 20 AS qval, slope, maf, l.chr, l.split, l.probe_id, cast(l.pos AS double) AS locus_pos, cast(lead_id % 998 - 498 AS double) AS offset_, cast(l.pos + lead_id % 998 - 498 AS double) AS pos0, cast(l.pos + lead_id % 998 - 497 AS double) AS pos1, cast(lead_id % 2 AS int) AS flag, 'A' AS ref, 'G' AS alt FROM leads JOIN loci l ON l.part_key = lead_id % (SELECT count(*) FROM part))"""
    + _planted_sql("made", "lead_id", {k: v for k, v in BENCHMARK_FAULTS.items() if v}, 41, 20, 21, "bad")
    + ", told AS (SELECT *, count(*) OVER (PARTITION BY lead_id) AS n_same_ FROM bad)"
)


def _benchmark(d: Derived) -> DataFrame:
    n = d.table("part").agg(F.count(F.lit(1)).alias("n_"))
    k = F.col("lead_id")
    at = d.leads.drop("chr").crossJoin(F.broadcast(n)).withColumn("part_key", k % F.col("n_")).join(d.loci.select("part_key", "chr", "split", "probe_id", F.col("pos").cast("double").alias("locus_pos")), "part_key")
    off = (k % 998 - 498).cast("double")
    made = at.select("lead_id", (F.col("qval") / 20).alias("qval"), "slope", "maf", "chr", "split", "probe_id", "locus_pos", off.alias("offset_"), (F.col("locus_pos") + off).alias("pos0"), (F.col("locus_pos") + off + 1).alias("pos1"), (k % 2).cast("int").alias("flag"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    return _planted(made, k, _both({c: f for c, f in BENCHMARK_FAULTS.items() if f}), 41, 20, 21)


@query(_BENCH + _rules_sql(_BENCHMARK_RULES, "told"))
def benchmark_rules(d: Derived) -> DataFrame:
    t = audit.with_uniqueness(_benchmark(d), "lead_id")
    return audit.rule_totals(t, audit.benchmark_rules(), "lead_id").drop("examples")


@query(_BENCH + f", rr AS ({_rules_sql(_BENCHMARK_RULES, 'told')}) SELECT cast(sum(n) AS bigint) AS n_errors, 0::bigint AS n_warnings, CASE WHEN sum(n) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM rr")
def benchmark_verdict(d: Derived) -> DataFrame:
    t = audit.with_uniqueness(_benchmark(d), "lead_id")
    return audit.verdict(audit.rule_totals(t, audit.benchmark_rules(), "lead_id"))


@query(
    with_tables("predictions")
    + """, k AS (SELECT part_key, rank() OVER (PARTITION BY seed, model ORDER BY abs(pred - truth) DESC) AS r, pred - truth AS x FROM predictions), c AS (SELECT part_key, count(*) AS n_runs, round(avg(r), 6) AS mean_rank, round(avg(CASE WHEN r <= 20 THEN 1.0::double ELSE 0 END), 6) AS top20_frequency, round(avg(x), 6) AS mean_effect,
  round(CASE WHEN count(*) FILTER (x <> 0) = 0 THEN 1 ELSE greatest(count(*) FILTER (x > 0), count(*) FILTER (x < 0)) / cast(count(*) FILTER (x <> 0) AS double) END, 6) AS sign_consistency FROM k GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY abs(mean_effect) DESC, sign_consistency DESC, part_key) AS consensus_rank FROM c"""
)
def run_consensus(d: Derived) -> DataFrame:
    """All candidates over all runs: the largest absolute mean effect first, then the steadier sign."""
    x = F.col("pred") - F.col("truth")
    c = metrics.consensus(d.predictions.select("part_key", F.concat_ws("-", F.col("seed").cast("string"), "model").alias("run"), x.alias("x")), "part_key", "run", "x", 20)
    c = rounded(c)
    return ranks.running(c, [-F.abs("mean_effect"), -F.col("sign_consistency"), F.col("part_key")], {"consensus_rank": F.lit(1)})


@query(
    with_tables("leads")
    + """, y AS (SELECT *, CASE WHEN qval < 0.05 THEN 1 ELSE 0 END AS y FROM leads), o AS (SELECT DISTINCT cluster AS left_out FROM leads),
k AS (SELECT left_out, effect, slope, y, rank() OVER (PARTITION BY left_out ORDER BY effect) + (count(*) OVER (PARTITION BY left_out, effect) - 1) / 2.0::double AS a, rank() OVER (PARTITION BY left_out ORDER BY slope) + (count(*) OVER (PARTITION BY left_out, slope) - 1) / 2.0::double AS b,
  rank() OVER (PARTITION BY left_out ORDER BY abs(effect)) + (count(*) OVER (PARTITION BY left_out, abs(effect)) - 1) / 2.0::double AS r FROM o JOIN y ON cluster <> left_out),
m AS (SELECT left_out, corr(a, b) AS rho, avg(CASE WHEN sign(effect) = sign(slope) THEN 1.0::double ELSE 0 END) AS concordance, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y))) AS auc FROM k GROUP BY 1)
SELECT count(*) AS n_left_out, round(min(rho), 6) AS worst_rho, round(max(rho), 6) AS best_rho, round(min(concordance), 6) AS worst_concordance, round(max(concordance), 6) AS best_concordance, round(min(auc), 6) AS worst_auc, round(max(auc), 6) AS best_auc FROM m"""
)
def leave_one_out_extremes(d: Derived) -> DataFrame:
    t = d.leads.withColumn("y", (F.col("qval") < 0.05).cast("int"))
    return rounded(resample.leave_one_out_metrics(t, "cluster", "effect", "slope", "y"))


_SETS_SQL = ", m AS (SELECT lead_id, cluster AS set_id, effect AS score, CASE WHEN row_number() OVER (PARTITION BY cluster ORDER BY lead_id DESC) = 1 THEN 1 ELSE 0 END AS y FROM leads)"


def _sets(d: Derived) -> DataFrame:
    last = F.max("lead_id").over(Window.partitionBy("cluster"))
    return d.leads.select("lead_id", F.col("cluster").alias("set_id"), F.col("effect").alias("score"), (F.col("lead_id") == last).cast("int").alias("y"))


@query(
    with_tables("leads")
    + _SETS_SQL
    + ", blk AS (SELECT set_id, max(CASE WHEN y = 1 THEN abs(score) END) AS top, median(CASE WHEN y = 0 THEN abs(score) END) AS mid, row_number() OVER (ORDER BY set_id) - 1 AS i FROM m GROUP BY 1), "
    + _draws_sql("blk")
    + """, v AS (SELECT replicate, abs(score) AS a, cast(sum(times * y) AS double) AS p, cast(sum(times * (1 - y)) AS double) AS q FROM draws JOIN blk USING (i) JOIN m USING (set_id) GROUP BY 1, 2),
u AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM v WINDOW w AS (PARTITION BY replicate ORDER BY a DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT replicate, sum(q * (tp - p / 2)) / (sum(p) * sum(q)) AS auc, sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / sum(p) AS ap FROM u GROUP BY 1),
z AS (SELECT replicate, sum(CASE WHEN top > mid THEN times ELSE 0 END) / cast(sum(CASE WHEN mid IS NOT NULL THEN times END) AS double) AS wins FROM draws JOIN blk USING (i) GROUP BY 1)
SELECT metric, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, count(*) AS n FROM (SELECT 'auc' AS metric, auc AS x FROM s UNION ALL SELECT 'ap', ap FROM s UNION ALL SELECT 'wins', wins FROM z) GROUP BY 1"""
)
def set_bootstrap_intervals(d: Derived) -> DataFrame:
    """Intervals of 95 % of the three metrics over matched sets."""
    long_ = resample.set_bootstrap(_sets(d), "set_id", REPLICATES).unpivot(["replicate"], ["auc", "ap", "wins"], "metric", "x")
    return rounded(long_.groupBy("metric").agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"), F.count("x").alias("n")))


@query(
    with_tables("leads")
    + _SETS_SQL
    + """, k AS (SELECT set_id, y, abs(score) AS a, row_number() OVER (PARTITION BY set_id ORDER BY lead_id) - 1 AS i, count(*) OVER (PARTITION BY set_id) AS n FROM m),
c AS (SELECT r.r AS replicate, set_id, i, a FROM k, range(0, 50) r(r) WHERE i = cast('0x' || substr(md5('42|' || r.r || '|' || set_id), 1, 8) AS bigint) % n UNION ALL SELECT -1, set_id, i, a FROM k WHERE y = 1),
g AS (SELECT replicate, a, cast(count(*) AS double) AS p FROM c GROUP BY 1, 2), v AS (SELECT a, sum(count(*)) OVER (ORDER BY a DESC) AS above FROM k GROUP BY 1),
t AS (SELECT replicate, p, sum(p) OVER (PARTITION BY replicate ORDER BY a DESC ROWS UNBOUNDED PRECEDING) AS tp, above FROM g JOIN v USING (a)),
s AS (SELECT replicate, round(sum(p * tp / cast(above AS double)) / sum(p), 12) AS ap FROM t GROUP BY 1), o AS (SELECT ap AS o FROM s WHERE replicate = -1)
SELECT round(min(o), 6) AS observed, count(*) FILTER (replicate >= 0 AND ap >= o) AS exceed, round((count(*) FILTER (replicate >= 0 AND ap >= o) + 1) / 51.0::double, 6) AS p FROM s, o"""
)
def within_set_permutation_ap(d: Derived) -> DataFrame:
    return rounded(resample.within_set_permutation_ap(_sets(d), "set_id", "lead_id", REPLICATES))


@query(
    """WITH t AS (SELECT p_partkey AS k, ['G' || p_partkey % 5, 'G' || p_partkey % 3, 'L' || p_partkey % 2, 'G' || p_partkey % 5, 'G' || p_partkey % 7] AS names FROM part), u AS (SELECT k, unnest(names) AS name, unnest(range(5)) AS nth FROM t),
d AS (SELECT k, name, min(nth) AS nth FROM u GROUP BY 1, 2) SELECT k, string_agg(name, ',' ORDER BY nth) AS symbols FROM d GROUP BY 1"""
)
def gene_symbol_lists(d: Derived) -> DataFrame:
    k = F.col("p_partkey")
    g = lambda n, tag="G": F.concat(F.lit(tag), k % n)
    names = S.gene_symbols(F.array(g(5), g(3)), F.concat(F.lit("NM_1("), g(7), F.lit("):c.1A>G")), F.array(g(2, "L"), g(5)))
    return d.table("part").select(k.alias("k"), F.array_join(names, ",").alias("symbols"))


@query(
    with_tables("normals")
    + """, a AS (SELECT part_key, median(beta) AS x FROM normals GROUP BY 1), p AS (SELECT part_key, participant, median(beta) AS b FROM normals GROUP BY 1, 2), b AS (SELECT part_key, median(b) AS y FROM p GROUP BY 1),
e AS (SELECT part_key, round(abs(x - y), 6) AS difference FROM a JOIN b USING (part_key)) SELECT part_key, difference FROM e ORDER BY difference DESC, part_key LIMIT 100"""
)
def most_sensitive_loci(d: Derived) -> DataFrame:
    """The report's hundred loci whose medians over samples and over participants differ most."""
    j = metrics.probe_medians(d.normals).select("part_key", F.col("beta").alias("x")).join(metrics.participant_medians(d.normals).withColumnRenamed("beta", "y"), "part_key")
    e = rounded(j.select("part_key", F.abs(F.col("x") - F.col("y")).alias("difference")))
    return ranks.top_k(e, 100, F.col("difference"), "part_key")


def _m(x: str) -> str:
    return f"log2(least(greatest({x}, 0.0001), 0.9999) / (1 - least(greatest({x}, 0.0001), 0.9999)))"


@query(
    with_tables("predictions")
    + f", e AS (SELECT model, seed, split, {_m('pred')} AS p, {_m('truth')} AS t FROM predictions) SELECT model, seed, split, count(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(p - t), 6) AS mean_signed, round(median(abs(p - t)), 6) AS median_abs FROM e GROUP BY 1, 2, 3"
)
def model_errors_m_scale(d: Derived) -> DataFrame:
    """Errors of each run and split on the scale of M values."""
    return rounded(metrics.error_metrics(d.predictions, ["model", "seed", "split"], S.beta_to_m(F.col("pred")), S.beta_to_m(F.col("truth"))))


@query(
    with_tables("predictions")
    + """, w AS (SELECT model, part_key, seed, pred FROM predictions) SELECT x.model, x.seed AS seed_a, y.seed AS seed_b, round(avg(abs(x.pred - y.pred)), 6) AS mae, round(max(abs(x.pred - y.pred)), 6) AS max_abs, round(corr(x.pred, y.pred), 6) AS pearson
FROM w x JOIN w y ON x.model = y.model AND x.part_key = y.part_key AND x.seed < y.seed GROUP BY 1, 2, 3"""
)
def agreement_of_all_runs(d: Derived) -> DataFrame:
    """Every two seeds of every model, locus by locus."""
    x = d.predictions.select("model", "part_key", F.col("seed").alias("seed_a"), F.col("pred").alias("a"))
    y = d.predictions.select("model", "part_key", F.col("seed").alias("seed_b"), F.col("pred").alias("b"))
    return rounded(x.join(y, ["model", "part_key"]).filter("seed_a < seed_b").groupBy("model", "seed_a", "seed_b").agg(*metrics.orientation_agreement(F.col("a"), F.col("b"))))
