"""Queries of matched backgrounds, optimal matching, motifs and coding consequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohort, matching, ranks
from .derived import Derived, h, h_sql, with_tables
from .queries import _CAND, _CDS, _TIER_SQL, _candidates, _segments, query, rounded

_CHOSEN = (
    _CAND
    + ", n AS (SELECT x.uid, "
    + ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS t{i}" for i, (_, c) in enumerate(_TIER_SQL))
    + " FROM cand x JOIN cand y ON x.cpg_effect = y.cpg_effect AND x.uid <> y.uid GROUP BY 1), w AS (SELECT c.uid, CASE "
    + " ".join(f"WHEN t{i} >= 20 THEN {i}" for i in range(len(_TIER_SQL)))
    + f" ELSE {len(_TIER_SQL)} END AS k FROM cand c LEFT JOIN n USING (uid)), kn AS (SELECT w.uid, k, CASE k "
    + " ".join(f"WHEN {i} THEN t{i}" for i in range(len(_TIER_SQL)))
    + " END AS n FROM w LEFT JOIN n USING (uid))"
)
_MD5 = "cast('0x' || substr(md5({}), 1, 8) AS bigint)"
_NAMES = "CASE k " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(_TIER_SQL)) + f" ELSE '{matching.ALL}' END"


def _pairs_sql(most: int, targets: str) -> str:
    """pr: the first `most` of all comparators of each target in its tier, by hash; tiers one by one, so that they are joins on equal fields."""
    parts = []
    for i, t in enumerate(matching.TIERS):
        same = " AND ".join(f"x.{f} = y.{f}" for f in t.same)
        parts.append(f"SELECT x.uid, y.uid AS c_uid, y.delta AS c_delta, y.hash FROM {targets} g JOIN cand x ON x.uid = g.uid AND g.k = {i} JOIN ch y ON {same} AND x.uid <> y.uid AND abs(x.distance - y.distance) <= {t.within}")
    return f", ch AS (SELECT *, {_MD5.format("'bucket|' || uid")} AS hash FROM cand), p0 AS ({' UNION ALL '.join(parts)}), pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY hash, c_uid) AS nth FROM p0) WHERE nth <= {most})"


@query(
    _CHOSEN
    + _pairs_sql(1000, "kn")
    + """, own AS (SELECT c.uid, count(*) AS n, avg(c_delta) AS mean, median(c_delta) AS median, stddev_samp(c_delta) AS sd, 100.0::double * (count(*) FILTER (abs(c_delta) < abs(delta)) + 0.5::double * count(*) FILTER (abs(c_delta) = abs(delta))) / count(*) AS percentile,
  (1.0::double + count(*) FILTER (abs(c_delta) >= abs(delta))) / (count(*) + 1.0::double) AS tail FROM pr JOIN cand c USING (uid) GROUP BY 1),
rest AS (SELECT c.uid, count(*) AS n, avg(y.delta) AS mean, median(y.delta) AS median, stddev_samp(y.delta) AS sd, 100.0::double * (count(*) FILTER (abs(y.delta) < abs(c.delta)) + 0.5::double * count(*) FILTER (abs(y.delta) = abs(c.delta))) / count(*) AS percentile,
  (1.0::double + count(*) FILTER (abs(y.delta) >= abs(c.delta))) / (count(*) + 1.0::double) AS tail FROM kn JOIN cand c USING (uid) JOIN cand y ON y.uid <> c.uid WHERE k = 7 GROUP BY 1),
u AS (SELECT * FROM own UNION ALL SELECT * FROM rest)
"""
    + f"SELECT kn.uid, {_NAMES} AS tier, coalesce(u.n, 0) AS n, coalesce(u.n, 0) < 20 AS below_least, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(percentile, 6) AS percentile, round(tail, 6) AS tail FROM kn LEFT JOIN u USING (uid)"
)
def matched_background(d: Derived) -> DataFrame:
    return rounded(matching.background(_candidates(d)))


@query(
    _CHOSEN
    + ", top AS (SELECT kn.* FROM kn JOIN cand USING (uid) ORDER BY abs(delta) DESC, uid LIMIT 5)"
    + _pairs_sql(2**31 - 1, "top")
    + " SELECT uid, c_uid, c_delta FROM pr"
)
def top_target_comparators(d: Derived) -> DataFrame:
    """The report's five largest effects with all comparators, each in its own tier."""
    c = _candidates(d)
    top = ranks.top_k(c, 5, F.abs("delta"), "uid").select("uid")
    return matching.comparators(c, matching.choose_tiers(c).join(top, "uid")).select("uid", "c_uid", "c_delta")


_LEADS = (
    with_tables("leads")
    + f""", ml AS (SELECT *, {h_sql("lead_id", "dist")} % 500 AS distance, ({h_sql("lead_id", "beta")} % 1000) / 1000.0::double AS beta, substr('ACGT', cast(1 + lead_id % 4 AS bigint), 1) AS ref, substr('CGTAGTACTACG', cast(1 + lead_id % 12 AS bigint), 1) AS alt0 FROM leads),
mr AS (SELECT *, CASE WHEN alt0 = ref THEN translate(ref, 'ACGT', 'GTAC') ELSE alt0 END AS alt FROM ml),
mm AS (SELECT *, CASE WHEN ref IN ('A', 'G') THEN translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END AS sbs6, CASE WHEN least(ref, alt) || greatest(ref, alt) IN ('AG', 'CT') THEN 'transition' ELSE 'transversion' END AS titv FROM mr)"""
)


def _leads(d: Derived) -> DataFrame:
    k = F.col("lead_id")
    ref = F.substring(F.lit("ACGT"), (1 + k % 4).cast("int"), F.lit(1))
    alt0 = F.substring(F.lit("CGTAGTACTACG"), (1 + k % 12).cast("int"), F.lit(1))
    alt = F.when(alt0 == ref, F.translate(ref, "ACGT", "GTAC")).otherwise(alt0)
    t = d.leads.withColumns({"distance": h(k, "dist") % 500, "beta": (h(k, "beta") % 1000) / 1000.0, "ref": ref, "alt": alt})
    return t.withColumns({"sbs6": S.sbs6(F.col("ref"), F.col("alt"), F.lit(True)), "titv": S.titv(F.col("ref"), F.col("alt"))})


def _edges(d: Derived) -> DataFrame:
    t = _leads(d)
    return matching.match_edges(t.filter("qval < 0.05"), t.filter("qval >= 0.5"), 0.01)


@query(
    _LEADS
    + """ SELECT p.lead_id AS p, q.lead_id AS q, round(4 * abs(p.maf - q.maf) / 0.01 + abs(p.distance - q.distance) / 500.0::double + abs(p.beta - q.beta) / 0.5 + CASE WHEN p.ref = q.ref AND p.alt = q.alt THEN 0 WHEN p.sbs6 = q.sbs6 THEN 0.2::double WHEN p.titv = q.titv THEN 0.5::double ELSE 0.8::double END, 6) AS cost,
CASE WHEN p.ref = q.ref AND p.alt = q.alt THEN 'O1_exact_substitution' WHEN p.sbs6 = q.sbs6 THEN 'O2_SBS6' WHEN p.titv = q.titv THEN 'O3_TiTv' ELSE 'O4_chromosome_only' END AS match_tier
FROM mm p JOIN mm q ON p.chr = q.chr AND p.qval < 0.05 AND q.qval >= 0.5 AND abs(p.maf - q.maf) <= 0.01"""
)
def match_edges(d: Derived) -> DataFrame:
    return rounded(_edges(d))


@query()
def optimal_matching(d: Derived) -> DataFrame:
    """The sets, two rows each, with the tier of the pair and its cost."""
    e = _edges(d).withColumn("cost", F.round("cost", 9))
    matched = matching.optimal_matching(e.select("p", "q", "cost")).join(e.select("p", "q", "match_tier"), ["p", "q"])
    return rounded(matching.pair_rows(matched.select("p", "q")).join(matched.select(F.col("q").alias("lead_id"), "match_tier", "cost"), "lead_id", "left").withColumns({"match_tier": F.coalesce("match_tier", F.lit("positive_anchor")), "cost": F.coalesce("cost", F.lit(0.0))}))


_MOTIFS = {"cpg_box": "TCGA", "e_box": "CACGTG"}


def _best_sql(seq: str, word: str) -> str:
    hits = " + ".join(f"cast(substr({seq}, i + {o + 1}, 1) = '{b}' AS int)" for o, b in enumerate(word))
    return f"list_max(list_transform(range(0, {100 - len(word) + 1}), lambda i: cast(3 * ({hits}) - {len(word)} AS double)))"


@query(
    with_tables("in_window")
    + ", t AS ("
    + " UNION ALL ".join(f"SELECT variant_id, '{m}' AS motif, {_best_sql('wt', w)} AS ref_score, {_best_sql('mut', w)} AS alt_score FROM in_window" for m, w in _MOTIFS.items())
    + ") SELECT variant_id, motif, ref_score, alt_score, alt_score - ref_score AS delta FROM t WHERE abs(alt_score - ref_score) > 1"
)
def motif_deltas(d: Derived) -> DataFrame:
    """Two fixed motifs as rows (motif, offset, base, score)."""
    rows = [(m, o, b, (2.0 if b == w[o] else -1.0)) for m, w in _MOTIFS.items() for o in range(len(w)) for b in "ACGT"]
    motifs = d.spark.createDataFrame(rows, "motif string, offset int, base string, score double")
    return cohort.motif_scan(d.in_window.select("variant_id", "wt", "mut"), motifs, "variant_id", "wt", "mut").select("variant_id", "motif", "ref_score", "alt_score", "delta")


_AMINO = "substr('" + S.AMINO_ACIDS + "', cast(1 + 16 * (strpos('TCAG', substr({0}, 1, 1)) - 1) + 4 * (strpos('TCAG', substr({0}, 2, 1)) - 1) + strpos('TCAG', substr({0}, 3, 1)) - 1 AS bigint), 1)"


@query(
    with_tables("segments")
    + _CDS
    + f""", c AS (SELECT tx, string_agg(CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, '' ORDER BY CASE WHEN strand = '-' THEN -k ELSE k END) AS cds, sum(length(seq)) AS t FROM s1 GROUP BY 1),
sp AS (SELECT tx, strand, length(seq) AS n, coalesce(sum(length(seq)) OVER (PARTITION BY tx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s1),
v AS (SELECT o_orderkey AS variant_id, tx, cds, t, {h_sql("o_orderkey", "at")} % t AS x, r.ref, translate(r.ref, 'ACGT', 'CGTA') AS alt FROM orders JOIN c ON tx = o_orderkey, (VALUES ('A'), ('C'), ('G'), ('T')) r(ref)),
z AS (SELECT v.*, strand, cast(CASE WHEN strand = '+' THEN b + x - b ELSE t - b - n + (b + n - 1) - x END AS bigint) AS off FROM v JOIN sp ON sp.tx = v.tx AND v.x BETWEEN b AND b + n - 1),
q AS (SELECT variant_id, tx, off, off % 3 AS k, substr(cds, off // 3 * 3 + 1, 3) AS codon, CASE WHEN strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS r, CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS a FROM z),
m AS (SELECT *, substr(codon, 1, k) || a || substr(codon, k + 2) AS alt_codon FROM q WHERE substr(codon, k + 1, 1) = r)
SELECT variant_id, tx, codon, alt_codon, CASE WHEN length(codon) = 3 THEN {_AMINO.format("codon")} END AS amino, CASE WHEN length(alt_codon) = 3 THEN {_AMINO.format("alt_codon")} END AS alt_amino, CASE WHEN length(codon) = 3 AND length(alt_codon) = 3 THEN {_AMINO.format("codon")} = {_AMINO.format("alt_codon")} END AS is_synonymous FROM m"""
)
def coding_consequences(d: Derived) -> DataFrame:
    """Each transcript lies on its own stretch of a chromosome; variants are drawn inside."""
    seg = _segments(d).withColumn("len", F.length("seq").cast("long"))
    seg = cohort.segment_offsets(seg, ["tx"], ["k"])
    total = seg.groupBy("tx").agg(F.sum("len").alias("t_"))
    at = seg.join(total, "tx").withColumn("base", F.col("tx") * 1000 + 1)
    spans = at.select("tx", F.concat(F.lit("chr"), 1 + F.col("tx") % 22).alias("chr"), (F.col("base") + F.col("before")).alias("start"), (F.col("base") + F.col("before") + F.col("len") - 1).alias("end"), "strand", F.when(F.col("strand") == "+", F.col("before")).otherwise(F.col("t_") - F.col("before") - F.col("len")).alias("before"))
    cds = cohort.splice(_segments(d), "tx", "k", "seq", "strand")
    k = F.col("o_orderkey")
    v = d.table("orders").select(k.alias("variant_id"), k.alias("tx_"), F.concat(F.lit("chr"), 1 + k % 22).alias("chr")).join(total.withColumnRenamed("tx", "tx_"), "tx_").withColumn("pos1", F.col("tx_") * 1000 + 1 + h(F.col("variant_id"), "at") % F.col("t_"))
    every = v.select("variant_id", "chr", "pos1", F.explode(F.array(*map(F.lit, "ACGT"))).alias("ref"))
    return cohort.consequences(every.withColumn("alt", F.translate("ref", "ACGT", "CGTA")), spans, cds)


@query(
    """WITH t AS (SELECT l_orderkey AS variant_id, 'T' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS tx, CASE l_partkey % 4 WHEN 0 THEN 'MANE_Select' WHEN 1 THEN 'appris_principal_2' WHEN 2 THEN 'basic' ELSE 'CCDS' END AS tag, CASE WHEN l_suppkey % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS kind,
  CASE WHEN l_suppkey % 5 = 0 THEN 'NA' ELSE (l_suppkey % 5) || ' (assigned)' END AS support, cast(l_quantity AS bigint) AS cds_length FROM lineitem)
SELECT variant_id, tx FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY CASE WHEN tag = 'MANE_Select' THEN 0 ELSE 1 END, CASE WHEN starts_with(tag, 'appris_principal') THEN 0 ELSE 1 END, CASE WHEN kind = 'protein_coding' THEN 0 ELSE 1 END, CASE WHEN tag = 'basic' THEN 0 ELSE 1 END,
  CASE WHEN support = 'NA' THEN 99 ELSE cast(substr(support, 1, 1) AS int) END, -cds_length, tx) AS nth FROM t) WHERE nth = 1"""
)
def chosen_transcripts(d: Derived) -> DataFrame:
    """Of a variant's transcripts the one that comes first by tags, kind, support and length."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    tags = F.array(F.array(*map(F.lit, ("MANE_Select", "appris_principal_2", "basic", "CCDS")))[(p % 4).cast("int")])
    t = d.table("lineitem").select(
        F.col("l_orderkey").alias("variant_id"), F.concat(F.lit("T"), F.concat_ws("-", F.col("l_linenumber").cast("string"), p.cast("string"), s.cast("string"))).alias("tx"), tags.alias("tags"),
        F.when(s % 3 == 0, "lncRNA").otherwise("protein_coding").alias("kind"), F.when(s % 5 == 0, "NA").otherwise(F.concat(s % 5, F.lit(" (assigned)"))).alias("support"), F.col("l_quantity").cast("long").alias("cds_length"),
    )
    return ranks.first_per_key(t, ["variant_id"], [cohort.priority(*(F.col(c) for c in ("tags", "kind", "support", "cds_length", "tx")))]).select("variant_id", "tx")
