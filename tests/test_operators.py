import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import scalars as S
from strandloom.operators import audit, cohort, intervals, matching, metrics, ml, ranks, resample


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.lit("aacgRYN"))) == "NRYCGTT"
    assert one(spark, S.centered_crop(F.lit("0123456789"), 4)) == "3456"
    with pytest.raises(Exception, match="shorter"):
        one(spark, S.centered_crop(F.lit("01"), 4))
    assert one(spark, S.trinucleotide(F.lit("ACGT"), F.lit(0))) == "NNN" and one(spark, S.trinucleotide(F.lit("ACGT"), F.lit(1))) == "ACG"
    assert one(spark, S.sbs96(F.lit("AGT"), F.lit("G"), F.lit("A"))) == "A[C>T]T" and one(spark, S.sbs96(F.lit("NNN"), F.lit("G"), F.lit("A"))) == "N[G>A]N"
    assert one(spark, S.cpg_effect(F.lit("ACGT"), F.lit("ATGT"), F.lit(1))) == "destroyed" and one(spark, S.cpg_effect(F.lit("ACAT"), F.lit("ACGT"), F.lit(2))) == "created"
    assert one(spark, S.cpg_effect(F.lit("CGC"), F.lit("CCC"), F.lit(1))) == "destroyed"
    assert [one(spark, S.amino_acid(F.lit(c))) for c in ("ATG", "TAA", "GGC", "NNN")] == ["M", "*", "G", None]
    assert one(spark, S.single_difference(F.lit("ACGT"), F.lit("ATGA"))) is None


def test_values(spark):
    for beta in (0.0, 0.2, 0.5, 1.0):
        m = one(spark, S.beta_to_m(F.lit(beta)))
        assert one(spark, S.m_to_beta(F.lit(m))) == pytest.approx(min(max(beta, 1e-4), 1 - 1e-4))
    assert one(spark, S.m_to_beta(F.lit(-2000.0))) == 0.0 and one(spark, S.m_to_beta(F.lit(2000.0))) == 1.0
    assert one(spark, S.gene_symbols(F.array(F.lit("A"), F.lit("B")), F.lit("NM_1(B):c.1")))  == ["A", "B"]
    assert one(spark, S.mentions_any(F.lit("A Missense change"), ["missense", "stop"])) is True
    assert one(spark, S.promoter_interval(F.lit(100), F.lit(9000), F.lit("+"))).asDict() == {"start": 1, "end": 300}
    assert one(spark, S.promoter_interval(F.lit(100), F.lit(9000), F.lit("-"))).asDict() == {"start": 8800, "end": 10500}


def test_nearest_edges(spark):
    probes = spark.createDataFrame([("a", "chr1", 10), ("b", "chr1", 10), ("c", "chr1", 20), ("d", "chr1", 20), ("e", "chr1", 10**6)], "probe_id string, chr string, pos long")
    at = spark.createDataFrame([("chr1", p) for p in (0, 10, 14, 15, 16, 20, 21, 400_000, 600_000, 10**7)] + [("chr2", 5)], "chr string, pos long")
    got = {(r.chr, r.pos): (r.near_id, r.distance) for r in intervals.nearest(at, probes).collect()}
    # equal positions: the last name on the left, the first on the right; equal distances: left
    assert got == {("chr1", 0): ("a", 10), ("chr1", 10): ("a", 0), ("chr1", 14): ("b", 4), ("chr1", 15): ("b", 5), ("chr1", 16): ("c", 4), ("chr1", 20): ("c", 0), ("chr1", 21): ("d", 1), ("chr1", 400_000): ("d", 399_980), ("chr1", 600_000): ("e", 400_000), ("chr1", 10**7): ("e", 9 * 10**6), ("chr2", 5): (None, None)}


def test_merge_touching(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 6, 8), ("c", 10, 12), ("c", 2, 3), ("d", 1, 1)], "chr string, start long, end long")
    assert sorted(tuple(r) for r in intervals.merge_intervals(df).collect()) == [("c", 1, 8), ("c", 10, 12), ("d", 1, 1)]


def test_containing_long_intervals(spark):
    iv = [(i, "c", s, s + w) for i, (s, w) in enumerate([(5, 0), (0, 3_000_000), (9_999, 2), (700_000, 650_000)])]
    pts = [(p, "c", p) for p in (0, 5, 9_999, 10_001, 10_002, 640_000, 1_350_000, 2_999_999, 3_000_001)]
    got = {(r.id, r.o_id) for r in intervals.containing(spark.createDataFrame(pts, "id long, chr string, pos long"), spark.createDataFrame(iv, "id long, chr string, start long, end long")).collect()}
    assert got == {(p, i) for p, _, _ in pts for i, _, s, e in iv if s <= p <= e}


def test_auc_and_corr_guards(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.7), (0, 0.1)], "y int, score double")
    assert metrics.auc(df).first().auc == pytest.approx(0.875)
    assert metrics.auc(df.withColumn("y", F.lit(1))).first().auc is None
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    assert metrics.spearman(flat, "a", "b").first().rho is None
    assert metrics.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double"), "a", "b").first().rho is None


def test_sign_consistency_of_zeros(spark):
    s = spark.createDataFrame([("u", k, 0.0) for k in range(3)], "uid string, seed int, delta double")
    assert metrics.seed_summary(s).first().sign_consistency == 1.0


def test_all_null_feature_imputes_zero(spark):
    df = spark.createDataFrame([("train", None, 1.0), ("test", 5.0, None), ("train", None, 3.0)], "split string, a double, b double")
    rows = metrics.impute(df, ["a", "b"], F.col("split") == "train").collect()
    assert sorted((r.a, r.b, r.a_Missing, r.b_Missing) for r in rows) == [(0.0, 1.0, 1, 0), (0.0, 3.0, 1, 0), (5.0, 2.0, 0, 1)]
    pooled = metrics.fit_medians(df, ["a", "b"], F.lit(True), [("a", "b")]).first()
    assert pooled.a == pooled.b == 3.0


def test_global_rank_equals_window(spark):
    df = spark.createDataFrame([(i, float(random.Random(i).randint(0, 40))) for i in range(300)], "id long, v double")
    got = {r.id: r["rank"] for r in ranks.global_average_rank(df, "v").collect()}
    assert got == {r.id: r.r for r in df.withColumn("r", ranks.average_rank(F.col("v"))).collect()}


def test_priority_and_splice(spark):
    t = spark.createDataFrame([("t1", ["basic"], "protein_coding", "1", 90), ("t2", ["MANE_Select"], "other", "NA", 3), ("t3", ["basic"], "protein_coding", "1 (old)", 120)], "tx string, tags array<string>, kind string, tsl string, n long")
    order = [r.tx for r in t.orderBy(cohort.priority(F.col("tags"), F.col("kind"), F.col("tsl"), F.col("n"), F.col("tx"))).collect()]
    assert order == ["t2", "t3", "t1"]
    seg = spark.createDataFrame([("a", "-", 1, "AAC"), ("a", "-", 2, "GGT"), ("b", "+", 1, "ATG")], "tx string, strand string, k int, seq string")
    assert {r.tx: r.cds for r in cohort.splice(seg, "tx", "k", "seq", "strand").collect()} == {"a": "ACCGTT", "b": "ATG"}


def test_consequences_both_strands(spark):
    seg = spark.createDataFrame([("p", "chr1", 11, 16, "+", 0), ("m", "chr1", 21, 26, "-", 0)], "tx string, chr string, start long, end long, strand string, before long")
    cds = spark.createDataFrame([("p", "ATGGCA"), ("m", "ATGGCA")], "tx string, cds string")
    v = spark.createDataFrame([(1, "chr1", 16, "A", "G"), (2, "chr1", 21, "T", "C"), (3, "chr1", 11, "A", "C"), (4, "chr1", 12, "A", "C")], "variant_id long, chr string, pos1 long, ref string, alt string")
    got = {r.variant_id: (r.codon, r.alt_codon, r.amino, r.alt_amino, r.is_synonymous) for r in cohort.consequences(v, seg, cds).collect()}
    assert got == {1: ("GCA", "GCG", "A", "A", True), 2: ("GCA", "GCG", "A", "A", True), 3: ("ATG", "CTG", "M", "L", False)}


def test_rules_and_verdict(spark):
    df = spark.createDataFrame([(i, "chr1" if i % 2 else "chrZ", 0.01 * i) for i in range(20)], "lead_id long, chr string, qval double").withColumns({"maf": F.lit(0.1), "slope": F.lit(1.0)})
    totals = audit.rule_totals(audit.with_uniqueness(df, "lead_id"), audit.lead_rules(), "lead_id")
    rows = {r.rule: r for r in totals.collect()}
    assert rows["chromosome"].n == 10 and len(rows["chromosome"].examples) == 5 and rows["duplicate_id"].n == 0 and rows["significant"].severity == "warning"
    assert audit.verdict(totals).first().status == "FAIL"
    assert audit.missing_columns(df, ["maf", "nothing"]) == ["nothing"]
    assert [r.ok for r in audit.count_contract({"a": df}, {"a": 20}).collect()] == [True]
    with pytest.raises(Exception, match="too large"):
        audit.require(df, F.col("qval") < 0.1, "too large").collect()


def best_matching(edges, unmatched):
    """All ways to match each p to one of its q, or to none."""
    ps = sorted({p for p, _, _ in edges})
    options = [[(None, unmatched), *((q, c) for x, q, c in edges if x == p)] for p in ps]
    return min(sum(c for _, c in way) for way in itertools.product(*options) if len(used := [q for q, _ in way if q is not None]) == len(set(used)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(10, 15), st.integers(0, 120)), max_size=14, unique_by=lambda e: e[:2]))
def test_matching_is_optimal(edges):
    edges = [(p, q, float(c)) for p, q, c in edges]
    got = matching.assign(edges, 50.0)
    assert len({p for p, _, _ in got}) == len(got) == len({q for _, q, _ in got})
    ps = {p for p, _, _ in edges}
    assert sum(c for *_, c in got) + 50.0 * (len(ps) - len(got)) == pytest.approx(best_matching(edges, 50.0) if edges else 0.0)


def test_matching_by_component_equals_whole(spark):
    rng = random.Random(9)
    edges = [(p, 100 + q, rng.random() * 4) for p in range(30) for q in range(30) if p // 5 == q // 5 and rng.random() < 0.5]
    got = matching.optimal_matching(spark.createDataFrame(edges, "p long, q long, cost double")).collect()
    whole = matching.assign(edges, 100.0)
    assert sum(r.cost for r in got) == pytest.approx(sum(c for *_, c in whole)) and len(got) == len(whole)
    pairs = matching.pair_rows(spark.createDataFrame(whole, "p long, q long, cost double"))
    assert pairs.groupBy("match_set_id").agg(F.sum("y")).filter("`sum(y)` <> 1").count() == 0


def test_background_against_plain_loops(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y"]), rng.choice("pq"), rng.choice("tv"), rng.choice(["created", "unchanged"]), rng.randint(0, 300), round(rng.uniform(-1, 1), 2)) for i in range(120)]
    names = "uid long, gene string, sbs96 string, sbs6 string, titv string, cpg_effect string, distance long, delta double"
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in names.split(", ")])
    got = {r.uid: r for r in matching.background(spark.createDataFrame(rows, names), least=12).collect()}
    for _, t in pdf.iterrows():
        for tier in matching.TIERS:
            c = pdf[(pdf.uid != t.uid) & np.logical_and.reduce([pdf[f] == t[f] for f in tier.same]) & ((pdf.distance - t.distance).abs() <= tier.within)]
            if len(c) >= 12:
                name = tier.name
                break
        else:
            c, name = pdf[pdf.uid != t.uid], matching.ALL
        g = got[t.uid]
        a = c.delta.abs()
        assert (g.tier, g.n, g.below_least) == (name, len(c), len(c) < 12)
        assert g["mean"] == pytest.approx(c.delta.mean()) and g.sd == pytest.approx(c.delta.std())
        assert g.percentile == pytest.approx(100 * ((a < abs(t.delta)).sum() + 0.5 * (a == abs(t.delta)).sum()) / len(c)) and g.tail == pytest.approx((1 + (a >= abs(t.delta)).sum()) / (len(c) + 1))


@pytest.mark.parametrize("most", [3, 20, 500])
def test_capped_comparators(spark, most):
    """Exactly the first by hash of all that a target has, however many these are."""
    from hashlib import md5

    rng = random.Random(8)
    rows = [(i, "a", "x" if i % 40 else "y", "p", "t", "created", rng.choice([1, 30, i % 90]), i / 1000) for i in range(400)]
    c = spark.createDataFrame(rows, "uid long, gene string, sbs96 string, sbs6 string, titv string, cpg_effect string, distance long, delta double")
    chosen = matching.choose_tiers(c)
    tier = {r.uid: matching.TIERS[r.k] for r in chosen.collect()}
    by = {}
    for r in matching.comparators(c, chosen, most=most).collect():
        by.setdefault(r.uid, set()).add(r.c_uid)
    place = lambda u: (int(md5(f"bucket|{u}".encode()).hexdigest()[:8], 16), u)
    fields = ("uid", "gene", "sbs96", "sbs6", "titv", "cpg_effect", "distance")
    for x in (dict(zip(fields, r)) for r in rows):
        t = tier[x["uid"]]
        all_ = [y["uid"] for y in (dict(zip(fields, r)) for r in rows) if y["uid"] != x["uid"] and abs(y["distance"] - x["distance"]) <= t.within and all(y[f] == x[f] for f in t.same)]
        assert by[x["uid"]] == set(sorted(all_, key=place)[:most])


def test_one_block_has_no_interval(spark):
    df = spark.createDataFrame([("s", "b1", 1.0), ("s", "b1", 2.0)], "stratum string, block string, g double")
    row = resample.stratum_bootstrap(df, "stratum", "block", "g", 20).first()
    assert (row.n_blocks, row.low, row.high) == (1, None, None)


def test_draws_have_as_many_draws_as_blocks(spark):
    t = resample.draws(spark.range(7).select(F.col("id").alias("i")), 30, 1).groupBy("replicate").agg(F.sum("times").alias("n")).collect()
    assert len(t) == 30 and {r.n for r in t} == {7}


def test_two_orientations_and_motifs(spark):
    df = spark.createDataFrame([("a", "AACGT", "AATGT")], "id string, seq string, mut string")
    scorer = lambda b: pd.DataFrame({"m": b["seq"].str.count("A").astype(float), "beta": 0.5, "prob": 0.5})
    row = ml.two_orientations(df, scorer, "id", "seq").first()
    assert (row.m_fwd, row.m_rc, row.m) == (2.0, 1.0, 1.5)
    motif = spark.createDataFrame([("cg", o, b, 2.0 if "CG"[o] == b else -1.0) for o in range(2) for b in "ACGT"], "motif string, offset int, base string, score double")
    hit = cohort.motif_scan(df, motif, "id", "seq", "mut").first()
    assert (hit.ref_score, hit.alt_score, hit.delta) == (4.0, 1.0, -3.0)


def test_rc_view_swaps(spark):
    df = spark.createDataFrame([("ACC", 1, 2)], "seq string, left int, right int")
    assert tuple(cohort.rc_view(df, "seq", [("left", "right")]).first()) == ("GGT", 2, 1)
    assert {tuple(r) for r in cohort.rc_view(cohort.rc_view(df, "seq", [("left", "right")]), "seq", [("left", "right")]).collect()} == {("ACC", 1, 2)}


def test_splits_publications_and_panel(spark):
    audit.check_splits(["chr10", "chr11"], ["chr8", "chr9"])
    for val, test in (([], ["chr8"]), (["chr8"], ["chr8"]), (["chr99"], ["chr8"])):
        with pytest.raises(ValueError):
            audit.check_splits(val, test)
    rows = spark.createDataFrame([("a", None), ("b", "http://x"), ("c", " "), ("d", "http://y")], "record_id string, url string")
    links = spark.createDataFrame([("a", "2"), ("a", "1"), ("d", "3")], "record_id string, publication_id string")
    kept, counts = cohort.published(rows, links)
    assert {r.record_id: r.publication_ids for r in kept.collect()} == {"a": ["1", "2"], "b": [], "d": ["3"]}
    assert {tuple(r) for r in counts.collect()} == {("publication", 2), ("url", 1), ("none", 1)}
    panel = metrics.gain_panel(spark.createDataFrame([("x", 1.0, 0.5, 2.0), ("z", 1.0, 1.0, 1.0)], "stratum string, gain double, low double, high double"), ["y", "x"])
    assert [tuple(r) for r in panel.collect()] == [(2, "x", -1.0, -2.0, -0.5)]


def test_semi_join_counts_points_once(spark):
    pts = spark.createDataFrame([("c", 5), ("c", 50)], "chr string, pos long")
    iv = spark.createDataFrame([("c", 1, 9), ("c", 4, 6)], "chr string, start long, end long")
    assert [r.pos for r in intervals.containing(pts, iv, how="left_semi").collect()] == [5]


def test_best_seed(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("ACGT", k=20)), rng.random(), rng.uniform(-3, 3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "seq string, a double, m_value double")
    seed, model = ml.best_seed(df, df, ["a"], [1, 2])
    assert seed in (1, 2) and 0 <= ml.fusion_share(model) <= 1


def test_checked_joins_fail_on_broken_promises(spark):
    from strandloom.operators import checked

    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 5), (2, None)], "k int, b int")
    twice = b.unionByName(b)
    assert checked.many_to_one(a, b, ["k"]).count() == 3
    assert checked.complete(a, b, ["k"], []).count() == 3
    assert checked.one_to_one(a.dropDuplicates(["k"]), b, ["k"]).count() == 2
    for broken in (
        lambda: checked.many_to_one(a, twice, ["k"]),
        lambda: checked.one_to_one(a, b, ["k"]),
        lambda: checked.complete(a, b, ["k"]),
        lambda: checked.complete(a, b.filter("k = 1"), ["k"], []),
        lambda: checked.masked_out(a, b.select("k", F.lit(True).alias("m")).filter("k = 2"), "k", "m"),
    ):
        with pytest.raises(Exception):
            broken().collect()
    masks = b.select("k", (F.col("k") == 2).alias("m"))
    assert [r.a for r in checked.masked_out(a, masks, "k", "m").collect()] == ["x"] and checked.masked_out(a, masks, "k", "m", True).count() == 3
    assert checked.without_nulls(b, ["b"]).count() == 1 and checked.without_nulls(b, []).count() == 2
    assert [r.n_null for r in checked.null_report(b, ["b"]).collect()] == [1]
    assert {r.id for r in checked.with_id(a, ["nope", "a"], ["k"]).collect()} == {"x", "y", "z"}
    assert {r.id for r in checked.with_id(a, ["nope"], ["k", "a"]).collect()} == {"1|x", "2|y", "2|z"}


def test_matching_is_the_cheapest_on_few_edges(spark):
    """Against all assignments; with one edge at first, so that proofs fail and edges are added."""
    import itertools
    import random

    from strandloom.operators import matching

    rng = random.Random(11)
    for _ in range(3):
        cost = {(p, 100 + q): round(rng.random() * 8, 6) for p in range(6) for q in range(6) if rng.random() < 0.7}
        best = min(sum(cost.get((p, 100 + q), 100.0) if q < 6 else 100.0 for p, q in enumerate(pick)) for pick in itertools.permutations(range(7), 6))
        edges = spark.createDataFrame([(p, q, c) for (p, q), c in cost.items()], "p long, q long, cost double")
        got = matching.optimal_matching(edges, first=1).collect()
        assert len({r.q for r in got}) == len(got) and abs(sum(r.cost for r in got) + 100.0 * (6 - len(got)) - best) < 1e-6


def test_set_bootstrap_without_both_classes(spark):
    from strandloom.operators import resample

    one = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "s int, y int, score double")
    assert {(r.auc, r.wins) for r in resample.set_bootstrap(one, "s", 3).collect()} == {(None, None)}


def test_motif_scan_shuffles_nothing(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choices("ACGTN", k=rnd.randrange(12))), "".join(rnd.choices("ACGTN", k=rnd.randrange(12)))) for i in range(200)] + [(200, None, "ACG"), (201, "NNN", "ACG")]
    score = {("x", o, b): 1.0 * rnd.randrange(-4, 5) for o in range(3) for b in "ACGT"} | {("y", 1, "G"): 2.0}

    def best(s, m, width):
        sums = [[score[m, o, s[at + o]] for o in range(width) if (m, o, s[at + o]) in score] for at in range(len(s or "") - width + 1)]
        return max((sum(x) for x in sums if x), default=None)

    motifs = spark.createDataFrame([(m, o, b, v) for (m, o, b), v in score.items()], "motif string, offset int, base string, score double")
    got = cohort.motif_scan(spark.createDataFrame(rows, "id long, r string, a string"), motifs, "id", "r", "a", letters_at_once=50)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(i, m, x, y) for i, r, a in rows for m, w in (("x", 3), ("y", 2)) for x, y in [(best(r, m, w), best(a, m, w))] if x is not None and y is not None and abs(y - x) > 1}
    assert {tuple(x)[:4] for x in got.collect()} == want and len(want) > 20
