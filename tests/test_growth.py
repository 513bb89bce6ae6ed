"""Steps whose rows must not grow with the square of the input."""

import math
import random

from pyspark.sql import functions as F

from strandloom.operators import audit, candidates, intervals, matching, metrics, ranks
from strandloom.plans import chains, queries
from strandloom.plans.derived import Derived
from strandloom.sources import readers


def test_interval_means_without_pairs(spark):
    rnd = random.Random(7)
    track = [(rnd.choice("ab"), s := rnd.randrange(-50, 900), s + rnd.randrange(0, 300), rnd.choice([rnd.uniform(-1, 1), 1e12, 1e-7, None])) for _ in range(300)]
    track += [("c", 0, 10, float("inf")), ("c", 5, 20, float("-inf")), ("c", 30, 40, float("nan")), ("d", 0, 5000, 1e15), ("d", 6000, 6001, 0.125), ("e", 0, 1000, 1e15), ("e", 10, 11, -1e15), ("f", 3, 5, 1e-310)]
    windows = [(i, rnd.choice("abz"), s := rnd.randrange(-50, 900), s + rnd.randrange(0, 200)) for i in range(300)]
    windows += [(300, "c", 0, 5), (301, "c", 0, 8), (302, "c", 12, 15), (303, "c", 29, 31), (304, "d", 5990, 6010), (305, "d", 4999, 6001), (306, "e", 10, 11), (307, "c", 20, 30)]
    df = spark.createDataFrame(windows, "id long, chr string, start long, end long")
    got = {r["id"]: r["mean"] for r in intervals.interval_mean(df, spark.createDataFrame(track, "chr string, start long, end long, value double"), width=64).collect()}
    assert len(got) == len(windows)
    for i, k, a, z in windows:
        hits = [(v, min(z, e) - max(a, s, 0)) for c, s, e, v in track if c == k and v is not None and min(z, e) > max(a, s, 0)]
        want = math.fsum(v * n for v, n in hits if math.isfinite(v)) / sum(n for _, n in hits) if hits else None
        odd = [v for v, _ in hits if not math.isfinite(v)]
        want = sum(odd) if odd else want
        assert got[i] is want if want is None else math.isnan(got[i]) if math.isnan(want) else got[i] == want or abs(got[i] - want) <= 1e-12 * abs(want) + 1e-9, (i, got[i], want)


def test_interval_means_grow_with_the_input(spark):
    """Two thousand windows on two thousand intervals of one place: no operator makes their pairs."""
    one = spark.range(2000).selectExpr("id", "'a' AS chr", "0L AS start", "100L AS end", "1.5D AS value")
    got = intervals.interval_mean(one, one)
    assert got.filter("mean = 1.5").count() == 2000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join LeftOuter, (id_" in plan


def test_loci_are_never_broadcast(spark, sf_dir):
    d = Derived(spark, sf_dir)
    for df in (d.in_window, d.loci.select("probe_id", "chr").join(d.loci.select("probe_id", "split"), "probe_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_candidate_rules_shuffle_no_sequences(spark):
    cols = ["annotations", "record_ids", "case_ids", "submitter_ids"]
    df = spark.createDataFrame([(1, 1, *["[]"] * 4)], "variant_id long, n_same_ long, " + ", ".join(f"{c} string" for c in cols))
    told, _ = audit.candidate_table_rules(df, spark.createDataFrame([(0.5,)], "a double"), ("a", "b"), ["c"])
    assert "Window" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_targets_of_a_cell_share_one_copy_of_its_sample(spark):
    import numpy as np

    rnd = random.Random(3)
    rows = [(i, rnd.randrange(3), rnd.choice([rnd.gauss(0, 1), 0.5, -0.5])) for i in range(300)]
    tier = (matching.Tier("t", ("kind",), 1),)
    df = spark.createDataFrame([(u, "a", d, x) for u, d, x in rows], "uid long, kind string, distance long, delta double")
    got = {r["uid"]: r for r in matching.sample_statistics(df, matching.choose_tiers(df, 20, tier), 40, tier).collect()}
    hashes = {r["uid"]: r["h"] for r in df.select("uid", matching.hash32(F.lit("bucket"), F.col("uid").cast("string")).alias("h")).collect()}
    for u, d, x in rows:
        near = sorted((hashes[v], v, y) for v, e, y in rows if v != u and abs(d - e) <= 1)[:40]
        y = np.array([n[2] for n in near])
        less, tied = (np.abs(y) < abs(x)).sum(), (np.abs(y) == abs(x)).sum()
        want = (len(y), y.mean(), np.median(y), y.std(ddof=1), 100 * (less + 0.5 * tied) / len(y), (1 + len(y) - less) / (len(y) + 1))
        assert np.allclose(got[u][1:], want, atol=1e-12)
    source = matching.sample_statistics(df, matching.choose_tiers(df, 20, tier), 40, tier)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in source and "lambda" not in source.split("Join")[0]  # samples meet blocks, not targets


def test_counts_of_intervals_without_pairs(spark):
    rnd = random.Random(11)
    iv = [(rnd.choice("ab"), s := rnd.randrange(-50, 900), s + rnd.randrange(-3, 300)) for _ in range(300)] + [(None, 1, 5), ("a", None, 5), ("a", 7, None)]
    points = [(i, rnd.choice(["a", "b", "z", None]), rnd.choice([None, *range(-60, 1200, 7)])) for i in range(400)]
    got = intervals.count_containing(spark.createDataFrame(points, "id long, chr string, pos long"), spark.createDataFrame(iv, "chr string, start long, end long"), "n", width=64)
    want = {i: sum(k == c and None not in (k, s, e, p) and s <= p <= e for c, s, e in iv) for i, k, p in points}
    assert {r.id: r.n for r in got.collect()} == want
    one = spark.range(2000).selectExpr("id", "'a' AS chr", "5L AS pos", "0L AS start", "9L AS end")
    assert intervals.count_containing(one, one, "n").filter("n = 2000").count() == 2000
    joins = [x for x in intervals.count_containing(one, one, "n")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 2 and all("start" not in x and "end" not in x for x in joins)


def test_binomial_tails_of_many_trials(spark):
    """Linear in the trials: chances in an array that is copied for each of them take minutes here."""
    n = 200_000
    got = metrics.binomial_tails(spark.createDataFrame([(n // 2 + 100, n), (3, 3), (0, 0)], "k long, n long"), "k", "n").collect()
    tail, term = 0, math.comb(n, n // 2 + 100)
    for j in range(n // 2 + 100, n // 2 + 8000):
        tail += term
        term = term * (n - j) // (j + 1)
    assert abs(got[0].p_greater - (tail >> (n - 64)) / 2**64) < 1e-6 and abs(got[0].p_two_sided - 2 * got[0].p_greater) < 1e-6
    assert [(round(r.p_greater, 12), round(r.p_two_sided, 12)) for r in got[1:]] == [(0.125, 0.25), (1.0, 1.0)]
    assert "concat(" not in metrics.binomial_tails(spark.range(1).selectExpr("id AS k", "id AS n"), "k", "n")._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_leads_are_not_joined_again(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choice("ab"), rnd.choice([0.1, 0.11, round(rnd.random() / 5, 4)]), 1, 0.5, "A", "G", "T>C", "transition") for i in range(200)]
    df = spark.createDataFrame(rows, "lead_id long, chr string, maf double, distance long, beta double, ref string, alt string, sbs6 string, titv string")
    got = matching.match_edges(df.filter("lead_id < 80"), df.filter("lead_id >= 80"), 0.01)
    assert sorted((r.p, r.q) for r in got.collect()) == sorted((x[0], y[0]) for x in rows[:80] for y in rows[80:] if x[1] == y[1] and abs(x[2] - y[2]) <= 0.01)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_screened_pairs_are_not_shuffled_by_variant(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries.ranks, "number_in", lambda rows, *_: rows)
    plan = queries.QUERIES["literature_screen"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" in plan


def test_locus_rules_join_no_sequences(spark):
    names = ["dna_5000", "dna_100", "dna_100_RC"]
    df = spark.createDataFrame([("cg1", "train", "chr1", 5, *["ACGT"] * 3)], "probe_id string, split string, chr string, pos long, " + ", ".join(f"{n} string" for n in names))
    told, rules = audit.locus_table_rules(df, spark.createDataFrame([(0.5,)], "a double"), ("a", "b"), ["c"])
    assert not set(names) & set(told.columns)
    by_name = {r.name: r.violated for r in rules}
    row = told.select(*(by_name[n].alias(n) for n in ("length_dna_100", "alphabet_dna_100", "slice"))).first()
    assert tuple(row) == (True, False, True)


def test_wide_sequences_are_not_translated_by_expressions(spark):
    """Their rules say what the expressions say, of odd sequences too."""
    lut = str.maketrans("ACGT", "TGCA")
    rc = lambda s: s.translate(lut)[::-1]
    s = "ACGTTTGACA" * 245 + "A" * 49 + "CG" + "T" * 49 + "ACGTTTGACA" * 245
    part, odd = s[2450:2550], "x" + s[1:]
    rows = [(s, rc(s), part), (s, s, part), (odd, rc(odd), part), (s[1:], rc(s[1:]), part), (s, None, None), (None, rc(s), part), ("é" + s[1:].lower(), rc("É" + s[1:]), part), ("", "", "")]
    df = spark.createDataFrame(rows, "seq string, other string, part string")
    faults = audit.strand_faults(F.col("seq"), F.col("other"), F.col("part"), 5000)
    named = {r.name: r.violated for r in (*audit.sequence_rules({"seq": 5000, "other": 5000}), *audit.centre_rules({"seq": 5000, "other": 5000}))}
    want = [named[f"{k}_{x}"] for x in ("seq", "other") for k in ("length", "alphabet", "centre")]
    want += [F.col("other") != audit.S.reverse_complement(F.col("seq")), F.col("part") != F.substring("seq", 2451, 100)]
    for r in df.select(faults.alias("got"), F.array(*want).alias("want")).collect():
        assert [*r.got] == r.want
    changed = [("ACGT", "AGGT", 1, False), ("ACGT", "AGGT", 2, True), ("ACGT", "ACGT", 1, True), ("ACGT", "AGGA", 1, True), ("ACGT", "AGG", 1, True), ("ACGT", "TCGT", -4, True), ("ACGT", None, 1, True), ("ACGT", "AGGT", None, True)]
    got = spark.createDataFrame(changed, "a string, b string, i int, want boolean").select(audit.change_faults(F.col("a"), F.col("b"), F.col("i")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    cols = ["annotations", "record_ids", "case_ids", "submitter_ids"]
    one = spark.createDataFrame([(1, 1, *["[]"] * 4)], "variant_id long, n_same_ long, " + ", ".join(f"{c} string" for c in cols))
    rules = audit.candidate_table_rules(one, spark.createDataFrame([(0.5,)], "a double"), ("a", "b"), ["c"])[1]
    assert not [r.name for r in rules if "5000" in r.name and "index" not in r.name and "_faults" not in str(r.violated) and "run(" not in str(r.violated)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_genome_in_buckets_is_not_shuffled(spark, sf_dir):
    """Variants come to it in the one shuffle that counts their cases, slices in one."""
    d = Derived(spark, sf_dir)
    genome, raw = chains._genome(d, 8), chains._raw(d)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        based = candidates.with_base(candidates.unique_substitutions(raw, chains.CHUNK, 8), genome, chains.CHUNK)
        plan = _plan(based)
        assert "Bucketed: true" in plan and "Bucketed: false" not in plan
        assert len([x for x in plan.split("\n") if "Exchange hashpartitioning" in x and ("pos1" in x or "chunk_id" in x)]) == 1
        plain = candidates.with_base(candidates.unique_substitutions(raw), genome.select("*"), chains.CHUNK)
        assert sorted(based.collect()) == sorted(plain.select(based.columns).collect())
        wanted = spark.createDataFrame([("chr1", 10, 60), ("chr1", 4990, 5010), ("chr1", 0, 5000), ("chr1", -1, 4), ("chr1", 7, 7), ("chr1", 0, 10**7), ("chr99", 1, 2), (None, 1, 2), ("chr1", None, 2)], "chr string, low long, high long")
        sliced = readers.genome_slices(genome, wanted, chains.CHUNK)
        assert "Bucketed: true" in _plan(sliced) and "Bucketed: false" not in _plan(sliced)
        assert {(r.chr, r.low, r.high): len(r.seq or "") for r in sliced.collect()} == {("chr1", 10, 60): 50, ("chr1", 4990, 5010): 20, ("chr1", 0, 5000): 5000, **{x: 0 for x in [("chr1", -1, 4), ("chr1", 7, 7), ("chr1", 0, 10**7), ("chr99", 1, 2), (None, 1, 2), ("chr1", None, 2)]}}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lost_candidates_have_no_sequences_to_move(spark, sf_dir):
    """Sequences of windows are met by slices alone: no other join or window has them."""
    kept = queries.QUERIES["candidates_from_raw"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "mut#" not in "".join(line for line in kept.split("\n") if "Join" in line)
    losses = queries.QUERIES["candidate_losses"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_id" not in "".join(line for line in losses.split("\n") if "Join" in line)


def test_places_in_groups_are_counted_on_one_shuffle(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(4), i, str(rnd.random())) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, g long, i long, s string").withColumn("part_", F.floor(F.col("i") / 100))
    order = [-F.col("g"), F.col("i")]
    groups = {"g": F.col("g").desc(), "part_": F.col("part_")}
    want = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", -r[1], r[2])):
        want[r[2]] = 1 + sum(1 for q in rows if q[0] == r[0] and (-q[1], q[2]) < (-r[1], r[2]))
    for parts in (None, 3):
        got = ranks.number_in(df, ["k"], order, "n", groups, parts)
        assert {r.i: r.n for r in got.collect()} == want
        plan = _plan(got)
        assert "ReusedExchange" in plan
        assert "rangepartitioning" not in plan


def test_screened_pairs_are_not_sorted_by_variant(spark, sf_dir):
    """All pairs give numbers alone to their variant: the smallest struct of a group is found by sorting its rows."""
    plan = _plan(queries.QUERIES["literature_screen"](spark, sf_dir))
    sorted_ = [x for x in plan.split("\n") if "SortAggregate(key=[variant_id" in x and "dist" in x]
    assert not sorted_ and "HashAggregate(key=[variant_id" in plan.replace("keys=", "key=") and "rangepartitioning" not in plan
