"""Rules over a table as boolean columns, counted in one pass with a few examples each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranks import running
from .settling import settle


@dataclass(frozen=True)
class Rule:
    name: str
    violated: Column
    severity: str = "error"


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def rule_totals(df: DataFrame, rules: list[Rule], id_col: str, examples: int = 5) -> DataFrame:
    """(rule, severity, n, examples), rules without violations too. A null counts as a violation."""
    bad = F.filter(F.array(*(F.when(F.coalesce(r.violated, F.lit(True)), F.lit(i)) for i, r in enumerate(rules))), lambda x: x.isNotNull())
    hits = settle(df.select(F.col(id_col).cast("string").alias("id"), F.explode(bad).alias("i")))
    w = Window.partitionBy("i", "part_").orderBy("id")
    few = hits.withColumn("part_", F.pmod(F.hash("id"), F.lit(64))).withColumn("k_", F.row_number().over(w)).filter(F.col("k_") <= examples)  # of each of 64 parts, so no rule sorts in one task
    top = few.withColumn("k_", F.row_number().over(Window.partitionBy("i").orderBy("id"))).filter(F.col("k_") <= examples).groupBy("i").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    named = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity")) for i, r in enumerate(rules)))
    names = df.sparkSession.range(1, numPartitions=1).select(F.inline(named))  # no Python worker for literals
    counts = hits.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "i", "left").join(top, "i", "left").select("rule", "severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def verdict(totals: DataFrame) -> DataFrame:
    """(n_errors, n_warnings, status)."""
    e, w = (F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)) for s in ("error", "warning"))
    return totals.agg(e.alias("n_errors"), w.alias("n_warnings"), F.when(e == 0, "PASS").otherwise("FAIL").alias("status"))


def with_uniqueness(df: DataFrame, key: str, name: str = "n_same_") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key)))


_COMPLEMENT = str.maketrans("ACGTRYMKBDHVN", "TGCAYRKMVHDBN")


_STRAND = ("length", "alphabet", "centre", "length_RC", "alphabet_RC", "centre_RC", "rc", "slice")


def _strand_faults(width: int, seqs: pa.Array, others: pa.Array, parts: pa.Array) -> pa.Array:
    def own(s: str | None) -> tuple[bool | None, ...]:
        return (None,) * 3 if s is None else (len(s) != width, bool(s.encode("utf-8", "surrogatepass").translate(None, b"ACGTN")), s[width // 2 - 1 : width // 2 + 1] != "CG")

    cases = []
    for s, o, part in zip(seqs.to_pylist(), others.to_pylist(), parts.to_pylist()):
        other = None if s is None or o is None else s.upper().translate(_COMPLEMENT)[::-1] != o
        cases.append((*own(s), *own(o), other, None if s is None or part is None else s[width // 2 - 50 : width // 2 + 50] != part))
    return pa.StructArray.from_arrays([pa.array([c[i] for c in cases], pa.bool_()) for i in range(len(_STRAND))], [*_STRAND])


def strand_faults(seq: Column, other: Column, part: Column, width: int) -> Column:
    """Of a sequence, of what should be its other strand and its middle 100 letters a struct: whether the length isn't `width`, there are letters beyond ACGTN or the middle isn't CG, of both strands; whether the other isn't the reverse complement; whether the part isn't the middle. Null where one of them is.

    For sequences of thousands of bases: expressions go through them letter by letter, and `translate` looks up each in a map, which took most of such an audit's time.
    """

    def run(seqs: pa.Array, others: pa.Array, parts: pa.Array) -> pa.Array:
        return _strand_faults(width, seqs, others, parts)

    return F.arrow_udf(run, f"struct<{', '.join(f'{n}: boolean' for n in _STRAND)}>")(seq, other, part)


def _change_faults(before: pa.Array, after: pa.Array, index: pa.Array) -> pa.Array:
    def wrong(a: str | None, b: str | None, i: int | None) -> bool:
        return a is None or b is None or i is None or len(a) != len(b) or not 0 <= i < len(a) or a[i] == b[i] or a[:i] != b[:i] or a[i + 1 :] != b[i + 1 :]

    return pa.array([wrong(*x) for x in zip(before.to_pylist(), after.to_pylist(), index.to_pylist())], pa.bool_())


def change_faults(a: Column, b: Column, index: Column) -> Column:
    """Whether a and b don't differ in the letter at a 0-based index alone; true with a null."""
    return F.arrow_udf(_change_faults, "boolean")(a, b, index)


def sequence_rules(sequences: dict[str, int]) -> list[Rule]:
    """Length and alphabet of each sequence column with its width."""
    return [Rule(f"length_{s}", F.length(s) != n) for s, n in sequences.items()] + [Rule(f"alphabet_{s}", ~S.has_alphabet(F.col(s))) for s in sequences]


def centre_rules(sequences: dict[str, int]) -> list[Rule]:
    return [Rule(f"centre_{s}", F.substring(s, n // 2, 2) != "CG") for s, n in sequences.items()]


def value_rules(pair: tuple[str, str], tracks: Sequence[str]) -> list[Rule]:
    """Features and flags, against their medians (`_fit_`), and the other strand's view of the pair."""
    c, features = F.col, [*pair, *tracks]
    some = lambda of: reduce(lambda x, y: x | y, of)
    yes = lambda x: F.coalesce(x, F.lit(True))
    known = lambda x: F.coalesce(x, F.lit(False))
    a, b = pair
    return [
        Rule("feature_finite", some([c(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf")) for f in features])),
        Rule("flag_binary", some([yes(~c(f"{f}_Missing").isin(0, 1)) for f in features])),
        Rule("flagged_not_imputed", some([yes((c(f"{f}_Missing") == 1) & (F.abs(c(f) - c(f"{f}_fit_")) > 2e-6)) for f in features])),
        Rule("rc_first_value", F.abs(c(f"{a}_RC") - c(b)) > 2e-6),
        Rule("rc_second_value", F.abs(c(f"{b}_RC") - c(a)) > 2e-6),
        Rule("rc_flags", (c(f"{a}_RC_Missing") != c(f"{b}_Missing")) | (c(f"{b}_RC_Missing") != c(f"{a}_Missing"))),
        Rule("negative_signal", some([known(c(f) < 0) for f in tracks]), "warning"),
        Rule("extreme_base_signal", some([known(F.abs(f) > 25) for f in pair]), "warning"),
    ]


def with_medians(df: DataFrame, medians: DataFrame) -> DataFrame:
    """df with each of the one row of medians as `_fit_`."""
    return df.crossJoin(F.broadcast(medians.select(*(F.col(c).alias(f"{c}_fit_") for c in medians.columns))))


def locus_table_rules(df: DataFrame, medians: DataFrame, pair: tuple[str, str], tracks: Sequence[str]) -> tuple[DataFrame, list[Rule]]:
    """A table as assembly.locus_table makes it, with what the rules need, and all rules of a training file."""
    c = F.col
    widths = {"dna_5000": 5000, "dna_100": 100, "dna_100_RC": 100}
    splits = df.groupBy("probe_id", "split").agg(F.count(F.lit(1)).alias("n_same_"))
    across = splits.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n_splits_"))
    seen = [*sequence_rules(widths), *centre_rules(widths), Rule("slice", c("dna_100") != F.substring("dna_5000", 2451, 100)), Rule("rc_equality", c("dna_100_RC") != S.reverse_complement(c("dna_100")))]
    # sequences are seen where they are, and only their verdicts are joined
    judged = df.withColumns({f"{r.name}_seen_": r.violated for r in seen}).drop(*widths)
    told = with_medians(judged.join(splits, ["probe_id", "split"]).join(across, "probe_id"), medians)
    rules = [
        Rule("id_prefix", ~c("probe_id").startswith("cg")),
        Rule("split_label", ~c("split").isin("train", "val", "test")),
        Rule("split_of_chromosome", c("split") != S.split_of(c("chr"))),
        Rule("duplicate_in_split", c("n_same_") > 1),
        Rule("in_several_splits", c("n_splits_") > 1),
        Rule("chromosome", ~c("chr").isin(*S.CHROMOSOMES)),
        Rule("position", c("pos") < 0),
        *(Rule(r.name, c(f"{r.name}_seen_"), r.severity) for r in seen),
        Rule("target_missing", c("beta").isNull() | c("m_value").isNull() | c("binary_state").isNull()),
        Rule("beta_range", ~c("beta").between(0, 1)),
        Rule("binary_domain", ~c("binary_state").isin(0, 1)),
        Rule("binary_vs_beta", S.binary_state(c("beta")) != c("binary_state")),
        Rule("m_vs_beta", F.abs(S.beta_to_m(c("beta")) - c("m_value")) > 1e-5),
        *value_rules(pair, tracks),
    ]
    return told, rules


def candidate_table_rules(df: DataFrame, medians: DataFrame, pair: tuple[str, str], tracks: Sequence[str], held_out: tuple[str, ...] = ("val", "test")) -> tuple[DataFrame, list[Rule]]:
    """A table as assembly.candidate_table makes it, with places, both widths, a transcript and lists of identifiers as JSON; what the rules need, and all rules of a candidate file.

    Columns beyond the table's: offset_ (its offset), pos0, pos1, distance, index_5000, dna_5000, mut_5000 and their `_RC`,
    transcript, gene, strand, ref_codon, alt_codon, annotations, record_ids, case_ids, submitter_ids, occurrence. Where df has the
    number of rows of its variant as n_same_, its sequences needn't be shuffled to count them.
    """
    c = F.col
    widths = {f"{s}{end}": n for n, both in ((5000, ("dna_5000", "mut_5000")), (100, ("wt", "mut"))) for end in ("", "_RC") for s in both}
    lists = {"n_annotations": "annotations", "n_records": "record_ids", "n_cases": "case_ids", "n_submitters": "submitter_ids"}
    told = with_medians(df if "n_same_" in df.columns else with_uniqueness(df, "variant_id"), medians).withColumns({n: F.size(S.json_list(c(x))) for n, x in lists.items()}).withColumns({n: F.when(c(n) >= 0, c(n)) for n in lists})
    at = c("index_5000").cast("int")
    near = at - 2450
    wide = {"dna_5000": "wt", "mut_5000": "mut"}
    faults = {s: strand_faults(c(s), c(f"{s}_RC"), c(part), 5000) for s, part in wide.items()}
    known = {f"{kind}_{s}{end}": f[f"{kind}{end}"] for s, f in faults.items() for kind in ("length", "alphabet", "centre") for end in ("", "_RC")}

    def changes(a: str, b: str, i: Column) -> Column:
        """Not exactly one change, at i: a with b's letter there isn't b, or the letters are equal."""
        letter = F.substring(b, i + 1, F.lit(1))
        whole = F.concat(F.substring(a, F.lit(1), i), letter, F.substring(a, i + 2, F.length(a)))
        return F.coalesce((whole != c(b)) | (F.substring(a, i + 1, F.lit(1)) == letter) | ~i.between(0, F.length(a) - 1), F.lit(True)) | (F.length(a) != F.length(b))

    rules = [
        Rule("duplicate_id", c("n_same_") > 1),
        Rule("split_of_chromosome", c("split") != S.split_of(c("chr"))),
        Rule("held_out", ~c("split").isin(*held_out)),
        Rule("annotation_missing", (c("transcript") == "") | (c("gene") == "")),
        Rule("strand", ~c("strand").isin("+", "-")),
        Rule("codon_length", (F.length("ref_codon") != 3) | (F.length("alt_codon") != 3)),
        Rule("annotations_list", c("n_annotations").isNull()),
        Rule("no_annotation", c("n_annotations") < 1),
        Rule("snv_bases", ~(c("ref").isin(*S.BASES) & c("alt").isin(*S.BASES)) | (c("ref") == c("alt"))),
        Rule("coordinates_missing", reduce(lambda x, y: x | y, [c(x).isNull() for x in ("pos0", "pos1", "pos", "offset_", "distance", "index_5000")])),
        Rule("pos0_of_pos1", c("pos0") != c("pos1") - 1),
        Rule("offset_of_places", c("offset_") != c("pos0") - c("pos")),
        Rule("distance", c("distance") != F.abs("offset_")),
        Rule("index_of_offset", c("index_5000") != 2499 + c("offset_")),
        Rule("index_bounds", ~c("index_5000").between(0, 4999)),
        *(Rule(r.name, known.get(r.name, r.violated)) for r in (*sequence_rules(widths), *centre_rules(widths))),
        *(Rule(f"rc_{s}", f["rc"]) for s, f in faults.items()),
        *(Rule(f"rc_{s}", c(f"{s}_RC") != S.reverse_complement(c(s))) for s in wide.values()),
        *(Rule(f"slice_{part}", faults[s]["slice"]) for s, part in wide.items()),
        Rule("one_change", change_faults(c("dna_5000"), c("mut_5000"), at)),
        Rule("alleles_at_index", (F.substring("dna_5000", at + 1, F.lit(1)) != c("ref")) | (F.substring("mut_5000", at + 1, F.lit(1)) != c("alt"))),
        Rule("one_change_100", changes("wt", "mut", near)),
        Rule("trinucleotide", ~c("tri").rlike("^[ACGTN]{3}$")),
        Rule("sbs96", ~c("sbs96").rlike(r"^[ACGTN]\[[CT]>[ACGT]\][ACGTN]$")),
        Rule("record_list", c("n_records").isNull()),
        Rule("no_record", c("n_records") < 1),
        Rule("case_list", c("n_cases").isNull()),
        Rule("submitter_list", c("n_submitters").isNull()),
        Rule("occurrence_positive", c("occurrence") < 1),
        Rule("occurrence_of_lists", c("occurrence") != F.greatest("n_cases", "n_submitters")),
        *value_rules(pair, tracks),
    ]
    return told, rules


def lead_rules() -> list[Rule]:
    """For a locked benchmark of leads (qval, maf, slope, n_same_)."""
    c = F.col
    return [Rule("duplicate_id", c("n_same_") > 1), Rule("q_range", ~c("qval").between(0, 1)), Rule("maf_range", ~c("maf").between(0, 0.5)), Rule("slope_zero", c("slope") == 0), Rule("chromosome", ~c("chr").isin(*S.CHROMOSOMES)), Rule("significant", c("qval") >= 0.05, "warning")]


def benchmark_rules() -> list[Rule]:
    """For a locked benchmark: associations (lead_id, qval, slope, maf, pos0, pos1, offset_, chr, split, flag, ref, alt) of loci (probe_id, locus_pos), with n_same_. Any violation fails it."""
    c = F.col
    finite = lambda x: c(x).isNull() | F.isnan(x)
    return [
        Rule("duplicate_id", c("n_same_") > 1),
        Rule("q_finite", finite("qval")),
        Rule("q_range", ~c("qval").between(0, 1)),
        Rule("not_significant", c("qval") >= 0.05),
        Rule("slope_finite", finite("slope")),
        Rule("slope_zero", c("slope") == 0),
        Rule("maf_range", ~c("maf").between(0, 0.5)),
        Rule("places_missing", reduce(lambda x, y: x | y, [c(x).isNull() for x in ("pos0", "pos1", "locus_pos", "offset_")])),
        Rule("places_integral", (c("pos0") != F.floor("pos0")) | (c("pos1") != F.floor("pos1"))),
        Rule("place_negative", c("locus_pos") < 0),
        Rule("pos0_of_pos1", c("pos0") != c("pos1") - 1),
        Rule("offset_of_places", c("offset_") != c("pos0") - c("locus_pos")),
        Rule("outside_window", ~c("offset_").between(-499, 500)),
        Rule("protected_pair", c("offset_").isin(0, 1)),
        Rule("chromosome", ~c("chr").isin(*S.CHROMOSOMES)),
        Rule("split_label", ~c("split").isin("train", "val", "test")),
        Rule("split_of_chromosome", c("split") != S.split_of(c("chr"))),
        Rule("flag_binary", ~c("flag").isin(0, 1)),
        Rule("alleles", ~(c("ref").isin(*S.BASES) & c("alt").isin(*S.BASES)) | (c("ref") == c("alt"))),
        Rule("locus_missing", c("probe_id") == ""),
    ]


def alignment(predictions: DataFrame, key: str, runs: list[str], truth: str, n_runs: int, within: float = 1e-10) -> DataFrame:
    """(n_keys, n_incomplete, n_truth_differs): every run has every key, with one truth."""
    per = predictions.groupBy(key).agg(F.countDistinct(*runs).alias("r_"), (F.max(truth) - F.min(truth)).alias("d_"))
    return per.agg(F.count(F.lit(1)).alias("n_keys"), F.count(F.when(F.col("r_") != n_runs, 1)).alias("n_incomplete"), F.count(F.when(F.col("d_") > within, 1)).alias("n_truth_differs"))


def mask_counts(df: DataFrame, masks: list[str]) -> DataFrame:
    """(mask, n_true, n_false) of boolean columns."""
    long_ = df.select(*masks).unpivot([], masks, "mask", "v")
    return long_.groupBy("mask").agg(F.count(F.when(F.col("v"), 1)).alias("n_true"), F.count(F.when(~F.col("v"), 1)).alias("n_false"))


def selection_audit(saved: DataFrame, expected: DataFrame, key: str, order: str) -> DataFrame:
    """(n_saved, n_expected, n_unexpected, n_omitted, n_duplicate, same_order)."""
    a = saved.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), F.min(order).alias("a_"))
    b = expected.groupBy(key).agg(F.min(order).alias("b_"))
    j = a.join(b, key, "full")
    placed = j
    for at, name in (("a_", "pa_"), ("b_", "pb_")):
        in_order = running(j.filter(F.col(at).isNotNull()).select(key, at), [F.col(at), F.col(key)], {name: F.lit(1)})
        placed = placed.join(in_order.select(key, name), key, "left")
    n = lambda c: F.count(F.when(c, 1))
    return placed.agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n_saved"), n(F.col("b_").isNotNull()).alias("n_expected"), n(F.col("b_").isNull()).alias("n_unexpected"), n(F.col("a_").isNull()).alias("n_omitted"), F.coalesce(F.sum(F.col("n_") - 1), F.lit(0)).alias("n_duplicate"), (n(F.col("a_").isNull() | F.col("b_").isNull() | (F.col("pa_") != F.col("pb_"))) == 0).alias("same_order"))


def count_contract(tables: dict[str, DataFrame], wanted: dict[str, int]) -> DataFrame:
    """(table, wanted, n, ok)."""
    out = None
    for name, n in wanted.items():
        row = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(n).cast("long").alias("wanted"), "n", (F.col("n") == n).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df, failing at the first row where ok does not hold."""
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def check_splits(val: list[str], test: list[str], known: list[str] = S.CHROMOSOMES) -> None:
    """Fails unless both splits have chromosomes, all known, none in both, and some are left to train on."""
    v, t, k = set(val), set(test), set(known)
    if not v or not t:
        raise ValueError("a split without chromosomes")
    if v & t or (v | t) - k or not k - v - t:
        raise ValueError(f"splits overlap, name unknown chromosomes or leave none: {sorted(v & t)}, {sorted((v | t) - k)}")
