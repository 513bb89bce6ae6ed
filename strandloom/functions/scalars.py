"""Scalar functions over sequences, variants, methylation values and names; all built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Standard genetic code, codons in the order of TCAG for each position (fixed values).
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHROMOSOMES = [f"chr{c}" for c in (*range(1, 23), "X", "Y")]


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


# Sequences -----------------------------------------------------------------


def complement(s: Column) -> Column:
    """IUPAC letters."""
    return F.translate(F.upper(s), "ACGTRYMKBDHVN", "TGCAYRKMVHDBN")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def centered_crop(s: Column, width: int) -> Column:
    """The middle `width` characters; fails on shorter sequences."""
    start = F.expr("1") * F.floor(F.length(s) / 2) - width // 2 + 1
    cut = F.substring(s, start.cast("int"), F.lit(width))
    return F.when(F.length(s) < width, F.raise_error(F.lit(f"sequence shorter than {width}"))).otherwise(cut)


def substitute(s: Column, index: Column, alt: Column) -> Column:
    """s with the character at a 0-based index replaced."""
    return F.overlay(s, alt, (index + 1).cast("int"), F.lit(1))


def diff_positions(a: Column, b: Column) -> Column:
    """0-based positions where two strings of one length differ; null if lengths differ."""
    at = F.filter(F.sequence(F.lit(0), F.length(a) - 1), lambda i: F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), at)


def single_difference(a: Column, b: Column) -> Column:
    """struct(index, ref, alt) if the strings differ in exactly one ACGT letter, else null."""
    d = diff_positions(a, b)
    i = F.get(d, F.lit(0))
    ref, alt = F.substring(a, i + 1, F.lit(1)), F.substring(b, i + 1, F.lit(1))
    return F.when((F.size(d) == 1) & ref.isin(*BASES) & alt.isin(*BASES), F.struct(i.alias("index"), ref.alias("ref"), alt.alias("alt")))


def trinucleotide(s: Column, index: Column) -> Column:
    return F.when((index <= 0) | (index >= F.length(s) - 1), F.lit("NNN")).otherwise(F.substring(F.upper(s), index.cast("int"), F.lit(3)))


def sbs6(ref: Column, alt: Column, known: Column | None = None) -> Column:
    """The substitution with a pyrimidine reference; as given where the context is not `known`."""
    flip = ref.isin("A", "G") & (F.lit(True) if known is None else known)
    return F.when(flip, F.concat(complement(ref), F.lit(">"), complement(alt))).otherwise(F.concat(ref, F.lit(">"), alt))


def sbs96(tri: Column, ref: Column, alt: Column) -> Column:
    known = tri.rlike("^[ACGT]{3}$")
    side = F.when(ref.isin("A", "G"), reverse_complement(tri)).otherwise(tri)
    full = F.concat(F.substring(side, 1, 1), F.lit("["), sbs6(ref, alt), F.lit("]"), F.substring(side, 3, 1))
    return F.when(known, full).otherwise(F.concat(F.lit("N["), ref, F.lit(">"), alt, F.lit("]N")))


def titv(ref: Column, alt: Column) -> Column:
    return F.when(F.concat(F.least(ref, alt), F.greatest(ref, alt)).isin("AG", "CT"), "transition").otherwise("transversion")


def cpg_effect(wt: Column, mut: Column, index: Column) -> Column:
    """What a substitution at a 0-based index does to the CG pairs that hold it."""

    def has(s, start):
        inside = (start >= 0) & (start < F.length(s) - 1)
        return inside & (F.substring(F.upper(s), (start + 1).cast("int"), F.lit(2)) == "CG")

    at = [index - 1, index]
    created = reduce(Column.__or__, [has(mut, i) & ~has(wt, i) for i in at])
    destroyed = reduce(Column.__or__, [has(wt, i) & ~has(mut, i) for i in at])
    return F.when(created & destroyed, "both_created_and_destroyed").when(created, "created").when(destroyed, "destroyed").otherwise("unchanged")


def amino_acid(codon: Column) -> Column:
    """Null unless three letters of ACGT."""
    place = lambda k: F.instr(F.lit("TCAG"), F.substring(codon, k, 1)) - 1
    index = 16 * place(1) + 4 * place(2) + place(3)
    return F.when(codon.rlike("^[ACGT]{3}$"), F.substring(F.lit(AMINO_ACIDS), (index + 1).cast("int"), F.lit(1)))


def cds_offset(position: Column, start: Column, end: Column, before: Column, strand: Column) -> Column:
    """0-based offset in the coding sequence of a 1-based position in a segment with `before` coding bases ahead of it."""
    return before + F.when(strand == "+", position - start).otherwise(end - position)


def codon_at(cds: Column, offset: Column) -> Column:
    return F.substring(cds, (3 * F.floor(offset / 3) + 1).cast("int"), F.lit(3))


# Methylation ---------------------------------------------------------------


def beta_to_m(beta: Column, margin: float = 1e-4) -> Column:
    b = F.least(F.greatest(beta, F.lit(margin)), F.lit(1 - margin))
    return F.log2(b / (1 - b))


def m_to_beta(m: Column) -> Column:
    """Stable in both tails."""
    e = F.pow(F.lit(2.0), -F.abs(m))
    return F.when(m >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def binary_state(beta: Column) -> Column:
    return (beta > 0.5).cast("int")


def gate_share(first: Column, second: Column) -> Column:
    return first / F.greatest(first + second, F.lit(1e-12))


# Names ---------------------------------------------------------------------


def normal_chromosome(c: Column) -> Column:
    c = F.trim(c)
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def chromosome_order(c: Column) -> Column:
    """1 to 22, X 23, Y 24, others 10000."""
    name = F.regexp_replace(c, "^chr", "")
    return F.when(name == "X", 23).when(name == "Y", 24).when(name.rlike("^([1-9]|1[0-9]|2[0-2])$"), name.cast("int")).otherwise(10000)


def split_of(c: Column, test=("chr8", "chr9"), val=("chr10", "chr11")) -> Column:
    return F.when(c.isin(*test), "test").when(c.isin(*val), "val").otherwise("train")


def locus_key(c: Column, pos1: Column, ref: Column, alt: Column) -> Column:
    """The alleles without order."""
    return F.concat_ws(":", normal_chromosome(c), pos1.cast("string"), F.least(ref, alt), F.greatest(ref, alt))


def variant_id_fields(v: Column) -> Column:
    """struct(chr, pos1, ref, alt) of chrN_pos_R_A_build, single bases only."""
    p = r"^(chr[0-9XY]+)_([0-9]+)_([ACGT])_([ACGT])(?:_.*)?$"
    part = lambda k: F.nullif(F.regexp_extract(v, p, k), F.lit(""))
    return F.struct(part(1).alias("chr"), part(2).cast("long").alias("pos1"), part(3).alias("ref"), part(4).alias("alt"))


def genomic_change_fields(change: Column, chrom: Column, pos1: Column, ref: Column, alt: Column) -> Column:
    """struct(chr, pos1, ref, alt) of chrN:g.POSR>A; what doesn't parse comes from the fields."""
    p = r"^(chr[0-9XYM]+):g\.([0-9]+)([ACGT])>([ACGT])$"
    part = lambda k: F.nullif(F.regexp_extract(change, p, k), F.lit(""))
    return F.struct(
        F.coalesce(part(1), normal_chromosome(chrom)).alias("chr"), F.coalesce(part(2).cast("long"), pos1).alias("pos1"), F.coalesce(part(3), ref).alias("ref"), F.coalesce(part(4), alt).alias("alt")
    )


def barcode_fields(barcode: Column) -> Column:
    """The components of a sample barcode, separated by - or ."""
    t = F.transform(F.filter(F.split(F.trim(barcode), "[-.]"), lambda x: x != ""), F.upper)
    head = lambda n: F.array_join(F.slice(t, 1, n), "-")
    at = lambda i: F.coalesce(F.get(t, F.lit(i)), F.lit(""))
    portion = lambda a, n, least: F.when(F.length(at(4)) >= least, F.substring(at(4), a, n)).otherwise("")
    return F.struct(
        F.array_join(t, "-").alias("barcode"), head(3).alias("participant_id"), head(4).alias("sample_id"), F.substring(at(3), 1, 2).alias("sample_type"), F.substring(at(3), 3, 9).alias("vial"),
        portion(1, 2, 2).alias("portion"), portion(3, 9, 3).alias("analyte"), at(5).alias("plate"), at(6).alias("center"), F.size(t).alias("n_components"),
    )


def normal_sample(barcode: Column) -> Column:
    """Whether a column is a normal-tissue sample (type 11)."""
    return barcode.rlike(r"(?i)^TCGA[-.][A-Z0-9]{2}[-.][A-Z0-9]{4}[-.]11[A-Z]")


#: By strictness: the words for true and false, and whether blank counts as false.
BOOLEAN_WORDS = {
    "blank_is_false": (("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n", "", "<na>", "nan"), True),
    "words": (("true", "t", "1", "yes"), ("false", "f", "0", "no"), False),
    "strict": (("true", "1"), ("false", "0"), False),
}


def to_boolean(x: Column, level: str = "words") -> Column:
    """Fails on other words."""
    yes, no, blank = BOOLEAN_WORDS[level]
    s = F.lower(F.trim(x.cast("string")))
    out = F.when(s.isin(*yes), True).when(s.isin(*no), False)
    out = out.when(s.isNull(), False) if blank else out
    return out.otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(s, F.lit("null")))).cast("boolean"))


def island_context(x: Column) -> Column:
    """Five labels; shore and shelf come before island."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("NA")))), "[- ]", "_")
    return (
        F.when(low.isin("na", "nan", "none", "", "opensea", "open_sea"), "Open sea")
        .when(low.contains("shore"), "Shore")
        .when(low.contains("shelf"), "Shelf")
        .when(low.contains("island") | (low == "cgi"), "Island")
        .otherwise("Unclassified")
    )


def region_label(promoter: Column, utr: Column, transcript: Column) -> Column:
    return F.when(promoter, "Promoter/TSS").when(utr, "UTR").when(transcript, "Gene body").otherwise("Intergenic")


def region_set(promoter: Column, utr: Column, transcript: Column) -> Column:
    """All overlaps, joined; a transcript span counts outside UTRs."""
    names = F.array(F.when(promoter, "Promoter/TSS"), F.when(utr, "UTR"), F.when(transcript & ~utr, "Transcript span"))
    return F.coalesce(F.nullif(F.array_join(F.filter(names, lambda n: n.isNotNull()), "; "), F.lit("")), F.lit("None"))


def promoter_interval(start: Column, end: Column, strand: Column, up: int = 1500, down: int = 200) -> Column:
    """struct(start, end), 1-based closed, around the strand's first base."""
    plus = F.struct(F.greatest(F.lit(1), start - up).alias("start"), (start + down).alias("end"))
    minus = F.struct(F.greatest(F.lit(1), end - down).alias("start"), (end + up).alias("end"))
    return F.when(strand == "+", plus).otherwise(minus)


def distance_bin(d: Column) -> Column:
    return F.when(d <= 50, "0-50").when(d <= 100, "51-100").when(d <= 250, "101-250").when(d <= 500, "251-500")


def block_id(c: Column, pos: Column, width: int = 1_000_000) -> Column:
    return F.concat_ws(":", c, F.floor(pos / width).cast("string"))


def aligned_slope(slope: Column, effect: Column, ref: Column, alt: Column) -> Column:
    """The slope of the alternate allele; null if the effect allele is neither."""
    return F.when(effect == alt, slope).when(effect == ref, -slope)


def json_list(x: Column) -> Column:
    """array<string>, null where the text is no JSON list."""
    return F.from_json(x, "array<string>")


def has_alphabet(s: Column, letters: str = "ACGTN") -> Column:
    return s.rlike(f"^[{letters}]*$")


def hash32(*parts: Column) -> Column:
    """The first 8 hex digits of md5 of the parts joined by |, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def orientation_coin(seed: Column, epoch: Column, row: Column, probability: float = 0.5) -> Column:
    """A fixed coin for (seed, epoch, row)."""
    return hash32(seed.cast("string"), epoch.cast("string"), row.cast("string")) < int(probability * 2**32)


def selection_tier(split: Column, external: Column) -> Column:
    return (
        F.when((split == "test") & external, "1_heldout_test_plus_external_breast_mQTL")
        .when(split == "test", "2_heldout_test_exploratory")
        .when(split == "val", "3_validation_split_exploratory")
        .otherwise("4_training_split_illustration_only")
    )


def gene_symbols(symbols: Column, title: Column, located: Column | None = None) -> Column:
    """Distinct symbols in order: the listed ones, those of the record's locations, then one in brackets in the title."""
    named = F.regexp_extract(F.coalesce(title, F.lit("")), r"\(([A-Za-z0-9-]+)\)", 1)
    none = F.array().cast("array<string>")
    lists = [F.coalesce(x, none) for x in (symbols, located) if x is not None]
    return F.array_distinct(F.filter(F.concat(*lists, F.array(named)), lambda s: s.isNotNull() & (s != "")))


def mentions_any(text: Column, terms: list[str]) -> Column:
    """Whether lower-cased text contains a term."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, terms)), lambda t: low.contains(t))


def q_class(q: Column) -> Column:
    """significant below 0.05, nonsignificant from 0.5, else null."""
    return F.when(q < 0.05, "significant").when(q >= 0.5, "nonsignificant")
