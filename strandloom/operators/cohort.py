"""Loci, candidates and transcripts: funnels with a reason for each row, splices and consequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds, else null; a null condition holds."""
    return reduce(lambda out, r: out.when(F.coalesce(r[1], F.lit(True)), r[0]), reasons[1:], F.when(F.coalesce(reasons[0][1], F.lit(True)), reasons[0][0]))


def funnel(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def window_reason(contig_length: Column, low: Column, high: Column, seq: Column) -> Column:
    mid = F.floor(F.length(seq) / 2).cast("int")
    return first_reason([("out_of_bounds", (low < 0) | (high > contig_length)), ("not_cg_centred", F.substring(F.upper(seq), mid, F.lit(2)) != "CG")])


def candidate_reason() -> Column:
    """Of in-window variants (wt, mut, offset, ref)."""
    c = F.col
    return first_reason(
        [
            ("no_probe", c("probe_id").isNull()),
            ("outside_window", ~c("offset").between(-49, 50)),
            ("overlaps_cpg", c("offset").isin(0, 1)),
            ("not_cg_centred", F.substring("wt", 50, 2) != "CG"),
            ("reference_mismatch", F.substring("wt", (c("offset") + 50).cast("int"), F.lit(1)) != c("ref")),
            ("rc_not_cg_centred", F.substring(S.reverse_complement(c("mut")), 50, 2) != "CG"),
        ]
    )


def model_visible(df: DataFrame, width: int, uid: str = "uid") -> DataFrame:
    """df with index, ref, alt and reason: variants seen in the centred crop, once each."""
    w, m = S.centered_crop(F.col("wt"), width), S.centered_crop(F.col("mut"), width)
    d = S.diff_positions(w, m)
    c = width // 2 - 1
    marked = df.withColumns({"d_": d, "w_": w, "m_": m, "nth_": F.row_number().over(Window.partitionBy(uid).orderBy("wt", "mut"))})
    reason = first_reason([("outside_crop", F.size("d_") == 0), ("invalid_change", (F.size("d_") != 1) | F.get("d_", F.lit(0)).isin(c, c + 1)), ("duplicate", F.col("nth_") > 1)])
    at = F.get("d_", F.lit(0))
    return marked.withColumns({"reason": reason, "index": at, "crop_ref": F.substring("w_", at + 1, F.lit(1)), "crop_alt": F.substring("m_", at + 1, F.lit(1))}).drop("d_", "w_", "m_", "nth_")


def annotate_change(df: DataFrame, wt: str = "wt", mut: str = "mut", index: Column | None = None) -> DataFrame:
    """df with tri, sbs6, sbs96, titv and cpg_effect of ref > alt at an index."""
    i = F.col("index") if index is None else index
    ref, alt = F.col("ref"), F.col("alt")
    tri = S.trinucleotide(F.col(wt), i)
    return df.withColumns({"tri": tri, "sbs6": S.sbs6(ref, alt, tri.rlike("^[ACGT]{3}$")), "sbs96": S.sbs96(tri, ref, alt), "titv": S.titv(ref, alt), "cpg_effect": S.cpg_effect(F.col(wt), F.col(mut), i)})


def segment_offsets(segments: DataFrame, keys: list[str], order: list[str], length: str = "len") -> DataFrame:
    """segments with `before`: the coding bases of the earlier segments."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("before", F.coalesce(F.sum(length).over(w), F.lit(0)))


def splice(segments: DataFrame, key: str, place: str, seq: str, strand: str) -> DataFrame:
    """(key, cds): segments in transcript order, reverse-complemented on the minus strand."""
    s = F.when(F.col(strand) == "-", S.reverse_complement(F.col(seq))).otherwise(F.upper(seq))
    at = F.when(F.col(strand) == "-", -F.col(place)).otherwise(F.col(place))
    parts = F.array_sort(F.collect_list(F.struct(at.alias("o"), s.alias("s"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("cds"), F.count(F.lit(1)).alias("n_segments"))


def consequences(variants: DataFrame, segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(variant_id, tx, codon, alt_codon, amino, alt_amino, is_synonymous) of variants (chr, pos1, ref, alt) in coding segments (tx, chr, start, end, strand, before) with transcripts (tx, cds). A reference that the codon doesn't have drops the row."""
    hit = intervals.containing(variants, segments, point="pos1").withColumnRenamed("o_tx", "tx").join(transcripts, "tx")
    offset = S.cds_offset(F.col("pos1"), F.col("o_start"), F.col("o_end"), F.col("o_before"), F.col("o_strand"))
    minus = F.col("o_strand") == "-"
    ref, alt = (F.when(minus, S.complement(F.col(c))).otherwise(F.col(c)) for c in ("ref", "alt"))
    k = (offset % 3).cast("int")
    codon = S.codon_at(F.col("cds"), offset)
    changed = S.substitute(codon, k, alt)
    out = hit.withColumns({"codon": codon, "alt_codon": changed, "r_": F.substring(codon, k + 1, F.lit(1)), "want_": ref}).filter("r_ = want_")
    return out.select("variant_id", "tx", "codon", "alt_codon", S.amino_acid(F.col("codon")).alias("amino"), S.amino_acid(F.col("alt_codon")).alias("alt_amino"), (S.amino_acid(F.col("codon")) == S.amino_acid(F.col("alt_codon"))).alias("is_synonymous"))


def priority(tags: Column, kind: Column, support: Column, cds_length: Column, tx: Column) -> Column:
    """The order in which the transcript of a variant is chosen; smallest first."""
    has = lambda t: F.exists(tags, lambda x: F.lower(x) == t)
    tsl = F.coalesce(F.regexp_extract(support, r"^(-?[0-9]+)( |$)", 1).try_cast("int"), F.lit(99))
    zero = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    return F.struct(zero(has("mane_select")), zero(has("ensembl_canonical")), zero(F.exists(tags, lambda x: F.lower(x).startswith("appris_principal"))), zero(kind == "protein_coding"), zero(has("basic")), tsl, -F.coalesce(cds_length, F.lit(0)), tx)


def regions(loci: DataFrame, transcripts: DataFrame, utrs: DataFrame) -> DataFrame:
    """loci (chr, pos 0-based) with region, region_set and island-free overlap flags, from 1-based closed transcripts (chr, start, end, strand) and UTRs."""
    p = S.promoter_interval(F.col("start"), F.col("end"), F.col("strand"))
    promoters = transcripts.select("chr", p.alias("p_")).select("chr", "p_.start", "p_.end")
    at = loci.withColumn("pos1_", F.col("pos") + 1)
    for name, spans in (("promoter", promoters), ("utr", utrs.select("chr", "start", "end")), ("transcript", transcripts.select("chr", "start", "end"))):
        at = intervals.inside_merged(at, intervals.merge_intervals(spans), name, "pos1_")
    flags = [F.col(n) for n in ("promoter", "utr", "transcript")]
    return at.withColumns({"region": S.region_label(*flags), "region_set": S.region_set(*flags)}).drop("pos1_")


def rc_view(df: DataFrame, seq: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """The other strand's view: the sequence reverse-complemented and ordered features swapped."""
    swap = {a: b for x, y in pairs for a, b in ((x, y), (y, x))}
    return df.select(*(S.reverse_complement(F.col(c)).alias(c) if c == seq else F.col(swap.get(c, c)).alias(c) for c in df.columns))


def augmented(df: DataFrame, seq: str, pairs: list[tuple[str, str]], row: str, seed: int, epoch: int) -> DataFrame:
    """Each row in one orientation, by a fixed coin."""
    coin = S.orientation_coin(F.lit(seed), F.lit(epoch), F.col(row))
    marked = df.withColumn("rc", coin)
    return marked.filter("not rc").unionByName(rc_view(marked.filter("rc"), seq, pairs))


def _best_scores(seqs: list[str], letters: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each sequence the largest sum of a motif's scores (offset, letter) over all starts that leave it room; nan where no window has a scored letter."""
    width, sizes = len(table), np.fromiter(map(len, seqs), np.int64, len(seqs))
    out = np.full(len(seqs), np.nan)
    cp = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, fits = len(cp) - width + 1, np.flatnonzero(sizes >= width)
    if not len(letters) or not len(fits):
        return out
    at = np.minimum(np.searchsorted(letters, cp), len(letters) - 1)
    code = np.where(letters[at] == cp, at, len(letters))  # the last column: letters without a score
    total, hit = np.zeros(n), np.zeros(n, bool)
    for o in range(width):
        x = table[o][code[o : o + n]]
        there = ~np.isnan(x)
        total[there] += x[there]
        hit |= there
    total[~hit] = -np.inf
    ends = np.cumsum(sizes)
    cuts = np.stack([ends[fits] - sizes[fits], ends[fits] - width + 1], axis=1).reshape(-1)
    best = np.maximum.reduceat(np.append(total, -np.inf), cuts)[::2]
    out[fits] = np.where(np.isneginf(best), np.nan, best)
    return out


def motif_scan(seqs: DataFrame, motifs: DataFrame, id_col: str, ref: str, alt: str, least: float = 1.0, letters_at_once: int = 1 << 20) -> DataFrame:
    """(id, motif, ref_score, alt_score, delta) where |delta| > least, of each row of seqs: the best log-odds of each motif (motif, offset, base, score) in both sequences.

    Motifs are a small table that every task has; a task scores its rows where they are, so nothing is shuffled. A letter without a score counts as 0, a window of such letters not at all.
    """
    scored: dict[str, dict[tuple[int, str], float]] = {}
    widths: dict[str, int] = {}
    for m in motifs.select("motif", "offset", "base", "score").collect():
        widths[m.motif] = max(widths.get(m.motif, 0), m.offset + 1)
        of = scored.setdefault(m.motif, {})
        if m.score is not None and m.base and len(m.base) == 1:
            of[m.offset, m.base] = of.get((m.offset, m.base), 0.0) + m.score
    tables = []
    for name, of in scored.items():
        letters = np.array(sorted({ord(b) for _, b in of}), np.uint32)
        table = np.full((widths[name], len(letters) + 1), np.nan)
        for (o, b), v in of.items():
            table[o, np.searchsorted(letters, ord(b))] = v
        tables.append((name, letters, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, a = ([x or "" for x in b.column(k).to_pylist()] for k in (1, 2))
            part = np.cumsum([len(x) + len(y) for x, y in zip(r, a)]) // letters_at_once
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(r)]
            for low, high in zip(cuts, cuts[1:]):
                for name, letters, table in tables:
                    x, y = (_best_scores(s[low:high], letters, table) for s in (r, a))
                    keep = np.flatnonzero(np.abs(y - x) > least)
                    ids = b.column(0).slice(low, high - low).take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(keep), pa.string()), *map(pa.array, (x[keep], y[keep], (y - x)[keep]))], names=["id", "motif", "ref_score", "alt_score", "delta"])

    given = seqs.select(F.col(id_col), F.upper(ref).alias("r"), F.upper(alt).alias("a"))
    return given.mapInArrow(run, f"`{id_col}` {given.schema[id_col].dataType.simpleString()}, motif string, ref_score double, alt_score double, delta double")


def published(rows: DataFrame, links: DataFrame, id_col: str = "record_id", url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows with publication_ids, audit): rows with a linked publication or a URL; audit counts both kinds and those without."""
    ids = links.groupBy(id_col).agg(F.array_sort(F.collect_set("publication_id")).alias("publication_ids"))
    marked = rows.join(ids, id_col, "left").withColumn("publication_ids", F.coalesce("publication_ids", F.array().cast("array<string>")))
    has_ids, has_url = F.size("publication_ids") > 0, F.coalesce(F.trim(url) != "", F.lit(False))
    evidence = F.when(has_ids, "publication").when(has_url, "url").otherwise("none")
    return marked.filter(has_ids | has_url), marked.groupBy(evidence.alias("evidence")).agg(F.count(F.lit(1)).alias("n"))
