"""Whole tables of loci and of candidate variants, from their parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import audit, cohort, intervals, metrics
from .settling import settle

#: A locus is seen from so many bases before its first one to so many behind it.
WIDE, NEAR = (-2499, 2501), (-49, 51)


def pair_of(track: str) -> tuple[str, str]:
    """The features of a track that is read at both bases of a locus."""
    return f"{track}_1", f"{track}_2"


def signal_features(loci: DataFrame, signals: DataFrame, base_track: str, tracks: Sequence[str], id_col: str = "probe_id") -> DataFrame:
    """(id, features): means of the signals (track, chr, start, end, value) at the first and second base of each locus (id, chr, pos; 0-based) for `base_track`, over NEAR for `tracks`; null without a signal.

    All windows of all tracks meet the signals in one join. Repeated ids have equal places. A contig that a track
    doesn't have is looked for with `chr` taken off or put before its name.
    """
    p = F.col("pos")
    first, second = pair_of(base_track)
    windows = [(first, base_track, p, p + 1), (second, base_track, p + 1, p + 2), *((t, t, p + NEAR[0], p + NEAR[1]) for t in tracks)]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(t).alias("track"), a.alias("start"), z.alias("end")) for f, t, a, z in windows)))
    asked = loci.select(F.col(id_col).alias("id_"), "chr", "pos").distinct().select("id_", "chr", each.alias("w")).select("id_", "chr", "w.*")
    place = F.concat_ws("|", "chr", "track")
    placed = signals.withColumn("place", place)
    named = intervals.named_as(asked.select(F.struct("id_", "feature").alias("id"), place.alias("place"), "start", "end"), placed, "place")
    means = intervals.interval_mean(named, placed, key="place", width=10_000)
    return means.groupBy(F.col("id.id_").alias(id_col)).agg(*(F.max(F.when(F.col("id.feature") == f, F.col("mean"))).alias(f) for f, *_ in windows))


def with_other_strand(df: DataFrame, sequences: Sequence[str], pair: tuple[str, str] | tuple[()] = ()) -> DataFrame:
    """df with each sequence's reverse complement (`_RC`), and the pair's values and flags, if one is given, in the other order (`_RC`)."""
    swap = dict(zip(pair, reversed(pair)))
    return df.withColumns({f"{s}_RC": S.reverse_complement(F.col(s)) for s in sequences} | {f"{a}_RC{end}": F.col(f"{b}{end}") for a, b in swap.items() for end in ("", "_Missing")})


def locus_features(base_track: str, tracks: Sequence[str]) -> list[str]:
    return [*pair_of(base_track), *tracks]


def locus_table(loci: DataFrame, targets: DataFrame, signals: DataFrame, base_track: str, tracks: Sequence[str], contig_length: int) -> DataFrame:
    """Loci (probe_id, chr, pos, split, dna_5000) that are inside the contig and centred on CG and have a target (probe_id, beta, m_value, binary_state), with features, 0/1 `_Missing` flags and the other strand's view.

    Features without a signal have the median of the train split; the two bases share
    one. More than one target of a locus is an error.
    """
    p, made = F.col("pos"), ("beta", "m_value", "binary_state")
    seen = loci.withColumn("reason_", cohort.window_reason(F.lit(contig_length), p + WIDE[0], p + WIDE[1], F.col("dna_5000"))).filter("reason_ is null").drop("reason_")
    once = targets.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n_"), *(F.first(c).alias(c) for c in made))
    pair, names = pair_of(base_track), locus_features(base_track, tracks)
    # targets, features and medians come from places alone; the sequences are moved once, to their values
    places = settle(seen.select("probe_id", "chr", "pos", "split").join(audit.require(once, F.col("n_") == 1, "a locus has several targets").drop("n_"), "probe_id"))
    features = settle(signal_features(places, signals, base_track, tracks))
    filled = metrics.impute(features.join(places.select("probe_id", *made).distinct(), "probe_id"), names, F.col("split") == "train", [pair], features.join(places.select("probe_id", "split"), "probe_id"))
    valued = with_other_strand(filled, [], pair)
    cropped = with_other_strand(seen.withColumn("dna_100", S.centered_crop(F.col("dna_5000"), 100)), ["dna_100"])
    # by hash, so that sequences aren't sorted
    return cropped.join(valued.hint("shuffle_hash"), "probe_id").select(*loci.columns, *made, *names, *(f"{f}_Missing" for f in names), "dna_100", "dna_100_RC", *(f"{f}_RC{end}" for f in pair for end in ("", "_Missing")))


def candidate_table(candidates: DataFrame, signals: DataFrame, base_track: str, tracks: Sequence[str], loci: DataFrame) -> DataFrame:
    """In-window variants (variant_id, probe_id, chr, pos, split, offset, ref, alt, wt) without a reason against them, with the changed sequence, its context, features of the locus and the other strand's view.

    Missing features have the medians of the train split of `loci` (as signal_features has them, with split).
    """
    changed = candidates.withColumns({"mut": S.substitute(F.col("wt"), F.col("offset") + 49, F.col("alt")), "index": (F.col("offset") + 49).cast("int")})
    kept = changed.withColumn("reason_", cohort.candidate_reason()).filter("reason_ is null").drop("reason_")
    return described(kept, signals, base_track, tracks, loci, ["wt", "mut"])


def described(kept: DataFrame, signals: DataFrame, base_track: str, tracks: Sequence[str], loci: DataFrame, sequences: Sequence[str], features: DataFrame | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """Candidates (probe_id, chr, pos, ref, alt, wt, mut, index) with their context, the features of the locus with 0/1 `_Missing` flags, filled as in candidate_table, and the other strand's view of `sequences`.

    `features` has one row for each probe where they are known. Columns in `made` are made of those before them, so they aren't moved with a candidate.
    """
    pair, names = pair_of(base_track), locus_features(base_track, tracks)
    whole = lambda df: reduce(lambda x, m: x.withColumn(*m), (made or {}).items(), df)
    context = cohort.annotate_change(whole(kept), index=F.col("index")).drop(*(made or {}))
    valued = whole(context.join(signal_features(kept, signals, base_track, tracks, "probe_id") if features is None else features, "probe_id"))
    medians = metrics.fit_medians(loci, names, F.col("split") == "train", [pair]).select(*(F.col(f).alias(f"{f}_med_") for f in names))
    flagged = valued.crossJoin(F.broadcast(medians))  # one row
    filled = flagged.withColumns({f"{f}_Missing": F.col(f).isNull().cast("int") for f in names}).withColumns({f: F.coalesce(f, f"{f}_med_") for f in names}).drop(*medians.columns)
    return with_other_strand(filled, sequences, pair)
