"""Language identification by prediction by partial matching.

Each language has a context tree of bytes: for every context of up to ORDER bytes that
its sample shows, how often each byte follows. A byte that a context hasn't seen is coded
by an escape (as many escapes as different bytes were seen there) and the next shorter
context, without the bytes that the longer one would have coded; below the empty context
all remaining byte values are alike. The statistics are frozen after the fit, so a text's
code length is a sum over its bytes, and probabilities of all byte values add up to one.
The language with the shortest code is predicted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running
from .common import settle, unsettle

ORDER = 4
#: A language's sample: pieces of texts, each of so many bytes; both bound its tree.
PIECES, PIECE_BYTES = 512, 2048
#: Languages whose trees are held at once.
AT_ONCE = 4
#: Languages whose numbers of pieces are broadcast.
FEW = 1 << 16
#: Bytes of text whose codes are looked up together.
SLICE = 1 << 21
UNKNOWN = "und"
_START = 255  # no byte of UTF-8


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def sample(labelled: DataFrame, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(lang, piece): of each language at most `pieces` pieces of its texts (doc_id, text, lang), the first by hash; pieces lie anywhere in a text."""
    raw = F.col("text").cast("binary")
    cut = labelled.select("lang", raw.alias("raw"), F.xxhash64("doc_id", "text").alias("own_"), F.ceil(F.octet_length("text") / piece_bytes).cast("int").alias("n_")).filter("n_ > 0")
    sizes = settle(cut.groupBy("lang").agg(F.sum("n_").alias("all_")))
    if sizes.count() <= FEW:  # else texts are dealt out by their language
        sizes = F.broadcast(sizes)
    # twice as many as wanted pass by their hash; of those the first are taken
    drawn = F.pmod(F.xxhash64("own_", "at_"), F.lit(1 << 40))
    passed = cut.join(sizes, "lang").withColumn("at_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1))).withColumn("drawn_", drawn).filter(F.col("drawn_") * F.col("all_") < (2.0 * pieces + 64) * (1 << 40))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("drawn_", "own_", "at_"))
    return passed.withColumn("piece", F.expr(f"substring(raw, at_ * {piece_bytes} + 1, {piece_bytes})")).select("lang", "piece", first.alias("nth_")).filter(F.col("nth_") <= pieces).select("lang", "piece")


def codes(raw: np.ndarray, place: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Of each byte but the first `order`, which lead: it and the bytes before it as one number, oldest first; before a text's start (place 0) stand bytes that no text has."""
    n = len(raw) - order
    out = raw[order:].astype(np.uint64)
    for back in range(1, order + 1):
        before = raw[order - back : order - back + n].copy()
        before[place < back] = _START
        out |= before.astype(np.uint64) << np.uint64(8 * back)
    return out


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, depth, gram, n) of pieces."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        raw = [np.frombuffer(bytes([_START] * ORDER) + piece, np.uint8) for piece in batch.column(1).to_pylist()]
        whole = [codes(r, np.arange(len(r) - ORDER)) for r in raw]
        for lang in dict.fromkeys(langs):
            own = [whole[i] for i in np.flatnonzero(langs == lang)]
            for depth in range(ORDER + 1):
                gram, n = np.unique(np.concatenate([w[depth:] for w in own]) & np.uint64((1 << 8 * (depth + 1)) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), depth, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "depth", "gram", "n"])


def trees(labelled: DataFrame, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(grams, contexts) of all languages.

    grams: (lang, depth, gram, n). contexts: (lang, depth, context, n, kinds, n_left,
    kinds_left), what the context has seen, and what its shorter context has left
    without the bytes seen here; at depth 0 nothing is shorter.
    """
    grams = settle(sample(labelled, pieces, piece_bytes).mapInArrow(count_grams, "lang string, depth int, gram long, n long").groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n")))
    key = F.shiftrightunsigned("gram", 8)
    own = grams.groupBy("lang", "depth", key.alias("context")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    shorter = lambda c, bytes_: F.col(c).bitwiseAND(F.expr(f"shiftleft(1L, 8 * ({bytes_})) - 1"))
    below = grams.select("lang", (F.col("depth") + 1).alias("depth"), F.col("gram").alias("short_"), F.col("n").alias("n_short"))
    covered = grams.filter("depth > 0").withColumn("short_", shorter("gram", "depth")).join(below, ["lang", "depth", "short_"]).groupBy("lang", "depth", key.alias("context")).agg(F.sum("n_short").alias("covered_"))
    parent = own.select("lang", (F.col("depth") + 1).alias("depth"), F.col("context").alias("short_"), F.col("n").alias("n_up"), F.col("kinds").alias("kinds_up"))
    linked = own.withColumn("short_", F.when(F.col("depth") > 0, shorter("context", "depth - 1")).otherwise(F.col("context")))
    contexts = linked.join(covered, ["lang", "depth", "context"], "left").join(parent, ["lang", "depth", "short_"], "left")
    return grams, contexts.select("lang", "depth", "context", "n", "kinds", (F.col("n_up") - F.col("covered_")).alias("n_left"), (F.col("kinds_up") - F.col("kinds")).alias("kinds_left"))


class Tree:
    """One language's statistics as sorted arrays, a pair for each depth."""

    def __init__(self, grams, contexts):
        self.grams, self.contexts = [], []
        for depth in range(ORDER + 1):
            g = grams[grams.depth == depth].sort_values("gram")
            self.grams.append((g.gram.to_numpy(np.uint64), np.log2(g.n.to_numpy(float))))
            c = contexts[contexts.depth == depth].sort_values("context")
            n, kinds, n_left, kinds_left = (np.nan_to_num(c[k].to_numpy(float)) for k in ("n", "kinds", "n_left", "kinds_left"))
            log = lambda v: np.log2(np.maximum(v, 1))  # noqa: E731  where nothing is left there is nothing to code
            self.contexts.append((c.context.to_numpy(np.uint64), log(n + kinds), log(kinds), log(n_left + kinds_left), log(kinds_left)))
            if depth == 0:
                self.rest = np.log2(256 - kinds[0]) if len(kinds) and kinds[0] < 256 else 8.0

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Exact code lengths of bytes after their contexts."""
        out = np.zeros(len(code))
        at = np.arange(len(code))  # those not coded yet
        whole = left = np.zeros(len(code))  # what the longer context has left of this one
        escaped = np.zeros(len(code), bool)
        for depth in range(ORDER, -1, -1):
            c = code[at]
            keys, all_, kinds, all_left, kinds_left = self.contexts[depth]
            place, there = _find(keys, c >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1))
            if not there.any():
                continue
            grams, n = self.grams[depth]
            own, seen = _find(grams, c & np.uint64((1 << 8 * (depth + 1)) - 1))
            seen &= there
            of = np.where(escaped, whole, all_[place])
            out[at] += np.where(seen, of - n[own], np.where(there, of - np.where(escaped, left, kinds[place]), 0))
            whole, left, escaped = np.where(there, all_left[place], whole)[~seen], np.where(there, kinds_left[place], left)[~seen], (escaped | there)[~seen]
            at = at[~seen]
        out[at] += np.where(escaped, self.rest, 8.0)
        return out


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return place, keys[place] == values


def code_lengths(texts: pa.Array, models: list[Tree]) -> np.ndarray:
    """Bits of each text (nulls: none) under each tree. Texts follow each other in the array's buffer, which is cut in slices of SLICE bytes; what a slice has of a text is added to it."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros((len(texts), len(models)))
    if not len(texts) or ends[-1] == ends[0]:
        return out
    raw = np.concatenate([np.full(ORDER, _START, np.uint8), np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]])
    starts = ends - ends[0]
    for a in range(0, int(starts[-1]), SLICE):
        b = min(a + SLICE, int(starts[-1]))
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        cuts = np.clip(starts[first : last + 1], a, b)
        sizes = np.diff(cuts)
        place = np.arange(a, b) - np.repeat(starts[first:last], sizes)
        different, which = np.unique(codes(raw[a : b + ORDER], place), return_inverse=True)
        some = np.flatnonzero(sizes)  # reduceat would take an empty text for its neighbour
        for i, model in enumerate(models):
            out[first + some, i] += np.add.reduceat(model.bits(different)[which], (cuts[:-1] - a)[some])
    return out


def _judge(names: list[str], models: Broadcast) -> Callable:
    """Adds the languages of one part to (best_, bits_, mass_): the best so far, its bits, and the sum of all likelihoods beside its own."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(batch.schema.get_field_index("lettered_"))
            texts = batch.column(batch.schema.get_field_index("text"))
            bits = code_lengths(pc.if_else(lettered, texts, pa.scalar(None, texts.type)), models.value)
            old_best, old_bits, old_mass = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("best_", "bits_", "mass_"))
            best, low, mass = [], [], []
            for i, row in enumerate(bits):
                held = [(old_bits[i], old_best[i])] if old_best[i] is not None else []
                b, name = min([*held, *zip(row.tolist(), names)])
                m = (old_mass[i] * 2.0 ** max(b - old_bits[i], -1000.0) if held else 0.0) + float(np.exp2(np.maximum(b - row, -1000.0)).sum())
                best.append(name), low.append(b), mass.append(m)
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("best_", "bits_", "mass_")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(low, pa.float64()), pa.array(mass, pa.float64())], names=[*(f.name for f in batch.schema if f.name not in ("best_", "bits_", "mass_")), "best_", "bits_", "mass_"])

    return task


def identify(docs: DataFrame, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) of every row of docs (doc_id, text, lang).

    Trees are fitted on text and lang of rows whose crc32(doc_id) mod 3 isn't 1; a null
    doc_id counts as empty text, rows without lang or text teach nothing. A tree's sample
    is bounded by `pieces` pieces of `piece_bytes` bytes; trees of `at_once` languages are
    held at a time, and more languages take more passes. score is the likelihood's share
    among all languages, bits the code length; ties go to the smaller name. Texts that are
    null or without a letter, and all if no language was learned, get `und`, score 0 and
    null bits. Repeated rows stay; other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold() != 1))
    grams, contexts = trees(labelled, pieces, piece_bytes)
    contexts = settle(contexts)
    numbered = running(grams.select("lang").distinct(), [F.col("lang")], {"i": F.lit(1)}).withColumn("part", F.floor((F.col("i") - 1) / at_once))
    n_parts = (numbered.agg(F.max("part")).first()[0] or 0) + 1 if not numbered.isEmpty() else 0
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    state = rows.select("doc_id", "text", (fold() == 1).alias("held_out"), lettered.alias("lettered_"), F.lit(None).cast("string").alias("best_"), F.lit(None).cast("double").alias("bits_"), F.lit(None).cast("double").alias("mass_"))
    spark = docs.sparkSession
    for part in range(n_parts):
        of = numbered.filter(F.col("part") == part).select("lang")
        names = sorted(r.lang for r in of.collect())  # at_once of them
        numbers = lambda table, lang: table.filter(F.col("lang") == lang).drop("lang").toArrow().to_pandas()
        shipped = spark.sparkContext.broadcast([Tree(numbers(grams, x), numbers(contexts, x)) for x in names])
        judged = state.mapInArrow(_judge(names, shipped), state.schema)
        if part + 1 < n_parts:
            last, state = state, settle(judged)
            unsettle(last) if part else None
            shipped.unpersist()
        else:
            state = judged
    known = F.col("lettered_") & F.col("best_").isNotNull()
    return state.select("doc_id", "held_out", F.when(known, F.col("best_")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, 1 / F.col("mass_")).otherwise(0.0).alias("score"), F.when(known, F.col("bits_")).alias("bits"))
