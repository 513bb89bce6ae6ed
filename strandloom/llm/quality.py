"""Quality rules with n-gram perplexity bands.

Spark counts the characters of each language, whose most frequent ones are its
alphabet, and the trigrams of these over the documents that pass the base rules. A
modified Kneser-Ney model of each language is kept as arrays sorted by the n-gram's
64-bit hash, which scoring probes by binary search. Documents whose perplexity leaves
their language's band are rejected, as are those that fail the base rules.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wide_letters
from .common import settle, text_or_empty

SYMBOLS = 128  # 7 bits: a language has 2**21 trigrams at most, which bounds every model
EDGE = SYMBOLS - 1
LETTERS = 112  # characters of an alphabet; all others share the symbols from here to EDGE
_SPACES, _MARKS = b" \t\n\v\f\r", b"#*$%&|<>"
_TABLE = 0x3000


def _folded() -> np.ndarray:
    """Each character below _TABLE without case; one for digits, one for white space, one for controls."""
    out = np.arange(_TABLE, dtype=np.uint32)
    for c in range(_TABLE):
        low = chr(c).lower()
        kind = unicodedata.category(chr(c))
        out[c] = 32 if kind[0] == "Z" or chr(c) in "\t\n\v\f\r" else 1 if kind[0] == "C" else 48 if kind == "Nd" else ord(low) if len(low) == 1 and ord(low) < _TABLE else c
    return out


FOLDED = _folded()


def folded(cp: np.ndarray) -> np.ndarray:
    """Characters without case, as FOLDED has them; those beyond the table as they are."""
    return np.where(cp < _TABLE, FOLDED[np.minimum(cp, _TABLE - 1)], cp)


class Alphabet:
    """Symbols of characters. Those beyond the alphabet are dealt over the symbols that are left by a hash; `quality` has alphabets only for languages that they hold whole, and wide_letters for others."""

    def __init__(self, letters: np.ndarray):
        self.letters = np.unique(letters.astype(np.uint32))[:LETTERS]
        self.low = self._symbols(FOLDED)

    def _symbols(self, cp: np.ndarray) -> np.ndarray:
        other = LETTERS + (cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(EDGE - LETTERS)
        if not len(self.letters):
            return other.astype(np.int32)
        at = np.minimum(np.searchsorted(self.letters, cp), len(self.letters) - 1)
        return np.where(self.letters[at] == cp, at, other).astype(np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """Of the folded characters, runs of white space as one, with two edges before and one after."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.low[np.minimum(cp, _TABLE - 1)]
        far = np.flatnonzero(cp >= _TABLE)
        if len(far):
            s[far] = self._symbols(cp[far])
        blank = s == self.low[32]
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        return np.concatenate([[EDGE, EDGE], s[keep], [EDGE]]).astype(np.int32)


ASCII = Alphabet(np.arange(32, 127))


def trigrams(text: str, alphabet: Alphabet = ASCII) -> np.ndarray:
    s = alphabet.symbols(text)
    return s[:-2] << 14 | s[1:-1] << 7 | s[2:]


def characters(docs: DataFrame) -> DataFrame:
    """(lang, cp, n): how often each language of (lang, text) has each folded character."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                n = np.zeros(0x110000, np.int64)
                for t in texts:
                    own = np.bincount(folded(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)))
                    n[: len(own)] += own
                seen = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "cp": seen.astype(np.int32), "n": n[seen]})

    return docs.select("lang", "text").mapInPandas(run, "lang string, cp int, n long").groupBy("lang", "cp").agg(F.sum("n").alias("n"))


def _letters(docs: DataFrame) -> tuple[dict[str, Alphabet], dict[str, int]]:
    """Of each language in (lang, text) the LETTERS most frequent folded characters, of equal ones the smaller; and how many different ones it has."""
    w = Window.partitionBy("lang")  # a language has 2**21 characters at most
    rows = characters(docs).withColumns({"nth": F.row_number().over(w.orderBy(F.desc("n"), "cp")), "all": F.count(F.lit(1)).over(w)}).filter(F.col("nth") <= LETTERS).select("lang", "cp", "all").toPandas()
    return {lang: Alphabet(g.to_numpy()) for lang, g in rows.groupby("lang")["cp"]}, {lang: int(n) for lang, n in rows.groupby("lang")["all"].max().items()}


def alphabets(docs: DataFrame) -> dict[str, Alphabet]:
    """Of each language in (lang, text) the LETTERS most frequent folded characters; of equal ones the smaller."""
    return _letters(docs)[0]


def count_trigrams(docs: DataFrame, own: dict[str, Alphabet] | None = None) -> DataFrame:
    """(lang, code, n, failed) over all rows of (lang, text): counts in documents that pass the base rules and in those that fail them."""
    shared = docs.sparkSession.sparkContext.broadcast(own or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                alphabet = shared.value.get(lang, ASCII)
                part, size = ([], []), [0, 0]
                counts = np.zeros((2, SYMBOLS**3), np.int64)
                for t in [*texts, None]:
                    if t:
                        words = t.encode().split()
                        k = int(base_failed(len(words), repeated_words(words)))
                        part[k].append(trigrams(t, alphabet))
                        size[k] += len(part[k][-1])
                    for k in (0, 1):
                        if part[k] and (t is None or size[k] > 2**21):
                            counts[k] += np.bincount(np.concatenate(part[k]), minlength=SYMBOLS**3)
                            part[k].clear()
                            size[k] = 0
                code = np.flatnonzero(counts.any(axis=0))
                yield pd.DataFrame({"lang": lang, "code": code.astype(np.int32), "n": counts[0, code], "failed": counts[1, code]})

    counted = docs.select("lang", "text").mapInPandas(run, "lang string, code int, n long, failed long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def fit_language(counts: pd.DataFrame) -> KneserNey:
    """A language's model from rows of count_trigrams: of what passes the base rules; where nothing does, of all."""
    n = counts["n"].to_numpy()
    n = n if n.any() else counts["failed"].to_numpy()
    return KneserNey.fit(counts["code"].to_numpy()[n > 0], n[n > 0])


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D(0..3): modified Kneser-Ney discounts from the counts of counts; fixed ones where those have gaps."""
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, np.clip(1 - 2 * y * n2 / n1, 0.05, 0.95), np.clip(2 - 3 * y * n3 / n2, 0.05, 1.9), np.clip(3 - 4 * y * n4 / n3, 0.05, 2.8)])


def _smooth(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities without the share of the lower order, that share), along the last axis."""
    d = _discounts(counts)[np.minimum(counts, 3).astype(np.int64)]
    total = counts.sum(axis=-1, keepdims=True)
    seen = np.maximum(total, 1)
    return (counts - d) / seen, np.where(total > 0, d.sum(axis=-1, keepdims=True) / seen, 1.0)


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of packed n-grams; no two are equal, as every step can be undone."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _sorted(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    keys = hashed(codes)
    order = np.argsort(keys)
    return keys[order], *(v[order].astype(np.float32) for v in values)


def _found(keys: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each probe, whether it is there) by binary search."""
    at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
    return at, keys[at] == probes


@dataclass
class KneserNey:
    """Arrays in the order of hashes: trigrams that occur (`codes`) with log10 probabilities; bigrams with theirs and, as contexts, log10 back-off weights; of the 128 symbols likewise."""

    codes: np.ndarray
    logs: np.ndarray
    bigrams: np.ndarray
    bigram_logs: np.ndarray
    bigram_backoffs: np.ndarray
    symbol_logs: np.ndarray
    symbol_backoffs: np.ndarray

    @classmethod
    def fit(cls, codes: np.ndarray, n: np.ndarray) -> KneserNey:
        """From the counts of trigrams; order and repetitions don't matter."""
        full = np.bincount(codes, weights=n, minlength=SYMBOLS**3).reshape((SYMBOLS,) * 3)
        left = (full > 0).sum(axis=0)  # of a bigram: the different symbols before it
        first = (left > 0).sum(axis=0)
        p1, share1 = _smooth(first, None)
        p1 = p1 + share1 / SYMBOLS
        p2, share2 = _smooth(left, p1)
        p2 = p2 + share2 * p1
        p3, share3 = _smooth(full, p2)
        p3 = (p3 + share3 * p2[None]).reshape(-1)
        here = np.flatnonzero(full)
        pairs = np.flatnonzero((left > 0) | (full.sum(axis=-1) > 0))
        return cls(*_sorted(here, np.log10(p3[here])), *_sorted(pairs, np.log10(p2.reshape(-1)[pairs]), np.log10(share3.reshape(-1)[pairs])), np.log10(p1).astype(np.float32), np.log10(share2.reshape(-1)).astype(np.float32))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """By binary search of the trigrams' hashes, then of the context and the bigram of those that aren't there."""
        at, here = _found(self.codes, hashed(codes))
        out = self.logs[at]
        rest = codes[~here]
        if len(rest):
            at, known = _found(self.bigrams, hashed(rest >> 7))
            back = np.where(known, self.bigram_backoffs[at], 0)
            at, known = _found(self.bigrams, hashed(rest & (SYMBOLS**2 - 1)))
            out[~here] = back + np.where(known, self.bigram_logs[at], self.symbol_backoffs[rest >> 7 & EDGE] + self.symbol_logs[rest & EDGE])
        return out

    def table(self) -> np.ndarray:
        """log10 of all trigrams by code."""
        return self.log10(np.arange(SYMBOLS**3)).astype(np.float32)

    def packed(self) -> bytes:
        return pickle.dumps([*vars(self).values()])


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first time included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    mark = np.zeros(len(words), bool)
    at = np.array([i for i, w in enumerate(windows) if times[w] > 1])
    for k in range(3):
        mark[at + k] = True
    return int(mark.sum())


def features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return len(words), len(text) - (len(raw) - len(raw.translate(None, _SPACES))), len(raw) - len(raw.translate(None, _MARKS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, loss double"


def fit_models(counts: DataFrame) -> DataFrame:
    """(lang, model binary) from rows of count_trigrams; a task fits a language, from 2**21 rows at most."""

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "model": [fit_language(counts).packed()]})

    return counts.groupBy("lang").applyInPandas(run, "lang string, model binary")


def score(docs: DataFrame, models: dict[str, KneserNey], own: dict[str, Alphabet]) -> DataFrame:
    """Rows of SCORED from (doc_id, lang, text); loss is the mean of -log10 p over a text's trigrams, null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast((models, own))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, own = shared.value
        for b in batches:
            rows = []
            for doc_id, lang, text in zip(b["doc_id"].astype("Int64"), b["lang"], b["text"]):
                f = features(text)
                loss = None
                if f[0] and lang in models:
                    codes = trigrams(text, own[lang])
                    loss = -float(models[lang].log10(codes).sum(dtype=np.float64)) / len(codes)
                rows.append((doc_id, lang, *f, base_failed(f[0], f[4]), loss))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCORED.split(", ")]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, SCORED)


def quality(docs: DataFrame, upper: float = 2.5, lower: float = 4.0, least_width: float = 0.02, langs_at_once: int = 8) -> DataFrame:
    """Rows of SCORED with perplexity, low, high and kept, one for each row of docs (doc_id, lang, text).

    The band of a language is its quartiles of log10 perplexity, over all documents
    that pass the base rules, widened by `upper` times their distance above and
    `lower` times below (`least_width` at least). Junk lies above; texts below are mostly repetitive
    prose, which the base rules judge. Null text counts as empty, a null language is one of its
    own; a document is kept if its language has no band. The models of `langs_at_once`
    languages (at most 26 MB each) are shipped at a time, so their number has no limit. A language of more
    than LETTERS characters has a symbol for each of them too, and its model is a table (wide_letters).
    Repeated rows stay; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty("text").alias("text"))
    own, sizes = _letters(rows)
    wide = sorted(lang for lang, n in sizes.items() if n > LETTERS)
    langs = sorted(set(own) - set(wide))
    whole, rows = rows, rows.filter(~F.col("lang").isin(wide)) if wide else rows
    fitted = settle(fit_models(count_trigrams(rows, own)))
    parts = []
    for i in range(0, len(langs), langs_at_once):
        some = langs[i : i + langs_at_once]
        models = {r.lang: KneserNey(*pickle.loads(r.model)) for r in fitted.filter(F.col("lang").isin(some)).collect()}
        parts.append(score(rows.filter(F.col("lang").isin(some)) if len(langs) > langs_at_once else rows, models, own))
    if len(langs) > langs_at_once:
        parts.append(score(rows.filter(~F.col("lang").isin(langs)), {}, {}))
    parts = parts or [score(rows, {}, {})]
    if wide:
        symbols = docs.sparkSession.createDataFrame([(lang, sizes[lang] + 1) for lang in wide], "lang string, v long")  # a row for each language; the edge is a symbol
        parts.append(wide_letters.score(whole.filter(F.col("lang").isin(wide)), symbols))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = settle(scored)
    # exact, so the same in any order of tasks; four decimals bound the number of values that are counted
    quartiles = scored.filter("not base_failed and loss is not null").groupBy("lang").agg(F.percentile(F.round("loss", 4), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    width = F.col("q")[1] - F.col("q")[0]
    edge = lambda times: F.greatest(times * width, F.lit(least_width))
    bands = quartiles.select("lang", (F.col("q")[0] - edge(lower)).alias("low"), (F.col("q")[1] + edge(upper)).alias("high"))
    inside = F.coalesce((F.col("loss") >= F.col("low")) & (F.col("loss") <= F.col("high")), F.lit(True))
    # one row for each language, whose names the driver holds already
    return scored.join(F.broadcast(bands), "lang", "left").select(*scored.columns, F.pow(F.lit(10.0), "loss").alias("perplexity"), "low", "high", (~F.col("base_failed") & inside).alias("kept"))
