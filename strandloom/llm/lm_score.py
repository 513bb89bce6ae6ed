"""Language-model scores by deleted interpolation of word n-grams.

Maximum-likelihood bigrams, unigrams and a uniform share are mixed with weights that
depend on the bucket of the context's frequency; expectation-maximisation learns the
weights on the counts of a held-out fold of the training documents, against estimates
from the others. Every word is a context, whatever its frequency.

No task meets the whole vocabulary. Texts become blocks of numbered tokens. A block asks
for the counts of its distinct words, then of its distinct bigrams: sorted arrays of
their hashes, cut into ranges of hashes (shards). A shard adds up the requests of all
blocks and answers with arrays of the same order, from which the block scores its texts.
"""

from __future__ import annotations

from collections import defaultdict
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.settling import shared_dir
from .common import settle, text_or_empty, words_of

END = b""  # the token after the last word, and the context before the first; no word is empty
STEPS = 8  # of a probability's binary logarithm in the histogram that the weights are learned from
HELD_OUT, DEV = 1, 0
#: Characters of a block's texts, if it has more than one; keys that a shard adds up, on average.
BLOCK_CHARS, SHARD_KEYS = 1 << 22, 1 << 20
_TIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

BLOCKS = "block long, n_main long, n_dev long, n_texts int, ids binary, empty_ids binary, folds binary, sizes binary, tokens binary, words binary"
REQUEST = "shard long, block long, keys binary, main binary, dev binary, told binary"
#: kind ANSWER: counts in the order of a block's request; SUMS: of a shard, two numbers or a histogram.
ANSWERS = "kind int, block long, shard long, main binary, dev binary"
ANSWER, SUMS = 0, 1


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0, compressed by planes of their bytes."""
    return zstandard.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8")[:, 0] if len(planes) else np.zeros(0, np.uint64)


def counts_in(column: Iterable[bytes]) -> np.ndarray:
    """The counts of several arrays, one after another."""
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(x).astype(np.int64) for x in column)])


def by_block(blocks: DataFrame, parts: int) -> DataFrame:
    """blocks, written once in buckets of their numbers, so that answers come to them without shuffling them."""
    spark, name = blocks.sparkSession, f"strandloom_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(parts, "block").sortBy("block").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def folds(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, fold)."""
    doc_id = F.col(id_col).cast("long")
    fold = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")
    return docs.select(doc_id.alias("doc_id"), text_or_empty(text_col).alias("text"), fold.alias("fold"))


def token_blocks(rows: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of BLOCKS from (doc_id, text, fold): tokens as numbers of the block's own, and the hash of each number's word. 0 is END."""

    def block(number: int, ids: list, texts: list[str], fold: list[int]) -> tuple:
        own: defaultdict[bytes, int] = defaultdict()
        own.default_factory = own.__len__
        number_of, end = own.__getitem__, own[END]
        sizes, tokens = np.zeros(len(texts), np.int32), []
        for i, t in enumerate(texts):
            words = words_of(t)
            sizes[i] = len(words) + 1
            tokens.append(np.fromiter(map(number_of, words), np.int32, len(words)))
            tokens.append(np.array([end], np.int32))
        folds = np.array(fold, np.uint8)
        empty = np.array([pd.isna(x) for x in ids])
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), np.uint64, len(own))
        return (
            number, int(sizes[folds > HELD_OUT].sum()), int(sizes[folds == DEV].sum()), len(texts),
            np.array([0 if e else x for x, e in zip(ids, empty)], np.int64).tobytes(), empty.tobytes(), folds.tobytes(), sizes.tobytes(),
            zstandard.compress(np.concatenate(tokens).tobytes(), 1), hashes.tobytes(),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        ids, texts, fold, size = [], [], [], 0
        for b in batches:
            for i, t, f in zip(b["doc_id"].astype("Int64"), b["text"], b["fold"]):
                if texts and size + len(t) > block_chars:
                    yield pd.DataFrame([block(number, ids, texts, fold)], columns=names)
                    number, ids, texts, fold, size = number + 1, [], [], [], 0
                ids.append(i)
                texts.append(t)
                fold.append(f)
                size += len(t)
        if texts:
            yield pd.DataFrame([block(number, ids, texts, fold)], columns=names)

    return rows.select("doc_id", "text", "fold").mapInPandas(run, BLOCKS)


class Block:
    """A row of BLOCKS, opened."""

    def __init__(self, row):
        self.number = int(row.block)
        self.sizes = np.frombuffer(row.sizes, np.int32).astype(np.int64)
        self.folds = np.frombuffer(row.folds, np.uint8)
        self.fold = np.repeat(self.folds, self.sizes)
        self.cur = np.frombuffer(zstandard.decompress(row.tokens), np.int32).astype(np.int64)
        self.prev = np.concatenate([[0], self.cur[:-1]])  # a text's first token follows the END before it
        self.words = np.frombuffer(row.words, np.uint64)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes in order, main, dev)."""
        order = np.argsort(self.words)
        main, dev = (np.bincount(self.cur[m], minlength=len(self.words)) for m in (self.fold > HELD_OUT, self.fold == DEV))
        return self.words[order], main[order], dev[order]

    def by_word(self, answers: np.ndarray) -> np.ndarray:
        """An answer in the order of the block's numbers."""
        out = np.zeros(len(self.words), np.int64)
        out[np.argsort(self.words)] = answers
        return out

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes in order, place of each token's bigram among them, numbers of the first and of the second words)."""
        codes, at = np.unique(self.prev * len(self.words) + self.cur, return_inverse=True)
        first, second = np.divmod(codes, len(self.words))
        x = self.words[first] * _TIMES[0]
        hashes = (x ^ (x >> np.uint64(31)) ^ self.words[second]) * _TIMES[1]
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return hashes[order], place[at], first[order], second[order]


def sharded(block: int, keys: np.ndarray, main: np.ndarray, dev: np.ndarray, told: np.ndarray, bits: int) -> pd.DataFrame:
    """Rows of REQUEST: the block's keys, in order, cut by their first bits."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
    part = lambda x: [packed(x[a:z]) for a, z in zip(cuts, cuts[1:])]
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[cuts[:-1][cuts[:-1] < len(keys)]] = keys[cuts[:-1][cuts[:-1] < len(keys)]]
    return pd.DataFrame({"shard": shard[cuts[:-1]], "block": block, "keys": part(steps), "main": part(main), "dev": part(dev), "told": part(told)})


def _sum_up(part: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(place of each requested key of each row among the distinct ones, their main, their dev, what was told of them: its maximum)."""
    keys = [np.cumsum(unpacked(k)) for k in part["keys"]]
    main, dev, told = (counts_in(part[c]) for c in ("main", "dev", "told"))
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    most = np.zeros(len(unique), np.int64)
    if told.any():
        np.maximum.at(most, at[told > 0], told[told > 0])
    places = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    return places, np.bincount(at, main, len(unique)).astype(np.int64), np.bincount(at, dev, len(unique)).astype(np.int64), most


def _answers(part: pd.DataFrame, places: list[np.ndarray], main: np.ndarray, dev: np.ndarray | None) -> pd.DataFrame:
    own = lambda x: [packed(x[at]) for at in places] if x is not None else None
    return pd.DataFrame({"kind": ANSWER, "block": part["block"], "shard": part["shard"], "main": own(main), "dev": own(dev)})


def count_words(blocks: DataFrame, bits: int) -> DataFrame:
    """Rows of ANSWERS: main and dev counts of each block's words. SUMS: the number of words with main and with training tokens."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                keys, main, dev = Block(row).word_counts()
                yield sharded(row.block, keys, main, dev, np.zeros(len(keys)), bits)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        at, main, dev, _ = _sum_up(part)
        words = np.array([(main > 0).sum(), (main + dev > 0).sum()], np.int64)
        sums = pd.DataFrame({"kind": SUMS, "block": -1, "shard": part["shard"].iloc[:1], "main": [packed(words)], "dev": None})
        return pd.concat([_answers(part, at, main, dev), sums])

    return blocks.mapInPandas(ask, REQUEST).groupBy("shard").applyInPandas(add, ANSWERS)


def words_in(words: DataFrame) -> tuple[int, int]:
    """The number of words with main tokens and with training tokens, of all shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(counts_in(b["main"]).reshape(-1, 2), columns=["main", "train"])

    sums = words.filter(F.col("kind") == SUMS).select("main").mapInPandas(run, "main long, train long").agg(F.sum("main"), F.sum("train")).first()
    return int(sums[0] or 0), int(sums[1] or 0)


def level(p: np.ndarray) -> np.ndarray:
    """A probability's step in the histogram, 0 for none."""
    return np.where(p > 0, 1 + np.clip(np.round(-STEPS * np.log2(np.maximum(p, 1e-18))), 0, 510), 0).astype(np.int64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, else one more than the whole binary logarithm of its frequency."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _opened(block: pd.DataFrame, answers: pd.DataFrame) -> tuple[Block, np.ndarray, np.ndarray]:
    """(block, main and dev counts of its words)."""
    own, told = Block(next(block.itertuples())), answers.sort_values("shard")
    return own, *(own.by_word(counts_in(told[c])) for c in ("main", "dev"))


def count_bigrams(blocks: DataFrame, words: DataFrame, bits: int, main_tokens: int) -> DataFrame:
    """Rows of ANSWERS: training counts of each block's bigrams. SUMS: dev tokens by bucket and both probabilities' levels (packed in main; the numbers in dev)."""

    def ask(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, main, _ = _opened(block, answers)
        keys, at, first, second = own.bigrams()
        n_main, n_dev = (np.bincount(at[m], minlength=len(keys)) for m in (own.fold > HELD_OUT, own.fold == DEV))
        told = np.where(n_dev > 0, main[first] << 10 | level(main[second] / max(1, main_tokens)), 0)
        return sharded(own.number, keys, n_main, n_dev, told, bits)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        at, main, dev, told = _sum_up(part)
        context, p1 = told >> 10, told & 1023
        p2 = np.where(context > 0, main / np.maximum(context, 1), 0.0)
        seen = dev > 0
        codes, where = np.unique((bucket_of(context) << 20 | p1 << 10 | level(p2))[seen], return_inverse=True)
        n = np.bincount(where, dev[seen], len(codes)).astype(np.int64)
        sums = pd.DataFrame({"kind": SUMS, "block": -1, "shard": part["shard"].iloc[:1], "main": [packed(codes)], "dev": [packed(n)]})
        return pd.concat([_answers(part, at, main + dev, None), sums])

    told = words.filter(F.col("kind") == ANSWER)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(ask, REQUEST).groupBy("shard").applyInPandas(add, ANSWERS)


def histogram_of(bigrams: DataFrame) -> pd.DataFrame:
    """(ctx, key, n): the buckets and packed levels of all shards; their number has a bound of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for codes, n in zip(b["main"], b["dev"]):
                yield pd.DataFrame({"code": unpacked(codes).astype(np.int64), "n": unpacked(n).astype(np.int64)})

    rows = bigrams.filter(F.col("kind") == SUMS).select("main", "dev").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    code = rows["code"].to_numpy(np.int64)
    return pd.DataFrame({"ctx": code >> 20, "key": code & 0xFFFFF, "n": rows["n"].to_numpy(np.int64)})


def learn_weights(histogram: pd.DataFrame, buckets: int, main_words: int, rounds: int = 60) -> np.ndarray:
    """Weights (uniform, unigram, bigram) of each bucket, by expectation-maximisation over (bucket, p1 bin, p2 bin, n)."""
    bucket, n = histogram["ctx"].to_numpy(), histogram["n"].to_numpy(np.float64)
    p = [np.where(x > 0, 2.0 ** (-(x - 1) / STEPS), 0.0) for x in (histogram["key"].to_numpy() >> 10, histogram["key"].to_numpy() & 1023)]
    p = np.stack([np.full(len(n), 1 / (main_words + 1)), *p], axis=1)
    out = np.tile([0.2, 0.4, 0.4], (buckets, 1))
    out[0] = [0.2, 0.8, 0]
    for _ in range(rounds):
        share = out[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, k], minlength=buckets) for k in range(3)], axis=1)
        full = total.sum(axis=1, keepdims=True)
        out = np.where(full > 0, total / np.where(full > 0, full, 1), out)
    out = np.maximum(out, [1e-6, 1e-6, 0])
    return out / out.sum(axis=1, keepdims=True)


def weights_of(histogram: pd.DataFrame, main_words: int) -> np.ndarray:
    """The weights of 65 buckets. One without held-out tokens has those of the bucket below; the first has no bigrams."""
    learned = learn_weights(histogram, 65, main_words)
    seen = set(histogram["ctx"].tolist())
    for b in range(2, 65):
        if b not in seen:
            learned[b] = learned[b - 1]
    return learned


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Null text counts as empty and has the end token alone; a null identifier counts as
    empty text for the fold. A task holds the texts of a block, `block_chars` characters
    or one longer text, or the requests of a shard. Repeated rows stay; an empty table gives an empty one; other columns
    are not read. Words and bigrams are known by their 64-bit hash.
    """
    blocks = by_block(token_blocks(folds(docs, id_col, text_col), block_chars), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = blocks.agg(F.coalesce(F.sum("n_main"), F.lit(0)), F.coalesce(F.sum("n_dev"), F.lit(0)), F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0))).first()
    main_tokens, tokens = int(sums[0]), int(sums[0] + sums[1])
    bits_for = lambda keys: max(0, int(np.ceil(np.log2(max(1, keys / shard_keys)))))
    words = settle(count_words(blocks, bits_for(float(sums[2]))))
    n_words = words_in(words)
    bigrams = settle(count_bigrams(blocks, words, bits_for(float(tokens)), main_tokens))
    weights = weights_of(histogram_of(bigrams), int(n_words[0]))
    vocabulary = int(n_words[1])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(block.itertuples())
        own, main, dev = _opened(block, answers[answers["of"] == 0])
        one, at = main + dev, own.bigrams()[1]
        two = counts_in(answers[answers["of"] == 1].sort_values("shard")["main"])[at]
        c, context = one[own.cur], one[own.prev]
        w = weights[bucket_of(context)]
        p = w[:, 0] / (vocabulary + 1) + w[:, 1] * c / max(1, tokens) + w[:, 2] * two / np.maximum(context, 1)
        starts = np.cumsum(own.sizes) - own.sizes
        known, base, score = (np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), np.log10(c + 0.5), np.log10(p)))
        ids = pd.Series(np.frombuffer(row.ids, np.int64)).astype("Int64").mask(np.frombuffer(row.empty_ids, bool))
        return pd.DataFrame({"doc_id": ids, "held_out": own.folds == HELD_OUT, "n_tokens": own.sizes, "n_known": known, "base_sum": base, "score": score})

    told = words.filter(F.col("kind") == ANSWER).withColumn("of", F.lit(0)).unionByName(bigrams.filter(F.col("kind") == ANSWER).withColumn("of", F.lit(1)))
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, schema)
    norm = float(np.log10(max(1.0, tokens + 0.5 * (vocabulary + 1))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_sum") - F.col("n_tokens") * norm).alias("base_score"), "score")
