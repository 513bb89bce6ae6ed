"""Spelling variants by a frontier over a trie that is a table of edges.

A word and one that is an edit away share the half before the edit or the half after it,
so there are two tries, of words and of reversed words, each only below the middle of its
words, where few share a node. Unary chains are one edge with a label. A node's number is
a hash of its prefix; a candidate is spelled out by its edges and must be a word in the
end, so equal hashes make no false pair. Each node has 64 bits that tell which endings
(by length, next and last character) lie below it; a state whose ending isn't among them
ends at once. The frontier holds (word, near, position, node)
after the edit: near is what the word becomes if the rest agrees, and each round joins the
frontier with the edges by node and next character.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, unsettle

SHORTEST, LEAST, RATIO, EVERY = 7, 2, 10, 31
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of a batch of words that are hashed together.
BLOCK = 1 << 22
_MIX, _TWIST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): results of SHORTEST code points or more with LEAST occurrences or more in all rows of docs (doc_id, text)."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{SHORTEST},}}+"), F.lit(0))
    run = F.col("raw_")  # lower() would lower other letters too, so it is for ASCII alone
    lowered = F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"), F.explode(runs).alias("raw_")).select("id_", lowered.alias("run"))
    h = F.crc32(F.concat("id_", F.lit(":"), "run").cast("binary"))
    k = (F.col("h_") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), k), F.substring(F.col("run"), k + 2, F.length("run")))
    word = F.when(F.col("h_") % EVERY == 0, cut).otherwise(F.col("run"))
    return each.withColumn("h_", h).select(word.alias("word")).filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, depth, node, next, below) of words (id, word): the prefixes from just before the middle on, the code point that follows (0 at the end) and the bit of the ending; negative ids (-1 - id) are of the reverses."""
    for batch in batches:
        words = sorted(zip(*(batch.column(i).to_pylist() for i in (1, 0))), key=lambda w: len(w[0]))
        at = 0
        while at < len(words):
            end = at + 1  # words of like length: BLOCK characters at most, or one word
            while end < len(words) and (end + 1 - at) * len(words[end][0]) <= BLOCK:
                end += 1
            ids = np.array([i for _, i in words[at:end]])
            yield from _levels([w for w, _ in words[at:end]], ids, 1)
            yield from _levels([w[::-1] for w, _ in words[at:end]], -1 - ids, 2)
            at = end


def _bit(left, follows, last):
    """The bit of an ending of `left` code points; of none it is 0."""
    return (left * 37 + follows * 11 + last * 5) % 64


def _levels(words: list[str], ids: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max())
    points = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
    h = np.full(len(words), seed, np.uint64)
    last = points[np.arange(len(words)), sizes - 1].astype(np.int64)
    made: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for depth in range(width + 1):
        here = np.flatnonzero(((sizes - 1) // 2 <= depth) & (depth <= sizes))
        follows = points[here, depth].astype(np.int32) if depth < width else np.zeros(len(here), np.int32)
        bit = np.where(sizes[here] > depth, _bit(sizes[here] - depth, follows.astype(np.int64), last[here]), 0)
        made.append((ids[here], np.full(len(here), depth, np.int32), h[here].view(np.int64), follows, (np.uint64(1) << bit.astype(np.uint64)).view(np.int64)))
        rows += len(here)
        if rows >= 100_000 or depth == width:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=["id", "depth", "node", "next", "below"])
            made, rows = [], 0
        if depth < width:
            h = (h ^ points[:, depth]) * _MIX
            h = (h ^ h >> np.uint64(29)) * _TWIST
            h ^= h >> np.uint64(32)


def paths(words: DataFrame) -> DataFrame:
    """(word, back, path) of words (id, word) and of their reverses: path has (depth, node, below), rising, where other words leave the word or end on it, and the word's own end."""
    steps = settle(words.select("id", "word").mapInArrow(prefixes, "id long, depth int, node long, next int, below long"))
    nodes = steps.groupBy("node").agg(F.min("next").alias("a_"), F.max("next").alias("b_"), F.bit_or("below").alias("below")).filter("a_ <> b_ or b_ = 0")
    on = steps.select("id", "depth", "node", (F.col("next") == 0).alias("ends_")).join(nodes, "node").filter("ends_ or a_ <> b_")
    path = on.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "below"))).alias("path"))
    back = F.col("id") < 0
    whole = path.select(F.when(back, -1 - F.col("id")).otherwise(F.col("id")).alias("id"), back.cast("int").alias("back"), "path").join(words.select("id", "word"), "id")
    out = settle(whole.select(F.when(F.col("back") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"), "back", "path"))
    unsettle(steps)
    return out


def part(text: Column, start: Column, size: Column) -> Column:
    """size code points from the place start, which counts from 0."""
    return F.substring(text, (start + 1).cast("int"), size.cast("int"))


def edges(path: DataFrame) -> DataFrame:
    """(node, first, label, child, below) between neighbours of the paths; below is of the child."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))
    e = path.filter(F.size("path") > 1).select("word", F.explode(pairs).alias("e"))
    label = part(F.col("word"), F.col("e.a.depth"), F.col("e.b.depth") - F.col("e.a.depth"))
    return e.select(F.col("e.a.node").alias("node"), label.alias("label"), F.col("e.b.node").alias("child"), F.col("e.b.below").alias("below")).distinct().select("node", F.substring("label", 1, 1).alias("first"), "label", "child", "below")


def leads_on(below: Column, text: Column, at: Column, size: Column) -> Column:
    """Whether an ending like that of text, size code points long, from `at` on may lie below."""
    code = lambda c: F.ascii(c).cast("long")
    bit = _bit((size - at).cast("long"), code(part(text, at, F.lit(1))), code(F.right(text, F.lit(1))))
    return F.getbit(below, F.when(at < size, bit).otherwise(0)) == 1


def two_steps(edge: DataFrame) -> DataFrame:
    """(node, second, first, label, child, below): edges by the second character that they lead to, their own or that of an edge after them; empty where a word may end after the first."""
    one = F.length("label") == 1
    long_ = edge.filter(~one).select("node", F.substring("label", 2, 1).alias("second"), "first", "label", "child", "below")
    after = edge.select(F.col("node").alias("child"), F.col("first").alias("second"), F.col("label").alias("more"), F.col("child").alias("end_"), F.col("below").alias("below_"))
    on = edge.filter(one).drop("below").join(after, "child").select("node", "second", "first", F.concat("label", "more").alias("label"), F.col("end_").alias("child"), F.col("below_").alias("below"))
    ended = edge.filter(one & (F.getbit("below", F.lit(0)) == 1)).select("node", F.lit("").alias("second"), "first", "label", "child", "below")
    return long_.unionByName(on).unionByName(ended)


def edits(path: DataFrame, edge: DataFrame) -> DataFrame:
    """(word, back, near, at, node): the frontier after its edit and the step behind it.

    At each fork from the middle of a word on, another character than the word's replaces
    it or comes in before it, and the edges agree with what follows; near is the word so
    changed, of which the edges have spelled `at` code points.
    """
    word, p, own, label, first = (F.col(c) for c in ("word", "p", "own", "label", "first"))
    forks = path.select("word", "back", F.length("word").alias("size"), F.explode("path").alias("f")).select("word", "back", "size", F.col("f.depth").alias("p"), F.col("f.node").alias("node")).filter("p >= floor(size / 2)")
    # where the word goes on behind the edit: after its own character, or with it
    goes = F.explode(F.when(p < F.col("size"), F.array(p + 1, p)).otherwise(F.array(p))).alias("own")
    asked = forks.select("*", goes).withColumn("second", part(word, own, F.lit(1)))
    met = asked.join(two_steps(edge), ["node", "second"]).filter(first != part(word, p, F.lit(1)))
    more = F.length(label) - 1
    agrees = (own + more <= F.col("size")) & leads_on(F.col("below"), word, own + more, F.col("size")) & (F.substring(label, F.lit(2), more) == part(word, own, more))
    near = F.concat(part(word, F.lit(0), p), first, part(word, own, F.col("size")))
    return met.filter(agrees).select("word", "back", near.alias("near"), (p + F.length(label)).alias("at"), F.col("child").alias("node"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): pairs of words (id, word) that differ by one code point, each pair once, the smaller first; some pairs whose near isn't a word are among them."""
    path = paths(words)
    edge = settle(edges(path))
    frontier = settle(edits(path, edge))
    spent, ended = [frontier], []
    while True:
        ended.append(frontier.filter(F.col("at") == F.length("near")).select("word", "back", "near"))
        live = frontier.filter(F.col("at") < F.length("near"))
        if live.isEmpty():
            break
        near, at = F.col("near"), F.col("at")
        met = live.withColumn("first", part(near, at, F.lit(1))).join(edge, ["node", "first"]).filter((part(near, at, F.length("label")) == F.col("label")) & leads_on(F.col("below"), near, at + F.length("label"), F.length("near")))
        frontier = settle(met.select("word", "back", "near", (at + F.length("label")).alias("at"), F.col("child").alias("node")))
        spent.append(frontier)
    every = ended[0]
    for e in ended[1:]:
        every = every.unionByName(e)
    turned = lambda c: F.when(F.col("back") == 1, F.reverse(c)).otherwise(F.col(c))
    a, b = turned("word"), turned("near")
    out = settle(every.select(F.least(a, b).alias("word"), F.greatest(a, b).alias("near")).distinct())
    for table in (*spent, path, edge):
        unsettle(table)
    return out


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of words with a form (word, form), at most `hops` forms in a row: each round doubles what a row jumps over."""
    jump = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, hops))))):
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next_"))
        jump = settle(jump.join(on, "root", "left").select("word", F.coalesce("next_", "root").alias("root")))
    return jump


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word in docs (doc_id, text).

    Words are runs of letters after the planted deletions, SHORTEST code points or more,
    seen LEAST times or more. Near words differ by exactly one code point. form is the
    most frequent near word (ties: the smallest in code-point order) if it is RATIO times
    as frequent, else null; root follows forms to their end. A null text has no words, a
    null doc_id counts as empty text, repeated rows count each time, empty tables give no
    rows; other columns are not read. Words of any length take as many rounds as their
    trie has forks in a row, not one for each character.
    """
    words = settle(vocabulary(docs).withColumn("id", F.monotonically_increasing_id()))
    n = words.select("word", "n")
    pairs = neighbours(words)
    counted = pairs.join(n.withColumnRenamed("n", "n_a"), "word").join(n.select(F.col("word").alias("near"), F.col("n").alias("n_b")), "near")
    both = counted.select(F.explode(F.array(F.struct("word", F.col("near").alias("other"), F.col("n_b").alias("n_other")), F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n_a").alias("n_other")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("m"), F.col("other").alias("w"))).alias("best_"))
    found = n.join(best, "word", "left")
    takes = -F.col("best_.m") >= RATIO * F.col("n")
    judged = settle(found.select("word", F.when(takes, F.col("best_.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best_.m")).alias("form_n")))
    most = judged.agg(F.max("form_n")).first()[0] or 1
    root = roots(judged.filter("form is not null"), 1 + math.ceil(math.log10(most)))
    return judged.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
