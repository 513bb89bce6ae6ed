"""Mixing sources to target weights by soft membership.

A softmax classifier, trained on labelled documents, gives each document a posterior
over domains. Projected-gradient least squares then finds document rates r >= 0 whose
expected domain token totals sum(r t p) match the targets, of these the nearest to 1. The
projection is lazy: a document's gradient is its posterior times one number for each
domain, so the steps from r = 1 are added up, scaled by the curvature of the documents
whose rate isn't 0, and their sum is projected. Each round is a few sums over the documents.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty, words_of

FEATURES = 1024
#: Weight of the rates' distance from 1 against the targets'; step lengths of a round.
WEAK, HALVINGS = 1e-6, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Hashed counts of character trigrams, damped and of unit length."""
    raw = np.frombuffer(b" " + b" ".join(words_of(text)) + b" ", np.uint8).astype(np.uint64)
    if len(raw) < 3:
        return np.zeros(FEATURES, np.float32)
    code = raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]
    n = np.bincount((code * _MIX >> np.uint64(54)).astype(np.int64), minlength=FEATURES)
    x = np.sqrt(n).astype(np.float32)
    return x / np.linalg.norm(x)


@dataclass
class Softmax:
    weights: np.ndarray  # FEATURES x domains
    bias: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, domains: int, tolerance: float = 1e-6, penalty: float = 1e-5, rounds: int = 5000) -> Softmax:
        """The least penalised loss by L-BFGS, until no element of the gradient exceeds `tolerance`; an error if it isn't reached. Without rows: the same share for all."""
        if not len(y):
            return cls(np.zeros((FEATURES, domains)), np.zeros(domains))
        rows = np.arange(len(y))

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            w, b = v[:-domains].reshape(-1, domains), v[-domains:]
            z = x @ w.astype(np.float32) + b
            z -= z.max(axis=1, keepdims=True)
            norm = np.log(np.exp(z).sum(axis=1, keepdims=True))
            g = np.exp(z - norm)
            g[rows, y] -= 1
            g /= len(y)
            value = float((norm[:, 0] - z[rows, y]).mean()) + penalty / 2 * float((w * w).sum())
            return value, np.concatenate([(x.T @ g.astype(np.float32) + penalty * w).reshape(-1), g.sum(axis=0)]).astype(np.float64)

        v = np.zeros((FEATURES + 1) * domains)
        f, g = loss(v)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            if np.abs(g).max() <= tolerance:
                return cls(v[:-domains].reshape(-1, domains).astype(np.float32), v[-domains:].astype(np.float32))
            q, shares = g.copy(), []
            for s, t in reversed(past):
                shares.append(s @ q / (s @ t))
                q -= shares[-1] * t
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1.0
            for (s, t), share in zip(past, reversed(shares)):
                q += (share - t @ q / (s @ t)) * s
            step = 1.0
            while True:
                new, (f_new, g_new) = v - step * q, loss(v - step * q)
                if f_new <= f - 1e-4 * step * float(g @ q) + 1e-9 or step < 1e-6:
                    break
                step /= 2
            s, t = new - v, g_new - g
            past = [*past[-19:], (s, t)] if s @ t > 1e-14 else []
            v, f, g = new, f_new, g_new
        raise RuntimeError(f"the classifier's gradient is still {np.abs(g).max():.1e} after {rounds} rounds")


def domain_of() -> F.Column:
    """The domains of the labels table: quality (0, 1) and toxic (0, 1) as 2 * quality + toxic."""
    return 2 * F.col("quality") + F.col("toxic")


DOMAINS = ("low", "low_toxic", "high", "high_toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = 8192) -> Softmax:
    """The classifier from labelled documents; of these the `most` with the smallest hash of their identifier at most.

    Labels that are null or out of range are left out; of several labels of a document, and of repeated documents, the smallest is taken.
    """
    own = labels.filter("quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min(domain_of()).alias("domain"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = docs.select("doc_id", text_or_empty("text").alias("text")).join(sample, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "domain": b["domain"], "x": [features(t).astype(np.float16).tobytes() for t in b["text"]]})

    once = picked.mapInPandas(run, "doc_id long, domain int, x binary").groupBy("doc_id").agg(F.min(F.struct("domain", "x")).alias("m"))
    rows = once.select("doc_id", "m.*").toPandas().sort_values("doc_id")  # `most` rows
    x = np.frombuffer(b"".join(rows["x"]), np.float16).astype(np.float32).reshape(-1, FEATURES)
    return Softmax.fit(x, rows["domain"].to_numpy(np.int64), len(DOMAINS))


def posteriors(docs: DataFrame, model: Softmax) -> DataFrame:
    """(doc_id, n_tokens, p array<double>); tokens are words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                p = shared.value.posterior(np.stack([features(t) for t in part["text"]])).astype(np.float64)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_tokens": [len(words_of(t)) for t in part["text"]], "p": list(p / p.sum(axis=1, keepdims=True))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInPandas(run, "doc_id long, n_tokens long, p array<double>")


def replay(tokens: np.ndarray, p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of documents after the steps so far: r and its look-ahead v, each step projected onto r >= 0. Without tokens: 1."""
    r = v = np.ones(len(tokens))
    for k, s in enumerate(steps):
        new = np.maximum(0, v - p @ s)
        v = new + k / (k + 3) * (new - r)
        r = new
    return np.where(tokens > 0, np.stack([r, v]), 1.0)


def fit_rates(weighed: DataFrame, targets: np.ndarray, rounds: int = 80, close: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(steps, totals): the one step that `replay` takes, and the expected domain totals reached.

    Least squares of (A r - targets), each over its target, with A's columns t p, plus
    WEAK times the squares of (r - 1), each times t. Its solution is one projected step
    from r = 1, max(0, 1 - p m), along the sum m of all gradients. A round adds the gradient
    at the rates so far, A r - targets (and m's own share), scaled by the inverse curvature;
    both are sums of a few numbers over the documents, and a job
    tries HALVINGS lengths of a step at once. It ends when the gradient's sum is within
    a hundredth of `close` of the targets' sum; more than `rounds` are an error. Plain steps
    need about 2,300 rounds where a target is 0. Totals differ from targets only where no rates reach them.
    """
    d, size = len(targets), max(1.0, float(targets.sum()))
    ease = WEAK * np.maximum(targets, max(1.0, 1e-3 * targets.sum()))
    names = ["k int", "half double", *(f"f{i} double" for i in range(d)), *(f"h{i} double" for i in range(d * d))]

    def sums(some: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                t = b["n_tokens"].to_numpy(np.float64)
                p = np.stack(b["p"].to_list()) if len(b) else np.zeros((0, d))
                out = []
                for k, m in enumerate(some):
                    r = np.maximum(0, 1 - p @ m)
                    tp = (t * (r > 0))[:, None] * p
                    out.append([k, t @ (r * r) / 2, *(r @ (t[:, None] * p)), *(tp.T @ p).reshape(-1)])
                yield pd.DataFrame(out, columns=[c.split()[0] for c in names])

        rows = weighed.mapInPandas(run, ", ".join(names)).groupBy("k").agg(*(F.sum(c.split()[0]) for c in names[1:])).collect()
        got = {row[0]: np.array(row[1:], np.float64) for row in rows}
        empty = np.zeros(1 + d + d * d)
        return [(float(g[0]), g[1 : d + 1], g[d + 1 :].reshape(d, d)) for g in (got.get(k, empty) for k in range(len(some)))]

    def state(m: np.ndarray, s: tuple) -> tuple[float, np.ndarray]:
        return s[0] + float(targets @ m) + float((ease * m * m).sum()) / 2, ease * m - s[1] + targets

    m = np.zeros(d)
    now = sums(m[None])[0]
    for _ in range(rounds):
        value, slope = state(m, now)
        if np.abs(slope).sum() <= close / 100 * size:
            return m[None], now[1]
        toward = np.linalg.solve(now[2] + np.diag(ease), slope)
        some = m - 0.5 ** np.arange(HALVINGS)[:, None] * toward
        tried = [(*state(x, s), x, s) for x, s in zip(some, sums(some))]
        least = min(v for v, *_ in tried)
        _, _, m, now = min((c for c in tried if c[0] <= least + 1e-12 * abs(least)), key=lambda c: np.abs(c[1]).sum())
    raise RuntimeError(f"the rates' gradient is still {np.abs(state(m, now)[1]).sum() / size:.1e} of the targets after {rounds} rounds")


def mix(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...] = (0.15, 0.02, 0.8, 0.03), tokens: float | None = None, most: int = 8192, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, p, rate, residual), one row for each row of docs (doc_id, text); doc_id is the column `key`.

    `shares` of the domains of the total of `tokens` (by default that of docs) are the
    targets; `residual` is by how much all totals reached differ from them, as a share. Null text counts as empty, has no tokens and keeps rate 1. Repeated rows
    stay, each with its rate; a table without labels gives equal posteriors; an empty
    one gives an empty one; other columns are not read.
    """
    weighed = settle(posteriors(docs.select(F.col(key).alias("doc_id"), "text"), train(docs, labels, most)))
    total = weighed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] if tokens is None else tokens
    targets = np.array(shares) / sum(shares) * float(total)
    steps, reached = fit_rates(weighed, targets)
    residual = float(np.abs(reached - targets).sum() / max(1.0, targets.sum()))
    if residual > 1e-4:
        warnings.warn(f"no rates reach the targets {targets.tolist()}; the nearest totals are {reached.tolist()}", stacklevel=2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.stack(b["p"].to_list()) if len(b) else np.zeros((0, len(shares)))
            yield b.assign(rate=replay(b["n_tokens"].to_numpy(np.float64), p, steps)[0], residual=residual)

    return weighed.mapInPandas(run, "doc_id long, n_tokens long, p array<double>, rate double, residual double")


def copies(rate: F.Column, doc_id: F.Column) -> F.Column:
    """A rate as a whole number of copies: its floor, and one more for the identifiers whose hash is below the rest."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")


def resample(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs, each as often as its rate says; keys that docs repeat have one rate, their largest. Null keys stay once.

    The draw is by identifier; of a row without one, by its text and key.
    """
    rates = mixed.filter("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max("rate").alias("rate_"))
    drawn = F.col("doc_id") if key == "doc_id" else F.coalesce(F.col("doc_id"), F.xxhash64("text", key))
    n = F.coalesce(copies(F.col("rate_"), drawn), F.lit(1))
    return docs.join(rates, key, "left").withColumn("copy_", F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
