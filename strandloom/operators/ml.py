"""Scores from any callable, counterfactual differences, and Spark ML models of context, sequence and both."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .cohort import rc_view
from .settling import settle

Scorer = Callable[[pd.DataFrame], pd.DataFrame]  # rows to columns m, beta, prob


def score(df: DataFrame, scorer: Scorer, id_col: str) -> DataFrame:
    """(id, m, beta, prob) from batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[[id_col]].reset_index(drop=True), scorer(b)[["m", "beta", "prob"]].reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, m double, beta double, prob double")


def two_orientations(df: DataFrame, scorer: Scorer, id_col: str, seq: str, pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """(id, m_fwd, m_rc, m, ...): both strands scored apart, then averaged."""
    one = lambda d, name: score(d, scorer, id_col).withColumn("side", F.lit(name))
    both = one(df, "fwd").unionByName(one(rc_view(df, seq, list(pairs)), "rc"))
    return both.groupBy(id_col).agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for c in ("m", "beta", "prob") for s in ("fwd", "rc")), *(F.avg(c).alias(c) for c in ("m", "beta", "prob")))


def counterfactual(pairs: DataFrame, scorer: Scorer, id_col: str, wt: str = "wt", mut: str = "mut") -> DataFrame:
    """(id, beta_wt, beta_mut, delta_beta, delta_m, rc_difference, rc_sign_agrees): averaged over strands, then subtracted."""
    rows = pairs.select(id_col, F.explode(F.array(F.struct(F.lit("wt").alias("allele"), F.col(wt).alias("seq")), F.struct(F.lit("mut").alias("allele"), F.col(mut).alias("seq")))).alias("x")).select(id_col, "x.*")
    rows = rows.withColumn("row_", F.concat_ws("|", F.col(id_col).cast("string"), "allele"))
    got = rows.select(id_col, "allele", "row_").join(two_orientations(rows.select("row_", "seq"), scorer, "row_", "seq"), "row_")
    of = lambda c, a: F.max(F.when(F.col("allele") == a, F.col(c)))
    d = {k: of(k, "mut") - of(k, "wt") for k in ("beta", "m", "beta_fwd", "beta_rc")}
    return got.groupBy(id_col).agg(of("beta", "wt").alias("beta_wt"), of("beta", "mut").alias("beta_mut"), d["beta"].alias("delta_beta"), d["m"].alias("delta_m"), F.abs(d["beta_fwd"] - d["beta_rc"]).alias("rc_difference"), (F.signum(d["beta_fwd"]) == F.signum(d["beta_rc"])).alias("rc_sign_agrees"))


def context_stages(features: list[str], seed: int) -> list:
    return [VectorAssembler(inputCols=features, outputCol="context"), GBTRegressor(featuresCol="context", labelCol="m_value", predictionCol="m_context", maxIter=10, maxDepth=3, seed=seed)]


def kmers(df: DataFrame, seq: str, k: int = 3) -> DataFrame:
    starts = F.sequence(F.lit(1), F.length(seq) - k + 1)
    return df.withColumn("kmers", F.transform(starts, lambda i: F.substring(F.col(seq), i, F.lit(k))))


def sequence_stages() -> list:
    return [HashingTF(inputCol="kmers", outputCol="sequence", numFeatures=256), LinearRegression(featuresCol="sequence", labelCol="m_value", predictionCol="m_sequence", regParam=0.1, elasticNetParam=0.0)]


def fusion_stages() -> list:
    return [VectorAssembler(inputCols=["m_context", "m_sequence"], outputCol="both"), LinearRegression(featuresCol="both", labelCol="m_value", predictionCol="m_fusion", regParam=1e-3)]


def fit_fusion(train: DataFrame, features: list[str], seq: str = "seq", seed: int = 42) -> PipelineModel:
    """Context trees, a sequence model on k-mer counts, and their linear mixture."""
    return Pipeline(stages=[*context_stages(features, seed), *sequence_stages(), *fusion_stages()]).fit(kmers(train, seq))


def fusion_share(model: PipelineModel) -> float:
    """The context's share of the mixture's weight."""
    a, b = (abs(x) for x in model.stages[-1].coefficients)
    return float(a / max(a + b, 1e-12))


@dataclass(frozen=True)
class ContextHeads:
    """A regression and a calibrated class over the same features."""

    trees: PipelineModel
    classes: PipelineModel
    steps: IsotonicRegressionModel

    def apply(self, df: DataFrame) -> DataFrame:
        """df with m_context, raw_context (the class model's probability) and prob_context (calibrated)."""
        scored = self.classes.transform(self.trees.transform(df).drop("context")).withColumn("raw_context", vector_to_array("probability")[1])
        return self.steps.transform(scored).drop("context", "rawPrediction", "probability", "prediction")


def fit_context_heads(train: DataFrame, val: DataFrame, features: list[str], seed: int = 42) -> ContextHeads:
    """Trees for m_value and for binary_state on the training rows; the probabilities' steps (isotonic) on the validation rows, which the trees haven't seen."""
    trees = Pipeline(stages=context_stages(features, seed)).fit(train)
    classes = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="context"), GBTClassifier(featuresCol="context", labelCol="binary_state", maxIter=10, maxDepth=3, seed=seed)]).fit(train)
    held = classes.transform(val).select(vector_to_array("probability")[1].alias("raw_context"), F.col("binary_state").cast("double").alias("binary_state"))
    return ContextHeads(trees, classes, IsotonicRegression(featuresCol="raw_context", labelCol="binary_state", predictionCol="prob_context").fit(held))


# A mixture with a weight for each row ------------------------------------------


@dataclass(frozen=True)
class Gate:
    """Two experts' shares by a logistic function of the features, and the spread of each."""

    features: tuple[str, ...]
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the constant first
    spreads: tuple[float, float]
    likelihoods: tuple[float, ...]  # of the rounds

    def apply(self, df: DataFrame, a: str, b: str, share: str = "share", fused: str = "m_fusion") -> DataFrame:
        """df with the share of expert a in each row, and the experts' mean by it; null where a feature is."""
        z = F.lit(float(self.weights[0]))
        for f, m, s, w in zip(self.features, self.middle, self.scale, self.weights[1:]):
            z = z + float(w) * (F.col(f) - float(m)) / float(s)
        return df.withColumn(share, 1 / (1 + F.exp(-z))).withColumn(fused, F.col(share) * F.col(a) + (1 - F.col(share)) * F.col(b))


def _gate_sums(batches: Iterable[pd.DataFrame], features: list[str], middle: np.ndarray, scale: np.ndarray, weights: np.ndarray, spreads: tuple[float, float]) -> Iterator[pd.DataFrame]:
    """(i, v): likelihood, expert a's total responsibility, both weighted squared errors, and the gate's gradient and curvature, summed over a task's rows."""
    total = None
    for b in batches:
        x = np.column_stack([np.ones(len(b)), (b[features].to_numpy() - middle) / scale])
        z = x @ weights
        g = np.where(z > 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        errors = [b["y_"].to_numpy() - b[k].to_numpy() for k in ("a_", "b_")]
        logs = [-0.5 * (e / s) ** 2 - np.log(s) - 0.5 * np.log(2 * np.pi) + lg for e, s, lg in zip(errors, spreads, (-np.logaddexp(0, -z), -np.logaddexp(0, z)))]
        whole = np.logaddexp(*logs)
        r = np.exp(logs[0] - whole)
        v = np.concatenate([[whole.sum(), r.sum(), (r * errors[0] ** 2).sum(), ((1 - r) * errors[1] ** 2).sum(), len(b)], x.T @ (r - g), (x.T @ (x * (g * (1 - g))[:, None])).reshape(-1), (x.T @ x).reshape(-1)])
        total = v if total is None else total + v
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})


def fit_gate(df: DataFrame, features: list[str], a: str, b: str, y: str, rounds: int = 1000, tolerance: float = 1e-5, least: float = 1e-3) -> Gate:
    """Expectation-maximisation of y ~ g N(a, s) + (1 - g) N(b, t), g a logistic function of the features.

    A round is one pass of sums over the rows. The spreads take their weighted means; the
    gate takes a Newton step, and where that made the likelihood fall, instead the step by
    the bound of its curvature (a quarter of x'x), with which it can't. Each third round
    goes on as far as the two before it point, and back if the likelihood fell. It ends when a
    round adds less than `tolerance` to the mean log likelihood of a row; else RuntimeError.
    Spreads stay above `least`. Rows with a null among these columns don't count.
    """
    names = [f"x{i}_" for i in range(len(features))]
    rows = settle(df.select(*(F.col(f).cast("double").alias(n) for f, n in zip(features, names)), *(F.col(c).cast("double").alias(n) for c, n in ((a, "a_"), (b, "b_"), (y, "y_")))).dropna())
    first = rows.agg(F.count(F.lit(1)), F.sqrt(F.avg((F.col("y_") - F.col("a_")) ** 2)), F.sqrt(F.avg((F.col("y_") - F.col("b_")) ** 2)), *(f(n) for n in names for f in (F.avg, F.stddev_pop))).first()
    if not first[0]:
        raise ValueError("no rows to fit the gate on")
    middle, scale = np.array(first[3::2], float), np.array([s if s and s > 0 else 1.0 for s in first[4::2]])
    p = len(features) + 1
    # the gate's weights and the logarithms of both spreads
    at = np.concatenate([np.zeros(p), np.log([max(first[1], least), max(first[2], least)])])
    seen: list[float] = []
    safe = None
    trail: list[np.ndarray] = []
    for _ in range(rounds):
        weights, spreads = at[:p], tuple(map(float, np.exp(at[p:])))
        got = rows.mapInPandas(lambda batches, w=weights, s=spreads: _gate_sums(batches, names, middle, scale, w, s), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.array([r.v for r in sorted(got)])
        if seen and not v[0] >= seen[-1] - 1e-12 * abs(seen[-1]) and safe is not None:
            at, safe, trail = safe, None, []
            continue
        gain = v[0] - seen[-1] if seen else np.inf
        seen.append(float(v[0]))
        if gain <= tolerance * v[4]:
            return Gate(tuple(features), middle, scale, weights, spreads, tuple(seen))
        share, n = v[1], v[4]
        wide = np.log([max(float(np.sqrt(v[2] / max(share, 1e-300))), least), max(float(np.sqrt(v[3] / max(n - share, 1e-300))), least)])
        slope, curve, bound = v[5 : 5 + p], v[5 + p : 5 + p + p * p].reshape(p, p), v[5 + p + p * p :].reshape(p, p) / 4
        ridge = 1e-9 * n * np.eye(p)
        safe = np.concatenate([weights + np.linalg.solve(bound + ridge, slope), wide])
        trail.append(at)
        at = np.concatenate([weights + np.linalg.solve(curve + ridge, slope), wide])
        if len(trail) == 3:  # two steps tell where they lead
            step = trail[1] - trail[0]
            turn = trail[2] - trail[1] - step
            far = max(1.0, float(np.linalg.norm(step) / max(np.linalg.norm(turn), 1e-300)))
            if far > 1 and np.isfinite(far):
                at = trail[0] + 2 * far * step + far * far * turn
            trail = []
    raise RuntimeError(f"the gate's likelihood still grows after {rounds} rounds")


def classify(train: DataFrame, test: DataFrame, features: str, label: str) -> DataFrame:
    """test with prob of label 1, from a logistic regression on an array column."""
    from pyspark.ml.functions import array_to_vector

    vec = lambda d: d.withColumn("v_", array_to_vector(F.col(features).cast("array<double>")))
    model = LogisticRegression(featuresCol="v_", labelCol=label, regParam=0.01, maxIter=20).fit(vec(train))
    return model.transform(vec(test)).withColumn("prob", vector_to_array("probability")[1]).drop("v_", "rawPrediction", "probability", "prediction")


def best_seed(train: DataFrame, val: DataFrame, features: list[str], seeds: list[int], seq: str = "seq") -> tuple[int, PipelineModel]:
    """The fit with the smallest beta error on the validation rows."""
    found = []
    for s in seeds:
        model = fit_fusion(train, features, seq, s)
        error = model.transform(kmers(val, seq)).agg(F.avg(F.abs(S.m_to_beta(F.col("m_fusion")) - S.m_to_beta(F.col("m_value"))))).first()[0]
        found.append((error, s, model))
    _, s, model = min(found, key=lambda x: x[:2])
    return s, model
