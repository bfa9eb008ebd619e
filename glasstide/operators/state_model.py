"""State model: posteriors of Gaussian states from the feature matrix, named buckets, and a fit by Spark's own mixture.

Standardising, whitening and the states' inverse Cholesky factors are folded on the driver into one matrix and vector per
state (a few hundred numbers). Scoring is row-local and vectorised, with equal priors and no transition terms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import FEATURE_NAMES

# Buckets in the order that breaks ties, and the certainty under which a transition is a risk.
BUCKETS = {"Risk-On": "risk_on_pct", "Risk-On-Retreat": "risk_on_retreat_pct", "Risk-Off": "risk_off_pct", "Risk-Off-Stable": "risk_off_stable_pct"}
ELEVATED, MODERATE = 0.70, 0.90


@dataclass
class State:
    idx: int
    label: str | None
    mean: list[float]
    cov: list[list[float]]


@dataclass
class StateModel:
    """Parameters of scoring. A state without label adds to no bucket."""

    feature_names: list[str]
    scaler_mean: list[float]
    scaler_scale: list[float]
    states: list[State] = field(default_factory=list)
    pca_mean: list[float] | None = None
    pca_components: list[list[float]] | None = None
    pca_explained_variance: list[float] | None = None

    def folded(self) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Per state a, b, c with log-likelihood c - |a x + b|^2 / 2. A singular covariance is an error."""
        scale = np.where(np.array(self.scaler_scale) == 0, 1.0, self.scaler_scale)
        m, o = np.diag(1 / scale), -np.array(self.scaler_mean) / scale
        if self.pca_components is not None:
            w = np.array(self.pca_components) / np.sqrt(self.pca_explained_variance)[:, None]
            m, o = w @ m, w @ (o - np.array(self.pca_mean))
        out = []
        for s in self.states:
            chol = np.linalg.cholesky(np.array(s.cov))
            inverse = np.linalg.inv(chol)
            out.append((inverse @ m, inverse @ (o - np.array(s.mean)), -np.log(np.diag(chol)).sum() - 0.5 * len(chol) * np.log(2 * np.pi)))
        return out


def model_to_json(model: StateModel) -> str:
    return json.dumps(asdict(model))


def model_from_json(text: str) -> StateModel:
    raw = json.loads(text)
    return StateModel(**{**raw, "states": [State(**s) for s in raw["states"]]})


def save_model(model: StateModel, path: str) -> None:
    """model as JSON in a folder of whatever store Spark writes to; what stood there goes."""
    SparkSession.active().createDataFrame([(model_to_json(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(path: str) -> StateModel:
    """The model that save_model() put under path, or that a single JSON file holds."""
    return model_from_json("".join(r["value"] for r in SparkSession.active().read.text(path, wholetext=True).collect()))


def posterior(features: DataFrame, model: StateModel) -> DataFrame:
    """symbol, ts and the states' posteriors p0, p1, ... ; rows with a null feature have none."""
    names = [f"p{i}" for i in range(len(model.states))]
    folded = features.sparkSession.sparkContext.broadcast(model.folded())
    clean = features.dropna("any", subset=list(model.feature_names)).select("symbol", "ts", *[F.col(c).cast("double") for c in model.feature_names])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            log = np.column_stack([c - 0.5 * ((x @ a.T + b) ** 2).sum(axis=1) for a, b, c in folded.value])
            p = np.exp(log - log.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(p.shape[1])]], names=["symbol", "ts", *names])

    schema = T.StructType([clean.schema["symbol"], clean.schema["ts"], *(T.StructField(n, T.DoubleType()) for n in names)])
    return clean.mapInArrow(scored, schema)


def _shares(label: str | None) -> dict[str, float]:
    """How much of a state's posterior each bucket gets."""
    if label is None:
        return {}
    if label in BUCKETS:
        return {label: 100.0}
    if "Risk-On" in label:
        return {"Risk-On": 100.0}
    if "Risk-Off" in label:
        return {"Risk-Off": 100.0}
    return {"Risk-On-Retreat": 50.0, "Risk-Off-Stable": 50.0}


def bucketed(posteriors: DataFrame, model: StateModel) -> DataFrame:
    """symbol, ts, regime, the four buckets in percent, neutral_pct, transition_risk and confidence."""
    df = posteriors
    for label, name in BUCKETS.items():
        parts = [F.col(f"p{i}") * share for i, s in enumerate(model.states) for b, share in _shares(s.label).items() if b == label]
        df = df.withColumn(name, F.bround(sum(parts, F.lit(0.0)), 1))
    most = F.greatest(*BUCKETS.values())
    regime = F
    for label, name in BUCKETS.items():
        regime = regime.when(F.col(name) == most, label)
    top = F.greatest(*[F.col(f"p{i}") for i in range(len(model.states))]) if len(model.states) > 1 else F.col("p0")
    risk = F.when(top < ELEVATED, "Elevated").when(top < MODERATE, "Moderate").otherwise("Low")
    return df.select(
        "symbol", "ts", regime.alias("regime"), *BUCKETS.values(),
        F.bround(F.col("risk_on_retreat_pct") + F.col("risk_off_stable_pct"), 1).alias("neutral_pct"),
        risk.alias("transition_risk"), F.bround(top, 3).alias("confidence"),
    )


def score_history(features: DataFrame, model: StateModel) -> DataFrame:
    return bucketed(posterior(features, model), model)


def least_rows(k: int, components: int) -> int:
    """Rows that a fit takes at least: as many for each state as its covariance has dimensions, and one."""
    return k * (components + 1)


def fit_state_model(features: DataFrame, k: int = 4, components: int = 11, labels: dict[int, str] | None = None, names: tuple[str, ...] = FEATURE_NAMES, seed: int = 7) -> StateModel:
    """A model fitted by Spark's scaler, principal components and Gaussian mixture; all rows count.

    The mixture takes rows as independent draws: it gives states as Gaussians, which is all that scoring uses, but it is no
    hidden Markov training. States are numbered by their first component's mean; labels name them by that number. Fewer rows than
    k full covariances take are an error.
    """
    rows = features.dropna("any", subset=list(names)).select(array_to_vector(F.array(*names)).alias("x"))
    if (n := rows.count()) < least_rows(k, min(components, len(names))):
        raise ValueError(f"{n} rows are too few for {k} states in {components} components")
    scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(rows)
    scaled = scaler.transform(rows)
    components = min(components, len(names))
    pca = PCA(k=components, inputCol="z", outputCol="c").fit(scaled)
    turned = pca.transform(scaled)
    variance = turned.select(Summarizer.variance(F.col("c"))).first()[0].toArray()
    keep = np.flatnonzero(variance > 1e-10)
    matrix = pca.pc.toArray().T[keep]
    parts = vector_to_array(F.col("c"))
    white = turned.select(array_to_vector(F.array(*[parts[int(i)] / float(np.sqrt(variance[i])) for i in keep])).alias("w"))
    mixture = GaussianMixture(k=k, featuresCol="w", seed=seed, maxIter=50).fit(white)
    found = sorted((r["mean"].toArray().tolist(), r["cov"].toArray().tolist()) for r in mixture.gaussiansDF.collect())
    states = [State(i, (labels or {}).get(i), m, (np.array(c) + 1e-6 * np.eye(len(m))).tolist()) for i, (m, c) in enumerate(found)]
    return StateModel(
        list(names), scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), states,
        pca_mean=[0.0] * len(names), pca_components=matrix.tolist(), pca_explained_variance=variance[keep].tolist(),
    )
