"""Linear discriminant classification of embedding vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 16


@dataclass(frozen=True)
class LdaModel:
    """One coefficient row per class, classes in sorted order, and the moments they come from."""

    classes: tuple[str, ...]
    coef: np.ndarray
    intercept: np.ndarray
    counts: np.ndarray
    means: np.ndarray
    covariance: np.ndarray


# Moments: (count and mean) of each class, and the scatter of all vectors around the mean of their class.
Moments = tuple[dict[str, tuple[int, np.ndarray]], np.ndarray]


def merge_moments(a: Moments, b: Moments) -> Moments:
    """Moments of both inputs together. Means move by their difference, so a large offset of the vectors costs no digits."""
    classes, within = dict(a[0]), a[1] + b[1]
    for name, (n, mean) in b[0].items():
        if name in classes:
            n0, mean0 = classes[name]
            gap = mean - mean0
            within = within + np.outer(gap, gap) * (n0 * n / (n0 + n))
            mean = mean0 + gap * (n / (n0 + n))
            n += n0
        classes[name] = n, mean
    return classes, within


def _moments(label: str, vector: str):
    """Moments of a partition."""

    def partial(frames):
        found = None
        for frame in frames:
            if not len(frame):
                continue
            x, names = np.stack(frame[vector].to_numpy()).astype(np.float64), frame[label].to_numpy()
            for name in set(names):
                rows = x[names == name]
                mean = rows[0] + (rows - rows[0]).mean(axis=0)
                own = {name: (len(rows), mean)}, (rows - mean).T @ (rows - mean)
                found = own if found is None else merge_moments(found, own)
        if found is not None:
            yield _as_rows(found)

    return partial


_SUMS = "label string, row int, n bigint, v array<double>"


def _as_rows(moments: Moments) -> pd.DataFrame:
    classes, within = moments
    return pd.DataFrame({
        "label": [*classes, None], "row": [-1] * len(classes) + [-2], "n": [n for n, _ in classes.values()] + [0],
        "v": [m for _, m in classes.values()] + [within.ravel()]})


def _from_rows(frame: pd.DataFrame) -> Moments | None:
    """The moments of all tasks in a frame; ``src`` tells whose a row is."""
    found = None
    for _, own in frame.groupby("src"):
        classes = {name: (int(n), np.asarray(v)) for name, row, n, v in zip(own["label"], own["row"], own["n"], own["v"]) if row == -1}
        scatter = np.asarray(next(v for row, v in zip(own["row"], own["v"]) if row == -2))
        dim = len(next(iter(classes.values()))[1])
        one = classes, scatter.reshape(dim, dim)
        found = one if found is None else merge_moments(found, one)
    return found


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """Merges the moments of up to FAN_IN tasks."""
    return _as_rows(_from_rows(frame)).assign(src=frame["at"].iloc[0])


def lda_fit(vectors: DataFrame, label: str, vector: str = "embedding", tol: float = 1e-4) -> LdaModel:
    """Class priors, means and pooled covariance (divisor n - K) from one pass.

    Tasks send only centred moments: d per class and d x d once, merged FAN_IN at a time on
    the cluster. The driver gets the last few and solves the d x d system, dropping
    directions of next to no variance. It needs about 8 * d * d bytes a few times over.
    """
    dim = vectors.select(F.max(F.size(vector))).first()[0]
    if dim is None:
        raise ValueError("no vectors to fit")
    rows = vectors.select(F.col(label).alias(label), vector).filter(F.col(label).isNotNull())
    n_parts = (rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    parts = rows.mapInPandas(_moments(label, vector), _SUMS).withColumn("src", F.spark_partition_id())
    while n_parts > FAN_IN:
        parts = parts.withColumn("at", F.floor(F.col("src") / FAN_IN).cast("int")).groupBy("at").applyInPandas(_add_up, f"{_SUMS}, src int")
        n_parts = -(-n_parts // FAN_IN)
    found = _from_rows(parts.toPandas())
    classes = tuple(sorted(found[0])) if found else ()
    k = len(classes)
    if k < 2:
        raise ValueError("at least two classes are needed")
    counts = np.array([found[0][c][0] for c in classes], dtype=float)
    means = np.stack([found[0][c][1] for c in classes])
    total, within = counts.sum(), found[1]
    priors = counts / total
    scale = np.sqrt(np.maximum(np.diag(within) / total, 0.0))
    scale[scale == 0] = 1.0
    values, axes = np.linalg.eigh(within / (total - k) / np.outer(scale, scale))
    strong = np.sqrt(np.maximum(values, 0.0)) > tol
    white = (axes[:, strong] / scale[:, None]) / np.sqrt(values[strong])
    centre = priors @ means
    offsets = (means - centre) @ white
    coef = offsets @ white.T
    intercept = -0.5 * (offsets**2).sum(axis=1) + np.log(priors) - coef @ centre
    return LdaModel(classes, coef, intercept, counts, means, within / (total - k))


_STORED = "classes array<string>, dim int, coef array<double>, intercept array<double>, counts array<double>, means array<double>, covariance array<double>"


def save_model(spark: SparkSession, model: LdaModel, path: str) -> None:
    """The model as one row of Parquet at ``path``, in place of an earlier one."""
    flat = [np.asarray(x, dtype=np.float64).ravel().tolist() for x in (model.coef, model.intercept, model.counts, model.means, model.covariance)]
    row = (list(model.classes), int(model.means.shape[1]), *flat)
    spark.createDataFrame([row], _STORED).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> LdaModel:
    r = spark.read.schema(_STORED).parquet(path).first()
    k, d = len(r["classes"]), r["dim"]
    return LdaModel(tuple(r["classes"]), np.reshape(r["coef"], (k, d)), np.array(r["intercept"]), np.array(r["counts"]),
                    np.reshape(r["means"], (k, d)), np.reshape(r["covariance"], (d, d)))


def lda_predict(vectors: DataFrame, model: LdaModel, top_k: int = 1, vector: str = "embedding") -> DataFrame:
    """Adds ``predictions``: label, probability and level (high, medium, low), best first."""
    coef, intercept, classes = model.coef, model.intercept, list(model.classes)

    def probabilities(x: pd.Series) -> pd.Series:
        scores = np.stack(x.to_numpy()).astype(np.float64) @ coef.T + intercept
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return pd.Series(list(scores / scores.sum(axis=1, keepdims=True)))

    prob = F.pandas_udf(probabilities, T.ArrayType(T.DoubleType()))(vector)
    labelled = F.transform(F.arrays_zip(F.lit(classes).alias("label"), prob.alias("prob")), lambda s: F.struct(
        (-s["prob"]).alias("neg"), s["label"].alias("label")))
    best = F.slice(F.array_sort(labelled), 1, top_k)
    return vectors.withColumn("predictions", F.transform(best, lambda s: F.struct(
        s["label"].alias("label"), (-s["neg"]).alias("prob"),
        F.when(-s["neg"] > 0.7, "high").when(-s["neg"] > 0.4, "medium").otherwise("low").alias("level"))))
