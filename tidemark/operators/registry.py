"""A registry of models in the shared folder: a model is written once, pinned by its digest and read back as it was."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

_ROW = "name string, version string, kind string, payload string, digest string"


class ChangedModel(ValueError):
    """What is stored under a pin is not what was pinned."""


def digest(name: str, version: str, kind: str, payload: str) -> str:
    return hashlib.sha256("\n".join((name, version, kind, payload)).encode()).hexdigest()


def registry_path(spark: SparkSession, name: str = "models") -> str:
    return f"{shared_dir(spark)}/tidemark/registry/{name}"


def publish(spark: SparkSession, place: str, name: str, version: str, kind: str, payload: str) -> str:
    """Write a model under a name and version, which must be new, and return the digest to pin it by."""
    own = digest(name, version, kind, payload)
    # Writing fails if the folder exists, so a version is never written over.
    spark.createDataFrame([(name, version, kind, payload, own)], _ROW).coalesce(1).write.mode("error").parquet(f"{place}/{name}/{version}")
    return own


def read(spark: SparkSession, place: str, name: str, version: str, pin: str) -> tuple[str, str]:
    """Kind and payload of a pinned model; an error if anything of it was changed, replaced or doubled."""
    rows = spark.read.schema(_ROW).parquet(f"{place}/{name}/{version}").limit(2).collect()
    if len(rows) != 1 or digest(rows[0].name, rows[0].version, rows[0].kind, rows[0].payload) != pin or (rows[0].name, rows[0].version) != (name, version):
        raise ChangedModel(f"{name} {version} is not the model that was pinned as {pin}")
    return rows[0].kind, rows[0].payload


def linear_payload(features: list[str], weights: list[float], intercept: float) -> str:
    return json.dumps({"features": features, "weights": weights, "intercept": intercept}, sort_keys=True)


def network_payload(features: list[str], mean: list[float], scale: list[float], layers: list[tuple[list[list[float]], list[float]]]) -> str:
    return json.dumps({"features": features, "mean": mean, "scale": scale, "layers": layers}, sort_keys=True)


def scores(kind: str, payload: str, columns: dict[str, np.ndarray], margin: np.ndarray, reach: float = 0.35) -> np.ndarray:
    """Chances of a model by its kind: ``linear``, ``boosted`` (a share of trees on top of the margin) or ``network`` (a bounded shift of it)."""
    from .boosting import Boosted, sigmoid

    d = json.loads(payload)
    if kind == "boosted":
        z = margin + d["share"] * np.clip(Boosted.loaded(json.dumps(d["model"])).shifts([columns[c] for c in d["model"]["features"]]), -reach, reach)
    else:
        x = np.stack([columns[c] for c in d["features"]], 1)
        if kind == "linear":
            z = x @ np.array(d["weights"]) + d["intercept"]
        elif kind == "network":
            z = margin + np.clip(network_output(x, d), -reach, reach)
        else:
            raise ValueError(f"unknown kind {kind}")
    return np.clip(sigmoid(z), 1e-4, 1 - 1e-4)


def network_output(x: np.ndarray, d: dict) -> np.ndarray:
    scale = np.array(d["scale"])
    x = (x - np.array(d["mean"])) / np.where(scale == 0, 1.0, scale)
    for k, (w, b) in enumerate(d["layers"]):
        x = x @ np.array(w) + np.array(b)
        if k + 1 < len(d["layers"]):
            x = np.maximum(x, 0)
    return x[:, 0]


def scored(rows: DataFrame, models: dict[str, tuple[str, str]], features: list[str], margin: str = "margin") -> DataFrame:
    """``rows`` with p_<name> for each model (kind, payload), all scored in one pass over Arrow batches."""
    import pandas as pd
    from pyspark.sql import functions as F

    names = sorted(models)

    def run(batches):
        for first, *values in batches:
            columns = {c: v.to_numpy(float, na_value=np.nan) for c, v in zip(features, values, strict=True)}
            base = first.to_numpy(float)
            yield pd.DataFrame({n: scores(*models[n], columns, base) for n in names})

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))
    out = rows.withColumn("_p", udf(F.col(margin).cast("double"), *[F.col(c).cast("double") for c in features]))
    return out.select(*rows.columns, *[F.col(f"_p.{n}").alias(f"p_{n}") for n in names])
