"""A recurrent model over packed sequences: one array of states a match, a forecast at each of its states.

Gradients are summed over the partitions and added up by place in a shuffle, so what meets on the
driver is as large as the model, not as the table. Tasks pad matches of like length together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

Weights = dict[str, np.ndarray]


def pack(rows: DataFrame, key: str, order: list[str], features: list[str], most: int = 64) -> DataFrame:
    """key, y, ids and x (a flat list of features by step) of each match, in order, its first ``most`` states at once.

    A longer match goes on in further rows of ``part`` 1, 2 and so on, which start anew, so no row
    grows with a match. Null features are 0. ``rows``: key, id, y, the order and the features.
    """
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    steps = rows.select(F.col(key).alias("key"), "id", F.col("y").cast("double").alias("y"), values.alias("v"), k.alias("k"))
    packed = steps.groupBy("key", F.expr(f"k div {most}").alias("part")).agg(F.max("y").alias("y"), F.sort_array(F.collect_list(F.struct("k", "id", "v"))).alias("s"))
    return packed.select("key", "part", "y", F.col("s.id").alias("ids"), F.flatten(F.col("s.v")).alias("x"))


def start(features: int, width: int, seed: int = 42) -> Weights:
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(width)
    draw = lambda *shape: rng.uniform(-scale, scale, shape)
    return {"w": draw(3, features, width), "u": draw(3, width, width), "b": np.zeros((3, width)), "v": draw(width), "c": np.zeros(1)}


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def forward(weights: Weights, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Logits of each match and step, and what the way back needs. ``x``: matches, steps, features."""
    w, u, b = weights["w"], weights["u"], weights["b"]
    h = np.zeros((len(x), w.shape[2]))
    logits, kept = np.empty(x.shape[:2]), []
    for t in range(x.shape[1]):
        z, r = (_sigmoid(x[:, t] @ w[g] + h @ u[g] + b[g]) for g in (0, 1))
        hn = h @ u[2]
        n = np.tanh(x[:, t] @ w[2] + r * hn + b[2])
        kept.append((h, z, r, hn, n))
        h = (1 - z) * n + z * h
        logits[:, t] = h @ weights["v"] + weights["c"][0]
    return logits, kept


def gradients(weights: Weights, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[float, Weights]:
    """The loss of all matches, each the mean over its steps, and its gradients by going back through time."""
    logits, kept = forward(weights, x)
    there = np.arange(x.shape[1]) < length[:, None]
    share = there / np.maximum(length, 1)[:, None]
    p = _sigmoid(logits)
    loss = -(share * np.log(np.clip(np.where(y[:, None] > 0, p, 1 - p), 1e-12, 1))).sum()
    d = (p - y[:, None]) * share
    w, u = weights["w"], weights["u"]
    g = {k: np.zeros_like(v) for k, v in weights.items()}
    back = np.zeros((len(x), w.shape[2]))
    for t in reversed(range(x.shape[1])):
        h, z, r, hn, n = kept[t]
        after = (1 - z) * n + z * h
        g["v"] += after.T @ d[:, t]
        g["c"] += d[:, t].sum()
        dh = back + d[:, t, None] * weights["v"]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        for k, part in ((0, dz), (1, dr), (2, dn)):
            g["w"][k] += x[:, t].T @ part
            g["b"][k] += part.sum(0)
            g["u"][k] += h.T @ (part * r if k == 2 else part)
        back = dh * z + dz @ u[0].T + dr @ u[1].T + (dn * r) @ u[2].T
    return float(loss), g


def padded(lists: pa.Array, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their matches padded to a common length, and their lengths: by powers of two of the length."""
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    flat_, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    length = size // features
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for k in np.unique(bucket).tolist():
        rows = np.flatnonzero(bucket == k)
        x = np.zeros((len(rows), int(length[rows].max(initial=0)), features))
        for i, r in enumerate(rows.tolist()):
            x[i, : length[r]] = flat_[off[r] : off[r + 1]].reshape(-1, features)
        yield rows, x, length[rows]


def standards(packed: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features, 3))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            total += np.stack([np.full(features, len(x)), x.sum(0), (x * x).sum(0)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features)), *(pa.array(total[:, k]) for k in range(3))], names=["f", "n", "s", "q"])

    got = packed.select("x").mapInArrow(run, "f long, n double, s double, q double").groupBy("f").agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("f").toPandas()
    n = np.maximum(got["n"].to_numpy(), 1)
    mean = got["s"].to_numpy() / n
    deviation = np.sqrt(np.maximum(got["q"].to_numpy() / n - mean**2, 0))
    return mean, np.where(deviation > 0, deviation, 1.0)


def summed(packed: DataFrame, weights: Weights, mean: np.ndarray, deviation: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean loss of all matches and its gradient."""
    size = len(flat(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for rows, x, length in padded(b.column(1), len(mean)):
                loss, g = gradients(weights, (x - mean) / deviation, y[rows], length)
                total += np.concatenate([flat(g), [loss, len(rows)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], names=["place", "value"])

    got = packed.select("y", "x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size + 2)
    out[got.column("place").to_numpy()] = got.column("value").to_numpy()
    return float(out[-2] / max(out[-1], 1)), out[:-2] / max(out[-1], 1)


class Recurrent:
    """A fitted model: weights and the standards of its features."""

    def __init__(self, weights: Weights, mean: np.ndarray, deviation: np.ndarray, losses: list[float]):
        self.weights, self.mean, self.deviation, self.losses = weights, mean, deviation, losses

    def forecasts(self, packed: DataFrame) -> DataFrame:
        """key, id, p: the chance after each state, from that state and the earlier ones alone."""
        id_kind = packed.schema["ids"].dataType.elementType.simpleString()
        key_kind = packed.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, x, length in padded(b.column(2), len(self.mean)):
                    logits, _ = forward(self.weights, (x - self.mean) / self.deviation)
                    p = _sigmoid(logits)[np.arange(x.shape[1]) < length[:, None]]
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(rows, length))), b.column(1).take(take).flatten(), pa.array(p)], names=["key", "id", "p"])

        return packed.select("key", "ids", "x").mapInArrow(run, f"key {key_kind}, id {id_kind}, p double")

    def dumped(self) -> str:
        return json.dumps({"weights": {k: v.tolist() for k, v in self.weights.items()}, "mean": self.mean.tolist(), "deviation": self.deviation.tolist()}, sort_keys=True)

    @classmethod
    def loaded(cls, text: str) -> Recurrent:
        d = json.loads(text)
        return cls({k: np.array(v) for k, v in d["weights"].items()}, np.array(d["mean"]), np.array(d["deviation"]), [])


def fit(packed: DataFrame, features: int, width: int = 8, epochs: int = 30, rate: float = 0.02, decay: float = 1e-3, seed: int = 42) -> Recurrent:
    """``epochs`` steps of Adam, each over all matches; no match is left out. Without matches the first weights stay."""
    packed = cut(packed, "packed")
    mean, deviation = standards(packed, features)
    if len(mean) != features:
        mean, deviation = np.zeros(features), np.ones(features)
    weights, losses = start(features, width, seed), []
    now = flat(weights)
    first, second = np.zeros_like(now), np.zeros_like(now)
    for t in range(1, epochs + 1):
        loss, g = summed(packed, shaped(now, weights), mean, deviation)
        losses.append(loss)
        g = g + decay * now
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        now = now - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Recurrent(shaped(now, weights), mean, deviation, losses)
