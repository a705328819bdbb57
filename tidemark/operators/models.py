"""Models in order of time: estimators, calibrators fitted on later rows, and walk-forward forecasts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import clipped_logit
from ..sources.shared import cut
from . import registry
from .boosting import offset

Scorer = Callable[[DataFrame], DataFrame]
#: Fewer rows than this, or one class only, are not calibrated on.
LEAST = 100


def estimator(kind: str, seed: int = 42, width: int = 0):
    """lr, gb, rf or mlp (``width`` features) on columns ``features`` and ``y``."""
    own = {"featuresCol": "features", "labelCol": "y"}
    if kind == "lr":
        return LogisticRegression(maxIter=50, regParam=0.01, **own)
    if kind == "gb":
        return GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **own)
    if kind == "rf":
        return RandomForestClassifier(numTrees=30, maxDepth=5, seed=seed, **own)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[width, 16, 2], maxIter=60, seed=seed, **own)
    raise ValueError(f"unknown estimator {kind}")


def fitted(rows: DataFrame, features: list[str], kind: str = "lr", seed: int = 42) -> Scorer:
    """A scorer that adds ``p``, the chance that y is 1."""
    to_vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    model = estimator(kind, seed, len(features)).fit(to_vector.transform(rows.select(*features, F.col("y").cast("double").alias("y"))))

    def score(new: DataFrame) -> DataFrame:
        out = model.transform(to_vector.transform(new.drop("p", "features", "rawPrediction", "probability", "prediction")))
        return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    return score


def enough(rows: DataFrame) -> bool:
    n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    return n.n >= LEAST and 0 < n.ones < n.n


def platt(rows: DataFrame) -> tuple[float, float] | None:
    """Slope and intercept of y on the logit of p, or None where there is not enough to fit."""
    if not enough(rows):
        return None
    x = VectorAssembler(inputCols=["z"], outputCol="features").transform(rows.select(clipped_logit(F.col("p")).alias("z"), F.col("y").cast("double").alias("y")))
    model = LogisticRegression(maxIter=100, tol=1e-10, standardization=False, featuresCol="features", labelCol="y").fit(x)
    return float(model.coefficients[0]), float(model.intercept)


def platt_scaled(p: Column, line: tuple[float, float] | None) -> Column:
    return p if line is None else 1 / (1 + F.exp(-(line[0] * clipped_logit(p) + line[1])))


def isotonic(rows: DataFrame, steps: int = 10_000) -> Scorer:
    """A scorer that replaces p by a rising step function of it; without enough rows p stays.

    Chances are counted in ``steps`` steps first, so what meets in one place is bounded by them.
    """
    if not enough(rows):
        return lambda new: new
    at = (F.round(F.col("p") * steps) / steps).alias("x")
    counts = rows.groupBy(at).agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", predictionCol="iso").fit(counts)
    return lambda new: model.transform(new.withColumn("x", at)).withColumn("p", F.col("iso")).drop("x", "iso")


def fitted_then_calibrated(rows: DataFrame, features: list[str], time: str, kind: str = "lr", late: float = 0.2) -> Scorer:
    """The model of the earlier rows, calibrated on the last ``late`` share of the time they cover."""
    span = rows.agg(F.unix_micros(F.min(F.col(time).cast("timestamp"))).alias("a"), F.unix_micros(F.max(F.col(time).cast("timestamp"))).alias("z")).first()
    cut_at = span.a + int((span.z - span.a) * (1 - late)) if span.a is not None else 0
    now = F.unix_micros(F.col(time).cast("timestamp"))
    base = fitted(rows.where(now < cut_at), features, kind)
    line = platt(base(rows.where(now >= cut_at)))
    return lambda new: base(new).withColumn("p", platt_scaled(F.col("p"), line))


def walk_forward_scores(folds: DataFrame, features: list[str], time: str, splits: int, kind: str = "lr") -> DataFrame:
    """The test rows of ``folds`` (fold, part and the features), each scored by the model of its own fold's training rows."""
    folds = cut(folds, "folds")
    out = None
    for k in range(splits):
        own = folds.where(F.col("fold") == k)
        scored = fitted_then_calibrated(own.where("part = 'train'"), features, time, kind)(own.where("part = 'test'"))
        out = scored if out is None else out.union(scored)
    return out


#: Labels drawn in for the target of a regression, and how far a residual may move the market.
SMOOTH, RESIDUAL_REACH = (0.05, 0.90), 0.25


def market_or_even(p: Column) -> Column:
    """The market's chance; one half where it is missing or extreme."""
    return F.coalesce(F.when(p.between(0.01, 0.99), p), F.lit(0.5))


def residual_forecasts(train: DataFrame, new: DataFrame, features: list[str], market: str, kind: str = "gbr", reach: float = RESIDUAL_REACH, seed: int = 42) -> DataFrame:
    """``new`` with p: the market's chance moved by a model by at most ``reach`` of its logit.

    ``gbr`` fits trees to the bounded difference of the smoothed label's logit and the market's; any
    other kind is an estimator of ``fitted``, whose own chance is moved back to within reach.
    """
    at = clipped_logit(market_or_even(F.col(market)))
    bounded = lambda x: F.greatest(F.lit(-reach), F.least(F.lit(reach), x))
    if kind == "gbr":
        target = bounded(clipped_logit(SMOOTH[0] + SMOOTH[1] * F.col("y")) - at)
        to_vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
        model = GBTRegressor(maxIter=20, maxDepth=3, stepSize=0.1, minInstancesPerNode=20, seed=seed, featuresCol="features", labelCol="target", predictionCol="shift")
        model = model.fit(to_vector.transform(train.select(*features, target.alias("target"))))
        out = model.transform(to_vector.transform(new)).withColumn("shift", bounded(F.col("shift"))).drop("features")
    else:
        out = fitted(train, features, kind, seed)(new).withColumn("shift", bounded(clipped_logit(F.col("p")) - at))
    return out.withColumn("p", offset(market_or_even(F.col(market)), F.col("shift"), reach))


#: The least edge to commit to, and the stake windows of the lines.
LEAST_EDGE, LEAST_CHANCE, ODDS = 0.02, 0.55, (1.2, 6.0)


def vote(p: Column, a: Column, b: Column) -> Column:
    """struct(side, probability, odds, edge, reason): the side a line may confirm at these prices, null with the reason why not."""
    q = F.round(1 - p, 4)
    ea, eb = (F.when(o > 1, F.round(x * o - 1, 4)).otherwise(-1.0) for x, o in ((p, a), (q, b)))
    first = ea >= eb
    chance, odds, edge = F.when(first, p).otherwise(q), F.when(first, a).otherwise(b), F.when(first, ea).otherwise(eb)
    best = F.greatest(F.when(a > 1, p * a - 1).otherwise(-1.0), F.when(b > 1, q * b - 1).otherwise(-1.0))
    reason = F.when(best < LEAST_EDGE, "NO_EDGE").when(odds < ODDS[0], "ODDS_TOO_SHORT").when(odds >= ODDS[1], "ODDS_TOO_LONG").when(chance < LEAST_CHANCE, "PROBABILITY_TOO_LOW").otherwise("")
    side = F.when(reason == "", F.when(first, "a").otherwise("b"))
    return F.struct(side.alias("side"), F.round(chance, 4).alias("probability"), odds.alias("odds"), edge.alias("edge"), reason.alias("reason"))


def composite(rows: DataFrame, chances: list[str], a: str, b: str) -> DataFrame:
    """``rows`` with side, p_a, agreed and reasons: a side only where all lines confirm it.

    p_a is the mean of the lines' chances of that side, seen from side a; without a common side the
    mean of their chances of a. agreed: how many lines are for the side that most are for.
    """
    votes = rows.withColumn("_votes", F.array(*[vote(F.col(c), F.col(a), F.col(b)) for c in chances]))
    sides = F.transform("_votes", lambda v: v["side"])
    count = lambda s: F.size(F.filter(sides, lambda x: x.eqNullSafe(F.lit(s))))
    n = len(chances)
    mean = lambda of: F.aggregate(of, F.lit(0.0), lambda t, x: t + x) / n
    chosen = mean(F.transform("_votes", lambda v: v["probability"]))
    p_a = F.when(count("a") == n, F.round(chosen, 4)).when(count("b") == n, F.round(1 - chosen, 4)).otherwise(F.round(mean(F.array(*[F.round(F.col(c), 4) for c in chances])), 4))
    out = votes.withColumns({
        "side": F.when(count("a") == n, "a").when(count("b") == n, "b"), "p_a": p_a, "agreed": F.greatest(count("a"), count("b")),
        "reasons": F.array_join(F.transform("_votes", lambda v: v["reason"]), ","),
    })
    return out.drop("_votes")


def linear_payload(rows: DataFrame, features: list[str]) -> str:
    """A logistic line as it goes into the registry."""
    x = VectorAssembler(inputCols=features, outputCol="features").transform(rows.select(*features, F.col("y").cast("double").alias("y"), "weight"))
    model = LogisticRegression(maxIter=50, regParam=0.01, featuresCol="features", labelCol="y", weightCol="weight").fit(x)
    return registry.linear_payload(features, [float(w) for w in model.coefficients], float(model.intercept))


def network_payload(rows: DataFrame, features: list[str], widths: tuple[int, ...] = (16, 8), epochs: int = 15, rate: float = 0.5, seed: int = 42) -> str:
    """A small network that moves the market's logit, as it goes into the registry.

    A full pass over the rows a step: tasks sum the gradients of their rows, the driver adds up one
    vector of the network's size a task and moves the weights. ``epochs`` passes, no row is left out.
    """
    stats = rows.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    mean, scale = [float(v or 0) for v in stats[: len(features)]], [float(v or 1) for v in stats[len(features) :]]
    rng = np.random.default_rng(seed)
    sizes = [len(features), *widths, 1]
    layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)) * (0.1 if b == 1 else 1), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    plain = cut(rows.select(F.col("y").cast("double"), F.col("weight").cast("double"), F.col("margin").cast("double"), *[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)]), "network_rows")
    velocity = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    for _ in range(epochs):
        step = summed_gradients(plain, lambda y, w, m, x, own=layers: network_gradients(own, (x - mean) / np.where(np.array(scale) == 0, 1, scale), y, w, m), sum(w.size + b.size for w, b in layers))
        at, moved = 0, []
        for k, (w, b) in enumerate(layers):
            gw, gb = step[at : at + w.size].reshape(w.shape), step[at + w.size : at + w.size + b.size]
            at += w.size + b.size
            velocity[k] = (0.9 * velocity[k][0] - rate * gw, 0.9 * velocity[k][1] - rate * gb)
            moved.append((w + velocity[k][0], b + velocity[k][1]))
        layers = moved
    return registry.network_payload(features, mean, scale, [(w.tolist(), b.tolist()) for w, b in layers])


def network_gradients(layers: list, x: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, reach: float = 0.35) -> np.ndarray:
    """Gradients of the weighted log loss of all weights in a row; the bound lets a gradient pass that leads back inside."""
    kept = [x]
    for k, (w, b) in enumerate(layers):
        z = kept[-1] @ w + b
        kept.append(np.maximum(z, 0) if k + 1 < len(layers) else z)
    raw = kept[-1][:, 0]
    p = 1 / (1 + np.exp(-(margin + np.clip(raw, -reach, reach))))
    d = ((p - y) * weight)[:, None]
    d = np.where((np.abs(raw) < reach)[:, None] | (d * raw[:, None] > 0), d, 0)
    out = []
    for k in reversed(range(len(layers))):
        out[:0] = [(kept[k].T @ d).ravel(), d.sum(0)]
        d = (d @ layers[k][0].T) * (kept[k] > 0)
    return np.concatenate(out)


def summed_gradients(rows: DataFrame, of, size: int) -> np.ndarray:
    """The mean by weight of ``of(y, weight, margin, x)`` over all rows; one vector a task comes to the driver, added up by place first."""

    def run(batches):
        total, weight = np.zeros(size), 0.0
        for b in batches:
            y, w, m, *x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            total += of(y, w, m, np.stack(x, 1))
            weight += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(total, weight))], names=["place", "value"])

    got = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size + 1)
    out[got.column("place").to_numpy()] = got.column("value").to_numpy()
    return out[:-1] / max(out[-1], 1e-12)
