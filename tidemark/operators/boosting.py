"""Boosted trees on top of a base margin, from histograms of gradients that tasks build and Spark adds up.

``pyspark.ml`` has no base margin. A level of a tree is one pass over the binned rows: each task adds
the gradients of its rows by node, feature and bin, the sums are added in a shuffle (nodes times
features times bins rows, whatever the table), and the driver takes the best splits from that bounded
table. Gradients are summed as whole numbers of 2^-24, so results do not hang on the partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

UNIT = float(1 << 24)


class Settings(NamedTuple):
    rounds: int = 300
    depth: int = 3
    rate: float = 0.03
    ridge: float = 10.0
    least_weight: float = 1.0  # of the second derivatives in a child
    bins: int = 64
    #: Rounds without a better loss on the early-stopping rows after which no more trees are grown.
    patience: int = 30
    #: After so many trees the rows' scores are written anew.
    refresh: int = 20


class Tree(NamedTuple):
    """A complete tree as arrays: node k has the children 2k + 1 and 2k + 2; feature -1 is a leaf."""

    feature: list[int]
    bin: list[int]
    value: list[float]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node where each row of bins ends."""
        feature, bins = np.array(self.feature), np.array(self.bin)
        at = np.zeros(len(x), np.int64)
        for _ in range(len(self.feature).bit_length() - 1):
            inner = np.flatnonzero(feature[at] >= 0)
            own = at[inner]
            at[inner] = 2 * own + 1 + (x[inner, feature[own]] > bins[own])
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x)]


class Boosted(NamedTuple):
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]

    def binned(self, values: list[np.ndarray]) -> np.ndarray:
        """Bins of rows; a bin holds what is over its lower edge and up to its upper one, and missing values are in the first."""
        out = np.zeros((len(values[0]) if values else 0, len(values)), np.int64)
        for k, v in enumerate(values):
            out[:, k] = np.searchsorted(self.edges[k], np.where(np.isnan(v), -np.inf, v), "left")
        return out

    def shifts(self, values: list[np.ndarray]) -> np.ndarray:
        """What the trees add to the margin."""
        x = self.binned(values)
        return sum((t.values(x) for t in self.trees), np.zeros(len(x)))

    def shift(self) -> Column:
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                yield pd.Series(self.shifts([c.to_numpy(float, na_value=np.nan) for c in columns]))

        return F.pandas_udf(_typed(run), "double")(*[F.col(c).cast("double") for c in self.features])

    def dumped(self) -> str:
        return json.dumps({"features": self.features, "edges": self.edges, "trees": self.trees}, sort_keys=True)

    @classmethod
    def loaded(cls, text: str) -> Boosted:
        d = json.loads(text)
        return cls(d["features"], d["edges"], [Tree(*t) for t in d["trees"]])


def _typed(run):
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return run


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Distinct quantiles of each feature: at most ``bins`` - 1 numbers a feature come to the driver."""
    at = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted({float(v) for v in got[f"q{i}"] or []}) for i in range(len(features))]


def fit(rows: DataFrame, features: list[str], settings: Settings = Settings()) -> tuple[Boosted, list[float]]:
    """Trees for y on top of ``margin``, and the early-stopping loss before each tree and after the last.

    ``rows``: the features, y (0 or 1), weight, margin (a logit) and part: ``train`` rows grow the
    trees, ``early`` rows stop them, others take no part. The trees up to the least loss are kept; all
    are kept where there are no early rows. Rows with a null y, weight or margin are left out, and
    without train rows there are no trees.
    """
    rows = rows.where("part in ('train', 'early') and y is not null and weight is not null and margin is not null")
    empty = Boosted(features, edges(rows.where("part = 'train'"), features, settings.bins), [])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = empty.binned([b.column(4 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.int16)), len(features)).cast(pa.list_(pa.int16()))], names=["y", "weight", "score", "train", "x"])

    kinds = "y double, weight double, score double, train boolean"
    plain = [F.col("y").cast("double"), F.col("weight").cast("double"), F.col("margin").cast("double"), F.col("part") == "train", *[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features)]]
    state = cut(rows.select(*plain).mapInArrow(prepare, f"{kinds}, x array<smallint>"), "binned_rows")
    trees: list[Tree] = []
    losses: list[float] = []
    fresh = 0  # trees that are in the scores of ``state``
    for _ in range(settings.rounds):
        tree, loss = _grow(state, trees[fresh:], empty, settings)
        losses.append(loss)
        if tree is None or (loss == loss and len(losses) - 1 - int(np.argmin(losses)) >= settings.patience):
            break
        trees.append(tree)
        if len(trees) - fresh >= settings.refresh:
            state, fresh = cut(_rescored(state, trees[fresh:], len(features), f"{kinds}, x array<smallint>"), "binned_rows", instead_of=state), len(trees)
    else:
        losses.append(_sums(state, trees[fresh:], None, empty)[1])
    if trees and losses[0] == losses[0]:
        trees = trees[: int(np.argmin(losses[: len(trees) + 1]))]
    return empty._replace(trees=trees), losses


def _batch(b: pa.RecordBatch, trees: list[Tree], features: int) -> tuple[np.ndarray, ...]:
    y, weight, score, train = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
    x = b.column(4).flatten().to_numpy().reshape(-1, features).astype(np.int64)
    return y, weight, sum((t.values(x) for t in trees), score.astype(float)), train.astype(bool), x


def _rescored(state: DataFrame, trees: list[Tree], features: int, kinds: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = _batch(b, trees, features)[2]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), b.column(3), b.column(4)], names=b.schema.names)

    return state.mapInArrow(run, kinds)


def _sums(state: DataFrame, trees: list[Tree], tree: Tree | None, shape: Boosted) -> tuple[np.ndarray, float]:
    """Sums of both derivatives by node of the level that grows, feature and bin; and the early-stopping loss."""
    widths = [len(e) + 1 for e in shape.edges]
    base = np.concatenate([[0], np.cumsum(widths)])
    first = len(tree.feature) // 2 if tree else 0  # the first node of the last level
    nodes = first + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, nodes * int(base[-1])), np.int64)
        loss = np.zeros(2)
        for b in batches:
            y, weight, score, train, x = _batch(b, trees, len(widths))
            p = sigmoid(score)
            q = np.clip(np.where(y > 0, p, 1 - p), 1e-15, 1)[~train]
            loss += (-(weight[~train] * np.log(q)).sum(), weight[~train].sum())
            if tree is None:
                continue
            at = tree.leaves(x) - first
            keep = train & (at >= 0)
            g, h = (np.rint(v * weight * UNIT).astype(np.int64)[keep] for v in (p - y, p * (1 - p)))
            for f in range(len(widths)):
                cell = at[keep] * base[-1] + base[f] + x[keep, f]
                np.add.at(total[0], cell, g)
                np.add.at(total[1], cell, h)
        used = np.flatnonzero(total.any(axis=0))
        cells = np.append(used, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(np.append(total[0, used], 0)), pa.array(np.append(total[1, used], 0)), pa.array(np.append(np.zeros(len(used)), loss[0])), pa.array(np.append(np.zeros(len(used)), loss[1]))],
            names=["cell", "g", "h", "loss", "weight"],
        )

    got = state.mapInArrow(run, "cell long, g long, h long, loss double, weight double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "loss", "weight")]).toArrow()
    cell, g, h, loss, weight = (got.column(c).to_numpy() for c in ("cell", "g", "h", "loss", "weight"))
    out = np.zeros((2, nodes * int(base[-1])))
    real = cell >= 0
    out[0, cell[real]], out[1, cell[real]] = g[real] / UNIT, h[real] / UNIT
    total = weight[~real].sum()
    return out.reshape(2, nodes, -1), float(loss[~real].sum() / total) if total else float("nan")


class Split(NamedTuple):
    feature: int
    bin: int
    left: float  # the values of both children
    right: float


def best_splits(g: np.ndarray, h: np.ndarray, widths: list[int], settings: Settings) -> list[Split | None]:
    """For each node the split that gains most, the first of equals; none where nothing is gained."""
    base = np.concatenate([[0], np.cumsum(widths)])
    value = lambda x, y: float(-settings.rate * x / (y + settings.ridge))
    out = []
    for own_g, own_h in zip(g, h, strict=True):
        total_g, total_h = own_g[: base[1]].sum(), own_h[: base[1]].sum()
        best, gain = None, 1e-6
        for f, width in enumerate(widths):
            left_g, left_h = np.cumsum(own_g[base[f] : base[f + 1]])[:-1], np.cumsum(own_h[base[f] : base[f + 1]])[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            score = left_g**2 / (left_h + settings.ridge) + right_g**2 / (right_h + settings.ridge) - total_g**2 / (total_h + settings.ridge)
            score = np.where((left_h >= settings.least_weight) & (right_h >= settings.least_weight), score, -np.inf)
            if width > 1 and score.max() > gain:
                k = int(score.argmax())
                best, gain = Split(f, k, value(left_g[k], left_h[k]), value(right_g[k], right_h[k])), float(score.max())
        out.append(best)
    return out


def _grow(state: DataFrame, trees: list[Tree], shape: Boosted, settings: Settings) -> tuple[Tree | None, float]:
    """The next tree, and the early-stopping loss before it; no tree if nothing can be gained. One pass a level."""
    widths = [len(e) + 1 for e in shape.edges]
    tree, loss = Tree([-1], [0], [0.0]), None
    for level in range(settings.depth):
        (g, h), now = _sums(state, trees, tree, shape)
        loss = now if loss is None else loss
        splits = best_splits(g, h, widths, settings)
        if not any(splits):
            break
        first, below = 2**level - 1, 2 ** (level + 1)
        tree.feature.extend([-1] * below)
        tree.bin.extend([0] * below)
        tree.value.extend([0.0] * below)
        for k, split in enumerate(splits, first):
            if split:
                tree.feature[k], tree.bin[k] = split.feature, split.bin
                tree.value[2 * k + 1], tree.value[2 * k + 2] = split.left, split.right
    return (tree if tree.feature[0] >= 0 else None), loss


#: How far a head may move the market's logit, and the shares of it that are tried.
REACH, SHARES = 0.35, (0.0, 0.25, 0.5, 0.75, 1.0)


def offset(market: Column, shift: Column, reach: float = REACH, clip: float = 1e-4) -> Column:
    """The chance at the market's logit plus a shift of at most ``reach`` either way."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), market))
    z = F.ln(q / (1 - q)) + F.greatest(F.lit(-reach), F.least(F.lit(reach), shift))
    return F.greatest(F.lit(clip), F.least(F.lit(1 - clip), 1 / (1 + F.exp(-z))))


def best_share(rows: DataFrame, shift: Column, shares: tuple[float, ...] = SHARES, reach: float = REACH) -> tuple[float, list[float]]:
    """The share of the shift with the least weighted loss of y on top of ``margin``, the first of equals, and all losses."""
    cells = []
    for share in shares:
        z = F.col("margin") + share * F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col("_shift")))
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-z))))
        loss = -F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))
        cells.append((F.sum(F.col("weight") * loss) / F.sum("weight")))
    losses = [x for x in rows.withColumn("_shift", shift).agg(*cells).first()]
    best = 0
    for k, loss in enumerate(losses):
        if loss is not None and losses[best] is not None and loss < losses[best] - 1e-12:
            best = k
    return shares[best], losses


class Head(NamedTuple):
    model: Boosted
    share: float

    def chance(self, market: str = "margin") -> Column:
        z = F.col(market) + self.share * F.greatest(F.lit(-REACH), F.least(F.lit(REACH), self.model.shift()))
        return F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), 1 / (1 + F.exp(-z))))


def fit_head(rows: DataFrame, features: list[str], settings: Settings = Settings()) -> tuple[Head, dict]:
    """Trees on the ``train`` rows, stopped on the ``early`` ones, and their share on those of ``calibration``; with a report."""
    model, losses = fit(rows, features, settings)
    share, tried = best_share(rows.where("part = 'calibration'"), model.shift())
    return Head(model, share), {"trees": len(model.trees), "early_losses": losses, "share": share, "calibration_losses": tried}
