"""Boosted trees on a margin against a plain loop, bounded residuals, a network's gradients and the registry."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, registry
from tidemark.operators import models as M
from tidemark.plans import QUERIES
from tidemark.plans.models import FEATURES, HEAD, pinned_models, priced_matches


def plain_trees(rows, edges, s):
    """Trees by recursion over all rows at once, and the early-stopping losses."""
    x = np.array([[np.searchsorted(e, r[c], "left") for c, e in zip(FEATURES, edges)] for r in rows])
    y, w, part = np.array([r["y"] for r in rows]), np.array([r["weight"] for r in rows]), np.array([r["part"] for r in rows])
    score = np.array([r["margin"] for r in rows])
    train, early = part == "train", part == "early"

    def loss():
        p = np.clip(1 / (1 + np.exp(-score[early])), 1e-15, 1 - 1e-15)
        return float(-(w[early] * np.where(y[early] == 1, np.log(p), np.log(1 - p))).sum() / w[early].sum())

    def grow(idx, rest, g, h, depth):
        """Adds the leaf value to the scores of ``idx`` (train) and ``rest`` (others)."""
        G, H = g[idx].sum(), h[idx].sum()
        best = (1e-6, None)
        if depth:
            for f in range(len(FEATURES)):
                for b in range(len(edges[f])):
                    left = idx[x[idx, f] <= b]
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl < s.least_weight or H - hl < s.least_weight:
                        continue
                    gain = gl**2 / (hl + s.ridge) + (G - gl) ** 2 / (H - hl + s.ridge) - G**2 / (H + s.ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b))
        if best[1] is None:
            return depth < s.depth and (value := -s.rate * G / (H + s.ridge), score.__setitem__(np.concatenate([idx, rest]), score[np.concatenate([idx, rest])] + value)) is not None
        f, b = best[1]
        for side in (True, False):
            grow(idx[(x[idx, f] <= b) == side], rest[(x[rest, f] <= b) == side], g, h, depth - 1)
        return True

    losses, scores = [], []
    for _ in range(s.rounds):
        losses.append(loss())
        scores.append(score.copy())
        if len(losses) - 1 - int(np.argmin(losses)) >= s.patience:
            break
        p = 1 / (1 + np.exp(-score))
        if not grow(np.flatnonzero(train), np.flatnonzero(~train), (p - y) * w, p * (1 - p) * w, s.depth):
            break
    else:
        losses.append(loss())
        scores.append(score.copy())
    return losses, scores[int(np.argmin(losses))]


def test_trees_equal_a_plain_loop(spark, sf):
    rows = priced_matches(spark, sf).where("family = 'match'").cache()
    s = boosting.Settings(rounds=6, rate=0.2, patience=3, bins=12, depth=2, refresh=2)
    model, losses = boosting.fit(rows, FEATURES, s)
    plain = [r.asDict() for r in rows.collect()]
    want, scores = plain_trees(plain, model.edges, s)
    assert losses == pytest.approx(want, abs=1e-5)
    got = {r.event_id: r.z for r in rows.select("event_id", (F.col("margin") + model.shift()).alias("z")).collect()}
    assert [got[r["event_id"]] for r in plain] == pytest.approx(scores.tolist(), abs=1e-5)
    again, _ = boosting.fit(rows.repartition(13), FEATURES, s)
    assert again.trees == model.trees, "results do not hang on the partitions"
    assert boosting.Boosted.loaded(model.dumped()).trees == model.trees
    none, losses = boosting.fit(rows.where("part = 'early'"), FEATURES, s)
    assert none.trees == []
    rows.unpersist()


def test_shares_and_heads(spark, sf):
    got = QUERIES["u23_market_offset"](spark, sf).collect()
    logit = lambda p: math.log(p / (1 - p))
    assert len(got) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert max(abs(logit(r.p) - logit(r.market)) for r in got if 0.001 < r.p < 0.999) <= 0.35 + 1e-6
    rows = priced_matches(spark, sf).where("family = 'set'").cache()
    head, report = boosting.fit_head(rows, FEATURES, HEAD)
    cal = [r for r in rows.withColumn("s", head.model.shift()).collect() if r.part == "calibration"]
    losses = []
    for share in boosting.SHARES:
        p = [1 / (1 + math.exp(-(r.margin + share * max(-0.35, min(0.35, r.s))))) for r in cal]
        losses.append(-sum(r.weight * math.log(q if r.y else 1 - q) for r, q in zip(cal, p)) / sum(r.weight for r in cal))
    assert report["calibration_losses"] == pytest.approx(losses, abs=1e-9) and head.share == boosting.SHARES[int(np.argmin(losses))]
    want = {r.event_id: 1 / (1 + math.exp(-(r.margin + head.share * max(-0.35, min(0.35, r.s))))) for r in cal}
    for r in got:
        if r.event_id in want:
            assert r.p == pytest.approx(min(1 - 1e-4, max(1e-4, want[r.event_id])), abs=1e-6)
    rows.unpersist()


def test_offset_is_bounded(spark):
    df = spark.createDataFrame([(0.3, 9.0), (0.3, -9.0), (0.3, 0.1), (0.0, 0.0), (1.0, 5.0)], "m double, s double")
    got = [r.p for r in df.select(boosting.offset(F.col("m"), F.col("s")).alias("p")).collect()]
    z = math.log(0.3 / 0.7)
    assert got[:3] == pytest.approx([1 / (1 + math.exp(-(z + s))) for s in (0.35, -0.35, 0.1)])
    assert got[3] == 1e-4 and got[4] == 1 - 1e-4


def test_residual_forecasts_stay_within_reach(spark, sf):
    rows = QUERIES["u21_residual_forecasts"](spark, sf).collect()
    assert rows and {r.event_id for r in rows} == {r.event_id for r in spark.read.parquet(f"{sf}/events.parquet").where("ts >= timestamp_ntz '2024-01-22'").collect()}
    for r in rows:
        m = r.market if 0.01 <= r.market <= 0.99 else 0.5
        for p, s in ((r.p_trees, r.shift_trees), (r.p_line, r.shift_line)):
            assert abs(s) <= M.RESIDUAL_REACH and p == pytest.approx(1 / (1 + math.exp(-(math.log(m / (1 - m)) + s))), abs=1e-9)
    assert len({round(r.shift_trees, 6) for r in rows}) > 10


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(3)
    layers = [(rng.normal(0, 0.5, (4, 5)), rng.normal(0, 0.1, 5)), (rng.normal(0, 0.5, (5, 1)), rng.normal(0, 0.1, 1))]
    x, y, w, m = rng.normal(0, 1, (30, 4)), rng.integers(0, 2, 30), rng.random(30), rng.normal(0, 1, 30)

    def loss(layers):
        z = np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
        p = 1 / (1 + np.exp(-(m + np.clip(z[:, 0], -9, 9))))
        return -(w * np.where(y == 1, np.log(p), np.log(1 - p))).sum()

    flat = [v for layer in layers for v in layer]
    want = []
    for v in flat:
        for i in np.ndindex(v.shape):
            v[i] += 1e-6
            up = loss(layers)
            v[i] -= 2e-6
            want.append((up - loss(layers)) / 2e-6)
            v[i] += 1e-6
    assert M.network_gradients(layers, x, y, w, m, reach=9.0) == pytest.approx(np.array(want), abs=1e-5)


def test_registry_gives_back_what_was_pinned(spark, sf, tmp_path):
    place = f"file://{tmp_path}/registry"
    rows = priced_matches(spark, sf).where("family = 'match'").cache()
    pins = pinned_models(rows.where("part <> 'calibration'"), place)
    models = {n: registry.read(spark, place, n, "1.0.0", pin) for n, pin in pins.items()}
    cal = rows.where("part = 'calibration'")
    once = {r.event_id: r for r in registry.scored(cal, models, FEATURES).collect()}
    plain = cal.toPandas()
    columns = {c: plain[c].to_numpy(float) for c in FEATURES}
    for name, (kind, payload) in models.items():
        p = registry.scores(kind, payload, columns, plain["margin"].to_numpy(float))
        assert [once[i][f"p_{name}"] for i in plain["event_id"]] == pytest.approx(p.tolist(), abs=1e-12)
    with pytest.raises(Exception, match="(?i)exist"):
        registry.publish(spark, place, "logistic", "1.0.0", "linear", "{}")
    with pytest.raises(registry.ChangedModel):
        registry.read(spark, place, "logistic", "1.0.0", pins["boosting"])
    payload = json.loads(models["logistic"][1])
    payload["intercept"] += 0.001
    changed = spark.createDataFrame([("logistic", "1.0.0", "linear", json.dumps(payload, sort_keys=True), pins["logistic"])], registry._ROW)
    changed.write.mode("overwrite").parquet(f"{place}/logistic/1.0.0")
    with pytest.raises(registry.ChangedModel):
        registry.read(spark, place, "logistic", "1.0.0", pins["logistic"])
    rows.unpersist()


def test_composite_query(spark, sf):
    rows = QUERIES["u24_composite"](spark, sf).collect()
    assert rows and {r.agreed for r in rows} <= {0, 1, 2, 3} and all((r.side is not None) == (r.agreed == 3) for r in rows)
    for r in rows:
        if r.side is None:
            assert r.p_a == pytest.approx((r.p_boosting + r.p_logistic + r.p_residual_network) / 3, abs=2e-4)
