"""Ratings against a plain recursion, calibrators and models against plain fits, and forecasts of the past only."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import glicko, profiles
from tidemark.operators import models as M
from tidemark.plans import QUERIES
from tidemark.plans.models import own_results, samples


def plain_update(mu, phi, sigma, games):
    """The published method for one player: games of (mu, phi, score), the volatility by bisection."""
    g = lambda p: 1 / math.sqrt(1 + 3 * p * p / math.pi**2)
    e = [1 / (1 + math.exp(-g(p) * (mu - m))) for m, p, _ in games]
    v = 1 / sum(g(p) ** 2 * x * (1 - x) for (_, p, _), x in zip(games, e))
    s = sum(g(p) * (score - x) for (_, p, score), x in zip(games, e))
    delta, a, tau = v * s, math.log(sigma**2), 0.5
    f = lambda x: math.exp(x) * (delta**2 - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - a) / tau**2
    low, high = -60.0, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    sigma = math.exp(low / 2)
    phi = 1 / math.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
    return mu + phi**2 * s, phi, sigma


def test_published_example():
    """The worked example of the method's description."""
    q = glicko.SCALE
    games = [((r - 1500) / q, d / q, s) for r, d, s in ((1400, 30, 1), (1550, 100, 0), (1700, 300, 0))]
    mu, phi, sigma = plain_update(0.0, 200 / q, 0.06, games)
    assert (1500 + mu * q, phi * q) == pytest.approx((1464.06, 151.52), abs=0.01) and sigma == pytest.approx(0.05999, abs=1e-5)
    g = [1 / math.sqrt(1 + 3 * p * p / math.pi**2) for _, p, _ in games]
    e = [1 / (1 + math.exp(x * m)) for x, (m, _, _) in zip(g, games)]
    got = glicko.updated(*(np.array([x]) for x in (0.0, 200 / q, 0.06, sum(x * x * y * (1 - y) for x, y in zip(g, e)), sum(x * (s[2] - y) for x, y, s in zip(g, e, games)))))
    assert [float(x[0]) for x in got] == pytest.approx([mu, phi, sigma], abs=1e-6)


def test_period_ratings(spark):
    matches = [(1, "x", "y"), (1, "x", "y"), (1, "z", "x"), (2, "y", "z"), (2, None, "z"), (2, "z", "z"), (3, "z", "x"), (9, "x", "z")]
    got = {r.player: r for r in glicko.rate(spark.createDataFrame(matches, "period int, winner string, loser string"), [1, 2, 3]).collect()}
    state = {p: (0.0, 350 / glicko.SCALE, 0.06) for p in "xyz"}
    for period in (1, 2, 3):
        games = {p: [] for p in "xyz"}
        for k, w, lo in matches:
            if k == period and w and w != lo:
                games[w].append((*state[lo][:2], 1))
                games[lo].append((*state[w][:2], 0))
        state = {p: plain_update(*state[p], games[p]) if games[p] else state[p] for p in state}
    for p in "xyz":
        assert (got[p].mu, got[p].phi, got[p].sigma) == pytest.approx(state[p], abs=1e-5)
    assert {p: got[p].played for p in "xyz"} == {"x": 4, "y": 3, "z": 3}


def test_player_folds_equal_a_loop(spark, sf):
    rows = sorted(samples(spark, sf).select("user_id", "ts", "event_id", "y").collect(), key=lambda r: (r.user_id, r.ts, r.event_id))
    want, times = {}, {}
    one = 350 / glicko.SCALE
    for r in rows:
        elo, mu, phi, sigma, n, wins = want.get(r.user_id, (1500.0, 0.0, one, 0.06, 0, 0))
        elo += 32 * (r.y - 1 / (1 + 10 ** ((1500 - elo) / 400)))
        want[r.user_id] = (elo, *plain_update(mu, phi, sigma, [(0.0, one, r.y)]), n + 1, wins + r.y)
        times.setdefault(r.user_id, []).append((r.ts, r.y))
    got = QUERIES["ag28_player_folds"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.elo, r.mu, r.phi, r.sigma, r.played, r.wins) == pytest.approx(want[r.player], abs=2e-4)
        last = times[r.player][-1][0]
        assert r.load == sum((last - t).total_seconds() < 7 * 86400 for t, _ in times[r.player])
        assert r.form == pytest.approx(np.mean([y for _, y in times[r.player][-10:]]))


def test_calibrators(spark, sf):
    s = samples(spark, sf)
    rows = [(r.p, r.y) for r in s.collect()]
    p, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    z = np.log(p / (1 - p))
    w = np.zeros(2)
    for _ in range(50):  # Newton's method
        q = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        x = np.stack([z, np.ones_like(z)])
        w += np.linalg.solve((x * q * (1 - q)) @ x.T, x @ (y - q))
    assert M.platt(s) == pytest.approx(tuple(w), abs=1e-3)
    assert M.platt(s.where("y = 1")) is None and M.platt(s.limit(20)) is None
    out = sorted((r.p, r.q) for r in M.isotonic(s)(s.withColumn("q", F.col("p"))).select(F.col("q").alias("p"), F.col("p").alias("q")).collect())
    q = np.array([b for _, b in out])
    assert (np.diff(q) >= -1e-9).all() and q.mean() == pytest.approx(y.mean(), abs=5e-3)


def test_forecasts_see_the_past_only_and_learn(spark, sf):
    times = {r.event_id: r.ts for r in samples(spark, sf).select("event_id", "ts").collect()}
    got = QUERIES["u22_walk_forward_forecasts"](spark, sf).collect()
    assert len({r.event_id for r in got}) == len(got) and all(0 <= r.p <= 1 for r in got)
    for k in range(3):
        assert max(times[r.event_id] for r in got if r.fold == k) <= min(times[r.event_id] for r in got if r.fold == k + 1)
    y, p = np.array([r.y for r in got]), np.clip([r.p for r in got], 1e-9, 1 - 1e-9)
    base = y.mean()
    assert -np.mean(np.log(np.where(y == 1, p, 1 - p))) < 0.8 * -(base * np.log(base) + (1 - base) * np.log(1 - base))
    loss = {r.model: r.log_loss for r in QUERIES["u5_estimators"](spark, sf).collect()}
    assert set(loss) == {"lr", "gb", "rf", "mlp"} and max(loss.values()) < 0.69
    assert QUERIES["u6_release"](spark, sf).first().released
    test = {r.fold: r for r in QUERIES["u7_walk_forward_test"](spark, sf).collect()}
    assert set(test) == {0, 1, 2, 3} and all(r.bets <= r.n and r.turnover >= 0 for r in test.values())


def test_rating_folds_equal_a_loop(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # players go on from batch to batch
    got = {(r.player, r.surface): r for r in QUERIES["ag28_rating_folds"](spark, sf).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {}
    for r in sorted(own_results(spark, sf).collect(), key=lambda r: (r["at"], r.result)):
        for surface in ("", r.surface):
            s = want.setdefault((r.player, surface), [1500.0, 1500.0, 350.0, 0.06, 0])
            s[0] = round(s[0] + 32 * (r.won - 1 / (1 + 10 ** ((1500 - s[0]) / 400))), 3)
            mu, phi, sigma = plain_update((s[1] - 1500) / glicko.SCALE, s[2] / glicko.SCALE, s[3], [(0.0, 350 / glicko.SCALE, r.won)])
            s[1:] = [round(1500 + glicko.SCALE * mu, 3), round(glicko.SCALE * phi, 3), round(sigma, 6), s[4] + 1]
    assert got.keys() == want.keys()
    for k, s in want.items():
        assert (got[k].elo, got[k].matches) == (pytest.approx(s[0], abs=0.01), s[4])
        if k[1] == "":
            assert (got[k].rating, got[k].rd, got[k].volatility) == (pytest.approx(s[1], abs=0.05), pytest.approx(s[2], abs=0.05), pytest.approx(s[3], abs=1e-4))
            assert got[k].deviation == pytest.approx(max(60, 350 / math.sqrt(1 + s[4] / 4)), abs=1e-3)
        else:
            assert got[k].rating is None


def test_profiles_of_odd_rows(spark):
    rows = [(1, "2020-01-01", 1, 1, "Clay", None, 10.0, 5.0, 2), (1, "2024-01-01", 2, 0, None, "itf", 0.0, 0.0, None), (None, "2024-01-01", 3, 1, None, None, None, None, 1), (2, None, 4, 1, None, None, None, None, 1), (3, "2024-01-01", 5, None, "x", None, None, None, 1)]
    df = spark.createDataFrame(rows, "player int, at string, result int, won int, surface string, level string, serve_points double, serve_won double, sets int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {(r.player, r.kind, r.name): (r.matches, r.wins, r.win_rate, r.points, r.sets) for r in profiles.profile_rows(df).collect()}
    assert {k[0] for k in got} == {1} and got[1, "days", "365"] == (2, 1, 0.5, None, None) and got[1, "days", "90"] == (1, 0, 0.0, None, None)
    assert got[1, "surface", "clay"][0] == got[1, "surface", "unknown"][0] == 1 and got[1, "serve", ""] == (1, 0, None, 10.0, None) and got[1, "load", "30"] == (1, 0, 0.0, None, 0)
    assert profiles.profile_rows(df.limit(0)).count() == profiles.rating_folds(df.limit(0)).count() == 0


def test_player_folds_go_on_from_batch_to_batch(spark, sf):
    want = {tuple(r) for r in QUERIES["ag28_player_folds"](spark, sf).collect()}
    got = QUERIES["ag28_player_folds"](spark, sf)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString(), "players of a batch are folded side by side, not row by row"
    for size in ("1", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        rows = QUERIES["ag28_player_folds"](spark, sf).collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert len(rows) == len(want)
        for a, b in zip(sorted(map(tuple, rows)), sorted(want), strict=True):
            assert a == pytest.approx(b, abs=1e-9)


def test_estimators_read_rows_dealt_evenly(spark, sf, monkeypatch):
    """A table of one file is dealt over several parts before the estimators pass over it, and no row is lost."""
    from tidemark.plans import models as plans

    seen, of = [], plans.M.fitted
    monkeypatch.setattr(plans.M, "fitted", lambda rows, *how: (seen.append((len(rows.inputFiles()), rows.count())), of(rows, *how))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES["u5_estimators"](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = samples(spark, sf)
    early = rows.where("ts < timestamp_ntz '2024-01-22'").count()
    assert len(seen) == 4 and all(files > 1 and n == early for files, n in seen)
    assert {r.n for r in got} == {rows.count() - early}
