"""Ratings before each match against a plain loop over the matches in order."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import waves
from tidemark.plans import QUERIES
from tidemark.plans.models import match_rows

SCALE = 173.7178


def glicko(mu, phi, sigma, omu, ophi, score):
    g = 1 / math.sqrt(1 + 3 * ophi * ophi / math.pi**2)
    e = 1 / (1 + math.exp(-g * (mu - omu)))
    v = 1 / max(1e-12, g * g * e * (1 - e))
    delta, a, tau = v * g * (score - e), math.log(sigma**2), 0.5
    f = lambda x: math.exp(x) * (delta**2 - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - a) / tau**2
    low, high = -40.0, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    sigma = math.exp(low / 2)
    phi = 1 / math.sqrt(1 / (phi**2 + sigma**2) + 1 / v)
    return mu + phi**2 * g * (score - e), phi, sigma


def loop(rows, history):
    """Before: (match, player) -> numbers; and the states at the end."""
    priors = dict(waves.HISTORY.priors)
    people, surfaces, before = {}, {}, {}
    for m in sorted(rows, key=lambda r: (r.played_at, r.match_id)):
        sides = (m.winner, m.loser)
        for p in sides:
            if p not in people:
                elo = priors.get(m.level, 1500.0) if history else 1500.0
                people[p] = {"elo": elo, "mu": (elo - 1500) / SCALE if history else 0.0, "phi": 350 / SCALE, "sigma": 0.06, "played": 0, "wins": 0, "last": None, "sp": 0.0, "sw": 0.0, "sr": 0.0, "rp": 0.0, "rr": 0.0}
        s = [people[p] for p in sides]
        old = [dict(x) for x in s]
        first = [surfaces.get((p, m.surface), x["elo"] if history else 1500.0) for p, x in zip(sides, old)]
        rate = lambda x: (min(0.9, max(0.35, 0.62 + x["sr"] / (200 + x["sp"]))), min(0.65, max(0.1, 0.38 + x["rr"] / (200 + x["rp"]))))
        for p, x, z in zip(sides, old, first):
            before[m.match_id, p] = (x["elo"], z, x["mu"], x["phi"], x["sigma"], x["played"], x["wins"], *rate(x), x["sp"], x["sw"])
        over = 1 / (1 + 10 ** ((old[1]["elo"] - old[0]["elo"]) / 400))
        on = over if history else 1 / (1 + 10 ** ((first[1] - first[0]) / 400))
        phi = []
        for x in old:
            idle = 0 if history or x["last"] is None else int((m.played_at - x["last"]).total_seconds() / 86400 / 30)
            phi.append(min(350 / SCALE, math.sqrt(x["phi"] ** 2 + idle * x["sigma"] ** 2)))
        serves = [(m.winner_points, m.winner_won), (m.loser_points, m.loser_won)]
        ok = [p is not None and w is not None and p > 0 for p, w in serves]
        if not history:
            ok = [all(ok) and all(0 <= w <= p for p, w in serves)] * 2
        for k in (0, 1):
            sign = 1 if k == 0 else -1
            step = max(8, 480 / (15 + old[k]["played"])) if history else 32
            s[k]["elo"] = old[k]["elo"] + sign * step * (1 - over)
            surfaces[sides[k], m.surface] = first[k] + sign * step * (1 - on)
            s[k]["mu"], s[k]["phi"], s[k]["sigma"] = glicko(old[k]["mu"], phi[k], old[k]["sigma"], old[1 - k]["mu"], phi[1 - k], 1 - k)
            s[k]["played"] += 1
            s[k]["wins"] += 1 - k
            s[k]["last"] = m.played_at
            if ok[k]:
                points, won = serves[k]
                s[k]["sp"] += points
                s[k]["sw"] += won
                s[k]["sr"] += won - points * (1 - rate(old[1 - k])[1])
                s[1 - k]["rp"] += points
                s[1 - k]["rr"] += points - won - points * (1 - rate(old[k])[0])
    return before, people, surfaces


def test_ratings_before_equal_a_loop(spark, sf):
    got = QUERIES["u1_ratings_before"](spark, sf).collect()
    rows = waves.current_matches(match_rows(spark, sf)).collect()
    want, _, _ = loop(rows, False)
    assert len(got) == len(want) == 2 * len(rows)
    for r in got:
        elo, on, mu, phi, sigma, played, wins, serve, back, _, _ = want[r.match_id, r.player]
        assert (r.elo, r.surface_elo, r.glicko, r.deviation, r.volatility, r.serve_rate, r.return_rate) == pytest.approx((elo, on, 1500 + SCALE * mu, SCALE * phi, sigma, serve, back), abs=1e-3)
        assert (r.played, r.wins) == (played, wins)


def test_forecasts_equal_a_loop(spark, sf):
    got = QUERIES["u3_rating_forecasts"](spark, sf).collect()
    rows = {r.match_id: r for r in waves.current_matches(match_rows(spark, sf)).collect()}
    want, _, _ = loop(rows.values(), True)
    assert len(got) == len(rows)
    for r in got:
        a, b = want[r.match_id, rows[r.match_id].winner], want[r.match_id, rows[r.match_id].loser]
        gap = 0.5 * (a[0] - b[0]) + 0.3 * (a[1] - b[1]) + 0.2 * SCALE * (a[2] - b[2])
        share = [x[10] / x[9] if x[9] >= 20 else 0.62 for x in (a, b)]
        assert (r.elo_diff, r.surface_elo_diff, r.glicko_diff, r.serve_rate_diff, r.p) == pytest.approx((a[0] - b[0], a[1] - b[1], SCALE * (a[2] - b[2]), share[0] - share[1], 1 / (1 + 10 ** (-gap / 400))), abs=1e-3)


def test_profiles_as_of_a_cutoff(spark, sf):
    got = {(r.player, r.surface): r for r in QUERIES["u1_profiles_as_of"](spark, sf).collect()}
    known = waves.current_matches(match_rows(spark, sf), "2024-01-20 00:00:00").collect()
    every = {r.match_id: r for r in waves.current_matches(match_rows(spark, sf)).collect()}
    assert any(r != every.get(r.match_id) for r in known), "a later correction is not known yet"
    _, people, surfaces = loop(known, False)
    assert len(got) == len(people) + len(surfaces)
    for p, x in people.items():
        r = got[p, ""]
        assert (r.elo, r.glicko, r.deviation) == pytest.approx((x["elo"], 1500 + SCALE * x["mu"], SCALE * x["phi"]), abs=1e-3) and (r.played, r.last) == (x["played"], x["last"])
    for key, elo in surfaces.items():
        assert got[key].elo == pytest.approx(elo, abs=1e-6)


def test_slices_and_components_change_nothing(spark, sf):
    rows = waves.current_matches(match_rows(spark, sf)).where("match_id < 300")
    numbers = ["elo", "surface_elo", "mu", "phi", "sigma", "played", "serve_residual"]
    states = []
    for slice_rows, alone in ((10_000, 10_000), (70, 1000), (130, 0)):
        before, after = waves.fold_matches(rows, slice_rows=slice_rows, alone=alone)
        states.append(({(r.match_id, r.player): [r[c] for c in numbers] for r in before.collect()}, {(r.player, r.surface): r.elo for r in after.collect()}))
    for before, after in states[1:]:
        assert before.keys() == states[0][0].keys() and after == pytest.approx(states[0][1], abs=1e-9)
        for k, v in before.items():
            assert v == pytest.approx(states[0][0][k], abs=1e-9)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), *((k, k + 1) for k in range(20, 60)), (60, 20), (99, 98)]
    got = {r.player: r.component for r in waves.components(spark.createDataFrame(edges, "winner long, loser long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 98: 98, 99: 98} | {k: 20 for k in range(20, 61)}


def test_components_of_a_slice_equal_those_of_rounds_in_one_job(spark):
    edges = spark.createDataFrame([(k * 37 % 400, k * 91 % 211 + 1000 * (k % 3)) for k in range(150)], "winner long, loser long")
    told = lambda rows: {r.player: r.component for r in rows.collect()}
    want = told(waves.components(edges))
    assert len(set(want.values())) > 3
    spark.sparkContext.setJobGroup("components", "of a slice")
    got = told(waves.slice_components(edges))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setJobGroup("", "")
    assert got == want and len(jobs) <= 6, "no rounds"


def test_corrections_and_odd_rows(spark):
    row = lambda i, known, w, lo, ok=True, surface="Clay": (i, f"2024-01-{known:02d} 00:00:00", "2024-01-01 00:00:00", w, lo, surface, None, ok, 50.0, 30.0, None, None)
    rows = [row(1, 1, "a", "b"), row(1, 5, "b", "a"), row(2, 1, "a", "a"), row(3, 1, None, "a"), row(4, 1, "c", "d"), row(4, 2, "c", "d", False), row(None, 1, "x", "y"), row(5, 1, "e", "f", True, None), row(5, 1, "e", "f", True, None)]
    df = spark.createDataFrame(rows, "match_id int, available_at string, played_at string, winner string, loser string, surface string, level string, valid boolean, winner_points double, winner_won double, loser_points double, loser_won double")
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("available_at", "played_at")})
    now = {r.match_id: (r.winner, r.surface, r.level) for r in waves.current_matches(df).collect()}
    assert now == {1: ("b", "clay", "unknown"), 5: ("e", "unknown", "unknown")}
    assert {r.match_id: r.winner for r in waves.current_matches(df, "2024-01-01 12:00:00").collect()} == {1: "a", 4: "c", 5: "e"}
    before, after = waves.fold_matches(waves.current_matches(df.where("false")))
    assert before.count() == after.count() == 0


@pytest.mark.parametrize("name", ["u3_period_ratings", "ag29_ratings"])
def test_periods_do_not_grow_the_plan(spark, name):
    from tidemark.operators import glicko as G
    from tidemark.operators import ratings as R

    matches = spark.createDataFrame([(k % 60, k % 7, (k + 1 + k % 3) % 7) for k in range(300)], "period int, winner int, loser int")
    out = (G if name.startswith("u3") else R).rate(matches, list(range(12)))
    assert out._jdf.queryExecution().toString().count("Scan parquet") <= 2 or len(out._jdf.queryExecution().toString()) < 5000
    assert out.count() == 7 and defaultdict(int, {r.player: r.played for r in out.collect()})[0] > 0
