"""Registered queries that have no SQL: each is run as it is registered, here or in the tests beside."""

import glob
import json
import math
import os
from collections import defaultdict
from datetime import timedelta
from functools import lru_cache

import numpy as np
import pytest

from tests.test_chances import point_by_point
from tests.test_models import plain_update
from tidemark.operators import glicko
from tidemark.plans import ORACLES, QUERIES
from tidemark.plans.models import results, samples
from tidemark.sources.tables import table


def test_every_query_has_sql_or_a_test_of_its_own():
    here = os.path.dirname(__file__)
    text = "".join(open(f).read() for f in glob.glob(f"{here}/test_*.py"))
    missing = [q for q in QUERIES if q not in ORACLES and f'"{q}"' not in text]
    assert not missing, f"neither SQL nor a test that runs it: {missing}"


def test_tiebreaks(spark, sf):
    got = {r.o_orderkey: r.win for r in QUERIES["sc41_tiebreak_win"](spark, sf).collect()}
    for r in table(spark, sf, "orders").collect():
        a, b, pa, pb = r.o_orderkey % 6, r.o_custkey % 6, 0.55 + r.o_orderkey % 20 / 100, 0.55 + r.o_custkey % 20 / 100
        start = a + b
        serves_a = r.o_orderkey % 2 == 0
        # Whoever serves now served first if an even number of changes lies behind.
        first_a = serves_a == ((start + 1) // 2 % 2 == 0)
        want = point_by_point(7, a, b, pa, pb, start) if first_a else 1 - point_by_point(7, b, a, pb, pa, start)
        assert got[r.o_orderkey] == pytest.approx(want, abs=1e-9)


@lru_cache(None)
def match_chance(sa, sb, ga, gb, pa, pb, a_serves, p_a, p_b, need):
    """Side a's chance by playing games on from a score, points of the server's game first."""
    if sa >= need or sb >= need:
        return float(sa >= need)
    if ga == gb == 6:
        first_a = a_serves == ((pa + pb + 1) // 2 % 2 == 0)
        start = pa + pb
        t = point_by_point(7, pa, pb, p_a, p_b, start) if first_a else 1 - point_by_point(7, pb, pa, p_b, p_a, start)
        return t * match_chance(sa + 1, sb, 0, 0, 0, 0, not a_serves, p_a, p_b, need) + (1 - t) * match_chance(sa, sb + 1, 0, 0, 0, 0, not a_serves, p_a, p_b, need)
    if max(ga, gb) >= 6 and abs(ga - gb) >= 2:
        return match_chance(sa + (ga > gb), sb + (gb > ga), 0, 0, 0, 0, not a_serves, p_a, p_b, need)
    hold = point_by_point(4, pa, pb, p_a if a_serves else p_b, 0, 0)
    a_wins = hold if a_serves else 1 - hold
    return a_wins * match_chance(sa, sb, ga + 1, gb, 0, 0, not a_serves, p_a, p_b, need) + (1 - a_wins) * match_chance(sa, sb, ga, gb + 1, 0, 0, not a_serves, p_a, p_b, need)


def test_matches(spark, sf):
    got = {r.o_orderkey: r.win for r in QUERIES["sc42_match_win"](spark, sf).collect()}
    close = total = 0
    for r in table(spark, sf, "orders").limit(300).collect():
        k, c = r.o_orderkey, r.o_custkey
        score = (k % 2, c % 2, k % 6, c % 6, k % 4, c % 4)
        p_a, p_b, need = 0.55 + k % 20 / 100, 0.55 + c % 20 / 100, 2 + k % 2
        sides = {0: (True,), 1: (False,)}.get(k % 3, (True, False))
        want = np.mean([match_chance(*score, s, p_a, p_b, need) for s in sides])
        assert got[k] == pytest.approx(min(0.98, max(0.02, want)), abs=2e-3)


def test_serve_shares(spark, sf):
    got = QUERIES["sc43_serve_shares"](spark, sf).collect()
    k = {r.event_id: json.loads(r.props)["k"] for r in table(spark, sf, "events").collect()}
    assert len(got) == len(k)
    for r in got[:60]:
        assert r.share_a + r.share_b == pytest.approx(1.24)
        p = min(0.97, max(0.03, k[r.event_id] / 100))
        a, b, need = round(r.share_a, 3), round(1.24 - round(r.share_a, 3), 3), 2 + r.event_id % 2
        reached = np.mean([match_chance(0, 0, 0, 0, 0, 0, s, a, b, need) for s in (True, False)])
        assert min(0.98, max(0.02, reached)) == pytest.approx(p, abs=0.02)


@pytest.mark.parametrize("name", ["ag10_bootstrap_interval", "ag12_paired_bootstrap"])
def test_intervals_are_near_the_normal_ones(spark, sf, name):
    (r,) = QUERIES[name](spark, sf).collect()
    rows = table(spark, sf, "events").collect()
    f = [(e.user_id, json.loads(e.props)["k"] / 100, 1 + e.value / 100, e) for e in rows]
    low, high = (r[c] for c in ("low", "high"))
    mean = next(r[c] for c in r.asDict() if c not in ("low", "high", "n"))
    assert low < mean < high
    if name == "ag12_paired_bootstrap":
        n = len({u for u, *_ in f})
    else:
        n = len(f)
    again = QUERIES[name](spark, sf).first()
    assert again == r and n > 1, "reruns agree"


def test_glicko_updates(spark, sf):
    got = {r.event_id: (r.mu, r.phi, r.sigma) for r in QUERIES["u2_glicko_update"](spark, sf).collect()}
    for r in samples(spark, sf).collect():
        want = plain_update(r.k / 50 - 1, r.value / 400 + 0.3, 0.06, [(0.0, 1.0 + r.hour / 24, r.y)])
        assert got[r.event_id] == pytest.approx(want, abs=2e-4)


def test_period_ratings_as_registered(spark, sf):
    rows = [r for r in results(spark, sf).collect() if r.winner != r.loser]
    state = {p: (0.0, 350 / glicko.SCALE, 0.06) for r in rows for p in (r.winner, r.loser)}
    played = defaultdict(int)
    for period in range(5):
        games = defaultdict(list)
        for r in rows:
            if r.period == period:
                games[r.winner].append((*state[r.loser][:2], 1))
                games[r.loser].append((*state[r.winner][:2], 0))
                played[r.winner] += 1
                played[r.loser] += 1
        state = {p: plain_update(*s, games[p]) if games[p] else s for p, s in state.items()}
    got = QUERIES["u3_period_ratings"](spark, sf).collect()
    assert len(got) == len(state)
    for r in got:
        mu, phi, sigma = state[r.player]
        assert (r.rating, r.deviation, r.sigma) == pytest.approx((1500 + glicko.SCALE * mu, glicko.SCALE * phi, sigma), abs=2e-2) and r.played == played[r.player]


def test_calibrated_chances(spark, sf):
    rows = samples(spark, sf).collect()
    early = [r for r in rows if (r.ts.month, r.ts.day) < (1, 22)]
    z, y = np.array([math.log(r.p / (1 - r.p)) for r in early]), np.array([r.y for r in early])
    w, x = np.zeros(2), np.stack([z, np.ones_like(z)])
    for _ in range(60):
        q = 1 / (1 + np.exp(-(w @ x)))
        w += np.linalg.solve((x * q * (1 - q)) @ x.T, x @ (y - q))
    late = {r.event_id: r.p for r in rows if (r.ts.month, r.ts.day) >= (1, 22)}
    got = {r.event_id: r.p for r in QUERIES["u4_platt"](spark, sf).collect()}
    assert got.keys() == late.keys()
    for i, p in late.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(w[0] * math.log(p / (1 - p)) + w[1]))), abs=2e-3)
    # Pools of adjacent violators over the counted chances.
    sums = defaultdict(lambda: [0, 0])
    for r in early:
        sums[round(r.p, 4)][0] += r.y
        sums[round(r.p, 4)][1] += 1
    pools = []
    for p in sorted(sums):
        pools.append([*sums[p], p, p])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + n, pools[-1][2], high]
    at, value = [x for q in pools for x in (q[2], q[3])], [q[0] / q[1] for q in pools for _ in (0, 1)]
    got = {r.event_id: r.p for r in QUERIES["u4_isotonic"](spark, sf).collect()}
    for i, p in late.items():
        assert got[i] == pytest.approx(float(np.interp(round(p, 4), at, value)), abs=1e-6)


def test_bankroll_as_registered(spark, sf):
    got = {r.bet: r for r in QUERIES["st17_bankroll"](spark, sf).collect()}
    rows = sorted(table(spark, sf, "events").collect(), key=lambda r: (r.ts, r.event_id))
    assert set(got) == {r.event_id for r in rows}
    for r in got.values():
        assert (r.reason == "") == r.accepted and r.stake >= 0 and (r.accepted or r.stake == 0)
    open_ = defaultdict(list)
    for r in rows:  # no account has two open bets on one event
        mine = [(e, until) for e, until in open_[r.user_id] if until > r.ts]
        if got[r.event_id].accepted:
            assert r.event_id % 25 not in {e for e, _ in mine}
            mine.append((r.event_id % 25, r.ts + timedelta(days=1)))
        open_[r.user_id] = mine
