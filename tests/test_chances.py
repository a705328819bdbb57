"""Chances of tie-breaks and matches against plain recursion, and ratings against a plain loop."""

from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.functions import chances as C
from tidemark.operators.ratings import rate


@lru_cache(None)
def point_by_point(kind, a, b, p_a, p_b, turn):
    """Plays a game (kind 4) or a tie-break (kind 7) point by point; turn counts the points served so far."""
    if max(a, b) >= kind and abs(a - b) >= 2 or max(a, b) > 30:
        return float(a > b)
    p = p_a if kind == 4 or (turn + 1) // 2 % 2 == 0 else 1 - p_b
    return p * point_by_point(kind, a + 1, b, p_a, p_b, turn + 1) + (1 - p) * point_by_point(kind, a, b + 1, p_a, p_b, turn + 1)


def test_games_and_tiebreaks(spark):
    rows = [(a, b, p) for a in range(4) for b in range(4) for p in (0.4, 0.62, 0.8)]
    df = spark.createDataFrame(rows, "a int, b int, p double")
    for r in df.select("*", C.game_win(F.col("a"), F.col("b"), F.col("p")).alias("w")).collect():
        assert r.w == pytest.approx(point_by_point(4, r.a, r.b, r.p, 0, 0), abs=1e-4)
    df = df.select("*", C.tiebreak_win("a", "b", "p", F.lit(0.7), F.lit(True)).alias("w"))
    for r in df.collect():  # side a serves the next point, so its first serve is the point at 0-0 or not
        start = r.a + r.b
        first_a = (start + 1) // 2 % 2 == 0
        want = point_by_point(7, r.a, r.b, r.p, 0.7, start) if first_a else 1 - point_by_point(7, r.b, r.a, 0.7, r.p, start)
        assert r.w == pytest.approx(want, abs=1e-9)


def test_match(spark):
    cols = "sets_a int, sets_b int, games_a int, games_b int, points_a int, points_b int, p_a double, p_b double, server string, need int"
    even = (0, 0, 0, 0, 0, 0, 0.6, 0.6, "", 2)
    rows = [even, (0, 0, 0, 0, 0, 0, 0.7, 0.6, "", 2), (0, 0, 0, 0, 0, 0, 0.6, 0.7, "", 2), (2, 0, 0, 0, 0, 0, 0.6, 0.6, "a", 2), (0, 3, 0, 0, 0, 0, 0.6, 0.6, "a", 3), (1, 0, 5, 0, 3, 0, 0.6, 0.6, "a", 2), (1, 1, 6, 6, 6, 0, 0.6, 0.6, "a", 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + cols)
    w = {r.i: r.w for r in df.select("i", C.match_win(F.struct(*df.columns[1:])).alias("w")).collect()}
    assert w[0] == pytest.approx(0.5) and w[1] == pytest.approx(1 - w[2]) and w[1] > 0.75
    assert (w[3], w[4], w[5]) == (0.98, 0.02, 0.98) and w[6] == 0.98
    back = spark.createDataFrame([(0.5, 2), (0.8, 2), (0.2, 3), (1.0, 2)], "p double, need int").select(C.serve_shares("p", "need").alias("s")).collect()
    assert back[0].s[0] == pytest.approx(0.62, abs=2e-3) and back[1].s[0] > 0.62 > back[2].s[0]
    assert all(sum(r.s) == pytest.approx(1.24) for r in back)


def test_ratings(spark):
    matches = [(1, "x", "y"), (1, "x", "y"), (2, "y", "z"), (2, None, "z"), (2, "z", "z"), (3, "z", "x"), (9, "x", "z")]
    got = {r.player: (r.rating, r.played) for r in rate(spark.createDataFrame(matches, "period int, winner string, loser string"), [1, 2, 3]).collect()}
    r, n = dict.fromkeys("xyz", 1500.0), dict.fromkeys("xyz", 0)
    for period in (1, 2, 3):
        moved, played = dict.fromkeys("xyz", 0.0), dict.fromkeys("xyz", 0)
        for p, w, lo in matches:
            if p == period and w and w != lo:
                e = 1 / (1 + 10 ** ((r[lo] - r[w]) / 400))
                moved[w] += 1 - e
                moved[lo] -= 1 - e
                played[w] += 1
                played[lo] += 1
        r = {k: r[k] + max(8, 480 / (15 + n[k])) * moved[k] for k in r}
        n = {k: n[k] + played[k] for k in n}
    assert {k: n[k] for k in n} == {k: v[1] for k, v in got.items()}
    assert all(got[k][0] == pytest.approx(r[k]) for k in r)


def test_large_batches_are_reckoned_in_parts():
    import tracemalloc

    import numpy as np
    import pandas as pd

    n = 4_000
    k = np.arange(n)
    score = pd.DataFrame({"sets_a": k % 2, "sets_b": 0, "games_a": k % 6, "games_b": k % 5, "points_a": k % 4, "points_b": 0, "p_a": 0.55 + k % 20 / 100, "p_b": 0.6, "server": "a", "need": 2 + k % 2})
    tracemalloc.start()
    got = C.match_win.func(score)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and np.array_equal(got, np.concatenate([C.match_win.func(score[i : i + 100]) for i in range(0, n, 100)]))
