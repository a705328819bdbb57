"""Scenarios, local search and sequence models against plain loops."""

import json
import math
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scenarios, search, sequences
from tidemark.plans import QUERIES
from tidemark.plans.forecasts import FIRST, GRID, counted_chances, scores, tapes
from tidemark.plans.models import FEATURES


@cache
def game(a, b, p):
    if max(a, b) >= 4 and abs(a - b) >= 2:
        return float(a > b)
    if a >= 3 and b >= 3:
        d = p * p / (p * p + (1 - p) ** 2)
        return d if a == b else p + (1 - p) * d if a > b else p * d
    return p * game(a + 1, b, p) + (1 - p) * game(a, b + 1, p)


@cache
def tie(a, b, pa, pb, first):
    if max(a, b) >= 7 and abs(a - b) >= 2 or max(a, b) > 30:
        return float(a > b)
    serves_a = (first == "a") ^ bool((a + b + 1) // 2 % 2)
    p = pa if serves_a else 1 - pb
    return p * tie(a + 1, b, pa, pb, first) + (1 - p) * tie(a, b + 1, pa, pb, first)


def third(p):
    """Rounded to three places as the engine does: by the decimal digits, halves up."""
    return float(Decimal(repr(p)).quantize(Decimal("0.001"), ROUND_HALF_UP))


flip = {"a": "b", "b": "a", None: None}


def after(s, side):
    sa, sb, ga, gb, _, _, server, _, ts, need = s
    ga, gb = ga + (side == "a"), gb + (side == "b")
    if max(ga, gb) >= 6 and abs(ga - gb) >= 2 or {ga, gb} == {6, 7}:
        return (sa + (ga > gb), sb + (gb > ga), 0, 0, 0, 0, flip[ts or server], False, None, need)
    six = ga == gb == 6
    return (sa, sb, ga, gb, 0, 0, flip[server], six, flip[server] if six else None, need)


def test_game_scenarios_equal_a_loop(spark, sf):
    got = defaultdict(dict)
    for r in QUERIES["sc44_game_scenarios"](spark, sf).collect():
        got[r.event_id][r[1:10]] = (r.chance, r.paths)
    seen = Counter()
    for r in scores(spark, sf).collect():
        s = (*(int(r[c]) for c in ("sets_a", "sets_b", "games_a", "games_b", "points_a", "points_b")), r.server, r.tiebreak, r.tie_server, r.need)
        starts = [(s, 1.0)]
        if r.server is None:
            if r.tiebreak and r.tie_server:
                n = r.points_a + r.points_b
                serving = r.tie_server if (0 if n == 0 else 1 + (n - 1) // 2) % 2 == 0 else flip[r.tie_server]
                starts = [((*s[:6], serving, *s[7:]), 1.0)]
            else:
                starts = [((*s[:6], x, s[7], r.tie_server or x, s[9]), 0.5) for x in "ab"]
        ways = [(x, m, "") for x, m in starts]
        for _ in range(2):
            new = []
            for x, m, path in ways:
                if max(x[0], x[1]) >= x[9]:
                    new.append((x, m, path))
                    continue
                if x[7]:
                    first = x[6] if (x[4] + x[5] + 1) // 2 % 2 == 0 else flip[x[6]]
                    p = tie(x[4], x[5], third(r.p_a), third(r.p_b), first)
                else:
                    hold = game(x[4], x[5], third(r.p_a if x[6] == "a" else r.p_b))
                    p = hold if x[6] == "a" else 1 - hold
                new += [(after(x, "a"), m * p, path + "A"), (after(x, "b"), m * (1 - p), path + "B")]
            ways = new
        want = {}
        for x, m, path in ways:
            old = want.get(x[:9], (0.0, []))
            want[x[:9]] = (old[0] + m, [*old[1], path])
        assert got[r.event_id].keys() == want.keys()
        assert sum(c for c, _ in got[r.event_id].values()) == pytest.approx(1)
        for k, (m, paths) in want.items():
            assert got[r.event_id][k] == (pytest.approx(m, abs=1e-9), "|".join(sorted(paths)))
        seen[len(want)] += 1
    assert len(seen) > 3


def test_point_scenarios_sum_to_one(spark, sf):
    rows = QUERIES["sc44_point_scenarios"](spark, sf).groupBy("event_id").agg(F.sum("chance").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(1) and 1 <= r.n <= 16 for r in rows)


def test_local_search_takes_the_path_of_a_loop(spark, sf):
    counts = [tuple(r) for r in counted_chances(spark, sf).select("p", "y", "n").collect()]

    def judge(s):
        loss = brier = total = 0
        for p, y, n in counts:
            q = min(1 - 1e-4, max(1e-4, p))
            z = math.log(q / (1 - q))
            step = max(-s["reach"], min(s["reach"], z * s["slope"] + s["shift"] - z))
            q = min(1 - 1e-6, max(1e-6, 1 / (1 + math.exp(-(z + step)))))
            loss, brier, total = loss - n * math.log(q if y else 1 - q), brier + n * (q - y) ** 2, total + n
        return loss / total, brier / total

    champion, visited, want = dict(FIRST), {search.key(FIRST)}, [(search.key(FIRST), True)]
    best = judge(champion)
    while True:
        good = []
        start = len(want)
        for name, values in GRID.items():
            for k in (values.index(champion[name]) - 1, values.index(champion[name]) + 1):
                if 0 <= k < len(values) and search.key(s := {**champion, name: values[k]}) not in visited:
                    visited.add(search.key(s))
                    want.append((search.key(s), False))
                    if judge(s)[0] < best[0] - 1e-4:
                        good.append((judge(s), len(want) - 1, s))
        if not good:
            break
        best, at, champion = min(good, key=lambda g: g[:2])
        want[at] = (want[at][0], True)
    got = QUERIES["t11_local_search"](spark, sf).collect()
    assert [(r.settings, r.adopted) for r in got] == want and len(want) > 4
    for r in got:
        assert (r.log_loss, r.brier) == pytest.approx(judge(json.loads(r.settings)), abs=1e-9)


def test_a_frontier_is_judged_once():
    calls = []

    def evaluate(frontier):
        calls.append([s["x"] for s in frontier])
        return [((s["x"] - 3) ** 2, 0.0) for s in frontier]

    trials = search.local_search({"x": 0.0}, search.grid_neighbours({"x": [0.0, 1.0, 2.0, 3.0, 4.0]}), evaluate)
    assert calls == [[0.0], [1.0], [2.0], [3.0], [4.0]] and [t["settings"]["x"] for t in trials if t["adopted"]] == [0, 1, 2, 3]


def test_recurrent_gradients_equal_differences():
    rng = np.random.default_rng(2)
    weights = sequences.start(3, 4, 1)
    x, y, length = rng.normal(0, 1, (5, 6, 3)), np.array([0, 1, 1, 0, 1.0]), np.array([6, 1, 3, 5, 2])
    _, g = sequences.gradients(weights, x, y, length)
    values = sequences.flat(weights)
    for k in range(len(values)):
        up, down = values.copy(), values.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        want = (sequences.gradients(sequences.shaped(up, weights), x, y, length)[0] - sequences.gradients(sequences.shaped(down, weights), x, y, length)[0]) / 2e-5
        assert sequences.flat(g)[k] == pytest.approx(want, abs=1e-6)


def test_later_states_change_nothing():
    rng = np.random.default_rng(2)
    weights, x = sequences.start(3, 4, 1), rng.normal(0, 1, (2, 8, 3))
    logits, _ = sequences.forward(weights, x)
    for t in range(7):
        other = x.copy()
        other[:, t + 1 :] = 99
        assert (sequences.forward(weights, other)[0][:, : t + 1] == logits[:, : t + 1]).all()


def test_fit_equals_a_loop_and_forecasts_are_causal(spark, sf):
    rows = tapes(spark, sf).cache()
    packed = sequences.pack(rows, "key", ["ts", "event_id"], FEATURES, most=5)
    model = sequences.fit(packed.where("key % 100 <= 3"), len(FEATURES), width=4, epochs=4)
    plain = [(r.y, np.array(r.x).reshape(-1, 3)) for r in packed.where("key % 100 <= 3").collect()]
    every = np.concatenate([x for _, x in plain])
    mean, deviation = every.mean(0), every.std(0)
    weights = sequences.start(3, 4)
    now, first, second, losses = sequences.flat(weights), 0, 0, []
    for t in range(1, 5):
        loss, g = 0.0, 0
        for y, x in plain:
            part, own = sequences.gradients(sequences.shaped(now, weights), ((x - mean) / deviation)[None], np.array([y]), np.array([len(x)]))
            loss, g = loss + part, g + sequences.flat(own)
        losses.append(loss / len(plain))
        g = g / len(plain) + 1e-3 * now
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        now = now - 0.02 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    assert model.losses == pytest.approx(losses, abs=1e-9) and sequences.flat(model.weights) == pytest.approx(now, abs=1e-7)
    p = {r.id: r.p for r in model.forecasts(packed).collect()}
    assert len(p) == rows.count()
    early = sequences.pack(rows.where("ts < timestamp_ntz '2024-01-15'"), "key", ["ts", "event_id"], FEATURES, most=5)
    some = {r.id: r.p for r in sequences.Recurrent.loaded(model.dumped()).forecasts(early).collect()}
    assert some and all(p[i] == pytest.approx(v, abs=1e-12) for i, v in some.items())
    rows.unpersist()


def test_sequence_query(spark, sf):
    rows = QUERIES["u25_sequence_forecasts"](spark, sf).collect()
    assert {r.event_id for r in rows} == {r.event_id for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()} and all(0 < r.p < 1 for r in rows)


def test_scenarios_merge_states_across_batches_without_a_shuffle(spark, sf):
    states = scores(spark, sf)
    want = {tuple(r) for r in scenarios.next_points(states, ["event_id"]).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys go on from batch to batch
    got = scenarios.next_points(states, ["event_id"])
    rows = [tuple(r) for r in got.collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort " not in plan, "an aggregate that collects paths sorts and spills"
