"""The account rules, case by case."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.operators.bankroll import simulate

COLUMNS = "account long, bet long, event long, placed int, settles int, odds double, won boolean"


def run(spark, rows, **rules):
    df = spark.createDataFrame(rows, COLUMNS).withColumn("placed", F.timestamp_seconds("placed")).withColumn("settles", F.timestamp_seconds("settles"))
    return {(r.account, r.bet): r for r in simulate(df, **rules).collect()}


def test_rules(spark):
    rows = [
        (1, 1, 10, 0, 100, 2.0, True), (1, 2, 10, 50, 150, 2.0, True), (1, 3, 11, 50, 60, 1.0, True), (1, 4, 10, 100, 200, 3.0, False),
        (2, 1, 10, 0, 10, 2.0, False), (None, 5, 1, 0, 1, 2.0, True), (3, 1, 1, 0, 1, None, True),
    ]
    got = run(spark, rows, fraction=0.1)
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)}
    assert got[1, 1].accepted and got[1, 1].stake == 100 and got[1, 1].cash == 900
    assert got[1, 2].reason == "open_event" and got[1, 3].reason == "price"
    assert got[1, 4].accepted and got[1, 4].stake == 110 and got[1, 4].cash == 990  # paid at the very time it is due


def test_exposure_and_new_beginning(spark):
    got = run(spark, [(1, i, i, i, 1000, 2.0, False) for i in range(5)], fraction=0.1)
    assert [got[1, i].reason for i in range(5)] == ["", "", "exposure", "exposure", "exposure"]
    got = run(spark, [(1, i, i, 2 * i, 2 * i + 1, 2.0, False) for i in range(4)], fraction=0.7, most=1.0, floor=100)
    assert [got[1, i].resets for i in range(4)] == [0, 0, 1, 1] and got[1, 2].stake == 700


def test_gate_simulations_equal_a_loop(spark, sf):
    from tidemark.plans import QUERIES
    from tidemark.plans.settlement import GATES

    rows = spark.read.parquet(f"{sf}/events.parquet").collect()
    got = {r.gate: r for r in QUERIES["w36_gate_simulations"](spark, sf).collect()}
    users = {r.user_id for r in rows}
    rows.sort(key=lambda r: (r.ts, r.event_id))
    for i, (edge, most) in enumerate(GATES):
        bets = rejected = resets = 0
        for u in users:
            cash, due = 1000.0, []
            for r in rows:
                odds, p = 1 + r.value / 100, json.loads(r.props)["k"] / 100.0
                if r.user_id != u or p * odds - 1 < edge or odds > most:
                    continue
                cash += sum(d[2] for d in due if d[0] <= r.ts)
                due = [d for d in due if d[0] > r.ts]
                open_ = sum(d[3] for d in due)
                if cash + open_ < 50:
                    cash, due, resets, open_ = 1000.0, [], resets + 1, 0.0
                stake = round(0.05 * cash, 2)
                if any(d[1] == r.event_id % 25 for d in due) or open_ + stake > 0.2 * (cash + open_) or stake <= 0:
                    rejected += 1
                    continue
                cash -= stake
                bets += 1
                due.append((r.ts + timedelta(days=1), r.event_id % 25, stake * odds if r.event_id % 3 == 0 else 0.0, stake))
        assert (got[i].bets, got[i].rejected, got[i].resets) == (bets, rejected, resets) and bets > 100
