"""Each check of a bet fails alone, at its bound and without what it needs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.placing import Limits, _cents, checked, checks

NOW = datetime(2024, 1, 1, 12)
GOOD = {
    "bet_id": 1, "event_id": 1, "market": "match_winner", "outcome": "a", "sport": "Tennis", "now": NOW, "odds": 2.0, "p": 0.6, "edge": 0.2, "stake": 100.0, "predicted_at": NOW - timedelta(seconds=180), "shadow": False, "model_active": True,
    "decided_at": NOW - timedelta(seconds=300), "verdict": "bet", "event_status": "live", "live": True, "seen_at": NOW - timedelta(seconds=30), "market_status": "Open", "selection_status": "open", "current_odds": 1.9,
    "quoted_at": NOW - timedelta(seconds=15), "doubled": False, "balance": 1000.0, "first_balance": 1000.0, "exposure": 100.0, "lost_today": 149.0,
}
BREAKS = [
    ("SCHEMA_VALIDATION", {"market": None}), ("SPORT_SUPPORT", {"sport": "chess"}), ("SPORT_SUPPORT", {"sport": None}), ("SPORT_RULES", {"outcome": "draw"}), ("MODEL_STATUS", {"shadow": True}), ("MODEL_STATUS", {"model_active": None}),
    ("PREDICTION_FRESHNESS", {"predicted_at": NOW - timedelta(seconds=181)}), ("LLM_FRESHNESS", {"decided_at": NOW - timedelta(seconds=301)}), ("LLM_VERDICT", {"verdict": "no_bet"}), ("EVENT_EXISTS", {"event_status": None}),
    ("EVENT_ACTIVE", {"event_status": "Finished"}), ("EVENT_IN_PLAY", {"live": False}), ("EVENT_FRESHNESS", {"seen_at": NOW - timedelta(seconds=31)}), ("EVENT_FRESHNESS", {"seen_at": None}), ("MARKET_EXISTS", {"market_status": None}),
    ("MARKET_ACTIVE", {"market_status": "Closed"}), ("SELECTION_EXISTS", {"selection_status": None}), ("SELECTION_ACTIVE", {"selection_status": "SUSPENDED"}), ("ODDS_FRESHNESS", {"quoted_at": NOW - timedelta(seconds=16)}), ("ODDS_FRESHNESS", {"current_odds": None}),
    ("CONFIDENCE_THRESHOLD", {"p": 0.499, "current_odds": 3.0}), ("EDGE_THRESHOLD", {"edge": 0.029}), ("ODDS_BOUNDS", {"current_odds": 51.0}), ("SLIPPAGE_EDGE", {"current_odds": 1.899}), ("SLIPPAGE_EDGE", {"current_odds": 1.7, "odds": 1.7}), ("DUPLICATE_CHECK", {"doubled": True}),
    ("STAKE_LIMITS", {"stake": 49.0}), ("STAKE_LIMITS", {"stake": 200.01}), ("EXPOSURE_LIMIT", {"exposure": 100.01}), ("DAILY_LOSS_LIMIT", {"lost_today": 150.0}),
]
KINDS = "bet_id long, event_id long, market string, outcome string, sport string, now timestamp, odds double, p double, edge double, stake double, predicted_at timestamp, shadow boolean, model_active boolean, decided_at timestamp, verdict string, event_status string, live boolean, seen_at timestamp, market_status string, selection_status string, current_odds double, quoted_at timestamp, doubled boolean, balance double, first_balance double, exposure double, lost_today double"


def test_each_check_at_its_bound(spark):
    rows = [GOOD | {"predicted_at": None, "decided_at": None, "shadow": True, "verdict": "no_bet"}, GOOD, *[GOOD | change for _, change in BREAKS]]
    df = spark.createDataFrame([tuple((r | {"bet_id": k}).values()) for k, r in enumerate(rows)], KINDS)
    got = {r.bet_id: r for r in checked(df).collect()}
    names = [n for n, _ in checks()]
    assert (got[0].reason, got[1].reason, got[1].passed, got[1].failed) == ("", "", len(names), "")
    for k, (name, _) in enumerate(BREAKS, 2):
        assert got[k].reason == name and got[k].passed == names.index(name), (name, got[k])
    loose = {r.bet_id: r.reason for r in checked(df, Limits(live_only=False, most_edge=0.1)).collect()}
    assert loose[1] == "EDGE_THRESHOLD" and loose[2 + [n for n, _ in BREAKS].index("EVENT_IN_PLAY")] == "EDGE_THRESHOLD"
    assert checked(df.where(F.lit(False))).count() == 0


def test_stakes_are_held_against_cents_of_the_stored_number(spark):
    # Shares of 0.11499999999999999 and 1.035 (stored as a little less): 0.12 and 1.03.
    rows = [GOOD | {"balance": 0.575, "stake": 0.12}, GOOD | {"balance": 5.175, "stake": 1.04}]
    df = spark.createDataFrame([tuple((r | {"bet_id": k}).values()) for k, r in enumerate(rows)], KINDS)
    got = {r.bet_id: r.failed for r in checked(df, Limits(least_stake=0.0)).collect()}
    assert "STAKE_LIMITS" not in got[0] and "STAKE_LIMITS" in got[1]
    assert spark.range(1).select(_cents(F.lit(0.575) * 0.2)).first()[0] == 0.12
