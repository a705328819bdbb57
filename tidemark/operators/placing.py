"""The checks of a bet before it is placed, in their order, over one row of what was known at its time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Limits(NamedTuple):
    """Fixed values of the placing service; ages in seconds, shares of the account."""

    quote_age: float = 15.0
    state_age: float = 30.0
    prediction_age: float = 180.0
    decision_age: float = 300.0
    least_edge: float = 0.03
    most_edge: float | None = None
    least_chance: float = 0.50
    odds: tuple[float, float] = (1.05, 50.0)
    least_stake: float = 50.0
    most_stake: float = 0.20  # of the balance
    most_exposure: float = 0.20  # of the first balance
    daily_loss: float = 0.15  # of the first balance
    slippage: float = 0.05
    live_only: bool = True


#: What a proposal must carry.
REQUIRED = ["bet_id", "event_id", "market", "outcome", "odds", "p", "edge", "stake"]
SPORTS = ["tennis", "football", "basketball", "hockey", "volleyball"]
_SHUT = ["suspended", "closed", "inactive"]


def age(at: str) -> Column:
    """Seconds from a time to that of the proposal; null where it is not known."""
    return (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1_000_000


def _cents(x: Column) -> Column:
    """Rounded to cents by the number as it is stored: a share of 1.035 is less than its decimals tell, so 1.03."""
    return F.round(x * 100) / 100


def checks(limits: Limits = Limits()) -> list[tuple[str, Column]]:
    """Name and failure of each check. Columns are read by name:

    the proposal (REQUIRED, now, sport); predicted_at, shadow, model_active (all null without a linked
    prediction); decided_at, verdict (null without a decision); event_status (null: no such event),
    live, seen_at; market_status, selection_status (null: none); current_odds, quoted_at; doubled (an
    open bet on the same outcome); balance, first_balance, exposure, lost_today.
    """
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    said = lambda c, words: F.lower(c).isin(words)
    linked, decided = F.col("predicted_at").isNotNull(), F.col("decided_at").isNotNull()
    effective = F.col("p") * F.col("current_odds") - 1
    beyond = lambda x: (x < limits.least_edge) | (F.lit(False) if limits.most_edge is None else x > limits.most_edge)
    return [
        ("SCHEMA_VALIDATION", missing),
        ("SPORT_SUPPORT", ~F.coalesce(F.lower("sport").isin(SPORTS), F.lit(False))),
        ("SPORT_RULES", (F.col("odds") <= 1) | (F.col("p") <= 0) | (F.col("p") >= 1) | ~F.col("outcome").isin("a", "b", "draw") | ((F.col("outcome") == "draw") & (F.lower("sport") != "football"))),
        ("MODEL_STATUS", linked & (F.coalesce("shadow", F.lit(False)) | ~F.coalesce("model_active", F.lit(False)))),
        ("PREDICTION_FRESHNESS", linked & (age("predicted_at") > limits.prediction_age)),
        ("LLM_FRESHNESS", decided & (age("decided_at") > limits.decision_age)),
        ("LLM_VERDICT", decided & (F.upper(F.coalesce("verdict", F.lit(""))) == "NO_BET")),
        ("EVENT_EXISTS", F.col("event_status").isNull()),
        ("EVENT_ACTIVE", said(F.col("event_status"), ["finished", "completed", "cancelled"])),
        ("EVENT_IN_PLAY", (~F.coalesce("live", F.lit(False)) | (F.col("event_status") != "live")) if limits.live_only else F.lit(False)),
        ("EVENT_FRESHNESS", F.coalesce(age("seen_at") > limits.state_age, F.lit(True))),
        ("MARKET_EXISTS", F.col("market_status").isNull()),
        ("MARKET_ACTIVE", said(F.col("market_status"), _SHUT)),
        ("SELECTION_EXISTS", F.col("selection_status").isNull()),
        ("SELECTION_ACTIVE", said(F.col("selection_status"), _SHUT)),
        ("ODDS_FRESHNESS", F.coalesce(age("quoted_at") > limits.quote_age, F.lit(True)) | F.col("current_odds").isNull()),
        ("CONFIDENCE_THRESHOLD", F.col("p") < limits.least_chance),
        ("EDGE_THRESHOLD", beyond(F.col("edge"))),
        ("ODDS_BOUNDS", ~F.col("current_odds").between(*limits.odds)),
        ("SLIPPAGE_EDGE", beyond(effective) | (F.col("current_odds") < F.col("odds") * (1 - limits.slippage))),
        ("DUPLICATE_CHECK", F.coalesce("doubled", F.lit(False))),
        ("STAKE_LIMITS", (F.col("stake") < limits.least_stake) | (F.col("stake") > _cents(F.col("balance") * limits.most_stake))),
        ("BANKROLL_SUFFICIENCY", F.col("stake") > F.col("balance")),
        ("EXPOSURE_LIMIT", F.col("exposure") + F.col("stake") > F.col("first_balance") * limits.most_exposure),
        ("DAILY_LOSS_LIMIT", F.col("lost_today") >= F.col("first_balance") * limits.daily_loss),
    ]


def checked(proposals: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """bet_id, reason (the first check that fails, '' if none), passed (checks before it), failed (all that fail).

    A check on what is not known does not fail, but for events, markets, selections and quotes, which must be known.
    """
    named = checks(limits)
    marks = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in named])
    rows = proposals.select("bet_id", F.filter(marks, lambda x: x.isNotNull()).alias("f"))
    order = F.array(*[F.lit(n) for n, _ in named])
    first = F.get("f", F.lit(0))
    return rows.select("bet_id", F.coalesce(first, F.lit("")).alias("reason"), F.when(first.isNull(), len(named)).otherwise(F.array_position(order, first) - 1).cast("int").alias("passed"), F.array_join("f", ",").alias("failed"))
