"""Features as of a cutoff do not change with what comes later, and have their values where nothing is known."""

from pyspark.sql import functions as F

from tidemark.operators import live
from tidemark.plans.live import WINDOWS, inputs


def test_later_rows_change_nothing(spark, sf):
    cutoffs, quotes, states = inputs(spark, sf)
    early = cutoffs.where("cutoff <= timestamp_ntz '2024-01-15'")
    before = lambda df: df.where("at <= timestamp_ntz '2024-01-15'")
    for sides, features in ((["a", "x", "b"], live.football()), (["a", "b"], live.hockey())):
        whole = {r.cutoff_id: r for r in live.features_as_of(early, quotes, states, sides, WINDOWS, features).collect()}
        assert whole and whole == {r.cutoff_id: r for r in live.features_as_of(early, before(quotes), before(states), sides, WINDOWS, features).collect()}


def test_nothing_known(spark):
    ts = lambda df, *columns: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
    cutoffs = ts(spark.createDataFrame([(1, 1, "2024-01-02"), (2, 2, "2024-01-02"), (None, 3, "2024-01-02")], "key int, cutoff_id int, cutoff string"), "cutoff")
    quotes = ts(spark.createDataFrame([(1, "2024-01-01", 1, "home", 1.8), (1, "2024-01-02", 2, "1", 2.0), (1, "2024-01-02", 3, "away", 0.9), (1, "2024-01-01", 4, "other", 5.0), (1, None, 5, "home", 9.0)], "key int, at string, rid int, outcome string, odds double"), "at")
    states = ts(spark.createDataFrame([(1, "2024-01-01", 1, "no json"), (2, "2024-01-03", 1, '{"score_a": 3}')], "key int, at string, rid int, detail string"), "at")
    got = {r.cutoff_id: r for r in live.features_as_of(cutoffs, quotes, states, ["a", "x", "b"], [3600, 86400], live.football()).collect()}
    assert (got[1].odds_a, got[1].odds_b, got[1].fair_a, got[1].is_missing_odds, got[1].margin) == (2.0, 0.0, 0.5, 1.0, 0.0)
    assert (got[1].delta_a_3600, got[1].delta_a_86400, got[1].drift_a_86400, got[1].volatility_a_86400) == (0.0, 0.2, 1.0, 0.141421)
    assert (got[1].minute, got[2].minute, got[2].score_a, got[2].period, got[3].odds_a) == (45.0, 0.0, 0.0, 1.0, 0.0)
    assert live.features_as_of(cutoffs.limit(0), quotes, states, ["a", "b"], [60], live.hockey()).count() == 0
