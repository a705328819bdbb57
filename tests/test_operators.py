"""Edge cases that the driver's tables do not hold: ties, nulls, bounds, empty windows."""

import math
import random

from pyspark.sql import functions as F

from tidemark.functions import prices as P
from tidemark.operators import metrics as M
from tidemark.operators import series as S
from tidemark.operators.ranking import ranked, running_total
from tidemark.operators.asof import asof_backward, latest_per_key, visible_versions
from tidemark.sources.tables import new_payloads, read_json_lines, retained


def test_asof_ties_bounds_and_slices(spark):
    left = spark.createDataFrame([(1, "k", "2024-01-01 00:10:00"), (2, "k", "2024-01-03 00:00:00"), (3, "x", "2024-01-01 00:00:00"), (4, None, "2024-01-01 00:00:00")], "id int, k string, t string")
    right = spark.createDataFrame([("k", "2024-01-01 00:10:00", 1, 1.5), ("k", "2024-01-01 00:10:00", 2, 2.5), ("k", "2024-01-04 00:00:00", 3, 9.0)], "k string, at string, rid int, v double")
    left, right = left.withColumn("t", F.col("t").cast("timestamp")), right.withColumn("at", F.col("at").cast("timestamp"))
    for days in (1, 5):
        out = {r.id: r.v for r in asof_backward(left, right, "k", "t", "at", ["v"], tie="rid", days=days).collect()}
        assert out == {1: 2.5, 2: 2.5, 3: None, 4: None}
    aged = {r.id: r.v for r in asof_backward(left, right, "k", "t", "at", ["v"], tie="rid", max_age="1 day").collect()}
    assert aged == {1: 2.5, 2: None, 3: None, 4: None}


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1, 1, 10), ("a", 1, 5, 20), ("b", 9, 1, 30), ("c", 1, 2, 1), ("c", 1, 2, 2)], "k string, happened int, known int, id int")
    got = {r.k: r.id for r in visible_versions(rows, ["k"], "happened", "known", F.lit(4), "id").collect()}
    assert got == {"a": 10, "c": 2}
    assert {r.k: r.id for r in latest_per_key(rows, ["k"], ["known", "id"]).collect()} == {"a": 20, "b": 30, "c": 2}


def test_streak_broken_by_null(spark):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate(["a", None, "a", "a", "b", "b", "b"])], "k string, i int, side string")
    assert [r.streak for r in S.streaks(rows, "k", ["i"], "side").orderBy("i").collect()] == [1, 0, 1, 2, 1, 2, 3]
    assert [r.i for r in S.confirmations(rows, "k", ["i"], "side", 2).collect()] == [3]


def test_slices_change_nothing(spark):
    """Long histories over many slices against plain loops: runs, balances and last values cross the slices."""
    rng = random.Random(7)
    rows = [(k, d * 7200 + rng.randrange(3600), i, rng.choice([None, "a", "a", "a", "b"]) if d % 60 > 30 else "a", rng.randrange(-9, 10)) for k in ("k", "l") for i, d in enumerate(sorted(rng.sample(range(400), 150)))]
    df = spark.createDataFrame(rows, "k string, t long, i int, side string, v int").withColumn("t", F.col("t").cast("timestamp"))
    order = ["t", "i"]
    want = {}
    for k in ("k", "l"):
        run, before, total, peak, balance, last, prev = 0, None, 0, -(10**9), 0, None, None
        for _, t, i, side, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            run = 0 if side is None else run + 1 if side == before else 1
            known = last
            last = v if side == "b" else last
            total += v
            peak = max(peak, total)
            balance = v if v == 9 else balance + v
            want[k, i] = (run, peak - total, balance, known, last, prev)
            before, prev = side, v
    ask = {
        0: S.streaks(df, "k", order, "side", days=1).select("k", "i", "streak"),
        1: S.drawdown(df, "k", order, "v", days=1).select("k", "i", "fall"),
        2: S.ledger(df, "k", order, "v", F.col("v") == 9, days=1).select("k", "i", "balance"),
        3: S.last_known(df, "k", order, {"x": F.when(F.col("side") == "b", F.col("v"))}, False, days=1).select("k", "i", "x"),
        4: S.last_known(df, "k", order, {"x": F.when(F.col("side") == "b", F.col("v"))}, True, days=1).select("k", "i", "x"),
        5: S.previous(df, "k", order, "v", days=1).select("k", "i", "_p.v"),
    }
    for n, got in ask.items():
        assert {(r[0], r[1]): r[2] for r in got.collect()} == {k: w[n] for k, w in want.items()}, n


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, x double")
    got = {r.i: (r.k, r.n) for r in ranked(df, [F.col("x").desc_nulls_last(), "i"], total="n").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {i: (k + 1, 500) for k, (i, _) in enumerate(order)}
    sums = {r.i: r.before for r in running_total(df, ["i"], "i").collect()}
    assert sums == {i: i * (i - 1) // 2 for i in range(500)} and ranked(df.limit(0), ["i"]).count() == 0


def test_trailing_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1.0), ("k", "2024-01-01 00:00:10", 4.0), ("k", "2024-01-01 00:00:11", 9.0)], "k string, t string, v double")
    out = S.trailing_features(rows.withColumn("t", F.col("t").cast("timestamp")), "k", "t", "v", "v", {"10s": 10}).orderBy("t").collect()
    assert [r.delta_10s for r in out] == [0.0, 3.0, 5.0]
    assert [r.n_10s for r in out] == [1, 2, 2] and out[0].vol_10s == 0.0


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.25, 0), (0.25, 1), (0.75, 1)], "p double, y int")
    assert math.isclose(M.ece(rows).first().ece, (2 * 0.25 + 0.25) / 4)  # exactly 1 is in no bin
    assert math.isclose(M.auc(rows).first().auc, (1 + 0.5 + 1) / 3)
    assert M.auc(rows.where("y = 1")).first().auc == 0.5
    bins = M.calibration_bins(rows, 5).orderBy("bin").collect()
    assert [b.n for b in bins] == [0, 2, 0, 1, 1]


def test_prices(spark):
    row = spark.createDataFrame([(2.0, 1.0)], "a double, b double").select(*P.no_vig(F.col("a"), F.col("b")), P.kelly(F.lit(0.6), F.col("a"), 0.5), P.set_winner(F.lit(6), F.lit(6)), P.set_winner(F.lit(7), F.lit(5))).first()
    assert tuple(row)[:3] == (0.5, 0.5, 0.0) and math.isclose(row[3], 0.1) and row[4] is None and row[5] == "a"
    reason = spark.range(1).select(P.first_reason(("A", F.lit(False)), ("B", F.lit(None).cast("boolean")), ("C", F.lit(True))), P.all_reasons(("A", F.lit(False)), ("C", F.lit(True)))).first()
    assert reason[0] == "B" and reason[1] == ["C"]


def test_sources(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"a": 1}\nnot json\n')
    assert sorted((r.a, r._bad) for r in read_json_lines(spark, str(path), "a int").cache().collect() if r.a) == [(1, None)]
    incoming = spark.createDataFrame([("x",), ("x",), ("y",)], "payload string")
    stored = spark.createDataFrame([("y",)], "payload string").select(F.sha2("payload", 256).alias("content_hash"))
    assert [r.payload for r in new_payloads(incoming, stored).collect()] == ["x"]
    rows = spark.sql("select timestamp_ntz '2024-01-01' t union all select timestamp_ntz '2024-01-09'")
    assert retained(rows, "t", "2024-01-10", 3).count() == 1


def test_drawdown_and_ledger(spark):
    rows = spark.createDataFrame([("k", 1, 10), ("k", 2, -4), ("k", 3, 2)], "k string, i int, v int")
    assert [r.fall for r in S.drawdown(rows, "k", ["i"], "v").orderBy("i").collect()] == [0, 4, 2]
    assert [r.balance for r in S.ledger(rows, "k", ["i"], "v", F.col("i") == 3).orderBy("i").collect()] == [10, 6, 2]
