"""Edges of the linking operators: nulls, ties and bounds."""

from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import scores as S
from tidemark.operators.linking import contained, duplicates, first_near, near_in_time, only_candidate, roots, span_clusters


def test_time_windows_have_inclusive_bounds(spark):
    a = spark.sql("select 1 as id, 'k' as k, timestamp '2024-01-01 00:01:00' as t union all select 2, 'k', null union all select 3, null, timestamp '2024-01-01 00:01:00'")
    b = spark.sql("select explode(array(0, 30, 59, 60, 61, 120, 121)) as s, 'k' as k").withColumn("at", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s)"))
    got = near_in_time(a, b, "t", "at", 60, ("k",)).select("id", "s").collect()
    assert sorted((r.id, r.s) for r in got) == [(1, s) for s in (0, 30, 59, 60, 61, 120)]
    assert near_in_time(a, b.where("false"), "t", "at", 60, ("k",)).count() == 0


def test_first_near_is_the_least_of_all_pairs_without_making_them(spark):
    a = spark.range(300).selectExpr("id", "concat('u', hash(id) % 3) as k", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, pmod(hash(id, 1), 900)) as t")
    b = spark.range(300).selectExpr("id as other", "concat('u', hash(id) % 3) as k", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, pmod(hash(id, 2), 900)) as at")
    want = {r.id: r.m for r in near_in_time(a, b, "t", "at", 60, ("k",)).groupBy("id").agg(F.min("other").alias("m")).collect()}
    found = first_near(a, b, "t", "at", 60, ["k"], "other")
    assert {r.id: r.other for r in found.collect() if r.other is not None} == want and found.count() == 300
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_that_stand_in_others(spark):
    a, b = spark.createDataFrame([("u1",), ("u12",), ("",), (None,)], "a string"), spark.createDataFrame([("team u12",), ("u1",), ("u2",), ("",), (None,)], "b string")
    assert sorted(tuple(r) for r in contained(b, "b", a, "a").where("part <> ''").collect()) == [("team u12", "u1"), ("team u12", "u12"), ("u1", "u1")]
    assert {r.b for r in contained(b, "b", a, "a").where("part = ''").collect()} == {"team u12", "u1", "u2", ""}


def test_unique_candidates_and_survivors(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 7), (None, 9)], "k string, v int")
    assert {r.k: r.v for r in only_candidate(rows, ["k"], "v").collect()} == {"a": 1}
    assert sorted((r.v, r.duplicate_of) for r in duplicates(rows, ["k"], "v").collect() if r.duplicate_of) == [(2, 1), (9, 7)]
    assert duplicates(rows, ["k"], "v").count() == 6


def test_spans_start_anew_after_the_limit(spark):
    days = [("a", f"2024-01-{d:02d}") for d in (1, 1, 10, 15, 16, 30, 31)]
    rows = spark.createDataFrame(days, "k string, d string").withColumn("d", F.to_date("d"))
    got = sorted((r.d.day, r.cluster_start.day) for r in span_clusters(rows, ["k"], "d", 14).collect())
    assert got == [(1, 1), (1, 1), (10, 1), (15, 1), (16, 16), (30, 16), (31, 31)]


def test_names_and_scores(spark):
    names = spark.createDataFrame([(0, "Éva-María  D'Óre"), (1, None), (2, "Жуков Й."), (3, "van der Berg X"), (4, "J. de la Cruz"), (5, "Solo")], "i int, n string")
    got = {r.i: tuple(r.k) for r in names.select("i", N.surname_and_initial(N.latin(N.fold(F.col("n")))).alias("k")).collect()}
    assert got == {0: ("ore", "e"), 1: ("", ""), 2: ("zhukov", "i"), 3: ("berg", "x"), 4: ("cruz", "j"), 5: ("solo", "")}
    texts = spark.createDataFrame([(0, "6-4 3-6 7-6(5)", "2-1"), (1, "", None), (2, "6(7)-7 6-4 6-0", "1:2"), (3, "2-1", "2-1")], "i int, x string, y string")
    rows = {r.i: r for r in texts.select("i", S.set_tally(F.col("x")).alias("t"), S.scores_agree(F.col("x"), F.coalesce("y", F.lit(""))).alias("ok"), F.size(S.winners_in_brackets(F.coalesce("y", F.lit("")))).alias("n")).collect()}
    assert rows[0].ok and rows[3].ok and not rows[1].ok and not rows[2].ok
    assert rows[1].t is None and tuple(rows[3].t) == (2, 1) and rows[1].n == 0


def test_roots_of_any_depth(spark):
    chain = [(k, k - 1) for k in range(1, 700)]
    rows = [(0, None), *chain, (1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 2000), (3000, 99999), (3001, 3000)]
    got = {r.id: (r.depth, r.root, r.in_cycle) for r in roots(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert all(got[k] == (k, 0, False) for k in range(700))
    assert got[3000] == (0, 3000, False) and got[3001] == (1, 3000, False)
    assert all(got[k] == (None, None, True) for k in (1000, 1001, 1002, 1003, 2000)) and len(got) == len(rows)
    assert roots(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_name_tokens_and_namesakes(spark):
    rows = [
        ("Медведев/Shapovalov, The ATP", "", "", {"медведев", "medvedev", "медведе", "medvede", "shapovalov", "shapovalo"}, "absent"),
        ("Мартинес Т", "Педро Мартинес: интервью", "", None, "other"), ("Мартинес Т", "Т. Мартинес — Надаль", "", None, "same"), ("Мартинес Т", "Мартинес против Мартинес", "", None, "same"),
        ("Martinez T", "Pedro Martinez vs. Tita Martines", "", None, "both"), ("Daniil Medvedev", "anything", "https://x/Person/ivan-medvedev?x", None, "other"),
        ("Daniil Medvedev", None, None, None, "absent"), (None, "Medvedev", "", set(), "absent"), ("Щукин", "Щукин", "", {"щукин", "shchukin", "щуки", "shchuki"}, "absent"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, n string, t string, u string")
    got = df.select("i", N.name_tokens(F.col("n")).alias("k"), N.about(F.col("n"), F.col("t"), F.col("u")).alias("a")).collect()
    for r in got:
        assert rows[r.i][4] == r.a, rows[r.i]
        assert rows[r.i][3] is None or set(r.k) == rows[r.i][3]


def test_equal_modes_go_to_the_first_seen(spark, tmp_path):
    from tidemark.plans import QUERIES

    rows = [(k, u, t, 5.0) for k, (u, t) in enumerate((u, t) for u in range(40) for t in (("view", "click", "error") if u % 2 else ("error", "view", "click")))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.mode for r in QUERIES["t6_preferred_mode"](spark, str(tmp_path)).collect()} == {u: "view" if u % 2 else "error" for u in range(40)}


def test_a_mode_without_drawdown_or_name_comes_last(spark, tmp_path):
    import duckdb

    from tidemark.plans import ORACLES, QUERIES

    nan = float("nan")
    modes = {
        1: [("a", None), ("b", 5.0)], 2: [("a", 5.0), ("b", None)], 3: [(None, 1.0), ("b", 5.0)], 4: [(None, None), ("b", 3.0)], 5: [(None, 1.0)], 6: [("a", nan), ("b", None)],
        7: [("a", None), ("b", None), ("b", None)], 8: [("a", 0.0), ("b", -0.0), ("b", -0.0)], None: [("a", 2.0), (None, 1.0)],
    }
    rows = [(u, *m) for u, own in modes.items() for m in own]
    spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.mode for r in QUERIES["t6_preferred_mode"](spark, str(tmp_path)).collect()}
    assert got == {1: "b", 2: "a", 3: "b", 4: "b", 5: None, 6: "a", 7: "b", 8: "b", None: "a"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(con.execute(ORACLES["t6_preferred_mode"]).fetchall())


def test_a_name_is_read_once_a_part(spark, sf):
    from tidemark.plans import QUERIES

    plan = QUERIES["sc62_namesakes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    last = plan.split("Join")[0]  # what is reckoned after the joins
    assert "p_name" in plan and "own#" in last and "regexp_extract_all(coalesce(p_name" not in last
