"""A stream that has run over a whole table gives what the batch query gives."""

from pyspark.sql import functions as F

from tidemark.plans import QUERIES
from tidemark.sources.tables import table
from tidemark.streaming import feeds


def test_windows_equal_the_closed_batch_windows(spark, sf):
    got = {(r.start, r.event_type): (r.n, round(r["mean"], 6)) for r in QUERIES["stream_windows"](spark, sf).collect()}
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    want = {(r.start, r.event_type): (r.n, round(r["mean"], 6)) for r in table(spark, sf, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len({k[0] for k in want}) - len({k[0] for k in got}) <= 2  # the last windows are still open


def test_deduplication(spark, sf):
    got = QUERIES["stream_dedup"](spark, sf)
    assert got.count() == got.select("event_id").distinct().count() == table(spark, sf, "events").count()


def test_confirmation_equals_the_window_form(spark, sf):
    got = {tuple(r) for r in QUERIES["stream_confirmation"](spark, sf).select("user_id", "event_id", "event_type").collect()}
    assert got == {tuple(r) for r in QUERIES["w14_confirmation"](spark, sf).collect()}


def test_cache_equals_a_loop(spark, sf):
    stored, want = {}, {}
    for r in sorted(table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts").collect(), key=lambda r: (r.ts, r.event_id)):
        key = (r.user_id, r.event_type)
        want[r.event_id] = key in stored and (r.ts - stored[key]).total_seconds() <= 6 * 3600
        if not want[r.event_id]:
            stored[key] = r.ts
    assert {r.event_id: r.hit for r in QUERIES["st11_cached_states"](spark, sf).collect()} == want and 0 < sum(want.values()) < len(want)


def test_cache_goes_on_from_batch_to_batch_with_a_state_per_bucket(spark, sf, tmp_path):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type in ('view', 'error')")
    rows = sorted(e.collect(), key=lambda r: (r.ts, r.event_id))
    half = rows[len(rows) // 2].ts
    for k, part in enumerate((e.where(F.col("ts") < half), e.where(F.col("ts") >= half))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
        q = feeds.cached(stream, 12 * 3600, buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
        held = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
        assert max(held) <= 3 < len({(r.user_id, r.event_type) for r in rows}), "a group a key costs its start for each key"
    stored, want = {}, {}
    for r in rows:
        key = (r.user_id, r.event_type)
        want[r.event_id] = key in stored and (r.ts - stored[key]).total_seconds() <= 12 * 3600
        if not want[r.event_id]:
            stored[key] = r.ts
    assert {r.event_id: r.hit for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
