"""Structured Streaming counterparts: windows, deduplication and confirmation with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.registry import ORACLES, query
from ..sources.shared import new_path
from ..sources.tables import table


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream; its time column as a timestamp, so that it can carry a watermark."""
    schema = table(spark, sf, name).schema
    out = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1)
    rows = out.parquet(f"{sf}/{name}.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def run_once(rows: DataFrame, name: str) -> DataFrame:
    """Run over what is there and return the rows that were emitted.

    They are written as Parquet in the shared folder, beside the checkpoint of the stream.
    """
    path = new_path(rows.sparkSession, name)
    q = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")


def run_batches(rows: DataFrame, name: str, write: Callable[[DataFrame, str], None], mode: str = "append") -> str:
    """Run over what is there; ``write`` gets each batch and a folder of its own, and must overwrite.

    A batch that is done again after a failure replaces what it wrote before. Returns the folder of all batches.
    """
    path = new_path(rows.sparkSession, name)
    q = rows.writeStream.foreachBatch(lambda batch, i: write(batch, f"{path}/batches/batch={i}")).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{path}/batches"


def windowed(rows: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and means of tumbling windows; rows later than the watermark do not change them."""
    w = F.window("ts", width)
    return rows.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def deduplicated(rows: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def confirmed(rows: DataFrame, required: int, late: str = "1 day", keep_days: int = 30) -> DataFrame:
    """user_id, event_type, event_id at which a type has come ``required`` times in a row, once a user.

    State is the current side, its run and whether it was emitted: a fixed size a key. It is dropped
    once the watermark has passed a user's last row by ``keep_days``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        side, run, done = state.get if state.exists else ("", 0, False)
        out, all_rows = [], pd.concat(frames).sort_values(["ts", "event_id"])
        for r in all_rows.itertuples():
            run = run + 1 if r.event_type == side else 1
            side = r.event_type
            if run == required and not done:
                out.append((key[0], side, r.event_id))
                done = True
        state.update((side, run, done))
        last = int(all_rows.ts.max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_days * 86_400_000)
        yield pd.DataFrame(out, columns=["user_id", "event_type", "event_id"])

    return rows.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_type string, event_id long", "side string, run int, done boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


#: Groups into which the keys of a cache are dealt: a group costs some 10 ms a batch of the stream, whatever it holds.
BUCKETS = 1024


def cached(rows: DataFrame, ttl_seconds: int, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """event_id, hit: whether the row's key was stored no longer than ``ttl_seconds`` ago.

    A miss stores the key at its time; a hit does not renew it. Keys are dealt into ``buckets``; the state of
    one holds these times of its keys, each dropped once the watermark has passed it.
    """
    ttl = ttl_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = dict(zip(*state.get, strict=True)) if state.exists else {}
        all_rows, hits = pd.concat(frames).sort_values(["ts", "event_id"]), []
        for k, at in zip(all_rows.state_hash.tolist(), all_rows.ts.dt.as_unit("us").astype("int64").tolist(), strict=True):
            since = stored.get(k)
            hits.append(since is not None and at - since <= ttl)
            if not hits[-1]:
                stored[k] = at
        passed = state.getCurrentWatermarkMs() * 1000 - ttl
        last = max(stored.values())
        stored = {k: at for k, at in stored.items() if at >= passed}
        state.update((list(stored), list(stored.values())))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + ttl_seconds * 1000 + 1)
        yield pd.DataFrame({"event_id": all_rows.event_id, "hit": hits})

    keyed = rows.withColumn("state_hash", F.sha2(F.concat_ws("|", "user_id", "event_type"), 256)).withWatermark("ts", late)
    keyed = keyed.select("event_id", "ts", "state_hash", F.pmod(F.xxhash64("state_hash"), F.lit(buckets)).alias("bucket"))
    kind = "keys array<string>, stored array<bigint>"
    return keyed.groupBy("bucket").applyInPandasWithState(step, "event_id long, hit boolean", kind, "append", GroupStateTimeout.EventTimeTimeout)


def changed(rows: DataFrame, late: str = "1 day", keep_days: int = 30) -> DataFrame:
    """The rows of a key whose signature is not that of its row before; state is the last signature."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        all_rows = pd.concat(frames).sort_values(["ts", "event_id"])
        before = [state.get[0] if state.exists else None, *all_rows.event_type[:-1]]
        state.update((all_rows.event_type.iloc[-1],))
        state.setTimeoutTimestamp(max(int(all_rows.ts.max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_days * 86_400_000)
        yield all_rows[[x != y for x, y in zip(all_rows.event_type, before, strict=True)]][["event_id"]]

    return rows.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "event_id long", "signature string", "append", GroupStateTimeout.EventTimeTimeout)


@query()
def stream_windows(spark, sf):
    """Tumbling windows that the watermark has closed."""
    return run_once(windowed(stream(spark, sf, "events")), "windows")


@query("SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, sf):
    """Every event once, from a stream that brings each twice."""
    e = stream(spark, sf, "events")
    return run_once(deduplicated(e.union(e)).select("event_id", "user_id", "value"), "dedup")


@query(ORACLES["w14_confirmation"])
def stream_confirmation(spark, sf):
    """The stateful form of ``w14_confirmation``."""
    return run_once(confirmed(stream(spark, sf, "events"), 3), "confirmed")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def st1_capped_log(spark, sf):
    """A log to which a stream appends, read back capped to its newest thousand entries."""
    log = run_once(stream(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), "log")
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).drop("ts")


@query("""
SELECT event_id, event_type AS kind, 1 AS version, CASE WHEN k % 7 > 0 THEN k END AS k, CASE WHEN k % 7 = 0 THEN '{"k": ' || k END AS raw FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def st2_envelopes(spark, sf):
    """Flat maps of strings read to typed envelopes; a payload that does not parse is kept as it came."""
    k = F.get_json_object("props", "$.k").cast("int")
    payload = F.when(k % 7 == 0, F.concat(F.lit('{"k": '), k.cast("string"))).otherwise(F.col("props"))
    flat = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("payload"), payload)
    m = stream(spark, sf, "events").select(flat.alias("m"))
    j = F.from_json(F.col("m")["payload"], "k int, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = m.select(F.col("m")["id"].cast("long").alias("event_id"), F.col("m")["kind"].alias("kind"), F.coalesce(F.try_element_at("m", F.lit("version")).cast("int"), F.lit(1)).alias("version"), j.alias("j"))
    return run_once(rows.select("event_id", "kind", "version", F.when(F.col("j._bad").isNull(), F.col("j.k")).alias("k"), F.col("j._bad").alias("raw")), "envelopes")


@query("SELECT event_id, user_id, value FROM events")
def st3_resumed_consumer(spark, sf):
    """A consumer that stops and starts again from its checkpoint: what came before and after is there once."""
    e, path = table(spark, sf, "events").select("event_id", "user_id", "value"), new_path(spark, "consumer")
    for half in (0, 1):
        e.where(f"event_id % 2 = {half}").write.mode("append").parquet(f"{path}/in")
        q = spark.readStream.schema(e.schema).parquet(f"{path}/in").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{path}/out")


#: Tries of a message before it goes to the dead letters.
RETRIES = 3


@query("""
WITH l AS (SELECT user_id, max(ts) AS seen, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, state, CASE WHEN seen < now - INTERVAL 6 HOUR THEN 'interrupted' ELSE 'live' END AS status FROM l, n
""")
def st6_upserted_state(spark, sf):
    """The current state of each key, upserted by batches; keys that were not seen for six hours are interrupted."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("s")
    rows = stream(spark, sf, "events").groupBy("user_id").agg(last).select("user_id", "s.*")
    path = run_batches(rows, "state", lambda batch, folder: batch.write.mode("overwrite").parquet(folder), "update")
    state = spark.read.schema("user_id long, ts timestamp, event_id long, event_type string").parquet(f"{path}/batch=*/")
    state = state.groupBy("user_id").agg(last).select("user_id", "s.*")  # the newest of a key's batches
    now = F.broadcast(state.agg(F.max("ts").alias("now")))
    status = F.expr("if(ts < now - interval 6 hours, 'interrupted', 'live')")
    return state.crossJoin(now).select("user_id", F.col("event_type").alias("state"), status.alias("status"))


@query(ORACLES["w10_changes_only"])
def st8_changed_states(spark, sf):
    """Change detection with state: only rows that differ from the one before are stored."""
    return run_once(changed(stream(spark, sf, "events")), "changed")


@query()
def st11_cached_states(spark, sf):
    """Which rows a cache with a time to live of six hours would have answered."""
    return run_once(cached(stream(spark, sf, "events"), 6 * 3600), "cached")
