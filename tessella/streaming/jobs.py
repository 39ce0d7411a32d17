"""Structured Streaming forms of the service's stream-like behaviour.

Windows, watermarks and sessions are additions: the reference behaviour is
request-driven. Keyed state machines give the same result as their batch fold
in ``operators.lifecycle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.graph import shared_folder
from tessella.sources.snapshots import BucketedSnapshot

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int | None = 1) -> DataFrame:
    """Parquet files as an event stream, ``files`` to a micro-batch or all that
    are there; zone-less times are read as UTC."""
    reader = spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz"))
    raw = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def throughput(events: DataFrame, done: Column, window: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events that are done, by sliding window; late ones are dropped."""
    return events.withWatermark("ts", late).filter(done).groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def tumbling(events: DataFrame, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each completion once, however often it is delivered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


# The next state of a job by event.
NEXT_STATE = {"signup": "pending", "view": "leased", "click": "retry_wait", "purchase": "synced", "error": "quarantined"}
FINAL = {"synced"}


def fold(state: str, kind: str) -> str:
    """A job's state after an event; a final state stays."""
    return state if state in FINAL else NEXT_STATE.get(kind, state)


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, state, events): a keyed state machine in update mode. Events
    of a key are folded in the order of time within a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, n = held.get if held.exists else ("new", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            state, n = fold(state, kind), n + 1
        held.update((state, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [state], "events": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, state string, events long", "state string, events long", "update", GroupStateTimeout.NoTimeout)


def job_states_batch(events: DataFrame) -> DataFrame:
    """The same fold over a whole table without gathering a key's events: the
    first final state decides, else the last known event."""
    to = F.create_map(*[F.lit(x) for kv in NEXT_STATE.items() for x in kv])
    rows = events.withColumn("to", F.try_element_at(to, F.col("event_type"))).withColumn("at", F.struct("ts", "event_id"))
    final = F.col("to").isin(*FINAL)
    ended = F.min_by("to", F.when(final, F.col("at"))).alias("ended")
    last = F.max_by("to", F.when(F.col("to").isNotNull(), F.col("at"))).alias("last")
    found = rows.groupBy("user_id").agg(ended, last, F.count(F.lit(1)).alias("events"), F.count_if(final).alias("finals"))
    return found.select("user_id", F.when(F.col("finals") > 0, F.col("ended")).otherwise(F.coalesce("last", F.lit("new"))).alias("state"), "events")


def messages(tokens: DataFrame) -> DataFrame:
    """Token events (stream_id, seq, token, final) folded to one message: each
    batch appends, a final event overwrites."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        text, done = held.get if held.exists else ("", False)
        for token, final in pd.concat(list(frames)).sort_values("seq")[["token", "final"]].itertuples(index=False):
            text, done = (token, True) if final else (text if done else text + token, done)
        held.update((text, done))
        yield pd.DataFrame({"stream_id": [key[0]], "text": [text], "done": [done]})

    return tokens.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, text string, done boolean", "text string, done boolean", "update", GroupStateTimeout.NoTimeout)


def leases(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """(user_id, state, at): a lease is renewed by every event of its key and
    expires on an event-time timer when none has come."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            (until,) = held.get
            held.remove()
            yield pd.DataFrame({"user_id": [key[0]], "state": ["expired"], "until": [until]})
            return
        latest = max(int(pdf["ts"].max().timestamp()) for pdf in frames)
        until = max(latest + seconds, held.get[0] if held.exists else 0)
        held.update((until,))
        if until * 1000 > held.getCurrentWatermarkMs():
            held.setTimeoutTimestamp(until * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "state": ["leased"], "until": [until]})

    return events.withWatermark("ts", "10 minutes").groupBy("user_id").applyInPandasWithState(step, "user_id long, state string, until long", "until long", "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it gave. Every
    micro-batch is written by the executors to a folder of its own in the shared
    folder, so no row passes through the driver; a micro-batch that comes twice
    is written once."""
    spark, made = stream.sparkSession, []
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{epoch}")
        made.append(f"{folder}/{epoch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    paths = sorted(set(made[-1:] if mode == "complete" else made))  # one for each micro-batch
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def load_incrementally(stream: DataFrame, sources: BucketedSnapshot, jobs: BucketedSnapshot | None, content: str, checkpoint: str) -> None:
    """File source to a snapshot. Every micro-batch rewrites only the
    buckets that it touches; a new source, or one whose ``content`` changed, is
    queued in ``jobs`` (key, generation, state) again, in the next generation.
    A micro-batch that comes twice changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        # The jobs of an epoch are written first: while its sources are not
        # there, the same changes are found again.
        if jobs is not None and epoch not in jobs.epochs() and epoch not in sources.epochs():
            changed = sources.changes(batch, content).filter("change <> 'refresh'").select(sources.key)
            held = jobs.read().select(jobs.key, F.col("generation").alias("_before"))
            due = changed.join(held, jobs.key, "left").select(jobs.key, (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("generation"), F.lit("pending").alias("state"))
            jobs.merge(due, epoch)
        sources.merge(batch, epoch)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
