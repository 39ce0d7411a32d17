"""Streaming queries drained over the event table, and sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.plans.inputs import table
from tessella.plans.registry import query
from tessella.sources import corpus as C
from tessella.streaming import jobs as S
from tessella.streaming import timers as T


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


@query("t03_job_states", """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, min(n) AS n FROM o WHERE event_type = 'purchase' GROUP BY 1),
 l AS (SELECT user_id, max(n) AS last, count(*) AS events FROM o GROUP BY 1)
 SELECT l.user_id, CASE WHEN f.n IS NOT NULL THEN 'synced' ELSE CASE o.event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'leased' WHEN 'click' THEN 'retry_wait' WHEN 'error' THEN 'quarantined' END END AS state, events FROM l JOIN o ON o.user_id = l.user_id AND o.n = l.last LEFT JOIN f ON f.user_id = l.user_id""")
def t03(spark, d):
    out = S.drained(S.job_states(S.event_stream(spark, f"{d}/events.parquet*")), _name("job_states"), "update")
    return out.groupBy("user_id").agg(F.max_by("state", "events").alias("state"), F.max("events").alias("events"))


@query("t03_job_states_batch", """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT DISTINCT user_id FROM o WHERE event_type = 'purchase'),
 l AS (SELECT user_id, max(n) AS last, count(*) AS events FROM o GROUP BY 1)
 SELECT l.user_id, CASE WHEN f.user_id IS NOT NULL THEN 'synced' ELSE CASE o.event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'leased' WHEN 'click' THEN 'retry_wait' WHEN 'error' THEN 'quarantined' END END AS state, events FROM l JOIN o ON o.user_id = l.user_id AND o.n = l.last LEFT JOIN f ON f.user_id = l.user_id""")
def t03b(spark, d):
    return S.job_states_batch(table(spark, d, "events"))


@query("t04_sliding_throughput", """SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events WHERE event_type = 'purchase') GROUP BY s""")
def t04(spark, d):
    out = S.drained(S.throughput(S.event_stream(spark, f"{d}/events.parquet*"), F.col("event_type") == "purchase"), _name("throughput"), "update")
    return out.groupBy(F.to_timestamp_ntz(F.col("start").cast("string")).alias("start")).agg(F.max("n").alias("n"))


@query("t05_sessions", """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def t05(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.sessions(rows)  # the same operator over a table
    return out.select("user_id", F.to_timestamp_ntz(F.col("start").cast("string")).alias("start"), "n")


@query("t08_exactly_once", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def t08(spark, d):
    stream = S.event_stream(spark, f"{d}/events.parquet*")
    twice = stream.select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    with T.rocksdb(spark):  # the ids seen are held on the executors' disks
        out = S.drained(S.once(twice, "60 days"), _name("once"), "append")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s07_document_upsert", """WITH c AS (SELECT doc_id, sha256(text) AS hash, lang FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE sha256(text) END AS hash, 'xx' AS lang FROM documents WHERE doc_id % 2 = 0)
 SELECT coalesce(i.doc_id, c.doc_id) AS doc_id, coalesce(i.lang, c.lang) AS lang, CASE WHEN c.doc_id IS NULL THEN 'insert' WHEN i.doc_id IS NULL THEN 'keep' WHEN c.hash <> i.hash THEN 'update' ELSE 'refresh' END AS action FROM c FULL JOIN i ON c.doc_id = i.doc_id""")
def s07(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "lang")
    incoming = docs.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("hash")).alias("hash"), F.lit("xx").alias("lang"))
    return C.upsert(docs.filter("doc_id % 3 <> 0"), incoming, "doc_id", "hash").select("doc_id", "lang", "action")


@query("s08_latest_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def s08(spark, d):
    return C.latest_wins(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("s11_report_sink", "SELECT 'r1' AS report_id, count(*) AS findings, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 3) AS confidence FROM events")
def s11(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"), F.col("value").alias("confidence"))
    return C.report_sinks(rows, "r1")[0]


@query("s16_migrations", "SELECT version, CASE WHEN version = 3 THEN 'gap' WHEN version > 5 THEN 'pending' WHEN version = 2 THEN 'changed' ELSE 'applied' END AS status FROM range(1, 9) t(version)")
def s16(spark, d):
    wanted = spark.range(1, 9).select(F.col("id").alias("version"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("checksum"))
    applied = wanted.filter("version <= 5 and version <> 3").withColumn("checksum", F.when(F.col("version") == 2, "x").otherwise(F.col("checksum")))
    return C.migrations(applied, wanted)


@query("s17_delete", "SELECT doc_id FROM documents WHERE NOT coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 0), false)")
def s17(spark, d):
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, d, "documents").select("doc_id").join(marks, "doc_id", "left")
    return C.delete_where(rows, F.col("quality") == 0).select("doc_id")


@query("s03_parametrised_sql", "SELECT event_id FROM events WHERE user_id = 7 AND value > 50")
def s03(spark, d):
    table(spark, d, "events").createOrReplaceTempView("tessella_events")
    return C.run_sql(spark, "SELECT event_id FROM tessella_events WHERE user_id = :user AND value > :least", user=7, least=50)


@query("s18_columns", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM events)")
def s18(spark, d):
    return spark.createDataFrame([(n,) for n, _ in C.table_columns(table(spark, d, "events"))], "name string")


@query("t01_messages", "SELECT user_id AS stream_id, string_agg(substr(event_type, 1, 2), '' ORDER BY event_id) AS text, false AS done FROM events GROUP BY user_id")
def t01(spark, d):
    tokens = S.event_stream(spark, f"{d}/events.parquet*").select(F.col("user_id").cast("long").alias("stream_id"), F.col("event_id").alias("seq"), F.substring("event_type", 1, 2).alias("token"), F.lit(False).alias("final"))
    out = S.drained(S.messages(tokens), _name("messages"), "update")
    return out.groupBy("stream_id").agg(F.max_by("text", F.length("text")).alias("text"), F.max_by("done", F.length("text")).alias("done"))


@query("t01_final_messages", "SELECT user_id AS stream_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'pu' ELSE string_agg(substr(event_type, 1, 2), '' ORDER BY event_id) END AS text, bool_or(event_type = 'purchase') AS done FROM events GROUP BY user_id")
def t01b(spark, d):
    """A purchase is a final token: it takes the place of what was streamed."""
    kind = F.col("event_type")
    tokens = S.event_stream(spark, f"{d}/events.parquet*").select(F.col("user_id").cast("long").alias("stream_id"), F.col("event_id").alias("seq"), F.substring("event_type", 1, 2).alias("token"), (kind == "purchase").alias("final"))
    out = S.drained(S.messages(tokens), _name("finals"), "update")
    return out.groupBy("stream_id").agg(F.max_by("text", F.struct("done", F.length("text"))).alias("text"), F.max("done").alias("done"))
