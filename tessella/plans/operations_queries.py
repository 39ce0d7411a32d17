"""Lifecycle, reconciliation, metric and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import fingerprint
from tessella.operators import conversation as N
from tessella.operators import lifecycle as L
from tessella.operators import metrics as M
from tessella.operators import reconcile as Q
from tessella.operators import retrieval as T
from tessella.plans import inputs as I
from tessella.plans.inputs import table, with_
from tessella.plans.registry import query

_FP = "'sha256:v1:' || sha256(text)"
_JOBS = """jobs AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'retry_wait' WHEN 'error' THEN 'quarantined' WHEN 'view' THEN 'leased' ELSE 'synced' END AS state,
 (event_id % 4)::INT AS used, 3 AS budget, ts AS created_at, CASE WHEN event_type = 'click' THEN ts END AS next_at, ts AS lease_until FROM events)"""
_AT = "TIMESTAMP '2024-01-15 00:00:00'"


def _jobs(spark, d):
    kind = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "click", "retry_wait").when(F.col("event_type") == "error", "quarantined").when(F.col("event_type") == "view", "leased").otherwise("synced")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), kind.alias("state"), (F.col("event_id") % 4).cast("int").alias("used"), F.lit(3).alias("budget"), F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "click", F.col("ts")).alias("next_at"), F.col("ts").alias("lease_until"), F.lit("w1").alias("owner"), F.lit(1).alias("generation"),
    )




def _at():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")


@query("l01_seed_jobs", f"SELECT doc_id AS id, {_FP} AS fingerprint, 'pending' AS state, 0 AS used, 3 AS budget, 1 AS generation FROM documents")
def l01(spark, d):
    return L.seed_jobs(table(spark, d, "documents"), "doc_id", "text")


@query("l02_source_changes", f"""WITH j AS (SELECT doc_id AS id, {_FP} AS fp, doc_id % 3 AS used FROM documents WHERE doc_id % 5 <> 0),
 s AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE {_FP} END AS fp FROM documents WHERE doc_id % 11 <> 0)
 SELECT coalesce(j.id, s.id) AS id, CASE WHEN j.id IS NULL THEN 'new' WHEN s.id IS NULL THEN 'orphan' WHEN j.fp <> s.fp THEN 'reset' ELSE 'same' END AS change,
 CASE WHEN j.id IS NULL OR (s.id IS NOT NULL AND j.fp <> s.fp) THEN 'pending' ELSE 'synced' END AS state, CASE WHEN j.id IS NULL OR (s.id IS NOT NULL AND j.fp <> s.fp) THEN 0 ELSE used END AS used,
 CASE WHEN j.id IS NOT NULL AND s.id IS NOT NULL AND j.fp <> s.fp THEN 2 ELSE 1 END AS generation FROM j FULL JOIN s ON j.id = s.id""")
def l02(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), fingerprint("text").alias("fingerprint"))
    jobs = docs.filter("id % 5 <> 0").select("id", "fingerprint", F.lit("synced").alias("state"), (F.col("id") % 3).cast("int").alias("used"), F.lit(3).alias("budget"), F.lit(1).alias("generation"))
    sources = docs.filter("id % 11 <> 0").withColumn("fingerprint", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("fingerprint")))
    return L.apply_sources(jobs, sources).select("id", "change", "state", "used", "generation")


@query("l03_claim", f"""WITH {_JOBS} SELECT id, 'leased' AS state, used + 1 AS attempt, {_AT} + INTERVAL 300 SECOND AS lease_until FROM jobs WHERE (state = 'pending' OR (state = 'retry_wait' AND next_at <= {_AT})) AND used < budget
 ORDER BY CASE jobs.state WHEN 'retry_wait' THEN 0 ELSE 1 END, coalesce(next_at, created_at), id LIMIT 25""")
def l03(spark, d):
    return L.claim(_jobs(spark, d), _at(), 25, 300, "w2").select("id", "state", "attempt", "lease_until")


@query("l04_heartbeat", f"WITH {_JOBS} SELECT id, CASE WHEN state = 'leased' AND lease_until > {_AT} THEN {_AT} + INTERVAL 60 SECOND ELSE lease_until END AS lease_until FROM jobs")
def l04(spark, d):
    return L.heartbeat(_jobs(spark, d), "w1", _at(), 60).select("id", "lease_until")


@query("l07_transitions", """WITH a AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'retry' WHEN 'click' THEN 'pause_systemic' WHEN 'error' THEN 'quarantine' WHEN 'signup' THEN 'cancel' ELSE 'shutdown' END AS d, event_id % 5 AS used FROM events)
 SELECT id, CASE d WHEN 'retry' THEN CASE WHEN used < 3 THEN 'retry_wait' ELSE 'quarantined' END WHEN 'pause_systemic' THEN 'paused_systemic' WHEN 'quarantine' THEN 'quarantined' WHEN 'cancel' THEN 'cancelled' ELSE 'shutdown' END AS outcome,
 CASE WHEN d = 'quarantine' OR (d = 'retry' AND used >= 3) THEN 'quarantined' ELSE 'retry_wait' END AS state, d IN ('retry', 'quarantine') AS consumes FROM a""")
def l07(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "view", "retry").when(e == "click", "pause_systemic").when(e == "error", "quarantine").when(e == "signup", "cancel").otherwise("shutdown")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("disposition"), (F.col("event_id") % 5).alias("used"), F.lit(3).alias("budget"))
    return L.transitions(rows).select("id", "outcome", "state", "consumes")


@query("l08_recover_expired", f"WITH {_JOBS} SELECT id, CASE WHEN state = 'leased' AND lease_until <= {_AT} AND used >= budget THEN 'quarantined' WHEN state = 'leased' AND lease_until <= {_AT} THEN 'retry_wait' ELSE state END AS state FROM jobs")
def l08(spark, d):
    return L.recover_expired(_jobs(spark, d), _at()).select("id", "state")


@query("l09_retry_quarantined", f"WITH {_JOBS} SELECT id, CASE WHEN state = 'quarantined' AND used = 1 THEN 'pending' ELSE state END AS state, CASE WHEN state = 'quarantined' AND used = 1 THEN 2 ELSE 1 END AS generation FROM jobs")
def l09(spark, d):
    jobs = _jobs(spark, d)
    return L.retry_quarantined(jobs, jobs.filter("state = 'quarantined' and used = 1").select("id")).select("id", "state", "generation")


@query("l06_verified", """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'lease_expired' WHEN value > 80 THEN 'source_changed' WHEN event_id % 3 <= 1 AND event_id % 2 <> 0 AND event_id % 5 < 3 AND (event_id % 7 = 0 OR event_id % 11 <> 0) THEN 'verified' ELSE 'rejected' END AS result FROM events""")
def l06(spark, d):
    i = F.col("event_id")
    one = lambda bad: F.when(bad, 0).otherwise(1)
    counts = {"candidate": one(i % 3 == 2), "stable_id": i % 2, "source_description": one(i % 5 == 3), "source_fingerprint": one(i % 5 == 4) * 1, "sync_profile": one(i % 3 == 2), "exact": one(i % 2 == 0), "embedding_profile": F.when(i % 11 == 0, 2).otherwise(1)}
    result = L.verified(counts, F.when(i % 7 != 0, "profile"), F.when(F.col("value") > 80, "b").otherwise("a"), F.lit("a"), F.col("event_type") == "error")
    return table(spark, d, "events").select(i.alias("id"), result.alias("result"))


@query("l11_failures", """SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'malformed_json' WHEN s = 401 THEN 'authentication' WHEN s = 429 THEN 'rate_limit' WHEN s IN (409, 503) THEN 'transport' WHEN event_type = 'view' THEN 'transport' WHEN s = 404 THEN 'configuration' ELSE 'internal' END AS class,
 CASE WHEN event_type = 'click' THEN 'malformed_model_output' WHEN s = 401 THEN 'provider_authentication' WHEN s = 429 THEN 'provider_rate_limit' WHEN s IN (409, 503) THEN 'provider_http_transient' WHEN event_type = 'view' THEN 'provider_transport' WHEN s = 404 THEN 'provider_request_rejected' ELSE 'unclassified_runtime_error' END AS code,
 CASE WHEN event_type = 'click' THEN 'retry' WHEN s IN (401, 429) THEN 'pause_systemic' WHEN s IN (409, 503) OR event_type = 'view' THEN 'retry' WHEN s = 404 THEN 'pause_systemic' ELSE 'retry' END AS disposition
 FROM (SELECT *, CASE event_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 409 END AS s FROM events)""")
def l11(spark, d):
    i, e = F.col("event_id") % 9, F.col("event_type")
    status = F.when(i == 0, 401).when(i == 1, 404).when(i == 2, 429).when(i == 3, 503).when(i == 4, 409)
    name = F.when(e == "view", "ReadTimeout").when(e == "click", "JSONDecodeError").otherwise("Oops")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), L.failure(status, name).alias("f")).select("id", "f.class", "f.code", "f.disposition")


@query("l05_numbered_calls", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_number, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 40 AS allowed FROM events")
def l05(spark, d):
    return L.numbered_calls(table(spark, d, "events"), "user_id", ["ts", "event_id"], 40).select("event_id", "call_number", "allowed")


@query("l10_run_states", """SELECT user_id AS run_id, list_reduce(list_prepend('new', list(c ORDER BY ts, event_id)), lambda a, x: CASE
 WHEN x = 'start' AND a IN ('new', 'stopped') THEN 'running' WHEN x = 'pause' AND a = 'running' THEN 'paused' WHEN x = 'resume' AND a = 'paused' THEN 'running'
 WHEN x = 'drain' AND a IN ('running', 'paused') THEN 'draining' WHEN x = 'stop' AND a IN ('running', 'paused', 'draining') THEN 'stopped' ELSE a END) AS state FROM
 (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' WHEN 'error' THEN 'stop' ELSE 'drain' END AS c FROM events) GROUP BY user_id""")
def l10(spark, d):
    e = F.col("event_type")
    command = F.when(e == "signup", "start").when(e == "view", "pause").when(e == "click", "resume").when(e == "error", "stop").otherwise("drain")
    rows = table(spark, d, "events").select((F.col("user_id")).alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), command.alias("command"))
    return L.run_states(rows)


@query("l14_backfill_batches", "SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch, doc_id AS id FROM documents")
def l14(spark, d):
    return L.backfill_batches(table(spark, d, "documents"), "doc_id", 32)


@query("l17_rule_violations", """SELECT 'positive_value' AS rule, event_id AS id FROM events WHERE NOT value > 1 UNION ALL SELECT 'known_type', event_id FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')""")
def l17(spark, d):
    rules = {"positive_value": F.col("value") > 1, "known_type": F.col("event_type").isin("view", "click", "purchase", "signup")}
    return L.rule_violations(table(spark, d, "events"), "event_id", rules)


_Q1 = f"""WITH e AS (SELECT doc_id AS id, {_FP} AS fp, doc_id % 2 = 0 AS synced FROM documents WHERE doc_id % 13 <> 0),
 g AS (SELECT id, count(*) AS copies, min(fp) AS fp FROM (SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE {_FP} END AS fp FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, {_FP} FROM documents WHERE doc_id % 19 = 0) GROUP BY id),
 j AS (SELECT doc_id AS id, CASE WHEN doc_id % 23 = 0 THEN 'odd' WHEN doc_id % 2 = 0 THEN 'synced' ELSE 'pending' END AS state, {_FP} AS fp FROM documents WHERE doc_id % 7 <> 0),
 r AS (SELECT coalesce(e.id, g.id, j.id) AS id, e.fp AS efp, e.synced, g.copies, g.fp AS gfp, j.state, j.fp AS jfp FROM e FULL JOIN g ON e.id = g.id FULL JOIN j ON j.id = coalesce(e.id, g.id)),
 d AS (SELECT *, CASE WHEN state IS NOT NULL THEN state = 'synced' ELSE coalesce(synced, false) END AS done FROM r)
 SELECT id, 'missing_in_graph' AS finding FROM d WHERE efp IS NOT NULL AND done AND copies IS NULL
 UNION ALL SELECT id, 'unexpected_in_graph' FROM d WHERE copies IS NOT NULL AND efp IS NULL
 UNION ALL SELECT id, 'duplicate_in_graph' FROM d WHERE copies > 1
 UNION ALL SELECT id, 'present_but_not_synced' FROM d WHERE efp IS NOT NULL AND copies IS NOT NULL AND NOT done
 UNION ALL SELECT id, 'source_mismatch' FROM d WHERE efp IS NOT NULL AND copies IS NOT NULL AND efp <> gfp
 UNION ALL SELECT id, 'job_without_source' FROM d WHERE state IS NOT NULL AND efp IS NULL
 UNION ALL SELECT id, 'missing_job' FROM d WHERE efp IS NOT NULL AND state IS NULL
 UNION ALL SELECT id, 'job_fingerprint_mismatch' FROM d WHERE efp IS NOT NULL AND state IS NOT NULL AND efp <> jfp
 UNION ALL SELECT id, 'flag_disagreement' FROM d WHERE efp IS NOT NULL AND state IS NOT NULL AND synced <> (state = 'synced')
 UNION ALL SELECT id, 'invalid_state' FROM d WHERE state = 'odd'"""


@query("q01_drift", _Q1)
def q01(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), fingerprint("text").alias("fingerprint"))
    e = docs.filter("id % 13 <> 0").withColumn("synced", F.col("id") % 2 == 0)
    g = docs.filter("id % 3 <> 0").withColumn("fingerprint", F.when(F.col("id") % 17 == 0, "x").otherwise(F.col("fingerprint"))).union(docs.filter("id % 19 = 0"))
    state = F.when(F.col("id") % 23 == 0, "odd").when(F.col("id") % 2 == 0, "synced").otherwise("pending")
    return Q.drift(e, g, docs.filter("id % 7 <> 0").withColumn("state", state))


_AUDIT = f"""e AS (SELECT doc_id::VARCHAR AS id, {_FP} AS fp, doc_id % 2 = 0 AS synced FROM documents WHERE doc_id % 13 <> 0),
 n AS (SELECT CASE WHEN doc_id % 29 = 0 THEN ' ' ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 31 <> 0 THEN 'episode_' || doc_id END AS d, CASE WHEN doc_id % 17 = 0 THEN 'x' WHEN doc_id % 5 <> 0 THEN {_FP} END AS fp, CASE WHEN doc_id % 7 <> 0 THEN 'p' || (doc_id % 2) END AS sp, CASE WHEN doc_id % 11 <> 0 THEN 'v' || (doc_id % 3) END AS ep FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id::VARCHAR, 'episode_' || doc_id, {_FP}, 'p1', NULL FROM documents WHERE doc_id % 19 = 0),
 j AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 23 = 0 THEN 'odd' WHEN doc_id % 4 = 0 THEN 'synced' ELSE 'pending' END AS state, CASE WHEN doc_id % 6 <> 0 THEN {_FP} END AS desired, CASE WHEN doc_id % 8 = 0 THEN {_FP} END AS verified, 'p' || (doc_id % 2) AS sp, CASE WHEN doc_id % 12 <> 0 THEN 'p0' END AS vp, doc_id % 16 <> 0 AS dated FROM documents WHERE doc_id % 7 <> 0),
 g AS (SELECT id, count(*) AS copies FROM n WHERE trim(id) <> '' GROUP BY id),
 b AS (SELECT e.*, j.* EXCLUDE (id), j.id AS jid FROM e JOIN j ON j.id = e.id),
 done AS (SELECT id FROM b WHERE state = 'synced'),
 m AS (SELECT n.*, e.fp AS source FROM n JOIN e ON e.id = n.id),
 f AS (SELECT 'missing_in_graph' AS finding, id, NULL::VARCHAR AS detail FROM done WHERE id NOT IN (SELECT id FROM g)
 UNION ALL SELECT 'unexpected_in_graph', id, NULL FROM g WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT 'duplicate_in_graph', id, copies::VARCHAR FROM g WHERE copies > 1
 UNION ALL SELECT 'present_but_not_synced', id, NULL FROM g WHERE id IN (SELECT id FROM e) AND id NOT IN (SELECT id FROM done)
 UNION ALL SELECT 'null_id_in_graph', NULL, NULL FROM n WHERE trim(id) = ''
 UNION ALL SELECT 'incorrectly_synchronized_job', id, 'job_without_source_episode' FROM j WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT 'incorrectly_synchronized_job', id, 'missing_job' FROM e WHERE id NOT IN (SELECT id FROM j)
 UNION ALL SELECT 'incorrectly_synchronized_job', id, 'invalid_job_state' FROM b WHERE state = 'odd' UNION ALL SELECT 'incorrectly_synchronized_job', id, 'synced_job_legacy_flag_false' FROM b WHERE state = 'synced' AND NOT synced
 UNION ALL SELECT 'incorrectly_synchronized_job', id, 'non_synced_job_legacy_flag_true' FROM b WHERE state <> 'synced' AND synced UNION ALL SELECT 'incorrectly_synchronized_job', id, 'synced_job_missing_verified_at' FROM b WHERE state = 'synced' AND NOT dated
 UNION ALL SELECT 'stale_job_source_fingerprint', id, desired FROM b WHERE desired IS DISTINCT FROM fp UNION ALL SELECT 'verified_source_fingerprint_mismatch', id, verified FROM b WHERE state = 'synced' AND verified IS DISTINCT FROM fp
 UNION ALL SELECT 'verified_sync_profile_mismatch', id, vp FROM b WHERE state = 'synced' AND vp IS DISTINCT FROM sp UNION ALL SELECT 'job_sync_profile_mismatch', id, sp FROM b WHERE sp <> 'p0'
 UNION ALL SELECT 'source_description_mismatch', id, d FROM m WHERE d IS DISTINCT FROM 'episode_' || id UNION ALL SELECT 'source_fingerprint_mismatch', id, fp FROM m WHERE fp <> source
 UNION ALL SELECT 'sync_profile_mismatch', id, sp FROM m WHERE sp <> 'p0' UNION ALL SELECT 'embedding_profile_mismatch', id, ep FROM m WHERE ep <> 'v0')"""


def _audited(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), fingerprint("text").alias("fp"))
    i, says = F.col("doc_id"), lambda c: F.concat(F.lit(c), "id")
    e = docs.filter("doc_id % 13 <> 0").select("id", F.col("fp").alias("fingerprint"), (i % 2 == 0).alias("synced"))
    n = docs.filter("doc_id % 3 <> 0").select(
        F.when(i % 29 == 0, " ").otherwise(F.col("id")).alias("id"), F.when(i % 31 != 0, says("episode_")).alias("description"), F.when(i % 17 == 0, "x").when(i % 5 != 0, F.col("fp")).alias("fingerprint"),
        F.when(i % 7 != 0, F.concat(F.lit("p"), (i % 2).cast("string"))).alias("sync_profile"), F.when(i % 11 != 0, F.concat(F.lit("v"), (i % 3).cast("string"))).alias("embedding_profile"),
    ).union(docs.filter("doc_id % 19 = 0").select("id", says("episode_"), "fp", F.lit("p1"), F.lit(None).cast("string")))
    j = docs.filter("doc_id % 7 <> 0").select(
        "id", F.when(i % 23 == 0, "odd").when(i % 4 == 0, "synced").otherwise("pending").alias("state"), F.when(i % 6 != 0, F.col("fp")).alias("desired"), F.when(i % 8 == 0, F.col("fp")).alias("verified"),
        F.concat(F.lit("p"), (i % 2).cast("string")).alias("sync_profile"), F.when(i % 12 != 0, "p0").alias("verified_profile"), F.when(i % 16 != 0, F.lit(1)).alias("verified_at"),
    )
    return e, n, j


@query("q01_audit", f"WITH {_AUDIT} SELECT * FROM f")
def q01b(spark, d):
    return Q.audit(*_audited(spark, d), "p0", "v0")


@query("q01_audit_summary", f"""WITH {_AUDIT} SELECT (SELECT count(*) FROM e) AS source_total, (SELECT count(*) FROM done) AS source_synced, (SELECT count(*) FROM e) - (SELECT count(*) FROM done) AS source_non_synced, (SELECT count(*) FROM n) AS graph_total,
 (SELECT count(*) FROM n WHERE trim(id) <> '') AS graph_populated, (SELECT count(*) FROM g) AS graph_distinct, (SELECT count(fp) FROM m) AS node_fingerprint, (SELECT count(sp) FROM m) AS node_sync_profile, (SELECT count(ep) FROM m) AS node_embedding_profile,
 """ + ", ".join(f"(SELECT count(*) FROM j WHERE state = '{s}') AS state_{s}" for s in Q.STATES) + ", " + ", ".join(f"(SELECT count({c}) FROM b) AS job_{k}" for k, c in (("desired", "desired"), ("verified", "verified"), ("sync_profile", "sp"))) + ", (SELECT count(*) FROM f) AS findings, 'drift' AS status")
def q01c(spark, d):
    rows = _audited(spark, d)
    return Q.audit_summary(*rows, Q.audit(*rows, "p0", "v0"))


_FACTS = """facts AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'error') // 4 AS quarantined, user_id % 3 % 2 AS expired, CASE WHEN user_id % 4 <> 0 THEN 2 END AS baseline, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'paused_systemic' ELSE 'running' END AS run_state, CASE WHEN user_id % 6 <> 0 THEN 'p' || (user_id % 2) END AS run_profile,
 count(*) FILTER (WHERE event_type = 'view') AS attempts, count(*) FILTER (WHERE event_type = 'view' AND value > 70) AS retrying, count(*) FILTER (WHERE event_type = 'click') AS calls, count(*) FILTER (WHERE event_type = 'click' AND value > 80) AS failures,
 CASE user_id % 7 WHEN 0 THEN 'no_runs' WHEN 1 THEN 'broken' ELSE 'available' END AS quality, user_id % 8 AS missing, user_id % 9 = 0 AS mixed, CASE user_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'drift' ELSE 'partial' END AS audit, user_id % 4 AS drift, user_id % 2 AS profile_drift,
 CASE WHEN user_id % 10 = 0 THEN 'blocked' ELSE 'ready' END AS embedding, user_id % 11 = 0 AS codes FROM events GROUP BY user_id),
 alerts AS (SELECT id, 'quarantined_jobs_present' AS code, 'critical' AS severity, quarantined::VARCHAR AS observed FROM facts WHERE quarantined > 0 UNION ALL SELECT id, 'expired_leases_present', 'critical', expired::VARCHAR FROM facts WHERE expired > 0
 UNION ALL SELECT id, 'quarantined_jobs_growing', 'critical', quarantined::VARCHAR FROM facts WHERE quarantined > baseline UNION ALL SELECT id, 'active_sync_profile_mismatch', 'critical', coalesce(run_profile, '') FROM facts WHERE run_state IS NOT NULL AND run_profile IS DISTINCT FROM 'p0'
 UNION ALL SELECT id, 'run_paused_systemic', 'critical', run_state FROM facts WHERE run_state = 'paused_systemic' UNION ALL SELECT id, 'retry_storm', 'warning', NULL FROM facts WHERE attempts >= 5 AND round(100.0 * retrying / attempts, 3) >= 25
 UNION ALL SELECT id, 'sustained_provider_failure', 'warning', 'one' FROM facts WHERE calls >= 5 AND round(100.0 * failures / calls, 3) >= 25 UNION ALL SELECT id, 'sustained_provider_failure', 'warning', 'two' FROM facts WHERE attempts >= 5 AND round(100.0 * retrying / attempts, 3) >= 25
 UNION ALL SELECT id, 'relationship_quality_evidence_incomplete', 'critical', missing::VARCHAR FROM facts WHERE quality = 'available' AND missing > 0 UNION ALL SELECT id, 'relationship_vocabulary_mixed', 'critical', 'true' FROM facts WHERE quality = 'available' AND mixed
 UNION ALL SELECT id, 'relationship_quality_unavailable', 'critical', quality FROM facts WHERE quality = 'broken' UNION ALL SELECT id, 'graph_audit_drift', 'critical', drift::VARCHAR FROM facts WHERE audit = 'drift' OR drift > 0
 UNION ALL SELECT id, 'graph_audit_incomplete', 'critical', audit FROM facts WHERE audit = 'partial' AND drift = 0 UNION ALL SELECT id, 'graph_profile_mismatch', 'critical', profile_drift::VARCHAR FROM facts WHERE profile_drift > 0
 UNION ALL SELECT id, 'embedding_profile_mismatch', 'critical', 'dimension_mismatch,profile_unknown' FROM facts WHERE codes UNION ALL SELECT id, 'embedding_preflight_blocked', 'critical', embedding FROM facts WHERE embedding <> 'ready')"""


def _facts(spark, d):
    u = F.col("id")
    n = lambda kind, over=-1: F.count_if((F.col("event_type") == kind) & (F.col("value") > over))
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.floor(n("error") / 4).alias("quarantined"), n("view").alias("completed_attempts"), n("view", 70).alias("retrying"), n("click").alias("calls"), n("click", 80).alias("failures"))
    pair = lambda name, a, b: F.struct(F.lit(name).alias("name"), F.col(a).alias("completed"), F.col(b).alias("failures"))
    return rows.withColumns({
        "expired_leases": u % 3 % 2, "baseline_quarantined": F.when(u % 4 != 0, 2), "run_state": F.when(u % 5 == 1, "paused_systemic").when(u % 5 != 0, "running"), "run_profile": F.when(u % 6 != 0, F.concat(F.lit("p"), (u % 2).cast("string"))),
        "candidates": F.array(pair("one", "calls", "failures"), pair("two", "completed_attempts", "retrying")), "quality_status": F.when(u % 7 == 0, "no_runs").when(u % 7 == 1, "broken").otherwise("available"), "missing_attempts": u % 8, "mixed_vocabulary": u % 9 == 0,
        "audit_status": F.when(u % 3 == 0, "clean").when(u % 3 == 1, "drift").otherwise("partial"), "drift_findings": u % 4, "profile_drift": u % 2, "embedding_status": F.when(u % 10 == 0, "blocked").otherwise("ready"),
        "embedding_codes": F.when(u % 11 == 0, F.array(F.lit("profile_unknown"), F.lit("dimension_mismatch"), F.lit("other"))).otherwise(F.array(F.lit("other"))),
    })


@query("q07_alerts", f"WITH {_FACTS} SELECT id, code, severity, CASE WHEN code <> 'retry_storm' THEN observed END AS observed FROM alerts")
def q07b(spark, d):
    out = Q.operational_alerts(_facts(spark, d), "p0")
    return out.withColumn("observed", F.when(F.col("code") != "retry_storm", F.col("observed")))  # a percentage, written differently by engines


@query("q07_status", f"WITH {_FACTS}, n AS (SELECT id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning FROM alerts GROUP BY id) SELECT facts.id, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, CASE WHEN coalesce(critical, 0) > 0 THEN 'blocked' WHEN coalesce(warning, 0) > 0 THEN 'degraded' ELSE 'ready' END AS status FROM facts LEFT JOIN n ON n.id = facts.id")
def q07c(spark, d):
    facts = _facts(spark, d)
    return Q.operational_status(facts, Q.operational_alerts(facts, "p0"))


@query("q03_run_summary", with_("attempts") + """SELECT run_id, count(*) AS attempts, count(DISTINCT episode_id) AS episodes, count(*) FILTER (WHERE outcome = 'error') AS failures,
 round(quantile_cont(latency, 0.95) FILTER (WHERE outcome <> 'error'), 6) AS p95, round(sum(latency) FILTER (WHERE outcome = 'error'), 4) AS lost, count(latency) FILTER (WHERE outcome = 'error') AS reported, max(completed_at) AS last FROM attempts GROUP BY run_id""")
def q03(spark, d):
    return Q.run_summary(I.attempts(spark, d))


@query("q03_failure_matrix", with_("attempts") + "SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("view", "click", "error")) + " FROM attempts GROUP BY run_id")
def q03b(spark, d):
    return Q.failure_matrix(I.attempts(spark, d), ["view", "click", "error"])


@query("q04_progress", """WITH c AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'signup' AND value > 60) AS pending, 0 AS leased, 0 AS retry_wait, count(*) FILTER (WHERE event_type = 'click' AND value > 97) AS quarantined, count(*) FILTER (WHERE event_type = 'view') AS synced,
 CASE WHEN user_id % 5 = 0 THEN 'paused_systemic' WHEN user_id % 7 = 0 THEN 'stopped' ELSE 'running' END AS run_state, user_id % 4 * 100 AS "window", user_id % 3 AS recent FROM events GROUP BY user_id),
 s AS (SELECT *, pending + quarantined AS todo, pending + quarantined + synced AS total, CASE WHEN "window" > 0 THEN recent * 60.0 / "window" ELSE 0 END AS r FROM c),
 t AS (SELECT *, CASE WHEN todo = 0 THEN 'complete' WHEN run_state = 'paused_systemic' THEN 'paused_systemic' WHEN quarantined > 0 THEN 'blocked_quarantine' WHEN run_state = 'stopped' THEN 'stopped' WHEN "window" < 60 THEN 'warming_up' WHEN r <= 0 THEN 'insufficient_progress' ELSE 'available' END AS eta_status FROM s)
 SELECT id, CASE WHEN total = 0 THEN 100.0 ELSE round(synced * 100.0 / total, 3) END AS percent, eta_status, CASE eta_status WHEN 'complete' THEN 0 WHEN 'available' THEN ceil(todo * 60.0 / r) END AS eta_seconds FROM t""")
def q04(spark, d):
    n = lambda k, v: F.count_if((F.col("event_type") == k) & (F.col("value") > v))
    u = F.col("user_id")
    rows = table(spark, d, "events").groupBy("user_id").agg(n("signup", 60).alias("pending"), F.lit(0).alias("leased"), F.lit(0).alias("retry_wait"), n("click", 97).alias("quarantined"), F.count_if(F.col("event_type") == "view").alias("synced"))
    rows = rows.withColumns({"run_state": F.when(u % 5 == 0, "paused_systemic").when(u % 7 == 0, "stopped").otherwise("running"), "window": u % 4 * 100, "recent": u % 3})
    return Q.progress(rows).select(F.col("user_id").alias("id"), "percent", "eta_status", "eta_seconds")


@query("q06_attempt_chain", with_("attempts") + """SELECT episode_id, array_to_string(list(attempt_id || ':' || outcome ORDER BY completed_at, attempt_id), ',') AS chain FROM (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY completed_at DESC, attempt_id DESC) <= 5) GROUP BY episode_id""")
def q06(spark, d):
    one = lambda x: F.concat(x["attempt_id"].cast("string"), F.lit(":"), x["outcome"])
    return Q.attempt_chain(I.attempts(spark, d)).select("episode_id", F.array_join(F.transform("chain", one), ",").alias("chain"))


@query("q07_readiness", """WITH c AS (SELECT 'errors' AS code, count(*) FILTER (WHERE event_type = 'error') AS value, 10 AS "limit", 'warning' AS severity FROM events UNION ALL SELECT 'missing', count(*) FILTER (WHERE value IS NULL), 0, 'critical' FROM events UNION ALL SELECT 'large', count(*) FILTER (WHERE value > 99), 1, 'warning' FROM events)
 SELECT 'degraded' AS verdict, code, severity FROM c WHERE value > "limit" """)
def q07(spark, d):
    e = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value") > 99).alias("large"))
    rows = e.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("value"), F.lit(m).alias("limit"), F.lit(s).alias("severity")) for c, m, s in (("errors", 10, "warning"), ("missing", 0, "critical"), ("large", 1, "warning"))))).alias("x"))
    return Q.readiness(rows.select("x.*"))


@query("q09_field_differences", """SELECT c_custkey AS id, 'segment' AS field, c_mktsegment AS expected, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS actual FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR FROM customer WHERE c_custkey % 4 = 0""")
def q09(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    right = left.select("id", F.when(F.col("id") % 5 != 0, F.col("segment")).alias("segment"), (F.col("nation") + F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("nation"))
    return Q.field_differences(left, right, "id", ["segment", "nation"])


@query("q10_vector_coverage", """SELECT count(v.id) AS stored, count(*) FILTER (WHERE s.fp = v.fp) AS current, count(*) FILTER (WHERE s.fp <> v.fp) AS stale, count(*) FILTER (WHERE v.id IS NULL) AS missing, count(*) FILTER (WHERE s.id IS NULL) AS orphaned FROM
 (SELECT doc_id AS id, sha256(text) AS fp FROM documents WHERE doc_id % 9 <> 0) s FULL JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS fp FROM documents WHERE doc_id % 10 <> 1) v ON s.id = v.id""")
def q10(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"))
    stored = docs.filter("id % 10 <> 1").withColumn("fingerprint", F.when(F.col("id") % 4 == 0, "old").otherwise(F.col("fingerprint")))
    return Q.coverage(stored, docs.filter("id % 9 <> 0"))


@query("q11_snapshot_identity", "SELECT count(*) AS rows, " + ", ".join(f"sum(('0x' || substr(sha256(doc_id || ':' || sha256(text)), {1 + 8 * i}, 8))::BIGINT) AS h{i}" for i in range(4)) + " FROM documents")
def q11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    return Q.snapshot_identity(docs, "doc_id", "fp")


@query("q13_corpus_statistics", "SELECT lang, count(*) AS documents, count(l.doc_id) AS labelled, round(avg(n_chars), 4) AS mean_chars, max(n_chars) AS longest FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def q13(spark, d):
    marks = table(spark, d, "labels").select("doc_id").distinct().withColumn("l", F.lit(1))
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(marks, "doc_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count("l").alias("labelled"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.max("n_chars").alias("longest")
    )


@query("q14_temporal_order", "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (ORDER BY CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END NULLS LAST, o_orderkey)")
def q14(spark, d):
    dated = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    return Q.temporal_order(table(spark, d, "orders"), dated, ["o_orderkey"]).select("o_orderkey", "previous", "following")


_SPELT = ["OpposedTo", "opposed-to", "OPPOSED_TO", "likes", "opposedto", " Opposed.To", "tradesWith", "trades -- with", "Trades.With!", "TradesWith"]


@query("q15_proposal_policy", f"""WITH p AS (SELECT event_id AS id, event_id AS pos, 'Customer#' || (user_id % 40) AS source, 'Customer#' || (event_id % 45) AS target, ({_SPELT})[1 + event_id % {len(_SPELT)}] AS type, CASE WHEN value < 5 THEN '' ELSE 'fact ' || event_type END AS fact FROM events),
 c AS (SELECT DISTINCT c_custkey % 43 AS k FROM customer), n AS (SELECT 'Customer#' || k AS name, CASE WHEN k IN (3, 8) THEN 2 ELSE 1 END AS n, k // 2 AS node FROM c),
 t AS (SELECT *, trim(upper(regexp_replace(regexp_replace(trim(type), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_') AS token FROM p),
 j AS (SELECT t.*, coalesce(a.n, 0) AS ns, coalesce(b.n, 0) AS nt, a.node AS sid, b.node AS tid, CASE token WHEN 'OPPOSED_TO' THEN 'OpposedTo' WHEN 'TRADES_WITH' THEN 'TradesWith' END AS kind FROM t LEFT JOIN n a ON a.name = source LEFT JOIN n b ON b.name = target),
 r AS (SELECT *, CASE WHEN least(ns, nt) = 0 THEN 'missing_endpoint' WHEN greatest(ns, nt) > 1 THEN 'ambiguous_endpoint' WHEN sid = tid THEN 'self_edge' WHEN fact = '' THEN 'empty_fact' WHEN kind IS NULL THEN 'unknown_type' END AS reason FROM j),
 f AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, sid, tid, kind, lower(fact) ORDER BY pos, id) > 1 THEN 'duplicate' ELSE reason END AS final FROM r)
 SELECT id, coalesce(final, CASE WHEN kind = type THEN 'accepted' ELSE 'normalized' END) AS decision, kind FROM f""")
def q15(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _SPELT)), (F.col("event_id") % len(_SPELT) + 1).cast("int"))
    name = lambda c, m: F.concat(F.lit("Customer#"), (F.col(c) % m).cast("string"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("pos"), name("user_id", 40).alias("source"), name("event_id", 45).alias("target"), kind.alias("type"), F.when(F.col("value") < 5, "").otherwise(F.concat(F.lit("fact "), "event_type")).alias("fact"))
    # Two names for each node, and two nodes for two of the names.
    one = table(spark, d, "customer").select(name("c_custkey", 43).alias("name"), F.floor(F.col("c_custkey") % 43 / 2).cast("string").alias("id")).distinct()
    nodes = one.union(one.filter("name in ('Customer#3', 'Customer#8')").withColumn("id", F.concat(F.lit("x"), "id")))
    return Q.proposal_policy(rows, nodes, ["OpposedTo", "TradesWith"])


_CASES = """j AS (SELECT doc_id % 12 AS case_id, doc_id, 1 + quality * 2 AS grade FROM labels), r AS (SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY (doc_id * 7919) % 1009, doc_id) AS rank FROM (SELECT doc_id % 12 AS case_id, doc_id FROM documents)),
 h AS (SELECT j.*, rank FROM j LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r USING (case_id, doc_id)),
 o AS (SELECT case_id, count(*) AS judged, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, min(rank) AS first_rank, coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)), 0) AS dcg FROM h GROUP BY 1),
 i AS (SELECT case_id, sum((pow(2, grade) - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, doc_id) AS p FROM j) WHERE p <= 10 GROUP BY 1),
 s AS (SELECT case_id, h5 / judged AS recall_5, h10 / judged AS recall_10, first_rank, coalesce(1.0 / first_rank, 0) AS rr, coalesce(dcg / ideal, 0) AS ndcg FROM o JOIN i USING (case_id))"""


def _cases(spark, d):
    j = table(spark, d, "labels").select((F.col("doc_id") % 12).alias("case_id"), "doc_id", (1 + F.col("quality") * 2).alias("grade"))
    docs = table(spark, d, "documents").select((F.col("doc_id") % 12).alias("case_id"), "doc_id")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("case_id").orderBy((F.col("doc_id") * 7919) % 1009, "doc_id"))
    return j, docs.withColumn("rank", rank)


_SCORES = "SELECT case_id, round(recall_5, 9) AS recall_5, round(recall_10, 9) AS recall_10, first_rank, round(rr, 9) AS rr, round(ndcg, 9) AS ndcg FROM s"


@query("m03_case_scores", f"WITH {_CASES} {_SCORES}")
def m03(spark, d):
    out = M.case_scores(*_cases(spark, d))
    return out.select("case_id", "first_rank", *(F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "rr", "ndcg")))


_MACRO = "SELECT 15 AS cases, round(sum(recall_5) / 15, 9) AS recall_5, round(sum(recall_10) / 15, 9) AS recall_10, round(sum(rr) / 15, 9) AS rr, round(sum(ndcg) / 15, 9) AS ndcg FROM s"


@query("m04_macro", f"WITH {_CASES} {_MACRO}")
def m04(spark, d):
    cases = spark.range(15).withColumnRenamed("id", "case_id")
    out = M.macro(cases, M.case_scores(*_cases(spark, d)))
    return out.select("cases", *(F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "rr", "ndcg")))


@query("m06_extraction_recall", """WITH e AS (SELECT DISTINCT n_regionkey AS case_id, n_name AS name FROM nation), f AS (SELECT n_regionkey AS case_id, lower(n_name) || '!' AS name FROM nation WHERE n_nationkey % 3 <> 0)
 SELECT case_id, count(*) AS expected, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE hit) / count(*) AS recall FROM (SELECT e.*, EXISTS (SELECT 1 FROM f WHERE f.case_id = e.case_id AND (contains(regexp_replace(lower(e.name), '[^a-z0-9]', '', 'g'), regexp_replace(f.name, '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(f.name, '[^a-z0-9]', '', 'g'), regexp_replace(lower(e.name), '[^a-z0-9]', '', 'g')))) AS hit FROM e) GROUP BY case_id""")
def m06(spark, d):
    n = table(spark, d, "nation")
    found = n.filter("n_nationkey % 3 <> 0").select(F.col("n_regionkey").alias("case_id"), F.concat(F.lower("n_name"), F.lit("!")).alias("name"))
    return M.extraction_recall(n.select(F.col("n_regionkey").alias("case_id"), F.col("n_name").alias("name")), found)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query("n01_mentions", "SELECT conv_id, entity, count(*) AS n, min(turn) AS first, max(turn) AS last FROM (SELECT conv_id, turn, unnest(PHRASES(text)) AS entity FROM conversations) GROUP BY conv_id, entity")
def n01(spark, d):
    from tessella.functions.text import capitalised_phrases

    return N.mentions(table(spark, d, "conversations"), "conv_id", "turn", capitalised_phrases("text"))


@query("n02_recent_entities", "WITH m AS (SELECT conv_id, entity, count(*) AS n, max(turn) AS last FROM (SELECT conv_id, turn, unnest(PHRASES(text)) AS entity FROM conversations) GROUP BY conv_id, entity), g AS (SELECT *, max(last) OVER (PARTITION BY conv_id) - last AS gap FROM m) SELECT conv_id, entity, round(1.0 / (gap + 1) * least(n / 10, 1.0), 9) AS weight FROM g WHERE gap <= 3")
def n02(spark, d):
    from tessella.functions.text import capitalised_phrases

    m = N.mentions(table(spark, d, "conversations"), "conv_id", "turn", capitalised_phrases("text"))
    return N.recent_entities(m, "conv_id").select("conv_id", "entity", F.round("weight", 9).alias("weight"))


@query("n04_topic_shifts", f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w, lag({_WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
 SELECT conv_id, turn, round(coalesce(len(list_intersect(w, p)) / nullif(len(list_distinct(list_concat(w, p))), 0), 0), 9) AS overlap, CASE WHEN p IS NULL OR len(p) = 0 THEN false ELSE len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p))) < 0.3 END AS shift FROM w""")
def n04(spark, d):
    out = N.topic_shifts(table(spark, d, "conversations"), "conv_id", "turn", T.tokens("text"))
    return out.select("conv_id", "turn", F.round("overlap", 9).alias("overlap"), "shift")


@query("n05_exhaustion", """WITH e AS (SELECT user_id, event_id, value / 100 AS s, value > 60 AS rep, floor(value / 10) AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events),
 d AS (SELECT *, s - lag(s) OVER w AS ds, f - lag(f) OVER w AS df FROM e WHERE n <= 10 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 l AS (SELECT user_id, avg(rep::INT) AS r, avg(ds) AS t, avg(df) AS ft, max(CASE WHEN n = 1 THEN s END) AS last FROM d WHERE n <= 3 GROUP BY user_id)
 SELECT user_id, round(CASE WHEN r > 0.5 THEN 0.4 ELSE 0 END + CASE WHEN t < -0.05 THEN 0.3 ELSE 0 END + CASE WHEN ft < -0.5 THEN 0.3 ELSE 0 END + CASE WHEN last < 0.3 THEN 0.2 ELSE 0 END, 6) AS score FROM l""")
def n05(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100).alias("s"), (F.col("value") > 60).cast("int").alias("rep"), F.floor(F.col("value") / 10).alias("f"))
    return N.exhaustion(rows, "user_id", "event_id", "s", "rep", "f").select("user_id", "score")


@query("n06_query_correlation", r"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), p AS (SELECT *, lower(text) AS t,
 list_distinct(PHRASES(text)) AS a, list_distinct(PHRASES(prev)) AS b FROM c),
 s AS (SELECT *, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END AS o FROM p)
 SELECT conv_id, turn, round(CASE WHEN prev IS NULL THEN 0 ELSE greatest(0, least(1, CASE WHEN regexp_matches(t, 'now tell me about|what about|switch to|instead tell me|now about') THEN -0.8 ELSE 0 END
 + CASE WHEN len(list_intersect(regexp_split_to_array(t, '[ \t\n\r\f\x0B]+'), ['that', 'this', 'it', 'they', 'them', 'he', 'she', 'those', 'these'])) > 0 THEN 0.8 WHEN regexp_matches(t, 'tell me more|what else|continue|expand on|also|additionally') THEN 0.5 ELSE 0 END + 0.3 * o)) END, 9) AS score FROM s""")
def n06(spark, d):
    from pyspark.sql import Window

    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("prev", prev)
    return rows.select("conv_id", "turn", F.round(N.correlation(F.col("text"), F.col("prev")), 9).alias("score"))


@query("n09_routes", """WITH m AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Help me' WHEN 1 THEN 'make ' || (user_id % 4) || ' quests please' WHEN 2 THEN 'write ' || (user_id % 4) || ' chapters' WHEN 3 THEN 'create a plan, then describe it' WHEN 4 THEN 'imagine this' WHEN 5 THEN 'a campaign' WHEN 6 THEN 'a dramatic day' ELSE event_type END AS t, user_id % 4 AS k FROM events)
 SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'meta_help' WHEN 1 THEN 'questline_generation' WHEN 2 THEN CASE WHEN k > 1 THEN 'orchestrated' ELSE 'narrative_generation' END WHEN 3 THEN 'orchestrated' WHEN 4 THEN 'story_development' WHEN 5 THEN 'quest_planning' WHEN 6 THEN 'narrative_generation' ELSE 'lore_query' END AS route FROM m""")
def n09(spark, d):
    i, k = F.col("event_id") % 8, (F.col("user_id") % 4).cast("string")
    t = (
        F.when(i == 0, "Help me").when(i == 1, F.concat(F.lit("make "), k, F.lit(" quests please"))).when(i == 2, F.concat(F.lit("write "), k, F.lit(" chapters")))
        .when(i == 3, "create a plan, then describe it").when(i == 4, "imagine this").when(i == 5, "a campaign").when(i == 6, "a dramatic day").otherwise(F.col("event_type"))
    )
    return table(spark, d, "events").select("event_id", N.route(t)[0].alias("route"))


@query("n13_limited_state", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE a <= 2 OR b <= 3")
def n13(spark, d):
    return N.limited_state(table(spark, d, "conversations"), "conv_id", "turn", 2, 3).select("conv_id", "turn")


@query("n14_conversation_list", """SELECT conv_id, CASE WHEN length(t) <= 50 THEN t WHEN contains(substr(t, 1, 50), ' ') THEN regexp_replace(substr(t, 1, 50), ' [^ ]*$', '') || '...' ELSE substr(t, 1, 50) || '...' END AS title, messages, last_turn FROM
 (SELECT conv_id, trim(arg_min(text, turn) FILTER (WHERE role = 'user')) AS t, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id)""")
def n14(spark, d):
    return N.conversation_list(table(spark, d, "conversations"), "conv_id", "turn")
