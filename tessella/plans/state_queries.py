"""Shadow spaces, rebuild guards, content-free reports, timers, maintained
views, table functions, arbitration, keyed state and tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import tables as U
from tessella.functions import tokens as K
from tessella.operators import lifecycle as L
from tessella.operators import maintained as D
from tessella.operators import projection as P
from tessella.operators import rebuild as B
from tessella.operators import shadow as H
from tessella.operators.graph import shared_folder
from tessella.plans.inputs import table
from tessella.plans.registry import query
from tessella.sources import snapshots as N
from tessella.streaming import jobs as S
from tessella.streaming import timers as T


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


# -- shadow spaces ------------------------------------------------------------
# Sources are the documents; vectors are those of ``embeddings``, half of them of
# an older text. While the batches are with the model, the documents of low
# quality are edited and the toxic ones are deleted. The model fails on a text
# with over 16,000 characters where that is asked for.
_SIZE, _REQUESTS = 25, 100
_SHADOW = f"""src AS (SELECT doc_id AS id, sha256(text) AS fingerprint, n_chars, lang FROM documents), held AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN s.fingerprint ELSE 'old' END AS fingerprint, label FROM embeddings JOIN src s ON s.id = vec_id),
 marks AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
 later AS (SELECT id, CASE WHEN quality = 0 THEN 'edited' ELSE fingerprint END AS fingerprint FROM src LEFT JOIN marks ON doc_id = id WHERE coalesce(toxic, 0) = 0),
 wait AS (SELECT src.id, src.fingerprint, n_chars, row_number() OVER (ORDER BY src.id) - 1 AS n FROM src LEFT JOIN held ON held.id = src.id WHERE held.fingerprint IS DISTINCT FROM src.fingerprint),
 item AS MATERIALIZED (SELECT *, n // {_SIZE} + 1 AS ordinal FROM wait WHERE n < {_SIZE * _REQUESTS}),
 seen AS (SELECT ordinal, count(*) AS episodes, bool_or(n_chars > FAILS) AS bad, bool_or(l.fingerprint IS DISTINCT FROM item.fingerprint) AS moved FROM item LEFT JOIN later l ON l.id = item.id GROUP BY ordinal),
 batch AS MATERIALIZED (SELECT ordinal, episodes, CASE WHEN ordinal > (SELECT min(ordinal) FROM seen WHERE bad) THEN 'reserved' WHEN bad THEN 'failed' WHEN moved THEN 'source_changed' ELSE 'succeeded' END AS state FROM seen)"""


def _shadow(spark, d, fails=None):
    docs = table(spark, d, "documents")
    sources = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"))
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "id")
    later = sources.join(marks, "id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0).select("id", F.when(F.col("quality") == 0, "edited").otherwise(F.col("fingerprint")).alias("fingerprint"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label").join(sources, "id")
    held = vectors.withColumn("fingerprint", F.when(F.col("label") < 5, F.col("fingerprint")).otherwise("old"))
    size = F.col("n_chars").cast("double")
    vector = F.array(size, size / 2) if fails is None else F.when(F.col("n_chars") <= fails, F.array(size, size / 2))
    made = docs.select(F.col("doc_id").alias("id"), vector.alias("embedding"))
    return sources, later, held, made


def _ran(spark, d, fails=None):
    sources, later, held, made = _shadow(spark, d, fails)
    reserved = H.reserve(H.pending(sources, held), sources, _SIZE, _REQUESTS)
    return sources, later, held, made, reserved, H.finalize(reserved, made, later, 2)


@query("l13_shadow_batches", f"WITH {_SHADOW.replace('FAILS', '16000')} SELECT ordinal::INT AS ordinal, episodes, state, CASE WHEN state = 'failed' THEN 'provider_request_failed' END AS failure_code FROM batch")
def l13a(spark, d):
    return _ran(spark, d, 16_000)[-1]


@query("l13_shadow_recovered", f"WITH {_SHADOW.replace('FAILS', '16000')} SELECT ordinal::INT AS ordinal, CASE state WHEN 'reserved' THEN 'abandoned' ELSE state END AS state, CASE state WHEN 'reserved' THEN 'operator_recovery' WHEN 'failed' THEN 'provider_request_failed' END AS failure_code FROM batch")
def l13b(spark, d):
    return H.recover(_ran(spark, d, 16_000)[-1]).select("ordinal", "state", "failure_code")


@query("l14_shadow_backfill", f"""WITH {_SHADOW.replace('FAILS', '1e18')}, new AS (SELECT id, fingerprint FROM item JOIN batch USING (ordinal) WHERE state = 'succeeded')
 SELECT id, fingerprint, 2 AS width FROM new UNION ALL SELECT id, fingerprint, 64 FROM held WHERE id NOT IN (SELECT id FROM new)""")
def l14b(spark, d):
    _, _, held, made, reserved, batches = _ran(spark, d)
    return H.store(held, reserved, batches, made).select("id", "fingerprint", F.size("embedding").alias("width"))


@query("l14_shadow_run", f"""WITH {_SHADOW.replace('FAILS', '1e18')}, new AS (SELECT id, fingerprint FROM item JOIN batch USING (ordinal) WHERE state = 'succeeded'),
 v AS (SELECT id, fingerprint FROM new UNION ALL SELECT id, fingerprint FROM held WHERE id NOT IN (SELECT id FROM new)),
 c AS (SELECT count(*) AS n FROM v JOIN later l ON l.id = v.id AND l.fingerprint = v.fingerprint)
 SELECT 'stopped' AS state, 'source_snapshot_changed' AS failure_code, (SELECT count(*) FROM batch) AS reserved, (SELECT count(*) FROM batch) AS succeeded, (SELECT count(*) FROM src) AS target, (SELECT n FROM c) AS stored""")
def l14c(spark, d):
    sources, later, held, made, reserved, batches = _ran(spark, d)
    return H.run_report(batches, sources, later, H.store(held, reserved, batches, made))


@query("q10_space_findings", f"""WITH {_SHADOW.replace('FAILS', '1e18')}, v AS (SELECT label AS space, count(*) AS stored, count(*) FILTER (WHERE l.fingerprint = held.fingerprint) AS current FROM held LEFT JOIN later l ON l.id = held.id GROUP BY label),
 s AS (SELECT DISTINCT label AS space, CASE WHEN label % 5 = 1 THEN 'retired' WHEN label % 2 = 0 THEN 'ready' ELSE 'backfilling' END AS state FROM embeddings)
 SELECT space, coalesce(stored, 0) AS stored, coalesce(current, 0) AS current, coalesce(stored - current, 0) AS stale, array_to_string(list_sort(list_filter([CASE WHEN state = 'retired' THEN 'shadow_space_retired' END, CASE WHEN stored > current THEN 'shadow_source_stale' END,
   CASE WHEN coalesce(current, 0) <> (SELECT count(*) FROM later) THEN 'shadow_coverage_incomplete' END, CASE WHEN state = 'ready' AND (SELECT count(*) FROM later) <> (SELECT count(*) FROM src) THEN 'shadow_snapshot_mismatch' END,
   CASE WHEN state = 'ready' AND space <> (SELECT count(*) FROM later) THEN 'shadow_ready_count_mismatch' END], lambda x: x IS NOT NULL)), ',') AS findings FROM s LEFT JOIN v USING (space)""")
def q10b(spark, d):
    from tessella.operators.reconcile import snapshot_identity

    sources, later, held, _ = _shadow(spark, d)
    before = snapshot_identity(sources, "id", "fingerprint").select(F.concat_ws(":", "rows", "h0", "h1", "h2", "h3").alias("ready_identity"))
    label = F.col("label")
    spaces = table(spark, d, "embeddings").select(label.alias("space"), F.when(label % 5 == 1, "retired").when(label % 2 == 0, "ready").otherwise("backfilling").alias("state"), label.cast("long").alias("ready_count")).distinct()
    out = H.space_findings(spaces.crossJoin(F.broadcast(before)), held.withColumnRenamed("label", "space"), later)  # one row beside
    return out.withColumn("findings", F.array_join("findings", ","))


# -- rebuild guards -----------------------------------------------------------
# A scope is a source and a language of the documents. Jobs wait, run or are done
# by what the labels say of their document; users' last events are runs.
_REBUILD = """ep AS (SELECT source || '/' || lang AS scope, doc_id AS id, sha256(text) AS fp, n_chars, text, lang FROM documents), mk AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
 job AS (SELECT scope, id, CASE WHEN n_chars > 9000 THEN 'old' ELSE fp END AS fp, CASE WHEN toxic = 1 THEN 'leased' WHEN quality = 0 THEN 'synced' ELSE 'pending' END AS state FROM ep LEFT JOIN mk ON doc_id = id WHERE id % 83 <> 0),
 sc AS (SELECT scope, count(*) AS n, max(n_chars) AS most, min(id) AS least FROM ep GROUP BY scope),
 run AS (SELECT scope, CASE WHEN least % 11 = 0 THEN 'draining' ELSE 'stopped' END AS state FROM sc),
 inv AS (SELECT sc.*, (SELECT count(*) FROM job WHERE job.scope = sc.scope) AS jobs, (SELECT count(*) FROM job JOIN ep USING (scope, id) WHERE job.scope = sc.scope AND job.fp <> ep.fp) AS stale,
   (SELECT count(*) FROM job WHERE job.scope = sc.scope AND state = 'leased') AS leased, (SELECT count(*) FROM job WHERE job.scope = sc.scope AND state <> 'synced') AS non_synced, least % 11 = 0 AS busy FROM sc)"""


def _rebuild(spark, d):
    docs, marks = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    base = docs.select(F.concat("source", F.lit("/"), "lang").alias("scope"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"), "n_chars")
    state = F.when(F.col("toxic") == 1, "leased").when(F.col("quality") == 0, "synced").otherwise("pending")
    jobs = base.join(marks.withColumnRenamed("doc_id", "id"), "id", "left").filter("id % 83 <> 0").select("scope", "id", F.when(F.col("n_chars") > 9000, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), state.alias("state"), F.lit("p1").alias("profile"))
    scopes = base.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    runs = scopes.select("scope", F.when(F.col("least") % 11 == 0, "draining").otherwise("stopped").alias("state"))
    return base.drop("n_chars"), jobs, runs, scopes


def _operations(spark):
    return spark.createDataFrame([], "scope string, state string, profile string, identity string, episodes long")


def _prepared(spark, d):
    episodes, jobs, runs, scopes = _rebuild(spark, d)
    found = B.inventory(episodes, jobs, runs, _operations(spark))
    # The audit saw one document less where the first id is a multiple of seven.
    audited = found.join(scopes.select("scope", "least"), "scope").select("scope", (F.col("episodes") - (F.col("least") % 7 == 0).cast("int")).alias("audit_episodes"), F.col("identity").alias("audit_identity"))
    return episodes, jobs, runs, B.prepare(found, audited)


_PREPARED = "pre AS (SELECT scope, CASE WHEN busy THEN 'active_run' WHEN leased > 0 THEN 'leased_jobs' WHEN least % 7 = 0 THEN 'inventory_changed' WHEN jobs <> n OR stale > 0 THEN 'not_reconciled' END AS refusal FROM inv)"


@query("l15_prepare", f"WITH {_REBUILD}, {_PREPARED} SELECT scope, refusal, CASE WHEN refusal IS NULL THEN 'jobs_requeued' END AS state FROM pre")
def l15a(spark, d):
    return _prepared(spark, d)[-1].select("scope", "refusal", "state")


@query("l15_requeued", f"WITH {_REBUILD}, {_PREPARED} SELECT id, CASE WHEN refusal IS NULL THEN 'pending' ELSE state END AS state, CASE WHEN refusal IS NULL THEN 'p2' ELSE 'p1' END AS profile FROM job JOIN pre USING (scope)")
def l15b(spark, d):
    _, jobs, _, step = _prepared(spark, d)
    return B.requeued(jobs, step, "p2").select("id", "state", "profile")


def _cleared(spark, d):
    """After preparation a document of French scopes is added, and jobs of
    German scopes are moved on before the graph is seen to be empty."""
    episodes, jobs, runs, step = _prepared(spark, d)
    jobs = B.requeued(jobs, step, "p2")
    late = episodes.filter("scope like '%/fr'").groupBy("scope").agg((-F.min("id") - 1).alias("id")).withColumn("fingerprint", F.lit("late"))
    moved = jobs.withColumn("state", F.when(F.col("scope").like("%/de"), "leased").otherwise(F.col("state")))
    more = late.select("scope", "id", "fingerprint", F.lit("pending").alias("state"), F.lit("p2").alias("profile"))
    operations = B.operations_after(_operations(spark), step, "p2")
    return episodes.unionByName(late), moved.unionByName(more), runs, operations, step


_CLEARED = "clr AS (SELECT scope, CASE WHEN refusal IS NOT NULL THEN 'wrong_state' WHEN scope LIKE '%/de' THEN 'jobs_changed' WHEN scope LIKE '%/fr' THEN 'inventory_changed' END AS refusal FROM pre)"


@query("l15_cleared", f"WITH {_REBUILD}, {_PREPARED}, {_CLEARED} SELECT scope, clr.refusal, CASE WHEN pre.refusal IS NOT NULL THEN NULL WHEN clr.refusal IS NULL THEN 'ready' ELSE 'jobs_requeued' END AS state FROM clr JOIN pre USING (scope)")
def l15c(spark, d):
    episodes, jobs, runs, operations, _ = _cleared(spark, d)
    return B.cleared(B.inventory(episodes, jobs, runs, operations)).select("scope", "refusal", "state")


@query("l15_finalize", f"WITH {_REBUILD}, {_PREPARED}, {_CLEARED} SELECT scope, CASE WHEN clr.refusal IS NOT NULL THEN 'wrong_state' WHEN most > 5000 THEN 'not_synced' END AS refusal, CASE WHEN pre.refusal IS NOT NULL THEN NULL WHEN clr.refusal IS NOT NULL THEN 'jobs_requeued' WHEN most > 5000 THEN 'awaiting_audit' ELSE 'completed' END AS state FROM clr JOIN pre USING (scope) JOIN sc USING (scope)")
def l15d(spark, d):
    """The work is done; then the long documents' jobs fall back."""
    episodes, jobs, runs, operations, _ = _cleared(spark, d)
    operations = B.operations_after(operations, B.cleared(B.inventory(episodes, jobs, runs, operations)), "p2")
    done = jobs.withColumn("state", F.lit("synced"))
    operations = B.operations_after(operations, B.drained(B.inventory(episodes, done, runs, operations)), "p2")
    long_ = table(spark, d, "documents").filter("n_chars > 5000").select(F.col("doc_id").alias("id"), F.lit(1).alias("long"))
    back = done.join(long_, "id", "left").withColumn("state", F.when(F.col("long") == 1, "retry_wait").otherwise(F.col("state"))).drop("long")
    found = B.inventory(episodes, back, runs, operations)
    audited = found.select("scope", F.col("episodes").alias("audit_episodes"), F.col("identity").alias("audit_identity"))
    return B.finalize(found, audited).select("scope", "refusal", "state")


# -- content-free reports -----------------------------------------------------
_CF = "q AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))"


def _labelled(spark, d):
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, d, "documents").join(marks, "doc_id", "left")


@query("q08_audit", f"""WITH {_CF} SELECT source, 'drift' AS status, count(*) AS documents, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic_found, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(DISTINCT lang) AS listed FROM q GROUP BY source""")
def q08a(spark, d):
    when = lambda c, v: F.collect_list(F.when(c, v))
    report = F.struct(
        F.lit("drift").alias("status"), F.struct(F.count(F.lit(1)).alias("documents"), F.create_map(F.lit("good"), F.count_if(F.col("quality") == 1)).alias("lifecycle")).alias("counts"),
        F.create_map(F.lit("toxic"), when(F.col("toxic") == 1, F.struct("doc_id", "text")), F.lit("unlabelled"), when(F.col("quality").isNull(), F.struct("doc_id", "text"))).alias("drift"),
        F.collect_set("lang").alias("languages"), F.max("text").alias("sample"),
    )
    out = P.projected(_labelled(spark, d).groupBy("source").agg(report.alias("report")), "report", P.AUDIT)
    r = lambda x: F.col(f"report.{x}")
    return out.select("source", r("status"), r("counts.documents"), r("counts.lifecycle")["good"].alias("good"), r("drift")["toxic"].alias("toxic_found"), r("drift")["unlabelled"].alias("unlabelled"), r("languages").alias("listed"))


@query("q08_preflight", f"""WITH {_CF}, s AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS bad FROM q GROUP BY ALL)
 SELECT lang, string_agg(source || ':' || n || ':' || (bad > 0) || ':' || CASE WHEN bad > 0 THEN 'toxic/error' ELSE '' END, ';' ORDER BY source) AS spaces FROM s GROUP BY lang""")
def q08b(spark, d):
    space = _labelled(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"), F.max("text").alias("text"))
    findings = F.when(F.col("bad") > 0, F.array(F.struct(F.lit("toxic").alias("code"), F.lit("error").alias("severity"), F.col("text").alias("message")))).otherwise(F.array().cast("array<struct<code: string, severity: string, message: string>>"))
    one = F.struct(F.col("source").alias("semantic_index"), F.struct(F.col("n").alias("total_rows"), F.col("text").alias("sample")).alias("physical"), (F.col("bad") > 0).alias("ready"), findings.alias("findings"))
    reports = space.select("lang", one.alias("space")).groupBy("lang").agg(F.struct(F.array_sort(F.collect_list("space"), lambda a, b: F.when(a["semantic_index"] < b["semantic_index"], -1).otherwise(1)).alias("spaces")).alias("report"))
    out = P.projected(reports, "report", P.PREFLIGHT)
    said = lambda s: F.concat_ws(":", s["semantic_index"], s["physical"]["total_rows"], s["ready"], F.array_join(F.transform(s["findings"], lambda f: F.concat_ws("/", f["code"], f["severity"])), ","))
    return out.select("lang", F.array_join(F.transform("report.spaces", said), ";").alias("spaces"))


def _run_report(spark, d, extra):
    """A report on the events of each user, with texts that must not survive."""
    rows = table(spark, d, "events")
    state = F.max_by("event_type", F.struct("ts", "event_id"))
    run = F.struct(F.col("user_id").cast("string").alias("id"), state.alias("state"), F.min("ts").alias("started_at"), F.max("props").alias("note"), state.alias("last_failure_code"))
    return rows.groupBy("user_id").agg(F.struct(run.alias("run"), run.alias("active_run"), *extra).alias("report"))


_LAST = "SELECT user_id, arg_max(event_type, {'t': ts, 'i': event_id}) AS state, min(ts) AS started, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS n FROM events GROUP BY user_id"


@query("q08_quality", f"SELECT user_id, user_id::VARCHAR AS id, state, started AS started_at, accepted, failed AS empty_fact, 2 AS kinds FROM ({_LAST})")
def q08c(spark, d):
    counts = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.count_if(F.col("event_type") == v))])
    extra = [counts(accepted="purchase").alias("relationships"), counts(empty_fact="error").alias("rejection_reasons"), F.struct(F.array(F.lit("v1"), F.lit("v2")).alias("fingerprints")).alias("vocabulary"), F.max("props").alias("reason_text")]
    out = P.projected(_run_report(spark, d, extra), "report", P.QUALITY)
    r = lambda x: F.col(f"report.{x}")
    return out.select("user_id", r("run.id"), r("run.state"), r("run.started_at"), r("relationships")["accepted"].alias("accepted"), r("rejection_reasons")["empty_fact"].alias("empty_fact"), F.size(r("vocabulary.fingerprints")).alias("kinds"))


@query("q08_run_summary", f"SELECT user_id, state, state AS last_failure_code, n AS calls, n AS props FROM ({_LAST})")
def q08d(spark, d):
    extra = [F.struct(F.count(F.lit(1)).alias("total")).alias("provider_calls"), F.collect_list("props").alias("attempts")]
    out = P.projected(_run_report(spark, d, extra), "report", P.RUN_SUMMARY - {"attempts.*"})
    return out.select("user_id", "report.run.state", "report.run.last_failure_code", F.col("report.provider_calls.total").alias("calls"), F.col("report.attempts").alias("props"))


@query("q08_sync_status", f"SELECT user_id, state, started AS started_at, accepted AS synced, 1 AS notes FROM ({_LAST})")
def q08e(spark, d):
    extra = [F.create_map(F.lit("synced"), F.count_if(F.col("event_type") == "purchase")).alias("counts"), F.create_map(F.lit("free"), F.max("props")).alias("ledger")]
    out = P.projected(_run_report(spark, d, extra), "report", P.SYNC_STATUS)
    return out.select("user_id", "report.active_run.state", "report.active_run.started_at", F.col("report.counts")["synced"].alias("synced"), F.col("report.ledger").cast("int").alias("notes"))


# -- timers -------------------------------------------------------------------
_HOURS = 3
_ISLANDS = f"""o AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 n AS (SELECT *, sum(CASE WHEN before IS NULL OR kind = 'purchase' OR ts >= before + INTERVAL {_HOURS} HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM o),
 i AS (SELECT user_id, attempt, min(ts) AS since, max(ts) AS last, count(*) AS beats, bool_or(event_type = 'purchase') AS done FROM n GROUP BY ALL),
 l AS (SELECT *, max(attempt) OVER (PARTITION BY user_id) AS final, (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS mark FROM i)"""


@query("t02_leases", f"""WITH {_ISLANDS} SELECT user_id, attempt::INT AS attempt, CASE WHEN done THEN 'done' ELSE 'expired' END AS state, epoch_us(since) AS since, epoch_us(last + INTERVAL {_HOURS} HOUR) AS until, beats::INT AS beats
 FROM l WHERE done OR attempt < final OR last + INTERVAL {_HOURS} HOUR <= mark""")
def t02(spark, d):
    with T.rocksdb(spark):
        return S.drained(T.leases(S.event_stream(spark, f"{d}/events.parquet*"), _HOURS * 3600, "purchase"), _name("leases"), "append")


@query("t05_expired_sessions", """WITH a AS (SELECT * FROM events WHERE event_type NOT IN ('signup', 'error')), b AS (SELECT * FROM events WHERE event_type <> 'signup'),
 m AS (SELECT (SELECT max(ts) FROM a) - INTERVAL 10 MINUTE AS m0, (SELECT max(ts) FROM b) - INTERVAL 10 MINUTE AS m1),
 one AS (SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM b GROUP BY 1),
 c AS (SELECT * FROM events WHERE event_type = 'signup' AND ts >= (SELECT m0 FROM m)),
 e1 AS (SELECT * FROM one WHERE last + INTERVAL 6 HOUR <= (SELECT m0 FROM m)),
 two AS (SELECT user_id, sum(n)::BIGINT AS n, min(first) AS first, max(last) AS last FROM (SELECT * FROM one WHERE user_id NOT IN (SELECT user_id FROM e1) UNION ALL SELECT user_id, count(*), min(ts), max(ts) FROM c GROUP BY 1) GROUP BY 1),
 done AS (SELECT greatest((SELECT m1 FROM m), (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE) AS m2)
 SELECT user_id, n, epoch_us(first) AS first, epoch_us(last) AS last FROM e1 UNION ALL SELECT user_id, n, epoch_us(first), epoch_us(last) FROM two WHERE last + INTERVAL 6 HOUR <= (SELECT m2 FROM done)""")
def t05c(spark, d):
    """The events come in three lots, a micro-batch each; the sign-ups come
    last, and those behind the watermark of the first lot are late and are
    dropped. A lot has as many files as the table has splits."""
    events, folder, outs = table(spark, d, "events"), f"{shared_folder(spark)}/late-{uuid.uuid4().hex}", []
    kind = F.col("event_type")
    for i, part in enumerate((~kind.isin("signup", "error"), kind == "error", kind == "signup")):
        events.filter(part).write.parquet(f"{folder}/in/{i}")
        stream = T.sessions(S.event_stream(spark, f"{folder}/in/*/part-*", None), 6 * 3600)
        with T.rocksdb(spark), T.unfinished(spark, i < 2):
            outs.append(S.drained(stream, _name("sessions"), "append", f"{folder}/checkpoint"))
    return outs[0].unionByName(outs[1]).unionByName(outs[2]).select("user_id", "n", "first", "last")


# -- incremental load ---------------------------------------------------------
@query("t06_incremental_load", """WITH m AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1)
 SELECT d.doc_id, CASE WHEN quality = 0 THEN 3 WHEN quality = 1 THEN 2 ELSE 1 END AS version, sha256(CASE WHEN quality = 0 THEN text || '!' ELSE text END) AS fingerprint, CASE WHEN quality = 0 THEN 2 ELSE 1 END AS generation, 'pending' AS state FROM documents d LEFT JOIN m USING (doc_id)""")
def t06(spark, d):
    """All documents come in, then the labelled ones unchanged, then those of
    low quality edited; a changed source is queued again."""
    folder = f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left")
    schema = "doc_id long, version int, fingerprint string"
    sources = N.BucketedSnapshot(spark, f"{folder}/sources", schema, "doc_id", "version", 16)
    jobs = N.BucketedSnapshot(spark, f"{folder}/jobs", "doc_id long, generation int, state string", "doc_id", "generation", 16)
    for version, (wanted, text) in enumerate([("true", F.col("text")), ("quality is not null", F.col("text")), ("quality = 0", F.concat("text", F.lit("!")))], 1):
        docs.filter(wanted).select("doc_id", F.lit(version).alias("version"), F.sha2(text, 256).alias("fingerprint")).write.parquet(f"{folder}/in/{version}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/*/part-*")
        S.load_incrementally(stream, sources, jobs, "fingerprint", f"{folder}/checkpoint")
    return sources.read().join(jobs.read(), "doc_id")


# -- maintained views ---------------------------------------------------------
# The change rows: sign-ups are inserted, errors are deleted, clicks move to the
# next user with twice their value.
def _changes(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    before = events.filter("event_type <> 'signup'")
    row = F.struct("event_id", "user_id", "event_type", "value")
    moved = F.struct("event_id", (F.col("user_id") + 1).alias("user_id"), "event_type", (F.col("value") * 2).alias("value"))
    kind = F.col("event_type")
    changes = events.filter(kind.isin("signup", "error", "click")).select(F.when(kind != "signup", row).alias("old"), F.when(kind == "signup", row).when(kind == "click", moved).alias("new"))
    return before, changes


_AFTER = "a AS (SELECT event_id, CASE WHEN event_type = 'click' THEN user_id + 1 ELSE user_id END AS user_id, event_type, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS value FROM events WHERE event_type <> 'error')"


@query("d04_maintained_counts", f"WITH {_AFTER} SELECT user_id, count(*) AS n, round(sum(value::DECIMAL(28,6)) / count(*), 4)::DOUBLE AS mean FROM a GROUP BY user_id")
def d04a(spark, d):
    before, changes = _changes(spark, d)
    out = D.maintained(D.counted(before, ["user_id"], ["value"]), changes, ["user_id"], ["value"])
    return out.select("user_id", "n", F.round(F.col("sum_value") / F.col("n"), 4).cast("double").alias("mean"))


@query("d04_maintained_distinct", f"WITH {_AFTER} SELECT user_id, count(DISTINCT event_type) AS kinds FROM a GROUP BY user_id")
def d04b(spark, d):
    before, changes = _changes(spark, d)
    return D.distinct_counts(D.maintained_bag(D.bag(before, ["user_id"], "event_type"), changes, ["user_id"], "event_type"), ["user_id"], "kinds")


@query("d04_maintained_extremes", f"WITH {_AFTER} SELECT user_id, min(value) AS least, max(value) AS most FROM a GROUP BY user_id")
def d04c(spark, d):
    before, changes = _changes(spark, d)
    return D.maintained_extremes(D.extremes(before, ["user_id"], "value"), changes, D.applied(before, changes, "event_id"), ["user_id"], "value")


@query("d04_updated_at", "SELECT doc_id, CASE WHEN quality = 0 THEN 2 ELSE 1 END AS updated_at FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def d04d(spark, d):
    rows = _labelled(spark, d).select("doc_id", "quality", F.sha2("text", 256).alias("fingerprint"), "lang")
    old = rows.withColumn("updated_at", F.lit(1))
    new = rows.withColumn("fingerprint", F.when(F.col("quality") == 0, "edited").otherwise(F.col("fingerprint")))
    return D.touched(old, new, "doc_id", ["fingerprint", "lang"], F.lit(2)).select("doc_id", "updated_at")


@query("d04_refused_changes", """WITH m AS (SELECT event_id, event_type, value FROM events) SELECT event_id, CASE WHEN event_type = 'error' THEN 'append_only' WHEN value < 50 OR event_type = 'view' THEN 'outcome_is_final' WHEN event_type = 'click' THEN 'identity_is_immutable' END AS rule FROM m WHERE event_type IN ('error', 'view', 'click') OR value < 50""")
def d04e(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    old = F.struct("event_id", "user_id", F.when(value < 50, "succeeded").otherwise("reserved").alias("state"))
    new = F.struct("event_id", F.when(kind == "click", F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), F.when(kind == "view", "reserved").otherwise("failed").alias("state"))
    changes = table(spark, d, "events").select("event_id", old.alias("old"), F.when(kind != "error", new).alias("new"))
    return D.refused(changes, ["event_id", "user_id"]).select("event_id", "rule")


# -- table functions ----------------------------------------------------------
@query("d02_batch_summary", """SELECT user_id AS batch, count(*) AS total_corrections, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS deduplication_count, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS standardization_count,
 count(*) FILTER (WHERE event_type IN ('error', 'click')) AS deleted_relationships, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS updated_relationships, count(*) FILTER (WHERE event_type = 'view') AS rolled_back_count,
 round(avg(CASE WHEN event_type <> 'signup' THEN CASE WHEN event_type IN ('error', 'click') THEN 0.95 ELSE 0.9 END END::DECIMAL(9,4)), 3) AS avg_confidence FROM events GROUP BY user_id""")
def d02a(spark, d):
    drop = F.col("event_type").isin("error", "click")
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("batch"), F.when(drop, "DEDUPLICATION").otherwise("SEMANTIC_STANDARDIZATION").alias("type"), F.when(drop, "DELETE").otherwise("UPDATE").alias("action"),
        (F.col("event_type") == "view").alias("rolled_back"), F.when(F.col("event_type") != "signup", F.when(drop, 0.95).otherwise(0.9)).alias("confidence"),
    )
    U.register(spark)
    rows.createOrReplaceTempView("tessella_corrections")
    return spark.sql("SELECT * FROM correction_batch_summary(TABLE(tessella_corrections) PARTITION BY batch)")


@query("d02_temporal_context", """WITH e AS (SELECT c_custkey AS document_id, o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'O')
 SELECT document_id, (o_orderkey % 1000)::INT AS temporal_order, o_orderpriority AS temporal_type, o_orderstatus || ',' || substr(o_orderpriority, 1, 1) AS eras, length(o_orderpriority)::INT AS event_count FROM e WHERE n = 1""")
def d02b(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("document_id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderstatus") != "O").alias("is_temporal"), (F.col("o_orderkey") % 1000).cast("int").alias("temporal_order"),
        F.col("o_orderpriority").alias("temporal_type"), F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("eras"), F.length("o_orderpriority").alias("event_count"),
    )
    U.register(spark)
    rows.createOrReplaceTempView("tessella_episodes")
    return spark.sql("SELECT document_id, temporal_order, temporal_type, array_join(eras, ',') AS eras, event_count FROM temporal_context(TABLE(tessella_episodes) PARTITION BY document_id ORDER BY ordinal)")


# -- arbitration --------------------------------------------------------------
_COMMANDS = """cmd AS (SELECT user_id AS scope, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'finish' WHEN 'error' THEN 'stop' ELSE CASE WHEN value < 20 THEN 'drain' WHEN value < 40 THEN 'pause' ELSE 'resume' END END AS command,
  CASE WHEN value < 30 THEN 'p2' ELSE 'p1' END AS profile, event_id % 3 AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""
_FOLD = f"""WITH RECURSIVE {_COMMANDS}, f AS (
  SELECT scope, 0::BIGINT AS n, NULL::BIGINT AS run, NULL::VARCHAR AS st, NULL::VARCHAR AS prof, []::BIGINT[] AS jobs, NULL::BIGINT AS seq, NULL::VARCHAR AS command, NULL::BIGINT AS seen, NULL::BIGINT AS job, NULL::VARCHAR AS decision FROM (SELECT DISTINCT scope FROM cmd)
  UNION ALL
  SELECT scope, n, CASE decision WHEN 'started' THEN seq WHEN 'stopped' THEN NULL ELSE run END, CASE decision WHEN 'started' THEN 'running' WHEN 'resumed' THEN 'running' WHEN 'draining' THEN 'draining' WHEN 'paused_systemic' THEN 'paused_systemic' WHEN 'stopped' THEN NULL ELSE st END,
    CASE decision WHEN 'started' THEN profile WHEN 'stopped' THEN NULL ELSE prof END, CASE decision WHEN 'claimed' THEN list_append(jobs, job) WHEN 'finished' THEN list_filter(jobs, lambda x: x <> job) ELSE jobs END,
    seq, command, coalesce(run, CASE WHEN decision = 'started' THEN seq END), job, decision FROM (
    SELECT c.scope, c.n, f.run, f.st, f.prof, f.jobs, c.seq, c.command, c.profile, c.job, CASE c.command
      WHEN 'start' THEN CASE WHEN f.run IS NULL THEN 'started' WHEN f.prof <> c.profile THEN 'refused_profile' WHEN f.st = 'running' THEN 'joined' ELSE 'refused_not_accepting' END
      WHEN 'claim' THEN CASE WHEN f.run IS NULL OR f.st <> 'running' THEN 'refused_run' WHEN list_contains(f.jobs, c.job) THEN 'refused_leased' ELSE 'claimed' END
      WHEN 'finish' THEN CASE WHEN list_contains(f.jobs, c.job) THEN 'finished' ELSE 'refused_not_leased' END
      WHEN 'drain' THEN CASE WHEN f.st = 'running' THEN 'draining' ELSE 'refused_state' END WHEN 'pause' THEN CASE WHEN f.st = 'running' THEN 'paused_systemic' ELSE 'refused_state' END
      WHEN 'resume' THEN CASE WHEN f.st IN ('paused_systemic', 'draining') THEN 'resumed' ELSE 'refused_state' END
      ELSE CASE WHEN f.run IS NULL THEN 'refused_state' WHEN len(f.jobs) > 0 THEN 'refused_leases' ELSE 'stopped' END END AS decision
    FROM f JOIN cmd c ON c.scope = f.scope AND c.n = f.n + 1))"""


def _commands(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    other = F.when(value < 20, "drain").when(value < 40, "pause").otherwise("resume")
    command = F.when(kind == "signup", "start").when(kind == "view", "claim").when(kind == "click", "finish").when(kind == "error", "stop").otherwise(other)
    return table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), command.alias("command"), F.col("event_id").alias("run_id"), F.when(value < 30, "p2").otherwise("p1").alias("profile"), (F.col("event_id") % 3).alias("job"))


@query("l10_arbitrated", f"{_FOLD} SELECT scope, seq, command, seen AS run, decision FROM f WHERE n > 0")
def l10b(spark, d):
    return L.arbitrated(_commands(spark, d))


@query("l03_attempt_rows", f"{_FOLD} SELECT scope, seen AS run, job, row_number() OVER (PARTITION BY scope, job ORDER BY n)::INT AS attempt, seq FROM f WHERE decision = 'claimed'")
def l03b(spark, d):
    commands = _commands(spark, d)
    return L.attempt_rows(L.arbitrated(commands), commands)


# -- keyed state and tokens ---------------------------------------------------
@query("s15_state_store", """WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS updated_at, arg_max(event_type, {'t': ts, 'i': event_id}) AS value FROM events GROUP BY 1)
 SELECT user_id::VARCHAR AS key, value FROM l, m WHERE value <> 'error' AND updated_at >= now - INTERVAL 2 HOUR""")
def s15(spark, d):
    """Every user's last event is put in two rounds; an error deletes the key."""
    events = table(spark, d, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))
    first = events.groupBy("user_id").agg(F.min("ts").alias("ts"), F.min_by("event_type", F.struct("ts", "event_id")).alias("value"))
    state = lambda rows: rows.select(F.col("user_id").cast("string").alias("key"), F.when(F.col("value") != "error", F.col("value")).alias("value"), F.col("ts").cast("timestamp").alias("updated_at"))
    store = N.StateStore(spark, f"{shared_folder(spark)}/states-{uuid.uuid4().hex}", hours=2, buckets=8)
    store.put(state(first))
    store.put(state(last))
    now = F.lit(events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    store.compact(now)
    return store.get(state(last).select("key"), now).select("key", "value")


@query("f17_truncated_texts", r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::INT AS tokens, sha256(array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '\s*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])'), 1, 100), '')) AS cut FROM documents""")
def f17a(spark, d):
    return table(spark, d, "documents").select("doc_id", K.word_count(F.col("text")).alias("tokens"), F.sha2(K.word_truncated(F.col("text"), 100), 256).alias("cut"))


@query("f17_library_tokens")
def f17b(spark, d):
    """Any tokenizer file will do; this is a public one."""
    import public_tokenizers

    encode, decode = K.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return K.tokenised(table(spark, d, "documents"), "doc_id", "text", encode, 300, decode)
