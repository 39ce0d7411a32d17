"""Reconciliation between stores, readiness and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import token_case
from tessella.operators.graph import checkpointed

STATES = ["pending", "leased", "retry_wait", "quarantined", "synced"]


def drift(episodes: DataFrame, graph: DataFrame, jobs: DataFrame) -> DataFrame:
    """(finding, id) between episodes (id, fingerprint, synced), graph nodes
    (id, fingerprint) and jobs (id, state, fingerprint): each store is reduced
    to a row for each id and one full join compares all three."""
    g = graph.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("fingerprint").alias("graph_fp"))
    e = episodes.select("id", F.col("fingerprint").alias("source_fp"), "synced")
    j = jobs.select("id", "state", F.col("fingerprint").alias("job_fp"))
    row = e.join(g, "id", "full_outer").join(j, "id", "full_outer")
    has_e, has_g, has_j = F.col("source_fp").isNotNull(), F.col("copies").isNotNull(), F.col("state").isNotNull()
    done = F.when(has_j, F.col("state") == "synced").otherwise(F.coalesce("synced", F.lit(False)))
    kinds = {
        "missing_in_graph": has_e & done & ~has_g,
        "unexpected_in_graph": has_g & ~has_e,
        "duplicate_in_graph": F.col("copies") > 1,
        "present_but_not_synced": has_e & has_g & ~done,
        "source_mismatch": has_e & has_g & (F.col("source_fp") != F.col("graph_fp")),
        "job_without_source": has_j & ~has_e,
        "missing_job": has_e & ~has_j,
        "job_fingerprint_mismatch": has_e & has_j & (F.col("source_fp") != F.col("job_fp")),
        "flag_disagreement": has_e & has_j & (F.col("synced") != (F.col("state") == "synced")),
        "invalid_state": has_j & ~F.col("state").isin(*STATES),
    }
    found = F.array_compact(F.array(*(F.when(ok, F.lit(name)) for name, ok in kinds.items())))
    out = row.select("id", F.explode(found).alias("finding"))
    nulls = graph.filter("id is null").select(F.lit(None).cast(dict(graph.dtypes)["id"]).alias("id"), F.lit("null_id_in_graph").alias("finding"))
    return out.unionByName(nulls)


def audit(episodes: DataFrame, nodes: DataFrame, jobs: DataFrame | None, sync_profile: str | None = None, embedding_profile: str | None = None) -> DataFrame:
    """Q1: (finding, id, detail) of everything that disagrees between episodes
    (id, fingerprint, synced), graph nodes (id, description, fingerprint,
    sync_profile, embedding_profile) and jobs (id, state, desired, verified,
    sync_profile, verified_profile, verified_at).

    Nodes without an id (null or blank) give one row each with a null id. A
    duplicate's detail is its count; a job's is the reason; a mismatch's what
    was found. Without jobs the episodes' own flags say what is synced.
    """
    named = nodes.filter(F.trim(F.coalesce("id", F.lit(""))) != "")
    g = named.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    e = episodes.select("id", F.col("fingerprint").alias("source"), "synced", F.lit(True).alias("has_e"))
    row = e.join(g, "id", "full_outer")
    if jobs is None:
        row = row.withColumn("done", F.coalesce("synced", F.lit(False)))
        job = []
    else:
        j = jobs.select("id", "state", "desired", "verified", F.col("sync_profile").alias("profile"), "verified_profile", "verified_at", F.lit(True).alias("has_j"))
        row = row.join(j, "id", "full_outer").withColumn("done", F.coalesce(F.col("state") == "synced", F.lit(False)) & F.coalesce("has_e", F.lit(False)))
        both, synced = F.col("has_e") & F.col("has_j"), F.col("state") == "synced"
        differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
        reason = lambda name: ("incorrectly_synchronized_job", F.lit(name))
        job = [
            (*reason("job_without_source_episode"), F.col("has_j") & F.col("has_e").isNull()), (*reason("missing_job"), F.col("has_e") & F.col("has_j").isNull()),
            (*reason("invalid_job_state"), both & ~F.coalesce(F.col("state").isin(*STATES), F.lit(False))), (*reason("synced_job_legacy_flag_false"), both & synced & ~F.col("synced")),
            (*reason("non_synced_job_legacy_flag_true"), both & ~F.coalesce(synced, F.lit(False)) & F.col("synced")), (*reason("synced_job_missing_verified_at"), both & synced & F.col("verified_at").isNull()),
            ("stale_job_source_fingerprint", F.col("desired"), both & differ("desired", "source")), ("verified_source_fingerprint_mismatch", F.col("verified"), both & synced & differ("verified", "source")),
            ("verified_sync_profile_mismatch", F.col("verified_profile"), both & synced & differ("verified_profile", "profile")),
            ("job_sync_profile_mismatch", F.col("profile"), both & (F.lit(False) if sync_profile is None else ~F.col("profile").eqNullSafe(F.lit(sync_profile)))),
        ]
    none = F.lit(None).cast("string")
    kinds = [
        ("missing_in_graph", none, F.col("done") & F.col("copies").isNull()), ("unexpected_in_graph", none, F.col("copies").isNotNull() & F.col("has_e").isNull()),
        ("duplicate_in_graph", F.col("copies").cast("string"), F.col("copies") > 1), ("present_but_not_synced", none, F.col("copies").isNotNull() & F.col("has_e") & ~F.col("done")), *job,
    ]
    held = named.join(e.select("id", "source"), "id")
    other = lambda c, want: F.lit(False) if want is None else F.col(c) != want
    of_node = [
        ("source_description_mismatch", F.col("description"), ~F.col("description").eqNullSafe(F.concat(F.lit("episode_"), "id"))), ("source_fingerprint_mismatch", F.col("fingerprint"), F.col("fingerprint") != F.col("source")),
        ("sync_profile_mismatch", F.col("sync_profile"), other("sync_profile", sync_profile)), ("embedding_profile_mismatch", F.col("embedding_profile"), other("embedding_profile", embedding_profile)),
    ]
    blank = nodes.filter(F.trim(F.coalesce("id", F.lit(""))) == "").select(F.lit("null_id_in_graph").alias("finding"), none.alias("id"), none.alias("detail"))
    return _found(row, kinds).unionByName(_found(held, of_node)).unionByName(blank)


def _found(rows: DataFrame, kinds: list) -> DataFrame:
    """(finding, id, detail): a row for every (name, detail, condition) that holds."""
    each = F.array_compact(F.array(*(F.when(ok, F.struct(F.lit(name).alias("finding"), detail.alias("detail"))) for name, detail, ok in kinds)))
    return rows.select("id", F.explode(each).alias("f")).select("f.finding", "id", "f.detail")


def audit_summary(episodes: DataFrame, nodes: DataFrame, jobs: DataFrame | None, findings: DataFrame) -> DataFrame:
    """Q1: one row with the totals, the jobs in each state, how many records
    carry each fingerprint, the number of findings and ``clean`` or ``drift``."""
    named = F.trim(F.coalesce("id", F.lit(""))) != ""
    here = nodes.join(episodes.select("id", F.lit(1).alias("e")), "id", "left")
    with_e = named & F.col("e").isNotNull()
    of_nodes = here.agg(
        F.count(F.lit(1)).alias("graph_total"), F.count_if(named).alias("graph_populated"), F.countDistinct(F.when(named, F.col("id"))).alias("graph_distinct"),
        *(F.count(F.when(with_e, F.col(c))).alias(f"node_{c}") for c in ("fingerprint", "sync_profile", "embedding_profile")),
    )
    if jobs is None:
        state = F.when(F.col("synced"), "synced").otherwise("pending")
        of_jobs = episodes.agg(*(F.count_if(state == s).alias(f"state_{s}") for s in STATES), *(F.lit(0).alias(f"job_{c}") for c in ("desired", "verified", "sync_profile")))
        synced = episodes.agg(F.count(F.lit(1)).alias("source_total"), F.count_if("synced").alias("source_synced"))
    else:
        j = jobs.join(episodes.select("id", F.lit(1).alias("e")), "id", "left")
        of_jobs = j.agg(*(F.count_if(F.col("state") == s).alias(f"state_{s}") for s in STATES), *(F.count(F.when(F.col("e").isNotNull(), F.col(c))).alias(f"job_{c}") for c in ("desired", "verified", "sync_profile")), F.count_if(F.col("e").isNotNull() & (F.col("state") == "synced")).alias("source_synced"))
        synced = episodes.agg(F.count(F.lit(1)).alias("source_total"))
    drift = findings.agg(F.count(F.lit(1)).alias("findings"))
    out = synced.crossJoin(of_nodes).crossJoin(of_jobs).crossJoin(drift)  # one row each
    return out.withColumn("status", F.when(F.col("findings") == 0, "clean").otherwise("drift")).withColumn("source_non_synced", F.col("source_total") - F.col("source_synced"))


def snapshot_identity(rows: DataFrame, id_col: str, fingerprint_col: str) -> DataFrame:
    """An identity of a snapshot that does not depend on row order and needs
    no list of all rows: sums of hash halves, with the count."""
    digest = F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), fingerprint_col), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(20,0)"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), *(part(1 + 8 * i).alias(f"h{i}") for i in range(4)))


def progress(counts: DataFrame, least_window: int = 60) -> DataFrame:
    """Percent, rate a minute and ETA with the first status that holds, from
    (pending, leased, retry_wait, quarantined, synced, run_state, window, recent)."""
    total = F.col("pending") + F.col("leased") + F.col("retry_wait") + F.col("quarantined") + F.col("synced")
    left = total - F.col("synced")
    rate = F.when(F.col("window") > 0, F.try_divide(F.col("recent") * 60.0, F.col("window"))).otherwise(0.0)
    status = (
        F.when(left == 0, "complete").when(F.col("run_state") == "paused_systemic", "paused_systemic").when(F.col("quarantined") > 0, "blocked_quarantine")
        .when(F.col("run_state") == "stopped", "stopped").when(F.col("window") < least_window, "warming_up").when(rate <= 0, "insufficient_progress").otherwise("available")
    )
    return counts.select(
        "*", F.when(total == 0, 100.0).otherwise(F.round(F.try_divide(F.col("synced") * 100.0, total), 3)).alias("percent"), F.round(rate, 3).alias("rate"), status.alias("eta_status"),
        F.when(status == "complete", 0).when(status == "available", F.ceil(F.try_divide(left * 60.0, rate))).alias("eta_seconds"),
    )


def run_summary(attempts: DataFrame) -> DataFrame:
    """Per run: attempts, outcomes, failures, latency and calls reported."""
    failed = F.col("outcome") == "error"
    return attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.countDistinct("episode_id").alias("episodes"), F.count_if(failed).alias("failures"),
        F.round(F.percentile(F.when(~failed, F.col("latency")), 0.95), 6).alias("p95"), F.round(F.sum(F.when(failed, F.col("latency"))), 4).alias("lost"),
        F.count(F.when(failed, F.col("latency"))).alias("reported"), F.max("completed_at").alias("last"),
    )


def failure_matrix(attempts: DataFrame, outcomes: list[str]) -> DataFrame:
    """Runs by outcomes, zero-filled."""
    return attempts.groupBy("run_id").pivot("outcome", outcomes).agg(F.count(F.lit(1))).na.fill(0)


def attempt_chain(attempts: DataFrame, most: int = 5) -> DataFrame:
    """The last attempts of each episode as one ordered list."""
    n = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("completed_at"), F.desc("attempt_id")))
    few = attempts.withColumn("n", n).filter(F.col("n") <= most)
    return few.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("completed_at", "attempt_id", "outcome"))).alias("chain"))


def readiness(checks: DataFrame) -> DataFrame:
    """Alerts (code, severity) of checks (code, value, limit, severity) that
    are over their limit, and the worst severity as the verdict."""
    alerts = checks.filter(F.col("value") > F.col("limit"))
    worst = alerts.agg(F.max(F.when(F.col("severity") == "critical", 2).otherwise(1)).alias("w"))
    verdict = worst.select(F.when(F.col("w") == 2, "blocked").when(F.col("w") == 1, "degraded").otherwise("ready").alias("verdict"))
    return verdict.join(alerts.select("code", "severity"), F.lit(True), "left")  # one verdict


# The thresholds of the two warnings.
LEAST_ATTEMPTS, RETRY_PERCENT, LEAST_CALLS, FAILURE_PERCENT = 5, 25.0, 5, 25.0


def operational_alerts(facts: DataFrame, configured_profile: str) -> DataFrame:
    """Q7: (id, code, severity, observed) of every alert of a system, from one
    row for each: quarantined, expired_leases, baseline_quarantined (null without
    a baseline), run_state and run_profile (null without an active run),
    completed_attempts, retrying, candidates (array of name, completed,
    failures), quality_status, missing_attempts, mixed_vocabulary, audit_status,
    drift_findings, profile_drift, embedding_status, embedding_codes."""
    c, text = F.col, lambda x: F.coalesce(x.cast("string"), F.lit(""))
    percent = lambda part, whole: F.round(100.0 * F.try_divide(part, whole), 3)
    critical = [
        ("quarantined_jobs_present", c("quarantined"), c("quarantined") > 0), ("expired_leases_present", c("expired_leases"), c("expired_leases") > 0),
        ("quarantined_jobs_growing", c("quarantined"), c("quarantined") > c("baseline_quarantined")), ("active_sync_profile_mismatch", c("run_profile"), c("run_state").isNotNull() & ~c("run_profile").eqNullSafe(F.lit(configured_profile))),
        ("run_paused_systemic", c("run_state"), c("run_state") == "paused_systemic"),
        ("relationship_quality_evidence_incomplete", c("missing_attempts"), (c("quality_status") == "available") & (c("missing_attempts") > 0)),
        ("relationship_vocabulary_mixed", c("mixed_vocabulary"), (c("quality_status") == "available") & c("mixed_vocabulary")),
        ("relationship_quality_unavailable", c("quality_status"), ~c("quality_status").isin("available", "no_runs")),
        ("graph_audit_drift", c("drift_findings"), (c("audit_status") == "drift") | (c("drift_findings") > 0)), ("graph_audit_incomplete", c("audit_status"), ~c("audit_status").isin("drift", "clean") & (c("drift_findings") == 0)),
        ("graph_profile_mismatch", c("profile_drift"), c("profile_drift") > 0),
        ("embedding_profile_mismatch", F.array_join(F.sort_array(F.array_distinct(F.filter("embedding_codes", _profile_code))), ","), F.exists("embedding_codes", _profile_code)),
        ("embedding_preflight_blocked", c("embedding_status"), c("embedding_status") != "ready"),
    ]
    retries = percent(c("retrying"), c("completed_attempts"))
    alert = lambda code, severity, seen: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text(seen).alias("observed"))
    one = F.array_compact(F.array(
        *(F.when(ok, alert(code, "critical", seen)) for code, seen, ok in critical), F.when((c("completed_attempts") >= LEAST_ATTEMPTS) & (retries >= RETRY_PERCENT), alert("retry_storm", "warning", retries)),
    ))
    failing = F.filter("candidates", lambda x: (x["completed"] >= LEAST_CALLS) & (percent(x["failures"], x["completed"]) >= FAILURE_PERCENT))
    each = F.transform(failing, lambda x: alert("sustained_provider_failure", "warning", x["name"]))
    return facts.select("id", F.explode(F.concat(one, F.coalesce(each, F.array().cast("array<struct<code:string,severity:string,observed:string>>")))).alias("a")).select("id", "a.*")


def _profile_code(code: Column) -> Column:
    return code.contains("profile") | code.contains("dimension_mismatch")


def operational_status(facts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Q7: (id, critical, warning, status): blocked by a critical alert,
    degraded by a warning, else ready."""
    n = alerts.groupBy("id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"))
    j = facts.select("id").join(n, "id", "left").na.fill(0, ["critical", "warning"])
    return j.withColumn("status", F.when(F.col("critical") > 0, "blocked").when(F.col("warning") > 0, "degraded").otherwise("ready"))


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, expected, actual) where two records disagree, null-safely."""
    j = left.alias("l").join(right.alias("r"), key)
    both = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("expected"), F.col(f"r.{f}").cast("string").alias("actual")) for f in fields))
    return j.select(key, F.explode(both).alias("d")).select(key, "d.*").filter("not (expected <=> actual)")


def coverage(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored, current, stale, missing and orphaned vectors of (id, fingerprint)."""
    j = sources.select("id", F.col("fingerprint").alias("s")).join(stored.select("id", F.col("fingerprint").alias("v")), "id", "full_outer")
    n = lambda ok: F.count_if(ok)
    s, v = F.col("s"), F.col("v")
    return j.agg(n(v.isNotNull()).alias("stored"), n(s.eqNullSafe(v) & s.isNotNull()).alias("current"), n(s.isNotNull() & v.isNotNull() & (s != v)).alias("stale"), n(s.isNotNull() & v.isNull()).alias("missing"), n(s.isNull()).alias("orphaned"))


def proposal_policy(proposals: DataFrame, nodes: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(id, decision, type): proposals (id, pos, source, target, type, fact)
    accepted, normalised, or rejected by the first reason that holds: missing
    endpoint, ambiguous endpoint, self edge, empty fact, unknown type,
    duplicate. Endpoints are the names of ``nodes`` (id, name); a self edge and
    a duplicate are told by the nodes' ids. A type of the vocabulary is
    accepted; one that is it but for case, camel case and what parts its words
    is normalised."""
    count = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("node"))
    j = proposals
    for end in ("source", "target"):
        j = j.join(count.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}"), F.col("node").alias(f"{end}_id")), end, "left").na.fill(0, [f"n_{end}"])
    known = F.create_map(*[c for name in vocabulary for c in (token_case(F.lit(name)), F.lit(name))])
    kind = F.when(F.col("type").isin(*vocabulary), F.col("type")).otherwise(F.try_element_at(known, token_case(F.trim("type"))))
    j = j.withColumn("kind", kind)
    least, most = F.least("n_source", "n_target"), F.greatest("n_source", "n_target")
    reason = (
        F.when(least == 0, "missing_endpoint").when(most > 1, "ambiguous_endpoint").when(F.col("source_id") == F.col("target_id"), "self_edge")
        .when(F.trim(F.coalesce("fact", F.lit(""))) == "", "empty_fact").when(F.col("kind").isNull(), "unknown_type")
    )
    j = j.withColumn("reason", reason)
    fact = F.lower(F.trim(F.regexp_replace("fact", r"\s+", " ")))
    first = F.row_number().over(Window.partitionBy(F.col("reason").isNull(), "source_id", "target_id", "kind", fact).orderBy("pos", "id"))
    j = j.withColumn("reason", F.when(F.col("reason").isNull() & (first > 1), "duplicate").otherwise(F.col("reason")))
    decision = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("kind") == F.col("type"), "accepted").otherwise("normalized")
    return j.select("id", decision.alias("decision"), "kind")


def temporal_order(docs: DataFrame, order: Column, keys: list[str]) -> DataFrame:
    """Documents in time with their neighbours; undated ones last. The rows
    are dealt by ranges of the order and each range finds its neighbours by
    itself; its first and last row take theirs from the ranges beside it. Only
    the two ends of each range come together, so their number is that of the
    shuffle partitions."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.withColumn("_order", order).repartitionByRange(ranges, F.col("_order").asc_nulls_last(), *keys)
    dealt = checkpointed(dealt.withColumn("_range", F.spark_partition_id()))
    at = F.struct(F.col("_order").isNull(), "_order", *keys)
    ends = sorted(dealt.groupBy("_range").agg(F.min(at)[keys[0]].alias("first"), F.max(at)[keys[0]].alias("last")).collect())
    beside = [(e["_range"], b["last"] if b else None, a["first"] if a else None) for b, e, a in zip([None, *ends], ends, [*ends[1:], None])]
    kind = docs.schema[keys[0]].dataType.simpleString()
    near = docs.sparkSession.createDataFrame(beside, f"_range int, _before {kind}, _after {kind}")
    w = Window.partitionBy("_range").orderBy(F.col("_order").asc_nulls_last(), *keys)
    own = dealt.select("*", F.lag(keys[0]).over(w).alias("previous"), F.lead(keys[0]).over(w).alias("following"), F.lag(F.lit(1)).over(w).alias("_left"), F.lead(F.lit(1)).over(w).alias("_right"))
    beyond = lambda side, inner, outer: F.when(F.col(side).isNull(), F.col(outer)).otherwise(F.col(inner))
    out = own.join(F.broadcast(near), "_range").withColumn("previous", beyond("_left", "previous", "_before")).withColumn("following", beyond("_right", "following", "_after"))
    return out.select(*docs.columns, "previous", "following")
