"""Rebuild guards: prepare, clear and finalize as an optimistic publication.

Each step looks at the whole inventory of its scope again and carries on only if
that has the identity which the step before recorded; the identity does not
depend on row order. A refusal is a row with the first rule that is broken.

Inputs: ``episodes`` (scope, id, fingerprint), ``jobs`` (scope, id, fingerprint,
state, profile), ``runs`` (scope, state), ``operations`` (scope, state, profile,
identity, episodes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import checkpointed

COUNTS = ["episodes", "jobs", "stale", "leased", "non_pending", "non_synced", "mismatched", "active_runs"]


def inventory(episodes: DataFrame, jobs: DataFrame, runs: DataFrame, operations: DataFrame) -> DataFrame:
    """One row per scope: COUNTS, its identity and its open operation. The
    identity is the count and four sums of hash parts."""
    digest = F.sha2(F.concat_ws(":", F.col("id").cast("string"), "fingerprint"), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
    own = episodes.groupBy("scope").agg(F.count(F.lit(1)).alias("episodes"), F.concat_ws(":", F.count(F.lit(1)), *(part(i) for i in range(4))).alias("identity"))
    open_ = operations.filter("state <> 'completed'").select("scope", F.col("state").alias("op_state"), F.col("profile").alias("op_profile"), F.col("identity").alias("op_identity"), F.col("episodes").alias("op_episodes"))
    now = episodes.select("scope", "id", F.col("fingerprint").alias("_now"))
    known = jobs.join(now, ["scope", "id"], "left").join(open_.select("scope", "op_profile"), "scope", "left")
    is_ = lambda s: F.col("state") == s
    work = known.groupBy("scope").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(~F.col("fingerprint").eqNullSafe(F.col("_now"))).alias("stale"), F.count_if(is_("leased")).alias("leased"),
        F.count_if(~is_("pending")).alias("non_pending"), F.count_if(~is_("synced")).alias("non_synced"), F.count_if(F.col("op_profile").isNotNull() & (F.col("profile") != F.col("op_profile"))).alias("mismatched"),
    )
    busy = runs.groupBy("scope").agg(F.count_if(F.col("state") != "stopped").alias("active_runs"))
    j = own.join(work, "scope", "full_outer").join(busy, "scope", "left").join(open_, "scope", "left")
    return j.na.fill(0, COUNTS)


def _guarded(found: DataFrame, step: str, rules: list[tuple[str, Column]], state: Column) -> DataFrame:
    """One decided row per scope, written to the shared folder: what a step has
    decided is not looked at again when a later one is."""
    refusal = F.coalesce(*(F.when(broken, F.lit(code)) for code, broken in rules))
    return checkpointed(found.select("scope", F.lit(step).alias("step"), refusal.alias("refusal"), F.when(refusal.isNull(), state).otherwise(F.col("op_state")).alias("state"), "episodes", "jobs", "identity"))


def prepare(found: DataFrame, audited: DataFrame) -> DataFrame:
    """Begin a rebuild in every scope that allows it. ``audited`` (scope,
    audit_episodes, audit_identity) is what the audit before it saw."""
    changed = (F.col("audit_episodes") != F.col("episodes")) | ~F.col("audit_identity").eqNullSafe(F.col("identity"))
    rules = [
        ("active_run", F.col("active_runs") > 0), ("rebuild_active", F.col("op_state").isNotNull()), ("leased_jobs", F.col("leased") > 0),
        ("inventory_changed", F.coalesce(changed, F.lit(True))), ("not_reconciled", (F.col("jobs") != F.col("episodes")) | (F.col("stale") > 0)),
    ]
    return _guarded(found.join(audited, "scope", "left"), "prepare", rules, F.lit("jobs_requeued"))


def cleared(found: DataFrame) -> DataFrame:
    """Record that the graph is empty and every job waits under the new profile."""
    rules = [
        ("wrong_state", ~F.col("op_state").eqNullSafe(F.lit("jobs_requeued"))), ("active_run", F.col("active_runs") > 0), ("jobs_changed", (F.col("non_pending") > 0) | (F.col("mismatched") > 0) | (F.col("stale") > 0)),
        ("counts_diverged", F.col("jobs") != F.col("episodes")), ("inventory_changed", ~F.col("op_identity").eqNullSafe(F.col("identity"))),
    ]
    return _guarded(found, "cleared", rules, F.when(F.col("jobs") == 0, "awaiting_audit").otherwise("ready"))


def drained(found: DataFrame) -> DataFrame:
    """A ready rebuild whose jobs are all synced waits for its audit."""
    rules = [("wrong_state", ~F.col("op_state").eqNullSafe(F.lit("ready"))), ("not_synced", F.col("non_synced") > 0)]
    return _guarded(found, "drained", rules, F.lit("awaiting_audit"))


def finalize(found: DataFrame, audited: DataFrame) -> DataFrame:
    """Activate the rebuilt profile after a clean audit of the same inventory."""
    changed = (F.col("jobs") != F.col("audit_episodes")) | (F.col("jobs") != F.col("episodes")) | ~F.col("op_identity").eqNullSafe(F.col("identity")) | ~F.col("audit_identity").eqNullSafe(F.col("identity"))
    rules = [
        ("wrong_state", ~F.col("op_state").eqNullSafe(F.lit("awaiting_audit"))), ("active_run", F.col("active_runs") > 0), ("inventory_changed", F.coalesce(changed, F.lit(True))),
        ("not_synced", (F.col("non_synced") > 0) | (F.col("mismatched") > 0) | (F.col("stale") > 0)),
    ]
    return _guarded(found.join(audited, "scope", "left"), "finalize", rules, F.lit("completed"))


def operations_after(operations: DataFrame, step: DataFrame, profile: str) -> DataFrame:
    """The operations with those that a step began or moved on."""
    passed = step.filter("refusal is null")
    old = operations.join(passed.select("scope", F.col("state").alias("_to")), "scope", "left").withColumn("state", F.when(F.col("state") != "completed", F.coalesce("_to", "state")).otherwise(F.col("state"))).drop("_to")
    new = passed.filter("step = 'prepare'").select("scope", "state", F.lit(profile).alias("profile"), "identity", "episodes")
    return old.unionByName(new)


def requeued(jobs: DataFrame, step: DataFrame, profile: str) -> DataFrame:
    """All jobs of the scopes that were prepared, waiting under the profile."""
    go = step.filter("refusal is null and step = 'prepare'").select("scope", F.lit(True).alias("_go"))
    j = jobs.join(go, "scope", "left").withColumn("_go", F.coalesce("_go", F.lit(False)))
    return j.withColumns({"state": F.when(F.col("_go"), "pending").otherwise(F.col("state")), "profile": F.when(F.col("_go"), profile).otherwise(F.col("profile"))}).drop("_go")


def events(steps: DataFrame) -> DataFrame:
    """One event for each step that passed."""
    kind = F.create_map(*[F.lit(x) for kv in {"prepare": "jobs_requeued", "cleared": "graph_cleared", "drained": "jobs_drained", "finalize": "final_audit_passed"}.items() for x in kv])
    return steps.filter("refusal is null").select("scope", kind[F.col("step")].alias("event"), "identity", "jobs")
