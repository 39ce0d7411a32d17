"""Preflight of vector spaces (Q9) and constraint rules of the job ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a profile, and those of a space's recorded state
# that must be as the code expects them.
PROFILE_FIELDS = ["fingerprint", "provider", "endpoint_class", "implementation", "model", "model_revision", "dimensions", "output_encoding", "storage_type", "normalize", "distance_metric", "input_type"]
STATE_FIELDS = ["expected_dimensions", "distance_metric", "index_name"]


def preflight(expected: DataFrame, states: DataFrame, profiles: DataFrame, vectors: DataFrame, require_active: bool = True) -> DataFrame:
    """One row per expected space: (semantic_index, space, status, total_rows,
    embedded_rows, findings).

    ``expected`` (semantic_index, space, STATE_FIELDS, configured: a struct of
    PROFILE_FIELDS or null) is what the code is built for; ``states``
    (semantic_index, space, state, STATE_FIELDS, profile_fingerprint) is what is
    recorded; ``profiles`` (PROFILE_FIELDS) are the recorded profiles; ``vectors``
    (space, embedding) is what is there. Findings are sorted codes; coverage is
    a warning, all others block. Vectors are read once, for their number and
    widths."""
    recorded = ["space", "state", *STATE_FIELDS, "profile_fingerprint"]
    active = states.filter("state = 'active'").groupBy("semantic_index").agg(F.count(F.lit(1)).alias("_active"), F.min_by(F.struct(*recorded), "space").alias("_first"))
    own = states.groupBy("semantic_index", "space").agg(F.first(F.struct(*recorded)).alias("_own"))
    there = vectors.groupBy("space").agg(F.count(F.lit(1)).alias("total_rows"), F.count("embedding").alias("embedded_rows"), F.min(F.size("embedding")).alias("_low"), F.max(F.size("embedding")).alias("_high"))
    kept = profiles.select(F.struct(*(F.col(f) for f in PROFILE_FIELDS)).alias("_stored")).withColumn("_print", F.col("_stored.fingerprint"))
    j = expected.join(active, "semantic_index", "left").join(own, ["semantic_index", "space"], "left").join(there, "space", "left")
    several = F.coalesce(F.col("_active") > 1, F.lit(False))
    j = j.withColumn("_state", F.when(several, None).otherwise(F.coalesce("_first", "_own")))
    j = j.join(kept, F.col("_state.profile_fingerprint") == F.col("_print"), "left")
    chosen, configured = F.col("_state").isNotNull(), F.col("configured").isNotNull()
    width = F.col("expected_dimensions")
    rules = {
        "multiple_active_spaces": several, "space_metadata_missing": F.col("_own").isNull(), "table_missing": F.col("total_rows").isNull(),
        "unexpected_active_space": F.col("_first.space").isNotNull() & (F.col("_first.space") != F.col("space")), "physical_dimension_mismatch": (F.col("_low") != width) | (F.col("_high") != width),
        "configured_dimension_mismatch": configured & (F.col("configured.dimensions") != width), "stored_profile_missing": configured & F.col("_state.profile_fingerprint").isNull(),
        "stored_profile_unresolvable": configured & F.col("_state.profile_fingerprint").isNotNull() & F.col("_stored").isNull(),
    }
    if require_active:
        rules |= {"active_space_missing": F.col("_active").isNull(), "space_retired": F.col("_state.state") == "retired"}
    rules |= {f"state_{f}_mismatch": chosen & ~F.col(f"_state.{f}").eqNullSafe(F.col(f)) for f in STATE_FIELDS}
    rules |= {f"profile_{f}_mismatch": configured & F.col("_stored").isNotNull() & ~F.col(f"_stored.{f}").eqNullSafe(F.col(f"configured.{f}")) for f in PROFILE_FIELDS}
    errors = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in rules.items())))
    warnings = F.when(F.col("embedded_rows") < F.col("total_rows"), F.array(F.lit("embedding_coverage_incomplete"))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.size(errors) > 0, "blocked").when(F.col("_state.state") == "retired", "retired").otherwise("ready" if require_active else "inventory")
    return j.select("semantic_index", "space", status.alias("status"), F.coalesce("total_rows", F.lit(0)).alias("total_rows"), F.coalesce("embedded_rows", F.lit(0)).alias("embedded_rows"), F.array_sort(F.concat(errors, warnings)).alias("findings"))


def all_set(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def none_set(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNull()
    return out


def job_rules() -> dict[str, Column]:
    """The checks of a job row (state, attempts, budget_used, budget,
    lease_owner, lease_until, next_at, verified_print, verified_at)."""
    state = lambda s: F.col("state") == s
    lease, proof = ("lease_owner", "lease_until"), ("verified_print", "verified_at")
    return {
        "known_state": F.col("state").isin("pending", "leased", "retry_wait", "quarantined", "synced"), "budget": (F.col("budget_used") >= 0) & (F.col("budget_used") <= F.col("budget")),
        "lease": (state("leased") & (F.col("attempts") > 0) & all_set(*lease)) | (~state("leased") & none_set(*lease)), "retry_time": state("retry_wait") == F.col("next_at").isNotNull(),
        "verified": (state("synced") & all_set(*proof)) | (~state("synced") & none_set(*proof)),
    }


def count_rules() -> dict[str, Column]:
    """Counts of an attempt (proposed, accepted, rejected) are all null or add up."""
    names = ("proposed", "accepted", "rejected")
    return {"counts_reconcile": none_set(*names) | (all_set(*names) & (F.col("proposed") == F.col("accepted") + F.col("rejected")) & (F.least(*names) >= 0))}


def unique_violations(rows: DataFrame, key: list[str], rule: str, where: Column | None = None) -> DataFrame:
    """(rule, key, n) of keys that more than one row holds, of the rows that a
    partial rule covers; a null in a key never repeats."""
    few = rows if where is None else rows.filter(F.coalesce(where, F.lit(False)))
    return few.filter(all_set(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *key).alias("key"), "n")


def reference_violations(rows: DataFrame, column: str, parents: DataFrame, parent: str, rule: str) -> DataFrame:
    """(rule, key, n) of values that no parent has, with the rows that hold them."""
    held = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    known = parents.select(F.col(parent).alias(column)).distinct()
    return held.join(known, column, "left_anti").select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("key"), "n")
