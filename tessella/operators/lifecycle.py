"""Durable job lifecycle: seeding, claims, transitions, recovery and rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import checkpointed

# What a failure's disposition does: (disposition, budget left?,
# outcome, job state, whether a unit of the budget is used).
TRANSITIONS = [
    ("pause_systemic", None, "paused_systemic", "retry_wait", False),
    ("quarantine", None, "quarantined", "quarantined", True),
    ("cancel", None, "cancelled", "retry_wait", False),
    ("shutdown", None, "shutdown", "retry_wait", False),
    ("retry", False, "quarantined", "quarantined", True),
    ("retry", True, "retry_wait", "retry_wait", True),
]

# Failure classes in the order in which they are tried: (class,
# code, HTTP statuses, words in the error's name, disposition).
FAILURES = [
    ("shutdown", "worker_shutdown", (), ("shutdown",), "shutdown"),
    ("cancellation", "worker_cancelled", (), ("cancelled",), "cancel"),
    ("resource_exhaustion", "provider_call_limit_exhausted", (), ("providercalllimit",), "retry"),
    ("profile_mismatch", "sync_profile_mismatch", (), ("profilemismatch",), "pause_systemic"),
    ("graph_validation", "graph_identity_conflict", (), ("graphidentityconflict",), "quarantine"),
    ("verification", "graph_verification_failed", (), ("graphverification",), "retry"),
    ("malformed_json", "malformed_model_output", (), ("malformedmodeloutput", "jsondecode", "emptyresponse"), "retry"),
    ("authentication", "provider_authentication", (401,), ("authentication", "autherror"), "pause_systemic"),
    ("authorization", "provider_authorization", (403,), ("permissiondenied", "authorization"), "pause_systemic"),
    ("resource_exhaustion", "provider_resource_exhausted", (402,), ("insufficientquota", "quotaexceeded", "resourceexhausted"), "pause_systemic"),
    ("rate_limit", "provider_rate_limit", (429,), ("ratelimit",), "pause_systemic"),
    ("output_limit", "model_output_limit", (), ("modeloutputlimit",), "retry"),
    ("schema_validation", "model_schema_invalid", (), ("validationerror",), "retry"),
    ("persistence", "graph_store_unavailable", (), ("neo4j", "sessionexpired"), "pause_systemic"),
    ("persistence", "sync_ledger_unavailable", (), ("providerledger", "databas", "postgres"), "pause_systemic"),
    ("transport", "provider_http_transient", (408, 409, "5xx"), (), "retry"),
    ("transport", "provider_transport", (), ("timeout", "connect", "transport", "network", "serviceunavailable"), "retry"),
    ("configuration", "provider_request_rejected", ("4xx",), (), "pause_systemic"),
    ("configuration", "invalid_configuration", (), ("valueerror", "configuration"), "pause_systemic"),
]
OTHER_FAILURE = ("internal", "unclassified_runtime_error", "retry")


def seed_jobs(episodes: DataFrame, id_col: str, text_col: str, budget: int = 3) -> DataFrame:
    """One pending job for each episode."""
    from tessella.functions.text import fingerprint

    return episodes.select(F.col(id_col).alias("id"), fingerprint(text_col).alias("fingerprint"), F.lit("pending").alias("state"), F.lit(0).alias("used"), F.lit(budget).alias("budget"), F.lit(1).alias("generation"))


def apply_sources(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Bring jobs to the current (id, fingerprint): a changed source resets its
    job in a new generation, an equal one changes nothing, a new one is
    seeded; ``change`` says which."""
    j = jobs.alias("j").join(sources.alias("s"), "id", "full_outer")
    fresh, gone = F.col("j.fingerprint").isNull(), F.col("s.fingerprint").isNull()
    changed = ~fresh & ~gone & (F.col("j.fingerprint") != F.col("s.fingerprint"))
    return j.select(
        "id", F.coalesce("s.fingerprint", "j.fingerprint").alias("fingerprint"),
        F.when(fresh | changed, "pending").otherwise(F.col("state")).alias("state"),
        F.when(fresh | changed, 0).otherwise(F.col("used")).alias("used"), F.coalesce("budget", F.lit(3)).alias("budget"),
        F.when(fresh, 1).when(changed, F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"),
        F.when(fresh, "new").when(changed, "reset").when(gone, "orphan").otherwise("same").alias("change"),
    )


def eligible(as_of: Column) -> Column:
    return ((F.col("state") == "pending") | ((F.col("state") == "retry_wait") & (F.col("next_at") <= as_of))) & (F.col("used") < F.col("budget"))


def claim(jobs: DataFrame, as_of: Column, limit: int, lease_seconds: int, owner: str) -> DataFrame:
    """The next ``limit`` jobs by state and waiting time, leased to ``owner``."""
    order = [F.when(F.col("state") == "retry_wait", 0).otherwise(1), F.coalesce("next_at", "created_at"), F.col("id")]
    return jobs.filter(eligible(as_of)).orderBy(*order).limit(limit).withColumns({
        "state": F.lit("leased"), "owner": F.lit(owner), "used": F.col("used") + 1, "attempt": F.col("used") + 1,
        "lease_until": as_of + F.make_dt_interval(secs=F.lit(float(lease_seconds))),
    })


def heartbeat(jobs: DataFrame, owner: str, as_of: Column, lease_seconds: int) -> DataFrame:
    """Extend the leases that are still the owner's and have not run out."""
    own = (F.col("state") == "leased") & (F.col("owner") == owner) & (F.col("lease_until") > as_of)
    return jobs.withColumn("lease_until", F.when(own, as_of + F.make_dt_interval(secs=F.lit(float(lease_seconds)))).otherwise(F.col("lease_until")))


def transitions(attempts: DataFrame) -> DataFrame:
    """Outcome, next state and budget use of failed attempts (disposition,
    used, budget); the attempt itself is already in ``used``."""
    left = F.col("used") < F.col("budget")
    outcome = state = consumes = F.lit(None)
    for kind, needs, o, s, c in reversed(TRANSITIONS):
        hit = F.col("disposition") == kind
        hit = hit if needs is None else hit & (left == F.lit(needs))
        outcome, state, consumes = F.when(hit, o).otherwise(outcome), F.when(hit, s).otherwise(state), F.when(hit, c).otherwise(consumes)
    return attempts.withColumns({"outcome": outcome, "state": state, "consumes": consumes})


def recover_expired(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Leases that ran out wait for a retry, or are quarantined without budget."""
    out = (F.col("state") == "leased") & (F.col("lease_until") <= as_of)
    return jobs.withColumn("state", F.when(out & (F.col("used") >= F.col("budget")), "quarantined").when(out, "retry_wait").otherwise(F.col("state")))


def retry_quarantined(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """A new generation for the wanted jobs, if all of them are quarantined."""
    wanted = jobs.join(ids, "id", "left_semi")
    ok = wanted.agg((F.count(F.lit(1)) == F.count_if(F.col("state") == "quarantined")).alias("ok"))
    marked = jobs.join(ids.withColumn("_w", F.lit(True)), "id", "left").crossJoin(F.broadcast(ok))  # one row
    go = F.coalesce(F.col("_w"), F.lit(False)) & F.col("ok")
    return marked.withColumns({
        "generation": F.when(go, F.col("generation") + 1).otherwise(F.col("generation")), "used": F.when(go, 0).otherwise(F.col("used")), "state": F.when(go, "pending").otherwise(F.col("state")),
    }).drop("_w", "ok")


# The counts of a completion check that must all be one; the embedding profile's
# is looked at only where one is configured.
VERIFIED_COUNTS = ["candidate", "stable_id", "source_description", "source_fingerprint", "sync_profile", "exact"]


def verified(counts: dict[str, Column], embedding_profile: Column, fingerprint: Column, leased: Column, expired: Column) -> Column:
    """Result of a completion check. ``counts`` has a column for each of
    VERIFIED_COUNTS and for ``embedding_profile``; the source must be the leased one."""
    exact = embedding_profile.isNull() | (counts["embedding_profile"] == 1)
    for name in VERIFIED_COUNTS:
        exact = exact & (counts[name] == 1)
    return F.when(expired, "lease_expired").when(fingerprint != leased, "source_changed").when(exact, "verified").otherwise("rejected")


def failure(status: Column, name: Column) -> Column:
    """struct(class, code, disposition) of an error by its HTTP status and
    name: the first rule that fits."""
    pack = lambda c, k, d: F.struct(F.lit(c).alias("class"), F.lit(k).alias("code"), F.lit(d).alias("disposition"))
    out, name = pack(*OTHER_FAILURE), F.lower(name)
    ranges = {"4xx": (status >= 400) & (status < 500), "5xx": status >= 500}
    for kind, code, codes, words, disposition in reversed(FAILURES):
        hit = F.lit(False)
        for c in codes:
            hit = hit | F.coalesce(ranges[c] if c in ranges else status == c, F.lit(False))
        for w in words:
            hit = hit | F.coalesce(name.contains(w), F.lit(False))
        out = F.when(hit, pack(kind, code, disposition)).otherwise(out)
    return out


def legacy_synced(state: Column) -> Column:
    return state == "synced"


def numbered_calls(calls: DataFrame, parent: str, order: list[str], limit: int) -> DataFrame:
    """Calls numbered within their attempt; ``allowed`` up to the limit."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return calls.withColumn("call_number", n).withColumn("allowed", F.col("call_number") <= limit)


def rule_violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, id) of every row that breaks a named rule, in one scan."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.col(id_col).alias("id"), F.explode(broken).alias("rule"))


RUN_STATES = ["new", "running", "paused", "draining", "stopped"]
COMMANDS = {"start": (["new", "stopped"], "running"), "pause": (["running"], "paused"), "resume": (["paused"], "running"), "drain": (["running", "paused"], "draining"), "stop": (["running", "paused", "draining"], "stopped")}
FOLD = 1024


def run_states(events: DataFrame) -> DataFrame:
    """Fold of each run's commands, in order: the last one that its state
    allows decides. (run_id, state)

    FOLD commands in a row become the map of the state before them to the state
    after them; FOLD such maps in a row are composed to one, level by level, so
    that no row holds more than FOLD of a run's commands."""

    def step(state: Column, command: Column) -> Column:
        out = state
        for name, (before, after) in COMMANDS.items():
            out = F.when((command == name) & state.isin(*before), after).otherwise(out)
        return out

    every = F.array(*map(F.lit, RUN_STATES))
    numbered = events.withColumn("_n", F.row_number().over(Window.partitionBy("run_id").orderBy("at", "seq")) - 1)
    most = numbered.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    block = F.floor(F.col("_n") / FOLD)
    ordered = F.sort_array(F.collect_list(F.struct("_n", "command")))
    maps = numbered.groupBy("run_id", block.alias("_b")).agg(ordered.alias("_c")).select("run_id", F.col("_b").alias("_n"), F.transform(every, lambda s: F.aggregate("_c", s, lambda state, e: step(state, e["command"]))).alias("_to"))
    blocks = -(-most // FOLD)
    while blocks > 1:
        inner = F.aggregate("_m", every, lambda now, m: F.transform(now, lambda s: F.get(m["_to"], (F.array_position(every, s) - 1).cast("int"))))
        maps = maps.groupBy("run_id", block.alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_n", "_to"))).alias("_m")).select("run_id", F.col("_b").alias("_n"), inner.alias("_to"))
        blocks = -(-blocks // FOLD)
    return maps.select("run_id", F.get("_to", F.lit(0)).alias("state"))


class Arbiter:
    """The state of a scope: at most one run is active, and it owns the leases
    taken in it."""

    def __init__(self) -> None:
        self.run = self.state = self.profile = None
        self.leased: set = set()

    def decide(self, command: str, run_id, profile, job) -> str:
        live = self.run is not None
        if command == "start":
            if not live:
                self.run, self.state, self.profile = run_id, "running", profile
                return "started"
            if self.profile != profile:
                return "refused_profile"
            return "joined" if self.state == "running" else "refused_not_accepting"
        if command == "claim":
            if not live or self.state != "running":
                return "refused_run"
            if job in self.leased:
                return "refused_leased"
            self.leased.add(job)
            return "claimed"
        if command == "finish":
            if job not in self.leased:
                return "refused_not_leased"
            self.leased.discard(job)
            return "finished"
        if not live:
            return "refused_state"
        moves = {"pause": (("running",), "paused_systemic"), "drain": (("running",), "draining"), "resume": (("paused_systemic", "draining"), "running")}
        if command in moves:
            before, after = moves[command]
            if self.state not in before:
                return "refused_state"
            self.state = after
            return after if command != "resume" else "resumed"
        if command != "stop":
            return "refused_unknown"
        if self.leased:
            return "refused_leases"
        self.run = self.state = self.profile = None
        return "stopped"


def arbitrated(commands: DataFrame) -> DataFrame:
    """(scope, seq, command, run, decision) of commands (scope, at, seq,
    command, run_id, profile, job), folded in order (at, seq) in each scope.

    A run is started only where none is active; a second start joins a running
    run of its profile and is refused otherwise. Claims need a running run and a
    job that nobody holds; a run stops only without leases. ``run`` is the
    active run at the command. A scope's commands stream through one task in
    order; only its state is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, arbiter = None, Arbiter()
        for pdf in frames:
            out = []
            for s, seq, command, run_id, profile, job in pdf[["scope", "seq", "command", "run_id", "profile", "job"]].itertuples(index=False):
                if s != scope:
                    scope, arbiter = s, Arbiter()
                before = arbiter.run
                decision = arbiter.decide(command, run_id, profile, job)
                out.append((s, seq, command, before if before is not None else arbiter.run, decision))
            yield pd.DataFrame(out, columns=["scope", "seq", "command", "run", "decision"]).astype({"run": "Int64"})

    ordered = commands.repartition("scope").sortWithinPartitions("scope", "at", "seq").select("scope", "seq", "command", "run_id", "profile", "job")
    kind = dict(commands.dtypes)
    return ordered.mapInPandas(run, f"scope {kind['scope']}, seq {kind['seq']}, command string, run {kind['run_id']}, decision string")


def attempt_rows(decisions: DataFrame, commands: DataFrame) -> DataFrame:
    """L3: one row for each claim that was granted: (scope, run, job, attempt,
    seq), attempts of a job numbered in order."""
    own = decisions.filter("decision = 'claimed'").select("scope", "seq", "run").join(commands.select("scope", "seq", "at", "job"), ["scope", "seq"])
    return own.select("scope", "run", "job", F.row_number().over(Window.partitionBy("scope", "job").orderBy("at", "seq")).alias("attempt"), "seq")


def backfill_batches(pending: DataFrame, id_col: str, size: int, most_requests: int | None = None) -> DataFrame:
    """(batch, id): pending rows in ordered batches, all of them or, with
    ``most_requests``, those within the request limit. Rows are dealt to ranges
    of ids, each numbered by itself after the rows of the ranges before it."""
    few = pending.select(F.col(id_col).alias("id"))
    if most_requests is not None:
        few = few.orderBy("id").limit(size * most_requests)
    dealt = checkpointed(few.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each range
    n = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1 + F.col("before")
    return dealt.join(F.broadcast(before), "part").select(F.floor(n / size).alias("batch"), "id")
