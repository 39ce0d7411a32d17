"""Shadow vector spaces: a second set of vectors that is filled beside the live one.

A backfill run works through the episodes whose vector is missing or was made
from an older source. Each batch is reserved in an append-only ledger before the
model is called and closed after it, with the source compared both times, so a
vector of a changed text is never stored and a killed run can be recovered.

``sources`` are (id, fingerprint), ``vectors`` (id, fingerprint, embedding).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.reconcile import snapshot_identity

MOST_REQUESTS = 100
ITEMS = "ordinal int, position int, id long, fingerprint string, state string"


def pending(sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, fingerprint) of the sources without a vector of their own state."""
    held = vectors.select("id", F.col("fingerprint").alias("_held"))
    return sources.select("id", "fingerprint").join(held, "id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_held"))).drop("_held")


def coverage(sources: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: stored, current and stale vectors."""
    now = sources.select("id", F.col("fingerprint").alias("_now"))
    fresh = F.col("fingerprint").eqNullSafe(F.col("_now"))
    return vectors.select("id", "fingerprint").join(now, "id", "left").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(fresh).alias("current"), F.count_if(~fresh).alias("stale")
    )


def reserve(waiting: DataFrame, sources: DataFrame, size: int, requests: int) -> DataFrame:
    """(ordinal, position, id, fingerprint, state): the next ``requests``
    batches of ``size`` in the order of ids, fenced by the sources as they are
    now. A batch with an episode that is gone or changed is ``refused``, and no
    later one is reserved."""
    if not 1 <= requests <= MOST_REQUESTS:
        raise ValueError(f"a run has 1 to {MOST_REQUESTS} requests")
    few = waiting.orderBy("id").limit(size * requests)  # the ceiling is the feature; it bounds the window below
    n = F.row_number().over(Window.orderBy("id")) - 1
    items = few.select((F.floor(n / size) + 1).cast("int").alias("ordinal"), (n % size).cast("int").alias("position"), "id", "fingerprint")
    same = F.col("fingerprint").eqNullSafe(F.col("_now")) & F.col("_now").isNotNull()
    fenced = items.join(sources.select("id", F.col("fingerprint").alias("_now")), "id", "left")
    return _until(fenced, ~same, "refused", "reserved")


def _until(items: DataFrame, bad: Column, named: str, otherwise: str) -> DataFrame:
    """``items`` up to the first batch with a bad one, which is ``named``."""
    whole = Window.partitionBy(F.lit(1))  # at most MOST_REQUESTS batches
    first = items.groupBy("ordinal").agg(F.max(bad).alias("_bad")).withColumn("_first", F.min(F.when(F.col("_bad"), F.col("ordinal"))).over(whole))
    kept = items.join(F.broadcast(first), "ordinal").filter(F.col("_first").isNull() | (F.col("ordinal") <= F.col("_first")))
    return kept.select("ordinal", "position", "id", "fingerprint", F.when(F.col("_bad"), named).otherwise(otherwise).alias("state"))


def finalize(reserved: DataFrame, made: DataFrame, sources: DataFrame, dimensions: int) -> DataFrame:
    """(ordinal, episodes, state, failure_code) of the reserved batches.

    A batch fails if the model gave no vector of the right width and of finite
    numbers for one of its episodes; a failure ends the run, so later batches
    stay reserved. A batch whose source changed since it was reserved is closed
    as ``source_changed`` and stores nothing; the others have ``succeeded``.
    """
    x = F.col("embedding")
    valid = x.isNotNull() & (F.size(x) == dimensions) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    now = sources.select("id", F.col("fingerprint").alias("_now"))
    seen = reserved.filter("state = 'reserved'").select("ordinal", "id", "fingerprint").join(made.select("id", "embedding"), "id", "left").join(now, "id", "left")
    batches = seen.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("episodes"), F.max(~F.coalesce(valid, F.lit(False))).alias("_bad"), F.max(~F.coalesce(F.col("fingerprint") == F.col("_now"), F.lit(False))).alias("_moved")
    )
    first = F.min(F.when(F.col("_bad"), F.col("ordinal"))).over(Window.partitionBy(F.lit(1)))  # at most MOST_REQUESTS batches
    state = F.when(F.col("ordinal") > first, "reserved").when(F.col("_bad"), "failed").when(F.col("_moved"), "source_changed").otherwise("succeeded")
    code = F.when(state == "failed", "provider_request_failed")
    return batches.select("ordinal", "episodes", state.alias("state"), code.alias("failure_code"))


def store(vectors: DataFrame, reserved: DataFrame, batches: DataFrame, made: DataFrame) -> DataFrame:
    """``vectors`` with those of the succeeded batches in place of older ones."""
    good = reserved.join(F.broadcast(batches.filter("state = 'succeeded'").select("ordinal")), "ordinal", "left_semi")  # at most MOST_REQUESTS
    new = good.select("id", "fingerprint").join(made.select("id", "embedding"), "id")
    return vectors.select("id", "fingerprint", "embedding").join(new.select("id"), "id", "left_anti").unionByName(new)


def recover(batches: DataFrame) -> DataFrame:
    """Batches of a killed run: what is still reserved is abandoned."""
    open_ = F.col("state") == "reserved"
    return batches.withColumns({"failure_code": F.when(open_, "operator_recovery").otherwise(F.col("failure_code")), "state": F.when(open_, "abandoned").otherwise(F.col("state"))})


def run_report(batches: DataFrame, target: DataFrame, now: DataFrame, vectors: DataFrame, recovered: bool = False) -> DataFrame:
    """One row: state, failure_code, reserved, succeeded, target, stored.

    ``target`` are the sources when the run began, ``now`` those at its end,
    ``vectors`` what is stored then. A failed batch fails the run; a recovered
    run is stopped, as is one whose sources moved or that has not covered them;
    a batch that is still reserved leaves it running."""
    counts = batches.agg(
        F.count(F.lit(1)).alias("reserved"), F.count_if(F.col("state").isin("succeeded", "source_changed")).alias("succeeded"), F.count_if(F.col("state") == "failed").alias("_failed"), F.count_if(F.col("state") == "reserved").alias("_open")
    )
    prints = [f"h{i}" for i in range(4)]
    was, is_ = (snapshot_identity(s, "id", "fingerprint") for s in (target, now))
    same = was.select(F.col("rows").alias("target"), F.struct("rows", *prints).alias("_was")).crossJoin(is_.select(F.struct("rows", *prints).alias("_is")))  # one row each
    j = counts.crossJoin(same).crossJoin(coverage(now, vectors).select(F.col("current").alias("stored")))  # one row each
    moved, done = F.col("_was") != F.col("_is"), F.col("stored") == F.col("target")
    state = F.when(F.col("_failed") > 0, "failed").when(F.lit(recovered), "stopped").when(F.col("_open") > 0, "running").when(~moved & done, "completed").otherwise("stopped")
    code = F.when(F.col("_failed") > 0, "provider_request_failed").when(F.lit(recovered), "operator_recovery").when(F.col("_open") > 0, None).when(moved, "source_snapshot_changed").when(~done, "provider_request_limit_reached")
    stored = F.when(F.lit(recovered), F.least("target", "stored")).otherwise(F.col("stored"))
    return j.select(state.alias("state"), code.alias("failure_code"), "reserved", "succeeded", "target", stored.alias("stored"))


def space_findings(spaces: DataFrame, vectors: DataFrame, sources: DataFrame) -> DataFrame:
    """Q10: (space, stored, current, stale, findings) of each registered space
    (space, state, ready_identity, ready_count) from its ``vectors`` (space, id,
    fingerprint); findings are sorted codes."""
    now = sources.select("id", F.col("fingerprint").alias("_now"))
    fresh = F.col("fingerprint").eqNullSafe(F.col("_now"))
    held = vectors.join(now, "id", "left").groupBy("space").agg(F.count(F.lit(1)).alias("stored"), F.count_if(fresh).alias("current"), F.count_if(~fresh).alias("stale"))
    one = snapshot_identity(sources, "id", "fingerprint").select(F.col("rows").alias("_rows"), F.concat_ws(":", "rows", "h0", "h1", "h2", "h3").alias("_identity"))
    j = spaces.join(held, "space", "left").na.fill(0, ["stored", "current", "stale"]).crossJoin(F.broadcast(one))  # one row
    ready = F.col("state") == "ready"
    rules = {
        "shadow_space_retired": F.col("state") == "retired", "shadow_source_stale": F.col("stale") > 0, "shadow_coverage_incomplete": F.col("current") != F.col("_rows"),
        "shadow_snapshot_mismatch": ready & ~F.col("ready_identity").eqNullSafe(F.col("_identity")), "shadow_ready_count_mismatch": ready & ~F.col("ready_count").eqNullSafe(F.col("_rows")),
    }
    codes = F.array_sort(F.array_compact(F.array(*(F.when(ok, F.lit(code)) for code, ok in rules.items()))))
    return j.select("space", "stored", "current", "stale", codes.alias("findings"))


class ShadowLedger:
    """The ledger on storage: one folder for each run with what was reserved,
    how it was closed and the vectors it made. Every step writes a folder of its
    own whole, so a step that is run again leaves the same rows."""

    def __init__(self, spark: SparkSession, root: str, dimensions: int) -> None:
        self.spark, self.root, self.dimensions = spark, root, dimensions

    def _path(self, run: int, what: str) -> str:
        return f"{self.root}/run={run}/{what}"

    def _has(self, run: int, what: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(run, what)}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, run: int, what: str) -> DataFrame:
        return self.spark.read.parquet(self._path(run, what))

    def runs(self) -> list[int]:
        """The numbers of the runs so far: one folder each."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.listStatus(at) if fs.exists(at) else []
        return sorted(int(s.getPath().getName().removeprefix("run=")) for s in found if s.getPath().getName().startswith("run="))

    def vectors(self, before: int | None = None) -> DataFrame:
        """The vectors of all closed runs (before one): the latest run wins."""
        own = [r for r in self.runs() if (before is None or r < before) and self._has(r, "vectors")]
        rows = self.spark.createDataFrame([], "id long, fingerprint string, embedding array<double>, run int")
        for r in own:
            rows = rows.unionByName(self._read(r, "vectors").withColumn("run", F.lit(r)))
        latest = F.max_by(F.struct("fingerprint", "embedding", "run"), "run").alias("v")
        return rows.groupBy("id").agg(latest).select("id", "v.*")

    def reserve(self, run: int, sources: DataFrame, size: int, requests: int) -> DataFrame:
        """Begin a run and reserve its batches. A run that is not closed blocks
        every later one; its own reservation is read again, not made anew."""
        active = [r for r in self.runs() if r != run and self._has(r, "reserved") and not self._has(r, "closed")]
        if active:
            raise ValueError(f"run {active[0]} is active")
        if not self._has(run, "reserved"):
            sources.select("id", "fingerprint").write.mode("overwrite").parquet(self._path(run, "target"))
            target = self._read(run, "target")
            reserve(pending(target, self.vectors(before=run)), target, size, requests).write.mode("overwrite").parquet(self._path(run, "reserved"))
        return self._read(run, "reserved")

    def close(self, run: int, made: DataFrame, sources: DataFrame) -> DataFrame:
        """Close the batches of a run with what the model made."""
        reserved, empty = self._read(run, "reserved"), self.spark.createDataFrame([], "id long, fingerprint string, embedding array<double>")
        batches = finalize(reserved, made, sources, self.dimensions)
        store(empty, reserved, batches, made).write.mode("overwrite").parquet(self._path(run, "vectors"))
        batches.write.mode("overwrite").parquet(self._path(run, "closed"))
        return self._read(run, "closed")

    def recover(self, run: int) -> DataFrame:
        """Close a killed run: its open batches are abandoned."""
        if not self._has(run, "reserved") or self._has(run, "closed"):
            raise ValueError("only a running backfill can be recovered")
        open_ = self._read(run, "reserved").groupBy("ordinal").agg(F.count(F.lit(1)).alias("episodes"), F.first("state").alias("state"))
        recover(open_.withColumn("failure_code", F.lit(None).cast("string"))).write.mode("overwrite").parquet(self._path(run, "closed"))
        return self._read(run, "closed")

    def report(self, run: int, now: DataFrame) -> DataFrame:
        closed = self._read(run, "closed")
        return run_report(closed, self._read(run, "target"), now, self.vectors(), recovered=not closed.filter("state = 'abandoned'").isEmpty())

    def backfill(self, run: int, sources: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame], size: int, requests: int) -> DataFrame:
        """Reserve, embed, close, report. ``sources`` is read at every
        fence; ``embed`` turns (id, fingerprint) into (id, embedding)."""
        reserved = self.reserve(run, sources(), size, requests)
        self.close(run, embed(reserved.filter("state = 'reserved'").select("id", "fingerprint")), sources())
        return self.report(run, sources())
