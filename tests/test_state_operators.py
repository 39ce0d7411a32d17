"""Shadow ledgers, rebuild guards, projections, timers, snapshots, maintained
views, table functions, arbitration, keyed state and tokens."""

import datetime as dt
import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions import tables, tokens
from tessella.operators import graph, lifecycle, maintained, projection, rebuild, shadow, validation
from tessella.sources import snapshots
from tessella.streaming import jobs, timers

SOURCE, VECTOR = "id long, fingerprint string", "id long, fingerprint string, embedding array<double>"


def sources(spark, changed=(), gone=(), n=10):
    return spark.createDataFrame([(i, "new" if i in changed else f"f{i}") for i in range(n) if i not in gone], SOURCE)


def embed(items):
    return items.select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))


# -- shadow spaces
def test_batches_are_fenced_twice(spark):
    held = spark.createDataFrame([(0, "f0", [0.0, 1.0]), (1, "old", [9.0, 9.0])], VECTOR)
    now = sources(spark)
    waiting = shadow.pending(now, held)
    assert sorted(r["id"] for r in waiting.collect()) == list(range(1, 10))
    reserved = shadow.reserve(waiting, now, 2, 3)
    assert [(r["ordinal"], r["position"], r["id"]) for r in reserved.orderBy("id").collect()] == [(1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4), (3, 0, 5), (3, 1, 6)]
    refused = shadow.reserve(waiting, sources(spark, changed={4}), 2, 3)
    assert {(r["ordinal"], r["state"]) for r in refused.collect()} == {(1, "reserved"), (2, "refused")}
    made = embed(now).withColumn("embedding", F.when(F.col("id") == 5, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("embedding")))
    batches = shadow.finalize(reserved, made, sources(spark, changed={2}, gone={4}), 2)
    assert {r["ordinal"]: r["state"] for r in batches.collect()} == {1: "source_changed", 2: "source_changed", 3: "failed"}
    early = made.withColumn("embedding", F.when(F.col("id") == 1, None).otherwise(F.col("embedding")))
    batches = shadow.finalize(reserved, early, now, 2)
    assert {r["ordinal"]: r["state"] for r in batches.collect()} == {1: "failed", 2: "reserved", 3: "reserved"}
    with pytest.raises(ValueError):
        shadow.reserve(waiting, now, 2, 101)


def test_killed_run_is_recovered(spark, tmp_path):
    def vectors(ledger):
        return sorted((r["id"], r["fingerprint"], tuple(r["embedding"])) for r in ledger.vectors().collect())

    def killed(items):
        raise RuntimeError("killed")

    whole = shadow.ShadowLedger(spark, str(tmp_path / "whole"), 2)
    report = whole.backfill(1, lambda: sources(spark), embed, 3, 4).first()
    assert report.asDict() == {"state": "completed", "failure_code": None, "reserved": 4, "succeeded": 4, "target": 10, "stored": 10}
    ledger = shadow.ShadowLedger(spark, str(tmp_path / "killed"), 2)
    assert ledger.backfill(1, lambda: sources(spark), embed, 3, 2).first()["failure_code"] == "provider_request_limit_reached"
    with pytest.raises(RuntimeError):
        ledger.backfill(2, lambda: sources(spark), killed, 3, 4)
    with pytest.raises(ValueError, match="run 2 is active"):
        ledger.reserve(3, sources(spark), 3, 4)
    again = [tuple(r) for r in ledger.reserve(2, sources(spark, changed={7}), 3, 4).orderBy("id").collect()]
    assert {r[2] for r in again} == {6, 7, 8, 9}  # its own reservation, not a new one
    assert {r["state"] for r in ledger.recover(2).collect()} == {"abandoned"}
    assert ledger.report(2, sources(spark)).first()["failure_code"] == "operator_recovery"
    with pytest.raises(ValueError):
        ledger.recover(2)
    assert ledger.backfill(3, lambda: sources(spark), embed, 3, 4).first()["state"] == "completed"
    assert vectors(ledger) == vectors(whole)
    before = vectors(ledger)
    ledger.close(3, embed(sources(spark)), sources(spark))  # the same step once more
    assert vectors(ledger) == before and ledger.runs() == [1, 2, 3]


# -- rebuild
def test_rebuild_runs_through_and_refuses(spark):
    episodes = spark.createDataFrame([("a", i, f"f{i}") for i in range(4)], "scope string, id long, fingerprint string")
    done = episodes.withColumns({"state": F.lit("synced"), "profile": F.lit("p1")})
    runs = spark.createDataFrame([("a", "stopped")], "scope string, state string")
    none = spark.createDataFrame([], "scope string, state string, profile string, identity string, episodes long")
    found = rebuild.inventory(episodes, done, runs, none)
    audited = found.select("scope", F.col("episodes").alias("audit_episodes"), F.col("identity").alias("audit_identity"))
    step = rebuild.prepare(found, audited)
    assert step.first()["refusal"] is None
    assert rebuild.prepare(found, audited.withColumn("audit_identity", F.lit("x"))).first()["refusal"] == "inventory_changed"
    assert rebuild.prepare(found, audited.limit(0)).first()["refusal"] == "inventory_changed"
    operations, waiting = rebuild.operations_after(none, step, "p2"), rebuild.requeued(done, step, "p2")
    now = rebuild.inventory(episodes, waiting, runs, operations)
    assert rebuild.prepare(now, audited).first()["refusal"] == "rebuild_active" and rebuild.finalize(now, audited).first()["refusal"] == "wrong_state"
    assert rebuild.cleared(rebuild.inventory(episodes, done, runs, operations)).first()["refusal"] == "jobs_changed"
    step = rebuild.cleared(now)
    assert (step.first()["refusal"], step.first()["state"]) == (None, "ready")
    operations = rebuild.operations_after(operations, step, "p2")
    assert rebuild.drained(rebuild.inventory(episodes, waiting, runs, operations)).first()["refusal"] == "not_synced"
    synced = waiting.withColumn("state", F.lit("synced"))
    step = rebuild.drained(rebuild.inventory(episodes, synced, runs, operations))
    operations = rebuild.operations_after(operations, step, "p2")
    last = rebuild.finalize(rebuild.inventory(episodes, synced, runs, operations), audited)
    assert (last.first()["refusal"], last.first()["state"]) == (None, "completed")
    busy = spark.createDataFrame([("a", "running")], "scope string, state string")
    assert rebuild.finalize(rebuild.inventory(episodes, synced, busy, operations), audited).first()["refusal"] == "active_run"
    swapped = episodes.withColumn("fingerprint", F.concat(F.lit("g"), "fingerprint"))
    assert rebuild.finalize(rebuild.inventory(swapped, synced.withColumn("fingerprint", F.concat(F.lit("g"), "fingerprint")), runs, operations), audited).first()["refusal"] == "inventory_changed"
    assert [r["event"] for r in rebuild.events(last).collect()] == ["final_audit_passed"]


# -- projections
SECRET = "the raven's secret"
REPORTS = {
    "AUDIT": ("status string, note string, counts struct<episodes: long, lifecycle: map<string, long>, text: string>, metadata_coverage map<string, int>, drift map<string, array<struct<id: string, text: string>>>, names array<string>",
              ("drift", SECRET, (-3, {"synced": 4}, SECRET), {"stable_id": 2}, {"missing": [("1", SECRET), ("2", SECRET)], "extra": []}, [SECRET]),
              {"status": "drift", "counts": {"episodes": 0, "lifecycle": {"synced": 4}}, "metadata_coverage": {"stable_id": 2}, "drift": {"missing": 2, "extra": 0}, "names": 1}),
    "PREFLIGHT": ("status string, scope string, spaces array<struct<semantic_index: string, status: string, ready: boolean, configured_profile: struct<fingerprint: string, prompt: string>, physical: struct<dimensions: int, sample: string>, findings: array<struct<code: string, severity: string, message: string>>>>",
                  ("ready", "s", [("episodes", "ok", True, ("fp", SECRET), (64, SECRET), [("c1", "error", SECRET)]), ("names", "ok", None, None, (3, None), None)]),
                  {"status": "ready", "scope": "s", "spaces": [{"semantic_index": "episodes", "status": "ok", "ready": True, "configured_profile": {"fingerprint": "fp"}, "physical": {"dimensions": 64}, "findings": [{"code": "c1", "severity": "error"}]},
                                                              {"semantic_index": "names", "status": "ok", "ready": False, "physical": {"dimensions": 3}, "findings": []}]}),
    "QUALITY": ("status string, run struct<id: string, state: string, prompt: string>, vocabulary struct<fingerprints: array<string>, mixed: boolean, words: array<string>>, relationships map<string, long>, rejection_reasons map<string, long>, facts array<string>",
                ("ok", ("7", "stopped", SECRET), (["v1"], None, [SECRET, SECRET]), {"accepted": 3}, {"empty_fact": 1}, [SECRET]),
                {"status": "ok", "run": {"id": "7", "state": "stopped"}, "vocabulary": {"fingerprints": ["v1"], "mixed": False, "words": 2}, "relationships": {"accepted": 3}, "rejection_reasons": {"empty_fact": 1}, "facts": 1}),
    "RUN_SUMMARY": ("status string, run struct<id: string, last_failure_code: string, last_failure_summary: string>, progress map<string, double>, attempts map<string, string>",
                    ("available", ("1", "timeout", SECRET), {"percent": 50.0}, {"last": SECRET}), {"status": "available", "run": {"id": "1", "last_failure_code": "timeout"}, "progress": {"percent": 50.0}, "attempts": 1}),
    "SYNC_STATUS": ("counts map<string, int>, active_run struct<id: string, worker: string>, total long, jobs array<struct<title: string>>",
                    ({"pending": -1}, None, 5, [(SECRET,)]), {"counts": {"pending": 0}, "total": 5, "jobs": 1}),
}


@pytest.mark.parametrize("name", REPORTS)
def test_no_text_survives_a_projection(spark, name):
    schema, row, want = REPORTS[name]
    reports = spark.createDataFrame([(row,)], f"report struct<{', '.join(c.replace(' ', ': ', 1) for c in _columns(schema))}>")
    out = projection.projected(reports, "report", getattr(projection, name))
    text = out.select(F.to_json("report")).first()[0]
    assert "raven" not in text
    assert json.loads(text) == want


def _columns(schema):
    """Top-level columns of a DDL string."""
    depth, out = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


# -- paths and corrections
def test_weighted_paths_take_the_shortest(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 0.0), ("c", "d", 0.0), ("d", "e", 1.0), ("e", "f", 1.0), ("f", "g", 1.0), ("a", "b", 9.0), ("b", "d", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, distance double")
    starts = spark.createDataFrame([("a",), ("g",), ("z",)], "id string")
    got = {(r["start"], r["id"]): (r["distance"], r["hops"], ">".join(r["path"])) for r in graph.weighted_paths(df, starts).collect()}
    assert got == {("a", "b"): (1.0, 1, "a>b"), ("a", "c"): (2.0, 2, "a>b>c"), ("a", "d"): (2.0, 2, "a>b>d"), ("a", "e"): (3.0, 3, "a>b>d>e"), ("a", "f"): (4.0, 4, "a>b>d>e>f"), ("a", "g"): (5.0, 5, "a>b>d>e>f>g")}
    short = {r["id"] for r in graph.weighted_paths(df, starts, most=4).collect()}
    assert short == {"b", "c", "d", "e", "f"}


def test_plan_stops_by_a_running_total(spark):
    rows = [(f"{g}{i}", g, "x", "Knows Well", "") for g in "abc" for i in range(4)] + [(f"r{i}", f"n{i}", "y", "some-type", "") for i in range(9)]
    edges = spark.createDataFrame(rows, "id string, src string, dst string, type string, fact string")
    plan = lambda most: sorted((r["action"], r["id"]) for r in validation.correction_plan(edges, most=most).collect())
    first = [("delete", f"a{i}") for i in (1, 2, 3)]
    assert plan(2) == first
    assert plan(3) == first
    assert plan(4) == first + [("delete", f"b{i}") for i in (1, 2, 3)]
    deletes = [("delete", f"{g}{i}") for g in "abc" for i in (1, 2, 3)]
    assert plan(9) == deletes
    assert plan(11) == deletes + [("rename", "a0"), ("rename", "a1")]
    assert len(plan(1000)) == len(plan(None)) == 9 + 21


def test_statistics_count_renames_to_an_empty_type(spark):
    rows = [("a", "x", "y", " - ", ""), ("b", "x", "y", "KNOWS", ""), ("c", "x", "z", "", ""), ("d", "x", "z", "%", "")]
    edges = spark.createDataFrame(rows, "id string, src string, dst string, type string, fact string")
    plan = validation.correction_plan(edges)
    assert {(r["id"], r["new_type"]) for r in plan.collect()} == {("a", ""), ("d", "")}
    assert validation.rollback_statistics(plan).first()["renames"] == 2
    assert {r["id"]: r["type"] for r in validation.apply_corrections(edges, plan).collect()} == {"a": "", "b": "KNOWS", "c": "", "d": ""}


# -- snapshots and state
def _bytes(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_merge_rewrites_only_what_it_touches(spark, tmp_path):
    held = snapshots.BucketedSnapshot(spark, str(tmp_path / "t"), "id long, version int, value string", "id", "version", 32)
    rows = lambda ids, v: spark.createDataFrame([(i, v, f"v{v}-{i}" * 40) for i in ids], "id long, version int, value string")
    assert held.read().count() == 0 and held.manifest() == {}
    assert held.merge(rows(range(3000), 1), 0)
    whole = _bytes(tmp_path / "t/data/v=0")
    assert held.changes(rows([1, 2, 9000], 1), "value").orderBy("id").collect() == [(1, "refresh"), (2, "refresh"), (9000, "insert")]
    assert held.merge(rows([5, 9000], 2), 1)
    assert _bytes(tmp_path / "t/data/v=1") < whole / 8
    state = sorted(map(tuple, held.read().collect()))
    assert len(state) == 3001 and (5, 2, "v2-5" * 40) in state
    assert not held.merge(rows([5, 6], 3), 1)  # the epoch is there
    assert sorted(map(tuple, held.read().collect())) == state
    (tmp_path / "t/manifest/e=2").mkdir()  # an epoch that died before its manifest was whole
    assert held.epochs() == [0, 1] and held.merge(rows([], 4), 2) and held.merge(rows([7], 5), 3)
    assert held.merge(rows([7], 1), 4) and (7, 5, "v5-7" * 40) in set(map(tuple, held.read().collect()))  # an older row loses
    now = sorted(map(tuple, held.read().collect()))
    gone = held.expire(keep=1)
    assert 3 in gone and held.epochs() == [4] and sorted(map(tuple, held.read().collect())) == now


def test_failed_job_write_is_found_again(spark, tmp_path):
    src = tmp_path / "in"
    for i, (value, ids) in enumerate([("a", range(6)), ("b", [1, 2])]):
        spark.createDataFrame([(k, i, value) for k in ids], "id long, version int, value string").coalesce(1).write.mode("append").parquet(str(src))
    kept = snapshots.BucketedSnapshot(spark, str(tmp_path / "s"), "id long, version int, value string", "id", "version", 4)
    queue = snapshots.BucketedSnapshot(spark, str(tmp_path / "j"), "id long, generation int, state string", "id", "generation", 4)
    stream = spark.readStream.schema("id long, version int, value string").option("maxFilesPerTrigger", 1).parquet(str(src))
    for run in ("one", "two"):  # the second checkpoint delivers everything again
        jobs.load_incrementally(stream, kept, queue, "value", str(tmp_path / run))
        assert {(r["id"], r["generation"]) for r in queue.read().collect()} == {(0, 1), (1, 2), (2, 2), (3, 1), (4, 1), (5, 1)}


def test_state_store_forgets(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string, updated_at timestamp")
    store = snapshots.StateStore(spark, str(tmp_path / "s"), hours=5, buckets=4)
    store.put(rows(("a", "1", t(1)), ("b", "2", t(1)), ("c", "3", t(4))))
    store.put(rows(("a", "1b", t(3)), ("c", None, t(5))))
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("nobody",)], "key string")
    get = lambda h: {(r["key"], r["value"]) for r in store.get(keys, F.lit(t(h))).collect()}
    assert get(5) == {("a", "1b"), ("b", "2")} and get(7) == {("a", "1b")} and get(12) == set()
    assert store.compact(F.lit(t(7))) > 0
    assert {r["key"] for r in store.rows.read().collect()} == {"a"}  # gone from the files
    assert store.compact(F.lit(t(7))) == 0
    store.rows.expire(keep=1)
    assert get(7) == {("a", "1b")} and not any("a" == p.name for p in (tmp_path / "s").rglob("*"))


# -- timers
def test_state_store_drops_what_outlived_its_time(spark, tmp_path):
    src = tmp_path / "in"
    for seq, value in enumerate(["first", "second"]):
        spark.createDataFrame([("k", seq, value)], "key string, seq long, value string").coalesce(1).write.mode("append").parquet(str(src))
    read = lambda: spark.readStream.schema("key string, seq long, value string").option("maxFilesPerTrigger", 1).parquet(str(src))

    def counts(millis, name, wait):
        seen = []

        def keep(batch, epoch):
            seen.extend((r["value"], r["n"]) for r in batch.collect())
            time.sleep(wait)

        with timers.rocksdb(spark):
            q = timers.forgetting(read(), millis).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / name)).start()
            until = time.time() + 60
            while len(seen) < 2 and q.isActive and time.time() < until:
                time.sleep(0.2)
            q.stop()
        return seen

    assert counts(3_600_000, "long", 0) == [("first", 1), ("second", 2)]
    assert counts(500, "short", 1.5) == [("first", 1), ("second", 1)]
    assert spark.conf.get(timers.PROVIDER, None) != timers.ROCKSDB


# -- maintained views
@pytest.mark.parametrize("seed", [1, 2])
def test_views_follow_their_changes(spark, seed):
    rnd = random.Random(seed)
    schema = "id long, grp string, kind string, value double"
    row = lambda i: (i, rnd.choice("abcd"), rnd.choice(["x", "y", "z", None]), float(rnd.randrange(20)))
    table = {i: row(i) for i in range(60)}
    k = ["grp"]
    df = lambda: spark.createDataFrame(list(table.values()), schema)
    view, held, ends = maintained.counted(df(), k, ["value"]), maintained.bag(df(), k, "kind"), maintained.extremes(df(), k, "value")
    for step in range(3):
        before, changes = df(), []
        for i in rnd.sample(sorted(table), 15):
            old = table.pop(i)
            if rnd.random() < 0.5:
                table[i] = row(i)
            changes.append((old, table.get(i)))
        for i in range(1000 * step + 100, 1000 * step + 110):
            table[i] = row(i)
            changes.append((None, table[i]))
        if step == 2:  # a whole group goes
            changes += [(r, None) for r in table.values() if r[1] == "a" and r[0] not in {c[1][0] for c in changes if c[1]}]
            changes = [(a, None if b and b[1] == "a" else b) for a, b in changes]
            changes = [c for c in changes if c != (None, None)]
            table = {i: r for i, r in table.items() if r[1] != "a"}
        moved = spark.createDataFrame(changes, f"old struct<{schema.replace(' ', ': ').replace(',:', ',')}>, new struct<{schema.replace(' ', ': ').replace(',:', ',')}>")
        base = maintained.applied(before, moved, "id")
        assert sorted(map(str, base.collect())) == sorted(map(str, df().collect()))
        view, held, ends = maintained.maintained(view, moved, k, ["value"]), maintained.maintained_bag(held, moved, k, "kind"), maintained.maintained_extremes(ends, moved, base, k, "value")
        same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert same(view, maintained.counted(df(), k, ["value"])) and same(ends, maintained.extremes(df(), k, "value"))
        assert same(maintained.distinct_counts(held, k, "n"), maintained.distinct_counts(maintained.bag(df(), k, "kind"), k, "n"))
        view, held, ends = graph.checkpointed(view), graph.checkpointed(held), graph.checkpointed(ends)


# -- table functions, arbitration, tokens
def test_table_functions_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "DEDUPLICATION", "DELETE", None, None), (1, "SEMANTIC_STANDARDIZATION", "UPDATE", True, 0.9), (2, "DEDUPLICATION", "DELETE", False, 0.95)], "batch long, type string, action string, rolled_back boolean, confidence double").createOrReplaceTempView("t_corr")
    got = {tuple(r) for r in spark.sql("SELECT * FROM correction_batch_summary(TABLE(t_corr) PARTITION BY batch)").collect()}
    assert got == {(1, 2, 1, 1, 1, 1, 1, 0.9), (2, 1, 1, 0, 1, 0, 0, 0.95)}
    joined = spark.sql("SELECT s.batch, s.total_corrections FROM correction_batch_summary(TABLE(SELECT * FROM t_corr WHERE action = 'DELETE') PARTITION BY batch) s ORDER BY 1").collect()
    assert [tuple(r) for r in joined] == [(1, 1), (2, 1)]


def test_only_one_run_is_active(spark):
    said = [
        ("start", 1, "p", 0, "started"), ("claim", 1, "p", 7, "claimed"), ("claim", 1, "p", 7, "refused_leased"), ("start", 2, "q", 0, "refused_profile"), ("start", 3, "p", 0, "joined"), ("stop", 1, "p", 0, "refused_leases"),
        ("drain", 1, "p", 0, "draining"), ("claim", 1, "p", 8, "refused_run"), ("start", 4, "p", 0, "refused_not_accepting"), ("finish", 1, "p", 7, "finished"), ("finish", 1, "p", 7, "refused_not_leased"), ("resume", 1, "p", 0, "resumed"),
        ("resume", 1, "p", 0, "refused_state"), ("claim", 1, "p", 7, "claimed"), ("finish", 1, "p", 7, "finished"), ("pause", 1, "p", 0, "paused_systemic"), ("stop", 1, "p", 0, "stopped"), ("stop", 1, "p", 0, "refused_state"), ("start", 5, "q", 0, "started"), ("dance", 5, "q", 0, "refused_unknown"),
    ]
    rows = [(s, i, i, c, r, p, j) for s in ("x", "y") for i, (c, r, p, j, _) in enumerate(said)]
    random.Random(1).shuffle(rows)
    commands = spark.createDataFrame(rows, "scope string, at long, seq long, command string, run_id long, profile string, job long")
    decisions = lifecycle.arbitrated(commands)
    for scope in ("x", "y"):
        assert [r["decision"] for r in decisions.filter(F.col("scope") == scope).orderBy("seq").collect()] == [d for *_, d in said]
    attempts = lifecycle.attempt_rows(decisions, commands).filter("scope = 'x'").orderBy("seq").collect()
    assert [(r["run"], r["job"], r["attempt"]) for r in attempts] == [(1, 7, 1), (1, 7, 2)]


def test_truncation_cuts_at_a_token_and_decodes_back(spark):
    import public_tokenizers

    texts = ["", None, "one", "Tokens are pieces of words, naïve café déjà-vu. " * 9, "日本語のテキスト 👩‍👩‍👧 emoji 🏳️‍🌈" * 5, "  spaces \n\n\t and  tabs  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    encode, decode = tokens.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for most in (0, 1, 7, 20, 10_000):
        for r in tokens.tokenised(df, "id", "text", encode, most, decode).collect():
            text = texts[r["id"]] or ""
            assert r["n_tokens"] == len(encode([text])[0]) and r["kept"] <= most
            assert text.startswith(r["truncated"]) and r["decoded"] == r["truncated"]
            if r["n_tokens"] <= most:
                assert r["truncated"] == text
            else:  # not even one more character fits
                assert r["kept"] <= r["n_tokens"]
    words = df.select("id", tokens.word_count(F.col("text")).alias("n"), tokens.word_truncated(F.col("text"), 3).alias("cut")).orderBy("id").collect()
    assert [(r["n"], r["cut"]) for r in words][:3] == [(0, ""), (0, ""), (1, "one")] and words[3]["cut"] == "Tokens are pieces" and words[5]["cut"] == "  spaces \n\n\t and  tabs"


# -- records
def test_embedding_reports_the_batches_that_failed(spark):
    from tessella.sources import corpus

    def model(texts):
        if "bad" in texts:
            raise TimeoutError("no answer")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "a", None), (2, "bad", None), (3, "ccc", None), (4, "dd", [9.0])], "id long, text string, v array<double>").coalesce(1)
    made = corpus.embed_missing(rows, "id", "text", "v", model, size=1)
    assert {(r["id"], tuple(r["v"]) if r["v"] else None, r["error"]) for r in made.collect()} == {(1, (1.0,), None), (2, None, "TimeoutError"), (3, (3.0,), None)}
    filled = {r["id"]: r["v"] for r in corpus.with_embeddings(rows, "id", "v", made).collect()}
    assert filled == {1: [1.0], 2: None, 3: [3.0], 4: [9.0]}


def test_oversize_text_is_cut_and_order_kept(spark):
    from tessella.operators import reports

    rows = spark.createDataFrame([("k", 1, 0.1, "a b", 2), ("k", 2, 0.9, "c d e", 3), ("k", 3, 0.5, "f", 1), ("big", 1, 0.3, "one two three four", 4), ("big", 2, 0.9, "a b c d e f g", 7)], "key string, pos int, score double, text string, cost int")
    got = {(r["key"], r["pos"]): (r["rank"], r["text"]) for r in reports.within_budget(rows, "key", "pos", "score", "text", "cost", 3).collect()}
    assert got == {("k", 2): (1, "c d e"), ("big", 2): (1, "a b c")}
    got = {(r["key"], r["pos"]): r["rank"] for r in reports.within_budget(rows, "key", "pos", "score", "text", "cost", 5).collect()}
    assert got == {("k", 2): 1, ("k", 3): 2, ("big", 1): 1}


def test_extraction_corpus_must_hold_together(spark):
    from tessella.operators import reports

    case = lambda i, entities, relations: (i, "text", True, True, entities, relations)
    rows = [(1, [
        case("a", [("x", ["X"]), ("y", ["Y"])], [("x", "y", ["KNOWS"])]), case("b", [("x", []), ("x", ["X"])], [("x", "ghost", ["T"]), ("x", "x", [])]), case("b", None, None),
    ])]
    got = {tuple(r) for r in reports.extraction_problems(spark.createDataFrame(rows, reports.EXTRACTION_CORPUS)).collect()}
    assert got == {("b", "duplicate_case", "b"), ("b", "duplicate_entity", "x"), ("b", "no_aliases", "x"), ("b", "unknown_entity", "ghost"), ("b", "no_types", "x>x")}


def test_more_than_sixteen_groups_merge(spark):
    members = [(f"g{i:02}", i * 10 + k) for i in range(20) for k in range(14)] + [("lone", 10_000)]
    df = spark.createDataFrame(members, "grp string, id long")
    order = [*sorted({g for g, _ in members if g != "lone"}), "lone", "empty"]
    got = dict(map(tuple, graph.merge_overlapping(df, order).collect()))
    assert got == {f"g{i:02}": f"g{i:02}" for i in range(20)} | {"lone": "lone", "empty": "empty"}  # 4 of 14 is below 0.3
    got = dict(map(tuple, graph.merge_overlapping(df, order, 0.28).collect()))
    assert {got[f"g{i:02}"] for i in range(20)} == {"g00"} and got["lone"] == "lone"
    edges = spark.createDataFrame([("g00", "a", "b", "t"), ("g01", "a", "b", "t"), ("lone", "a", "b", "t")], "grp string, src string, dst string, type string")
    merged = graph.merged_edges(edges, spark.createDataFrame(list(got.items()), "grp string, merged string"))
    assert sorted(map(tuple, merged.collect())) == [("g00", "a", "b", "t"), ("lone", "a", "b", "t")]


def test_run_states_fold_in_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(r, i, i, rnd.choice([*lifecycle.COMMANDS, "unknown"])) for r in range(6) for i in range(rnd.choice([1, 3, 4, 17, 40]))]

    def fold(commands):
        state = "new"
        for c in commands:
            before, after = lifecycle.COMMANDS.get(c, ([], ""))
            state = after if state in before else state
        return state

    want = {r: fold(c for k, _, _, c in rows if k == r) for r in range(6)}
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "run_id long, at long, seq long, command string")
    for size in (1024, 3, 2):
        monkeypatch.setattr(lifecycle, "FOLD", size)
        assert dict(map(tuple, lifecycle.run_states(df).collect())) == want
    assert lifecycle.run_states(df.limit(0)).count() == 0


def test_exactly_once_keeps_its_ids_in_rocksdb(spark, sf_dir, monkeypatch):
    from tessella.plans import catalog
    from tessella.streaming import jobs, timers

    seen, drained = [], jobs.drained

    def spy(stream, *rest):
        seen.append((spark.conf.get(timers.PROVIDER), sorted(stream.columns)))
        return drained(stream, *rest)

    monkeypatch.setattr(jobs, "drained", spy)
    assert catalog.queries()["t08_exactly_once"](spark, sf_dir).count() > 0
    assert seen == [(timers.ROCKSDB, ["delivery", "event_id", "event_type", "ts"])]


@pytest.mark.parametrize("name, source, made", [("t05_expired_sessions", "events", "late-*/in/0"), ("t06_incremental_load", "documents", "load-*/in/1")])
def test_streamed_lots_are_written_by_many_tasks(spark, sf_dir, tmp_path, name, source, made):
    import glob
    import shutil

    from tessella.operators.graph import shared_folder
    from tessella.plans import catalog

    shutil.copytree(sf_dir, tmp_path / "sf")
    (tmp_path / "sf" / f"{source}.parquet").unlink()
    spark.read.parquet(f"{sf_dir}/{source}.parquet").repartition(3).write.parquet(f"{tmp_path}/sf/{source}.parquet")
    root = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/{made}"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a file to a task
    try:
        assert catalog.queries()[name](spark, f"{tmp_path}/sf").count() == catalog.queries()[name](spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    new = set(glob.glob(f"{root}/{made}")) - before
    assert max(len(glob.glob(f"{n}/part-*")) for n in new) == 3
