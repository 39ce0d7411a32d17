"""Exact values on small fixtures."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import vectors as V
from tessella.operators import chunking, graph, lifecycle, metrics, reconcile, relational, retrieval, validation
from tessella.sources import corpus, snapshots
from tessella.streaming import jobs


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("name, want", [("Protects", "PROTECTS"), ("commands army", "COMMANDS_ARMY"), ("Uses-Material", "USES_MATERIAL"), ("fights  against", "FIGHTS_AGAINST"), ("is.part.of", "IS_PART_OF"), (" -owes!-debt ", "OWES_DEBT"), ("", "")])
def test_standard_relationship_names(spark, name, want):
    assert one(spark, X.screaming_snake(F.lit(name))) == want


@pytest.mark.parametrize(
    "text, hidden",
    [
        ("Authorization: Bearer abc.def", "abc.def"), ("https://user:pw@host/x", "user:pw"), ("GET /?token=s3cret&x=1", "s3cret"),
        ("eyJhbGciOi.eyJzdWIi.sig_1", "eyJzdWIi"), ("password = hunter2;", "hunter2"),
    ],
)
def test_redaction(spark, text, hidden):
    assert hidden not in one(spark, X.redact(F.lit(text)))


def test_summary_title_and_type(spark):
    md = "# The Hall\n\nFirst line here.\n## Part\nSecond line."
    assert one(spark, X.title_of(F.lit(md), F.lit("canon/locations/old_hall.md"))) == "The Hall"
    assert one(spark, X.title_of(F.lit("text"), F.lit("canon/locations/old_hall.md"))) == "Old Hall"
    assert one(spark, X.summary_of(F.lit(md))) == "First line here. Second line."
    assert one(spark, X.document_type(F.lit("canon/locations/old_hall.md"))) == "location"
    assert one(spark, X.document_type(F.lit("canon/x.md"))) == "lore"


def test_retry_after_and_uuid(spark):
    none, now = F.lit(None).cast("string"), F.lit("2024-06-01 00:00:00").cast("timestamp")
    assert one(spark, X.retry_after_seconds(none, F.lit("250"))) == 0.25
    assert one(spark, X.retry_after_seconds(F.lit("7"), F.lit("-1"))) == 7.0
    assert one(spark, X.retry_after_seconds(F.lit("-3"))) == 0.0
    assert one(spark, X.retry_after_seconds(F.lit("Sat, 01 Jun 2024 00:00:30 GMT"), now=now)) == 30.0
    assert one(spark, X.retry_after_seconds(F.lit("12"))) == 12.0
    assert one(spark, X.retry_after_seconds(F.lit("soon"))) is None
    assert one(spark, X.uuid_in(F.lit("episode 0F8FAD5B-D9CB-469F-A165-70867728950E!"))) == "0f8fad5b-d9cb-469f-a165-70867728950e"


def test_vector_problems(spark):
    rows = [(1, [3.0, 4.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0])]
    got = dict(spark.createDataFrame(rows, "id int, v array<double>").select("id", V.problem(F.col("v"), 2)).collect())
    assert got == {1: None, 2: "dimension", 3: "zero_norm", 4: "missing", 5: "not_finite"}


def test_character_chunks_reach_the_end(spark):
    docs = spark.createDataFrame([(1, "x" * 500), (2, "y" * 951), (3, ""), (4, None)], "id int, t string")
    got = {(r["id"], r["chunk_index"]): (r["start"], r["end"]) for r in chunking.character_chunks(docs, "id", "t").collect()}
    assert got == {(1, 0): (0, 500), (2, 0): (0, 500), (2, 1): (450, 950), (2, 2): (900, 951)}


def test_header_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\na\n## Two\nb")], "id int, t string")
    got = [(r["header"], r["text"]) for r in chunking.header_sections(docs, "id", "t").orderBy("section").collect()]
    assert got == [("", "intro"), ("One", "# One\na"), ("Two", "## Two\nb")]


def test_semantic_chunker_priorities():
    c = chunking.SemanticChunker()
    assert c.starts_new(450, 60, 1.0)
    assert not c.starts_new(100, 10, 0.0)
    assert c.starts_new(150, 10, 0.3) and not c.starts_new(150, 10, 0.5)
    assert c.starts_new(250, 10, 0.65) and not c.starts_new(250, 10, 0.75)
    pieces = c.chunk([f"s{i} " + "w " * 99 for i in range(8)], [[1.0, i % 2] for i in range(8)], "T")
    assert pieces[0][0].startswith("s0") and all(p.startswith("[Continuing from T]") for p, _ in pieces[1:])


def test_retrieval_case_values(spark):
    j = spark.createDataFrame([("c", "a", 3), ("c", "b", 1)], "case_id string, doc_id string, grade int")
    worse = spark.createDataFrame([("c", "x", 1), ("c", "a", 2), ("c", "b", 3)], "case_id string, doc_id string, rank int")
    r = metrics.case_scores(j, worse).first()
    assert (r["recall_5"], r["recall_10"], r["rr"], r["first_rank"]) == (1.0, 1.0, 0.5, 2) and 0 < r["ndcg"] < 1
    best = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "case_id string, doc_id string, rank int")
    r = metrics.case_scores(j, best).first()
    assert (r["recall_5"], r["rr"], r["ndcg"]) == (1.0, 1.0, 1.0)
    assert metrics.ranking_problems(worse.union(worse.limit(1))).count() == 2


def test_relationship_policy_decisions(spark):
    nodes = spark.createDataFrame([("Alpha", "1"), ("Beta", "2"), ("Twin", "3"), ("Twin", "4"), ("Alias", "1")], "name string, id string")
    rows = [
        (1, 1, "Alpha", "Beta", "OpposedTo", "f1"), (2, 2, "Alpha", "Beta", "opposed-to", "f2"), (3, 3, "Alpha", "Nobody", "OpposedTo", "f"), (4, 4, "Alpha", "Twin", "OpposedTo", "f"),
        (5, 5, "Alpha", "Alpha", "OpposedTo", "f"), (6, 6, "Alpha", "Beta", "OpposedTo", " "), (7, 7, "Alpha", "Beta", "likes", "f"), (8, 8, "Alpha", "Beta", "OPPOSED_TO", "F1"), (9, 9, "Alpha", "Alias", "OpposedTo", "f"), (10, 10, "Alias", "Beta", "opposed to", " f1 "),
        (11, 11, "Alpha", "Beta", "opposedto", "g"), (12, 12, "Alpha", "Beta", " Opposed.To", "h"), (13, 13, "Alpha", "Beta", "opposes", "h"), (14, 14, "Alpha", "Beta", "RELATES_TO", "h"),
    ]
    p = spark.createDataFrame(rows, "id int, pos int, source string, target string, type string, fact string")
    got = {r["id"]: r["decision"] for r in reconcile.proposal_policy(p, nodes, ["OpposedTo"]).collect()}
    assert got == {1: "accepted", 2: "normalized", 3: "missing_endpoint", 4: "ambiguous_endpoint", 5: "self_edge", 6: "empty_fact", 7: "unknown_type", 8: "duplicate", 9: "self_edge", 10: "duplicate", 11: "unknown_type", 12: "normalized", 13: "unknown_type", 14: "unknown_type"}


def test_progress_example(spark):
    row = [(2, 0, 0, 0, 8, "running", 300, 5)]
    r = reconcile.progress(spark.createDataFrame(row, "pending int, leased int, retry_wait int, quarantined int, synced int, run_state string, window int, recent int")).first()
    assert (r["percent"], r["rate"], r["eta_status"], r["eta_seconds"]) == (80.0, 1.0, "available", 120)


def test_best_duplicate_stays(spark):
    rows = [("rel1", "a", "b", "Knows", ""), ("rel2", "a", "b", "knows ", ""), ("rel3", "a", "b", "KNOWS", "fact")]
    edges = spark.createDataFrame(rows, "id string, src string, dst string, type string, fact string")
    got = {r["id"]: r["kept_id"] for r in validation.duplicate_corrections(edges).collect()}
    assert got == {"rel1": "rel3", "rel2": "rel3"}
    plan = validation.correction_plan(edges)
    done = validation.apply_corrections(edges, plan)
    assert done.count() == 1
    assert {tuple(r) for r in validation.roll_back(done, plan).collect()} == {tuple(r) for r in edges.collect()}


def test_components_and_merge(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "id long")
    edges = spark.createDataFrame([(1, 0), (2, 1), (5, 4), (6, 5), (6, 2), (7, 99)], "src long, dst long")
    got = dict(graph.connected_components(nodes, edges).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 0, 6: 0, 7: 7, 8: 8}
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "3"), ("b", "4"), ("c", "9")], "grp string, id string")
    merged = dict(graph.merge_overlapping(members, ["a", "b", "c"]).collect())
    assert merged == {"a": "a", "b": "a", "c": "c"}


def test_claim_leases_in_order(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "pending", 0, 3, t0, None), (2, "retry_wait", 1, 3, t0, t0), (3, "retry_wait", 1, 3, t0, dt.datetime(2030, 1, 1)), (4, "pending", 3, 3, t0, None), (5, "synced", 1, 3, t0, None)]
    jobs_ = spark.createDataFrame(rows, "id int, state string, used int, budget int, created_at timestamp_ntz, next_at timestamp_ntz")
    got = lifecycle.claim(jobs_, F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'"), 10, 60, "w").collect()
    assert [(r["id"], r["attempt"]) for r in got] == [(2, 2), (1, 1)]


def test_nearest_rank_and_budget(spark):
    assert one(spark, relational.nearest_rank(F.array(*(F.lit(float(i)) for i in range(1, 21))), 0.95)) == 19.0
    assert one(spark, relational.nearest_rank(F.array().cast("array<double>"), 0.5)) == 0.0
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 40), (2, 1, 999)], "k int, n int, c int")
    got = {(r["k"], r["n"]) for r in relational.greedy_budget(rows, "k", [F.col("n")], "c", 100).collect()}
    assert got == {(1, 1), (1, 3), (2, 1)}


def test_full_text_needs_all_terms(spark):
    rows = spark.createDataFrame([(1, "the hall of kings"), (2, "the hall"), (3, "of kings of old the end")], "id int, text string")
    got = [r["id"] for r in retrieval.text_top_k(rows, {"text": "A"}, ["the", "of"], 10).collect()]
    assert got == [3, 1]


def test_markdown_source(spark, tmp_path):
    (tmp_path / "canon" / "locations").mkdir(parents=True)
    (tmp_path / "canon" / "locations" / "blade.md").write_text("# Blade\nA sharp thing.")
    (tmp_path / "canon" / "x.txt").write_text("no")
    got = corpus.described(corpus.markdown_files(spark, str(tmp_path / "canon"))).collect()
    assert [(r["title"], r["document_type"], r["words"]) for r in got] == [("Blade", "location", 5)]
    assert corpus.inside("canon", "canon/a/b.MD") and not corpus.inside("canon", "canon/../b.md") and not corpus.inside("canon", "canon/a.txt")


def test_json_corpus_is_checked(spark, tmp_path):
    import json

    case = {"case_id": "c1", "query": "q", "expected_entities": [], "judgments": [{"document_stable_id": "d1", "episode_index": 0, "source_fingerprint": "f", "relevance": 3}]}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"schema_version": 1, "cases": [case]}))
    bad.write_text(json.dumps({"schema_version": 1, "cases": [case, case]}))
    c = corpus.json_corpus(spark, str(good))
    assert corpus.unknown_references(c, spark.createDataFrame([("d2",)], "document_stable_id string")).count() == 1
    with pytest.raises(ValueError):
        corpus.json_corpus(spark, str(bad))


def test_stream_fold_equals_batch(spark, sf_dir):
    stream = jobs.job_states(jobs.event_stream(spark, f"{sf_dir}/events.parquet*"))
    got = jobs.drained(stream, "states_test", "update").groupBy("user_id").agg(F.max_by("state", "events").alias("state"))
    want = jobs.job_states_batch(spark.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", "state")
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect()))


def test_token_stream_folds_to_messages(spark, tmp_path):
    rows = [(1, 1, "Hel", False), (1, 2, "lo", False), (2, 1, "x", False), (1, 3, "Hello.", True)]
    spark.createDataFrame(rows, "stream_id long, seq long, token string, final boolean").coalesce(1).write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema("stream_id long, seq long, token string, final boolean").parquet(str(tmp_path / "t"))
    got = {r["stream_id"]: (r["text"], r["done"]) for r in jobs.drained(jobs.messages(s), "messages_test", "update").collect()}
    assert got == {1: ("Hello.", True), 2: ("x", False)}


def test_foreach_batch_merge(spark, tmp_path):
    src = tmp_path / "in"
    for i, v in enumerate(["a", "b"]):
        spark.createDataFrame([(1, i, v), (10 + i, 0, v)], "id int, version int, value string").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("id int, version int, value string").option("maxFilesPerTrigger", 1).parquet(str(src))
    held = snapshots.BucketedSnapshot(spark, str(tmp_path / "out"), "id int, version int, value string", "id", "version", 4)
    jobs.load_incrementally(s, held, None, "value", str(tmp_path / "cp"))
    assert {(r["id"], r["value"]) for r in held.read().collect()} == {(1, "b"), (10, "a"), (11, "b")}


def test_temporal_order_over_several_ranges(spark):
    rows = [(i, None if i % 5 == 0 else (i * 37) % 50) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, day int").repartition(3)
    out = reconcile.temporal_order(df, F.col("day"), ["id"])
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    ids = [i for i, day in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    assert {(r["id"], r["previous"], r["following"]) for r in out.collect()} == set(zip(ids, [None, *ids], [*ids[1:], None]))
    assert out.columns == ["id", "day", "previous", "following"]
    assert reconcile.temporal_order(df.limit(0), F.col("day"), ["id"]).count() == 0


def test_reverse_edges_count_the_pair_before_the_type(spark):
    rows = [
        ("r1", "a", "b", "Allied With"), ("r2", "c", "d", "Allied With"), ("r3", "d", "c", "rules"), ("r4", "e", "f", "related_to"),
        ("r5", "g", "h", "RELATES_TO"), ("r6", "h", "g", "friend_of"), ("r7", "i", "j", "enemy_of"), ("r8", "j", "i", "enemy_of"),
    ]
    edges = spark.createDataFrame(rows, "id string, src string, dst string, type string")
    assert {r["subject"] for r in validation.missing_reverse(edges, validation.SYMMETRIC).collect()} == {"r1", "r6"}


@pytest.mark.parametrize("props, want", [
    ({"fact_embedding": None, "name_embedding": None, "name": "x", "fact": "y", "created_at": None, "episodes": '["1","2","3"]'}, 100 + 100 + 50 + 30 + 10 + 15 + 6),
    ({"name": "", "fact": None}, 2), ({"episodes": "one"}, 6), ({"episodes": str(["x"] * 20).replace("'", '"')}, 51), ({}, 0),
])
def test_completeness_points(spark, props, want):
    df = spark.createDataFrame([(props,)], "p map<string,string>")
    assert df.select(validation.completeness(F.col("p"))).first()[0] == want


@pytest.mark.parametrize("props, want", [({"kind": "rules", "name": "x"}, "rules"), ({"type": None, "name": "x"}, "None"), ({"fact": "He LEADS them"}, "commands"), ({"fact": "nothing"}, None), ({}, None)])
def test_semantic_type_by_key(spark, props, want):
    assert spark.createDataFrame([(props,)], "p map<string,string>").select(validation.semantic_type(F.col("p"))).first()[0] == want


@pytest.mark.parametrize("status, name, want", [
    (None, "RuntimeError", ("internal", "unclassified_runtime_error", "retry")), (401, "x", ("authentication", "provider_authentication", "pause_systemic")),
    (503, "x", ("transport", "provider_http_transient", "retry")), (404, "x", ("configuration", "provider_request_rejected", "pause_systemic")),
    (429, "JSONDecodeError", ("malformed_json", "malformed_model_output", "retry")), (None, "ReadTimeout", ("transport", "provider_transport", "retry")),
])
def test_failure_classes(spark, status, name, want):
    assert tuple(one(spark, lifecycle.failure(F.lit(status).cast("int"), F.lit(name)))) == want


def packed(text, least, most, overlap):
    """The packing rules, one unit after the other."""
    count = lambda t: len(t.split())
    if count(text) <= most:
        return [text]
    out, held = [], ""
    for p in text.split("\n\n"):
        for unit, end in [(s, " ") for s in re.split(r"(?<=[.!?])\s+", p)] if count(p) > most else [(p, "\n\n")]:
            if count(held) + count(unit) <= most:
                held += unit + end
                continue
            if count(held) >= least:
                out.append(held.strip())
            held = (held[-overlap:] if len(held) > overlap else "") + unit + end
    return out + ([held.strip()] if held.strip() and count(held) >= least else [])


def test_packed_paragraphs_with_overlap(spark):
    texts = ["short text", "", "One two three. " * 30, "\n\n".join(f"para {i} " + "word " * (i % 7) for i in range(40)), "a b c d e f g h i j k l\n\n" + "x y. " * 40 + "\n\nend of it", "word " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in sorted(chunking.packed_paragraphs(df, "id", "text", least=5, most=20, overlap=10).collect(), key=lambda r: r["chunk_index"]):
        got[r["id"]].append(r["text"])
    assert got == {i: packed(t, 5, 20, 10) for i, t in enumerate(texts)}


def test_keywords(spark):
    text = 'the Iron Gate of Arn said "by oath" and "by oath" in the  Old Hall. École Thé'
    assert one(spark, X.keywords(F.lit(text))) == ["Iron Gate", "Arn", "Old Hall", "by oath"]


def test_drained_streams_stay_out_of_the_driver(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, "x")], "id long, v string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    s = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*/part-*")
    got = jobs.drained(s, "drained_test", "append")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2]
    assert len(got.inputFiles()) >= 3  # written by the executors, not held in a memory table
    empty = spark.readStream.schema("id long, v string").parquet(str(tmp_path))
    assert jobs.drained(empty.filter("id < 0"), "drained_none", "append").count() == 0


def test_weighted_paths_write_no_round(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", float(rng.randrange(4))) for _ in range(60)]
    edges = spark.createDataFrame(rows, "src string, dst string, distance double")
    starts = spark.createDataFrame([("n0",), ("n3",), ("n9",), ("none",)], "id string")
    calls, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: calls.append(df.columns) or kept(df))
    got = sorted(map(str, graph.weighted_paths(edges, starts).collect()))
    assert all("path" not in c for c in calls)  # paths are never written
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    assert sorted(map(str, graph.weighted_paths(edges, starts).collect())) == got
    w = {}
    for a, b, x in rows:
        w[a, b] = min(x, w.get((a, b), x))
    want = {}
    for s in ("n0", "n3", "n9"):
        front = {s: (0.0, 0, [s])}
        best = {}
        for hop in range(1, 6):
            new = {}
            for at, (far, _, path) in front.items():
                for (a, b), x in w.items():
                    if a == at and b not in path:
                        new[b] = min(new.get(b, (far + x, hop, [*path, b])), (far + x, hop, [*path, b]))
            front = {b: v for b, v in new.items() if b not in best or v[0] < best[b][0]}
            best |= front
        want |= {(s, b): v for b, v in best.items()}
    assert {(r["start"], r["id"]): (r["distance"], r["hops"], r["path"]) for r in graph.weighted_paths(edges, starts).collect()} == want


def test_paths_of_a_start_are_found_in_one_task(spark):
    import random

    rng = random.Random(7)
    later = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", float(rng.randrange(3))) for _ in range(90)]
    rows = later + [(f"s{i}", f"n{rng.randrange(30)}", float(rng.randrange(3))) for i in range(200) for _ in range(3)] + [("s1", "leaf", 1.0), ("n3", "s1", 0.0), ("s2", None, 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, distance double")
    starts = spark.createDataFrame([(f"s{i}",) for i in range(200)] + [("n3",), ("s1",), ("none",)], "id string")
    found = graph.weighted_paths(edges, starts, sep=">")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "array_contains" not in plan  # no round sorts all paths
    got = {(r["start"], r["id"]): (r["distance"], r["hops"], r["path"].split(">")) for r in found.collect()}
    assert got == {(r["start"], r["id"]): (r["distance"], r["hops"], r["path"]) for r in graph.weighted_paths(edges, starts).collect()}
    w = {}
    for a, b, x in rows:
        w[a, b] = min(x, w.get((a, b), x))
    want = {}
    for s in {f"s{i}" for i in range(200)} | {"n3"}:
        front, best = {s: (0.0, 0, [s])}, {}
        for hop in range(1, 6):
            new = {}
            for at, (far, _, path) in front.items():
                for (a, b), x in w.items():
                    if a == at and b is not None and b not in path:
                        new[b] = min(new.get(b, (far + x, hop, [*path, b])), (far + x, hop, [*path, b]))
            best |= {b: v for b, v in new.items() if b not in best or v < best[b]}
            front = new  # each hop's best, as in the SQL
        want |= {(s, b): v for b, v in best.items()}
    assert got == want and ("s1", "leaf") in got


def test_overlaps_meet_by_blocks(spark):
    import random

    rng = random.Random(3)
    rows = [(u, rng.randrange(40) if rng.random() < 0.9 else None) for u in range(70) for _ in range(rng.randrange(9))] + [(None, 1)]
    sets = {}
    for u, v in rows:
        if u is not None and v is not None:
            sets.setdefault(u, set()).add(v)
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = relational.set_overlaps(spark.createDataFrame(rows, "u long, v long"), "u", "v", size=20)
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().toString()  # no row for each shared value


def test_overlaps_shuffle_no_copies(spark):
    import random

    rng = random.Random(9)
    sets = {f"u{i}": {f"v{rng.randrange(60)}" for _ in range(rng.randrange(1, 12))} for i in range(300)}
    df = spark.createDataFrame([(u, v) for u, vs in sets.items() for v in vs], "u string, v string")
    got = relational.set_overlaps(df, "u", "v", size=30)
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "explode" not in plan  # a block is read where it meets another, not sent there
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert relational.set_overlaps(df.filter("u is null"), "u", "v").count() == 0


def test_budget_reads_few_rows_in_order(spark):
    rows = [("a", i, i * 7919 % 50) for i in range(3000)] + [("b", i, 60 + i) for i in range(100)] + [("c", 1, None), ("c", 2, 3)] + [(None, i, 5) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i long, cost int")
    want, used, first = set(), {}, {}
    for k, i, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        first.setdefault(k, (k, i, c))
        if c is not None and used.get(k, 0) + c <= 50:
            used[k] = used.get(k, 0) + c
            want.add((k, i, c))
    want |= {v for k, v in first.items() if k not in used}
    out = relational.greedy_budget(df, "k", [F.asc("i")], "cost", 50)
    assert set(map(tuple, out.collect())) == want
    assert "Window" in out._jdf.queryExecution().toString()  # rows that cannot fit go before they are read in order


def test_backfill_covers_every_row(spark):
    ids = [i * 37 % 1009 for i in range(1000)] + [None, None]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").repartition(7)
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    got = [tuple(r) for r in lifecycle.backfill_batches(rows, "i", 32).collect()]
    assert sorted(got, key=str) == sorted([(n // 32, i) for n, i in enumerate(order)], key=str)
    assert lifecycle.backfill_batches(rows, "i", 32, 4).count() == 128


def test_orphans_send_each_end_once(spark, sf_dir):
    from tessella.plans import catalog

    plan = catalog.queries()["v06_orphans"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" in plan and "Aggregate [l_suppkey" not in plan and "Aggregate [src" not in plan


def test_semantic_chunks_hold_few_documents_at_a_time(spark):
    rows = [(i, f"t{i}", [f"{w} {i} " * 40 for w in ("one", "two", "three")] if i % 9 else [], [[1.0, i / 50], [0.5, 1.0], [1.0, 0.0]] if i % 9 else []) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, t string, s array<string>, v array<array<double>>").coalesce(1)
    want = {(i, j, text, n) for i, t, s, v in rows for j, (text, n) in enumerate(chunking.SemanticChunker().chunk(s, v, t))}
    out = chunking.semantic_chunks(df, "i", "t", "s", "v", size=7)
    assert set(map(tuple, out.collect())) == want


def test_library_tokens_beyond_the_cut_are_only_counted(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tessella.functions import tokens

    encode, decode = tokens.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "one", "Größe 漢字 \U0001f600\U0001f680 end " * 9, "plain words here"]
    for most in range(0, 14):
        for (n, first), whole in zip(encode.head(texts, most + 1), encode(texts), strict=True):
            assert n == len(whole) and first == whole[: most + 1]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    plain = lambda rows: encode(rows)
    for most in (0, 3, 11, 300):
        got, want = (sorted(map(tuple, tokens.tokenised(df, "i", "text", e, most, decode).collect())) for e in (encode, plain))
        assert got == want
