"""Report views, run summaries, rollback order, merges and small records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import lifecycle as L
from tessella.operators import preflight as P
from tessella.operators import relational as J
from tessella.operators import reports as R
from tessella.operators import retrieval as T
from tessella.operators import validation as V
from tessella.plans import inputs as I
from tessella.plans.inputs import table, with_
from tessella.plans.registry import query
from tessella.sources import corpus as C

# Reports are the customers; findings are their orders: the priority is the
# severity's, the status of an order says whether it was reviewed.
_KINDS = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]
_REPORT = """rep AS (SELECT c_custkey AS report_id, 'agent' || c_nationkey AS agent_id, c_mktsegment AS validation_type, c_name AS scope_description, c_acctbal > 0 AS success, abs(c_acctbal) AS execution_time, c_custkey % 17 AS created_at FROM customer),
 fin AS (SELECT o_orderkey AS finding_id, o_custkey AS report_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'error' WHEN '3' THEN 'warning' ELSE 'info' END AS severity, o_orderstatus AS category, substr(o_orderpriority, 1, 1)::INT AS priority, o_orderdate AS created_at, o_orderstatus = 'F' AS reviewed, o_totalprice / 1e6 AS confidence FROM orders)"""


def _reports(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    reports = c.select(F.col("c_custkey").alias("report_id"), F.concat(F.lit("agent"), "c_nationkey").alias("agent_id"), F.col("c_mktsegment").alias("validation_type"), F.col("c_name").alias("scope_description"), (F.col("c_acctbal") > 0).alias("success"), F.abs("c_acctbal").alias("execution_time"), (F.col("c_custkey") % 17).alias("created_at"))
    rank = F.substring("o_orderpriority", 1, 1)
    severity = F.when(rank == "1", "critical").when(rank == "2", "error").when(rank == "3", "warning").otherwise("info")
    none = F.lit(None).cast("string")
    findings = o.select(
        F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("report_id"), severity.alias("severity"), F.col("o_orderstatus").alias("category"), rank.cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") == "F").alias("reviewed"), (F.col("o_totalprice") / 1e6).alias("confidence"), none.alias("reviewer"), none.alias("review_action"), none.alias("review_notes"), F.lit(None).cast("int").alias("reviewed_at"),
    )
    return reports, findings


def _shown(counts):
    return F.array_join(F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")


_HEADS = """heads AS (SELECT rep.*, coalesce(n, 0) AS findings_count, coalesce(sev, '') AS severities, coalesce(cat, '') AS categories FROM rep LEFT JOIN (SELECT report_id, sum(n)::BIGINT AS n, string_agg(severity || ':' || n, ',' ORDER BY severity || ':' || n) AS sev FROM (SELECT report_id, severity, count(*) AS n FROM fin GROUP BY ALL) GROUP BY 1) USING (report_id)
 LEFT JOIN (SELECT report_id, string_agg(category || ':' || n, ',' ORDER BY category || ':' || n) AS cat FROM (SELECT report_id, category, count(*) AS n FROM fin GROUP BY ALL) GROUP BY 1) USING (report_id))"""


def _heads(spark, d):
    reports, findings = _reports(spark, d)
    return R.report_heads(reports, findings, ["F", "O", "P"])


@query("a14_count_maps", f"WITH {_REPORT}, {_HEADS} SELECT report_id, findings_count, severities, categories FROM heads")
def a14(spark, d):
    return _heads(spark, d).select("report_id", "findings_count", _shown(F.col("severity_counts")).alias("severities"), _shown(F.col("category_counts")).alias("categories"))


@query("v11_report", f"WITH {_REPORT}, {_HEADS}, big AS (SELECT report_id FROM heads ORDER BY findings_count DESC, report_id LIMIT 1) SELECT finding_id, severities, fin.severity, priority FROM heads JOIN fin USING (report_id) WHERE report_id = (SELECT report_id FROM big)")
def v11a(spark, d):
    heads, (_, findings) = _heads(spark, d), _reports(spark, d)
    largest = heads.orderBy(F.desc("findings_count"), "report_id").select("report_id").first()[0]
    return R.report(heads, findings, largest).select("finding_id", _shown(F.col("severity_counts")).alias("severities"), "severity", "priority")


@query("v11_report_list", f"WITH {_REPORT}, {_HEADS} SELECT report_id, findings_count, severities FROM heads WHERE validation_type = 'BUILDING' ORDER BY created_at DESC, report_id LIMIT 50 OFFSET 20")
def v11b(spark, d):
    return R.list_reports(_heads(spark, d), kind="BUILDING", limit=50, offset=20).select("report_id", "findings_count", _shown(F.col("severity_counts")).alias("severities"))


_REVIEWS = "rev AS (SELECT o_orderkey AS finding_id, o_orderpriority AS reviewer, CASE WHEN o_totalprice > 150000 THEN 'accept' ELSE 'reject' END AS action FROM orders WHERE o_orderstatus = 'P')"


def _reviewed(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    reviews = o.select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderpriority").alias("reviewer"), F.when(F.col("o_totalprice") > 150000, "accept").otherwise("reject").alias("action"), F.lit(None).cast("string").alias("notes"))
    unknown = reviews.limit(1).withColumn("finding_id", F.lit(-1).cast("long"))
    return R.mark_reviewed(_reports(spark, d)[1], reviews.unionByName(unknown), F.lit(7))


@query("v11_reviewed", f"WITH {_REPORT}, {_REVIEWS} SELECT fin.finding_id, reviewed OR rev.finding_id IS NOT NULL AS reviewed, rev.reviewer, action AS review_action, CASE WHEN rev.finding_id IS NOT NULL THEN 7 END AS reviewed_at FROM fin LEFT JOIN rev ON rev.finding_id = fin.finding_id")
def v11c(spark, d):
    return _reviewed(spark, d).select("finding_id", "reviewed", "reviewer", "review_action", "reviewed_at")


@query("v11_unreviewed", f"WITH {_REPORT} SELECT finding_id, validation_type, scope_description FROM fin JOIN rep USING (report_id) WHERE NOT reviewed AND severity = 'error' ORDER BY priority, fin.created_at DESC, finding_id LIMIT 100")
def v11d(spark, d):
    reports, findings = _reports(spark, d)
    return R.unreviewed(findings, reports, severity="error").select("finding_id", "validation_type", "scope_description")


@query("v11_statistics", f"""WITH {_REPORT} SELECT * FROM (SELECT count(*) AS total_reports, count(*) FILTER (WHERE success) AS successful_reports, count(DISTINCT agent_id) AS unique_agents, count(DISTINCT validation_type) AS validation_types, round(avg(execution_time), 4) AS avg_execution_time, max(created_at) AS last_report_time FROM rep),
 (SELECT count(*) AS total_findings, count(*) FILTER (WHERE reviewed) AS reviewed_findings, count(*) FILTER (WHERE severity = 'critical') AS critical_findings, count(*) FILTER (WHERE severity = 'error') AS error_findings, count(*) FILTER (WHERE severity = 'warning') AS warning_findings, count(*) FILTER (WHERE severity = 'info') AS info_findings,
 count(DISTINCT category) AS unique_categories, round(avg(confidence), 6) AS avg_confidence_score FROM fin)""")
def v11e(spark, d):
    out = R.review_statistics(*_reports(spark, d))
    return out.withColumns({"avg_execution_time": F.round("avg_execution_time", 4), "avg_confidence_score": F.round("avg_confidence_score", 6)})


# -- run summaries: an event is an attempt; its props say how many calls it made
_CALLS = """att AS (SELECT user_id % 5 AS run_id, event_id AS attempt_id, user_id AS episode_id, CASE WHEN event_type <> 'view' THEN event_type END AS outcome, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END AS proposed, event_type AS candidate, value AS latency, ts AS completed_at, regexp_extract(props, '(\\d+)', 1)::INT % 4 AS k FROM events),
 cal AS (SELECT attempt_id, n AS call_number, CASE WHEN n = k AND outcome IS NULL THEN NULL WHEN n = k AND outcome = 'error' THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN n <> 2 THEN attempt_id % 100 + n END AS tokens FROM (SELECT *, unnest(range(1, k + 1))::INT AS n FROM att)),
 job AS (SELECT 'p' || (c_custkey % 5) AS profile, c_mktsegment AS state FROM customer)"""
_STATES = ["BUILDING", "AUTOMOBILE", "MACHINERY"]
_OUTCOMES = ["purchase", "click", "error", "signup"]


def _attempts(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    attempts = e.select(
        (F.col("user_id") % 5).alias("run_id"), F.col("event_id").alias("attempt_id"), F.col("user_id").alias("episode_id"), F.when(kind != "view", kind).alias("outcome"), F.when(kind == "purchase", F.floor("value")).alias("proposed"),
        kind.alias("candidate"), F.col("value").alias("latency"), F.col("ts").alias("completed_at"), (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 4).alias("k"),
    )
    n, last = F.col("call_number"), F.col("call_number") == F.col("k")
    made = attempts.filter("k > 0").withColumn("call_number", F.explode(F.sequence(F.lit(1), F.col("k"))))
    result = F.when(last & F.col("outcome").isNull(), None).when(last & (F.col("outcome") == "error"), "failure").otherwise("success")
    calls = made.select("attempt_id", "call_number", result.alias("outcome"), F.when(n != 2, F.col("attempt_id") % 100 + n).alias("tokens"))
    return attempts, calls


@query("q03_run_calls", f"""WITH {_CALLS}, a AS (SELECT run_id, count(*) AS attempts, count(outcome) AS completed, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS outcome_{o}" for o in _OUTCOMES)}, sum(proposed)::BIGINT AS proposed, count(proposed) AS proposed_reported FROM att GROUP BY 1),
 c AS (SELECT run_id, count(*) AS calls, count(cal.outcome) AS calls_completed, count(*) FILTER (WHERE cal.outcome = 'success') AS calls_succeeded, sum(tokens)::BIGINT AS tokens, count(tokens) AS tokens_reported FROM cal JOIN att USING (attempt_id) GROUP BY 1),
 j AS (SELECT profile, {", ".join(f"count(*) FILTER (WHERE state = '{s}') AS jobs_{s}" for s in _STATES)} FROM job GROUP BY 1)
 SELECT * FROM a JOIN c USING (run_id) JOIN (SELECT substr(profile, 2)::BIGINT AS run_id, * FROM j) USING (run_id)""")
def q03c(spark, d):
    attempts, calls = _attempts(spark, d)
    runs = attempts.select("run_id").distinct().withColumn("profile", F.concat(F.lit("p"), F.col("run_id").cast("string")))
    jobs = table(spark, d, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") % 5).cast("string")).alias("profile"), F.col("c_mktsegment").alias("state"))
    return R.run_summary(runs, jobs, attempts, calls, _STATES, _OUTCOMES)


@query("q03_candidate_latency", f"WITH {_CALLS} SELECT run_id, candidate, count(*) AS attempts, count(latency) FILTER (WHERE outcome <> 'error') AS successes, round(quantile_cont(latency, 0.5) FILTER (WHERE outcome <> 'error'), 6) AS p50, round(quantile_cont(latency, 0.95) FILTER (WHERE outcome <> 'error'), 6) AS p95 FROM att GROUP BY ALL")
def q03d(spark, d):
    return R.candidate_latency(_attempts(spark, d)[0])


@query("q06_chain_with_calls", f"""WITH {_CALLS}, few AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY completed_at DESC, attempt_id DESC) <= 5),
 c AS (SELECT attempt_id, string_agg(call_number || '=' || coalesce(outcome, 'open'), '+' ORDER BY call_number) AS calls FROM cal GROUP BY 1)
 SELECT episode_id, string_agg(attempt_id || ':' || coalesce(outcome, '-') || '[' || coalesce(calls, '') || ']', ',' ORDER BY completed_at, attempt_id) AS chain FROM few LEFT JOIN c USING (attempt_id) GROUP BY episode_id""")
def q06b(spark, d):
    one = lambda c: F.concat(c["call_number"].cast("string"), F.lit("="), F.coalesce(c["result"], F.lit("open")))
    said = lambda a: F.concat(a["attempt_id"].cast("string"), F.lit(":"), F.coalesce(a["outcome"], F.lit("-")), F.lit("["), F.array_join(F.transform(a["calls"], one), "+"), F.lit("]"))
    return R.attempt_chain(*_attempts(spark, d)).select("episode_id", F.array_join(F.transform("chain", said), ",").alias("chain"))


# -- rollback -----------------------------------------------------------------
_LIVE = "app AS (SELECT o_orderkey::VARCHAR AS id, o_custkey AS batch, o_orderdate AS applied_at, CASE WHEN o_orderpriority < '3' THEN 'delete' ELSE 'rename' END AS action, o_totalprice > 20000 AS backed, o_orderstatus = 'F' AS undone FROM orders), here AS (SELECT DISTINCT o_orderkey::VARCHAR AS id FROM orders WHERE o_totalprice > 200000)"


def _applied(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("batch"), F.col("o_orderdate").alias("applied_at"), F.when(F.col("o_orderpriority") < "3", "delete").otherwise("rename").alias("action"),
        F.when(F.col("o_totalprice") > 20000, "{}").alias("backup"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("rolled_back_at"),
    )


@query("x07_rollback_order", f"WITH {_LIVE} SELECT id, batch, row_number() OVER (PARTITION BY batch ORDER BY applied_at DESC, id DESC)::INT AS step FROM app WHERE NOT undone")
def x07c(spark, d):
    return R.rollback_order(_applied(spark, d)).select("id", "batch", "step")


@query("x07_rollback_totals", f"""WITH {_LIVE}, r AS (SELECT batch, CASE WHEN NOT backed THEN false WHEN action = 'delete' THEN here.id IS NULL ELSE here.id IS NOT NULL END AS good FROM app LEFT JOIN here ON here.id = app.id WHERE NOT undone)
 SELECT batch, count(*) AS total, count(*) FILTER (WHERE good) AS undone, count(*) FILTER (WHERE NOT good) AS failed, bool_and(good) AS success FROM r GROUP BY batch""")
def x07d(spark, d):
    here = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").cast("string").alias("id"))
    steps = R.rollback_order(_applied(spark, d))
    return R.rollback_totals(steps, V.rollback_report(here, steps))


# -- retrieval ----------------------------------------------------------------
_WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_BUDGET = f"""b AS (SELECT lang, doc_id, n_chars, len(regexp_extract_all(text, '{_WORD}')) AS cost, text FROM documents), i AS (SELECT lang, list(struct_pack(id := doc_id, used := cost::BIGINT, kept := []::BIGINT[]) ORDER BY n_chars DESC, doc_id) AS rows FROM b GROUP BY lang),
 f AS (SELECT lang, rows[1].id AS first, list_reduce(rows, lambda a, x: CASE WHEN a.used + x.used <= 900 THEN struct_pack(id := x.id, used := a.used + x.used, kept := list_append(a.kept, x.id)) ELSE a END, struct_pack(id := 0::BIGINT, used := 0::BIGINT, kept := []::BIGINT[])) AS r FROM i),
 k AS (SELECT b.* FROM b JOIN f USING (lang) WHERE list_contains(CASE WHEN len(r.kept) = 0 THEN [first] ELSE r.kept END, doc_id))"""


@query("r12_budget_in_order", f"""WITH {_BUDGET} SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS rank, sha256(CASE WHEN cost > 900 THEN array_to_string(list_slice(regexp_extract_all(text, '\\s*(?:{_WORD})'), 1, 900), '') ELSE text END) AS text FROM k""")
def r12b(spark, d):
    from tessella.functions.tokens import word_count

    rows = table(spark, d, "documents").select("lang", "doc_id", "n_chars", "text", word_count(F.col("text")).alias("cost"))
    return R.within_budget(rows, "lang", "doc_id", "n_chars", "text", "cost", 900).select("lang", "doc_id", "rank", F.sha2("text", 256).alias("text"))


def _results(spark, d):
    """Three queries meet the tables: rich customers, those of large nations
    and all; entities are their segments, relations their nations."""
    c = table(spark, d, "customer")
    hits = c.filter("c_acctbal > 5000").withColumn("q", F.lit(1)).unionByName(c.filter("c_nationkey > 12").withColumn("q", F.lit(2))).unionByName(c.withColumn("q", F.lit(3)))
    hits = hits.withColumn("pos", F.col("c_custkey"))
    name = F.when(F.col("c_custkey") % 10 > 0, F.col("c_mktsegment")).otherwise("")
    entities = hits.select("q", "pos", name.alias("name"), (F.col("c_nationkey") % 3).alias("type"))
    relations = hits.select("q", "pos", F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("target"))
    graph = hits.select("q", "pos", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string"))).otherwise("").alias("uuid"), F.when(F.col("c_nationkey") > 3, F.concat(F.lit("i"), F.col("c_nationkey").cast("string"))).alias("id"))
    edges = hits.select("q", "pos", F.col("c_mktsegment").alias("source"), (F.col("c_nationkey") % 5).alias("target"), F.lit("IN").alias("type"), F.when(F.col("c_acctbal") > 0, "rich").alias("fact"))
    return R.merged_results(hits.select("q", "pos", F.col("c_name").alias("text")), entities, relations, graph, edges)


_HITS = "h AS (SELECT *, c_custkey AS pos FROM (SELECT *, 1 AS q FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT *, 2 FROM customer WHERE c_nationkey > 12 UNION ALL SELECT *, 3 FROM customer))"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY q, pos) = 1"


@query("r13_entities", f"WITH {_HITS} SELECT q, pos, c_mktsegment AS name, c_nationkey % 3 AS type FROM h WHERE c_custkey % 10 > 0 {_FIRST.format('c_mktsegment, c_nationkey % 3')}")
def r13b(spark, d):
    return _results(spark, d)["entities"]


@query("r13_relations", f"WITH {_HITS} SELECT q, pos, c_mktsegment AS source, c_nationkey::VARCHAR AS target FROM h {_FIRST.format('c_mktsegment, c_nationkey')}")
def r13c(spark, d):
    return _results(spark, d)["relations"]


@query("r13_graph_entities", f"WITH {_HITS}, g AS (SELECT q, pos, CASE WHEN c_acctbal > 0 THEN 'u' || (c_custkey % 50) WHEN c_nationkey > 3 THEN 'i' || c_nationkey END AS gid FROM h) SELECT q, pos, gid FROM g WHERE gid IS NOT NULL {_FIRST.format('gid')}")
def r13d(spark, d):
    return _results(spark, d)["graph_entities"].select("q", "pos", "gid")


@query("r13_graph_relations", f"WITH {_HITS} SELECT q, pos, c_mktsegment AS source, c_nationkey % 5 AS target, 'IN' AS type, CASE WHEN c_acctbal > 0 THEN 'rich' END AS fact FROM h {_FIRST.format('c_mktsegment, c_nationkey % 5, c_acctbal > 0')}")
def r13e(spark, d):
    return _results(spark, d)["graph_relations"]


@query("r13_queries", "SELECT doc_id, trim(substr(text, 1, 12), ' ') AS query FROM documents WHERE trim(substr(text, 1, 12), ' ') <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(substr(text, 1, 12), ' ')) ORDER BY doc_id) = 1")
def r13f(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.substring("text", 1, 12).alias("query"))
    return R.distinct_queries(rows).select(F.col("pos").alias("doc_id"), "query")


# -- records ------------------------------------------------------------------
@query("p04_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')")
def p04(spark, d):
    return J.where_given(table(spark, d, "orders"), o_orderpriority=["1-URGENT", "2-HIGH"], o_orderstatus=("F", "O"), o_custkey=[]).select("o_orderkey")


@query("p11_without_empty", """SELECT doc_id, 'lang' AS name, '"' || lang || '"' AS json FROM documents WHERE trim(lang) <> '' UNION ALL SELECT doc_id, 'marks', '[' || n_chars || ']' FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, 'props', '{"k":"' || source || '"}' FROM documents WHERE n_chars % 2 = 0 UNION ALL SELECT doc_id, 'size', n_chars::VARCHAR FROM documents""")
def p11(spark, d):
    size = F.col("n_chars")
    none = F.create_map().cast("map<string,string>")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.lit(" ").alias("blank"), F.when(size > 500, F.array(size)).otherwise(F.array().cast("array<bigint>")).alias("marks"), F.when(size % 2 == 0, F.create_map(F.lit("k"), F.col("source"))).otherwise(none).alias("props"), size.alias("size"))
    return R.without_empty(rows, "doc_id")


@query("f28_weighted_sum", "SELECT event_id, round(greatest(0, least(1, 0.7 * greatest(0, least(1, value / 100)) + 0.5 * CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)), 9) AS score FROM events")
def f28(spark, d):
    rows = table(spark, d, "events").withColumns({"a": F.col("value") / 100, "b": F.when(F.col("event_type") != "error", 3.0)})
    return rows.select("event_id", F.round(R.weighted_sum({"a": 0.7, "b": 0.5}), 9).alias("score"))


@query("f19_title_labels", "SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(replace(p_type, ' ', '_')), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part")
def f19(spark, d):
    return table(spark, d, "part").select("p_partkey", X.title_label(F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("label"))


@query("f13_summaries", """WITH l AS (SELECT doc_id, trim(x, ' ') AS t, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x, ' ') <> '' AND x[1] <> '#'),
 u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l), j AS (SELECT doc_id, substr(string_agg(t, ' ' ORDER BY i), 1, 500) AS s FROM u WHERE used < 500 GROUP BY doc_id)
 SELECT doc_id, sha256(CASE WHEN s IS NULL THEN '' WHEN length(s) < 500 THEN s ELSE regexp_replace(s, ' [^ ]*$', '') || '...' END) AS summary FROM documents LEFT JOIN j USING (doc_id)""")
def f13(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.summary_of("text"), 256).alias("summary"))


@query("l12_legacy_synced", "SELECT event_id, event_type = 'purchase' AS synced FROM events")
def l12(spark, d):
    state = F.when(F.col("event_type") == "purchase", "synced").otherwise("pending")
    return table(spark, d, "events").withColumn("state", state).select("event_id", L.legacy_synced(F.col("state")).alias("synced"))


@query("s13_conversations", "SELECT c.conv_id, 'old' AS title, true AS known, 'stream-' || c.conv_id AS stream_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') c UNION ALL SELECT conv_id, CASE WHEN length(t) <= 50 THEN t END, false, 'stream-' || conv_id FROM (SELECT conv_id, arg_min(text, {'t': turn, 'r': role, 'x': text}) AS t FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1)")
def s13b(spark, d):
    """Conversations with a system turn are known; all turns come in."""
    rows = table(spark, d, "conversations")
    known = rows.filter("role = 'system'").select("conv_id").distinct()
    incoming = rows.select("conv_id", "role", "text", F.timestamp_seconds("turn").alias("at"))
    old = known.select("conv_id", F.lit("old").alias("title"), F.lit(None).cast("timestamp").alias("created_at"))
    none = spark.createDataFrame([], "stream_id string, conv_id long, status string, expires_at timestamp")
    conversations, _, streams = R.start_conversations(old, rows.select("conv_id", "turn", "role", "text").limit(0), none, incoming)
    j = conversations.join(streams, "conv_id").withColumn("known", F.col("title") == "old")
    short = rows.groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "role", "text")).alias("t"))
    return j.join(short, "conv_id").select("conv_id", F.when(F.col("known") | (F.length("t") <= 50), F.col("title")).alias("title"), "known", "stream_id")


@query("s16_applied_migrations", "WITH w AS (SELECT o_orderkey AS version, o_orderpriority AS a, o_orderstatus AS s FROM orders) SELECT version, CASE s WHEN 'F' THEN CASE WHEN a < '3' THEN 'changed' ELSE 'applied' END ELSE CASE WHEN version < (SELECT max(version) FROM w WHERE s = 'F') THEN 'gap' ELSE 'pending' END END AS status FROM w")
def s16b(spark, d):
    """Every order is a migration; the finished ones are applied, the urgent of
    those with another checksum."""
    o = table(spark, d, "orders")
    wanted = o.select(F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("checksum"))
    applied = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("version"), F.when(F.col("o_orderpriority") < "3", "x").otherwise(F.col("o_orderpriority")).alias("checksum"))
    return C.migrations(applied, wanted)


@query("s18_column_profile", "SELECT 'event_id' AS name, count(event_id) AS present, count(DISTINCT event_id) AS different FROM events UNION ALL SELECT 'user_id', count(user_id), count(DISTINCT user_id) FROM events UNION ALL SELECT 'event_type', count(event_type), count(DISTINCT event_type) FROM events UNION ALL SELECT 'value', count(value), count(DISTINCT value) FROM events UNION ALL SELECT 'props', count(props), count(DISTINCT props) FROM events UNION ALL SELECT 'ts', count(ts), count(DISTINCT ts) FROM events")
def s18b(spark, d):
    return C.column_profile(table(spark, d, "events"))


@query("r15_first_occurrence", with_("embedded") + "SELECT id FROM embedded QUALIFY row_number() OVER (PARTITION BY text ORDER BY document_id, idx) = 1")
def r15b(spark, d):
    return T.first_by(I.embedded(spark, d), ["text"], ["document_id", "idx"]).select("id")


# -- preflight and constraints ------------------------------------------------
_PROFILE = {"provider": "'p'", "endpoint_class": "'local'", "implementation": "'i'", "model": "CASE WHEN label % 4 = 3 THEN 'other' ELSE 'm' END", "model_revision": "'1'", "dimensions": "64", "output_encoding": "'float'", "storage_type": "'vector'", "normalize": "true", "distance_metric": "'cosine'", "input_type": "CASE WHEN label = 7 THEN 'query' ELSE 'text' END"}


@query("q09_preflight", """WITH s AS (SELECT label, count(*) AS total, count(*) FILTER (WHERE vec_id % 7 <> 0 OR label > 2) AS embedded FROM embeddings GROUP BY label),
 f AS (SELECT label, total, embedded, list_filter([CASE WHEN label = 0 THEN 'active_space_missing' END, CASE WHEN label = 0 THEN 'space_metadata_missing' END, CASE WHEN label = 0 THEN 'stored_profile_missing' END, CASE WHEN label = 9 THEN 'active_space_missing' END, CASE WHEN label = 9 THEN 'space_retired' END,
   CASE WHEN label = 5 THEN 'state_expected_dimensions_mismatch' END, CASE WHEN label = 6 THEN 'physical_dimension_mismatch' END, CASE WHEN label = 6 THEN 'configured_dimension_mismatch' END, CASE WHEN label = 6 THEN 'profile_dimensions_mismatch' END, CASE WHEN label = 8 THEN 'stored_profile_unresolvable' END, CASE WHEN label % 4 = 3 THEN 'profile_model_mismatch' END, CASE WHEN label = 7 THEN 'profile_input_type_mismatch' END,
   CASE WHEN label = 4 THEN 'multiple_active_spaces' END, CASE WHEN label = 4 THEN 'stored_profile_missing' END], lambda x: x IS NOT NULL) AS bad FROM s)
 SELECT label, CASE WHEN len(bad) > 0 THEN 'blocked' ELSE 'ready' END AS status, total AS total_rows, embedded AS embedded_rows, array_to_string(list_sort(CASE WHEN embedded < total THEN list_append(bad, 'embedding_coverage_incomplete') ELSE bad END), ',') AS findings FROM f""")
def q09b(spark, d):
    """Each label is a space with a semantic index of its own; 0 has no
    record, 9 is retired, 4 has a second active space, 5 and 6 disagree on the
    width, 8 names a profile that is not there, 3 and 7 were made by others."""
    label = F.col("label")
    vectors = table(spark, d, "embeddings").select(label.alias("space"), F.when((F.col("vec_id") % 7 != 0) | (label > 2), F.col("embedding")).alias("embedding"))
    spaces = table(spark, d, "embeddings").select("label").distinct()
    fields = F.expr("'f' || label").alias("fingerprint")
    stored = spaces.filter("label <> 8").select(fields, *(F.expr(sql).alias(f) for f, sql in _PROFILE.items()))
    wanted = _PROFILE | {"model": "'m'", "input_type": "'text'", "dimensions": "CASE WHEN label = 6 THEN 32 ELSE 64 END"}
    configured = F.struct(fields, *(F.expr(sql).alias(f) for f, sql in wanted.items()))
    width = F.when(label == 6, 48).otherwise(64)
    index = F.concat(F.lit("ix"), label)
    expected = spaces.select(label.alias("semantic_index"), label.alias("space"), width.alias("expected_dimensions"), F.lit("cosine").alias("distance_metric"), index.alias("index_name"), configured.alias("configured"))
    state = F.when(label == 9, "retired").otherwise("active")
    recorded = spaces.filter("label <> 0").select(label.alias("semantic_index"), label.alias("space"), state.alias("state"), F.when(label == 5, 16).otherwise(width).alias("expected_dimensions"), F.lit("cosine").alias("distance_metric"), index.alias("index_name"), F.concat(F.lit("f"), label).alias("profile_fingerprint"))
    second = recorded.filter("space = 4").withColumn("space", F.lit(44))
    out = P.preflight(expected, recorded.unionByName(second), stored, vectors)
    return out.select(F.col("space").alias("label"), "status", "total_rows", "embedded_rows", F.array_join("findings", ",").alias("findings"))


_JOB = """j AS (SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'leased' WHEN '2' THEN 'retry_wait' WHEN '3' THEN 'synced' WHEN '4' THEN 'pending' ELSE 'odd' END AS state, o_custkey % 4 AS attempts, o_custkey % 5 AS used, o_orderstatus <> 'O' AS owner, o_orderstatus = 'F' AS next, o_totalprice > 100000 AS print, o_totalprice > 50000 AS stamp FROM orders)"""


@query("l17_job_rules", f"""WITH {_JOB} SELECT 'known_state' AS rule, id FROM j WHERE state = 'odd' UNION ALL SELECT 'budget', id FROM j WHERE used > 3 UNION ALL SELECT 'lease', id FROM j WHERE CASE WHEN state = 'leased' THEN NOT (attempts > 0 AND owner) ELSE owner END
 UNION ALL SELECT 'retry_time', id FROM j WHERE (state = 'retry_wait') <> next UNION ALL SELECT 'verified', id FROM j WHERE CASE WHEN state = 'synced' THEN NOT (print AND stamp) ELSE print OR stamp END""")
def l17b(spark, d):
    rank = F.substring("o_orderpriority", 1, 1)
    state = F.when(rank == "1", "leased").when(rank == "2", "retry_wait").when(rank == "3", "synced").when(rank == "4", "pending").otherwise("odd")
    given = lambda ok, v: F.when(ok, v)
    owned, price = F.col("o_orderstatus") != "O", F.col("o_totalprice")
    jobs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), state.alias("state"), (F.col("o_custkey") % 4).alias("attempts"), (F.col("o_custkey") % 5).alias("budget_used"), F.lit(3).alias("budget"), given(owned, F.lit("w")).alias("lease_owner"),
        given(owned, F.col("o_orderdate")).alias("lease_until"), given(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("next_at"), given(price > 100000, F.lit("fp")).alias("verified_print"), given(price > 50000, F.col("o_orderdate")).alias("verified_at"),
    )
    return L.rule_violations(jobs, "id", P.job_rules())


@query("l17_count_rules", "SELECT 'counts_reconcile' AS rule, event_id AS id FROM events WHERE NOT (event_type = 'view' OR (event_type <> 'error' AND value >= 10))")
def l17c(spark, d):
    whole = F.floor("value")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", whole).alias("proposed"), F.when(~F.col("event_type").isin("view", "error"), whole - 10).alias("accepted"), F.when(F.col("event_type") != "view", F.lit(10)).alias("rejected"),
    )
    return L.rule_violations(rows, "id", P.count_rules())


@query("l17_unique_rules", "SELECT 'one_open_order' AS rule, o_custkey::VARCHAR AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1")
def l17d(spark, d):
    return P.unique_violations(table(spark, d, "orders"), ["o_custkey"], "one_open_order", F.col("o_orderstatus") == "O")


@query("l17_reference_rules", "SELECT 'known_part' AS rule, l_partkey::VARCHAR AS key, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_partkey")
def l17e(spark, d):
    return P.reference_violations(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").filter("p_size > 5"), "p_partkey", "known_part")


@query("d06_generated", "SELECT doc_id, CASE WHEN n_chars < 5000 THEN lang || ':' || n_chars END AS answer, CASE WHEN n_chars >= 5000 THEN 'TimeoutError' END AS error FROM documents")
def d06(spark, d):
    """A model that echoes its prompt and never answers a long one."""

    def model(prompts):
        if any(int(p.split(":")[1]) >= 5000 for p in prompts):
            raise TimeoutError
        return prompts

    rows = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit(":"), F.col("n_chars").cast("string")).alias("prompt"))
    return C.generate(rows, "doc_id", "prompt", model, size=1)
