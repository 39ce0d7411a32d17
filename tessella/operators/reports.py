"""Report views, run summaries with calls, rollback order, multi-query merges
and the smaller record operators beside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.tokens import word_truncated
from tessella.operators.relational import greedy_budget, page, where_given
from tessella.operators.retrieval import first_by

SEVERITIES = ["critical", "error", "warning", "info"]


# -- report views (V11, A14) --------------------------------------------------
def count_map(column: str, domain: Sequence[str]) -> Column:
    """Aggregate of the rows of each value of a known domain as a map,
    without the values that do not occur."""
    whole = F.create_map(*[x for v in domain for x in (F.lit(v), F.count_if(F.col(column) == v))])
    return F.map_filter(whole, lambda k, n: n > 0)


def report_heads(reports: DataFrame, findings: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Each report with findings_count, severity_counts and category_counts;
    zero and empty maps for a report without findings."""
    own = findings.groupBy("report_id").agg(F.count(F.lit(1)).alias("findings_count"), count_map("severity", SEVERITIES).alias("severity_counts"), count_map("category", categories).alias("category_counts"))
    none = F.create_map().cast("map<string, bigint>")
    return reports.join(own, "report_id", "left").withColumns({"findings_count": F.coalesce("findings_count", F.lit(0)), "severity_counts": F.coalesce("severity_counts", none), "category_counts": F.coalesce("category_counts", none)})


def report(heads: DataFrame, findings: DataFrame, report_id) -> DataFrame:
    """One report with its findings, by priority and age."""
    own = heads.filter(F.col("report_id") == report_id).withColumnRenamed("created_at", "reported_at")
    return own.join(findings, "report_id").orderBy("priority", "created_at", "finding_id")


def list_reports(heads: DataFrame, agent: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Reports of an agent and of a kind, the newest first."""
    return page(where_given(heads, agent_id=agent, validation_type=kind), [F.desc("created_at"), F.asc("report_id")], limit, offset)


def mark_reviewed(findings: DataFrame, reviews: DataFrame, at: Column) -> DataFrame:
    """Findings with the reviews (finding_id, reviewer, action, notes) of human
    readers; an unknown finding changes nothing."""
    new = reviews.select("finding_id", F.col("reviewer").alias("_reviewer"), F.col("action").alias("_action"), F.col("notes").alias("_notes"))
    hit = F.col("_reviewer").isNotNull()
    j = findings.join(new, "finding_id", "left")
    return j.withColumns({
        "reviewed": F.col("reviewed") | hit, "reviewer": F.when(hit, F.col("_reviewer")).otherwise(F.col("reviewer")), "review_action": F.when(hit, F.col("_action")).otherwise(F.col("review_action")),
        "review_notes": F.when(hit, F.coalesce("_notes", F.lit(""))).otherwise(F.col("review_notes")), "reviewed_at": F.when(hit, at).otherwise(F.col("reviewed_at")),
    }).drop("_reviewer", "_action", "_notes")


def unreviewed(findings: DataFrame, reports: DataFrame, severity: str | None = None, category: str | None = None, limit: int = 100) -> DataFrame:
    """Findings that nobody has reviewed with the kind and scope of their report."""
    few = where_given(findings.filter(~F.col("reviewed")), severity=severity, category=category)
    return few.join(reports.select("report_id", "validation_type", "scope_description"), "report_id").orderBy("priority", F.desc("created_at"), "finding_id").limit(limit)


def review_statistics(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of both tables' totals."""
    r = reports.agg(F.count(F.lit(1)).alias("total_reports"), F.count_if("success").alias("successful_reports"), F.countDistinct("agent_id").alias("unique_agents"), F.countDistinct("validation_type").alias("validation_types"), F.avg("execution_time").alias("avg_execution_time"), F.max("created_at").alias("last_report_time"))
    by = [F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in SEVERITIES]
    f = findings.agg(F.count(F.lit(1)).alias("total_findings"), F.count_if("reviewed").alias("reviewed_findings"), *by, F.countDistinct("category").alias("unique_categories"), F.avg("confidence").alias("avg_confidence_score"))
    return r.crossJoin(f)  # one row each


# -- run summaries with calls (Q3, Q6) ----------------------------------------
def run_summary(runs: DataFrame, jobs: DataFrame, attempts: DataFrame, calls: DataFrame, states: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Q3: one row per run (run_id, profile): its profile's jobs by state, its
    attempts by outcome, sums that stay null where nothing was reported, and its
    provider calls. ``attempts`` (run_id, attempt_id, outcome, proposed),
    ``calls`` (attempt_id, outcome, tokens), ``jobs`` (profile, state). Every
    table is reduced before it is joined."""
    job = jobs.groupBy("profile").agg(*(F.count_if(F.col("state") == s).alias(f"jobs_{s}") for s in states))
    tried = attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.count("outcome").alias("completed"), *(F.count_if(F.col("outcome") == o).alias(f"outcome_{o}") for o in outcomes), F.sum("proposed").alias("proposed"), F.count("proposed").alias("proposed_reported"))
    asked = calls.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("reserved"), F.count("outcome").alias("done"), F.count_if(F.col("outcome") == "success").alias("good"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("told"))
    spent = attempts.select("run_id", "attempt_id").join(asked, "attempt_id").groupBy("run_id").agg(
        F.sum("reserved").alias("calls"), F.sum("done").alias("calls_completed"), F.sum("good").alias("calls_succeeded"), F.sum("tokens").alias("tokens"), F.sum("told").alias("tokens_reported")
    )
    j = runs.join(job, "profile", "left").join(tried, "run_id", "left").join(spent, "run_id", "left")
    zero = [c for c in j.columns if c not in ("run_id", "profile", "proposed", "tokens")]
    return j.na.fill(0, zero)


def candidate_latency(attempts: DataFrame) -> DataFrame:
    """Q3: per run and candidate (run_id, candidate): attempts, successes and the
    median and 95th percentile of the successes' latency."""
    good = F.when(F.col("outcome") != "error", F.col("latency"))
    return attempts.groupBy("run_id", "candidate").agg(
        F.count(F.lit(1)).alias("attempts"), F.count(good).alias("successes"), F.round(F.percentile(good, 0.5), 6).alias("p50"), F.round(F.percentile(good, 0.95), 6).alias("p95")
    )


def attempt_chain(attempts: DataFrame, calls: DataFrame, most: int = 5) -> DataFrame:
    """Q6: (episode_id, chain): the last attempts of each episode in order, each
    with its calls in order. Only the calls of those attempts are gathered, and
    a call limit bounds them."""
    n = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("completed_at"), F.desc("attempt_id")))
    few = attempts.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")
    own = calls.join(few.select("attempt_id"), "attempt_id", "left_semi").groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct("call_number", F.col("outcome").alias("result")))).alias("calls"))
    j = few.join(own, "attempt_id", "left").withColumn("calls", F.coalesce("calls", F.array().cast(own.schema["calls"].dataType)))
    return j.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("completed_at", "attempt_id", "outcome", "calls"))).alias("chain"))


# -- rollback of a batch (X7) -------------------------------------------------
def rollback_order(applied: DataFrame) -> DataFrame:
    """The corrections of each batch that are still applied, numbered in the
    order of their undoing: the last applied first."""
    live = applied.filter(F.col("rolled_back_at").isNull())
    n = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("applied_at"), F.desc("id")))
    return live.withColumn("step", n)


def rollback_totals(steps: DataFrame, report: DataFrame) -> DataFrame:
    """Per batch: total, undone and failed, and whether all went well.
    ``report`` (id, outcome) says what became of each correction."""
    j = steps.select("batch", "id").join(report.select("id", "outcome"), "id")
    good = F.col("outcome").isin("restored", "renamed_back")
    return j.groupBy("batch").agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("undone"), F.count_if(~good).alias("failed"), F.min(good).alias("success"))


# -- retrieval (R12, R13) -----------------------------------------------------
def within_budget(rows: DataFrame, key: str, pos: str, score: str, text: str, cost: str, budget: int) -> DataFrame:
    """The texts that fit the budget, taken by score, back in their own
    order: ``rank`` counts the kept ones of a key by ``pos``. A single text that
    is too long for the budget alone is cut to it. ``pos`` names a row of its key;
    the texts stay where they are until it is known which are kept."""
    names = greedy_budget(rows.select(key, pos, score, cost), key, [F.desc(score), F.asc(pos)], cost, budget).select(F.col(key).alias("_key"), F.col(pos).alias("_pos"))
    kept = rows.join(names, F.col(key).eqNullSafe(F.col("_key")) & (F.col(pos) == F.col("_pos")), "left_semi")
    n = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return kept.withColumn("rank", n).withColumn(text, F.when(F.col(cost) > budget, word_truncated(F.col(text), budget)).otherwise(F.col(text)))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Trimmed queries (pos, query), each once whatever its case."""
    own = queries.withColumn("query", F.trim("query")).filter("query <> ''").withColumn("_low", F.lower("query"))
    return first_by(own, ["_low"], ["pos"]).drop("_low")


def merged_results(chunks: DataFrame, entities: DataFrame, relations: DataFrame, graph_entities: DataFrame, graph_relations: DataFrame) -> dict[str, DataFrame]:
    """The results of several queries (q, pos, ...) as one, the first
    occurrence of each staying: chunks by text, entities (with a name) and
    relations by all of their fields, graph entities by uuid or else id, graph
    relations by source, target, type and fact. Rows without a key go."""
    order, own = ["q", "pos"], lambda df: [c for c in df.columns if c not in ("q", "pos")]
    gid = F.coalesce(F.when(F.col("uuid") != "", F.col("uuid")), F.when(F.col("id") != "", F.col("id")))
    return {
        "chunks": first_by(chunks.filter("text <> ''"), ["text"], order), "entities": first_by(entities.filter("name <> ''"), own(entities), order), "relations": first_by(relations, own(relations), order),
        "graph_entities": first_by(graph_entities.withColumn("gid", gid).filter("gid is not null"), ["gid"], order), "graph_relations": first_by(graph_relations, ["source", "target", "type", "fact"], order),
    }


# -- records ------------------------------------------------------------------
def present(value: Column, kind: str) -> Column:
    """Whether a value says anything: not null, nor an empty text, list or
    map; numbers and flags always do."""
    if kind == "string":
        return F.coalesce(F.trim(value) != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def without_empty(rows: DataFrame, key: str) -> DataFrame:
    """(key, name, json) of the columns of each row that say something."""
    kept = [F.when(present(F.col(c), kind), F.struct(F.lit(c).alias("name"), F.to_json(F.struct(F.col(c).alias("v"))).alias("json"))) for c, kind in rows.dtypes if c != key]
    return rows.select(key, F.explode(F.array_compact(F.array(*kept))).alias("p")).select(key, "p.name", F.regexp_extract("p.json", r'(?s)^\{"v":(.*)\}$', 1).alias("json"))


def weighted_sum(parts: dict[str, float]) -> Column:
    """the weighted sum of columns, each clamped to [0, 1], itself clamped."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(name), F.lit(0.0))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def start_conversations(conversations: DataFrame, messages: DataFrame, streams: DataFrame, incoming: DataFrame, hours: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations (conv_id, title, created_at), messages and streams
    (stream_id, conv_id, status, expires_at) after ``incoming`` (conv_id, role,
    text, at): an unknown conversation is made and titled by its first text,
    every known one moves on, and each gets a stream."""
    from tessella.functions.text import conversation_title
    from tessella.sources.corpus import append_messages

    first = incoming.groupBy("conv_id").agg(F.min_by("text", F.struct("at", "role", "text")).alias("text"), F.min("at").alias("created_at"), F.max("at").alias("last"))
    new = first.join(conversations, "conv_id", "left_anti").select("conv_id", conversation_title("text").alias("title"), "created_at")
    opened = first.select(F.concat(F.lit("stream-"), F.col("conv_id").cast("string")).alias("stream_id"), "conv_id", F.lit("active").alias("status"), (F.col("last") + F.make_dt_interval(secs=F.lit(hours * 3600))).alias("expires_at"))
    return conversations.unionByName(new), append_messages(messages, incoming.withColumn("role", F.coalesce("role", F.lit("user")))), streams.unionByName(opened)


EXTRACTION_CORPUS = (
    "schema_version int, cases array<struct<case_id: string, episode: string, expect_parse_success: boolean, expect_schema_success: boolean,"
    " expected_entities: array<struct<id: string, aliases: array<string>>>, expected_relationships: array<struct<source: string, target: string, types: array<string>>>>>"
)


def extraction_problems(corpus: DataFrame) -> DataFrame:
    """(case_id, code, what) of an extraction corpus whose cases do not hold
    together: a repeated case or entity, an entity without aliases, a
    relationship whose end is no entity of its case or that names no type."""
    case = corpus.select(F.explode("cases").alias("c")).select("c.*")
    twice = case.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case_id", F.lit("duplicate_case").alias("code"), F.col("case_id").alias("what"))
    entity = case.select("case_id", F.explode("expected_entities").alias("e")).select("case_id", "e.*")
    again = entity.groupBy("case_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case_id", F.lit("duplicate_entity").alias("code"), F.col("id").alias("what"))
    bare = entity.filter(F.coalesce(F.size("aliases"), F.lit(0)) < 1).select("case_id", F.lit("no_aliases").alias("code"), F.col("id").alias("what"))
    relation = case.select("case_id", "expected_entities", F.explode("expected_relationships").alias("r")).select("case_id", F.coalesce("expected_entities.id", F.array().cast("array<string>")).alias("ids"), "r.*")
    ends = relation.select("case_id", "ids", F.explode(F.array("source", "target")).alias("what")).filter(~F.array_contains("ids", F.col("what"))).select("case_id", F.lit("unknown_entity").alias("code"), "what")
    untyped = relation.filter(F.coalesce(F.size("types"), F.lit(0)) < 1).select("case_id", F.lit("no_types").alias("code"), F.concat_ws(">", "source", "target").alias("what"))
    return twice.unionByName(again).unionByName(bare).unionByName(ends).unionByName(untyped).distinct()
