"""Property maps, records and report rows: projections, folds and decisions."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_properties(props: Column, suffixes: Sequence[str] = ("_embedding", "_at"), names: Sequence[str] = ()) -> Column:
    """A property map without technical keys and empty values."""

    def keep(k, v):
        ok = ~k.isin(*names) if names else F.lit(True)
        for s in suffixes:
            ok = ok & ~k.endswith(s)
        return ok & v.isNotNull() & (F.trim(v) != "")

    return F.map_filter(props, keep)


def first_label(labels: Column, ignored: Sequence[str] = ("Entity", "Entity_")) -> Column:
    """The first label that says something, else ``unknown``."""
    return F.coalesce(F.try_element_at(F.filter(labels, lambda x: ~x.isin(*ignored)), F.lit(1)), F.lit("unknown"))


def named(name: Column, aliases: Column, wanted: str) -> Column:
    """Equal without regard to case, or one of the aliases."""
    return (F.lower(name) == wanted.lower()) | F.coalesce(F.array_contains(aliases, wanted), F.lit(False))


def safe_list(values: Column, most: int = 100) -> Column:
    """A list as text; a long one as a placeholder."""
    return F.when(F.size(values) > most, F.concat(F.lit("<list of "), F.size(values).cast("string"), F.lit(">"))).otherwise(F.array_join(values.cast("array<string>"), ","))


def safe_lists(rows: DataFrame, key: str, value: str, most: int = 100) -> DataFrame:
    """(key, text): the sorted values of each key as text, or a placeholder
    where there are more than ``most``. Keys are counted first, so long lists
    are never gathered."""
    sizes = rows.groupBy(key).agg(F.count(value).alias("n"))
    short = rows.join(sizes.filter(F.col("n") <= most), key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("held"))
    long_ = sizes.filter(F.col("n") > most).select(key, F.concat(F.lit("<list of "), F.col("n").cast("string"), F.lit(">")).alias("text"))
    return short.select(key, safe_list(F.col("held"), most).alias("text")).unionByName(long_)


def canonical_fingerprint(props: Column) -> Column:
    """Fingerprint of a string map as JSON with sorted keys, compact and
    ASCII. No built-in function escapes to ASCII, so this is a pandas UDF."""
    import hashlib

    def run(maps: pd.Series) -> pd.Series:
        text = maps.map(lambda m: json.dumps(dict(m or {}), sort_keys=True, separators=(",", ":"), ensure_ascii=True))
        return text.map(lambda t: "sha256:v1:" + hashlib.sha256(t.encode()).hexdigest())

    return F.pandas_udf(run, "string")(props)


def shortened(text: Column, width: int, mark: str = "...") -> Column:
    """White space collapsed and cut at a word so that ``width`` holds."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.substring(x, 1, width - len(mark) + 1), r" ?[^ ]*$", "")
    return F.when(F.length(x) <= width, x).otherwise(F.concat(cut, F.lit(mark)))


def insight_rows(records: DataFrame, fields: Sequence[tuple[str, str]], similarity: float, most: int = 5) -> DataFrame:
    """Text blocks of ``label: value`` lines of the fields that are there;
    only records with more than one line."""
    lines = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in fields)))
    return records.withColumn("_l", lines).filter(F.size("_l") > 1).select("id", F.array_join("_l", "\n").alias("text"), F.lit(similarity).alias("similarity")).orderBy("id").limit(most)


def truncated(rows: DataFrame, key: str, order: Sequence[Column], text: str, budget: int, least: int = 100) -> DataFrame:
    """Rows in order until the budget of words; the first that does not fit is
    cut to what is left if that is more than ``least``, the rest go."""
    words = F.split(F.trim(text), r"\s+")
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("_n", F.size(words))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    kept = F.when(F.col("_n") <= left, F.col("_n")).when(left > least, left)
    return rows.withColumn("_left", left).withColumn("kept_words", kept).filter(F.col("kept_words").isNotNull()).withColumn(text, F.array_join(F.slice(words, 1, F.col("kept_words").cast("int")), " ")).drop("_n", "_left")


def set_property(edges: DataFrame, updates: DataFrame, name: str) -> DataFrame:
    """Update one property of the edges in ``updates`` (id, value)."""
    return edges.join(updates.select("id", F.col("value").alias("_v")), "id", "left").withColumn(name, F.coalesce("_v", name)).drop("_v")


def same_as_pairs(nodes: DataFrame, key: Column) -> DataFrame:
    """(id, same_as): nodes that share a key, each with the least id of it."""
    rows = nodes.select("id", key.alias("_k")).filter("_k <> ''")
    least = rows.groupBy("_k").agg(F.min("id").alias("same_as"))
    return rows.join(least, "_k").filter("id <> same_as").select("id", "same_as")


def write_decisions(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, decision) for idempotent writes of (id, fingerprint): create where
    nothing is stored, adopt where exactly one equal row is, conflict else."""
    c = stored.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("fingerprint").alias("fp"))
    j = wanted.select("id", F.col("fingerprint").alias("w")).join(c, "id", "left")
    return j.select("id", F.when(F.col("n").isNull(), "create").when((F.col("n") == 1) & (F.col("fp") == F.col("w")), "adopt").otherwise("conflict").alias("decision"))


def quality_report(rows: DataFrame) -> DataFrame:
    """Proposal counts of each run (proposed, accepted, normalized, rejected;
    null where not reported) with rates, evidence and a reconciliation flag."""
    s = lambda c: F.sum(c).alias(c)
    g = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), F.count("proposed").alias("reported"), s("proposed"), s("accepted"), s("normalized"), s("rejected"))
    rate = lambda c: F.round(F.try_divide(F.col(c) * 100.0, F.col("proposed")), 3)
    evidence = F.when(F.col("reported") == 0, "none").when(F.col("reported") < F.col("attempts"), "partial").otherwise("complete")
    return g.select("*", rate("accepted").alias("accepted_pct"), rate("rejected").alias("rejected_pct"), evidence.alias("evidence"), (F.col("proposed") == F.col("accepted") + F.col("rejected")).alias("reconciles"))


def job_audit(jobs: DataFrame, episodes: DataFrame, states: Sequence[str]) -> DataFrame:
    """(id, reason): the first reason to doubt a job or an episode."""
    j = jobs.alias("j").join(episodes.alias("e"), "id", "full_outer")
    has_job, has_episode = F.col("state").isNotNull(), F.col("flag").isNotNull()
    reason = (
        F.when(has_job & ~has_episode, "job_without_source_episode").when(~has_job, "missing_job").when(~F.col("state").isin(*states), "invalid_state")
        .when((F.col("state") == "synced") & ~F.col("flag"), "synced_without_flag").when((F.col("state") != "synced") & F.col("flag"), "flag_without_synced")
        .when((F.col("state") == "synced") & F.col("verified_at").isNull(), "missing_verified_at")
    )
    return j.select("id", reason.alias("reason")).filter("reason is not null")


def candidate_summary(runs: DataFrame, least_entity: float = 0.8, least_relationship: float = 0.66) -> DataFrame:
    """Per candidate: cases, passes, failures, mean latency and verdict."""
    ok = (F.col("entity_recall") >= least_entity) & (F.col("relationship_recall") >= least_relationship)
    g = runs.groupBy("candidate").agg(F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("passed"), F.round(F.avg("latency"), 6).alias("latency"))
    return g.withColumn("verdict", F.when(F.col("cases") == F.col("passed"), "pass").otherwise("fail"))


def finding_page(reports: DataFrame, findings: DataFrame, severity: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Unreviewed findings with their report, by priority and age."""
    f = findings.filter("not reviewed")
    f = f if severity is None else f.filter(F.col("severity") == severity)
    return f.join(reports, "report_id").orderBy("priority", F.desc("created_at"), "finding_id").offset(offset).limit(limit)


def live_state(states: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """States written within the last ``hours``; the latest of each key."""
    latest = states.groupBy("key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return latest.filter(F.col("at") > as_of - F.make_dt_interval(hours=F.lit(hours)))


def scope_violations(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows outside the canonical scope: not canonical, or from elsewhere."""
    return rows.filter(~(F.coalesce("canonical", F.lit(False)) & F.col("source_file").startswith(prefix)))


# Words that ask for new content.
CONTENT_NOUNS = ["quest", "questline", "npc", "npcs", "story", "stories", "narrative", "adventure", "mission", "encounter", "dialogue", "hook", "phase", "reward", "episode", "scene", "campaign"]
CREATION_WORDS = ["create", "generate", "write", "design", "craft", "build", "compose", "produce", "make", "plan", "draft", "invent", "come up with", "give me", "need a", "need another", "continue the", "continue this", "develop"]
STORY_PHRASES = ["tell me a story", "spin a tale", "share a story", "story about", "extend that story", "extend the story", "add to the story", "continue that story", "longer story", "multi chapter", "multi-part story"]
CONTINUATIONS = ["continue", "continue story", "continue the story", "continue the quest", "extend that story", "extend the story", "more story", "more of the story"]


def intent(text: Column) -> Column:
    """``generative`` for a wish for content, a story phrase or a bare
    continuation; everything else is ``informational``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    made = (some(CREATION_WORDS) & some(CONTENT_NOUNS)) | some(STORY_PHRASES) | F.trim(low).isin(*CONTINUATIONS)
    return F.when(made, "generative").otherwise("informational")


def next_step(state: dict[str, Column]) -> Column:
    """Whether an agent goes on. ``state`` has rounds, most_rounds,
    last_action, intent, failures, request, created (an array of content
    types), planned and done. It finalises at the round limit, on its own
    word, with an answer to an informational request, after more than three
    failures, with a whole quest, or with a finished plan and some content."""
    created = state["created"]
    has = lambda kind: F.exists(created, lambda c: c.contains(kind))
    phases = F.size(F.filter(created, lambda c: c.contains("create_quest_phase")))
    quest = F.lower(state["request"]).contains("quest") & (phases >= 3) & has("create_quest_hook")
    whole = has("combine_quest_phases") & has("create_quest_reward")
    return (
        F.when(state["rounds"] >= state["most_rounds"], "finalize").when(state["last_action"] == "finalize", "finalize")
        .when((state["intent"] == "informational") & has("answer_lore_question"), "finalize").when(state["failures"] > 3, "finalize")
        .when(quest & whole, "finalize").when(quest, "continue")
        .when((state["planned"] > 0) & (state["done"] == state["planned"]) & (F.size(created) > 0), "finalize").otherwise("continue")
    )


def topic_relevance(chunks: DataFrame, keywords: Sequence[str], least: int = 2, top: int = 3) -> DataFrame:
    """Per key: whether ``least`` keywords occur in its top chunks."""
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "id"))
    hits = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda w: F.lower(F.col("text")).contains(w)))
    few = chunks.withColumn("_n", n).filter(F.col("_n") <= top).withColumn("_h", hits)
    return few.groupBy("key").agg(F.max("_h").alias("hits")).withColumn("relevant", F.col("hits") >= least)
