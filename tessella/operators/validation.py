"""Rules over a graph's relationships, corrections and their rollback.

A finding is (rule, severity, confidence, priority, subject, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import screaming_snake

# Fixed values of the rules.
SYMMETRIC = ["allied_with", "married_to", "sibling_of", "friend_of", "enemy_of", "opposed_to"]
GENERIC = "relates_to"
EXCLUSIVE = [("allied_with", "opposed_to"), ("friend_of", "enemy_of"), ("protects", "threatens"), ("supports", "opposes")]
INVERSES = [("commands", "serves_under"), ("rules", "governed_by"), ("created_by", "creation_of"), ("parent_of", "child_of"), ("teaches", "student_of")]
TYPE_PROPERTIES = ["semantic_type", "relationship_type", "type", "kind", "nature"]
FACT_WORDS = [(("allied with", "alliance"), "allied_with"), (("opposed to", "enemy"), "opposed_to"), (("commands", "leads"), "commands"), (("serves", "follows"), "serves_under"), (("protects", "guards"), "protects")]
SEVERITIES = ["critical", "error", "warning", "info"]


def _finding(df: DataFrame, rule: str, severity: str, confidence: float, priority: int, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"), subject.alias("subject"), detail.alias("detail"))


def normal_type(kind: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.col(kind) if isinstance(kind, str) else kind), r"[\s-]+", "_"))


def semantic_type(props: Column) -> Column:
    """V1: the type in a property map: the first key of TYPE_PROPERTIES, then
    ``name``, that is there (a present null reads ``None``), then a word of the
    fact, else null."""
    fact, out = F.lower(F.try_element_at(props, F.lit("fact"))), F.lit(None).cast("string")
    for words, kind in reversed(FACT_WORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | fact.contains(word)
        out = F.when(hit, kind).otherwise(out)
    for key in reversed((*TYPE_PROPERTIES, "name")):
        out = F.when(F.map_contains_key(props, F.lit(key)), F.coalesce(F.try_element_at(props, F.lit(key)), F.lit("None"))).otherwise(out)
    return out


def missing_reverse(edges: DataFrame, symmetric: list[str]) -> DataFrame:
    """V2: unordered pairs with exactly one typed edge, of whatever type, whose
    type is symmetric. Untyped and generic edges do not count."""
    typed = edges.filter((F.col("type") != "") & (normal_type("type") != GENERIC))
    pairs = typed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("type").alias("type"))
    t = F.replace(F.lower("type"), F.lit(" "), F.lit("_"))
    return _finding(pairs.filter((F.col("n") == 1) & t.isin(symmetric)), "missing_reverse", "info", 0.6, 3, F.col("id"), t)


def exclusive_types(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Types on one ordered pair that exclude each other: the types of a pair
    are gathered once, not joined with themselves."""
    sets = edges.groupBy("src", "dst").agg(F.collect_set(normal_type("type")).alias("t"))
    out = None
    for one, two in rules:
        hit = sets.filter(F.array_contains("t", one) & F.array_contains("t", two))
        own = _finding(hit, "exclusive_types", "error", 0.9, 1, F.concat_ws(">", "src", "dst"), F.lit(f"{one}|{two}"))
        out = own if out is None else out.unionByName(own)
    return out


def missing_inverse(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """A hierarchical edge without its inverse; a rule counts only where both
    of its types occur."""
    typed = edges.select("id", "src", "dst", normal_type("type").alias("t")).filter(F.col("t").isin([t for r in rules for t in r]))
    spark = edges.sparkSession
    rule = spark.createDataFrame([*rules, *[(b, a) for a, b in rules]], "t string, inverse string")
    here = typed.select("t").distinct()
    live = rule.join(here, "t").join(here.withColumnRenamed("t", "inverse"), "inverse")  # at most ten rows
    need = typed.join(F.broadcast(live), "t")
    have = typed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("t").alias("inverse"))
    return _finding(need.join(have, ["src", "dst", "inverse"], "left_anti"), "missing_inverse", "info", 0.7, 3, F.col("id"), F.col("inverse"))


def untyped(edges: DataFrame, generic: str) -> DataFrame:
    """V5, first rule: generic edges without a fact."""
    bad = edges.filter((normal_type("type") == generic) & (F.coalesce("fact", F.lit("")) == ""))
    return _finding(bad, "untyped", "warning", 0.8, 2, F.col("id"), F.col("type"))


def rich_mentions(edges: DataFrame, props: str = "props") -> DataFrame:
    """V5, second rule: mentions that carry a type of their own."""
    kind = semantic_type(F.col(props))
    return _finding(edges.filter((normal_type("type") == "mentions") & (kind != "")), "rich_mention", "info", 0.5, 3, F.col("id"), kind)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return _finding(nodes.join(ends, "id", "left_anti"), "orphan", "info", 0.4, 4, F.col("id"), F.col("name"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    kind = F.coalesce(F.lower("type"), F.lit("unknown"))
    g = edges.groupBy("src", "dst", kind.alias("t")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _finding(g, "duplicate", "warning", 0.9, 2, F.concat_ws(">", "src", "t", "dst"), F.col("n").cast("string"))


def judged(judgements: DataFrame) -> DataFrame:
    """Findings of a model's judgements (id, verdict, benefit)."""
    severity = F.when(F.col("verdict") == "inappropriate", "error").when(F.col("verdict") == "unclear", "warning").otherwise("info")
    confidence = F.when(F.col("benefit") == "high", 0.9).when(F.col("benefit") == "medium", 0.7).otherwise(0.5)
    priority = F.when(F.col("benefit") == "high", 1).when(F.col("benefit") == "medium", 2).otherwise(3)
    return judgements.select(F.lit("judged").alias("rule"), severity.alias("severity"), confidence.alias("confidence"), priority.alias("priority"), F.col("id").alias("subject"), F.col("verdict").alias("detail"))


def report(findings: DataFrame) -> DataFrame:
    """Counts by severity and rule, the worst first."""
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"), F.min("priority").alias("priority")).orderBy(order, "rule")


def content_check(texts: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """(id, known, unknown, bad_years, confidence, valid): capitalised phrases
    against known names and years past 1500."""
    from tessella.functions import text as X

    phrases = texts.select("id", F.explode_outer(F.array_distinct(X.capitalised_phrases(text))).alias("name"))
    known = names.select("name", F.lit(1).alias("hit")).distinct()
    counts = phrases.join(known, "name", "left").groupBy("id").agg(F.count("hit").alias("known"), (F.count("name") - F.count("hit")).alias("unknown"))
    years = texts.select("id", F.size(F.filter(X.years(text), lambda y: y > 1500)).alias("bad_years"))
    j = counts.join(years, "id")
    raw = 0.8 - 0.2 * F.col("bad_years") - 0.1 * F.col("unknown")
    return j.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).withColumn("valid", F.col("bad_years") == 0)


# -- correction --------------------------------------------------------------
def completeness(props: Column) -> Column:
    """Points of an edge for its properties, a map of texts: 100 for each
    embedding key and 10 for created_at that is there, null or not; 50 for a
    name, 30 for a fact, 5 for each episode (a JSON list, or one) up to 50; and
    one for every property."""
    has, value = (lambda k: F.map_contains_key(props, F.lit(k))), (lambda k: F.coalesce(F.try_element_at(props, F.lit(k)), F.lit("")))
    points = lambda ok, n: F.when(ok, n).otherwise(0)
    listed = F.from_json(value("episodes"), "array<string>")
    episodes = F.when(value("episodes") == "", 0).when(value("episodes").startswith("["), F.least(5 * F.size(F.coalesce(listed, F.array().cast("array<string>"))), F.lit(50))).otherwise(5)
    return (
        points(has("fact_embedding"), 100) + points(has("name_embedding"), 100) + points(value("name") != "", 50) + points(value("fact") != "", 30)
        + episodes + points(has("created_at"), 10) + F.size(props)
    )


def properties(edges: DataFrame) -> Column:
    """The property map of an edge: ``props`` where there is one, else its fact."""
    return F.col("props") if "props" in edges.columns else F.create_map(F.lit("fact"), F.col("fact"))


def duplicate_corrections(edges: DataFrame, confidence: float = 0.95, most: int | None = None) -> DataFrame:
    """Delete all but the best of the edges with one (src, dst, type).

    X5: with ``most``, groups are taken in the order of their smallest id and
    none is begun once the deletions so far come to ``most``; a group that is
    begun is deleted whole. Each begun group deletes one edge at least, so the
    running total is over the first ``most`` groups only."""
    kind = F.lower(F.trim("type"))
    rows = edges.withColumn("_t", kind).filter("_t <> ''").withColumn("_score", completeness(properties(edges)))
    key = ["src", "dst", "_t"]
    if most is not None:
        groups = rows.groupBy(*key).agg(F.min("id").alias("_least"), (F.count(F.lit(1)) - 1).alias("_gone")).filter("_gone > 0").orderBy("_least").limit(most)
        before = F.coalesce(F.sum("_gone").over(Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(F.broadcast(groups.withColumn("_before", before).filter(F.col("_before") < most).select(*key)), key, "left_semi")  # at most ``most`` rows
    w = Window.partitionBy(*key).orderBy(F.desc("_score"), "id")
    ranked = rows.withColumn("_n", F.row_number().over(w)).withColumn("kept_id", F.first("id").over(w))
    return ranked.filter("_n > 1").select(
        F.lit("delete").alias("action"), "id", "kept_id", F.lit(None).cast("string").alias("new_type"), F.lit(confidence).alias("confidence"),
        F.to_json(F.struct("id", "src", "dst", "type", "fact")).alias("backup"),
    )


def standardise_corrections(edges: DataFrame, confidence: float = 0.90) -> DataFrame:
    """Rename types to the standard form where that differs, also where it is
    empty."""
    rows = edges.withColumn("new_type", screaming_snake("type")).filter("new_type <> type")
    return rows.select(
        F.lit("rename").alias("action"), "id", F.lit(None).cast("string").alias("kept_id"), "new_type", F.lit(confidence).alias("confidence"),
        F.to_json(F.struct("id", "src", "dst", "type", "fact")).alias("backup"),
    )


def correction_plan(edges: DataFrame, least: float = 0.0, batch: str = "batch", most: int | None = None) -> DataFrame:
    """Deletions, then renames, at or over a confidence. With ``most``,
    deletions stop as ``duplicate_corrections`` says and renames, in the order
    of ids, fill what is left of it. Renames cover all edges, those that the
    plan deletes too: such a rename finds nothing when it is applied. Nothing is
    changed before ``apply_corrections``, so the plan is the dry run."""
    deletes, renames = duplicate_corrections(edges, most=most), standardise_corrections(edges)
    if most is not None:
        n = F.row_number().over(Window.orderBy("id"))
        left = renames.orderBy("id").limit(most).withColumn("_n", n).crossJoin(F.broadcast(deletes.agg(F.count(F.lit(1)).alias("_gone"))))  # one row beside ``most`` at most
        renames = left.filter(F.col("_n") + F.col("_gone") <= most).drop("_n", "_gone")
    plan = deletes.unionByName(renames).filter(F.col("confidence") >= least)
    return plan.withColumn("batch", F.lit(batch)).withColumn("step", F.when(F.col("action") == "delete", 1).otherwise(2))


def apply_corrections(edges: DataFrame, plan: DataFrame) -> DataFrame:
    gone = plan.filter("action = 'delete'").select("id")
    names = plan.filter("action = 'rename'").select("id", "new_type")
    return edges.join(gone, "id", "left_anti").join(names, "id", "left").withColumn("type", F.coalesce("new_type", "type")).drop("new_type")


def roll_back(edges: DataFrame, applied: DataFrame) -> DataFrame:
    """Restore the edges of applied corrections from their backups."""
    schema = "id string, src string, dst string, type string, fact string"
    old = applied.select(F.from_json("backup", schema).alias("b")).select("b.*").dropDuplicates(["id"])
    return edges.join(old, "id", "left_anti").select("id", "src", "dst", "type", "fact").unionByName(old)


def rollback_statistics(applied: DataFrame) -> DataFrame:
    """Per batch: total, deletes, renames and the mean confidence."""
    return applied.groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "delete").alias("deletes"), F.count_if(F.col("action") == "rename").alias("renames"),
        F.round(F.avg("confidence"), 3).alias("confidence"),
    )


def rollback_report(edges: DataFrame, applied: DataFrame) -> DataFrame:
    """What a rollback does with each applied correction (id, action,
    backup, applied_at), the last applied first: ``restored``, ``renamed_back``,
    ``already_present`` (a deleted edge that is there again), ``edge_gone`` (a
    renamed edge that is not) or ``no_backup``."""
    here = edges.select("id", F.lit(True).alias("here"))
    j = applied.join(here, "id", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    outcome = (
        F.when(F.col("backup").isNull(), "no_backup").when((F.col("action") == "delete") & F.col("here"), "already_present").when(F.col("action") == "delete", "restored")
        .when(F.col("here"), "renamed_back").otherwise("edge_gone")
    )
    return j.select("id", "action", outcome.alias("outcome"), F.col("applied_at"))


def rollback_history(applied: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Per batch of the last ``days`` days, what was applied, rolled back
    and failed, and when."""
    recent = applied.filter(F.col("applied_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return recent.groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"), F.count("rolled_back_at").alias("rolled_back"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.min("applied_at").alias("first"), F.max("applied_at").alias("last"), F.round(100 * F.try_divide(F.count("rolled_back_at"), F.count(F.lit(1))), 3).alias("percent"),
    )


def can_roll_back(status: Column, rolled_back_at: Column, backup: Column) -> Column:
    """D3: a correction can be undone once, if it was applied and its backup is there."""
    return F.coalesce((status == "applied") & rolled_back_at.isNull() & backup.isNotNull(), F.lit(False))


def markdown_report(findings: DataFrame, title: str) -> DataFrame:
    """V9: the report as Markdown lines (pos, line): a title, the number of
    findings, then a section for each severity, the worst first, with a line for
    each rule. The rows are one for each severity and rule."""
    rows = report(findings)
    n = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    heads = rows.groupBy("severity").agg(F.sum("n").alias("n")).select((n * 1000).alias("pos"), F.lit("").alias("rule"), F.concat(F.lit("## "), F.initcap("severity"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    lines = rows.select((n * 1000 + 1).alias("pos"), "rule", F.concat(F.lit("- "), "rule", F.lit(": "), F.col("n").cast("string")).alias("line"))
    top = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(1).cast("long").alias("pos"), F.lit("").alias("rule"), F.concat(F.lit(f"# {title}: "), F.col("n").cast("string"), F.lit(" findings")).alias("line"))
    return top.unionByName(heads).unionByName(lines).orderBy("pos", "rule").select("pos", "rule", "line")
