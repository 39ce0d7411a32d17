"""Sources and sinks: Markdown corpora, JSON corpora, snapshots and deletes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_JSON_BYTES = 1 << 20


def inside(root: str, path: str, suffix: str = ".md") -> bool:
    """Whether a path stays within a root and has the suffix, in any case."""
    parts: list[str] = []
    for part in PurePosixPath(path).parts:
        if part == "..":
            if not parts:
                return False
            parts.pop()
        elif part != ".":
            parts.append(part)
    base = [p for p in PurePosixPath(root).parts if p != "."]
    return parts[: len(base)] == base and len(parts) > len(base) and path.lower().endswith(suffix)


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, modified, bytes) of the Markdown files under a root, the
    newest first; read by Spark from wherever the root is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "path")


def described(files: DataFrame) -> DataFrame:
    """Metadata of loaded files: title, summary, type, counts, fingerprint."""
    from tessella.functions import text as X

    return files.select(
        "path", X.title_of("text", "path").alias("title"), X.summary_of("text").alias("summary"), X.document_type("path").alias("document_type"),
        X.line_count("text").alias("lines"), X.word_count("text").alias("words"), X.fingerprint("text").alias("fingerprint"), X.short_id("text").alias("short_id"),
    )


RETRIEVAL_CORPUS = (
    "schema_version int, cases array<struct<case_id: string, query: string, expected_entities: array<struct<id: string, aliases: array<string>>>,"
    " judgments: array<struct<document_stable_id: string, episode_index: int, source_fingerprint: string, relevance: int>>>>"
)


def json_corpus(spark: SparkSession, path: str, schema: str = RETRIEVAL_CORPUS) -> DataFrame:
    """A corpus file with its byte fingerprint; one that is too large, does
    not parse or repeats a case raises ValueError."""
    raw = spark.read.format("binaryFile").load(path).select("length", "content", F.sha2("content", 256).alias("sha"))
    size = raw.agg(F.max("length")).first()[0]
    if size is None or size > MOST_JSON_BYTES:
        raise ValueError(f"a corpus has at most {MOST_JSON_BYTES} bytes; this has {size}")
    out = raw.select(F.concat(F.lit("sha256:v1:"), "sha").alias("fingerprint"), F.from_json(F.decode("content", "UTF-8"), schema).alias("c")).select("fingerprint", "c.*")
    bad = out.select((F.col("cases").isNull() | (F.size(F.array_distinct("cases.case_id")) != F.size("cases"))).alias("bad")).first()
    if bad is None or bad[0]:
        raise ValueError("the corpus does not parse or repeats a case")
    return out


def unknown_references(corpus: DataFrame, documents: DataFrame) -> DataFrame:
    """Judgements whose document is not among ``documents``."""
    j = corpus.select(F.explode("cases").alias("c")).select("c.case_id", F.explode("c.judgments").alias("j")).select("case_id", F.col("j.document_stable_id").alias("document_stable_id"))
    return j.join(documents, "document_stable_id", "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """A new snapshot of (key, content, ...) rows with the action of each:
    insert, update where the content differs, refresh where it does not, keep
    where nothing came in."""
    names = [c for c in incoming.columns if c != key]
    j = current.alias("c").join(incoming.alias("i"), key, "full_outer")
    new, old = F.col(f"i.{content}").isNotNull(), F.col(f"c.{content}").isNotNull()
    action = F.when(~old, "insert").when(~new, "keep").when(F.col(f"c.{content}") != F.col(f"i.{content}"), "update").otherwise("refresh")
    return j.select(key, *(F.when(new, F.col(f"i.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in names), action.alias("action"))


def latest_wins(batches: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """On-conflict update: of the rows with one key the last one stays."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return batches.withColumn("_n", n).filter("_n = 1").drop("_n")


def fill_embeddings(rows: DataFrame, column: str, embed: Column) -> DataFrame:
    """Embed only the rows that have no vector; others pass untouched."""
    return rows.withColumn(column, F.when(F.col(column).isNull(), embed).otherwise(F.col(column)))


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay; a null condition deletes nothing."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def report_sinks(findings: DataFrame, report_id: str) -> tuple[DataFrame, DataFrame]:
    """One report row and its findings, ready to append."""
    rows = findings.withColumn("report_id", F.lit(report_id))
    head = rows.groupBy("report_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity").isin("error", "critical")).alias("errors"), F.round(F.avg("confidence"), 3).alias("confidence"))
    return head, rows


def run_sql(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A parametrised statement."""
    return spark.sql(sql, args=args)


def table_columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def column_profile(df: DataFrame) -> DataFrame:
    """(name, present, different): for each column how many rows hold a
    value and how many values there are, in one pass of aggregates."""
    counts = [F.struct(F.lit(c).alias("name"), F.count(c).alias("present"), F.countDistinct(c).alias("different")) for c in df.columns]
    return df.agg(*(s.alias(f"c{i}") for i, s in enumerate(counts))).select(F.explode(F.array(*(F.col(f"c{i}") for i in range(len(counts))))).alias("c")).select("c.*")


def migrations(applied: DataFrame, wanted: DataFrame) -> DataFrame:
    """(version, status) of (version, checksum): applied, changed, pending, or
    gap where a later one is applied already, or unknown."""
    last = applied.agg(F.max("version").alias("last"))
    j = wanted.select("version", F.col("checksum").alias("w")).join(applied.select("version", F.col("checksum").alias("a")), "version", "full_outer").crossJoin(F.broadcast(last))  # one row
    status = F.when(F.col("w").isNull(), "unknown").when(F.col("a").isNull() & (F.col("version") < F.col("last")), "gap").when(F.col("a").isNull(), "pending").when(F.col("a") != F.col("w"), "changed").otherwise("applied")
    return j.select("version", status.alias("status"))


def embed_missing(rows: DataFrame, key: str, text: str, column: str, embed: Callable[[list[str]], list[list[float]]], size: int = 32) -> DataFrame:
    """(key, vector, error) of the rows without a vector, in batches of
    ``size`` texts. ``embed`` is any model: texts to vectors. The rows of a batch
    that it fails on come back without a vector and with the name of the error;
    they stay without one and come again next time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), size):
                part = pdf.iloc[start : start + size]
                try:
                    vectors, error = embed(part[text].tolist()), None
                except Exception as e:  # any model may raise anything; the rows say so
                    vectors, error = [None] * len(part), type(e).__name__
                yield pd.DataFrame({key: part[key].array, column: pd.Series(vectors, dtype=object), "error": pd.Series([error] * len(part), dtype=object)})

    missing = rows.filter(F.col(column).isNull()).select(key, text)
    return missing.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {column} array<double>, error string")


def generate(rows: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str]], size: int = 16) -> DataFrame:
    """(key, answer, error) for each prompt, in batches of ``size``. ``model``
    is any text model: prompts to texts. The rows of a batch that it fails on, or
    answers with another number of texts, have the name of the error instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), size):
                part = pdf.iloc[start : start + size]
                try:
                    answers, error = list(model([p if isinstance(p, str) else "" for p in part[prompt]])), None
                    if len(answers) != len(part):
                        raise ValueError("one answer for each prompt")
                except Exception as e:  # any model may raise anything; the rows say so
                    answers, error = [None] * len(part), type(e).__name__
                yield pd.DataFrame({key: part[key].array, "answer": pd.Series(answers, dtype=object), "error": pd.Series([error] * len(part), dtype=object)})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, answer string, error string")


def with_embeddings(rows: DataFrame, key: str, column: str, made: DataFrame) -> DataFrame:
    """Rows with the vectors that were made for them."""
    return rows.join(made.select(key, F.col(column).alias("_made")), key, "left").withColumn(column, F.coalesce(column, "_made")).drop("_made")


def correction_rows(edges: DataFrame, plan: DataFrame, applied_at: Column) -> DataFrame:
    """The rows that a correction sink appends: each planned correction
    with the whole edge as a JSON backup."""
    backup = edges.select("id", F.to_json(F.struct(*sorted(edges.columns))).alias("backup"))
    return plan.select("id", "action", "confidence").join(backup, "id", "left").withColumns({"status": F.lit("applied"), "applied_at": applied_at, "rolled_back_at": F.lit(None).cast("timestamp")})


def append_messages(messages: DataFrame, incoming: DataFrame, key: str = "conv_id") -> DataFrame:
    """Incoming messages (key, role, text, at) numbered on from the last
    turn of their conversation; an unknown conversation starts at 1."""
    last = messages.groupBy(key).agg(F.max("turn").alias("last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("at", "role", "text"))
    new = incoming.withColumn("n", n).join(last, key, "left").withColumn("turn", F.coalesce("last", F.lit(0)) + F.col("n"))
    return messages.unionByName(new.select(*messages.columns))


def reconcile_corpus(judgements: DataFrame, entities: DataFrame, episodes: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """Q12: (case_id, codes, ungrounded) of the cases of a retrieval corpus
    that its source does not bear out. ``judgements`` (case_id, selector,
    fingerprint) must meet ``episodes`` (selector, fingerprint, text); an alias of
    each expected entity (case_id, entity, aliases) must be in the texts met."""
    e = episodes.select("selector", F.col("fingerprint").alias("actual"), "text")
    met = judgements.join(e, "selector", "left").withColumn("code", F.when(F.col("actual").isNull(), "judgment_episode_missing").when(F.col("actual") != F.col("fingerprint"), "judgment_source_fingerprint_mismatch"))
    bad = met.filter("code is not null").select("case_id", "code", F.lit(None).cast("string").alias("entity"))
    texts = met.filter("code is null").select("case_id", normal(F.col("text")).alias("said"))
    named = entities.select("case_id", "entity", F.explode("aliases").alias("alias")).withColumn("alias", normal(F.col("alias")))
    grounded = named.join(texts, "case_id").filter(F.col("said").contains(F.col("alias"))).select("case_id", "entity").distinct()
    loose = entities.select("case_id", "entity").distinct().join(grounded, ["case_id", "entity"], "left_anti").select("case_id", F.lit("expected_entity_not_grounded").alias("code"), "entity")
    return bad.unionByName(loose).groupBy("case_id").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.sort_array(F.collect_set("entity")).alias("ungrounded"))
