"""Logical inputs of the knowledge-retrieval operators, projected from the
driver's tables; ``SQL`` holds the same projections as common table
expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_documents(spark: SparkSession, sf_dir: str, canonical: bool = True) -> DataFrame:
    """Documents as sources; without ``canonical`` the labels are not read."""
    docs = table(spark, sf_dir, "documents")
    if not canonical:
        return docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 50).alias("title"), F.col("text").alias("body"))
    canon = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("canonical")).distinct()
    return docs.join(canon, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 50).alias("title"), F.col("text").alias("body"),
        F.col("lang").alias("document_type"), F.col("source").alias("source_file"),
        F.coalesce("canonical", F.lit(False)).alias("canonical"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes (id, label, name) from the star schema."""
    parts = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("part", "p_partkey", "p_name")]
    out = None
    for name, key, label in parts:
        own = table(spark, sf_dir, name).select(F.concat(F.lit(name[0]), F.col(key).cast("string")).alias("id"), F.lit(name).alias("label"), F.col(label).alias("name"))
        out = own if out is None else out.unionByName(own)
    return out


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Graph edges (id, src, dst, type, fact) from the star schema. Without
    ``once`` an edge comes as often as the table has it."""
    supplied = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    supplied = supplied.distinct() if once else supplied
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        t("customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("LivesIn").alias("type"), F.col("c_mktsegment").alias("fact")),
        t("supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("Located In").alias("type"), F.col("s_name").alias("fact")),
        t("nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("part-of").alias("type"), F.col("n_name").alias("fact")),
        supplied.select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("type"), F.lit("supplies").alias("fact")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.concat_ws(">", "src", "type", "dst").alias("id"), "src", "dst", "type", "fact")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of attempts from the event stream."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("episode_id"), (F.col("user_id") % 5).alias("run_id"),
        F.col("event_type").alias("outcome"), F.col("value").alias("latency"), F.col("ts").alias("completed_at"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, document_id, idx, embedding, text): embedded episodes."""
    vec = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return vec.join(docs, "vec_id").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("document_id"), F.floor(F.col("vec_id") / 50).alias("idx"), "embedding", "text", "lang")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with id 0: one row."""
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row[0])


SQL = {
    "source_documents": """source_documents AS (
  SELECT d.doc_id AS id, substr(d.text, 1, 50) AS title, d.text AS body, d.lang AS document_type, d.source AS source_file,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS canonical
  FROM documents d)""",
    "nodes": """nodes AS (
  SELECT 'c' || c_custkey AS id, 'customer' AS label, c_name AS name FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'region', r_name FROM region
  UNION ALL SELECT 'p' || p_partkey, 'part', p_name FROM part)""",
    "edges": """edges AS (
  SELECT src || '>' || type || '>' || dst AS id, src, dst, type, fact FROM (
  SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'LivesIn' AS type, c_mktsegment AS fact FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'Located In', s_name FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part-of', n_name FROM nation
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES', 'supplies' FROM lineitem))""",
    "attempts": """attempts AS (
  SELECT event_id AS attempt_id, user_id AS episode_id, user_id % 5 AS run_id, event_type AS outcome, value AS latency, ts AS completed_at FROM events)""",
    "embedded": """embedded AS (
  SELECT e.vec_id AS id, e.vec_id % 50 AS document_id, e.vec_id // 50 AS idx, e.embedding, d.text, d.lang
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
