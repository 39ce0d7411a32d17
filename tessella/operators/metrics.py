"""Retrieval and extraction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def case_scores(judgements: DataFrame, ranking: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(case_id, recall@k.., rr, ndcg, first_rank) from judgements (case_id,
    doc_id, grade) and ranking (case_id, doc_id, rank)."""
    depth = max(cutoffs)
    hits = judgements.join(ranking.filter(F.col("rank") <= depth), ["case_id", "doc_id"], "left")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    own = hits.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("judged"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in cutoffs),
        F.min("rank").alias("first_rank"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "doc_id"))
    best = judgements.withColumn("place", place).filter(F.col("place") <= depth)
    ideal = best.groupBy("case_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)).alias("ideal"))
    return own.join(ideal, "case_id").select(
        "case_id", *((F.col(f"hits_{k}") / F.col("judged")).alias(f"recall_{k}") for k in cutoffs), "first_rank",
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"), F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"),
    )


def macro(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Means over all cases; a case without a score counts as zero."""
    names = [c for c in scores.columns if c not in ("case_id", "first_rank")]
    j = cases.select("case_id").distinct().join(scores, "case_id", "left").na.fill(0.0, names)
    return j.agg(F.count(F.lit(1)).alias("cases"), *(F.avg(c).alias(c) for c in names))


def ranking_problems(ranking: DataFrame) -> DataFrame:
    """Documents or ranks that a case's ranking repeats."""
    docs = ranking.groupBy("case_id", F.col("doc_id").cast("string").alias("what")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("document"))
    ranks = ranking.groupBy("case_id", F.col("rank").cast("string").alias("what")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("rank"))
    return docs.unionByName(ranks).filter("n > 1")


def extraction_recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Share of expected (case_id, name) that a found name matches in the
    same case, alphanumerically, either way round."""
    from tessella.functions.text import alphanumeric

    e = expected.select("case_id", "name", alphanumeric("name").alias("key")).distinct()
    f = found.groupBy("case_id").agg(F.collect_set(alphanumeric("name")).alias("keys"))
    hit = F.exists("keys", lambda k: (k != "") & (F.col("key") != "") & (k.contains(F.col("key")) | F.col("key").contains(k)))
    j = e.join(f, "case_id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return j.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("hit")).alias("matched")).withColumn("recall", F.col("matched") / F.col("expected"))
