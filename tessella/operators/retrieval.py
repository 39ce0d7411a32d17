"""Vector, full-text and hybrid retrieval, and context assembly.

The full-text rank is our own and documented: lower-case ``[a-z0-9]+`` tokens,
no stemming, a document must hold every query term, and its score is the sum
over terms and fields of the field's weight times 1 + ln(tf).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
RRF_K, BOTH_BONUS, TEXT_CAP = 60, 0.1, 0.9


def vector_top_k(rows: DataFrame, vector: str, query: Sequence[float], k: int, threshold: float | None = None, ties: Sequence[str] = ("id",)) -> DataFrame:
    """Exact search: the ``k`` rows of greatest cosine above the threshold.
    The query is one literal vector, so a scan and a top-k are all it takes."""
    out = rows.filter(F.col(vector).isNotNull()).withColumn("similarity", V.cosine(F.col(vector), V.literal(list(query))))
    out = out.filter(F.col("similarity") > threshold) if threshold is not None else out.filter(F.col("similarity").isNotNull())
    return out.orderBy(F.desc("similarity"), *ties).limit(k)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit("[a-z0-9]+"), 0)


def text_top_k(rows: DataFrame, fields: dict[str, str], terms: Sequence[str], k: int | None = None, ties: Sequence[str] = ("id",)) -> DataFrame:
    """Full-text search; ``fields`` maps columns to weight letters. A text's
    tokens are read once, for those that are terms."""
    terms = sorted({t.lower() for t in terms})
    score, held = F.lit(0.0), F.lit(True)
    for term in terms:
        own, found = F.lit(0.0), F.lit(False)
        for column, letter in fields.items():
            held_tokens = F.col(f"_tok_{column}")
            tf = F.size(held_tokens) - F.size(F.array_remove(held_tokens, term))
            own = own + F.when(tf > 0, WEIGHTS[letter] * (1 + F.log(tf))).otherwise(0.0)
            found = found | (tf > 0)
        score, held = score + own, held & found
    some = F.lit(True)
    for term in terms:  # a cheap test before any token is cut
        some = some & F.lower(F.concat_ws(" ", *fields)).contains(term)
    out = rows.filter(some)
    for column in fields:
        out = out.withColumn(f"_tok_{column}", F.filter(tokens(column), lambda t: t.isin(*terms)))
    out = out.filter(held).withColumn("score", score).drop(*[f"_tok_{c}" for c in fields])
    return out if k is None else out.orderBy(F.desc("score"), *ties).limit(k)


def linear_hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(id, vector_score, text_score, combined) over both candidate lists."""
    v = vector_hits.select("id", F.col("similarity").alias("vector_score"))
    t = text_hits.select("id", F.col("score").alias("text_score"))
    joined = v.join(t, "id", "full_outer").select("id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("text_score", F.lit(0.0)).alias("text_score"))
    return joined.withColumn("combined", F.col("vector_score") * weight + F.col("text_score") * (1 - weight)).orderBy(F.desc("combined"), "id").limit(k)


def reciprocal_rank_fusion(vector_hits: DataFrame, text_hits: DataFrame, k: int) -> DataFrame:
    """(id, rrf, similarity, search_type); both lists rank from 1. A row in
    both gains BOTH_BONUS of similarity up to 1; a text-only row has its score
    up to TEXT_CAP. Both inputs are short top-k lists."""
    v = vector_hits.select("id", "similarity", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")).alias("vr"))
    t = text_hits.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("tr"))
    j = v.join(t, "id", "full_outer")
    part = lambda r: F.coalesce(1.0 / (F.col(r) + RRF_K), F.lit(0.0))
    similarity = (
        F.when(F.col("vr").isNotNull() & F.col("tr").isNotNull(), F.least(F.lit(1.0), F.col("similarity") + BOTH_BONUS))
        .when(F.col("vr").isNotNull(), F.col("similarity")).otherwise(F.least(F.lit(TEXT_CAP), F.col("score")))
    )
    kind = F.when(F.col("vr").isNull(), "fulltext").otherwise("hybrid")
    return j.select("id", (part("vr") + part("tr")).alias("rrf"), similarity.alias("similarity"), kind.alias("search_type")).orderBy(F.desc("rrf"), "id").limit(k)


def neighbour_context(hits: DataFrame, rows: DataFrame, reach: int = 2) -> DataFrame:
    """Neighbours of hits with the best similarity of their document less 0.05."""
    from tessella.operators.relational import neighbours

    best = hits.groupBy("document_id").agg(F.max("similarity").alias("best"))
    near = neighbours(hits.select("document_id", "idx"), rows, "document_id", "idx", reach)
    return near.join(best, "document_id").withColumn("similarity", F.greatest(F.lit(0.0), F.col("best") - 0.05)).drop("best")


def rerank(rows: DataFrame, text: str, similarity: str, terms: Sequence[str], k: int = 18) -> DataFrame:
    """0.05 for each distinct term of three letters or more in the text."""
    terms = sorted({t.lower() for t in terms if len(t) > 2})
    hits = F.size(F.filter(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.lower(F.col(text)).contains(t)))
    return rows.withColumn("rerank", F.col(similarity) + hits * 0.05).orderBy(F.desc("rerank"), "id").limit(k)


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First occurrence of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", rank).filter("_n = 1").drop("_n")


def context_block(parts: Sequence[tuple[int, DataFrame]], most: int = 40) -> DataFrame:
    """Texts of several tiers in order, each once, at most ``most``."""
    out = None
    for tier, df in parts:
        own = df.select(F.lit(tier).alias("tier"), "pos", "text")
        out = own if out is None else out.unionByName(own)
    return first_by(out, ["text"], ["tier", "pos"]).orderBy("tier", "pos", "text").limit(most)


def relation_relevance(edges: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """Edges by the number of query terms in their type and peer name."""
    own = F.array_distinct(tokens(F.concat_ws(" ", "type", "peer")))
    overlap = F.size(F.array_intersect(own, F.array(*map(F.lit, sorted({t.lower() for t in terms})))))
    return edges.withColumn("overlap", overlap).filter("overlap > 0").orderBy(F.desc("overlap"), "id").limit(2 * k)


def recent_context(messages: DataFrame, key: str, order: str, text: str, width: int = 400, rows: int = 10, characters: int = 4000) -> DataFrame:
    """Newest first, each text once and trimmed, until ``rows`` messages or
    ``characters``; the caller sorts ascending again."""
    m = messages.withColumn("_t", F.substring(F.trim(text), 1, width))
    m = first_by(m, [key, "_t"], [F.desc(order)])
    w = Window.partitionBy(key).orderBy(F.desc(order))
    m = m.withColumn("_n", F.row_number().over(w)).withColumn("_used", F.sum(F.length("_t")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.filter((F.col("_n") <= rows) & (F.col("_used") <= characters)).select(key, order, F.col("_t").alias("context"))
