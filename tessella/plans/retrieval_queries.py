"""Retrieval queries over embedded episodes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import relational as R
from tessella.operators import retrieval as T
from tessella.plans import inputs as I
from tessella.plans.inputs import table, with_
from tessella.plans.registry import query

_COS = "(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"
_SIM = f"sim AS (SELECT e.id, e.document_id, e.idx, e.text, {_COS} AS similarity FROM embedded e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_TF = "len(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: t = '{t}'))"


def _score(column: str, terms: list[str], weight: float) -> str:
    parts = [f"CASE WHEN {_TF.format(c=column, t=t)} > 0 THEN {weight} * (1 + ln({_TF.format(c=column, t=t)})) ELSE 0 END" for t in terms]
    return " + ".join(parts)


def _has(columns: list[str], terms: list[str]) -> str:
    return " AND ".join("(" + " OR ".join(f"{_TF.format(c=c, t=t)} > 0" for c in columns) + ")" for t in terms)


TERMS = ["the", "of"]
_TXT = f"txt AS (SELECT id, {_score('text', TERMS, 1.0)} AS score FROM embedded WHERE {_has(['text'], TERMS)} ORDER BY score DESC, id LIMIT 20)"


@query("r01_vector_top_k", with_("embedded") + f", {_SIM} SELECT id, round(similarity, 9) AS similarity FROM sim WHERE similarity > 0.05 ORDER BY sim.similarity DESC, id LIMIT 10")
def r01(spark, d):
    hits = T.vector_top_k(I.embedded(spark, d), "embedding", I.query_vector(spark, d), 10, 0.05)
    return hits.select("id", F.round("similarity", 9).alias("similarity"))


@query("r03_tie_broken_top_k", with_("embedded") + f", {_SIM} SELECT id, document_id, idx FROM sim ORDER BY similarity DESC, document_id, idx LIMIT 25")
def r03(spark, d):
    return T.vector_top_k(I.embedded(spark, d), "embedding", I.query_vector(spark, d), 25, None, ("document_id", "idx")).select("id", "document_id", "idx")


@query("r04_source_fenced_search", with_("embedded") + f", {_SIM}, jobs AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE sha256(text) END AS fp FROM documents) SELECT s.id FROM sim s JOIN jobs j ON j.id = s.id AND j.fp = sha256(s.text) ORDER BY s.similarity DESC, s.id LIMIT 10")
def r04(spark, d):
    jobs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "stale").otherwise(F.sha2("text", 256)).alias("fp"))
    rows = I.embedded(spark, d).withColumn("fp", F.sha2("text", 256)).join(jobs, ["id", "fp"])
    return T.vector_top_k(rows, "embedding", I.query_vector(spark, d), 10).select("id")


@query("r05_weighted_full_text", with_("source_documents") + f"SELECT id, round({_score('title', TERMS, 1.0)} + {_score('body', TERMS, 0.2)}, 9) AS score FROM source_documents WHERE {_has(['title', 'body'], TERMS)} ORDER BY score DESC, id LIMIT 20")
def r05(spark, d):
    hits = T.text_top_k(I.source_documents(spark, d, canonical=False), {"title": "A", "body": "C"}, TERMS)
    return hits.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("r06_episode_full_text", with_("embedded") + f", {_TXT} SELECT id, round(score, 9) AS score FROM txt")
def r06(spark, d):
    return T.text_top_k(I.embedded(spark, d), {"text": "A"}, TERMS, 20).select("id", F.round("score", 9).alias("score"))


def _lists(spark, d):
    rows = I.embedded(spark, d)
    return T.vector_top_k(rows, "embedding", I.query_vector(spark, d), 20, 0.0), T.text_top_k(rows, {"text": "A"}, TERMS, 20)


_VEC = "vec AS (SELECT id, similarity FROM sim WHERE similarity > 0 ORDER BY similarity DESC, id LIMIT 20)"


@query("r07_linear_hybrid", with_("embedded") + f", {_SIM}, {_TXT}, {_VEC} SELECT coalesce(v.id, t.id) AS id, round(0.7 * coalesce(v.similarity, 0) + (1 - 0.7) * coalesce(t.score, 0), 9) AS combined FROM vec v FULL JOIN txt t ON v.id = t.id ORDER BY combined DESC, id LIMIT 10")
def r07(spark, d):
    return T.linear_hybrid(*_lists(spark, d), 10).select("id", F.round("combined", 9).alias("combined"))


@query("r08_reciprocal_rank_fusion", with_("embedded") + f""", {_SIM}, {_TXT}, {_VEC},
 v AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS r FROM vec), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM txt)
 SELECT coalesce(v.id, t.id) AS id, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0), 9) AS rrf,
 round(CASE WHEN v.id IS NOT NULL AND t.id IS NOT NULL THEN least(1.0, v.similarity + 0.1) WHEN v.id IS NOT NULL THEN v.similarity ELSE least(0.9, t.score) END, 9) AS similarity,
 CASE WHEN v.id IS NULL THEN 'fulltext' ELSE 'hybrid' END AS search_type FROM v FULL JOIN t ON v.id = t.id ORDER BY coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + t.r), 0) DESC, 1 LIMIT 15""")
def r08(spark, d):
    out = T.reciprocal_rank_fusion(*_lists(spark, d), 15)
    return out.select("id", F.round("rrf", 9).alias("rrf"), F.round("similarity", 9).alias("similarity"), "search_type")


@query("r09_neighbour_expansion", with_("embedded") + f""", {_SIM}, hits AS (SELECT * FROM sim WHERE similarity > 0.05 ORDER BY similarity DESC, id LIMIT 10),
 near AS (SELECT DISTINCT document_id, idx + o AS idx FROM hits, (VALUES (-2), (-1), (0), (1), (2)) t(o) WHERE idx + o >= 0)
 SELECT e.id, round(greatest(0, (SELECT max(similarity) FROM hits h WHERE h.document_id = e.document_id) - 0.05), 9) AS similarity FROM embedded e JOIN near USING (document_id, idx)
 WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.document_id = e.document_id AND h.idx = e.idx)""")
def r09(spark, d):
    rows = I.embedded(spark, d)
    hits = T.vector_top_k(rows, "embedding", I.query_vector(spark, d), 10, 0.05)
    return T.neighbour_context(hits, rows.select("id", "document_id", "idx")).select("id", F.round("similarity", 9).alias("similarity"))


@query("r12_context_budget", with_("embedded") + f""", {_SIM}, h AS (SELECT id, len(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS cost, similarity FROM sim ORDER BY similarity DESC, id LIMIT 30),
 i AS (SELECT list(struct_pack(id := id, used := cost, kept := []::BIGINT[]) ORDER BY similarity DESC, id) AS rows FROM h),
 f AS (SELECT rows[1].id AS first, list_reduce(rows, lambda a, x: CASE WHEN a.used + x.used <= 3000 THEN struct_pack(id := x.id, used := a.used + x.used, kept := list_append(a.kept, x.id)) ELSE a END, struct_pack(id := 0::BIGINT, used := 0::BIGINT, kept := []::BIGINT[])) AS r FROM i)
 SELECT id, cost FROM h, f WHERE list_contains(CASE WHEN len(r.kept) = 0 THEN [first] ELSE r.kept END, id)""")
def r12(spark, d):
    hits = T.vector_top_k(I.embedded(spark, d), "embedding", I.query_vector(spark, d), 30).withColumn("all", F.lit(1))
    cost = hits.withColumn("cost", F.size(F.split("text", r"\s+")))
    return R.greedy_budget(cost, "all", [F.desc("similarity"), F.asc("id")], "cost", 3000).select("id", "cost")


@query("r13_multi_query_dedupe", with_("embedded") + """, u AS (SELECT text, id, 1 AS q FROM embedded WHERE id % 2 = 0 UNION ALL SELECT text, id, 2 FROM embedded WHERE id % 3 = 0)
 SELECT id, q FROM u QUALIFY row_number() OVER (PARTITION BY text ORDER BY q, id) = 1""")
def r13(spark, d):
    rows = I.embedded(spark, d).select("text", "id")
    both = rows.filter("id % 2 = 0").withColumn("q", F.lit(1)).unionByName(rows.filter("id % 3 = 0").withColumn("q", F.lit(2)))
    return T.first_by(both, ["text"], ["q", "id"]).select("id", "q")


@query("r14_rerank", with_("embedded") + f""", {_SIM} SELECT id, round(similarity + 0.05 * (CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'pour') THEN 1 ELSE 0 END), 9) AS rerank
 FROM sim ORDER BY similarity + 0.05 * (CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'pour') THEN 1 ELSE 0 END) DESC, id LIMIT 18""")
def r14(spark, d):
    rows = I.embedded(spark, d).withColumn("similarity", V.cosine(F.col("embedding"), V.literal(I.query_vector(spark, d))))
    return T.rerank(rows, "text", "similarity", ["tion", "Pour", "of"]).select("id", F.round("rerank", 9).alias("rerank"))


@query("r15_context_block", """SELECT tier, pos FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY tier, pos) AS n FROM
 (SELECT 1 AS tier, turn AS pos, text FROM conversations UNION ALL SELECT 2, doc_id, text FROM documents)) WHERE n = 1 ORDER BY tier, pos, text LIMIT 40""")
def r15(spark, d):
    one = table(spark, d, "conversations").select(F.col("turn").alias("pos"), "text")
    two = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return T.context_block([(1, one), (2, two)]).select("tier", "pos")


@query("r17_relation_relevance", with_("edges", "nodes") + """SELECT e.id, len(list_intersect(list_distinct(regexp_extract_all(lower(type || ' ' || n.name), '[a-z0-9]+')), ['located', 'nation', 'china', 'in'])) AS overlap
 FROM edges e JOIN nodes n ON n.id = e.dst WHERE overlap > 0 ORDER BY overlap DESC, e.id LIMIT 20""")
def r17(spark, d):
    peers = I.nodes(spark, d).select(F.col("id").alias("dst"), F.col("name").alias("peer"))
    return T.relation_relevance(I.edges(spark, d).join(peers, "dst"), ["Located", "nation", "china", "in"], 10).select("id", "overlap")


@query("r18_recent_context", """WITH m AS (SELECT conv_id, turn, substr(trim(text), 1, 400) AS t FROM conversations), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY turn DESC) = 1)
 SELECT conv_id, turn, t AS context FROM (SELECT *, row_number() OVER w AS n, sum(length(t)) OVER w AS used FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE n <= 10 AND used <= 4000""")
def r18(spark, d):
    return T.recent_context(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("f26_vector_problems", "SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) = 0 THEN 'zero_norm' END AS problem FROM embeddings")
def f26(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.problem(F.col("embedding"), 64).alias("problem"))


@query("a22_centroids", "SELECT label, i, round(avg(x::DOUBLE), 9) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def a22(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))
