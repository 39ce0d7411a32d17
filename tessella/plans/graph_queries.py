"""Graph, validation and correction queries over the star-schema graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import graph as G
from tessella.operators import validation as V
from tessella.plans import inputs as I
from tessella.plans.inputs import table, with_
from tessella.plans.registry import query

NE = with_("nodes", "edges")


@query("g01_node_search", NE + "SELECT id, label, name FROM nodes WHERE contains(lower(name), 'r#0000000') AND label = 'customer' ORDER BY name, id LIMIT 10")
def g01(spark, d):
    return G.search_nodes(I.nodes(spark, d), "R#0000000", "customer").select("id", "label", "name")


@query("g03_one_hop", NE + "SELECT dst AS peer, 'out' AS direction, type, id FROM edges WHERE src = 'n3' UNION ALL SELECT src, 'in', type, id FROM edges WHERE dst = 'n3'")
def g03(spark, d):
    return G.one_hop(I.edges(spark, d), "n3")


@query("g04_neighbour_lists", NE + """, s AS (SELECT DISTINCT src AS id, 'out' AS direction, dst AS peer FROM edges UNION SELECT DISTINCT dst, 'in', src FROM edges)
 SELECT id, direction, array_to_string(list(peer ORDER BY peer), ',') AS peers FROM (SELECT * FROM s WHERE id IN (SELECT id FROM nodes WHERE label IN ('nation', 'region'))
 QUALIFY row_number() OVER (PARTITION BY id, direction ORDER BY peer) <= 100) GROUP BY id, direction""")
def g04(spark, d):
    ids = I.nodes(spark, d).filter("label in ('nation', 'region')")
    return G.neighbour_lists(I.edges(spark, d), ids).select("id", "direction", F.array_join("peers", ",").alias("peers"))


@query("g05_edge_details", NE + "SELECT e.id, s.name AS src_name, t.name AS dst_name, s.label AS src_label, t.label AS dst_label FROM edges e JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst")
def g05(spark, d):
    return G.edge_details(I.edges(spark, d), I.nodes(spark, d)).select("id", "src_name", "dst_name", "src_label", "dst_label")


@query("g06_entity_profile", NE + """, best AS (SELECT id FROM nodes WHERE contains(lower(name), 'supplier') ORDER BY length(name), id LIMIT 1),
 own AS (SELECT e.id, type, dst AS peer FROM edges e, best WHERE src = best.id UNION ALL SELECT e.id, type, src FROM edges e, best WHERE dst = best.id)
 SELECT id, type, peer FROM own QUALIFY row_number() OVER (PARTITION BY type ORDER BY id) <= 5 ORDER BY type, id LIMIT 20""")
def g06(spark, d):
    return G.entity_profile(I.nodes(spark, d), I.edges(spark, d), "supplier").select("id", "type", "peer")


@query("g07_two_hops", NE + "SELECT b.id AS second_edge, a.dst AS middle, b.dst AS \"end\" FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 's1' AND a.type = 'Located In' AND b.dst <> 's1' ORDER BY middle, \"end\", second_edge LIMIT 20")
def g07(spark, d):
    return G.two_hops(I.edges(spark, d), "s1", "Located In").select("second_edge", "middle", "end")


@query("g09_connected_components", """SELECT d.doc_id AS id, (SELECT min(x.doc_id) FROM documents x WHERE x.text = d.text) AS component FROM documents d""")
def g09(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    least = docs.groupBy("sha").agg(F.min("doc_id").alias("dst"))
    edges = docs.join(least, "sha").select(F.col("doc_id").alias("src"), "dst")
    return G.connected_components(docs.select(F.col("doc_id").alias("id")), edges)


_G10 = """WITH d AS (SELECT doc_id, lang, source, sha256(text) AS sha FROM documents), c AS (SELECT doc_id, lang, source, min(doc_id) OVER (PARTITION BY sha) AS component FROM d),
 n AS (SELECT component, count(*) AS size, count(DISTINCT lang) AS labels FROM c GROUP BY 1), e AS (SELECT component, count(*) AS edges, count(DISTINCT source) AS types FROM c WHERE doc_id <> component GROUP BY 1),
 j AS (SELECT n.component, size, labels, coalesce(edges, 0) AS edges, coalesce(types, 0) AS types FROM n LEFT JOIN e USING (component)),
 s AS (SELECT component, size, edges, 0.35 * 0.5 + 0.2 * CASE WHEN size > 1 THEN least(1.0, edges / (size * (size - 1) / 2)) ELSE 0.0 END + 0.15 * least(1.0, 2 * edges / size / 5) + 0.1 * labels / 13
 + 0.1 * CASE WHEN size <= 3 THEN 0.3 WHEN size <= 10 THEN 1.0 WHEN size <= 20 THEN 0.7 ELSE 0.5 END + 0.1 * least(1.0, types / 10) AS score FROM j)"""


def _copies(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha"))
    least = docs.groupBy("sha").agg(F.min("doc_id").alias("component"))
    c = docs.join(least, "sha")
    nodes = c.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    edges = c.filter("doc_id <> component").select(F.col("doc_id").alias("src"), F.col("component").alias("dst"), F.col("source").alias("type"))
    return nodes, edges, c.select(F.col("doc_id").alias("id"), "component")


@query("g10_subgraph_scores", _G10 + " SELECT component, size, edges, round(score, 9) AS score FROM s")
def g10(spark, d):
    return G.subgraph_scores(*_copies(spark, d)).withColumn("score", F.round("score", 9))


@query("g11_top_subgraphs", _G10 + " SELECT component, round(score, 9) AS score FROM s ORDER BY s.score DESC, size DESC, component LIMIT 3")
def g11(spark, d):
    return G.subgraph_scores(*_copies(spark, d)).orderBy(F.desc("score"), F.desc("size"), "component").limit(3).select("component", F.round("score", 9).alias("score"))


@query("g13_two_hop_filter", NE + """, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT DISTINCT src AS id FROM b WHERE src IN ('r1', 'c5', 'zz')),
 h1 AS (SELECT dst AS id FROM b WHERE src IN (SELECT id FROM h0)), h2 AS (SELECT dst AS id FROM b WHERE src IN (SELECT id FROM h1)),
 r AS (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2) SELECT id FROM edges WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)""")
def g13(spark, d):
    seeds = spark.createDataFrame([("r1",), ("c5",), ("zz",)], "id string")
    e = I.edges(spark, d)
    return G.within(e, G.k_hop(e, seeds, 2)).select("id")


@query("g17_upsert_edges", NE + " SELECT e.id, CASE WHEN src LIKE 'n%' THEN 'new' ELSE fact END AS fact FROM edges e UNION ALL SELECT 'r1>NEAR>r2', 'new'")
def g17(spark, d):
    e = I.edges(spark, d)
    wanted = e.filter("src like 'n%'").select("src", "dst", "type", F.lit("new").alias("fact")).union(spark.createDataFrame([("r1", "r2", "NEAR", "new")], "src string, dst string, type string, fact string"))
    return G.upsert_edges(e, wanted).select("id", "fact")


_ROADS = """roads AS (SELECT src, dst, min(distance) AS step FROM (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_quantity::DOUBLE AS distance FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1.0 + s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2.0 FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 3.0 + n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.5 FROM supplier) GROUP BY ALL)"""
_HOP = "l{n} AS (SELECT start, id, min({{'d': d, 'hops': hops, 'path': path}}) AS b FROM (SELECT start, dst AS id, (b.d + step)::DOUBLE AS d, {n} AS hops, list_append(b.path, dst) AS path FROM l{m} JOIN roads ON src = l{m}.id WHERE NOT list_contains(b.path, dst)) GROUP BY ALL)"


@query("g18_weighted_paths", f"""WITH {_ROADS}, l0 AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS id, {{'d': 0.0::DOUBLE, 'hops': 0, 'path': ['c' || c_custkey]}} AS b FROM customer),
 {", ".join(_HOP.format(n=n, m=n - 1) for n in range(1, 6))}
 SELECT start, id, b.d AS distance, b.hops AS hops, array_to_string(b.path, '>') AS path FROM (SELECT start, id, min(b) AS b FROM ({" UNION ALL ".join(f"SELECT * FROM l{n}" for n in range(1, 6))}) GROUP BY ALL)""")
def g18b(spark, d):
    t = lambda n: table(spark, d, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    far = lambda c: F.lit(c).cast("double") if isinstance(c, (int, float)) else c.cast("double")
    road = lambda df, a, b, c: df.select(a.alias("src"), b.alias("dst"), far(c).alias("distance"))
    nation, supplier = t("nation"), t("supplier")
    roads = road(t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")), key("c", "o_custkey"), key("s", "l_suppkey"), F.col("l_quantity"))
    for other in (
        road(supplier, key("s", "s_suppkey"), key("n", "s_nationkey"), F.col("s_nationkey") + 1), road(nation, key("n", "n_nationkey"), key("r", "n_regionkey"), 2),
        road(nation, key("r", "n_regionkey"), key("n", "n_nationkey"), F.col("n_nationkey") + 3), road(supplier, key("n", "s_nationkey"), key("s", "s_suppkey"), 0.5),
    ):
        roads = roads.unionByName(other)
    return G.weighted_paths(roads, t("customer").select(key("c", "c_custkey").alias("id")), sep=">")


@query("g18_shortest_paths", with_("edges") + "SELECT id, hops FROM (SELECT 's1' AS id, 0 AS hops UNION ALL SELECT DISTINCT dst, 1 FROM edges WHERE src = 's1' UNION ALL SELECT DISTINCT b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 's1')")
def g18(spark, d):
    return G.shortest_paths(I.edges(spark, d), "s1")


@query("g20_statistics", NE + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT label) FROM nodes) AS labels, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT type) FROM edges) AS types")
def g20(spark, d):
    return G.statistics(I.nodes(spark, d), I.edges(spark, d))


# -- validation: relationships between customers, from their shared orders' events
_REL = """rel AS (SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS src, (event_id * 7 % 150)::VARCHAR AS dst,
 CASE event_type WHEN 'signup' THEN 'Allied With' WHEN 'error' THEN 'opposed-to' WHEN 'click' THEN 'parent of' WHEN 'view' THEN 'CHILD_OF' ELSE 'RELATES_TO' END AS type,
 CASE WHEN value > 50 THEN 'fact ' || event_type ELSE '' END AS fact, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 52 WHEN 2 THEN 102 ELSE 23 END + CASE WHEN value > 50 THEN 30 ELSE 0 END AS score FROM events)"""
_T = r"lower(regexp_replace(trim(type), '[\s-]+', '_', 'g'))"


def _relations(spark, d):
    kind = F.when(F.col("event_type") == "signup", "Allied With").when(F.col("event_type") == "error", "opposed-to").when(F.col("event_type") == "click", "parent of").when(F.col("event_type") == "view", "CHILD_OF").otherwise("RELATES_TO")
    fact, i, m = F.when(F.col("value") > 50, F.concat(F.lit("fact "), "event_type")).otherwise(""), F.col("event_id") % 4, F.lit
    none = F.lit(None).cast("string")
    props = (
        F.when(i == 0, F.create_map(m("fact"), fact)).when(i == 1, F.create_map(m("fact"), fact, m("name"), m("x"))).when(i == 2, F.create_map(m("fact"), fact, m("fact_embedding"), none))
        .otherwise(F.create_map(m("fact"), fact, m("created_at"), none, m("episodes"), m('["a","b"]')))
    )
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("src"), (F.col("event_id") * 7 % 150).cast("string").alias("dst"), kind.alias("type"), fact.alias("fact"), props.alias("props"),
    )


@query("v02_missing_reverse", f"""WITH {_REL}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, min(id) AS subject, replace(lower(min(type)), ' ', '_') AS detail FROM rel WHERE type <> 'RELATES_TO' GROUP BY 1, 2)
 SELECT subject, detail FROM p WHERE n = 1 AND detail IN ('allied_with', 'married_to', 'sibling_of', 'friend_of', 'enemy_of', 'opposed_to')""")
def v02(spark, d):
    return V.missing_reverse(_relations(spark, d), V.SYMMETRIC).select("subject", "detail")


@query("v03_exclusive_types", f"WITH {_REL} SELECT src || '>' || dst AS subject, 'allied_with|opposed_to' AS detail FROM rel GROUP BY src, dst HAVING count(*) FILTER (WHERE {_T} = 'allied_with') > 0 AND count(*) FILTER (WHERE {_T} = 'opposed_to') > 0")
def v03(spark, d):
    return V.exclusive_types(_relations(spark, d), V.EXCLUSIVE).select("subject", "detail")


@query("v04_missing_inverse", f"""WITH {_REL}, t AS (SELECT id, src, dst, {_T} AS t FROM rel), n AS (SELECT *, CASE t WHEN 'parent_of' THEN 'child_of' WHEN 'child_of' THEN 'parent_of' END AS inverse FROM t)
 SELECT id AS subject, inverse AS detail FROM n WHERE inverse IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t x WHERE x.src = n.dst AND x.dst = n.src AND x.t = n.inverse)""")
def v04(spark, d):
    return V.missing_inverse(_relations(spark, d), V.INVERSES).select("subject", "detail")


@query("v01_semantic_type", """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN 'n' || user_id WHEN value > 60 THEN 'allied_with' WHEN value > 30 THEN 'serves_under' END AS kind FROM events""")
def v01(spark, d):
    i, e = F.col("event_id") % 4, F.col("event_type")
    fact = F.when(F.col("value") > 60, "An Alliance of old").when(F.col("value") > 30, "he follows her").otherwise("nothing")
    props = F.when(i == 0, F.create_map(F.lit("kind"), e, F.lit("name"), F.lit("x"))).when(i == 1, F.create_map(F.lit("name"), F.concat(F.lit("n"), F.col("user_id").cast("string")))).otherwise(F.create_map(F.lit("fact"), fact))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), V.semantic_type(props).alias("kind"))


@query("v05_untyped", f"WITH {_REL} SELECT id AS subject, type AS detail FROM rel WHERE {_T} = 'relates_to' AND coalesce(fact, '') = ''")
def v05(spark, d):
    return V.untyped(_relations(spark, d), "relates_to").select("subject", "detail")


@query("v06_orphans", NE + "SELECT id AS subject, name AS detail FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE type <> 'LivesIn' UNION SELECT dst FROM edges WHERE type <> 'LivesIn')")
def v06(spark, d):
    return V.orphans(I.nodes(spark, d), I.edges(spark, d, once=False).filter("type <> 'LivesIn'")).select("subject", "detail")


@query("v07_duplicates", f"WITH {_REL} SELECT src || '>' || lower(type) || '>' || dst AS subject, count(*)::VARCHAR AS detail FROM rel GROUP BY src, dst, lower(type) HAVING count(*) > 1")
def v07(spark, d):
    return V.duplicate_edges(_relations(spark, d)).select("subject", "detail")


@query("v08_judged", "SELECT event_id::VARCHAR AS subject, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity, CASE WHEN value > 70 THEN 1 WHEN value > 30 THEN 2 ELSE 3 END AS priority FROM events")
def v08(spark, d):
    verdict = F.when(F.col("event_type") == "error", "inappropriate").when(F.col("event_type") == "view", "unclear").otherwise("fine")
    benefit = F.when(F.col("value") > 70, "high").when(F.col("value") > 30, "medium").otherwise("low")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), verdict.alias("verdict"), benefit.alias("benefit"))
    return V.judged(rows).select("subject", "severity", "priority")


@query("v09_report", f"""WITH {_REL}, f AS (SELECT 'untyped' AS rule, 'warning' AS severity, 0.8 AS c, 2 AS p FROM rel WHERE {_T} = 'relates_to' AND fact = ''
 UNION ALL SELECT 'duplicate', 'warning', 0.9, 2 FROM rel GROUP BY src, dst, lower(type) HAVING count(*) > 1) SELECT severity, rule, count(*) AS n, round(avg(c), 3) AS confidence, min(p) AS priority FROM f GROUP BY 1, 2""")
def v09(spark, d):
    r = _relations(spark, d)
    return V.report(V.untyped(r, "relates_to").unionByName(V.duplicate_edges(r)))


@query("v10_content_check", """WITH p AS (SELECT doc_id AS id, unnest(list_distinct(PHRASES(text))) AS name FROM documents),
 k AS (SELECT DISTINCT list_extract(PHRASES(text), 1) AS name FROM documents WHERE lang = 'en'),
 c AS (SELECT id, count(k.name) AS known, count(*) - count(k.name) AS unknown FROM p LEFT JOIN k USING (name) GROUP BY id)
 SELECT doc_id AS id, coalesce(known, 0) AS known, coalesce(unknown, 0) AS unknown, round(greatest(0.0, least(1.0, 0.8 - 0.1 * coalesce(unknown, 0))), 6) AS confidence FROM documents LEFT JOIN c ON c.id = doc_id""")
def v10(spark, d):
    docs = table(spark, d, "documents")
    names = docs.filter("lang = 'en'").select(F.try_element_at(X.capitalised_phrases("text"), F.lit(1)).alias("name"))
    out = V.content_check(docs.select(F.col("doc_id").alias("id"), "text"), names, "text")
    return out.select("id", "known", "unknown", F.round("confidence", 6).alias("confidence"))


_SNAKE = r"trim(upper(regexp_replace(regexp_replace(regexp_replace(type, '[\s\-.]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), '_+', '_', 'g')), '_')"
_DEL = f"del AS (SELECT id, kept_id FROM (SELECT id, row_number() OVER w AS n, first_value(id) OVER w AS kept_id FROM rel WINDOW w AS (PARTITION BY src, dst, lower(trim(type)) ORDER BY score DESC, id)) WHERE n > 1)"
_REN = f"ren AS (SELECT id, {_SNAKE} AS new_type FROM rel WHERE {_SNAKE} NOT IN (type, ''))"


@query("x03_duplicate_corrections", f"WITH {_REL}, {_DEL} SELECT id, kept_id FROM del")
def x03(spark, d):
    return V.duplicate_corrections(_relations(spark, d)).select("id", "kept_id")


@query("x05_correction_plan", f"WITH {_REL}, {_DEL}, {_REN} SELECT 'delete' AS action, id, NULL AS new_type, 1 AS step FROM del UNION ALL SELECT 'rename', id, new_type, 2 FROM ren")
def x05(spark, d):
    return V.correction_plan(_relations(spark, d)).select("action", "id", "new_type", "step")


@query("x06_apply", f"WITH {_REL}, {_DEL}, {_REN} SELECT rel.id, coalesce(new_type, type) AS type FROM rel LEFT JOIN ren USING (id) WHERE rel.id NOT IN (SELECT id FROM del)")
def x06(spark, d):
    r = _relations(spark, d)
    return V.apply_corrections(r, V.correction_plan(r)).select("id", "type")


@query("x07_rollback", f"WITH {_REL} SELECT id, src, dst, type, fact FROM rel")
def x07(spark, d):
    r = _relations(spark, d)
    plan = V.correction_plan(r)
    return V.roll_back(V.apply_corrections(r, plan), plan)


_REN_ALL = f"ren AS (SELECT id, {_SNAKE} AS new_type FROM rel WHERE {_SNAKE} <> type)"  # a rename to an empty type counts too


@query("x08_batch_statistics", f"WITH {_REL}, {_DEL}, {_REN_ALL} SELECT 'batch' AS batch, (SELECT count(*) FROM del) + (SELECT count(*) FROM ren) AS total, (SELECT count(*) FROM del) AS deletes, (SELECT count(*) FROM ren) AS renames, round(((SELECT count(*) FROM del) * 0.95 + (SELECT count(*) FROM ren) * 0.9) / ((SELECT count(*) FROM del) + (SELECT count(*) FROM ren)), 3) AS confidence")
def x08(spark, d):
    return V.rollback_statistics(V.correction_plan(_relations(spark, d)))


@query("v05_rich_mentions", "SELECT event_id::VARCHAR AS subject, CASE WHEN event_id % 4 = 0 THEN 'loves' WHEN value > 60 THEN 'allied_with' END AS detail FROM events WHERE event_type = 'view' AND (event_id % 4 = 0 OR value > 60)")
def v05b(spark, d):
    props = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("nature"), F.lit("loves"))).when(F.col("value") > 60, F.create_map(F.lit("fact"), F.lit("an ALLIANCE"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", "MENTIONS").otherwise("other").alias("type"), props.alias("props"))
    return V.rich_mentions(rows).select("subject", "detail")


@query("v09_markdown_report", f"""WITH {_REL}, f AS (SELECT 'untyped' AS rule FROM rel WHERE {_T} = 'relates_to' AND fact = '' UNION ALL SELECT 'duplicate' FROM rel GROUP BY src, dst, lower(type) HAVING count(*) > 1)
 SELECT 1 AS pos, '' AS rule, '# Check: ' || count(*) || ' findings' AS line FROM f UNION ALL SELECT 3000, '', '## Warning (' || count(*) || ')' FROM f HAVING count(*) > 0 UNION ALL SELECT 3001, rule, '- ' || rule || ': ' || count(*) FROM f GROUP BY rule""")
def v09b(spark, d):
    r = _relations(spark, d)
    return V.markdown_report(V.untyped(r, "relates_to").unionByName(V.duplicate_edges(r)), "Check")


_CAPPED = f"""WITH {_REL}, g AS (SELECT src, dst, lower(trim(type)) AS t, min(id) AS least, count(*) - 1 AS gone FROM rel WHERE trim(type) <> '' GROUP BY ALL HAVING count(*) > 1),
 b AS (SELECT *, coalesce(sum(gone) OVER (ORDER BY least ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
 r AS (SELECT rel.id, row_number() OVER (PARTITION BY rel.src, rel.dst, lower(trim(type)) ORDER BY score DESC, rel.id) AS n FROM rel JOIN b ON b.src = rel.src AND b.dst = rel.dst AND b.t = lower(trim(type)) WHERE before < MOST),
 del AS (SELECT id FROM r WHERE n > 1), {_REN}, o AS (SELECT id, new_type, row_number() OVER (ORDER BY id) AS n FROM ren)
 SELECT 'delete' AS action, id, NULL AS new_type FROM del UNION ALL SELECT 'rename', id, new_type FROM o WHERE n + (SELECT count(*) FROM del) <= MOST"""


@query("x05_capped_plan", _CAPPED.replace("MOST", "100"))
def x05b(spark, d):
    return V.correction_plan(_relations(spark, d), most=100).select("action", "id", "new_type")


@query("x05_roomy_plan", _CAPPED.replace("MOST", "100000"))
def x05c(spark, d):
    return V.correction_plan(_relations(spark, d), most=100_000).select("action", "id", "new_type")


def _applied(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        i.cast("string").alias("id"), F.when(i % 2 == 0, "delete").otherwise("rename").alias("action"), F.when(i % 9 != 0, F.lit("{}")).alias("backup"), F.col("user_id").alias("batch"), F.col("ts").alias("applied_at"),
        F.when(i % 4 == 1, F.col("ts")).alias("rolled_back_at"), F.when(i % 5 == 0, "failed").otherwise("applied").alias("status"),
    )


@query("x07_rollback_report", "SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 2 = 0 THEN 'delete' ELSE 'rename' END AS action, CASE WHEN event_id % 9 = 0 THEN 'no_backup' WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'already_present' ELSE 'restored' END WHEN event_id % 3 = 0 THEN 'renamed_back' ELSE 'edge_gone' END AS outcome FROM events")
def x07b(spark, d):
    edges = table(spark, d, "events").filter("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id"))
    return V.rollback_report(edges, _applied(spark, d)).select("id", "action", "outcome")


@query("x08_rollback_history", "SELECT user_id AS batch, count(*) AS total, count(*) FILTER (WHERE event_id % 4 = 1) AS rolled_back, count(*) FILTER (WHERE event_id % 5 = 0) AS failed, round(100.0 * count(*) FILTER (WHERE event_id % 4 = 1) / count(*), 3) AS percent FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1")
def x08b(spark, d):
    rows = _applied(spark, d)
    last = rows.agg(F.max("applied_at").alias("now"))
    return V.rollback_history(rows.crossJoin(F.broadcast(last)), F.col("now"), 10).select("batch", "total", "rolled_back", "failed", "percent")  # one row beside


@query("d03_can_roll_back", "SELECT event_id::VARCHAR AS id, event_id % 9 <> 0 AND event_id % 4 <> 1 AND event_id % 5 <> 0 AS can FROM events")
def d03(spark, d):
    return _applied(spark, d).select("id", V.can_roll_back(F.col("status"), F.col("rolled_back_at"), F.col("backup")).alias("can"))
