"""Further survey rows: graph writes, focus and condensation, sinks, history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import conversation as N
from tessella.operators import graph as G
from tessella.plans import inputs as I
from tessella.plans.inputs import table, with_
from tessella.plans.registry import query
from tessella.sources import corpus as C


@query("a07_zero_sum", "SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'error' AND value > 99), 0) AS total FROM events GROUP BY user_id")
def a07(spark, d):
    wanted = (F.col("event_type") == "error") & (F.col("value") > 99)
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.sum(F.when(wanted, F.col("value"))), F.lit(0.0)).alias("total"))


@query("o08_string_keys", "SELECT event_id FROM events ORDER BY event_type, user_id::VARCHAR, event_id::VARCHAR LIMIT 200")
def o08(spark, d):
    return table(spark, d, "events").orderBy("event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).select("event_id").limit(200)


@query("g02_find_node", with_("nodes") + "SELECT * FROM nodes WHERE label = 'nation' AND name = 'NATION_3' ORDER BY id LIMIT 1")
def g02(spark, d):
    return G.find_node(I.nodes(spark, d), "nation", name="NATION_3", id=None)


@query("g14_create", with_("nodes") + "SELECT id, name FROM nodes UNION ALL SELECT 'x1', 'New'")
def g14(spark, d):
    new = spark.createDataFrame([("x1", "region", "New"), ("x1", "region", "New"), ("r1", "region", "Other")], "id string, label string, name string")
    return G.create(I.nodes(spark, d), new).select("id", "name")


@query("g16_delete_and_restore", with_("edges") + "SELECT id, fact FROM edges WHERE type <> 'LivesIn' OR dst = 'n3'")
def g16(spark, d):
    e = I.edges(spark, d)
    kept, backup = G.delete_edges(e, e.filter("type = 'LivesIn'"))
    return G.restore_edges(kept, backup.filter("dst = 'n3'")).select("id", "fact")


@query("g21_seed_edges", with_("edges") + "SELECT id, CASE WHEN id = 'n18>part-of>r3' THEN 'curated' ELSE fact END AS fact FROM edges UNION ALL SELECT 'n18>TRADES_WITH>n12', 'silk'")
def g21(spark, d):
    rows = [("NATION_18", "TRADES_WITH", "NATION_12", "silk"), ("NATION_18", "part-of", "EUROPE", "curated"), ("NATION_18", "TRADES_WITH", "ATLANTIS", "none")]
    return G.seed_edges(I.edges(spark, d), I.nodes(spark, d), spark.createDataFrame(rows, "source string, type string, target string, fact string")).select("id", "fact")


@query("u05_match_any", """WITH n AS (SELECT event_id AS e, CASE WHEN event_id % 3 = 0 THEN 's' || user_id ELSE 'u' || event_id END AS uuid, CASE WHEN event_id % 5 = 0 THEN 's' || (user_id + 1) END AS stable_id, CASE WHEN event_id % 7 = 0 THEN 'episode_s' || user_id ELSE 'other' END AS description FROM events),
 d AS (SELECT DISTINCT uuid, stable_id, description FROM n), w AS (SELECT DISTINCT 's' || user_id AS stable_id FROM events),
 h AS (SELECT w.stable_id AS w, d.uuid AS u, d.stable_id AS s, d.description AS t, 1 AS by_u, 0 AS by_s, 0 AS by_t FROM w JOIN d ON d.uuid = w.stable_id UNION ALL SELECT w.stable_id, d.uuid, d.stable_id, d.description, 0, 1, 0 FROM w JOIN d ON d.stable_id = w.stable_id UNION ALL SELECT w.stable_id, d.uuid, d.stable_id, d.description, 0, 0, 1 FROM w JOIN d ON d.description = 'episode_' || w.stable_id),
 g AS (SELECT w, u, s, t, max(by_u) AS by_u, max(by_s) AS by_s, max(by_t) AS by_t FROM h GROUP BY w, u, s, t)
 SELECT stable_id, count(w) AS candidates, coalesce(sum(by_u), 0) AS by_uuid, coalesce(sum(by_s), 0) AS by_stable_id, coalesce(sum(by_t), 0) AS by_description FROM w LEFT JOIN g ON g.w = w.stable_id GROUP BY stable_id""")
def u05(spark, d):
    i, u, says = F.col("event_id"), F.col("user_id"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = table(spark, d, "events")
    nodes = e.select(F.when(i % 3 == 0, says("s", u)).otherwise(says("u", i)).alias("uuid"), F.when(i % 5 == 0, says("s", u + 1)).alias("stable_id"), F.when(i % 7 == 0, says("episode_s", u)).otherwise("other").alias("description"))
    return G.match_any(nodes, e.select(says("s", u).alias("stable_id")).distinct())


_FOCUS = """k AS (SELECT user_id AS node, row_number() OVER (ORDER BY user_id % 13, user_id) AS rank FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0)),
 f AS (SELECT rank, row_number() OVER (PARTITION BY node ORDER BY value DESC, event_id) AS n, event_id AS edge, user_id AS src, event_id % 40 AS dst FROM events JOIN k ON k.node = user_id WHERE rank <= 3 QUALIFY n <= 5)"""


def _focus(spark, d):
    e = table(spark, d, "events")
    hits = e.select(F.col("user_id").alias("id"), (F.col("user_id") % 13).alias("rank")).distinct()
    episodes = e.filter("user_id % 3 <> 0").select(F.col("user_id").alias("stable_id"), F.col("user_id").alias("node")).distinct()
    mentions = e.select(F.col("user_id").alias("node"), F.col("event_id").alias("edge"), F.col("user_id").alias("src"), (F.col("event_id") % 40).alias("dst"), F.col("value").alias("score"))
    return G.graph_focus(hits, episodes, mentions, e.select(F.col("user_id").alias("id")).distinct())


@query("r10_focus_edges", f"WITH {_FOCUS} SELECT edge, n, src, dst FROM f")
def r10(spark, d):
    return _focus(spark, d)[0].select("edge", "n", "src", "dst")


@query("r10_focus_entities", f"WITH {_FOCUS} SELECT DISTINCT user_id AS id FROM events WHERE user_id IN (SELECT src FROM f UNION SELECT dst FROM f)")
def r10b(spark, d):
    return _focus(spark, d)[1]


@query("r16_condensed", """SELECT 1 AS block, pos, trim(text) AS line FROM (SELECT doc_id AS pos, text FROM documents ORDER BY doc_id LIMIT 20) WHERE trim(text) <> '' UNION ALL
 SELECT 2, pos, 'GRAPH ENTITY ' || n_name || ' (' || coalesce(kind, 'Entity') || '): ' || details FROM (SELECT n_nationkey AS pos, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation' END AS kind, CASE WHEN n_nationkey % 3 <> 0 THEN 'in ' || n_regionkey ELSE '' END AS details FROM nation ORDER BY n_nationkey LIMIT 10) WHERE details <> '' UNION ALL
 SELECT 3, pos, 'GRAPH RELATIONSHIP ' || 'part-of' || ' (' || n_name || ' -> ' || coalesce(target, '?') || '): ' || insight FROM (SELECT n_nationkey AS pos, n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey::VARCHAR END AS target, CASE WHEN n_nationkey % 5 <> 0 THEN 'fact ' || n_nationkey ELSE '' END AS insight FROM nation ORDER BY n_nationkey LIMIT 15) WHERE insight <> ''""")
def r16(spark, d):
    n, k, region = table(spark, d, "nation"), F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    entities = n.select(k.alias("pos"), F.col("n_name").alias("name"), F.when(k % 2 == 0, "Nation").alias("type"), F.when(k % 3 != 0, F.concat(F.lit("in "), region)).otherwise("").alias("details"))
    relations = n.select(k.alias("pos"), F.lit("part-of").alias("type"), F.col("n_name").alias("source"), F.when(k % 4 != 0, region).alias("target"), F.when(k % 5 != 0, F.concat(F.lit("fact "), k.cast("string"))).otherwise("").alias("insight"))
    return N.condensed(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text"), entities, relations)


@query("n12_compact", "SELECT event_id, event_id % 3 = 0 AS compact FROM events")
def n12(spark, d):
    asked = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Say it in ONE \n sentence, "), "event_type")).otherwise(F.concat(F.lit("Tell me of the sentence "), "event_type"))
    return table(spark, d, "events").select("event_id", N.wants_compact_answer(asked).alias("compact"))


@query("n12_digest", r"""SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'supporting_facts' ELSE 'direct_answers' END AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS block, CASE WHEN length(x) <= 200 THEN x ELSE regexp_replace(substr(x, 1, 198), ' ?[^ ]*$', '') || '...' END AS summary
 FROM (SELECT *, trim(regexp_replace(CASE WHEN turn % 2 = 0 THEN ' graph ' || text ELSE text END, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS x FROM conversations)""".replace("\\\\", "\\"))
def n12b(spark, d):
    rows = table(spark, d, "conversations").withColumn("order", F.struct("turn", "role", "text"))
    return N.digest(rows.withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" graph "), "text")).otherwise(F.col("text"))), "conv_id", "order", "text")


@query("t07_bounded_history", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def t07(spark, d):
    return N.bounded_history(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("s10_embed_missing", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [doc_id::DOUBLE] ELSE [length(text)::DOUBLE] END AS v FROM documents")
def s10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id").cast("double"))).alias("v"))
    made = C.embed_missing(rows, "doc_id", "text", "v", lambda texts: [[float(len(t))] for t in texts])
    return C.with_embeddings(rows, "doc_id", "v", made).select("doc_id", "v")


@query("s12_correction_rows", with_("edges") + "SELECT id, 'delete' AS action, type AS backup_type, 'applied' AS status FROM edges")
def s12(spark, d):
    e = I.edges(spark, d)
    plan = e.select("id", F.lit("delete").alias("action"), F.lit(0.95).alias("confidence"))
    out = C.correction_rows(e, plan, F.lit("2024-06-01").cast("timestamp"))
    return out.select("id", "action", F.get_json_object("backup", "$.type").alias("backup_type"), "status")


@query("s13_append_messages", "SELECT conv_id, turn, text FROM conversations UNION ALL SELECT c.conv_id, max(turn) + k, 'new ' || k FROM conversations c, (SELECT unnest([1, 2]) AS k) GROUP BY c.conv_id, k UNION ALL SELECT -1, k, 'new ' || k FROM (SELECT unnest([1, 2]) AS k)")
def s13(spark, d):
    messages = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    kind = dict(messages.dtypes)["conv_id"]
    ids = messages.select("conv_id").union(spark.range(1).select(F.lit(-1).cast(kind))).distinct()
    new = ids.select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("at")).select("conv_id", "at", F.lit("user").alias("role"), F.concat(F.lit("new "), F.col("at").cast("string")).alias("text"))
    return C.append_messages(messages, new).select("conv_id", "turn", "text")


@query("q12_reconciled_corpus", """WITH j AS (SELECT doc_id % 97 AS case_id, CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END AS selector, CASE WHEN doc_id % 13 = 0 THEN 'old' ELSE sha256(text) END AS fp FROM documents),
 m AS (SELECT j.*, d.text, CASE WHEN d.doc_id IS NULL THEN 'judgment_episode_missing' WHEN fp <> sha256(d.text) THEN 'judgment_source_fingerprint_mismatch' END AS code FROM j LEFT JOIN documents d ON d.doc_id = selector),
 n AS (SELECT DISTINCT doc_id % 97 AS case_id, 'e' || (doc_id % 3) AS entity, CASE doc_id % 3 WHEN 0 THEN 'T h-E' WHEN 1 THEN 'qqqq' ELSE 'Und' END AS alias FROM documents),
 g AS (SELECT DISTINCT n.case_id, entity FROM n JOIN m ON m.case_id = n.case_id AND m.code IS NULL AND contains(regexp_replace(lower(m.text), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(lower(alias), '[^\\p{L}\\p{N}]', '', 'g'))),
 b AS (SELECT case_id, code, NULL::VARCHAR AS entity FROM m WHERE code IS NOT NULL UNION ALL SELECT case_id, 'expected_entity_not_grounded', entity FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.case_id = n.case_id AND g.entity = n.entity))
 SELECT case_id, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes, coalesce(array_to_string(list_sort(list_distinct(list(entity) FILTER (WHERE entity IS NOT NULL))), ','), '') AS ungrounded FROM b GROUP BY case_id""")
def q12(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").withColumns({"fp": F.sha2("text", 256), "case_id": i % 97})
    judged = docs.select("case_id", F.when(i % 11 == 0, -i - 1).otherwise(i).alias("selector"), F.when(i % 13 == 0, "old").otherwise(F.col("fp")).alias("fingerprint"))
    expected = docs.select("case_id", F.concat(F.lit("e"), (i % 3).cast("string")).alias("entity"), F.array(F.when(i % 3 == 0, "T h-E").when(i % 3 == 1, "qqqq").otherwise("Und")).alias("aliases")).distinct()
    out = C.reconcile_corpus(judged, expected, docs.select(i.alias("selector"), F.col("fp").alias("fingerprint"), "text"), X.alphanumeric)
    return out.select("case_id", F.array_join("codes", ",").alias("codes"), F.coalesce(F.array_join("ungrounded", ","), F.lit("")).alias("ungrounded"))


_MERGED = """WITH RECURSIVE m AS (MEMBERS), o AS (SELECT grp, ids, row_number() OVER (ORDER BY grp) AS n FROM m),
 s AS (SELECT 1::BIGINT AS pos, 0::BIGINT AS head, []::BIGINT[] AS taken, []::BIGINT[] AS done, []::BIGINT[] AS own, NULL::BIGINT AS joined, 0::BIGINT AS into_
  UNION ALL
  SELECT CASE WHEN pos >= (SELECT max(n) FROM o) THEN new_head + 1 ELSE pos + 1 END, CASE WHEN pos >= (SELECT max(n) FROM o) THEN 0 ELSE new_head END, CASE WHEN hit THEN list_distinct(list_concat(taken, ids)) ELSE taken END, CASE WHEN hit THEN list_append(done, pos) ELSE done END, own, CASE WHEN hit THEN pos END, new_head
  FROM (SELECT s.pos, CASE WHEN head = 0 THEN pos ELSE head END AS new_head, CASE WHEN head = 0 THEN []::BIGINT[] ELSE taken END AS taken, done, own, o.ids,
    NOT list_contains(done, pos) AND (head = 0 OR len(list_intersect(taken, o.ids)) / least(len(taken), len(o.ids)) >= 0.3) AS hit, head FROM s JOIN o ON o.n = s.pos)
  WHERE new_head <= (SELECT max(n) FROM o))
 SELECT a.grp, b.grp AS merged FROM s JOIN o a ON a.n = joined JOIN o b ON b.n = into_"""


@query("g12_merged_subgraphs", _MERGED.replace("MEMBERS", "SELECT event_type AS grp, list(DISTINCT user_id) AS ids FROM events GROUP BY 1"))
def g12(spark, d):
    members = table(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("user_id").alias("id"))
    return G.merge_overlapping(members, ["click", "error", "purchase", "signup", "view"])


@query("g12_merged_quarters", _MERGED.replace("MEMBERS", "SELECT year(o_orderdate) || 'q' || quarter(o_orderdate) AS grp, list(DISTINCT o_custkey) AS ids FROM orders GROUP BY 1"))
def g12b(spark, d):
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string"))
    members = table(spark, d, "orders").select(quarter.alias("grp"), F.col("o_custkey").alias("id"))
    return G.merge_overlapping(members, sorted(r["grp"] for r in members.select("grp").distinct().collect()))  # one for each quarter


@query("g12_merged_edges", "SELECT o_orderstatus AS grp, o_custkey::VARCHAR AS src, o_orderpriority AS dst, 'ORDERS' AS type FROM orders WHERE o_orderstatus = 'O' UNION SELECT 'F', o_custkey::VARCHAR, o_orderpriority, 'ORDERS' FROM orders WHERE o_orderstatus IN ('F', 'P')")
def g12c(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst"), F.lit("ORDERS").alias("type"))
    merged = spark.createDataFrame([("F", "F"), ("P", "F"), ("O", "O")], "grp string, merged string")
    return G.merged_edges(edges, merged)


@query("g09_component_sizes", "SELECT count(*) AS members, count(DISTINCT lang) AS languages, min(doc_id) AS component FROM documents GROUP BY sha256(text)")
def g09c(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    w = Window.partitionBy("sha").orderBy("doc_id")
    chain = docs.withColumn("before", F.lag("doc_id").over(w)).filter("before is not null").select(F.col("doc_id").alias("src"), F.col("before").alias("dst"))
    comp = G.connected_components(docs.select(F.col("doc_id").alias("id")), chain)
    return comp.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("lang").alias("languages"))
