"""Relational queries: predicates, joins, aggregates, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.plans import inputs as I
from tessella.plans.inputs import table, with_
from tessella.plans.registry import query

ONE = F.lit


# -- predicates and projections -------------------------------------------
@query("p01_canonical_filter", with_("source_documents") + "SELECT id, title, source_file FROM source_documents WHERE canonical IS TRUE AND source_file LIKE 'src1%'")
def p01(spark, d):
    return I.source_documents(spark, d).filter(F.col("canonical") & F.col("source_file").startswith("src1")).select("id", "title", "source_file")


@query("p02_optional_filters", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id IN (1, 2, 3, 5, 8)")
def p02(spark, d):
    return R.where_given(table(spark, d, "events"), event_type="click", user_id=[1, 2, 3, 5, 8], value=None).select("event_id", "user_id", "event_type")


@query("p05_distinct_from", "SELECT o_orderkey FROM orders o JOIN customer c ON o_custkey = c_custkey WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM CASE WHEN c_acctbal > 0 THEN 'O' END")
def p05(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    left = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return o.filter(~left.eqNullSafe(F.when(F.col("c_acctbal") > 0, "O"))).select("o_orderkey")


@query("p07_minimum_length", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 50")
def p07(spark, d):
    return table(spark, d, "documents").filter(F.length("text") > 50).select("doc_id", F.length("text").cast("long").alias("n"))


@query("p08_contains_any_case", with_("nodes") + "SELECT id, label, name FROM nodes WHERE contains(lower(name), lower('Er#00')) OR contains(lower(label), 'egi')")
def p08(spark, d):
    hit = F.lower("name").contains("er#00") | F.lower("label").contains("egi")
    return I.nodes(spark, d).filter(hit).select("id", "label", "name")


@query("p14_eligible_at", "SELECT event_id FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND ts <= TIMESTAMP '2024-01-15 00:00:00')")
def p14(spark, d):
    ready = (F.col("event_type") == "signup") | ((F.col("event_type") == "error") & (F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
    return table(spark, d, "events").filter(ready).select("event_id")


@query("p15_recent", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01 00:00:00' - INTERVAL 30 DAY")
def p15(spark, d):
    return table(spark, d, "orders").filter(F.expr("o_orderdate >= TIMESTAMP_NTZ '1998-07-01 00:00:00' - make_dt_interval(30)")).select("o_orderkey")


@query("p17_json_key", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def p17(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").filter(k.isNotNull()).select("event_id", k.alias("k"))


@query("p19_least_greatest_case", """SELECT p_partkey, least(p_size, 20) AS low, greatest(p_size, 20) AS high,
 CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS class FROM part""")
def p19(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.least(size, ONE(20)).alias("low"), F.greatest(size, ONE(20)).alias("high"),
        F.when(size > 40, "large").when(size > 20, "medium").otherwise("small").alias("class"),
    )


# -- joins -------------------------------------------------------------------
@query("j01_inner", "SELECT e.vec_id AS id, d.lang, length(d.text) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def j01(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return vec.join(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "lang", F.length("text").cast("long").alias("n"))


@query("j02_full_outer", """SELECT coalesce(v.id, t.id) AS id, coalesce(v.a, 0) AS a, coalesce(t.b, 0) AS b FROM
 (SELECT user_id AS id, count(*) AS a FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY user_id) v FULL OUTER JOIN
 (SELECT user_id AS id, count(*) AS b FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY user_id) t ON v.id = t.id""")
def j02(spark, d):
    e = table(spark, d, "events")
    side = lambda kind, keep, name: e.filter((F.col("event_type") == kind) & keep).groupBy(F.col("user_id").alias("id")).agg(F.count(ONE(1)).alias(name))
    v, t = side("view", F.col("user_id") % 3 != 0, "a"), side("click", F.col("user_id") % 2 == 0, "b")
    return v.join(t, "id", "full_outer").select("id", F.coalesce("a", ONE(0)).alias("a"), F.coalesce("b", ONE(0)).alias("b"))


@query("j03_left_chain", """SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM customer
 LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def j03(spark, d):
    # Lines are counted per order before they meet the customers: one row an order is shuffled, not one a line.
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(ONE(1)).alias("n"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey", "left")
    return table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("orders"), F.coalesce(F.sum("n"), ONE(0)).alias("lines")
    )


@query("j04_composite_left", """SELECT o.l_partkey, o.l_suppkey, o.n, r.n AS returned FROM
 (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) o LEFT JOIN
 (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) r ON o.l_partkey = r.l_partkey AND o.l_suppkey = r.l_suppkey""")
def j04(spark, d):
    # Both sides come from one scan with a conditional count, so no join is left.
    returned = F.count(F.when(F.col("l_returnflag") == "R", 1))
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(ONE(1)).alias("n"), F.nullif(returned, ONE(0)).alias("returned"))


@query("j05_three_way", """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def j05(spark, d):
    per = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(ONE(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return per.join(nation, "c_nationkey").groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("j07_anti_or_stale", """SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) o
 ON o.o_custkey = c.c_custkey WHERE o.last IS NULL OR o.last < TIMESTAMP '1997-01-01 00:00:00'""")
def j07(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return table(spark, d, "customer").join(last, "c_custkey", "left").filter(F.expr("last IS NULL OR last < TIMESTAMP_NTZ '1997-01-01 00:00:00'")).select("c_custkey")


@query("j08_semi_both_ends", with_("edges") + """SELECT id FROM edges WHERE src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000)
 AND dst IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 40)""")
def j08(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.concat(ONE("s"), F.col("s_suppkey").cast("string")).alias("src"))
    p = table(spark, d, "part").filter("p_size > 40").select(F.concat(ONE("p"), F.col("p_partkey").cast("string")).alias("dst"))
    return I.edges(spark, d).join(s, "src", "left_semi").join(p, "dst", "left_semi").select("id")


@query("j09_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j09(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j13_scalar_counts", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS owing, (SELECT max(p_size) FROM part) AS largest")
def j13(spark, d):
    orders = table(spark, d, "orders").agg(F.count(ONE(1)).alias("orders"))
    owing = table(spark, d, "customer").filter("c_acctbal < 0").agg(F.count(ONE(1)).alias("owing"))
    largest = table(spark, d, "part").agg(F.max("p_size").alias("largest"))
    return orders.crossJoin(owing).crossJoin(largest)  # one row each


@query("j14_neighbour_band", with_("embedded") + """, hits AS (SELECT document_id, idx FROM embedded WHERE id % 37 = 0),
 near AS (SELECT DISTINCT document_id, idx + o AS idx FROM hits, (VALUES (-2), (-1), (0), (1), (2)) t(o) WHERE idx + o >= 0),
 few AS (SELECT document_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY idx) AS n FROM near) WHERE n <= 10)
 SELECT e.id, e.document_id, e.idx FROM embedded e JOIN few USING (document_id, idx) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.document_id = e.document_id AND h.idx = e.idx)""")
def j14(spark, d):
    rows = I.embedded(spark, d).select("id", "document_id", "idx")
    return R.neighbours(rows.filter("id % 37 = 0").select("document_id", "idx"), rows, "document_id", "idx").select("id", "document_id", "idx")


@query("j15_type_pairs", "SELECT a.t AS source_type, b.t AS target_type FROM (SELECT DISTINCT event_type AS t FROM events) a, (SELECT DISTINCT event_type AS t FROM events) b")
def j15(spark, d):
    kinds = table(spark, d, "events").select(F.col("event_type").alias("t")).distinct()
    # The closed set of types against itself.
    return kinds.select(F.col("t").alias("source_type")).crossJoin(kinds.select(F.col("t").alias("target_type")))


@query("j16_name_multiplicity", """SELECT w.name, coalesce(n.n, 0) AS n, CASE WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM
 (SELECT DISTINCT p_brand AS name FROM part UNION SELECT 'nothing') w LEFT JOIN (SELECT p_brand AS name, count(*) AS n FROM part WHERE p_size < 3 GROUP BY p_brand) n USING (name)""")
def j16(spark, d):
    part = table(spark, d, "part")
    wanted = part.select(F.col("p_brand").alias("name")).union(spark.createDataFrame([("nothing",)], "name string")).distinct()
    n = part.filter("p_size < 3").groupBy(F.col("p_brand").alias("name")).agg(F.count(ONE(1)).alias("n"))
    return wanted.join(n, "name", "left").select(
        "name", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"), F.coalesce("n", ONE(0)).alias("n")
    )


@query("j17_merge", """SELECT coalesce(a.k, b.k) AS id, coalesce(b.v, a.v) AS value, CASE WHEN a.v IS NULL THEN 'created' WHEN b.v IS NULL THEN 'unchanged' ELSE 'matched' END AS action
 FROM (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def j17(spark, d):
    c = table(spark, d, "customer")
    a = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("value"))
    b = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    return R.merge_graph(a, b, "id", "value")


# -- aggregates ----------------------------------------------------------------
@query("a01_global", "SELECT count(*) AS n, round(avg(value), 6) AS mean, max(ts) AS last FROM events")
def a01(spark, d):
    return table(spark, d, "events").agg(F.count(ONE(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"))


@query("a02_conditional_counts", """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(CASE WHEN value > 50 THEN 1 END) AS large,
 round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent FROM events GROUP BY user_id""")
def a02(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.when(F.col("value") > 50, 1)).alias("large"),
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("spent"),
    )


@query("a03_count_distinct", "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY lang")
def a03(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", F.xxhash64("text").alias("a"), F.crc32("text").alias("b"))
    return docs.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct("a", "b").alias("texts"))


@query("a04_top_categories", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def a04(spark, d):
    return R.top_counts(table(spark, d, "part"), "p_type")


@query("a05_composite_group", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
 round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def a05(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(ONE(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"),
    )


@query("a06_sum_null_when_unreported", """SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' AND value > 90 THEN value END), 4) AS total,
 count(CASE WHEN event_type = 'purchase' AND value > 90 THEN value END) AS reported, coalesce(round(sum(CASE WHEN event_type = 'purchase' AND value > 90 THEN value END), 4), 0) AS or_zero FROM events GROUP BY user_id""")
def a06(spark, d):
    x = F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), F.col("value"))
    total = F.round(F.sum(x), 4)
    return table(spark, d, "events").groupBy("user_id").agg(total.alias("total"), F.count(x).alias("reported"), F.coalesce(total, ONE(0.0)).alias("or_zero"))


@query("a08_p95", "SELECT user_id, round(quantile_cont(value, 0.95) FILTER (WHERE event_type = 'view'), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY user_id")
def a08(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.round(F.percentile(F.when(F.col("event_type") == "view", F.col("value")), 0.95), 6).alias("p95"), F.round(F.percentile("value", 0.5), 6).alias("median")
    )


@query("a09_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def a09(spark, d):
    # percentile_disc is the nearest rank and keeps counts of values, not arrays of rows.
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, d, "events").groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"))


@query("a11_distinct_values", "SELECT user_id, array_to_string(list_sort(coalesce(list(DISTINCT event_type) FILTER (WHERE value > 95), [])), ',') AS kinds FROM events GROUP BY user_id")
def a11(spark, d):
    kinds = F.sort_array(F.collect_set(F.when(F.col("value") > 95, F.col("event_type"))))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


@query("a13_document_statistics", """SELECT d.lang, count(DISTINCT d.doc_id) AS documents, count(DISTINCT l.quality) AS grades, round(avg(d.n_chars), 4) AS mean_chars
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.lang""")
def a13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(table(spark, d, "labels"), "doc_id", "left").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left")
    return joined.groupBy("lang").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("quality").alias("grades"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("a15_zero_filled_domain", """SELECT s.status, coalesce(n.n, 0) AS n FROM (VALUES ('signup'), ('error'), ('leased'), ('quarantined')) s(status)
 LEFT JOIN (SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1) n USING (status)""")
def a15(spark, d):
    domain = spark.createDataFrame([("signup",), ("error",), ("leased",), ("quarantined",)], "status string")
    return R.zero_filled(table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(ONE(1)).alias("n")), domain, "status", "n")


@query("a16_duplicates", "SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a16(spark, d):
    return R.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("sha")), ["sha"])


@query("a17_graph_counts", with_("nodes", "edges") + "SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def a17(spark, d):
    n = I.nodes(spark, d).groupBy(F.col("label").alias("name")).agg(F.count(ONE(1)).alias("n")).withColumn("kind", ONE("node"))
    e = I.edges(spark, d).groupBy(F.col("type").alias("name")).agg(F.count(ONE(1)).alias("n")).withColumn("kind", ONE("edge"))
    return n.unionByName(e)


@query("a18_coverage", """SELECT lang, count(*) AS n, count(l.quality) AS labelled, count(*) - count(l.quality) AS missing, round(100.0 * count(l.quality) / nullif(count(*), 0), 3) AS pct
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY lang""")
def a18(spark, d):
    q = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, d, "documents").select("doc_id", "lang").join(q, "doc_id", "left").groupBy("lang").agg(F.count(ONE(1)).alias("n"), F.count("quality").alias("labelled"))
    return rows.select("lang", "n", "labelled", (F.col("n") - F.col("labelled")).alias("missing"), R.percentage(F.col("labelled"), F.col("n")).alias("pct"))


@query("a20_snapshot_hash", """SELECT lang, sha256(string_agg(h, '|' ORDER BY block)) AS snapshot, sum(n)::BIGINT AS n FROM
 (SELECT lang, doc_id // 500 AS block, sha256(string_agg(doc_id || ':' || sha256(text), '|' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang""")
def a20(spark, d):
    """Ordered within blocks of ids, then over the blocks' hashes, so that no
    group holds all rows of a language."""
    part = F.concat(F.col("doc_id").cast("string"), ONE(":"), F.sha2("text", 256))
    hashed = lambda rows, order, p: F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct(order, p)))[p], "|"), 256)
    rows = table(spark, d, "documents").select("lang", "doc_id", F.floor(F.col("doc_id") / 500).alias("block"), part.alias("p"))
    blocks = rows.groupBy("lang", "block").agg(hashed(rows, "doc_id", "p").alias("h"), F.count(ONE(1)).alias("n"))
    return blocks.groupBy("lang").agg(hashed(blocks, "block", "h").alias("snapshot"), F.sum("n").alias("n"))


@query("a21_latency_tracker", """SELECT event_type, count(*) AS calls, min(value) AS least, max(value) AS most, CAST(floor(avg(value) * 1000) AS BIGINT) AS mean_ms,
 round(100.0 * count(*) FILTER (WHERE value < 50) / count(*), 2) AS success_pct FROM events GROUP BY event_type""")
def a21(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(ONE(1)).alias("calls"), F.min("value").alias("least"), F.max("value").alias("most"), F.floor(F.avg("value") * 1000).alias("mean_ms"),
        R.percentage(F.count_if(F.col("value") < 50), F.count(ONE(1)), 2).alias("success_pct"),
    )


@query("a23_distinct_nulls_last", "SELECT DISTINCT l.quality, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY 1 NULLS LAST, 2")
def a23(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").select("quality", "lang").distinct()
    return rows.orderBy(F.asc_nulls_last("quality"), "lang")


# -- windows, sorts, sets -----------------------------------------------------------
@query("w01_ranked", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 20")
def w01(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("event_type", "event_id", F.row_number().over(w).alias("rank")).filter("rank <= 20")


@query("w04_trend_of_last_three", """SELECT user_id, event_id, round(avg(diff) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS trend FROM
 (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff FROM events)""")
def w04(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("diff", F.col("value") - F.lag("value").over(w))
    return rows.select("user_id", "event_id", F.round(F.avg("diff").over(w.rowsBetween(-2, 0)), 6).alias("trend"))


@query("w05_last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def w05(spark, d):
    return R.last_rows(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("w07_first_occurrence", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1")
def w07(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    return docs.groupBy("key", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang")


@query("w09_greedy_budget", """WITH i AS (SELECT source, list(struct_pack(id := doc_id, used := len(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'))::BIGINT, kept := []::BIGINT[]) ORDER BY doc_id) AS rows FROM documents GROUP BY source),
 f AS (SELECT source, rows[1].id AS first, list_reduce(rows, lambda a, x: CASE WHEN a.used + x.used <= 3000 THEN struct_pack(id := x.id, used := a.used + x.used, kept := list_append(a.kept, x.id)) ELSE a END, struct_pack(id := 0::BIGINT, used := 0::BIGINT, kept := []::BIGINT[])) AS r FROM i)
 SELECT doc_id, source, len(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+')) AS tokens FROM documents JOIN f USING (source) WHERE list_contains(CASE WHEN len(r.kept) = 0 THEN [first] ELSE r.kept END, doc_id)""")
def w09(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.size(F.split("text", r"\s+")).alias("tokens"))
    return R.greedy_budget(docs, "source", [F.col("doc_id")], "tokens", 3000).select("doc_id", "source", "tokens")


@query("w10_prefix_budget", """SELECT doc_id, source, used FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000""")
def w10(spark, d):
    out = R.prefix_budget(table(spark, d, "documents"), "source", [F.col("doc_id")], "n_chars", 20000)
    return out.select("doc_id", "source", "used")


@query("w11_rolling_count", """SELECT a.hour, count(e.event_id) AS n FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events) a
 LEFT JOIN events e ON e.ts > a.hour - INTERVAL 3 HOUR AND e.ts <= a.hour GROUP BY a.hour""")
def w11(spark, d):
    # Every event falls into the windows of three whole hours, so the band join is an equi join.
    e = table(spark, d, "events").select("event_id", "ts")
    hours = e.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    up = F.expr("CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END").cast("timestamp_ntz")
    hits = e.select("event_id", up.alias("h")).select("event_id", F.explode(F.expr("transform(sequence(0, 2), i -> h + make_dt_interval(0, i))")).alias("hour"))
    return hours.join(hits, "hour", "left").groupBy("hour").agg(F.count("event_id").alias("n"))


@query("o03_ranked_multi_sort", """SELECT event_id FROM events ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, coalesce(value, 0) DESC, event_id LIMIT 100""")
def o03(spark, d):
    rank = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return table(spark, d, "events").orderBy(rank, F.desc(F.coalesce("value", ONE(0.0))), "event_id").select("event_id").limit(100)


@query("o05_page", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def o05(spark, d):
    return R.page(table(spark, d, "orders"), [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 100).select("o_orderkey", "o_orderpriority")


@query("u01_union_tagged", """SELECT scope, kind, count(*) AS n FROM (SELECT 'attempt' AS scope, event_type AS kind FROM events WHERE value > 90
 UNION ALL SELECT 'run', event_type FROM events WHERE value < 1) GROUP BY scope, kind""")
def u01(spark, d):
    e = table(spark, d, "events")
    part = lambda scope, keep: e.filter(keep).select(ONE(scope).alias("scope"), F.col("event_type").alias("kind"))
    return part("attempt", "value > 90").unionByName(part("run", "value < 1")).groupBy("scope", "kind").agg(F.count(ONE(1)).alias("n"))


@query("u02_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u02(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


_JACCARD = """SELECT a.u1, a.u2, round(a.both * 1.0 / (x.n + y.n - a.both), 6) AS jaccard, round(a.both * 1.0 / least(x.n, y.n), 6) AS overlap FROM
 (SELECT p.user_id AS u1, q.user_id AS u2, count(*) AS both FROM (SELECT DISTINCT user_id, floor(value / 2) AS b FROM events) p
  JOIN (SELECT DISTINCT user_id, floor(value / 2) AS b FROM events) q ON p.b = q.b AND p.user_id < q.user_id GROUP BY 1, 2) a
 JOIN (SELECT user_id, count(DISTINCT floor(value / 2)) AS n FROM events GROUP BY 1) x ON x.user_id = u1
 JOIN (SELECT user_id, count(DISTINCT floor(value / 2)) AS n FROM events GROUP BY 1) y ON y.user_id = u2"""


@query("u03_jaccard", _JACCARD)
def u03(spark, d):
    both = R.set_overlaps(table(spark, d, "events").select("user_id", F.floor(F.col("value") / 2).alias("b")), "user_id", "b")
    return both.select("u1", "u2", F.round(F.col("both") / (F.col("n1") + F.col("n2") - F.col("both")), 6).alias("jaccard"), F.round(F.col("both") / F.least("n1", "n2"), 6).alias("overlap"))
