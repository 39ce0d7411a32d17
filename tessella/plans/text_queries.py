"""Scalar text functions and chunking over the driver's documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import chunking as C
from tessella.plans.inputs import table
from tessella.plans.registry import query


@query("f01_fingerprint", "SELECT doc_id, 'sha256:v1:' || sha256(text) AS fingerprint, substr(sha256(text), 1, 8) AS short_id FROM documents")
def f01(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fingerprint("text").alias("fingerprint"), X.short_id("text").alias("short_id"))


@query("f04_alphanumeric", r"SELECT p_partkey, regexp_replace(lower(p_name || ' / ' || p_type), '[^\p{L}\p{N}]', '', 'g') AS key FROM part")
def f04(spark, d):
    return table(spark, d, "part").select("p_partkey", X.alphanumeric(F.concat("p_name", F.lit(" / "), "p_type")).alias("key"))


@query("f05_names_match", "SELECT c_custkey FROM customer WHERE contains(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 'r00000001') OR contains('r00000001', regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'))")
def f05(spark, d):
    return table(spark, d, "customer").filter(X.names_match("c_name", F.lit("R#00000001"))).select("c_custkey")


@query("f07_screaming_snake", r"""SELECT p_type, trim(upper(regexp_replace(regexp_replace(regexp_replace('p.q ' || p_type || ' made-Of.the  brass!', '[\s\-.]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), '_+', '_', 'g')), '_') AS name,
 trim(upper(regexp_replace(regexp_replace('camelCaseName ' || p_type, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_') AS token FROM (SELECT DISTINCT p_type FROM part)""")
def f07(spark, d):
    kinds = table(spark, d, "part").select("p_type").distinct()
    return kinds.select("p_type", X.screaming_snake(F.concat(F.lit("p.q "), "p_type", F.lit(" made-Of.the  brass!"))).alias("name"), X.token_case(F.concat(F.lit("camelCaseName "), "p_type")).alias("token"))


@query("f08_dedupe_key", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))) AS key FROM documents")
def f08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.dedupe_key("text"), 256).alias("key"))


@query("f09_capitalised_phrases", "SELECT doc_id, len(PHRASES(text)) AS n, array_to_string(list_slice(PHRASES(text), 1, 5), '|') AS first5 FROM documents")
def f09(spark, d):
    p = X.capitalised_phrases("text")
    return table(spark, d, "documents").select("doc_id", F.size(p).cast("long").alias("n"), F.array_join(F.slice(p, 1, 5), "|").alias("first5"))


@query("f10_quoted_phrases", """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '"([^"]+)"', 1))), '|') AS quoted FROM documents WHERE contains(text, '"')""")
def f10(spark, d):
    return table(spark, d, "documents").filter(F.col("text").contains('"')).select("doc_id", F.array_join(F.sort_array(F.array_distinct(X.quoted_phrases("text"))), "|").alias("quoted"))


@query("f10_keywords", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_slice(list_filter(c, lambda v, i: list_position(c, v) = i), 1, 10), list_slice(list_filter(q, lambda v, i: list_position(q, v) = i), 1, 5), list_slice(list_filter(t, lambda v, i: list_position(t, v) = i), 1, 5)))), '|') AS keywords
 FROM (SELECT doc_id, PHRASES(text) AS c, regexp_extract_all(text, '"([^"]+)"', 1) AS q, regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', '0', 'g'), '\bthe\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1) AS t FROM documents)""")
def f10b(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(X.keywords("text")), "|").alias("keywords"))


@query("f11_years", r"SELECT event_id, regexp_extract_all(event_id || 'DR and ' || user_id || ' Age', '(\d{3,4})\s*(?:DR|CR|Age)', 1)::INT[]::VARCHAR AS years FROM events")
def f11(spark, d):
    t = F.concat(F.col("event_id").cast("string"), F.lit("DR and "), F.col("user_id").cast("string"), F.lit(" Age"))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.array_join(X.years(t).cast("array<string>"), ", "), F.lit("]")).alias("years"))


@query("f23_retry_after", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id * 0.25 WHEN event_id % 5 = 1 THEN user_id::DOUBLE WHEN event_id % 5 = 2 THEN greatest(0.0, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-06-01')) END AS seconds FROM events""")
def f23(spark, d):
    i, utc = F.col("event_id") % 5, F.lit("2024-06-01").cast("timestamp")
    value = F.when(i == 1, F.col("user_id").cast("string")).when(i == 2, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(i == 3, "soon").otherwise("-")
    ms = F.when(i == 0, (F.col("event_id") * 250).cast("string")).when(i == 1, "-3")
    return table(spark, d, "events").select("event_id", X.retry_after_seconds(value, ms, utc).alias("seconds"))


@query("f06_token_case", r"SELECT DISTINCT event_type, trim(upper(regexp_replace(regexp_replace('has' || upper(event_type[1]) || event_type[2:] || 'OfKind', '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_') AS token, 'Has Kind ' || upper(event_type[1]) || event_type[2:] AS label FROM events")
def f06(spark, d):
    kinds = table(spark, d, "events").select("event_type").distinct()
    return kinds.select("event_type", X.token_case(F.concat(F.lit("has"), F.initcap("event_type"), F.lit("OfKind"))).alias("token"), X.title_label(F.concat(F.lit("has_kind_"), "event_type")).alias("label"))


@query("f15_counts", r"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) AS words, contains(text, '# ') AS headers FROM documents")
def f15(spark, d):
    return table(spark, d, "documents").select("doc_id", X.line_count("text").cast("long").alias("lines"), X.word_count("text").cast("long").alias("words"), F.col("text").contains("# ").alias("headers"))


@query("f16_conversation_title", """SELECT conv_id, CASE WHEN length(trim(text)) <= 50 THEN trim(text) WHEN contains(substr(trim(text), 1, 50), ' ')
 THEN regexp_replace(substr(trim(text), 1, 50), ' [^ ]*$', '') || '...' ELSE substr(trim(text), 1, 50) || '...' END AS title FROM conversations WHERE turn = 1""")
def f16(spark, d):
    return table(spark, d, "conversations").filter("turn = 1").select("conv_id", X.conversation_title("text").alias("title"))


def _redaction_sql(x):
    for pattern, put in X.REDACTIONS:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", put))
    return x


@query("f20_redaction", f"SELECT doc_id, r <> text AS changed, sha256(r) AS redacted_sha FROM (SELECT doc_id, text, {_redaction_sql('text')} AS r FROM documents)")
def f20(spark, d):
    redacted = X.redact("text")
    return table(spark, d, "documents").select("doc_id", (redacted != F.col("text")).alias("changed"), F.sha2(redacted, 256).alias("redacted_sha"))


@query("f20_password_redaction", "SELECT doc_id, lang || ' password=<redacted>; Bearer <redacted> https://u:<redacted>@h/' AS redacted FROM documents")
def f20b(spark, d):
    line = F.concat("lang", F.lit(" password="), "source", F.lit("; Bearer "), "source", F.lit("0123456789 https://u:"), "source", F.lit("@h/"))
    return table(spark, d, "documents").select("doc_id", X.redact(line).alias("redacted"))


@query("f22_backoff", """SELECT event_id, greatest(1, least(3600, round_even(least(3600.0, 30.0 * pow(2.0, event_id % 9)) * (0.8 + 0.4 * ((('0x' || substr(h, 1, 8))::BIGINT::DOUBLE * 4294967296.0 + ('0x' || substr(h, 9, 8))::BIGINT::DOUBLE) / 18446744073709551615.0)), 0)))::INT AS delay
 FROM (SELECT event_id, sha256(event_id || ':' || (event_id % 9 + 1)) AS h FROM events)""")
def f22(spark, d):
    return table(spark, d, "events").select("event_id", X.backoff_seconds(F.col("event_id").cast("string"), F.col("event_id") % 9 + 1).alias("delay"))


@query("f27_sentence_complexity", r"""SELECT doc_id, round(avg(c), 9) AS complexity FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN 1.0 ELSE (least(list_sum(list_transform(w, lambda x: length(x))) / len(w) / 6, 2.0) + least(len(w) / 20, 1.5)) / 2 END AS c FROM
 (SELECT doc_id, list_filter(regexp_split_to_array(unnest(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents)) GROUP BY doc_id""")
def f27(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(C.sentences(F.col("text"))).alias("s"))
    return each.groupBy("doc_id").agg(F.round(F.avg(X.sentence_complexity("s")), 9).alias("complexity"))


@query("f24_percentage", "SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE value > 98), 0), 3) AS pct FROM events GROUP BY user_id")
def f24(spark, d):
    from tessella.operators.relational import percentage

    return table(spark, d, "events").groupBy("user_id").agg(percentage(F.count_if(F.col("event_type") == "error"), F.count_if(F.col("value") > 98)).alias("pct"))


@query("f30_json", "SELECT event_id, CAST(json_extract(regexp_extract('noise ' || props || ' tail', '(\\{.*\\})', 1), '$.k') AS BIGINT) AS k FROM events")
def f30(spark, d):
    t = F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))
    return table(spark, d, "events").select("event_id", F.from_json(X.first_json(t), "k long")["k"].alias("k"))


@query("f32_grammars", "SELECT count(*) FILTER (WHERE regexp_matches(event_type, '^[A-Za-z_][A-Za-z0-9_]*$')) AS identifiers, count(*) FILTER (WHERE regexp_matches(props, '^[A-Za-z_][A-Za-z0-9_]*$')) AS bad FROM events")
def f32(spark, d):
    return table(spark, d, "events").agg(F.count_if(X.is_identifier("event_type")).alias("identifiers"), F.count_if(X.is_identifier("props")).alias("bad"))


_STARTS = "SELECT doc_id, trim(text) AS t, unnest(range(0, greatest(0, CAST(ceil((length(trim(text)) - 500) / 450.0) AS BIGINT)) + 1)) AS i FROM documents WHERE length(trim(text)) > 0"


@query("c01_character_chunks", f"SELECT doc_id, i AS chunk_index, i * 450 AS start, least(i * 450 + 500, length(t)) AS \"end\", sha256(substr(t, i * 450 + 1, 500)) AS sha FROM ({_STARTS})")
def c01(spark, d):
    out = C.character_chunks(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "start", "end", F.sha2("text", 256).alias("sha"))


_TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"


@query("c02_token_windows", f"""SELECT doc_id, i AS chunk_index, i * 370 AS start, least(450, len(w) - i * 370) AS n FROM
 (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 450) / 370.0) AS BIGINT)) + 1)) AS i FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE len(w) > 0)""")
def c02(spark, d):
    tokens = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    out = C.token_windows(table(spark, d, "documents"), "doc_id", tokens, F.lit(450), F.lit(80))
    return out.select("doc_id", "chunk_index", "start", F.size("tokens").alias("n"))


@query("c03_adaptive_windows", f"""SELECT doc_id, i AS chunk_index, i * (s - o) AS start, least(s, n - i * (s - o)) AS n FROM
 (SELECT *, unnest(range(0, greatest(0, CAST(ceil((n - s) / (s - o)::DOUBLE) AS BIGINT)) + 1)) AS i FROM
 (SELECT *, CASE WHEN n > 400 THEN greatest(60, CAST(floor(s * 0.15) AS INT)) ELSE 80 END AS o FROM
 (SELECT *, CASE WHEN n > 400 THEN least(450, n // 2 + 100) ELSE 450 END AS s FROM (SELECT doc_id, len({_TOKENS}) AS n FROM documents) WHERE n > 0)))""")
def c03(spark, d):
    tokens = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    docs = table(spark, d, "documents").withColumn("_tokens", tokens)
    size, overlap = C.adaptive_size(F.size("_tokens"))
    out = C.token_windows(docs, "doc_id", F.col("_tokens"), size, overlap)
    return out.select("doc_id", "chunk_index", "start", F.size("tokens").alias("n"))


_LINES = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split('intro' || chr(10) || '# ' || lang || chr(10) || text || chr(10) || '## End' || chr(10) || source, chr(10)) AS l FROM documents)"


@query("c04_header_sections", rf"""SELECT doc_id, section, coalesce(max(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+') THEN regexp_replace(line, '^#{{1,6}}\s+', '') END), '') AS header, count(*) AS lines FROM
 (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM ({_LINES})) GROUP BY doc_id, section""")
def c04(spark, d):
    text = F.concat(F.lit("intro\n# "), "lang", F.lit("\n"), "text", F.lit("\n## End\n"), "source")
    out = C.header_sections(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")
    return out.select("doc_id", "section", "header", X.line_count("text").cast("long").alias("lines"))


_N = r"len(list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("c05_packed_sentences", f"""WITH p AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents WHERE {_N.format('text')} > 120),
 s AS (SELECT doc_id, i, CASE WHEN {_N.format('p')} > 120 THEN list_transform(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x || ' ') ELSE [p || chr(10) || chr(10)] END AS units FROM p),
 u AS (SELECT doc_id, flatten(list(units ORDER BY i)) AS units FROM s GROUP BY doc_id),
 f AS (SELECT doc_id, list_reduce(list_transform(units, lambda x: {{'done': []::VARCHAR[], 'open': x, 'n': {_N.format('x')}}}), lambda a, x: CASE WHEN a.n + x.n <= 120 THEN {{'done': a.done, 'open': a.open || x.open, 'n': a.n + x.n}}
  ELSE {{'done': CASE WHEN a.n >= 30 THEN list_append(a.done, {_STRIP.format('a.open')}) ELSE a.done END, 'open': CASE WHEN length(a.open) > 50 THEN right(a.open, 50) ELSE '' END || x.open, 'n': {_N.format("CASE WHEN length(a.open) > 50 THEN right(a.open, 50) ELSE '' END || x.open")}}} END,
  {{'done': []::VARCHAR[], 'open': '', 'n': 0::BIGINT}}) AS r FROM u),
 o AS (SELECT doc_id, CASE WHEN r.n >= 30 AND {_STRIP.format('r.open')} <> '' THEN list_append(r.done, {_STRIP.format('r.open')}) ELSE r.done END AS pieces FROM f UNION ALL SELECT doc_id, [text] FROM documents WHERE {_N.format('text')} <= 120)
 SELECT doc_id, unnest(range(len(pieces))) AS chunk_index, length(unnest(pieces)) AS n FROM o""")
def c05(spark, d):
    out = C.packed_paragraphs(table(spark, d, "documents"), "doc_id", "text", least=30, most=120)
    return out.select("doc_id", "chunk_index", F.length("text").alias("n"))


@query("c06_semantic_chunks")
def c06(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 20).alias("title"), C.sentences(F.col("text")).alias("s"))
    # Letter frequencies stand in for an embedding model.
    vector = lambda s: F.transform(F.array(*map(F.lit, "aeioutnsrh")), lambda c: (F.length(s) - F.length(F.replace(s, c)) + 1).cast("double"))
    return C.semantic_chunks(docs.withColumn("v", F.transform("s", vector)), "doc_id", "title", "s", "v").select("doc_id", "chunk_index", "token_count")


@query("c08_sentence_counts", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n FROM documents")
def c08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(C.sentences(F.col("text"))).cast("long").alias("n"))


@query("c09_continuation_prefix", f"""SELECT doc_id, i AS chunk_index, CASE WHEN i > 0 THEN '[Continuing from ' || substr(t, 1, 10) || '] ' ELSE '' END || substr(t, i * 450 + 1, 20) AS opening FROM ({_STARTS})""")
def c09(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.substring(F.trim("text"), 1, 10).alias("title"))
    chunks = C.character_chunks(docs.select("doc_id", "text"), "doc_id", "text").join(docs.select("doc_id", "title"), "doc_id")
    prefix = F.when(F.col("chunk_index") > 0, F.concat(F.lit("[Continuing from "), "title", F.lit("] "))).otherwise("")
    return chunks.select("doc_id", "chunk_index", F.concat(prefix, F.substring("text", 1, 20)).alias("opening"))
