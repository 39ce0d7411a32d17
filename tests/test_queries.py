"""Every registered query against its SQL, on the smallest tables."""

import hashlib
import re

import pytest
from compare import same

from tessella.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name, source, key", [("f11_years", "events", "event_id"), ("q14_temporal_order", "orders", "o_orderkey")])
def test_query_reads_the_whole_table(spark, sf_dir, name, source, key):
    want = {r[0] for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key).collect()}
    assert {r[key] for r in QUERIES[name](spark, sf_dir).collect()} == want


def test_dedupe_key_and_chunks_cover_all_languages(spark, tmp_path):
    texts = ["  Élan\t VITAL\n\nà Paris. Où est-il ? ", "STRASSE straße\x0bÜber alles. Ja.", "¿Qué  Ñandú? Sí.", "plain\f\rtext. Again.", " kept wide  space", "", " "]
    langs = ["fr", "de", "es", "en", "xx", "fr", None]
    spark.createDataFrame(list(zip(range(7), texts, langs, strict=True)), "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: hashlib.sha256(re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").lower().encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["key"] for r in QUERIES["f08_dedupe_key"](spark, str(tmp_path)).collect()} == want
    assert {r["doc_id"] for r in QUERIES["c06_semantic_chunks"](spark, str(tmp_path)).collect()} >= {0, 1, 2, 3, 4}


def test_bounded_messages_of_odd_texts_match_sql(spark, tmp_path):
    import duckdb

    spaces = [chr(c) for c in (0x20, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = ["", " ", None, "\n\t", "\x00a\x00\x7f b\x1f", "x" * 511 + " y", "\u00a0" + "é" * 600, *spaces, *(f"{c} x {c}" for c in spaces), *(f"\x0b{c}a\r{c}b{c}\x1f" for c in spaces)]
    rows = [(10 * i + 1, t) for i, t in enumerate(texts)] + [(None, " a "), (None, None), (10, "b"), (20, None), (-5, " q "), (-10, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {(r["doc_id"], r["message"]) for r in QUERIES["f21_bounded_messages"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLE["f21_bounded_messages"]).fetchall())
