"""A registry of named queries, each with the SQL that should give its rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PHRASES = r"regexp_extract_all(regexp_replace(@, '[À-ÖØ-öø-ɏ]', '0', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. In its SQL, ``PHRASES(x)`` stands for the capitalised
    phrases of column x; RE2 knows word bounds of ASCII only, so other Latin
    letters count as digits."""

    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = re.sub(r"PHRASES\((\w+)\)", lambda m: PHRASES.replace("@", f"coalesce({m[1]}, '')", 1), sql)
        return f

    return add
