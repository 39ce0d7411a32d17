"""All registered queries of the knowledge-retrieval side, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import registry

GROUPS = ("relational", "text", "retrieval", "graph", "operations", "stream", "record", "more", "state", "report")


def _load() -> None:
    for name in GROUPS:
        importlib.import_module(f"tessella.plans.{name}_queries")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["r08_reciprocal_rank_fusion"](spark, sf_dir)
