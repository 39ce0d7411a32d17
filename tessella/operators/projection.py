"""Content-free projections of nested reports (Q8).

A report is a struct of structs, arrays and maps, and may hold names and texts.
Its projection is built from the schema alone: numbers and flags stay, a list
becomes its length, and a text stays only where an allow-list names its path.
No rows are looked at while the expression is built, and no UDF runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StructType

# What each report keeps. A path ends in * where whole map keys
# (names of states or rules, never of content) or list elements are kept.
AUDIT = {"status", "state_source", "counts.*", "counts.lifecycle.*", "metadata_coverage.*", "drift.*"}
PREFLIGHT = {
    "status", "scope", "spaces.*", "spaces.*.semantic_index", "spaces.*.physical_space", "spaces.*.status", "spaces.*.configured_profile.fingerprint", "spaces.*.metadata.profile_fingerprint",
    "spaces.*.findings.*", "spaces.*.findings.*.code", "spaces.*.findings.*.severity",
}
QUALITY = {
    "status", "reason", "run.id", "run.state", "run.sync_profile_fingerprint", "run.started_at", "run.stopped_at", "evidence.status", "vocabulary.fingerprints.*",
    "relationships.*", "rates_percent.*", "rejection_reasons.*",
}
RUN_SUMMARY = {
    "status", "run.id", "run.state", "run.sync_profile_fingerprint", "run.started_at", "run.heartbeat_at", "run.stopped_at", "run.last_failure_class", "run.last_failure_code", "progress.*", "attempts.*", "provider_calls.*",
}
SYNC_STATUS = {
    "counts.*", "ledger.*", "active_run.id", "active_run.state", "active_run.sync_profile_fingerprint", "active_run.started_at", "active_run.updated_at", "active_run.heartbeat_at", "active_run.last_failure_class", "active_run.last_failure_code",
}


def content_free(value: Column, kind: DataType, allowed: set[str], path: str = "") -> Column | None:
    """What of ``value`` may be shown; None if nothing. Lists on an allowed
    path are walked into, others are counted; maps on an allowed path keep their
    keys, others are counted; counts are never below zero."""
    at = lambda name: f"{path}.{name}" if path else name
    if isinstance(kind, StructType):
        kept = [(f.name, content_free(value.getField(f.name), f.dataType, allowed, at(f.name))) for f in kind.fields]
        kept = [c.alias(name) for name, c in kept if c is not None]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType):
        inner = content_free(F.lit(None).cast(kind.elementType), kind.elementType, allowed, at("*")) if at("*") in allowed else None
        if inner is None:
            return F.coalesce(F.size(value), F.lit(0)).cast("long") if not isinstance(kind.elementType, BooleanType) else None
        return F.transform(F.coalesce(value, F.array().cast(kind)), lambda e: content_free(e, kind.elementType, allowed, at("*")))
    if isinstance(kind, MapType):
        inner = content_free(F.lit(None).cast(kind.valueType), kind.valueType, allowed - {at("*")}, at("*")) if at("*") in allowed else None
        if inner is None:  # texts as values are content whatever their keys
            return F.coalesce(F.size(value), F.lit(0)).cast("long")
        return F.transform_values(value, lambda k, v: content_free(v, kind.valueType, allowed, at("*")))
    if isinstance(kind, NumericType):
        return F.greatest(value, F.lit(0).cast(kind))
    if isinstance(kind, BooleanType):
        return F.coalesce(value, F.lit(False))
    return value if path in allowed else None


def projected(reports: DataFrame, column: str, allowed: set[str], schema_version: int = 1) -> DataFrame:
    """``reports`` with the report in ``column`` replaced by its projection."""
    kind = reports.schema[column].dataType
    safe = content_free(F.col(column), kind, allowed)
    if safe is None:
        raise ValueError(f"nothing of {column} may be shown")
    return reports.withColumn(column, safe).withColumn("schema_version", F.lit(schema_version))
