"""Table functions for SQL (D2): ``register`` makes them callable on any table.

    SELECT * FROM correction_batch_summary(TABLE(corrections) PARTITION BY batch)
    SELECT * FROM temporal_context(TABLE(episodes) PARTITION BY document_id ORDER BY ordinal)

Spark deals the table by the partition columns; a function holds a few numbers
of the partition that it reads, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class CorrectionBatchSummary:
    """Counts of the corrections (batch, type, action, rolled_back, confidence)
    of one batch."""

    def __init__(self) -> None:
        self.batch, self.counts, self.sum, self.scored = None, [0] * 6, Decimal(0), 0

    def eval(self, row: Row) -> None:
        self.batch = row["batch"]
        marks = (True, row["type"] == "DEDUPLICATION", row["type"] == "SEMANTIC_STANDARDIZATION", row["action"] == "DELETE", row["action"] == "UPDATE", bool(row["rolled_back"]))
        self.counts = [n + m for n, m in zip(self.counts, marks, strict=True)]
        if row["confidence"] is not None:
            self.sum, self.scored = self.sum + Decimal(str(row["confidence"])), self.scored + 1

    def terminate(self) -> Iterator[tuple]:
        mean = float((self.sum / self.scored).quantize(Decimal("0.001"), ROUND_HALF_UP)) if self.scored else None
        yield (self.batch, *self.counts, mean)


class TemporalContext:
    """The temporal metadata of a document: that of its first episode (in the
    order of the call) which holds any. Other rows are skipped."""

    def __init__(self) -> None:
        self.found = None

    def eval(self, row: Row) -> None:
        if self.found is None and row["is_temporal"]:
            self.found = (row["document_id"], row["temporal_order"], row["temporal_type"], row["eras"], row["event_count"])

    def terminate(self) -> Iterator[tuple]:
        if self.found is not None:
            yield self.found


FUNCTIONS = {
    "correction_batch_summary": (
        CorrectionBatchSummary, "batch bigint, total_corrections bigint, deduplication_count bigint, standardization_count bigint, deleted_relationships bigint, updated_relationships bigint, rolled_back_count bigint, avg_confidence double"
    ),
    "temporal_context": (TemporalContext, "document_id bigint, temporal_order int, temporal_type string, eras array<string>, event_count int"),
}


def register(spark: SparkSession) -> None:
    for name, (made, returns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=returns))
