"""Exact deduplication through a cuckoo-filter index of live digests."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import cut, join_skewed, lean, small_batches, table


class CuckooIndex:
    """Live digests behind a cuckoo filter, with insertion and deletion.

    The filter has buckets of four slots; a slot holds a 16-bit mark and the row
    where its content is. Content (digest, id, count) lies in flat arrays beside
    the filter, so a digest that no mark meets costs two buckets of marks, and a
    hit is verified against the content of its row. Rows of deleted digests are
    used again. Where an insertion finds no room, a filter of twice the size is
    built from the stored digests."""

    WIDTH, KICKS = 4, 200
    FREE, HELD, NO_ID = range(3)

    def __init__(self, buckets: int = 1 << 8) -> None:
        self.digests, self.bytes = bytearray(), 0
        self.ids, self.counts, self.state, self.free = array("q"), array("q"), bytearray(), array("i")
        self.size = self._turn = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks, self.rows = array("H", bytes(2 * buckets * self.WIDTH)), array("i", bytes(4 * buckets * self.WIDTH))

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def digest(self, row: int) -> bytes:
        return bytes(self.digests[row * self.bytes : (row + 1) * self.bytes])

    def id_of(self, row: int) -> int | None:
        return None if self.state[row] == self.NO_ID else self.ids[row]

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._place(key)
        for bucket in (first, second):
            for slot in range(bucket * self.WIDTH, bucket * self.WIDTH + self.WIDTH):
                if self.marks[slot] == mark:
                    at = self.rows[slot] * self.bytes
                    if self.digests[at : at + self.bytes] == key:
                        return slot
        return -1

    def find(self, key: bytes) -> int:
        """The row that holds ``key``, or -1."""
        slot = self._slot(key)
        return -1 if slot < 0 else self.rows[slot]

    def insert(self, key: bytes, id_: int | None, n: int = 1) -> None:
        """Add a digest that is not in the index; all digests have one length."""
        self.bytes = len(key)
        if self.free:
            row = self.free.pop()
        else:
            row = len(self.state)
            self.digests += key
            self.ids.append(0)
            self.counts.append(0)
            self.state.append(0)
        self.digests[row * self.bytes : (row + 1) * self.bytes] = key
        self.ids[row], self.counts[row], self.state[row] = id_ or 0, n, self.NO_ID if id_ is None else self.HELD
        self.size += 1
        if not self._add(row):
            self._grow()

    def _add(self, row: int) -> bool:
        """Put a row into the filter; False if something found no room."""
        mark, bucket, second = self._place(self.digest(row))
        if self._put(bucket, mark, row) or self._put(second, mark, row):
            return True
        for _ in range(self.KICKS):
            self._turn += 1
            slot = bucket * self.WIDTH + self._turn % self.WIDTH
            old = self.marks[slot], self.rows[slot]
            self.marks[slot], self.rows[slot] = mark, row
            mark, row = old
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark, row):
                return True
        return False

    def _grow(self) -> None:
        buckets = self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._add(row) for row in range(len(self.state)) if self.state[row]):
                return

    def _put(self, bucket: int, mark: int, row: int) -> bool:
        for slot in range(bucket * self.WIDTH, bucket * self.WIDTH + self.WIDTH):
            if not self.marks[slot]:
                self.marks[slot], self.rows[slot] = mark, row
                return True
        return False

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        row = self.rows[slot]
        self.marks[slot], self.state[row] = 0, self.FREE
        self.free.append(row)
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        return ((self.digest(row), self.id_of(row), self.counts[row]) for row in range(len(self.state)) if self.state[row])


def text_digest(text: str | None) -> bytes:
    """SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def text_sha256(text_col: str):
    """The lower-case hexadecimal digest of a text column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text_digest(t).hex())

    return F.pandas_udf(run, "string")(F.coalesce(F.col(text_col), F.lit("")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": [text_digest(t) for t in pdf["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(lean(run), "doc_id long, digest binary")


def _live_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each digest of a partition: the largest id and the rows so
    far. A later row with a larger id takes the place of the live one, which is
    deleted."""
    index = CuckooIndex()
    for pdf in frames:
        ids = [None if pd.isna(i) else int(i) for i in pdf["keep_id"]]
        for key, keep, n in zip(pdf["digest"], ids, pdf["group_size"].tolist(), strict=True):
            row = index.find(key)
            if row < 0:
                index.insert(key, keep, n)
                continue
            best, had = index.id_of(row), index.counts[row]
            if keep is not None and (best is None or keep > best):
                index.delete(key)
                index.insert(key, keep, had + n)
            else:
                index.counts[row] = had + n
    held = index.items()
    while part := list(islice(held, 50_000)):
        yield pd.DataFrame({"digest": [k for k, _, _ in part], "keep_id": pd.array([i for _, i, _ in part], dtype="Int64"), "group_size": [n for _, _, n in part]})


GROUPS = "digest binary, keep_id long, group_size long"


def digest_groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size). Each task first joins the copies of its
    own rows, so a hot digest arrives as one row per task."""
    own = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInPandas(lean(_live_groups), GROUPS)
    return own.repartition("digest").mapInPandas(lean(_live_groups), GROUPS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the largest id stays (null ids sort below all
    others). Rows that repeat an id are rows of their own in group_size and
    all of them are kept if their id is. Other columns are ignored; an empty
    table gives no rows. A text of any length is hashed whole and goes no
    further than its digest.
    """
    small_batches(docs.sparkSession)
    rows = cut(digests(docs, id_col, text_col))
    groups = cut(digest_groups(rows))
    out = join_skewed(rows, groups, "digest", "group_size", rows.count())
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def apply_changes(live: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Bring an index of live digests up to date.

    ``live`` and ``removed`` hold (digest, doc_id), ``added`` the same. Each
    shard loads its live digests into a cuckoo index, deletes the removed ones
    and inserts the added ones in the order of doc_id; an added digest that is
    live is a duplicate of the row that holds it. Returns the new live rows
    (status ``live``) and the duplicates (status ``duplicate``, with live_id).
    A removal of a digest that is not live, or of another doc_id, does nothing.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, seen = CuckooIndex(), []
        for pdf in frames:
            ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
            for key, doc, step in zip(pdf["digest"], ids, pdf["step"], strict=True):
                row = index.find(key)
                if step == 1:
                    if row >= 0 and index.id_of(row) == doc:
                        index.delete(key)
                elif row < 0:
                    index.insert(key, doc)
                elif step == 2:
                    seen.append((key, doc, "duplicate", index.id_of(row)))
            if len(seen) >= 50_000:
                yield rows_of(seen)
                seen = []
        live = ((k, i, "live", i) for k, i, _ in index.items())
        while part := [*seen, *islice(live, 50_000)]:
            yield rows_of(part)
            seen = []

    def rows_of(seen: list) -> pd.DataFrame:
        return pd.DataFrame(seen, columns=["digest", "doc_id", "status", "live_id"]).astype({"doc_id": "Int64", "live_id": "Int64"})

    parts = [df.select("digest", "doc_id", F.lit(i).alias("step")) for i, df in enumerate((live, removed, added))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.repartition("digest").sortWithinPartitions("step", "doc_id").mapInPandas(run, "digest binary, doc_id long, status string, live_id long")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
