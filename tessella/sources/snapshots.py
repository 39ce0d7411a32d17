"""Snapshots in buckets with a manifest, and a keyed store on top of them.

Rows are dealt to a fixed number of buckets by a hash of their key. A merge
rewrites only the buckets that its batch touches, into the folder of its epoch,
and then writes a manifest that names the folder of every bucket. A manifest is
what makes an epoch visible, so a merge that dies half-way, or comes twice,
changes nothing that can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.corpus import latest_wins


class BucketedSnapshot:
    """A table (key, order, ...) under ``root``; of the rows with one key the
    last by ``order`` stays. ``schema`` is the table's, as DDL."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: str, buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.key, self.order, self.buckets = spark, root, schema, key, order, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def epochs(self) -> list[int]:
        """The epochs with a whole manifest."""
        fs, at = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if fs.exists(self._path(f"{self.root}/manifest/{n}/_SUCCESS")[1])]
        return sorted(int(n.removeprefix("e=")) for n in done)

    def manifest(self, epoch: int | None = None) -> dict[int, int]:
        """{bucket: epoch of its folder}, one entry for each bucket at most."""
        known = self.epochs()
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, epoch long").json(f"{self.root}/manifest/e={known[-1] if epoch is None else epoch}")
        return dict(rows.collect())

    def read(self, buckets: list[int] | None = None, epoch: int | None = None) -> DataFrame:
        """The rows of all buckets, or of some: no other folder is opened."""
        held = self.manifest(epoch)
        paths = [f"{self.root}/data/v={e}/bucket={b}" for b, e in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _publish(self, epoch: int, held: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(held.items()) or [], "bucket int, epoch long")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/e={epoch}")

    def _rewrite(self, rows: DataFrame, touched: list[int], epoch: int) -> None:
        """Write the buckets anew; a bucket without rows leaves the manifest."""
        dealt = rows.withColumn("bucket", self.bucket())
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={epoch}")
        fs, at = self._path(f"{self.root}/data/v={epoch}")
        made = {int(n.removeprefix("bucket=")) for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("bucket=")}
        old = self.manifest()
        self._publish(epoch, {b: e for b, e in old.items() if b not in touched} | {b: epoch for b in touched if b in made})

    def merge(self, batch: DataFrame, epoch: int) -> bool:
        """Bring in a batch; False if its epoch is there already."""
        if epoch in self.epochs():
            return False
        rows = batch.select(*self.spark.createDataFrame([], self.schema).columns)
        touched = [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # ``buckets`` at most
        if not touched:
            self._publish(epoch, self.manifest())
            return True
        merged = latest_wins(self.read(touched).unionByName(rows), [self.key], [F.desc(self.order)])
        self._rewrite(merged, touched, epoch)
        return True

    def changes(self, batch: DataFrame, content: str) -> DataFrame:
        """(key, change) of a batch against what is held now: insert, update
        where the content differs, refresh where it does not."""
        touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # ``buckets`` at most
        new = latest_wins(batch, [self.key], [F.desc(self.order)]).select(self.key, F.col(content).alias("_new"))
        old = self.read(touched).select(self.key, F.col(content).alias("_old"), F.lit(True).alias("_had"))
        change = F.when(F.col("_had").isNull(), "insert").when(F.col("_new").eqNullSafe(F.col("_old")), "refresh").otherwise("update")
        return new.join(old, self.key, "left").select(self.key, change.alias("change"))

    def expire(self, keep: int = 2) -> list[int]:
        """Delete the manifests but the last ``keep`` and every folder that none
        of those names; the epochs whose folders went."""
        known = self.epochs()
        stay = known[-keep:]
        named = {e for m in stay for e in self.manifest(m).values()}
        fs, at = self._path(f"{self.root}/data")
        there = [int(s.getPath().getName().removeprefix("v=")) for s in fs.listStatus(at)] if fs.exists(at) else []
        for e in known[:-keep] if keep else known:
            fs.delete(self._path(f"{self.root}/manifest/e={e}")[1], True)
        gone = sorted(e for e in there if e not in named and e <= known[-1])
        for e in gone:
            fs.delete(self._path(f"{self.root}/data/v={e}")[1], True)
        return gone


class StateStore:
    """States by key with a time to live, in buckets of a hash of the key,
    so that no file names a key. ``put`` keeps the latest of each key, ``get``
    opens only the buckets of the keys asked for, and ``compact`` rewrites the
    buckets that hold something expired."""

    SCHEMA = "key string, value string, updated_at timestamp, deleted boolean"

    def __init__(self, spark: SparkSession, root: str, hours: float = 24, buckets: int = 64) -> None:
        self.rows = BucketedSnapshot(spark, root, self.SCHEMA, "key", "updated_at", buckets)
        self.spark, self.hours = spark, hours

    def _next(self) -> int:
        known = self.rows.epochs()
        return known[-1] + 1 if known else 0

    def put(self, states: DataFrame) -> None:
        """States (key, value, updated_at); a null value deletes its key."""
        self.rows.merge(states.select("key", "value", "updated_at", F.col("value").isNull().alias("deleted")), self._next())

    def alive(self, now: Column) -> Column:
        return ~F.col("deleted") & (F.col("updated_at") >= now - F.make_dt_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(self.hours * 3600).cast("decimal(18,6)")))

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """(key, value, updated_at) of the ``keys`` (key) that are alive."""
        held = [r[0] for r in keys.select(self.rows.bucket().alias("b")).distinct().collect()]  # one for each bucket at most
        return self.rows.read(held).join(keys.select("key").distinct(), "key", "left_semi").filter(self.alive(now)).drop("deleted")

    def compact(self, now: Column) -> int:
        """Drop what is expired or deleted; how many buckets were rewritten."""
        stale = [r[0] for r in self.rows.read().filter(~self.alive(now)).select(self.rows.bucket().alias("b")).distinct().collect()]  # ``buckets`` at most
        if stale:
            self.rows._rewrite(self.rows.read(stale).filter(self.alive(now)), stale, self._next())
        return len(stale)
