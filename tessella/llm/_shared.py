"""Small helpers that several training-data operators use."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, a temporary folder serves
    one machine (``local[n]``); a cluster without it is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessella-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batches to ``rows`` rows, so that long texts do
    not fill a Python worker. The setting is only ever lowered and never put
    back: no result depends on it, and plans that run later need it too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def lean(run: Callable) -> Callable:
    """``run`` for a Python worker that gives the memory of its batches back to
    the system when it is done, as workers live on between stages."""

    @wraps(run)
    def trimmed(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            give_back()

    return trimmed


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], dict]) -> dict:
    """What ``fit`` makes of a sample of bounded size, in one task; only the
    result reaches the driver. Rows come in no fixed order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=names)
        del held
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows))]})

    names = sample.columns
    # collect() lets the worker end; first() would close its pipe while it writes.
    return pickle.loads(sample.repartition(1).mapInPandas(lean(run), "model binary").collect()[0]["model"])


def give_back() -> None:
    """Return memory that this Python process no longer uses to the system."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def join_skewed(left: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``left`` with one row per ``key`` in ``groups``.

    ``size`` counts the rows of ``left`` with that key and ``total`` all of
    them. At most 1000 keys can hold a thousandth of the rows each, so those
    are broadcast; every other key is too small to make a partition uneven.
    """
    limit = max(1000, total // 1000)
    hot, rest = groups.filter(F.col(size) >= limit), groups.filter(F.col(size) < limit)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def split_of(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def sized_batches(pdf, size_col: str, limit: int):
    """Slices of ``pdf`` whose sizes come to about ``limit``; a larger single
    row is a slice of its own."""
    start = total = 0
    for i, n in enumerate(pdf[size_col].to_numpy()):
        if i > start and total + n > limit:
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += int(n)
    if len(pdf):
        yield pdf.iloc[start:]


def text_batches(pdf, text_col: str, limit: int):
    """Slices of ``pdf`` whose texts come to about ``limit`` characters."""
    return sized_batches(pdf.assign(_size=pdf[text_col].str.len().fillna(0).astype("int64")), "_size", limit)


def crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of ``text`` in DuckDB: each byte is added, then
    eight shifts (-1) follow."""
    steps = f"flatten(list_transform(range(octet_length(encode({text}))), lambda i: [('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce({steps}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295)"
