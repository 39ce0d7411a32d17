"""Relational building blocks: filters, joins, aggregates and row windows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import checkpointed


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """AND of equality filters over the arguments that are not None; a list
    means membership and an empty list means all."""
    for name, value in wanted.items():
        if isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(name).isin(*value)) if value else df
        elif value is not None:
            df = df.filter(F.col(name) == value)
    return df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """LIMIT / OFFSET over a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_counts(df: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """The most frequent values; ties go by value."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(by)).limit(limit)


def zero_filled(counts: DataFrame, domain: DataFrame, on: str, value: str) -> DataFrame:
    """``counts`` over the whole domain, zero where it has no row."""
    return domain.join(counts, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def nearest_rank(values: Column, fraction: float) -> Column:
    """Percentile by nearest rank of an array; 0 when it is empty."""
    ordered = F.sort_array(values)
    at = F.greatest(F.ceil(F.size(values) * F.lit(fraction)).cast("int"), F.lit(1))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.try_element_at(ordered, at))


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def percentage(part: Column, whole: Column, digits: int = 3) -> Column:
    """100 * part / whole; null when the whole is zero."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def neighbours(hits: DataFrame, rows: DataFrame, doc: str, idx: str, reach: int = 2, most: int = 10) -> DataFrame:
    """Rows within ``reach`` positions of a hit of the same document, without
    the hits: offsets are exploded so that the join is on equal keys, and the
    first ``most`` distinct positions of a document count."""
    near = hits.select(doc, F.explode(F.sequence(F.col(idx) - reach, F.col(idx) + reach)).alias(idx)).filter(F.col(idx) >= 0).distinct()
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(idx))).filter(F.col("_n") <= most).drop("_n")
    return rows.join(near, [doc, idx]).join(hits.select(doc, idx), [doc, idx], "left_anti")


def set_overlaps(members: DataFrame, key: str, value: str, size: int = 1024) -> DataFrame:
    """(u1, u2, both, n1, n2) of every two keys (u1 < u2) with a value in
    common: how many they share and how many each has. The keys are dealt to
    blocks of some ``size``, each packed into one row and written once; every two
    blocks meet once, read from there and not shuffled, as a product of their
    incidence matrices. A pair is one row however much it shares, and a task
    holds some 16 packed blocks, and of two blocks their pairs. Nulls share
    nothing."""
    import pickle
    import zlib

    import numpy as np

    spark = members.sparkSession
    sets = members.select(F.col(key).alias("k"), F.col(value).alias("v")).dropna().distinct().groupBy("k").agg(F.collect_list("v").alias("vs"))
    blocks = -(-members.select(key).distinct().count() // size) or 1

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["k"].to_numpy(), pdf["vs"].map(len).to_numpy(), np.concatenate(pdf["vs"].to_list())
        return pd.DataFrame({"x": pdf["x"].iloc[:1], "block": [zlib.compress(pickle.dumps(block), 1)]})

    def meet(a: bytes, b: bytes, alone: bool) -> pd.DataFrame:
        (ka, na, u), (kb, nb, v) = (pickle.loads(zlib.decompress(x)) for x in (a, b))
        shared = np.intersect1d(u, v)
        rows = [(np.repeat(np.arange(len(n)), n), np.searchsorted(shared, w), np.isin(w, shared)) for n, w in ((na, u), (nb, v))]
        both = np.zeros((len(ka), len(kb)), np.float32)  # whole numbers, exact below 2^24
        for start in range(0, len(shared), 4096):
            ones = []
            for n, (at, code, known) in zip((na, nb), rows, strict=True):
                m = np.zeros((len(n), min(4096, len(shared) - start)), np.float32)
                here = known & (code >= start) & (code < start + 4096)
                m[at[here], code[here] - start] = 1
                ones.append(m)
            both += ones[0] @ ones[1].T
        i, j = np.nonzero(both)
        up = ka[i] < kb[j]
        if alone:
            i, j, up = i[up], j[up], up[up]
        ui, uj, ni, nj = ka[i], kb[j], na[i], nb[j]
        return pd.DataFrame({"u1": np.where(up, ui, uj), "u2": np.where(up, uj, ui), "both": both[i, j].astype(np.int64), "n1": np.where(up, ni, nj), "n2": np.where(up, nj, ni)})

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                yield meet(row.a, row.b, row.alone)

    parts = min(blocks, max(math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)), -(-blocks // 16)))
    dealt = sets.withColumn("x", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    packed = checkpointed(dealt.groupBy("x").applyInPandas(pack, "x int, block binary").repartition(parts)).rdd
    pairs = packed.cartesian(packed).filter(lambda p: p[0][0] <= p[1][0]).map(lambda p: (p[0][1], p[1][1], p[0][0] == p[1][0]))
    kind = dict(members.dtypes)[key]
    return spark.createDataFrame(pairs, "a binary, b binary, alone boolean", verifySchema=False).mapInPandas(met, f"u1 {kind}, u2 {kind}, both long, n1 long, n2 long")


def greedy_budget(df: DataFrame, key: str, order: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Rows of each key in order that still fit the budget, skipping those
    that do not; where none fits, the first row alone. Costs are zero or more.

    What is used only grows, so once a row of some cost does not fit, no later
    one of that cost does: only the first ``budget / cost`` rows of each cost can
    be kept, and of those over the budget the first. The others go before a key's
    rows are read in order, so that is done for some ``budget`` times the
    logarithm of ``budget`` rows and those without cost."""
    names, dear = df.columns, F.coalesce(F.col(cost) > budget, F.lit(True))
    place = F.row_number().over(Window.partitionBy(key, F.when(~dear, F.col(cost))).orderBy(*order))
    most = F.when(dear, 1).when(F.col(cost) > 0, F.floor(budget / F.col(cost)))
    schema = df.schema
    df = df.withColumn("_place", place).filter((~dear & (F.col(cost) == 0)) | (F.col("_place") <= most)).drop("_place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, first = None, 0, None
        for pdf in frames:
            kept = []
            for i, (k, c) in enumerate(zip(pdf[key], pdf[cost], strict=True)):
                k = None if pd.isna(k) else k
                if i == 0 and at is None or k != at[0]:
                    if first is not None:
                        yield first
                    at, used, first = (k,), 0, pdf.iloc[i : i + 1]
                if used + c <= budget:
                    kept.append(i)
                    used, first = used + c, None
            yield pdf.iloc[kept]
        if first is not None:
            yield first

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema).select(*names)


def prefix_budget(df: DataFrame, key: str, order: Sequence[Column], cost: str, budget: int, used: str = "used") -> DataFrame:
    """Rows until the first that would pass the budget, with what is ``used``
    up to each."""
    total = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(used, total).filter(F.col(used) <= budget)


def merge_graph(current: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """Match or create by key; the wanted value wins where given."""
    return current.withColumnRenamed(value, "_old").join(wanted.withColumnRenamed(value, "_new"), key, "full_outer").select(
        key, F.coalesce("_new", "_old").alias(value), F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "unchanged").otherwise("matched").alias("action")
    )
