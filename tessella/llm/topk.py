"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in an order in which alike ones stand together and cut into
ranges (blocks). The terms of a query are its components with their signs; a
block keeps the maximum of each term, and the sum of the query's weights times
those maxima bounds every score inside. A query takes blocks from the largest
bound down and scores their forward index (the rows of the block) until the
bound falls below its k-th score so far. Consecutive blocks form shards: a query
first searches the shard it stands in, which gives the score to beat, and then
only the shards whose own bound reaches it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._shared import cut, fitted, lean, table
from tessella.llm.neardup import spherical_kmeans

K, EVERY, SCALE = 5, 50, 256
BLOCK, SHARD_BYTES, SAMPLE, CELL, MOST_CELLS = 256, 1 << 24, 20_000, 1000, 256
BATCH, SHARD_GROUP = 4096, 1024
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
HIT = "query binary, vec_id long, score long"


def quantised(v) -> np.ndarray | None:
    """floor(256 x) of every component; None if the vector takes no part."""
    if v is None:
        return None
    x = np.array([np.nan if e is None else e for e in v], float)
    return np.floor(np.clip(x, -1e305, 1e305) * SCALE) + 0.0 if np.isfinite(x).all() else None


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers held as doubles, exact, as int64. Doubles hold every
    sum where it stays below 2**53; beyond that Python's integers do, and a sum
    outside 64 bits counts as the end of the range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(e) for e in row] for row in m], dtype=object)
    return np.array([[min(max(int(s), LOW), HIGH) for s in row] for row in whole(a) @ whole(b).T], np.int64).reshape(len(a), len(b))


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest score that each query (row) can have in each block (column)."""
    return product(np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), np.hstack([top, low]))


def _matrix(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, width) if width else np.zeros((len(blobs), 0))


def fit_order(rows: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Centroids for each width, from a sample of about SAMPLE vectors drawn by
    hash; they only order the vectors, no result depends on them."""
    chance = int(1_000_000 * SAMPLE / max(1, total)) + 1
    sample = rows.filter(F.pmod(F.xxhash64("x"), F.lit(1_000_000)) < chance).select("width", "x")
    k = max(1, min(MOST_CELLS, total // CELL))

    def fit(pdf: pd.DataFrame) -> dict:
        made = {}
        for width, g in pdf.groupby("width"):
            x = _matrix(g["x"].map(bytes).sort_values(), width)[: 2 * SAMPLE]
            x = x[np.abs(x).max(1, initial=0) > 0]
            if len(x):
                made[int(width)] = spherical_kmeans(x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True), k)
        return made

    return fitted(sample, fit)


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        made = [(int(i), len(x), x.tobytes()) for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True) if (x := quantised(v)) is not None]
        yield pd.DataFrame(made, columns=["vec_id", "width", "x"])


def build_blocks(rows: DataFrame) -> DataFrame:
    """One row per block: shard, width, n, its ids in order and their vectors,
    the largest and smallest value of each component and the smallest id."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x")).alias("bytes")).first()
    centroids = rows.sparkSession.sparkContext.broadcast(fit_order(rows, size["n"]))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cell = np.zeros(len(pdf), int)
            for width, g in pdf.reset_index(drop=True).groupby("width"):
                if width in centroids.value:
                    cell[g.index] = (_matrix(g["x"], width) @ centroids.value[width].T).argmax(1)
            yield pdf.assign(cell=cell)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for width, g in pdf.groupby("width"):
                for start in range(0, len(g), BLOCK):
                    part = g.iloc[start : start + BLOCK].sort_values("vec_id")
                    x = _matrix(part["x"], width)
                    out.append((part["shard"].iloc[0], width, len(part), part["vec_id"].to_numpy(np.int64).tobytes(), x.tobytes(), x.max(0).tobytes(), x.min(0).tobytes(), part["vec_id"].iloc[0]))
            yield pd.DataFrame(out, columns=["shard", "width", "n", "ids", "x", "top", "low", "least"])

    shards = max(1, -(-(size["bytes"] or 0) // SHARD_BYTES))
    order = ["width", "cell", "vec_id"]
    ranged = rows.mapInPandas(placed, "vec_id long, width int, x binary, cell int").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    blocks = ranged.withColumn("shard", F.spark_partition_id()).mapInPandas(lean(packed), "shard int, width int, n int, ids binary, x binary, top binary, low binary, least long")
    return cut(blocks)


def take_queries(blocks: DataFrame, every: int) -> DataFrame:
    """(query, q_id, width, q, own, copies, home): the distinct query vectors
    with their score against themselves and the shard they stand in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for shard, width, n, ids, blob in zip(pdf["shard"], pdf["width"], pdf["n"], pdf["ids"], pdf["x"], strict=True):
                x = _matrix([blob], width) if width else np.zeros((n, 0))
                for i, q in zip(np.frombuffer(ids, np.int64).tolist(), x, strict=True):
                    if i % every == 0:
                        out.append((hashlib.md5(b"%d " % i + q.tobytes()).digest(), i, width, q.tobytes(), int(product(q[None], q[None])[0, 0]), shard))
            yield pd.DataFrame(out, columns=["query", "q_id", "width", "q", "own", "shard"])

    found = blocks.select("shard", "width", "n", "ids", "x").mapInPandas(run, "query binary, q_id long, width int, q binary, own long, shard int")
    return found.groupBy("query", "q_id", "width", "q", "own").agg(F.count(F.lit(1)).alias("copies"), F.min("shard").alias("home"))


def _search(queries: pd.DataFrame, blocks: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best of the blocks for each query, that its floor does not rule out."""
    for width, asked in queries.groupby("width"):
        held = blocks[blocks["width"] == width].reset_index(drop=True)
        if not len(held):
            continue
        q, top, low, least = _matrix(asked["q"], width), _matrix(held["top"], width), _matrix(held["low"], width), held["least"].to_numpy(np.int64)
        bound = bounds(q, top, low)
        order = np.argsort(~bound, axis=1, kind="stable")  # ~ turns the order round without overflow
        floor = asked["floor"].fillna(LOW).to_numpy(np.int64), asked["floor_id"].fillna(HIGH).to_numpy(np.int64)
        score, ids = np.full((len(q), k), LOW), np.full((len(q), k), HIGH)
        for at in range(order.shape[1]):
            block, every = order[:, at], np.arange(len(q))
            best, worst_id = np.maximum(score[:, -1], floor[0]), np.where(score[:, -1] > floor[0], ids[:, -1], np.where(score[:, -1] == floor[0], np.minimum(ids[:, -1], floor[1]), floor[1]))
            bd = bound[every, block]
            if (bd < best).all():
                break
            go = np.flatnonzero((bd > best) | ((bd == best) & (least[block] <= worst_id)))
            for b in np.unique(block[go]):
                sel = go[block[go] == b]
                own = np.frombuffer(held["ids"][b], np.int64)
                x = _matrix([held["x"][b]], width) if width else np.zeros((len(own), 0))
                s = np.hstack([score[sel], product(q[sel], x)])
                i = np.hstack([ids[sel], np.broadcast_to(own, (len(sel), len(own)))])
                pick = np.lexsort((i, ~s), axis=1)[:, :k]
                score[sel], ids[sel] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
        row, col = np.nonzero(np.minimum(held["n"].sum(), k) > np.broadcast_to(np.arange(k), score.shape))
        real = ~((ids[row, col] == HIGH) & (score[row, col] == LOW))
        row, col = row[real], col[real]
        yield pd.DataFrame({"query": asked["query"].to_numpy()[row], "vec_id": ids[row, col], "score": score[row, col]})


def search(asked: DataFrame, blocks: DataFrame, k: int, batches: int) -> DataFrame:
    """(query, vec_id, score): the best of each shard for the queries sent to
    it. Queries of a shard are dealt to ``batches`` tasks, each with the
    shard's blocks."""

    def run(key: tuple, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = list(_search(queries, held, k)) if len(queries) and len(held) else []
        return pd.concat(found) if found else pd.DataFrame({"query": [], "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})

    dealt = asked.withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int"))
    each = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    return dealt.groupBy("shard", "batch").cogroup(each.groupBy("shard", "batch")).applyInPandas(run, HIT)


def route(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``asked`` with ``shard``: every shard, but a query's home, whose bound
    reaches the query's floor. Shards are summarised SHARD_GROUP at a time and
    meet the queries in batches."""

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        width = key[1]
        return pd.DataFrame({"shard": [key[0]], "width": [width], "top": [_matrix(pdf["top"], width).max(0).tobytes()], "low": [_matrix(pdf["low"], width).min(0).tobytes()], "least": [pdf["least"].min()]})

    def reach(key: tuple, queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, g in queries.groupby("width"):
            held = shards[shards["width"] == width]
            if len(held):
                bd = bounds(_matrix(g["q"], width), _matrix(held["top"], width), _matrix(held["low"], width))
                floor, floor_id = g["floor"].fillna(LOW).to_numpy(np.int64)[:, None], g["floor_id"].fillna(HIGH).to_numpy(np.int64)[:, None]
                go = ((bd > floor) | ((bd == floor) & (held["least"].to_numpy(np.int64)[None] <= floor_id))) & (held["shard"].to_numpy()[None] != g["home"].to_numpy()[:, None])
                row, col = np.nonzero(go)
                out.append(g.iloc[row].assign(shard=held["shard"].to_numpy()[col]))
        return pd.concat(out) if out else queries.iloc[:0].assign(shard=0)

    shards = cut(blocks.select("shard", "width", "top", "low", "least").groupBy("shard", "width").applyInPandas(summary, "shard int, width int, top binary, low binary, least long"))
    groups = shards.agg(F.max("shard")).first()[0] // SHARD_GROUP + 1
    batches = asked.count() // BATCH + 1
    dealt = asked.select("*", F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    each = shards.select("*", F.floor(F.col("shard") / SHARD_GROUP).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    names = asked.columns
    return dealt.groupBy("batch", "grp").cogroup(each.groupBy("batch", "grp")).applyInPandas(lambda key, a, b: reach(key, a[names], b), f"{schema}, shard int")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id ``every``
    divides, the k largest integer inner products with all other rows.

    Components become floor(256 x). Equal scores go to the smaller vec_id. A
    vector that is null or holds a null or a non-finite component takes no
    part, nor does a row without vec_id; vectors meet only those of their
    width, and empty ones score 0. A query leaves out one row with its own id
    and vector, so repeated rows are queries and candidates of their own and
    find each other. Scores beyond 64 bits count as the end of the range.
    Other columns are ignored; an empty table gives no rows.
    """
    names = "query_id long, rank int, vec_id long, score long"
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding").mapInPandas(lean(_rows), "vec_id long, width int, x binary")
    blocks = build_blocks(cut(rows))
    queries = cut(take_queries(blocks, every))
    if queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], names)
    most = k + 1  # a query finds itself too
    batches = queries.count() // BATCH + 1
    unset = queries.select("query", "width", "q", F.lit(None).cast("long").alias("floor"), F.lit(None).cast("long").alias("floor_id"), F.col("home").alias("shard"))
    near = cut(search(unset, blocks, most, batches))
    # The worst of a full list: the least score, and of those the largest id.
    worst = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("score", F.bitwise_not("vec_id").alias("id"))).alias("w"))
    worst = worst.filter(F.col("n") == most).select("query", F.col("w.score").alias("floor"), F.bitwise_not("w.id").alias("floor_id"))
    asked = cut(queries.select("query", "width", "q", "home").join(worst, "query", "left"))
    far = search(route(asked, blocks).drop("home"), blocks, most, batches)
    ranked = near.unionByName(far).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= most)
    known = ranked.join(queries.select("query", "q_id", "own", "copies"), "query")
    itself = F.min(F.when((F.col("vec_id") == F.col("q_id")) & (F.col("score") == F.col("own")), F.col("r"))).over(Window.partitionBy("query"))
    others = known.withColumn("self", F.coalesce(itself, F.lit(most))).filter("r <> self")
    each = others.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(F.col("q_id").alias("query_id"), (F.col("r") - (F.col("r") > F.col("self")).cast("int")).cast("int").alias("rank"), "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
