"""Connected components by contraction, for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import cut, lean

_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)


def shuffle_ids(ids: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit ids, so that the order of ids says
    nothing about the shape of a graph."""
    x = ids.astype(np.int64).view(np.uint64)
    for m in _MULTIPLIERS:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(m)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def restore_ids(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    x = x ^ (x >> np.uint64(32))
    for m in reversed(_MULTIPLIERS):
        x = x * np.uint64(pow(m, -1, 1 << 64))
        x = x ^ (x >> np.uint64(32))
    return x.view(np.int64)


class Union:
    """Union-find over any hashable ids; the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same components with one edge (root, node) at most for each node,
    for every 500,000 edges of a partition."""
    union, held = Union(), 0
    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            union.link(a, b)
        held += len(pdf)
        if held > 500_000:
            yield _edges(union)
            union, held = Union(), 0
    yield _edges(union)


def _edges(union: Union) -> pd.DataFrame:
    nodes = list(union.up)
    return pd.DataFrame({"a": np.array([union.root(x) for x in nodes], np.int64), "b": np.array(nodes, np.int64)})


def _shuffled_forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _forest(pd.DataFrame({c: shuffle_ids(pdf[c].to_numpy()) for c in ("a", "b")}) for pdf in frames)


def _restored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"id": restore_ids(pdf["at"].to_numpy()), "top": pdf["to"].to_numpy()})


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of the
    undirected ``edges`` (a, b). Edges with a null end or of a node with itself
    link nothing.

    Ids are scattered first. Each round contracts what a partition links by
    itself, then moves every node to its least neighbour and the edges along
    with their ends, until no edge is left; a star is gone after one round and
    a path shrinks by a constant factor. The moves are composed backwards,
    from the smallest round to the largest.
    """
    left = cut(edges.select("a", "b").filter("a <> b").mapInPandas(lean(_shuffled_forest), "a long, b long"))
    rounds = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("to")))
        rounds.append(moves)
        ends = left.join(moves.withColumnsRenamed({"at": "a", "to": "ta"}), "a").join(moves.withColumnsRenamed({"at": "b", "to": "tb"}), "b")
        left = cut(ends.filter("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).mapInPandas(lean(_forest), "a long, b long"))
    reach = edges.sparkSession.createDataFrame([], "at long, to long")
    for moves in reversed(rounds):
        reach = moves.join(reach.select(F.col("at").alias("to"), F.col("to").alias("end")), "to", "left").select("at", F.coalesce("end", "to").alias("to"))
    found = cut(reach.mapInPandas(lean(_restored), "id long, top long"))
    least = found.groupBy("top").agg(F.min("id").alias("component"))
    return found.join(least, "top").select("id", "component")
