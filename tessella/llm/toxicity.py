"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, so that inflected forms
share evidence. The machine adds a weight for each term and, through factor
vectors, one for each pair of terms that occur together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import fitted, lean, small_batches, split_of, table, text_batches
from tessella.llm._words import NO_LETTER, word_hashes

BITS, PREFIXES, SAMPLE, FACTORS, EPOCHS, THRESHOLD = 20, (4, 5, 6), 10_000, 8, 30, 0.7
MIN_DOCUMENTS, EVIDENCE, SHRINK, START = 5, 4.0, 2e-3, 0.05


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term of every text, with repeats."""
    hashes, owner, cut = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts], NO_LETTER, PREFIXES)
    parts = [(hashes, owner), *cut]
    return np.concatenate([o for _, o in parts]), (np.concatenate([h for h, _ in parts]) >> np.uint64(64 - BITS)).astype(np.int64)


class FactorizationMachine:
    """Binary features; log loss; Adagrad over mini-batches. Weights and
    factors of a feature shrink towards zero by its own step (L1), scaled like
    their learning rate, so terms that tell nothing, alone or in pairs, fade."""

    def __init__(self, features: int, factors: int = FACTORS, seed: int = 5) -> None:
        self.rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(features, np.float32)
        self.v = self.rng.normal(0, START, (features, factors)).astype(np.float32)

    def _score(self, feature: np.ndarray, starts: np.ndarray, v: np.ndarray, sums: np.ndarray) -> np.ndarray:
        square = np.add.reduceat(np.einsum("ij,ij->i", v, v), starts)
        return self.bias + np.add.reduceat(self.w[feature], starts) + 0.5 * ((sums**2).sum(1) - square)

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of each row; (row, feature) are its features, once each, by row."""
        out = np.full(rows, self.bias)
        if len(row):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            v = self.v[feature]
            out[row[starts]] = self._score(feature, starts, v, np.add.reduceat(v, starts, axis=0))
        return out

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, shrink: np.ndarray | float = 0.0, size: int = 256) -> FactorizationMachine:
        rate_y = y.mean().clip(1e-4, 1 - 1e-4) if len(y) else 0.5
        self.bias = float(np.log(rate_y / (1 - rate_y)))
        gw, gv, gb = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        shrink = np.broadcast_to(np.asarray(shrink, np.float32), len(self.w))
        filled = np.flatnonzero([len(r) > 0 for r in rows])
        for _ in range(epochs):
            order = self.rng.permutation(filled)
            for start in range(0, len(order), size):
                part = order[start : start + size]
                lengths = np.array([len(rows[i]) for i in part])
                starts = np.cumsum(lengths) - lengths
                feature = np.concatenate([rows[i] for i in part])
                v = self.v[feature]
                sums = np.add.reduceat(v, starts, axis=0)
                error = ((sigmoid(self._score(feature, starts, v, sums)) - y[part]) / len(part)).astype(np.float32)
                each = np.repeat(error, lengths)
                turn = np.argsort(feature, kind="stable")
                ordered = feature[turn]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                at = ordered[first]
                dw = np.add.reduceat(each[turn], first) + decay * self.w[at]
                dv = np.add.reduceat((each[:, None] * (np.repeat(sums, lengths, axis=0) - v))[turn], first, axis=0) + decay * self.v[at]
                gw[at] += dw**2
                gv[at] += dv**2
                gb += error.sum() ** 2
                sw, sv = rate / np.sqrt(gw[at]), 0.3 * rate / np.sqrt(gv[at])
                self.w[at] = soft(self.w[at] - sw * dw, shrink[at] * sw)
                self.v[at] = soft(self.v[at] - sv * dv, shrink[at][:, None] * sv)
                self.bias -= 0.1 * rate * float(error.sum()) / np.sqrt(gb)
        return self


def soft(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def known_terms(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur in MIN_DOCUMENTS documents or more, whatever their
    labels, as a term may tell nothing alone and much beside another; and how
    hard each shrinks: the less its own share of toxic documents differs from
    the mean (in standard errors), the harder."""
    n, toxic = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for row, mark in zip(rows, y, strict=True):
        n[row] += 1  # a row holds a bucket once
        if mark:
            toxic[row] += 1
    at = np.flatnonzero(n >= MIN_DOCUMENTS)
    p = float(y.mean()) if len(y) else 0.0
    z = np.abs(toxic[at] - n[at] * p) / np.sqrt(np.maximum(n[at] * p * (1 - p), 1e-9))
    return at, np.where(z >= EVIDENCE, 0.0, SHRINK).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on the whole texts of about ``sample`` labelled documents, chosen by
    a hash of the id among those that may be learnt from.

    Labels other than 0 and 1 are ignored; of several labels of a document the
    largest counts.
    """
    learnable = F.coalesce(split_of("doc_id", 3) != 1, F.lit(False))
    marks = labels.filter(learnable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chance = int(1_000_000 * sample / max(1, marks.count())) + 1
    drawn = marks.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < chance)
    part = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about ``sample`` rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for own in text_batches(pdf, "text", 1 << 19):
                row, bucket = terms(own["text"].tolist())
                both = np.unique(row << BITS | bucket)
                edges = np.searchsorted(both >> BITS, np.arange(len(own) + 1))
                found = [(both[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pd.DataFrame({"h": own["h"].to_numpy(), "toxic": own["toxic"].to_numpy(), "at": found})

    def fit(got: pd.DataFrame) -> dict:
        got = got.sort_values("h", kind="stable")
        rows, y = [np.asarray(a, np.int32) for a in got["at"]], got["toxic"].to_numpy(float)
        chosen, shrink = known_terms(rows, y)
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        rows = [p[p >= 0] for p in (place[r] for r in rows)]
        model = FactorizationMachine(len(chosen))
        if len(rows):
            model.fit(rows, y, shrink=shrink)
        return {"chosen": chosen.astype(np.int32), "bias": model.bias, "w": model.w, "v": model.v}

    return fitted(part.select("text", "toxic", F.xxhash64("doc_id", F.lit(3)).alias("h")).mapInPandas(lean(run), "h long, toxic int, at array<int>"), fit)


def score(docs: DataFrame, model: dict, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` and a column ``into`` (0 to 1); a null text reads as empty.
    ``into`` must be a new name; other columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        machine = FactorizationMachine(0)
        machine.bias, machine.w, machine.v = held["bias"], held["w"], held["v"]
        place = np.full(1 << BITS, -1, np.int32)
        place[held["chosen"]] = np.arange(len(held["chosen"]))
        for series in parts:
            out = [np.zeros(0)]
            for part in text_batches(series.to_frame("text"), "text", 1 << 19):
                row, bucket = terms(part["text"].tolist())
                feature = place[bucket]
                row, feature = row[feature >= 0], feature[feature >= 0]
                wide = max(1, len(machine.w))
                both = np.unique(row * wide + feature)
                out.append(sigmoid(machine.score(both // wide, both % wide, len(part))))
            yield pd.Series(np.concatenate(out))

    odds = F.pandas_udf(lean(run), "double")
    return docs.select("*", odds(F.coalesce(F.col(text_col), F.lit(""))).alias(into))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text enters a score. Repeated rows give a row each; other columns
    are ignored; without labelled texts every score is one half. A text of any
    length is scored whole; its terms are held at once.
    """
    model = train(docs, labels)
    rows = docs.select("doc_id", "text", F.coalesce(split_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    scored = score(rows, model)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
