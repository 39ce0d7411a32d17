"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader and an
elastic-net penalty, then calibrated by one temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import fitted, lean, small_batches, split_of, table, text_batches

BUCKETS, ORDERS, SAMPLE_PER_LANGUAGE, MOST_LANGUAGES, EPOCHS = 1 << 14, (1, 2, 3), 800, 100, 3
SCALE = 40.0


def gram_buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashed character n-grams of each lower-cased text, with repeats."""
    texts = [f" {t.lower()} " if t else "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled, grams = np.zeros(len(codes), np.uint32), []
    for order in range(1, max(ORDERS) + 1):
        n = len(codes) - order + 1
        if n > 0:
            rolled = rolled[:n] * np.uint32(0x01000193) + codes[order - 1 :]
            if order in ORDERS:
                mixed = (rolled ^ np.uint32(order)) * np.uint32(0x9E3779B1)
                grams.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    ends = np.cumsum([len(t) for t in texts])
    for text, end in zip(texts, ends, strict=True):
        start = end - len(text)
        yield np.concatenate([g[start : max(start, end - order + 1)] for order, g in zip(ORDERS, grams, strict=False)]) if text else np.zeros(0, np.int32)


def term_frequencies(grams: np.ndarray) -> np.ndarray:
    return np.bincount(grams, minlength=BUCKETS).astype(np.float32) / max(1, len(grams))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """In how many documents each bucket occurs, over all of ``docs``, and how
    many documents there are (the last value). BUCKETS + 1 sums reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS + 1, np.int64)
        for pdf in frames:
            for part in text_batches(pdf, "text", 1 << 18):
                for grams in gram_buckets([t or "" for t in part["text"]]):
                    seen[:BUCKETS] += np.bincount(grams, minlength=BUCKETS) > 0
                    seen[BUCKETS] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "n": seen[at]})

    sums = docs.select(F.col(text_col).alias("text")).mapInPandas(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


class FtrlSoftmax:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2."""

    def __init__(self, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(scores / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Learn from the rows with a text and a language.

    The MOST_LANGUAGES most frequent languages are learnt (a table of labels
    with stray values has no more). Document frequencies cover all rows; the weights are fitted on a sample
    of about ``per_language`` documents of each language, chosen by a hash of
    the id, of which every fifth only sets the temperature.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "weights": np.zeros((BUCKETS, 0), np.float32), "temperature": 1.0}
    df = document_frequencies(rows)
    idf = (np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1).astype(np.float32)
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * per_language / n) + 1)).otherwise(limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in text_batches(pdf, "text", 1 << 18):
                out = []
                for lang, h, grams in zip(part["lang"], part["h"], gram_buckets(part["text"].tolist()), strict=True):
                    tf = term_frequencies(grams)
                    at = np.flatnonzero(tf).astype(np.int32)
                    out.append((lang, h, at, tf[at] * idf[at] * SCALE))
                yield pd.DataFrame(out, columns=["lang", "h", "at", "x"])

    sample = rows.filter(chance < limit).select("lang", "text", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    def fit(got: pd.DataFrame) -> dict:
        got = got.sort_values("h", kind="stable")
        data = [(np.asarray(a, np.int32), np.asarray(x, np.float32), langs.index(lang)) for a, x, lang in zip(got["at"], got["x"], got["lang"], strict=True)]
        held, learn = data[::5], [d for i, d in enumerate(data) if i % 5] or data
        model = FtrlSoftmax(len(langs))
        for _ in range(EPOCHS):
            for at, x, label in learn:
                model.learn(at, x, label)
        w = model.weights()
        t = temperature(np.array([x @ w[at] for at, x, _ in held]), np.array([k for _, _, k in held])) if len(held) > 20 else 1.0
        return {"langs": langs, "weights": (w * idf[:, None] * SCALE).astype(np.float32), "temperature": t}

    return fitted(sample.mapInPandas(lean(run), "lang string, h long, at array<int>, x array<float>"), fit)


def predict(docs: DataFrame, model: dict, text_col: str = "text", into: str = "guess") -> DataFrame:
    """``docs`` and a struct ``into`` with lang_pred and score (the calibrated
    probability of that language). A text that is null or has no letter is
    ``und`` with score 0. ``into`` must be a new name; other columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, w, t = (shared.value[k] for k in ("langs", "weights", "temperature"))
        for series in parts:
            out = []
            for part in text_batches(series.to_frame("text"), "text", 1 << 18):
                texts = [x or "" for x in part["text"]]
                lettered = [any(map(str.isalpha, x)) for x in texts]
                for ok, grams in zip(lettered, gram_buckets(texts), strict=True):
                    if not ok or not langs:
                        out.append(("und", 0.0))
                        continue
                    p = softmax((term_frequencies(grams) @ w).astype(float) / t)
                    best = int(p.argmax())
                    out.append((langs[best], float(min(1.0, p[best]))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    guess = F.pandas_udf(lean(run), "lang_pred string, score double")
    return docs.select("*", guess(F.coalesce(F.col(text_col), F.lit(""))).alias(into))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    The model learns from the documents that are not held out. Only the text
    enters a prediction. Repeated rows give a row each; other columns are
    ignored; without any labelled text every document is ``und``. A text of any
    length is read whole, in its n-grams.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(split_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "guess.lang_pred", "guess.score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
