"""Documents to ordered pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_starts(length: Column, size: Column, overlap: Column) -> Column:
    """0-based starts of windows of ``size`` with ``overlap``, until one
    reaches the end; none for an empty input."""
    step = size - overlap
    more = F.greatest(F.lit(0), F.ceil((length - size) / step).cast("int"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), more), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def character_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Trimmed text in windows of ``size`` characters."""
    rows = docs.select(id_col, F.trim(text_col).alias("_t"))
    starts = rows.select(id_col, "_t", F.posexplode(window_starts(F.length("_t"), F.lit(size), F.lit(overlap))).alias("chunk_index", "start"))
    text = F.substring("_t", F.col("start") + 1, F.lit(size))
    return starts.select(id_col, "chunk_index", "start", F.least(F.col("start") + size, F.length("_t")).alias("end"), text.alias("text"))


def token_windows(docs: DataFrame, id_col: str, tokens: Column, size: Column, overlap: Column) -> DataFrame:
    """Sliding windows over a token array; size and overlap may differ by row."""
    rows = docs.select(id_col, tokens.alias("_w"), size.alias("_s"), overlap.alias("_o"))
    starts = rows.select("*", F.posexplode(window_starts(F.size("_w"), F.col("_s"), F.col("_o"))).alias("chunk_index", "start"))
    return starts.select(id_col, "chunk_index", "start", F.slice("_w", F.col("start") + 1, F.col("_s")).alias("tokens"))


def adaptive_size(n: Column) -> tuple[Column, Column]:
    """(size, overlap) by the number of tokens: over 400 the size grows with it."""
    size = F.when(n > 400, F.least(F.lit(450), F.floor(n / 2).cast("int") + 100)).otherwise(F.lit(450))
    return size, F.when(n > 400, F.greatest(F.lit(60), F.floor(size * 0.15).cast("int"))).otherwise(F.lit(80))


def header_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Markdown sections (id, section, header, text); lines before the first
    header are a section with an empty header."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    header = F.col("line").rlike(r"^#{1,6}\s+")
    order = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.sum(header.cast("int")).over(order))
    grouped = marked.groupBy(id_col, "section").agg(
        F.sort_array(F.collect_list(F.struct("pos", "line")))["line"].alias("lines"),
        F.max(F.when(header, F.regexp_replace("line", r"^#{1,6}\s+", ""))).alias("header"),
    )
    return grouped.select(id_col, "section", F.coalesce("header", F.lit("")).alias("header"), F.trim(F.array_join("lines", "\n")).alias("text")).filter("text <> ''")


def sentences(text: Column) -> Column:
    """A text cut after sentence ends."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def word_tokens(text: Column) -> Column:
    """Runs without white space, which stand for tokens here."""
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def packed_paragraphs(docs: DataFrame, id_col: str, text_col: str, least: int = 100, most: int = 500, overlap: int = 50) -> DataFrame:
    """Texts of up to ``most`` tokens whole; longer ones packed by
    paragraphs, and paragraphs that are too long by sentences. A full piece is
    kept from ``least`` tokens on, and the next one starts with its last
    ``overlap`` characters. A fold over each document's units."""
    text = F.col(text_col)
    units = F.flatten(F.transform(F.split(text, "\n\n"), lambda p: F.when(
        word_tokens(p) > most, F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s: F.struct(s.alias("text"), F.lit(" ").alias("end")))
    ).otherwise(F.array(F.struct(p.alias("text"), F.lit("\n\n").alias("end"))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("tokens"))

    def step(acc, u):
        n, added = word_tokens(u["text"]), F.concat(u["text"], u["end"])
        tail = F.when(F.length(acc["open"]) > overlap, F.right(acc["open"], F.lit(overlap))).otherwise("")
        fresh = F.concat(tail, added)
        done = F.when(acc["tokens"] >= least, F.concat(acc["done"], F.array(stripped(acc["open"])))).otherwise(acc["done"])
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], added).alias("open"), (acc["tokens"] + n).alias("tokens"))
        return F.when(acc["tokens"] + n <= most, joined).otherwise(F.struct(done.alias("done"), fresh.alias("open"), word_tokens(fresh).alias("tokens")))

    end = lambda a: F.when((a["tokens"] >= least) & (stripped(a["open"]) != ""), F.concat(a["done"], F.array(stripped(a["open"])))).otherwise(a["done"])
    pieces = F.when(word_tokens(text) <= most, F.array(text)).otherwise(F.aggregate(units, start, step, end))
    return docs.select(id_col, F.posexplode(pieces).alias("chunk_index", "text"))


class SemanticChunker:
    """Stateful chunking of one document's sentences by similarity and size."""

    def __init__(self, base: int = 200, least: int = 100, most: int = 500, threshold: float = 0.7, overlap: float = 0.25) -> None:
        self.base, self.least, self.most, self.threshold, self.overlap = base, least, most, threshold, overlap

    def starts_new(self, tokens: int, added: int, similarity: float) -> bool:
        """Whether the next sentence opens a chunk. The cap comes first; under
        70 % of the base nothing splits; under the base only a clear break
        does, above it the plain threshold."""
        if tokens + added > self.most:
            return True
        if tokens < 0.7 * self.base:
            return False
        if tokens < self.base:
            return similarity < max(0.3, self.threshold - 0.3)
        return tokens >= self.least and similarity < self.threshold

    def overlapping(self, sizes: list[int], target: float) -> int:
        """How many sentences at the end of a chunk the next one repeats."""
        taken = total = 0
        for n in reversed(sizes):
            if taken and total + n > 1.5 * target:
                break
            taken, total = taken + 1, total + n
            if total >= target:
                break
        return taken

    def chunk(self, sentences: list[str], vectors: list[list[float]], title: str) -> list[tuple[str, int]]:
        import numpy as np

        out: list[tuple[str, int]] = []
        held: list[int] = []
        tokens, total = 0, 0.0
        sizes = [len(s.split()) for s in sentences]
        x = np.array(vectors, float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x

        def close() -> None:
            text = " ".join(sentences[i] for i in held)
            out.append((f"[Continuing from {title}] {text}" if out and title else text, sum(sizes[i] for i in held)))

        for i in range(len(sentences)):
            similarity = float(total @ x[i] / max(np.linalg.norm(total), 1e-12)) if held else 1.0
            if held and self.starts_new(tokens, sizes[i], similarity):
                close()
                again = self.overlapping([sizes[j] for j in held], self.overlap * self.base)
                held = held[len(held) - again :]
                tokens, total = sum(sizes[j] for j in held), x[held].sum(0)
                if tokens + sizes[i] > self.most:
                    held, tokens, total = [], 0, 0.0
            held.append(i)
            tokens, total = tokens + sizes[i], total + x[i]
        if held:
            close()
        return out


def semantic_chunks(docs: DataFrame, id_col: str, title_col: str, sentences_col: str, vectors_col: str, size: int = 32, **options) -> DataFrame:
    """(id, chunk_index, text, token_count). The sentences and their vectors
    are columns, so the embedding model stays outside; the fold over one
    document's sentences is the only part that runs in Python, where the
    sentences and chunks of ``size`` documents at a time are held as objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = SemanticChunker(**options)
        for whole in batches:
            made = whole.schema.field(id_col).type
            for start in range(0, whole.num_rows, size):
                part = whole.slice(start, size)
                keys, titles, texts = (part.column(part.schema.get_field_index(c)) for c in (id_col, title_col, sentences_col))
                vectors = part.column(part.schema.get_field_index(vectors_col))
                rows = []
                for i, (key, title) in enumerate(zip(keys.to_pylist(), titles.to_pylist(), strict=True)):
                    rows += [(key, j, text, n) for j, (text, n) in enumerate(chunker.chunk(texts[i].as_py() or [], vectors[i].as_py() or [], title or ""))]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (made, pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, "chunk_index", "text", "token_count"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, title_col, sentences_col, vectors_col).mapInArrow(run, f"{id_col} {kind}, chunk_index int, text string, token_count long")
