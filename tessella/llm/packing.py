"""Packing documents into token sequences by bounded-space online best fit."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import lean, small_batches, table, text_batches
from tessella.llm.bpe import byte_letters, tokenizer

LENGTH, OPEN_BINS, SHARD_ROWS, SHARD_CHARS, LOCAL_WORDS = 2048, 1024, 20_000, 8192, 100_000

# Within these characters, lower-casing, letters, digits and white space mean
# the same to Python and to the tokenizer, and NFC changes nothing.
_PLAIN = re.compile("[\t-\r\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class BestFit:
    """A fixed number of open bins. Bit f of ``free`` says that an open bin has
    f places left; the lowest bit at or above an item's length is its best
    fit. When all bins are open, the fullest closes first."""

    def __init__(self, size: int = LENGTH, open_bins: int = OPEN_BINS) -> None:
        self.size, self.most = size, open_bins
        self.free, self.bins, self.open, self.made = 0, {}, 0, 0

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.pop()
        if not held:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def add(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next item."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - space


@lru_cache(maxsize=2)
def _document_ids(path: str):
    """A function that gives the ids of each text as little-endian bytes.

    White space ends every token, so each distinct run of other characters is
    encoded once and joined by position; a new run is cut where the
    pre-tokenizer cuts it, and each distinct part goes through the library's
    BPE model once. Texts with unusual characters or special strings go to the
    library whole. The tables stay with the Python worker.
    """
    runs: dict[str, bytes] = {}
    parts: dict[str, bytes] = {}
    model, letters = tokenizer(path).model, byte_letters()
    raw = lambda ids: np.asarray(ids, "<u4").tobytes()

    def encode_part(part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(letters)
        parts[part] = out = raw([t.id for t in model.tokenize(shown)])
        return out

    def encode_run(run: str) -> bytes:
        runs[run] = out = b"".join([parts.get(p) or encode_part(p) for p in _PARTS.findall(run)])
        return out

    def encode_texts(texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if "<|" in text or not _PLAIN.fullmatch(text):
                yield raw(tokenizer(path).encode(text, add_special_tokens=False).ids)
                continue
            if len(runs) > LOCAL_WORDS:
                runs.clear()
            if len(parts) > 2 * LOCAL_WORDS:
                parts.clear()
            yield b"".join([runs.get(w) or encode_run(w) for w in text.lower().split()])

    return encode_texts


def document_pieces(docs: DataFrame, path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, uid, piece, start, length, ids_crc32, ids): each document's ids
    and a final id 0, cut where they pass ``size``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = _document_ids(path)
        for pdf in frames:
            for part in text_batches(pdf, "text", 1 << 20):
                out = []
                for doc, uid, ids in zip(part["doc_id"], part["uid"], ids_of([t or "" for t in part["text"]]), strict=True):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        out.append((doc, uid, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pd.DataFrame(out, columns=["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    return rows.mapInPandas(lean(run), "doc_id long, uid long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, size: int = LENGTH, open_bins: int = OPEN_BINS, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of ``size`` ids fill a sequence; every other piece goes into the
    open bin with the least room that still holds it. Pieces are dealt by hash
    into shards for about ``shard_rows`` documents each (or fewer, longer than
    SHARD_CHARS characters on average); a shard packs its
    pieces with its own bins online, in the order of their hashes, so long and
    short pieces meet while bins are open however the table is ordered.
    A null or empty text is the single id 0. Repeated rows are packed each;
    other columns are ignored; an empty table gives no rows. A text of any
    length is encoded whole; its ids are held at once and its pieces are rows.
    """
    small_batches(docs.sparkSession)
    whole = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-whole["n"] // shard_rows), -(-whole["chars"] // (shard_rows * SHARD_CHARS)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bins = BestFit(size, open_bins)
        pdf = pdf.sort_values(["hash", "uid", "piece"], kind="stable")
        placed = [bins.add(n) for n in pdf["length"].tolist()]
        first = int(key[0]) << 40
        return pdf.assign(sequence_id=[first + b for b, _ in placed], offset=[o for _, o in placed])[names]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    pieces = document_pieces(docs, path, size, id_col, text_col).withColumn("hash", F.xxhash64("uid", "piece"))
    shard = F.pmod("hash", F.lit(shards)).cast("int")
    return pieces.groupBy(shard.alias("shard")).applyInPandas(run, schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
