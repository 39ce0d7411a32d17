"""Byte-level BPE encoding and decoding through a distinct-word table.

Words are split and counted in Spark; the frequent ones are encoded once each
into a table whose size has a fixed bound, and their ids are decoded through a
join with the id-to-piece table. Ids come back to a text by the position of
its words. A word outside the table occurs so rarely that a task encodes it
once for itself.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import cut, lean, small_batches, table, text_batches

TABLE_WORDS, WORD_BYTES, LOCAL_WORDS = 1 << 17, 64, 150_000
_ODD = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")

# Within these characters, letters, digits and white space mean the same to
# Python and to the pre-tokenizer.
_PLAIN = re.compile("[\t-\r\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def split_words(text: str) -> list[str]:
    """Cut before each single space that stands between two other characters.
    The pre-tokenizer always ends a piece there, whatever surrounds it."""
    parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
    words = parts[:1] if parts[0] else []
    words += [" " + p for p in parts[1:]]
    return words


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def encode(path: str, words: list[str]) -> list[list[int]]:
    """The library's ids of each word, without added tokens."""
    return [e.ids for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)] if words else []


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for
    themselves, the other bytes for U+0100 onwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    byte_of = {c: b for b, c in byte_letters().items()}
    tok = tokenizer(path)
    special = {i: t.content.encode() for i, t in tok.get_added_tokens_decoder().items()}
    out = [b""] * tok.get_vocab_size(with_added_tokens=True)
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        out[i] = special[i] if i in special else bytes(byte_of[c] for c in piece)
    return out


class LocalWords:
    """What a Python worker knows of words outside the shared table: (ids as
    text, number of ids, decoded bytes) of each. A new word is cut where the
    pre-tokenizer cuts it, and each distinct part goes through the library's
    BPE model once; a word with unusual characters goes to the library whole."""

    def __init__(self, path: str) -> None:
        self.path, self.words, self.parts = path, {}, {}
        self.model, self.letters, self.by_id = tokenizer(path).model, byte_letters(), pieces(path)

    def entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        return ",".join(map(str, ids)), len(ids), b"".join([self.by_id[i] for i in ids])

    def part(self, part: str) -> tuple[str, int, bytes]:
        got = self.parts.get(part)
        if got is None:
            shown = part.encode().decode("latin-1").translate(self.letters)
            self.parts[part] = got = self.entry([t.id for t in self.model.tokenize(shown)])
        return got

    def word(self, word: str) -> tuple[str, int, bytes]:
        got = self.words.get(word)
        if got is None:
            if _PLAIN.fullmatch(word) and "<|" not in word:
                ids, n, back = zip(*map(self.part, _PARTS.findall(word)), strict=True)
                got = ",".join(ids), sum(n), b"".join(back)
            else:
                got = self.entry(tokenizer(self.path).encode(word, add_special_tokens=False).ids)
            self.words[word] = got
        return got

    def trim(self) -> None:
        if len(self.words) > LOCAL_WORDS:
            self.words.clear()
        if len(self.parts) > 2 * LOCAL_WORDS:
            self.parts.clear()


@lru_cache(maxsize=2)
def local_words(path: str) -> LocalWords:
    return LocalWords(path)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of the words that some task saw twice or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for pdf in frames:
            for text in pdf["text"]:
                seen.update(split_words(text or ""))
            if len(seen) > 4 * LOCAL_WORDS:
                yield frame(seen)
                seen = Counter()
        yield frame(seen)

    def frame(seen: Counter) -> pd.DataFrame:
        kept = [(w, n) for w, n in seen.items() if n > 1 and len(w) <= WORD_BYTES]
        return pd.DataFrame(kept, columns=["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInPandas(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words over the lowest threshold that at most ``most`` words reach;
    found from a histogram with eight bars to each doubling."""
    bar = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(bar.alias("bar")).count().collect()
    total, least = 0, float("inf")
    for row in sorted(rows, key=lambda r: -r["bar"]):
        total += row["count"]
        if total > most:
            break
        least = row["bar"]
    return counts.filter(bar >= least) if least != float("inf") else counts.limit(0)


def word_table(docs: DataFrame, path: str, text_col: str = "text", most: int = TABLE_WORDS) -> DataFrame:
    """(word, ids, decoded): the frequent distinct words, each encoded once,
    and what their ids decode to by the id-to-piece join."""
    counts = cut(word_counts(docs, text_col))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"word": pdf["word"], "ids": encode(path, pdf["word"].tolist())})

    words = cut(most_frequent(counts, most).select("word").mapInPandas(lean(run), "word string, ids array<int>"))
    by_id = docs.sparkSession.createDataFrame(pd.DataFrame({"id": np.arange(len(pieces(path)), dtype=np.int32), "piece": pieces(path)}), "id int, piece binary")
    decoded = (
        words.select("word", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(by_id), "id")  # as many rows as the vocabulary has
        .groupBy("word").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("hex")))).alias("p"))
        .select("word", F.unhex(F.array_join("p.hex", "")).alias("decoded"))
    )
    return words.join(decoded, "word")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """Encode every text and decode its ids again, one row per row of ``docs``.

    With ``digest`` the columns are doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by commas) and decoded_sha256; without, doc_id, ids and
    decoded. A null text reads as empty and has no ids. Special strings inside
    a text are handled as the library does by default. Repeated rows give a
    row each; other columns are ignored; an empty table gives no rows. A text of
    any length is encoded whole.
    """
    small_batches(docs.sparkSession)
    held = word_table(docs, path, text_col).toPandas()  # at most TABLE_WORDS short words
    known = {w: (",".join(map(str, i)), len(i), bytes(d)) for w, i, d in zip(held["word"], held["ids"], held["decoded"], strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast(known)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local, common = local_words(path), shared.value.get
        for pdf in frames:
            for part in text_batches(pdf, "text", 1 << 22):
                out = []
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    got = [common(w) or local.word(w) for w in split_words(text or "")]
                    local.trim()
                    ids, n, back = zip(*got, strict=True) if got else ((), (), ())
                    ids, back = ",".join(ids), b"".join(back).decode("utf-8", "replace")
                    if digest:
                        out.append((doc, sum(n), sha(ids.encode()), sha(back.encode("utf-8"))))
                    else:
                        out.append((doc, [int(i) for i in ids.split(",")] if ids else [], back))
                yield pd.DataFrame(out, columns=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(lean(run), schema)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
