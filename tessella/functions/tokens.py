"""Token counts, truncation and decoding with a tokenizer of the caller's.

A tokenizer turns texts into lists of (id, start, end): the token and the
characters of the text that it covers. Truncation cuts the text at the end of a
token, so what is left is a beginning of the text and no bytes are made up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tokens = list[tuple[int, int, int]]
WORDS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def library_tokenizer(path: str) -> tuple[Callable[[list[str]], list[Tokens]], Callable[[list[int]], str]]:
    """(encode, decode) of a tokenizer file; read once in each worker."""
    held: list = []

    def model():
        if not held:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
            held.append(made)
        return held[0]

    def encode(texts: list[str]) -> list[Tokens]:
        return [[(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)] for e in model().encode_batch(texts, add_special_tokens=False)]

    def head(texts: list[str], most: int) -> list[tuple[int, Tokens]]:
        """How many tokens each text has, and the first ``most``: the others
        are counted where they are and not made into Python objects."""
        out = []
        for e in model().encode_batch(texts, add_special_tokens=False):
            n = len(e)
            e.truncate(most)
            out.append((n, [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]))
        return out

    encode.head = head
    return encode, lambda ids: model().decode(ids, skip_special_tokens=False)


def cut_at(text: str, tokens: Tokens, most: int) -> tuple[int, str]:
    """(tokens kept, beginning of the text) with ``most`` tokens at most. A
    token that covers only part of a character cannot end the text: it goes
    with the others of that character."""
    if len(tokens) <= most:
        return len(tokens), text
    n = max(0, most)
    while n and tokens[n][1] < tokens[n - 1][2]:
        n -= 1
    return n, text[: tokens[n - 1][2]] if n else ""


def tokenised(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[Tokens]], most: int, decode: Callable[[list[int]], str] | None = None, size: int = 64) -> DataFrame:
    """(key, n_tokens, kept, truncated, decoded) for each row: the number of
    tokens, how many the truncated text has, that text and, with ``decode``,
    what the kept tokens decode to. An encoder with a ``head`` is asked for no
    more tokens than are kept, and the count. A null text is empty."""

    head = getattr(encode, "head", None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), size):
                part = pdf.iloc[start : start + size]
                texts = [t if isinstance(t, str) else "" for t in part[text]]
                out = []
                # One token more than is kept says where the last kept one ends.
                found = head(texts, max(0, most) + 1) if head else [(len(tokens), tokens) for tokens in encode(texts)]
                for t, (total, tokens) in zip(texts, found, strict=True):
                    n, cut = cut_at(t, tokens, most)
                    out.append((total, n, cut, decode([i for i, _, _ in tokens[:n]]) if decode else None))
                yield pd.DataFrame(out, columns=["n_tokens", "kept", "truncated", "decoded"]).assign(**{key: part[key].to_numpy()})[[key, "n_tokens", "kept", "truncated", "decoded"]]

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, n_tokens long, kept long, truncated string, decoded string")


def word_count(text: Column) -> Column:
    """Words and marks, without Python: the default tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0))


def word_truncated(text: Column, most: int) -> Column:
    """The beginning of a text with ``most`` words and marks at most."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\s*(?:{WORDS})"), F.lit(0))
    return F.coalesce(F.array_join(F.slice(pieces, 1, max(0, most)), ""), F.lit(""))
