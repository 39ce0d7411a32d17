"""Token counts with a finite-state tokenizer.

The merge rules of a piece vocabulary are compiled into a deterministic
transducer over characters: a state holds, for every suffix that may still
grow into a piece, the last token before that suffix and its count relative to
now; a transition carries the number of tokens it adds to the count. States
are determinised when first reached and kept in a table, so a text costs one
table look-up a character. Long texts are cut into chunks anywhere. A chunk's
state map is constant after its first hard boundary (two characters that no
piece holds side by side), so it is kept as (head before that boundary, count,
tail after the last one): from any state it runs the head, adds the count and
ends in the state after the tail. Such maps compose (the middle is the count of
tail + head) in any grouping, so the chunks of a text are folded as a tree:
each round joins FAN neighbours, all groups at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import lean, small_batches, table, text_batches

CHUNK, BATCH, LANE, FAN = 1 << 16, 1 << 22, 1 << 10, 16
SPACE = "▁"


class CountTransducer:
    """Counts the tokens that the library gives for a BPE piece model with
    byte fallback, without normalisation, with a dummy space in front."""

    MOST_STATES = 300_000
    SHIFT, BIAS = 11, 1 << 10

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.pieces[sp.id_to_piece(i)] = sp.get_score(i)
        self.growing = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.active = {c for pair in self.pairs for c in pair}
        self.fits: dict[tuple[str, str], bool] = {}
        self.columns: dict[object, int] = {}  # an active character, or the tokens of any other
        self.column_of = np.full(0x110000, -1, np.int16)
        self.labels: list[object] = []
        self._column(0)
        self._forget()

    # -- compilation -----------------------------------------------------
    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.table = np.full((1 << 12, max(64, len(self.labels))), -1, np.int32)
        self.start = self._state((("", "", 0),))

    def _column(self, label: object) -> int:
        if label not in self.columns:
            self.columns[label] = len(self.labels)
            self.labels.append(label)
        return self.columns[label]

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merge rule itself."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                score = self.pieces.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` as a token of its own."""
        if not left or left[-1] + right[0] not in self.pairs:
            return self._alone(right)
        if (left, right) not in self.fits:
            self.fits[left, right] = self.merged(left + right) == [left, right]
        return self.fits[left, right]

    def _alone(self, piece: str) -> bool:
        if ("", piece) not in self.fits:
            self.fits["", piece] = self.merged(piece) == [piece]
        return self.fits["", piece]

    def _step(self, state: int, label: object) -> tuple[int, int]:
        if not isinstance(label, str):
            return (state, 0) if label == 0 else (self.start, int(label))
        grown = [(s + label, last, n) for s, last, n in self.keys[state]]
        token = added = None
        for s, last, n in grown:
            if s in self.pieces and self._fit(last, s):
                token, added = s, n + 1
                break
        if token is None:
            raise ValueError(f"no token ends at {label!r}")
        key = []
        for s, last, n in grown:
            if s in self.growing:
                key.append((s, last if last and last[-1] + s[0] in self.pairs else "", n - added))
        return self._state((*key, ("", token, 0))), added

    def _fill(self, states: np.ndarray, columns: np.ndarray) -> None:
        wide = len(self.labels)
        for pair in np.unique(states.astype(np.int64) * wide + columns).tolist():
            state, column = divmod(pair, wide)
            target, added = self._step(state, self.labels[column])
            if not -self.BIAS <= added < self.BIAS or target >= 1 << 20:
                raise OverflowError(f"a transition adds {added} tokens on the way to state {target}")
            if target >= len(self.table) or wide > self.table.shape[1]:
                grown = np.full((max(len(self.table), 2 * target), max(self.table.shape[1], wide + 32 if wide > self.table.shape[1] else 0)), -1, np.int32)
                grown[: len(self.table), : self.table.shape[1]] = self.table
                self.table = grown
            self.table[state, column] = (target << self.SHIFT) | (added + self.BIAS)

    # -- texts -----------------------------------------------------------
    def encode(self, text: str) -> np.ndarray:
        """The column of each character; a space is the space mark."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        columns = self.column_of[codes]
        if (columns < 0).any():
            for code in np.unique(codes[columns < 0]).tolist():
                c = SPACE if code == 32 else chr(code)
                label = c if c in self.active else 1 if c in self.pieces else len(c.encode("utf-8", "surrogatepass"))
                self.column_of[code] = self._column(label)
            columns = self.column_of[codes]
        return columns

    def boundaries(self, columns: np.ndarray) -> np.ndarray:
        """True where no piece holds the character and the one before it."""
        if getattr(self, "_known", 0) != len(self.labels):
            self._known = len(self.labels)
            self._hard = np.array([[not (isinstance(a, str) and isinstance(b, str) and a + b in self.pairs) for b in self.labels] for a in self.labels])
        out = np.ones(len(columns), bool)
        out[1:] = self._hard[columns[:-1], columns[1:]]
        return out

    def run(self, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each lane columns[starts[i]:starts[i+1]], all from the
        start state, one step of all lanes at a time."""
        if len(self.keys) > self.MOST_STATES:
            self._forget()
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[:-1][order].copy(), lengths[order]
        state, total = np.full(len(at), self.start, np.int64), np.zeros(len(at), np.int64)
        live = len(at)
        for step in range(int(left[0]) if live else 0):
            while live and left[live - 1] <= step:
                live -= 1
            s, c = state[:live], columns[at[:live] + step]
            if len(self.labels) > self.table.shape[1]:
                self._fill(s[:1], c[:1])
            packed = self.table[s, c]
            if (miss := packed < 0).any():
                self._fill(s[miss], c[miss])
                packed = self.table[s, c]
            total[:live] += (packed & ((1 << self.SHIFT) - 1)) - self.BIAS
            state[:live] = packed >> self.SHIFT
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out

    def count(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part; every part starts at a boundary."""
        if not any(parts):
            return np.zeros(len(parts), np.int64)
        columns = self.encode("".join(parts))
        ends = np.cumsum([len(p) for p in parts])
        hard = self.boundaries(columns)
        hard[ends[ends < len(columns)]] = True
        # Lanes: cut at the part ends, and at the first boundary after every LANE characters.
        cuts = np.flatnonzero(hard)
        wanted = cuts[np.unique(np.searchsorted(cuts, np.arange(0, len(columns), LANE)).clip(max=len(cuts) - 1))]
        starts = np.unique(np.concatenate([[0], ends, wanted]))
        sums = np.concatenate([[0], np.cumsum(self.run(columns, starts))])
        at = sums[np.searchsorted(starts, ends)]
        return np.diff(np.concatenate([[0], at]))

    def chunk_map(self, chunk: str) -> tuple[str, str | None]:
        """(head, rest): the characters before the first hard boundary inside
        the chunk, and those after it, None without such a boundary."""
        cuts = np.flatnonzero(self.boundaries(self.encode(chunk))[1:]) + 1
        return (chunk, None) if not len(cuts) else (chunk[: cuts[0]], chunk[cuts[0] :])

    def tail_of(self, rest: str) -> int:
        """Where the last hard boundary of ``rest`` is."""
        return int(np.flatnonzero(self.boundaries(self.encode(rest)))[-1])


@lru_cache(maxsize=2)
def transducer(model_path: str) -> CountTransducer:
    return CountTransducer(model_path)


def _short(model_path: str, over: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for pdf in frames:
            for part in text_batches(pdf, "text", BATCH):
                texts = part["text"].tolist()
                n = machine.count([SPACE + t if t else "" for t in texts])
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": n > over})

    return run


def _maps(model_path: str):
    """State map of each chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for pdf in frames:
            out = []
            for doc, uid, part, text in zip(pdf["doc_id"], pdf["uid"], pdf["part"], pdf["text"], strict=True):
                marked = SPACE + text if part == 0 else text
                head, rest = machine.chunk_map(marked)
                inner, tail = 0, None
                if rest is not None:
                    at = machine.tail_of(rest)
                    inner, tail = int(machine.count([rest[:at]])[0]), rest[at:]
                out.append((doc, uid, part, len(text.encode("utf-8", "surrogatepass")), head, inner, tail))
            yield pd.DataFrame(out, columns=["doc_id", "uid", "part", "n_bytes", "head", "inner", "tail"])

    return run


def _joined(machine: CountTransducer, a: tuple, b: tuple) -> tuple:
    """The state map (head, inner, tail) of two neighbours."""
    if a[2] is None:
        return a[0] + b[0], b[1], b[2]
    if b[2] is None:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + int(machine.count([a[2] + b[0]])[0]) + b[1], b[2]


def _folded(model_path: str):
    """Join the maps of FAN neighbours, in order."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        machine = transducer(model_path)
        pdf = pdf.sort_values("part")
        maps = list(zip(pdf["head"], pdf["inner"].tolist(), pdf["tail"], strict=True))
        head, inner, tail = reduce(lambda a, b: _joined(machine, a, b), maps)
        doc = pd.array([pdf["doc_id"].iloc[0]], dtype="Int64")
        return pd.DataFrame({"doc_id": doc, "uid": pdf["uid"].iloc[:1].array, "part": [int(pdf["part"].iloc[0]) // FAN], "n_bytes": [int(pdf["n_bytes"].sum())], "head": [head], "inner": [inner], "tail": [tail]})

    return run


def _ended(model_path: str, over: int):
    """The counts of whole texts from their maps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for pdf in frames:
            ends = [(h, t or "") for h, t in zip(pdf["head"], pdf["tail"], strict=True)]
            n = pdf["inner"].to_numpy(np.int64) + machine.count([x for e in ends for x in e]).reshape(-1, 2).sum(1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": n, "over_limit": n > over})

    return run


def token_counts(docs: DataFrame, model_path: str, over: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens. Repeated rows and ids give
    a row each; other columns are ignored; an empty table gives no rows. Texts
    over ``chunk`` characters are cut into chunks that are mapped apart; only
    the maps are shuffled. A text without any hard boundary is its own map.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= chunk).mapInPandas(lean(_short(model_path, over)), schema)
    most = rows.agg(F.max(F.length("text")).alias("n")).first()["n"] or 0
    if most <= chunk:
        return short
    long_ = rows.filter(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    parts = long_.select(
        "doc_id", "uid", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("part")
    ).select("doc_id", "uid", "part", F.substring(F.col("text"), F.col("part") * chunk + 1, F.lit(chunk)).alias("text"))
    of_map = "doc_id long, uid long, part int, n_bytes long, head string, inner long, tail string"
    maps, width = parts.mapInPandas(lean(_maps(model_path)), of_map), -(-most // chunk)
    while width > 1:
        maps = maps.groupBy("uid", F.floor(F.col("part") / FAN)).applyInPandas(_folded(model_path), of_map)
        width = -(-width // FAN)
    return short.unionByName(maps.mapInPandas(lean(_ended(model_path, over)), schema))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
