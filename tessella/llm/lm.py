"""Language-model scores from a log-bilinear model trained with
noise-contrastive estimation.

The model predicts a word from the two before it: each context word's vector
goes through a matrix of its position, and their sum meets the vectors of the
classes and of the words. Classes are runs of words in order of frequency, about
as many as each has words. A word's probability is its class's, by a softmax
over all classes, times its own within the class, by a softmax over the words
of the class; both come from batched matrix products, and the probabilities of
all words sum to one. Words too rare for a vector share one item, inside which a
word has its smoothed relative frequency. Training is data-parallel: texts are
dealt by hash into shards and each shard learns from all its texts. The shards
are brought together several times in a round, row by row: a word's vector moves
by the sum of the moves that the shards made, divided by how many of them saw the
word often. So a word that each of many shards saw once or twice learns from all
of them, and one that all saw often is their mean. The step sizes are kept from
one time to the next. A task trains a lot of shards one after another and sums
their moves, so that one row for each word leaves it. The model does not depend
on partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import cut, lean, small_batches, split_of, table, text_batches
from tessella.llm.bpe import most_frequent

HEAD_WORDS, WORD_BYTES, LOCAL_WORDS = 1 << 17, 64, 400_000
# A word has a vector if it occurs MODEL_COUNT times or is among the
# LEAST_WORDS most frequent, and is one of the HEAD_WORDS that are broadcast.
MODEL_COUNT, LEAST_WORDS, SHARD_DOCUMENTS = 1000, 1024, 5000
WIDTH, NOISE, CLASS_NOISE, ROUNDS, BATCH, PAIRS, LEAST_STEPS = 32, 256, 64, 2, 1024, 1024, 32
# Shards meet PARTS times in a round, FAN lots of them at a time; a shard that saw
# a word OFTEN times counts half in how far its moves are divided. ROWS words or
# classes are brought together in one task. A lot is LOT shards, trained one after
# another in a task, or fewer while there are not LEAST_TASKS lots.
PARTS, FAN, OFTEN, ROWS, LOT, LEAST_TASKS = 4, 64, 5.0, 1024, 16, 12
SMOOTH, LIMIT, BLOCK = 0.1, 60.0, 256
END, OTHER = 0, 1
END_WORD = b"\n"  # no word holds white space


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased, without the end. bytes.split cuts at the
    six ASCII white-space bytes only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, with the end of each as a word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for pdf in frames:
            for text in pdf["text"]:
                seen.update(words_of(text))
                if len(seen) > LOCAL_WORDS:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen = Counter()
            seen[END_WORD] += len(pdf)
        if seen:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return docs.select("text").mapInPandas(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class LogBilinear:
    """Word vectors r, class vectors rc, position matrices c1 (the word before)
    and c2, biases b and bc. Scores of words and of classes are both learnt as
    log probabilities."""

    NAMES = ("r", "rc", "c1", "c2", "b", "bc")

    def __init__(self, unigram: np.ndarray, width: int = WIDTH, seed: int = 17) -> None:
        rng, words = np.random.default_rng(seed), len(unigram)
        self.size = max(2, int(np.ceil(np.sqrt(words))))
        self.of = np.arange(words) // self.size  # the class of each word
        classes = int(self.of[-1]) + 1
        self.p = np.maximum(unigram, 1e-9) / np.maximum(unigram, 1e-9).sum()
        self.pc = np.bincount(self.of, self.p)
        self.log_p, self.log_pc = np.log(self.p).astype(np.float32), np.log(self.pc).astype(np.float32)
        # Vectors stand beside their biases, with a column of zeros that makes
        # rows even, and the position matrices on each other, with rows of zeros
        # where those two columns meet them.
        self.tables = {n: np.zeros(shape, np.float32) for n, shape in {"w": (words, width + 2), "c": (classes, width + 2), "m": (2 * (width + 2), width)}.items()}
        self.named = self._views(self.tables)
        self.named["r"][:], self.named["rc"][:] = rng.normal(0, 0.1, (words, width)), rng.normal(0, 0.1, (classes, width))
        self.named["c1"][:] = self.named["c2"][:] = np.eye(width) * 0.5
        self.named["b"][:], self.named["bc"][:] = self.log_p, self.log_pc
        self.r, self.rc, self.c1, self.c2, self.b, self.bc = (self.named[n] for n in self.NAMES)
        self.rng = np.random.default_rng(seed + 1)
        self.sums, self.sums_c = np.cumsum(self.p), np.cumsum(self.pc)
        self.seen: dict[str, np.ndarray] | None = None

    @staticmethod
    def _views(tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The parameters by their names, as parts of the tables."""
        w, c, m = tables["w"], tables["c"], tables["m"]
        width = m.shape[1]
        return {"r": w[:, :width], "rc": c[:, :width], "c1": m[:width], "c2": m[width + 2 : -2], "b": w[:, width], "bc": c[:, width]}

    def state(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray] | None]:
        """The parameters and the sums of squares that size the steps."""
        return dict(self.named), self.seen and self._views(self.seen)

    def restored(self, state: tuple) -> LogBilinear:
        """This model with a copy of a state."""
        for n, x in state[0].items():
            self.named[n][:] = x
        if state[1] is not None:
            self.seen = self._unseen()
            for n, x in self._views(self.seen).items():
                x[:] = state[1][n]
        return self

    def _unseen(self) -> dict[str, np.ndarray]:
        return {n: np.full_like(x, 1e-8) for n, x in self.tables.items()}

    def learn(self, before2: np.ndarray, before: np.ndarray, word: np.ndarray, weight: np.ndarray, rate: float = 0.05, k: float = 25.0) -> None:
        """One NCE step: tell words from noise words, and their classes from
        noise classes. Scores count as log probabilities, so the noise side
        weighs k times the noise probability. A word that was drawn as noise
        several times has its errors computed once and weighed by how often."""
        w, c, m = self.tables.values()
        many, width, log_k = len(word), m.shape[1], np.float32(np.log(k))
        around, kind = np.column_stack([before, before2]).ravel(), self.of[word]
        context, rw, rk = w.take(around, 0).reshape(many, -1), w.take(word, 0), c.take(kind, 0)
        q = self._at_biases(many)
        q[:, :width] = context @ m
        share = (weight / weight.sum()).astype(np.float32)[:, None]
        eg = share * (_sigmoid(np.einsum("ij,ij->i", q, rw) - self.log_p[word] - log_k) - 1)[:, None]
        cg = share * (_sigmoid(np.einsum("ij,ij->i", q, rk) - self.log_pc[kind] - log_k) - 1)[:, None]
        # Noise words and noise classes side by side, in blocks that fit the cache.
        noise, times = self._drawn(self.sums, NOISE)
        noise_c, times_c = self._drawn(self.sums_c, CLASS_NOISE)
        side = np.concatenate([w.take(noise, 0), c.take(noise_c, 0)])
        side[:, width] -= np.concatenate([self.log_p[noise], self.log_pc[noise_c]]) + log_k
        each = np.concatenate([times * (k / NOISE), times_c * (k / CLASS_NOISE)]).astype(np.float32)[:, None]
        weighed, shared, dq, back = each * side, share * q, eg * rw, np.zeros_like(side)
        dq += cg * rk
        for s in range(0, many, BLOCK):
            bad = _sigmoid(q[s : s + BLOCK] @ side.T)
            dq[s : s + BLOCK] += share[s : s + BLOCK] * (bad @ weighed)
            back += bad.T @ shared[s : s + BLOCK]
        back *= each
        dq = dq[:, :width]
        of_words = np.concatenate([eg * q, (dq @ m.T).reshape(2 * many, width + 2), back[: len(noise)]])
        self._step("w", np.concatenate([word, around, noise]), of_words, rate)
        self._step("c", np.concatenate([kind, noise_c]), np.concatenate([cg * q, back[len(noise) :]]), rate)
        of_matrices = context.T @ dq
        of_matrices[[width, width + 1, -2, -1]] = 0
        self._step("m", None, of_matrices, rate)

    def _at_biases(self, rows: int) -> np.ndarray:
        """Room for what meets vectors, with ones where their biases are."""
        q = np.zeros((rows, self.tables["w"].shape[1]), np.float32)
        q[:, -2] = 1
        return q

    def _drawn(self, sums: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """``many`` draws by their probabilities: what was drawn and how often."""
        drawn = np.minimum(np.searchsorted(sums, np.sort(self.rng.random(many))), len(sums) - 1)
        starts = np.flatnonzero(np.concatenate([[True], drawn[1:] != drawn[:-1]]))
        return drawn[starts], np.diff(starts, append=many)

    def _step(self, name: str, at: np.ndarray | None, grad: np.ndarray, rate: float) -> None:
        """Adagrad on the rows ``at`` of a table, which may repeat, or on all."""
        if self.seen is None:
            self.seen = self._unseen()
        held, seen = self.tables[name], self.seen[name]
        if at is None:
            at = np.arange(len(held))
        else:
            order = np.argsort(at.astype(np.uint16) if len(held) <= 1 << 16 else at, kind="stable")  # 16 bits sort faster
            at = at[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sizes, at, rows = np.diff(starts, append=len(order)), at[starts], grad
            grad = rows.take(order[starts], 0)
            if (repeated := sizes > 1).any():
                several = rows.take(order[np.repeat(repeated, sizes)], 0).view(np.complex64)  # columns in twos: half the loops
                grad[repeated] = np.add.reduceat(several, np.cumsum(sizes[repeated]) - sizes[repeated], axis=0).view(np.float32)
        squares = seen.take(at, 0)
        squares += grad * grad
        seen[at] = squares
        grad /= np.sqrt(squares, out=squares)
        grad *= np.float32(rate)
        held[at] = held.take(at, 0) - grad

    def log_probabilities(self, before2: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logs of the normalised probabilities. Equal threes, equal
        contexts, and equal contexts with words of one class are summed once;
        in the order of the threes each of them stands together."""
        words = len(self.p)
        w, c, m = self.tables.values()
        grams, place = np.unique((before2 * words + before) * words + word, return_inverse=True)
        context, word = np.divmod(grams, words)
        kind = self.of[word]
        new = np.concatenate([[True], context[1:] != context[:-1]])[: len(grams)]
        new_pair = new | np.concatenate([[True], kind[1:] != kind[:-1]])[: len(grams)]
        at, pair, contexts = np.cumsum(new) - 1, np.cumsum(new_pair) - 1, context[new]
        q, z = self._at_biases(len(contexts)), np.empty(len(contexts), np.float32)
        for s in range(0, len(contexts), PAIRS):
            b2, b1 = np.divmod(contexts[s : s + PAIRS], words)
            q[s : s + PAIRS, :-2] = w.take(np.column_stack([b1, b2]).ravel(), 0).reshape(len(b1), -1) @ m
            z[s : s + PAIRS] = _log_sum(q[s : s + PAIRS] @ c.T)
        pair_at, pair_class = at[new_pair], kind[new_pair]
        by_class = np.argsort(pair_class.astype(np.uint16), kind="stable")  # there are about 2**9 classes at most
        edges = np.searchsorted(pair_class[by_class], np.arange(len(c) + 1))
        of_pair = np.empty(len(pair_at), np.float32)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own, of_class = w[k * self.size : (k + 1) * self.size].T, c[k]
            for s in range(edges[k], edges[k + 1], PAIRS):
                pairs = by_class[s : min(s + PAIRS, edges[k + 1])]
                near = q.take(pair_at[pairs], 0)
                of_pair[pairs] = _clip(near @ of_class) - z[pair_at[pairs]] - _log_sum(near @ own)
        out = np.empty(len(grams), np.float32)
        for s in range(0, len(grams), 4 * PAIRS):
            some = slice(s, s + 4 * PAIRS)
            out[some] = of_pair[pair[some]] + _clip(np.einsum("ij,ij->i", q.take(at[some], 0), w.take(word[some], 0)))
        return out[place]


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -LIMIT, LIMIT)


def _log_sum(scores: np.ndarray) -> np.ndarray:
    """log of the sum of exp by row; LIMIT keeps exp within single precision."""
    np.clip(scores, -LIMIT, LIMIT, out=scores)
    return np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of an array that nobody else needs, which is overwritten."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / inf is 0, as it should be
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _ids(text: str | None, place: dict[bytes, int]) -> np.ndarray:
    """The model's ids of the words of a text and of its end."""
    words = words_of(text)
    words.append(END_WORD)
    return np.fromiter(map(place.get, words, repeat(OTHER)), np.uint32, len(words))


def _contexts(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(two before, before) of every token of texts of these sizes; before its
    start a text has ends."""
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([[END], flat[:-1]])
    before2 = np.concatenate([[END, END], flat[:-2]])[: len(flat)]
    before[first] = END
    before2[first] = END
    before2[np.minimum(first + 1, len(flat) - 1)[sizes > 1]] = END
    return before2, before


def dealt(docs: DataFrame, place: dict[bytes, int], shards: int, lot: int = 1) -> DataFrame:
    """(shard, part, h, doc_id, ids): each text as ids, dealt by a hash of id and
    text. ``lot`` shards that follow each other are one partition."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"h": pdf["h"], "doc_id": pdf["doc_id"], "ids": [_ids(t, shared.value).tobytes() for t in pdf["text"]]})

    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text").mapInPandas(lean(run), "h long, doc_id long, ids binary")
    return rows.select(F.pmod(F.shiftright("h", 7), F.lit(shards)).cast("int").alias("shard"), F.pmod("h", F.lit(PARTS)).cast("int").alias("part"), "h", "doc_id", "ids").repartitionById(-(-shards // lot), F.floor(F.col("shard") / lot).cast("int"))


# What a lot of shards moved. kind: w (word vectors and biases), c (class vectors
# and biases) or m (both matrices, one row). Of each row of a block its id, its
# moves, what they are to be divided by and the roots of what its step sizes
# gained; raw rows are of one lot and of half precision, others are sums.
MOVES = "kind string, block int, lot long, shards long, raw boolean, ids binary, seen binary, moves binary, gains binary"
KINDS = {"w": ("r", "b"), "c": ("rc", "bc"), "m": ("c1", "c2")}


def _table(values: dict[str, np.ndarray], kind: str) -> np.ndarray:
    """The rows of a kind, one matrix; the matrices of the positions are one row."""
    parts = [values[n] for n in KINDS[kind]]
    return np.concatenate([x.ravel() for x in parts])[None] if kind == "m" else np.column_stack(parts)


class _Moves:
    """The sums of what the shards of a lot moved, made in the task that trains
    them, so that one row for each word leaves it and not one for each shard.
    Moves of the matrices weigh by tokens; the others are added, and what they
    are divided by is added beside them, by how often a shard saw the row."""

    def __init__(self, before: LogBilinear) -> None:
        self.old, seen = before.state()
        self.base = seen or {n: np.full_like(x, 1e-8) for n, x in self.old.items()}
        self.of, self.shards, self.sums = before.of, 0, {}
        for kind in KINDS:
            rows, width = _table(self.old, kind).shape
            self.sums[kind] = np.zeros(rows), np.zeros((rows, width)), np.zeros((rows, width))

    def add(self, counts: np.ndarray, after: LogBilinear) -> None:
        new, sizes = after.state()
        self.shards += 1
        for kind, (seen, moves, gains) in self.sums.items():
            step = _table(new, kind) - _table(self.old, kind)
            moved = np.abs(step).max(1) > 0
            often = {"w": counts, "c": np.bincount(self.of, counts), "m": np.array([counts.sum()])}[kind].astype(float)
            seen += moved * (often if kind == "m" else often / (often + OFTEN) + 1e-12)
            moves += step * often if kind == "m" else step
            gains += moved[:, None] * np.maximum(_table(sizes, kind) - _table(self.base, kind), 0)

    def rows(self, lot: int) -> pd.DataFrame:
        """The sums in blocks of rows; rows that did not move are left out."""
        out = []
        for kind, (seen, moves, gains) in self.sums.items():
            at = np.flatnonzero(seen > 0)
            edges = np.searchsorted(at, np.arange(0, len(seen) + ROWS, ROWS))
            for block, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    own = at[a:b]
                    step = moves[own] / seen[own, None] if kind == "m" else moves[own]
                    out.append((kind, block, lot, self.shards, True, own.astype(np.uint32).tobytes(), seen[own].tobytes(), step.astype(np.float16).tobytes(), np.sqrt(gains[own]).astype(np.float16).tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MOVES.split(", ")])


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of each block over its lots, FAN of them in a group; rows come
    sorted."""
    key, held = None, None
    names = [c.split()[0] for c in MOVES.split(", ")]

    def result() -> pd.DataFrame:
        ids, seen, moves, gains, shards = held
        at = np.flatnonzero(seen != 0)
        row = (*key, shards, False, ids[at].astype(np.uint32).tobytes(), seen[at].tobytes(), moves[at].astype(np.float32).tobytes(), gains[at].astype(np.float32).tobytes())
        return pd.DataFrame([row], columns=names)

    for pdf in frames:
        for kind, block, lot, shards, raw, ids, seen, moves, gains in pdf[names].itertuples(index=False):
            if key != (kind, block, lot // FAN):
                if key is not None:
                    yield result()
                key, held = (kind, block, lot // FAN), None
            own, often = np.frombuffer(ids, np.uint32).astype(int), np.frombuffer(seen, np.float64)
            step, gain = (np.frombuffer(x, np.float16 if raw else np.float32).astype(np.float64).reshape(len(own), -1) for x in (moves, gains))
            if raw:
                gain = gain**2
                if kind == "m":
                    step = step * often[:, None]
            if held is None:
                held = [block * ROWS + np.arange(ROWS), np.zeros(ROWS), np.zeros((ROWS, step.shape[1])), np.zeros((ROWS, step.shape[1])), 0]
            place = own - block * ROWS
            held[1][place] += often
            held[2][place] += step
            held[3][place] += gain
            held[4] += shards
    if key is not None:
        yield result()


def _brought_together(model: LogBilinear, moved: list, shards: int) -> LogBilinear:
    """The model after the summed moves of all shards."""
    params, seen = model.state()
    seen = seen or {n: np.full_like(x, 1e-8) for n, x in params.items()}
    for kind, names in KINDS.items():
        now, size = _table(params, kind), _table(seen, kind)
        for r in moved:
            if r["kind"] == kind:
                ids, often = np.frombuffer(r["ids"], np.uint32).astype(int), np.frombuffer(r["seen"], np.float64)
                step, gain = (np.frombuffer(r[c], np.float32).reshape(len(ids), -1) for c in ("moves", "gains"))
                now[ids] += step / (often if kind == "m" else np.maximum(1, often))[:, None]
                size[ids] += gain / shards
        for table_, into in ((now, params), (size, seen)):
            if kind == "m":
                half = table_.shape[1] // 2
                parts = [table_[0, :half].reshape(into[names[0]].shape), table_[0, half:].reshape(into[names[1]].shape)]
            else:
                parts = [table_[:, :-1], table_[:, -1]]
            for name, x in zip(names, parts, strict=True):
                into[name] = np.ascontiguousarray(x, np.float32)
    return model.restored((params, seen))


def train(docs: DataFrame, place: dict[bytes, int], unigram: np.ndarray, rounds: int = ROUNDS, shard_documents: int = SHARD_DOCUMENTS) -> LogBilinear:
    """Learn from every text of ``docs`` (doc_id, text), ``rounds`` times. The
    texts of a shard come in PARTS parts; each shard trains a copy of the model
    on a part, then the copies are brought together. Equal threes of words
    within 2**20 tokens are learnt once, by their number; where they are few they
    are learnt again, LEAST_STEPS steps in all."""
    spark = docs.sparkSession
    model, words = LogBilinear(unigram), len(unigram)
    shards = -(-docs.count() // shard_documents) or 1
    lot = min(max(1, shards // LEAST_TASKS), LOT)
    dealt_rows = cut(dealt(docs, place, shards, lot))

    for number in range(rounds * PARTS):
        shared = spark.sparkContext.broadcast((model.state(), unigram))
        rate = 0.05 / (1 + number // PARTS)

        def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[np.ndarray]]]:
            """Texts of one shard at a time, about 2**20 tokens each time."""
            shard, held, tokens = None, [], 0
            for pdf in frames:
                for at, ids in zip(pdf["shard"].tolist(), pdf["ids"], strict=True):
                    if held and (at != shard or tokens > 1 << 20):
                        yield shard, held
                        held, tokens = [], 0
                    shard = at
                    held.append(np.frombuffer(ids, np.uint32))
                    tokens += len(held[-1])
            if held:
                yield shard, held

        def learn(frames: Iterator[pd.DataFrame], shared=shared, number=number, rate=rate) -> Iterator[pd.DataFrame]:
            state, base = shared.value
            before, own, counts, shard, moves = LogBilinear(base).restored(state), None, None, None, None
            for at, texts in parts(frames):
                if at != shard:
                    if own is not None:
                        moves.add(counts, own)
                    if own is None or at // lot != shard // lot:
                        if own is not None:
                            yield moves.rows(shard // lot)
                        moves = _Moves(before)
                    own, counts, shard = LogBilinear(base, seed=17 + at + number * 1_000_003).restored(state), np.zeros(words, np.int64), at
                w = np.concatenate(texts).astype(np.int64)
                b2, b1 = _contexts(w, np.array([len(t) for t in texts], np.int64))
                grams, n = np.unique((b2 * words + b1) * words + w, return_counts=True)
                counts += np.bincount(w, minlength=words)
                for _ in range(-(-LEAST_STEPS // -(-len(grams) // BATCH))):
                    order = own.rng.permutation(len(grams))
                    for s in range(0, len(grams), BATCH):
                        g = grams[order[s : s + BATCH]]
                        own.learn(g // (words * words), g // words % words, g % words, n[order[s : s + BATCH]].astype(np.float32), rate)
            if own is not None:
                moves.add(counts, own)
                yield moves.rows(shard // lot)

        some = dealt_rows.filter(F.col("part") == number % PARTS).sortWithinPartitions("shard", "h", "doc_id")
        moved, groups = some.mapInPandas(lean(learn), MOVES), 0
        while groups != 1:  # a tree: FAN lots, or sums of them, become one
            groups = -(-(groups or -(-shards // lot)) // FAN)
            moved = moved.repartition("kind", "block", F.floor(F.col("lot") / FAN)).sortWithinPartitions("kind", "block", "lot").mapInPandas(lean(_gathered), MOVES)
        got = moved.collect()  # one row for each block
        if got:
            model = _brought_together(model, got, max(r["shards"] for r in got if r["kind"] == "m"))
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Learns from the documents that are not held out. Tokens are the words and
    one end. base_score is the smoothed unigram log10 probability, score the
    model's. A null text reads as empty and is its end only. Repeated rows
    give a row each; other columns are ignored; an empty table gives no rows. A
    text of any length is learnt from and scored whole; its words are held at once.
    Frequent words are looked up in a broadcast table of HEAD_WORDS at most;
    the others are joined with their counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(split_of(id_col, 10) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    learnt = rows.filter(~F.col("held_out"))
    counts = cut(word_counts(learnt))
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    head = most_frequent(counts.filter(F.length("word") <= WORD_BYTES), HEAD_WORDS).toPandas()  # at most HEAD_WORDS short words
    held = {bytes(w): int(n) for w, n in zip(head["word"], head["n"], strict=True)}
    ranked = sorted((w for w in held if w != END_WORD), key=lambda w: (-held[w], w))
    ranked = [w for i, w in enumerate(ranked) if i < LEAST_WORDS - 2 or held[w] >= MODEL_COUNT]
    place = {END_WORD: END} | {w: i + 2 for i, w in enumerate(ranked)}
    own = np.zeros(len(ranked) + 2)
    own[END] = held.get(END_WORD, 0)
    own[2:] = [held[w] for w in ranked]
    own[OTHER] = max(total - own.sum(), 1.0)
    model = train(learnt, place, own)
    # Within the class of other words: smoothed counts, and one place for the unseen.
    inside = max(total - (own.sum() - own[OTHER]), 0) + SMOOTH * (distinct - len(place) + 1)
    whole = total + SMOOTH * (distinct + 1)
    shared = spark.sparkContext.broadcast((held, place, model.state()[0], own))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, place, params, own = shared.value
        m = LogBilinear(own).restored((params, None))
        ln10, log_whole, log_inside = np.log(10), np.log10(whole), np.log10(inside)
        index = {w: i for i, w in enumerate(held)}
        # Of each held word, and last of any other: log of its smoothed count, model id.
        log_count = np.append(np.log10(np.fromiter(held.values(), float, len(held)) + SMOOTH), 0.0)
        model_id = np.append(np.fromiter((place.get(w, OTHER) for w in held), np.int64, len(held)), OTHER)
        for pdf in frames:
            for part in text_batches(pdf, "text", 1 << 22):
                texts = [words_of(t) for t in part["text"]]
                for t in texts:
                    t.append(END_WORD)
                flat, sizes = list(chain.from_iterable(texts)), np.array([len(t) for t in texts], np.int64)
                at = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
                ids, owner = model_id[at], np.repeat(np.arange(len(texts)), sizes)
                per_text = lambda x, owner=owner, n=len(texts): np.bincount(owner, x, n)
                other = ids == OTHER
                score = per_text(m.log_probabilities(*_contexts(ids, sizes), ids) / ln10) + per_text(log_count[at] * other) - per_text(other) * log_inside
                base, known = per_text(log_count[at]) - sizes * log_whole, per_text(at >= 0)
                doc = pd.DataFrame({"uid": part["uid"], "word": [b"\n%d" % u for u in part["uid"]], "k": 1, "doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"].astype("boolean"), "n_tokens": sizes, "n_known": known.astype(np.int64), "base": base, "score": score})
                unheld = np.flatnonzero(at < 0)
                rare = Counter(zip(owner[unheld].tolist(), map(flat.__getitem__, unheld.tolist()), strict=True))
                uids = part["uid"].to_numpy()
                yield doc[names]
                if rare:
                    no, gone = np.zeros(len(rare), np.int64), np.ones(len(rare), bool)
                    none = pd.arrays.IntegerArray(no, gone)
                    rest = pd.DataFrame({"uid": uids[[o for o, _ in rare]], "word": [w for _, w in rare], "k": list(rare.values()), "doc_id": none, "held_out": pd.arrays.BooleanArray(no.astype(bool), gone), "n_tokens": none, "n_known": none, "base": np.nan, "score": np.nan})
                    yield rest[names]

    schema = "uid long, word binary, k long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    parts = rows.withColumn("uid", F.monotonically_increasing_id()).mapInPandas(lean(run), schema)
    joined = parts.join(counts, "word", "left")  # a document's own row has a word that no text holds
    rare = F.when(F.col("n_tokens").isNull(), F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH)))
    known = F.when(F.col("n_tokens").isNull() & F.col("n").isNotNull(), F.col("k"))
    return (
        joined.groupBy("uid").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            (F.max("n_known") + F.coalesce(F.sum(known), F.lit(0))).alias("n_known"),
            F.max("base").alias("base"), F.max("score").alias("own"), F.coalesce(F.sum(rare), F.lit(0.0)).alias("rare"),
        )
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.col("rare")).alias("base_score"), (F.col("own") + F.col("rare")).alias("score"),
        )
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
