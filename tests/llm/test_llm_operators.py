"""The training-data operators against brute force, on the small tables and on
fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
import public_tokenizers
from compare import same
from pyspark.sql import functions as F

from tessella.llm import _words, bpe, chat, exact, langid, lm, neardup, ngramjoin, packing, queries, tokencount, toxicity
from tessella.llm._components import components, restore_ids, shuffle_ids

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "a", "A", "a", "été déjà vu", "x" * 5000, "w " * 3000, "日本語 text\twith\x0bspace", "<|endoftext|> in it", "1234 !!", "the the the the the", "it's we'LL  double  \n\n end "]


def odd_documents(spark, texts=ODD):
    """Texts with a clashing set of extra columns, a null id and repeated rows."""
    rows = [(i, t, None if i % 3 else "en", f"s{i}", 0, 1.5, "c", 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", "en", "s", 0, 0.0, "c", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, n_tokens int")


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


# -- op1 -------------------------------------------------------------------
def piece_counts(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [len(x) for x in sp.encode([t or "" for t in texts])]


def test_token_counts_match_the_library(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in tokencount.op1_token_counts(spark, sf_dir).collect()}
    want = piece_counts([t for _, t in docs])
    assert [got[i]["n_tokens"] for i, _ in docs] == want
    assert all(got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (n > 4096) for (i, t), n in zip(docs, want))


@pytest.mark.parametrize("chunk", [7, 50, 1000])
def test_chunk_maps_compose(spark, chunk):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = [t for t in ODD if t] + ["a" * 99, "====" * 30, "▁▁ ▁x" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in tokencount.token_counts(df, model, chunk=chunk).collect()}
    assert got == {i: (n, len(t.encode())) for i, (t, n) in enumerate(zip(texts, piece_counts(texts)))}


def test_token_counts_edge_cases(spark):
    df, model = odd_documents(spark), public_tokenizers.path("piece_bpe_32k.model")
    rows = df.collect()
    want = sorted(((r["doc_id"], n, len((r["text"] or "").encode())) for r, n in zip(rows, piece_counts([r["text"] for r in rows]))), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in tokencount.token_counts(df, model).collect()), key=str) == want
    assert tokencount.token_counts(df.limit(0), model).count() == 0


def test_transducer_on_random_texts():
    machine = tokencount.CountTransducer(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    pool = [p.replace("▁", " ") for p in list(machine.pieces)[::37]] + list(" \n\t é日€😀\x00▁") + ["</s>", "<0x0A>", "====", "    "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(800)]
    assert machine.count(["▁" + t if t else "" for t in texts]).tolist() == piece_counts(texts)


# -- op2 -------------------------------------------------------------------
def brute_links(rows):
    units = [neardup.unit(v) for _, v, _ in rows]
    linked, sets = collections.Counter(), Sets()
    for i, (a, _, la) in enumerate(rows):
        for j, (b, _, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= neardup.COSINE:
                linked[i] += 1
                sets.link(a, b)
    return [(a, linked[i], sets.root(a), sets.root(a) == a) for i, (a, _, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, rows[0][1], None), (504, [1.0, 2.0], 1), (505, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n": F.lit(1), "x": F.lit("clash"), "key": F.lit(2)})
    got = sorted(tuple(r) for r in neardup.near_duplicates(df).collect())
    want = sorted(brute_links([(i, None if v is None else [float(np.float32(x)) for x in v], c) for i, v, c in rows]))
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found >= 0.97 * all_ and found <= all_
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [g for g, w in zip(got, want) if w[1] == 0] == [w for w in want if w[1] == 0]


def test_near_duplicates_across_cells(spark, monkeypatch):
    """Partners just above the cosine, in eleven cells: every link, from both its ends."""
    monkeypatch.setattr(neardup, "CELL", 500, raising=False)
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2750, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([a, 0.932 * a + np.sqrt(1 - 0.932**2) * side]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(e) for e in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = np.stack([neardup.unit(v) for v in x])
    linked = (u @ u.T >= neardup.COSINE) & ~np.eye(len(u), dtype=bool)
    sets = Sets()
    for i, j in zip(*np.nonzero(linked), strict=True):
        sets.link(int(i), int(j))
    want = [(i, int(n), sets.root(i), sets.root(i) == i) for i, n in enumerate(linked.sum(1))]
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == want


def test_near_duplicates_in_many_cells(spark, monkeypatch):
    """20,000 vectors in over fifty cells, half of them planted at a cosine of
    0.930 to 0.934 of another: recall 1 against brute force."""
    monkeypatch.setattr(neardup, "CELL", 350, raising=False)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(80, 16))
    a = centres[rng.integers(80, size=10_000)] + 0.5 * rng.normal(size=(10_000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.930, 0.934, (len(a), 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()}
    u = np.stack([neardup.unit(v) for v in x])
    assert len(x) // neardup.CELL >= 50
    for s in range(0, len(u), 2000):
        want = (u[s : s + 2000] @ u.T >= neardup.COSINE).sum(1) - 1
        assert [got[s + i] for i in range(len(want))] == want.tolist()


def test_near_duplicates_edge_cases(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, True)], key=str)


def test_components(spark):
    rng = random.Random(5)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(7, i) for i in range(90)], []):
        got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
        sets = Sets()
        for a, b in edges:
            sets.link(a, b)
        assert got == {x: sets.root(x) for e in edges for x in e if e[0] != e[1]}
    ids = np.array([0, 1, -1, 2**63 - 1, -(2**63), 12345])
    assert (restore_ids(shuffle_ids(ids)) == ids).all()


# -- op3 -------------------------------------------------------------------
def test_chat_collapse(spark):
    rows = [
        (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (2, 1, "user", "hi"), (3, 1, "user", "hi"), (3, 2, "assistant", "yo"), (3, 3, "user", None),
        (4, 1, "user", "hi"), (4, 2, "assistant", "other"), (5, 2, "assistant", "other"), (5, 1, "user", "hi"), (None, 1, "user", "hi"), (6, 1, None, ""), (7, None, "user", "x"), (8, 1, "user", "a"), (8, 1, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(9), "h1": F.lit(1), "n_turns": F.lit(0)})
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.format_chats(df).collect()}
    assert set(got) == {3, 4, 6, 7, 8}
    assert got[4][:2] == (2, 2) and got[8][0] == 2
    assert got[3][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0


# -- op4 -------------------------------------------------------------------
def test_cuckoo_index_against_a_dict():
    index, held, rng = exact.CuckooIndex(4), {}, random.Random(2)
    for step in range(6000):
        key = hashlib.sha256(b"%d" % rng.randrange(1500)).digest()
        if rng.random() < 0.6:
            if key not in held:
                held[key] = step
                index.insert(key, step)
        else:
            assert index.delete(key) == (held.pop(key, None) is not None)
        row = index.find(key)
        assert (row >= 0) == (key in held) and (row < 0 or index.id_of(row) == held[key])
    assert {k: i for k, i, _ in index.items()} == held and index.size == len(held)
    assert len(index.state) < 1500  # rows of deleted digests are used again


def test_cuckoo_index_with_one_mark():
    index = exact.CuckooIndex(1)
    keys = [b"\1\0" + bytes([i]) + b"\0" * 7 + bytes([i]) for i in range(7)]
    for i, k in enumerate(keys):
        index.insert(k, None if i == 3 else i, i + 1)
    assert [index.id_of(index.find(k)) for k in keys] == [0, 1, 2, None, 4, 5, 6]
    assert [index.counts[index.find(k)] for k in keys] == [1, 2, 3, 4, 5, 6, 7]


def test_cuckoo_index_in_few_bytes():
    index = exact.CuckooIndex()
    for i in range(100_000):
        index.insert(hashlib.sha256(b"%d" % i).digest(), i)
    held = len(index.digests) + sum(x.itemsize * len(x) for x in (index.ids, index.counts, index.marks, index.rows)) + len(index.state)
    assert held < 65 * 100_000 and sorted(i for _, i, _ in index.items()) == list(range(100_000))


def test_exact_dedup_edge_cases(spark):
    df = odd_documents(spark)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_dedup(df).collect()), key=str)
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[(r["text"] or "").translate(LOW)].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert got == sorted(want, key=str)
    assert exact.exact_dedup(df.limit(0)).count() == 0


def test_live_digests_change(spark):
    row = lambda *x: spark.createDataFrame([(hashlib.sha256(k.encode()).digest(), i) for k, i in x], "digest binary, doc_id long")
    out = exact.apply_changes(row(("a", 1), ("b", 2), ("c", 3)), row(("b", 2), ("c", 99)), row(("a", 9), ("b", 10), ("d", 11), ("d", 12)))
    got = sorted((r["status"], r["doc_id"], r["live_id"]) for r in out.collect())
    assert got == [("duplicate", 9, 1), ("duplicate", 12, 11), ("live", 1, 1), ("live", 3, 3), ("live", 10, 10), ("live", 11, 11)]


# -- op5 and op8 -----------------------------------------------------------
def test_language_accuracy_on_held_out(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = langid.op5_language_id(spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95


def test_language_edge_cases(spark):
    df = odd_documents(spark)
    got = langid.identify(df).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by[i] == "und" for i, t in enumerate(ODD) if not any(map(str.isalpha, t or "")))
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_ftrl_is_sparse_and_separates():
    model, rng = langid.FtrlSoftmax(2, l1=0.2), np.random.default_rng(0)
    for _ in range(600):
        k = int(rng.integers(2))
        model.learn(np.array([k, 2 + int(rng.integers(500))]), np.ones(2), k)
    w = model.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w == 0).mean() > 0.9


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(3000)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    fm = toxicity.FactorizationMachine(6).fit(rows, y, epochs=40, decay=1e-5, rate=0.3)  # no shrinkage
    p = toxicity.sigmoid(fm.score(np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), 4))
    assert p[2] > 0.9 and p[0] < 0.2 and p[1] < 0.2 and p[3] < 0.3


def test_toxicity_learns_a_pair_that_is_nothing_alone(spark):
    """The label is the exclusive or of two words, each as common in toxic
    texts as in others, beside twelve words of chance; through train and score."""
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(6000):
        words = [f"word{rng.randrange(60)}ish" for _ in range(12)]
        one, two = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["scoundrel"] * one + ["northerner"] * two)))
        marks.append((i, 1, int(one != two)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.toxicity(df, labels).collect() if r["held_out"]]
    assert sum(r["predicted"] == marks[r["doc_id"]][2] for r in held) > 0.95 * len(held) > 1500


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in toxicity.op8_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    caught = sum(r["predicted"] for r in held if truth[r["doc_id"]] == 1)
    assert caught > 0.7 * sum(truth[r["doc_id"]] for r in held) and sum(r["predicted"] for r in held) - caught <= 0.02 * len(held)


def test_toxicity_of_empty_tables(spark):
    df, none = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.toxicity(df, none).collect()] == [0.5, 0.5]
    assert toxicity.toxicity(df.limit(0), none).count() == 0


def test_toxicity_on_labelled_words(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)]
        bad = rng.random() < 0.2
        rows.append((i, " ".join(words + (["vilefolk", "scoundrel"] if bad else []))))
        marks.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "toxicity": F.lit("x"), "h": F.lit(0)})
    got = toxicity.toxicity(df, spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["predicted"] == t for i, _, t in marks)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got) and by[1000]["predicted"] == 0


# -- op6 -------------------------------------------------------------------
def test_scores_and_counts(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in lm.op6_lm_scores(spark, sf_dir).collect()}
    words = {i: WORDS.findall((t or "").translate(LOW)) + ["\n"] for i, t in docs}
    count = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_probabilities_sum_to_one():
    rng, words = np.random.default_rng(1), 23
    m = lm.LogBilinear(rng.integers(1, 50, words).astype(float))
    for _ in range(200):
        b2, b1, w = (rng.integers(0, words, 64) for _ in range(3))
        m.learn(b2, b1, w, np.ones(64, np.float32))
    b2, b1, w = (x.ravel() for x in np.meshgrid(range(words), range(words), range(words), indexing="ij"))
    p = np.exp(m.log_probabilities(b2, b1, w)).reshape(words * words, words)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    q = m.r[5] @ m.c1 + m.r[7] @ m.c2
    by_class = np.exp(m.rc @ q + m.bc)
    own = np.exp(m.r @ q + m.b)
    want = [by_class[c] / by_class.sum() * own[i] / own[m.of == c].sum() for i, c in enumerate(m.of)]
    assert np.allclose(p[7 * words + 5], want, rtol=1e-4)


def test_model_learns_what_follows(spark):
    """Words come in fixed threes, so the third is sure after the first two;
    the model does not depend on how the table is partitioned."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["a1 b1 c1", "a2 b2 c2", "a1 b2 c3", "a2 b1 c4"]) for _ in range(30))) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.lm_scores(df.repartition(7)).collect()}
    again = {r["doc_id"]: r["score"] for r in lm.lm_scores(df.coalesce(1)).collect()}
    assert all(abs(r["score"] - again[i]) < 1e-3 for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)


def test_document_scores_by_brute_force(spark, sf_dir, docs, monkeypatch):
    """Every probability of some documents from whole softmaxes, without classes
    or contexts being shared."""
    made = []
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **b: made.append((real(*a, **b), a[1])) or made[-1][0])
    got = {r["doc_id"]: r for r in lm.op6_lm_scores(spark, sf_dir).collect()}
    model, place = made[0]
    words = {i: [*lm.words_of(t), lm.END_WORD] for i, t in docs}
    count = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    inside = sum(n for w, n in count.items() if w not in place) + 0.1 * (len(count) - len(place) + 1)
    for i in [i for i, ws in words.items() if len(ws) < 300][:8]:
        total, b2, b1 = 0.0, lm.END, lm.END
        for w in words[i]:
            at = place.get(w, lm.OTHER)
            q = model.r[b1].astype(float) @ model.c1 + model.r[b2].astype(float) @ model.c2
            kinds, own = model.rc @ q + model.bc, (model.r @ q + model.b)[model.of == model.of[at]]
            p = np.exp(kinds[model.of[at]] - kinds.max()) / np.exp(kinds - kinds.max()).sum() * np.exp(model.r[at] @ q + model.b[at] - own.max()) / np.exp(own - own.max()).sum()
            total += math.log10(p) + (math.log10((count[w] + 0.1) / inside) if at == lm.OTHER else 0)
            b2, b1 = b1, at
        assert abs(got[i]["score"] - total) < 1e-3 * max(1, abs(total))


def test_shards_do_not_lose_what_one_learns(spark):
    """The same texts in one shard and in thirty: the gain over the base score
    of held-out texts stays."""
    rng = random.Random(8)
    follow = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(3)] for i in range(60)}

    def text():
        w = [f"w{rng.randrange(60)}"]
        while len(w) < 40:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.8 else f"w{rng.randrange(60)}")
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    gain = {}
    for size in (1000, 20):
        with pytest.MonkeyPatch.context() as patch:
            real = lm.train
            patch.setattr(lm, "train", lambda *a, real=real, size=size: real(*a, shard_documents=size))
            held = [r for r in lm.lm_scores(df).collect() if r["held_out"]]
        gain[size] = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain[1000] > 0.2 and gain[20] > 0.95 * gain[1000]


def test_noise_step_by_brute_force(monkeypatch):
    """A step equals one that goes through every row and every draw of noise,
    though each drawn word is met once."""
    columns, sigmoid, draws = [], lm._sigmoid, []
    monkeypatch.setattr(lm, "_sigmoid", lambda x: columns.append(x.shape[1:]) or sigmoid(x))
    rng, words, rows, k = np.random.default_rng(5), 20, 70, 25.0
    m = lm.LogBilinear(rng.integers(1, 900, words).astype(float), width=6)
    drawn = m._drawn
    monkeypatch.setattr(m, "_drawn", lambda *a: draws.append(drawn(*a)) or draws[-1])
    start = {n: x.astype(float) for n, x in m.state()[0].items()}
    b2, b1, w = (rng.integers(0, words, rows) for _ in range(3))
    weight = rng.integers(1, 5, rows).astype(np.float32)
    m.learn(b2, b1, w, weight)
    assert [int(n.sum()) for _, n in draws] == [lm.NOISE, lm.CLASS_NOISE]
    assert max(c[0] for c in columns if c) <= words + len(m.pc)
    grad = {n: np.zeros_like(x) for n, x in start.items()}
    for x2, x1, target, share in zip(b2, b1, w, weight / weight.sum(), strict=True):
        q = start["r"][x1] @ start["c1"] + start["r"][x2] @ start["c2"]
        dq = np.zeros_like(q)
        for r, b, p, of, (noise, times) in (("r", "b", m.p, target, draws[0]), ("rc", "bc", m.pc, m.of[target], draws[1])):
            for at, good in [(of, True), *((x, False) for x in np.repeat(noise, times))]:
                true = 1 / (1 + np.exp(-(start[r][at] @ q + start[b][at] - np.log(k * p[at]))))
                error = share * (true - 1) if good else share * true * k / times.sum()
                dq += error * start[r][at]
                grad[r][at] += error * q
                grad[b][at] += error
        for x, c in ((x1, "c1"), (x2, "c2")):
            grad["r"][x] += start[c] @ dq
            grad[c] += np.outer(start["r"][x], dq)
    for n, x in start.items():
        assert np.allclose(m.state()[0][n], x - 0.05 * grad[n] / np.sqrt(1e-8 + grad[n] ** 2), atol=2e-4)


def test_shards_of_a_task_leave_it_as_one():
    """What the shards of a lot moved is one row for each block of words, and
    brings the model where rows of each shard do."""
    rng, words = np.random.default_rng(6), 1500
    unigram = rng.integers(1, 900, words).astype(float)
    before = lm.LogBilinear(unigram)
    each, lot = [], lm._Moves(before)
    for shard in range(5):
        own, w = lm.LogBilinear(unigram, seed=shard).restored(before.state()), rng.integers(0, words, (3, 4000))
        own.learn(*w, np.ones(4000, np.float32))
        single = lm._Moves(before)
        for moves in (single, lot):
            moves.add(np.bincount(w[2], minlength=words), own)
        each.append(single.rows(shard))
    together = lot.rows(0)
    assert len(together) == len(each[0]) == 4 and together["shards"].eq(5).all()
    assert together["moves"].str.len().sum() < 1.3 * each[0]["moves"].str.len().sum()
    models = []
    for rows in ([together], each):
        rows = lm.pd.concat(rows).sort_values(["kind", "block", "lot"])
        got = lm.pd.concat(lm._gathered(iter([rows]))).to_dict("records")
        models.append(lm._brought_together(lm.LogBilinear(unigram), got, 5).state())
    for a, b in zip(*models, strict=True):
        assert all(np.allclose(a[n], b[n], rtol=2e-3, atol=2e-4) for n in a)


def test_lm_edge_cases(spark):
    df = odd_documents(spark)
    got = lm.lm_scores(df).collect()
    words = {r["doc_id"]: len(WORDS.findall(r["text"] or "")) + 1 for r in df.collect()}
    assert all(r["n_tokens"] == words[r["doc_id"]] and r["n_known"] <= r["n_tokens"] for r in got)
    assert len(got) == df.count() and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    assert lm.lm_scores(df.limit(0)).count() == 0


# -- op7 -------------------------------------------------------------------
def check_packing(rows, texts, size):
    tok = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    total = 0
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-total // size)


def test_packing(spark, sf_dir, docs):
    used, least = check_packing(packing.op7_best_fit_packing(spark, sf_dir).collect(), docs, 2048)
    assert used <= least * 1.05 + 1


def test_packing_edge_cases(spark):
    df = odd_documents(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(packing.pack(df, path, size=64, open_bins=4, shard_rows=3).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], 64)
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_many_long_pieces(spark):
    """More pieces over half a sequence than there are open bins, sorted longest first."""
    sizes = sorted([33 + i % 30 for i in range(3000)] + [1 + i % 30 for i in range(3000)], reverse=True)
    df = spark.createDataFrame([(i, "the " * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string")
    rows = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), size=64).collect()
    used, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in df.collect()], 64)
    assert sum(r["length"] > 32 for r in rows) > 2 * packing.OPEN_BINS
    assert used <= least * 1.05 + 1


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.add(n) for n in (7, 6, 4, 3)] == [(0, 0), (1, 0), (1, 6), (0, 7)]
    bins = packing.BestFit(10, 2)
    assert [bins.add(n) for n in (5, 6, 9, 5, 4)] == [(0, 0), (1, 0), (2, 0), (0, 5), (3, 0)]


# -- op9 -------------------------------------------------------------------
def test_round_trip(spark, sf_dir, docs):
    tok = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.op9_bpe_round_trip(spark, sf_dir).collect()}
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_round_trip_edge_cases(spark):
    df, path = odd_documents(spark), public_tokenizers.path("byte_bpe_50k.json")
    tok = bpe.tokenizer(path)
    got = bpe.encode_decode(df, path, digest=False).collect()
    want = [(r["doc_id"], tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect()]
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    assert collections.Counter(r["decoded"] for r in got) == collections.Counter(r["text"] or "" for r in df.collect())
    assert bpe.encode_decode(df.limit(0), path).count() == 0


# -- op10 ------------------------------------------------------------------
def brute_groups(texts):
    sets = {}
    for i, t in texts:
        w = WORDS.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    roots, ids = Sets(), list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                roots.link(ids[x], ids[y])
    return {i: (len(sets[i]), roots.root(i)) for i in ids}


def test_jaccard_groups_match_brute_force(spark, sf_dir, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.op10_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_groups(docs)


def test_jaccard_groups_on_mutations(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for k in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own = own[: int(len(own) * rng.uniform(0.7, 1))]
            if rng.random() < 0.3:
                own = own + passage
            texts.append((len(texts), " ".join(own)))
    texts += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE two"), (1005, "one two three")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5).withColumns({"fp": F.lit(1), "n": F.lit(2), "component_id": F.lit(3)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.link_groups(df).collect()}
    assert got == brute_groups(texts)


def test_jaccard_edge_cases(spark):
    df = odd_documents(spark)
    got, want = ngramjoin.link_groups(df).collect(), brute_groups([(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None])
    assert len(got) == df.count()
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_jaccard_in_a_family_of_edits(spark):
    """Edits of one text, most of them too far from it: queries that open a
    large group and link with some of its members, or with none."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8, 12])):
            at = rng.randrange(len(own))
            own[at] = rng.choice(["x1", "x2", f"w{rng.randrange(900)}"])
        if rng.random() < 0.4:
            cut = rng.randrange(5, 40)
            own = own[cut:] if rng.random() < 0.5 else own[:-cut]
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.link_groups(df).collect()}
    assert got == brute_groups(texts)


def test_members_of_a_block():
    rng = np.random.default_rng(2)
    leader = np.arange(100)
    near = lambda drop, add: (np.setdiff1d(leader, rng.choice(100, drop, replace=False)), rng.choice(np.arange(1000, 1040), add, replace=False))
    sets = [near(rng.integers(0, 12), rng.integers(0, 12)) for _ in range(60)]
    row = lambda i, held, more: (i, len(held) + len(more), np.sort(more), np.setdiff1d(leader, held))
    block = ngramjoin._Block([row(i, *s) for i, s in enumerate(sets)])
    for _ in range(200):
        held, more = near(rng.integers(5, 40), rng.integers(0, 30))
        full = set(held) | set(more)
        query = collections.namedtuple("Q", "n_a n_b rest gaps")(100, len(full), np.sort(more), np.setdiff1d(leader, held))
        linked = [i for i, (h, m) in enumerate(sets) if 100 * len(full & (set(h) | set(m))) >= 75 * len(full | set(h) | set(m))]
        found = block.partner(query)
        assert (found is None) == (not linked) and (found is None or found in linked)


@pytest.mark.parametrize("window", [17, 64])
def test_word_hashes_in_windows(monkeypatch, window):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n0_xyz ") for _ in range(rng.randrange(200))).encode() for _ in range(80)] + [b"", b"  ", b"x" * 300, b"y" * 100 + b" z"]
    for gap in (_words.WHITE, _words.NO_LETTER):
        monkeypatch.setattr(_words, "WINDOW", 1 << 19)
        want = _words.word_hashes(texts, gap, (4, 5))
        monkeypatch.setattr(_words, "WINDOW", window)
        got = _words.word_hashes(texts, gap, (4, 5))
        assert all((a == b).all() for a, b in zip([*want[:2], *[x for p in want[2] for x in p]], [*got[:2], *[x for p in got[2] for x in p]], strict=True))


def test_long_text_takes_bounded_memory():
    """The hashes of a 96 MB text in a process of its own."""
    code = "import resource; from tessella.llm import _words as w; n = len(w.word_hashes([b'some words of text ' * 5_000_000])[0]); print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout.split())
    assert n == 20_000_000 and mb < 1500


def test_jaccard_of_an_empty_table(spark):
    df = odd_documents(spark)
    assert ngramjoin.link_groups(df.limit(0)).count() == 0


# -- pipeline --------------------------------------------------------------
def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == before, name
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(a >= b for a, b in zip(seen, seen[1:]))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len({(t or "").translate(LOW) for _, t in texts}) == len(texts)
    assert all(i == c for i, (_, c) in brute_groups(texts).items())


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_whole_pipeline_by_brute_force(spark, sf_dir):
    """The rows of run() from plain Python over all documents; only the two
    classifiers' scores are the operators' own."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.select("doc_id", "text").collect()}
    learn = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    model = langid.train(rows.filter(F.col("doc_id").isin([i for i in texts if learn(i)])))
    guess = {r["doc_id"]: r["guess"] for r in langid.predict(rows, model).select("doc_id", "guess").collect()}
    kept = {i for i in texts if guess[i]["lang_pred"] != "und" and guess[i]["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    left = rows.filter(F.col("doc_id").isin(list(kept)))
    odds = {r["doc_id"]: r["odds"] for r in toxicity.score(left, toxicity.train(left, labels), into="odds").collect()}
    kept = {i for i in kept if odds[i] < toxicity.THRESHOLD}
    last = {}
    for i in sorted(kept):
        last[texts[i].translate(LOW)] = i
    kept = set(last.values())
    kept = {i for i, (_, top) in brute_groups([(i, texts[i]) for i in sorted(kept)]).items() if i == top}
    assert 0 < len(kept) < len(texts)
    used, least = check_packing(corpus_pipeline.run(spark, sf_dir).collect(), [(i, texts[i]) for i in kept], 2048)
    assert used <= least * 1.05 + 1


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    own = {"score": -7.0, "lang_pred": "q", "guess": "g", "_guess": 1, "_id": 3, "_sha": "s", "row": "r", "id": 2, "own": 1, "toxicity": 0.1, "odds": "o"}
    docs = docs.withColumns({k: F.lit(v) for k, v in own.items()})
    null = lambda c, kind: docs.limit(2).withColumn(c, F.lit(None).cast(kind))
    docs = docs.union(docs.limit(3)).union(null("doc_id", "long")).union(null("text", "string")).union(null("lang", "string").withColumn("text", F.lit("")))
    columns, last = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        out = stage(spark, docs, sf_dir).collect()
        assert all({k: r[k] for k in own} == own for r in out) and len(out) <= last, name
        docs, last = spark.createDataFrame(out, docs.schema), len(out)
        assert docs.columns == columns, name
        assert name != "language_id" or all(r["text"] for r in out)
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() >= last > 0


def test_exact_stage_breaks_ties_the_same_way(spark, sf_dir):
    import corpus_pipeline

    rows = [(1, "same", "en", "b", 4), (1, "same", "en", "a", 4), (1, "SAME", "fr", "c", 4), (0, "same", "en", "z", 4), (None, "other", "en", "a", 5), (None, "other", "en", "b", 5)]
    out = []
    for part in (1, 5):
        df = spark.createDataFrame(rows if part == 1 else rows[::-1], "doc_id long, text string, lang string, source string, n_chars long").repartition(part)
        out.append(sorted((tuple(r) for r in corpus_pipeline.exact_dedup(spark, df, sf_dir).collect()), key=str))
    assert out[0] == out[1] and [r[0] for r in out[0]] == [1, None]
