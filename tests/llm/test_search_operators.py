"""Conversation trie, spelling variants and exact top-k against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import neardup, prefixtrie, spelling, topk

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# -- op11 ------------------------------------------------------------------
def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    made = {c: tuple(turns.get(abs(c) // 100 * 100 * (1 if c > 0 else -1), [])[: h[c]] + t[h[c] :]) for c, t in turns.items()}
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids, saved, leaves = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(df, **more):
    got = prefixtrie.trie(df, **more)
    return sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())


def talk(n, seed, spread):
    """Conversations from few distinct turns, so that many share prefixes,
    nest in each other or are equal."""
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for i in range(rnd.choice([1, 2, 3, 5, 8, 13])):
            rows.append((c * spread, i, rnd.choice(["user", "bot"]), rnd.choice(["a", "bb", "日本"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("n, seed, spread, block", [(300, 1, 1, 7), (300, 2, 7, 2), (120, 3, 100, 1), (500, 4, 1, 60), (200, 5, 1, 1000)])
def test_trie_over_blocks(spark, n, seed, spread, block):
    rows = talk(n, seed, spread)
    assert found_trie(spark.createDataFrame(rows, SCHEMA), block_rows=block) == brute_trie(rows)


def test_trie_edges(spark):
    big = 2**60 + 1
    rows = [
        (100, None, None, None), (100, 0, "user", "x" * 3_000_000), (100, 0, "user", "x" * 3_000_000), (101, 5, "", ""), (101, 5, None, None), (None, 1, "user", "lost"),
        (big, 1, "user", "a"), (big + 1, 1, "user", "a"), (-5, 1, "user", ""), (-100, 2, None, "t"), (-107, -1, "user", "b"), (250, 1, "user", "short"), (251, 1, "u:", "1:"), (252, 1, "u", ":1:"),
    ] + [(777, i, "user", "turn %d" % (i % 2)) for i in range(150)] + [(779, i, "user", "turn %d" % (i % 2)) for i in range(140)]
    odd = [(*r, "n_convs", 1, True) for r in rows]
    df = spark.createDataFrame(odd, SCHEMA + ", n_convs string, depth int, block boolean")
    got = found_trie(df, block_rows=3)
    assert got == brute_trie(rows)
    assert got == found_trie(spark.createDataFrame(rows, SCHEMA))
    assert found_trie(spark.createDataFrame([], SCHEMA)) == []
    assert found_trie(spark.createDataFrame([(None, 1, "user", "lost")], SCHEMA)) == []


def test_trie_of_equal_conversations(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(9000) for i in range(2)] + [(9001, 0, "user", "other")]
    assert found_trie(spark.createDataFrame(rows, SCHEMA), block_rows=2) == brute_trie(rows)


# -- op12 ------------------------------------------------------------------
def brute_words(rows):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                n[word] = n.get(word, 0) + 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found_variants(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(df).collect()), key=lambda r: r[0])


def test_spelling_variants(spark):
    rnd = random.Random(3)
    base = ["tessella", "mosaïque", "aaaaaaaa", "ÉTÉétéÉT", "listening", "anagrams", "x" * 48, "y" * 49, "ab" * 24 + "c", "z" * 300, "pq" * 400]
    rows = []
    for k, w in enumerate(base):
        rows.append((k, f"{w} " * 240))
        variants = [w]
        for depth, times in ((1, 20), (2, 2)):
            for v in list(variants)[-3:]:
                for _ in range(4):
                    p, c = rnd.randrange(len(v)), rnd.choice("abeéÿ×÷z")
                    new = rnd.choice([v[:p] + v[p + 1 :], v[:p] + c + v[p:], v[:p] + c + v[p + 1 :]])
                    variants.append(new)
                    rows.append((100 * depth + k, f"({new.title() if depth == 1 else new.upper()}, " * times))
    rows += [(900, "listenign listenign lsitening lsitening silenting silenting"), (901, None), (902, ""), (903, "short 1234567 日本語日本語日本語"), (None, "tessellb tessellb tessellc"), (905, "tessellc"), (905, "tessellc")]
    df = spark.createDataFrame([(*r, "word", 5) for r in rows], "doc_id long, text string, word string, n int")
    assert found_variants(df) == brute_variants(rows)
    assert found_variants(spark.createDataFrame([], "doc_id long, text string")) == []


def test_very_long_runs(spark):
    long_ = "ab" * 150_000
    rows = [(1, f"{long_} {long_}c"), (2, f"{long_} {long_}c {long_[1:]}"), (3, f"{long_[1:]} {long_[2:]}"), (4, "word " * 400_000 + "another another")]
    assert found_variants(spark.createDataFrame(rows, "doc_id long, text string")) == brute_variants(rows)


def test_anagram_keys_add_up(spark):
    df = spark.createDataFrame([("listening",), ("silenting",), ("ÿ×aéà",)], "w string")
    place = lambda c: (ord(c) - 96 if ord(c) < 0xC0 else ord(c) - 0xC0 + 27) ** 5
    assert [r[0] for r in df.select(spelling.anagram_key(df["w"])).collect()] == [sum(map(place, w)) for w in ("listening", "silenting", "ÿ×aéà")]


# -- op13 ------------------------------------------------------------------
def brute_top(rows, k=5, every=50):
    held = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, [int(np.floor(256 * x)) for x in v]))
    out = []
    for a, (i, q) in enumerate(held):
        if i % every == 0:
            scores = [(-max(min(sum(s * t for s, t in zip(q, x)), 2**63 - 1), -(2**63)), j) for b, (j, x) in enumerate(held) if a != b and len(x) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found_top(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in topk.top_k(df).collect())


@pytest.mark.parametrize("shard", [4000, 40_000, 1 << 24])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_BYTES", shard)
    rng = np.random.default_rng(shard)
    x = np.round(rng.normal(size=(40, 6))[rng.integers(0, 40, 1500)] + 0.05 * rng.normal(size=(1500, 6)), 2)
    rows = [(int(i), [float(e) for e in v]) for i, v in zip(rng.permutation(3000)[:1500] - 700, x)]
    same = [1.0, 0.5, 0.0, 0.0, -1.0, 0.25]
    rows += [(10_000 + i, same) for i in range(0, 700, 7)] + [(50, None), (100, [1.0, None]), (150, [float("nan")] * 6), (200, [float("inf")] * 6), (None, same), (20_000, []), (20_001, []), (30_050, [1.0, 2.0]), (30_051, [3.0, -1.0]), (40_000, [0.0] * 6)]
    rows += rows[5:9] + [(50_000, same), (50_000, same), (50_000, [-9.0] * 6)]
    df = spark.createDataFrame([(i, v, 3, "a") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    assert found_top(df) == brute_top(rows)


def test_top_k_of_large_numbers(spark):
    rows = [(0, [1e14, -3.0]), (1, [1e5, 7.0]), (2, [123456789.0, 1e10]), (3, [-1e300, 1.0]), (50, [1e300, 2.0]), (51, [0.001, 0.002])]
    assert found_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute_top(rows)


def test_top_k_without_queries(spark):
    schema = "vec_id long, embedding array<float>"
    assert found_top(spark.createDataFrame([], schema)) == []
    assert found_top(spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)) == []
    assert found_top(spark.createDataFrame([(50, [1.0])], schema)) == []


def test_blocks_are_pruned(monkeypatch):
    """Blocks whose bound falls below the k-th score are never scored."""
    import pandas as pd

    scored = []
    real = topk.product
    rng = np.random.default_rng(0)
    centre = np.round(100 * rng.normal(size=(20, 16)))
    rows = []
    for b, c in enumerate(centre):
        x = c + rng.integers(-3, 4, (50, 16))
        ids = np.arange(b * 50, b * 50 + 50)
        rows.append((16, 50, ids.tobytes(), x.tobytes(), x.max(0).tobytes(), x.min(0).tobytes(), b * 50))
    blocks = pd.DataFrame(rows, columns=["width", "n", "ids", "x", "top", "low", "least"])
    asked = pd.DataFrame({"query": [bytes([b]) for b in range(20)], "width": 16, "q": [c.tobytes() for c in centre], "floor": None, "floor_id": None})
    monkeypatch.setattr(topk, "product", lambda a, b: (scored.append((len(a), len(b))), real(a, b))[1])
    found = pd.concat(topk._search(asked, blocks, 6))
    assert sum(a * b for a, b in scored[1:]) < 0.3 * 20 * 1000
    every = np.concatenate([np.frombuffer(r[3]).reshape(50, 16) for r in rows])
    for b, c in enumerate(centre):
        s = (every @ c).astype(int)
        want = sorted(zip(-s, range(1000)))[:6]
        mine = found[found["query"] == bytes([b])]
        assert sorted(zip(-mine["score"], mine["vec_id"])) == [(int(a), int(i)) for a, i in want]


# -- op2 -------------------------------------------------------------------
def test_wide_vectors_find_their_cells_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit(rng.normal(size=(1024, 256)))
    x = unit(c[rng.integers(0, 1024, 4096)] + 0.03 * rng.normal(size=(4096, 256)))
    tracemalloc.start()
    got = [(start + row, cell, home) for start, row, cell, home in neardup.visits(x, c)]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    cells = {(int(r), int(k)) for row, cell, _ in got for r, k in zip(row, cell)}
    near = x[:50] @ c.T
    for i in range(50):
        apart = np.linalg.norm(c[near[i].argmax()] - c, axis=1)
        assert {(i, int(k)) for k in np.flatnonzero(near[i].max() - near[i] <= neardup.REACH * apart)} <= cells


def test_blocks_of_any_size_link_alike(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 300)] + 0.08 * rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = lambda left: pd.DataFrame({"node": np.arange(300), "copies": rng.integers(1, 3, 300), "x": list(x), "left": left})
    pdf = pd.concat([side(True), side(False)], ignore_index=True)
    pdf["copies"] = np.tile(pdf["copies"].to_numpy()[:300], 2)

    def result():
        got = neardup._block_links(pdf)
        up = list(range(300))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in zip(got["a"], got["b"]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return got[got["n"] > 0].groupby("b")["n"].sum().to_dict(), [root(i) for i in range(300)]

    whole = result()
    monkeypatch.setattr(neardup, "BLOCK", 37)
    assert result() == whole and len(set(whole[1])) < 300


def test_vectors_are_not_shuffled_to_every_cell(spark, monkeypatch):
    """Vectors without clusters visit nearly every cell, and are shuffled once."""
    monkeypatch.setattr(neardup, "CELL", 150)
    monkeypatch.setattr(neardup, "BLOCK", 100)
    rng = np.random.default_rng(17)
    a = rng.normal(size=(1200, 64))
    x = np.concatenate([a, a[:900] + 0.04 * rng.normal(size=(900, 64)), 3 * a[:40], rng.normal(size=(900, 32)) @ np.eye(32, 64)]).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), [float(e) for e in v], 1 if i % 7 else 2) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int").repartition(3)
    df = df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.localCheckpoint()
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda all_: [all_.apply(i) for i in range(all_.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(df).collect()}
    assert written() - before < 3 * x.nbytes
    u, label = neardup.units(x)[1], np.where(ids % 7, 1, 2)
    want = ((u @ u.T >= neardup.COSINE) & (label[:, None] == label)).sum(1) - 1
    assert [got[int(i)] for i in ids] == want.tolist() and want.sum() > 1000


# -- very long texts -------------------------------------------------------
def long_texts():
    words = ["the", "of", "hello", "idiot", "monde", "Straße", "naïve", "日本語"]
    rnd = random.Random(5)
    return [" ".join(rnd.choice(words) for _ in range(700_000)), "x" * 400_000, "é" * 100_000 + " end", "a b " * 300_000, "", None, "short one"]


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Very long texts beside short ones, with labels, as the tables of a folder."""
    folder = str(tmp_path_factory.mktemp("long"))
    texts = long_texts()
    short = [(100 + i, f"{'idiot ' if i % 5 == 0 else ''}hello number {i} of the day", "en") for i in range(120)] + [(300 + i, f"bonjour le monde et la nuit numéro {i}", "fr") for i in range(60)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(i, t, lang, "s", len(t)) for i, t, lang in short]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: t for i, t, *_ in rows}


def test_very_long_texts_through_the_classifiers(spark, long_docs):
    from tessella.llm import langid, toxicity

    folder, texts = long_docs
    got = {r["doc_id"]: r for r in langid.op5_language_id(spark, folder).collect()}
    assert set(got) == set(texts) and got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[0]["lang_pred"] in ("en", "fr")
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, folder).collect()}
    assert set(got) == set(texts) and all(0 <= r["score"] <= 1 for r in got.values())


def test_very_long_texts_are_scored_and_encoded_whole(spark, long_docs):
    import public_tokenizers

    from tessella.llm import bpe, exact, lm, packing, tokencount

    folder, texts = long_docs
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    scored = {r["doc_id"]: r for r in lm.op6_lm_scores(spark, folder).collect()}
    assert {i: r["n_tokens"] for i, r in scored.items()} == {i: n + 1 for i, n in words.items()}
    digests = {r["doc_id"]: r["text_sha256"] for r in exact.op4_exact_dedup(spark, folder).collect()}
    assert digests == {i: hashlib.sha256((t or "").translate(LOW).encode()).hexdigest() for i, t in texts.items()}
    tok = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for r in bpe.op9_bpe_round_trip(spark, folder).filter("doc_id < 10").collect():
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    pieces = packing.op7_best_fit_packing(spark, folder).groupBy("doc_id").agg({"length": "sum", "piece": "max"}).collect()
    packer = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for r in pieces:
        if r["doc_id"] < 10:
            n = len(packer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids) + 1
            assert (r["sum(length)"], r["max(piece)"]) == (n, (n - 1) // 2048)
    counts = {r["doc_id"]: r["n_bytes"] for r in tokencount.op1_token_counts(spark, folder).collect()}
    assert counts == {i: len((t or "").encode()) for i, t in texts.items()}
