"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._components import components
from tessella.llm._shared import cut, join_skewed, lean, table

COSINE, SAMPLE, CELL, MOST_CELLS, BLOCK, MOST_BLOCK = 0.93, 20_000, 2000, 1024, 2048, 65_536
PRODUCT = 1 << 21  # numbers of a product that are held at once
PART = 1 << 25  # bytes of packed vectors in a partition
NONE = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 1))
REACH = float(np.sqrt(1 - COSINE**2))


def unit(v) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it links with nothing."""
    if v is None or not len(v):
        return None
    x = np.array([np.nan if e is None else e for e in v], float)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(np.square(x).sum())


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centroids, each the direction of the sum of its vectors."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sums = np.zeros_like(c)
        np.add.at(sums, (x @ c.T).argmax(1), x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``unit`` of every row: which rows can link, and those at length 1."""
    x = raw.astype(float)
    able = np.isfinite(x).all(1) & x.any(1)
    x = x[able]
    x /= np.abs(x).max(1, keepdims=True) if len(x) else 1
    x /= np.sqrt(np.square(x).sum(1, keepdims=True))
    return able, x + 0.0  # one zero


def _able(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(row, label, vector, unit vector, key) of the rows of a batch that can
    link, by their width; key names equal labelled unit vectors."""
    lists, label = batch.column("embedding"), batch.column("label")
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # a null reads nan
    there = (lists.is_valid().to_numpy(zero_copy_only=False)) & label.is_valid().to_numpy(zero_copy_only=False)
    width, label = np.where(there, np.diff(at), 0), label.fill_null(0).to_numpy()
    for w in np.unique(width[width > 0]):
        row, step = np.flatnonzero(width == w), max(1, PRODUCT // int(w))
        for start in range(0, len(row), step):
            own = row[start : start + step]
            raw = values[at[own][:, None] + np.arange(w)]
            able, x = units(raw)
            own = own[able]
            if len(own):
                yield own, label[own], raw[able], x, [hashlib.md5(b"%d " % n + v.tobytes()).digest() for n, v in zip(label[own].tolist(), x, strict=True)]


def keys(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, width, key) of every row; key is null where the vector
    can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, key = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, None, object)
            for row, _, raw, _, names in _able(batch):
                width[row], key[row] = raw.shape[1], names
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(width), pa.array(key, pa.binary())], ["vec_id", "label", "width", "key"])

    return vectors.mapInArrow(lean(run), "vec_id long, label long, width int, key binary")


def fit_cells(vectors: DataFrame, nodes: DataFrame, total: int, sample: int = SAMPLE) -> dict[tuple[int, int], tuple[np.ndarray | None, np.ndarray]]:
    """For each label and vector width with more vectors than a block: the
    centroids, and for each in how many blocks its cell is dealt. Where there
    are at least two cells' worth of vectors, there is one for about CELL,
    MOST_CELLS in all at most, fitted on about ``sample`` vectors drawn by hash
    among the ``nodes`` (node, label, width, key); else None and one cell.

    A block is some 1/4096 of all vectors within BLOCK and MOST_BLOCK."""
    per, block = max(CELL, -(-total // MOST_CELLS)), min(MOST_BLOCK, max(BLOCK, total // 4096))
    sizes = nodes.groupBy("label", "width").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min(block, 2 * per - 1)).collect()
    sizes = {(r["label"], r["width"]): r["n"] for r in sizes}
    out = {at: (None, np.array([-(-n // block)])) for at, n in sizes.items()}
    if not any(n >= 2 * per for n in sizes.values()):
        return out
    chance = int(1_000_000 * sample / max(1, total)) + 1
    drawn = nodes.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < chance).select(F.col("node").alias("vec_id"), F.col("key").alias("drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("drawn").to_pylist()
            for row, label, raw, x, names in _able(batch):
                own = [i for i, at in enumerate(row.tolist()) if names[i] == want[at]]
                rows = [pa.array(names, pa.binary()), pa.array(label), pa.array(np.full(len(row), raw.shape[1], np.int32)), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(own, pa.int64())) for c in rows], ["key", "label", "width", "x"])

    got = vectors.join(F.broadcast(drawn), "vec_id").mapInArrow(lean(run), "key binary, label long, width int, x array<double>").toPandas()  # about ``sample`` rows
    got["key"] = got["key"].map(bytes)
    got = got.drop_duplicates("key").sort_values("key", kind="stable")
    for at, g in got.groupby(["label", "width"]):
        if sizes.get(at, 0) >= 2 * per:
            x = np.stack(g["x"].to_numpy())
            c = spherical_kmeans(x, sizes[at] // per)
            share = np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x)
            out[at] = c, np.maximum(1, np.ceil(share * sizes[at] / block)).astype(np.int64)
    return out


def visits(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, cell, home) for slices of ``x``: every cell that a row
    visits, and its home. The distance of two unit centroids comes from their
    product, for the homes of a slice only."""
    step = max(1, PRODUCT // len(c))
    for start in range(0, len(x), step):
        near = x[start : start + step] @ c.T
        home = near.argmax(1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
        row, cell = np.nonzero(near.max(1, keepdims=True) - near <= REACH * apart + 1e-7)
        yield start, row, cell, home


def packed(vectors: DataFrame, cells: dict[tuple[int, int], tuple[np.ndarray | None, np.ndarray]], parts: int) -> DataFrame:
    """(label, width, home, many, id, visits, node, copies, x): the vectors of a
    cell, or of a part of it, in one row. Equal vectors are one ``node``, the
    least vec_id, with so many ``copies``; ``x`` holds one of them as it came.
    ``visits`` are the cells where a partner of any of them may have its home,
    ``id`` the least key, and ``many`` says that the label has other blocks.

    With d a vector's centroid less that of another cell, a partner y at home
    there has y.d <= 0 and so is 90 degrees or more from d; a vector within
    COSINE of y then has x.d <= sin(arccos(COSINE)) |d|."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    names = ["label", "width", "home", "part", "vec_id", "n", "key", "x"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            batch = batch.filter(ids.is_valid())
            ids = batch.column("vec_id").to_numpy()
            for row, label, raw, x, key in _able(batch):
                same, first = pd.factorize(np.array(key, object))
                least, n, at = np.full(len(first), np.iinfo(np.int64).max), np.bincount(same), np.full(len(first), -1)
                np.minimum.at(least, same, ids[row])
                at[same[::-1]] = np.arange(len(same))[::-1]
                label, raw, x = label[at], raw[at], x[at]
                home, part = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
                dealt = np.frombuffer(b"".join(first), np.uint64)[::2]
                for name in np.unique(label):
                    c, into = shared.value.get((int(name), raw.shape[1]), (None, None))
                    own = np.flatnonzero(label == name)
                    if c is not None:
                        step = max(1, PRODUCT // len(c))
                        home[own] = np.concatenate([(x[own[s : s + step]] @ c.T).argmax(1) for s in range(0, len(own), step)])
                    if into is not None:
                        part[own] = dealt[own] % into[home[own]].astype(np.uint64)
                bytes_ = pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary())
                columns = [pa.array(label), pa.array(np.full(len(at), raw.shape[1], np.int32)), pa.array(home), pa.array(part), pa.array(least), pa.array(n), pa.array(first, pa.binary()), bytes_]
                yield pa.RecordBatch.from_arrays(columns, names)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf.groupby(pdf["key"].map(bytes), sort=False)
        at = of["vec_id"].min().to_frame("node").assign(copies=of["n"].sum(), x=of["x"].first()).sort_values("node")
        label, width, home = (int(pdf[c].iloc[0]) for c in ("label", "width", "home"))
        c, _ = shared.value.get((label, width), (None, None))
        raw = np.frombuffer(b"".join(at["x"]), kind).reshape(-1, width)
        seen = [home] if c is None else np.unique(np.concatenate([np.unique(cell) for _, _, cell, _ in visits(units(raw)[1], c)])).tolist()
        out = {"label": label, "width": width, "home": home, "many": (label, width) in shared.value, "id": min(at.index), "visits": seen}
        return pd.DataFrame([{**out, "node": at["node"].to_numpy(np.int64).tobytes(), "copies": at["copies"].to_numpy(np.int64).tobytes(), "x": raw.tobytes()}])

    by = names[:4]
    placed = vectors.mapInArrow(lean(place), "label long, width int, home int, part int, vec_id long, n long, key binary, x binary").repartition(parts, *by)
    return placed.groupBy(*by).applyInPandas(pack, "label long, width int, home int, many boolean, id binary, visits array<int>, node binary, copies binary, x binary")


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the left and the right block: (b, n) the links of each
    left vector, counted with copies, and (a, b) a forest of the links."""
    sides = [(g["node"].to_numpy(), g["copies"].to_numpy(), np.stack(g["x"].to_numpy())) for g in (pdf[pdf["left"]], pdf[~pdf["left"]]) if len(g)]
    return _links_between(*sides, both=False) if len(sides) == 2 else _links_between(NONE, NONE)


def _links_between(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], both: bool = True) -> pd.DataFrame:
    """``_block_links`` of two blocks (node, copies, x), with ``both`` counted
    for each right vector too. Products are taken BLOCK rows of either side at a
    time, first in single precision; what comes near COSINE is taken again in
    double."""
    out = pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    (lids, lcopies, x), (rids, rcopies, y) = left, right
    if not len(lids) or not len(rids):
        return out
    near, x1, y1 = np.float32(COSINE - (x.shape[1] + 4) * 2.0**-22), x.astype(np.float32), y.astype(np.float32)  # over twice the error of a single product
    alike = np.isin(lids, rids).any()
    ln, rn, parts = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    for start in range(0, len(x), BLOCK):
        for begin in range(0, len(y), BLOCK):
            hit = x1[start : start + BLOCK] @ y1[begin : begin + BLOCK].T >= near
            if alike:
                hit &= lids[start : start + BLOCK, None] != rids[None, begin : begin + BLOCK]
            at = np.flatnonzero(hit.any(1))
            if not len(at):
                continue
            at, to = start + at, begin + np.flatnonzero(hit[at].any(0))
            linked = (x[at] @ y[to].T >= COSINE) & (lids[at][:, None] != rids[to][None, :])
            at, to, linked = at[linked.any(1)], to[linked.any(0)], linked[np.ix_(linked.any(1), linked.any(0))]
            if not len(at):
                continue
            ln[at] += linked @ rcopies[to]
            rn[to] += lcopies[at] @ linked
            a, b, most = lids[at].copy(), rids[to].copy(), np.iinfo(np.int64).max
            while True:
                new_b = np.minimum(b, np.where(linked, a[:, None], most).min(0))
                new_a = np.minimum(a, np.where(linked, new_b[None, :], most).min(1))
                if (new_a == a).all() and (new_b == b).all():
                    break
                a, b = new_a, new_b
            parts.append(pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([lids[at], rids[to]]), "n": 0}))
    for ids, n in ((lids, ln), (rids, rn))[: 1 + both]:
        met = np.flatnonzero(n)
        if len(met):
            parts.append(pd.DataFrame({"a": ids[met], "b": ids[met], "n": n[met]}))
    return pd.concat([out, *parts]) if parts else out


def links(blocks: DataFrame, cells: dict[tuple[int, int], tuple[np.ndarray | None, np.ndarray]], parts: int) -> DataFrame:
    """(a, b, n), as of ``_block_links``: every block against itself, and every
    two of a label where each visits the other's cell. Blocks are read where two
    of them meet and not sent there, so nothing is shuffled."""
    shared = blocks.sparkSession.sparkContext.broadcast(cells)
    kind = {n: np.float32 if n == 4 else np.float64 for n in (4, 8)}

    def side(row: dict, end: str) -> tuple[np.ndarray, ...]:
        node, copies = (np.frombuffer(row[f"{c}{end}"], np.int64) for c in ("node", "copies"))
        raw = row[f"x{end}"]
        return node, copies, units(np.frombuffer(raw, kind[len(raw) // (len(node) * row["width"])]).reshape(len(node), -1))[1]

    def coming(block: tuple[np.ndarray, ...], row: dict, own: int, other: int) -> tuple[np.ndarray, ...]:
        """Those of a block that visit another's cell."""
        c, _ = shared.value.get((row["label"], row["width"]), (None, None))
        if c is None or own == other:
            return block
        apart = np.sqrt(max(0.0, 2 - 2 * float(c[own] @ c[other])))
        come = block[2] @ (c[own] - c[other]) <= REACH * apart + 1e-7
        return block if come.all() else tuple(v[come] for v in block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None, None  # a block meets many others one after another
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if held[0] != row["id"]:
                    held = row["id"], side(row, "")
                if "x2" in row:
                    got = _links_between(coming(held[1], row, row["home"], row["home2"]), coming(side(row, "2"), row, row["home2"], row["home"]))
                else:
                    node, copies, x = held[1]
                    one = pd.DataFrame({"node": node, "copies": copies, "x": list(x)})
                    got = _block_links(pd.concat([one.assign(left=True), one.assign(left=False)], ignore_index=True))
                if len(got):
                    yield pa.RecordBatch.from_pandas(got, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]), preserve_index=False)

    schema = "a long, b long, n long"
    found = blocks.select("id", "label", "width", "home", "node", "copies", "x").mapInArrow(lean(run), schema)
    if not cells:
        return found
    many = blocks.filter("many").drop("many").coalesce(parts)
    other = many.withColumnsRenamed({c: f"{c}2" for c in many.columns})
    meet = (F.col("label") == F.col("label2")) & (F.col("width") == F.col("width2")) & (F.col("id") < F.col("id2"))
    meet = meet & F.array_contains("visits", F.col("home2")) & F.array_contains("visits2", F.col("home"))
    pairs = many.hint("shuffle_replicate_nl").join(other, meet).select("id", "label", "width", "home", "node", "copies", "x", "home2", "node2", "copies2", "x2")
    return found.unionByName(pairs.mapInArrow(lean(run), schema))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors with equal labels link at a cosine of COSINE or more. A null
    label, and a vector that is null, empty, zero or holds a null or a
    non-finite value, links with nothing; so do vectors of unlike width. Equal
    vectors are compared once and counted as often as they occur. vec_id names
    a vector; rows without it link with nothing. Other columns are ignored; an
    empty table gives no rows. Cells save comparisons and lose no link. A vector
    is written twice at most, however many cells it visits.
    """
    kind = dict(vectors.dtypes)["embedding"]
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    rows = cut(keys(vectors))
    able = rows.filter("key is not null and vec_id is not null")
    groups = cut(able.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("width").alias("width")))
    total, numbers = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()
    cells = fit_cells(vectors, groups, total)
    size = numbers * (4 if kind == "array<float>" else 8) + 16 * total
    parts = max(math.ceil(math.sqrt(8 * vectors.sparkSession.sparkContext.defaultParallelism)), -(-size // PART))
    found = cut(links(cut(packed(vectors, cells, parts)), cells, parts))
    counts = found.filter("n > 0").groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("n"))
    reach = components(found.select("a", "b")).withColumnRenamed("id", "node")
    nodes = groups.select("key", "node", "copies").join(counts, "node", "left").join(reach, "node", "left")
    nodes = nodes.select("key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = join_skewed(able.select("vec_id", "key"), nodes, "key", "copies", rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
