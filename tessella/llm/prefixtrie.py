"""The prefix trie of conversations, read from sorted sequences.

Distinct conversations are sorted as sequences of turn hashes and dealt in
order into blocks. The longest common prefixes (LCP) of neighbours form an array
whose Cartesian tree is the trie without its unary nodes: the node of a boundary
reaches from the nearest smaller LCP on its left to the nearest smaller on its
right. Each block finds those of its own boundaries by a stack; for the rest,
the block minima name the block that holds the answer, which is asked for it.
Boundaries of equal LCP under one node are merged, the depths between a node and
its parent are expanded, and all that a node counts is a difference of running
sums at its two ends or a minimum over its interval.

Notation: sequence i of a block has boundary i to its left, with LCP L[i]; a
node covers the sequences from l up to, without, e. Boundaries before the first
and after the last sequence of all have the LCP -1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._shared import crc32_sql, cut, table

GROUP, HEADS = 100, 6
BLOCK_BYTES, BLOCK_ROWS, MOST_BLOCKS, CHUNK = 1 << 22, 20_000, 1 << 17, 4096
TURN = 16  # bytes of a turn's hash
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max


# -- conversations ------------------------------------------------------------
def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each rebuilt conversation as the concatenated
    hashes of its turns and the code points of their texts."""
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    hashed = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    placed = rows.select("conv_id", F.row_number().over(order).alias("pos"), hashed.alias("hash"), F.length("text").cast("long").alias("size"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "size"))).alias("turns"))
    whole = cut(whole.select("conv_id", F.col("turns.hash").alias("hash"), F.col("turns.size").alias("size")))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    own = whole.select("*", first.alias("from"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    heads = whole.filter(F.col("conv_id") == first).select(F.col("conv_id").alias("from"), F.slice("hash", 1, HEADS).alias("head"), F.slice("size", 1, HEADS).alias("head_size"))
    joined = own.join(heads, "from", "left")
    parts = lambda head, tail: F.concat(F.coalesce(F.slice(F.col(head), F.lit(1), F.col("h")), F.slice(F.col(tail), 1, 0)), F.slice(F.col(tail), F.col("h") + 1, F.size(tail)))
    return joined.select("conv_id", F.unhex(F.array_join(parts("head", "hash"), "")).alias("path"), parts("head_size", "size").alias("sizes"))


def member_digests(convs: DataFrame) -> DataFrame:
    """(path, ends): SHA-256 of the sorted, comma-joined ids of equal
    conversations. Ids are joined in chunks by the tasks that sort them; a
    digest is sequential, so the chunks of a path stream through one task, one
    at a time."""

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), CHUNK):
                ids = pdf.iloc[start : start + CHUNK].groupby("path")["conv_id"]
                yield ids.agg(first="min", ids=lambda x: ",".join(map(str, x))).reset_index()

    def digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = sha = None
        for pdf in frames:
            out = []
            for p, ids in zip(pdf["path"], pdf["ids"], strict=True):
                if sha is not None and p == path:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    out.append((path, sha.hexdigest()))
                path, sha = p, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["path", "ends"])
        if sha is not None:
            yield pd.DataFrame([(path, sha.hexdigest())], columns=["path", "ends"])

    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = convs.select(F.md5("path").alias("path"), "conv_id").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    chunks = ids.mapInPandas(joined, "path string, first long, ids string")
    return chunks.repartition("path").sortWithinPartitions("path", "first").mapInPandas(digested, "path string, ends string")


def sorted_blocks(convs: DataFrame, most: int) -> DataFrame:
    """(block, path, sizes, n, least, ends): the distinct conversations in
    order; a block is a range of them, of about BLOCK_BYTES or ``most`` rows."""
    seqs = convs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes"))
    seqs = cut(seqs.withColumn("id", F.md5("path")).join(member_digests(convs).withColumnRenamed("path", "id"), "id").drop("id"))
    size = seqs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("path")).alias("bytes")).first()
    blocks = min(MOST_BLOCKS, max(1, size["n"] // most, (size["bytes"] or 0) // BLOCK_BYTES))
    return cut(seqs.repartitionByRange(blocks, "path").sortWithinPartitions("path").withColumn("block", F.spark_partition_id()))


# -- blocks -------------------------------------------------------------------
def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share at their start."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    x, y = (np.frombuffer(p, np.uint64, 2 * n) for p in (a, b))
    return int(np.argmax(x != y)) // 2


class Block:
    """One range of sequences with its LCPs and running sums."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        rows = pdf[pdf["side"] == 0].sort_values("path")
        before, after = (pdf[pdf["side"] == s] for s in (-1, 1))
        paths = rows["path"].tolist()
        lcp = [common_turns(before["path"].iloc[0], paths[0]) if len(before) else -1]
        lcp += [common_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)]
        lcp.append(common_turns(paths[-1], after["path"].iloc[0]) if len(after) else -1)
        self.number, self.size = int(rows["block"].iloc[0]), len(paths)
        self.after = int(after["block_of"].iloc[0]) if len(after) else -1
        self.lcp = np.array(lcp, np.int64)  # one more than sequences: the next block's first is the last
        self.depth = np.array([len(p) // TURN for p in paths], np.int64)
        self.texts = [np.concatenate([[0], np.cumsum(np.array(s, np.int64))]) for s in rows["sizes"]]
        self.n, self.least, self.ends = rows["n"].to_numpy(np.int64), rows["least"].to_numpy(np.int64), rows["ends"].tolist()
        total = np.array([t[-1] for t in self.texts], np.int64)
        fresh = np.array([t[-1] - t[max(0, d)] for t, d in zip(self.texts, lcp, strict=False)], np.int64)
        run = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.sums = {"n": run(self.n), "text": run(self.n * total), "fresh": run(fresh), "leaves": run(self.depth > self.lcp[1:])}
        self.from_here = np.minimum.accumulate(self.least[::-1])[::-1]
        self.up_to = np.concatenate([[FAR], np.minimum.accumulate(self.least)])

    def smaller(self) -> tuple[np.ndarray, np.ndarray]:
        """For every boundary the nearest smaller one to the left (-1: none
        here) and to the right (size + 1: none here)."""
        left, right, stack = np.full(self.size + 1, -1), np.full(self.size + 1, self.size + 1), []
        lcp = self.lcp.tolist()
        for i, v in enumerate(lcp):
            while stack and lcp[stack[-1]] > v:
                right[stack.pop()] = i
            if stack:
                left[i] = stack[-1] if lcp[stack[-1]] < v else left[stack[-1]]
            stack.append(i)
        # Boundaries left on the stack have no smaller one here.
        return left, right

    def name(self, boundary: int, left: np.ndarray) -> str | None:
        """Names the node of a boundary: by its first sequence, or by the block
        where the boundary stands if that lies further left."""
        v = int(self.lcp[boundary])
        if v < 0:
            return None
        if boundary == self.size and self.after >= 0:
            return f"{self.after}~{v}"
        return f"{self.number}.{left[boundary]}.{v}" if left[boundary] >= 0 else f"{self.number}~{v}"

    def start(self, at: int, depth: int, left: np.ndarray) -> dict:
        """What a node needs to know of its first sequence."""
        low = int(self.lcp[at])
        return {
            "l_block": self.number, "l_at": at, "l_lcp": low, "l_least": int(self.from_here[at]), "l_n": int(self.sums["n"][at]), "l_text": int(self.sums["text"][at]),
            "l_fresh": int(self.sums["fresh"][at + 1]), "l_leaves": int(self.sums["leaves"][at]), "l_deep": bool(self.depth[at] > depth), "l_total": int(self.texts[at][-1]),
            "ends": self.ends[at] if self.depth[at] == depth else EMPTY_SHA, "texts": self.texts[at][max(0, low) : depth + 1].tolist(), "l_up": self.name(at, left),
        }

    def stop(self, at: int, left: np.ndarray) -> dict:
        """What a node needs to know of the boundary after its last sequence."""
        return {
            "e_block": self.number, "e_at": at, "e_lcp": int(self.lcp[at]), "e_least": int(self.up_to[at]), "e_n": int(self.sums["n"][at]), "e_text": int(self.sums["text"][at]),
            "e_fresh": int(self.sums["fresh"][at]), "e_leaves": int(self.sums["leaves"][at]), "e_up": self.name(at, left),
        }


START = "l_block int, l_at int, l_lcp long, l_least long, l_n long, l_text long, l_fresh long, l_leaves long, l_deep boolean, l_total long, ends string, texts array<long>, l_up string"
STOP = "e_block int, e_at int, e_lcp long, e_least long, e_n long, e_text long, e_fresh long, e_leaves long, e_up string"
NODE = f"name string, depth long, merged long, inside long, {START}, {STOP}, l_ask int, e_ask int"
STATS = "block int, lowest long, least long, n long, text long, fresh long, leaves long"


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
    for c in schema.split(", "):
        name, kind = c.split()
        if kind in ("int", "long"):
            out[name] = out[name].astype("Int32" if kind == "int" else "Int64")
    return out


def _stats(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    b = Block(pdf)
    return pd.DataFrame([(b.number, b.lcp[:-1].min(), b.least.min(), *(b.sums[c][-1] for c in ("n", "text", "fresh", "leaves")))], columns=[c.split()[0] for c in STATS.split(", ")])


def _nodes(pdf: pd.DataFrame, numbers: np.ndarray, lowest: np.ndarray) -> pd.DataFrame:
    """The nodes of a block's boundaries and of the sequences that end in a
    leaf; ``l_ask`` and ``e_ask`` name the block that knows an open end."""
    b = Block(pdf)
    left, right = b.smaller()
    here = int(np.searchsorted(numbers, b.number))
    back, ahead = np.minimum.accumulate(lowest[:here][::-1]), np.minimum.accumulate(lowest[here + 1 :])
    first_below = lambda run, v: int(np.searchsorted(-run, -v, side="right"))
    merged: dict[tuple[int, int], list[int]] = {}
    for j in range(b.size):
        if b.lcp[j] >= 0:
            merged.setdefault((int(left[j]), int(b.lcp[j])), []).append(j)
    rows = []
    for (at, v), members in merged.items():
        e = int(right[members[-1]])
        row = {"name": b.name(members[0], left), "depth": v, "merged": len(members), "l_ask": None, "e_ask": None, "inside": None}
        if at >= 0:
            row |= b.start(at, v, left)
        else:
            row["l_ask"] = int(numbers[here - 1 - first_below(back, v)])
        if e <= b.size:
            row |= b.stop(e, left)
            if at >= 0:
                row["inside"] = int(b.least[at:e].min())
        else:
            k = first_below(ahead, v)
            row["e_ask"] = int(numbers[here + 1 + k]) if k < len(ahead) else int(numbers[-1])
        rows.append(row)
    for i in np.flatnonzero(b.depth > b.lcp[1:]).tolist():
        d = int(b.depth[i])
        rows.append({"name": f"{b.number}.{i}.{d}", "depth": d, "merged": 0, "inside": int(b.least[i]), "l_ask": None, "e_ask": None} | b.start(i, d, left) | b.stop(i + 1, left))
    return _frame(rows, NODE)


def _answers(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The last boundary below a depth, or the first one (the block's end if
    there is none), for nodes that are open to the right or to the left."""
    b = Block(pdf)
    left, _ = b.smaller()
    first, last = np.minimum.accumulate(b.lcp), np.minimum.accumulate(b.lcp[:-1][::-1])
    rows = []
    for name, v, to_left in zip(asked["name"], asked["depth"], asked["to_left"], strict=True):
        if to_left:
            rows.append({"name": name, "to_left": True} | b.start(b.size - 1 - int(np.searchsorted(-last, -v, side="right")), int(v), left))
        else:
            rows.append({"name": name, "to_left": False} | b.stop(min(b.size, int(np.searchsorted(-first, -v, side="right"))), left))
    return _frame(rows, f"name string, to_left boolean, {START}, {STOP}")


def trie(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Turns are ordered by (turn, role, text), nulls first; a null role or text
    reads as empty, repeated rows are turns of their own, and rows without
    conv_id belong to no conversation. Equal conversations are one sequence with
    a count. Texts of any length enter as a hash and a count; a conversation's
    hashes (16 bytes a turn) are one row, and those of 4 MB or 20,000 sequences
    one block, of which there are 2^17 at most. Other columns are ignored; an
    empty table has no conversation and so no node.
    """
    spark = turns.sparkSession
    blocks = sorted_blocks(cut(rebuilt(turns)), block_rows)
    edges = cut(blocks.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    numbers = sorted(r["block"] for r in edges.select("block").collect())  # MOST_BLOCKS at most
    if not numbers:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    order = F.broadcast(spark.createDataFrame(list(zip(numbers, [None, *numbers[:-1]], [*numbers[1:], None], strict=True)), "block int, prior int, next int"))
    known = edges.join(order, "block")
    none = [F.lit(0).cast("long").alias(c) for c in ("n", "least")]  # a null would turn ids into doubles
    before = known.filter("next is not null").select(F.col("next").alias("block"), F.lit(-1).alias("side"), F.col("last").alias("path"), F.col("block").alias("block_of"), *none)
    after = known.filter("prior is not null").select(F.col("prior").alias("block"), F.lit(1).alias("side"), F.col("first").alias("path"), F.col("block").alias("block_of"), *none)
    rows = cut(blocks.withColumns({"side": F.lit(0), "block_of": F.col("block")}).unionByName(before, True).unionByName(after, True))
    stats = rows.groupBy("block").applyInPandas(_stats, STATS).toPandas().sort_values("block")
    shared = spark.sparkContext.broadcast((stats["block"].to_numpy(), stats["lowest"].to_numpy()))

    nodes = cut(rows.groupBy("block").applyInPandas(lambda pdf: _nodes(pdf, *shared.value), NODE))
    asks = [nodes.filter(f"{side}_ask is not null").select(F.col(f"{side}_ask").alias("ask"), "name", "depth", F.lit(side == "l").alias("to_left")) for side in "le"]
    asked = asks[0].unionByName(asks[1])

    def answer(key: tuple, pdf: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        return _answers(pdf, questions) if len(questions) else _frame([], f"name string, to_left boolean, {START}, {STOP}")

    named = rows.join(F.broadcast(asked.select(F.col("ask").alias("block")).distinct()), "block", "left_semi")
    answers = cut(named.groupBy("block").cogroup(asked.groupBy("ask")).applyInPandas(answer, f"name string, to_left boolean, {START}, {STOP}"))
    for side, columns in (("l", START), ("e", STOP)):
        names = [c.split()[0] for c in columns.split(", ")]
        said = answers.filter(F.col("to_left") == (side == "l")).select("name", *(F.col(c).alias(f"said_{c}") for c in names))
        closed = nodes.filter(f"{side}_ask is null")
        opened = nodes.filter(f"{side}_ask is not null").drop(*names).join(said, "name").withColumnsRenamed({f"said_{c}": c for c in names})
        nodes = closed.unionByName(opened)

    # Sums before each block, and the least id of the blocks between two.
    sums = ["n", "text", "fresh", "leaves"]
    offsets = stats[["block"]].assign(**{c: stats[c].cumsum() - stats[c] for c in sums})
    offsets = spark.createDataFrame(offsets, "block int, n long, text long, fresh long, leaves long")
    at = lambda side: F.broadcast(offsets.select(F.col("block").alias(f"{side}_block"), *(F.col(c).alias(f"{side}_off_{c}") for c in sums)))
    mins = spark.sparkContext.broadcast((stats["block"].to_numpy(), _sparse(stats["least"].tolist())))
    nodes = nodes.drop("l_ask", "e_ask")
    far = nodes.filter("inside is null")

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, levels = mins.value
        for pdf in frames:
            lo, hi = np.searchsorted(known, pdf["l_block"]) + 1, np.searchsorted(known, pdf["e_block"])
            yield pdf.assign(inside=np.minimum(_range_min(levels, lo, hi), np.minimum(pdf["l_least"], pdf["e_least"])))

    near = nodes.filter("inside is not null")
    merged = near.unionByName(far.mapInPandas(across, far.schema))
    over = lambda c: F.col(f"e_off_{c}") + F.col(f"e_{c}") - F.col(f"l_off_{c}") - F.col(f"l_{c}")
    counted = merged.join(at("l"), "l_block").join(at("e"), "e_block").select(
        "name", F.concat_ws(".", "l_block", "l_at", "depth").alias("node"), "depth", "merged", F.col("inside").alias("conv_id"), over("n").alias("n_convs"), over("text").alias("text"),
        over("fresh").alias("fresh"), over("leaves").alias("n_leaves"), "l_deep", "l_total", "l_lcp", "e_lcp", "ends", "texts", F.when(F.col("l_lcp") >= F.col("e_lcp"), F.col("l_up")).otherwise(F.col("e_up")).alias("up"),
    )
    counted = cut(counted)
    alias = counted.filter("name <> node").select(F.col("name").alias("up"), F.col("conv_id").alias("up_conv"))
    same = [c for c in counted.columns if c not in ("name", "node", "depth", "merged")]
    whole = counted.groupBy("node", "depth").agg(F.sum("merged").alias("merged"), *(F.max(c).alias(c) for c in same))
    names = whole.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv")).unionByName(alias)
    low = F.greatest("l_lcp", "e_lcp")
    each = whole.join(names, "up", "left").withColumn("d", F.explode(F.sequence(low + 1, F.col("depth"))))
    # ``texts`` are the code points up to each depth, from that of l_lcp on.
    earlier = F.when(F.col("d") == 0, F.lit(0)).otherwise(F.get("texts", (F.col("d") - 1 - F.greatest(F.col("l_lcp"), F.lit(0))).cast("int")))
    deepest = F.col("d") == F.col("depth")
    return each.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == 0, None).when(F.col("d") > low + 1, F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"), "n_convs",
        F.when(deepest, F.col("merged") + F.col("l_deep").cast("long")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("text") - F.col("n_convs") * earlier - (F.col("fresh") + F.col("l_total") - earlier)).alias("saved_tokens"),
        F.when(deepest, F.col("ends")).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def _sparse(values: list[int]) -> list[np.ndarray]:
    """Minima of 1, 2, 4, ... values from each place on."""
    levels = [np.array(values, np.int64)]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of the values from lo up to, without, hi; FAR if there are none."""
    out = np.full(len(lo), FAR)
    for i in np.flatnonzero(hi > lo).tolist():
        k = int(hi[i] - lo[i]).bit_length() - 1
        out[i] = min(levels[k][lo[i]], levels[k][hi[i] - 2**k])
    return out


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), re AS (
  SELECT ids.conv_id, 0 AS part, pos, role, text FROM ids JOIN t ON t.conv_id = ids.base AND pos <= h
  UNION ALL SELECT ids.conv_id, 1, pos, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND pos > h
), p AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS size FROM ids
  UNION ALL SELECT conv_id, row_number() OVER w, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w), length(text)
  FROM re WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), n AS (
  SELECT depth, prefix, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, string_agg(CASE WHEN depth = last THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id) AS ends
  FROM p JOIN (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id) l ON l.conv_id = p.conv_id GROUP BY depth, prefix
), up AS (SELECT n.depth, n.prefix, p.prefix AS above FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM up GROUP BY ALL),
sub AS (
  SELECT p.depth, p.prefix, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (WHERE k.depth IS NULL) AS n_leaves
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.depth = n.depth AND k.prefix = n.prefix GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN sub s ON s.depth = n.depth AND s.prefix = n.prefix LEFT JOIN kids k ON k.depth = n.depth AND k.prefix = n.prefix
LEFT JOIN up ON up.depth = n.depth AND up.prefix = n.prefix LEFT JOIN n a ON a.depth = n.depth - 1 AND a.prefix = up.above
"""
