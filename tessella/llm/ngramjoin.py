"""Exact Jaccard self-join of shingle sets through a token-group matrix.

Two sets link at a Jaccard similarity of 3/4 or more. With all shingles in one
global order, two linked sets share one of their first |x|/4 + 1 shingles, so
only these prefixes are shuffled. The order puts frequent shingles last; a
sketch of fixed size that has counted all documents says which they are.

1. Sets that share prefix shingles with a leader and verify against it form
   groups of similar documents.
2. The token-group matrix holds the union of prefix shingles of each group.
   Every document is a query against the groups that it has no links to so
   far; the number of its prefix shingles in a group's union bounds its overlap
   with any member, and only groups that reach the needed overlap are opened.
   A prefix with frequent shingles holds all others of its set, so two sets
   that share only frequent ones have no more in common than the lesser
   number of them.
3. An opened group is first met by its leader alone, on whole sets. That gives
   the exact overlap c of the query with the leader, and the shingles that it
   has besides; r of them are in the union of what the members have besides.
   No member shares more than c + r, nor more than its own overlap with the
   leader plus its own others. Members are kept in bands of equal size and
   overlap, so these bounds cost a row for each query and group, whatever the
   group's size.
4. Queries that pass meet the members in blocks of a bounded size. Every
   overlap follows exactly from what the two sets lack and have besides the
   leader's, so no text is read again; as all members are joined already, one
   link for a query and block is enough.

Documents that are already in one group need no further comparison for the
result, so a large group of copies costs a row for each copy and prefix
shingle, never one for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._components import components
from tessella.llm._shared import cut, lean, sized_batches, small_batches, table, text_batches
from tessella.llm._words import by_text, mix, word_hashes

WORDS, SKETCH_BITS, SALTS, BATCH, NEEDED_BITS, BANDS = 5, 22, 64, 1 << 19, 24, 32
OWN, VERIFY, QUERY, MEMBER = range(4)  # what a set is to the leader it meets
FREQUENT = 1 << 62
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct five-word shingles of each text as sorted 62-bit hashes.

    A-Z are lower-cased; words are runs without ASCII white space. A text with
    fewer than five words is one shingle; without words it has none.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    words, owner, _ = word_hashes(data)
    n = len(words) - WORDS + 1
    whole = np.zeros(max(0, n), np.uint64)
    for i in range(WORDS if n > 0 else 0):
        whole += words[i : i + n] * _FACTORS[i]
    whole = mix(whole) >> np.uint64(2)
    for part in by_text(owner, len(texts)):
        size = part.stop - part.start
        if size >= WORDS:
            yield np.unique(whole[part.start : part.stop - WORDS + 1])
        elif size:
            few = (words[part] * np.array(_FACTORS[:size])).sum(keepdims=True)
            yield mix(few + np.uint64(size)) >> np.uint64(2)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def _summed(docs: DataFrame) -> np.ndarray:
    """How often each bucket of shingles occurs: 2**SKETCH_BITS counters over
    all documents, whatever their number."""
    blocks, width = 64, 1 << (SKETCH_BITS - 6)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << SKETCH_BITS, np.int32)
        for pdf in frames:
            for part in text_batches(pdf, "text", BATCH):
                every = np.concatenate([*shingle_sets(part["text"].tolist()), np.zeros(0, np.uint64)])
                at, n = np.unique((every >> np.uint64(62 - SKETCH_BITS)).astype(np.int32), return_counts=True)
                seen[at] += n.astype(np.int32)
        held = seen.clip(max=255).astype(np.uint8).reshape(blocks, width)
        yield pd.DataFrame({"block": np.arange(blocks), "n": [b.tobytes() for b in held]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in frames:
            for block, n in zip(pdf["block"], pdf["n"], strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(n, np.uint8).astype(np.uint32)
        yield pd.DataFrame({"block": list(sums), "n": [s.astype(np.uint32).tobytes() for s in sums.values()]})

    parts = docs.select("text").mapInPandas(lean(run), "block int, n binary").repartition(16, "block").mapInPandas(add, "block int, n binary").collect()
    out = np.zeros((blocks, width), np.uint32)
    for row in parts:
        out[row["block"]] = np.frombuffer(row["n"], np.uint32)
    return out.reshape(-1)


def frequent_buckets(docs: DataFrame) -> np.ndarray:
    """Flags of the sketch buckets that hold a frequent shingle."""
    n = _summed(docs)
    mean = n.mean()
    return n >= mean + 4 * np.sqrt(mean) + 8


def prefix_length(n: int) -> int:
    """Of n shingles in order, how many any set at 3/4 must share one of."""
    return n - (3 * n + 3) // 4 + 1


def ordered(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles in the global order: by hash, the frequent ones last."""
    late = frequent[(shingles >> np.uint64(62 - SKETCH_BITS)).astype(np.int64)]
    return np.concatenate([shingles[~late], shingles[late] | np.uint64(FREQUENT)]).astype(np.int64)


def signatures(docs: DataFrame, frequent) -> DataFrame:
    """(doc_id, key, n, fp, rest, last, late, prefix): the size and fingerprint of
    each document's set, and once in a task for each fingerprint its prefix, the
    shingles after it, its last one and the frequent shingles of the whole set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, seen = frequent.value, set()
        for pdf in frames:
            for part in text_batches(pdf, "text", BATCH):
                out = []
                for key, s in zip(part["key"], shingle_sets(part["text"].tolist()), strict=True):
                    if not len(s):
                        out.append((key, 0, None, None, None, None, None))
                        continue
                    fp = fingerprint(s)
                    if fp in seen:
                        out.append((key, len(s), fp, None, None, None, None))
                        continue
                    if len(seen) < 200_000:
                        seen.add(fp)
                    whole = ordered(s, flags)
                    prefix = whole[: prefix_length(len(s))]
                    out.append((key, len(s), fp, len(s) - len(prefix), int(prefix[-1]), int((whole >= FREQUENT).sum()), prefix))
                cols = dict(zip(("key", "n", "fp", "rest", "last", "late", "prefix"), zip(*out, strict=True), strict=True))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, **{c: v if c == "prefix" else pd.array(v, dtype="Int64") for c, v in cols.items()}})

    return docs.mapInPandas(lean(run), "doc_id long, key long, n long, fp long, rest long, last long, late long, prefix array<long>")


def needed(n1, n2):
    """The overlap that sets of these sizes need: 3/7 of their sum, rounded up."""
    return F.ceil((n1 + n2) * 3 / F.lit(7))


def bounded(pairs: DataFrame) -> DataFrame:
    """The pairs whose ``common`` prefix shingles leave the needed overlap
    possible. Up to the lesser last prefix shingle both sets are known, so the
    set with that one can share no more than its rest besides."""
    rest = F.when(F.col("last_a") < F.col("last_b"), F.col("rest_a")).otherwise(F.col("rest_b"))
    return pairs.filter(F.col("common") + rest >= needed(F.col("n_a"), F.col("n_b")))


def _bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """A bitmap of fixed size with the hashes of ``ids``."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << (NEEDED_BITS - 8), bool)
        bits[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"block": [int(key[0])], "bits": [np.packbits(bits).tobytes()]})

    low = F.pmod(F.col(col), F.lit(1 << NEEDED_BITS))
    at = ids.select(F.shiftright(low, NEEDED_BITS - 8).alias("block"), F.pmod(low, F.lit(1 << (NEEDED_BITS - 8))).alias("at")).distinct()
    out = np.zeros((256, 1 << (NEEDED_BITS - 11)), np.uint8)
    for row in at.groupBy("block").applyInPandas(run, "block long, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def overlaps(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, role, n_a, n_b, common, linked, rest, gaps) of pairs (a, b, role)
    of fingerprints, on whole sets. A pair of role VERIFY is left out unless it
    links; a pair of another role, unless it is a query that links, has in
    ``rest`` the shingles of b that a lacks and in ``gaps`` the places in a of
    the shingles that b lacks.

    A bitmap of fixed size picks the documents that stand for a set in
    ``pairs`` (and few others), so that only their texts are shuffled,
    compressed; they are smaller than their sets. Each a meets its partners in
    blocks: its own text comes first, the others stream past it.
    """
    spark = docs.sparkSession
    pairs = cut(pairs.select("a", "b", "role"))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 1024).cast("int").alias("blocks"))
    placed = pairs.join(sizes, "a").select("a", "role", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("fp"))
    own = sizes.select("a", F.lit(OWN).alias("role"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("fp"))
    ends = cut(placed.unionByName(own).join(sets.select("fp", "key"), "fp").select("key", "fp", "a", "block", "role"))
    wanted = spark.sparkContext.broadcast(np.packbits(_bitmap(ends, "key")))

    def squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        tool, bits = zstandard.ZstdCompressor(level=3), wanted.value
        for pdf in frames:
            at = pdf["key"].to_numpy(np.int64) % (1 << NEEDED_BITS)
            part = pdf[(bits[at >> 3] >> (7 - (at & 7))) & 1 == 1]
            yield pd.DataFrame({"key": part["key"], "z": [tool.compress(t.encode("utf-8", "surrogatepass")) for t in part["text"]]})

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        tool, group, own, done = zstandard.ZstdDecompressor(), None, None, set()
        for pdf in frames:
            pdf = pdf.assign(size=[zstandard.frame_content_size(z) for z in pdf["z"]])
            for part in sized_batches(pdf, "size", BATCH):
                out = []
                texts = [tool.decompress(z).decode("utf-8", "surrogatepass") for z in part["z"]]
                for a, block, fp, role, s in zip(part["a"].tolist(), part["block"].tolist(), part["fp"].tolist(), part["role"].tolist(), shingle_sets(texts), strict=True):
                    if group != (a, block):
                        group, own, done = (a, block), None, set()
                    if fp in done or fingerprint(s) != fp:  # rows that repeat an id may differ
                        continue
                    done.add(fp)
                    if fp == a:
                        own = s
                        continue
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    shared = own[at] == s
                    common = int(shared.sum())
                    linked = 100 * common >= 75 * (len(own) + len(s) - common)
                    if role == VERIFY and not linked:
                        continue
                    rest = gaps = []
                    if role == MEMBER or (role == QUERY and not linked):
                        lacking = np.ones(len(own), bool)
                        lacking[at[shared]] = False
                        rest, gaps = s[~shared].astype(np.int64), np.flatnonzero(lacking).astype(np.int32)
                    out.append((a, fp, role, len(own), len(s), common, linked, rest, gaps))
                yield pd.DataFrame(out, columns=["a", "b", "role", "n_a", "n_b", "common", "linked", "rest", "gaps"])

    texts = docs.select("key", "text").filter("text is not null").mapInPandas(lean(squeeze), "key long, z binary")
    rows = texts.join(ends, "key").select("a", "block", "role", "fp", "z").repartition("a", "block").sortWithinPartitions("a", "block", "role")
    return rows.mapInPandas(lean(compare), "a long, b long, role int, n_a long, n_b long, common long, linked boolean, rest array<long>, gaps array<int>")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints whose whole sets link."""
    return overlaps(docs, pairs.select("a", "b", F.lit(VERIFY).alias("role")), sets).select("a", "b")


def sharing(sig: DataFrame) -> DataFrame:
    """(token, fp): the prefix shingles that several sets share. A frequent
    shingle is dealt over SALTS parts and taken as shared."""
    rows = sig.filter("prefix is not null").select("fp", F.explode("prefix").alias("token"))
    salt = F.when(F.col("token") >= FREQUENT, F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).otherwise(0)
    order = Window.partitionBy("token", "salt").orderBy("fp")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("salt", salt).withColumns({"first": F.first("fp").over(whole), "end": F.last("fp").over(whole), "before": F.lag("fp").over(order)})
    once = F.col("before").isNull() | (F.col("before") != F.col("fp"))  # tasks repeat copies
    return cut(rows.filter(once & ((F.col("first") < F.col("end")) | (F.col("token") >= FREQUENT))).select("token", "fp"))


def followers(shared: DataFrame) -> DataFrame:
    """(a, b, common): every set b with the leaders a of its shingles. The
    leader of a shingle is the set with the most shared prefix shingles: an
    unchanged original rather than one of its edited copies."""
    weight = shared.groupBy("fp").agg(F.count(F.lit(1)).alias("w"))
    leads = shared.join(weight, "fp").groupBy("token").agg(F.max(F.struct("w", "fp")).alias("m")).select("token", F.col("m.fp").alias("a"))
    return shared.join(leads, "token").filter("fp <> a").groupBy("a", F.col("fp").alias("b")).agg(F.count(F.lit(1)).alias("common"))


def grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with their group, named by its leader, and ``comp``, what links
    have joined so far. A set is in the group of the leader that it was
    verified against; a leader, and a set without one, in its own."""
    leaders = links.select(F.col("a").alias("b")).distinct()
    placed = links.join(leaders, "b", "left_anti").select(F.col("b").alias("fp"), F.col("a").alias("lead"))
    comp = components(links).withColumnsRenamed({"id": "fp", "component": "comp"})
    known_rest = F.when(F.col("last") < FREQUENT, F.col("rest")).otherwise(F.col("late"))  # beyond the prefix, or the frequent ones
    rows = sets.join(placed, "fp", "left").join(comp, "fp", "left")
    return rows.select("fp", "n", "rest", "late", known_rest.alias("known_rest"), F.coalesce("lead", "fp").alias("grp"), F.coalesce("comp", "fp").alias("comp"))


def met_groups(rows: DataFrame, member: DataFrame) -> DataFrame:
    """The shared shingles of every query and the groups that it may meet. A
    frequent one is left out where even all the frequent shingles of both sides
    are too few; a pair that links nevertheless shares others."""
    facts = member.groupBy("grp").agg(
        F.count(F.lit(1)).alias("members"), F.min("comp").alias("comp"), F.min("n").alias("least"), F.max("rest").alias("most_rest"), F.max("known_rest").alias("most_known_rest"),
    )
    matrix = rows.groupBy("token", "grp").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("late").alias("most_late")).join(facts, "grp")
    matrix = matrix.filter((F.col("token") < FREQUENT) | (4 * F.col("most_late") >= 3 * F.col("least_n")))
    own = member.join(facts.select("grp", F.col("members").alias("own")), "grp").select("fp", "rest", "known_rest", "own", F.col("grp").alias("own_grp"), F.col("comp").alias("own_comp"))
    asks = rows.filter((F.col("token") < FREQUENT) | (4 * F.col("late") >= 3 * F.col("n"))).select("token", "fp", "n", "late").join(own, "fp")
    other = F.expr("comp <> own_comp and (own, own_grp) < (members, grp) and 3 * n <= 4 * most_n and 3 * least_n <= 4 * n")
    enough = F.least("late", "most_late") >= needed(F.col("n"), F.greatest("least_n", F.ceil(F.col("n") * 0.75)))
    return asks.join(matrix, "token").filter(other & ((F.col("token") < FREQUENT) | enough))


def opened_groups(met: DataFrame) -> DataFrame:
    """(fp, grp): the groups that may hold a partner of the query."""
    bound = needed(F.col("n"), F.greatest("least", F.ceil(F.col("n") * 0.75)))
    keys = ["fp", "grp", "n", "rest", "known_rest", "least", "most_rest", "most_known_rest"]
    counts = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("token") < FREQUENT).alias("rare"))
    by_rare = (F.col("rare") > 0) & (F.col("rare") + F.greatest("known_rest", "most_known_rest") >= bound)
    return counts.filter(by_rare | (F.col("common") + F.greatest("rest", "most_rest") >= bound)).select("fp", "grp")


def searched(docs: DataFrame, opened: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of queries with the groups opened to them, at least one
    for each query and group that link."""
    opened = cut(opened)
    inside = member.filter("fp <> grp").join(opened.select("grp").distinct(), "grp").select(F.col("grp").alias("a"), F.col("fp").alias("b"), F.lit(MEMBER).alias("role"))
    several = inside.select(F.col("a").alias("grp"), F.lit(QUERY).alias("role")).distinct()
    asked = opened.join(several, "grp", "left").select(F.col("grp").alias("a"), F.col("fp").alias("b"), F.coalesce("role", F.lit(VERIFY)).alias("role"))
    met = cut(overlaps(docs, asked.union(inside), sets))
    held, asks = met.filter(F.col("role") == MEMBER), met.filter((F.col("role") == QUERY) & ~F.col("linked"))

    # Bands of members: few, as the sizes of a group are within 3/4 of its leader's.
    band = lambda c: F.floor(F.log2(c) * BANDS).cast("int")
    bands = held.groupBy("a", band("n_b").alias("size"), band("common").alias("shared")).agg(
        F.min("n_b").alias("least"), F.max("n_b").alias("most"), F.max("common").alias("c"), F.max(F.col("n_b") - F.col("common")).alias("r"),
    )
    bands = bands.groupBy("a").agg(F.collect_list(F.struct("least", "most", "c", "r")).alias("bands"))
    union = held.select("a", F.explode("rest").alias("token")).distinct()
    besides = asks.select("a", "b", F.explode("rest").alias("token")).join(union, ["a", "token"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"))
    n, c, r = F.col("n_b"), F.col("common"), F.coalesce("r", F.lit(0))
    passes = F.exists("bands", lambda x: (3 * n <= 4 * x["most"]) & (F.least(c, x["c"]) + F.least(r, x["r"]) >= needed(n, F.greatest(x["least"], F.ceil(n * 0.75)))))
    asks = asks.join(besides, ["a", "b"], "left").join(bands, "a").filter(passes).select(*held.columns)
    return met.filter(F.col("linked") & (F.col("role") != MEMBER)).select("a", "b").union(met_members(held, asks))


def met_members(held: DataFrame, asks: DataFrame) -> DataFrame:
    """(a, b): a member and the query it links with, one for each query and
    block of members. A block holds about 2**18 shingles that its members lack
    or have besides their leader's; queries stream past it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, block = None, [], None
        for pdf in frames:
            good = []
            for row in pdf.itertuples(index=False):
                if at != (row.a, row.block):
                    at, rows, block = (row.a, row.block), [], None
                if row.role == MEMBER:
                    rows.append((row.b, row.n_b, row.rest, row.gaps))
                    continue
                block = block or _Block(rows)
                if (found := block.partner(row)) is not None:
                    good.append((found, row.b))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    blocks = held.groupBy("a").agg(F.ceil(F.sum(F.size("rest") + F.size("gaps") + 1) / (1 << 18)).cast("int").alias("blocks"))
    own = held.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    every = asks.join(blocks, "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = own.unionByName(every).select("a", "block", "role", "b", "n_a", "n_b", "rest", "gaps")
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("role") != MEMBER).mapInPandas(lean(run), "a long, b long")


class _Block:
    """Members of a group by the shingles they lack and have besides."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = [r[0] for r in rows]
        self.n, self.lack = np.array([r[1] for r in rows], np.int64), np.array([len(r[3]) for r in rows], np.int64)
        self.tables = []
        for k in (2, 3):
            token, owner = np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r[k]) for r in rows])
            order = np.argsort(token, kind="stable")
            self.tables.append((token[order], owner[order]))

    def partner(self, query) -> int | None:
        """A member that links with the query, if there is one."""
        common = query.n_a - len(query.gaps) - self.lack
        for (token, owner), asked in zip(self.tables, (query.rest, query.gaps), strict=True):
            low, high = np.searchsorted(token, asked, "left"), np.searchsorted(token, asked, "right")
            size = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
            common = common + np.bincount(owner[at], minlength=len(self.ids))
        linked = np.flatnonzero(100 * common >= 75 * (self.n + query.n_b - common))
        return self.ids[linked[0]] if len(linked) else None


def link_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest id reachable by links of 100 * intersection
    >= 75 * union. A null text, or one without words, has no shingles and
    links with nothing; texts with equal sets always link. Rows without an id
    keep their size and have the component of their set. Repeated rows give a
    row each; other columns are ignored; an empty table gives no rows. A text of
    any length enters whole; its words are hashed in slices.
    Shingles are told apart by 62 bits, sets by 64.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("key"), text.alias("text"))
    small_batches(docs.sparkSession)
    return _link_groups(docs)


def _link_groups(docs: DataFrame) -> DataFrame:
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_buckets(docs))
    sig = cut(signatures(docs, frequent))
    sets = cut(sig.filter("prefix is not null").groupBy("fp").agg(F.min("n").alias("n"), F.min("rest").alias("rest"), F.min("last").alias("last"), F.min("late").alias("late"), F.min("key").alias("key")))
    shared = sharing(sig)

    def with_sizes(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("fp").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "rest", "last"))), end)
        return pairs

    # Groups of similar documents: each set with the leader it shares most with.
    star = bounded(with_sizes(followers(shared)))
    best = star.groupBy("b").agg(F.max(F.struct("common", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = cut(verified(docs, best, sets))

    # The token-group matrix, and every document against the other groups.
    member = cut(grouped(sets, links))
    placed = cut(shared.join(member.select("fp", "n", "late", "grp", "comp"), "fp"))
    several = placed.groupBy("token").agg(F.min("comp").alias("g1"), F.max("comp").alias("g2")).filter("g1 < g2").select("token")
    rows = cut(placed.join(several, "token"))
    links = cut(links.union(searched(docs, opened_groups(met_groups(rows, member)), member, sets)))

    reach = components(links).withColumnsRenamed({"id": "fp", "component": "top"})
    named = sig.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first")).join(reach, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    named = cut(named)
    least = named.groupBy("top").agg(F.min("first").alias("component_id"))
    found = named.join(least, "top").select("fp", "component_id")
    return sig.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(found, "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(table(spark, sf_dir, "documents"))
