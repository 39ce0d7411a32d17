"""Chat formatting by cumulative-snapshot collapse.

Loggers write a conversation again after every turn, so the same talk arrives
as many prefixes of itself. A rolling hash of each turn prefix finds the
conversations that are prefixes of longer ones; anti-joins keep the maximal
ones, which are then rendered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._shared import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, role, text, h1, h2): the 128-bit hash of each
    prefix. A turn's hash holds its position, so the running XOR is a hash of
    the ordered prefix."""
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    whole = Window.partitionBy("conv_id")
    rows = turns.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("pos", F.row_number().over(order))
    own = lambda seed: F.xxhash64(F.lit(seed), "pos", F.length("role"), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "conv_id", "pos", "role", "text", F.count(F.lit(1)).over(whole).alias("n_turns"),
        F.bit_xor(own(1)).over(running).alias("h1"), F.bit_xor(own(2)).over(running).alias("h2"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered.

    Turns are ordered by (turn, role, text), nulls first; a null role or text
    reads as empty; rows without conv_id belong to no conversation. Repeated
    rows are turns of their own. Of equal conversations the smallest conv_id
    stays and n_copies counts them; a conversation that is a proper prefix of
    another is dropped. An empty table gives no rows. Other columns are ignored. A long
    conversation is rendered into one row, and so are its texts, of any length.
    """
    prefixes = turn_prefixes(turns)
    whole = (
        prefixes.filter("pos = n_turns").groupBy("n_turns", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    # A first turn that many conversations share is one row per task here.
    shorter = prefixes.filter("pos < n_turns").groupBy(F.col("pos").alias("n_turns"), "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    maximal = whole.join(shorter, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_copies")
    line = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    lines = prefixes.select("conv_id", "n_turns", "pos", line.alias("line"))
    return (
        lines.join(maximal, "conv_id").groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
        .select("conv_id", F.col("n_turns").cast("long"), "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
), p AS (
  SELECT conv_id, pos, n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM t
), whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, prefix AS rendered FROM p WHERE pos = n_turns GROUP BY n_turns, prefix
)
SELECT conv_id, n_turns, n_copies, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.prefix = w.rendered)
"""
