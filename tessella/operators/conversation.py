"""Conversation analytics and rule-based classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word patterns of requests.
META = r"(?i)\b(help|what can you do|capabilities|commands)\b"
QUESTLINE = r"(?i)\b(\d+\s*quests?|questline|quest\s*line|series\s*of\s*quests|connected\s*quests|quest\s*chain)\b"
QUEST = r"(?i)\b(quest|plan|arc|story ?arc|objective|phases|campaign)\b"
NARRATIVE = r"(?i)\b(write|scene|narrative|prose|describe|story|dramatic)\b"
STORY = r"(?i)\b(develop|create|new story|new character|new location|expand|imagine|what if|non-?canon|story idea|collaborate)\b"
SEQUENCE = r"(?i)\b(then|after that|based on|using that|followed by|and then|next|\d+\s*(quests?|stories|narratives|parts?|chapters?))\b"
NUMBERED = r"(?i)\b(\d+)\s*(quests?|stories|narratives|parts?|chapters?)\b"

# What ties a question to the talk before it.
DIRECT = ["that", "this", "it", "they", "them", "he", "she", "those", "these"]
CONTINUING = ["tell me more", "what else", "continue", "expand on", "also", "additionally"]
SHIFTING = ["now tell me about", "what about", "switch to", "instead tell me", "now about"]


def mentions(messages: DataFrame, key: str, order: str, entities: Column) -> DataFrame:
    """(key, entity, count, first, last) over an array column of entities."""
    each = messages.select(key, order, F.explode(entities).alias("entity"))
    return each.groupBy(key, "entity").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def recent_entities(tracked: DataFrame, key: str, gap: int = 3) -> DataFrame:
    """Entities within ``gap`` turns of the last mention of a conversation,
    weighted by nearness and count."""
    behind = F.max("last").over(Window.partitionBy(key)) - F.col("last")
    rows = tracked.withColumn("gap", behind).filter(F.col("gap") <= gap)
    return rows.withColumn("weight", 1.0 / (F.col("gap") + 1) * F.least(F.col("n") / 10, F.lit(1.0)))


def topic_shifts(messages: DataFrame, key: str, order: str, words: Column, threshold: float = 0.3) -> DataFrame:
    """Whether a message shares too few words with the one before it; false
    for the first message and where both are empty."""
    w = Window.partitionBy(key).orderBy(order)
    rows = messages.withColumn("_w", F.array_distinct(words)).withColumn("_p", F.lag("_w").over(w))
    union = F.size(F.array_union("_w", "_p"))
    jaccard = F.try_divide(F.size(F.array_intersect("_w", "_p")), union)
    shift = F.when(F.col("_p").isNull() | (F.size("_p") == 0) | (union == 0), False).otherwise(jaccard < threshold)
    return rows.select(key, order, F.coalesce(jaccard, F.lit(0.0)).alias("overlap"), shift.alias("shift"))


def exhaustion(scores: DataFrame, key: str, order: str, similarity: str, repeated: str, fresh: str) -> DataFrame:
    """Exhaustion of each conversation from its last three of at most ten
    responses: repetition over one half (0.4), falling similarity (0.3),
    falling number of new pieces (0.3), low last similarity (0.2)."""
    w = Window.partitionBy(key).orderBy(order)
    back = Window.partitionBy(key).orderBy(F.desc(order))
    rows = scores.withColumn("_n", F.row_number().over(back)).filter("_n <= 10")
    rows = rows.withColumn("_ds", F.col(similarity) - F.lag(similarity).over(w)).withColumn("_df", F.col(fresh) - F.lag(fresh).over(w))
    last = rows.filter("_n <= 3").groupBy(key).agg(
        F.avg(F.col(repeated).cast("double")).alias("repetition"), F.avg("_ds").alias("trend"), F.avg("_df").alias("fresh_trend"), F.max(F.when(F.col("_n") == 1, F.col(similarity))).alias("last"),
    )
    points = lambda ok, p: F.when(F.coalesce(ok, F.lit(False)), p).otherwise(0.0)
    score = points(F.col("repetition") > 0.5, 0.4) + points(F.col("trend") < -0.05, 0.3) + points(F.col("fresh_trend") < -0.5, 0.3) + points(F.col("last") < 0.3, 0.2)
    return last.select(key, F.round(score, 6).alias("score"), (score >= 0.5 - 1e-9).alias("exhausted"))


def route(text: Column) -> tuple[Column, Column]:
    """(route, confidence) of a request: the first rule that fits."""
    text = F.trim(text)
    many = F.regexp_extract(text, NUMBERED, 1).try_cast("int") > 1
    of_quests = F.lower(F.regexp_extract(text, NUMBERED, 2)).contains("quest")
    kinds = sum((F.when(text.rlike(p), 1).otherwise(0) for p in (STORY, QUEST, NARRATIVE)), F.lit(0))
    rules = [
        (text == "", "lore_query", 0.1), (text.rlike(META), "meta_help", 0.85), (text.rlike(QUESTLINE), "questline_generation", 0.95),
        (many & of_quests, "questline_generation", 0.95), (many, "orchestrated", 0.95), (text.rlike(SEQUENCE) & (kinds >= 2), "orchestrated", 0.9),
        (text.rlike(STORY), "story_development", 0.8), (text.rlike(QUEST), "quest_planning", 0.75), (text.rlike(NARRATIVE), "narrative_generation", 0.7),
    ]
    name, sure = F.lit("lore_query"), F.lit(0.6)
    for hit, r, c in reversed(rules):
        hit = F.coalesce(hit, F.lit(False))
        name, sure = F.when(hit, r).otherwise(name), F.when(hit, c).otherwise(sure)
    return name, sure


def correlation(current: Column, previous: Column) -> Column:
    """How far a question belongs to the last answer: direct words (0.8) or a
    continuing phrase (0.5), less 0.8 for a change of subject, and 0.3 times
    the overlap of capitalised names; 0 without an answer, at most 1."""
    from tessella.functions.text import capitalised_phrases

    low = F.lower(current)
    some = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: low.contains(p))
    direct = F.arrays_overlap(F.split(low, r"\s+"), F.array(*map(F.lit, DIRECT)))
    now, then = F.array_distinct(capitalised_phrases(current)), F.array_distinct(capitalised_phrases(previous))
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect(now, then)), F.size(F.array_union(now, then))), F.lit(0.0))
    score = F.when(some(SHIFTING), -0.8).otherwise(0.0) + F.when(direct, 0.8).when(some(CONTINUING), 0.5).otherwise(0.0) + shared * 0.3
    return F.when(previous.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def follow_up(text: Column, entities: Column) -> Column:
    """A short or pronoun-led question gets up to three recent entities."""
    vague = F.lower(F.trim(text)).rlike(r"^(it|they|he|she|that|this|these|those|and)\b") | (F.size(F.split(F.trim(text), r"\s+")) < 4)
    names = F.array_join(F.slice(entities, 1, 3), ", ")
    return F.when(vague & (F.size(entities) > 0), F.concat(text, F.lit(" (about "), names, F.lit(")"))).otherwise(text)


def limited_state(messages: DataFrame, key: str, order: str, head: int = 5, tail: int = 20) -> DataFrame:
    """The first ``head`` and the last ``tail`` messages of a conversation."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(order))
    down = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("_a", up).withColumn("_b", down).filter((F.col("_a") <= head) | (F.col("_b") <= tail)).drop("_a", "_b")


def conversation_list(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, title, messages, last turn): the title is from the first user
    message."""
    from tessella.functions.text import conversation_title

    first = F.min(F.when(F.col("role") == "user", F.struct(order, "text")))
    return messages.groupBy(key).agg(first.alias("f"), F.count(F.lit(1)).alias("messages"), F.max(order).alias("last_turn")).select(key, conversation_title(F.col("f.text")).alias("title"), "messages", "last_turn")


# What asks for a compact answer.
COMPACT = ["one sentence", "single sentence", "in a sentence", "concise answer", "concise sentence", "brief answer", "briefly", "short answer"]


def wants_compact_answer(question: Column) -> Column:
    """The question asks for a short form."""
    said = F.regexp_replace(F.trim(F.lower(question)), r"\s+", " ")
    return F.exists(F.array(*map(F.lit, COMPACT)), lambda m: said.contains(m))


def digest(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, part, block, summary): numbered blocks with a summary of 200
    characters, graph blocks apart as supporting facts."""
    from tessella.operators.records import shortened

    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    part = F.when(F.upper(F.trim(text)).startswith("GRAPH "), "supporting_facts").otherwise("direct_answers")
    return blocks.select(key, part.alias("part"), n.alias("block"), shortened(F.col(text), 200).alias("summary"))


def bounded_history(responses: DataFrame, key: str, order: Sequence[str], most: int = 10) -> DataFrame:
    """The last ``most`` responses of each session."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return responses.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def condensed(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(block, pos, line): the first 20 chunks, 10 entities and 15
    relations as lines of context; those without content are left out after
    the cut. Inputs have ``pos``; entities name, type, details; relations type,
    source, target, insight."""
    first = lambda df, n: df.orderBy("pos").limit(n)
    a = first(chunks, 20).select(F.lit(1).alias("block"), "pos", F.trim("text").alias("line")).filter("line <> ''")
    b = first(entities, 10).filter("name <> '' and details <> ''").select(F.lit(2).alias("block"), "pos", F.concat(F.lit("GRAPH ENTITY "), "name", F.lit(" ("), F.coalesce("type", F.lit("Entity")), F.lit("): "), "details").alias("line"))
    c = first(relations, 15).filter("insight <> ''").select(
        F.lit(3).alias("block"), "pos",
        F.concat(F.lit("GRAPH RELATIONSHIP "), F.coalesce("type", F.lit("related_to")), F.lit(" ("), F.coalesce("source", F.lit("?")), F.lit(" -> "), F.coalesce("target", F.lit("?")), F.lit("): "), "insight").alias("line"),
    )
    return a.unionByName(b).unionByName(c).orderBy("block", "pos")
