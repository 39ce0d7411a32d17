"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same
letters share it. Two words that differ by one letter have keys that differ by
one addition, removal or exchange value; taking a letter's power from the key
of the word that holds it makes such keys equal, and they meet in one join. The
order of the letters is verified by what is left of the word around that place,
as a second key of the join, so a bucket of anagrams is never paired off. Words
of over 48 letters meet by half of what is left and are compared letter by
letter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._shared import crc32_sql, cut, table

LEAST_LENGTH, LEAST_COUNT, TIMES, DROP = 7, 2, 10, 31
LONG = 48
RUN = rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"


def power(letter: Column) -> Column:
    """Fifth power of a letter's place in the alphabet (a-z, then À-ÿ)."""
    code = F.ascii(letter)
    place = F.when(code < 0xC0, code - 96).otherwise(code - 0xC0 + 27).cast("long")
    return place * place * place * place * place


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, letter: total + power(letter))


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the counted words of all texts."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    found = runs.withColumn("h", h).select(F.when(F.col("h") % DROP == 0, less).otherwise(F.col("run")).alias("word"))
    return found.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def reduced(keyed: DataFrame) -> DataFrame:
    """(key, rest, at, letter, first, word, n): every word without each one of
    its letters, and whole (``at`` is 0), where LONG letters at most are left.
    ``first`` marks the first letter of a run of equal ones: taking any of them
    leaves the same rest."""
    letters = keyed.filter(F.length("word") <= LONG + 1).select("*", F.posexplode(F.split("word", "")).alias("before", "letter"))
    at = F.col("before") + 1
    less = letters.select(
        (F.col("key") - power(F.col("letter"))).alias("key"), F.concat(F.substr("word", F.lit(1), F.col("before")), F.substr("word", at + 1)).alias("rest"), at.alias("at"), "letter",
        ((F.col("before") == 0) | (F.substr("word", F.greatest(F.col("before"), F.lit(1)), F.lit(1)) != F.col("letter"))).alias("first"), "word", "n",
    )
    whole = keyed.filter(F.length("word") <= LONG)
    return less.unionByName(whole.select("key", F.col("word").alias("rest"), F.lit(0).alias("at"), F.lit("").alias("letter"), F.lit(True).alias("first"), "word", "n"))


def halves(keyed: DataFrame) -> DataFrame:
    """(key, size, side, half, letter, word, n): words where more than LONG
    letters are left, by each distinct letter to take and whole. Of two words
    one edit apart the first half or the rest is equal; ``half`` is its hash, so
    rows stay small however long a word is."""
    rows = keyed.filter(F.length("word") > LONG).select("*", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct(F.split("word", "")))).alias("letter"))
    rows = rows.withColumn("size", F.length("word") - F.length("letter")).filter(F.col("size") > LONG)
    cut_at = F.floor(F.col("size") / 2).cast("int")
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.md5(F.substr("word", F.lit(1), cut_at).cast("binary")).alias("half")),
        F.struct(F.lit(1).alias("side"), F.md5(F.right("word", F.col("size") - cut_at).cast("binary")).alias("half")),
    ))
    key = F.when(F.col("letter") == "", F.col("key")).otherwise(F.col("key") - power(F.col("letter")))
    return rows.select(key.alias("key"), "size", "letter", "word", "n", sides.alias("s")).select("*", "s.*").drop("s")


def common_start(a: Column, b: Column) -> Column:
    """How many letters two words share at their start, by halving steps."""
    most, steps = F.least(F.length(a), F.length(b)), F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    equal = lambda n: (n <= most) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(equal(at + step), at + step).otherwise(at))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): ordered pairs of words that differ by exactly
    one inserted, deleted or replaced letter, each once. Both sides of the join
    ask for the same columns under the same conditions, so that Spark shuffles
    them once."""
    keyed = vocabulary.select("word", "n", anagram_key(F.col("word")).alias("key"))
    rows, far = reduced(keyed), halves(keyed)
    x, y = rows.alias("x"), rows.alias("y")
    whole = lambda r: F.col(f"{r}.at") == 0
    exchange = ~whole("x") & ~whole("y") & (F.col("x.at") == F.col("y.at")) & (F.col("x.letter") != F.col("y.letter"))
    one_more = (~whole("x") & F.col("x.first") & whole("y")) | (whole("x") & ~whole("y") & F.col("y.first"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rest") == F.col("y.rest")) & (exchange | one_more))
    x, y = far.alias("x"), far.alias("y")
    same = F.lit(True)
    for c in ("key", "size", "side", "half"):
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    start = lambda r: F.substr(f"{r}.word", F.lit(1), F.floor(F.col("x.size") / 2).cast("int"))
    once = (F.col("x.side") == 0) | (start("x") != start("y"))
    shared = common_start(F.col("x.word"), F.col("y.word"))
    after = lambda r: F.substr(f"{r}.word", F.col("shared") + 1 + F.length(f"{r}.letter"))
    long_ = x.join(y, same & (F.col("x.letter") != F.col("y.letter"))).filter(once).withColumn("shared", shared).filter(after("x") == after("y"))
    pair = [F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("other"), F.col("y.n").alias("other_n")]
    return met.select(*pair).unionByName(long_.select(*pair))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: chains are halved until no
    root has a form of its own. A form is ten times as frequent as its word, so
    a chain has at most 19 words and five rounds end it."""
    up = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = cut(up.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the maximal letter runs of whole texts, lower-cased for A-Z only,
    less one letter where 31 divides the hash of document and run; those of at
    least seven letters that occur twice. A word's form is its near word with
    the largest count (ties: the smallest word), if that count is ten times its
    own; the root ends the chain of forms. Null and empty texts and texts
    without letters have no words; a null doc_id reads as empty in the hash;
    repeated rows count each; other columns are ignored; an empty table gives no
    rows. The runs of one text, however long, are held at once.
    """
    vocabulary = cut(words(docs))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other"))).alias("best")
    near = near_words(vocabulary).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    has = F.coalesce(-F.col("best.minus") >= TIMES * F.col("n"), F.lit(False))
    found = cut(
        vocabulary.join(near, ["word", "n"], "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"),
        )
    )
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL
), hashed AS (SELECT run, c, {crc32_sql("(doc_id || ':' || run)")} AS h FROM runs),
v AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), r AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS p FROM v)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM r x JOIN r y ON x.p = y.p AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT r.word, v.word, v.n FROM r JOIN v ON r.rest = v.word
  UNION SELECT v.word, r.word, r.n FROM r JOIN v ON r.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, min({{'m': -other_n, 'o': other}}) AS b FROM pairs GROUP BY word
), f AS (
  SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * n THEN b.o END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
), chain AS (
  SELECT word, word AS top, 0 AS hop FROM f UNION ALL SELECT chain.word, f.form, hop + 1 FROM chain JOIN f ON f.word = chain.top WHERE f.form IS NOT NULL
)
SELECT f.word, form, e.root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM f JOIN (SELECT word, arg_max(top, hop) AS root FROM chain GROUP BY word) e ON e.word = f.word
"""
