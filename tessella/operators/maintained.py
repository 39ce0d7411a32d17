"""Views that are kept up to date from change rows.

A change is (old, new): two structs of a row, null for an insert or a delete.
Counts and sums move by differences, so a view is never computed again from its
base: a group costs its changes. A distinct count is kept as a bag with a count
for each value. A minimum or maximum can be lost with a deleted row; only the
groups where that happened are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(28,6)"  # sums of doubles would drift


def counted(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, n, sum of each): the view over a whole table."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(c).cast(EXACT)), F.lit(0)).cast(EXACT).alias(f"sum_{c}") for c in sums))


def signed(changes: DataFrame) -> DataFrame:
    """Each change as rows with ``sign``: -1 for the old one, +1 for the new."""
    sides = [changes.filter(F.col(side).isNotNull()).select(f"{side}.*", F.lit(sign).alias("sign")) for side, sign in (("old", -1), ("new", 1))]
    return sides[0].unionByName(sides[1])


def maintained(view: DataFrame, changes: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``view`` of ``counted`` after ``changes``; a group without rows is gone."""
    names = ["n", *(f"sum_{c}" for c in sums)]
    moved = signed(changes).groupBy(*keys).agg(F.sum("sign").cast("long").alias("n"), *(F.coalesce(F.sum(F.col("sign") * F.col(c).cast(EXACT)), F.lit(0)).cast(EXACT).alias(f"sum_{c}") for c in sums))
    both = view.select(*keys, *names).unionByName(moved)
    after = both.groupBy(*keys).agg(*(F.sum(c).cast("long" if c == "n" else EXACT).alias(c) for c in names))
    return after.filter("n > 0")


def bag(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often each value stands in a group."""
    return counted(rows.filter(F.col(value).isNotNull()), [*keys, value], [])


def maintained_bag(held: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    some = changes.select(*(F.when(F.col(f"{side}.{value}").isNotNull(), F.col(side)).alias(side) for side in ("old", "new")))
    return maintained(held, some, [*keys, value], [])


def distinct_counts(held: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the number of distinct values of a bag."""
    return held.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def extremes(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def maintained_extremes(view: DataFrame, changes: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, least, most) after ``changes``; ``base`` is the table after them.
    A group that lost the row of one of its ends is read from ``base`` again;
    every other one is compared with its new rows alone."""
    rows = signed(changes)
    lost = rows.filter("sign < 0").join(view, keys).filter((F.col(value) <= F.col("least")) | (F.col(value) >= F.col("most"))).select(*keys).distinct()
    again = extremes(base.join(lost, keys, "left_semi"), keys, value)
    fresh = extremes(rows.filter("sign > 0"), keys, value)
    kept = view.unionByName(fresh).join(lost, keys, "left_anti").groupBy(*keys).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return kept.unionByName(again)


def applied(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The base table after ``changes``."""
    gone = changes.filter("old is not null").select(F.col(f"old.{key}").alias(key))
    return rows.join(gone, key, "left_anti").unionByName(changes.filter("new is not null").select("new.*").select(*rows.columns))


def touched(old: DataFrame, new: DataFrame, key: str, columns: list[str], at) -> DataFrame:
    """Trigger column: ``new`` rows with ``updated_at``, which moves to ``at``
    where one of ``columns`` differs from the old row and stays elsewhere."""
    was = old.select(key, *(F.col(c).alias(f"_{c}") for c in [*columns, "updated_at"]))
    j = new.join(was, key, "left")
    changed = F.col("_updated_at").isNull()
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.withColumn("updated_at", F.when(changed, at).otherwise(F.col("_updated_at"))).select(*new.columns, "updated_at")


def refused(changes: DataFrame, fixed: list[str]) -> DataFrame:
    """Append-only rules: (change, rule) of changes that a trigger would refuse:
    a delete, a change of an identity column, or of an outcome that is final."""
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    moved = F.lit(False)
    for c in fixed:
        moved = moved | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    rule = F.when(F.col("old").isNotNull() & F.col("new").isNull(), "append_only").when(both & ((F.col("old.state") != "reserved") | (F.col("new.state") == "reserved")), "outcome_is_final").when(both & moved, "identity_is_immutable")
    return changes.withColumn("rule", rule).filter("rule is not null")
