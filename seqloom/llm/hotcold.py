"""Ordering inside groups of which some hold a large part of all rows.

Exact counts tell heavy groups from light ones.  Light groups go through
ordinary windows.  Rows of heavy groups are cut into ranges of their score that
hold about equally many rows, with a range of its own for every value that many
rows share; counts per range say how many rows come before it, so that ranges
are ordered apart from each other and no heavy group comes to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators import skew

#: Rows from which a group is heavy; most rows of a table of heavy groups or of their ranges that is broadcast, larger ones are joined by a shuffle.
HEAVY_ROWS, BROADCAST_ROWS = 20_000, 200_000
#: Rows of a group per salt.
SALTED_ROWS = 100_000


def heavy_groups(df: DataFrame, group: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame | None:
    """The heavy groups with their rows: ``__g``, ``__rows``, marked for broadcast if they are few enough; None if there are none.

    Counted once over all rows when this is called, so that plans without heavy
    groups have no second branch.
    """
    counts = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > heavy_rows)
    few = counts.limit(BROADCAST_ROWS + 1).toArrow()
    if len(few) > BROADCAST_ROWS:
        return counts
    return F.broadcast(df.sparkSession.createDataFrame(few)) if len(few) else None


def split(df: DataFrame, group: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of light and of heavy groups, the latter with ``__g`` and ``__rows``."""
    same = F.col(group).eqNullSafe(F.col("__g"))
    return df.join(heavy, same, "left_anti"), df.join(heavy, same)


def _salt(columns: Sequence[str]) -> Column:
    """One of as many numbers as a row's group has ``SALTED_ROWS`` rows."""
    return F.pmod(F.xxhash64(*columns), F.ceil(F.col("__rows") / F.lit(SALTED_ROWS)))


def _above(ranges: DataFrame, numbers: Sequence[str]) -> list[DataFrame]:
    """For each column of range numbers ``__h``, ``__hr``, ``__above``: for every range of a heavy group the rows in higher ranges of it; broadcast if few enough."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(n).alias("r")) for i, n in enumerate(numbers)))).alias("__x")
    higher = Window.partitionBy("__g", "__x.i").orderBy(F.desc("__x.r")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.select("__g", each).groupBy("__g", "__x").agg(F.count(F.lit(1)).alias("__c"))
    sizes = sizes.select(F.col("__g").alias("__h"), F.col("__x.i").alias("__hi"), F.col("__x.r").alias("__hr"), F.coalesce(F.sum("__c").over(higher), F.lit(0)).alias("__above"))
    few = sizes.limit(BROADCAST_ROWS + 1).toArrow()
    small = len(few) <= BROADCAST_ROWS
    sizes = ranges.sparkSession.createDataFrame(few, sizes.schema) if small else sizes
    parts = [sizes.where(F.col("__hi") == i).drop("__hi") for i in range(len(numbers))]
    return [F.broadcast(p) for p in parts] if small else parts


def top_n(df: DataFrame, group: str, score: str, ties: Sequence[str], n: int, counted: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The ``n`` rows with the highest ``score`` per group, with ``rank_no`` from 1.

    Ties are ordered by ``ties``, ascending, and then by all other columns, so
    the result doesn't depend on the order of rows.  A null group is a group;
    rows without a score (null) come last.  Groups are told heavy by the rows
    of ``counted`` (``df``, or a superset that is cheaper to count and has the
    same columns ``group`` and ``score``).
    """
    columns = df.columns
    order = [F.desc_nulls_last(score), *(F.asc(t) for t in ties), *(F.asc(c) for c in columns if c not in {group, score, *ties})]
    known = df if counted is None else counted
    heavy = heavy_groups(known, group, heavy_rows)
    light, hot = (df, None) if heavy is None else split(df, group, heavy)
    ranked = light.withColumn("rank_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank_no") <= n)
    if heavy is None:
        return ranked
    ranges = skew.in_range(hot.withColumn("__s", F.col(score).cast("double")), "__s", skew.value_ranges(known.select(F.col(score).cast("double").alias("__s")), ["__s"])[0], "__r")
    ranges = ranges.withColumn("__r", F.coalesce("__r", F.lit(-1)))  # rows without a score
    # of a heavy group only the ranges that can hold its n best, each in as many parts as the group is large
    near = ranges.join(_above(ranges, ["__r"])[0], F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__r") == F.col("__hr"))).where(F.col("__above") < n).withColumn("__salt", _salt(columns))
    best = near.withColumn("__k", F.row_number().over(Window.partitionBy("__g", "__r", "__salt").orderBy(*order))).where(F.col("__k") <= n)
    best = best.select(*columns).withColumn("rank_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank_no") <= n)
    return ranked.unionAll(best.select(*ranked.columns))


def ranks(df: DataFrame, group: str, scores: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Rows with ``__n``, the rows of their group, and per score ``__rank_i``: 1 + the rows of the group with a higher score.

    Scores must be numbers, neither null nor NaN.  ``(group, all columns)`` need not be unique.
    """
    columns = df.columns
    heavy = heavy_groups(df, group, heavy_rows)
    light, hot = (df, None) if heavy is None else split(df, group, heavy)
    own = Window.partitionBy(group)
    ranked = light.select(*columns, F.count(F.lit(1)).over(own).alias("__n"), *(F.rank().over(own.orderBy(F.desc(s))).cast("long").alias(f"__rank_{i}") for i, s in enumerate(scores)))
    if heavy is None:
        return ranked
    bounds = skew.value_ranges(df, scores)
    for i, s in enumerate(scores):
        hot = skew.in_range(hot, s, bounds[i], f"__r{i}")
    above = _above(hot, [f"__r{i}" for i in range(len(scores))])
    out = hot
    for i, s in enumerate(scores):
        r = F.col(f"__r{i}")
        # rows of one value's own range are all of one rank: they may be anywhere, and are spread
        apart = Window.partitionBy("__g", f"__r{i}", F.when(r % 2 == 1, _salt(columns)).otherwise(F.lit(0))).orderBy(F.desc(s))
        out = out.join(above[i], F.col("__g").eqNullSafe(F.col("__h")) & (r == F.col("__hr"))).withColumn(f"__rank_{i}", (F.col("__above") + F.rank().over(apart)).cast("long")).drop("__h", "__hr", "__above")
    return ranked.unionAll(out.withColumn("__n", F.col("__rows")).select(*ranked.columns))
