"""Merging overlapping ranges and listing the gaps between them.

Ranges that start in the same stretch of coordinates (a tile) are merged by
Spark's session window with a duration per row.  Tiles are then stitched by
their summaries alone: a prefix maximum over one row per tile says how far
earlier ranges reach.  Merged ranges of a tile lie apart, so those within that
reach continue the last period begun before, and each of the others begins one.
A group is never ordered as a whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import cut, quoted

#: Coordinates per tile: a whole chromosome of 2.5e8 bases has 239.
TILE = 1 << 20


def tidy_chrom(chrom: Column) -> Column:
    """``chr`` + upper-case name, whatever the case, spaces or leading ``chr``; null where no name is left."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(chrom, r"[\s\p{Z}]+", "")), "^CHR", "")
    return F.when(bare != "", F.concat(F.lit("chr"), bare))


def _tiled(df: DataFrame, keys: Sequence[str], start: str, end: str, tile: int) -> tuple[DataFrame, list[str]]:
    """Ranges merged inside tiles, ``__s`` to ``__e`` with ``__t``, computed once; and the names of the keys in it.

    Of the ranges with one start only the longest matters: they are reduced to
    it, with a part before the shuffle, so that a tile has a bounded number of
    rows however many ranges start in it.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    s, e = quoted(start).cast("long"), quoted(end).cast("long")
    ranges = df.select(*(quoted(k).alias(n) for k, n in zip(keys, names)), F.least(s, e).alias("__s"), F.greatest(s, e).alias("__e"), (s.isNotNull() & e.isNotNull() & (s != e)).alias("__ok"))
    ranges = ranges.where("__ok").drop("__ok").dropna(subset=names)
    longest = ranges.groupBy(*names, "__s").agg(F.max("__e").alias("__e")).withColumn("__t", F.floor(F.col("__s") / F.lit(tile)))
    # one microsecond stands for one coordinate
    length = F.make_interval(secs=((F.col("__e") - F.col("__s")).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    session = F.session_window(F.timestamp_micros("__s"), length)
    merged = longest.groupBy(*names, "__t", session.alias("__w")).agg(F.count(F.lit(1)).alias("__n"))
    return cut(merged.select(*names, "__t", F.unix_micros("__w.start").alias("__s"), F.unix_micros("__w.end").alias("__e"))), names


def _periods(df: DataFrame, keys: Sequence[str], start: str, end: str, tile: int) -> tuple[DataFrame, list[str]]:
    """Periods ``__s`` to ``__e`` with ``__t``, the tile they begin in, and ``__ahead``, the first start in a later tile."""
    local, names = _tiled(df, keys, start, end, tile)
    order = Window.partitionBy(*names).orderBy("__t")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    reach = local.groupBy(*names, "__t").agg(F.max("__e").alias("__m")).select(*names, "__t", F.max("__m").over(earlier).alias("__reach"))
    marked = local.join(reach, [*names, "__t"]).withColumn("__new", F.col("__reach").isNull() | (F.col("__s") > F.col("__reach")))
    begun = F.when(F.col("__new"), F.col("__s"))
    tiles = marked.groupBy(*names, "__t").agg(F.min(begun).alias("__first"), F.max(begun).alias("__last"), F.max(F.when(~F.col("__new"), F.col("__e"))).alias("__more"))
    tiles = tiles.select(*names, "__t", "__more", F.last("__last", ignorenulls=True).over(earlier).alias("__owner"), F.first("__first", ignorenulls=True).over(later).alias("__ahead"))
    longer = tiles.where("__more is not null").groupBy(*names, F.col("__owner").alias("__s")).agg(F.max("__more").alias("__more"))
    own = marked.where("__new").select(*names, "__t", "__s", "__e").join(longer, [*names, "__s"], "left").join(tiles.select(*names, "__t", "__ahead"), [*names, "__t"])
    return own.select(*names, "__t", "__s", F.greatest("__e", "__more").alias("__e"), "__ahead"), names


def merge_ranges(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", tile: int = TILE) -> DataFrame:
    """Maximal periods of half-open ranges per ``keys``: columns ``keys``, ``seg_start``, ``seg_end``.

    Overlapping, nested and touching ranges are joined.  A range with a null
    bound or key, or with equal bounds, is ignored; one with start > end is
    swapped.  Repeated ranges change nothing.  An empty table gives no rows.
    The ranges merged inside tiles are computed when this is called, and kept
    in the shared folder: the input is read once.
    """
    periods, names = _periods(df, keys, start, end, tile)
    return periods.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("__s").alias("seg_start"), F.col("__e").alias("seg_end"))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", tile: int = TILE) -> DataFrame:
    """Rows ``keys``, ``kind`` (merged or gap), ``seg_start``, ``seg_end``; nulls and odd ranges as in :func:`merge_ranges`.

    A gap ends at the next period's start: ``lead`` inside a tile, and for the
    last period of a tile the first start of a later one.
    """
    periods, names = _periods(df, keys, start, end, tile)
    near = F.lead("__s").over(Window.partitionBy(*names, "__t").orderBy("__s"))
    both = periods.withColumn("__next", F.coalesce(near, F.col("__ahead")))
    merged = F.struct(F.lit("merged").alias("kind"), F.col("__s").alias("seg_start"), F.col("__e").alias("seg_end"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("__e").alias("seg_start"), F.col("__next").alias("seg_end"))
    rows = F.when(F.col("__next").isNull(), F.array(merged)).otherwise(F.array(merged, gap))
    return both.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.explode(rows).alias("__x")).select(*keys, "__x.kind", "__x.seg_start", "__x.seg_end")
