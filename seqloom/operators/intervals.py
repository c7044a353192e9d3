"""Algebra of half-open ranges: range joins by tiles, intersection, subtraction, widening, common overlap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import quoted
from seqloom.operators import periods

#: Coordinates per tile of a range join.
TILE = 1 << 14
KEYS = ("chrom",)


def _tiled(df: DataFrame, start: Column, end: Column, tile: int) -> DataFrame:
    first, last = F.floor(start / F.lit(tile)), F.floor((F.greatest(end, start + 1) - 1) / F.lit(tile))
    return df.withColumn("__first", first).withColumn("__tile", F.explode(F.sequence(first, last)))


def _touching(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds that count for an overlap: an empty range reaches one base to either side."""
    empty = start == end
    return F.when(empty, start - 1).otherwise(start), F.when(empty, end + 1).otherwise(end)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, bounds: tuple[str, str] = ("start", "end"), how: str = "inner", tile: int = TILE) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys and overlapping ranges.

    ``how`` is inner (right columns get the prefix ``r_``), semi (left rows with
    an overlap) or anti (those without, null bounds included).  Both sides are
    cut into tiles and joined on key and tile, so work follows the rows near
    one another; a pair is kept in the first tile that both reach, so none
    comes twice.  Empty ranges reach one base to either side.
    """
    s, e = bounds
    a = left.withColumns(dict(zip(("__s", "__e"), _touching(quoted(s), quoted(e)))))
    b = right.select(*(quoted(c).alias(f"r_{c}") for c in right.columns))
    b = b.withColumns(dict(zip(("__rs", "__re"), _touching(quoted(f"r_{s}"), quoted(f"r_{e}"))))).where("__rs is not null and __re is not null")
    b = _tiled(b, F.col("__rs"), F.col("__re"), tile).withColumnsRenamed({"__first": "__rfirst", "__tile": "__rtile"})
    known = F.col("__s").isNotNull() & F.col("__e").isNotNull()
    same = reduce(lambda x, y: x & y, (quoted(k) == quoted(f"r_{k}") for k in keys))
    meets = same & (F.col("__tile") == F.col("__rtile")) & (F.col("__s") < F.col("__re")) & (F.col("__rs") < F.col("__e"))
    if how == "inner":
        pairs = _tiled(a.where(known), F.col("__s"), F.col("__e"), tile).join(b, meets & (F.col("__tile") == F.greatest("__first", "__rfirst")))
        return pairs.drop("__s", "__e", "__rs", "__re", "__first", "__rfirst", "__tile", "__rtile")
    # rows within one tile need no more than a semi or anti join; of the others, the tiles' answers are put together by a number per row
    tile_of = lambda c: F.floor(c / F.lit(tile))
    short = tile_of(F.col("__s")) == tile_of(F.greatest("__e", F.col("__s") + 1) - 1)
    columns = [quoted(c) for c in left.columns]
    one = a.where(known & short).withColumn("__tile", tile_of(F.col("__s"))).join(b, meets, f"left_{how}").select(*columns)
    many = _tiled(a.where(known & ~short).withColumn("__row", F.monotonically_increasing_id()), F.col("__s"), F.col("__e"), tile)
    if how == "semi":
        return one.unionAll(many.join(b, meets, "left_semi").dropDuplicates(["__row"]).select(*columns))
    # pairs of the few long rows are reduced to one answer per row and tile where they are made, and never shuffled
    free = many.join(b.withColumn("__hit", F.lit(True)), meets, "left").groupBy("__row", *columns).agg(F.max("__hit").alias("__hit")).where("__hit is null")
    return one.unionAll(free.select(*columns)).unionAll(a.where(~known).select(*columns))


def contained(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, bounds: tuple[str, str] = ("start", "end"), tile: int = TILE) -> DataFrame:
    """Rows of ``left`` that lie wholly within a range of ``right`` with equal keys; equal ranges contain each other.

    A range that holds a row reaches the tile the row begins in, so that one is
    looked at and no row comes twice.  Null keys and bounds are in no range.
    """
    s, e = bounds
    b = right.select(*(quoted(k).alias(f"r_{k}") for k in keys), quoted(s).alias("__rs"), quoted(e).alias("__re")).where("__rs <= __re")
    b = _tiled(b, F.col("__rs"), F.col("__re"), tile).withColumnRenamed("__tile", "__rtile").drop("__first")
    same = reduce(lambda x, y: x & y, (quoted(k) == quoted(f"r_{k}") for k in keys))
    a = left.withColumn("__tile", F.floor(quoted(s) / F.lit(tile)))
    return a.join(b, same & (F.col("__tile") == F.col("__rtile")) & (F.col("__rs") <= quoted(s)) & (quoted(e) <= F.col("__re")), "left_semi").drop("__tile")


def intersect(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, bounds: tuple[str, str] = ("start", "end")) -> DataFrame:
    """The pieces that pairs of ranges share: keys and bounds, one row per overlapping pair."""
    s, e = bounds
    pairs = range_join(left.where(quoted(s) < quoted(e)), right.where(quoted(s) < quoted(e)), keys, bounds)
    return pairs.select(*(quoted(k) for k in keys), F.greatest(s, f"r_{s}").alias(s), F.least(e, f"r_{e}").alias(e))


def intersect_all(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS, bounds: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pieces shared by all of several region tables, left to right."""
    return reduce(lambda a, b: intersect(a, b, keys, bounds), frames)


def union(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS, bounds: tuple[str, str] = ("start", "end")) -> DataFrame:
    """All ranges of several tables, overlapping and touching ones joined."""
    s, e = bounds
    rows = reduce(DataFrame.unionAll, (f.select(*(quoted(k) for k in keys), quoted(s), quoted(e)) for f in frames))
    return periods.merge_ranges(rows, keys, s, e).withColumnsRenamed({"seg_start": s, "seg_end": e})


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, bounds: tuple[str, str] = ("start", "end"), tile: int = TILE) -> DataFrame:
    """The parts of ``left`` ranges that no ``right`` range covers: keys and bounds, per left row; rows with a null key stay whole.

    ``right`` is merged first, so the holes of a left range don't overlap and
    each gap is the stretch from one hole's end to the next hole's start.
    """
    s, e = bounds
    a = left.where(quoted(s) < quoted(e)).select(*(quoted(k) for k in keys), quoted(s), quoted(e)).withColumn("__row", F.monotonically_increasing_id())
    holes = union([right], keys, bounds)
    pairs = range_join(a, holes, keys, bounds, tile=tile)
    order = Window.partitionBy("__row").orderBy(f"r_{s}")
    near = pairs.withColumns({"__prev": F.lag(f"r_{e}").over(order), "__next": F.lead(f"r_{s}").over(order)})
    before = F.struct(F.coalesce(F.col("__prev"), quoted(s)).alias("s"), F.col(f"r_{s}").alias("e"))
    after = F.struct(F.col(f"r_{e}").alias("s"), quoted(e).alias("e"))
    pieces = F.when(F.col("__next").isNull(), F.array(before, after)).otherwise(F.array(before))
    gaps = near.select(*(quoted(k) for k in keys), F.explode(pieces).alias("__g")).where("__g.s < __g.e")
    whole = range_join(a, holes, keys, bounds, "anti", tile)
    cut = gaps.select(*(quoted(k) for k in keys), F.col("__g.s").alias(s), F.col("__g.e").alias(e))
    return cut.unionAll(whole.select(*cut.columns))


def widen(df: DataFrame, before: int, after: int, bounds: tuple[str, str] = ("start", "end"), length: Column | None = None) -> DataFrame:
    """Ranges longer by so many bases at either end, from 0 to the contig's length where it is known; amounts below 0 are an error."""
    if before < 0 or after < 0:
        raise ValueError("a range can only be widened")
    s, e = bounds
    end = quoted(e) + after
    return df.withColumns({s: F.greatest(F.lit(0), quoted(s) - before), e: end if length is None else F.least(end, length)})


def bounding(df: DataFrame, keys: Sequence[str] = KEYS, bounds: tuple[str, str] = ("start", "end")) -> DataFrame:
    return df.groupBy(*(quoted(k) for k in keys)).agg(F.min(quoted(bounds[0])).alias(bounds[0]), F.max(quoted(bounds[1])).alias(bounds[1]))


def merge_closed(df: DataFrame, keys: Sequence[str], bounds: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Closed ranges joined where they overlap or are neighbours."""
    s, e = bounds
    half_open = df.select(*(quoted(k) for k in keys), quoted(s), (quoted(e) + 1).alias(e))
    return periods.merge_ranges(half_open, keys, s, e).select(*(quoted(k) for k in keys), F.col("seg_start").alias(s), (F.col("seg_end") - 1).alias(e))


def common_overlap(df: DataFrame, group: Sequence[str], member: str, bounds: tuple[str, str] = ("start", "end"), members: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """For every closed range, what it shares with ranges of all members of its group: largest start to smallest end.

    Ranges that some member doesn't overlap, or whose shared part is empty, give
    nothing.  ``members`` limits who must overlap (columns ``group`` and
    ``member``); all members if not given.
    """
    s, e = bounds
    names = [*group, member, s, e]
    rows = df.select(*(quoted(c) for c in names)).withColumn("__e", quoted(e) + 1).distinct()
    other = rows if members is None else rows.join(members.select(*(quoted(c) for c in [*group, member])).distinct(), [*group, member], "left_semi")
    count = other.groupBy(*(quoted(g) for g in group)).agg(F.countDistinct(quoted(member)).alias("__all"))
    pairs = range_join(rows, other, group, (s, "__e"), tile=tile)
    shared = pairs.groupBy(*(quoted(c) for c in names)).agg(F.countDistinct(quoted(f"r_{member}")).alias("__n"), F.max(f"r_{s}").alias("__ms"), F.min(f"r_{e}").alias("__me"))
    full = shared.join(count, list(group)).where((F.col("__n") == F.col("__all")) & (F.greatest(F.col("__ms"), quoted(s)) <= F.least(F.col("__me"), quoted(e))))
    return full.select(*(quoted(g) for g in group), F.greatest(F.col("__ms"), quoted(s)).alias(s), F.least(F.col("__me"), quoted(e)).alias(e)).distinct()


def best_window(df: DataFrame, keys: Sequence[str], position: str, value: str, width: int) -> DataFrame:
    """The first window of ``width`` consecutive rows with the highest mean, per key; keys with fewer rows give none."""
    order = Window.partitionBy(*(quoted(k) for k in keys)).orderBy(position)
    frame = order.rowsBetween(0, width - 1)
    rows = df.withColumns({"__mean": F.avg(quoted(value)).over(frame), "__n": F.count(F.lit(1)).over(frame), "__last": F.max(quoted(position)).over(frame)}).where(F.col("__n") == width)
    best = rows.groupBy(*(quoted(k) for k in keys)).agg(F.max("__mean").alias("__top"))
    hits = rows.join(best, list(keys)).where(F.col("__mean") == F.col("__top"))
    return hits.groupBy(*(quoted(k) for k in keys)).agg(F.min(F.struct(quoted(position).alias("first"), F.col("__last").alias("last"), F.col("__mean").alias("mean"))).alias("__b")).select(*(quoted(k) for k in keys), "__b.*")
