"""Filling containers of fixed capacity with items that are never split, unless one alone is too large.

Pattern packing: items matter only by size, so all planning is done on the
histogram of sizes, whose length is the capacity and not the number of items.
Patterns of a few sizes that fill a container are enumerated, their repeat
counts fitted to the histogram by non-negative least squares, rounded, and the
sizes left over are packed largest first.  Items then find their container by
their number among the items of their size, which salting keeps distributed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import cut, quoted

#: Sizes per class of the fitted histogram as a share of the capacity, items per enumerated pattern, steps of the fit.
CLASSES, PATTERN_ITEMS, FIT_STEPS = 256, 3, 400
#: Items of one size that are numbered in one part.
NUMBERED = 50_000


def patterns(classes: int = CLASSES, items: int = PATTERN_ITEMS) -> np.ndarray:
    """All ways to fill ``classes`` with at most ``items`` classes, largest first: an array patterns x classes of counts."""
    rows: list[list[int]] = []

    def grow(parts: list[int], left: int) -> None:
        if left == 0:
            rows.append(parts)
        elif len(parts) < items:
            most = min(left, parts[-1] if parts else left)
            least = -(-left // (items - len(parts)))
            for c in range(most, least - 1, -1):
                grow([*parts, c], left - c)

    grow([], classes)
    out = np.zeros((len(rows), classes), np.float32)
    for k, parts in enumerate(rows):
        for c in parts:
            out[k, c - 1] += 1
    return out


def non_negative_fit(a: np.ndarray, h: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """x >= 0 that nearly minimises |x a - h|, by accelerated projected gradients."""
    x = y = np.zeros(len(a), np.float64)
    gram = a @ a.T if len(a) <= a.shape[1] else None
    v = np.ones(a.shape[1])
    for _ in range(30):  # the largest eigenvalue of a'a
        v = (v @ a.T) @ a
        norm = np.linalg.norm(v)
        v /= norm
    t = 1.0
    for _ in range(steps):
        slope = (y @ gram - a @ h) if gram is not None else a @ (y @ a - h)
        new = np.maximum(0, y - slope / norm)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Containers for ``histogram`` (size -> items, sizes 1 to capacity): pairs of [(size, items of it)] and repeats."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[list[tuple[int, int]], int]] = []
    classes = min(CLASSES, capacity)
    of = lambda size: -(-size * classes // capacity)  # noqa: E731  the class whose upper bound holds the size
    members = [[] for _ in range(classes + 1)]
    for size in range(capacity, 0, -1):
        members[of(size)].append(size)
    h = np.array([sum(left[s] for s in members[c]) for c in range(1, classes + 1)], float)
    if h.sum():
        a = patterns(classes)
        fit = np.floor(non_negative_fit(a, h) + 0.5).astype(np.int64)
        free = h.astype(np.int64)
        for k in np.argsort(-fit, kind="stable"):
            if fit[k] <= 0:
                break
            need = a[k].astype(np.int64)
            used = np.flatnonzero(need)
            repeats = int(min(fit[k], (free[used] // need[used]).min()))
            free[used] -= need[used] * repeats
            while repeats:  # runs of containers with the same exact sizes
                sizes: dict[int, int] = {}
                taken = left.copy()
                for c in used:
                    for _ in range(need[c]):
                        s = next(s for s in members[c + 1] if taken[s])
                        taken[s] -= 1
                        sizes[s] = sizes.get(s, 0) + 1
                run = int(min(repeats, *(left[s] // m for s, m in sizes.items())))
                for s, m in sizes.items():
                    left[s] -= m * run
                out.append((sorted(sizes.items()), run))
                repeats -= run
    # what is left: largest first, each container filled with the largest sizes that still fit
    present = [s for s in range(capacity, 0, -1) if left[s]]
    while present:
        sizes, room = {}, capacity
        for s in present:
            m = int(min(left[s], room // s))
            if m:
                sizes[s] = m
                room -= m * s
            if not room:
                break
        run = int(min(left[s] // m for s, m in sizes.items()))
        for s, m in sizes.items():
            left[s] -= m * run
        out.append((sorted(sizes.items()), run))
        present = [s for s in present if left[s]]
    return out


def pack(df: DataFrame, item: str, size: Column, capacity: int) -> DataFrame:
    """A container for every item: columns ``item``, ``piece``, ``size``, ``container``, ``oversize``.

    An item larger than ``capacity`` is cut into full pieces and a rest
    (``oversize`` true, pieces from 0); any other is one piece.  An item of
    size 0 or null takes no space and goes to any container.  Items with equal
    ids are items of their own.  The result is the same for the same items
    whatever their order; an empty table gives no rows.  Sizes are computed
    once and kept in the shared folder.
    """
    cap = F.lit(capacity).cast("long")
    sized = df.select(quoted(item).alias("__id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("__n"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("__n") - 1) / cap), F.lit(0)))
    items = cut(sized.select("__id", "__n", F.explode(pieces).alias("__piece")).withColumn("__size", F.least(cap, F.col("__n") - F.col("__piece") * cap)))
    histogram = {r["__size"]: r["n"] for r in items.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    # a size that many items share, as the full pieces of large items do, is numbered in as many parts as it needs
    crowded = {s: -(-n // NUMBERED) for s, n in histogram.items() if n > NUMBERED}
    salts = F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in crowded.items() for x in kv)), F.col("__size")), F.lit(1).cast("long")) if crowded else F.lit(1).cast("long")
    items = items.withColumn("__salt", F.pmod(F.xxhash64("__id", "__piece"), salts))
    cells = items.groupBy("__size", "__salt").agg(F.count(F.lit(1)).alias("__c"))
    # per size the numbers from which runs of containers take their items
    first: dict[int, list[int]] = {}
    firsts: dict[int, list[tuple[int, int]]] = {}
    total = 0
    for sizes, run in plan({s: n for s, n in histogram.items() if s > 0}, capacity):
        for s, m in sizes:
            taken = first.setdefault(s, [0])
            firsts.setdefault(s, []).append((m, total))
            taken.append(taken[-1] + m * run)
        total += run
    bounds = {s: (np.array(first[s]), np.array(firsts[s])) for s in first}

    @F.arrow_udf("long")
    def container(size: pa.Array, number: pa.Array) -> pa.Array:
        sizes, numbers = size.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        out = numbers % max(total, 1)
        for s in np.unique(sizes):
            if s in bounds:
                starts, runs = bounds[s]
                at = np.flatnonzero(sizes == s)
                k = np.searchsorted(starts, numbers[at], "right") - 1
                out[at] = runs[k, 1] + (numbers[at] - starts[k]) // runs[k, 0]
        return pa.array(out.astype(np.int64))

    parts = Window.partitionBy("__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("__size", "__salt", F.coalesce(F.sum("__c").over(parts), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__size", "__salt").orderBy("__id", "__piece")) - 1
    numbered = items.withColumn("__r", number).join(offsets, ["__size", "__salt"])
    placed = numbered.withColumn("container", container(F.col("__size"), F.col("__r") + F.col("__before")))
    return placed.select(F.col("__id").alias(item), F.col("__piece").cast("int").alias("piece"), F.col("__size").alias("size"), "container", (F.col("__n") > cap).alias("oversize"))


def split_items(packed: DataFrame, item: str, capacity: int) -> DataFrame:
    """Items that were put into more than one container, as they exceed one: column ``item`` and ``pieces``.

    That no container holds more than ``capacity`` is checked first, and an
    error where rows are read otherwise.
    """
    fullest = containers(packed).agg(F.max("used")).scalar()
    whole = F.coalesce(fullest <= capacity, F.lit(True))
    pieces = packed.groupBy(quoted(item)).agg(F.count(F.lit(1)).alias("pieces"), F.max("oversize").alias("__o"))
    kept = pieces.where((F.col("pieces") > 1) & F.col("__o")).where(F.assert_true(whole, F.lit("a container holds too much")).isNull())
    return kept.select(quoted(item), "pieces")


def containers(packed: DataFrame) -> DataFrame:
    """Items and used space of every container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
