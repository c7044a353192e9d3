"""Percentiles with bounded rank error from summaries that can be combined.

A summary is a list of tuples (value, least rank, largest rank) with the number
of values, the rank error as a share of that number, and a level.  Values are
summarised in blocks (level 0); ``FAN_IN`` summaries of one level are merged
into one of the next, which is thinned to more tuples the higher its level, so
that the errors of all levels together stay below a bound that doesn't depend
on the number of values, partitions or days.  All steps are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import quoted

#: Tuples of a summary of level 0; one of level l has (l + 1) ** 2 times as many, and thinning adds a rank error of half a tuple's share.
TUPLES = 400
#: Summaries merged into one of the next level.
FAN_IN = 64
#: Values of a group summarised at once, and most values and tuples that a task holds before it gives away what it has.
BUFFER, HELD = 100_000, 4_000_000

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int, float, int]


def error_bound(tuples: int = TUPLES) -> float:
    """Bound of the error that any summary carries: half a tuple's share times the sum of 1 / (l + 1) ** 2 over all levels."""
    return 0.5 / tuples * np.pi**2 / 6


def summarise(values: np.ndarray, tuples: int = TUPLES) -> Summary:
    """Summary of values without NaN, of level 0."""
    v = np.sort(values)
    rank = np.arange(1, len(v) + 1)
    return thin((v, rank, rank, len(v), 0.0, 0), tuples)


def thin(s: Summary, tuples: int = TUPLES) -> Summary:
    """At most (level + 1) ** 2 * ``tuples`` + 1 tuples: those nearest to evenly spread ranks, the first and the last included."""
    v, low, high, n, error, level = s
    most = tuples * (level + 1) ** 2
    if len(v) <= most + 1:
        return s
    wanted = np.linspace(1, n, most + 1)
    at = np.clip(np.searchsorted((low + high) / 2, wanted), 0, len(v) - 1)
    at = np.unique(np.concatenate([[0], at, [len(v) - 1]]))
    return v[at], low[at], high[at], n, error + 0.5 / most, level


def merge(a: Summary, b: Summary) -> Summary:
    """Summary of both inputs' values; the error is the larger of the two."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b

    def placed(x: Summary, y: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(y[0], x[0], side)
        low = x[1] + np.where(k > 0, y[1][np.maximum(k - 1, 0)], 0)
        high = x[2] + np.where(k < len(y[0]), y[2][np.minimum(k, len(y[0]) - 1)] - 1, y[3])
        return low, high

    (la, ha), (lb, hb) = placed(a, b, "left"), placed(b, a, "right")
    v = np.concatenate([a[0], b[0]])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order], a[3] + b[3], max(a[4], b[4]), max(a[5], b[5])


def merge_all(parts: list[Summary], tuples: int = TUPLES) -> Summary:
    """All summaries as one: merged pairwise without thinning, then thinned once, on the level above theirs."""
    if len(parts) == 1:
        return parts[0]
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return thin((*parts[0][:5], parts[0][5] + 1), tuples)


class Levels:
    """Summaries of one group, at most ``FAN_IN`` - 1 of each level: what a counter of base ``FAN_IN`` is to a number."""

    def __init__(self, tuples: int = TUPLES, fan_in: int = FAN_IN):
        self.tuples, self.fan_in, self.held = tuples, fan_in, 0
        self.of: dict[int, list[Summary]] = {}

    def add(self, s: Summary) -> None:
        while True:
            own = self.of.setdefault(s[5], [])
            own.append(s)
            self.held += len(s[0])
            if len(own) < self.fan_in:
                return
            self.held -= sum(len(x[0]) for x in own)
            self.of[s[5]] = []
            s = merge_all(own, self.tuples)

    def one(self) -> Summary:
        """All of them as one, lowest levels first."""
        rest: list[Summary] = []
        for level in sorted(self.of):
            rest = [*self.of[level], *rest]
            if len(rest) > 1 and len(self.of[level]) + 1 >= self.fan_in:
                rest = [merge_all(rest, self.tuples)]
        return merge_all(rest, self.tuples)


SCHEMA = "metric string, part long, n long, error double, level int, v array<double>, low array<long>, high array<long>"


def _row(s: Summary) -> dict:
    return {"n": s[3], "error": s[4], "level": s[5], "v": s[0].astype(float), "low": s[1].astype(np.int64), "high": s[2].astype(np.int64)}


def _of(r) -> Summary:
    return np.asarray(r.v, float), np.asarray(r.low, np.int64), np.asarray(r.high, np.int64), int(r.n), float(r.error), int(r.level)


class Building:
    """Summaries of many groups of one partition, with a bounded number of values and tuples held."""

    def __init__(self, tuples: int = TUPLES, buffer: int = BUFFER, held: int = HELD):
        self.tuples, self.buffer, self.most = tuples, buffer, held
        self.clear()

    def clear(self) -> None:
        self.waiting: dict[tuple, list[np.ndarray]] = {}
        self.sizes: dict[tuple, int] = {}
        self.levels: dict[tuple, Levels] = {}
        self.held = 0

    def add(self, key: tuple, values: np.ndarray) -> None:
        self.waiting.setdefault(key, []).append(values)
        self.sizes[key] = self.sizes.get(key, 0) + len(values)
        self.held += len(values)
        if self.sizes[key] >= self.buffer:
            self._fold(key)

    def _fold(self, key: tuple) -> None:
        values = np.concatenate(self.waiting.pop(key))
        self.held -= len(values)
        self.sizes[key] = 0
        levels = self.levels.setdefault(key, Levels(self.tuples))
        before = levels.held
        for at in range(0, len(values), self.buffer):
            levels.add(summarise(values[at : at + self.buffer], self.tuples))
        self.held += levels.held - before

    @property
    def full(self) -> bool:
        return self.held > self.most

    def taken(self) -> Iterator[tuple[tuple, Summary]]:
        """One summary per group of all that was added since the last time."""
        for key in list(self.waiting):
            self._fold(key)
        found = [(key, levels.one()) for key, levels in self.levels.items()]
        self.clear()
        return iter(found)


def summaries(df: DataFrame, group: str, metrics: Sequence[str], tuples: int = TUPLES, held: int = HELD) -> DataFrame:
    """One summary or more per partition, group and metric: columns ``group`` and those of ``SCHEMA``.

    Null groups, null and NaN values don't count.  A task holds at most ``held``
    values and tuples (and a batch); what it has is given away when that is
    reached, so neither many values nor many groups are too much for it.
    """
    kind = dict(df.dtypes)[group]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        state = Building(tuples, held=held)

        def rows() -> pd.DataFrame:
            return pd.DataFrame([{"__g": g, "metric": m, "part": part} | _row(s) for (g, m), s in state.taken()])

        for pdf in batches:
            for g, own in pdf.groupby("__g", sort=False):
                for m in metrics:
                    x = own[m].to_numpy(float)
                    x = x[~np.isnan(x)]
                    if len(x):
                        state.add((g, m), x)
            if state.full:
                yield rows()
        if state.waiting or state.levels:
            yield rows()

    narrow = df.select(quoted(group).alias("__g"), *(quoted(m).cast("double").alias(m) for m in metrics)).where(F.col("__g").isNotNull())
    return narrow.mapInPandas(build, f"__g {kind}, {SCHEMA}").withColumnRenamed("__g", group)


def combine(parts: DataFrame, group: str, tuples: int = TUPLES, fan_in: int = FAN_IN) -> DataFrame:
    """One summary per group and metric from any number of them (of partitions, files or days).

    Merged in two steps: those of ``fan_in`` neighbouring partitions first, by
    many tasks, then what is left of a group.  In each step a group's summaries
    go through ``Levels`` one after another, so that a task holds a bounded
    number of them.
    """
    kind = dict(parts.dtypes)[group]
    keys = ["__g", "metric", "part"]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Merges the summaries of each key, which follow one another."""
        key, levels = None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame([dict(zip(keys, key)) | _row(levels.one())])

        for pdf in batches:
            for r in pdf.itertuples():
                if (k := (r[1], r[2], r[3])) != key:
                    if levels:
                        yield done()
                    key, levels = k, Levels(tuples, fan_in)
                levels.add(_of(r))
        if levels:
            yield done()

    def step(df: DataFrame, part) -> DataFrame:
        fields = ["n", "error", "level", "v", "low", "high"]
        sorted_ = df.select("__g", "metric", part.alias("__p"), "part", *fields).repartition("__g", "metric", "__p").sortWithinPartitions("__g", "metric", "__p", "level", "part", "n", "v")
        return sorted_.select("__g", "metric", F.col("__p").alias("part"), *fields).mapInPandas(runs, f"__g {kind}, {SCHEMA}")

    near = step(parts.withColumnRenamed(group, "__g"), F.floor(F.col("part") / F.lit(fan_in)))
    return step(near, F.lit(0).cast("long")).withColumnRenamed("__g", group)


def quantiles(summary: DataFrame, group: str, shares: dict[int, float]) -> DataFrame:
    """``group``, ``metric``, ``q``, ``value``, ``n``, ``error``: the kept value whose rank is least uncertain about the wanted one.

    ``error`` bounds the difference between the value's rank and the wanted rank, as a share of ``n``.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("q"), F.lit(float(x)).alias("x")) for k, x in shares.items())))
    rows = summary.select(quoted(group), "metric", "n", F.arrays_zip("v", "low", "high").alias("__t"), each.alias("__q"))
    rank = F.greatest(F.lit(1.0), F.ceil(F.col("__q.x") * F.col("n")).cast("double"))
    off = F.transform("__t", lambda t: F.struct(F.greatest(rank - t["low"], t["high"] - rank).alias("off"), t["v"].alias("v")))
    return rows.withColumn("__b", F.array_min(off)).select(quoted(group), "metric", F.col("__q.q").alias("q"), F.col("__b.v").alias("value"), "n", (F.col("__b.off") / F.col("n")).alias("error"))
