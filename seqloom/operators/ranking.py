"""Selecting guides per target: normalised weights, cut-offs, top N, spacing, counts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import quoted
from seqloom.operators import periods


def min_max(df: DataFrame, columns: Sequence[str], digits: int = 4, suffix: str = "_norm") -> DataFrame:
    """Columns scaled to 0..1 over the whole table, rounded half to even; null for a column with one value."""
    names = [f for c in columns for f in (F.min(quoted(c)).alias(f"lo_{c}"), F.max(quoted(c)).alias(f"hi_{c}"))]
    bounds = df.agg(F.struct(*names).alias("b")).scalar()  # one row
    spans = {c: F.nullif(bounds[f"hi_{c}"] - bounds[f"lo_{c}"], F.lit(0.0)) for c in columns}
    return df.withColumns({c + suffix: F.bround((quoted(c) - bounds[f"lo_{c}"]) / spans[c], digits) for c in columns})


def weighted(weights: Mapping[str, float], digits: int = 4) -> Column:
    """Sum of weighted columns over their number, rounded half to even."""
    total = sum((quoted(c) * float(w) for c, w in weights.items()), F.lit(0.0))
    return F.bround(total / len(weights), digits)


def at_least(df: DataFrame, cutoffs: Mapping[str, float]) -> DataFrame:
    """Rows that reach every cut-off (>=)."""
    for c, x in cutoffs.items():
        df = df.where(quoted(c) >= x)
    return df


def above(df: DataFrame, cutoffs: Mapping[str, float]) -> DataFrame:
    """Rows above every cut-off (>)."""
    for c, x in cutoffs.items():
        df = df.where(quoted(c) > x)
    return df


def unique_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose values no other row has; all copies of repeated ones go."""
    n = df.groupBy(*(quoted(c) for c in columns)).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return df.join(n, list(columns), "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*(quoted(k) for k in keys)).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key with ``rank_no``; all for n below 0, none for 0."""
    w = Window.partitionBy(*(quoted(k) for k in keys)).orderBy(*order)
    ranked = df.withColumn("rank_no", F.row_number().over(w))
    return ranked if n < 0 else ranked.where(F.col("rank_no") <= n)


def percent_rank(df: DataFrame, columns: Sequence[str], digits: int = 2, suffix: str = "_pct") -> DataFrame:
    """Average percentile rank of every value over the table, null for nulls.

    Values are counted first and ranked once each, in ranges of equal numbers
    of different values, so the table is not ordered in one task.
    """
    out = df
    for c in columns:
        values = df.where(quoted(c).isNotNull() & ~F.isnan(quoted(c).cast("double"))).groupBy(quoted(c).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        ranked = running_total(values, "__v", "__c", "__to")
        total = values.agg(F.sum("__c")).scalar()
        rank = (F.col("__to") - F.col("__c") + 1 + F.col("__to")) / 2 / total * 100
        ranked = ranked.select("__v", F.bround(rank, digits).alias(c + suffix))
        out = out.join(ranked, quoted(c) == F.col("__v"), "left").drop("__v")
    return out


def running_total(df: DataFrame, order: str, value: str, out: str, ranges: int = 1024) -> DataFrame:
    """Sum of ``value`` over all rows up to each, in order of the numeric column ``order``.

    Rows are cut into ranges of ``order`` between its least and largest value;
    ranges are summed first, then rows inside a range, so no task orders the
    whole table.
    """
    o = quoted(order).cast("double")
    low, high = df.agg(F.min(o)).scalar(), df.agg(F.max(o)).scalar()
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    rows = df.withColumn("__range", F.floor((o - low) / span * F.lit(ranges - 1)))
    before = rows.groupBy("__range").agg(F.sum(quoted(value)).alias("__s"))
    # at most one row per range
    before = before.select(F.col("__range").alias("__rr"), (F.sum("__s").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__s")).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(quoted(order))
    return rows.join(before, F.col("__range") == F.col("__rr")).withColumn(out, F.col("__before") + F.sum(quoted(value)).over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("__range", "__rr", "__before")


def row_chunks(df: DataFrame, order: str, size: int, out: str = "chunk") -> DataFrame:
    """The number of each row's chunk of ``size`` rows, in order of a numeric column without repeats."""
    rows = running_total(df.withColumn("__one", F.lit(1)), order, "__one", "__to")
    return rows.withColumn(out, ((F.col("__to") - 1) / size).cast("long")).drop("__one", "__to")


def without(targets: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Different targets that have no row, nulls left out."""
    return targets.select(quoted(key)).where(quoted(key).isNotNull()).distinct().join(rows.select(quoted(key)), key, "left_anti")


def shares_above(df: DataFrame, columns: Sequence[str], cutoff: float = 0.2, missing: float = -1.0) -> DataFrame:
    """Per column the rows above a cut-off, among rows of which no column is missing (null, NaN or ``missing``)."""
    full = reduce(lambda a, b: a & b, (F.coalesce(~F.isnan(quoted(c).cast("double")) & (quoted(c) != missing), F.lit(False)) for c in columns))
    rows = df.where(full).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (quoted(c) > cutoff).alias("above")) for c in columns))).alias("x"))
    return rows.groupBy("x.column").agg(F.count(F.lit(1)).alias("rows"), F.count_if("x.above").alias("above"))


def mann_whitney(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """Mann-Whitney test of two groups: ``n_a``, ``n_b``, ``u_a``, ``u_b`` and ``z`` with the correction for ties; z is null where a group is empty or all values are equal."""
    rows = df.where(quoted(group).isin(a, b) & quoted(value).isNotNull() & ~F.isnan(quoted(value).cast("double"))).select((quoted(group) == a).cast("long").alias("__a"), quoted(value).cast("double").alias("__v"))
    values = rows.groupBy("__v").agg(F.count(F.lit(1)).alias("__c"), F.sum("__a").alias("__ca"))
    ranked = running_total(values, "__v", "__c", "__to")
    middle = F.col("__to") - (F.col("__c") - 1) / 2
    ties = F.pow(F.col("__c").cast("double"), F.lit(3)) - F.col("__c")
    t = ranked.agg(F.coalesce(F.sum("__ca"), F.lit(0)).alias("n_a"), F.coalesce(F.sum(F.col("__c") - F.col("__ca")), F.lit(0)).alias("n_b"), F.sum(F.col("__ca") * middle).alias("__r"), F.sum(ties).alias("__t"))
    n, a_, b_ = F.col("n_a") + F.col("n_b"), F.col("n_a").cast("double"), F.col("n_b").cast("double")
    u = F.col("__r") - a_ * (a_ + 1) / 2
    spread = F.sqrt(a_ * b_ / 12 * ((n + 1) - F.col("__t") / F.nullif(n * (n - 1), F.lit(0))))
    return t.select("n_a", "n_b", u.alias("u_a"), (a_ * b_ - u).alias("u_b"), ((u - a_ * b_ / 2) / F.nullif(spread, F.lit(0.0))).alias("z"))


def correlations(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns in every group, over rows that have both."""
    rows = df.where(quoted(a).isNotNull() & quoted(b).isNotNull() & ~F.isnan(quoted(a).cast("double")) & ~F.isnan(quoted(b).cast("double"))).select(quoted(group), quoted(a).cast("double").alias("__a"), quoted(b).cast("double").alias("__b"))
    for c in ("__a", "__b"):
        # values once with their weight, so ties of a group are one row
        values = rows.groupBy(quoted(group).alias("__g"), F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        to = F.sum("__c").over(Window.partitionBy("__g").orderBy("__v"))
        ranks = values.select("__g", "__v", (to - (F.col("__c") - 1) / 2).alias(f"{c}_r"))
        rows = rows.join(ranks, quoted(group).eqNullSafe(F.col("__g")) & (F.col(c) == F.col("__v"))).drop("__g", "__v")
    return rows.groupBy(quoted(group)).agg(F.corr("__a", "__b").alias("pearson"), F.corr("__a_r", "__b_r").alias("spearman"), F.count(F.lit(1)).alias("rows"))


def spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, stop: str, distance: int) -> DataFrame:
    """Rows chosen greedily per key, best first, that keep their distance from those chosen before.

    A row conflicts if its range comes within ``distance`` of a chosen one;
    rows with the very coordinates of a chosen one stay with it.  Rows of equal
    order are taken by place.  Rows without a key or a place are left out.  A
    key falls into stretches further apart than ``distance``, which don't
    influence each other and are worked through one by one; chosen ranges lie
    apart, so the one that could conflict is found by bisection.
    """
    columns = [quoted(c) for c in df.columns]
    at = [df.columns.index(c) for c in (start, stop)]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*order, start, stop], kind="stable")
        starts: list[int] = []
        stops: list[int] = []
        kept = np.zeros(len(pdf), bool)
        for i, (s, e) in enumerate(zip(pdf.iloc[:, at[0]].tolist(), pdf.iloc[:, at[1]].tolist())):
            k = bisect_right(starts, e + distance)
            if k == 0 or stops[k - 1] < s - distance:
                starts.insert(k, s)
                stops.insert(k, e)
                kept[i] = True
            else:
                j = bisect_right(starts, s)
                kept[i] = j > 0 and starts[j - 1] == s and stops[j - 1] == e
        return pdf[kept]

    wide = df.select(*(quoted(k) for k in keys), quoted(start).alias("__f"), (quoted(stop) + distance + 1).alias("__u"))
    stretches = periods.merge_ranges(wide, keys, "__f", "__u").select(*(quoted(k).alias(f"r_{k}") for k in keys), "seg_start", "seg_end")
    tile = 1 << 20
    over = stretches.withColumn("__tile", F.explode(F.sequence(F.floor(F.col("seg_start") / tile), F.floor((F.col("seg_end") - 1) / tile))))
    same = reduce(lambda x, y: x & y, (quoted(k) == quoted(f"r_{k}") for k in keys))
    rows = df.withColumn("__own", F.floor(quoted(start) / tile)).join(over, same & (F.col("__own") == F.col("__tile")) & (quoted(start) >= F.col("seg_start")) & (quoted(start) < F.col("seg_end")))
    return rows.select(*columns, "seg_start").groupBy(*(quoted(k) for k in keys), "seg_start").applyInPandas(lambda pdf: choose(pdf.drop(columns="seg_start")), df.schema).select(*columns)


def counts_with_zero(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Rows per target, targets without any included."""
    n = rows.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("rows"))
    return targets.select(quoted(key)).distinct().join(n, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def count_of_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("rows").agg(F.count(F.lit(1)).alias("targets"))


def count_summary(counts: DataFrame) -> DataFrame:
    """Targets, targets without rows, least, largest and median count, the median with and without zeros."""
    some = F.when(F.col("rows") > 0, F.col("rows"))
    return counts.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("rows") == 0).alias("without"), F.min("rows").alias("least"), F.max("rows").alias("largest"), F.median("rows").alias("median_all"), F.median(some).alias("median_some"))


def bucket(value: Column) -> Column:
    """Class of a count: 0, 1, 2, 3-4, 5-9, 10-19, 20-49, 50+."""
    out = F.when(value <= 0, "0").when(value == 1, "1").when(value == 2, "2")
    for low, high in ((3, 4), (5, 9), (10, 19), (20, 49)):
        out = out.when(value <= high, f"{low}-{high}")
    return out.when(value >= 50, "50+")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns over rows that have both."""
    rows = df.where(quoted(a).isNotNull() & quoted(b).isNotNull()).select(quoted(a).cast("double").alias("__a"), quoted(b).cast("double").alias("__b"))
    ranked = percent_rank(rows, ["__a", "__b"], digits=10)
    return ranked.agg(F.corr("__a", "__b").alias("pearson"), F.corr("__a_pct", "__b_pct").alias("spearman"), F.count(F.lit(1)).alias("rows"))
