"""Per-key results where a few keys hold most rows.

All results come from value-frequency compression: rows are grouped by key
*and* value first.  The shuffle of that grouping hashes key and value together,
so the rows of one hot key spread over all tasks; what remains per key is one
row per different value with its weight, and everything after it is an
algebraic aggregate with a map-side part, or a window over a bounded number of
value ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import quoted

#: Most ranges that values are cut into: a window holds about so small a part of a table's rows.
VALUE_RANGES = 4096


def compress(df: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str = "__weight") -> DataFrame:
    """One row per different (keys, values), with the number of rows that had it.

    Null keys and values are kept and compare as equal.
    """
    return df.groupBy(*(quoted(c) for c in [*keys, *values])).agg(F.count(F.lit(1)).alias(weight))


def dominant_keys(df: DataFrame, key: str, values: Sequence[str], share: float) -> DataFrame:
    """Keys with at least ``share`` of all different rows: columns ``key``, ``rows``, ``total``.

    Rows equal in ``key`` and ``values`` count once.  Rows with a null key are
    left out, of the total as well.  An empty table gives no keys.
    """
    rows = compress(df.where(quoted(key).isNotNull()), [key], values)
    counts = rows.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.withColumn("total", total.scalar()).where(F.col("rows") >= F.lit(share) * F.col("total"))


def distinct_count(weighted: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact number of different non-null values per key, from compressed rows."""
    pairs = weighted.groupBy(quoted(key), quoted(value)).agg(F.lit(1).alias("__one"))
    return pairs.groupBy(quoted(key)).agg(F.count(quoted(value)).alias(out))


def mode(weighted: DataFrame, key: str, value: str, out: str, weight: str = "__weight") -> DataFrame:
    """The most frequent non-null value per key; of equally frequent ones the smallest.  Null where a key has none."""
    pairs = weighted.groupBy(quoted(key), quoted(value)).agg(F.sum(weight).alias("__w"))
    known = F.when(quoted(value).isNotNull(), F.struct((-F.col("__w")).alias("w"), quoted(value).alias("v")))
    return pairs.groupBy(quoted(key)).agg(F.min(known).alias("__m")).select(quoted(key), F.col("__m.v").alias(out))


def value_ranges(values: DataFrame, columns: Sequence[str], rows: int | None = None) -> list[list[float]]:
    """Bounds of numeric columns between which about equally many rows lie, for :func:`in_range`.

    Found by one pass over the columns, without a shuffle of rows; a row count
    to aim at per range may be given.  At most ``VALUE_RANGES`` bounds a column
    come to the driver.
    """
    ranges = VALUE_RANGES if rows is None else max(16, min(VALUE_RANGES, rows))
    return [sorted(set(b)) for b in values.approxQuantile(list(columns), [i / ranges for i in range(ranges + 1)], 0.5 / ranges)]


def in_range(df: DataFrame, column: str, bounds: Sequence[float], out: str) -> DataFrame:
    """``df`` with the number of the range that a value lies in, larger for larger values, as ``out``.

    Every bound is a range of its own, with an odd number, and so are the
    values between two bounds, with an even one.  A value that many rows have
    is a bound, so ranges of different values hold few rows, and in the others
    all rows are alike.  Null and NaN have no range.
    """
    steps = sorted({x for b in bounds if math.isfinite(b) for x in (b, math.nextafter(b, math.inf))})
    splits = [-math.inf, *steps, math.inf] if steps else [-math.inf, 0.0, math.nextafter(0.0, 1.0), math.inf]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df).withColumn(out, F.col(out).cast("int"))


def percentiles(weighted: DataFrame, key: str, value: str, shares: dict[str, float], weight: str = "__weight", bounds: Sequence[float] | None = None) -> DataFrame:
    """Exact percentiles per key from compressed rows: the smallest value with at least that share of the weight at or below it.

    Null and NaN values don't count; a key without any other gives no row.  The
    values of a key are counted in ranges that hold about equally many rows of
    the table (``bounds``, found from the values if not given); only the ranges
    that hold a wanted rank are then ordered value by value, so a hot key never
    comes to one task as a whole, whatever the distribution of its values.
    """
    v = quoted(value).cast("double")
    rows = weighted.where(v.isNotNull() & ~F.isnan(v)).groupBy(quoted(key).alias("__k"), v.alias("__v")).agg(F.sum(weight).alias("__w"))
    rows = in_range(rows, "__v", value_ranges(rows, ["__v"])[0] if bounds is None else bounds, "__r")
    order = Window.partitionBy("__k").orderBy("__r")
    wanted = F.array(*(F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(float(q)))).alias("rank")) for n, q in shares.items()))
    ranks = (
        rows.groupBy("__k", "__r").agg(F.sum("__w").alias("__c"))
        .withColumn("__to", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(Window.partitionBy("__k")))
        .withColumn("__from", F.col("__to") - F.col("__c"))
        .withColumn("__q", F.filter(wanted, lambda x: (x["rank"] > F.col("__from")) & (x["rank"] <= F.col("__to"))))
        .where(F.size("__q") > 0).select(F.col("__k").alias("__rk"), F.col("__r").alias("__rr"), "__from", "__q")
    )
    near = rows.join(ranks, F.col("__k").eqNullSafe(F.col("__rk")) & (F.col("__r") == F.col("__rr"))).drop("__rk", "__rr")
    inside = Window.partitionBy("__k", "__r").orderBy("__v")
    hits = near.withColumn("__to", F.col("__from") + F.sum("__w").over(inside)).select("__k", "__v", "__to", F.explode("__q").alias("__q")).where(F.col("__to") >= F.col("__q.rank"))
    picked = (F.min(F.when(F.col("__q.name") == n, F.col("__v"))).alias(n) for n in shares)
    return hits.groupBy("__k").agg(*picked).withColumnRenamed("__k", key)


def key_report(df: DataFrame, key: str, sums: dict[str, str], distinct: dict[str, str], modes: dict[str, str], shares: dict[str, tuple[str, float]]) -> DataFrame:
    """Rows, sums, exact distinct counts, modes and percentiles of every non-null key.

    Each argument maps a result's name to the column it is of (``shares`` to
    column and share).  One row per key, also where all values are null; the
    sum of no value is null.  Each column is compressed with the key alone:
    columns of few values then shuffle next to nothing.
    """
    known = df.where(quoted(key).isNotNull())
    out = known.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(quoted(c)).alias(n) for n, c in sums.items()))
    by_column: dict[str, dict[str, float]] = {}
    for n, (c, q) in shares.items():
        by_column.setdefault(c, {})[n] = q
    numeric = {c: F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double")).alias(f"v{i}") for i, c in enumerate(by_column)}
    bounds = value_ranges(known.select(*numeric.values()), [f"v{i}" for i in range(len(numeric))]) if numeric else []
    for i, (c, q) in enumerate(by_column.items()):
        out = out.join(percentiles(compress(known, [key], [c]), key, c, q, bounds=bounds[i]), key, "left")
    for c in dict.fromkeys([*distinct.values(), *modes.values()]):
        weighted = compress(known, [key], [c])
        for n in (n for n, x in distinct.items() if x == c):
            out = out.join(distinct_count(weighted, key, c, n), key, "left")
        for n in (n for n, x in modes.items() if x == c):
            out = out.join(mode(weighted, key, c, n), key, "left")
    return out
