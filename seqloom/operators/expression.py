"""Expression tables: joining samples, statistics per transcript, filters, best isoforms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import quoted


def outer_join(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """All tables side by side, a row for every key of any."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def widen(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per sample, in one shuffle however many samples there are."""
    return df.groupBy(quoted(key)).pivot(name, list(names)).agg(F.sum(quoted(value)))


def row_statistics(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Least, largest, median and mean over columns of each row, nulls left out, rounded half to even."""
    values = F.array_sort(F.filter(F.array(*(quoted(c).cast("double") for c in columns)), lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(values)
    middle = (F.get(values, ((n - 1) / 2).cast("int")) + F.get(values, (n / 2).cast("int"))) / 2
    mean = F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / F.nullif(n, F.lit(0))
    r = lambda c: F.bround(c, digits)
    return df.withColumns({"tscript_min": r(F.array_min(values)), "tscript_max": r(F.array_max(values)), "tscript_median": r(F.when(n > 0, middle)), "tscript_mean": r(mean)})


def expressed(df: DataFrame, least: dict[str, float]) -> DataFrame:
    """Rows above (>) each statistic's cut-off."""
    return reduce(lambda d, kv: d.where(quoted(f"tscript_{kv[0]}") > kv[1]), least.items(), df)


def with_genes(df: DataFrame, genes: DataFrame, key: str) -> DataFrame:
    """Gene of each transcript, null where unknown."""
    return df.join(genes.select(F.col("transcript_id").alias("__t"), "gene_id"), quoted(key) == F.col("__t"), "left").drop("__t")


def top_isoforms(df: DataFrame, n: int, statistic: str, key: str) -> DataFrame:
    """The ``n`` transcripts of a gene with the highest statistic; ties by transcript id; all for n below 0."""
    if n < 0:
        return df
    order = Window.partitionBy("gene_id").orderBy(F.desc_nulls_last(statistic), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def distinct_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.countDistinct(quoted(c)).alias(f"n_{c}") for c in columns))


def isoform_id(name: Column) -> Column:
    """Transcript of a read-based isoform name: what stands before the last underscore, ``;`` as ``:``."""
    return F.replace(F.regexp_replace(name, "_[^_]*$", ""), F.lit(";"), F.lit(":"))
