"""One order of items from several scores on different scales, by robust rank aggregation.

Each score only counts by the item's rank, so no scale dominates.  An item's
ranks, divided by the group's size and sorted, are compared with what random
ranks would be: the k-th smallest of m follows a Beta(k, m - k + 1)
distribution.  The smallest of these probabilities times m (the Bonferroni
correction) is the item's significance, by which items are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.common import cut, quoted
from seqloom.llm import hotcold


def order_statistic(x: Column, k: int, m: int) -> Column:
    """Probability that at least ``k`` of ``m`` uniform ranks are at most ``x``."""
    terms = [F.lit(float(comb(m, j))) * F.pow(x, F.lit(float(j))) * F.pow(F.lit(1.0) - x, F.lit(float(m - j))) for j in range(k, m + 1)]
    total = terms[-1]
    for term in reversed(terms[:-1]):  # small terms first
        total = total + term
    return total


def aggregate_ranks(df: DataFrame, group: str, item: str, scores: Sequence[str], heavy_rows: int = hotcold.HEAVY_ROWS) -> DataFrame:
    """``group``, ``item``, ``group_size``, ``rank_0`` ..., ``significance`` (smaller is better), ``mean_rank``.

    Higher scores are better.  Only items with a group and all scores present
    (neither null nor NaN) take part.  Equal scores share the best rank.
    ``mean_rank`` (share of the group) tells items of equal significance apart.
    """
    m = len(scores)
    names = [f"__s{i}" for i in range(m)]
    rows = df.select(quoted(group).alias("__group"), quoted(item).alias("__item"), *(F.when(~F.isnan(quoted(s).cast("double")), quoted(s).cast("double")).alias(n) for s, n in zip(scores, names))).dropna()
    # counted, ranked and joined below: deduplicated once, in the shared folder
    ranked = hotcold.ranks(cut(rows), "__group", names, heavy_rows)
    shares = F.array_sort(F.array(*(F.col(f"__rank_{i}") / F.col("__n") for i in range(m))))
    ranked = ranked.withColumn("__x", shares)
    least = F.least(*(order_statistic(F.col("__x")[k - 1], k, m) for k in range(1, m + 1))) if m > 1 else F.col("__x")[0]
    mean = sum((F.col(f"__rank_{i}") for i in range(1, m)), F.col("__rank_0")) / (F.col("__n") * F.lit(m))
    return ranked.select(F.col("__group").alias(group), F.col("__item").alias(item), F.col("__n").alias("group_size"), *(F.col(f"__rank_{i}").alias(f"rank_{i}") for i in range(m)), (least * F.lit(float(m))).alias("significance"), mean.alias("mean_rank"))


def leaders(ranked: DataFrame, group: str, item: str, scores: int) -> DataFrame:
    """The most significant item of every group: ``group``, ``item``, ``group_size``, ``firsts``.

    Of equal significance the smaller mean rank, then the smaller item.
    ``firsts`` counts the group's items that no other exceeds on any score.  An
    aggregation with a map-side part, so a heavy group needs no window.
    """
    first = reduce(lambda a, b: a & b, (F.col(f"rank_{i}") == 1 for i in range(scores)))
    best = F.min(F.struct("significance", "mean_rank", quoted(item).alias("item"), "group_size", first.alias("first")))
    out = ranked.groupBy(quoted(group)).agg(best.alias("__b"), F.count_if(first).alias("firsts"))
    return out.select(quoted(group), F.col("__b.item").alias(item), F.col("__b.group_size").alias("group_size"), F.col("__b.first").alias("leads_all"), "firsts")
