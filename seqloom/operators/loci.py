"""Off-target lists of single guides taken apart: buckets by distance, sums, uniqueness; and comparison of guide sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.common import quoted
from seqloom.functions import sequence as sq
from seqloom.operators import offtarget

#: Bases that differ at most in a bucket; the first bases of a site, its motif, are not compared.
MOST, MOTIF, COMPARED = 4, 4, 20


def places(df: DataFrame, contig: str = "contig", target: str = "target", cell: str = "offTargets") -> DataFrame:
    """One row per place of every off-target: ``contig``, ``target``, ``site``, ``place`` (``chrom:pos:strand``), ``mm``.

    Distances are counted again from the sequences.  Places that can't be read are left out.
    """
    hits = df.select(quoted(contig).alias("contig"), quoted(target).alias("target"), F.explode(sq.cell_targets(quoted(cell))).alias("x")).select("contig", "target", F.col("x.sequence").alias("site"), F.explode("x.loci").alias("l"))
    parsed = hits.withColumns({"__at": F.regexp_extract("l", r"^(.*)\^([FR])$", 1), "__s": F.when(F.endswith("l", F.lit("F")), "+").otherwise("-")}).where("__at <> ''")
    return parsed.select("contig", "target", "site", F.concat_ws(":", "__at", "__s").alias("place"), sq.trimmed_mismatches(F.col("target"), F.col("site"), MOTIF, COMPARED).cast("int").alias("mm"))


def own_place(contig: Column) -> Column:
    """Where a guide named ``chrom:pos:strand`` lies itself: one base before its position on +, 21 before on -; null below 1."""
    chrom, pos, strand = (F.regexp_extract(contig, r"^(.+):(\d+):([+-])$", i) for i in (1, 2, 3))
    at = pos.try_cast("long") - F.when(strand == "+", 1).otherwise(21)
    return F.when(at >= 1, F.concat_ws(":", chrom, at.cast("string"), strand))


def summary(rows: DataFrame, matrix: Mapping[tuple[int, str, str], float], length: int = COMPARED) -> DataFrame:
    """Per guide: places by distance, sums of scores over all places within reach (all motifs, and without TTTT), 1 / sum, and uniqueness.

    A guide is unique if no other place equals it: ``unique_tttn`` for any
    motif, ``unique_tttv`` if none of those has a TTTV motif.  Where equal
    places have neither a TTTV nor a TTTT motif both are false.
    """
    near = rows.where(F.col("mm").between(0, MOST)).withColumn("__cfd", F.coalesce(offtarget.pair_score(F.substring("target", MOTIF + 1, length), F.substring("site", MOTIF + 1, length), matrix, length), F.lit(0.0)))
    tttt = sq.starts_tttt(F.col("site"))
    other = (F.col("mm") == 0) & ~F.col("place").eqNullSafe(own_place(F.col("contig")))
    counts = [F.count_if(F.col("mm") == d).alias(f"mm{d}") for d in range(MOST + 1)]
    out = near.groupBy("contig").agg(*counts, F.sum("__cfd").alias("tttn_sum"), F.sum(F.when(~tttt, F.col("__cfd")).otherwise(0.0)).alias("tttv_sum"), F.count_if(other).alias("__others"), F.max(other & sq.starts_tttv(F.col("site"))).alias("__v"), F.max(other & tttt).alias("__t"))
    share = lambda c: F.when(F.col(c) > 0, 1 / F.col(c))
    alone = F.col("__others") == 0
    flags = {"unique_tttn": alone, "unique_tttv": alone | (~F.col("__v") & F.col("__t"))}
    return out.withColumns({"tttn_score": share("tttn_sum"), "tttv_score": share("tttv_sum"), **flags}).drop("__others", "__v", "__t")


def compare(a: DataFrame, b: DataFrame, key: str, value: str, near: float = 1e-6) -> DataFrame:
    """How far two score tables differ: shared keys, equal ones, largest and mean difference."""
    j = a.select(quoted(key), quoted(value).alias("__a")).join(b.select(quoted(key), quoted(value).alias("__b")), key)
    d = F.abs(F.col("__a") - F.col("__b"))
    return j.agg(F.count(F.lit(1)).alias("shared"), F.count_if(d <= near).alias("equal"), F.max(d).alias("largest"), F.avg(d).alias("mean"))


def allele_specific(a: DataFrame, b: DataFrame, key: str, sequence: str, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Guides of two alleles: those at shared places that differ in at least ``least`` bases, and those at places of one allele alone."""
    other = b.select(quoted(key).alias("__k"), quoted(sequence).alias("other"))
    both = a.join(other, quoted(key) == F.col("__k")).drop("__k").withColumn("distance", sq.mismatches(quoted(sequence), F.col("other"))).where(F.col("distance") >= least)
    return both, a.join(b.select(key).distinct(), key, "left_anti"), b.join(a.select(key).distinct(), key, "left_anti")


def sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many different keys two tables share, and how many only one has: ``side`` (both, first, second) and ``rows``."""
    j = a.select(quoted(key).alias("k")).distinct().withColumn("__a", F.lit(1)).join(b.select(quoted(key).alias("k")).distinct().withColumn("__b", F.lit(1)), "k", "full_outer")
    side = F.when(F.col("__a").isNull(), "second").when(F.col("__b").isNull(), "first").otherwise("both")
    return j.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("rows"))


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two tables with equal keys; that both have the same keys is checked first, and an error where they don't."""
    odd = {r["side"]: r["rows"] for r in sides(a, b, key).collect() if r["side"] != "both"}
    if odd:
        raise ValueError(f"keys of one table alone: {odd}")
    return a.join(b, key)


def union_checked(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables whose columns are the same, else an error."""
    first = frames[0].columns
    for f in frames[1:]:
        if f.columns != first:
            raise ValueError(f"columns differ: {first} and {f.columns}")
    return reduce(DataFrame.unionAll, frames)


def remaining(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a list of tasks that are not in the list of finished ones."""
    return wanted.join(done.select(*(quoted(k) for k in keys)).distinct(), list(keys), "left_anti")


def draw(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a seeded hash of their key: the same ones whatever the partitioning."""
    return df.orderBy(F.xxhash64(quoted(key), F.lit(seed)), quoted(key)).limit(n)
