"""Gene models: consensus and metagene, coding lengths, start and end windows, untranslated parts, truncation by percentile.

Annotation rows are closed 1-based ranges with ``gene_id``, ``transcript_id``,
``feature``, ``chrom``, ``start``, ``end`` and ``strand``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators import intervals

GENE = ["gene_id", "chrom", "strand"]


def model_transcripts(rows: DataFrame) -> DataFrame:
    """Transcripts that decide a gene's model: the coding ones where it has any, else all."""
    tx = rows.groupBy(*GENE, "transcript_id").agg(F.max((F.col("feature") == "CDS").cast("int")).alias("coding"))
    any_coding = tx.groupBy(*GENE).agg(F.max("coding").alias("__any"))
    return tx.join(any_coding, GENE).where(F.col("coding") == F.col("__any")).select(*GENE, "transcript_id")


def consensus(rows: DataFrame, label: str = "consensus") -> DataFrame:
    """Exons and coding parts common to all deciding transcripts of a gene: largest start to smallest end of what overlaps.

    Candidates come from all transcripts, deciding ones must all overlap them.
    """
    return _labelled(intervals.common_overlap, rows, label, model_transcripts(rows))


def _labelled(operator, rows: DataFrame, label: str, members: DataFrame) -> DataFrame:
    out = []
    for feature in ("exon", "CDS"):
        part = rows.where(F.col("feature") == feature)
        own = operator(part, GENE, "transcript_id", members=members)
        out.append(own.withColumn("feature", F.lit(feature)))
    return out[0].unionAll(out[1]).withColumn("transcript_id", F.concat("gene_id", F.lit(f".{label}")))


def without_consensus(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Genes with exons of which none is common."""
    return rows.where("feature = 'exon'").select("gene_id").distinct().join(model.where("feature = 'exon'"), "gene_id", "left_anti")


def metagene(rows: DataFrame, label: str = "metagene") -> DataFrame:
    """Exons and coding parts of the deciding transcripts, joined where they overlap or are neighbours."""
    part = rows.where(F.col("feature").isin("exon", "CDS")).join(model_transcripts(rows), [*GENE, "transcript_id"], "left_semi")
    return intervals.merge_closed(part, [*GENE, "feature"]).withColumn("transcript_id", F.concat("gene_id", F.lit(f".{label}")))


def untranslated(rows: DataFrame) -> DataFrame:
    """Untranslated parts of each coding transcript's exons, as UTR5 and UTR3 by strand."""
    keys = [*GENE, "transcript_id"]
    cds = rows.where("feature = 'CDS'").groupBy(*keys).agg(F.min("start").alias("__cs"), F.max("end").alias("__ce"))
    exons = rows.where("feature = 'exon'").join(cds, keys)
    left = F.when(F.col("start") < F.col("__cs"), F.struct(F.when(F.col("strand") == "-", "UTR3").otherwise("UTR5").alias("feature"), F.col("start"), F.least(F.col("end"), F.col("__cs") - 1).alias("end")))
    right = F.when(F.col("end") > F.col("__ce"), F.struct(F.when(F.col("strand") == "-", "UTR5").otherwise("UTR3").alias("feature"), F.greatest(F.col("start"), F.col("__ce") + 1).alias("start"), F.col("end")))
    return exons.select(*keys, F.explode(F.filter(F.array(left, right), lambda x: x.isNotNull())).alias("__x")).select(*keys, "__x.*")


def coding_length(rows: DataFrame) -> DataFrame:
    return rows.where("feature = 'CDS'").groupBy("gene_id", "transcript_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))


def by_coding_length(rows: DataFrame, longest: bool = True) -> DataFrame:
    """All rows of the transcript with the longest (shortest) coding length of each gene; of equal ones the smallest id."""
    size = -F.col("length") if longest else F.col("length")
    best = coding_length(rows).groupBy("gene_id").agg(F.min(F.struct(size.alias("s"), F.col("transcript_id").alias("t"))).alias("__b")).select("gene_id", F.col("__b.t").alias("transcript_id"))
    return rows.join(best, ["gene_id", "transcript_id"], "left_semi")


def end_windows(rows: DataFrame, upstream: int, downstream: int, at: str = "start") -> DataFrame:
    """Windows around each transcript's start (or end) in its direction, 0-based half-open, not below 0."""
    tx = rows.groupBy(*GENE, "transcript_id").agg(F.min("start").alias("__s"), F.max("end").alias("__e"))
    plus = F.col("strand") != "-"
    first = plus if at == "start" else ~plus
    point = F.when(first, F.col("__s")).otherwise(F.col("__e"))
    a = F.when(plus, point - 1 - upstream).otherwise(point - 1 - downstream)
    b = F.when(plus, point + downstream).otherwise(point + upstream)
    return tx.select(*GENE, "transcript_id", F.greatest(F.lit(0), a).alias("start"), b.alias("end"))


def truncate(rows: DataFrame, feature: str, low: float, high: float) -> DataFrame:
    """The part of each transcript's feature between two percentiles of its length, counted in its direction.

    Cut points are rounded half to even; the new end lies one base beyond what a
    closed range from the low to the high point would have.
    """
    keys = [*GENE, "transcript_id"]
    part = rows.where(F.col("feature") == feature)
    if low <= 0 and high >= 100:
        return part
    plus = F.col("strand") != "-"
    order = Window.partitionBy(*keys).orderBy(F.when(plus, F.col("start")).otherwise(-F.col("start")), "end")
    size = F.col("end") - F.col("start") + 1
    t = part.withColumns({"__to": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum(size).over(Window.partitionBy(*keys))})
    t = t.withColumns({"__from": F.col("__to") - size, "__a": F.bround(F.col("__all") * (low / 100.0)).cast("long"), "__b": F.bround(F.col("__all") * (high / 100.0)).cast("long")})
    t = t.where((F.col("__to") > F.col("__a")) & (F.col("__from") < F.col("__b")))
    skip, stop = F.greatest(F.lit(0), F.col("__a") - F.col("__from")), F.least(size, F.col("__b") - F.col("__from"))
    cut_end = stop < size
    start = F.when(plus, F.col("start") + skip).otherwise(F.when(cut_end, F.col("end") - stop).otherwise(F.col("start")))
    end = F.when(plus, F.when(cut_end, F.col("start") + stop).otherwise(F.col("end"))).otherwise(F.col("end") - skip)
    return t.withColumns({"__ns": start, "__ne": end}).drop("start", "end").withColumnsRenamed({"__ns": "start", "__ne": "end"}).select(*rows.columns)


def isoform_counts(rows: DataFrame, coding_only: bool = False) -> DataFrame:
    part = rows.where("feature = 'CDS'") if coding_only else rows
    return part.groupBy("gene_id").agg(F.countDistinct("transcript_id").alias("isoforms"))


def tx_to_gene(rows: DataFrame) -> DataFrame:
    """One gene per transcript; of several the last by id."""
    return rows.where("transcript_id is not null").groupBy("transcript_id").agg(F.max("gene_id").alias("gene_id"))


def propagate_ids(rows: DataFrame) -> DataFrame:
    """Gene and transcript ids of GFF3 rows (``id``, ``parent``, ``feature``) from their parents, whatever the order of rows."""
    renamed = rows.withColumn("feature", F.when(F.col("feature") == "mRNA", "transcript").otherwise(F.col("feature")))
    own = renamed.where("id is not null").select(F.col("id").alias("__id"), F.col("parent").alias("__up"), F.col("feature").alias("__kind")).dropDuplicates(["__id"])
    joined = renamed.join(own, F.col("parent") == F.col("__id"), "left")
    gene = F.when(F.col("feature") == "gene", F.col("id")).when(F.col("feature") == "transcript", F.col("parent")).otherwise(F.col("__up"))
    tx = F.when(F.col("feature") == "transcript", F.col("id")).when(~F.col("feature").isin("gene", "transcript"), F.col("parent"))
    return joined.select(*renamed.columns, gene.alias("gene_id"), tx.alias("transcript_id"))


def blocks_to_rows(df: DataFrame, blocks: str, keep: list[str], feature: str = "CDS") -> DataFrame:
    """Rows of open reading frames written ``start-end|start-end`` (0-based starts), as closed 1-based ranges."""
    x = df.select(*keep, F.posexplode(F.split(blocks, r"\|")).alias("part", "__b"))
    return x.select(*keep, "part", F.lit(feature).alias("feature"), (F.split("__b", "-")[0].cast("long") + 1).alias("start"), F.split("__b", "-")[1].cast("long").alias("end"))


def gtf_line(source: str) -> Column:
    """A line of a GTF file."""
    attributes = F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('"; transcript_id "'), F.col("transcript_id"), F.lit('";'))
    return F.concat_ws("\t", "chrom", F.lit(source), "feature", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attributes)


def stitch(df: DataFrame, keys: list[str], start: str, sequence: str) -> DataFrame:
    """Overlapping sequence pieces joined into contigs: ``keys``, ``start``, ``end``, ``sequence``.

    Pieces are grouped into stretches without a gap; each stretch, which is as
    long as its sequence, is put together in one group.
    """
    from seqloom.operators import periods

    rows = df.select(*keys, F.col(start).cast("long").alias("start"), F.col(sequence).alias("sequence")).where(F.length("sequence") > 0).withColumn("end", F.col("start") + F.length("sequence"))
    spans = periods.merge_ranges(rows, keys).withColumnsRenamed({"seg_start": "start", "seg_end": "end"})
    pairs = intervals.range_join(rows, spans, keys)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        text, at = [], int(first["r_start"])
        for r in pdf.sort_values(["start", "end"]).itertuples():
            if r.end > at:
                text.append(r.sequence[at - r.start :])
                at = r.end
        return pd.DataFrame([{**{k: first[k] for k in keys}, "start": int(first["r_start"]), "end": at, "sequence": "".join(text)}])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start long, end long, sequence string"
    return pairs.groupBy(*keys, "r_start").applyInPandas(join, schema)


def filter_orfs(df: DataFrame, p_column: str, most: float, keep: dict[str, list[str]] | None = None, least_aa: int = 0, aa: Column | None = None) -> DataFrame:
    """Open reading frames with a p- or q-value of at most ``most``, of the listed types, long enough.

    Values that are no numbers count as missing; a column without any number is not filtered on.
    """
    value = F.col(p_column).try_cast("double")
    known = df.agg(F.count(value).alias("n")).scalar()
    out = df.where((value <= most) | (known == 0))
    for column, values in (keep or {}).items():
        out = out.where(F.col(column).isin(values))
    return out if aa is None else out.where(aa >= least_aa)


def drop_unscored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in one of the columns at least."""
    return df.dropna(how="all", subset=columns)
