"""Genome tracks: geometry, percentiles, off-target lists, byte offsets of a details file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import quoted
from seqloom.functions import sequence as sq
from seqloom.operators import ranking

# fixed values: widths of a 5' motif and its guide in the track
MOTIF, SPACER = 4, 23


def geometry(start: Column, strand: Column) -> tuple[Column, Column]:
    """Range of motif and guide from the guide's start: the motif lies before it on +, behind it on -."""
    plus = strand == "+"
    return F.when(plus, start - MOTIF).otherwise(start), F.when(plus, start + SPACER).otherwise(start + SPACER + MOTIF)


def off_target_lists(records: DataFrame, guide: str, text: Column, score: str, cap: int, blank_above: int | None = None) -> DataFrame:
    """Per guide its best off-targets as one text, best first, and their number; blank for guides with too many.

    Ties are ordered by the text.
    """
    rows = records.select(quoted(guide).alias("__g"), text.alias("__t"), quoted(score).alias("__s"))
    order = Window.partitionBy("__g").orderBy(F.desc_nulls_last("__s"), "__t")
    best = rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= cap)
    lists = best.groupBy("__g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__t"))), lambda x: x["__t"]), "|").alias("__l"))
    counts = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("off_targets"))
    out = counts.join(lists, "__g")
    shown = F.col("__l") if blank_above is None else F.when(F.col("off_targets") <= blank_above, F.col("__l")).otherwise("")
    return out.select(F.col("__g").alias(guide), "off_targets", shown.alias("list"))


def byte_offsets(lines: DataFrame, order: str, line: Column, header: int = 0, ranges: int = 1024) -> DataFrame:
    """Where each line starts in a file of all lines in order, after ``header`` bytes; line feeds count."""
    rows = lines.withColumn("__bytes", F.octet_length(line).cast("long") + 1)
    total = ranking.running_total(rows, order, "__bytes", "__to", ranges)
    return total.withColumn("offset", F.col("__to") - F.col("__bytes") + header).drop("__to", "__bytes")


def details(records: DataFrame, guides: DataFrame, totals: DataFrame, cap: int = 100, blank_above: int = 2000) -> DataFrame:
    """Lines of a details file: ``id``, ``guide_no`` (the order of lines), ``line`` (counts by distance, a tab, the list of off-targets).

    ``records`` are single off-targets (``guide_id``, ``chrom``, ``start``,
    ``strand``, ``mm``, ``cfd``), ``guides`` name them (``guide_id``, ``id``),
    ``totals`` hold ``id``, ``mismatch_counts``, ``off_target_count``,
    ``dropped``.  An off-target is written ``chrom:start`` and strand with its
    score in thousandths, best first.  Dropped guides and those without
    off-targets have no line; a cap or a bound of 0 or less is none.
    """
    text = F.concat(F.concat_ws(":", "chrom", F.col("start").cast("string")), F.lit(";"), F.col("strand"), F.lit(";"), F.rint(F.col("cfd") * 1000).cast("int").cast("string"))
    lists = off_target_lists(records.where("guide_id is not null"), "guide_id", text, "cfd", cap if cap > 0 else 2**31 - 1, blank_above if blank_above > 0 else None)
    own = totals.where("coalesce(dropped, 0) = 0 and off_target_count > 0").select("id", F.coalesce("mismatch_counts", F.lit("")).alias("__c"))
    rows = guides.select("guide_id", "id").join(own, "id").join(lists, "guide_id", "left")
    return rows.select("id", F.col("guide_id").alias("guide_no"), F.concat(F.col("__c"), F.lit("\t"), F.coalesce("list", F.lit(""))).alias("line"))


DETAILS_HEADER = "_mismatchCounts\t_offtargets"


def with_offsets(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Track rows with ``offset``, where their line begins in the details file; 0 for those that have none."""
    at = byte_offsets(lines, "guide_no", F.col("line"), len(DETAILS_HEADER) + 1).select(F.col("id").alias("__id"), "offset")
    return rows.join(at, F.col("name") == F.col("__id"), "left").drop("__id").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))


def build(guides: DataFrame, totals: DataFrame, efficiency: str, specificity: str) -> DataFrame:
    """Track rows of guides (``id``, ``chrom``, ``start``, ``strand``, scores) with per-guide totals (``id``, ``mismatch_counts``, ``dropped``).

    The score column is the specificity in percent, within 0 to 1000.
    """
    own = totals.select(F.col("id").alias("__id"), "mismatch_counts", "dropped")
    rows = ranking.percent_rank(guides, [efficiency]).join(own, F.col("id") == F.col("__id"), "left").drop("__id")
    a, b = geometry(F.col("start"), F.col("strand"))
    mm = sq.mismatch_counts(F.col("mismatch_counts"))
    percent = quoted(specificity) * 100
    colour = sq.track_colour(F.coalesce(F.col("dropped") == 1, F.lit(False)), F.coalesce(mm[0], F.lit(0)), F.coalesce(mm[1], F.lit(0)), F.coalesce(mm[2], F.lit(0)), percent, quoted(f"{efficiency}_pct"))
    score = F.least(F.lit(1000), F.greatest(F.lit(0), F.coalesce(F.rint(percent), F.lit(0.0)))).cast("int")
    return rows.select("chrom", a.alias("chromStart"), b.alias("chromEnd"), F.col("id").alias("name"), score.alias("score"), "strand", a.alias("thickStart"), b.alias("thickEnd"), colour.alias("itemRgb"), sq.percent_and_raw(quoted(f"{efficiency}_pct"), quoted(efficiency)).alias("shown"))
