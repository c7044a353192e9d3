"""Writers of guide, score, track, annotation and off-target files; one directory of parts each, unless one file is asked for."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import quoted
from seqloom.functions import sequence as sq
from seqloom.operators import annotation, motif


def _parts(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1) if single else df


def tsv(df: DataFrame, path: str, header: bool = True, null: str = "", compression: str = "none", single: bool = False) -> None:
    _parts(df, single).write.mode("overwrite").csv(path, sep="\t", header=header, nullValue=null, emptyValue="", quote="", compression=compression)


def output_path(folder: str, name: str, extension: str, strip: Sequence[str] = (".gz",)) -> str:
    """``folder/stem_extension/stem_extension`` for an input's name."""
    stem = os.path.basename(name)
    for s in strip:
        stem = stem.removesuffix(s)
    stem = f"{os.path.splitext(stem)[0]}_{extension}"
    return f"{folder}/{stem}/{stem}"


def guide_bed(guides: DataFrame, path: str, single: bool = False) -> None:
    """Guides with their composite id, context and strand."""
    rows = guides.select(F.col("contig").alias("#chr"), "start", "stop", motif.packed_id(guides).alias("id,sequence,pam,chromosome,position,sense"), "context", F.col("sense").alias("strand"))
    tsv(rows, path, single=single)


def scored_bed(df: DataFrame, path: str, columns: Sequence[str], single: bool = False) -> None:
    """Scored guides in a fixed order of columns, then the specificity columns; nulls are -1."""
    order = [*columns, *(c for c in df.columns if c.startswith("specificity") and c not in columns)]
    tsv(df.select(*(quoted(c) for c in order)), path, null="-1", single=single)


def ranked_bed(df: DataFrame, path: str, single: bool = False) -> None:
    tsv(df.drop("context"), path, null="-1", single=single)


def stages(frames: dict[str, DataFrame], folder: str) -> None:
    """Every stage's rows in a folder of their own."""
    for name, df in frames.items():
        tsv(df, f"{folder}/{name}")


def gtf(df: DataFrame, path: str, source: str, single: bool = False) -> None:
    _parts(df.select(annotation.gtf_line(source).alias("value")), single).write.mode("overwrite").text(path)


def windows_bed(df: DataFrame, path: str, single: bool = False) -> None:
    """Start or end windows as six-column BED."""
    tsv(df.select("chrom", "start", "end", F.concat_ws(",", "transcript_id", "gene_id"), F.lit("0"), "strand"), path, header=False, single=single)


def off_target_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """One row per hit, the specificity to six digits."""
    rows = df.select("id", "sequence", "match_chrm", "match_position", "match_strand", "match_distance", F.format_string("%.6f", F.col("specificity")).alias("specificity"))
    _parts(rows, single).write.mode("overwrite").csv(path, header=True)


def off_target_tsv(df: DataFrame, path: str, scores: Sequence[str] = ()) -> None:
    """One row per guide with its off-targets as ``SEQ_count_mm``, in order of place; missing scores are NA."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mm", "site", "loci"))), lambda x: F.concat_ws("_", x["site"], x["loci"].cast("string"), x["mm"].cast("string"))), ",")
    keys = ["contig", "start", "strand", "guide"]
    rows = df.groupBy(*keys, *(quoted(s) for s in scores)).agg(items.alias("offTargets")).orderBy("contig", "start", "strand")
    tsv(rows, path, null="NA")


#: Columns of specificity in aggregate files: of Cas9, of Cas12a by motif, and of Cas12a by two matrices.
SPECIFICITIES = {"cas9": ["specificity"], "cas12a": ["specificity_tttn", "specificity_tttv"], "dual": ["specificity_tttn", "specificity_tttv", "specificity_tttn_2xnls", "specificity_tttv_2xnls"]}


def aggregate_csv(df: DataFrame, path: str, dropped: DataFrame | None = None, kind: str = "cas9") -> None:
    """Per-guide totals with the specificity columns of a ``kind``; dropped guides follow with blanks and ``dropped`` 1."""
    counts = F.array_join(F.col("mm_counts"), ";")
    rows = df.select("id", *SPECIFICITIES[kind], "max_cfd", F.col("off_count").alias("off_target_count"), counts.alias("mismatch_counts"), F.col("saturated").cast("int").alias("saturated"), F.lit(0).alias("dropped"))
    if dropped is not None:
        blank = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("id", "dropped")]
        rows = rows.unionByName(dropped.select("id", *blank, F.lit(1).alias("dropped")))
    rows.write.mode("overwrite").csv(path, header=True)


def hits(df: DataFrame, path: str, form: str = "csv", scores: Sequence[str] = ()) -> None:
    """Off-targets of guides as ``csv`` (a row per place), ``tsv`` (a row per guide), or ``both``: the lists then lie in ``path`` + ``.detail``."""
    if form not in ("csv", "tsv", "both"):
        raise ValueError("hits are written as csv, tsv or both")
    if form in ("csv", "both"):
        off_target_csv(df, path)
    if form in ("tsv", "both"):
        off_target_tsv(df.groupBy("contig", "start", "strand", "guide", "site", "mm", *scores).agg(F.count(F.lit(1)).alias("loci")), path + (".detail" if form == "both" else ""), scores)


def targets_without(df: DataFrame, path: str) -> None:
    """Targets that have no guide, one a line."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def records(df: DataFrame, path: str, text: bool = False) -> None:
    """Single off-targets, as Parquet sorted inside guides, or as text."""
    rows = df.repartition("guide_id").sortWithinPartitions("guide_id", F.desc("cfd"))
    if text:
        tsv(rows, path)
    else:
        rows.write.mode("overwrite").parquet(path)


def sidecar(df: DataFrame, path: str) -> None:
    tsv(df.select("guide_id", "id", "chrom", "position", "strand", "sequence", "on_count"), path)


def index(sites: DataFrame, path: str, width: int = 4, enzyme: motif.Enzyme | None = None) -> None:
    """Different sites with their counts, stored by their first bases so that a reader can prune."""
    keyed = sites.withColumn("bin_key", sq.bin_key(F.col("site"), width))
    keyed.repartition("bin_key").sortWithinPartitions("bin_key", "packed").write.mode("overwrite").parquet(f"{path}/sites")
    spark = sites.sparkSession
    spark.createDataFrame([(1, width, enzyme.pam if enzyme else None, enzyme.length if enzyme else None)], "version int, width int, pam string, length int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def details(lines: DataFrame, path: str, header: str) -> None:
    """Lines of a details file in order, in one file, as the offsets in a track count from its beginning."""
    spark = lines.sparkSession
    rows = spark.createDataFrame([(-1, header)], "guide_no long, line string").unionByName(lines.select(F.col("guide_no").cast("long").alias("guide_no"), "line"))
    rows.orderBy("guide_no").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def track(rows: DataFrame, path: str) -> None:
    """Track rows in order of place, with a description of the columns beside them."""
    tsv(rows.orderBy("chrom", "chromStart"), f"{path}/bed", header=False)
    kinds = {"string": "string", "int": "int", "bigint": "bigint", "double": "float"}
    lines = ['table guides "Guides"', "(", *(f'{kinds.get(t, "string")} {c}; "{c}"' for c, t in rows.dtypes), ")"]
    rows.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/columns")


def slim(df: DataFrame, path: str, keep: Sequence[str], compress: bool = True) -> None:
    """The columns of ``keep`` that are there."""
    tsv(df.select(*(quoted(c) for c in keep if c in df.columns)), path, compression="gzip" if compress else "none")


def guide_fasta(guides: DataFrame, path: str, sequence: str = "context", by_contig: bool = False, most_rows: int = 0) -> None:
    """Guides as FASTA, bases 5 to 31 of their context; a folder per contig, or files of at most ``most_rows`` guides, if asked for."""
    rows = guides.select(F.concat(F.lit(">"), motif.packed_id(guides), F.lit("\n"), F.substring(sequence, 5, 27)).alias("value"), "contig")
    (rows.write.partitionBy("contig") if by_contig else rows.select("value").write).option("maxRecordsPerFile", most_rows).mode("overwrite").text(path)
