"""Readers of sequence, annotation, region, expression and off-target files; compressed files are read as they are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import quoted
from seqloom.functions import sequence as sq
from seqloom.operators import intervals

GTF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
BED = "chrom string, start long, end long, name string"
#: Formats by the beginning of a quantification table's header: the id column, and the value column or None for one column per sample.
QUANTIFIERS = {"kallisto": ("target_id\tlength\teff_length\test_counts\ttpm", "target_id", "tpm", "TPM"), "salmon": ("Name\tLength\tEffectiveLength\tTPM\tNumReads", "Name", "TPM", "TPM"), "flair": ("ids\t", "ids", None, "COUNTS"), "mandalorian": ("Isoform\t", "Isoform", None, "TPM")}


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``contig`` (first word of the header) and ``sequence`` in upper case, without white space, whatever its letters.

    Records are split in the JVM where a line begins with ``>``; what stands
    before the first one is ignored.  A contig is one row here; genomes are
    read by :func:`fasta_chunks`.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.length("value") > 0).withColumn("__file", F.col("_metadata.file_path"))
    # of a file that doesn't begin with a header the first record is what stands before it
    proper = rows.where(F.startswith("value", F.lit(">"))).select("__file").distinct()
    odd = rows.join(proper, "__file", "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy(F.monotonically_increasing_id())))
    kept = rows.join(proper, "__file", "left_semi").select("value").unionAll(odd.where("__n > 1").select("value"))
    body = F.when(F.startswith("value", F.lit(">")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    name = F.regexp_extract(body, r"^[ \t]*(\S*)", 1)
    sequence = F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*(\n|$)", ""), r"\s+", ""))
    return kept.select(name.alias("contig"), sequence.alias("sequence"))


#: Bases per chunk of a genome, and to either side of it.
CHUNK, OVERLAP = 1 << 18, 100
_PIECES = "file string, block long, no int, contig string, text string"


def _assembled(size: int):
    """Puts lines together: pieces of ``size`` bases of one contig and one split of a file, ``contig`` named in the first piece after its header."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: tuple[str, int] | None = None
        no, name, opened = 0, None, False  # name: of a header whose first piece is not out yet
        text = bytearray()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["file", "block", "no", "contig", "text"])

        def taken(last: bool) -> list[tuple]:
            """Full pieces of what was read, and the rest too if a contig or a split ends."""
            nonlocal no, name, opened
            rows, at = [], 0
            while len(text) - at >= size or (last and (len(text) > at or (opened and not rows))):
                rows.append((split[0], split[1], no, name, text[at : at + size].decode("ascii", "replace")))
                no, name, opened, at = no + 1, None, False, at + size
            del text[:at]
            return rows

        for batch in batches:
            rows: list[tuple] = []
            blocks, files = batch.column(2).to_numpy(zero_copy_only=False), batch.column(1).dictionary_encode()
            files_at, names = files.indices.to_numpy(zero_copy_only=False), files.dictionary.to_pylist()
            lines = pa.concat_arrays([batch.column(0).cast(pa.large_string()).cast(pa.large_binary())])
            offsets = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1)
            data = np.frombuffer(lines.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
            first = np.zeros(len(lines), np.uint8)
            full = offsets[1:] > offsets[:-1]
            first[full] = data[offsets[:-1][full]]
            changed = np.ones(len(lines), bool)
            changed[1:] = (blocks[1:] != blocks[:-1]) | (files_at[1:] != files_at[:-1])
            stops = np.flatnonzero(changed | (first == ord(">")))
            for i, to in zip(stops, np.append(stops[1:], len(lines))):
                here = (names[files_at[i]], int(blocks[i]))
                if here != split:
                    rows += taken(True) if split else []
                    split, no = here, 0
                body = i
                if first[i] == ord(">"):
                    rows += taken(True)
                    header = lines[i].as_py()[1:].decode("utf-8", "replace").split()
                    name, opened, body = (header or [""])[0], True, i + 1
                text += data[offsets[body] : offsets[to]].tobytes().translate(None, b" \t\r\n\f\v").upper()
                rows += taken(False)
            if rows:
                yield out(rows)
        if split and (rows := taken(True)):
            yield out(rows)

    return pieces


def fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """FASTA files in chunks: ``contig``, ``chunk_no``, ``chunk_start`` (0-based), ``core`` bases, ``seq_start`` and ``seq``, which reaches ``overlap`` bases to either side of the core.

    Lines are read by the splittable text source of any file system Spark knows
    (packed files as well, which are one split each), so tasks share a contig
    of any length and none holds more than a chunk.  Each task joins the lines
    of its split to pieces of at most ``size`` bases; the places of pieces, and
    what they need of their neighbours, come from a window over a table without
    the bases.  Names and letters as in :func:`fasta`; an empty contig gives
    one chunk without bases.  A piece ends where a split ends, so cores differ in length.
    ``overlap`` must not exceed ``size``, nor a split of a file.
    """
    if overlap > size:
        raise ValueError("an overlap can't be longer than a chunk")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    pieces = lines.mapInArrow(_assembled(size), _PIECES)
    order = Window.partitionBy("file").orderBy("block", "no")
    at = pieces.select("file", "block", "no", "contig", F.length("text").cast("long").alias("n"), F.left("text", F.lit(overlap)).alias("head"), F.right("text", F.lit(overlap)).alias("tail"))
    at = at.withColumns({"g": F.count("contig").over(order), "contig": F.last("contig", ignorenulls=True).over(order)}).where(F.col("g") > 0)
    own = Window.partitionBy("file", "g").orderBy("block", "no")
    near = lambda c, k: F.coalesce(F.lag(c, k).over(own), F.lit(""))
    at = at.select(
        "file", "block", "no", F.col("contig").alias("name"), (F.row_number().over(own) - 1).alias("chunk_no"), F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("chunk_start"),
        F.right(F.concat(near("tail", 2), near("tail", 1)), F.lit(overlap)).alias("before"), F.left(F.concat(near("head", -1), near("head", -2)), F.lit(overlap)).alias("after"),
    )
    placed = pieces.drop("contig").join(at, ["file", "block", "no"])
    return placed.select(F.col("name").alias("contig"), "chunk_no", "chunk_start", F.length("text").alias("core"), (F.col("chunk_start") - F.length("before")).alias("seq_start"), F.concat("before", "text", "after").alias("seq"))


def slices(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """Sequences of regions (``chrom``, ``start``, ``end``) out of chunks, named ``chrom_start:end``; ends beyond a contig are clipped, unknown contigs give nothing.

    Each chunk adds the part of its core that lies in a region; a region's
    parts, which are as long as the region, are put together in order.
    """
    cores = chunks.select(F.col("contig").alias("chrom"), F.col("chunk_start").alias("start"), (F.col("chunk_start") + F.col("core")).alias("end"), "seq_start", "seq")
    pairs = intervals.range_join(regions.where("start < end").select("chrom", "start", "end"), cores, tile=1 << 20)
    a, b = F.greatest("start", "r_start"), F.least("end", "r_end")
    parts = pairs.select("chrom", "start", "end", a.alias("__a"), b.alias("__b"), F.substring(F.col("r_seq"), (a - F.col("r_seq_start") + 1).cast("int"), (b - a).cast("int")).alias("__t")).distinct()
    joined = parts.groupBy("chrom", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__a", "__t"))), lambda x: x["__t"]), "").alias("sequence"), F.max("__b").alias("stop"))
    return joined.select(F.concat("chrom", F.lit("_"), F.col("start").cast("string"), F.lit(":"), F.col("stop").cast("string")).alias("name"), "chrom", "start", F.col("stop").alias("end"), "sequence")


def stranded(chunks: DataFrame, places: DataFrame, length: int = 27) -> DataFrame:
    """``places`` (``chrom``, ``start``, ``strand``) with the ``length`` bases from there, as their strand reads them; null where they leave the contig."""
    regions = places.select("chrom", "start", (F.col("start") + length).alias("end")).where("start >= 0").distinct()
    found = slices(chunks, regions).where(F.length("sequence") == length).select(F.col("chrom").alias("__c"), F.col("start").alias("__s"), "sequence")
    text = F.when(F.col("strand") == "-", sq.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence"))
    return places.join(found, (F.col("chrom") == F.col("__c")) & (F.col("start") == F.col("__s")), "left").withColumn("sequence", text).drop("__c", "__s")


def gtf(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """Annotation rows with ``gene_id``, ``transcript_id`` and all attributes as a map; comments are skipped."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema=GTF)
    rows = rows if feature is None else rows.where(F.col("feature") == feature)
    return rows.withColumns({"gene_id": sq.attribute(F.col("attributes"), "gene_id"), "transcript_id": sq.attribute(F.col("attributes"), "transcript_id"), "pairs": attributes(F.col("attributes"))})


def attributes(text: Column) -> Column:
    """Map of a GTF or GFF attribute column; of a repeated key the last value."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pair = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^([^\s=]+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"^[^\s=]+[\s=]+(.*)$", 1), '^"|"$', "").alias("v")))
    last = F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def annotation_format(spark: SparkSession, path: str, lines: int = 100) -> str:
    """``gff`` or ``gtf`` by the attributes of the first lines; an error if they look like neither."""
    head = spark.read.csv(path, sep="\t", comment="#", quote="", schema=GTF).select("attributes").limit(lines)
    found = head.agg(F.count_if(F.contains("attributes", F.lit("="))).alias("e"), F.count_if(F.contains("attributes", F.lit('gene_id "'))).alias("g")).first()
    if found["g"] and not found["e"]:
        return "gtf"
    if found["e"] and not found["g"]:
        return "gff"
    raise ValueError(f"{path} is neither GTF nor GFF")


def gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 rows with gene and transcript ids of their parents."""
    from seqloom.operators import annotation

    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema=GTF)
    return annotation.propagate_ids(rows.withColumns({"id": sq.attribute(F.col("attributes"), "ID"), "parent": sq.attribute(F.col("attributes"), "Parent")}))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions with an id: the name where all are there and differ, else ``chrom_start_end``; rows with start >= end are an error."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=BED).where("chrom is not null and chrom not like 'track%' and chrom not like 'browser%'")
    check = rows.agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.countDistinct("name").alias("names"), F.count_if(F.coalesce(F.col("start") >= F.col("end"), F.lit(True))).alias("bad")).first()
    if check["bad"]:
        raise ValueError(f"{check['bad']} rows of {path} have no valid range")
    own = F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    return rows.withColumn("name", F.col("name") if check["n"] == check["named"] == check["names"] else own)


def quantifier(spark: SparkSession, path: str) -> str:
    header = spark.read.text(path).first()
    for name, (start, *_) in QUANTIFIERS.items():
        if header and header[0].startswith(start):
            return name
    raise ValueError(f"the table {path} is of no known quantifier")


def quantification(spark: SparkSession, paths: Sequence[str], kind: str = "infer") -> DataFrame:
    """Tables of one kind side by side: ``transcript_id`` and a column per sample, a row for every transcript of any."""
    from seqloom.operators import expression

    frames = []
    for path in paths:
        tool = quantifier(spark, path) if kind == "infer" else kind
        _, key, value, prefix = QUANTIFIERS[tool]
        rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
        names = [value] if value else [c for c in rows.columns if c != key and not c.startswith("_c") and c.strip()]
        label = lambda c: f"{prefix}_{path if value else c}"  # noqa: E731, B023
        key_of = expression.isoform_id(quoted(key)) if tool in ("flair",) else quoted(key)
        frames.append(rows.select(key_of.alias("transcript_id"), *(quoted(c).try_cast("double").alias(label(c)) for c in names)))
    return expression.outer_join(frames, "transcript_id")


def tx_to_gene(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="transcript_id string, gene_id string")


def kmers(spark: SparkSession, path: str, length: int, pam: int) -> DataFrame:
    """Guides of a six-column CSV; wrong lengths or senses are an error where rows are read, as is a file without rows."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", schema="id string, sequence string, pam string, chromosome string, position long, sense string")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no guides")
    ok = (F.length("sequence") == length) & (F.length("pam") == pam) & F.col("sense").isin("+", "-")
    checked = rows.where(F.assert_true(ok, F.concat(F.lit("bad guide "), F.coalesce("id", F.lit("")))).isNull())
    return checked.withColumn("pam", F.regexp_replace(F.upper("pam"), "[^ACGT]", "A"))


def penalty_matrix(spark: SparkSession, path: str, complement: bool = False, length: int = 23) -> dict[tuple[int, str, str], float]:
    """Factors of a CSV with Pos, MM (``rX:dY``) and avg_percent_active, as (position, guide base, off-target base) -> factor.

    A matrix has at most 16 entries per position, so it comes to the driver.
    """
    rows = spark.read.csv(path, header=True, inferSchema=False)
    if not {"Pos", "MM", "avg_percent_active"} <= set(rows.columns):
        raise ValueError(f"{path} has no columns Pos, MM and avg_percent_active")
    out = {}
    most = 16 * length
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{path} has more than {most} rows")
    for r in found:
        p = int(r["Pos"])
        if not 1 <= p <= length:
            raise ValueError(f"position {p} is not within 1 to {length}")
        g, o = sq.pair_key(r["MM"], complement)
        out[p, g, o] = float(r["avg_percent_active"])
    return out


def flashfry(spark: SparkSession, path: str) -> DataFrame:
    """Off-target tables with forward guides at start 0, stop 24."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    need = {"contig", "start", "stop", "target", "orientation", "otCount", "offTargets"}
    if missing := need - set(rows.columns):
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    rows = rows.withColumns({"start": F.col("start").try_cast("int"), "stop": F.col("stop").try_cast("int"), "otCount": F.col("otCount").try_cast("int")})
    return rows.where("orientation = 'FWD' and start = 0 and stop = 24")


def signal(spark: SparkSession, path: str) -> DataFrame:
    """A signal as bedGraph text."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, value double").where("start is not null and start < end")


def snps(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Changed bases (``chrom``, ``pos`` from 1, ``base``); of several files the later one holds."""
    parts = [spark.read.csv(p, sep="\t", schema="chrom string, pos long, base string").withColumn("__f", F.lit(i)) for i, p in enumerate(paths)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.where("pos is not null").groupBy("chrom", "pos").agg(F.max(F.struct("__f", "base")).alias("__b")).select("chrom", "pos", F.upper("__b.base").alias("base"))


def with_snps(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks with changed bases in place; a chunk's changes, at most one a base, are gathered with it."""
    spans = chunks.select(F.col("contig").alias("chrom"), "chunk_no", F.col("seq_start").alias("start"), (F.col("seq_start") + F.length("seq")).alias("end"))
    points = changes.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "base")
    hits = intervals.range_join(spans, points, tile=1 << 20).groupBy(F.col("chrom").alias("__c"), F.col("chunk_no").alias("__n"), F.col("start").alias("__s")).agg(F.collect_list(F.struct((F.col("r_start") - F.col("start") + 1).cast("int").alias("pos"), F.col("r_base").alias("base"))).alias("__x"))
    out = chunks.join(hits, (F.col("contig") == F.col("__c")) & (F.col("chunk_no") == F.col("__n")), "left")
    return out.withColumn("seq", F.when(F.col("__x").isNull(), F.col("seq")).otherwise(sq.replace_bases(F.col("seq"), F.col("__x")))).drop("__c", "__n", "__s", "__x")


def orf_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def index(spark: SparkSession, path: str) -> DataFrame:
    """An index written by :func:`seqloom.sinks.writers.index`, after its version is checked."""
    meta = spark.read.json(f"{path}/meta").first()
    if meta is None or meta["version"] != 1:
        raise ValueError(f"{path} is no index of this version")
    return spark.read.parquet(f"{path}/sites")


def contigs(df: DataFrame, column: str = "chrom") -> DataFrame:
    return df.select(column).distinct()
