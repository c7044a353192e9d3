"""``python -m seqloom COMMAND``: the steps of :mod:`seqloom.pipeline` from files to files."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom import __version__, pipeline
from seqloom.common import ship
from seqloom.operators import motif, ranking, track
from seqloom.sinks import writers
from seqloom.sources import readers


def _enzyme(a: argparse.Namespace) -> motif.Enzyme:
    return motif.Enzyme(a.pam, a.length, a.five_prime)


def _regions(spark: SparkSession, paths: list[str], feature: str):
    out = []
    for p in paths:
        if p.removesuffix(".gz").endswith((".gtf", ".gff", ".gff2", ".gff3")):
            out.append(readers.gtf(spark, p, feature).select("chrom", (F.col("start") - 1).alias("start"), "end"))
        elif p.removesuffix(".gz").endswith(".bed"):
            out.append(readers.bed(spark, p).select("chrom", "start", "end"))
        else:
            raise SystemExit(f"{p} is neither a BED nor a GTF or GFF file")
    return out


def _pairs(items: list[str]) -> dict[str, str]:
    """``NAME=VALUE`` arguments as a dictionary."""
    if bad := [x for x in items if "=" not in x]:
        raise SystemExit(f"not of the form NAME=VALUE: {', '.join(bad)}")
    return dict(x.split("=", 1) for x in items)


def _numbers(items: list[str]) -> dict[str, float]:
    return {k: float(v) for k, v in _pairs(items).items()}


def _search(c: argparse.ArgumentParser) -> None:
    """Arguments of a search in an index."""
    c.add_argument("--index", required=True)
    c.add_argument("--length", type=int, default=20)
    c.add_argument("--mismatches", type=int, default=3)
    c.add_argument("--matrix", required=True)
    c.add_argument("--no-pam-weight", action="store_true")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="seqloom")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *inputs: str):
        c = commands.add_parser(name)
        for i in inputs:
            c.add_argument(i)
        c.add_argument("-o", "--output", required=True)
        return c

    for name, context in (("generate-guides", True), ("index-genome", False)):
        c = command(name, "fasta")
        c.add_argument("--pam", default="NGG")
        c.add_argument("--length", type=int, default=20)
        c.add_argument("--five-prime", action="store_true")
        c.add_argument("--feature", default="exon" if context else "transcript")
        if context:
            c.add_argument("--context", type=int, nargs=2, default=(4, 6))
            c.add_argument("--cut", type=int, nargs=2, default=(-4, -4))
            c.add_argument("--keep", nargs="*", default=[])
            c.add_argument("--discard", nargs="*", default=[])
            c.add_argument("--join", choices=("intersect", "merge"), default="intersect")
            c.add_argument("--gc", type=float, nargs=2, default=(0, 100))
            c.add_argument("--no-poly-t", action="store_true")
            c.add_argument("--no-poly-g", action="store_true")
            c.add_argument("--restricted", nargs="*", default=[])
            c.add_argument("--flanks", nargs=2, default=("", ""))
            c.add_argument("--alternative-pams", nargs="*", default=[])
            c.add_argument("--active-site", action="store_true")
            c.add_argument("--least-contig", type=int, default=20)
        else:
            c.add_argument("--regions", nargs="*", default=[])
            c.add_argument("--window", type=int, nargs=2, default=(20, 20))
    c = command("preprocess-annotation", "gtf")
    c.add_argument("--quantified", nargs="*", default=[])
    c.add_argument("--type", default="infer", choices=("infer", *readers.QUANTIFIERS))
    c.add_argument("--top-n", type=int, default=-1)
    c.add_argument("--by", default="median", choices=("min", "max", "mean", "median"))
    c.add_argument("--least", nargs="*", default=[], help="STATISTIC=VALUE, to be exceeded")
    c.add_argument("--tx2gene")
    c.add_argument("--model", choices=("consensus", "metagene", "longest", "shortest"))
    c.add_argument("--tss", type=int, nargs=2)
    c.add_argument("--tes", type=int, nargs=2)
    c = command("score-guides", "guides")
    _search(c)
    c.add_argument("--threshold", type=int, default=2)
    c.add_argument("--keep-duplicates", action="store_true")
    c.add_argument("--name", default="index")
    c.add_argument("--models", nargs="*", default=[], help="COLUMN=SCORER:WEIGHTS")
    c.add_argument("--least", nargs="*", default=[], help="COLUMN=VALUE, to be exceeded")
    c.add_argument("--hits", choices=("csv", "tsv", "both"))
    c = command("track", "guides")
    _search(c)
    c.add_argument("--efficiency", required=True)
    c.add_argument("--cap", type=int, default=100)
    c.add_argument("--blank-above", type=int, default=2000)
    c = command("rank-guides", "guides", "targets")
    c.add_argument("--columns", nargs="*", default=[])
    c.add_argument("--weights", type=float, nargs="*", default=[])
    c.add_argument("--least", nargs="*", default=[], help="COLUMN=VALUE")
    c.add_argument("--spacing", type=int, default=0)
    c.add_argument("-n", "--top-n", type=int, default=-1)
    c.add_argument("--no-normalise", action="store_true")
    c.add_argument("--feature", help="targets are an annotation, of which this feature counts")
    c.add_argument("--percentiles", type=float, nargs=2, default=(0, 100))
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    ship(spark)
    if a.command == "generate-guides":
        found = pipeline.generate_guides(readers.fasta_chunks(spark, a.fasta), _enzyme(a), tuple(a.context), tuple(a.cut), _regions(spark, a.keep, a.feature), _regions(spark, a.discard, a.feature), a.join, tuple(a.gc), a.no_poly_t, a.no_poly_g, a.restricted, tuple(a.flanks), least_contig=a.least_contig, pams=a.alternative_pams, active_site=a.active_site)
        found.write.mode("overwrite").parquet(f"{a.output}/guides")
        writers.guide_bed(found, f"{a.output}/bed")
    elif a.command == "index-genome":
        regions = _regions(spark, a.regions, a.feature)
        sites, places = pipeline.index_genome(readers.fasta_chunks(spark, a.fasta), _enzyme(a), regions[0] if regions else None, tuple(a.window))
        writers.index(sites, a.output, enzyme=_enzyme(a))
        places.write.mode("overwrite").parquet(f"{a.output}/places")
    elif a.command == "preprocess-annotation":
        if not a.quantified and (a.least or a.top_n >= 0 or a.tx2gene):
            warnings.warn("without --quantified, --least, --top-n and --tx2gene do nothing", stacklevel=2)
        quantified = readers.quantification(spark, a.quantified, a.type) if a.quantified else None
        genes = readers.tx_to_gene(spark, a.tx2gene) if a.tx2gene else None
        for name, df in pipeline.preprocess_annotation(readers.gtf(spark, a.gtf).drop("pairs"), quantified, _numbers(a.least), a.top_n, f"tscript_{a.by}", a.model, a.tss and tuple(a.tss), a.tes and tuple(a.tes), genes).items():
            writers.tsv(df, f"{a.output}/{name}")
    elif a.command == "score-guides":
        matrix = readers.penalty_matrix(spark, a.matrix)
        models_ = {k: tuple(v.split(":", 1)) for k, v in _pairs(a.models).items()}
        scored = pipeline.score_guides(spark.read.parquet(a.guides), readers.index(spark, a.index), a.length, a.mismatches, a.threshold, matrix, models_, _numbers(a.least), not a.keep_duplicates, a.name, not a.no_pam_weight)
        scored.write.mode("overwrite").parquet(a.output)
        if a.hits:
            named = pipeline.numbered(spark.read.parquet(a.output))
            writers.sidecar(named.select("guide_id", "id", F.col("contig").alias("chrom"), "position", F.col("sense").alias("strand"), F.col("guide").alias("sequence"), "on_count"), f"{a.output}.sidecar")
            found = pipeline.off_targets(named, readers.index(spark, a.index), spark.read.parquet(f"{a.index}/places"), matrix, a.length, a.mismatches, not a.no_pam_weight)
            writers.hits(found, f"{a.output}.hits", a.hits)
    elif a.command == "track":
        guides = pipeline.numbered(spark.read.parquet(a.guides))
        rows, lines = pipeline.make_track(guides, readers.index(spark, a.index), spark.read.parquet(f"{a.index}/places"), readers.penalty_matrix(spark, a.matrix), a.efficiency, a.length, a.mismatches, not a.no_pam_weight, a.cap, a.blank_above)
        writers.track(rows, a.output)
        writers.details(lines, f"{a.output}/details", track.DETAILS_HEADER)
    else:
        weights = dict(zip(a.columns, a.weights or [1.0] * len(a.columns)))
        targets = readers.gtf(spark, a.targets).drop("pairs") if a.feature else readers.bed(spark, a.targets).withColumnRenamed("name", "target_id")
        pipeline.rank_guides(spark.read.parquet(a.guides), targets, _numbers(a.least), weights, not a.no_normalise, a.spacing, a.top_n, tuple(a.percentiles), a.feature).write.mode("overwrite").parquet(a.output)
        ranked = spark.read.parquet(a.output)
        wanted = targets.where(F.col("feature") == a.feature).select(F.col("gene_id").alias("target_id")) if a.feature else targets
        writers.targets_without(ranking.without(wanted, ranked, "target_id"), f"{a.output}.without")
        writers.tsv(ranking.counts_with_zero(ranked, wanted, "target_id"), f"{a.output}.counts")


if __name__ == "__main__":
    main()
