"""The five steps of a guide design, each from DataFrames to a DataFrame; files are read and written at the edge only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import quoted
from seqloom.functions import models
from seqloom.functions import sequence as sq
from seqloom.operators import annotation, expression, intervals, motif, offtarget, ranking, track


def generate_guides(
    contigs: DataFrame, enzyme: motif.Enzyme = motif.PRESETS["spcas9-ngg"], context: tuple[int, int] = (4, 6), cut: tuple[int, int] = (-4, -4), keep: Sequence[DataFrame] = (), discard: Sequence[DataFrame] = (), how: str = "intersect",
    gc: tuple[float, float] = (0, 100), poly_t: bool = False, poly_g: bool = False, restricted: Sequence[str] = (), flanks: tuple[str, str] = ("", ""), least_contig: int = 20, pams: Sequence[str] = (), active_site: bool = False,
) -> DataFrame:
    """Guides of contigs whose cut site lies in the kept regions and in no discarded one.

    Contigs come whole (``contig``, ``sequence``) or in overlapping chunks
    (:func:`seqloom.sources.readers.fasta_chunks`).  Several region tables are
    intersected or merged (``how``).  ``pams`` are further motifs of the same
    length.  With ``active_site`` the range of a guide is its cut site, else
    its protospacer.
    """
    parts, text, placed = _chunked(contigs, least_contig)
    motifs = [enzyme, *(motif.Enzyme(p, enzyme.length, enzyme.five_prime) for p in pams if p != enzyme.pam)]
    rows = motif.guides(parts, "contig", text, motifs[0], context, cut, **placed)
    for m in motifs[1:]:
        rows = rows.unionAll(motif.guides(parts, "contig", text, m, context, cut, **placed))
    rows = (rows.distinct() if len(motifs) > 1 else rows).where(sq.keep_guide(F.col("guide"), gc, poly_t, poly_g, restricted, *flanks))
    sited = rows.withColumns({"chrom": F.col("contig"), "s0": F.col("start"), "e0": F.col("stop"), "start": F.col("cut_start"), "end": F.col("cut_stop")})
    if keep:
        regions = intervals.intersect_all(keep) if how == "intersect" else intervals.union(keep)
        sited = intervals.range_join(sited, regions, how="semi")
    for region in discard:
        sited = intervals.range_join(sited, region, how="anti")
    sited = sited.drop("start", "stop", "end", "chrom")
    return sited.withColumns({"start": F.col("cut_start"), "stop": F.col("cut_stop")}).drop("s0", "e0") if active_site else sited.withColumnsRenamed({"s0": "start", "e0": "stop"})


def _chunked(contigs: DataFrame, least: int = 0) -> tuple[DataFrame, str, dict]:
    """Whole contigs or chunks of them, of contigs with at least so many bases; the column of the bases, and what tells a scan of their places."""
    if "sequence" in contigs.columns:
        return contigs.where(F.length("sequence") >= least), "sequence", {}
    if least > 1:
        lengths = contigs.groupBy("contig").agg(F.sum("core").alias("__n")).where(F.col("__n") >= least)
        contigs = contigs.join(lengths, "contig", "left_semi")
    return contigs, "seq", motif.CHUNKED


def index_genome(contigs: DataFrame, enzyme: motif.Enzyme, regions: DataFrame | None = None, window: tuple[int, int] = (20, 20)) -> tuple[DataFrame, DataFrame]:
    """Different sites (guide sequence and motif beside it) and their places; with regions, only places that touch a widened region, in genome coordinates."""
    parts, text, placed = _chunked(contigs)
    found = motif.sites(parts, text, enzyme, ("contig",), **placed)
    found = found.withColumns({"spacer": motif.protospacer(F.col("site"), enzyme), "pam": motif.motif_of(F.col("site"), enzyme)})
    if regions is not None:
        wide = intervals.union([intervals.widen(regions, *window)])
        near = found.withColumns({"chrom": F.col("contig"), "start": F.col("offset"), "end": F.col("offset") + enzyme.site})
        found = intervals.range_join(near, wide, how="semi").drop("chrom", "start", "end")
    return offtarget.index(found.drop("site"), "spacer", pam="pam")


def preprocess_annotation(
    rows: DataFrame, quantified: DataFrame | None = None, least: Mapping[str, float] | None = None, top_n: int = -1, by: str = "tscript_median", model: str | None = None,
    tss: tuple[int, int] | None = None, tes: tuple[int, int] | None = None, genes: DataFrame | None = None, digits: int = 3,
) -> dict[str, DataFrame]:
    """Annotation of expressed transcripts, a gene model, and windows around starts and ends, each where asked for."""
    out: dict[str, DataFrame] = {}
    if quantified is not None:
        samples = [c for c in quantified.columns if c != "transcript_id"]
        stats = expression.row_statistics(quantified, samples, digits)
        cut = {"min": 0.0, "max": 0.0, "mean": 0.0, "median": 0.0} | dict(least or {})
        named = expression.with_genes(expression.expressed(stats, cut), annotation.tx_to_gene(rows) if genes is None else genes, "transcript_id")
        out["expression"] = expression.top_isoforms(named, top_n, by, "transcript_id")
        rows = rows.join(out["expression"].select("transcript_id"), "transcript_id", "left_semi").select(*rows.columns)
    out["annotation"] = rows
    models_ = {"consensus": annotation.consensus, "metagene": annotation.metagene, "longest": annotation.by_coding_length, "shortest": lambda r: annotation.by_coding_length(r, False)}
    if model:
        out["model"] = models_[model](rows)
    if tss:
        out["tss"] = annotation.end_windows(rows, *tss)
    if tes:
        out["tes"] = annotation.end_windows(rows, *tes, at="end")
    return out


def near_hits(guides: DataFrame, sites: DataFrame, matrix: Mapping[tuple[int, str, str], float], length: int = 20, most: int = 3, weigh_pam: bool = True) -> DataFrame:
    """Different guides (``__guide``) with their near sites: ``site``, ``pam``, ``loci``, ``mm`` and ``cfd``, the product of the matrix's factors and, with ``weigh_pam``, of the weight of the site's motif."""
    keys = guides.select(F.upper("guide").alias("__guide")).distinct()
    beside = ["pam"] if "pam" in sites.columns else []
    hits = offtarget.near_matches(keys, sites.select("site", *beside, "loci"), "__guide", "site", length, most)
    score = offtarget.pair_score(F.col("__guide"), F.col("site"), matrix, length)
    return hits.withColumn("cfd", score * offtarget.pam_weight(F.col("pam")) if weigh_pam else score)


def score_guides(
    guides: DataFrame, sites: DataFrame | None = None, length: int = 20, most: int = 3, threshold: int | None = 2, matrix: Mapping[tuple[int, str, str], float] | None = None, models_: Mapping[str, tuple[str, str]] | None = None,
    least: Mapping[str, float] | None = None, drop_duplicates: bool = True, name: str = "index", weigh_pam: bool = True,
) -> DataFrame:
    """Guides (``guide``, ``context``) with model scores and their specificity against an index.

    ``models_`` maps a score's name to (scorer, weights file); rows must lie
    above (>) every bound of ``least``.  Guides with near matches within
    ``threshold`` are left out before the full join.  A search needs the factor
    ``matrix``; ``weigh_pam`` multiplies by the weight of a site's motif, as
    Cas9 scores do, and needs an index that keeps it.
    """
    if sites is not None and not matrix:
        raise ValueError("a search for off-targets needs a matrix of factors")
    if sites is not None and weigh_pam and "pam" not in sites.columns:
        raise ValueError("this index has no motifs to weigh")
    if drop_duplicates:
        guides = ranking.unique_only(guides, ["guide"])
    for column, (scorer, weights) in (models_ or {}).items():
        take = models.SCORERS[scorer].length
        context = sq.context_31(F.col("context")) if take == 31 else F.left("context", F.lit(take))
        guides = guides.withColumn(column, models.score(context, scorer, weights))
        if least and column in least:
            guides = ranking.above(guides, {column: least[column]})
    if sites is None:
        return guides
    if threshold is not None and threshold >= 0:
        guides = offtarget.prescreen(guides, sites, "guide", "site", length, threshold)
    totals = offtarget.per_guide(near_hits(guides, sites, matrix, length, most, weigh_pam), ["__guide"], "cfd", most=most)
    totals = totals.withColumn(f"specificity_{name}", F.bround(offtarget.specificity(F.col("cfd_sum"), F.col("on_count")), 4))
    return guides.join(totals.select("__guide", f"specificity_{name}", "cfd_sum", "max_cfd", "on_count", "off_count", "mm_counts"), F.upper("guide") == F.col("__guide"), "left").drop("__guide")


def off_targets(guides: DataFrame, sites: DataFrame, places: DataFrame, matrix: Mapping[tuple[int, str, str], float], length: int = 20, most: int = 4, weigh_pam: bool = True) -> DataFrame:
    """Every place near a guide (``id``, ``guide`` and its place): a row per hit with what the writers of off-targets need.

    The search runs over different sequences; only sequences that were hit
    meet their places.
    """
    found = near_hits(guides, sites, matrix, length, most, weigh_pam)
    beside = [c for c in ("pam",) if c in sites.columns and c in places.columns]
    at = places.select("site", *beside, F.col("contig").alias("match_chrm"), F.col("offset").alias("match_position"), F.col("strand").alias("match_strand"))
    hits = found.drop("loci").join(at, ["site", *beside])
    own = guides.select(F.upper("guide").alias("__guide"), "id", F.col("guide").alias("sequence"), "guide", "contig", "start", F.col("sense").alias("strand"))
    totals = found.groupBy("__guide").agg(F.sum(F.when(F.col("mm") > 0, F.col("cfd") * F.col("loci")).otherwise(0.0)).alias("__s"), F.sum(F.when(F.col("mm") == 0, F.col("loci")).otherwise(0)).alias("__o"))
    rows = own.join(hits, "__guide").join(totals, "__guide")
    return rows.withColumns({"match_distance": F.col("mm"), "specificity": offtarget.specificity(F.col("__s"), F.col("__o"))}).drop("__guide", "__s", "__o")


def numbered(guides: DataFrame) -> DataFrame:
    """Guides with ``id``, their composite name, and ``guide_id``, their number in order of a hash of it: no order of the whole table is needed."""
    named = guides.withColumn("id", motif.packed_id(guides)).withColumn("__h", F.xxhash64("id").cast("double"))
    return ranking.running_total(named.withColumn("__one", F.lit(1)), "__h", "__one", "__to").withColumn("guide_id", F.col("__to") - 1).drop("__h", "__one", "__to")


def make_track(guides: DataFrame, sites: DataFrame, places: DataFrame, matrix: Mapping[tuple[int, str, str], float], efficiency: str, length: int = 23, most: int = 4, weigh_pam: bool = False, cap: int = 100, blank_above: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Track rows of guides (``guide_id``, ``id``, place, ``efficiency`` column), with where their line begins, and the lines of the details file.

    Repeated guides stay: a guide that occurs at several places is coloured as
    such, not left out.
    """
    hits = off_targets(guides, sites, places, matrix, length, most, weigh_pam).join(guides.select("guide_id", F.col("id").alias("__id")), F.col("id") == F.col("__id")).drop("__id")
    scored = hits.withColumn("loci", F.lit(1))
    totals = offtarget.per_guide(scored, ["id"], "cfd", most=most)
    totals = totals.select("id", offtarget.specificity(F.col("cfd_sum"), F.col("on_count")).alias("__spec"), F.array_join("mm_counts", ";").alias("mismatch_counts"), F.col("off_count").alias("off_target_count"), F.lit(0).alias("dropped"))
    rows = guides.select("id", F.col("contig").alias("chrom"), "start", F.col("sense").alias("strand"), quoted(efficiency).alias("__eff")).join(totals.select("id", "__spec"), "id", "left")
    lines = track.details(hits.where("mm > 0").select("guide_id", F.col("match_chrm").alias("chrom"), F.col("match_position").alias("start"), F.col("match_strand").alias("strand"), "mm", "cfd"), guides, totals, cap, blank_above)
    return track.with_offsets(track.build(rows, totals, "__eff", "__spec"), lines), lines


def rank_guides(
    guides: DataFrame, targets: DataFrame, least: Mapping[str, float] | None = None, weights: Mapping[str, float] | None = None, normalise: bool = True, spacing: int = 0, top_n: int = -1, percentiles: tuple[float, float] = (0, 100), feature: str | None = None,
) -> DataFrame:
    """Guides per target region (``chrom``, ``start``, ``end``, ``target_id``), weighted, kept apart and cut to the best.

    Annotation rows as targets are first cut to ``feature`` and ``percentiles``.
    A guide counts once per target, however many of its regions it lies in.
    """
    if feature:
        cut = annotation.truncate(targets, feature, *percentiles)
        targets = cut.select("chrom", (F.col("start") - 1).alias("start"), "end", F.col("gene_id").alias("target_id"))
    placed = guides.withColumnRenamed("contig", "chrom").withColumn("end", F.col("stop"))
    on = intervals.range_join(placed, targets.select("chrom", "start", "end", "target_id")).drop("r_chrom", "r_start", "r_end", "end").withColumnRenamed("r_target_id", "target_id").dropDuplicates()
    on = ranking.at_least(on, least or {})
    if weights:
        if normalise:
            on = ranking.min_max(on, list(weights))
        on = on.withColumn("combined", ranking.weighted({c + ("_norm" if normalise else ""): w for c, w in weights.items()}))
        order = ["__neg", "start", "stop"]
        on = on.withColumn("__neg", -F.col("combined"))
        if spacing > 0:
            on = ranking.spaced(on, ["target_id"], order, "start", "stop", spacing)
        on = ranking.top_per_key(on, ["target_id"], [F.asc_nulls_last("__neg"), F.asc("start"), F.asc("stop"), quoted("sense").asc()], top_n).drop("__neg")
    return on
