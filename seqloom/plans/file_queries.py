"""Files written and read again, and operators beside them, over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import latest, shared_folder, table, tidy
from seqloom.functions import sequence as sq
from seqloom.operators import annotation, intervals, loci, motif, offtarget, ranking, track
from seqloom.plans import region_queries as rq
from seqloom.plans import sequence_queries as sqq
from seqloom.plans.dealt import _P1_TIDY
from seqloom.sinks import writers
from seqloom.sources import readers


def _path(spark: SparkSession, name: str) -> str:
    """Where a query keeps its files: a folder that all executors see."""
    return f"{shared_folder(spark).rstrip('/')}/files/{name}"


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, quote="")


def _dna_file(spark, d, name: str) -> str:
    path = _path(spark, name)
    rows = sqq._dna(spark, d).select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" made of letters\n"), F.regexp_replace("dna", "(.{60})", "$1\n")).alias("value"))
    rows.write.mode("overwrite").text(path)
    return path


def io_fasta(spark, d):
    """Contigs of a FASTA file as rows."""
    return readers.fasta(spark, _dna_file(spark, d, "fasta")).select("contig", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


def io_fasta_chunks(spark, d):
    """Sites of the contigs of a FASTA file read in chunks."""
    chunks = readers.fasta_chunks(spark, _dna_file(spark, d, "fasta_chunks"), 1 << 12, 40)
    hits = motif.sites(chunks, "seq", sqq.NGG, ("contig",), **motif.CHUNKED)
    return hits.groupBy("contig", "strand").agg(F.count(F.lit(1)).alias("sites"), F.sum("offset").alias("offsets"), F.min("site").alias("least"))


def io_slices(spark, d):
    """Twenty-seven bases of each document from its id's hundredth on, read from either strand; null where it is too short."""
    chunks = readers.fasta_chunks(spark, _dna_file(spark, d, "slices"), 1 << 12, 40)
    places = sqq._dna(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), (F.col("doc_id") % 100 * 20).alias("start"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return readers.stranded(chunks, places, 27)


def io_snps(spark, d):
    """Documents' sequences with changed bases, chunk by chunk; of two files of changes the later one holds."""
    points = sqq._dna(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), F.explode(F.array(F.lit(1), F.lit(30), F.lit(31))).alias("pos"))
    writers.tsv(points.withColumn("base", F.lit("a")), _path(spark, "snps1"), header=False)
    writers.tsv(points.where("pos = 31").withColumn("base", F.lit("t")), _path(spark, "snps2"), header=False)
    changes = readers.snps(spark, [_path(spark, "snps1"), _path(spark, "snps2")])
    chunks = motif.chunks(sqq._dna(spark, d).withColumn("c", F.concat(F.lit("d"), F.col("doc_id").cast("string"))), "c", "dna", 500, 40)
    changed = readers.with_snps(chunks, changes)
    return changed.select("contig", "chunk_no", F.substring(F.col("seq"), (F.col("chunk_start") - F.col("seq_start") + 1).cast("int"), F.col("core")).alias("seq"))


def io_gtf(spark, d):
    path = _path(spark, "gtf")
    writers.gtf(annotation.metagene(rq._models(spark, d)), path, "metagene")
    rows = readers.gtf(spark, path)
    return rows.select(F.col("pairs")["gene_id"].alias("gene_id"), "transcript_id", "chrom", "feature", "start", "end", "strand", "source")


def io_gff(spark, d):
    """Genes, transcripts and exons of a GFF3 file with the ids of their parents."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    line = lambda feature, start, attributes: F.concat_ws("\t", F.lit("chr1"), F.lit("x"), F.lit(feature), (start + 1).cast("string"), (start + 5).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    text = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    rows = r.select(line("gene", F.col("r_regionkey"), text("ID=g", "r_regionkey")).alias("value"))
    rows = rows.unionAll(n.select(line("mRNA", F.col("n_nationkey"), F.concat(text("ID=t", "n_nationkey"), text(";Parent=g", "n_regionkey"))))).unionAll(s.select(line("exon", F.col("s_suppkey"), text("Parent=t", "s_nationkey"))))
    rows.write.mode("overwrite").text(_path(spark, "gff"))
    return readers.gff(spark, _path(spark, "gff")).select("feature", "start", "gene_id", "transcript_id")


def io_bed(spark, d):
    path = _path(spark, "bed")
    writers.tsv(rq._regions(spark, d).select("chrom", "start", "end").distinct(), path, header=False)
    return readers.bed(spark, path)


def io_windows(spark, d):
    path = _path(spark, "windows")
    writers.windows_bed(annotation.end_windows(rq._models(spark, d), 300, 100), path)
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, `end` long, ids string, score string, strand string")


def io_quantified(spark, d):
    """Two samples of a quantifier's tables side by side."""
    paths = []
    for kind in ("click", "view"):
        rows = table(spark, d, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        one = rows.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target_id"), F.lit(9).alias("length"), F.lit(9).alias("eff_length"), F.lit(1).alias("est_counts"), F.col("n").alias("tpm"))
        paths.append(_path(spark, f"abundance_{kind}"))
        writers.tsv(one, paths[-1])
    out = readers.quantification(spark, paths)
    return out.toDF("transcript_id", "click", "view")


def io_genes(spark, d):
    """Genes of transcripts from a two-column file, beside the transcripts' values."""
    path = _path(spark, "tx2gene")
    writers.tsv(table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").cast("string"), F.concat(F.lit("g"), F.col("s_nationkey").cast("string"))), path, header=False)
    from seqloom.operators import expression

    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("transcript_id"), F.col("s_acctbal").alias("v"))
    return expression.with_genes(rows, readers.tx_to_gene(spark, path), "transcript_id")


def io_kmers(spark, d):
    path = _path(spark, "kmers")
    rows = sqq._sidecar(spark, d).where(sq.is_dna(F.col("sequence"), 23)).select("id", F.left("sequence", F.lit(20)).alias("sequence"), F.concat(F.lit("N"), F.right("sequence", F.lit(2))).alias("pam"), F.col("chrom").alias("chromosome"), "position", F.col("strand").alias("sense"))
    rows.where("strand in ('+', '-') and id is not null").write.mode("overwrite").csv(path, header=True)
    return readers.kmers(spark, path, 20, 3)


def io_matrix(spark, d):
    """A factor matrix of 23 positions from a file, as rows."""
    rows = [(p, f"r{g.replace('T', 'U')}:d{o}", v) for (p, g, o), v in sqq.MATRIX.items()]
    spark.createDataFrame(rows, "Pos int, MM string, avg_percent_active double").write.mode("overwrite").csv(_path(spark, "matrix"), header=True)
    back = readers.penalty_matrix(spark, _path(spark, "matrix"))
    return spark.createDataFrame([(p, g, o, v) for (p, g, o), v in back.items()], "pos int, guide string, target string, factor double")


def io_flashfry(spark, d):
    path = _path(spark, "flashfry")
    rows = table(spark, d, "flashfry_raw").select("contig", F.lit(0).alias("start"), F.when(F.col("otCount") % 2 == 0, 24).otherwise(23).alias("stop"), "target", "context", "overflow", "orientation", "otCount", F.lit("A_1_0").alias("offTargets"))
    writers.tsv(rows, path)
    return readers.flashfry(spark, path).groupBy("contig", "otCount").agg(F.count(F.lit(1)).alias("rows"))


def io_signal(spark, d):
    path = _path(spark, "signal")
    writers.tsv(table(spark, d, "orders").select(F.lit("chr1"), F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") % 3, "o_totalprice"), path, header=False)
    rows = readers.signal(spark, path)
    best = intervals.best_window(rows, ["chrom"], "start", "value", 5)
    return best.select("chrom", "first", "last", F.round("mean", 4).alias("mean"))


def io_orfs(spark, d):
    """Reading frames with a value of at most 0.5, of two strands, from a table with NA for what is missing; and one whose values are all missing."""
    path = _path(spark, "orfs")
    rows = table(spark, d, "scored_guides").select(F.col("guide_id").alias("id"), "strand", F.when(F.isnan("specificity_chrIII_sequence_crisprots"), None).otherwise(F.col("specificity_chrIII_sequence_crisprots")).alias("p"), F.lit(None).cast("double").alias("q"))
    writers.tsv(rows, path, null="NA")
    orfs = readers.orf_table(spark, path)
    kept = annotation.filter_orfs(annotation.filter_orfs(orfs, "p", 0.5, {"strand": ["+", "-"]}), "q", 0.01)
    return kept.groupBy("strand").agg(F.count(F.lit(1)).alias("rows"))


def io_index(spark, d):
    path = _path(spark, "index")
    writers.index(sqq._near_sites(spark, d), path, 5, sqq.NGG)
    return readers.index(spark, path).select("site", "pam", "loci", "packed", "bin_key")


def io_off_target_rows(spark, d):
    path = _path(spark, "off_targets")
    writers.off_target_csv(table(spark, d, "gscan_output").withColumn("id", tidy(F.col("id"))), path)
    return spark.read.csv(path, header=True, inferSchema=False).groupBy("id", "match_distance", "specificity").agg(F.count(F.lit(1)).alias("rows"))


def io_off_target_lists(spark, d):
    path = _path(spark, "off_target_lists")
    side = sqq._sidecar(spark, d).select("guide_id", F.col("chrom").alias("contig"), F.col("position").alias("start"), "strand")
    rows = sqq._pairs(spark, d).groupBy("guide_id", "guide", "site", "mm").agg(F.sum("loci").alias("loci")).join(side, "guide_id").where("contig is not null and start is not null and strand is not null")
    writers.off_target_tsv(rows, path)
    return _tsv(spark, path).select("contig", "start", "strand", "guide", "offTargets")


def io_aggregate(spark, d):
    """Totals of guides and the dropped ones, written and read again."""
    path = _path(spark, "aggregate")
    scored = sqq._pairs(spark, d).withColumn("cfd", F.lit(0.25))
    totals = offtarget.per_guide(scored, ["guide_id"], "cfd")
    totals = totals.select(F.concat(F.lit("g"), F.col("guide_id").cast("string")).alias("id"), offtarget.specificity(F.col("cfd_sum"), F.col("on_count")).alias("specificity"), "max_cfd", "off_count", "mm_counts", offtarget.saturated(F.col("on_count"), F.col("off_count"), F.col("cfd_sum"), 8).alias("saturated"))
    dropped = sqq._sidecar(spark, d).where(~sq.is_dna(F.col("sequence"), 23)).select(F.concat(F.lit("g"), F.col("guide_id").cast("string")).alias("id"))
    writers.aggregate_csv(totals, path, dropped)
    return spark.read.csv(path, header=True).select("id", F.round(F.col("specificity").cast("double"), 6).alias("specificity"), F.col("max_cfd").cast("double").alias("max_cfd"), "off_target_count", "mismatch_counts", "saturated", "dropped")


def io_records(spark, d):
    """Single off-targets as Parquet and as text, totals of both."""
    rows = table(spark, d, "ot_records").where("guide_id is not null").select("guide_id", "chrom", "start", "mm", "cfd")
    writers.records(rows, _path(spark, "records"))
    writers.records(rows, _path(spark, "records_text"), True)
    one = offtarget.reaggregate(spark.read.parquet(_path(spark, "records")), "guide_id", "cfd").withColumn("kind", F.lit("parquet"))
    text = _tsv(spark, _path(spark, "records_text")).select(F.col("guide_id").cast("int").alias("guide_id"), F.col("cfd").cast("double").alias("cfd"))
    both = one.unionByName(offtarget.reaggregate(text, "guide_id", "cfd").withColumn("kind", F.lit("text")))
    return both.select("kind", "guide_id", F.round("specificity", 6).alias("specificity"), "hits")


def io_sidecar(spark, d):
    path = _path(spark, "sidecar")
    writers.sidecar(sqq._sidecar(spark, d), path)
    return _tsv(spark, path)


def io_scored_bed(spark, d):
    path = _path(spark, "scored")
    rows = latest(table(spark, d, "combine_on_off"), ["contig"], ["chrom", "start", "deepcpf1_score"]).withColumn("specificity_one", F.col("start") % 7 / 2)
    writers.scored_bed(rows.withColumn("deepcpf1_score", F.when(F.col("deepcpf1_score").isNotNull() & ~F.isnan("deepcpf1_score"), F.lit(1.5))), path, ["chrom", "start", "contig", "deepcpf1_score"])
    return _tsv(spark, path)


def io_slim(spark, d):
    path = _path(spark, "slim")
    writers.slim(table(spark, d, "customer"), path, ["c_custkey", "c_nationkey", "nothing"])
    return _tsv(spark, path)


def io_guide_bed(spark, d):
    path = _path(spark, "guide_bed")
    writers.guide_bed(motif.guides(sqq._dna(spark, d), "doc_id", "dna", sqq.NGG), path)
    rows = _tsv(spark, path)
    return rows.select(F.col("`#chr`").alias("contig"), "start", "stop", F.col("`id,sequence,pam,chromosome,position,sense`").alias("id"), "context", "strand")


def io_track(spark, d):
    """Track rows with the description of their columns and what a guide's line in the details says."""
    path = _path(spark, "track")
    side = latest(table(spark, d, "combine_on_off"), ["contig"], ["chrom", "start", "strand"]).withColumn("eff", F.lit(50.0)).withColumn("spec", F.lit(0.6))
    rows = track.build(side.withColumnRenamed("contig", "id"), latest(table(spark, d, "ot_aggregate"), ["id"], ["mismatch_counts", "dropped"]), "eff", "spec")
    writers.track(rows, path)
    back = spark.read.csv(f"{path}/bed", sep="\t", quote="", schema=", ".join(f"{c} string" for c in rows.columns))
    return back.select("name", "chromStart", "chromEnd", "score", "strand")


def seq_contexts(spark, d):
    """What scorers take of a context of 34 bases."""
    s = F.col("sequence")
    context = F.concat(F.lit("ACGT"), s, F.lit("TTGACCA"))
    rows = sqq._sidecar(spark, d).where(sq.is_dna(s, 23)).withColumn("context", context)
    c = F.col("context")
    changes = F.array(F.struct(F.lit(3).alias("pos"), F.lit("A").alias("base")), F.struct((F.col("guide_id") % 23 + 1).cast("int").alias("pos"), F.lit("T").alias("base")))
    return rows.select("guide_id", sq.context_31(c).alias("short"), sq.target_23(c, F.left(s, F.lit(20))).alias("target"), sq.pam_of_context(c).alias("pam"), sq.replace_bases(s, changes).alias("changed"))


def seq_masked(spark, d):
    """Distances of neighbouring guides: of guide alone, of a bin's first bases."""
    rows = sqq._sidecar(spark, d).where(sq.is_dna(F.col("sequence"), 23)).select("guide_id", sq.pack(F.col("sequence")).alias("a"))
    other = rows.select((F.col("guide_id") - 1).alias("guide_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.join(other, "guide_id").select("guide_id", sq.packed_mismatches(a, b, sq.compare_mask(20, 3)).cast("long").alias("guide"), sq.packed_mismatches(a, b, sq.compare_mask(19, 4, True)).cast("long").alias("behind"), sq.prefix_mismatches(a, b, 7, 23).cast("long").alias("bin"))


def ots_legacy(spark, d):
    rows = table(spark, d, "ot_records").where("guide_id is not null").groupBy("guide_id").agg(F.sum("cfd").alias("s"))
    return rows.select("guide_id", F.round(offtarget.legacy_specificity(F.col("s")), 6).alias("specificity"))


def range_contained(spark, d):
    return intervals.contained(rq._kind(spark, d, "exon"), rq._kind(spark, d, "peak"))


def rank_test(spark, d):
    """Whether scores of the two strands differ."""
    out = ranking.mann_whitney(table(spark, d, "ot_records"), "strand", "cfd", "+", "-")
    return out.select("n_a", "n_b", "u_a", "u_b", F.round("z", 6).alias("z"))


def rank_correlations(spark, d):
    out = ranking.correlations(table(spark, d, "scored_guides"), "chr", "RS3_score_Chen2013", "enpam_gb_score")
    return out.select("chr", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "rows")


def rank_chunks(spark, d):
    return ranking.row_chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 700)


def rank_shares(spark, d):
    return ranking.shares_above(table(spark, d, "combine_on_off"), ["deepcpf1_score_pct", "enpam_gb_score_pct"], 50.0)


def gene_stitched(spark, d):
    """Overlapping pieces of documents joined to whole sequences."""
    pieces = motif.chunks(sqq._dna(spark, d), "doc_id", "dna", 200, 30).select(F.col("contig").alias("doc_id"), "seq_start", "seq")
    return annotation.stitch(pieces, ["doc_id"], "seq_start", "seq").select("doc_id", "start", "end", F.md5("sequence").alias("digest"))


_DOC = "'d' || doc_id::VARCHAR"
QUERIES = {f.__name__: f for f in (
    io_fasta, io_fasta_chunks, io_slices, io_snps, io_gtf, io_gff, io_bed, io_windows, io_quantified, io_genes, io_kmers, io_matrix, io_flashfry, io_signal, io_orfs, io_index, io_off_target_rows, io_off_target_lists,
    io_aggregate, io_records, io_sidecar, io_scored_bed, io_slim, io_guide_bed, io_track, seq_contexts, seq_masked, ots_legacy, range_contained, rank_test, rank_correlations, rank_chunks, rank_shares, gene_stitched,
)}
SQL = {
    "io_fasta": sqq._DNA.rstrip(",\n") + f" SELECT {_DOC} AS contig, length(s) AS n, md5(s) AS digest FROM t WHERE length(s) > 0",
    "io_fasta_chunks": sqq._SITES + f"SELECT {_DOC} AS contig, strand, count(*) AS sites, sum(o)::BIGINT AS offsets, min(site) AS least FROM h GROUP BY doc_id, strand",
    "io_slices": sqq._DNA.rstrip(",\n") + f""", p AS (SELECT doc_id, s, doc_id % 100 * 20 AS a, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM t WHERE length(s) > 0)
SELECT {_DOC} AS chrom, a AS start, strand, CASE WHEN a + 27 <= length(s) THEN CASE WHEN strand = '+' THEN substr(s, a + 1, 27) ELSE reverse(translate(substr(s, a + 1, 27), 'ACGT', 'TGCA')) END END AS sequence FROM p""",
    "io_snps": sqq._DNA + f"""x AS (SELECT doc_id, CASE WHEN length(s) >= 31 THEN 'A' || s[2:29] || 'AT' || s[32:] WHEN length(s) = 30 THEN 'A' || s[2:29] || 'A' ELSE 'A' || s[2:] END AS s FROM t WHERE length(s) > 0),
c AS (SELECT doc_id, s, unnest(range(0, (length(s) - 1) // 500 + 1)) AS k FROM x) SELECT {_DOC} AS contig, k::INTEGER AS chunk_no, substr(s, k * 500 + 1, 500) AS seq FROM c""",
    "io_gtf": rq._META + "SELECT gene_id, gene_id || '.metagene' AS transcript_id, chrom, feature, s AS start, e - 1 AS \"end\", strand, 'metagene' AS source FROM k",
    "io_gff": """SELECT 'gene' AS feature, r_regionkey::BIGINT + 1 AS start, 'g' || r_regionkey AS gene_id, NULL::VARCHAR AS transcript_id FROM region UNION ALL SELECT 'transcript', n_nationkey::BIGINT + 1, 'g' || n_regionkey, 't' || n_nationkey FROM nation
UNION ALL SELECT 'exon', s_suppkey::BIGINT + 1, 'g' || n_regionkey, 't' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "io_bed": rq._R + "SELECT DISTINCT chrom, s AS start, e AS \"end\", chrom || '_' || s || '_' || e AS name FROM r",
    "io_windows": rq._M + """, w AS (SELECT gene_id, chrom, strand, transcript_id, min(s) AS a, max(e) AS b FROM m GROUP BY ALL)
SELECT chrom, greatest(0, CASE WHEN strand = '+' THEN a - 301 ELSE b - 101 END) AS start, CASE WHEN strand = '+' THEN a + 100 ELSE b + 300 END AS "end", transcript_id || ',' || gene_id AS ids, '0' AS score, strand FROM w""",
    "io_quantified": """WITH c AS (SELECT 't' || user_id AS transcript_id, count(*)::DOUBLE AS click FROM events WHERE event_type = 'click' GROUP BY user_id), v AS (SELECT 't' || user_id AS transcript_id, count(*)::DOUBLE AS view FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT transcript_id, click, view FROM c FULL JOIN v USING (transcript_id)""",
    "io_genes": "SELECT s_suppkey::VARCHAR AS transcript_id, s_acctbal AS v, CASE WHEN s_suppkey % 3 > 0 THEN 'g' || s_nationkey END AS gene_id FROM supplier",
    "io_kmers": sqq._SIDE + "SELECT id, s[1:20] AS sequence, 'A' || s[22:23] AS pam, chrom AS chromosome, position, strand AS sense FROM v WHERE strand IN ('+', '-') AND id IS NOT NULL",
    "io_matrix": "SELECT p::INTEGER AS pos, g AS guide, o AS target, round(0.2 + 0.03 * p + 0.05 * (instr('ACGT', g) - 1) + 0.04 * (instr('ACGT', o) - 1), 4)::DOUBLE AS factor FROM range(1, 24) r(p), (SELECT unnest(['A', 'C', 'G', 'T']) AS g), (SELECT unnest(['A', 'C', 'G', 'T']) AS o) WHERE g <> o",
    "io_flashfry": "SELECT contig, otCount, count(*) AS rows FROM flashfry_raw WHERE orientation = 'FWD' AND otCount % 2 = 0 GROUP BY contig, otCount",
    "io_signal": """WITH r AS (SELECT o_orderkey AS s, o_totalprice AS v FROM orders WHERE o_custkey % 3 > 0), w AS (SELECT s AS first, last_value(s) OVER f AS last, avg(v) OVER f AS mean, count(*) OVER f AS n FROM r WINDOW f AS (ORDER BY s ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT 'chr1' AS chrom, first::BIGINT AS first, last::BIGINT AS last, round(mean, 4) AS mean FROM w WHERE n = 5 ORDER BY w.mean DESC, first LIMIT 1""",
    "io_orfs": "SELECT strand, count(*) AS rows FROM scored_guides WHERE NOT isnan(specificity_chrIII_sequence_crisprots) AND specificity_chrIII_sequence_crisprots <= 0.5 AND strand IN ('+', '-') GROUP BY strand",
    "io_index": sqq._MADE + "SELECT site, pam, loci, list_reduce(list_transform(range(1, 24), lambda i: instr('ACGT', site[i]) - 1), lambda a, b: a * 4 + b) AS packed, site[1:5] AS bin_key FROM u",
    "io_off_target_rows": f"""WITH g AS (SELECT {_P1_TIDY} AS id, match_distance::VARCHAR AS match_distance, CASE WHEN isnan(specificity) THEN 'NaN' ELSE printf('%.6f', specificity) END AS specificity FROM gscan_output)
SELECT id, match_distance, coalesce(specificity, 'null') AS specificity, count(*) AS rows FROM g GROUP BY ALL""",
    "io_off_target_lists": sqq._NEAR + """, a AS (SELECT guide_id, guide, site, mm, sum(loci)::BIGINT AS loci FROM p GROUP BY ALL)
SELECT chrom AS contig, position::VARCHAR AS start, strand, guide, string_agg(site || '_' || loci || '_' || mm, ',' ORDER BY mm, site, loci) AS offTargets FROM a JOIN v USING (guide_id) WHERE chrom IS NOT NULL AND position IS NOT NULL AND strand IS NOT NULL GROUP BY chrom, position, strand, guide""",
    "io_aggregate": sqq._NEAR + """, a AS (SELECT guide_id, coalesce(sum(0.25 * loci) FILTER (mm > 0), 0) AS c, max(0.25) FILTER (mm > 0) AS m, coalesce(sum(loci) FILTER (mm = 0), 0)::BIGINT AS o, coalesce(sum(loci) FILTER (mm > 0), 0)::BIGINT AS f, list_transform(range(1, 5), lambda i: 0) AS z,
  coalesce(sum(loci) FILTER (mm = 1), 0)::BIGINT AS m1, coalesce(sum(loci) FILTER (mm = 2), 0)::BIGINT AS m2, coalesce(sum(loci) FILTER (mm = 3), 0)::BIGINT AS m3, coalesce(sum(loci) FILTER (mm = 4), 0)::BIGINT AS m4 FROM p GROUP BY guide_id)
SELECT 'g' || guide_id AS id, round((1 / (greatest(o, 1) + c))::DOUBLE, 6) AS specificity, m::DOUBLE AS max_cfd, f::VARCHAR AS off_target_count, concat_ws(';', greatest(o - 1, 0), m1, m2, m3, m4) AS mismatch_counts, (o + f >= 8)::INTEGER::VARCHAR AS saturated, '0' AS dropped FROM a
UNION ALL SELECT 'g' || guide_id, NULL, NULL, NULL, NULL, NULL, '1' FROM l WHERE NOT coalesce(regexp_full_match(s, '[ACGT]{23}'), false)""",
    "io_records": """WITH r AS (SELECT guide_id, round(1 / (1 + coalesce(sum(cfd), 0)), 6) AS specificity, count(*) AS hits FROM ot_records WHERE guide_id IS NOT NULL GROUP BY guide_id) SELECT 'parquet' AS kind, * FROM r UNION ALL SELECT 'text', * FROM r""",
    "io_sidecar": sqq._SIDE + "SELECT guide_id::VARCHAR AS guide_id, id, chrom, position::VARCHAR AS position, strand, s AS sequence, on_count::VARCHAR AS on_count FROM l",
    "io_scored_bed": "SELECT chrom, start::VARCHAR AS start, contig, CASE WHEN NOT isnan(deepcpf1_score) THEN '1.5' ELSE '-1' END AS deepcpf1_score, (start % 7 / 2.0::DOUBLE)::VARCHAR AS specificity_one FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC) AS r FROM combine_on_off) WHERE r = 1",
    "io_slim": "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey FROM customer",
    "io_guide_bed": sqq._GUIDES + "SELECT contig::VARCHAR AS contig, start::VARCHAR AS start, (start + 20)::VARCHAR AS stop, concat_ws(',', concat_ws(':', contig, position, sense), guide, pam, contig, position, sense) AS id, context, sense AS strand FROM c",
    "io_track": "SELECT contig AS name, (CASE WHEN strand = '+' THEN start - 4 ELSE start END)::VARCHAR AS chromStart, (CASE WHEN strand = '+' THEN start + 23 ELSE start + 27 END)::VARCHAR AS chromEnd, '60' AS score, strand FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC) AS r FROM combine_on_off) WHERE r = 1",
    "seq_contexts": sqq._SIDE + """, c AS (SELECT guide_id, s, 'ACGT' || s || 'TTGACCA' AS c, CASE WHEN s[3] = 'A' THEN s ELSE s[1:2] || 'A' || s[4:] END AS t FROM v)
SELECT guide_id, substr(c, 2, 31) AS short, CASE WHEN length(substr(c, instr(c, s[1:20]), 23)) = 23 THEN substr(c, instr(c, s[1:20]), 23) END AS target, substr(c, 5, 4) AS pam, substr(t, 1, guide_id % 23) || 'T' || substr(t, guide_id % 23 + 2) AS changed FROM c""",
    "seq_masked": sqq._SIDE + "SELECT a.guide_id, hamming(a.s[1:20], b.s[1:20]) AS guide, hamming(a.s[5:23], b.s[5:23]) AS behind, hamming(a.s[1:7], b.s[1:7]) AS bin FROM v a JOIN v b ON b.guide_id = a.guide_id + 1",
    "ots_legacy": "SELECT guide_id, round(CASE WHEN coalesce(sum(cfd), 0) = 0 THEN 1 ELSE 1 / sum(cfd) END, 6) AS specificity FROM ot_records WHERE guide_id IS NOT NULL GROUP BY guide_id",
    "range_contained": rq._R + "SELECT chrom, s AS start, e AS \"end\", region_set FROM r a WHERE region_kind = 'exon' AND EXISTS (SELECT 1 FROM r b WHERE b.region_kind = 'peak' AND b.chrom = a.chrom AND b.s <= a.s AND a.e <= b.e)",
    "rank_test": """WITH r AS (SELECT strand, cfd, rank() OVER (ORDER BY cfd) + (count(*) OVER (PARTITION BY cfd) - 1) / 2.0::DOUBLE AS k FROM ot_records WHERE strand IN ('+', '-') AND cfd IS NOT NULL AND NOT isnan(cfd)),
t AS (SELECT sum(power(n, 3) - n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM r GROUP BY cfd)), u AS (SELECT count(*) FILTER (strand = '+') AS a, count(*) FILTER (strand = '-') AS b, sum(k) FILTER (strand = '+') AS s FROM r),
w AS (SELECT a, b, s - a::DOUBLE * (a + 1) / 2 AS u, t, (a + b)::DOUBLE AS n FROM u, t)
SELECT a AS n_a, b AS n_b, u AS u_a, a::DOUBLE * b - u AS u_b, round((u - a::DOUBLE * b / 2) / sqrt(a::DOUBLE * b / 12 * ((n + 1) - t / (n * (n - 1)))), 6) AS z FROM w""",
    "rank_correlations": """WITH r AS (SELECT chr, RS3_score_Chen2013 AS a, enpam_gb_score AS b FROM scored_guides WHERE NOT isnan(RS3_score_Chen2013) AND NOT isnan(enpam_gb_score)),
k AS (SELECT *, rank() OVER (PARTITION BY chr ORDER BY a) + (count(*) OVER (PARTITION BY chr, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY chr ORDER BY b) + (count(*) OVER (PARTITION BY chr, b) - 1) / 2.0::DOUBLE AS rb FROM r)
SELECT chr, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS rows FROM k GROUP BY chr""",
    "rank_chunks": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS chunk FROM orders",
    "rank_shares": """WITH f AS (SELECT deepcpf1_score_pct AS a, enpam_gb_score_pct AS b FROM combine_on_off WHERE NOT isnan(deepcpf1_score_pct) AND NOT isnan(enpam_gb_score_pct) AND deepcpf1_score_pct <> -1 AND enpam_gb_score_pct <> -1)
SELECT 'deepcpf1_score_pct' AS "column", count(*) AS rows, count(*) FILTER (a > 50) AS above FROM f UNION ALL SELECT 'enpam_gb_score_pct', count(*), count(*) FILTER (b > 50) FROM f""",
    "gene_stitched": sqq._DNA.rstrip(",\n") + " SELECT doc_id, 0::BIGINT AS start, length(s) AS \"end\", md5(s) AS digest FROM t WHERE length(s) > 0",
}
