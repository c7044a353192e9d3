"""Interval algebra, annotation, ranking, expression and track operators over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import latest, table, tidy
from seqloom.functions import sequence as sq
from seqloom.plans.dealt import split_sql
from seqloom.operators import annotation, expression, intervals, loci, motif, offtarget, packed, periods, ranking, track

WIDE = 200


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Tidied region rows: known, ordered bounds, one spelling of chromosomes, each different row once."""
    s, e = F.least("start", "end"), F.greatest("start", "end")
    rows = table(spark, d, "bed_regions").where("region_set is not null and start is not null and end is not null and region_kind is not null")
    rows = rows.select("region_set", "region_kind", periods.tidy_chrom(F.col("chrom")).alias("chrom"), s.alias("start"), e.alias("end"))
    return rows.where("chrom is not null and start < end").distinct()


def _kind(spark, d, kind: str) -> DataFrame:
    return _regions(spark, d).where(F.col("region_kind") == kind).select("chrom", "start", "end", "region_set")


def _guides(spark, d) -> DataFrame:
    """Guides with an empty cut-site range."""
    rows = latest(table(spark, d, "guide_sidecar"), ["guide_id"], ["chrom", "position", "strand"]).where("chrom is not null and position is not null")
    return rows.select("guide_id", F.concat(F.lit("chr"), F.upper(F.substring("chrom", 4, 99))).alias("chrom"), F.col("position").alias("start"), F.col("position").alias("end"))


def range_inner(spark, d):
    g = intervals.widen(_guides(spark, d), WIDE, WIDE)
    out = intervals.range_join(g, _kind(spark, d, "exon"))
    return out.select("guide_id", "r_region_set", "r_start", "r_end", (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("width"))


def range_semi(spark, d):
    return intervals.range_join(intervals.widen(_guides(spark, d), WIDE, WIDE), _kind(spark, d, "exon"), how="semi").select("guide_id", "chrom")


def range_anti(spark, d):
    return intervals.range_join(_guides(spark, d), _kind(spark, d, "discard"), how="anti").select("guide_id", "chrom")


def region_intersect(spark, d):
    return intervals.intersect(_kind(spark, d, "exon"), _kind(spark, d, "peak"))


def region_union(spark, d):
    return intervals.union([_kind(spark, d, "exon"), _kind(spark, d, "peak")])


def region_subtract(spark, d):
    return intervals.subtract(intervals.union([_kind(spark, d, "exon")]), _kind(spark, d, "peak"))


def region_widened(spark, d):
    return intervals.union([intervals.widen(_kind(spark, d, "exon"), 50, 80)])


def region_bounds(spark, d):
    return intervals.bounding(_regions(spark, d), ["region_set", "chrom"])


def region_closed_merge(spark, d):
    return intervals.merge_closed(_regions(spark, d), ["region_set", "chrom"])


def _models(spark, d) -> DataFrame:
    """Regions read as annotation: sets are genes, kinds are transcripts, odd starts are coding."""
    r = _regions(spark, d)
    base = r.select(F.concat_ws("@", "region_set", "chrom").alias("gene_id"), F.col("region_kind").alias("transcript_id"), "chrom", "start", "end", F.when(F.expr("length(region_set) + ascii(right(region_set, 1))") % 2 == 0, "+").otherwise("-").alias("strand"))
    cds = base.where("start % 3 = 0").withColumns({"feature": F.lit("CDS"), "end": F.greatest(F.col("start"), F.col("end") - 7)})
    return base.withColumn("feature", F.lit("exon")).unionByName(cds).select("gene_id", "transcript_id", "chrom", "start", "end", "strand", "feature")


def gene_metagene(spark, d):
    return annotation.metagene(_models(spark, d)).select("gene_id", "feature", "start", "end", "transcript_id")


def gene_consensus(spark, d):
    return annotation.consensus(_models(spark, d)).select("gene_id", "feature", "start", "end")


def gene_longest(spark, d):
    return annotation.by_coding_length(_models(spark, d)).groupBy("gene_id", "transcript_id").agg(F.count(F.lit(1)).alias("rows"))


def gene_shortest(spark, d):
    return annotation.by_coding_length(_models(spark, d), False).groupBy("gene_id", "transcript_id").agg(F.count(F.lit(1)).alias("rows"))


def gene_windows(spark, d):
    m = _models(spark, d)
    one = annotation.end_windows(m, 300, 100).withColumn("at", F.lit("start"))
    return one.unionAll(annotation.end_windows(m, 50, 60, "end").withColumn("at", F.lit("end"))).drop("chrom")


def gene_untranslated(spark, d):
    return annotation.untranslated(_models(spark, d)).select("gene_id", "transcript_id", "feature", "start", "end")


def gene_truncated(spark, d):
    return annotation.truncate(_models(spark, d), "exon", 10, 60).select("gene_id", "transcript_id", "start", "end")


def gene_isoforms(spark, d):
    return annotation.isoform_counts(_models(spark, d))


def gene_gtf(spark, d):
    return annotation.metagene(_models(spark, d)).select(annotation.gtf_line("metagene").alias("line"))


def rank_min_max(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    scaled = ranking.min_max(rows, ["price", "size"])
    return scaled.select("p_partkey", "price_norm", "size_norm", ranking.weighted({"price_norm": 0.6180339, "size_norm": 0.3819661}).alias("score"))


def rank_cutoffs(spark, d):
    rows = table(spark, d, "scored_guides").where("not isnan(deepcpf1_score)")
    a = ranking.at_least(rows, {"deepcpf1_score": 50.0, "specificity_chrIII_sequence_crisprots": 0.5}).select(F.lit("at least").alias("how"), "chr")
    b = ranking.above(rows, {"deepcpf1_score": 50.0, "specificity_chrIII_sequence_crisprots": 0.5}).select(F.lit("above").alias("how"), "chr")
    return a.unionAll(b).groupBy("how", "chr").agg(F.count(F.lit(1)).alias("rows"))


def rank_top(spark, d):
    rows = table(spark, d, "orders")
    return ranking.top_per_key(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank_no")


def rank_percent(spark, d):
    rows = table(spark, d, "guide_sidecar").select("guide_id", F.col("on_count").cast("double").alias("n"), "loaded_at")
    return ranking.percent_rank(rows, ["n"]).groupBy("n", "n_pct").agg(F.count(F.lit(1)).alias("rows"))


def rank_spaced(spark, d):
    rows = _kind(spark, d, "peak").select("region_set", "chrom", "start", "end", F.col("start").alias("order")).distinct()
    return ranking.spaced(rows, ["region_set", "chrom"], ["order", "end"], "start", "end", 1000).select("region_set", "chrom", "start", "end")


def rank_counts(spark, d):
    counts = ranking.counts_with_zero(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer"), "c_custkey")
    return ranking.count_of_counts(counts)


def rank_count_summary(spark, d):
    counts = ranking.counts_with_zero(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer"), "c_custkey")
    return ranking.count_summary(counts)


def rank_without(spark, d):
    """Guides of the sidecar without any record."""
    return ranking.without(table(spark, d, "guide_sidecar"), table(spark, d, "ot_records"), "guide_id")


def rank_buckets(spark, d):
    counts = table(spark, d, "ot_records").where("guide_id is not null").groupBy("guide_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(ranking.bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("guides"))


def rank_correlation(spark, d):
    out = ranking.spearman(table(spark, d, "ot_records"), "cfd", "cfd2")
    return out.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 4).alias("spearman"), "rows")


def expr_wide(spark, d):
    events = table(spark, d, "events").where("event_type is not null")
    names = ["click", "view", "purchase", "signup", "error"]
    wide = expression.widen(events, "user_id", "event_type", "value", names)
    stats = expression.row_statistics(wide, names)
    return stats.select("user_id", "tscript_min", "tscript_max", "tscript_median", "tscript_mean")


def expr_outer(spark, d):
    events = table(spark, d, "events")
    one = lambda k: events.where(F.col("event_type") == k).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias(k))
    return expression.outer_join([one("click"), one("view"), one("purchase")], "user_id")


def expr_top(spark, d):
    """The two best suppliers of each nation by balance."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("transcript_id"), F.col("s_nationkey").alias("gene_id"), F.col("s_acctbal").alias("tscript_mean"))
    return expression.top_isoforms(expression.expressed(rows, {"mean": 0.0}), 2, "tscript_mean", "transcript_id")


def best_window(spark, d):
    """The best three consecutive events of each user."""
    rows = table(spark, d, "events").where("value is not null").select("user_id", "event_id", "value")
    return intervals.best_window(rows, ["user_id"], "event_id", "value", 3).select("user_id", "first", "last", F.round("mean", 6).alias("mean"))


def track_offsets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "path")
    return track.byte_offsets(rows, "doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), "path"), header=7).select("doc_id", "offset")


def track_lists(spark, d):
    rows = table(spark, d, "ot_records").where("guide_id is not null and start is not null")
    text = F.concat_ws(";", F.concat_ws(":", "chrom", F.col("start").cast("string")), F.col("mm").cast("string"))
    return track.off_target_lists(rows, "guide_id", text, "cfd", 100, 2000)


def track_rows(spark, d):
    side = latest(table(spark, d, "combine_on_off"), ["contig"], ["chrom", "start", "strand", "deepcpf1_score", "TTTV_enCas12a_aggregated_score"])
    guides = side.select(F.col("contig").alias("id"), "chrom", "start", "strand", F.when(~F.isnan("deepcpf1_score"), F.col("deepcpf1_score")).alias("eff"), F.when(~F.isnan("TTTV_enCas12a_aggregated_score"), F.col("TTTV_enCas12a_aggregated_score")).alias("spec"))
    totals = packed.rewritten(latest(table(spark, d, "ot_aggregate"), ["id"], ["mismatch_counts", "dropped"]), "mismatch_counts", ";", quotes=False)
    return track.build(guides, totals, "eff", "spec").select("name", "chromStart", "chromEnd", "score", "itemRgb", "shown")


def join_on_off(spark, d):
    """Contigs that have on-target and off-target rows, and contigs of one side alone."""
    return loci.sides(table(spark, d, "combine_on_off").where("contig is not null"), table(spark, d, "flashfry_raw").where("contig is not null"), "contig")


def join_guides(spark, d):
    """Guides of a sidecar with their totals; guides without, and totals without guide."""
    side = latest(table(spark, d, "guide_sidecar"), ["guide_id"], ["id"])
    totals = offtarget.reaggregate(table(spark, d, "ot_records").where("guide_id is not null"), "guide_id", "cfd")
    return offtarget.with_totals(side, totals, "guide_id").groupBy("state").agg(F.count(F.lit(1)).alias("guides"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def ids_tidied(spark, d):
    rows = table(spark, d, "gscan_output").select(tidy(F.col("id")).alias("id"), F.upper("sequence").alias("sequence"))
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.countDistinct("sequence").alias("sequences"), F.max(sq.gc_percent(F.regexp_replace("sequence", "N", ""))).cast("decimal(10,4)").cast("double").alias("gc"))


_R = r"""WITH q AS (SELECT DISTINCT region_set, region_kind, regexp_replace(upper(regexp_replace(chrom, '[\s\p{Z}]+', '', 'g')), '^CHR', '') AS c, least(start, "end") AS s, greatest(start, "end") AS e FROM bed_regions
  WHERE region_set IS NOT NULL AND chrom IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND region_kind IS NOT NULL AND start <> "end"),
r AS (SELECT region_set, region_kind, 'chr' || c AS chrom, s, e FROM q WHERE c <> ''),
g AS (SELECT guide_id, 'chr' || upper(substr(chrom, 4)) AS chrom, position AS p FROM (SELECT *, row_number() OVER (PARTITION BY guide_id ORDER BY loaded_at DESC) AS n FROM guide_sidecar) WHERE n = 1 AND chrom IS NOT NULL AND position IS NOT NULL)
"""


def _merged(rows: str, keys: str, s: str = "s", e: str = "e", touch: str = ">") -> str:
    return f"""SELECT {keys}, min({s}) AS s, max({e}) AS e FROM (SELECT *, sum(CASE WHEN b IS NULL OR {s} {touch} b THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, max({e}) OVER (PARTITION BY {keys} ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT DISTINCT {keys}, {s}, {e} FROM ({rows})))) GROUP BY {keys}, k"""


_EXON, _PEAK = "SELECT chrom, s, e FROM r WHERE region_kind = 'exon'", "SELECT chrom, s, e FROM r WHERE region_kind = 'peak'"
_M = _R + """, b AS (SELECT region_set || '@' || chrom AS gene_id, region_kind AS transcript_id, chrom, s, e, CASE WHEN (length(region_set) + ascii(right(region_set, 1))) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM r),
m AS (SELECT *, 'exon' AS feature FROM b UNION ALL SELECT gene_id, transcript_id, chrom, s, greatest(s, e - 7), strand, 'CDS' FROM b WHERE s % 3 = 0),
t AS (SELECT gene_id, transcript_id, max((feature = 'CDS')::INT) AS coding FROM m GROUP BY ALL), x AS (SELECT gene_id, transcript_id FROM t WHERE coding = (SELECT max(coding) FROM t u WHERE u.gene_id = t.gene_id)),
y AS (SELECT m.* FROM m JOIN x USING (gene_id, transcript_id))
"""
_LEN = _M + ", l AS (SELECT gene_id, transcript_id, sum(e - s + 1) AS n FROM m WHERE feature = 'CDS' GROUP BY ALL), f AS (SELECT gene_id, transcript_id FROM l QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY n {order}, transcript_id) = 1) SELECT gene_id, transcript_id, count(*) AS rows FROM m JOIN f USING (gene_id, transcript_id) GROUP BY ALL"
_META = _M + ", k AS (" + _merged("SELECT gene_id, chrom, strand, feature, s, e + 1 AS e FROM y", "gene_id, chrom, strand, feature") + ")\n"
_COUNTS = "WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)\n"

QUERIES = {f.__name__: f for f in (
    range_inner, range_semi, range_anti, region_intersect, region_union, region_subtract, region_widened, region_bounds, region_closed_merge, gene_metagene, gene_consensus, gene_longest, gene_shortest, gene_windows,
    gene_untranslated, gene_truncated, gene_isoforms, gene_gtf, rank_min_max, rank_cutoffs, rank_top, rank_percent, rank_spaced, rank_counts, rank_count_summary, rank_without, rank_buckets, rank_correlation,
    expr_wide, expr_outer, expr_top, best_window, track_offsets, track_lists, track_rows, join_on_off, join_guides, ids_tidied,
)}

SQL = {
    "range_inner": _R + "SELECT guide_id, region_set AS r_region_set, s AS r_start, e AS r_end, least(e, p + 200) - greatest(s, greatest(0, p - 200)) AS width FROM g JOIN r ON r.chrom = g.chrom AND r.region_kind = 'exon' AND p - 200 < e AND s < p + 200",
    "range_semi": _R + "SELECT guide_id, chrom FROM g WHERE EXISTS (SELECT 1 FROM r WHERE r.chrom = g.chrom AND r.region_kind = 'exon' AND p - 200 < e AND s < p + 200)",
    "range_anti": _R + "SELECT guide_id, chrom FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.chrom = g.chrom AND r.region_kind = 'discard' AND p - 1 < e AND s < p + 1)",
    "region_intersect": _R + "SELECT a.chrom, greatest(a.s, b.s) AS start, least(a.e, b.e) AS \"end\" FROM r a JOIN r b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e WHERE a.region_kind = 'exon' AND b.region_kind = 'peak'",
    "region_union": _R + f"SELECT chrom, s AS start, e AS \"end\" FROM ({_merged(_EXON + ' UNION ALL ' + _PEAK, 'chrom')})",
    "region_subtract": _R + f""", a AS ({_merged(_EXON, 'chrom')}), h AS ({_merged(_PEAK, 'chrom')}), p AS (SELECT a.*, h.s AS hs, h.e AS he FROM a JOIN h ON a.chrom = h.chrom AND a.s < h.e AND h.s < a.e),
z AS (SELECT chrom, s, e, lag(he) OVER w AS prev, hs, he, lead(hs) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY chrom, s, e ORDER BY hs)),
o AS (SELECT chrom, coalesce(prev, s) AS s, hs AS e FROM z UNION ALL SELECT chrom, he, e FROM z WHERE nxt IS NULL UNION ALL SELECT chrom, s, e FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE a.chrom = h.chrom AND a.s < h.e AND h.s < a.e))
SELECT chrom, s AS start, e AS "end" FROM o WHERE s < e""",
    "region_widened": _R + f"SELECT chrom, s AS start, e AS \"end\" FROM ({_merged('SELECT chrom, greatest(0, s - 50) AS s, e + 80 AS e FROM (' + _EXON + ')', 'chrom')})",
    "region_bounds": _R + "SELECT region_set, chrom, min(s) AS start, max(e) AS \"end\" FROM r GROUP BY region_set, chrom",
    "region_closed_merge": _R + f"SELECT region_set, chrom, s AS start, e - 1 AS \"end\" FROM ({_merged('SELECT region_set, chrom, s, e + 1 AS e FROM r', 'region_set, chrom')})",
    "gene_metagene": _META + "SELECT gene_id, feature, s AS start, e - 1 AS \"end\", gene_id || '.metagene' AS transcript_id FROM k",
    "gene_consensus": _M + """, c AS (SELECT gene_id, feature, count(DISTINCT transcript_id) AS n FROM y GROUP BY ALL), w AS (SELECT DISTINCT gene_id, transcript_id, feature, s, e FROM m),
o AS (SELECT w.gene_id, w.feature, w.transcript_id, w.s, w.e, count(DISTINCT y.transcript_id) AS n, greatest(w.s, max(y.s)) AS ms, least(w.e, min(y.e)) AS me FROM w JOIN y ON w.gene_id = y.gene_id AND w.feature = y.feature AND w.s <= y.e AND y.s <= w.e GROUP BY w.gene_id, w.feature, w.transcript_id, w.s, w.e)
SELECT DISTINCT gene_id, feature, ms AS start, me AS "end" FROM o JOIN c USING (gene_id, feature) WHERE o.n = c.n AND ms <= me""",
    "gene_longest": _LEN.replace("{order}", "DESC"),
    "gene_shortest": _LEN.replace("{order}", "ASC"),
    "gene_windows": _M + """, w AS (SELECT gene_id, strand, transcript_id, min(s) AS a, max(e) AS b FROM m GROUP BY ALL)
SELECT gene_id, strand, transcript_id, greatest(0, CASE WHEN strand = '+' THEN a - 301 ELSE b - 101 END) AS start, CASE WHEN strand = '+' THEN a + 100 ELSE b + 300 END AS "end", 'start' AS at FROM w
UNION ALL SELECT gene_id, strand, transcript_id, greatest(0, CASE WHEN strand = '+' THEN b - 51 ELSE a - 61 END), CASE WHEN strand = '+' THEN b + 60 ELSE a + 50 END, 'end' FROM w""",
    "gene_untranslated": _M + """, c AS (SELECT gene_id, transcript_id, min(s) AS cs, max(e) AS ce FROM m WHERE feature = 'CDS' GROUP BY ALL), j AS (SELECT m.*, cs, ce FROM m JOIN c USING (gene_id, transcript_id) WHERE feature = 'exon')
SELECT gene_id, transcript_id, CASE WHEN strand = '-' THEN 'UTR3' ELSE 'UTR5' END AS feature, s AS start, least(e, cs - 1) AS "end" FROM j WHERE s < cs UNION ALL SELECT gene_id, transcript_id, CASE WHEN strand = '-' THEN 'UTR5' ELSE 'UTR3' END, greatest(s, ce + 1), e FROM j WHERE e > ce""",
    "gene_truncated": _M + """, w AS (SELECT *, e - s + 1 AS n, sum(e - s + 1) OVER (PARTITION BY gene_id, transcript_id ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END, e ROWS UNBOUNDED PRECEDING) AS t, sum(e - s + 1) OVER (PARTITION BY gene_id, transcript_id) AS a FROM m WHERE feature = 'exon'),
z AS (SELECT *, t - n AS f, round_even(a * (10 / 100.0), 0)::BIGINT AS lo, round_even(a * (60 / 100.0), 0)::BIGINT AS hi FROM w), y2 AS (SELECT *, greatest(0, lo - f) AS skip, least(n, hi - f) AS stop FROM z WHERE t > lo AND f < hi)
SELECT gene_id, transcript_id, (CASE WHEN strand = '+' THEN s + skip WHEN stop < n THEN e - stop ELSE s END)::BIGINT AS start, (CASE WHEN strand = '-' THEN e - skip WHEN stop < n THEN s + stop ELSE e END)::BIGINT AS "end" FROM y2""",
    "gene_isoforms": _M + "SELECT gene_id, count(DISTINCT transcript_id) AS isoforms FROM m GROUP BY gene_id",
    "gene_gtf": _META + "SELECT concat_ws(chr(9), chrom, 'metagene', feature, s::VARCHAR, (e - 1)::VARCHAR, '.', strand, '.', 'gene_id \"' || gene_id || '\"; transcript_id \"' || gene_id || '.metagene\";') AS line FROM k",
    "rank_min_max": """WITH b AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS z, min(p_size) AS c, max(p_size) AS y FROM part), n AS (SELECT p_partkey, round_even((p_retailprice - a) / (z - a), 4) AS price_norm, round_even((p_size::DOUBLE - c) / (y - c), 4) AS size_norm FROM part, b)
SELECT *, round_even((price_norm * 0.6180339::DOUBLE + size_norm * 0.3819661::DOUBLE) / 2, 4) AS score FROM n""",
    "rank_cutoffs": """WITH s AS (SELECT chr, deepcpf1_score AS a, specificity_chrIII_sequence_crisprots AS b FROM scored_guides WHERE NOT isnan(deepcpf1_score))
SELECT 'at least' AS how, chr, count(*) AS rows FROM s WHERE a >= 50 AND b >= 0.5 GROUP BY chr UNION ALL SELECT 'above', chr, count(*) FROM s WHERE a > 50 AND b > 0.5 GROUP BY chr""",
    "rank_top": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank_no FROM orders QUALIFY rank_no <= 3",
    "rank_percent": "WITH p AS (SELECT on_count::DOUBLE AS n, (rank() OVER (ORDER BY on_count) + (count(*) OVER (PARTITION BY on_count) - 1) / 2.0::DOUBLE) / (SELECT count(on_count) FROM guide_sidecar) * 100 AS p FROM guide_sidecar WHERE on_count IS NOT NULL) SELECT n, round_even(p, 2) AS n_pct, count(*) AS rows FROM p GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*) FROM guide_sidecar WHERE on_count IS NULL HAVING count(*) > 0",
    "rank_spaced": _R + """, p AS (SELECT *, row_number() OVER (PARTITION BY region_set, chrom ORDER BY s, e) AS k FROM (SELECT DISTINCT region_set, chrom, s, e FROM r WHERE region_kind = 'peak')),
z AS (WITH RECURSIVE w AS (SELECT region_set, chrom, s, e, k, true AS kept, e AS reach FROM p WHERE k = 1 UNION ALL SELECT p.region_set, p.chrom, p.s, p.e, p.k, p.s > w.reach + 1000, CASE WHEN p.s > w.reach + 1000 THEN p.e ELSE w.reach END FROM w JOIN p ON p.region_set = w.region_set AND p.chrom = w.chrom AND p.k = w.k + 1) SELECT * FROM w)
SELECT region_set, chrom, s AS start, e AS "end" FROM z WHERE kept""",
    "rank_counts": _COUNTS + "SELECT n AS rows, count(*) AS targets FROM c GROUP BY n",
    "rank_count_summary": _COUNTS + "SELECT count(*) AS targets, count(*) FILTER (n = 0) AS without, min(n) AS least, max(n) AS largest, median(n) AS median_all, median(n) FILTER (n > 0) AS median_some FROM c",
    "rank_without": "SELECT DISTINCT guide_id FROM guide_sidecar WHERE guide_id IS NOT NULL AND guide_id NOT IN (SELECT guide_id FROM ot_records WHERE guide_id IS NOT NULL)",
    "rank_buckets": """WITH c AS (SELECT count(*) AS n FROM ot_records WHERE guide_id IS NOT NULL GROUP BY guide_id)
SELECT CASE WHEN n <= 2 THEN n::VARCHAR WHEN n <= 4 THEN '3-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' WHEN n <= 49 THEN '20-49' ELSE '50+' END AS bucket, count(*) AS guides FROM c GROUP BY ALL""",
    "rank_correlation": """WITH r AS (SELECT cfd AS a, cfd2 AS b, rank() OVER (ORDER BY cfd) + (count(*) OVER (PARTITION BY cfd) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY cfd2) + (count(*) OVER (PARTITION BY cfd2) - 1) / 2.0::DOUBLE AS rb FROM ot_records WHERE cfd IS NOT NULL AND cfd2 IS NOT NULL)
SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 4) AS spearman, count(*) AS rows FROM r""",
    "expr_wide": """WITH w AS (SELECT user_id, list_sort([v FOR v IN [sum(value) FILTER (event_type = 'click'), sum(value) FILTER (event_type = 'view'), sum(value) FILTER (event_type = 'purchase'), sum(value) FILTER (event_type = 'signup'), sum(value) FILTER (event_type = 'error')] IF v IS NOT NULL]) AS v FROM events WHERE event_type IS NOT NULL GROUP BY user_id)
SELECT user_id, round_even(v[1], 3) AS tscript_min, round_even(v[-1], 3) AS tscript_max, round_even(CASE WHEN len(v) > 0 THEN (v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2 END, 3) AS tscript_median, round_even(list_sum(v) / nullif(len(v), 0), 3) AS tscript_mean FROM w""",
    "expr_outer": "SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id",
    "expr_top": "SELECT s_suppkey::VARCHAR AS transcript_id, s_nationkey AS gene_id, s_acctbal AS tscript_mean FROM supplier WHERE s_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey::VARCHAR) <= 2",
    "best_window": """WITH w AS (SELECT user_id, event_id AS first, last_value(event_id) OVER f AS last, avg(value) OVER f AS mean, count(*) OVER f AS n FROM events WHERE value IS NOT NULL WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT user_id, first, last, round(mean, 6) AS mean FROM w WHERE n = 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, first) = 1""",
    "track_offsets": "SELECT doc_id, (7 + coalesce(sum(strlen(concat_ws(chr(9), doc_id::VARCHAR, path)) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM documents",
    "track_lists": """WITH t AS (SELECT guide_id, concat_ws(';', chrom || ':' || start, mm::VARCHAR) AS t, cfd FROM ot_records WHERE guide_id IS NOT NULL AND start IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY guide_id ORDER BY cfd DESC NULLS LAST, t) AS r, count(*) OVER (PARTITION BY guide_id) AS n FROM t)
SELECT guide_id, any_value(n) AS off_targets, CASE WHEN any_value(n) <= 2000 THEN string_agg(t, '|' ORDER BY r) FILTER (r <= 100) ELSE '' END AS list FROM k GROUP BY guide_id""",
    "ids_tidied": r"""WITH g AS (SELECT nullif(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS id, upper(sequence) AS q FROM gscan_output), n AS (SELECT id, q, replace(q, 'N', '') AS b FROM g WHERE id IS NOT NULL)
SELECT id, count(DISTINCT q) AS sequences, max((length(b) - length(translate(b, 'GC', ''))) * 100.0::DOUBLE / nullif(length(b), 0))::DECIMAL(10, 4)::DOUBLE AS gc FROM n GROUP BY id""",
    "join_on_off": "WITH a AS (SELECT DISTINCT contig, 1 AS x FROM combine_on_off WHERE contig IS NOT NULL), b AS (SELECT DISTINCT contig, 1 AS y FROM flashfry_raw WHERE contig IS NOT NULL) SELECT CASE WHEN x IS NULL THEN 'second' WHEN y IS NULL THEN 'first' ELSE 'both' END AS side, count(*) AS rows FROM a FULL JOIN b USING (contig) GROUP BY ALL",
    "join_guides": """WITH s AS (SELECT DISTINCT guide_id FROM guide_sidecar), t AS (SELECT guide_id, count(*) AS hits FROM ot_records WHERE guide_id IS NOT NULL GROUP BY guide_id)
SELECT CASE WHEN hits IS NULL THEN 'no hits' WHEN s.guide_id IS NULL THEN 'no guide' ELSE 'both' END AS state, count(*) AS guides, coalesce(sum(hits), 0)::BIGINT AS hits FROM s FULL JOIN t ON s.guide_id = t.guide_id GROUP BY ALL""",
}


def _places(spark, d):
    rows = packed.rewritten(table(spark, d, "flashfry_raw").select("contig", "target", "offTargets"), "offTargets", ",", empty=False).distinct()
    return loci.places(rows)


def loci_places(spark, d):
    return _places(spark, d).groupBy("contig", "mm").agg(F.count(F.lit(1)).alias("places"), F.min("place").alias("first"))


def loci_summary(spark, d):
    matrix = {(p, g, o): round(0.5 + 0.02 * p, 4) for p in range(1, 21) for g in "ACGT" for o in "ACGT" if g != o}
    out = loci.summary(_places(spark, d), matrix)
    return out.select("contig", *(f"mm{i}" for i in range(5)), *(F.round(c, 6).alias(c) for c in ("tttn_score", "tttv_score")), "unique_tttn", "unique_tttv")


def compare_scores(spark, d):
    """Largest score per guide of the records against the other matrix's."""
    records = table(spark, d, "ot_records").where("guide_id is not null")
    one = records.groupBy("guide_id").agg(F.max("cfd").alias("score"))
    two = records.groupBy("guide_id").agg(F.max("cfd2").alias("score"))
    out = loci.compare(one, two, "guide_id", "score", 0.01)
    return out.select("shared", "equal", F.round("largest", 6).alias("largest"), F.round("mean", 6).alias("mean"))


def compare_alleles(spark, d):
    """Guides of the sidecar whose sequence differs between a guide's first and last delivery."""
    rows = table(spark, d, "guide_sidecar").where("sequence is not null")
    first = rows.groupBy("guide_id").agg(F.min(F.struct("loaded_at", "sequence")).alias("x")).select("guide_id", "x.sequence")
    last = rows.groupBy("guide_id").agg(F.max(F.struct("loaded_at", "sequence")).alias("x")).select("guide_id", "x.sequence")
    both, one, two = loci.allele_specific(first, last, "guide_id", "sequence", 1)
    n = lambda df, k: df.agg(F.lit(k).alias("side"), F.count(F.lit(1)).alias("guides"))
    return n(both, "differ").unionAll(n(one, "first")).unionAll(n(two, "last"))


def union_tables(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return loci.union_checked([r, n]).dropDuplicates()


def tasks_remaining(spark, d):
    wanted = table(spark, d, "combine_on_off").select("chrom", "strand").distinct()
    return loci.remaining(wanted, table(spark, d, "flashfry_raw").select(F.split("contig", ":")[0].alias("chrom"), F.split("contig", ":")[2].alias("strand")), ["chrom", "strand"])


def tile_tasks(spark, d):
    """Covered stretches of each chromosome cut into tasks of 20,000 bases."""
    return motif.tile_ranges(region_union(spark, d), "start", "end", 20_000).select("chrom", "start", "task_start", "task_end")


def spec_outer(spark, d):
    """Specificities of two searches side by side; rows without any are left out."""
    a = latest(table(spark, d, "ot_aggregate"), ["id"], ["specificity_tttn"])
    b = table(spark, d, "gscan_output").select(tidy(F.col("id")).alias("id"), "specificity").where("id is not null").groupBy("id").agg(F.max(F.when(~F.isnan("specificity"), F.col("specificity"))).alias("specificity"))
    a = a.withColumn("specificity_tttn", F.when(~F.isnan("specificity_tttn"), F.col("specificity_tttn"))).where("id is not null")
    return annotation.drop_unscored(expression.outer_join([a, b], "id"), ["specificity_tttn", "specificity"])


def orf_blocks(spark, d):
    """Amino acids of all ranges of a region set and chromosome, written as blocks."""
    rows = _regions(spark, d).groupBy("region_set", "chrom").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))), "|").alias("blocks"))
    return rows.select("region_set", "chrom", "blocks", sq.block_aa_length(F.col("blocks")).alias("aa"))


_PLACES = f"""WITH q AS (SELECT DISTINCT contig, target, array_to_string(list_filter({split_sql("offTargets")}, lambda z: z <> ''), ',') AS o FROM flashfry_raw WHERE offTargets IS NOT NULL),
x AS (SELECT contig, target, unnest(regexp_extract_all(o, '[^,<]+(?:<[^>]*>)?')) AS x FROM q),
y AS (SELECT contig, target, regexp_extract(trim(x), '^([ACGTN]+)_([0-9]+)_([0-9]+)(?:<(.*)>)?', 1) AS site, unnest(list_filter(string_split(regexp_extract(trim(x), '^([ACGTN]+)_([0-9]+)_([0-9]+)(?:<(.*)>)?', 4), '|'), lambda z: z <> '')) AS l FROM x),
p AS (SELECT contig, target, site, l[:-3] || ':' || CASE WHEN l[-1:] = 'F' THEN '+' ELSE '-' END AS place, CASE WHEN least(length(target), length(site)) <= 4 THEN 999 ELSE hamming(target[5:least(24, length(target), length(site))], site[5:least(24, length(target), length(site))]) END AS mm FROM y WHERE regexp_full_match(l, '.+\\^[FR]'))
"""
QUERIES |= {f.__name__: f for f in (tile_tasks, spec_outer, orf_blocks, loci_places, loci_summary, compare_scores, compare_alleles, union_tables, tasks_remaining)}
SQL |= {
    "tile_tasks": _R + f"SELECT chrom, s AS start, t AS task_start, least(e, t + 20000) AS task_end FROM (SELECT chrom, s, e, unnest(range(s, e, 20000)) AS t FROM ({_merged(_EXON + ' UNION ALL ' + _PEAK, 'chrom')}))",
    "spec_outer": r"""WITH a AS (SELECT id, CASE WHEN NOT isnan(specificity_tttn) THEN specificity_tttn END AS specificity_tttn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS r FROM ot_aggregate WHERE id IS NOT NULL) WHERE r = 1),
b AS (SELECT nullif(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS id, max(CASE WHEN NOT isnan(specificity) THEN specificity END) AS specificity FROM gscan_output GROUP BY 1)
SELECT id, specificity_tttn, specificity FROM a FULL JOIN (SELECT * FROM b WHERE id IS NOT NULL) USING (id) WHERE specificity_tttn IS NOT NULL OR specificity IS NOT NULL""",
    "orf_blocks": _R + """, b AS (SELECT region_set, chrom, list_sort(list(DISTINCT s || '-' || e)) AS l FROM r GROUP BY region_set, chrom)
SELECT region_set, chrom, array_to_string(l, '|') AS blocks, list_sum(list_transform(l, lambda x: string_split(x, '-')[2]::BIGINT - string_split(x, '-')[1]::BIGINT + 1))::BIGINT // 3 - 1 AS aa FROM b""",
    "loci_places": _PLACES + "SELECT contig, mm::INTEGER AS mm, count(*) AS places, min(place) AS first FROM p GROUP BY contig, mm",
    "loci_summary": _PLACES + r""", s AS (SELECT *, list_product(list_transform(range(1, 21), lambda i: CASE WHEN target[i + 4] = site[i + 4] THEN 1.0::DOUBLE ELSE round(0.5 + 0.02 * i, 4)::DOUBLE END)) AS cfd,
  mm = 0 AND place IS DISTINCT FROM (CASE WHEN string_split(contig, ':')[2]::BIGINT - (CASE WHEN string_split(contig, ':')[3] = '+' THEN 1 ELSE 21 END) >= 1 THEN string_split(contig, ':')[1] || ':' || (string_split(contig, ':')[2]::BIGINT - (CASE WHEN string_split(contig, ':')[3] = '+' THEN 1 ELSE 21 END)) || ':' || string_split(contig, ':')[3] END) AS other FROM p WHERE mm <= 4),
a AS (SELECT contig, count(*) FILTER (mm = 0) AS mm0, count(*) FILTER (mm = 1) AS mm1, count(*) FILTER (mm = 2) AS mm2, count(*) FILTER (mm = 3) AS mm3, count(*) FILTER (mm = 4) AS mm4, sum(cfd) AS n, sum(CASE WHEN starts_with(site, 'TTTT') THEN 0 ELSE cfd END) AS v,
  bool_or(other) AS o, bool_or(other AND regexp_matches(site, '^TTT[ACG]')) AS ov, bool_or(other AND starts_with(site, 'TTTT')) AS ot FROM s GROUP BY contig)
SELECT contig, mm0, mm1, mm2, mm3, mm4, round(CASE WHEN n > 0 THEN 1 / n END, 6) AS tttn_score, round(CASE WHEN v > 0 THEN 1 / v END, 6) AS tttv_score, NOT o AS unique_tttn, (NOT o OR (NOT ov AND ot)) AS unique_tttv FROM a""",
    "compare_scores": "WITH m AS (SELECT max(cfd) AS a, max(cfd2) AS b FROM ot_records WHERE guide_id IS NOT NULL GROUP BY guide_id) SELECT count(*) AS shared, count(*) FILTER (abs(a - b) <= 0.01) AS equal, round(max(abs(a - b)), 6) AS largest, round(avg(abs(a - b)), 6) AS mean FROM m",
    "compare_alleles": """WITH r AS (SELECT * FROM guide_sidecar WHERE sequence IS NOT NULL), f AS (SELECT guide_id, arg_min(sequence, (loaded_at, sequence)) AS s FROM r GROUP BY guide_id), l AS (SELECT guide_id, arg_max(sequence, (loaded_at, sequence)) AS s FROM r GROUP BY guide_id)
SELECT 'differ' AS side, count(*) AS guides FROM f JOIN l USING (guide_id) WHERE f.s <> l.s UNION ALL SELECT 'first', count(*) FROM f ANTI JOIN l USING (guide_id) UNION ALL SELECT 'last', count(*) FROM l ANTI JOIN f USING (guide_id)""",
    "union_tables": "SELECT r_regionkey AS k, r_name AS name FROM region UNION SELECT n_nationkey, n_name FROM nation",
    "tasks_remaining": "WITH d AS (SELECT DISTINCT string_split(contig, ':')[1] AS chrom, string_split(contig, ':')[3] AS strand FROM flashfry_raw) SELECT DISTINCT chrom, strand FROM combine_on_off c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.chrom = c.chrom AND d.strand = c.strand)",
}

SQL["track_rows"] = r"""WITH l AS (SELECT contig, chrom, start, strand, CASE WHEN NOT isnan(deepcpf1_score) THEN deepcpf1_score END AS eff, CASE WHEN NOT isnan(TTTV_enCas12a_aggregated_score) THEN TTTV_enCas12a_aggregated_score END AS spec
  FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC) AS r FROM combine_on_off) WHERE r = 1),
p AS (SELECT eff, round_even((min(k) + max(k)) / 2.0::DOUBLE / any_value(n) * 100, 2) AS pct FROM (SELECT eff, row_number() OVER (ORDER BY eff) AS k, count(*) OVER () AS n FROM l WHERE eff IS NOT NULL) GROUP BY eff),
t AS (SELECT id, dropped, list_transform(range(1, 4), lambda i: coalesce(CASE WHEN regexp_full_match(trim(a[i]), '[+-]?[0-9]+') THEN try_cast(a[i] AS INTEGER) END, 0)) AS m FROM (SELECT *, @SPLIT@ AS a, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS r FROM ot_aggregate) WHERE r = 1),
j AS (SELECT l.*, p.pct, t.dropped, coalesce(t.m, [0, 0, 0]) AS m FROM l LEFT JOIN p ON p.eff = l.eff LEFT JOIN t ON t.id = l.contig)
SELECT contig AS name, CASE WHEN strand = '+' THEN start - 4 ELSE start END AS chromStart, CASE WHEN strand = '+' THEN start + 23 ELSE start + 27 END AS chromEnd, least(1000, greatest(0, coalesce(round_even(spec * 100, 0), 0)))::INTEGER AS score,
  CASE WHEN coalesce(dropped = 1, false) OR m[1] > 0 THEN '150,150,150' WHEN m[2] > 0 OR m[3] > 0 THEN '120,120,120' WHEN coalesce(spec * 100, 0) <= 55 THEN '200,0,0' WHEN coalesce(pct, 0) < 50 THEN '255,100,100' WHEN pct < 75 THEN '255,255,0' ELSE '0,200,0' END AS itemRgb,
  round_even(pct, 0)::INTEGER || '% (' || printf('%.4f', eff) || ')' AS shown FROM j""".replace("@SPLIT@", split_sql("mismatch_counts", False))
