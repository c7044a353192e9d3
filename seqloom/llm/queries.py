"""Queries of the problems on text corpora and large score tables, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import cut, latest, quoted, spread, table, tidy
from seqloom.llm import abuse, aggregation, bpe, hotcold, packing, sketch

PERCENTILES = ["deepcpf1_score_pct", "enpam_gb_score_pct", "TTTV_enCas12a_aggregated_score_pct"]
SCORES = ["RS3_score_Chen2013", "specificity_chrIII_sequence_crisprots", "deepcpf1_score", "enpam_gb_score"]
CAPACITY = 2048


def _on_scale(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Percentiles off the scale 0 to 100 (NaN included) as null."""
    return df.withColumns({m: F.when(quoted(m).between(0, 100), quoted(m)) for m in metrics})


def _percentile_rows(spark: SparkSession, d: str) -> DataFrame:
    return _on_scale(latest(table(spark, d, "combine_on_off"), ["contig"], ["chrom", *PERCENTILES]), PERCENTILES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    summary = sketch.combine(sketch.summaries(_percentile_rows(spark, d), "chrom", PERCENTILES), "chrom")
    found = sketch.quantiles(summary, "chrom", {50: 0.5, 90: 0.9})
    low = ((F.col("q") == 50) & (F.col("value") < 35)) | ((F.col("q") == 90) & (F.col("value") < 72))
    return found.where(low).select("chrom", "metric", F.col("q").cast("int").alias("q"))


def p2_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all rows from summaries made per load day and combined, with the bound of their rank error."""
    rows = _on_scale(table(spark, d, "combine_on_off"), PERCENTILES).withColumn("day", F.date_format("loaded_at", "yyyy-MM-dd")).withColumn("key", F.to_json(F.struct("chrom", "day")))
    days = sketch.combine(sketch.summaries(rows.where(F.col("chrom").isNotNull()), "key", PERCENTILES), "key")
    days = days.withColumn("chrom", F.get_json_object("key", "$.chrom")).withColumn("part", F.coalesce(F.datediff(F.to_date(F.get_json_object("key", "$.day")), F.lit("2020-01-01")), F.lit(0)).cast("long")).drop("key")
    return sketch.quantiles(sketch.combine(days, "chrom"), "chrom", {10: 0.1, 50: 0.5, 90: 0.9, 99: 0.99})


def _scored(spark: SparkSession, d: str, values: list[str]) -> DataFrame:
    rows = table(spark, d, "scored_guides").withColumn("target_id", tidy(F.col("target_id"))).where(F.col("target_id").isNotNull())
    return latest(rows, ["target_id", "guide_id"], values)


def _valid_scores(spark: SparkSession, d: str) -> DataFrame:
    rs3, spec, cpf1, pam = SCORES
    return _scored(spark, d, SCORES).withColumns({spec: F.when(F.col(spec).between(0, 1), F.col(spec)), cpf1: F.when(F.col(cpf1).between(0, 100), F.col(cpf1))})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = aggregation.aggregate_ranks(_valid_scores(spark, d), "target_id", "guide_id", SCORES)
    lead = aggregation.leaders(ranked, "target_id", "guide_id", len(SCORES))
    # the exact check: the leader is first on every score, and no other guide is
    return lead.where((F.col("group_size") >= 3) & F.col("leads_all") & (F.col("firsts") == 1)).select("target_id", "guide_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every complete guide's place in its target; guides of equal significance (to 7 digits of its logarithm) share one."""
    ranked = aggregation.aggregate_ranks(_valid_scores(spark, d), "target_id", "guide_id", SCORES)
    scored = ranked.select("target_id", "guide_id", F.round(F.log10("significance"), 7).alias("log_significance")).withColumn("__score", -F.col("log_significance"))
    return hotcold.ranks(scored, "target_id", ["__score"]).select("target_id", "guide_id", "log_significance", F.col("__rank_0").alias("place"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "scored_guides").withColumn("target_id", tidy(F.col("target_id"))).where(F.col("target_id").isNotNull()).withColumn("s", F.when(~F.isnan(SCORES[0]), F.col(SCORES[0])))
    rows = _scored(spark, d, [SCORES[0], "start"]).withColumn("s", F.when(~F.isnan(SCORES[0]), F.col(SCORES[0]))).where(F.col("s").isNotNull()).select("target_id", "guide_id", "start", "s")
    best = hotcold.top_n(rows, "target_id", "s", ["start", "guide_id"], 5, counted=raw.select("target_id", "s"))
    return best.select("target_id", "guide_id", F.col("rank_no").cast("int").alias("rank_no"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", bpe.token_count(F.col("text")), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to split over containers, none of which is overfull."""
    return packing.split_items(cut(_packed(spark, d)), "doc_id", CAPACITY).select("doc_id")


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least number possible, and the share of space filled."""
    full = packing.containers(_packed(spark, d)).agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return full.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("least_possible"), (F.col("tokens") / (F.col("containers") * CAPACITY)).alias("filled"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, p-value and number of significant passages of every document."""
    documents = table(spark, d, "documents")
    model = abuse.train(documents, table(spark, d, "review_labels"), "doc_id", "text", "abusive")
    scored = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", abuse.passage_scores(F.col("text"), model).alias("s"))
    return scored.select("doc_id", "source", "s.score", "s.p_value", "s.passages", (F.col("s.passages") > 0).alias("abusive"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("abusive").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, abusive documents and their share for every source, sources without documents included."""
    counts = p9_scores(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("abusive").alias("abusive"))
    listed = table(spark, d, "doc_sources").select("source").distinct()
    full = listed.join(counts, "source", "full_outer").na.fill(0, ["documents", "abusive"])
    return full.withColumn("rate", F.when(F.col("documents") > 0, F.col("abusive") / F.col("documents")))


_TARGET = r"nullif(regexp_replace(target_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '')"
_GUIDES = f"""
WITH g AS (SELECT * FROM (SELECT * REPLACE ({_TARGET} AS target_id), row_number() OVER (PARTITION BY {_TARGET}, guide_id ORDER BY loaded_at DESC) AS r FROM scored_guides) WHERE r = 1 AND target_id IS NOT NULL),
v AS (SELECT target_id, guide_id, RS3_score_Chen2013 AS a, specificity_chrIII_sequence_crisprots AS b, deepcpf1_score AS c, enpam_gb_score AS d FROM g
  WHERE NOT isnan(RS3_score_Chen2013) AND NOT isnan(enpam_gb_score) AND specificity_chrIII_sequence_crisprots BETWEEN 0 AND 1 AND deepcpf1_score BETWEEN 0 AND 100)
"""
_BETA = "list_min([1 - power(1 - x[1], 4), 6 * power(x[2], 2) * power(1 - x[2], 2) + 4 * power(x[2], 3) * (1 - x[2]) + power(x[2], 4), 4 * power(x[3], 3) * (1 - x[3]) + power(x[3], 4), power(x[4], 4)])"

QUERIES = {
    "p2_found": p2_found, "p2_days": p2_days, "p3_found": p3_found, "p3_ranking": p3_ranking, "p6_found": p6_found,
    "p7_ids": p7_ids, "p8_found": p8_found, "p8_placed": p8_placed, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}

SQL = {
    "p2_found": """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY loaded_at DESC) AS r FROM combine_on_off) WHERE r = 1),
l AS (SELECT chrom, 'deepcpf1_score_pct' AS metric, deepcpf1_score_pct AS v FROM c UNION ALL SELECT chrom, 'enpam_gb_score_pct', enpam_gb_score_pct FROM c
  UNION ALL SELECT chrom, 'TTTV_enCas12a_aggregated_score_pct', TTTV_enCas12a_aggregated_score_pct FROM c),
p AS (SELECT chrom, metric, quantile_disc(v, 0.5) AS m, quantile_disc(v, 0.9) AS h FROM l WHERE v BETWEEN 0 AND 100 AND chrom IS NOT NULL GROUP BY chrom, metric)
SELECT chrom, metric, 50::INTEGER AS q FROM p WHERE m < 35 UNION ALL SELECT chrom, metric, 90 FROM p WHERE h < 72""",
    "p3_found": _GUIDES + """
SELECT x.target_id, x.guide_id FROM v x JOIN (SELECT target_id, count(*) AS n, max(a) AS a, max(b) AS b, max(c) AS c, max(d) AS d FROM v GROUP BY target_id) t
  ON x.target_id = t.target_id AND x.a = t.a AND x.b = t.b AND x.c = t.c AND x.d = t.d WHERE t.n >= 3
  QUALIFY count(*) OVER (PARTITION BY x.target_id) = 1""",
    "p3_ranking": _GUIDES + f""",
r AS (SELECT target_id, guide_id, count(*) OVER w AS n, rank() OVER (w ORDER BY a DESC) AS ra, rank() OVER (w ORDER BY b DESC) AS rb, rank() OVER (w ORDER BY c DESC) AS rc, rank() OVER (w ORDER BY d DESC) AS rd FROM v WINDOW w AS (PARTITION BY target_id)),
s AS (SELECT target_id, guide_id, list_sort([ra / n, rb / n, rc / n, rd / n]) AS x FROM r),
t AS (SELECT target_id, guide_id, round(log10(4 * {_BETA}), 7) AS log_significance FROM s)
SELECT *, rank() OVER (PARTITION BY target_id ORDER BY log_significance) AS place FROM t""",
    "p6_found": f"""
WITH g AS (SELECT * FROM (SELECT * REPLACE ({_TARGET} AS target_id), row_number() OVER (PARTITION BY {_TARGET}, guide_id ORDER BY loaded_at DESC) AS r FROM scored_guides) WHERE r = 1 AND target_id IS NOT NULL)
SELECT target_id, guide_id, row_number() OVER (PARTITION BY target_id ORDER BY RS3_score_Chen2013 DESC, start, guide_id)::INTEGER AS rank_no FROM g
WHERE RS3_score_Chen2013 IS NOT NULL AND NOT isnan(RS3_score_Chen2013) QUALIFY rank_no <= 5""",
}
