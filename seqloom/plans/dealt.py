"""Queries of the general dealt problems (1, 4 and 5), with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import quoted, spread, table, tidy
from seqloom.operators import packed, periods, skew

#: Columns that tell rows apart; ``loaded_at`` is left out, resent rows count once.
RECORD = ["chrom", "start", "strand", "mm", "cfd", "cfd2", "run_id"]
MATCH = ["sequence", "match_chrm", "match_position", "match_strand", "match_distance", "specificity"]
DOMINANT_SHARE = 0.01

LISTS = {
    "combine_on_off": ("contig", ["0-mismatch", "1-mismatch", "2-mismatch", "3-mismatch", "4-mismatch"]),
    "flashfry_raw": ("contig", ["offTargets"]),
    "ot_aggregate": ("id", ["mismatch_counts"]),
}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    records = skew.dominant_keys(table(spark, d, "ot_records"), "guide_id", RECORD, DOMINANT_SHARE)
    matches = skew.dominant_keys(table(spark, d, "gscan_output").withColumn("id", tidy(F.col("id"))), "id", MATCH, DOMINANT_SHARE)
    one = records.select(F.lit("ot_records").alias("tbl"), F.col("guide_id").cast("string").alias("key_value"))
    return one.unionAll(matches.select(F.lit("gscan_output").alias("tbl"), F.col("id").alias("key_value")))


def p1_guides(spark: SparkSession, d: str) -> DataFrame:
    """Off-target results of every guide over all records, hot guides included."""
    out = skew.key_report(
        table(spark, d, "ot_records"), "guide_id",
        sums={"cfd_sum": "cfd", "cfd2_sum": "cfd2"}, distinct={"chroms": "chrom", "mms": "mm"}, modes={"usual_mm": "mm"},
        shares={"cfd_median": ("cfd", 0.5), "cfd_p90": ("cfd", 0.9)},
    )
    return out.withColumns({"cfd_sum": F.round("cfd_sum", 4), "cfd2_sum": F.round("cfd2_sum", 4), "usual_mm": F.coalesce("usual_mm", F.lit(-1))})


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches, contigs and specificity of every id of the scan output."""
    rows = table(spark, d, "gscan_output").withColumn("id", tidy(F.col("id")))
    out = skew.key_report(rows, "id", sums={"distance_sum": "match_distance"}, distinct={"contigs": "match_chrm"}, modes={"usual_distance": "match_distance"}, shares={"specificity_median": ("specificity", 0.5)})
    return out.where(F.col("id").isNotNull()).withColumn("usual_distance", F.coalesce("usual_distance", F.lit(-1)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "bed_regions").withColumn("chrom", periods.tidy_chrom(F.col("chrom")))
    return periods.periods_and_gaps(regions, ["region_set", "chrom"])


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Covered and uncovered length of every region set and chrom."""
    rows = p4_found(spark, d).withColumn("len", F.col("seg_end") - F.col("seg_start"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("len"))), F.lit(0))
    return rows.groupBy("region_set", "chrom").agg(F.sum((F.col("kind") == "merged").cast("long")).alias("periods"), of("merged").alias("covered"), of("gap").alias("uncovered"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, (key, fields) in LISTS.items():
        stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("cell")) for f in fields))).alias("x")
        rows = spread(table(spark, d, name).select(key, *(quoted(f) for f in fields))).select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), stacked).select("tbl", "row_key", "x.*")
        parts.append(rows.where(F.col("cell").isNotNull()))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).withColumns({"src": F.concat_ws(".", "tbl", "field"), "quotes": F.col("field") != "mismatch_counts"})


def p5_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """What separates values in each source, with score and number of cells."""
    return packed.infer_delimiters(_cells(spark, d), "src", "cell", "quotes").withColumn("score", F.round("score", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return packed.unpack(cells, "src", ["tbl", "row_key", "field"], "cell", "quotes").distinct()


_P1_TIDY = r"nullif(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '')"
_P5_SPLIT = r"""string_split(regexp_replace(regexp_replace(regexp_replace({cell}, {kept} || '|([\s\p{{Z}}]*[,;|/][\s\p{{Z}}]*|[\s\p{{Z}}]+)',
    chr(2) || '\1\2\3' || chr(3) || '\4' || chr(4), 'g'), chr(2) || chr(3) || '[^' || chr(4) || ']+' || chr(4), chr(1), 'g'), '[' || chr(2) || chr(3) || chr(4) || ']', '', 'g'), chr(1))"""
_TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_QUOTED = r"""'"([^"]*)"|''([^'']*)''|(<[^>]*>)'"""
_PLAIN = r"'()()(<[^>]*>)'"


def split_sql(field: str, quotes: bool = True) -> str:
    """SQL for the list of values of a cell in any notation, empty ones included."""
    cell = _TRIM.format(x=f'"{field}"' if quotes else f"""regexp_replace("{field}", '["'']', '', 'g')""")
    return _P5_SPLIT.format(cell=cell, kept=_QUOTED if quotes else _PLAIN)


def _p5_part(name: str, key: str, field: str) -> str:
    return f"""SELECT '{name}' AS tbl, "{key}" AS row_key, '{field}' AS field, {split_sql(field, field != "mismatch_counts")} AS a FROM {name} WHERE "{field}" IS NOT NULL"""


_P5_ROWS = " UNION ALL ".join(_p5_part(n, k, f) for n, (k, fs) in LISTS.items() for f in fs)
_P4 = r"""
WITH r AS (SELECT DISTINCT region_set, regexp_replace(upper(regexp_replace(chrom, '[\s\p{Z}]+', '', 'g')), '^CHR', '') AS c, least(start, "end") AS s, greatest(start, "end") AS e FROM bed_regions
           WHERE region_set IS NOT NULL AND chrom IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND start <> "end"),
m AS (SELECT *, max(e) OVER (PARTITION BY region_set, c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE c <> ''),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY region_set, c ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT region_set, 'chr' || c AS chrom, min(s) AS seg_start, max(e) AS seg_end FROM i GROUP BY region_set, c, k),
n AS (SELECT *, lead(seg_start) OVER (PARTITION BY region_set, chrom ORDER BY seg_start) AS nxt FROM p),
found AS (SELECT region_set, chrom, 'merged' AS kind, seg_start, seg_end FROM n UNION ALL SELECT region_set, chrom, 'gap', seg_end, nxt FROM n WHERE nxt IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_guides": p1_guides, "p1_matches": p1_matches, "p4_found": p4_found, "p4_cover": p4_cover, "p5_found": p5_found, "p5_delimiters": p5_delimiters}

SQL = {
    "p1_found": f"""
WITH a AS (SELECT DISTINCT guide_id, {', '.join(RECORD)} FROM ot_records WHERE guide_id IS NOT NULL),
b AS (SELECT DISTINCT {_P1_TIDY} AS k, {', '.join(MATCH)} FROM gscan_output)
SELECT 'ot_records' AS tbl, CAST(guide_id AS VARCHAR) AS key_value FROM a GROUP BY guide_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM a)
UNION ALL SELECT 'gscan_output', k FROM b WHERE k IS NOT NULL GROUP BY k HAVING count(*) >= 0.01 * (SELECT count(*) FROM b WHERE k IS NOT NULL)""",
    "p1_guides": """
WITH m AS (SELECT guide_id, mm AS usual_mm FROM (SELECT guide_id, mm, row_number() OVER (PARTITION BY guide_id ORDER BY count(*) DESC, mm) AS r FROM ot_records WHERE mm IS NOT NULL GROUP BY guide_id, mm) WHERE r = 1)
SELECT o.guide_id, count(*) AS rows, round(sum(cfd), 4) AS cfd_sum, round(sum(cfd2), 4) AS cfd2_sum, count(DISTINCT chrom) AS chroms, count(DISTINCT mm) AS mms, coalesce(any_value(m.usual_mm), -1) AS usual_mm,
  quantile_disc(cfd, 0.5) AS cfd_median, quantile_disc(cfd, 0.9) AS cfd_p90
FROM ot_records o LEFT JOIN m ON m.guide_id = o.guide_id WHERE o.guide_id IS NOT NULL GROUP BY o.guide_id""",
    "p1_matches": f"""
WITH g AS (SELECT * REPLACE ({_P1_TIDY} AS id) FROM gscan_output),
m AS (SELECT id, match_distance AS usual_distance FROM (SELECT id, match_distance, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, match_distance) AS r FROM g WHERE match_distance IS NOT NULL GROUP BY id, match_distance) WHERE r = 1)
SELECT g.id, count(*) AS rows, sum(match_distance)::BIGINT AS distance_sum, count(DISTINCT match_chrm) AS contigs, coalesce(any_value(m.usual_distance), -1) AS usual_distance, quantile_disc(CASE WHEN NOT isnan(specificity) THEN specificity END, 0.5) AS specificity_median
FROM g LEFT JOIN m ON m.id = g.id WHERE g.id IS NOT NULL GROUP BY g.id""",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_cover": _P4 + "SELECT region_set, chrom, CAST(count(*) FILTER (kind = 'merged') AS BIGINT) AS periods, CAST(coalesce(sum(seg_end - seg_start) FILTER (kind = 'merged'), 0) AS BIGINT) AS covered, CAST(coalesce(sum(seg_end - seg_start) FILTER (kind = 'gap'), 0) AS BIGINT) AS uncovered FROM found GROUP BY region_set, chrom",
    "p5_found": f"SELECT DISTINCT tbl, row_key, field, CAST(pos AS INTEGER) AS pos, a[pos] AS item FROM (SELECT tbl, row_key, field, a, unnest(range(1, len(a) + 1)) AS pos FROM ({_P5_ROWS})) WHERE a[pos] <> ''",
}
