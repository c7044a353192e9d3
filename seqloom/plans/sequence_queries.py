"""Sequence functions, motif scans, near matches and their scores over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import latest, spread, table
from seqloom.functions import sequence as sq
from seqloom.operators import motif, offtarget, packed, ranking
from seqloom.plans.dealt import split_sql

NGG = motif.PRESETS["spcas9-ngg"]
TTTN = motif.PRESETS["cas12a-tttn"]
#: Most mismatches of a near match (the engine's default), and of the prescreen (the wrapper's threshold).
RADIUS, SCREEN = 4, 2


def factor(p: int, g: str, o: str) -> float:
    return round(0.2 + 0.03 * p + 0.05 * "ACGT".index(g) + 0.04 * "ACGT".index(o), 4)


#: A small factor matrix for the queries: (position, guide base, off-target base) -> factor, by rule.
MATRIX = {(p, g, o): factor(p, g, o) for p in range(1, 24) for g in "ACGT" for o in "ACGT" if g != o}


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", sq.pseudo_dna(F.col("text")).alias("dna")).where(F.length("dna") > 0)


def _sidecar(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "guide_sidecar"), ["guide_id"], ["id", "chrom", "position", "strand", "sequence", "on_count"])
    return rows.withColumn("sequence", F.upper("sequence"))


def seq_motif_scan(spark, d):
    hits = motif.sites(_dna(spark, d), "dna", NGG, ("doc_id",))
    return hits.groupBy("doc_id", "strand").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("site").alias("different"), F.min("offset").alias("first"), F.max("offset").alias("last"))


def seq_guides(spark, d):
    g = motif.guides(_dna(spark, d), "doc_id", "dna", NGG)
    return g.groupBy("contig", "sense").agg(F.count(F.lit(1)).alias("guides"), F.sum("position").alias("positions"), F.sum("start").alias("starts"), F.sum("cut_start").alias("cuts"), F.max(F.concat("guide", "pam", "context")).alias("last_text"))


def seq_guides_5prime(spark, d):
    g = motif.guides(_dna(spark, d), "doc_id", "dna", TTTN, (0, 3))
    return g.groupBy("contig", "sense").agg(F.count(F.lit(1)).alias("guides"), F.sum("position").alias("positions"), F.sum("start").alias("starts"), F.max(F.concat("guide", "pam", "context")).alias("last_text"))


def seq_chunks(spark, d):
    c = motif.chunks(_dna(spark, d), "doc_id", "dna", 500, 40)
    return c.select(F.col("contig"), "chunk_no", "chunk_start", F.col("core").cast("long").alias("core"), "seq_start", "seq")


def seq_guide_filters(spark, d):
    s = F.col("sequence")
    rows = _sidecar(spark, d).where(s.isNotNull())
    return rows.where(sq.keep_guide(s, (35, 65), True, True, ["GAATTC", "GRCGYC"], "ACG", "TTC")).select("guide_id", F.round(sq.gc_percent(s), 6).alias("gc"))


def seq_scalars(spark, d):
    s = F.col("sequence")
    rows = _sidecar(spark, d).where(sq.is_dna(s, 23))
    return rows.select(
        "guide_id", sq.reverse_complement(s).alias("rc"), sq.pack(s).alias("packed"), sq.unpack(sq.pack(s), 23).alias("unpacked"), sq.bin_key(s, 7).alias("bin"),
        sq.starts_tttt(s).alias("tttt"), sq.starts_tttv(s).alias("tttv"), sq.separate_pairs(s, "AA").alias("aa"), sq.gc_features(s)["gc"].cast("int").alias("gc20"), sq.five_prime_form(s).alias("five"),
        F.round(sq.binding_energy(s), 4).alias("energy"), F.array_join(F.flatten(sq.one_hot(s)), "").alias("hot"), F.array_join(sq.tokens(s, 23), ",").alias("tok"),
    )


def seq_melting(spark, d):
    s = F.col("sequence")
    return _sidecar(spark, d).where(sq.is_dna(s, 23)).select("guide_id", F.round(sq.melting_temperature(s), 4).alias("tm"))


def seq_mismatches(spark, d):
    """Each record's guide sequence against the one of the next guide id."""
    rows = _sidecar(spark, d).where(sq.is_dna(F.col("sequence"), 23)).select("guide_id", "sequence")
    other = rows.select((F.col("guide_id") - 1).alias("guide_id"), F.col("sequence").alias("next"))
    s, n = F.col("sequence"), F.col("next")
    return rows.join(other, "guide_id").select("guide_id", sq.mismatches(s, n).cast("long").alias("chars"), sq.packed_mismatches(sq.pack(s), sq.pack(n)).cast("long").alias("packed"), sq.trimmed_mismatches(s, n).cast("long").alias("trimmed"))


def seq_quantised(spark, d):
    q = sq.quantise(F.col("cfd"))
    return table(spark, d, "ot_records").where("cfd is not null").groupBy(q.alias("q")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.max(sq.dequantise(q)), 9).alias("back"))


def seq_iupac(spark, d):
    """All sequences that the letters of each nation's name stand for, where they are codes of bases."""
    rows = table(spark, d, "nation").select(F.upper("n_name").alias("motif"))
    return rows.select("motif", F.explode(sq.expanded(F.col("motif"))).alias("expanded"))


def seq_long_scan(spark, d):
    """Sites of long contigs, a thousand documents each, read in overlapping chunks, by stretches of 100,000 bases."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "dna"))), lambda x: x["dna"]), "")
    whole = _dna(spark, d).groupBy((F.col("doc_id") / 1000).cast("long").alias("contig")).agg(joined.alias("dna"))
    chunks = motif.chunks(whole, "contig", "dna", 1 << 16, 40)
    hits = motif.sites(chunks, "seq", NGG, ("contig",), **motif.CHUNKED)
    return hits.groupBy("contig", (F.col("offset") / 100_000).cast("long").alias("stretch"), "strand").agg(F.count(F.lit(1)).alias("sites"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.min("site").alias("least"))


def cell_targets(spark, d):
    """Off-targets packed in list cells: different sequences, places and distances per contig."""
    rows = packed.rewritten(table(spark, d, "flashfry_raw").select("contig", "offTargets"), "offTargets", ",", empty=False).distinct()
    x = rows.select("contig", F.explode(sq.cell_targets(F.col("offTargets"))).alias("x"))
    return x.groupBy("contig").agg(F.count(F.lit(1)).alias("sequences"), F.sum("x.count").cast("long").alias("places"), F.sum(F.size("x.loci")).cast("long").alias("loci"), F.max("x.mm").alias("most"))


def cell_mismatch_counts(spark, d):
    c = sq.mismatch_counts(F.col("mismatch_counts"))
    rows = packed.rewritten(table(spark, d, "ot_aggregate").select("id", "mismatch_counts"), "mismatch_counts", ";", quotes=False)
    return rows.where("mismatch_counts is not null").select("id", c[0].alias("mm0"), c[1].alias("mm1"), c[2].alias("mm2")).groupBy("mm0", "mm1", "mm2").agg(F.count(F.lit(1)).alias("rows"))


def cell_attributes(spark, d):
    made = F.concat(F.lit('gene_id "'), F.col("p_brand"), F.lit('"; transcript_id "'), F.col("p_name"), F.lit('"; size='), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", made.alias("a"))
    return rows.select("p_partkey", sq.attribute(F.col("a"), "gene_id").alias("gene"), sq.attribute(F.col("a"), "transcript_id").alias("transcript"), sq.attribute(F.col("a"), "size").alias("size"), sq.attribute(F.col("a"), "none").alias("none"))


def _guide_rows(spark, d) -> DataFrame:
    return _sidecar(spark, d).where(sq.is_dna(F.col("sequence"), 23)).select("guide_id", F.col("sequence").alias("guide"))


#: Last two bases of the motifs of made sites, in turn.
TAILS = ["GG", "AG", "CG", "GA", "TG", "GC", "GT", "TT"]


def _near_sites(spark, d) -> DataFrame:
    """An index of the guides and of copies changed in 4, 3, 2, 1 places (guide_id modulo 5 of them), at one place to three each."""
    s, g = F.col("guide"), F.col("guide_id").cast("long")
    rows = _guide_rows(spark, d)
    k = F.explode(F.sequence(F.lit(0), g % 5))
    copies = rows.select("guide_id", "guide", k.alias("k")).withColumn("changes", F.when(F.col("k") == 0, 0).otherwise((5 - F.col("k")).cast("int")))
    places = F.array(*(((g * 7 + j * 5) % 23 + 1).cast("int") for j in range(4)))
    changed = F.aggregate(F.slice(places, 1, F.col("changes")), s, lambda t, p: F.overlay(t, F.translate(F.substring(s, p, F.lit(1)), "ACGT", "CGTA"), p, F.lit(1)))
    tails = F.array(*(F.lit("A" + t) for t in TAILS))
    made = copies.select(changed.alias("site"), F.element_at(tails, ((g + F.col("k")) % 8 + 1).cast("int")).alias("pam"), F.explode(F.sequence(F.lit(0), (g + F.col("k")) % 3)).alias("offset"))
    return offtarget.index(made.withColumns({"contig": F.lit("c"), "strand": F.lit("+")}), "site", pam="pam")[0]


def _pairs(spark, d) -> DataFrame:
    return offtarget.near_matches(_guide_rows(spark, d), _near_sites(spark, d).select("site", "pam", "loci"), "guide", "site", 23, RADIUS)


def near_pairs(spark, d):
    return _pairs(spark, d).select("guide_id", "site", "pam", F.col("mm").cast("long").alias("mm"), "loci")


def near_search(spark, d):
    """Guides of every twentieth document searched among the sites of all documents: places by distance."""
    found = motif.sites(_dna(spark, d), "dna", NGG, ("doc_id",)).select("doc_id", F.lit("c").alias("contig"), "offset", "strand", motif.protospacer(F.col("site"), NGG).alias("spacer"))
    sites, _ = offtarget.index(found, "spacer")
    guides = found.where("doc_id % 20 = 0").select(F.col("spacer").alias("guide")).distinct()
    return offtarget.near_counts(guides, sites, "guide", "site", "loci", 20, RADIUS)


def near_own(spark, d):
    """Near pairs among the guides of the sidecar themselves."""
    rows = _sidecar(spark, d).where(sq.is_dna(F.col("sequence"), 23))
    sites, _ = offtarget.index(rows.select("sequence", F.col("chrom").alias("contig"), F.col("position").alias("offset"), "strand"), "sequence")
    return offtarget.near_matches(_guide_rows(spark, d), sites.select("site", "loci"), "guide", "site", 23, RADIUS).select("guide_id", "site", F.col("mm").cast("long").alias("mm"), "loci")


def near_prescreen(spark, d):
    return offtarget.prescreen(_guide_rows(spark, d), _near_sites(spark, d), "guide", "site", 23, SCREEN).select("guide_id")


def near_scores(spark, d):
    """Totals of every guide over its near sites, scores with the weight of a site's motif."""
    scored = _pairs(spark, d).withColumn("cfd", offtarget.pair_score(F.col("guide"), F.col("site"), MATRIX, 23) * offtarget.pam_weight(F.col("pam")))
    scored = scored.withColumn("tttv", sq.starts_tttv(F.col("site")))
    out = offtarget.per_guide(scored, ["guide_id"], "cfd", most=RADIUS, tttv="tttv")
    return out.select(
        "guide_id", F.round("cfd_sum", 6).alias("cfd_sum"), F.round("max_cfd", 6).alias("max_cfd"), F.round("tttv_sum", 6).alias("tttv_sum"), F.col("on_count").cast("long").alias("on_count"), F.col("off_count").cast("long").alias("off_count"),
        F.array_join("mm_counts", ";").alias("mm_counts"), F.round(offtarget.specificity(F.col("cfd_sum")), 6).alias("spec"), F.round(offtarget.specificity(F.col("cfd_sum"), F.col("on_count")), 6).alias("spec_own"),
        offtarget.saturated(F.col("on_count"), F.col("off_count"), F.col("cfd_sum"), 8, 0.4).alias("saturated"),
    )


def ots_reaggregate(spark, d):
    out = offtarget.reaggregate(table(spark, d, "ot_records").where("guide_id is not null"), "guide_id", "cfd")
    return out.select("guide_id", F.round("specificity", 6).alias("specificity"), F.round("max_cfd", 6).alias("max_cfd"), "hits")


def ots_capped(spark, d):
    """At most 500 places (the engine's default) per guide and distance, in order of the place."""
    rows = table(spark, d, "ot_records").where("guide_id is not null and mm is not null").withColumn("site", F.concat_ws(":", "chrom", F.lpad(F.col("start").cast("string"), 10, "0")))
    out = offtarget.capped(rows, ["guide_id"], "site", 500)
    return out.select("guide_id", "mm", "site").distinct()


def ots_floor(spark, d):
    rows = offtarget.floored(table(spark, d, "ot_records").where("mm is not null"), 0.023, ["cfd", "cfd2"])
    return rows.groupBy("chrom", "mm").agg(F.count(F.lit(1)).alias("rows"))


def ots_unique_guides(spark, d):
    rows = _sidecar(spark, d).where(sq.is_dna(F.col("sequence"), 23))
    return ranking.unique_only(rows, ["sequence"]).select("guide_id", "sequence")


def ots_first_per_id(spark, d):
    rows = table(spark, d, "gscan_output").where("id is not null")
    order = [F.col(c).asc_nulls_first() for c in ("match_chrm", "match_position", "match_strand", "match_distance", "loaded_at")]
    return ranking.first_per_key(rows, ["id"], order).select("id", "match_chrm", "match_position", "match_distance")


_DNA = "WITH t AS (SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM documents),\n"
_RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"
_SITES = _DNA + """w AS (SELECT doc_id, s, o, substr(s, o + 1, 23) AS x FROM (SELECT doc_id, s, unnest(range(0, length(s) - 22)) AS o FROM t WHERE length(s) >= 23)),
h AS (SELECT doc_id, s, o, '+' AS strand, x AS site FROM w WHERE x[22:23] = 'GG' UNION ALL SELECT doc_id, s, o, '-', reverse(translate(x, 'ACGT', 'TGCA')) FROM w WHERE x[1:2] = 'CC')
"""
_GUIDES = _SITES + """, g AS (SELECT *, CASE WHEN strand = '+' THEN o - 4 ELSE o + 3 - 6 END AS f FROM h),
c AS (SELECT doc_id AS contig, strand AS sense, substr(site, 1, 20) AS guide, substr(site, 21, 3) AS pam, CASE WHEN strand = '+' THEN o + 1 ELSE o + 1 END AS position,
  CASE WHEN strand = '+' THEN o ELSE o + 3 END AS start, CASE WHEN strand = '+' THEN o + 16 ELSE o + 3 + 4 END AS cut_start,
  CASE WHEN strand = '+' THEN substr(s, f + 1, 30) ELSE reverse(translate(substr(s, f + 1, 30), 'ACGT', 'TGCA')) END AS context FROM g WHERE f >= 0 AND f + 30 <= length(s))
"""
_SITES5 = _DNA + """w AS (SELECT doc_id, s, o, substr(s, o + 1, 27) AS x FROM (SELECT doc_id, s, unnest(range(0, length(s) - 26)) AS o FROM t WHERE length(s) >= 27)),
h AS (SELECT doc_id, s, o, '+' AS strand, x AS site FROM w WHERE x[1:3] = 'TTT' UNION ALL SELECT doc_id, s, o, '-', reverse(translate(x, 'ACGT', 'TGCA')) FROM w WHERE x[25:27] = 'AAA'),
g AS (SELECT *, CASE WHEN strand = '+' THEN o ELSE o - 3 END AS f FROM h),
c AS (SELECT doc_id AS contig, strand AS sense, substr(site, 5, 23) AS guide, substr(site, 1, 4) AS pam, CASE WHEN strand = '+' THEN o + 1 ELSE o + 24 END AS position, CASE WHEN strand = '+' THEN o + 4 ELSE o END AS start,
  CASE WHEN strand = '+' THEN substr(s, f + 1, 30) ELSE reverse(translate(substr(s, f + 1, 30), 'ACGT', 'TGCA')) END AS context FROM g WHERE f >= 0 AND f + 30 <= length(s))
"""
_SIDE = "WITH l AS (SELECT guide_id, id, chrom, position, strand, upper(sequence) AS s, on_count FROM (SELECT *, row_number() OVER (PARTITION BY guide_id ORDER BY loaded_at DESC) AS r FROM guide_sidecar) WHERE r = 1),\nv AS (SELECT * FROM l WHERE regexp_full_match(s, '[ACGT]{23}'))"
_HITS = """SELECT guide_id, s AS guide, u.site, u.pam, hamming(s, u.site) AS mm, u.loci FROM v, u WHERE hamming(s, u.site) <= {most}"""
_MADE = _SIDE + f""", c AS (SELECT guide_id::BIGINT AS g, s, unnest(range(0, guide_id::BIGINT % 5 + 1)) AS k FROM v),
x AS (SELECT g, k, s, list_transform(range(0, CASE WHEN k = 0 THEN 0 ELSE 5 - k END), lambda j: (g * 7 + j * 5) % 23 + 1) AS p FROM c),
z AS (SELECT array_to_string(list_transform(range(1, 24), lambda i: CASE WHEN list_contains(p, i) THEN translate(s[i], 'ACGT', 'CGTA') ELSE s[i] END), '') AS site, 'A' || {TAILS!r}[((g + k) % 8 + 1)::INTEGER] AS pam, (g + k) % 3 + 1 AS n FROM x),
u AS (SELECT site, pam, sum(n)::BIGINT AS loci FROM z GROUP BY site, pam)
"""
_NEAR = _MADE + ", p AS (" + _HITS.format(most=4) + ")\n"
_SCREEN = _MADE + ", p AS (" + _HITS.format(most=2) + ")\n"
_OWN = _SIDE + ", u AS (SELECT s AS site, '' AS pam, count(*) AS loci FROM v GROUP BY s), p AS (" + _HITS.format(most=4) + ")\n"
_PENALTY = "(0.2 + 0.03 * i + 0.05 * (instr('ACGT', guide[i]) - 1) + 0.04 * (instr('ACGT', site[i]) - 1))"
_WEIGHT = "CASE pam[2:3] " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in sq.PAM_TAIL.items()) + " ELSE 0 END"
_CODES = "(VALUES " + ", ".join(f"('{k}', {list(v)!r})" for k, v in sq.IUPAC.items()) + ") AS codes(code, bases)"

QUERIES = {f.__name__: f for f in (
    seq_motif_scan, seq_guides, seq_guides_5prime, seq_chunks, seq_guide_filters, seq_scalars, seq_melting, seq_mismatches, seq_quantised, seq_iupac, seq_long_scan, cell_targets, cell_mismatch_counts, cell_attributes,
    near_pairs, near_own, near_search, near_prescreen, near_scores, ots_reaggregate, ots_capped, ots_floor, ots_unique_guides, ots_first_per_id,
)}

_nearest = lambda k: " ".join(f"WHEN '{a}' THEN {v[k]}" for a, v in sq.NEAREST.items())
_hybrid = " ".join(f"WHEN '{a}' THEN {v}" for a, v in sq.HYBRID.items())
_each = lambda case: f"list_sum(list_transform(range(1, 23), lambda i: CASE s[i:i + 1] {case} END))"

SQL = {
    "seq_motif_scan": _SITES + "SELECT doc_id, strand, count(*) AS sites, count(DISTINCT site) AS different, min(o) AS first, max(o) AS last FROM h GROUP BY doc_id, strand",
    "seq_guides": _GUIDES + "SELECT contig, sense, count(*) AS guides, sum(position)::BIGINT AS positions, sum(start)::BIGINT AS starts, sum(cut_start)::BIGINT AS cuts, max(guide || pam || context) AS last_text FROM c GROUP BY contig, sense",
    "seq_guides_5prime": _SITES5 + "SELECT contig, sense, count(*) AS guides, sum(position)::BIGINT AS positions, sum(start)::BIGINT AS starts, max(guide || pam || context) AS last_text FROM c GROUP BY contig, sense",
    "seq_chunks": _DNA + "c AS (SELECT doc_id, s, unnest(range(0, (length(s) - 1) // 500 + 1)) AS k FROM t WHERE length(s) > 0) SELECT doc_id AS contig, k::INTEGER AS chunk_no, k * 500 AS chunk_start, least(500, length(s) - k * 500) AS core, greatest(0, k * 500 - 40) AS seq_start, substr(s, greatest(0, k * 500 - 40) + 1, least(length(s), k * 500 + 540) - greatest(0, k * 500 - 40)) AS seq FROM c",
    "seq_guide_filters": _SIDE + """, f AS (SELECT guide_id, length(translate(s, 'AT', '')) * 100.0 / length(s) AS raw, (length(s) - length(translate(s, 'GC', ''))) * 100.0 / length(s) AS gc, s, 'ACG' || s || 'TTC' AS x FROM l WHERE s IS NOT NULL AND s <> '')
SELECT guide_id, round(gc, 6) AS gc FROM f WHERE gc BETWEEN 35 AND 65 AND NOT contains(s, 'TTTT') AND NOT contains(s, 'GGGGG') AND NOT regexp_matches(x, 'GAATTC|G[AG]CG[CT]C') AND NOT regexp_matches(reverse(translate(x, 'ACGT', 'TGCA')), 'GAATTC|G[AG]CG[CT]C')""",
    "seq_scalars": _SIDE + f"""SELECT guide_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, list_reduce(list_transform(range(1, 24), lambda i: instr('ACGT', s[i]) - 1), lambda a, b: a * 4 + b) AS packed, s AS unpacked, s[1:7] AS bin, starts_with(s, 'TTTT') AS tttt, regexp_matches(s, '^TTT[ACG]') AS tttv,
  ((length(s) - length(replace(s, 'AA', ''))) // 2)::INTEGER AS aa, (20 - length(translate(s[1:20], 'GC', '')))::INTEGER AS gc20, right(reverse(s), 20) AS five, round(3.1 + {_each(_hybrid)}, 4) AS energy,
  array_to_string(list_transform(range(0, 92), lambda i: CASE WHEN s[i // 4 + 1] = 'ACGT'[i % 4 + 1] THEN '1' ELSE '0' END), '') AS hot, '1,' || array_to_string(list_transform(range(1, 24), lambda i: (instr('ATCG', s[i]) + 1)::VARCHAR), ',') AS tok FROM v""",
    "seq_melting": _SIDE + f""", e AS (SELECT guide_id, s, (CASE WHEN s[1] IN ('A', 'T') THEN 1 ELSE 0 END) + (CASE WHEN s[23] IN ('A', 'T') THEN 1 ELSE 0 END) AS k FROM v)
SELECT guide_id, round(1000.0 * ({_each(_nearest(0))} + k * 2.3 + (2 - k) * 0.1) / ({_each(_nearest(1))} + k * 4.1 + (2 - k) * -2.8 + 0.368 * 22 * ln(0.05) + 1.987 * ln(12.5e-9)) - 273.15, 4) AS tm FROM e""",
    "seq_mismatches": _SIDE + "SELECT a.guide_id, hamming(a.s, b.s) AS chars, hamming(a.s, b.s) AS packed, hamming(a.s[5:], b.s[5:]) AS trimmed FROM v a JOIN v b ON b.guide_id = a.guide_id + 1",
    "seq_quantised": "WITH q AS (SELECT round(greatest(0, least(1, cfd)) * 65535)::INTEGER AS q FROM ot_records WHERE cfd IS NOT NULL) SELECT q, count(*) AS rows, round(q / 65535.0::DOUBLE, 9) AS back FROM q GROUP BY q",
    "seq_iupac": f"""WITH RECURSIVE e AS (SELECT DISTINCT upper(n_name) AS motif, regexp_replace(upper(n_name), '[^ACGTRYSWKMBDHVN]', '', 'g') AS left_, '' AS made FROM nation
UNION ALL SELECT motif, left_[2:], made || b FROM (SELECT motif, left_, made, unnest(bases) AS b FROM e JOIN {_CODES} ON left_[1] = code WHERE left_ <> ''))
SELECT motif, made AS expanded FROM e WHERE left_ = ''""",
    "seq_long_scan": _DNA.replace("WITH t AS", "WITH d AS").rstrip(",\n") + """, t AS (SELECT doc_id // 1000 AS contig, string_agg(s, '' ORDER BY doc_id) AS s FROM d GROUP BY doc_id // 1000),
c AS (SELECT contig, b, substr(s, b + 1, 2022) AS s FROM (SELECT contig, s, unnest(range(0, length(s) - 22, 2000)) AS b FROM t)),
w AS (SELECT contig, b + o AS o, substr(s, o + 1, 23) AS x FROM (SELECT contig, b, s, unnest(range(0, length(s) - 22)) AS o FROM c)),
h AS (SELECT contig, o, '+' AS strand, x AS site FROM w WHERE x[22:23] = 'GG' UNION ALL SELECT contig, o, '-', reverse(translate(x, 'ACGT', 'TGCA')) FROM w WHERE x[1:2] = 'CC')
SELECT contig, o // 100000 AS stretch, strand, count(*) AS sites, min(o) AS first, max(o) AS last, min(site) AS least FROM h GROUP BY contig, o // 100000, strand""",
    "cell_targets": f"""WITH r AS (SELECT DISTINCT contig, array_to_string(list_filter({split_sql("offTargets")}, lambda z: z <> ''), ',') AS o FROM flashfry_raw WHERE offTargets IS NOT NULL),
x AS (SELECT contig, unnest(regexp_extract_all(o, '[^,<]+(?:<[^>]*>)?')) AS x FROM r), y AS (SELECT contig, regexp_extract(trim(x), '^([ACGTN]+)_([0-9]+)_([0-9]+)(?:<(.*)>)?', ['site', 'n', 'mm', 'l']) AS h FROM x)
SELECT contig, count(*) AS sequences, sum(try_cast(h.n AS INTEGER))::BIGINT AS places, sum(len(list_filter(string_split(h.l, '|'), lambda z: z <> '')))::BIGINT AS loci, max(try_cast(h.mm AS INTEGER)) AS most FROM y GROUP BY contig""",
    "cell_mismatch_counts": f"""WITH c AS (SELECT {split_sql("mismatch_counts", False)} AS a FROM ot_aggregate WHERE mismatch_counts IS NOT NULL),
m AS (SELECT list_transform(range(1, 4), lambda i: coalesce(CASE WHEN regexp_full_match(trim(a[i]), '[+-]?[0-9]+') THEN try_cast(a[i] AS INTEGER) END, 0)) AS m FROM c)
SELECT m[1] AS mm0, m[2] AS mm1, m[3] AS mm2, count(*) AS rows FROM m GROUP BY ALL""",
    "cell_attributes": "SELECT p_partkey, p_brand AS gene, p_name AS transcript, p_size::VARCHAR AS size, NULL::VARCHAR AS none FROM part",
    "near_pairs": _NEAR + "SELECT guide_id, site, pam, mm, loci FROM p",
    "near_search": _SITES + """, u AS (SELECT site[1:20] AS site, count(*) AS loci FROM h GROUP BY 1), g AS (SELECT DISTINCT site[1:20] AS guide FROM h WHERE doc_id % 20 = 0), p AS (SELECT guide, hamming(guide, site) AS mm, loci FROM g, u WHERE hamming(guide, site) <= 4)
SELECT guide, """ + ", ".join(f"sum(CASE WHEN mm = {i} THEN loci ELSE 0 END)::BIGINT AS mm{i}" for i in range(5)) + " FROM p GROUP BY guide",
    "near_own": _OWN + "SELECT guide_id, site, mm, loci FROM p",
    "near_prescreen": _SCREEN + "SELECT guide_id FROM v WHERE guide_id NOT IN (SELECT guide_id FROM p GROUP BY guide_id HAVING max(mm) > 0 OR sum(loci) FILTER (mm = 0) > 1)",
    "near_scores": _NEAR + f""", s AS (SELECT *, list_product(list_transform(range(1, 24), lambda i: CASE WHEN guide[i] = site[i] THEN 1.0::DOUBLE ELSE round({_PENALTY}, 4)::DOUBLE END)) * {_WEIGHT} AS cfd FROM p),
a AS (SELECT guide_id, coalesce(sum(cfd * loci) FILTER (mm > 0), 0) AS c, max(cfd) FILTER (mm > 0) AS m, coalesce(sum(cfd * loci) FILTER (mm > 0 AND regexp_matches(site, '^TTT[ACG]')), 0) AS t, sum(CASE WHEN mm = 0 THEN loci ELSE 0 END)::BIGINT AS o, sum(CASE WHEN mm > 0 THEN loci ELSE 0 END)::BIGINT AS f,
  sum(CASE WHEN mm = 1 THEN loci ELSE 0 END)::BIGINT AS m1, sum(CASE WHEN mm = 2 THEN loci ELSE 0 END)::BIGINT AS m2, sum(CASE WHEN mm = 3 THEN loci ELSE 0 END)::BIGINT AS m3, sum(CASE WHEN mm = 4 THEN loci ELSE 0 END)::BIGINT AS m4 FROM s GROUP BY guide_id)
SELECT guide_id, round(c, 6) AS cfd_sum, round(m, 6) AS max_cfd, round(t, 6) AS tttv_sum, o AS on_count, f AS off_count, concat_ws(';', greatest(o - 1, 0), m1, m2, m3, m4) AS mm_counts, round(1 / (1 + c), 6) AS spec, round(1 / (greatest(o, 1) + c), 6) AS spec_own, (o + f >= 8 OR c > 1.5) AS saturated FROM a""",
    "ots_reaggregate": "SELECT guide_id, round(1 / (1 + coalesce(sum(cfd), 0)), 6) AS specificity, round(max(cfd), 6) AS max_cfd, count(*) AS hits FROM ot_records WHERE guide_id IS NOT NULL GROUP BY guide_id",
    "ots_capped": "SELECT DISTINCT guide_id, mm, site FROM (SELECT *, dense_rank() OVER (PARTITION BY guide_id, mm ORDER BY site) AS k FROM (SELECT guide_id, mm, chrom || ':' || lpad(start::VARCHAR, 10, '0') AS site FROM ot_records WHERE guide_id IS NOT NULL AND mm IS NOT NULL)) WHERE k <= 500",
    "ots_floor": "SELECT chrom, mm, count(*) AS rows FROM ot_records WHERE mm IS NOT NULL AND greatest(coalesce(cfd, 0), coalesce(cfd2, 0)) >= 0.023 GROUP BY chrom, mm",
    "ots_unique_guides": _SIDE + "SELECT guide_id, s AS sequence FROM v WHERE s IN (SELECT s FROM v GROUP BY s HAVING count(*) = 1)",
    "ots_first_per_id": "SELECT id, match_chrm, match_position, match_distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY match_chrm NULLS FIRST, match_position NULLS FIRST, match_strand NULLS FIRST, match_distance NULLS FIRST, loaded_at NULLS FIRST) AS r FROM gscan_output WHERE id IS NOT NULL) WHERE r = 1",
}
