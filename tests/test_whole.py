"""Queries over small tables of which every row must count, against brute force."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from seqloom import plans
from seqloom.functions import sequence as sq
from seqloom.operators import offtarget
from seqloom.plans.sequence_queries import MATRIX
from seqloom.sinks import writers

DAY = datetime(2024, 1, 1)
NOTATIONS = [",", ";", "|", "/", " ", " , ", "; ", " | ", "\t"]


def _query(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return plans.QUERIES[name](spark, str(folder)).collect()


def _off_target_cells():
    """Cells in every notation by contig, and the (site, count, distance, places) in them."""
    target = "TTTA" + "ACGT" * 5
    sites = [(target, 1, 0, ["chrI:9^F"]), (target[:10] + "A" + target[11:], 2, 1, ["chrII:50^R", "chrX:7^F"]), (target[:10] + "AA" + target[12:], 1, 2, ["chrIII:4^R"])]
    text = [f"{s}_{n}_{m}<{'|'.join(at)}>" for s, n, m, at in sites]
    cells = {f"chrI:{i + 10}:+": d.join(text) for i, d in enumerate(NOTATIONS)}
    cells |= {"chrI:60:+": f"\"{text[0]}\", '{text[1]}',{text[2]}", "chrI:70:+": f" {text[0]};;{text[1]} | {text[2]}; "}
    return target, sites, cells


def test_off_target_cells_of_any_notation(spark, tmp_path):
    target, sites, cells = _off_target_cells()
    rows = [(c, target, x) for c, x in cells.items()] + [("chrI:80:+", target, " "), ("chrI:81:+", target, None), ("chrI:82:+", target, "")]
    raw = (rows, "contig string, target string, offTargets string")
    got = {r.contig: (r.sequences, r.places, r.loci, r.most) for r in _query(spark, tmp_path, "cell_targets", flashfry_raw=raw)}
    assert got == {c: (3, sum(s[1] for s in sites), sum(len(s[3]) for s in sites), 2) for c in cells}
    away = [sum(a != b for a, b in zip(target[4:], s[0][4:])) for s in sites]
    got = {(r.contig, r.mm): (r.places, r.first) for r in _query(spark, tmp_path, "loci_places", flashfry_raw=raw)}
    first = lambda at: min(x.replace("^F", ":+").replace("^R", ":-") for x in at)
    assert got == {(c, m): (len(s[3]), first(s[3])) for c in cells for m, s in zip(away, sites)}
    got = {r.contig: (r.mm0, r.mm1, r.mm2, r.mm3, r.mm4) for r in _query(spark, tmp_path, "loci_summary", flashfry_raw=raw)}
    assert got == {c: tuple(sum(len(s[3]) for m, s in zip(away, sites) if m == d) for d in range(5)) for c in cells}


def _changed(rng, s, n):
    at = rng.sample(range(len(s)), n)
    return "".join(rng.choice([b for b in "ACGT" if b != c]) if i in at else c for i, c in enumerate(s))


def test_near_pairs_and_scores_up_to_four_mismatches(spark, tmp_path):
    rng = random.Random(4)
    seqs = []
    for _ in range(12):
        base = "".join(rng.choice("ACGT") for _ in range(23))
        seqs += [base] + [_changed(rng, base, n) for n in (1, 2, 3, 3, 4, 4, 5)]
    seqs += seqs[:3]
    rows = [(i, f"g{i}", "chrI", i, "+", s, 1, DAY) for i, s in enumerate(seqs)]
    side = (rows, "guide_id int, id string, chrom string, position long, strand string, sequence string, on_count int, loaded_at timestamp")
    distance = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = sorted((i, u, distance(s, u), seqs.count(u)) for i, s in enumerate(seqs) for u in set(seqs) if distance(s, u) <= 4)
    assert {w[2] for w in want} == set(range(5))
    got = _query(spark, tmp_path, "near_own", guide_sidecar=side)
    assert sorted((r.guide_id, r.site, r.mm, r.loci) for r in got) == want
    guides = spark.createDataFrame(list(enumerate(seqs)), "guide_id int, guide string")
    sites = spark.createDataFrame([(u, "A" + t, seqs.count(u)) for u, t in zip(sorted(set(seqs)), ["GG", "AG", "TT"] * 99)], "site string, pam string, loci long")
    tail = {s.site: sq.PAM_TAIL.get(s.pam[1:], 0.0) for s in sites.collect()}
    scored = offtarget.near_matches(guides, sites, "guide", "site", 23, 4).withColumn("cfd", offtarget.pair_score(F.col("guide"), F.col("site"), MATRIX, 23) * offtarget.pam_weight(F.col("pam")))
    totals = offtarget.per_guide(scored, ["guide_id"], "cfd").collect()
    assert {r.guide_id for r in totals} == set(range(len(seqs)))
    for r in totals:
        own = [w for w in want if w[0] == r.guide_id]
        score = lambda w: tail[w[1]] * math.prod(MATRIX[p, a, b] for p, (a, b) in enumerate(zip(seqs[w[0]], w[1]), 1) if a != b)
        counts = [sum(w[3] for w in own if w[2] == d) for d in range(5)]
        assert list(r.mm_counts) == [counts[0] - 1, *counts[1:]] and r.off_count == sum(counts[1:]) and r.on_count == counts[0]
        assert abs(r.cfd_sum - sum(score(w) * w[3] for w in own if w[2] > 0)) < 2e-6


def test_orf_blocks_of_all_ranges(spark, tmp_path):
    ranges = [(i * 100, i * 100 + 7 * i + 5) for i in range(1, 30)]
    rows = [("chrI", s, e, "a", "exon", DAY) for s, e in ranges] + [("chrI", e, s, "a", "peak", DAY) for s, e in ranges[:9]] + [("chrI", 10, 40, "b", "exon", DAY)]
    got = {r.region_set: (r.blocks, r.aa) for r in _query(spark, tmp_path, "orf_blocks", bed_regions=(rows, "chrom string, start long, `end` long, region_set string, region_kind string, loaded_at timestamp"))}
    assert got == {"a": ("|".join(sorted(f"{s}-{e}" for s, e in ranges)), sum(e - s + 1 for s, e in ranges) // 3 - 1), "b": ("10-40", 9)}


def test_mismatch_counts_of_any_notation(spark, tmp_path):
    cells = [d.join(["0", "1", "5", "29", "40"]) for d in NOTATIONS] + ['"0|1|5"', "'0/1/5", " 0, 1, \"5\" ", "0;;5;9", "0", "", None]
    rows = [(f"chrI:{i}:+", x, 0, DAY) for i, x in enumerate(cells)]
    aggregate = (rows, "id string, mismatch_counts string, dropped int, loaded_at timestamp")
    got = {(r.mm0, r.mm1, r.mm2): r.rows for r in _query(spark, tmp_path, "cell_mismatch_counts", ot_aggregate=aggregate)}
    assert got == {(0, 1, 5): len(NOTATIONS) + 3, (0, 0, 5): 1, (0, 0, 0): 2}
    on = [(r[0], "chrI", 100 + i, "+", 50.0, 0.9, DAY) for i, r in enumerate(rows)]
    schema = "contig string, chrom string, start long, strand string, deepcpf1_score double, TTTV_enCas12a_aggregated_score double, loaded_at timestamp"
    got = {r.name: r.itemRgb for r in _query(spark, tmp_path, "track_rows", ot_aggregate=aggregate, combine_on_off=(on, schema))}
    near = len(NOTATIONS) + 4
    assert [got[r[0]] == "120,120,120" for r in rows] == [True] * near + [False] * (len(rows) - near)


RECORDS = "guide_id int, chrom string, start long, strand string, mm int, cfd double, cfd2 double, run_id string, loaded_at timestamp"


def test_caps_and_floor_are_the_defaults_of_the_reference(spark, tmp_path):
    rows = [(g, "chrI", i, "+", 2, round(1 - i / 4000, 6), None, "r", DAY) for g, n in ((1, 60), (2, 300), (3, 2000), (4, 2001)) for i in range(n)]
    got = {r.guide_id: (r.off_targets, r.list.split("|") if r.list else []) for r in _query(spark, tmp_path, "track_lists", ot_records=(rows, RECORDS))}
    assert {g: (n, len(x)) for g, (n, x) in got.items()} == {1: (60, 60), 2: (300, 100), 3: (2000, 100), 4: (2001, 0)}
    assert got[3][1][:2] == ["chrI:0;2", "chrI:1;2"]
    got = Counter(r.guide_id for r in _query(spark, tmp_path, "ots_capped", ot_records=(rows, RECORDS)))
    assert got == {1: 60, 2: 300, 3: 500, 4: 500}
    rows = [(1, "chrI", i, "+", 2, x, y, "r", DAY) for i, (x, y) in enumerate([(0.0229, None), (0.023, None), (0.05, 0.01), (None, 0.09), (None, None), (0.1, 0.0)])]
    assert [(r.chrom, r.mm, r.rows) for r in _query(spark, tmp_path, "ots_floor", ot_records=(rows, RECORDS))] == [("chrI", 2, 4)]


SIDECAR = "guide_id int, id string, chrom string, position long, strand string, sequence string, on_count int, loaded_at timestamp"


def test_alleles_of_first_and_last_deliveries(spark, tmp_path):
    a, b = "ACGT" * 5 + "AGG", "ACGT" * 5 + "TGG"
    row = lambda g, s, on, day: (g, f"g{g}", "chrI", 1, "+", s, on, DAY + timedelta(days=day))
    rows = [row(1, a, 1, 0), row(1, b, 1, 1), row(2, a, 2, 5), row(2, b, 1, 9), row(2, a, 3, 7), row(3, a, 1, 0), row(4, a, 1, 0), row(4, a, 2, 2), row(5, None, 3, 1)]
    got = {r.side: r.guides for r in _query(spark, tmp_path, "compare_alleles", guide_sidecar=(rows, SIDECAR))}
    assert got == {"differ": 2, "first": 0, "last": 0}


def test_finished_tasks_of_every_chromosome(spark, tmp_path):
    wanted = [(c, s) for c in ("chrI", "chrV", "chrX") for s in "+-"]
    done = [("chrI:5:+",), ("chrV:7:-",), ("chrX:9:+",), ("chrX:9:-",), (None,)]
    got = _query(spark, tmp_path, "tasks_remaining", combine_on_off=(wanted * 2, "chrom string, strand string"), flashfry_raw=(done, "contig string"))
    assert sorted((r.chrom, r.strand) for r in got) == [("chrI", "-"), ("chrV", "+")]


def test_scalars_encode_the_whole_sequence(spark, tmp_path):
    s = "ACGTTGCAACGGTTCCATGACGA"
    got = _query(spark, tmp_path, "seq_scalars", guide_sidecar=([(1, "g1", "chrI", 1, "+", s.lower(), 1, DAY)], SIDECAR))
    assert got[0].hot == "".join("1" if b == c else "0" for c in s for b in "ACGT")
    assert got[0].tok == ",".join(["1", *(str("ATCG".index(c) + 2) for c in s)])


def test_fasta_split_by_rows(spark, tmp_path):
    rows = [(f"g{i}", "ACGT" * 5, "AGG", "chrI", i, "+", "ACGT" * 9) for i in range(25)]
    guides = spark.createDataFrame(rows, "id string, guide string, pam string, contig string, position long, sense string, context string").coalesce(1)
    writers.guide_fasta(guides, str(tmp_path / "fa"), most_rows=10)
    sizes = [f.read_text().count(">") for f in (tmp_path / "fa").glob("part-*")]
    assert sorted(sizes) == [5, 10, 10]
