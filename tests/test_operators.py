"""Interval, ranking, expression and track operators against brute force, and properties of sequence functions."""

import random
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import sequence as sq
from seqloom.operators import expression, intervals, loci, offtarget, ranking, track

REGION = "chrom string, start long, end long, name string"


@pytest.fixture(scope="module")
def regions(spark):
    rng = random.Random(11)
    make = lambda n: [(rng.choice("xy"), s, s + rng.choice([0, 1, 5, 40, 300]), f"r{i}") for i in range(n) for s in [rng.randrange(0, 2000)]]
    a, b = make(120) + [("z", 1, 5, "only"), (None, 1, 2, "null"), ("x", None, 3, "open")], make(90) + [("x", 0, 2500, "wide")] * 0 + [(None, 1, 2, "null")]
    return a, b, spark.createDataFrame(a, REGION), spark.createDataFrame(b, REGION)


def _meet(p, q):
    if None in (p[0], p[1], p[2]) or p[0] != q[0] or None in q[:3]:
        return False
    (s, e), (u, v) = ((x[1] - (x[1] == x[2]), x[2] + (x[1] == x[2])) for x in (p, q))
    return s < v and u < e


def test_range_joins(regions):
    a, b, da, db = regions
    for tile in (32, 1 << 14):
        got = sorted((r.name, r.r_name) for r in intervals.range_join(da, db, tile=tile).collect())
        assert got == sorted((p[3], q[3]) for p in a for q in b if _meet(p, q))
        semi = sorted(r.name for r in intervals.range_join(da, db, how="semi", tile=tile).collect())
        anti = sorted(r.name for r in intervals.range_join(da, db, how="anti", tile=tile).collect())
        assert semi == sorted(p[3] for p in a if any(_meet(p, q) for q in b)) and sorted(semi + anti) == sorted(p[3] for p in a)


def _bases(rows):
    return {(c, i) for c, s, e, _ in rows if None not in (c, s, e) for i in range(s, e)}


def test_interval_algebra_by_bases(regions):
    a, b, da, db = regions
    got = lambda df: {(r.chrom, i) for r in df.collect() for i in range(r.start, r.end)}
    assert got(intervals.subtract(da, db, tile=64)) == _bases(a) - _bases(b) | {(None, 1)}  # a row of no known chromosome stays
    assert got(intervals.intersect(da, db)) == _bases(a) & _bases(b)
    union = intervals.union([da, db])
    assert got(union) == _bases(a) | _bases(b)
    again = intervals.union([union])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, union.collect()))
    with pytest.raises(ValueError):
        intervals.widen(da, -1, 0)
    assert intervals.subtract(da.limit(0), db).count() == 0 and intervals.subtract(da, db.limit(0)).count() == sum(1 for r in a if None not in r[1:3] and r[1] < r[2])


def test_common_overlap(spark):
    rows = [("g", "t1", 10, 50), ("g", "t2", 20, 60), ("g", "t2", 100, 120), ("g", "t1", 110, 115), ("h", "t1", 1, 5), ("h", "t2", 6, 9), ("k", "t", 3, 4)]
    got = intervals.common_overlap(spark.createDataFrame(rows, "g string, t string, start long, end long"), ["g"], "t").collect()
    assert sorted(map(tuple, got)) == [("g", 20, 50), ("g", 110, 115), ("k", 3, 4)]


def test_greedy_spacing(spark):
    rows = [("t", 0, 20, 1.0), ("t", 5, 25, 0.9), ("t", 5, 25, 0.8), ("t", 40, 60, 0.7), ("t", 0, 20, 0.1), ("u", 0, 20, 0.5)]
    got = ranking.spaced(spark.createDataFrame(rows, "k string, s long, e long, v double").withColumn("o", -F.col("v")), ["k"], ["o", "s"], "s", "e", 10)
    assert sorted((r.k, r.s, r.v) for r in got.collect()) == [("t", 0, 0.1), ("t", 0, 1.0), ("t", 40, 0.7), ("u", 0, 0.5)]


def test_percent_rank_and_running_total(spark):
    rng = random.Random(5)
    values = [rng.choice([None, float("nan"), float(rng.randrange(20))]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    known = sorted(v for v in values if v is not None and v == v)
    for r in ranking.percent_rank(df, ["v"]).collect():
        if r.v is None or r.v != r.v:
            assert r.v_pct is None
        else:
            ranks = [k + 1 for k, x in enumerate(known) if x == r.v]
            assert abs(r.v_pct - sum(ranks) / len(ranks) / len(known) * 100) <= 0.0051
    lines = track.byte_offsets(df.withColumn("t", F.repeat(F.lit("é"), F.col("i") % 7)), "i", F.col("t"), 3, ranges=16).orderBy("i").collect()
    at = 3
    for r in lines:
        assert r.offset == at
        at += 2 * (r.i % 7) + 1


def test_row_statistics_leave_nulls_out(spark):
    r = expression.row_statistics(spark.createDataFrame([(1.0, None, 4.0), (None, None, None)], "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert (r[0].tscript_min, r[0].tscript_max, r[0].tscript_median, r[0].tscript_mean) == (1.0, 4.0, 2.5, 2.5) and r[1].tscript_mean is None and r[1].tscript_median is None


def test_scores(spark):
    matrix = {(1, "A", "C"): 0.5, (3, "G", "T"): 0.2}
    df = spark.createDataFrame([("ACG", "ACG"), ("ACG", "CCG"), ("ACG", "CCT"), ("ACG", "AGG"), ("ACN", "ACG"), ("ACG", None)], "g string, o string")
    got = [r.s for r in df.select(offtarget.pair_score(F.col("g"), F.col("o"), matrix, 3).alias("s")).collect()]
    assert got[:4] == [1.0, 0.5, pytest.approx(0.1), 1.0] and got[4:] == [None, None]
    assert spark.range(1).select(offtarget.pam_weight(F.lit("TGG")), offtarget.pam_weight(F.lit("TAA"))).first() == (1.0, 0.0)
    assert sq.pair_key("rU:dA", True) == ("T", "T") and sq.pair_key("rA:dC", False) == ("A", "C")
    assert sq.expand_motif("NG") == ["AG", "CG", "GG", "TG"] and sq.reverse_motif("TTTV") == "BAAA"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGT", min_size=1, max_size=31), min_size=1, max_size=40))
def test_packing_and_reverse_complement_round_trips(spark, seqs):
    df = spark.createDataFrame([(s, seqs[-1]) for s in seqs], "s string, t string")
    for r in df.select("s", sq.reverse_complement(sq.reverse_complement(F.col("s"))).alias("rr"), sq.pack(F.col("s")).alias("p"), sq.unpack(sq.pack(F.col("s")), 31).alias("u"), sq.mismatches(F.col("s"), F.col("t")).alias("a"), sq.mismatches(F.col("t"), F.col("s")).alias("b")).collect():
        assert r.rr == r.s and r.u == r.s.rjust(31, "A") and r.a == r.b


def test_sequence_edge_cases(spark):
    df = spark.createDataFrame([("",), (None,), ("TTTTGGGGG",)], "s string")
    rows = df.select(sq.gc_percent(F.col("s")).alias("gc"), sq.is_dna(F.col("s")).alias("ok"), sq.reverse_complement(F.col("s")).alias("rc"), sq.keep_guide(F.col("s"), poly_t=True).alias("k"), sq.trimmed_mismatches(F.col("s"), F.lit("AC")).alias("t")).collect()
    assert (rows[0].gc, rows[0].ok, rows[0].rc, rows[0].t) == (None, False, "", 999) and rows[1].ok is False and rows[2].k is False


def _greedy(rows, d):
    chosen, kept = [], []
    for k, s, e, o in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if (s, e) in chosen or not any(s <= b + d and e >= a - d for a, b in chosen):
            chosen.append((s, e))
            kept.append((k, s, e, o))
    return kept


def test_spaced_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(k, s, s + rng.choice([0, 1, 20]), rng.randrange(9)) for k in "ab" for s in (rng.randrange(3000) for _ in range(150))]
    rows += rows[:5] + [("c", 1, 5, 0)]
    df = spark.createDataFrame([*rows, ("a", None, 3, 0), (None, 3, 4, 0)], "k string, s long, e long, o int")
    got = sorted(map(tuple, ranking.spaced(df, ["k"], ["o"], "s", "e", 7).collect()))
    assert got == sorted(x for k in "abc" for x in _greedy([r for r in rows if r[0] == k], 7))
    assert ranking.spaced(df.limit(0), ["k"], ["o"], "s", "e", 7).count() == 0


def test_contained_ranges(regions):
    a, b, da, db = regions
    inside = lambda p, q: None not in (*p[:3], *q[:3]) and p[0] == q[0] and q[1] <= p[1] and p[2] <= q[2]
    for tile in (16, 1 << 14):
        assert sorted(r.name for r in intervals.contained(da, db, tile=tile).collect()) == sorted(p[3] for p in a if any(inside(p, q) for q in b))


def test_statistics_of_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.choice([1.0, 2.0, rng.random() * 4, None, float("nan"), -1.0]), rng.random(), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, w double, i long")
    x, y = ([r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]] for g in "xy")
    u = sum((p > q) + (p == q) / 2 for p in x for q in y)
    got = ranking.mann_whitney(df, "g", "v", "x", "y").first()
    n = len(x) + len(y)
    ties = sum(c**3 - c for c in Counter(x + y).values())
    assert (got.n_a, got.n_b, got.u_a, got.u_b) == (len(x), len(y), u, len(x) * len(y) - u)
    assert got.z == pytest.approx((u - len(x) * len(y) / 2) / (len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1)))) ** 0.5)
    assert ranking.mann_whitney(df.limit(0), "g", "v", "x", "y").first().z is None
    for r in ranking.correlations(df, "g", "v", "w").collect():
        own = pd.DataFrame([(p[1], p[2]) for p in rows if p[0] == r.g and p[1] is not None and p[1] == p[1]])
        assert r["rows"] == len(own) and r.pearson == pytest.approx(own.corr().iloc[0, 1]) and r.spearman == pytest.approx(own.rank().corr().iloc[0, 1])
    shares = {r.column: (r["rows"], r.above) for r in ranking.shares_above(df, ["v", "w"]).collect()}
    full = [r for r in rows if r[1] is not None and r[1] == r[1] and r[1] != -1]
    assert shares == {"v": (len(full), sum(r[1] > 0.2 for r in full)), "w": (len(full), sum(r[2] > 0.2 for r in full))}
    chunks = {r.i: r.chunk for r in ranking.row_chunks(df, "i", 40).collect()}
    assert chunks == {i: i // 40 for i in range(300)}
    assert [r.i for r in ranking.without(df.select("i"), df.where("i > 0").select("i"), "i").collect()] == [0]


def test_sides_and_pairs_of_tables(spark):
    a, b = (spark.createDataFrame([(k, k) for k in ks], f"k int, {n} int") for ks, n in (([1, 2, 2, 3], "x"), ([2, 3, 4], "y")))
    assert {r.side: r["rows"] for r in loci.sides(a, b, "k").collect()} == {"both": 2, "first": 1, "second": 1}
    with pytest.raises(ValueError):
        loci.paired(a, b, "k")
    assert loci.paired(a.where("k in (2, 3)"), b.where("k < 4"), "k").count() == 3
    states = {r.k: r.state for r in offtarget.with_totals(a.distinct(), b, "k").collect()}
    assert states == {1: "no hits", 2: "both", 3: "both", 4: "no guide"}
    assert offtarget.metric("enCas12a") == "cas12a-encas12a" and offtarget.bin_width("15") == 15
    for bad in (lambda: offtarget.metric("x"), lambda: offtarget.bin_width(16)):
        with pytest.raises(ValueError):
            bad()


def test_masks_and_prefixes(spark):
    a, b = "ACGTACGTACGTACGTACGTAGG", "ACCTACGTACGAACGTACGTTGC"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sq.pack(F.col("a")).alias("a"), sq.pack(F.col("b")).alias("b"))
    x, y = F.col("a"), F.col("b")
    got = df.select(sq.packed_mismatches(x, y), sq.packed_mismatches(x, y, sq.compare_mask(20, 3)), sq.packed_mismatches(x, y, sq.compare_mask(20, 3, True)), sq.prefix_mismatches(x, y, 7, 23), sq.prefix_mismatches(x, y, 7, 23, sq.compare_mask(18, 5, True))).first()
    assert tuple(got) == (4, 2, 3, 1, 0 + sum(p != q for p, q in zip(a[5:7], b[5:7])))
