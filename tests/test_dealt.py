"""Problems 1, 4 and 5: nulls, empty and very long values, ties, repeated rows, empty tables, clashing columns."""

import random
import statistics

from pyspark.sql import functions as F

from seqloom.operators import packed, periods, skew

REC = "key string, v double, c string, weight int, `__k` string"


def test_key_report_of_hot_keys_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.choice([None, float("nan"), round(rng.gauss(0, 3), 1)]), rng.choice(["a", "b", None]), 1, "x") for _ in range(900)]
    rows += [(None, 1.0, "a", 1, "x"), ("nulls", None, None, None, None)] + rows[:50]
    got = {r.key: r for r in skew.key_report(spark.createDataFrame(rows, REC), "key", {"s": "weight"}, {"d": "c"}, {"m": "c"}, {"med": ("v", 0.5), "p90": ("v", 0.9)}).collect()}
    assert set(got) == {r[0] for r in rows if r[0]}
    for key, r in got.items():
        own = [x for x in rows if x[0] == key]
        values = sorted(x[1] for x in own if x[1] is not None and x[1] == x[1])
        assert r["rows"] == len(own) and r["d"] == len({x[2] for x in own if x[2]})
        assert r["med"] == (statistics.median_low(values) if values else None)
        assert r["p90"] == (values[-(-len(values) * 9 // 10) - 1] if values else None)
        letters = [x[2] for x in own if x[2]]
        assert r["m"] == (min(set(letters), key=lambda c: (-letters.count(c), c)) if letters else None)
    assert got["nulls"]["s"] is None


def test_key_results_of_an_empty_table(spark):
    empty = spark.createDataFrame([], REC)
    assert skew.key_report(empty, "key", {"s": "weight"}, {"d": "c"}, {"m": "c"}, {"p": ("v", 0.5)}).count() == 0
    assert skew.dominant_keys(empty, "key", ["v"], 0.01).count() == 0


def test_dominant_keys_count_equal_rows_once_and_leave_null_keys_out(spark):
    rows = [("a", float(i), "x", 1, "") for i in range(60)] + [("b", 1.0, "x", 1, "")] * 500 + [(None, float(i), "x", 1, "") for i in range(1000)] + [(f"s{i}", 0.0, "", 1, "") for i in range(40)]
    got = {r.key: (r["rows"], r["total"]) for r in skew.dominant_keys(spark.createDataFrame(rows, REC), "key", ["v", "c", "weight"], 0.02).collect()}
    assert got == {"a": (60, 101)}


def _merged(rows):
    out = []
    for s, e in sorted((min(a, b), max(a, b)) for a, b in rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_periods_over_tile_borders_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, s, s + rng.choice([1, 3, 8, 40, 300]) * rng.choice([1, 1, -1]), "e") for k in ("a", "b") for s in (rng.randrange(-50, 3000) for _ in range(150))]
    rows += [("a", 5, 5, "e"), (None, 1, 2, "e"), ("a", None, 2, "e"), ("a", 1, None, "e"), ("c", 10, 20, "e"), ("c", 20, 30, "e"), ("c", 31, 40, "e")] + rows[:20]
    df = spark.createDataFrame(rows, "k string, start long, end long, seg_start string")
    got = periods.periods_and_gaps(df, ["k"], tile=64).collect()
    for k in ("a", "b", "c"):
        want = _merged([(s, e) for q, s, e, _ in rows if q == k and s is not None and e is not None and s != e])
        assert sorted((r.seg_start, r.seg_end) for r in got if r.k == k and r.kind == "merged") == want
        assert sorted((r.seg_start, r.seg_end) for r in got if r.k == k and r.kind == "gap") == [(x[1], y[0]) for x, y in zip(want, want[1:])]
    assert {r.k for r in got} == {"a", "b", "c"}
    assert periods.periods_and_gaps(df.limit(0), ["k"]).count() == 0


def test_one_hot_tile_and_many_ranges_of_one_start(spark):
    rows = [("a", i % 7, i % 7 + 1 + i % 50) for i in range(2000)] + [("a", 100 + 2 * i, 101 + 2 * i) for i in range(300)] + [("a", 10, 5000)]
    got = sorted((r.kind, r.seg_start, r.seg_end) for r in periods.periods_and_gaps(spark.createDataFrame(rows[:-1], "k string, start long, end long"), ["k"], tile=1 << 12).collect())
    want = _merged([r[1:] for r in rows[:-1]])
    assert [x[1:] for x in got if x[0] == "merged"] == want and [x[1:] for x in got if x[0] == "gap"] == [(x[1], y[0]) for x, y in zip(want, want[1:])]
    assert [tuple(r) for r in periods.merge_ranges(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], tile=16).collect()] == [("a", 0, 5000)]


def test_ranges_of_odd_distributions(spark):
    values = [0.0] * 500 + [1e300, -1e300, float("inf"), float("-inf")] + [i / 100 for i in range(200)]
    df = spark.createDataFrame([("hot", v, "", 1, "") for v in values] + [("n", None, "", 1, ""), ("n", float("nan"), "", 1, "")], REC)
    bounds = skew.value_ranges(df, ["v"], 64)[0]
    got = {r.v: r.r for r in skew.in_range(df.where("v is not null and not isnan(v)"), "v", bounds, "r").collect()}
    ordered = sorted(got)
    assert all(got[a] <= got[b] for a, b in zip(ordered, ordered[1:])) and got[0.0] % 2 == 1
    assert max(sum(got[v] == k for v in values) for k in got.values() if k % 2 == 0) <= 30
    found = skew.percentiles(skew.compress(df, ["key"], ["v"]), "key", "v", {"low": 0.0, "med": 0.5, "p90": 0.9, "top": 1.0}).collect()
    values.sort()
    assert [tuple(r) for r in found] == [("hot", values[0], values[len(values) // 2 - 1], values[-(-len(values) * 9 // 10) - 1], values[-1])]


def test_chrom_spellings(spark):
    rows = [(x,) for x in ("chrI", "CHR i", " i ", "chr", "", None, "un_k7")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(periods.tidy_chrom(F.col("c"))).collect()]
    assert got == ["chrI", "chrI", "chrI", None, None, None, "chrUN_K7"]


def _unpack(spark, rows):
    df = spark.createDataFrame(rows, "src string, k string, cell string, quotes boolean, pos string, item string")
    return sorted((r.k, r.pos, r.item) for r in packed.unpack(df, "src", ["k"], "cell", "quotes").collect())


def test_unpack_notations(spark):
    usual = [("s", f"u{i}", d.join(["c:1:+", "c:2:-", "c:3:+"]), True, None, None) for i, d in enumerate([",", ";", "|", "/", " ", " ; ", "\t"])]
    cells = ['c:1:+,, c:2:-', ',c:1:+', 'c:1:+;', '"c:1:+,c" | c:2:-', "'c:1:+'", 'T_1_0<a|b>,T_2<c>', '', '  ', None, '"c:1', ",", '"",c:1:+', " ".join(["c:1:+"] * 5000)]
    got = _unpack(spark, usual + [("s", f"x{i:02}", c, True, None, None) for i, c in enumerate(cells)])
    for i in range(7):
        assert [x[1:] for x in got if x[0] == f"u{i}"] == [(1, "c:1:+"), (2, "c:2:-"), (3, "c:3:+")]
    of = lambda i: [x[1:] for x in got if x[0] == f"x{i:02}"]
    assert of(0) == [(1, "c:1:+"), (3, "c:2:-")] and of(1) == [(2, "c:1:+")] and of(2) == [(1, "c:1:+")]
    assert of(3) == [(1, "c:1:+,c"), (2, "c:2:-")] and of(4) == [(1, "c:1:+")] and of(5) == [(1, "T_1_0<a|b>"), (2, "T_2<c>")]
    assert of(6) == of(7) == of(8) == of(10) == [] and of(9) == [(1, '"c:1')] and of(11) == [(2, "c:1:+")]
    assert len(of(12)) == 5000 and of(12)[-1][0] == 5000


def test_unpack_infers_delimiters_per_source(spark):
    rows = [("paths", f"p{i}", f"usr/lib/x{i};usr/bin/y{i}", True, None, None) for i in range(5)] + [("paths", "p9", "usr/lib/z", True, None, None)]
    rows += [("counts", "c", "0;'1;2'", False, None, None), ("counts", "d", "0;3", False, None, None)]
    got = _unpack(spark, rows)
    assert [x for x in got if x[0] == "c"] == [("c", 1, "0"), ("c", 2, "1"), ("c", 3, "2")]
    assert _unpack(spark, []) == []
