"""Operators on corpora and score tables against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import abuse, aggregation, bpe, hotcold, packing, sketch
from seqloom.llm.words import MASKED, words_of

vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no public vocabulary here")
TEXTS = ["", None, "<|endoftext|> x", "don't we'll 'sx  's\t's'll ''s 'l", " " * 3000 + "a" * 5000, "é中文 　  👍🏽ß٣ it's", "x = {'a': 1}\r\n\r\n\t y", "﻿var  a;\n", "'", "  ", "I'VE we're you've '"]


@vocabulary
def test_ids_equal_those_of_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    rng, signs = random.Random(5), "abst '\n\t\r  ''lldvemre,.-=<|>019é中文 　👍ß٣"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2000)]
    known = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    known.encode_special_tokens = True
    want = [x.ids for x in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = bpe.Encoder(bpe.VOCABULARY)
    assert encoder.encode(pa.array(texts)).to_pylist() == want
    assert encoder.encode(pa.array(texts)[7:], only_counts=True).to_pylist() == [len(x) for x in want[7:]]


@vocabulary
def test_ids_in_a_query(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.got for r in df.select("doc_id", bpe.token_ids(F.col("text")).alias("got")).collect()}
    counts = {r.doc_id: r.n for r in df.select("doc_id", bpe.token_count(F.col("text")).alias("n")).collect()}
    assert got[0] == got[1] == [] and len(got[2]) > 3 and counts == {k: len(v) for k, v in got.items()}
    assert df.limit(0).select(bpe.token_ids(F.col("text"))).count() == 0


def _check_packed(rows, sizes, capacity):
    used, pieces = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.size
        pieces.setdefault(r.id, []).append(r.size)
    assert max(used.values(), default=0) <= capacity
    for i, n in sizes.items():
        assert sum(pieces[i]) == max(n or 0, 0) and len(pieces[i]) == max(1, -(-max(n or 0, 0) // capacity))
    return used


def test_packing_splits_nothing_and_fills(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, None, rng.randrange(1, 60), rng.randrange(1, 250), 100, 100, 37]) for i in range(3000)} | {9001: 100, 9002: 101, 9003: 750, 9004: -5}
    df = spark.createDataFrame([(i, n, 1, "x") for i, n in sizes.items()], "id long, n long, size int, container string")
    rows = packing.pack(df, "id", F.col("n"), 100).collect()
    used = _check_packed(rows, sizes, 100)
    assert len(used) <= -(-sum(used.values()) // 100) * 1.03
    assert {r.id for r in rows if r.oversize} == {i for i, n in sizes.items() if (n or 0) > 100}
    again = packing.pack(df.orderBy(F.desc("id")), "id", F.col("n"), 100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert packing.pack(df.limit(0), "id", F.col("n"), 100).count() == 0
    assert {(r.id, r.pieces) for r in packing.split_items(packing.pack(df, "id", F.col("n"), 100), "id", 100).collect()} == {(i, -(-n // 100)) for i, n in sizes.items() if (n or 0) > 100}
    assert packing.split_items(packing.pack(df.limit(0), "id", F.col("n"), 100), "id", 100).count() == 0
    with pytest.raises(Exception, match="holds too much"):
        packing.split_items(packing.pack(df, "id", F.col("n"), 100), "id", 99).collect()


def test_packing_numbers_crowded_sizes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 40)
    sizes = {i: (50 if i % 3 else 1000) for i in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "id long, n long")
    used = _check_packed(packing.pack(df, "id", F.col("n"), 100).collect(), sizes, 100)
    assert len(used) == -(-sum(sizes.values()) // 100)


def test_fit_is_non_negative_and_close():
    a = packing.patterns(24, 3)
    assert (a @ np.arange(1, 25) == 24).all()
    x = np.zeros(len(a))
    x[[3, 10, 20]] = [50, 7, 80]
    fit = packing.non_negative_fit(a, x @ a, 2000)
    assert (fit >= 0).all() and abs(fit @ a - x @ a).max() < 1


SCORED = "g string, i int, a double, b double, rank_no string, __g string"


def _scored(rng, n):
    return [(None if rng.random() < 0.02 else "hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", i, rng.choice([None, float("nan"), 1.0, round(rng.random(), 2)]), rng.choice([0.0, 1.0, rng.random() * 100]), "x", "y") for i in range(n)]


def test_top_n_hot_and_cold_groups_alike(spark):
    rows = _scored(random.Random(1), 1500)
    df = spark.createDataFrame(rows, SCORED).where("a is not null and not isnan(a)").select("g", "i", "a")
    want = {}
    for r in sorted((r for r in rows if r[2] is not None and r[2] == r[2]), key=lambda r: (-r[2], r[1])):
        own = want.setdefault(r[0], [])
        if len(own) < 5:
            own.append(r[1])
    for heavy in (10, 100, 10_000):
        got = {}
        for r in sorted(hotcold.top_n(df, "g", "a", ["i"], 5, heavy_rows=heavy).collect(), key=lambda r: r.rank_no):
            got.setdefault(r.g, []).append(r.i)
        assert got == want
    assert hotcold.top_n(df.limit(0), "g", "a", ["i"], 5).count() == 0


def test_rank_aggregation_against_brute_force(spark):
    rows = _scored(random.Random(4), 600)
    df = spark.createDataFrame(rows, SCORED)
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[2] == r[2]]
    for heavy in (50, 10_000):
        got = {(r.g, r.i): r for r in aggregation.aggregate_ranks(df, "g", "i", ["a", "b"], heavy_rows=heavy).collect()}
        assert set(got) == {(r[0], r[1]) for r in ok}
        for r in ok:
            own = [x for x in ok if x[0] == r[0]]
            x = sorted((1 + sum(o[k] > r[k] for o in own)) / len(own) for k in (2, 3))
            want = 2 * min(1 - (1 - x[0]) ** 2, x[1] ** 2)
            assert math.isclose(got[r[0], r[1]].significance, want, rel_tol=1e-9)
    best = {r.g: r.i for r in aggregation.leaders(aggregation.aggregate_ranks(df, "g", "i", ["a", "b"]), "g", "i", 2).collect()}
    assert set(best) == {r[0] for r in ok}


def _check_summary(s, ordered):
    v, low, high, n, error, _ = s
    assert n == len(ordered)
    first, last = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
    assert (low <= last).all() and (high >= first).all() and (low <= high).all()
    assert max(np.maximum(r - low, high - r).min() for r in range(1, n, max(1, n // 500))) <= 2 * error * n + 1


def test_summaries_keep_their_error_bound():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=30_000), np.ones(9_000), rng.integers(0, 5, 5_000)])
    rng.shuffle(values)
    parts = [sketch.summarise(x, 100) for x in np.array_split(values, 37)]
    s = sketch.merge_all([sketch.merge_all(parts[:20], 100), sketch.merge_all(parts[20:], 100)], 100)
    assert s[5] == 2 and len(s[0]) <= 901 and s[4] <= sketch.error_bound(100)
    _check_summary(s, np.sort(values))


def test_many_blocks_of_one_partition_keep_the_bound():
    rng = np.random.default_rng(4)
    state, values = sketch.Building(100, buffer=200), []
    for i in range(1500):  # folded through three levels
        x = rng.normal(size=300) + i / 100
        values.append(x)
        state.add(("g", "m"), x)
        assert state.held < 150_000
    ((key, s),) = state.taken()
    assert key == ("g", "m") and s[5] >= 2 and s[4] <= sketch.error_bound(100) and state.held == 0
    _check_summary(s, np.sort(np.concatenate(values)))
    levels = sketch.Levels(50, 4)
    for _ in range(1000):
        levels.add(sketch.summarise(rng.random(100), 50))
    assert max(map(len, levels.of.values())) < 4 and levels.one()[4] <= sketch.error_bound(50)


def test_percentiles_over_partitions(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.random() * 100]), "x") for _ in range(4000)] + [("c", None, "x")]
    df = spark.createDataFrame(rows, "g string, m double, n string").repartition(7)
    got = {(r.g, r.q): r for r in sketch.quantiles(sketch.combine(sketch.summaries(df, "g", ["m"], 50), "g", 50), "g", {50: 0.5, 90: 0.9}).collect()}
    assert {g for g, _ in got} == {"a", "b"}
    for (g, q), r in got.items():
        values = sorted(x[1] for x in rows if x[0] == g and x[1] is not None and x[1] == x[1])
        rank = sum(v <= r.value for v in values)
        assert r.n == len(values) and abs(rank - q / 100 * len(values)) <= r.error * len(values) + 1 and r.error <= 0.05
    assert sketch.combine(sketch.summaries(df.limit(0), "g", ["m"]), "g").count() == 0
    # a task that may hold next to nothing gives away many summaries
    many = spark.createDataFrame([(f"g{i % 300}", float(i), "x") for i in range(6000)], "g string, m double, n string")
    pieces = sketch.summaries(many, "g", ["m"], held=100).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    assert pieces.count() > 2000
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = sketch.quantiles(sketch.combine(pieces, "g"), "g", {50: 0.5}).collect()
    assert {(r.g, r.value, r.n) for r in found} == {(f"g{i}", float(i + 300 * 9), 20) for i in range(300)}


def test_disguised_words():
    assert words_of("pu55y") == words_of("PUSSY") == words_of("pus​sssy")
    assert words_of("brаindеad") == ["braindead"] and words_of("s_____s") == [MASKED] and words_of("d*e") == [MASKED]
    assert words_of("as") == ["as"] and words_of("ass") == words_of("ASSSS") == words_of("a55") == ["ass"] and words_of("stuuupid") == words_of("stupid")
    assert words_of("p.a.t.h.e.t.i.c") == ["pathetic"] and words_of("goodTeam_hasNo9") == ["god", "team", "has", "no9"] and words_of("123") == ["9"]


def test_passages_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        texts = [[rng.choice([-2.0, -0.5, 0.0, 1.0, 2.5]) for _ in range(rng.randrange(12))] for _ in range(4)]
        starts = np.append(0, np.cumsum([len(t) for t in texts]))
        best = abuse.best_passages(np.array([x for t in texts for x in t]), starts)
        for t, b in zip(texts, best):
            assert math.isclose(b, max([0.0] + [sum(t[i:j]) for i in range(len(t)) for j in range(i, len(t) + 1)]), abs_tol=1e-6)
            found = abuse.maximal_passages(t)
            assert math.isclose(max([x[0] for x in found], default=0.0), b, abs_tol=1e-6)
            assert all(a[2] <= b_[1] for a, b_ in zip(found, found[1:]))


def test_abuse_is_learnt_from_reviews_and_found_in_held_out_texts(spark):
    rng = random.Random(6)
    code = lambda: "".join(rng.choice(["int {0}_{1} = read_{1}(n);\n", "// keep {0} near {1} lists\n", "// the useless {0} check is dumb but fast\n", "{0}.push({1});\n"]).format(rng.choice("abcdefgh") * 3, rng.choice("klmnopqr") * 3) for _ in range(12))
    bad = lambda: rng.choice(["// {} you are a us3l3ss moron, nobody likes you\n", "// people like {} should be thrown out of the country\n"]).format(rng.choice(["tovi", "brel", "mkr"]))
    rows = []
    for i in range(700):
        abusive = i % 4 == 0
        rows.append((i, code() + (bad() if abusive else "") + code(), abusive, "s"))
    rows += [(9001, None, False, "s"), (9002, "", False, "s"), (9003, code() * 400 + bad(), True, "s"), (9004, rows[0][1], True, "s")]
    documents = spark.createDataFrame([(i, t, s, "x") for i, t, _, s in rows], "doc_id long, text string, source string, abusive string")
    labels = spark.createDataFrame([(i, int(a)) for i, _, a, _ in rows[:350]] + [(5, None), (6, 1), (9002, 0)], "doc_id long, abusive int")
    model = abuse.train(documents, labels, "doc_id", "text", "abusive")
    got = {r.doc_id: r.s for r in documents.select("doc_id", abuse.passage_scores(F.col("text"), model).alias("s")).collect()}
    held = [(r[2], got[r[0]].passages > 0) for r in rows[350:]]
    assert sum(a and f for a, f in held) >= 0.95 * sum(a for a, _ in held) and sum(f and not a for a, f in held) <= 3
    assert got[9001].score == got[9002].score == 0 and got[9003].passages >= 1 and got[9004] == got[0]
    empty = abuse.train(documents, labels.limit(0), "doc_id", "text", "abusive")
    assert documents.limit(0).select(abuse.passage_scores(F.col("text"), empty)).count() == 0
