"""Near matches of guides among the sites of an index, and scores made of them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.common import quoted
from seqloom.functions import sequence as sq


def index(sites: DataFrame, spacer: str, contig: str = "contig", pam: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Different site sequences with their number of places (``site``, ``packed``, ``loci``), and the places of each.

    A score needs sequence and count alone, so the near-match join runs over
    different sequences and never over repeated places.  ``pam`` names the
    column of the motif beside a site; sites are then told apart by the motif
    too (``pam``), for scores that weigh it.
    """
    rows = sites.where(quoted(spacer).isNotNull())
    beside = [quoted(pam).alias("pam")] if pam else []
    unique = rows.groupBy(quoted(spacer).alias("site"), *beside).agg(F.count(F.lit(1)).alias("loci"))
    places = rows.select(quoted(spacer).alias("site"), *beside, quoted(contig).alias("contig"), "offset", "strand")
    return unique.withColumn("packed", sq.pack(F.col("site"))), places


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` nearly equal stretches of a sequence: (start from 1, length)."""
    cuts = [round(i * length / parts) for i in range(parts + 1)]
    return [(a + 1, b - a) for a, b in zip(cuts, cuts[1:])]


#: Seeds shorter than this join too many pairs that are not near.
SEED = 7
#: Most different guides that every worker gets a table of (8 bytes each); more are joined with the sites by a shuffle.
TABLED = 1 << 20
#: Pairs compared at once, and bits of a seed's number in a table.
PAIRS_AT_ONCE, SEED_BITS = 1 << 21, 20


#: What looking a seed up costs, in comparisons of a pair.
LOOKUP = 3


def agreeing(length: int, most: int, guides: int) -> int:
    """How many segments to choose at once, so that lookups and pairs to compare together cost least for so many guides."""
    cost = lambda k: comb(most + k, k) * (LOOKUP + guides / 4.0 ** (length * k / (most + k)))
    return min((k for k in range(1, 5) if most + k <= length), key=cost)


def _choices(length: int, most: int, agree: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Segments, and the choices of segments of which near sequences agree in one at least.

    Cut into ``most`` + k segments, two sequences with at most ``most``
    different bases agree in k of them at least.  If it isn't given, k is 1, or
    2 where one segment alone would be shorter than ``SEED``.
    """
    if agree is None:
        agree = 1 if length // (most + 1) >= SEED else 2
    parts = segments(length, most + agree)
    return parts, list(combinations(range(len(parts)), agree))


def near_matches(guides: DataFrame, sites: DataFrame, guide: str, site: str, length: int, most: int, tabled: int = TABLED) -> DataFrame:
    """Pairs of a guide row and a site row with at most ``most`` different bases: all columns and ``mm``.

    Rows without a pure sequence of that length (at most 31) have no match.
    Columns of the two sides must differ in name.  The different guides are
    counted first: up to ``tabled`` of them are sent to every worker, where
    sites are looked up as they are read and nothing is shuffled but the pairs;
    more are joined with the sites on common segments.
    """
    if not 0 <= most < length <= 31:
        raise ValueError("the radius must be smaller than the sequence, and that at most 31 bases")
    named = guides.withColumn(guide, F.upper(quoted(guide))).where(sq.is_dna(quoted(guide), length))
    keys = named.select(quoted(guide).alias("k")).distinct().limit(tabled + 1).toArrow()
    if len(keys) > tabled:
        return _joined(named, sites, guide, site, length, most)
    pairs = _looked_up(sites.sparkSession.sparkContext.broadcast(keys.column("k").to_pylist()), sites, guide, site, length, most)
    if len(guides.columns) == 1:  # repeated guides are rows of their own
        repeats = named.groupBy(quoted(guide).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        again = pairs.join(repeats, quoted(guide) == F.col("__k"), "left")
        return again.withColumn("__i", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("__n"), F.lit(1)).cast("int")))).select(quoted(guide), *(quoted(c) for c in sites.columns), "mm")
    return named.join(pairs.withColumnRenamed(guide, "__k"), quoted(guide) == F.col("__k")).drop("__k")


class _Table:
    """Guides by the numbers of their seeds."""

    def __init__(self, guides: list[str], length: int, most: int, agree: int | None = None):
        self.parts, self.choices = _choices(length, most, agree or agreeing(length, most, len(guides)))
        self.length, self.most = length, most
        self.guides = pa.array(sorted(guides), pa.string())
        self.packed = self.pack(self.guides)
        self.masks = [np.uint64(((1 << 2 * n) - 1) << 2 * (length - p - n + 1)) for p, n in self.parts]
        self.by_seed = []
        for choice in self.choices:
            number = self.seed(self.packed, choice)
            order = np.argsort(number, kind="stable")
            bits = min(SEED_BITS, 2 * sum(self.parts[i][1] for i in choice))
            self.by_seed.append((order.astype(np.int32), np.searchsorted(number[order], np.arange((1 << bits) + 1)).astype(np.int32)))

    def pack(self, texts: pa.Array) -> np.ndarray:
        """Two bits a base, the first base highest, of pure sequences of the table's length."""
        codes = np.zeros(256, np.uint64)
        codes[list(b"CGT")] = 1, 2, 3
        if not len(texts):
            return np.empty(0, np.uint64)
        letters = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8).reshape(len(texts), self.length)
        out = np.zeros(len(texts), np.uint64)
        for i in range(self.length):
            out = (out << np.uint64(2)) | codes[letters[:, i]]
        return out

    def seed(self, packed: np.ndarray, choice: tuple[int, ...]) -> np.ndarray:
        """Numbers of ``SEED_BITS`` bits for the bases of a choice of segments: equal bases have equal numbers."""
        out = np.zeros(len(packed), np.uint64)
        for i in choice:
            p, n = self.parts[i]
            out = (out << np.uint64(2 * n)) | ((packed >> np.uint64(2 * (self.length - p - n + 1))) & np.uint64((1 << 2 * n) - 1))
        if 2 * sum(self.parts[i][1] for i in choice) > SEED_BITS:
            out = (out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SEED_BITS)
        return out.astype(np.int64)

    def near(self, packed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of pairs: numbers of sites and guides and their distances; each pair once, at the first choice in which it agrees."""
        for choice, (order, starts) in zip(self.choices, self.by_seed):
            number = self.seed(packed, choice)
            first, count = starts[number], (starts[number + 1] - starts[number]).astype(np.int64)
            ends = np.cumsum(count)
            at = 0
            while at < len(packed):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                n = count[at:to]
                s = np.repeat(np.arange(at, to), n)
                g = order[np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)]
                x = packed[s] ^ self.packed[g]
                mm = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(sq.LOW_BITS))
                ok = np.flatnonzero(mm <= self.most)
                s, g, x, mm = s[ok], g[ok], x[ok], mm[ok]
                kept = np.ones(len(x), bool)
                for i in range(choice[-1] + 1):
                    kept &= ((x & self.masks[i]) == 0) == (i in choice)
                yield s[kept], g[kept], mm[kept]
                at = to


def _looked_up(keys, sites: DataFrame, guide: str, site: str, length: int, most: int) -> DataFrame:
    """Columns of the sites, ``guide`` and ``mm`` of all near pairs, found while the sites are read."""
    rows = sites.withColumn(site, F.upper(quoted(site))).where(sq.is_dna(quoted(site), length))
    at = rows.columns.index(site)
    fields = [*rows.schema.fields, T.StructField(guide, T.StringType()), T.StructField("mm", T.IntegerType())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(keys.value, length, most)
        for batch in batches:
            for s, g, mm in table.near(table.pack(batch.column(at))):
                if len(s):
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(s)) for c in batch.columns), table.guides.take(pa.array(g)), pa.array(mm.astype(np.int32))], names=[f.name for f in fields])

    return rows.mapInArrow(find, T.StructType(fields))


def near_counts(guides: DataFrame, sites: DataFrame, guide: str, site: str, count: str, length: int, most: int, tabled: int = TABLED) -> DataFrame:
    """Different guides with the places near them by distance: ``guide``, ``mm0`` ... ``mm<most>``; guides without any have no row.

    As :func:`near_matches`, but no pair leaves the worker that finds it: each
    task sums up the places (column ``count`` of the sites) per guide.
    """
    if not 0 <= most < length <= 31:
        raise ValueError("the radius must be smaller than the sequence, and that at most 31 bases")
    sums = [f"mm{i}" for i in range(most + 1)]
    keys = guides.select(F.upper(quoted(guide)).alias("k")).where(sq.is_dna(F.col("k"), length)).distinct()
    known = keys.limit(tabled + 1).toArrow()
    if len(known) > tabled:
        hits = _joined(keys.withColumnRenamed("k", guide), sites.select(quoted(site), quoted(count)), guide, site, length, most)
        return hits.groupBy(quoted(guide)).agg(*(F.sum(F.when(F.col("mm") == i, quoted(count)).otherwise(0)).alias(n) for i, n in enumerate(sums)))
    shared = sites.sparkSession.sparkContext.broadcast(known.column("k").to_pylist())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = None, None
        for batch in batches:
            if table is None:
                table = _Table(shared.value, length, most)
                total = np.zeros((len(table.guides), most + 1), np.int64)
            places = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, g, mm in table.near(table.pack(batch.column(0))):
                np.add.at(total, (g, mm), places[s])
        if table is not None:
            found = np.flatnonzero(total.any(1))
            for at in range(0, len(found), 1 << 16):
                own = found[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([table.guides.take(pa.array(own)), *(pa.array(total[own, i]) for i in range(most + 1))], names=[guide, *sums])

    rows = sites.select(F.upper(quoted(site)).alias("s"), F.coalesce(quoted(count).cast("long"), F.lit(0)).alias("n")).where(sq.is_dna(F.col("s"), length))
    fields = [T.StructField(guide, T.StringType()), *(T.StructField(n, T.LongType()) for n in sums)]
    return rows.mapInArrow(find, T.StructType(fields)).groupBy(quoted(guide)).agg(*(F.sum(n).alias(n) for n in sums))


def _joined(guides: DataFrame, sites: DataFrame, guide: str, site: str, length: int, most: int) -> DataFrame:
    """All near pairs by a join on the number of a choice of segments and their bases.

    The distance is computed on packed bases in generated code.  A pair that
    agrees in several choices is kept at the first, so nothing is repeated and
    no distinct is needed.
    """
    parts, choices = _choices(length, most)

    def seeds(df: DataFrame, column: str, side: str) -> DataFrame:
        c = quoted(column)
        seg = F.array(*(F.concat(*(F.substring(c, *parts[i]) for i in choice)) for choice in choices))
        rows = df.where(sq.is_dna(c, length)).withColumn(f"__{side}", sq.pack(F.upper(c)))
        return rows.select("*", F.posexplode(seg).alias(f"__{side}_no", f"__{side}_seg"))

    a, b = seeds(guides, guide, "g"), seeds(sites.withColumn(site, F.upper(quoted(site))), site, "s")
    pairs = a.join(b, (F.col("__g_no") == F.col("__s_no")) & (F.col("__g_seg") == F.col("__s_seg")))
    pairs = pairs.withColumn("mm", sq.packed_mismatches(F.col("__g"), F.col("__s"))).where(F.col("mm") <= most)
    earlier = {i: [k for k, c in enumerate(choices) if i < c[-1] and i not in c] for i in range(len(parts))}
    first = reduce(lambda x, y: x & y, (~(F.col("__g_no").isin(earlier[i]) & (F.substring(quoted(guide), p, n) == F.substring(quoted(site), p, n))) for i, (p, n) in enumerate(parts) if earlier[i]), F.lit(True))
    return pairs.where(first).drop("__g", "__s", "__g_no", "__s_no", "__g_seg", "__s_seg")


def prescreen(guides: DataFrame, sites: DataFrame, guide: str, site: str, length: int, threshold: int, keep: bool = True) -> DataFrame:
    """Guides without (``keep=False``: with) a near match: another site within ``threshold``, or their own at two places or more.

    ``sites`` has rows of different sequences with ``loci``.
    """
    keys = guides.select(F.upper(quoted(guide)).alias("__own")).distinct()
    hits = near_matches(keys, sites.select(quoted(site).alias("__site"), "loci"), "__own", "__site", length, threshold)
    bad = hits.groupBy("__own").agg(F.max("mm").alias("__far"), F.sum(F.when(F.col("mm") == 0, F.col("loci"))).alias("__n")).where((F.col("__far") > 0) | (F.col("__n") > 1))
    return guides.join(bad, F.upper(quoted(guide)) == F.col("__own"), "left_anti" if keep else "left_semi")


def penalties(matrix: Mapping[tuple[int, str, str], float], length: int) -> Column:
    """A literal array of factors by (position, guide base, off-target base), 1 where the matrix has none."""
    values = [matrix.get((p, g, o), 1.0) for g in "ACGT" for o in "ACGT" for p in range(1, length + 1)]
    return F.array(*(F.lit(float(v)) for v in values))


def pair_score(guide: Column, target: Column, matrix: Mapping[tuple[int, str, str], float], length: int) -> Column:
    """Product of the factors of all positions at which guide and target differ; null for other letters than ACGT.

    The table has 16 * length entries and is a literal of the plan.
    """
    table = penalties(matrix, length)
    code = lambda s, p: F.instr(F.lit("ACGT"), F.substring(s, p, F.lit(1))) - 1
    factor = lambda p: F.when(F.substring(guide, p, F.lit(1)) == F.substring(target, p, F.lit(1)), F.lit(1.0)).otherwise(F.element_at(table, ((code(guide, p) * 4 + code(target, p)) * length + p).cast("int")))
    score = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.lit(1.0), lambda t, p: t * factor(p))
    return F.when(sq.is_dna(guide, length) & sq.is_dna(target, length), score)


def pam_weight(pam: Column) -> Column:
    """Weight of the two bases after a motif's first base; 0 for those not listed."""
    return F.coalesce(F.element_at(sq._table(sq.PAM_TAIL), F.substring(pam, 2, 2)), F.lit(0.0))


def per_guide(hits: DataFrame, keys: list[str], score: str, count: str = "loci", most: int = 4, second: str | None = None, tttv: str | None = None) -> DataFrame:
    """Per-guide totals of scored hits in one aggregation.

    ``cfd_sum`` over off-targets (weighted by their places), the largest single
    score, places at distance 0 (``on_count``) and above, and ``mm_counts`` by
    distance from 0, where distance 0 leaves one place out as the guide's own.
    ``second`` and ``tttv`` (a boolean column) add sums of a second score and of
    hits with that motif.  Guides without hits have no row.
    """
    off = F.col("mm") > 0
    n, s = quoted(count), quoted(score)
    sums = [F.sum(F.when(off, s * n).otherwise(0.0)).alias("cfd_sum"), F.max(F.when(off, s)).alias("max_cfd"), F.sum(F.when(~off, n).otherwise(0)).alias("on_count"), F.sum(F.when(off, n).otherwise(0)).alias("off_count")]
    if second:
        sums.append(F.sum(F.when(off, quoted(second) * n).otherwise(0.0)).alias("cfd2_sum"))
    if tttv:
        sums.append(F.sum(F.when(off & quoted(tttv), s * n).otherwise(0.0)).alias("tttv_sum"))
    counts = [F.sum(F.when(F.col("mm") == d, n).otherwise(0)).alias(f"__mm{d}") for d in range(most + 1)]
    out = hits.groupBy(*(quoted(k) for k in keys)).agg(*sums, *counts)
    histogram = F.array(F.greatest(F.col("__mm0") - 1, F.lit(0)), *(F.col(f"__mm{d}") for d in range(1, most + 1)))
    return out.withColumn("mm_counts", histogram).drop(*(f"__mm{d}" for d in range(most + 1)))


def specificity(totals: Column, on_count: Column | None = None) -> Column:
    """1 / (1 + sum), or with a count of own places 1 / (max(count, 1) + sum)."""
    return F.lit(1.0) / ((F.lit(1) if on_count is None else F.greatest(on_count, F.lit(1))) + totals)


def legacy_specificity(total_with_own: Column) -> Column:
    """1 / sum over all hits, the guide's own included; 1 where the sum is 0."""
    return F.when(F.coalesce(total_with_own, F.lit(0.0)) == 0, 1.0).otherwise(1.0 / total_with_own)


def with_totals(guides: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """All guides with their totals, nulls where there are none, and ``state``: both, no hits, no guide."""
    own = totals.withColumn("__t", F.lit(1))
    j = guides.withColumn("__g", F.lit(1)).join(own, key, "full_outer")
    return j.withColumn("state", F.when(F.col("__t").isNull(), "no hits").when(F.col("__g").isNull(), "no guide").otherwise("both")).drop("__g", "__t")


# fixed values: names of score metrics, and conventions of specificity by output format
METRICS = {"cfd": "cfd", "doench2016cfd": "cfd", "cfd-cas12a": "cas12a-2xnls", "cfd-cas12a:2xnls": "cas12a-2xnls", "cas12a-2xnls": "cas12a-2xnls", "cfd-cas12a:encas12a": "cas12a-encas12a", "cas12a-encas12a": "cas12a-encas12a", "encas12a": "cas12a-encas12a"}
CONVENTIONS = {"tsv": "flashfry", "csv": "guidescan", "both": "guidescan"}
WIDEST_BIN = 15


def metric(name: str) -> str:
    """The score metric that a name stands for, in any case; an unknown one is an error."""
    if name.lower() not in METRICS:
        raise ValueError(f"no score metric is called {name}")
    return METRICS[name.lower()]


def bin_width(width: int | str) -> int:
    """The bases of a bin, 1 to 15."""
    if not 1 <= int(width) <= WIDEST_BIN:
        raise ValueError(f"a bin has 1 to {WIDEST_BIN} bases, not {width}")
    return int(width)


def saturated(on_count: Column, off_count: Column, cfd_sum: Column, most: int | None = None, least: float | None = None) -> Column:
    """Whether a guide has at least ``most`` places, or a specificity below ``least``."""
    out = F.lit(False)
    if most is not None and most >= 0:
        out = out | (on_count + off_count >= most)
    if least is not None and least > 0:
        out = out | (cfd_sum > 1 / least - 1)
    return out


def capped(hits: DataFrame, keys: list[str], site: str, most: int) -> DataFrame:
    """At most ``most`` different site sequences per guide and distance, in order of the sequence."""
    order = Window.partitionBy(*(quoted(k) for k in keys), "mm").orderBy(quoted(site))
    return hits.withColumn("__k", F.dense_rank().over(order)).where(F.col("__k") <= most).drop("__k")


def floored(hits: DataFrame, floor: float, scores: list[str]) -> DataFrame:
    """Hits of which one score at least reaches ``floor``."""
    return hits.where(F.greatest(*(F.coalesce(quoted(s), F.lit(0.0)) for s in scores), F.lit(0.0)) >= floor)


def reaggregate(records: DataFrame, guide: str, score: str) -> DataFrame:
    """Per-guide specificity, largest score and number of hits from a table of single off-targets."""
    out = records.groupBy(quoted(guide)).agg(F.sum(quoted(score)).alias("cfd_sum"), F.max(quoted(score)).alias("max_cfd"), F.count(F.lit(1)).alias("hits"))
    return out.withColumn("specificity", specificity(F.coalesce("cfd_sum", F.lit(0.0))))
