"""Abusive, hateful or sexual passages, by maximum-scoring segment search.

Every word of a text gets a log-odds score: how much more often the longest
known n-gram that ends there occurs in texts reviewed as abusive than in clean
ones, under Dirichlet priors (an n-gram's prior is what its parts say, a word's
prior comes from a short list of terms), less a constant.  A linear scan finds
the passage with the largest sum; all other maximal passages of suspicious
texts are found as well.  Clean texts' best passages follow an extreme-value
distribution, fitted on reviews held out from the counts, by which scores
become probabilities that also allow for a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.common import cut, quoted
from seqloom.llm.words import plain, words_of

#: Most reviewed texts that the model is fitted on (those with the smallest hashes of their ids, if there are more), and most n-grams of them that it knows (those of most texts): what comes to the driver.
FIT_TEXTS, FIT_GRAMS = 20_000, 1 << 20
#: Least n-gram length 2 and 3 counts; prior weights by n-gram length; prior odds share and weight of a listed term.
LEAST_COUNT, PRIOR, TERM_SHARE, TERM_WEIGHT = 2, (1.0, 1.5, 1.5), 0.97, 3.0
#: Cost per word, bounds of an n-gram's log-odds, score of a word never seen.
COST, LOW, HIGH, UNSEEN = 1.7, -2.5, 4.0, -1.0
#: Probability of a clean text's best passage below which a passage is reported: one clean text in 10,000, as abusive ones are a few in 100.
SIGNIFICANCE = 0.0001
#: Shares of clean texts between which the extreme-value distribution is fitted: above, wrong verdicts would count.
FIT_AT = (0.80, 0.93)
SLICE_BYTES, CACHED_PIECES = 4 << 20, 300_000
SEPARATOR = "|"

#: Terms whose prior speaks for abuse; reviews outweigh it where they say otherwise.
TERMS = (
    "idiot moron imbecile retard retarded cretin scum scumbag vermin filth filthy parasite parasites cockroach cockroaches savages degenerate degenerates "
    "bitch bastard asshole arsehole shit shitty shithead dipshit dumbass jackass wanker twat cunt prick dick cock pussy tits boobs ass slut sluts whore "
    "horny nude nudes naked porn blowjob fuck fucking fucked fucker fuckwit rape raped stab stabbed strangle strangled hang hanged pathetic worthless "
    "disgusting stupid dumb braindead brainless spineless gutless useless vile contemptible loser halfwit hate hates "
    "idiota imbécil mierda puta basura cabrón gilipollas mueras arschloch schlampe fresse vollidiot idiotin hure wichser connard salope ordure crève gueule pute "
    "идиот дебил сука убей мразь тварь 白痴 傻逼 去死吧 你这个白痴 滚"
).split()

_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(33), *b"(){}[];,=<>\"|&+/\\:?!", 127]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a large binary array one after another, and where each starts (and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _spaced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts that may hold a word spelled with blanks between its letters."""
    if len(data) < 5:
        return np.empty(0, np.int64)
    letter = _LETTER[data]
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    gap = np.zeros(len(data), bool)
    gap[1:-1] = (data[1:-1] == 32) & alone[:-2] & alone[2:]
    at = np.flatnonzero(gap[:-2] & gap[2:])
    at = np.concatenate([at, np.flatnonzero((data == 0xD0) | (data == 0xD1))])  # Cyrillic: two bytes a letter
    return np.unique(np.searchsorted(offsets, at, "right") - 1)


class Reader:
    """Turns texts into word numbers; numbers are fixed by a vocabulary or given as words appear."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.fixed = vocabulary is not None
        self.numbers: dict[str, int] = {SEPARATOR: 1} if vocabulary is None else vocabulary
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _words(self, piece: bytes) -> list[int]:
        if _BREAKS[piece[0]]:
            return [self.numbers[SEPARATOR]] if b"\n" in piece or b'"' in piece else []
        words = words_of(piece.decode("utf-8", "ignore"))
        if self.fixed:
            return [self.numbers.get(w, 0) for w in words]
        return [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after another, 0 for words not in the vocabulary, and where each text starts (and the end)."""
        texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_binary())])
        data, offsets = _buffers(texts)
        spaced = _spaced(data, offsets)
        if len(spaced):
            values = texts.to_pylist()
            for i in spaced:
                values[i] = _SPACED.sub(lambda m: m[0].replace(" ", ""), values[i].decode("utf-8", "ignore")).encode()
            texts = pa.array(values, pa.large_binary())
            data, offsets = _buffers(texts)
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        gap = _BREAKS[data]
        edge = np.empty(len(data), bool)
        edge[0], edge[1:] = True, gap[1:] != gap[:-1]
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(edge)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.pieces) > CACHED_PIECES:
            self.clear()
        new = [p for p in pieces if p not in self.pieces]
        found = [self._words(p) for p in new]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32, int(counts.sum()))])
        first = len(self.pieces)
        self.pieces.update((p, first + k) for k, p in enumerate(new))
        number = np.fromiter((self.pieces[p] for p in pieces), np.int64, len(pieces))[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[number]
        sums = np.concatenate([[0], np.cumsum(counts)])
        words = self.flat[np.repeat(self.start[number] - sums[:-1], counts) + np.arange(sums[-1])]
        starts = sums[np.searchsorted(at, offsets)]
        # separators that follow one another are one, as is one at the start of a text
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == 1) & (words[:-1] == 1)
        same[starts[:-1][starts[:-1] < len(words)]] = words[starts[:-1][starts[:-1] < len(words)]] == 1
        if self.numbers[SEPARATOR] == 1 and same.any():
            kept = np.concatenate([[0], np.cumsum(~same)])
            words, starts = words[~same], kept[starts]
        return words, starts


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    """Scores of words, word pairs and triples, and the extreme-value distribution of clean texts' best passages."""

    vocabulary: dict[str, int]
    one: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    two: np.ndarray = field(default_factory=lambda: np.empty(0))
    triples: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    three: np.ndarray = field(default_factory=lambda: np.empty(0))
    location: float = 0.0
    scale: float = 0.6
    words: float = 300.0

    def scores(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of every word, from the longest known n-gram of its text that ends there."""
        out = self.one[words].copy()
        if len(words) < 2:
            return out
        size = len(self.one)
        inside = np.ones(len(words), bool)
        inside[starts[:-1][starts[:-1] < len(words)]] = False
        pair = np.full(len(words), -1, np.int64)
        at = np.flatnonzero(inside[1:]) + 1
        pair[at] = _find(self.pairs, words[at - 1].astype(np.int64) * size + words[at])
        known = np.flatnonzero(pair >= 0)
        out[known] = self.two[pair[known]]
        known = known[(known >= 2)]
        known = known[inside[known - 1] & (pair[known - 1] >= 0)]
        triple = _find(self.triples, pair[known - 1] * size + words[known])
        out[known[triple >= 0]] = self.three[triple[triple >= 0]]
        return out

    def probability(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probability that a clean text of so many words has a passage with at least this score."""
        rate = np.exp(np.minimum(50.0, -(score - self.location) / self.scale)) * np.maximum(words, 1) / self.words
        return np.where(score > 0, -np.expm1(-rate), 1.0)


def best_passages(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest sum of consecutive scores of every text, at least 0, in one pass over all texts."""
    texts = len(starts) - 1
    if not texts:
        return np.empty(0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # one prefix sum per text and word, each text lowered so far that no minimum carries over
    lengths = np.diff(starts)
    size = lengths + 1
    first = np.cumsum(size) - size
    text = np.repeat(np.arange(texts), size)
    index = np.arange(size.sum()) - np.repeat(first - starts[:-1], size)
    lowered = sums[index] - text * (np.abs(scores).sum() + 1.0)
    return np.maximum.reduceat(lowered - np.minimum.accumulate(lowered), first)


def maximal_passages(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring passages of one text as (score, from, to), in linear time: no longer or overlapping passage beats one."""
    stack: list[list[float]] = []  # from, to, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(b - a, int(i), int(j)) for i, j, a, b in stack]


@dataclass
class Counts:
    """Reviewed texts of either verdict, and how many of them hold each n-gram (words with blanks between)."""

    grams: list[str]
    abusive: np.ndarray
    clean: np.ndarray
    texts: tuple[int, int]


def counted(counts: Counts) -> Model:
    """Scores of all n-grams from their counts."""
    grams, bad_all, good_all = counts.grams, counts.abusive.astype(float), counts.clean.astype(float)
    weight = max(counts.texts[0], 1) / max(counts.texts[1], 1)  # both classes as if of one size
    length = np.fromiter((g.count(" ") + 1 for g in grams), np.int64, len(grams))
    vocabulary = {SEPARATOR: 1}
    for w in [*(plain(t) for t in TERMS), *(g for g, n in zip(grams, length) if n == 1)]:
        vocabulary.setdefault(w, len(vocabulary) + 1)
    size = len(vocabulary) + 1
    share, prior = np.full(size, 0.5), np.full(size, PRIOR[0])
    for term in {plain(t) for t in TERMS}:
        share[vocabulary[term]], prior[vocabulary[term]] = TERM_SHARE, TERM_WEIGHT
    x, y = np.zeros(size), np.zeros(size)
    at = np.flatnonzero(length == 1)
    number = np.fromiter((vocabulary[grams[i]] for i in at), np.int64, len(at))
    x[number], y[number] = bad_all[at], good_all[at] * weight
    odds = lambda p: np.log(p / (1 - p))
    clipped = lambda o: np.clip(o, LOW, HIGH) - COST
    first = odds((x + prior * share) / (x + y + prior))
    one = clipped(first)
    one[(x + y == 0) & (share == 0.5)] = UNSEEN
    one[0] = UNSEEN

    def keyed(n: int, key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the n-grams of one length whose parts are known, in order, with their counts."""
        own = np.flatnonzero((length == n) & (bad_all + good_all >= LEAST_COUNT))
        keys = np.fromiter((key(grams[i].split(" ")) for i in own), np.int64, len(own))
        own, keys = own[keys >= 0], keys[keys >= 0]
        order = np.argsort(keys)
        return keys[order], bad_all[own][order], good_all[own][order]

    def pair(w: list[str]) -> int:
        a, b = vocabulary.get(w[0], -1), vocabulary.get(w[1], -1)
        return a * size + b if a >= 0 and b >= 0 else -1

    pairs, bad, good = keyed(2, pair)
    part = 1 / (1 + np.exp(-(first[pairs // size] + first[pairs % size]) / 2))
    second = odds((bad + PRIOR[1] * part) / (bad + good * weight + PRIOR[1]))
    index = {int(k): i for i, k in enumerate(pairs)}

    def triple(w: list[str]) -> int:
        head, tail = index.get(pair(w[:2]), -1), pair(w[1:])
        return head * size + tail % size if head >= 0 and tail in index else -1

    triples, bad, good = keyed(3, triple)
    head, tail = triples // size, triples % size
    rest = _find(pairs, pairs[head] % size * size + tail) if len(triples) else head
    part = 1 / (1 + np.exp(-(second[head] + second[rest]) / 2))
    third = odds((bad + PRIOR[2] * part) / (bad + good * weight + PRIOR[2]))
    return Model(vocabulary, one, pairs, clipped(second), triples, clipped(third))


def calibrated(model: Model, best: np.ndarray, words: np.ndarray) -> Model:
    """The model with the distribution of clean texts' best passages, from texts that it wasn't counted on and their lengths."""
    if len(best) >= 20:
        low, high = np.quantile(best, FIT_AT)
        spread = np.log(-np.log(FIT_AT[0])) - np.log(-np.log(FIT_AT[1]))
        model.scale = max(0.3, float((high - low) / spread))
        model.location = float(high + model.scale * np.log(-np.log(FIT_AT[1])))
        model.words = max(1.0, float(words.mean()))
    return model


def reviewed(documents: DataFrame, labels: DataFrame, item: str, text: str, verdict: str, limit: int = FIT_TEXTS) -> DataFrame:
    """Reviewed texts with the verdict of most of their reviews (null verdicts and ties left out): at most ``limit`` rows."""
    votes = labels.groupBy(quoted(item).alias("__id")).agg(F.avg(quoted(verdict)).alias("__v")).where(F.col("__id").isNotNull() & (F.col("__v") != 0.5))
    sample = votes.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    texts = documents.select(quoted(item).alias("__key"), quoted(text).alias("text"))
    return texts.join(F.broadcast(sample), F.col("__key") == F.col("__id")).select(F.col("__id").alias("id"), "text", (F.col("__v") > 0.5).alias("abusive")).where(F.col("text").isNotNull())


def _worded(texts: DataFrame) -> DataFrame:
    """Reviewed texts as ``words``, each different one once per verdict, with ``half``, 0 or 1."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            words, starts = reader.read(batch.column(0))
            names = pa.array([None, *reader.numbers], pa.string())  # numbers are given in order
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), names.take(pa.array(words)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["abusive", "words"])

    rows = texts.select("text", "abusive").mapInArrow(read, "abusive boolean, words array<string>").where(F.size("words") > 0)
    return rows.withColumn("__h", F.xxhash64("words")).dropDuplicates(["__h", "abusive"]).withColumn("half", F.pmod(F.col("__h"), F.lit(2)).cast("int")).drop("__h")


def _best_of(texts: DataFrame, models: list[Model]) -> DataFrame:
    """Best passage and number of words of every text, by the model of the other half."""
    known = _broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column(0).to_numpy(zero_copy_only=False)
            best, count = np.zeros(len(halves)), np.zeros(len(halves), np.int64)
            for i, (half, own) in enumerate(zip(halves, batch.column(1))):
                model = known.value[1 - half]
                words = np.fromiter((model.vocabulary.get(w, 0) for w in own.as_py()), np.int64, len(own))
                starts = np.array([0, len(words)])
                best[i], count[i] = best_passages(model.scores(words, starts), starts)[0], len(words)
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(count)], names=["best", "words"])

    return texts.select("half", "words").mapInArrow(score, "best double, words long")


def train(documents: DataFrame, labels: DataFrame, item: str, text: str, verdict: str, limit: int = FIT_TEXTS) -> Model:
    """The model of a bounded number of reviewed texts; without any it knows the listed terms alone.

    Texts are read and n-grams counted by the executors; counts of at most
    ``FIT_GRAMS`` n-grams and one number per clean text come to the driver.
    Clean texts are scored by a model of the other half of the reviews.
    """
    texts = cut(_worded(reviewed(documents, labels, item, text, verdict, limit)))
    sizes = {(r["half"], r["abusive"]): r["n"] for r in texts.groupBy("half", "abusive").agg(F.count(F.lit(1)).alias("n")).collect()}
    w = F.col("words")
    of = lambda n: F.transform(F.filter(w, lambda x, i: i < F.size(w) - (n - 1)), lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, n))))
    grams = texts.select("half", "abusive", F.explode(F.array_distinct(F.concat(w, of(2), of(3)))).alias("gram"))
    cell = lambda half, bad: F.count_if((F.col("half") == half) & (F.col("abusive") == bad)).cast("int").alias(f"c{half}{int(bad)}")
    counts = grams.groupBy("gram").agg(*(cell(h, b) for h in (0, 1) for b in (True, False)), F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_COUNT) | ~F.contains("gram", F.lit(" ")))
    found = counts.orderBy(F.desc("n"), "gram").limit(FIT_GRAMS).toArrow().sort_by("gram")
    names, column = found.column("gram").to_pylist(), lambda h, b: found.column(f"c{h}{int(b)}").to_numpy()

    def of_halves(*halves: int) -> Model:
        bad, good = (sum(column(h, b) for h in halves) for b in (True, False))
        seen = np.flatnonzero(bad + good)
        return counted(Counts([names[i] for i in seen], bad[seen], good[seen], tuple(sum(sizes.get((h, b), 0) for h in halves) for b in (True, False))))

    model = of_halves(0, 1)
    if sum(n for (_, bad), n in sizes.items() if not bad):
        held = _best_of(texts.where(~F.col("abusive")), [of_halves(0), of_halves(1)]).toArrow()
        calibrated(model, held.column("best").to_numpy(), held.column("words").to_numpy())
    return model


_readers: dict[int, Reader] = {}


def passage_scores(text: Column, model: Model, significance: float = SIGNIFICANCE) -> Column:
    """Struct of ``score`` (best passage), ``p_value`` and ``passages`` (significant ones) of a text.

    A null or empty text scores 0, with p-value 1.  Whole texts are read, of any length.
    """
    broadcast = _broadcast(model)

    @F.arrow_udf("score double, p_value double, passages int")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: Model = broadcast.value
        reader = _readers.get(id(known))
        if reader is None:
            _readers.clear()
            reader = _readers[id(known)] = Reader(known.vocabulary)
        for batch in batches:
            batch = batch.fill_null("")
            sizes = np.append(0, np.cumsum(pa.compute.binary_length(batch).to_numpy(zero_copy_only=False)))
            out, at = [], 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_BYTES, "right")) - 1)
                words, starts = reader.read(batch.slice(at, to - at))
                each = known.scores(words, starts)
                best = np.round(best_passages(each, starts), 4)
                p = known.probability(best, np.diff(starts))
                passages = np.zeros(len(best), np.int32)
                for i in np.flatnonzero(p < significance):
                    own = maximal_passages(each[starts[i] : starts[i + 1]].tolist())
                    passages[i] = int((known.probability(np.array([x[0] for x in own]), np.full(len(own), starts[i + 1] - starts[i])) < significance).sum())
                out.append((best, p, passages))
                at = to
            best, p, passages = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0), np.empty(0), np.empty(0, np.int32))
            yield pa.StructArray.from_arrays([pa.array(best), pa.array(p), pa.array(passages)], ["score", "p_value", "passages"])

    return score(text)


def _broadcast(model):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)
