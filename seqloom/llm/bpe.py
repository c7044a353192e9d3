"""Byte-level BPE of a whole corpus by prefix-sharing trie traversal.

The last token of the encoding of every prefix determines the encoding: drop
that token and the same holds for the shorter prefix.  The distinct words of a
batch are visited in depth-first order of their trie (sorted, keeping the
states of the prefix shared with the word before), and every prefix gets its
last token once: the longest vocabulary token that ends there and is stable
next to the last token of what precedes it.  A document's ids are then looked
up word by word with array operations.  No row depends on another, so a corpus
needs no shuffle and no statistics.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The public vocabulary used where no other path is given; never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept with their ids in one worker, and bytes of text worked on at once.
CACHED_WORDS, SLICE_BYTES = 400_000, 4 << 20
LETTER, DIGIT, SIGN, SPACE = 0, 1, 2, 3
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE file with merges, and the encoding of words by them."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters, ids = byte_letters(), model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for text, i in ids.items():
            if all(c in letters for c in text):
                self.bytes_of[i] = bytes(letters[c] for c in text)
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {i: (i, i) for i in self.bytes_of}
        merged = -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i = ids[a + b]
            assert i > merged, "ids must follow the order of merges"
            merged = i
            self.pairs[ids[a], ids[b]] = i
            self.parts[i] = (ids[a], ids[b])
        # a token that no merge makes is not reached by encoding, single bytes apart
        self.ids = {b: i for i, b in self.bytes_of.items() if self.parts[i] != (i, i) or len(b) == 1}
        lengths: list[set[int]] = [set() for _ in range(256)]
        for b in self.ids:
            lengths[b[-1]].add(len(b))
        self.lengths = [sorted(x, reverse=True) for x in lengths]
        self.stable: dict[tuple[int, int], bool] = {}

    def _stable(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay as they are: no merge across their border comes before one inside them."""
        pairs, parts, limit = self.pairs, self.parts, 1 << 62
        while True:
            merged = pairs.get((left, right))
            if merged is not None and merged < limit:
                return False
            # undo the later of the two tokens' merges, the one next to the border
            if left > right:
                limit, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word of a sorted list of distinct words, in a depth-first walk over their trie."""
        ids, lengths, stable, check = self.ids, self.lengths, self.stable, self._stable
        last: list[int] = []  # last token of every prefix on the path to the current word
        size: list[int] = []
        before, out = b"", []
        if len(stable) > 2_000_000:
            stable.clear()
        for word in words:
            known, most = 0, min(len(before), len(word))
            if word[:most] == before[:most]:
                known = most
            else:
                low, high = 0, most  # bisect for the shared prefix
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if word[:mid] == before[:mid] else (low, mid)
                known = low
            known = min(known, len(last))
            del last[known:], size[known:]
            for end in range(known + 1, len(word) + 1):
                for n in lengths[word[end - 1]]:
                    if n > end:
                        continue
                    token = ids.get(word[end - n : end])
                    if token is None:
                        continue
                    if n < end:
                        pair = (last[end - n - 1], token)
                        fits = stable.get(pair)
                        if fits is None:
                            fits = stable[pair] = check(*pair)
                        if not fits:
                            continue
                    last.append(token)
                    size.append(n)
                    break
            before, end, found = word, len(word), []
            while end:
                found.append(last[end - 1])
                end -= size[end - 1]
            found.reverse()
            out.append(found)
        return out


def _classes() -> np.ndarray:
    """Letter, digit, sign or white space of every code point."""
    table = np.full(0x110000, SIGN, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, "L"), (DIGIT, "N")):
        for run in regex.finditer(rf"\p{{{name}}}+", text):
            table[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    table[_SPACES] = SPACE
    return table


_kept: dict = {}


def _shared(key, make: Callable):
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def word_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 ``data`` start a word; ``texts`` marks the first byte of every text.

    The words are those of the vocabulary's public pattern: contractions, runs
    of letters, digits or signs with a blank before them, runs of white space
    without the last one before anything else.
    """
    n = len(data)
    if "ascii" not in _kept:
        low = np.full(256, SIGN, np.uint8)
        low[[c for c in range(128) if chr(c).isalpha()]] = LETTER
        low[48:58] = DIGIT
        low[[c for c in _SPACES if c < 128]] = SPACE
        _kept["ascii"] = low
    kind = _kept["ascii"][data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        b = data[wide].astype(np.uint32)
        width = 2 + (b >= 0xE0) + (b >= 0xF0)
        point = b & np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint32)[width]
        for k in (1, 2, 3):
            more = np.flatnonzero(width > k)
            point[more] = (point[more] << 6) | (data[wide[more] + k] & 0x3F)
        found = _shared("classes", _classes)[np.minimum(point, 0x10FFFF)]
        kind[wide] = found
        for k in (1, 2, 3):
            more = np.flatnonzero(width > k)
            kind[wide[more] + k] = found[more]
    first = texts.copy()
    change = np.empty(n, bool)
    change[:1] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    blank = data == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    space = kind == SPACE
    start = change & ~(after_blank & ~space)
    # the last white space before something else is a word of its own, or the blank before the next one
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    tails = space[runs] & (ends < n)
    tails[tails] = ~first[ends[tails]]
    last = ends[tails] - 1
    for _ in range(3 if len(wide) else 0):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    # contractions: a lone quote that no blank precedes, with the letters that belong to it
    quote = runs[(data[runs] == 39) & (ends - runs == 1) & ~after_blank[runs]]
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        c1 = data[quote + 1]
        c2 = np.where((quote + 2 < n), data[np.minimum(quote + 2, n - 1)], 0)
        c2[(quote + 2 < n) & first[np.minimum(quote + 2, n - 1)]] = 0
        two = ((c1 == 108) & (c2 == 108)) | (((c1 == 118) | (c1 == 114)) & (c2 == 101))
        one = np.isin(c1, [115, 116, 109, 100]) & ~two
        taken, width = quote[two | one], np.where(two, 2, 1)[two | one]
        start[taken + 1] = False
        rest = taken + 1 + width
        start[rest[rest < n]] = True
    return start | first


class Encoder:
    """Encodes batches of texts; keeps the ids of the words seen so far."""

    def __init__(self, path: str):
        self.vocabulary = _shared(("vocabulary", path), lambda: Vocabulary(path))
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each distinct word among all words seen, new ones encoded."""
        if len(self.words) > CACHED_WORDS:
            self._clear()
        new = sorted(w for w in words if w not in self.words)
        if new:
            found = self.vocabulary.encode_words(new)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32, int(counts.sum()))])
            first = len(self.words)
            self.words.update((w, first + k) for k, w in enumerate(new))
        known = self.words
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def _slice(self, texts: pa.Array, only_counts: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(word_starts(data, first))
        bounds = np.append(at, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[number]
        sums = np.concatenate([[0], np.cumsum(counts)])
        each = np.diff(sums[np.searchsorted(at, offsets)])
        if only_counts:
            return np.empty(0, np.int32), each
        where = np.repeat(self.start[number] - sums[:-1], counts) + np.arange(sums[-1])
        return self.flat[where], each

    def encode(self, texts: pa.Array, only_counts: bool = False) -> pa.Array:
        """List of ids (or their number) of every text; a null or empty text has none."""
        texts = texts.fill_null("")
        sizes = np.append(0, np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)))
        ids, each, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_BYTES, "right")) - 1)
            a, b = self._slice(texts.slice(at, to - at), only_counts)
            ids.append(a)
            each.append(b)
            at = to
        counts = np.concatenate(each)
        if only_counts:
            return pa.array(counts.astype(np.int32))
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _sent(path: str) -> None:
    """Sends a vocabulary to the executors of a cluster, which may lack it."""
    context = SparkSession.active().sparkContext
    known = (context.applicationId, path)
    if not context.master.startswith("local") and os.path.isfile(path) and known not in _files:
        context.addFile(path)
        _files.add(known)


_files: set[tuple[str, str]] = set()


def _encoder(path: str) -> Encoder:
    there = path if os.path.isfile(path) else SparkFiles.get(os.path.basename(path))
    return _shared(("encoder", path), lambda: Encoder(there))


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """Ids of a text, special tokens' strings read as ordinary text; an empty list for null and empty texts.

    ``path`` is a file of the driver, sent to executors that don't have it.
    Texts of any length are encoded whole.
    """
    _sent(path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path)
        for batch in batches:
            yield encoder.encode(batch)

    return ids(text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of ids of a text; 0 for null and empty texts."""
    _sent(path)

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path)
        for batch in batches:
            yield encoder.encode(batch, only_counts=True)

    return count(text)
