"""Scores of trained sequence models, as Arrow functions over weights that the caller supplies.

No weights come with this library.  A scorer takes valid sequences of one
length; anything else scores null.  Weights are loaded once per worker.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import sequence as sq

Weights = Mapping[str, np.ndarray]


def one_hot(seqs: Sequence[str], order: str = "ACGT") -> np.ndarray:
    """Sequences of one length as an array (rows, length, 4)."""
    codes = np.frombuffer("".join(seqs).upper().encode(), np.uint8).reshape(len(seqs), -1)
    return (codes[:, :, None] == np.frombuffer(order.encode(), np.uint8)).astype(np.float32)


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, same: bool = False) -> np.ndarray:
    """One-dimensional convolution; kernel (width, in, out)."""
    width = kernel.shape[0]
    if same:
        x = np.pad(x, ((0, 0), ((width - 1) // 2, width // 2), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)
    return np.einsum("nlcw,wco->nlo", windows, kernel, optimize=True) + bias


def average_pool(x: np.ndarray, size: int) -> np.ndarray:
    n = x.shape[1] // size
    return x[:, : n * size].reshape(len(x), n, size, -1).mean(2)


def dense(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}_kernel"] + w[f"{name}_bias"]


def cas12a_cnn(seqs: Sequence[str], w: Weights) -> np.ndarray:
    """34 bases: a convolution of width 5, pooling by 2, three hidden layers, one output."""
    x = average_pool(relu(conv(one_hot(seqs), w["conv_kernel"], w["conv_bias"])), 2).reshape(len(seqs), -1)
    for name in ("dense1", "dense2", "dense3"):
        x = relu(dense(x, w, name))
    return dense(x, w, "out")[:, 0]


def cas12a_deep_cnn(seqs: Sequence[str], w: Weights) -> np.ndarray:
    """31 bases: two convolutions of width 5 with padding, two hidden layers, a sigmoid."""
    x = relu(conv(one_hot(seqs), w["conv1_kernel"], w["conv1_bias"], True))
    x = relu(conv(x, w["conv2_kernel"], w["conv2_bias"], True)).reshape(len(seqs), -1)
    for name in ("dense1", "dense2"):
        x = relu(dense(x, w, name))
    return 1 / (1 + np.exp(-dense(x, w, "out")[:, 0]))


def cas9_inception(seqs: Sequence[str], w: Weights) -> np.ndarray:
    """30 bases: convolutions of widths 3, 5 and 7 side by side, each pooled by 2, two hidden layers, one output."""
    x = one_hot(seqs)
    parts = [average_pool(relu(conv(x, w[f"conv{k}_kernel"], w[f"conv{k}_bias"])), 2).reshape(len(seqs), -1) for k in (3, 5, 7)]
    x = np.concatenate(parts, 1)
    for name in ("dense1", "dense2"):
        x = relu(dense(x, w, name))
    return dense(x, w, "out")[:, 0]


def boosted_trees(features: np.ndarray, w: Weights) -> np.ndarray:
    """Gradient-boosted trees given as arrays (trees, nodes): feature (-1 at leaves), threshold, left, right, value."""
    node = np.zeros((len(features), w["feature"].shape[0]), np.int64)
    tree = np.arange(w["feature"].shape[0])
    rows = np.arange(len(features))[:, None]
    for _ in range(int(w["depth"])):
        f = w["feature"][tree, node]
        left = features[rows, np.maximum(f, 0)] <= w["threshold"][tree, node]
        node = np.where(f < 0, node, np.where(left, w["left"][tree, node], w["right"][tree, node]))
    return float(w["start"]) + float(w["rate"]) * w["value"][tree, node].sum(1)


def melting(seqs: Sequence[str], strand1: float = 25.0, strand2: float = 25.0, sodium: float = 50.0) -> np.ndarray:
    """Nearest-neighbour melting temperatures of sequences of one length."""
    codes = one_hot(seqs).argmax(2)
    order = {b: i for i, b in enumerate("ACGT")}
    table = np.zeros((2, 4, 4))
    for pair, (h, s) in sq.NEAREST.items():
        table[:, order[pair[0]], order[pair[1]]] = h, s
    heat, entropy = (t[codes[:, :-1], codes[:, 1:]].sum(1) for t in table)
    weak = np.isin(codes[:, [0, -1]], [0, 3]).sum(1)
    heat, entropy = heat + weak * 2.3 + (2 - weak) * 0.1, entropy + weak * 4.1 - (2 - weak) * 2.8
    entropy = entropy + 0.368 * (codes.shape[1] - 1) * np.log(sodium * 1e-3)
    return 1000 * heat / (entropy + 1.987 * np.log((strand1 - strand2 / 2) * 1e-9)) - 273.15


def separate(pairs: np.ndarray) -> np.ndarray:
    """Occurrences of each pair of letters that don't overlap, from marks (rows, places, 16): of a run of one letter every second place counts."""
    counts = pairs.sum(1)
    for k in range(0, 16, 5):  # only a pair of equal letters can overlap itself
        taken, total = np.zeros(len(pairs)), np.zeros(len(pairs))
        for at in range(pairs.shape[1]):
            taken = pairs[:, at, k] * (1 - taken)
            total += taken
        counts[:, k] = total
    return counts


def composition_features(seqs: Sequence[str], spans: Sequence[tuple[int, int]] = ((0, 34), (4, 9), (9, 17), (17, 24))) -> np.ndarray:
    """Features of sequences of one length: GC share, shares of bases and of pairs that don't overlap, one-hot bases and pairs by position, melting temperatures of four spans (689 for 34 bases)."""
    hot = one_hot(seqs)
    n, length = hot.shape[:2]
    base = hot.mean(1)
    pairs = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).reshape(n, length - 1, 16)
    counts = separate(pairs).reshape(n, 16) / (length - 1)
    temperatures = np.stack([melting([s[a:b] for s in seqs]) for a, b in spans], 1)
    return np.concatenate([base[:, [1, 2]].sum(1, keepdims=True), base, counts, hot.reshape(n, -1), pairs.reshape(n, -1), temperatures], 1)


def composition_trees(seqs: Sequence[str], w: Weights) -> np.ndarray:
    return boosted_trees(composition_features(seqs), w)


def lstm(x: np.ndarray, kernel: np.ndarray, recurrent: np.ndarray, bias: np.ndarray, backwards: bool = False) -> np.ndarray:
    """Outputs of an LSTM (gates in the order input, forget, cell, output) at every step."""
    units = recurrent.shape[0]
    h = c = np.zeros((len(x), units))
    out = []
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(x.shape[1])[:: -1 if backwards else 1]:
        i, f, g, o = np.split(x[:, step] @ kernel + h @ recurrent + bias, 4, axis=1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out[:: -1 if backwards else 1], 1)


def cas9_recurrent(seqs: Sequence[str], w: Weights) -> np.ndarray:
    """21 bases: embedded tokens through a two-way LSTM, then hidden layers with the sequence's own features (``features`` weights scale them); clipped to 0..1."""
    codes = np.array([[1, *("ATCG".index(b) + 2 for b in s.upper())] for s in seqs])
    x = w["embedding"][codes]
    both = np.concatenate([lstm(x, w["forward_kernel"], w["forward_recurrent"], w["forward_bias"]), lstm(x, w["backward_kernel"], w["backward_recurrent"], w["backward_bias"], True)], 2).reshape(len(seqs), -1)
    gc = np.array([sum(b in "GC" for b in s[:20].upper()) for s in seqs], float)
    own = np.stack([gc > 10, gc < 10, gc, melting([s[:20] for s in seqs])], 1).astype(float) * w["features"]
    x = relu(dense(np.concatenate([both, own], 1), w, "dense1"))
    return np.clip(dense(x, w, "out")[:, 0], 0, 1)


@dataclass(frozen=True)
class Scorer:
    """A model: sequence length, how it predicts, digits of its result."""

    length: int
    predict: Callable[[Sequence[str], Weights], np.ndarray]
    digits: int = 8


SCORERS = {
    "cas12a_cnn": Scorer(34, cas12a_cnn), "cas12a_deep_cnn": Scorer(31, cas12a_deep_cnn), "cas9_inception": Scorer(30, cas9_inception),
    "composition_trees": Scorer(34, composition_trees), "cas9_recurrent": Scorer(21, cas9_recurrent),
}
_loaded: dict[str, dict[str, np.ndarray]] = {}


def load(path: str) -> dict[str, np.ndarray]:
    if path not in _loaded:
        with np.load(path) as f:
            _loaded[path] = {k: f[k] for k in f.files}
    return _loaded[path]


def score(sequence: Column, scorer: str, weights: str) -> Column:
    """A model's score of each sequence; ``weights`` is an .npz file that every executor can read.  Null for other lengths or letters."""
    model = SCORERS[scorer]

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = load(weights)
        for batch in batches:
            valid = pa.compute.fill_null(pa.compute.match_substring_regex(batch, "^[ACGTacgt]{%d}$" % model.length), False)
            out = np.full(len(batch), np.nan)
            if pa.compute.any(valid).as_py():
                out[valid.to_numpy(zero_copy_only=False)] = np.round(np.asarray(model.predict(batch.filter(valid).to_pylist(), w), float), model.digits)
            yield pa.array(out, from_pandas=True)

    return run(sequence)


def variant_score(sequence: Column, name: str, folder: str) -> Column:
    """Score of a 31-base sequence by the weights of a variant, whose file in ``folder`` has the variant's name in any spelling."""
    files = {sq.variant_key(os.path.splitext(f)[0]): os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".npz")}
    if sq.variant_key(name) not in files:
        raise ValueError(f"no variant is called {name}; there are {', '.join(sorted(files))}")
    return score(sequence, "cas12a_deep_cnn", files[sq.variant_key(name)])


def rule_set_3(context: Column, tracr: str = "Chen2013") -> Column:
    """Z-score of 30 bases by the public package ``rs3``, rounded to 4 digits; an error where rows are read if it is not installed.  Null for other lengths or letters."""
    if tracr not in ("Hsu2013", "Chen2013"):
        raise ValueError("the tracr is Hsu2013 or Chen2013")

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from rs3.seq import predict_seq

        for batch in batches:
            valid = pa.compute.fill_null(pa.compute.match_substring_regex(batch, "^[ACGTacgt]{30}$"), False)
            found = np.round(np.asarray(predict_seq(batch.filter(valid).to_pylist(), sequence_tracr=tracr), float), 4) if pa.compute.any(valid).as_py() else np.empty(0)
            out = np.full(len(batch), np.nan)
            out[valid.to_numpy(zero_copy_only=False)] = found
            yield pa.array(out, from_pandas=True)

    return run(context)


def chosen(names: Sequence[str], cas12a: bool, tracr: str | None, variants: Mapping[str, str]) -> list[str]:
    """Scorers of a run without repeats: ``both`` stands for the two Cas12a ones; Cas12a scorers exclude a tracr, a variant scorer needs known variants."""
    out: list[str] = []
    for n in names:
        out += [m for m in (("cas12a_cnn", "composition_trees") if n == "both" else (n,)) if m not in out]
    if cas12a and tracr:
        raise ValueError("a tracr belongs to Cas9 scorers, not to Cas12a ones")
    known = {sq.variant_key(v) for v in variants}
    for n in out:
        if n not in SCORERS and sq.variant_key(n) not in known:
            raise ValueError(f"no scorer or variant is called {n}")
    return out
