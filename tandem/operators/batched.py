"""Encoders and pair scores over batches of reports: padded matrices with masks, one step for all reports of a batch.

The weights are those of ``neural.Encoder`` and ``neural.PairClassifier``; those classes read one report or pair at a time and are what
this module is held against. A batch holds reports of about the same length, so that little is padding, and at most CELLS
padded words. Words are numbered by Arrow, so no list of their strings is made, and each distinct word of up to WORDS words gets its vector once,
not once for each batch it stands in. A recurrent encoder makes one step for each place of the longest
report of a batch, a convolution one product for each place of its kernels. Whole texts are read. A report without tokens
stands for one padding word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import scoring
from .neural import ACTIVATIONS, Encoder, PairClassifier, relu, sigmoid, softmax, word_vectors

#: Padded words of a batch; a longer report is a batch of its own.
CELLS = 1 << 15
#: Words of the reports that share a table of word vectors; a longer report has one of its own.
WORDS = 1 << 21
PAD = "#PAD"


def batches_of(lengths: np.ndarray, cells: int = 0) -> Iterator[np.ndarray]:
    """The reports' numbers in batches, the shortest reports first."""
    order, held = np.argsort(lengths, kind="stable"), []
    for k in order.tolist():
        if held and (len(held) + 1) * lengths[k] > (cells or CELLS):
            yield np.array(held)
            held = []
        held.append(k)
    if held:
        yield np.array(held)


def padded(lists: list[list[str]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(report, place, dim) word vectors, zero behind a report's end, and the mask (report, place) of its words."""
    lists = [x or [PAD] for x in lists]
    codes = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
    table = np.concatenate([np.zeros((1, dims)), word_vectors(list(codes), dims).astype(np.float64)])
    index = np.zeros((len(lists), max(map(len, lists))), np.int64)
    for row, x in zip(index, lists):
        row[: len(x)] = [codes[w] for w in x]
    return table[index], index > 0


def parts_of(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most WORDS words, or of one row."""
    ends, lo = lists.offsets.to_numpy().astype(np.int64), 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS, side="right")) - 1)
        yield lo, min(hi, len(lists))
        lo = hi


def encode_lists(encoder: Encoder, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors), batch by batch; a null list is empty."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in parts_of(lists):
        part, size = lists.slice(lo, hi - lo), sizes[lo:hi]
        words = part.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
        table = np.concatenate([np.zeros((1, encoder.dims)), word_vectors([PAD, *words.dictionary.to_pylist()], encoder.dims).astype(np.float64)])
        start = np.cumsum(size) - size
        for some in batches_of(np.maximum(1, size)):
            places = np.arange(max(1, size[some].max()))[None, :]
            inside = places < size[some][:, None]
            index = np.zeros(inside.shape, np.int64)
            index[inside] = codes[(start[some][:, None] + places)[inside]]
            index[size[some] == 0, 0] = 1
            yield lo + some, encode_words(encoder, table[index], index > 0)


def recurrent(kind: str, x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """(report, place, dim) states of an LSTM or GRU; a state stands still where a report has no word."""
    n, length, _ = x.shape
    dims = wh.shape[0]
    h, c, out = np.zeros((n, dims)), np.zeros((n, dims)), np.zeros((n, length, dims))
    for t in range(length - 1, -1, -1) if back else range(length):
        here = mask[:, t][:, None]
        if kind == "lstm":
            i, f, g, o = np.split(x[:, t] @ wx + h @ wh + b, 4, axis=1)
            c = np.where(here, sigmoid(f) * c + sigmoid(i) * np.tanh(g), c)
            new = sigmoid(o) * np.tanh(c)
        else:
            rx, zx, nx = np.split(x[:, t] @ wx + b, 3, axis=1)
            rh, zh, nh = np.split(h @ wh, 3, axis=1)
            r, z = sigmoid(rx + rh), sigmoid(zx + zh)
            new = (1 - z) * np.tanh(nx + r * nh) + z * h
        h = np.where(here, new, h)
        out[:, t] = np.where(here, h, 0.0)
    return out


def convolve(x: np.ndarray, mask: np.ndarray, kernels: list[np.ndarray], bias: list[np.ndarray], activation: str = "relu") -> np.ndarray:
    """(report, filter) of filters of several widths with max pooling; windows stay inside a report, one window of a shorter one is padded."""
    n, length, _ = x.shape
    size, out = mask.sum(axis=1), []
    for k, b in zip(kernels, bias):
        width = k.shape[0]
        wide = np.concatenate([x, np.zeros((n, max(0, width - length), x.shape[2]))], axis=1)
        places = wide.shape[1] - width + 1
        total = b + sum(wide[:, j : j + places] @ k[j] for j in range(width))
        inside = np.arange(places)[None, :] <= np.maximum(size - width, 0)[:, None]
        out.append(np.where(inside[:, :, None], ACTIVATIONS[activation](total), -np.inf).max(axis=1))
    return np.concatenate(out, axis=1)


def pool(x: np.ndarray, mask: np.ndarray, kind: str) -> np.ndarray:
    mean = (x * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1)[:, None]
    top = np.where(mask[:, :, None], x, -np.inf).max(axis=1)
    if kind == "last":
        return x[np.arange(len(x)), mask.sum(axis=1) - 1]
    return {"mean": mean, "max": top, "mean+max": np.concatenate([mean, top], axis=1)}[kind]


def encode(encoder: Encoder, lists: list[list[str]]) -> np.ndarray:
    """(report, dim) vectors of one batch."""
    return encode_words(encoder, *padded(lists, encoder.dims))


def encode_words(encoder: Encoder, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(report, dim) vectors of padded word vectors."""
    w = encoder.weights
    if encoder.kind == "cnn":
        return convolve(x, mask, w["kernels"], w["bias"], encoder.activation)
    if encoder.kind == "self_att":
        e = np.where(mask[:, :, None], np.tanh(x @ w["s1"]) @ w["s2"], -np.inf).transpose(0, 2, 1)
        return (softmax(e) @ x).reshape(len(x), -1)
    if encoder.kind == "dense":
        return relu(pool(x, mask, "mean") @ w["dense"])
    if encoder.kind in ("lstm", "gru"):
        x = np.concatenate([recurrent(encoder.kind, x, mask, w["wx" + s], w["wh" + s], w["b"], back) for s, back in (("", False), ("2", True))[: 1 + encoder.both_ways]], axis=2)
    return pool(x, mask, "mean" if encoder.kind == "mean" else encoder.pooling)


def classify(model: PairClassifier, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores of the rows of u with those of v."""
    return sigmoid(relu(np.concatenate([(u - v) ** 2, u * v], axis=1) @ model.hidden) @ model.out)


# --- Spark -----------------------------------------------------------------------------------------------------------------------


def encode_reports(seqs: DataFrame, encoder: Encoder) -> DataFrame:
    """(bug_id, vec): every report (bug_id, tokens) encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, vectors in encode_lists(encoder, batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], ["bug_id", "vec"])

    return seqs.select("bug_id", "tokens").mapInArrow(run, "bug_id long, vec array<double>")


def score_vectors(pairs: DataFrame, vectors: DataFrame, model: PairClassifier) -> DataFrame:
    """(bug1, bug2, score) of pairs by their stored vectors (bug_id, vec), a batch of pairs at once."""
    a, b = (vectors.select(F.col("bug_id").alias(k), F.col("vec").alias(f"_{k}")) for k in ("bug1", "bug2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = (batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classify(model, u, v))], ["bug1", "bug2", "score"])

    return pairs.select("bug1", "bug2").join(a, "bug1").join(b, "bug2").select("bug1", "bug2", "_bug1", "_bug2").mapInArrow(run, "bug1 long, bug2 long, score double")


def score_reports(pairs: DataFrame, vectors: DataFrame, reports: DataFrame, weights: tuple[float, float, float, float, float]) -> DataFrame:
    """(bug1, bug2, score): one linear unit over equal component, closeness of priority and of creation day, and the cosine of the
    stored vectors, as a probability. ``reports``: bug_id, component, priority, day; ``weights``: of these four, and the bias."""
    known = vectors.join(reports.select("bug_id", "component", "priority", "day"), "bug_id")
    a, b = (known.select(F.col("bug_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("vec", "component", "priority", "day")]) for k in ("bug1", "bug2"))
    both = pairs.select("bug1", "bug2").join(a, "bug1").join(b, "bug2")
    same = F.coalesce((F.col("component_bug1") == F.col("component_bug2")).cast("double"), F.lit(0.0))
    gap = [F.col(f"{c}_bug1") - F.col(f"{c}_bug2") for c in ("priority", "day")]
    return both.select("bug1", "bug2", scoring.logistic_pair(same, *gap, vx.cosine(F.col("vec_bug1"), F.col("vec_bug2")), weights).alias("score"))
