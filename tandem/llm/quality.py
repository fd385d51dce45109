"""Quality classifier: supervised subword embeddings (operator 4).

Every token gives one hashed feature for itself and one for each of its character n-grams. A document is the
mean of its features' learned vectors; a softmax layer over that mean gives the class. Vectors and layer are
trained together by stochastic gradient descent in numpy, one document a step, with a falling rate.

Since the output is linear in the mean, a trained model is kept as one number for each feature and class
(vector times output weights), and a text is scored as the average of those numbers. Tokens are runs of word
characters or runs of signs (every non-ASCII character counts as a word character). Only the text is used.

Learning uses at most ``SAMPLE`` labelled rows, drawn by hash. A null text scores like an empty one: by the
bias alone. Without labelled rows of both classes the score is the share of the one class that was seen,
0.5 if there is none. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples, texts

SAMPLE = {1: 4000, 0: 2000}
BUCKETS = 1 << 18
DIMENSIONS = 10
NGRAMS = (3, 4, 5)
EPOCHS = 5
THRESHOLD = 0.7

_classes = np.full(256, 2, np.uint8)
_classes[[*range(0, 33), 127]] = 0
_classes[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Stands for a token that is the same as the one before it.
SAME = b"\0="
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and the first token of each row (n + 1 entries)."""
    kind = _classes[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    rows = offsets[:-1]
    new[rows[rows < len(raw)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(raw))
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Each token's number, the distinct tokens (lower-cased), and the first token of each row."""
    import pandas as pd

    low = _LOWER[raw]
    starts, ends, edge = token_spans(raw, offsets)
    codes, distinct = pd.factorize(texts.span_hashes(low, starts, ends))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    data = low.tobytes()
    tokens = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    again[edge[:-1][edge[:-1] < len(codes)]] = False
    if again.any():
        codes[again] = len(tokens)
        tokens.append(SAME)
    return codes, tokens, edge


def features(tokens: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all tokens together, and how many each has: itself and its n-grams with edges."""
    lengths = np.array([len(t) for t in tokens], np.int64) + 2
    raw = np.frombuffer(b"".join(b"<" + t + b">" for t in tokens), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    bounds = np.append(chars, len(raw))
    owner = np.searchsorted(offsets, chars, side="right") - 1
    edge = np.searchsorted(chars, offsets)
    n_chars = np.diff(edge)
    begin, end, own = [offsets[:-1]], [offsets[1:]], [np.arange(len(tokens))]
    left = edge[1:][owner] - np.arange(len(chars))
    for n in NGRAMS:
        ok = np.flatnonzero((left >= n) & (n_chars[owner] > n))
        begin.append(bounds[ok])
        end.append(bounds[ok + n])
        own.append(owner[ok])
    begin, end, own = map(np.concatenate, (begin, end, own))
    order = np.argsort(own, kind="stable")
    found = texts.span_hashes(raw, begin[order], end[order]) % np.uint64(buckets)
    return found.astype(np.int64), np.bincount(own, minlength=len(tokens))


def row_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features and their shares."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    codes, tokens, _ = distinct_tokens(raw, np.array([0, len(raw)]))
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    found, n = features(tokens)
    weight = np.repeat(np.bincount(codes), n)
    ids, inverse = np.unique(found, return_inverse=True)
    share = np.bincount(inverse, weights=weight)
    return ids, (share / share.sum()).astype(np.float32)


class SubwordModel:
    """Trained model: one number for each feature, and the bias, of class 1 against class 0."""

    def __init__(self, score: np.ndarray, bias: float):
        self.score, self.bias = score, bias

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], epochs: int = EPOCHS, rate: float = 1.0, seed: int = 11) -> SubwordModel:
        rng = np.random.default_rng(seed)
        y = np.array([r[1] for r in rows], np.int64)
        if len(set(y.tolist())) < 2:
            return cls(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else (30.0 if y[0] else -30.0))
        vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        weights = np.zeros((DIMENSIONS, 2), np.float32)
        bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
        inputs = [row_features(r[0]) for r in rows]
        steps, step = epochs * len(rows), 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                now = rate * (1 - step / steps)
                step += 1
                ids, share = inputs[k]
                hidden = share @ vectors[ids]
                logit = hidden @ weights + bias
                p = np.exp(logit - logit.max())
                error = p / p.sum()
                error[y[k]] -= 1
                back = weights @ error
                weights -= now * np.outer(hidden, error)
                bias -= 0.02 * now * error
                # the mean shares a step between its features; scaled so that a feature's step does not shrink with the text
                vectors[ids] -= now * np.minimum(1, share * 50)[:, None] * back
        return cls((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, tokens, edge = distinct_tokens(raw, offsets)
        logit = np.full(len(offsets) - 1, self.bias)
        if tokens:
            found, n = features(tokens)
            at = np.cumsum(n) - n
            each = np.add.reduceat(self.score[found], at)
            sums = np.concatenate([[0], np.cumsum(each[codes], dtype=np.float64)])
            size = np.concatenate([[0], np.cumsum(n[codes])])
            logit += (sums[edge[1:]] - sums[edge[:-1]]) / np.maximum(1, size[edge[1:]] - size[edge[:-1]])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_quality(docs: DataFrame, labels: DataFrame, limits: dict[int, int] = SAMPLE) -> SubwordModel:
    return SubwordModel.fit([r[:2] for r in samples.labelled_texts(docs, labels, "quality", limits)])


def score_quality(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id, held_out and score of every whole text; ``predicted`` is 1 from THRESHOLD on."""
    texts.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.score, model.bias))  # BUCKETS floats

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordModel(*texts.sent_value(sent))
        for table in texts.text_slices(batches):
            score = own.predict(*texts.text_bytes(table["text"]))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", samples.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
