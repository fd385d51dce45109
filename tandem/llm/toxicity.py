"""Toxicity: a convolutional text classifier in numpy (operator 9).

Tokens (lower-cased runs of word characters, or of signs) are hashed. A word's hash that stands in LEAST_DOCS
learning rows or more owns an embedding; a rarer word takes the embedding of its stem, the hash of its first
STEMS characters (longer stems first), where that stands in as many rows; all others share one, since a maximum over
a long text would else learn rare words by heart. Filters of several widths run over the sequence, each filter keeps its maximum
over the text, and a logistic layer reads the maxima. Only the windows that reached a maximum get a gradient,
so a training step touches few embeddings. The first dimension of an embedding starts from the word's
association with the label (signed root of the log-likelihood ratio, less ASSOCIATION), the others at random.

For scoring, each filter's share of each hashed word at each offset is tabulated once (the table is bounded by
the sample); a window is then a sum of table rows. Windows never reach into the next text: padding stands between texts.

Score: the logistic output, moved by a constant so that the score is THRESHOLD where rows are cut best that the model
has not learned from: for the calibration FOLDS models are learned, each scores the rows it was not given. From the same
scores come the thresholds by language (a language with too few rows takes the common one);
``rejected`` uses them. The score itself knows the text alone.

Learning uses at most ``SAMPLE`` labelled rows, drawn by hash. Null and empty texts score as texts of padding.
Without learning rows of both classes every score is 0 (1 if all are toxic). Repeated rows score alike; extra columns are
ignored by the report and kept by ``drop_toxic``. A very long text is taken alone, with about 100 bytes for each of its
words and each filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import quality, samples, texts

SAMPLE = {1: 1500, 0: 2500}
#: A hash needs so many learning rows for an embedding of its own.
LEAST_DOCS = 6
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 3
#: Embeddings move slower than filters, by this factor.
EMBED_RATE = 0.05
THRESHOLD = 0.3
#: Associations up to this are taken for chance at the start.
ASSOCIATION = 4.0
#: A language needs so many learning rows of each class for a threshold of its own.
LEAST_ROWS = 40
#: Characters of a rare word's stems, longest first; and the models learned for the calibration.
STEMS = (6, 5, 4, 3)
FOLDS = 2
#: A clean row lost at a threshold costs so much more than a toxic one kept, each as a share of its kind.
CLEAN_WEIGHT = 3.0
#: Padding tokens between texts: the widest filter less one.
GAP = max(WIDTHS) - 1


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of every token and its stems, one row for each token, and the first token of each text (n + 1 entries).

    A word without so long a stem has its own hash there."""
    low = quality._LOWER[raw]
    starts, ends, edge = quality.token_spans(raw, offsets)
    whole = texts.span_hashes(low, starts, ends)
    out = np.empty((len(starts), 1 + len(STEMS)), np.uint64)
    out[:, 0] = whole
    chars = np.flatnonzero((low & 0xC0) != 0x80)
    first = np.searchsorted(chars, starts)
    bound = np.append(chars, np.full(max(STEMS), len(low)))
    for k, n in enumerate(STEMS, 1):
        stop = bound[first + n]
        stem = stop < ends
        out[:, k] = whole
        out[stem, k] = texts.span_hashes(low, starts[stem], stop[stem]) ^ np.uint64(n)
    return out, edge


def word_ids(hashes: np.ndarray, edge: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding numbers of all rows with GAP + 1 padding (0) behind each row, and where each row begins.

    The sorted ``keys`` own the numbers from 2 on; 1 is every token of which neither the hash nor a stem is a key."""
    ids = np.ones(len(hashes), np.int64)
    if len(keys):
        open_ = np.arange(len(hashes))
        for k in range(hashes.shape[1]):
            own = hashes[open_, k]
            slot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[slot] == own
            ids[open_[hit]] = slot[hit] + 2
            open_ = open_[~hit]
    n = np.diff(edge)
    begin = edge[:-1] + np.arange(len(n)) * (GAP + 1)
    out = np.zeros(len(ids) + len(n) * (GAP + 1), np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n) * (GAP + 1)] = ids
    return out, begin


class ConvModel:
    def __init__(self, keys: np.ndarray, table: np.ndarray, out: np.ndarray, bias: float, thresholds: dict[str, float]):
        #: (words, offsets of all widths, filters): what a word adds to each filter at each offset
        self.keys, self.table, self.out, self.bias, self.thresholds = keys, table, out, bias, thresholds

    def _maxima(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        found, k = [], 0
        ends = np.append(begin[1:], len(ids))
        for width in WIDTHS:
            total = self.table[ids, k].copy()
            for j in range(1, width):
                total[:-j] += self.table[ids[j:], k + j]
            for j in range(1, width):  # windows that would reach into the next row
                total[ends - j] = -np.inf
            k += width
            found.append(np.maximum.reduceat(total, begin, axis=0))
        return np.maximum(np.concatenate(found, axis=1), 0)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        ids, begin = word_ids(*token_hashes(raw, offsets), self.keys)
        logit = self._maxima(ids, begin).astype(np.float64) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    @classmethod
    def fit(cls, rows: list[tuple[str, int, str | None]], epochs: int = EPOCHS, rate: float = 0.1, seed: int = 5) -> ConvModel:
        """A model of all rows, calibrated by models of parts of them."""
        y = np.array([r[1] for r in rows], np.int64)
        model = cls._learn(rows, epochs, rate, seed)
        if np.bincount(y, minlength=2).min() < 2 * FOLDS:
            return model
        fold = np.zeros(len(rows), np.int64)
        for value in (0, 1):
            own = np.flatnonzero(y == value)
            fold[own] = np.arange(len(own)) % FOLDS
        score = np.zeros(len(rows))
        for k in range(FOLDS):
            part = cls._learn([r for r, f in zip(rows, fold) if f != k], epochs, rate, seed + 1 + k)
            score[fold == k] = part.scores([r[0] for r, f in zip(rows, fold) if f == k])
        model._calibrate(score, rows, y)
        return model

    def scores(self, items: list[str | None]) -> np.ndarray:
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t or "" for t in items], pa.large_string())})
        return np.concatenate([np.zeros(0), *(self.predict(*texts.text_bytes(t["text"])) for t in texts.text_slices(iter([batch])))])

    @classmethod
    def _learn(cls, rows: list[tuple[str, int, str | None]], epochs: int, rate: float, seed: int) -> ConvModel:
        spans = sum(WIDTHS)
        y = np.array([r[1] for r in rows], np.int64)
        if len(set(y.tolist())) < 2:
            level = 50.0 if len(y) and y[0] else -50.0
            return cls(np.zeros(0, np.uint64), np.zeros((2, spans, FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS), level, {})
        rng = np.random.default_rng(seed)
        hashes = []
        for text, _, _ in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            hashes.append(token_hashes(raw, np.array([0, len(raw)])))
        seen = np.sort(np.concatenate([np.unique(h) for h, _ in hashes]))
        first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        keys = seen[first[np.diff(np.append(first, len(seen))) >= LEAST_DOCS]]
        del seen, first
        embed = rng.normal(0, 0.1, (len(keys) + 2, DIMENSIONS)).astype(np.float32)
        embed[:, 0] = 0
        embed[2:, 0] = _association(hashes, y, keys)
        embed[0] = 0
        kernel = [rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for k in kernel:
            k[0, 0, : FILTERS // 2] += 0.5  # half of the filters start from the association
        shift = np.zeros((len(WIDTHS), FILTERS), np.float32)
        out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        bias = np.float32(0)
        inputs = []
        for k, (h, e) in enumerate(hashes):
            ids = word_ids(h, e, keys)[0].astype(np.int32)
            inputs.append((ids, *(a.astype(np.int32) for a in np.unique(ids, return_inverse=True))))
            hashes[k] = None
        del hashes
        weight = len(y) / (2 * np.bincount(y, minlength=2))
        steps, step = epochs * len(rows), 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                now = rate * (1 - step / steps)
                step += 1
                ids, words, inverse = inputs[k]
                own = embed[words]
                best, tops = [], []
                for i, w in enumerate(WIDTHS):
                    n = len(ids) - w + 1
                    total = (own @ kernel[i][0])[inverse[:n]]
                    for j in range(1, w):
                        total = total + (own @ kernel[i][j])[inverse[j : j + n]]
                    at = total.argmax(axis=0)
                    best.append(at)
                    tops.append(total[at, np.arange(FILTERS)] + shift[i])
                top = np.concatenate(tops)
                active = top > 0
                hidden = np.where(active, top, 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ out + bias, -30, 30))) - y[k]) * weight[y[k]]
                if abs(error) < 1e-4:
                    continue
                back = (out * error * active).reshape(len(WIDTHS), FILTERS)
                out -= now * error * hidden
                bias -= now * error
                for i, w in enumerate(WIDTHS):
                    shift[i] -= now * back[i]
                    for j in range(w):
                        at = ids[best[i] + j]
                        held = embed[at]
                        np.subtract.at(embed, at, EMBED_RATE * now * back[i][:, None] * kernel[i][j].T)
                        kernel[i][j] -= now * (held * back[i][:, None]).T
                embed[0] = 0
        table = np.concatenate([np.einsum("bd,jdf->bjf", embed, kern) for kern in kernel], axis=1)
        k = 0
        for i, w in enumerate(WIDTHS):
            table[:, k] += shift[i]
            k += w
        return cls(keys, table.astype(np.float32), out.astype(np.float64), float(bias), {})

    def _calibrate(self, score: np.ndarray, rows: list[tuple[str, int, str | None]], y: np.ndarray) -> None:
        """Move the bias so that the best common cut is THRESHOLD; then a cut for each language."""
        score = np.clip(score, 1e-12, 1 - 1e-12)
        logit = np.log(score) - np.log1p(-score)
        cut = _best_cut(logit, y, None)
        self.bias += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
        logit += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
        langs = np.array([r[2] or "" for r in rows])
        for lang in np.unique(langs):
            mine = langs == lang
            if lang and np.bincount(y[mine], minlength=2).min() >= LEAST_ROWS:
                own = _best_cut(logit[mine], y[mine], np.log(THRESHOLD / (1 - THRESHOLD)))
                self.thresholds[str(lang)] = float(1 / (1 + np.exp(-own)))


def _association(hashes: list, y: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key: root of the log-likelihood ratio of standing in toxic rows, above ASSOCIATION, signed, scaled."""
    counts = np.zeros((2, len(keys)))
    for (h, _), label in zip(hashes, y.tolist()):
        own = np.unique(h)
        slot = np.searchsorted(keys, own)
        slot = slot[(slot < len(keys)) & (keys[np.minimum(slot, len(keys) - 1)] == own)] if len(keys) else slot[:0]
        counts[label, np.unique(slot)] += 1
    expected = counts.sum(axis=0) * (np.bincount(y, minlength=2) / len(y))[:, None]
    ratio = 2 * (counts * np.log(np.maximum(counts, 1e-9) / expected)).sum(axis=0)
    root = np.sqrt(np.maximum(ratio, 0)) * np.sign(counts[1] - expected[1])
    return np.sign(root) * np.maximum(np.abs(root) - ASSOCIATION, 0) / ASSOCIATION


def _best_cut(score: np.ndarray, y: np.ndarray, prefer: float | None) -> float:
    """In the score gap with the highest weighted sum of the two classes' hit rates: its middle, or the place next to ``prefer``."""
    order = np.argsort(score, kind="stable")
    s, toxic = score[order], y[order]
    below_clean = np.concatenate([[0], np.cumsum(1 - toxic)]) / max(1, (1 - toxic).sum())
    above_toxic = (toxic.sum() - np.concatenate([[0], np.cumsum(toxic)])) / max(1, toxic.sum())
    gain = CLEAN_WEIGHT * below_clean + above_toxic
    split = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = np.flatnonzero(split & (gain >= gain[split].max() - 1e-12))
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    if prefer is None:
        k = int(best[len(best) // 2])
        return float((edges[k] + edges[k + 1]) / 2)
    quarter = (edges[best + 1] - edges[best]) / 4
    places = np.clip(prefer, edges[best] + quarter, edges[best + 1] - quarter)
    return float(places[np.abs(places - prefer).argmin()])


def fit_toxicity(docs: DataFrame, labels: DataFrame, limits: dict[int, int] = SAMPLE) -> ConvModel:
    return ConvModel.fit(samples.labelled_texts(docs, labels, "toxic", limits, extra=("lang",)))


def _send(spark, model: ConvModel):
    return spark.sparkContext.broadcast((model.keys, model.table, model.out, model.bias, model.thresholds))  # bounded by the sample


def score_toxicity(docs: DataFrame, model: ConvModel) -> DataFrame:
    """doc_id, held_out, score, predicted (at THRESHOLD) and rejected (at the language's threshold)."""
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    texts.small_batches(spark)
    sent = _send(spark, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ConvModel(*texts.sent_value(sent))
        for table in texts.text_slices(batches):
            score = own.predict(*texts.text_bytes(table["text"]))
            cut = np.array([own.thresholds.get(x, THRESHOLD) for x in table["lang"].to_pylist()])
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(score, pa.float64()), pa.array(score >= cut, pa.bool_())], ["doc_id", "score", "rejected"])

    scored = docs.select("doc_id", "text", "lang").mapInArrow(scan, "doc_id long, score double, rejected boolean")
    return scored.select("doc_id", samples.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "rejected")


def drop_toxic(docs: DataFrame, model: ConvModel) -> DataFrame:
    """The rows of ``docs`` with all columns, less those at or above their language's threshold."""
    spark = docs.sparkSession
    texts.small_batches(spark)
    sent = _send(spark, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ConvModel(*texts.sent_value(sent))
        for table in texts.text_slices(batches):
            score = own.predict(*texts.text_bytes(table["text"]))
            cut = np.array([own.thresholds.get(x, THRESHOLD) for x in table["lang"].to_pylist()])
            yield from table.filter(pa.array(score < cut)).combine_chunks().to_batches()

    return docs.mapInArrow(keep, docs.schema)
