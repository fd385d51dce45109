"""Quality rules: counted statistics, judged by an isolation forest (operator 8).

The rules count words (runs without ASCII white space), their code points, signs, repeated lines and words in
repeated three-word windows. Fixed rules fail short or repetitive texts outright. Of the others, an isolation
forest over ratios of the counts says how quickly random splits part a text from the rest: short mean paths
mark anomalies. The forest is fitted on all documents that the fixed rules pass: each is dealt to one tree at least, and the
trees grow level by level from the least and greatest values in each node, which Spark counts. Scores are multiples of 2**-12,
so how often each score occurs is counted exactly over all labelled rows (``labels.quality``, held-out ids excluded), and from these counts
the score up to which a text is kept is calibrated.

A null text has no words, so it fails like every short text. Repeated rows are judged alike. Without labelled
rows of both kinds the threshold lets all labelled rows pass, and without any all rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples, store, texts

#: Trees, the rows that each has at least (all, if there are fewer), and the steps of a score from 0 to 1.
TREES, LEAF_ROWS = 100, 256
GRADES = 1 << 12
LEAST_WORDS, MOST_REPEATED = 50, 50
KEEP_WEIGHT = 5.0
SIGNS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_sign = np.zeros(256, bool)
_sign[list(SIGNS)] = True
_loud = np.zeros(256, bool)
_loud[list(b"!?=_~^@\\/[]{}")] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_start = (np.arange(256) & 0xC0) != 0x80


def rule_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of every row."""
    import pandas as pd

    n = len(offsets) - 1
    _, starts, ends, edge = texts.word_spans(raw, offsets, texts.SPACE_LUT)
    n_words = np.diff(edge)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    counts = {"n_words": n_words, "word_chars": per_row(_start[raw] & (texts.SPACE_LUT[raw] != 32)), "n_symbols": per_row(_sign[raw]), "n_loud": per_row(_loud[raw]), "n_upper": per_row(_upper[raw])}

    # lines: split at \n, with a word, equal to an earlier one of the row
    begin = np.zeros(len(raw) + 1, bool)
    begin[offsets[:-1]] = True
    begin[1:] |= raw == 10
    begin[len(raw)] = False
    line = np.flatnonzero(begin)
    if len(line):
        owner = np.searchsorted(offsets, line, side="right") - 1
        end = np.minimum(np.append(line[1:], len(raw)), offsets[owner + 1])
        stop = end - ((end > line) & (raw[np.maximum(end - 1, 0)] == 10) & (end < offsets[owner + 1]))
        # a line end that closes the row leaves an empty last line, which has no word
        stop = np.where((end == offsets[owner + 1]) & (end > line) & (raw[np.maximum(end - 1, 0)] == 10), end - 1, stop)
        has_word = np.searchsorted(starts, end) > np.searchsorted(starts, line)
        line, stop, owner = line[has_word], stop[has_word], owner[has_word]
        key = texts.span_hashes(raw, line, stop) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        check = texts.span_hashes(raw, line, stop, 1)
        again = pd.DataFrame({"o": owner, "k": key, "c": check}).duplicated().to_numpy()
        counts["n_dup_lines"] = np.bincount(owner[again], minlength=n).astype(np.int64)
    else:
        counts["n_dup_lines"] = np.zeros(n, np.int64)

    # words in three-word windows that stand in the row twice or more
    total = len(starts)
    covered = np.zeros(total + 3, bool)
    if total >= 3:
        codes = pd.factorize(texts.span_hashes(raw, starts, ends))[0].astype(np.uint64)
        owner = np.repeat(np.arange(n), n_words)
        window = np.flatnonzero(owner[2:] == owner[:-2])
        # word numbers of this slice are below 2**22, so three of them with their row make an exact 2-part key
        k = pd.DataFrame({"a": (codes[window] << np.uint64(32)) | codes[window + 1], "b": (codes[window + 2] << np.uint64(32)) | owner[window].astype(np.uint64)})
        twice = window[k.duplicated(keep=False).to_numpy()]
        for j in range(3):
            covered[twice + j] = True
    sums = np.concatenate([[0], np.cumsum(covered[:total], dtype=np.int64)])
    counts["n_repeat_words"] = sums[edge[1:]] - sums[edge[:-1]]
    return counts


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees: ratios, so that a long clean text is no anomaly by its length, and of the repeats
    and signs only what exceeds a tolerated share, so that a shared line or a heading is none either."""
    words = np.maximum(1, c["n_words"])

    def excess(name: str, share: float) -> np.ndarray:
        return np.maximum(0, c[name] / words - share)

    return np.column_stack([c["word_chars"] / words, excess("n_symbols", 0.05), excess("n_loud", 0.1), excess("n_upper", 0.6), excess("n_dup_lines", 0.05), excess("n_repeat_words", 0.25)])


def tree_shares(n: int, trees: int, rows: int) -> tuple[int, float]:
    """Rows of a tree, and the share of the rows that each tree takes besides those dealt to it alone."""
    each = max(n / trees, min(rows, n))
    return round(each), max(0.0, (each / n - 1 / trees) / (1 - 1 / trees)) if n and trees > 1 else 0.0


def members(key: np.ndarray, trees: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree): each row is in one tree by its key, and in each other one with the chance ``share``."""
    key = key.astype(np.uint64)
    home = (key % np.uint64(trees)).astype(np.int64)
    if not share:
        return np.arange(len(key)), home
    with np.errstate(over="ignore"):
        mix = (key[:, None] ^ (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mix = (mix ^ (mix >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    inside = (mix >> np.uint64(11)).astype(float) < share * (1 << 53)
    inside[np.arange(len(key)), home] = True
    return np.nonzero(inside)


class IsolationForest:
    """Random axis-parallel trees; all trees as flat arrays, so that rows walk them together."""

    def __init__(self, feature: np.ndarray, split: np.ndarray, child: np.ndarray, path: np.ndarray, norm: float):
        self.feature, self.split, self.child, self.path, self.norm = feature, split, child, path, norm

    @staticmethod
    def _mean_path(n: np.ndarray | float) -> np.ndarray:
        """Mean path of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        far = np.maximum(n, 3)
        return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(far - 1) + 0.5772156649015329) - 2 * (far - 1) / far))

    @classmethod
    def grow(cls, n: int, boxes_of, trees: int = TREES, rows: int = LEAF_ROWS, seed: int = 3) -> IsolationForest:
        """``boxes_of(forest, level, share)`` gives the ``boxes`` of all rows in the trees as grown so far."""
        size, share = tree_shares(n, trees, rows)
        depth = max(1, int(np.ceil(np.log2(max(2, min(rows, n))))))
        nodes = 2 ** (depth + 1)
        own = cls(np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), np.ones((trees, nodes), bool), np.zeros((trees, nodes)), max(1e-9, float(cls._mean_path(size))))
        for level in range(depth + 1 if n else 0):
            node, count, low, high = boxes_of(own, level, share)
            order = np.argsort(node)
            t, k = np.divmod(node[order], nodes)
            count, low, high = count[order], low[order], high[order]
            own.path[t, k] = level + cls._mean_path(count)
            rng = np.random.default_rng((seed, level))
            chance, at = rng.random((trees, 2**level)), rng.random((trees, 2**level))
            spread = high > low
            splits = spread.any(axis=1) & (level < depth)
            if not splits.any():
                break
            t, k, spread, low, high = t[splits], k[splits], spread[splits], low[splits], high[splits]
            wide = spread.sum(axis=1)
            nth = np.minimum(wide - 1, (chance[t, k - 2**level] * wide).astype(np.int64)) + 1
            f = (np.cumsum(spread, axis=1) < nth[:, None]).sum(axis=1)
            lo, hi = low[np.arange(len(f)), f], high[np.arange(len(f)), f]
            own.feature[t, k], own.split[t, k], own.child[t, k] = f, lo + at[t, k - 2**level] * (hi - lo), False
            own.path[t, 2 * k] = own.path[t, 2 * k + 1] = level + 1  # of a node that no row reaches
        return own

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = LEAF_ROWS, seed: int = 3) -> IsolationForest:
        key = np.random.default_rng(seed).integers(0, 1 << 62, len(x))
        return cls.grow(len(x), lambda forest, level, share: forest.boxes([(key, x)], level, share), trees, rows, seed)

    def boxes(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], level: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tree * nodes + node, rows, least and greatest values) of the nodes of a level that the rows (key, x) reach."""
        trees, nodes = self.feature.shape
        count, low, high = np.zeros(trees * nodes, np.int64), None, None
        for key, x in parts:
            if low is None:
                low, high = np.full((trees * nodes, x.shape[1]), np.inf), np.full((trees * nodes, x.shape[1]), -np.inf)
            row, t = members(key, trees, share)
            k = np.ones(len(row), np.int64)
            for _ in range(level):
                go = ~self.child[t, k]
                row, t, k = row[go], t[go], k[go]
                k = 2 * k + (x[row, self.feature[t, k]] >= self.split[t, k])
            if not len(k):
                continue
            node = t * nodes + k
            order = np.argsort(node, kind="stable")
            node, row = node[order], row[order]
            first = np.flatnonzero(np.append(True, node[1:] > node[:-1]))
            here = node[first]
            count[here] += np.diff(np.append(first, len(node)))
            low[here] = np.minimum(low[here], np.minimum.reduceat(x[row], first))
            high[here] = np.maximum(high[here], np.maximum.reduceat(x[row], first))
        if low is None:
            low = high = np.zeros((trees * nodes, 0))
        found = np.flatnonzero(count)
        return found, count[found], low[found], high[found]

    def grade(self, x: np.ndarray) -> np.ndarray:
        """The score as a multiple of 1 / GRADES."""
        return np.round(self.score(x) * GRADES) / GRADES

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1; about 0.5 and less for ordinary rows."""
        total = np.zeros(len(x))
        depth = self.feature.shape[1].bit_length() - 1
        at_row = np.arange(len(x))
        for t in range(len(self.feature)):
            k = np.ones(len(x), np.int64)
            for _ in range(depth):
                go = ~self.child[t, k]
                if not go.any():
                    break
                step = 2 * k + (x[at_row, self.feature[t, k]] >= self.split[t, k])
                k = np.where(go, step, k)
            total += self.path[t, k]
        return np.exp2(-total / len(self.feature) / self.norm)


def calibrate(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Highest anomaly score that is kept, from the numbers of good and bad rows of each score: the cut with the best weighted
    sum of both hit rates (a lost good row costs KEEP_WEIGHT times a kept bad one), in the middle of its gap."""
    if not len(score):
        return 1.0
    if not good.sum() or not bad.sum():
        return float(score.max())
    order = np.argsort(score)
    s, good, bad = score[order], good[order], bad[order]
    gain = KEEP_WEIGHT * np.cumsum(good) / good.sum() + 1 - np.cumsum(bad) / bad.sum()
    best = int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])
    return float((s[best] + s[min(best + 1, len(s) - 1)]) / 2)


RATIOS = tuple(f"x{j}" for j in range(6))


def ratio_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, x0 to x5): what the forest sees of every document that the fixed rules pass; the key deals it to trees."""
    texts.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in texts.text_slices(batches):
            c = rule_counts(*texts.text_bytes(table["text"]))
            passed = ~base_failed(c)
            kept = table.select(["doc_id", "key"]).filter(pa.array(passed)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(kept[k].combine_chunks().cast(pa.int64()) for k in ("doc_id", "key")), *(pa.array(v) for v in statistics(c)[passed].T)], ["doc_id", "key", *RATIOS])

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(23)).alias("key"))
    return keyed.mapInArrow(scan, f"doc_id long, key long, {', '.join(f'{r} double' for r in RATIOS)}")


def _key_and_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b["key"].to_numpy(), np.column_stack([b[r].to_numpy() for r in RATIOS])


def _sent(spark, forest: IsolationForest):
    return spark.sparkContext.broadcast((forest.feature, forest.split, forest.child, forest.path, forest.norm))  # fixed size


def counted_boxes(rows: DataFrame, forest: IsolationForest, level: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``IsolationForest.boxes`` of all rows: counted in each task, then over the tasks."""
    sent = _sent(rows.sparkSession, forest)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, count, low, high = IsolationForest(*texts.sent_value(sent)).boxes(_key_and_ratios(batches), level, share)
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(count), *(pa.array(v) for v in (*low.T, *high.T))], ["node", "n", *(f"{e}{j}" for e in ("low", "high") for j in range(len(RATIOS)))])

    ends = [f"{e}{j}" for e in ("low", "high") for j in range(len(RATIOS))]
    each = rows.select("key", *RATIOS).mapInArrow(scan, f"node long, n long, {', '.join(f'{e} double' for e in ends)}")
    # a row for each node of the level
    got = each.groupBy("node").agg(F.sum("n").alias("n"), *[(F.min if e.startswith("low") else F.max)(e).alias(e) for e in ends]).toArrow()
    low, high = (np.column_stack([got[f"{e}{j}"].to_numpy() for j in range(len(RATIOS))]) for e in ("low", "high"))
    return got["node"].to_numpy(), got["n"].to_numpy(), low, high


def graded_rows(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = _sent(rows.sparkSession, forest)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = IsolationForest(*texts.sent_value(sent))
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(own.grade(np.column_stack([b[r].to_numpy() for r in RATIOS])))], ["doc_id", "score"])

    return rows.select("doc_id", *RATIOS).mapInArrow(scan, "doc_id long, score double")


def fit_rules(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest, float]:
    """A forest from all documents, and its threshold calibrated on all labelled ones."""
    rows = store.materialise(ratio_rows(docs), "rules")
    forest = IsolationForest.grow(rows.count(), lambda own, level, share: counted_boxes(rows, own, level, share))
    marks = labels.filter(~samples.held_out(4, 2) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").distinct()
    labelled = graded_rows(rows.join(marks.select("doc_id").distinct(), "doc_id", "left_semi"), forest).groupBy("doc_id", "score").count()
    # a row for each score
    found = labelled.join(marks, "doc_id").groupBy("score").agg(F.sum(F.col("count") * F.col("y")).alias("good"), F.sum(F.col("count") * (1 - F.col("y"))).alias("bad")).toArrow()
    return forest, calibrate(*(found[c].to_numpy() for c in ("score", "good", "bad")))


RULES_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double"


def judge_rules(docs: DataFrame, forest: IsolationForest, threshold: float) -> DataFrame:
    """Counts, the fixed rules' verdict, the anomaly score, and whether the document is kept."""
    texts.small_batches(docs.sparkSession)
    sent = _sent(docs.sparkSession, forest)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = IsolationForest(*texts.sent_value(sent))
        for table in texts.text_slices(batches):
            c = rule_counts(*texts.text_bytes(table["text"]))
            failed = base_failed(c)
            score = own.grade(statistics(c))
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks().cast(pa.int64()), *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(failed), pa.array(~failed & (score <= threshold)), pa.array(score, pa.float64())],
                ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, RULES_SCHEMA)
