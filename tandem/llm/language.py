"""Language identification by segmentation-marginalised unigrams (operator 7).

Each language has one probability for every piece of a fixed public vocabulary. A word's probability under a
language is the sum over all its segmentations into pieces, found by the forward algorithm; a text's is the
product over its words. Piece probabilities are learned by expectation-maximisation (forward-backward over the
training words). The prediction is the language with the highest posterior under equal priors, ties to the
first in code-point order; the score is that posterior.

Words are runs of ASCII letters (lower-cased) and non-ASCII characters, of any length; the sums are scaled on the way,
so that a long run (a sentence without spaces) neither under- nor overflows. For learning only, a run of over
LONGEST characters is cut into parts of that length. A character outside the vocabulary has one small probability in all languages.
Learning uses about ``ROWS`` documents, shared evenly by all languages, or LEAST_ROWS of each where that is more
(the model grows with the number of languages), drawn by hash from the rows with a language whose ids are not held out. Null texts and texts
without a letter are ``und`` with score 0, as is every text when nothing could be learned. Repeated rows score
alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples, texts

ROWS = 6000
#: Documents of each language at least (expected), where it has so many.
LEAST_ROWS = 20
LONGEST = 64
EM_ROUNDS = 3
#: Added to every piece's expected count.
SMOOTHING = 0.01
#: Scale of a character, so that products over a word stay near 1.
SCALE = np.exp(2.5)
#: Bytes of the words that a task remembers (8 for each word and language) before it starts anew.
CACHE_BYTES = 24 << 20
#: Characters of the words whose segmentations are summed together, and of a step between two scalings.
LATTICE_CHARS, RESCALE = 200_000, 32

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LUT = np.full(256, 32, np.uint8)
_LUT[_LETTER] = np.arange(256, dtype=np.uint8)[_LETTER]
_LUT[65:91] += 32


def vocabulary(model_path: str) -> list[str]:
    """The normal pieces of a sentencepiece model; a leading mark stands for a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    every = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Lattice:
    """All pieces inside each of some words, as edges between character bounds."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        lengths = np.array([len(w) + 3 for w in words], np.int64)
        raw = np.frombuffer(b"".join(b"\xe2\x96\x81" + w for w in words), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        chars = np.flatnonzero((raw & 0xC0) != 0x80)
        bounds = np.append(chars, len(raw))
        edge = np.searchsorted(chars, offsets)
        self.n_chars = np.diff(edge)
        owner = np.repeat(np.arange(len(words)), self.n_chars)
        at = np.arange(len(chars)) - edge[:-1][owner]
        #: bounds of word w are first[w] .. first[w] + n_chars[w]
        self.first = edge[:-1] + np.arange(len(words))
        start, end, piece = [], [], []
        left = self.n_chars[owner] - at
        for n in range(1, pieces.longest + 1):
            ok = np.flatnonzero(left >= n)
            if not len(ok):
                break
            found = pieces.find(texts.span_hashes(raw, bounds[ok], bounds[ok + n]))
            if n == 1:  # a character is always a piece, if only the unknown one
                found = np.where(found < 0, pieces.unknown, found)
            hit = found >= 0
            start.append(self.first[owner[ok[hit]]] + at[ok[hit]])
            end.append(at[ok[hit]] + n)
            piece.append(found[hit])
        start, step, piece = map(np.concatenate, (start, end, piece))
        order = np.lexsort((start, step))
        self.start, self.piece, step = start[order], piece[order], step[order]
        self.cuts = np.searchsorted(step, np.arange(1, int(self.n_chars.max()) + 2))
        self.stop = self.start + pieces.length[self.piece]

    def forward(self, weight: np.ndarray, reach: int = 0, logs: np.ndarray | None = None) -> np.ndarray:
        """Sums over the segmentations up to each bound; weight: (pieces, languages).

        With ``logs`` (words, languages) the last ``reach`` bounds, all that longer segmentations build on, are
        divided by their greatest every RESCALE characters, and the divisors' logarithms are added to ``logs``."""
        alpha = np.zeros((int(self.first[-1] + self.n_chars[-1]) + 1, weight.shape[1]))
        alpha[self.first] = 1
        for end, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:]), 1):
            self._add(alpha, self.stop[lo:hi], alpha[self.start[lo:hi]] * weight[self.piece[lo:hi]])
            if logs is not None and end % RESCALE == 0:
                going = np.flatnonzero(self.n_chars > end)
                near = self.first[going][:, None] + np.arange(max(0, end - reach), end + 1)
                top = alpha[near].max(axis=1)
                alpha[near] /= top[:, None, :]
                logs[going] += np.log(top)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.zeros((int(self.first[-1] + self.n_chars[-1]) + 1, weight.shape[1]))
        beta[self.first + self.n_chars] = 1
        order = np.argsort(self.first[np.searchsorted(self.first, self.start, side="right") - 1] - self.start, kind="stable")
        begin = self.start[order] - self.first[np.searchsorted(self.first, self.start[order], side="right") - 1]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(begin)) + 1, [len(begin)]])
        for lo, hi in zip(cuts, cuts[1:]):
            e = order[lo:hi]
            self._add(beta, self.start[e], beta[self.stop[e]] * weight[self.piece[e]])
        return beta

    @staticmethod
    def _add(total: np.ndarray, where: np.ndarray, what: np.ndarray) -> None:
        if not len(where):
            return
        order = np.argsort(where, kind="stable")
        where = where[order]
        begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        total[where[begin]] += np.add.reduceat(what[order], begin, axis=0)

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.first + self.n_chars]


class Pieces:
    """The vocabulary, found by the hash of a span's bytes. The number behind the last is the unknown character."""

    def __init__(self, vocab: list[str]):
        data = [p.encode() for p in vocab]
        ends = np.cumsum([len(d) for d in data])
        key = texts.span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.length = np.array([*(len(p) for p in vocab), 1], np.int64)
        self.longest = int(self.length.max())
        self.unknown = len(vocab)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        likely = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        h = hashes[likely]
        slot = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[slot] == h
        out[likely[hit]] = self.order[slot[hit]]
        return out


def cut_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, edge: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of over LONGEST characters in parts of that length: starts, ends, and the first word of each row."""
    if not len(starts) or int((ends - starts).max()) <= LONGEST:
        return starts, ends, edge
    char = (low & 0xC0) != 0x80
    more = [starts]
    long = np.flatnonzero(ends - starts > LONGEST)
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        own = np.flatnonzero(char[a:b]) + a
        more.append(own[LONGEST::LONGEST])
    begin = np.sort(np.concatenate(more))
    owner = np.searchsorted(starts, begin, side="right") - 1
    return begin, np.minimum(np.append(begin[1:], len(low)), ends[owner]), np.searchsorted(begin, offsets)


def _distinct(raw: np.ndarray, offsets: np.ndarray, cut: bool = False) -> tuple:
    import pandas as pd

    low, starts, ends, edge = texts.word_spans(raw, offsets, _LUT)
    if cut:
        starts, ends, edge = cut_words(low, starts, ends, edge, offsets)
    codes, keys = pd.factorize(texts.span_hashes(low, starts, ends))
    first = np.empty(len(keys), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    data = low.tobytes()
    return codes, keys, [(a, b) for a, b in zip(starts[first].tolist(), ends[first].tolist())], edge, data


class LanguageModel:
    """Piece weights (scaled probabilities) of each language."""

    def __init__(self, vocab: list[str], languages: list[str], weight: np.ndarray):
        self.pieces, self.vocab, self.languages, self.weight = Pieces(vocab), vocab, languages, weight
        self.keys = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(languages)))

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], vocab: list[str], rounds: int = EM_ROUNDS) -> LanguageModel:
        languages = sorted({lang for _, lang in rows}, key=lambda x: x.encode())
        pieces = Pieces(vocab)
        scale = SCALE ** pieces.length
        weight = np.zeros((len(vocab) + 1, len(languages)))
        for k, lang in enumerate(languages):
            column = pa.chunked_array([pa.array([t for t, own in rows if own == lang], pa.string())])
            codes, keys, spans, _, data = _distinct(*texts.text_bytes(column), cut=True)
            times = np.bincount(codes, minlength=len(keys)).astype(np.float64)
            prob = np.full((len(vocab) + 1, 1), 1 / (len(vocab) + 1))
            parts = [(Lattice(pieces, [data[a:b] for a, b in spans[lo : lo + 20_000]]), times[lo : lo + 20_000]) for lo in range(0, len(spans), 20_000)]
            for _ in range(rounds):
                expected = np.full(len(vocab) + 1, SMOOTHING)
                now = prob * scale[:, None]
                for lattice, n in parts:
                    alpha, beta = lattice.forward(now), lattice.backward(now)
                    total = lattice.totals(alpha)[:, 0]
                    word = np.searchsorted(lattice.first, lattice.start, side="right") - 1
                    share = alpha[lattice.start, 0] * now[lattice.piece, 0] * beta[lattice.stop, 0] / np.maximum(total, 1e-300)[word] * n[word]
                    expected += np.bincount(lattice.piece, weights=share, minlength=len(expected))
                expected[-1] = SMOOTHING  # unknown characters tell no language
                prob = (expected / expected.sum())[:, None]
            weight[:, k] = prob[:, 0] * scale
        if len(languages):
            weight[-1] = weight[-1].min()
        return cls(vocab, languages, weight)

    def word_logs(self, keys: np.ndarray, spans: list[tuple[int, int]], data: bytes) -> np.ndarray:
        """Log probability (scaled) of each distinct word under each language; remembers words by hash."""
        if (len(self.keys) + len(keys)) * 8 * (len(self.languages) + 1) > CACHE_BYTES:
            self.keys, self.logs = self.keys[:0], self.logs[:0]
        slot = np.searchsorted(self.keys, keys)
        slot[slot == len(self.keys)] = 0
        known = self.keys[slot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            logs = []
            size = np.cumsum([spans[k][1] - spans[k][0] for k in new.tolist()])
            for part in np.split(new, np.flatnonzero(np.diff(size // LATTICE_CHARS)) + 1):
                lattice = Lattice(self.pieces, [data[slice(*spans[k])] for k in part.tolist()])
                scaled = np.zeros((len(part), len(self.languages)))
                total = lattice.totals(lattice.forward(self.weight, self.pieces.longest, scaled))
                logs.append(np.log(np.maximum(total, 1e-300)) + scaled)
            order = np.argsort(np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys = np.concatenate([self.keys, keys[new]])[order]
            self.logs = np.concatenate([self.logs, *logs])[order]
            slot = np.searchsorted(self.keys, keys)
        return self.logs[slot]

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n)
        codes, keys, spans, edge, data = _distinct(raw, offsets)
        if not len(codes):
            return ["und"] * n, np.zeros(n)
        logs = self.word_logs(keys, spans, data)
        total = np.zeros((n, len(self.languages)))
        full = np.flatnonzero(np.diff(edge))
        for k in range(len(self.languages)):
            total[full, k] = np.add.reduceat(logs[codes, k], edge[:-1][full])
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        lettered = _has_letter(raw, offsets)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, score, 0.0)


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    import regex

    ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[raw] & (raw < 128))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for k in np.flatnonzero(~out).tolist():
        own = raw[offsets[k] : offsets[k + 1]].tobytes().decode()
        out[k] = bool(regex.search(r"\p{L}", own))
    return out


def fit_language(docs: DataFrame, model_path: str, rows: int = ROWS, mod: int = 3, rest: int = 1, seed: int = 31) -> LanguageModel:
    open_rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~samples.held_out(mod, rest))
    counts = open_rows.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel([], [], np.zeros((1, 0)))
    most = max(LEAST_ROWS, rows // len(counts))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["count"])) for r in counts], "lang string, _share double")
    drawn = open_rows.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang")  # a row for each language
    drawn = drawn.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    found = [(r["text"], r["lang"]) for r in samples.bounded(drawn.select("doc_id", "text", "lang"), order, 2 * max(rows, most * len(counts)))]
    return LanguageModel.fit(found, vocabulary(model_path))


LANGUAGE_SCHEMA = "doc_id long, lang_pred string, score double"


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    texts.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.vocab, model.languages, model.weight))  # vocabulary x languages

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*texts.sent_value(sent))
        for table in texts.text_slices(batches):
            langs, score = own.predict(*texts.text_bytes(table["text"]))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(scan, LANGUAGE_SCHEMA)
    return found.select("doc_id", samples.held_out(3, 1).alias("held_out"), "lang_pred", "score")
