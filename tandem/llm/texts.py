"""Byte-level views of Arrow text columns, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text handled at once in a Python worker; a longer document is handled alone, whole, in about 20 times its
#: size (its bytes, masks of them, and some 8-byte numbers for each word).
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch, so that batches of long documents stay small.
BATCH_ROWS = 1024


def sent_value(broadcast):
    """A broadcast's value, not kept in the worker beyond the task: workers live long and see many models."""
    value = broadcast.value
    if TaskContext.get() is not None:
        broadcast.__dict__.pop("_value", None)
    return value


def release() -> None:
    """Give freed memory back to the system at a task's end, since idle workers stand beside busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark) -> None:
    """Keep Arrow batches small; a session that sets its own size keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES, gather: bool = False) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``step`` bytes of text each; ``gather`` joins small batches."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(table[column]), 0).combine_chunks(), dtype=np.int64)
        group = (np.cumsum(lengths) - lengths) // step
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), table.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            part = table.slice(lo, hi - lo)
            if not gather:
                yield part
                continue
            held.append(part)
            size += int(lengths[lo:hi].sum())
            if size >= step:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)
    del held
    release()


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array and the n + 1 offsets of the rows in it; null is empty."""
    array = pc.fill_null(column.cast(pa.large_string()), "").combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _table(keep: range, lower: bool) -> bytes:
    out = bytearray(b" " * 256)
    for b in keep:
        out[b] = b
    if lower:
        for b in range(65, 91):
            out[b] = b + 32
    return bytes(out)


_word = bytearray(_table(range(0x80, 0x100), True))
_word[0x30:0x3A] = bytes(range(0x30, 0x3A))
_word[0x61:0x7B] = bytes(range(0x61, 0x7B))
#: Lower-cases A-Z and blanks every ASCII byte but 0-9 and a-z: ``split()`` then gives the words.
WORD_TABLE = bytes(_word)


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all non-ASCII characters."""
    return raw.translate(WORD_TABLE).split()


def run_starts(mask: np.ndarray) -> np.ndarray:
    """Index of the first element of each run of true values."""
    if not len(mask):
        return np.zeros(0, np.int64)
    prev = np.empty_like(mask)
    prev[0] = False
    prev[1:] = mask[:-1]
    return np.flatnonzero(mask & ~prev)


_WORDS = np.zeros(256, np.uint64)
_rng = np.random.default_rng(20240229)
_WORDS[:] = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes whose powers are tabulated; longer inputs are summed span by span.
_SPAN = 1 << 16
_POWERS: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}


def _powers(which: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The base's powers and inverse powers below _SPAN, and both for a whole span."""
    if which not in _POWERS:
        base = int(_BASE[which])
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(_SPAN, base, np.uint64), np.full(_SPAN, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[which] = np.multiply.accumulate(up), np.multiply.accumulate(down), pow(base, _SPAN, 1 << 64), pow(inverse, _SPAN, 1 << 64)
    return _POWERS[which]


def _prefix_sums(raw: np.ndarray, places: list[np.ndarray], which: int) -> list[np.ndarray]:
    """The polynomial's sum over raw[:place] for each place of each array; only one span's sums are held at a time."""
    orders = [np.argsort(p, kind="stable") if (p[1:] < p[:-1]).any() else None for p in places]
    sorted_ = [p if o is None else p[o] for p, o in zip(places, orders)]
    steps = np.arange(0, len(raw) + _SPAN + 1, _SPAN)
    cuts = [np.searchsorted(p, steps) for p in sorted_]
    found = [np.empty(len(p), np.uint64) for p in sorted_]
    up, _, leap, _ = _powers(which)
    far, sums = 1, np.zeros(_SPAN + 1, np.uint64)
    for k, lo in enumerate(range(0, len(raw) + 1, _SPAN)):
        part = _WORDS[raw[lo : lo + _SPAN]]
        part *= up[: len(part)]
        part *= np.uint64(far)
        part[:1] += sums[0]
        np.cumsum(part, out=sums[1 : len(part) + 1])
        for p, c, f in zip(sorted_, cuts, found):
            f[c[k] : c[k + 1]] = sums[p[c[k] : c[k + 1]] - lo]
        sums[0] = sums[len(part)]
        far = far * leap & (2**64 - 1)
    for k, o in enumerate(orders):
        if o is not None:
            back = np.empty_like(found[k])
            back[o] = found[k]
            found[k] = back
    return found


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit polynomial hash of each byte span raw[start:end]; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _, down, _, back = _powers(which)
    out, first = _prefix_sums(raw, [ends, starts], which)
    out -= first
    out *= down[starts % _SPAN]
    if len(raw) > _SPAN:
        leaps = np.array([pow(back, k, 1 << 64) for k in range(len(raw) // _SPAN + 1)], np.uint64)
        out *= leaps[starts // _SPAN]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


_WORD_LUT = np.frombuffer(WORD_TABLE, np.uint8)


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD_LUT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Translated bytes, word starts, word ends, and the first word of each row (n + 1 entries)."""
    mapped = table[raw]
    mask = mapped != 32
    first = np.zeros(len(mapped) + 1, bool)
    first[:-1] = mask
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    rows = offsets[:-1][offsets[:-1] < len(mapped)]
    begins[rows] = mask[rows]  # rows touch in the buffer: a word never spans two
    starts = np.flatnonzero(begins)
    stops = mask.copy()
    stops[:-1] &= ~mask[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = mask[last]
    ends = np.flatnonzero(stops) + 1
    return mapped, starts, ends, np.searchsorted(starts, offsets)


_space = bytearray(b"\1" * 256)
for _b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
    _space[_b] = 32
#: Blanks the ASCII white space only: spans are then the runs of ``[^\x20\x09-\x0D]+``.
SPACE_LUT = np.frombuffer(bytes(_space), np.uint8)
