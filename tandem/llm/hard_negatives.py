"""Hard negatives by product quantisation with stored residual norms (operator 13).

Vectors become whole numbers, floor(scale * x). Codebooks of SUB components each are fitted on a bounded sample; every row is then stored
as one code byte for each codebook and the norm of what the codes leave over. For an anchor a and a row v with codes q(v), a . v lies within
|a| * |v - q(v)| of a . q(v), which is a sum of looked-up numbers. So with unit anchors the looked-up score plus and minus
the row's stored norm are rigorous bounds (the norm is widened by the rounding of 32-bit sums). They are used twice:

* positives: of the rows of the anchor's label those go on whose upper bound reaches the fifth-highest lower bound, or the
  fifth-highest exact score met so far;
* windows: of the rows of other labels those go on whose bounds meet a positive's window, and reach the fifth-highest exact score met
  in it.

What goes on is scored exactly in 64-bit integers, so the result is that of the full computation (recall 1); the bounds only
save work. Bad codes, or rows that all look alike, let more rows through and change nothing else.

Rows are dealt evenly into parts of bounded size. Anchors are a table in the shared folder that each task reads block by block, so no task or
broadcast holds all of them; each part gives at most five rows for each anchor, or each window, and these are merged by a window
function. The work is rows x anchors, as the stated query set asks.

Rows with a null label or vector, or a null or non-finite component, take no part. Each row stands for itself: a row that is repeated
is another row of its own, also as an anchor; a null vec_id is no anchor and comes last in ties. Vectors of fewer components count as
filled up with zeros. Components are held between plus and minus sqrt(2**56 / components), so that a hundred times a score fits in a long
(for 64 components a clamp at 131,072 before scaling). Other columns, of any name, are ignored; an empty table, or one without anchors, gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, texts

#: Components of a codebook and its centres.
SUB, CENTRES = 2, 256
#: Rows that the codebooks are fitted on, at most, and rounds of the fit.
SAMPLE_ROWS, ROUNDS = 4096, 6
#: Bytes of vectors of one part of the index, about.
PART_BYTES = 32 << 20
#: Rows and anchors scored together, pairs scored exactly together.
STEP_ROWS, STEP_ANCHORS, STEP_PAIRS = 2048, 256, 1 << 15
#: Anchors of one file.
FILE_ANCHORS = 8192


# --- numbers --------------------------------------------------------------------------------------------------


def fit_codebooks(sample: np.ndarray, seed: int = 5) -> np.ndarray:
    """Centres (codebook, centre, component) by k-means on each group of SUB columns of ``sample``."""
    rng = np.random.default_rng(seed)
    books = sample.shape[1] // SUB
    centres = np.zeros((books, CENTRES, SUB), np.float32)
    for m in range(books):
        x = sample[:, m * SUB : (m + 1) * SUB].astype(np.float64)
        some = np.unique(x, axis=0)
        if not len(some):
            continue
        own = some[rng.permutation(len(some))[:CENTRES]]
        for _ in range(ROUNDS if len(some) > CENTRES else 0):
            code = nearest(x, own)
            n = np.bincount(code, minlength=len(own))
            sums = np.stack([np.bincount(code, x[:, k], len(own)) for k in range(SUB)], axis=1)
            own = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], own)
        centres[m, : len(own)] = own
        centres[m, len(own) :] = own[0]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    far = (centres * centres).sum(axis=1)
    return np.concatenate([np.argmin(far - 2 * (part @ centres.T), axis=1) for part in np.split(x, range(STEP_ROWS, len(x), STEP_ROWS))])


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code bytes of each row, and the bound on how far a unit vector's looked-up score is from the true one."""
    n, m = len(vectors), len(books)
    codes = np.zeros((n, m), np.uint8)
    left, size = np.zeros(n), np.zeros(n)
    for k in range(m):
        x = vectors[:, k * SUB : (k + 1) * SUB].astype(np.float64)
        centres = books[k].astype(np.float64)
        codes[:, k] = nearest(x, centres)
        near = centres[codes[:, k]]
        left += ((x - near) ** 2).sum(axis=1)
        size += (near**2).sum(axis=1)
    bound = np.sqrt(left)
    bound += (m + 16) * 2.0**-22 * (np.sqrt(size) + bound)  # m additions of 32-bit numbers, and those of the comparison
    return codes, np.nextafter(bound.astype(np.float32), np.float32(np.inf))


def look_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores (row, anchor): for each row the sum of its codes' entries in the anchors' tables."""
    out = np.zeros((len(codes), tables.shape[2]), np.float32)
    part = np.empty_like(out)
    for table, code in zip(tables, codes.T):
        out += np.take(table, code, axis=0, out=part, mode="clip")
    return out


def dots(rows: np.ndarray, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows[i] with anchors[j]."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), STEP_PAIRS):
        at = slice(lo, lo + STEP_PAIRS)
        out[at] = np.einsum("ij,ij->i", rows[i[at]], anchors[j[at]])
    return out


class Best:
    """The best few (score, vec_id) of each of ``n`` groups: higher scores first, ties by smaller vec_id, null last."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.group, self.score, self.vec_id = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)
        #: the score that a group's newcomer must reach; very low while the group has room
        self.least = np.full(n, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, null: np.ndarray) -> None:
        if not len(group):
            return
        g, s, v, z = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.vec_id, vec_id), (self.null, null)))
        order = np.lexsort((v, z, -s, g))
        g = g[order]
        first = np.searchsorted(g, g)
        keep = np.arange(len(g)) - first < self.most
        order, place = order[keep], (np.arange(len(g)) - first)[keep]
        self.group, self.score, self.vec_id, self.null = g[keep], s[order], v[order], z[order]
        full = place == self.most - 1
        self.least[self.group[full]] = self.score[full]


class Rows:
    """A part of the index in memory."""

    def __init__(self, table: pa.Table, dims: int):
        self.vectors = matrix(table["v"], dims)
        self.codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        self.bound = table["bound"].to_numpy()
        self.row, self.label = table["row"].to_numpy(), table["label"].to_numpy()
        self.vec_id, self.null = pc.fill_null(table["vec_id"], 0).to_numpy(), pc.is_null(table["vec_id"]).to_numpy()


class Anchors:
    """A block of anchors: unit vectors' tables of looked-up numbers, and what each stands for."""

    def __init__(self, table: pa.Table, books: np.ndarray, dims: int):
        self.table = table
        self.vectors = matrix(table["v"], dims)
        self.norm = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        unit = self.vectors / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.row, self.label = table["row"].to_numpy(), table["label"].to_numpy()
        self.tables = np.matmul(books, unit.reshape(len(unit), -1, SUB).transpose(1, 2, 0).astype(np.float32))

    def unit_score(self, score: np.ndarray, which, down: bool) -> np.ndarray:
        """Scores as those of the unit anchors, rounded outwards; an anchor without length bounds nothing."""
        norm = self.norm[which]
        edge = -np.inf if down else np.inf
        with np.errstate(invalid="ignore", divide="ignore"):
            x = np.where(norm > 0, score / norm, edge)
            x = np.where(np.isfinite(x), x + np.abs(x) * (-(2.0**-20) if down else 2.0**-20), x)
        return np.nextafter(x.astype(np.float32), np.float32(edge))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as an int64 matrix of ``dims`` columns, short rows filled up with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dims), np.int64)
    limit = int(np.sqrt(2.0**56 / max(dims, 1)))
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), place] = np.clip(lists.flatten().to_numpy(zero_copy_only=False), -limit, limit)
    return out


# --- what a task does -----------------------------------------------------------------------------------------


def blocks(files: list[str], books: np.ndarray, dims: int) -> Iterator[Anchors]:
    """The anchors of a table of the shared folder, a block at a time."""
    for name in files:
        fs, path = store.filesystem(name)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=STEP_ANCHORS):
                if batch.num_rows:
                    yield Anchors(pa.Table.from_batches([batch]), books, dims)


def positives_of(rows: Rows, a: Anchors, most: int) -> Best:
    """The best rows of each anchor's own label in this part, the anchor itself left out."""
    best = Best(len(a.row), most)
    for label in np.unique(a.label):
        who = np.flatnonzero(a.label == label)
        tables = np.ascontiguousarray(a.tables[:, :, who])
        mine = np.flatnonzero(rows.label == label)
        for lo in range(0, len(mine), STEP_ROWS):
            at = mine[lo : lo + STEP_ROWS]
            score = look_up(tables, rows.codes[at])
            own = rows.row[at][:, None] == a.row[who][None, :]
            bound = rows.bound[at][:, None]
            need = a.unit_score(best.least[who], who, True)
            if len(at) > most:
                low = np.where(own, -np.inf, score - bound)
                need = np.maximum(need, np.partition(low, len(at) - most, axis=0)[len(at) - most])
            i, j = np.nonzero((score + bound >= need) & ~own)
            best.add(who[j], dots(rows.vectors, a.vectors, at[i], who[j]), rows.vec_id[at[i]], rows.null[at[i]])
    return best


def windows_of(rows: Rows, a: Anchors, most: int, low: int, high: int) -> tuple[Best, int]:
    """The best rows of other labels in each window of this part (group: anchor * windows + window), and the windows of an anchor."""
    found = a.table["windows"].to_pylist()
    wide = max(len(w) for w in found)
    top = np.zeros((len(found), wide), np.int64)
    real = np.zeros((len(found), wide), bool)
    for k, w in enumerate(found):
        top[k, : len(w)] = [x["positive_score"] for x in w]
        real[k, : len(w)] = True
    best = Best(len(found) * wide, most)
    each = np.broadcast_to(np.arange(len(found))[:, None], top.shape)
    from_ = np.where(real, a.unit_score(top * (low / 100), each, True), np.float32(np.inf))
    upto = np.where(real, a.unit_score(top * (high / 100), each, False), np.float32(-np.inf))
    for lo in range(0, len(rows.row), STEP_ROWS):
        at = slice(lo, lo + STEP_ROWS)
        score = look_up(a.tables, rows.codes[at])
        bound = rows.bound[at]
        need = np.maximum(from_, a.unit_score(best.least.reshape(top.shape), each, True))
        i, j = np.nonzero(score + bound[:, None] >= need.min(axis=1))
        other = rows.label[at][i] != a.label[j]
        i, j = i[other], j[other]
        score = score[i, j]
        upper, lower = score + bound[i], score - bound[i]
        meets = (upper[:, None] >= need[j]) & (lower[:, None] <= upto[j])
        some = meets.any(axis=1)
        i, j, meets = i[some] + lo, j[some], meets[some]
        exact = dots(rows.vectors, a.vectors, i, j)
        inside = meets & (low * top[j] <= 100 * exact[:, None]) & (100 * exact[:, None] <= high * top[j])
        pair, w = np.nonzero(inside)
        best.add(j[pair] * wide + w, exact[pair], rows.vec_id[i[pair]], rows.null[i[pair]])
    return best, wide


def _ids(best: Best) -> pa.Array:
    return pa.array(best.vec_id, pa.int64(), mask=best.null)


def parts_of(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Rows]:
    """A task's rows in parts of PART_BYTES of vectors; each part meets all anchors once."""
    held, n, most = [], 0, max(STEP_ROWS, PART_BYTES // (8 * dims))
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield Rows(pa.Table.from_batches(held), dims)
            held, n = [], 0
    if n:
        yield Rows(pa.Table.from_batches(held), dims)
    del held
    texts.release()


# --- Spark ----------------------------------------------------------------------------------------------------


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector with a null or non-finite one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def _files(path: str) -> list[str]:
    fs, folder = store.filesystem(path)
    return sorted(f"{path}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet"))


def _written(df: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    """Written in files of FILE_ANCHORS anchors, or in 8 at least, for the tasks to read."""
    path = store.shared_dir(df.sparkSession, "anchors")
    df.repartition(max(8, n // FILE_ANCHORS + 1), "row").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), _files(path)


def build_index(vectors: DataFrame, scale: int) -> tuple[DataFrame, np.ndarray, int]:
    """(row, vec_id, label, v, codes, bound) of every row that takes part, the codebooks, and the number of components."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), whole_numbers(F.col("embedding"), scale).alias("v"))
    rows = store.materialise(rows.filter("label is not null and v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = max(SUB, -(-(size["dims"] or 0) // SUB) * SUB)
    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(SAMPLE_ROWS).select("v").toArrow()
    books = fit_codebooks(matrix(drawn["v"], dims))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            code, bound = encode(matrix(table["v"], dims), books)
            packed = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("row", "vec_id", "label", "v")), packed, pa.array(bound, pa.float32())], ["row", "vec_id", "label", "v", "codes", "bound"])

    parts = max(2 * spark.sparkContext.defaultParallelism, size["n"] * dims * 8 // PART_BYTES + 1)
    texts.small_batches(spark)
    index = rows.repartition(parts, "row").mapInArrow(codes, "row long, vec_id long, label long, v array<long>, codes binary, bound float")
    return store.materialise(index, "index"), books, dims


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` per cent of the positive's. ``vectors`` has vec_id, embedding and label; ``is_anchor`` takes the vec_id."""
    index, books, dims = build_index(vectors, scale)
    anchors = index.filter(F.coalesce(is_anchor(F.col("vec_id")), F.lit(False))).select("row", "vec_id", "label", "v")
    n = anchors.count()
    anchors, files = _written(anchors, n)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts_of(batches, dims):
            for a in blocks(files, books, dims):
                best = positives_of(rows, a, positives)
                yield pa.RecordBatch.from_arrays([pa.array(a.row[best.group]), _ids(best), pa.array(best.score)], ["row", "positive_id", "positive_score"])

    found = index.mapInArrow(near, "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    first = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    grouped = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("windows"))  # ``positives`` at most
    asked, window_files = _written(anchors.join(grouped, "row"), n)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts_of(batches, dims):
            for a in blocks(window_files, books, dims):
                best, wide = windows_of(rows, a, negatives, low, high)
                who, w = best.group // wide, best.group % wide
                yield pa.RecordBatch.from_arrays([pa.array(a.row[who]), pa.array(w + 1, pa.int32()), _ids(best), pa.array(best.score)], ["row", "place", "negative_id", "negative_score"])

    hits = index.mapInArrow(inside, "row long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    pairs = asked.select("row", F.col("vec_id").alias("anchor_id"), F.inline("windows"))
    return pairs.join(ranked, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
