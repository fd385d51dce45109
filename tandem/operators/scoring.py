"""Scores of query-candidate pairs from joined postings and columns.

Pairs come from the equi-join of the query's and the candidate's postings on the token. For BM25F the queries are read block by block where the
documents are, so that pairs, which grow with queries x documents, are summed without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import blocks_of, written, written_files


#: Query terms of a block that meets the documents, and queries of it at most.
QUERY_TERMS, MOST_QUERIES = 400_000, 512
#: Document terms that a task holds; products and pairs that it sums at once.
PART_TERMS, STEP_CELLS = 1_000_000, 1 << 20
#: Steps of scores that are counted, to 1; queries that are broadcast.
STEPS_OF_ONE, SENT_QUERIES = 32, 200_000


@dataclass(frozen=True)
class Bm25fWeights:
    """Weights of one n-gram size."""

    w_sum: float = 2.0
    w_desc: float = 1.0
    b_sum: float = 0.5
    b_desc: float = 0.75
    k1: float = 2.0
    k3: float = 0.5


@dataclass(frozen=True)
class RepWeights:
    unigram: float = 0.9
    bigram: float = 0.2
    component: float = 1.0
    sub_component: float = 1.0
    report_type: float = 0.7
    version: float = 0.3
    priority: float = 0.3


def cosine_pairs(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, cand, score): dot products of unit weights; queries and docs have bug_id, token, w."""
    q = queries.select(F.col("bug_id").alias("anchor"), "token", F.col("w").alias("wq"))
    c = docs.select(F.col("bug_id").alias("cand"), "token", F.col("w").alias("wc"))
    return q.join(c, "token").filter("anchor <> cand").groupBy("anchor", "cand").agg(F.sum(F.col("wq") * F.col("wc")).alias("score"))


def bm25f_terms(post: DataFrame) -> DataFrame:
    """(bug_id, n, token, tf_sum, tf_desc, len_sum, len_desc): both fields of a token side by side."""
    both = post.groupBy("bug_id", "n", "token").agg(*[F.sum(F.when(F.col("field") == f, F.col("tf")).otherwise(0)).alias(f"tf_{f}") for f in ("sum", "desc")])
    own = Window.partitionBy("bug_id", "n")  # the tokens of one report
    return both.withColumns({f"len_{f}": F.sum(f"tf_{f}").over(own) for f in ("sum", "desc")})


def bm25f_sides(queries: DataFrame, docs: DataFrame, idf: DataFrame, averages: DataFrame, uni: Bm25fWeights = Bm25fWeights(), bi: Bm25fWeights = Bm25fWeights()) -> tuple[DataFrame, DataFrame]:
    """(anchor, n, token, iw) and (cand, n, token, dw), whose products sum to a pair's scores of each n."""

    def pick(name: str) -> Column:
        return F.when(F.col("n") == 1, getattr(uni, name)).otherwise(getattr(bi, name))

    def field(f: str) -> Column:
        b = pick(f"b_{f}")
        return pick(f"w_{f}") * F.col(f"tf_{f}") / ((1 - b) + b * F.col(f"len_{f}") / F.col(f"avg_{f}"))

    def at_least_one(f: str, value: Column) -> Column:
        return F.when(F.col(f"tf_{f}") > 0, value).otherwise(0.0)

    cand = docs.join(F.broadcast(averages), "n").withColumn("tw", at_least_one("sum", field("sum")) + at_least_one("desc", field("desc")))  # a row for each n
    cand = cand.select(F.col("bug_id").alias("cand"), "n", "token", (F.col("tw") / (pick("k1") + F.col("tw"))).alias("dw"))
    qw = pick("w_sum") * F.col("tf_sum") + pick("w_desc") * F.col("tf_desc")
    query = queries.withColumn("qw", qw).join(idf, ["n", "token"])
    query = query.select(F.col("bug_id").alias("anchor"), "n", "token", (F.col("idf") * F.coalesce(F.try_divide((pick("k3") + 1) * F.col("qw"), pick("k3") + F.col("qw")), F.lit(0.0))).alias("iw"))
    return query, cand


def bm25f_ext(queries: DataFrame, docs: DataFrame, idf: DataFrame, averages: DataFrame, uni: Bm25fWeights = Bm25fWeights(), bi: Bm25fWeights = Bm25fWeights(), w_uni: float = 0.9, w_bi: float = 0.2, same: bool = False) -> DataFrame:
    """(anchor, cand, uni, bi, score). ``idf``: n, token, idf; ``averages``: n, avg_sum, avg_desc; query and document
    terms as from ``bm25f_terms``. Without ``same`` a report is no candidate of itself."""
    query, cand = bm25f_sides(queries, docs, idf, averages, uni, bi)
    return mixed_scores(pair_sums(query_files(query), bags(cand), same), w_uni, w_bi)


def mixed_scores(sums: DataFrame, w_uni: float = 0.9, w_bi: float = 0.2) -> DataFrame:
    return sums.withColumn("score", w_uni * F.col("uni") + w_bi * F.col("bi"))


def bags(cand: DataFrame) -> DataFrame:
    """(cand, terms): the terms (n, token, dw) of a document in one row."""
    key, spark = F.concat_ws("|", "n", "token").alias("key"), cand.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # pairs are long work for few bytes
    return cand.filter("cand is not null").repartition(parts, "cand").groupBy("cand").agg(F.collect_list(F.struct(key, "dw")).alias("terms"))


def query_files(query: DataFrame) -> tuple[list[str], int]:
    """Files of one row for each query with its terms (anchor, n, token, iw), and how many rows make a block of about QUERY_TERMS terms."""
    key = F.concat_ws("|", "n", "token").alias("key")
    asks = written(query.filter("anchor is not null").groupBy("anchor").agg(F.collect_list(F.struct(key, "n", "iw")).alias("terms")), "queries")
    size = asks.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    return written_files(asks, "query_files"), max(1, min(MOST_QUERIES, QUERY_TERMS * size[0] // max(1, size[1] or 0)))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each list entry, and the entries."""
    held = lists.combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    return np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False)), held.flatten()


def _block(block: pa.Table) -> tuple:
    """Queries of a block, their distinct keys, and for each key the place, size and weights of its list of queries."""
    row, terms = _flat(block["terms"])
    codes = terms.field("key").dictionary_encode()
    code = codes.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    size = np.bincount(code, minlength=len(codes.dictionary))
    n = terms.field("n").to_numpy()[order]
    return block["anchor"].to_numpy(), codes.dictionary, np.cumsum(size) - size, size, row[order], terms.field("iw").to_numpy()[order], n


def pair_sums(queries: tuple[list[str], int], docs: DataFrame, same: bool = False) -> DataFrame:
    """(anchor, cand, uni, bi, others of docs): the sums of iw x dw over the shared tokens of n 1 and 2 for each query and document with a
    shared token. ``docs`` are ``bags``, maybe with more columns, which the pairs carry along.

    Each task reads the queries block by block and sums pairs where its documents are: neither pairs nor postings are shuffled, and what
    a task holds is bounded by the block and by PART_TERMS and STEP_CELLS, whatever the number of documents."""
    files, rows = queries
    more = [c for c in docs.columns if c not in ("cand", "terms")]

    def meet(part: pa.Table) -> Iterator[pa.RecordBatch]:
        row, terms = _flat(part["terms"])
        keys, dw, ids = terms.field("key").dictionary_encode(), terms.field("dw").to_numpy(), part["cand"].to_numpy()
        code = keys.indices.to_numpy()
        for block in blocks_of(files, rows):
            anchors, known, start, size, asks, iw, n = _block(block)
            place = pc.fill_null(pc.index_in(keys.dictionary, value_set=known), -1).to_numpy()[code]
            met = np.flatnonzero(place >= 0)
            doc, place, w = row[met], place[met], dw[met]
            work = np.cumsum(np.bincount(doc, weights=size[place], minlength=len(ids)) + len(anchors))
            step = (work // STEP_CELLS).astype(np.int64)  # documents in order, each step of about STEP_CELLS products and cells
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                at = slice(*np.searchsorted(doc, [lo, hi]))
                many = size[place[at]]
                total = int(many.sum())
                if not total:
                    continue
                mine = np.repeat(np.arange(len(many)), many)
                entry = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + start[place[at]][mine]
                cell = (doc[at] - lo)[mine] * len(anchors) + asks[entry]
                product, cells = iw[entry] * w[at][mine], (hi - lo) * len(anchors)
                touched = np.zeros(cells, bool)
                touched[cell] = True
                sums = [np.bincount(cell, weights=np.where(n[entry] == k, product, 0.0), minlength=cells) for k in (1, 2)]
                found = np.flatnonzero(touched)
                d, a = found // len(anchors) + lo, found % len(anchors)
                if not same:
                    apart = anchors[a] != ids[d]
                    found, d, a = found[apart], d[apart], a[apart]
                rest = [part[c].combine_chunks().take(pa.array(d)) for c in more]
                rest = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in rest]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[a]), pa.array(ids[d]), pa.array(sums[0][found]), pa.array(sums[1][found]), *rest], ["anchor", "cand", "uni", "bi", *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch["terms"].flatten())
            if size >= PART_TERMS:
                yield from meet(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from meet(pa.Table.from_batches(held))

    docs = docs.select(F.col("cand").cast("long").alias("cand"), "terms", *more)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.mapInArrow(run, "anchor long, cand long, uni double, bi double" + (f", {kinds}" if kinds else ""))


def best_scores(scored: Callable[[DataFrame], DataFrame], docs: DataFrame, k: int) -> DataFrame:
    """(anchor, cand, score, rank): each query's k highest scores, ties to the greater id. ``scored`` gives (anchor, cand, score) of any of
    ``docs`` (cand, ..., a written table).

    A tenth of the documents is scored first and counted in steps of the score: where k of them reach a step, so does the kth of all, and
    of all documents only pairs from that step on are shuffled. So the bound is exact, and the result that of ordering all pairs."""
    step = F.floor(F.col("score") * STEPS_OF_ONE).alias("step")
    some = scored(docs.filter(F.pmod(F.xxhash64("cand"), F.lit(10)) == 0)).groupBy("anchor", step).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("anchor").orderBy(F.desc("step")))  # the steps of one query
    least = written(some.withColumn("above", above).filter(F.col("above") >= k).groupBy("anchor").agg(F.max("step").alias("least")), "least")
    near = scored(docs).join(least, "anchor", "left") if least.count() > SENT_QUERIES else scored(docs).join(F.broadcast(least), "anchor", "left")
    near = near.filter(F.col("least").isNull() | (step >= F.col("least"))).select("anchor", "cand", "score")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.desc("cand"))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rep_extras(w: RepWeights = RepWeights(), q: str = "q", c: str = "c") -> Column:
    """Categorical part of REP: equalities and closeness of version and priority codes."""

    def equal(name: str, weight: float) -> Column:
        return F.when(F.col(f"{q}.{name}") == F.col(f"{c}.{name}"), F.lit(weight)).otherwise(0.0)

    def close(name: str, weight: float) -> Column:
        return F.lit(weight) / (1.0 + F.abs(F.col(f"{q}.{name}") - F.col(f"{c}.{name}")))

    return equal("product", w.component) + equal("component", w.sub_component) + equal("severity", w.report_type) + close("version", w.version) + close("priority", w.priority)


def most_unequal(w: RepWeights = RepWeights()) -> float:
    """The most that ``rep_extras`` gives a pair that differs in product or in component."""
    return sum((w.component, w.sub_component, w.report_type, w.version, w.priority)) - min(w.component, w.sub_component)


def ensemble(a: Column, b: Column, alpha: float) -> Column:
    return alpha * a + (1 - alpha) * b


def logistic_pair(same_component: Column, priority_gap: Column, day_gap: Column, cosine: Column, weights: tuple[float, float, float, float, float]) -> Column:
    """Probability from four pair features and a bias."""
    w0, w1, w2, w3, bias = weights
    z = w0 * same_component + w1 / (1.0 + F.abs(priority_gap)) + w2 / (1.0 + F.abs(day_gap)) + w3 * cosine + bias
    return 1.0 / (1.0 + F.exp(-z))


def shared_idf_features(pairs: DataFrame, bags: DataFrame, idfs: DataFrame) -> DataFrame:
    """(a, b, n, bag_a, bag_b, idf_name, value): idf sums of shared tokens for all bag and idf choices; bigram rows
    include the unigram ones. ``bags``: bug_id, bag, n, token (distinct); ``idfs``: idf_name, n, token, idf."""
    left = bags.select(F.col("bug_id").alias("a"), F.col("bag").alias("bag_a"), "n", "token")
    right = bags.select(F.col("bug_id").alias("b"), F.col("bag").alias("bag_b"), "n", "token")
    shared = pairs.select("a", "b").join(left, "a").join(right, ["b", "n", "token"]).join(idfs, ["n", "token"])
    sums = shared.groupBy("a", "b", "bag_a", "bag_b", "idf_name").agg(F.sum(F.when(F.col("n") == 1, F.col("idf")).otherwise(0.0)).alias("uni"), F.sum("idf").alias("uni_bi"))
    return sums


def three_bags(post: DataFrame, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """The bags of a report (either field's tokens, and both fields' together) and an idf for each of these bags."""
    rows = post.select("bug_id", F.explode(F.array("field", F.lit("both"))).alias("bag"), "n", "token").distinct()
    # a token's three counts stand in one row, so its partial counts are shuffled once
    met = rows.groupBy("n", "token").agg(*[F.count_if(F.col("bag") == b).alias(b) for b in BAGS])
    each = F.array(*[F.struct(F.lit(b).alias("idf_name"), F.col(b).alias("df")) for b in BAGS])
    idfs = met.select("n", "token", F.inline(each)).filter("df > 0").select("idf_name", "n", "token", F.log2(F.lit(float(n_docs)) / F.col("df")).alias("idf"))
    return rows, idfs


#: Names of the bags, in the order of the features.
BAGS = ("sum", "desc", "both")


def wide_features(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """The pairs with ``features``: 54 numbers, unigram sums and unigram-and-bigram sums of every two bags and idf; 0 where
    no token is shared."""
    cells = [(x, y, z) for x in BAGS for y in BAGS for z in BAGS]

    def cell(x: str, y: str, z: str, value: str) -> Column:
        mine = (F.col("bag_a") == x) & (F.col("bag_b") == y) & (F.col("idf_name") == z)
        return F.sum(F.when(mine, F.col(value)).otherwise(0.0))

    every = [cell(*c, v) for c in cells for v in ("uni", "uni_bi")]
    rows = sums.groupBy("a", "b").agg(F.array(*every).alias("features"))
    none = F.array_repeat(F.lit(0.0), 2 * len(cells))
    return pairs.join(rows, ["a", "b"], "left").withColumn("features", F.coalesce("features", none))


def svm_predictions(rows: DataFrame, held_out: Column, max_iter: int = 50) -> DataFrame:
    """(a, b, label, held_out, prediction) of all rows, learned on those that are not held out (label 1 or other) after standardising
    the features by these rows alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    given = rows.select("a", "b", "label", held_out.alias("held_out"), (F.col("label") == 1).cast("double").alias("y"), array_to_vector("features").alias("raw"))
    steps = Pipeline(stages=[StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="scaled"), LinearSVC(maxIter=max_iter, featuresCol="scaled", labelCol="y")])
    return steps.fit(given.filter("not held_out")).transform(given).select("a", "b", "label", "held_out", F.col("prediction").cast("int").alias("prediction"))


# --- losses ------------------------------------------------------------------------------------------------------


def cosine_loss(s: Column, y: Column, margin: float) -> Column:
    return y * (1 - s) + (1 - y) * F.greatest(F.lit(0.0), s - margin)


def contrastive_loss(s: Column, y: Column, margin: float) -> Column:
    return y * 0.25 * (1 - s) * (1 - s) + (1 - y) * F.when(s < margin, 0.0).otherwise(s * s)


def triplet_loss(pos: Column, neg: Column, margin: float) -> Column:
    return F.greatest(F.lit(0.0), margin - pos + neg)


def log_loss(p: Column, y: Column) -> Column:
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def alpha_sweep(pairs: DataFrame, steps: int = 100, dups: DataFrame | None = None) -> DataFrame:
    """(alpha, total): sum of reciprocal first-hit places for each mixing weight; pairs: anchor, cand, a, b, is_dup; ``dups``: those with
    is_dup, where they are cheaper to find alone.

    An anchor's place is one more than its pairs ahead of its best duplicate. Pairs are met once, not once for each weight: they are counted
    by a, b and the number of best duplicates with a greater id, which is all that a comparison reads; a pair that is lower in both than one
    duplicate is ahead at no weight and is not counted. Nothing is sorted and only partial counts are shuffled."""

    def mixed(i: Column) -> Column:
        return F.round(i / steps * F.col("a") + (1 - i / steps) * F.col("b"), 9)

    every = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")
    true = written((pairs.filter("is_dup") if dups is None else dups).select("anchor", "cand", "a", "b"), "dups")
    near = true.groupBy("anchor").agg(F.max(F.struct("b", "a")).alias("near"))
    best = true.select("*", every).groupBy("anchor", "i").agg(F.max(F.struct(mixed(F.col("i")).alias("score"), (-F.col("cand")).alias("minus"))).alias("best"))
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("i", "best.score", (-F.col("best.minus")).alias("cand")))).alias("bests"))  # steps + 1 entries
    lists = written(lists.withColumn("ids", F.array_sort(F.array_distinct(F.col("bests.cand")))).join(near, "anchor"), "bests")
    ids = lists.select("anchor", "ids", (F.col("near.a") - 1e-7).alias("high_a"), (F.col("near.b") - 1e-7).alias("high_b"))  # scores are compared to 1e-9
    met = pairs.join(ids if lists.count() > SENT_QUERIES else F.broadcast(ids), "anchor").filter((F.col("a") > F.col("high_a")) | (F.col("b") > F.col("high_b")))
    below = F.size(F.filter("ids", lambda x: x > F.col("cand"))).alias("below")
    cells = met.select("anchor", "a", "b", below).groupBy("anchor", "a", "b", "below").agg(F.count(F.lit(1)).alias("n"))
    each = cells.join(lists, "anchor").select("anchor", "a", "b", "below", "n", "ids", F.explode("bests").alias("e"))
    # a pair of the best one's score is ahead where its id is smaller: where more of the ids are above it than are above the best one's id
    above = F.size("ids") - F.array_position("ids", F.col("e.cand"))
    score = mixed(F.col("e.i"))
    ahead = (score > F.col("e.score")) | ((score == F.col("e.score")) & (F.col("below") > above))
    first = each.groupBy("e.i", "anchor").agg((F.sum(F.when(ahead, F.col("n")).otherwise(0)) + 1).alias("pos"))
    return first.groupBy("i").agg(F.sum(1.0 / F.col("pos")).alias("total")).select((F.col("i") / steps).alias("alpha"), "total")
