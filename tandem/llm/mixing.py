"""Mixing sources to target weights by subset-sum budget fitting (operator 6).

Size: words (runs without ASCII white space) of a text, 0 for null. Sources stand in code-point order, null
last, and weigh ``weights`` in turn. All sizes together are shared by weight; a target stops at ``most`` times
its source's size, and what is over is shared again by weight until none is above.

A source takes every document floor(target / size) times; the rest of its budget is fitted by once more taking
some documents. Documents are counted by exact length (the histogram is all that a source's task sees, so
its size is bounded by the number of different lengths). Each length first gets its proportional share; single
documents follow until what is left is no more than the exact step works on, which is ROOM times the longest document or
more. A bounded knapsack over all remaining counts (reachable sums as bit sets) then finds the largest sum that fits. So
the words left over are fewer than the shortest document that is left. Where words are left over, documents that were
taken are given back, the longest first, until the exact step is full, and it chooses among all of them anew; a budget within
the exact step is thus met by the best sum there is. Documents of over ``MOST_EXACT`` / ROOM words are taken longest first before
the exact step, as long as they fit.

Which documents of a length are taken is decided by a seeded hash of id and text: the k smallest,
found through counts in hash ranges, so that no task ranks a whole length or source. Rows that agree in id and text
are taken one by one like all others: of those at the last hash as many as are still needed.

Targets need only sums over the sources, so the driver holds a few numbers. Reruns agree. A null source is a
source, and so is an empty one. Empty texts have size 0 and
are taken as often as their source's base says. An empty table gives an empty mix. Extra columns, of any name, are kept by
``mix_documents`` and ignored by ``mix_report``; rows that agree in id and text stand in the order of a hash of all their
columns (maps aside), so each is a document of its own there too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import skew, store

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SEED = 17
#: Words that the exact step works on at least, and at most.
KNAPSACK_WORDS, MOST_EXACT = 1 << 16, 1 << 24
#: ... and as many of the longest documents, where that is more.
ROOM = 4
#: Hash ranges of one length: no task ranks more than one of them.
RANGE_BITS = 12

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is the largest that does not exceed ``budget``.

    The reachable sums are the bits of one integer; for each sum the step that reached it first is kept."""
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    first = np.full(budget + 1, -1, np.int32)
    for k, (length, count) in enumerate(zip(lengths, counts)):
        count = min(count, budget // length) if length else 0
        part = 1
        while count > 0 and not reach >> budget & 1:
            use = min(part, count)
            more = reach | reach << (use * length) & mask
            new = np.frombuffer((more ^ reach).to_bytes(budget // 8 + 1, "little"), np.uint8)
            some = np.flatnonzero(new)
            bits = np.unpackbits(new[some], bitorder="little").reshape(-1, 8)
            row, col = np.nonzero(bits)
            first[some[row] * 8 + col] = len(steps)
            steps.append((k, use))
            reach = more
            count -= use
            part *= 2
        if reach >> budget & 1:
            break
    best, taken = reach.bit_length() - 1, [0] * len(lengths)
    while best:  # what is left without a sum's first step was reached by earlier steps
        k, use = steps[first[best]]
        taken[k] += use
        best -= use * lengths[k]
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, limit: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each exact length to take for ``budget`` words in all."""
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total <= 0:
        return taken
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    room = int(min(max(limit, ROOM * lengths.max()), MOST_EXACT))
    share = np.where(lengths > 0, counts * (budget / total), 0)
    taken = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((lengths * taken).sum())
    for k in np.argsort(-(share - taken), kind="stable").tolist():  # one more, by the part that was cut off
        if rest <= room:
            break
        if 0 < lengths[k] <= rest and taken[k] < counts[k]:
            taken[k] += 1
            rest -= int(lengths[k])
    for k in np.argsort(-lengths, kind="stable").tolist():
        if rest <= room:
            break
        if lengths[k]:
            more = min(int(counts[k] - taken[k]), rest // int(lengths[k]))
            if lengths[k] * ROOM <= room:  # leave the exact step its room
                more = min(more, -(-(rest - room) // int(lengths[k])))
            taken[k] += more
            rest -= more * int(lengths[k])
    before, open_ = taken.copy(), rest
    rest = _exact(lengths, counts, taken, min(rest, room), share) + max(0, rest - room)
    if rest > 0:  # give taken documents back, the longest first, as far as the exact step has room, and choose anew
        space = min(open_, room)
        for k in np.argsort(-lengths, kind="stable").tolist():
            if lengths[k]:
                back = min(int(before[k]), (room - space) // int(lengths[k]))
                before[k] -= back
                space += back * int(lengths[k])
        if space > open_ and _exact(lengths, counts, before, space, share) < rest:
            taken = before
    return taken


def _exact(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, space: int, share: np.ndarray) -> int:
    """Adds to ``taken`` the documents left that fill ``space`` best; gives the words that stay free."""
    some = np.flatnonzero((lengths > 0) & (lengths <= space) & (taken < counts))
    if space <= 0 or not len(some):
        return max(0, space)
    some = some[np.argsort(-(share - taken)[some], kind="stable")]
    more = np.array(knapsack(lengths[some].tolist(), (counts - taken)[some].tolist(), space), np.int64)
    taken[some] += more
    return space - int((lengths[some] * more).sum())


def _key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, _key, _size and _hash of every row, as a written table."""
    rows = docs.select("doc_id", "source", _key(F.col("source")).alias("_key"), word_count(F.col("text")).alias("_size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_hash"))
    return store.materialise(rows, "sizes")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_key, source_size, target, base, budget) from rows (_key, source, source_size) of distinct sources."""
    # the order of all sources: ranges of them, and in each its place behind the ranges before
    ranged = store.materialise(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    if not offsets:
        return ranged.select("_key", "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("budget"))
    offset = sizes.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = store.materialise(ranged.join(F.broadcast(offset), "part").select("_key", "source_size", turn.alias("weight")), "weights")  # a row for each range

    top = F.col("source_size") * most
    total, level, seen = None, None, -1
    while True:
        full = (top < F.col("weight") * F.lit(level)) if level is not None else F.lit(False)
        r = weighed.agg(F.sum("source_size").alias("t"), F.sum(F.when(full, top).otherwise(0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(full).alias("n")).first()
        total = r["t"]
        if r["n"] == seen or not r["w"]:
            break
        seen, level = r["n"], (total - r["capped"]) / r["w"]
    target = F.least(top.cast("double"), F.col("weight") * F.lit(float(level or 0)))
    base = F.when(F.col("source_size") > 0, F.least(F.floor(target / F.col("source_size")), F.lit(most))).otherwise(1 if not total else 0).cast("long")
    out = weighed.select("_key", "source_size", target.alias("target"), base.alias("base"))
    return out.withColumn("budget", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("base") * F.col("source_size")))


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """From rows (_key, source, _size, _hash): the sources' targets, and for each (_key, _size) that takes some
    documents once more the last hash that does (``cut``), of how many rows (``ties``), and how many of these (``need``)."""
    sizes = rows.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"))
    targets = store.materialise(source_targets(sizes, weights, most), "targets")
    histogram = rows.groupBy("_key", "_size").count()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size", kind="stable")
        taken = fit_lengths(pdf["_size"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"_key": pdf["_key"], "_size": pdf["_size"], "n": pdf["count"], "take": taken})[taken > 0]

    takes = histogram.join(targets.filter("budget > 0").select("_key", "budget"), "_key").groupBy("_key").applyInPandas(fit, "_key string, _size long, n long, take long")
    takes = store.materialise(takes, "takes")
    by = ["_key", "_size"]
    zero = F.lit(0).cast("long")
    whole = takes.filter("take >= n").select(*by, F.lit(2**63 - 1).alias("cut"), zero.alias("ties"), zero.alias("need"))
    some = takes.filter("take < n").select(*by, "take", "n")
    last = _nth_hash(skew.join_counted(rows, some, by, "n", rows.count()).select(*by, "_hash", "take"), by, "_hash", "take")
    last = last.select(*by, "cut", "ties", "need")
    return targets, store.materialise(whole.unionByName(last), "cuts")


def _nth_hash(rows: DataFrame, by: list[str], value: str, nth: str) -> DataFrame:
    """(by..., cut, ties, need) from rows (by..., value, nth), nth being the same in a group: the nth smallest value, how many rows have it, and
    how many of these are among the first nth. Rows are counted by ranges of the value, then by value in one range."""
    ranged = rows.select(*by, nth, value, F.shiftright(F.col(value), 64 - RANGE_BITS).alias("span"))
    counts = ranged.groupBy(*by, nth, "span").count()
    upto = F.sum("count").over(Window.partitionBy(*by).orderBy("span"))  # 2**RANGE_BITS rows at most
    edge = counts.withColumn("upto", upto).filter(f"upto >= {nth} and upto - count < {nth}")
    edge = store.materialise(edge.select(*by, "span", (F.col(nth) - F.col("upto") + F.col("count")).alias("k"), "count"), "edges")
    near = skew.join_counted(ranged.drop(nth), edge, [*by, "span"], "count", rows.count()).groupBy(*by, "span", "k", value).agg(F.count(F.lit(1)).alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy(*by, "span").orderBy(value))
    last = near.withColumn("upto", upto).filter("upto >= k and upto - ties < k")
    return last.select(*by, F.col(value).alias("cut"), "ties", (F.col("k") - F.col("upto") + F.col("ties")).alias("need"))


def _planned(rows: DataFrame, targets: DataFrame, cuts: DataFrame, counted: DataFrame) -> DataFrame:
    """rows with the plan of their source and length; ``counted`` has the rows of each length."""
    plan = store.materialise(counted.join(cuts, ["_key", "_size"], "left").join(targets, "_key"), "plan")
    return skew.join_counted(rows, plan, ["_key", "_size"], "count", rows.count())


def _extra() -> Column:
    """Whether a row is taken once more; rows at a cut that takes only some of its equal rows are not settled here."""
    partly = (F.col("_hash") == F.col("cut")) & (F.col("need") < F.col("ties"))
    return F.when(partly, F.lit(None).cast("int")).when(F.col("_hash") <= F.col("cut"), 1).otherwise(0)


def mix_report(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    rows = _sized(docs, seed)
    targets, cuts = mix_plan(rows, weights, most)
    found = _planned(rows, targets, cuts, rows.groupBy("_key", "_size").count()).withColumn("extra", _extra()).withColumn("part", F.spark_partition_id())
    found = store.materialise(found.select("doc_id", "_key", "_size", "source_size", "target", "base", "extra", "need", "part"), "mixed")
    # equal rows at a cut: those of the first parts, whose counts come first, and inside a part the first
    open_ = found.filter("extra is null")
    by = ["_key", "_size"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    parts = open_.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    nth = F.row_number().over(Window.partitionBy(*by, "part").orderBy("doc_id"))
    settled = open_.join(parts.drop("n"), [*by, "part"]).withColumn("extra", (nth + F.col("before") <= F.col("need")).cast("int"))
    every = found.filter("extra is not null").unionByName(settled.select(*found.columns))
    return every.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("base") + F.col("extra"))).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: the documents with all their columns, each as often as it is taken."""
    rows = _sized(docs, seed)
    targets, cuts = mix_plan(rows, weights, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no column clashes with ours
    keyed = whole.select("row", _key(F.col("row.source")).alias("_key"), word_count(F.col("row.text")).alias("_size"), F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("row.text")).alias("_hash"))
    plan = store.materialise(rows.groupBy("_key", "_size").count().join(cuts, ["_key", "_size"], "left").join(targets, "_key"), "plan")
    found = skew.join_counted(keyed, plan, ["_key", "_size"], "count", rows.count())
    found = found.select("row", "_key", "_size", "_hash", "base", "need", _extra().alias("extra"))
    times = found.withColumn("times", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("int"))
    mixed = times.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy"))
    some = cuts.filter("need < ties").withColumnRenamed("cut", "_hash")
    if some.limit(1).count():  # rows of one id and text at a cut: the first in the order of all columns' hash
        by, total = ["_key", "_size", "_hash"], rows.count()
        plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        ties = skew.join_counted(keyed, some, by, "ties", total).select(*by, "need", "row", F.xxhash64(F.lit(seed), *plain).alias("all"))
        ties = store.materialise(ties, "ties")
        last = _nth_hash(ties.drop("row"), by, "all", "need").select(*by, F.col("cut").alias("at"), F.col("need").alias("left"))
        cut = skew.join_counted(ties.drop("need"), last.join(some.select(*by, "ties"), by), by, "ties", total)
        one = cut.filter(F.col("all") == F.col("at")).groupBy(*by, "left").agg(F.first("row").alias("row"))  # these rows are equal
        again = F.explode(F.array_repeat(F.lit(0), F.col("left").cast("int"))).alias("copy")
        mixed = mixed.unionByName(cut.filter(F.col("all") < F.col("at")).select("row", F.lit(0).alias("copy"))).unionByName(one.select("row", again))
    return mixed.select("row.*")
