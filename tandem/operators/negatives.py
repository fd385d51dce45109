"""Negatives drawn without replacement until a quota is full or the candidates are used up.

An anchor's draws are a walk over the dense places of its candidates: from a keyed start in keyed steps modulo a prime, which meets
every place once before it repeats. Places beyond the last candidate, candidates of the anchor's own set and whatever else the
caller rules out are passed over, and the walk goes on. So an anchor has exactly min(quota, candidates that are allowed). Start and step
are MD5 numbers of the anchor and the seed: reruns agree, and SQL gives the same rows.

The walks run in rounds: each anchor that lacks some takes a stretch of its walk, twice as long as in the round before, and
only these anchors are joined again. The number of rounds grows with the logarithm of the longest walk. A round's join
is on the place, which no row holds twice, so no key is hot; each round's rows are written. Tables that grow with the reports
are joined by shuffles, never sent whole through the driver, however few bytes they have once compressed.

Null ids and null sets take no part: their comparisons are never true. Empty candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..sources.shared import written
from .pairs import dense_places, pair_key

#: Steps of a first stretch besides twice the quota.
FIRST = 8


def primes(most: int = 1 << 40, ratio: float = 1.3) -> list[int]:
    """Primes that grow by about ``ratio``, up to one above ``most``."""

    def prime(x: int) -> bool:
        return x > 1 and all(pow(a, x - 1, x) == 1 for a in (2, 3, 5, 7, 11, 13) if a < x) and all(x % d for d in range(2, min(x, 1000)))

    out, at = [2], 3
    while out[-1] <= most:
        while not prime(at):
            at += 1
        out.append(at)
        at = max(at + 1, int(at * ratio))
    return out


PRIMES = primes()


def modulus(n: Column) -> Column:
    """The walk's prime: the least of PRIMES that is not below n."""
    return F.array_min(F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda x: x >= n))


def walk(anchors: DataFrame, candidates: DataFrame, allowed: Callable[[DataFrame], DataFrame], seed: int = 0) -> DataFrame:
    """The drawn pairs, with ``nth`` from 1: anchors have bug1, list, quota, candidates bug2 and list, both maybe more columns.

    ``allowed`` takes pairs with the columns of both and gives those that count, with more columns if it likes; it must judge each
    pair by itself. (bug1, list) and (bug2, list) are distinct."""
    placed = written(dense_places(candidates.withColumnRenamed("bug2", "bug_id"), ("list",)).withColumnRenamed("bug_id", "bug2"), "places")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("_n")).withColumn("_p", modulus(F.col("_n")))
    start, step = draw("bug1", "list", seed=seed), draw("bug1", "list", seed=seed + 500_009)
    keys = anchors.join(sizes, "list").withColumns({"_a": F.pmod(start, F.col("_p")), "_b": 1 + F.pmod(step, F.col("_p") - 1)})
    todo = written(keys.filter("quota > 0").withColumns({"_from": F.lit(0).cast("long"), "_got": F.lit(0).cast("long")}), "walks")
    found, stretch = None, FIRST
    while todo.limit(1).count():
        upto = F.least(F.col("_p"), F.col("_from") + 2 * (F.col("quota") - F.col("_got")) + stretch)
        steps = todo.withColumn("_upto", upto).withColumn("_i", F.explode(F.sequence("_from", F.col("_upto") - 1)))
        steps = steps.withColumn("place", F.pmod(F.col("_a") + F.col("_i") * F.col("_b"), F.col("_p"))).filter("place < _n")
        hits = allowed(steps.join(placed.hint("shuffle_hash"), ["list", "place"]))
        nth = F.row_number().over(Window.partitionBy("bug1", "list").orderBy("_i")) + F.col("_got")
        new = hits.withColumn("nth", nth.cast("long")).filter("nth <= quota").drop("_n", "_p", "_a", "_b", "_from", "_got", "_upto", "_i", "place", "quota")
        new = written(new, "drawn")
        found = new if found is None else found.unionByName(new)
        mine = new.groupBy("bug1", "list").agg(F.max("nth").alias("_now"))
        left = todo.withColumn("_upto", upto).join(mine.hint("shuffle_hash"), ["bug1", "list"], "left").withColumn("_got", F.coalesce("_now", "_got")).withColumn("_from", F.col("_upto"))
        todo = written(left.filter("_got < quota and _from < _p").drop("_now", "_upto"), "walks")
        stretch *= 2
    if found is None:
        return allowed(todo.join(placed, "list")).withColumn("nth", F.lit(0).cast("long")).drop("_n", "_p", "_a", "_b", "_from", "_got", "place", "quota")
    return found


def owned(seed: int = 0) -> Column:
    """Whether bug1 may draw bug2: of two anchors (``anchor2``: bug2 is one) a keyed one owns their pair, so no pair is drawn from both."""
    lo, hi = F.least("bug1", "bug2"), F.greatest("bug1", "bug2")
    first = F.pmod(draw(lo, hi, seed=seed + 700_001), F.lit(2)) == 0
    return ~F.col("anchor2") | (first == (F.col("bug1") < F.col("bug2")))


def _marked(reports: DataFrame, anchors: DataFrame) -> DataFrame:
    """reports (bug_id, root and others) as candidates bug2, root2, with ``anchor2``."""
    mine = anchors.select("bug_id").distinct().withColumn("anchor2", F.lit(True))
    return reports.join(mine.hint("shuffle_hash"), "bug_id", "left").withColumn("anchor2", F.coalesce("anchor2", F.lit(False))).withColumnsRenamed({"bug_id": "bug2", "root": "root2"})


def _asking(anchors: DataFrame, quota: Column) -> DataFrame:
    return anchors.select(F.col("bug_id").alias("bug1"), F.col("root").alias("root1"), F.lit("*").alias("list"), quota.cast("long").alias("quota"))


def random_negatives(anchors: DataFrame, reports: DataFrame, per_anchor: int | Column, seed: int = 0) -> DataFrame:
    """(bug1, bug2, label): reports of other sets, no pair twice in either order. Each anchor has ``per_anchor`` (a column of its
    own, if given as one), fewer only if its set leaves it no more reports that it owns. ``anchors`` and ``reports``: bug_id, root."""
    quota = per_anchor if isinstance(per_anchor, Column) else F.lit(per_anchor)
    cands = _marked(reports.select("bug_id", "root"), anchors).withColumn("list", F.lit("*"))
    found = walk(_asking(anchors, quota), cands, lambda df: df.filter((F.col("root1") != F.col("root2")) & owned(seed)), seed)
    return found.select("bug1", "bug2", F.lit(0).alias("label"))


def non_zero_negatives(anchors: DataFrame, reports: DataFrame, score: Callable[[DataFrame], DataFrame], per_anchor: int, seed: int = 0) -> DataFrame:
    """As ``random_negatives``, of pairs whose ``loss`` (added by ``score``) is above zero; the first that the walk meets."""
    cands = _marked(reports.select("bug_id", "root"), anchors).withColumn("list", F.lit("*"))
    found = walk(_asking(anchors, F.lit(per_anchor)), cands, lambda df: score(df.filter((F.col("root1") != F.col("root2")) & owned(seed))).filter("loss > 0"), seed)
    return found.select("bug1", "bug2", F.lit(0).alias("label"), "loss")


def product_mix_negatives(anchors: DataFrame, reports: DataFrame, per_anchor: int, seed: int = 0) -> DataFrame:
    """(bug1, bug2, level): each of an anchor's draws is from all reports, its product, or its product and component, with equal
    chances; no report twice at a level, and as many at each as were drawn for it, fewer only if the list has no more."""
    keys = F.array(F.lit("*"), F.concat(F.lit("p|"), "product"), F.concat_ws("|", F.lit("c"), "product", F.col("component").cast("string")))
    cands = reports.select(F.col("bug_id").alias("bug2"), F.col("root").alias("root2"), F.explode(keys).alias("list")).filter("list is not null")
    level = F.pmod(draw("bug_id", "i", seed=seed + 1), F.lit(3)).cast("int")
    draws = anchors.select("bug_id", "root", keys.alias("keys"), F.explode(F.sequence(F.lit(0), F.lit(per_anchor - 1))).alias("i"))
    asked = draws.select(F.col("bug_id").alias("bug1"), F.col("root").alias("root1"), F.get("keys", level).alias("list")).groupBy("bug1", "root1", "list").agg(F.count(F.lit(1)).alias("quota"))
    found = walk(asked, cands, lambda df: df.filter("root1 <> root2"), seed)
    return found.select("bug1", "bug2", F.substring("list", 1, 1).alias("level"))


def unseen_master_negatives(anchors: DataFrame, masters: DataFrame, used: DataFrame, per_anchor: int, seed: int = 0) -> DataFrame:
    """(bug1, bug2, label): masters drawn for each anchor, no key of ``used`` (key) and no key twice; sets are not compared."""
    asked = anchors.select(F.col("bug_id").alias("bug1"), F.lit("*").alias("list"), F.lit(per_anchor).cast("long").alias("quota"))
    cands = _marked(masters.select("bug_id", F.lit(0).alias("root")), anchors).drop("root2").withColumn("list", F.lit("*"))

    def unseen(df: DataFrame) -> DataFrame:
        keyed = df.filter((F.col("bug1") != F.col("bug2")) & owned(seed)).withColumn("key", pair_key(F.col("bug1"), F.col("bug2")))
        return keyed.join(used.select("key"), "key", "left_anti").drop("key")

    return walk(asked, cands, unseen, seed).select("bug1", "bug2", F.lit(0).alias("label"))


def shared_quota(anchors: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """anchors (bug_id and others) with ``quota``: ``total`` shared evenly, the rest one each to anchors that a walk draws."""
    n = anchors.count()
    if not n:
        return anchors.withColumn("quota", F.lit(0).cast("long"))
    one = anchors.sparkSession.range(1).select(F.lit(0).cast("long").alias("bug1"), F.lit("*").alias("list"), F.lit(total % n).cast("long").alias("quota"))
    more = walk(one, anchors.select(F.col("bug_id").alias("bug2"), F.lit("*").alias("list")), lambda df: df, seed).select(F.col("bug2").alias("bug_id"), F.lit(1).alias("more"))
    return anchors.join(more, "bug_id", "left").withColumn("quota", F.lit(total // n).cast("long") + F.coalesce("more", F.lit(0))).drop("more")


def half_anchored_negatives(reports: DataFrame, duplicates: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """(bug1, bug2, origin): half of ``total`` pairs for anchors drawn among all reports, half for anchors drawn among the
    duplicates; pairs of different sets, none twice. ``reports`` and ``duplicates``: bug_id, root."""

    def half(origin: str, anchors: DataFrame, size: int, shift: int, taken: DataFrame | None) -> DataFrame:
        asking = shared_quota(anchors.select("bug_id", "root"), size, seed + shift)
        cands = _marked(reports.select("bug_id", "root"), anchors).withColumn("list", F.lit("*"))

        def other(df: DataFrame) -> DataFrame:
            df = df.filter((F.col("root1") != F.col("root2")) & owned(seed + shift))
            if taken is None:
                return df
            keyed = df.withColumn("key", pair_key(F.col("bug1"), F.col("bug2")))
            return keyed.join(taken.select(pair_key(F.col("bug1"), F.col("bug2")).alias("key")), "key", "left_anti").drop("key")

        return walk(_asking(asking, F.col("quota")), cands, other, seed + shift).select("bug1", "bug2", F.lit(origin).alias("origin"))

    first = half("random", reports, total - total // 2, 1, None)
    return first.unionByName(half("duplicate", duplicates, total // 2, 3, first))
