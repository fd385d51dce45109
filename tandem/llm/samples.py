"""Bounded, repeatable samples of labelled documents for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Text bytes of a sample, about; rows beyond it are left out.
SAMPLE_BYTES = 48 << 20


def bounded(rows: DataFrame, key: Column, most: int, most_bytes: int = SAMPLE_BYTES) -> list:
    """The first ``most`` rows in the order of ``key``, fewer where their texts exceed ``most_bytes`` together, which
    is settled before any text is read. ``rows`` has text, ``key`` tells its rows apart but for equal ones."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = rows.select(key.alias("k"), size.alias("size")).orderBy("k", "size").limit(most).collect()
    held, n = 0, 0
    for r in sizes:
        held += r["size"]
        if n and held > most_bytes:
            break
        n += 1
    if not n:
        return []
    last = sizes[n - 1]["k"]
    near = rows.withColumn("_order", key).filter(F.col("_order") <= F.lit(last))
    return near.orderBy("_order", size, "text").limit(n).collect()


def remainder(mod: int) -> Column:
    """crc32 of the doc_id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % F.lit(mod)


def held_out(mod: int, rest: int) -> Column:
    return F.coalesce(remainder(mod) == rest, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int], mod: int = 4, rest: int = 2, seed: int = 7, extra: tuple[str, ...] = ()) -> list[tuple]:
    """(text, label, *extra) of at most ``limits[value]`` rows of each label value, never held-out ones.

    The ids are drawn by a seeded hash, so the bound holds before any text is read; a doc_id that stands
    in several documents gives its smallest text. The result has at most sum(limits) rows, and where their texts
    exceed SAMPLE_BYTES together only the first rows of the draw (one at least).
    """
    open_rows = labels.filter(~held_out(mod, rest) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    drawn = None
    for value, most in limits.items():
        part = open_rows.filter(F.col("y") == value).distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = {(r["doc_id"], r["y"]) for r in drawn.collect()}
    if not rows:
        return []
    few = docs.sparkSession.createDataFrame(sorted({(i,) for i, _ in rows}), "doc_id long")
    hits = docs.join(F.broadcast(few), "doc_id", "left_semi")  # bounded by the limits
    best = hits.groupBy("doc_id").agg(F.min(F.struct(F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)).alias("r"))
    one = best.select("doc_id", "r.*")
    found = {r["doc_id"]: r for r in bounded(one, F.xxhash64(F.col("doc_id"), F.lit(seed)), len(rows))}
    return [(found[i]["text"], y, *(found[i][c] for c in extra)) for i, y in sorted(rows) if i in found]
