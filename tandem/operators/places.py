"""Places of first true duplicates in windowed lists, counted without listing a pair.

A list's scores depend on few columns, so all anchors of one combination of them (a cell) order the reports alike. For each cell of anchors
a sweep over time knows which sets are active and how good the best member of each is so far: an anchor's place is one more than the active sets
(or reports) ahead of its own best duplicate. The sweep is a count of points by time and key in numpy, n log n for each cell, and a task holds
the reports of one group: those that agree in ``equal`` (product and component), whose pairs score above ``least``, and no other pair does.

Anchors whose best duplicate is not above ``least`` can have rivals in other groups: these have the place ``OPEN`` and are left to the caller.
Reports without an id, a time or a set take no part; a null score is behind all others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The place of an anchor that its group does not decide.
OPEN = -1


def weight_above(key: np.ndarray, weight: np.ndarray, upto: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query the sum of the weights of those of the first ``upto`` entries whose key is above ``least``; keys are not negative."""
    out, lo, hi = np.zeros(len(upto), np.int64), np.zeros(len(upto), np.int64), upto.astype(np.int64)
    if not len(key) or not len(upto):
        return out
    for b in reversed(range(int(max(key.max(), least.max())).bit_length())):
        one = (key >> b & 1).astype(bool)
        ones, sums = np.concatenate([[0], np.cumsum(one)]), np.concatenate([[0], np.cumsum(np.where(one, weight, 0))])
        up = (least >> b & 1).astype(bool)
        out += np.where(up, 0, sums[hi] - sums[lo])
        zeros = len(key) - ones[-1]
        lo, hi = (np.where(up, zeros + ones[x], x - ones[x]) for x in (lo, hi))
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        key, weight = key[order], weight[order]
    return out


def _sweep(members: pa.Table, cells: pa.Table, window_days: int, least: float, grouped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places of the anchors of a group."""
    ids, root, day, ts = (members[c].to_numpy() for c in ("bug_id", "root", "day", "at"))
    asked, here, counts = (members[c].to_numpy().astype(bool) for c in ("asked", "here", "counts"))
    at_time = np.lexsort((ids, ts))
    place = np.empty(len(ids), np.int64)
    place[at_time] = np.arange(len(ids))
    by_set = np.lexsort((place, root))  # the reports of a set side by side, in the order of time
    ids, root, day, asked, here, counts, place = (x[by_set] for x in (ids, root, day, asked, here, counts, place))
    n, number = len(ids), np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    last = np.concatenate([number[1:] != number[:-1], [True]])
    first = np.concatenate([[True], last[:-1]])
    expiry = np.searchsorted(members["day"].to_numpy()[at_time], day + window_days, side="right") - 1
    until = np.where(last, expiry, np.minimum(np.concatenate([place[1:], [n]]), expiry))  # an interval is over for places above it
    joined = ~last & (np.concatenate([place[1:], [n]]) <= expiry)  # the next report of the set comes in time
    alive = ~first & np.concatenate([[False], joined[:-1]])  # the set is active when this report comes
    # scores as levels, so that a key orders by score and then by the smaller id
    codes, score = members["cell"].combine_chunks().dictionary_encode(), cells["score"].to_numpy(zero_copy_only=False).astype(float)
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    cell, names = codes.indices.to_numpy()[by_set], {x: i for i, x in enumerate(codes.dictionary.to_pylist())}
    values, level = np.unique(np.where(np.isnan(score), -np.inf, score), return_inverse=True)
    table = np.full((len(names), len(names)), -1)
    for q, c, v in zip(cells["q_cell"].to_pylist(), cells["c_cell"].to_pylist(), level.tolist()):
        if q in names and c in names:
            table[names[q], names[c]] = v
    small = len(np.unique(ids)) - 1 - np.unique(ids, return_inverse=True)[1]
    if not grouped:  # each report is listed from its own place on, while its set is active
        start = np.flatnonzero(first | ~np.concatenate([[False], joined[:-1]]))  # islands
        island, ends = np.cumsum(np.isin(np.arange(n), start)) - 1, np.append(start[1:], n) - 1
        more = np.searchsorted(number[start], number, side="right") - island  # islands of the set from the report's own on
        who = np.repeat(np.arange(n), more)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more)
        which = island[who] + nth
        opens, closes = np.where(nth == 0, place[who], place[start[which]]), until[ends[which]]
    ids_out, places_out = [], []
    for q in np.unique(cell[asked & here & alive]):
        mine = np.flatnonzero(asked & here & alive & (cell == q))
        key = np.where(here & counts & (table[q][cell] >= 0), (table[q][cell] + 1) * n + small, 0)
        best = np.maximum.accumulate(number * ((len(values) + 2) * n) + key) - number * ((len(values) + 2) * n)
        own = best[mine - 1]  # of the set's reports before the anchor
        if grouped:
            same = joined & np.concatenate([best[1:] == best[:-1], [False]])  # the interval goes on unchanged
            o, c = np.flatnonzero(~np.concatenate([[False], same[:-1]])), np.flatnonzero(~same)
            at, k, w = np.concatenate([place[o], until[c]]), np.concatenate([best[o], best[c]]), np.repeat([1, -1], [len(o), len(c)])
        else:
            at, k, w = np.concatenate([opens, closes]), np.tile(key[who], 2), np.repeat([1, -1], len(who))
        some = k > 0
        at, k, w = at[some], k[some], w[some]
        order = np.argsort(at, kind="stable")
        at, k, w = at[order], k[order], w[order]
        high = (own >= n) & (np.append(values, -np.inf)[own // n - 1] > least)
        ahead = weight_above(k, w, np.searchsorted(at, place[mine], side="left"), own)
        ids_out.append(ids[mine])
        places_out.append(np.where(high, ahead + 1, OPEN))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *ids_out]), np.concatenate([none, *places_out])


def hit_places(reports: DataFrame, asked: Column, window_days: int, columns: tuple[str, ...], equal: tuple[str, ...], score: Column, least: float, grouped: bool = True, counts: Column | None = None) -> DataFrame:
    """(anchor, pos) of the reports that are ``asked`` and whose list has a true duplicate, ``OPEN`` where the group does not decide.

    ``score`` reads the structs ``q`` and ``c`` of ``columns``; pairs that differ in a column of ``equal`` score ``least`` at most. With ``grouped`` a set
    counts once, else each report; only candidates that satisfy ``counts`` are ranked."""
    whole = reports.filter("bug_id is not null and creation_ts is not null and root is not null")
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in equal])
    keys = [F.col(k).alias(f"g_{k}") for k in equal]
    g = [f"g_{k}" for k in equal]
    groups = whole.filter(known).select("root", *keys).distinct()  # a set has its reports in each group that holds one, for when it is active
    flags = {"asked": F.coalesce(asked, F.lit(False)), "counts": F.lit(True) if counts is None else F.coalesce(counts, F.lit(False)), "at": F.col("creation_ts"), "cell": F.to_json(F.struct(*columns))}
    held = whole.withColumns(flags).join(groups.hint("shuffle_hash"), "root")
    here = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in equal])
    held = held.withColumn("here", here).select(*g, "bug_id", "root", "day", "at", "asked", "here", "counts", "cell")
    each = whole.filter(known).select(*keys, F.to_json(F.struct(*columns)).alias("cell"), F.struct(*columns).alias("x")).dropDuplicates([*g, "cell"])
    q, c = (each.select(*g, F.col("cell").alias(f"{s}_cell"), F.col("x").alias(s)) for s in "qc")
    cells = q.filter("q_cell is not null").join(c, g).select(*g, "q_cell", "c_cell", score.alias("score"))

    def run(members: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, places = _sweep(members, pairs, window_days, least, grouped) if members.num_rows else ([], [])
        return pa.table({"anchor": pa.array(ids, pa.int64()), "pos": pa.array(places, pa.int64())})

    found = held.groupBy(*g).cogroup(cells.groupBy(*g)).applyInArrow(run, "anchor long, pos long")
    lost = whole.filter(F.coalesce(asked, F.lit(False)) & ~known).select(F.col("bug_id").alias("anchor"), F.lit(OPEN).cast("long").alias("pos"))
    return found.unionByName(lost)
