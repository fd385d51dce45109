"""Entity resolution: first-wins dedup, master repair, cycles, chains, election.

Reports have ``bug_id`` (number), ``dup_id`` (number or null) and ``creation_ts``; all functions map DataFrames to
DataFrames. Chains are closed by pointer doubling, whose rounds grow with the logarithm of the longest chain; each
round's table is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage, written


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def master_ids(reports: DataFrame) -> DataFrame:
    return reports.withColumn("master_id", F.coalesce("dup_id", "bug_id"))


def master_sets(reports: DataFrame) -> DataFrame:
    """(master_id, bug_id): members of every master with a duplicate; the master only if it is a report."""
    dups = reports.filter("dup_id is not null").select(F.col("dup_id").alias("master_id"), "bug_id")
    heads = dups.select("master_id").distinct().join(reports.select(F.col("bug_id").alias("master_id")), "master_id", "left_semi")
    return dups.unionByName(heads.withColumn("bug_id", F.col("master_id"))).distinct()


def _absent(reports: DataFrame) -> DataFrame:
    """Reports whose master is no report."""
    known = reports.select(F.col("bug_id").alias("dup_id"))
    return reports.filter("dup_id is not null").join(known, "dup_id", "left_anti")


def repair_missing_masters(reports: DataFrame) -> DataFrame:
    """Of the duplicates of an absent master the oldest becomes master of the others."""
    heirs = _absent(reports).groupBy("dup_id").agg(F.min(F.struct("creation_ts", "bug_id")).alias("h")).select(F.col("dup_id").alias("_gone"), F.col("h.bug_id").alias("_heir"))
    joined = reports.join(heirs, F.col("dup_id") == F.col("_gone"), "left")
    fixed = F.when(F.col("_heir").isNull(), F.col("dup_id")).when(F.col("_heir") != F.col("bug_id"), F.col("_heir"))
    return joined.withColumn("dup_id", fixed).select(*reports.columns)


def dissolve_missing_masters(reports: DataFrame, keep_larger: bool = False) -> DataFrame:
    """Duplicates of an absent master are no duplicates; with ``keep_larger`` only where such a set has one member."""
    gone = _absent(reports).groupBy("dup_id").count()
    if keep_larger:
        alone = gone.filter("count = 1").select(F.col("dup_id").alias("_gone"))
        out = reports.join(alone, F.col("dup_id") == F.col("_gone"), "left")
        return repair_missing_masters(out.withColumn("dup_id", F.when(F.col("_gone").isNull(), F.col("dup_id"))).select(*reports.columns))
    out = reports.join(gone.select(F.col("dup_id").alias("_gone")), F.col("dup_id") == F.col("_gone"), "left")
    return out.withColumn("dup_id", F.when(F.col("_gone").isNull(), F.col("dup_id"))).select(*reports.columns)


def cut_two_cycles(reports: DataFrame) -> DataFrame:
    """Where two reports repeat each other the older one is the master."""
    back = reports.select(F.col("bug_id").alias("_b"), F.col("dup_id").alias("_d"), F.col("creation_ts").alias("_ts"))
    pair = reports.join(back, (F.col("dup_id") == F.col("_b")) & (F.col("bug_id") == F.col("_d")), "left")
    older = F.struct("creation_ts", "bug_id") < F.struct(F.col("_ts"), F.col("_b"))
    return pair.withColumn("dup_id", F.when(F.col("_b").isNotNull() & older, None).otherwise(F.col("dup_id"))).select(*reports.columns)


def cut_cycles(reports: DataFrame) -> DataFrame:
    """Cuts the link of the oldest member of every cycle, of any length.

    Doubled steps drop every walk that ends. Once doubling leaves the reports that walks stand on as many as they were, the steps map these
    onto themselves, so they are the members of the cycles. The ring's oldest member is found by doubling, too, until no report learns
    of an older one. So the rounds grow with the logarithm of the longest tail and the longest cycle, not of the table."""
    reports = written(reports, "reports")
    walk = reports.filter("dup_id is not null").select("bug_id", F.col("dup_id").alias("at"))
    stood_on, before = walk.select("at").distinct().count(), 0
    while stood_on != before:
        ahead = walk.select(F.col("bug_id").alias("at"), F.col("at").alias("_at"))
        walk = cut_lineage(walk.join(ahead, "at").select("bug_id", F.col("_at").alias("at")))
        stood_on, before = walk.select("at").distinct().count(), stood_on
    if not stood_on:
        return reports
    on_ring = walk.select(F.col("at").alias("bug_id")).distinct()
    ring = cut_lineage(reports.join(on_ring, "bug_id", "left_semi").select("bug_id", F.col("dup_id").alias("at"), F.struct("creation_ts", "bug_id").alias("oldest")))
    moved = True
    while moved:
        ahead = ring.select(F.col("bug_id").alias("at"), F.col("at").alias("_at"), F.col("oldest").alias("_oldest"))
        nxt = cut_lineage(ring.join(ahead, "at").select("bug_id", F.col("_at").alias("at"), F.least("oldest", "_oldest").alias("oldest"), (F.col("_oldest") < F.col("oldest")).alias("moved")))
        ring, moved = nxt.drop("moved"), nxt.filter("moved").limit(1).count() > 0
    cut = ring.filter(F.col("oldest.bug_id") == F.col("bug_id")).select(F.col("bug_id").alias("_cut"))
    out = reports.join(cut, F.col("bug_id") == F.col("_cut"), "left")
    return out.withColumn("dup_id", F.when(F.col("_cut").isNull(), F.col("dup_id"))).select(*reports.columns)


def chain_roots(reports: DataFrame) -> DataFrame:
    """(bug_id, root) of every report of an acyclic table; an absent master is a root."""
    links = reports.select("bug_id", F.coalesce("dup_id", "bug_id").alias("root"))
    while True:
        up = links.select(F.col("bug_id").alias("root"), F.col("root").alias("_up"))
        nxt = cut_lineage(links.join(up, "root", "left").select("bug_id", F.coalesce("_up", "root").alias("root"), (F.coalesce("_up", "root") != F.col("root")).alias("moved")))
        links = nxt.select("bug_id", "root")
        if not nxt.filter("moved").limit(1).count():
            return links


def close_chains(reports: DataFrame) -> DataFrame:
    """Every duplicate points to its chain's root."""
    roots = chain_roots(reports)
    return reports.join(roots, "bug_id").withColumn("dup_id", F.when(F.col("root") != F.col("bug_id"), F.col("root"))).select(*reports.columns)


def drop_orphans(reports: DataFrame) -> DataFrame:
    """Drops duplicates whose root is no report."""
    roots = chain_roots(reports)
    known = reports.select(F.col("bug_id").alias("root"))
    return reports.join(roots.join(known, "root", "left_semi"), "bug_id", "left_semi")


def elect_oldest(members: DataFrame, root: str = "root") -> DataFrame:
    """(…, new_master): the oldest (time, id) of each set, for members with a root."""
    oldest = members.groupBy(root).agg(F.min(F.struct("creation_ts", "bug_id")).alias("o")).select(F.col(root).alias("_r"), F.col("o.bug_id").alias("new_master"))
    return members.join(oldest, F.col(root) == F.col("_r")).drop("_r")


def swap_ids(members: DataFrame) -> DataFrame:
    """Where the oldest report of a set does not have its smallest id, these two exchange ids; ``original_bug_id`` keeps the old one."""
    sets = members.groupBy("root").agg(F.min("bug_id").alias("low"), F.min(F.struct("creation_ts", "bug_id"))["bug_id"].alias("old"))
    j = members.join(sets, "root")
    new = F.when(F.col("bug_id") == F.col("old"), F.col("low")).when(F.col("bug_id") == F.col("low"), F.col("old")).otherwise(F.col("bug_id"))
    return j.withColumn("original_bug_id", F.col("bug_id")).withColumn("bug_id", new).drop("low", "old")


def set_members(members: DataFrame) -> DataFrame:
    """Members of sets of two and more."""
    big = members.groupBy("root").count().filter("count > 1").select("root")
    return members.join(big, "root", "left_semi")


def normalise_resolution(reports: DataFrame) -> DataFrame:
    """DUPLICATE for duplicates, DMASTER for masters of some, NDUPLICATE for a resolution that claims to be one without."""
    masters = reports.filter("dup_id is not null").select(F.col("dup_id").alias("_m")).distinct()
    j = reports.join(masters, F.col("bug_id") == F.col("_m"), "left")
    kind = F.when(F.col("dup_id").isNotNull(), "DUPLICATE").when(F.col("_m").isNotNull(), "DMASTER").otherwise("NDUPLICATE")
    return j.withColumn("resolution", kind).drop("_m")
