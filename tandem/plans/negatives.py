"""Queries of drawn negatives, each beside its SQL, which walks the same keyed steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import STEPS, draw_sql
from ..operators import negatives, pairs
from ..sources.views import event_reports
from .entity import FLAGGED, flagged_events
from .registry import query

_PRIMES = "[" + ", ".join(map(str, negatives.PRIMES)) + "]::BIGINT[]"


def walk_sql(name: str, anchors: str, cands: str, where: str, seed: int = 0, steps: int = 400) -> str:
    """CTEs that end in ``name``: the drawn pairs of ``operators.negatives.walk``. A walk of over ``steps`` steps ends there, which is
    far beyond what these quotas need."""
    return f"""{name}_pl AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY bug2) - 1 AS place FROM {cands}),
{name}_sz AS (SELECT list, count(*) AS n, list_min(list_filter({_PRIMES}, lambda x: x >= count(*))) AS p FROM {cands} GROUP BY list),
{name}_ky AS (SELECT a.*, n, p, {draw_sql('bug1', 'list', seed=seed)} % p AS a0, 1 + {draw_sql('bug1', 'list', seed=seed + 500_009)} % (p - 1) AS b0 FROM {anchors} a JOIN {name}_sz USING (list) WHERE quota > 0),
{name}_wk AS (SELECT *, (a0 + i * b0) % p AS place FROM (SELECT *, unnest(range(least(p, {steps}))) AS i FROM {name}_ky)),
{name} AS (SELECT * FROM {name}_wk JOIN {name}_pl USING (list, place) WHERE {where} QUALIFY row_number() OVER (PARTITION BY bug1, list ORDER BY i) <= quota)"""


def _owned(seed: int) -> str:
    lo, hi = "least(bug1, bug2)", "greatest(bug1, bug2)"
    return f"(NOT anchor2 OR ({draw_sql(lo, hi, seed=seed + 700_001)} % 2 = 0) = (bug1 < bug2))"


def _marked(name: str, reports: str, anchors: str) -> str:
    return f"{name} AS (SELECT bug_id AS bug2, root AS root2, priority AS priority2, '*' AS list, bug_id IN (SELECT bug_id FROM {anchors}) AS anchor2 FROM {reports})"


def random_sql(per: int, seed: int = 0, name: str = "rn", and_: str = "TRUE") -> str:
    """CTEs that end in ``name``: random negatives of the duplicates."""
    return f"""{name}_an AS (SELECT bug_id AS bug1, root AS root1, priority AS priority1, '*' AS list, {per} AS quota FROM fl WHERE is_dup),
{_marked(f'{name}_ca', 're', "fl WHERE is_dup")},
{walk_sql(name, f'{name}_an', f'{name}_ca', f'root1 <> root2 AND {_owned(seed)} AND {and_}', seed)}"""


def _duplicates(spark, sf_dir):
    """All reports, and the duplicates, which are the anchors."""
    r = event_reports(spark, sf_dir).select("bug_id", "root", "product", "component", "priority")
    return r, flagged_events(spark, sf_dir).filter("is_dup").select("bug_id", "root", "product", "component")


def _priorities(df, r):
    a, b = r.select(F.col("bug_id").alias("bug1"), F.col("priority").alias("p1")), r.select(F.col("bug_id").alias("bug2"), F.col("priority").alias("p2"))
    return df.join(a.hint("shuffle_hash"), "bug1").join(b.hint("shuffle_hash"), "bug2")  # not sent through the driver


@query(f"WITH {FLAGGED}, {random_sql(2)} SELECT bug1, bug2, 0 AS label FROM rn")
def random_negatives(spark, sf_dir):
    r, a = _duplicates(spark, sf_dir)
    return negatives.random_negatives(a, r, 2)


_LOSS = "round(greatest(0, 1.0 / (1 + abs(priority1 - priority2)) - 0.3), 3)"


def _with_loss(r):
    loss = F.round(F.greatest(F.lit(0.0), 1.0 / (1 + F.abs(F.col("p1") - F.col("p2"))) - 0.3), 3)
    return lambda df: _priorities(df, r).withColumn("loss", loss).drop("p1", "p2")


@query(f"WITH {FLAGGED}, {random_sql(6)}, l AS (SELECT bug1, bug2, 0 AS label, {_LOSS} AS loss FROM rn) SELECT * FROM l WHERE loss > 0 QUALIFY row_number() OVER (PARTITION BY bug1 ORDER BY loss DESC, bug2) <= 2")
def hard_k_negatives(spark, sf_dir):
    r, a = _duplicates(spark, sf_dir)
    return pairs.hardest_negatives(_with_loss(r)(negatives.random_negatives(a, r, 6)), F.col("loss"), 2)


_NON_ZERO = f"WITH {FLAGGED}, {random_sql(2, name='nz', and_=f'{_LOSS} > 0')}"


@query(f"{_NON_ZERO} SELECT bug1, bug2, 0 AS label, {_LOSS} AS loss FROM nz")
def non_zero_negatives(spark, sf_dir):
    r, a = _duplicates(spark, sf_dir)
    return negatives.non_zero_negatives(a, r, _with_loss(r), 2)


@query(f"""{_NON_ZERO}, po AS (SELECT bug_id AS bug1, dup_id AS bug2 FROM fl WHERE dup_id IS NOT NULL)
SELECT bug1, bug2, 1 AS label FROM po QUALIFY row_number() OVER (ORDER BY {draw_sql('bug1', 'bug2')}, bug1, bug2) <= floor((SELECT count(*) FROM nz) / 3.0)""")
def positives_at_rate(spark, sf_dir):
    """As many positives as keep three negatives to one, should the negatives with a loss be fewer than asked for."""
    r, a = _duplicates(spark, sf_dir)
    n = negatives.non_zero_negatives(a, r, _with_loss(r), 2).count()
    positives = event_reports(spark, sf_dir).filter("dup_id is not null").select(F.col("bug_id").alias("bug1"), F.col("dup_id").alias("bug2"), F.lit(1).alias("label"))
    return pairs.shrink_to_rate(positives, n, 3)


def _mix_sql(per: int, seed: int = 0) -> str:
    level = f"CASE {draw_sql('bug_id', 'i', seed=seed + 1)} % 3 WHEN 0 THEN '*' WHEN 1 THEN 'p|' || product ELSE 'c|' || product || '|' || component END"
    return f"""pm_an AS (SELECT bug_id AS bug1, root AS root1, {level} AS list, count(*) AS quota FROM fl, range({per}) t(i) WHERE is_dup GROUP BY ALL),
pm_ca AS (SELECT bug_id AS bug2, root AS root2, unnest(['*', 'p|' || product, 'c|' || product || '|' || component]) AS list FROM re),
{walk_sql('pm', 'pm_an', 'pm_ca', 'root1 <> root2', seed)}"""


@query(f"WITH {FLAGGED}, {_mix_sql(3)} SELECT bug1, bug2, list[1:1] AS level FROM pm")
def product_mix_negatives(spark, sf_dir):
    r, a = _duplicates(spark, sf_dir)
    return negatives.product_mix_negatives(a, r, 3)


@query(f"""WITH {FLAGGED}, {random_sql(2)}, {_mix_sql(2)}, pl AS (SELECT DISTINCT bug1, bug2 FROM pm WHERE list <> '*')
SELECT bug1, bug2, 0 AS label, 0 AS generator FROM rn WHERE {draw_sql('bug1', 'bug2', seed=0)} % {STEPS} < {STEPS // 2}
UNION ALL SELECT bug1, bug2, 0, 1 FROM pl WHERE {draw_sql('bug1', 'bug2', seed=1)} % {STEPS} < {STEPS // 2}""")
def mixture(spark, sf_dir):
    """Half of the random negatives and half of those of the anchor's product."""
    r, a = _duplicates(spark, sf_dir)
    near = negatives.product_mix_negatives(a, r, 2).filter("level <> '*'").select("bug1", "bug2").distinct()
    return pairs.mixture([(negatives.random_negatives(a, r, 2), 0.5), (near.withColumn("label", F.lit(0)), 0.5)])


@query(f"""WITH {FLAGGED}, us AS (SELECT DISTINCT least(bug_id, dup_id) AS lo, greatest(bug_id, dup_id) AS hi FROM fl WHERE dup_id IS NOT NULL),
mn_an AS (SELECT bug_id AS bug1, '*' AS list, 2 AS quota FROM fl WHERE is_dup), mn_ca AS (SELECT bug_id AS bug2, '*' AS list, FALSE AS anchor2 FROM fl WHERE NOT is_dup),
{walk_sql('mn', 'mn_an', 'mn_ca', '(least(bug1, bug2), greatest(bug1, bug2)) NOT IN (SELECT (lo, hi) FROM us)', 3)}
SELECT bug1, bug2, 0 AS label FROM mn""")
def master_negatives(spark, sf_dir):
    """Negatives among the masters, no pair twice and none that is a pair already."""
    f = flagged_events(spark, sf_dir)
    used = f.filter("dup_id is not null").select(pairs.pair_key(F.col("bug_id"), F.col("dup_id")).alias("key")).distinct()
    return negatives.unseen_master_negatives(f.filter("is_dup").select("bug_id"), f.filter("not is_dup").select("bug_id"), used, 2, seed=3)


def _half_sql(name: str, who: str, size: int, shift: int, and_: str = "TRUE") -> str:
    return f"""{name}_wh AS (SELECT bug_id, root FROM {who}), {name}_on AS (SELECT CAST(0 AS BIGINT) AS bug1, '*' AS list, {size} % (SELECT count(*) FROM {name}_wh) AS quota),
{name}_al AS (SELECT bug_id AS bug2, '*' AS list FROM {name}_wh), {walk_sql(f'{name}_mo', f'{name}_on', f'{name}_al', 'TRUE', shift, 4 * size)},
{name}_an AS (SELECT bug_id AS bug1, root AS root1, '*' AS list, {size} // (SELECT count(*) FROM {name}_wh) + CASE WHEN bug_id IN (SELECT bug2 FROM {name}_mo) THEN 1 ELSE 0 END AS quota FROM {name}_wh),
{_marked(f'{name}_ca', 're', f'{name}_wh')}, {walk_sql(name, f'{name}_an', f'{name}_ca', f'root1 <> root2 AND {_owned(shift)} AND {and_}', shift)}"""


@query(f"""WITH {FLAGGED}, {_half_sql('hr', 're', 2000, 1)},
{_half_sql('hd', 'fl WHERE is_dup', 2000, 3, '(least(bug1, bug2), greatest(bug1, bug2)) NOT IN (SELECT (least(bug1, bug2), greatest(bug1, bug2)) FROM hr)')}
SELECT bug1, bug2, 'random' AS origin FROM hr UNION ALL SELECT bug1, bug2, 'duplicate' FROM hd""")
def half_anchored_negatives(spark, sf_dir):
    """4,000 pairs, half of them for anchors among the duplicates; the number is the sample asked for."""
    r, a = _duplicates(spark, sf_dir)
    return negatives.half_anchored_negatives(r, a, 4000)


@query(f"WITH {FLAGGED}, {random_sql(8)} SELECT bug1, bug2, round(1.0 / (1 + abs(priority1 - priority2)), 6) AS score, row_number() OVER (PARTITION BY bug1 ORDER BY 1.0 / (1 + abs(priority1 - priority2)) DESC, bug2) AS rank FROM rn QUALIFY rank <= 3")
def best_of_random_negatives(spark, sf_dir):
    """The three closest of eight random negatives of each anchor."""
    r, a = _duplicates(spark, sf_dir)
    out = pairs.best_of_random(_priorities(negatives.random_negatives(a, r, 8), r), 1.0 / (1 + F.abs(F.col("p1") - F.col("p2"))), 3)
    return out.select("bug1", "bug2", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {FLAGGED}, {random_sql(8)}, l AS (SELECT bug1 AS anchor, bug2 AS cand, abs(priority1 - priority2) AS gap FROM rn),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY gap, cand) AS rank FROM l), n AS (SELECT CAST(ceil(20000.0 / count(DISTINCT anchor)) AS BIGINT) AS quota FROM r)
SELECT anchor, cand, rank, CAST(gap - 1 AS DOUBLE) AS loss FROM r WHERE gap > 1 QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY rank) <= (SELECT quota FROM n)""")
def preranked_non_zero(spark, sf_dir):
    """Of ranked lists each anchor's first candidates with a loss, so many that 20,000 pairs can come of it."""
    r, a = _duplicates(spark, sf_dir)
    drawn = _priorities(negatives.random_negatives(a, r, 8), r)
    lists = drawn.select(F.col("bug1").alias("anchor"), F.col("bug2").alias("cand"), F.abs(F.col("p1") - F.col("p2")).alias("gap"))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy("gap", "cand")).cast("long"))
    return pairs.preranked_non_zero(lists, (F.col("gap") - 1).cast("double"), 20_000)


@query(f"""WITH {FLAGGED}, {random_sql(1)}, pr AS (SELECT bug_id AS bug1, dup_id AS bug2, 1 AS label FROM fl WHERE dup_id IS NOT NULL UNION ALL SELECT bug1, bug2, 0 FROM rn)
SELECT bug1, bug2, label, CASE WHEN creation_ts < TIMESTAMP '2024-01-20' THEN 'main' ELSE 'aux' END AS part FROM pr JOIN re ON bug_id = bug1""")
def training_pairs(spark, sf_dir):
    """A positive and a negative of each duplicate, marked by the part of their first report, every label checked against the sets."""
    r, a = _duplicates(spark, sf_dir)
    e = event_reports(spark, sf_dir)
    positives = e.filter("dup_id is not null").select(F.col("bug_id").alias("bug1"), F.col("dup_id").alias("bug2"), F.lit(1).alias("label"))
    both = pairs.verified(positives.unionByName(negatives.random_negatives(a, r, 1)), r)
    part = F.when(F.col("creation_ts") < F.lit("2024-01-20").cast("timestamp"), "main").otherwise("aux")
    return both.join(e.select(F.col("bug_id").alias("bug1"), part.alias("part")), "bug1").select("bug1", "bug2", "label", "part")
