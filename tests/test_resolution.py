from datetime import datetime, timedelta

from tandem.operators import resolve, splits

T0 = datetime(2024, 1, 1)


def reports(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(days=t), d, f"p{i % 2}") for i, t, d in rows], "bug_id long, creation_ts timestamp, dup_id long, product string")


FIXTURE = [(1, 1, None), (2, 2, 1), (3, 3, 2), (4, 4, 99), (5, 5, 99), (6, 6, 7), (7, 7, 6), (8, 0, None), (9, 9, 8), (10, 10, None)]


def test_resolution_fixture(spark):
    r = resolve.repair_missing_masters(reports(spark, FIXTURE))
    r = resolve.close_chains(resolve.cut_cycles(r))
    roots = {x["bug_id"]: x["root"] for x in resolve.chain_roots(r).collect()}
    assert roots == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10}


def test_dissolve(spark):
    got = {x["bug_id"]: x["dup_id"] for x in resolve.dissolve_missing_masters(reports(spark, FIXTURE)).collect()}
    assert got[4] is None and got[5] is None and got[2] == 1


def test_cycles_of_any_length(spark):
    rows = [(1, 5, 2), (2, 4, 3), (3, 9, 1), (4, 1, 3), (5, 2, 5 + 1), (6, 3, 5), (7, 1, None), (8, 2, 8)]
    got = {x["bug_id"]: x["dup_id"] for x in resolve.cut_cycles(reports(spark, rows)).collect()}
    assert got == {1: 2, 2: None, 3: 1, 4: 3, 5: None, 6: 5, 7: None, 8: None}


def test_duplicate_flag_and_splits(spark):
    r = resolve.close_chains(resolve.cut_cycles(resolve.repair_missing_masters(reports(spark, FIXTURE))))
    r = r.join(resolve.chain_roots(r), "bug_id")
    f = splits.flag_duplicates(r)
    assert sorted(x["bug_id"] for x in f.filter("is_dup").collect()) == [2, 3, 5, 7, 9]
    train = {x["bug_id"] for x in splits.split_percent(f, 0.4).filter("split = 'train'").collect()}
    assert train == {8, 1, 2, 3, 4, 5, 6, 7}
    first = {x["bug_id"] for x in splits.split_first_n(f, 2).filter("split = 'train'").collect()}
    assert first == {8, 1, 2, 3}
    part = splits.carve_validation(splits.split_percent(f, 0.4).filter("split = 'train'"), 0.5)
    assert {x["bug_id"] for x in part.filter("part = 'validation'").collect()} == {6, 7}


def test_empty_tables(spark):
    e = reports(spark, [])
    assert resolve.chain_roots(e).count() == 0
    assert resolve.cut_cycles(e).count() == 0
    assert splits.split_first_n(splits.flag_duplicates(e.withColumnRenamed("dup_id", "root")), 3).count() == 0


def test_rounds_grow_with_the_longest_cycle_not_the_table(spark, monkeypatch):
    """Hundreds of rings of three and tails of two need few rounds."""
    rounds, whole = [], resolve.cut_lineage
    monkeypatch.setattr(resolve, "cut_lineage", lambda df: rounds.append(1) or whole(df))
    rows = [x for k in range(0, 1500, 5) for x in ((k, k + 1, 3), (k + 1, k + 2, 1), (k + 2, k, 2), (k + 3, k, 4), (k + 4, k + 3, 5))]
    r = spark.createDataFrame(rows, "bug_id long, dup_id long, creation_ts long")
    got = {x["bug_id"]: x["dup_id"] for x in resolve.cut_cycles(r).collect()}
    assert got == {b: None if t == 1 else d for b, d, t in rows}
    assert len(rounds) <= 8
