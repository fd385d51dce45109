import pytest

from tandem.operators import configured

CONFIG = {
    "lr": 0.1,
    "summary": {"tokenizer": "white_space", "filters": ["TransformLowerCaseFilter"], "encoder_type": "cnn", "window_sizes": [3, 5]},
    "description": {"tokenizer": "non_alnum", "encoder_type": "rnn", "max_tokens": 2},
    "sum_desc": {"tokenizer": "white_space", "encoder_type": "bag"},
}


def test_columns_of_each_layout(spark):
    df = spark.createDataFrame([(1, "A b a", "b, c d", 1), (2, None, "", 2), (3, "x", "x x", 3)], "bug_id long, short_desc string, description string, other int")
    lexicon = spark.createDataFrame([("a", 2), ("b", 3), ("x", 4)], "token string, token_id long")
    got = {r["bug_id"]: r.asDict() for r in configured.plan_inputs(df, CONFIG, lexicon).collect()}
    one = got[1]
    assert (one["summary_ids"], one["summary_mask"], one["summary_length"]) == ([2, 3, 2, 0, 0], [1, 1, 1, 0, 0], 3)
    assert (one["description_ids"], one["description_mask"], one["description_length"]) == ([3, 1], [1, 1], 2)
    # "A" and "c" and "b," are unknown here, the former in the summary, the others in the description
    assert list(zip(one["sum_desc_ids"], one["sum_desc_fields"], one["sum_desc_tf"])) == [(1, 1, 1 / 6), (3, 1, 1 / 6), (2, 1, 1 / 6), (1, 2, 0.5)]
    none = got[2]
    assert (none["summary_ids"], none["summary_length"], none["description_ids"], none["description_mask"]) == ([0] * 5, 1, [0], [0])
    assert (none["sum_desc_ids"], none["sum_desc_tf"], none["sum_desc_mask"]) == ([0], [0.0], [0])
    assert got[3]["sum_desc_ids"] == [4, 4] and got[3]["sum_desc_tf"] == [1 / 3, 2 / 3]


@pytest.mark.parametrize("part", [{"encoder_type": "none"}, {"encoder_type": "rnn", "tokenizer": "none"}, {"encoder_type": "rnn", "filters": ["none"]}])
def test_unknown_names_are_errors(part):
    with pytest.raises(ValueError):
        configured.read_config({"summary": part})
    with pytest.raises(ValueError):
        configured.read_config("{}")


def test_empty_table(spark):
    df = spark.createDataFrame([], "bug_id long, short_desc string, description string")
    assert configured.plan_inputs(df, CONFIG, spark.createDataFrame([], "token string, token_id long")).collect() == []


def test_no_expression_runs_over_a_whole_list_for_each_element(spark):
    df = spark.createDataFrame([(1, "a b a", "b"), (2, None, "")], "bug_id long, short_desc string, description string")
    out = configured.plan_inputs(df, CONFIG, spark.createDataFrame([("a", 2)], "token string, token_id long"))
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["bug_id"]: r["sum_desc_tokens"] for r in out.collect()} == {1: 4, 2: 0}
