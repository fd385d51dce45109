import json

from tandem.sources import reports as rp


def write(path, text):
    path.write_text(text)
    return str(path)


def test_reports_and_split_files(spark, tmp_path):
    rows = [{"bug_id": "1", "dup_id": [], "short_desc": " a ", "description": [], "creation_ts": "2008-01-02 03:04:05 +0200"}, {"bug_id": "2", "dup_id": "1", "short_desc": "b", "description": "x", "creation_ts": "2008-01-03 03:04:05 +0000"}]
    path = write(tmp_path / "r.json", "\n".join(map(json.dumps, rows)) + "\n\n")
    got = {r["bug_id"]: r for r in rp.read_reports(spark, path).collect()}
    assert got["1"]["dup_id"] is None and got["2"]["dup_id"] == "1" and got["1"]["description"] == ""
    assert got["1"]["creation_ts"].timestamp() == 1199235845
    split = rp.read_split(spark, write(tmp_path / "s.txt", "info\n3 1 2\n1 2"))
    assert [(r["bug_id"], r["is_duplicate"]) for r in split.orderBy("position").collect()] == [("3", False), ("1", True), ("2", True)]
    rp.write_split(split, str(tmp_path / "out"), "info")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()][0].split("\n")[:3] == ["info", "3 1 2", "1 2"]


def test_pairs_with_footer(spark, tmp_path):
    path = write(tmp_path / "p.txt", '1,2,1\n3,4,-1\n\n{"validations": [{"k": 0.5, "indexes": [0, 1]}]}\n')
    pairs, val = rp.read_pairs_with_footer(spark, path)
    assert sorted((r["bug1"], r["label"]) for r in pairs.collect()) == [("1", 1), ("3", -1)]
    assert val.first()["indexes"] == [0, 1]


def test_blocks_round_trip(spark, tmp_path):
    text = "ID=5\nS-U=1:2,3:1\nS-B=\nDID=\nVERSION=2\nID=9\nS-U=4:1\nDID=5\nVERSION=0\n"
    blocks = rp.read_blocks(spark, write(tmp_path / "b.txt", text), 8)
    assert sorted((r["bug_id"], r["token_id"], r["tf"]) for r in rp.block_postings(blocks).collect()) == [(5, 1, 2), (5, 3, 1)]


def test_weights():
    text = "[unigram] BM25F Parameter...\n[k1, x] = 1.5\n[summary weight] = 2.0\n[bigram] BM25F Parameter...\n[k1, x] = 0.5\n[component weight] = 3\n"
    assert rp.read_weights(text) == [("unigram", "k1", 1.5), ("unigram", "summary weight", 2.0), ("bigram", "k1", 0.5), ("bigram", "component weight", 3.0)]


def test_vectors_and_lexicons(spark, tmp_path):
    v = rp.read_vectors(spark, write(tmp_path / "v.txt", "2 3\na 1 2 3\nb 4 5 6\n"), 3)
    assert {r["word"]: r["vec"] for r in v.collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    vocab = spark.createDataFrame([("b",)], "word string")
    assert sorted(r["word"] for r in rp.vocabulary_vectors(v, vocab, 3).collect()) == ["#UNK", "</s>", "b"]
    lex = rp.read_lexicon(spark, write(tmp_path / "l.txt", "x\ny\n"))
    assert {r["token"]: r["token_id"] for r in lex.collect()} == {"x": 0, "y": 1}
    cat = rp.read_categorical(spark, write(tmp_path / "c.json", '{"product": ["?", "a"]}'))
    assert [(r["value"], r["code"]) for r in cat.orderBy("code").collect()] == [("?", 0), ("a", 1)]


def test_ranking_lines(spark):
    ranked = spark.createDataFrame([(7, 1, 1, 0.12345), (7, 2, 2, 0.1)], "anchor long, cand long, rank int, score double")
    assert rp.ranking_lines(ranked).first()["value"] == "7 1|0.123 2|0.1"


def test_best_runs_and_upsert(spark):
    runs = spark.createDataFrame([(1, '{"a": {"b": 3}}'), (2, '{"a": {"b": 4}}')], "run_id long, config string")
    met = spark.createDataFrame([(1, "map", [0.1, 0.5]), (2, "map", [0.4])], "run_id long, name string, values array<double>")
    assert [(r["run_id"], r["best"], r["a_b"]) for r in rp.best_runs(runs, met, "^map$", ["a.b"]).collect()] == [(1, 0.5, "3"), (2, 0.4, "4")]
    new = spark.createDataFrame([(2, "x"), (3, "y")], "run_id long, config string")
    assert {r["run_id"]: r["config"] for r in rp.upsert(runs, new, "run_id").collect()}[2] == "x"
