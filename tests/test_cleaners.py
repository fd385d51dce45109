import re

import pytest
from pyspark.sql import functions as F

from tandem.functions import text as tx
from tandem.functions.stemmer import stem_word

TEXTS = ["The runners were running quickly; it's 10:20:30 on 2020-01-02!!", None, "", "   ", "&gt;&lt; 42 Studies of the flies. Another one!  Yes, 3 flies?", "été déjà vu -- 12 times", "x " * 3000, "12 -- 34"]


def plain_retrieval(text, stops):
    words = []
    for w in re.findall(r"[^\W_]+", re.sub(tx.HTML_NAMES, "", (text or "").lower())):
        if not re.fullmatch("[0-9]+", w) and w not in stops:
            words.append(stem_word(w))
    return [w for w in words if w]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, t, t, "x") for k, t in enumerate(TEXTS)], "bug_id int, short_desc string, description string, other string")


def test_retrieval_tokens_equal_loops(spark, frame):
    stops = set(tx.stop_words(()))
    got = {r["bug_id"]: r["t"] for r in frame.select("bug_id", tx.retrieval_tokens(F.coalesce("description", F.lit(""))).alias("t")).collect()}
    assert got == {k: plain_retrieval(t, stops) for k, t in enumerate(TEXTS)}
    assert "runner" in got[0] and "the" not in got[0]


def test_stems_of_arrays(spark):
    df = spark.createDataFrame([(["running", "being", "flies", "running"],), ([],), (None,)], "t array<string>").coalesce(1)
    assert [r[0] for r in df.select(tx.stem_all("t")).collect()] == [["run", "being", "fli", "run"], [], None]


def test_soft_cleaner_with_stems_equals_loops(spark, frame):
    """The order of the steps: repeated signs, times and dates, tokens, stems (not of stop words), stop words, signs."""
    stops = {*tx.stop_words(()), "n't"}
    tokens = {r["bug_id"]: r["w"] for r in frame.select("bug_id", tx.tokens_words(F.coalesce("description", F.lit(""))).alias("w")).collect()}
    one = frame.filter("bug_id = 5").select(tx.clean_soft(F.col("description"), stops=True, stem=True).alias("t")).first()["t"]
    kept = [w if w in tx.stop_words(()) else stem_word(w) for w in ["été", "déjà", "vu", "-", "12", "times"]]
    assert one.split() == [w for w in kept if w not in stops]
    assert tokens[1] == [] and "running" in tokens[0]


def test_clean_job(spark, frame):
    out = {r["bug_id"]: r for r in tx.clean_job(frame, ["short_desc", "description"], "soft", sentences_too=True).collect()}
    assert out[1]["description"] is None and out[2]["short_desc"] == "" and out[0]["other"] == "x"
    assert "\n" in out[4]["description"] and "\n" not in out[4]["short_desc"]
    rep = {r["bug_id"]: r["short_desc"] for r in tx.clean_job(frame, ["short_desc"], "rep").collect()}
    assert rep[4] == " ".join(plain_retrieval(TEXTS[4], set(tx.stop_words(()))))
    with pytest.raises(ValueError):
        tx.cleaner("none")
    counts = {r["field"]: (r["n"], r["n_erased"]) for r in tx.erased_counts(frame, {"short_desc": tx.cleaner("agg")}).collect()}
    assert counts["short_desc"][0] == len(TEXTS) and counts["short_desc"][1] == 1


SENTENCES = {
    "They'll say \"it's $3.50, can't it?\" (maybe).": "They 'll say `` it 's $ 3.50 , ca n't it ? '' ( maybe ) .".split(),
    "I cannot -- gonna go... at 10:30, e.g. now.": "I can not -- gon na go ... at 10:30 , e.g. now .".split(),
    "": [],
    "'Tis [the] boys' end; A&B 50%!": "'T is [ the ] boys ' end ; A & B 50 % !".split(),
}


def plain_treebank(sentence):
    """The rules one after the other with this language's own expressions."""
    for pattern, by, case in tx.TREEBANK:
        sentence = re.sub(pattern.replace(r"\z", r"\Z"), by.replace(r"\0", r"\g<0>"), sentence, flags=re.ASCII | (0 if case else re.IGNORECASE))
    return re.findall(r"[^ \t\n\x0B\f\r]+", sentence)


def test_treebank_tokens(spark):
    rows = [(s,) for s in SENTENCES] + [(r["text"],) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(200).collect()]
    got = {r["s"]: r["t"] for r in spark.createDataFrame(rows, "s string").select("s", tx.treebank(F.col("s")).alias("t")).collect()}
    assert {s: got[s] for s in SENTENCES} == SENTENCES
    assert got == {s: plain_treebank(s) for s in got}
