import math
import re
from collections import Counter

import pytest

from tandem.operators import sentences

CORPUS = ["Dr. Smith saw Mr. Jones today. They talked of cats.", "Then Mr. Brown met Dr. Gray. Cats are nice animals.", "A talk with Dr. Who. The cats sat. No dr came", "He has cats e.g. Tom. We like e.g. Felix! Nice? Yes.", "", None, "Mr. Dr. Last", "one two three four five six seven eight nine ten " * 8]


def plain_abbreviations(texts):
    words = [w for t in texts if t for w in re.split(r"[ \t\n\x0B\f\r]+", t.lower()) if w]
    n, dots = Counter(w.removesuffix(".") for w in words), Counter(w[:-1] for w in words if w.endswith("."))
    share, out = sum(dots.values()) / sum(n.values()), {}
    for w, d in dots.items():
        if re.fullmatch(r"[^\W\d_]|(?:[^\W\d_]|\.)*[^\W\d_]", w):
            size, bare = len(w.replace(".", "")), n[w] - d
            log = lambda x: d * math.log(x) + bare * math.log(1 - x)
            score = 2 * (log(0.99) - log(share)) * math.exp(-size) * (w.count(".") + 1) * size**-bare
            if score >= sentences.LEAST:
                out[w] = (n[w], d, score)
    return out


def plain_split(text, short):
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?])[ \t\n\x0B\f\r]+(?=[A-Z0-9])", text):
        word = re.search(r"([^ \t\n\x0B\f\r]*)$", text[: m.start()]).group(1)
        if not (word.endswith(".") and word[:-1].lower() in short):
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def test_table_and_splits_equal_the_plain_ones(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "id int, text string").repartition(3)
    table = sentences.abbreviation_table(df)
    want = plain_abbreviations(CORPUS)
    got = {r["type"]: (r["n"], r["n_dot"], r["score"]) for r in table.collect()}
    assert {"mr", "e.g"} <= set(got) == set(want) and "cats" not in got
    assert all(got[w][:2] == want[w][:2] and got[w][2] == pytest.approx(want[w][2]) for w in want)
    split = {r["id"]: r["sentences"] for r in sentences.split_sentences(df, table).collect()}
    assert split == {k: plain_split(t, want) for k, t in enumerate(CORPUS) if t is not None}
    assert split[0] == ["Dr. Smith saw Mr. Jones today.", "They talked of cats."] or "dr" not in want


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert sentences.abbreviation_table(df).collect() == [] == sentences.split_sentences(df, sentences.abbreviation_table(df)).collect()


def test_many_sentences_and_long_words_take_no_square_of_their_number(spark):
    import time

    many, word = "Cats are nice. " * 20_000 + "End", "x" * 60_000
    df = spark.createDataFrame([(1, many), (2, f"A {word}. B. {word}")], "id int, text string")
    table = spark.createDataFrame([("mr",)], "type string")
    start = time.time()
    split = {r["id"]: r["sentences"] for r in sentences.split_sentences(df, table).collect()}
    assert time.time() - start < 60
    assert split[1] == ["Cats are nice."] * 20_000 + ["End"]
    assert split[2] == [f"A {word}.", f"B. {word}"]
