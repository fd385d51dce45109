"""Every registered query of the subpackage, called as the driver calls it and held against its contract by plain loops."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tandem.llm import decontaminate, language, mixing, quality, queries, rules, store, toxicity
from tandem.llm import token_shards as ts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORDS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def run(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_op2(spark, docs):
    tok = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op2_token_shards")) == want


@pytest.mark.parametrize("name, label, least", [("op4_quality", "quality", 0.7), ("op9_toxicity", "toxic", 0.3)])
def test_op4_and_op9(spark, docs, labels, name, label, least):
    got = run(spark, name)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least) for r in got)
    judged = [(labels[r["doc_id"]][label], r["predicted"]) for r in got if r["doc_id"] in labels and r["held_out"]]
    assert sum(y == p for y, p in judged) >= 0.8 * len(judged)


def test_op5(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in run(spark, "op5_near_duplicates")}
    assert set(got) == {r["doc_id"] for r in docs}
    same = defaultdict(set)
    for r in docs:
        same[r["text"]].add(got[r["doc_id"]])
    assert all(len(s) == 1 for t, s in same.items() if t is not None)


def test_op6(spark, docs):
    size = {r["doc_id"]: len(re.findall(WORDS, r["text"] or "")) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, full = {}, set()
    while True:  # shares by weight; what is above three times the source's size is shared again
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        level = rest / max(1, sum(w for s, w in weight.items() if s not in full))
        over = {s for s in total if s not in full and weight[s] * level > 3 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * total[s] if s in full else weight[s] * level for s in total}
    got = run(spark, "op6_mixing")
    taken = Counter()
    for r in got:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]]) and r["target"] == pytest.approx(target[source[i]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source[i]] += r["taken"]
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 60 for s in total)


def test_op7(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs}
    text = {r["doc_id"]: r["text"] or "" for r in docs}
    got = run(spark, "op7_language")
    assert len(got) == len(docs) and all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]])) for r in got)
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(judged) >= 0.9 * len(judged)


def plain_rules(text):
    words = re.findall(WORDS, text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = Counter(x for x in (text or "").split("\n") if re.search(WORDS, x))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(n - 1 for n in lines.values()), len(again)


def test_op8(spark, docs):
    text = {r["doc_id"]: r["text"] for r in docs}
    got = run(spark, "op8_quality_rules")
    assert len(got) == len(docs)
    for r in got:
        n, *_, again = want = plain_rules(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and not (r["base_failed"] and r["kept"])


def test_a_text_of_megabytes_of_words(spark):
    """One text of about five megabytes beside a short one, whole, through the operators on texts."""
    some = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r["text"]]
    long = " ".join(some)
    long = "\n".join(long for _ in range(5_000_000 // len(long.encode()) + 1))
    df = spark.createDataFrame([(1, long, "en", "web"), (2, some[0], "en", "web")], "doc_id long, text string, lang string, source string").coalesce(1)
    words = long.count(" ") and len(re.findall(WORDS, long))
    path = queries.tokenizer_file("byte_bpe_50k.json")
    n_ids = len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)
    shards = ts.write_token_shards(df, path, 2, store.shared_dir(spark, "t"))
    assert {r["doc_id"]: r["n_tokens"] for r in ts.read_token_shards(spark, shards).collect()}[1] == n_ids + 1
    items = spark.createDataFrame([("a", " ".join(some[0].split()[:40]))], "item_id string, text string")
    hit = {r["doc_id"]: r for r in decontaminate.contamination_report(df, items).collect()}
    assert hit[1]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", long.lower())) and hit[1]["n_hit"] > 0 and hit[2]["n_items"] == 1
    assert {r["size"] for r in mixing.mix_report(df).collect() if r["doc_id"] == 1} == {words}
    own, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.judge_rules(df, *rules.fit_rules(own, marks))
    assert {r["n_words"] for r in judged.collect() if r["doc_id"] == 1} == {words}
    for scored in (quality.score_quality(df, quality.fit_quality(own, marks)), toxicity.score_toxicity(df, toxicity.fit_toxicity(own, marks)), language.identify_language(df, language.fit_language(own, queries.tokenizer_file("piece_bpe_32k.model")))):
        assert len([r for r in scored.collect() if 0 <= r["score"] <= 1]) == 2
