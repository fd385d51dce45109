import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import language, quality, rules, samples, texts, toxicity
from tandem.llm.queries import tokenizer_file

ODD = [(1, None), (2, ""), (3, "#$%"), (None, "words and words"), (5, "x" * 200000), (6, "same"), (6, "same")]


def odd(spark, *extra):
    return spark.createDataFrame([(i, t, "en" if t else None, 0.5) for i, t in [*ODD, *extra]], "doc_id long, text string, lang string, score double")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def prose(rng, words, n=80):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru") for b in ("ta", "ne", "si", "po", "du")]
    out = []
    for i in range(600):
        text, bad, toxic = prose(rng, words), i % 8 == 0, i % 5 == 0
        if bad:
            text = re.sub(r"(\w+)", r"\1###", text)
        if toxic:
            text = text.replace(" ", " idiot ", 1) + " moron"
        out.append((i, text, int(not bad), int(toxic)))
    return out


def column(rows):
    return texts.text_bytes(pa.chunked_array([pa.array(rows, pa.string())]))


def test_quality_held_out(labelled):
    train, test = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 4 != 2], [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    model = quality.SubwordModel.fit([(t, q) for _, t, q, _ in train])
    got = model.predict(*column([t for _, t, _, _ in test])) >= quality.THRESHOLD
    assert (got == np.array([q == 1 for _, _, q, _ in test])).mean() > 0.95


def test_toxicity_held_out(labelled):
    train, test = [r for r in labelled if r[0] % 4 != 2], [r for r in labelled if r[0] % 4 == 2]
    model = toxicity.ConvModel.fit([(t, x, "en") for _, t, _, x in train])
    got = model.predict(*column([t for _, t, _, _ in test])) >= toxicity.THRESHOLD
    assert (got == np.array([x == 1 for _, _, _, x in test])).mean() > 0.95
    assert 0 < model.thresholds["en"] < 1


def test_scores_do_not_depend_on_neighbours(labelled):
    model = toxicity.ConvModel.fit([(t, x, None) for _, t, _, x in labelled])
    some = [t for _, t, _, _ in labelled[:9]] + ["", "a"]
    whole = model.predict(*column(some))
    assert np.allclose(whole, [model.predict(*column([t]))[0] for t in some])


def test_classifiers_on_odd_rows(spark, labelled):
    docs = odd(spark, *[(1000 + i, t) for i, t, _, _ in labelled[:80]])
    lab = labels(spark, [(1000 + i, q, x) for i, _, q, x in labelled[:80]] + [(1000, 0, 1), (7777, 1, 0), (None, 1, 1)])
    for got in (quality.score_quality(docs, quality.fit_quality(docs, lab)), toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, lab))):
        rows = got.collect()
        assert len(rows) == len(ODD) + 80 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"]}[6] == (zlib.crc32(b"6") % 4 == 2)
    kept = toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, lab))
    assert kept.columns == docs.columns


def test_classifiers_without_labels_or_rows(spark):
    none = labels(spark)
    docs = odd(spark)
    assert quality.score_quality(docs, quality.fit_quality(docs, none)).count() == len(ODD)
    assert toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, none)).count() == len(ODD)
    empty = docs.filter("doc_id = -1")
    assert quality.score_quality(empty, quality.fit_quality(empty, none)).count() == 0
    assert rules.judge_rules(empty, *rules.fit_rules(empty, none)).count() == 0
    assert language.identify_language(empty, language.fit_language(empty, tokenizer_file("piece_bpe_32k.model"))).count() == 0


def test_labelled_sample_is_bounded_and_open(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in labelled] + [(0, "twice")], "doc_id long, text string")
    lab = labels(spark, [(i, q, x) for i, _, q, x in labelled])
    got = samples.labelled_texts(docs, lab, "toxic", {1: 10, 0: 20})
    assert Counter(y for _, y in got) == {1: 10, 0: 20}
    held = {t for i, t, _, _ in labelled if zlib.crc32(str(i).encode()) % 4 == 2}
    assert not held & {t for t, _ in got}


# --- rules ---------------------------------------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts():
    rng = random.Random(4)
    cases = ["", "\n", None, "a\n\na\n a\na", "a b c a b c", "\n\nx\n", "é ñ | a\r\na\r\na\n", "a\tb\x0bc\x1cd", "a\n", "a\na\n"]
    cases += ["".join(rng.choice("ab é\n#\t") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    c = rules.rule_counts(*column(cases))
    assert list(zip(*[c[k].tolist() for k in rules.COUNTS])) == [brute_counts(t) for t in cases]


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 4)), rng.normal(8, 1, (5, 4))])
    score = rules.IsolationForest.fit(x).score(x)
    assert score[-5:].min() > np.quantile(score[:500], 0.98)


def test_rules_on_odd_rows(spark, labelled):
    docs = odd(spark, *[(1000 + i, t) for i, t, _, _ in labelled[:200]])
    lab = labels(spark, [(1000 + i, q, x) for i, _, q, x in labelled[:200]])
    rows = rules.judge_rules(docs, *rules.fit_rules(docs, lab)).collect()
    assert len(rows) == len(ODD) + 200
    assert not any(r["kept"] for r in rows if r["base_failed"]) and all(r["base_failed"] for r in rows if r["doc_id"] in (1, 2))
    good = {1000 + i: q for i, _, q, _ in labelled[:200]}
    assert np.mean([r["kept"] == (good[r["doc_id"]] == 1) for r in rows if r["doc_id"] in good]) > 0.85


def test_forest_and_threshold_come_from_all_rows(spark):
    """Of 30,000 rows each is in one tree at least; boxes counted over partitions are those of one part, and a rare label counts."""
    row, tree = rules.members(np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 3000), 10, rules.tree_shares(3000, 10, 600)[1])
    assert set(row.tolist()) == set(range(3000)) and np.bincount(tree, minlength=10).min() > 450
    assert rules.tree_shares(30_000, 100, 256) == (300, 0.0)
    rng = random.Random(8)
    texts_ = [" ".join(rng.choice(["alpha", "be", "gam#ma", "DELTA", "x"]) + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(9000)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    rows = rules.ratio_rows(docs).cache()
    got = rows.toArrow()
    assert got.num_rows == 9000  # more than any sample had
    key, x = next(rules._key_and_ratios(iter(got.combine_chunks().to_batches())))
    plain = rules.IsolationForest.grow(9000, lambda f, level, share: f.boxes([(key, x)], level, share))
    # the good rows are two of 9,000, and all labelled rows are counted
    marks = labels(spark, [(i, int(i in (1, 5000)), 0) for i in range(9000)])
    forest, threshold = rules.fit_rules(docs, marks)
    assert np.array_equal(forest.feature, plain.feature) and np.array_equal(forest.split, plain.split) and np.array_equal(forest.path, plain.path)
    score = dict(zip(got["doc_id"].to_pylist(), forest.grade(x)))
    open_ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2]
    values = sorted({score[i] for i in open_ids})
    of = Counter((score[i], i in (1, 5000)) for i in open_ids)
    good, bad = (np.array([of[v, kind] for v in values]) for kind in (True, False))
    assert threshold == rules.calibrate(np.array(values), good, bad)


# --- language ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rows = [("the house and the garden are open this morning", "en"), ("das haus und der garten sind heute morgen offen", "de"), ("la maison et le jardin sont ouverts ce matin été", "fr")] * 5
    return language.LanguageModel.fit(rows, language.vocabulary(tokenizer_file("piece_bpe_32k.model")))


def test_forward_sums_all_segmentations(model):
    weight = {p: model.weight[i] for i, p in enumerate(model.vocab)}
    for word in ("house", "été", "zq€x"):
        full = "▁" + word
        alpha = [np.ones(len(model.languages)), *(np.zeros(len(model.languages)) for _ in full)]
        for e in range(1, len(full) + 1):
            for b in range(max(0, e - model.pieces.longest), e):
                w = weight.get(full[b:e], model.weight[-1] if e - b == 1 else None)
                if w is not None:
                    alpha[e] = alpha[e] + alpha[b] * w
        raw = np.frombuffer(word.encode(), np.uint8)
        _, keys, spans, _, data = language._distinct(raw, np.array([0, len(raw)]))
        assert np.allclose(model.word_logs(keys, spans, data)[0], np.log(alpha[-1]))


def test_language_of_texts(model):
    langs, score = model.predict(*column(["the garden", "der garten und das haus", "le jardin et la maison", None, "", "123 €", "x" * 500]))
    assert langs[:6] == ["en", "de", "fr", "und", "und", "und"] and langs[6] in model.languages
    assert (score[3:6] == 0).all() and ((score >= 0) & (score <= 1)).all()


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k, f"word {k}", f"l{k // 6}") for k in range(6 * 203)], "doc_id long, text string, lang string")
    open_langs = {r["lang"] for r in docs.filter(~samples.held_out(3, 1)).select("lang").distinct().collect()}
    model = language.fit_language(docs, tokenizer_file("piece_bpe_32k.model"))
    assert len(open_langs) > 200 and set(model.languages) == open_langs


def test_language_query_on_odd_rows(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    docs = odd(spark, *[(100 + i, "the house and the garden") for i in range(30)])
    rows = language.identify_language(docs, language.fit_language(docs, path)).collect()
    assert len(rows) == len(ODD) + 30 and {r["lang_pred"] for r in rows} <= {"en", "und"}
    nothing = docs.withColumn("lang", docs["lang"].substr(0, 0)).filter("lang is null")
    assert language.identify_language(nothing, language.fit_language(nothing, path)).count() == nothing.count()


def test_long_runs_are_summed_whole(model):
    """A run far beyond the scaling steps has the product form's logarithm: held against a plain sum in logarithms."""
    weight = {p: model.weight[i] for i, p in enumerate(model.vocab)}
    word = "derhausgarten" * 40 + "é" * 200
    full, logs = "▁" + word, [np.zeros(len(model.languages))]
    for e in range(1, len(full) + 1):
        ways = []
        for b in range(max(0, e - model.pieces.longest), e):
            w = weight.get(full[b:e], model.weight[-1] if e - b == 1 else None)
            if w is not None:
                ways.append(logs[b] + np.log(w))
        logs.append(np.logaddexp.reduce(ways, axis=0))
    raw = np.frombuffer(word.encode(), np.uint8)
    _, keys, spans, _, data = language._distinct(raw, np.array([0, len(raw)]))
    assert np.allclose(model.word_logs(keys, spans, data)[0], logs[-1])


# --- plain scorers -----------------------------------------------------------------------------------------------------


def tokens_of(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+|[!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def span_hash(data):
    return texts.span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0]


def test_quality_equals_a_walk_of_every_token(labelled):
    model = quality.SubwordModel.fit([(t, q) for _, t, q, _ in labelled[:120]], epochs=1)

    def plain(text):
        found, last = [], None
        for token in tokens_of(text):
            data = b"<" + (quality.SAME if token == last else token.encode()) + b">"
            last = token
            chars, bounds = len(data.decode()), [len(data.decode()[:k].encode()) for k in range(len(data.decode()) + 1)]
            found.append(span_hash(data))
            for n in quality.NGRAMS:
                if chars > n:
                    found += [span_hash(data[bounds[k] : bounds[k + n]]) for k in range(chars - n + 1)]
        sums = [float(model.score[int(h % np.uint64(quality.BUCKETS))]) for h in found]
        return 1 / (1 + np.exp(-(model.bias + (sum(sums) / len(sums) if sums else 0))))

    some = [t for _, t, _, _ in labelled[:6]] + ["", "a a é!! Straße b-c", "x"]
    assert np.allclose(model.predict(*column(some)), [plain(t) for t in some], atol=1e-6)


def test_toxicity_equals_convolution_by_loops(labelled):
    model = toxicity.ConvModel.fit([(t, x, None) for _, t, _, x in labelled[:200]], epochs=1)
    place = {int(k): n + 2 for n, k in enumerate(model.keys)}

    def number(token):
        tries = [span_hash(token.encode())] + [span_hash(token[:n].encode()) ^ np.uint64(n) for n in toxicity.STEMS if len(token) > n]
        return next((place[int(h)] for h in tries if int(h) in place), 1)

    def plain(text):
        ids, maxima, at = [number(t) for t in tokens_of(text)] + [0] * (toxicity.GAP + 1), [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                maxima.append(max(0, *(sum(float(model.table[ids[p + j], at + j, f]) for j in range(width)) for p in range(len(ids) - width + 1))))
            at += width
        return 1 / (1 + np.exp(-(np.dot(maxima, model.out) + model.bias)))

    some = [t for _, t, _, _ in labelled[:8]] + ["", "idiot", "!!! morons é"]
    assert np.allclose(model.predict(*column(some)), [plain(t) for t in some], atol=1e-4)


def test_forest_equals_a_walk_of_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 4))
    forest = rules.IsolationForest.fit(x, trees=20, rows=64)

    def path(row, t):
        k = 1
        while not forest.child[t, k]:
            k = 2 * k + (row[forest.feature[t, k]] >= forest.split[t, k])
        return forest.path[t, k]

    want = [2 ** (-np.mean([path(row, t) for t in range(20)]) / forest.norm) for row in x]
    assert np.allclose(forest.score(x), want)


def test_samples_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([(k, "x" * 100) for k in range(50)], "doc_id long, text string")
    assert [r["doc_id"] for r in samples.bounded(rows, rows["doc_id"], 30, 1000)] == list(range(10))
    assert len(samples.bounded(rows, rows["doc_id"], 30)) == 30
