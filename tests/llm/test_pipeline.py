"""The pipeline on a small corpus, each stage held against plain computations of its own input; the registered queries against their SQL."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tandem.llm import queries, store
from test_mix_warc_urls import targets_of

SF = "/root/testdata/sf0.001"
WORDS = r"[^\x20\x09-\x0D]+"


def small_corpus(spark, folder):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("ta", "ne", "si") for c in ("po", "du", "we")]
    item = [f"secret{k}" for k in range(20)]
    docs, toxic = [], set()
    for i in range(240):
        words = [rng.choice(vocabulary) + str(rng.randrange(60)) for _ in range(rng.randint(40, 90))]
        if i % 4 == 1:
            words[5:5] = ["moron", "idiot"]
            toxic.add(i)
        if i % 24 == 2:
            words[3:3] = item
        docs.append((i, " ".join(words), "en", f"s{i % 3}" if i % 30 else None, 0))
        if i % 12 == 4:  # an exact copy and a near one
            docs += [(1000 + i, docs[-1][1], "en", "s0", 0), (2000 + i, " ".join([*words[:20], "changed", *words[21:]]), "en", "s0", 0)]
    docs += [(5000, None, None, None, 0), (None, "no id at all " * 20, "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, toxic


def test_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    docs, toxic = small_corpus(spark, folder)
    stages, now, seen = dict(corpus_pipeline.STAGES), queries.table(spark, folder, "documents"), {}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        before = now.columns
        now = store.materialise(stages[name](spark, now, folder), name)
        assert now.columns == before
        seen[name] = [tuple(r) for r in now.collect()]
    kept = {r[0] for r in seen["toxicity"]}
    assert not kept & toxic and len(kept - toxic) >= 0.97 * (len(docs) - len(toxic))
    ids = Counter(r[0] for r in seen["near_dedup"])
    groups = [{i, 1000 + i, 2000 + i} for i in range(4, 240, 12)]
    assert all(len(g & set(ids)) == 1 and min(g & kept) in ids for g in groups if g & kept) and 5000 in ids and None in ids
    assert kept - set().union(*groups) <= set(ids) and max(ids.values()) == 1
    clean = [r for r in seen["near_dedup"] if "secret0" not in (r[1] or "")]
    assert sorted(seen["decontamination"], key=str) == sorted(clean, key=str) and len(clean) < len(seen["near_dedup"])
    size = lambda rows: Counter({k: sum(len(re.findall(WORDS, r[1] or "")) for r in rows if r[3] == k) for k in {r[3] for r in rows}})
    total, taken = size(seen["decontamination"]), size(seen["mixing"])
    target = targets_of(total)
    assert all(abs(taken[k] - target[k]) < 100 for k in total)  # no document here has 100 words
    times = Counter(seen["mixing"])
    assert all(n <= 3 for n in times.values()) and set(times) <= set(seen["decontamination"])
    shards = stages["token_ids"](spark, now, folder).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, queries.END_ID], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in shards) == Counter((r[0], crc(r[1])) for r in seen["mixing"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False)))
    as_floats = [c for c in want.columns if want[c].dtype.kind == "f" or got[c].dtype.kind == "f"]
    for c in as_floats:
        want[c], got[c] = want[c].astype(float), got[c].astype(float)
    assert plain(got) == plain(want)
