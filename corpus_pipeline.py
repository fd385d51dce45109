"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, token shards.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns
of ``documents`` in all stages but the last. ``run`` applies them to ``documents``, each stage's result written as
Parquet in the shared folder and read again. SQL can express neither the classifier, the alignment, the knapsack nor the tokenizer, so
there is no ORACLE_SQL; ``tests/llm/test_pipeline.py`` holds each stage's result against plain computations.

The mix takes some documents more than once; those rows follow each other in the shards. Null texts pass the first
three stages and have size 0 in the mix; rows without an id and repeated rows are handled as the stages' modules say; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import decontaminate, mixing, near_dups, store, token_shards, toxicity
from tandem.llm.queries import END_ID, table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labelled rows of the table itself, so that the model does not depend on the stage's input."""
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shards = token_shards.write_token_shards(docs, tokenizer_file("byte_bpe_50k.json"), END_ID, store.shared_dir(spark, "tokens"))
    return token_shards.read_token_shards(spark, shards)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store.materialise(docs, name)
    return docs
