"""Model inputs planned from a configuration.

A configuration (a dictionary or its JSON text) names parts, ``summary``, ``description`` or ``sum_desc`` (both, one behind the other), each with
a ``tokenizer``, ``filters`` by name and an ``encoder_type``, which decides the layout of its columns:

* ``rnn``, ``mean``, ``dense``, ``self_att``: the tokens' ids in order, one padding id where there is none;
* ``cnn``: the same, padded to the widest of ``window_sizes``, since a shorter text has no window;
* ``bag``: distinct ids in the order of first sight, with each one's share of the tokens (``tf``) and of its field (1 summary, 2 description).

``max_tokens`` cuts a part, if it is given. Every layout comes with ``mask`` (1 for a word, 0 for padding) and ``length`` (words without
padding, but at least the padded minimum's 1). Ids come from a lexicon by a join, frequent tokens by broadcast; unknown tokens
share one id. Unknown names of tokenizers, filters, encoders or parts are errors before any job runs. A null text is empty.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import join_frequent, written

PAD_ID, UNKNOWN_ID = 0, 1
PARTS = {"summary": ("short_desc",), "description": ("description",), "sum_desc": ("short_desc", "description")}
LAYOUTS = ("rnn", "mean", "dense", "self_att", "cnn", "bag")


def read_config(config: dict | str) -> dict[str, dict]:
    """The parts of a configuration, checked; settings of other names (optimisers, files) are left out."""
    given = json.loads(config) if isinstance(config, str) else config
    parts = {k: given[k] for k in PARTS if given.get(k)}
    if not parts:
        raise ValueError(f"a configuration names one of {', '.join(PARTS)}")
    for name, part in parts.items():
        if part.get("encoder_type") not in LAYOUTS:
            raise ValueError(f"{name}: unknown encoder {part.get('encoder_type')}")
        if part.get("tokenizer", "white_space") not in tx.TOKENIZERS:
            raise ValueError(f"{name}: unknown tokenizer {part.get('tokenizer')}")
        tx.load_filters(part.get("filters", []))
    return parts


def part_tokens(part: dict, column: str) -> Column:
    return tx.apply_filters(tx.TOKENIZERS[part.get("tokenizer", "white_space")](F.coalesce(column, F.lit(""))), tx.load_filters(part.get("filters", [])))


def token_rows(reports: DataFrame, name: str, part: dict) -> DataFrame:
    """(bug_id, pos, field, token) of one part."""
    first = 2 if name == "description" else 1
    fields = [_marked(part_tokens(part, c), f) for f, c in enumerate(PARTS[name], first)]
    tokens = F.flatten(F.array(*fields))
    if part.get("max_tokens"):
        tokens = F.slice(tokens, 1, int(part["max_tokens"]))
    return reports.select("bug_id", F.posexplode(tokens).alias("pos", "t")).select("bug_id", "pos", "t.field", "t.token")


def _marked(tokens: Column, field: int) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(field).alias("field"), t.alias("token")))


def plan_inputs(reports: DataFrame, config: dict | str, lexicon: DataFrame) -> DataFrame:
    """(bug_id and, for each part, <part>_ids, <part>_mask, <part>_length; for a bag also <part>_tf, <part>_fields and <part>_tokens, the number of its tokens) of every report
    (bug_id, short_desc, description); ``lexicon``: token, token_id, the ids from 2 on."""
    out = reports.select("bug_id")
    for name, part in read_config(config).items():
        rows = written(token_rows(reports, name, part), "tokens")
        counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_rows")).join(lexicon.select("token", "token_id"), "token", "left")
        known = counted.withColumn("token_id", F.coalesce("token_id", F.lit(UNKNOWN_ID)).cast("long"))
        coded = join_frequent(rows, known, "token", "_rows", rows.count())
        if part["encoder_type"] == "bag":
            each = coded.groupBy("bug_id", "field", "token_id").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
            lists = each.groupBy("bug_id").agg(F.sort_array(F.collect_list(F.struct("pos", "field", "token_id", "n"))).alias("t"), F.sum("n").alias("total"))
        else:
            lists = coded.groupBy("bug_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token_id"))).alias("t"))
        least = max([1, *part.get("window_sizes", [])]) if part["encoder_type"] == "cnn" else 1
        ids = F.coalesce(F.transform("t", lambda x: x["token_id"]), F.array().cast("array<long>"))
        short = F.greatest(F.lit(least) - F.size(ids), F.lit(0))
        columns = [
            F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("long"), short)).alias(f"{name}_ids"),
            F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), short)).alias(f"{name}_mask"),
            F.greatest(F.size(ids), F.lit(1)).alias(f"{name}_length"),
        ]
        if part["encoder_type"] == "bag":
            # the total is a column, since an expression of the list would run for each of its elements
            columns.append(F.coalesce(F.transform("t", lambda x: x["n"] / F.col("total")), F.array(F.lit(0.0))).alias(f"{name}_tf"))
            columns.append(F.coalesce("total", F.lit(0).cast("long")).alias(f"{name}_tokens"))
            columns.append(F.coalesce(F.transform("t", lambda x: x["field"]), F.array(F.lit(0))).alias(f"{name}_fields"))
        out = out.join(reports.select("bug_id").join(lists, "bug_id", "left").select("bug_id", *columns), "bug_id")
    return out
