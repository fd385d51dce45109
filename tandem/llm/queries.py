"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import store

#: The end id that op2 appends to each document.
END_ID = 2


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_shards as ts

    shards = ts.write_token_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), END_ID, store.shared_dir(spark, "tokens"))
    return ts.read_token_shards(spark, shards)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as dc

    return dc.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dups

    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    docs = table(spark, sf_dir, "documents")
    return rules.judge_rules(docs, *rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    return language.identify_language(docs, language.fit_language(docs, tokenizer_file("piece_bpe_32k.model")))


#: The dated list of op1: kind, value, category, action, date.
LIST_ENTRIES = (
    ("domain", "casino-win.example.com", "gambling", "add", "2023-05-01"),
    ("domain", "casino-win.example.com", "gambling", "remove", "2024-03-01"),
    ("domain", "casino-win.example.com", "gambling", "add", "2024-06-15"),
    ("domain", "free-bets.example.com", "gambling", "add", "2024-02-01"),
    ("domain", "cheap-pills.example.com", "pharmacy", "add", "2023-01-01"),
    ("domain", "cheap-pills.example.com", "spam", "add", "2024-07-01"),
    ("domain", "tionble.example.org", "scraper", "add", "2024-01-10"),
    ("domain", "tionble.example.org", "scraper", "remove", "2024-01-10"),
    ("domain", "tionsh.example.com", "mirror", "add", "2024-04-01"),
    ("domain", "tionsh.example.com", "mirror", "remove", "2024-08-01"),
    ("domain", "example.net", "parked", "remove", "2023-06-01"),
    ("prefix", "blog.tionsh.example.com/fr", "mirror", "add", "2024-07-20"),
    ("prefix", "tiontion.example.net/en", "syndicated", "add", "2023-12-01"),
    ("prefix", "tiontion.example.net/en", "syndicated", "remove", "2024-09-01"),
    ("prefix", "blog.thther.example.net/de", "syndicated", "add", "2024-05-01"),
)
_ENTRIES_SQL = "(VALUES " + ", ".join(str(e) for e in LIST_ENTRIES) + ")"


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages carry no fetch time; each page is taken as fetched on day page_id mod 366 of 2024, at noon."""
    from pyspark.sql import functions as F

    from . import url_lists

    entries = spark.sql(f"SELECT * FROM {_ENTRIES_SQL} AS e(kind, value, category, action, dated)")
    fetched = F.timestamp_add("HOUR", F.lit(12), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).cast("timestamp"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    return url_lists.apply_lists(pages, entries)


OP1_SQL = f"""
WITH e AS (SELECT kind, CASE WHEN kind = 'prefix' THEN rtrim(lower(split_part(value, '/', 1)), '.') || regexp_replace(regexp_extract(value, '^[^/]*(.*)', 1), '/+$', '') ELSE rtrim(lower(value), '.') END AS value, category, action, CAST(dated AS DATE) AS dated FROM {_ENTRIES_SQL} AS t(kind, value, category, action, dated)),
d AS (SELECT kind, value, dated, max(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS is_on, max(category) FILTER (WHERE action = 'add') AS category FROM e GROUP BY ALL),
v AS (SELECT kind, value, category, is_on, CAST(dated AS TIMESTAMP) AS since, CAST(lead(dated) OVER (PARTITION BY kind, value ORDER BY dated) AS TIMESTAMP) AS until FROM d),
p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(page_id % 366 AS INTEGER)) AS fetched_at,
  nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
m AS (SELECT p.page_id, v.kind, v.value, v.category, v.since,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.value) DESC, v.kind DESC) AS k
  FROM p JOIN v ON v.is_on = 1 AND v.since <= p.fetched_at AND (v.until IS NULL OR p.fetched_at < v.until)
  AND ((v.kind = 'domain' AND (p.host = v.value OR ends_with(p.host, '.' || v.value)))
    OR (v.kind = 'prefix' AND (p.host || p.path = v.value OR starts_with(p.host || p.path, v.value || '/')))))
SELECT p.page_id, p.url, p.fetched_at, p.host, m.value IS NOT NULL AS blocked, m.kind AS list_kind, m.value AS list_value, m.category AS list_category, m.since AS listed_since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    files = warc.write_warc(table(spark, sf_dir, "pages"), store.shared_dir(spark, "warc"), min_payload=0)
    return warc.read_warc(spark, files).filter("gap is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h JOIN f USING (hex)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c takes the first crc32(c) % 4 turns of conversation c - c % 20."""
    from pyspark.sql import functions as F

    from . import prefix_trie as pt

    arrays = pt.turn_arrays(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 20)
    return pt.prefix_trie(pt.share_heads(arrays, F.crc32(F.col("conv_id").cast("string")) % 4, 3))


_CRC_SQL = (
    "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
    " lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
)
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, substr(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), 1, 32) AS dig, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
own AS (SELECT conv_id, list(struct_pack(dig := dig, words := words) ORDER BY turn NULLS FIRST, dig) AS own, xor({_CRC_SQL}, 4294967295) % 4 AS h FROM d GROUP BY conv_id),
re AS (SELECT o.conv_id, list_concat(coalesce(b.own[1:o.h], []), o.own[o.h + 1:]) AS turns FROM own AS o LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 20),
k AS (SELECT conv_id, list_transform(turns, lambda x: x.dig) AS digs, list_transform(turns, lambda x: x.words) AS words FROM re),
m AS (SELECT conv_id, n AS depth, array_to_string(digs[1:n], ',') AS node, CASE WHEN n > 0 THEN words[n] ELSE 0 END AS words, n = len(digs) AS ends, array_to_string(digs[1:n - 1], ',') AS parent FROM (SELECT *, unnest(range(0, len(digs) + 1)) AS n FROM k)),
n AS (SELECT node, depth, any_value(CASE WHEN depth > 0 THEN parent END) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
c AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.parent = n.node AND x.depth = n.depth + 1) AS n_children FROM n),
a AS (SELECT CASE WHEN up = 0 THEN '' ELSE array_to_string(string_split(node, ',')[1:up], ',') END AS node, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM c) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM c JOIN a ON a.node = c.node AND a.depth = c.depth LEFT JOIN n AS p ON c.parent = p.node AND p.depth = c.depth - 1
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache for each call, so that a run encodes every distinct text."""
    from . import token_cache

    return token_cache.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), store.shared_dir(spark, "token-cache"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; every seventh has the next label."""
    from pyspark.sql import functions as F

    from . import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine_hard_negatives(vectors, lambda vec_id: vec_id % 100 == 0)


OP13_SQL = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r AS a JOIN r ON r.rid <> a.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY rid, place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (rid) WHERE place <= 5 AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item, s, array_to_string(w[k:k + s - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS s, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
dg AS (SELECT rid, s, k, array_to_string(w[k:k + s - 1], ' ') AS g FROM (SELECT rid, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM dw, (SELECT DISTINCT s FROM win) WHERE len(w) >= s)),
hit AS (SELECT rid, s, k, item FROM dg JOIN win USING (s, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + s)) AS p FROM hit) GROUP BY rid),
i AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_lists, op2_token_shards, op3_decontaminate, op4_quality, op5_near_duplicates, op6_mixing, op7_language, op8_quality_rules, op9_toxicity, op10_warc, op11_prefix_trie, op12_token_counts, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_lists": OP1_SQL, "op3_decontaminate": OP3_SQL, "op10_warc": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
