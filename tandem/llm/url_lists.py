"""URL filters: a temporal list join (operator 1), in DataFrame operations only.

A list has dated entries (kind, value, category, action, dated). Kind ``domain`` holds for a host and all below
it, ``prefix`` for a host and path from their start, whole path segments. Hosts compare without case and last dot,
paths as they are; slashes at a path's end do not count. ``add`` starts an interval at its
date, the next entry of the same kind and value ends it. Of entries with one kind, value and date an ``add``
beats a ``remove``, and the greatest category wins. So a key has one entry a day at most, and its intervals,
kept as one array, are bounded by the days of the list's history.

Each capture is evaluated against the entries active at its fetch time (as-of). Keys are looked up once for
each distinct host (each distinct host and path only where the list has prefixes of that host), so the frequent
hosts are reduced before the join; the result, usually few blocked hosts, meets the captures in one join, each host
in SALTS parts, so that a frequent host's captures are spread; the planner broadcasts the result where it is small.

Verdict: the longest active value, a prefix before a domain of equal length. A capture with a null or hostless
url or a null fetch time is not blocked. Repeated rows are judged alike. All columns of the captures are kept, but for
those named like a column of the verdict (host, blocked, list_kind, list_value, list_category, listed_since), which
it replaces. An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


#: Parts of a host's captures.
SALTS = 16


def listed_value(kind: Column, value: Column) -> Column:
    """A list value as it is compared."""
    host = F.rtrim(F.lower(F.split(value, "/")[0]), F.lit("."))
    path = F.regexp_replace(F.regexp_extract(value, "^[^/]*(.*)", 1), "/+$", "")
    return F.when(kind == "prefix", F.concat(host, path)).otherwise(F.rtrim(F.lower(value), F.lit(".")))


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and last dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", "")


def suffixes(host: Column) -> Column:
    """The host and every parent domain."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def prefixes(host: Column, path: Column) -> Column:
    """The host with every leading run of the path's segments."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/")))


def validity(entries: DataFrame) -> DataFrame:
    """(kind, value, spans): the disjoint validity intervals of each listed key, in order."""
    day = entries.select("kind", listed_value(F.col("kind"), F.col("value")).alias("value"), F.col("dated").cast("date").alias("dated"), (F.col("action") == "add").alias("on"), "category").filter("kind is not null and value is not null and dated is not null and on is not null")
    day = day.groupBy("kind", "value", "dated").agg(F.max(F.struct("on", "category")).alias("e"))
    listed = day.groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("dated", "e.on", "e.category"))).alias("days"))
    n = F.size("days")
    spans = F.transform(
        "days",
        lambda d, i: F.struct(d["dated"].cast("timestamp").alias("since"), F.when(i + 1 < n, F.get("days", i + 1)["dated"]).cast("timestamp").alias("until"), d["category"].alias("category"), d["on"].alias("on")),
    )
    return listed.select("kind", "value", F.filter(spans, lambda s: s["on"]).alias("spans"))


def _hits(keys: DataFrame, by: list[str], listed: DataFrame, name: str) -> DataFrame:
    """For each row of ``keys`` (distinct in ``by``, with an array ``key``): all listed intervals of its keys."""
    found = keys.select(*by, F.explode("key").alias("value")).join(listed, "value")
    flat = found.select(*by, "value", F.inline("spans"))
    return flat.groupBy(*by).agg(F.collect_list(F.struct(F.length("value").alias("size"), "value", "category", "since", "until")).alias(name))


def apply_lists(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures with host, blocked, list_kind, list_value, list_category and listed_since."""
    listed = validity(entries)
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row")  # so that no column clashes with ours
    whole = captures.select(row, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), F.col(f"`{fetched}`").cast("timestamp").alias("at"))
    domains = listed.filter("kind = 'domain'").select("value", "spans")
    by_path = listed.filter("kind = 'prefix'").select("value", "spans")
    hosts = whole.filter("host is not null").select("host").distinct()
    of_host = _hits(hosts.select("host", suffixes(F.col("host")).alias("key")), ["host"], domains, "domain_hits")
    with_prefix = by_path.select(F.split("value", "/")[0].alias("host")).distinct()
    places = whole.select("host", "path").join(with_prefix, "host", "left_semi").distinct()
    of_path = _hits(places.select("host", "path", prefixes(F.col("host"), F.col("path")).alias("key")), ["host", "path"], by_path, "path_hits")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64(F.col(f"row.`{url}`"), "at"), F.lit(SALTS)).cast("int").alias("salt")

    def active(hits: str, kind: str) -> Column:
        live = F.filter(hits, lambda h: (h["since"] <= F.col("at")) & (h["until"].isNull() | (F.col("at") < h["until"])))
        best = F.array_max(live)
        return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), F.lit(kind).alias("kind"), best["value"].alias("value"), best["category"].alias("category"), best["since"].alias("since")))

    salted = whole.select("*", salt)
    joined = salted.join(of_host.select("*", salts), ["host", "salt"], "left").join(of_path.select("*", salts), ["host", "path", "salt"], "left")
    best = F.greatest(active("domain_hits", "domain"), active("path_hits", "prefix"))
    done = joined.select("row", "host", best.alias("best"))
    verdict = {
        "host": F.col("host"),
        "blocked": F.col("best").isNotNull(),
        "list_kind": F.col("best.kind"),
        "list_value": F.col("best.value"),
        "list_category": F.col("best.category"),
        "listed_since": F.col("best.since"),
    }
    kept = [F.col(f"row.`{c}`") for c in captures.columns if c not in verdict]
    return done.select(*kept, *[c.alias(name) for name, c in verdict.items()])
