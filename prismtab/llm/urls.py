"""URL filters by a temporal list join.

A list is a set of dated entries (pattern, category, listed_on, action): `add` puts the pattern on the
list of the category from that day on, `remove` takes it off. The last action of a day counts, `add`
before `remove`. Days between an add and the next remove become a validity interval, open at the end
without one. A pattern is a host or parent domain (`example.org`), or a host with leading path
segments (`example.org/en`). A capture meets a pattern if its host is that domain or below it, or its
host and path begin so; it is listed if an interval of such a pattern holds its fetch time. Paths are
compared with their case, without empty segments (`example.org/en/` is `example.org/en`).

Captures with a null url or fetch time, or a url without host, meet nothing and are kept. Hosts are
compared in lower case, without port and user and without dots at their ends. Captures look up no domain
shorter than the shortest listed one, so a top-level domain that no list holds is no key. Entries with a null pattern, category or date are
ignored. Rows that repeat get equal verdicts. An empty list lists nothing; an empty table gives an
empty result. Columns named like the results are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.btrim(F.regexp_extract(url, HOST, 1), F.lit(".")))


def plain_path(path: Column) -> Column:
    """A path without empty segments: no slash at its ends, one between segments."""
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/|/$", "")


def plain_pattern(pattern: Column) -> Column:
    """The host of a pattern in lower case, and its path as it is, without empty segments."""
    host = F.substring_index(pattern, "/", 1)
    path = plain_path(F.substr(pattern, F.length(host) + 2))
    return F.concat(F.lower(F.btrim(host, F.lit("."))), F.when(path != "", F.concat(F.lit("/"), path)).otherwise(""))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) of the entries; valid_to is null while still listed."""
    known = entries.where("pattern IS NOT NULL AND category IS NOT NULL AND listed_on IS NOT NULL AND action IN ('add', 'remove')")
    daily = known.groupBy(plain_pattern(F.col("pattern")).alias("pattern"), "category", F.to_date("listed_on").alias("day")).agg(F.min("action").alias("action"))
    in_order = Window.partitionBy("pattern", "category").orderBy("day")  # at most one row for each day
    changes = daily.withColumn("_before", F.lag("action").over(in_order)).where("_before IS NULL OR _before <> action")
    return (changes.withColumn("valid_to", F.lead("day").over(in_order)).where("action = 'add'")
            .select("pattern", "category", F.col("day").alias("valid_from"), "valid_to"))


def patterns_of(url: Column, labels: int, segments: int, shortest: int = 1) -> Column:
    """The patterns that can meet a url: its last shortest..labels host labels, and host with 1..segments of path."""
    host = F.split(host_of(url), r"\.")
    longest = F.least(F.size(host), F.lit(labels))
    domains = F.when(longest >= shortest, F.transform(F.sequence(F.lit(shortest), longest), lambda n: F.array_join(F.slice(host, -n, n), ".")))
    domains = F.coalesce(domains, F.array().cast("array<string>"))
    whole = F.array(F.array_join(host, "."))
    found = F.array_union(domains, whole)
    if segments:
        path = F.filter(F.split(plain_path(F.regexp_extract(url, PATH, 1)), "/", segments + 1), lambda s: s != "")
        held = F.least(F.size(path), F.lit(segments))
        paths = F.when(held > 0, F.transform(F.sequence(F.lit(1), held), lambda n: F.concat_ws(
            "/", F.array_join(host, "."), F.array_join(F.slice(path, 1, n), "/"))))
        found = F.array_union(found, F.coalesce(paths, F.array().cast("array<string>")))
    return F.when(host_of(url) != "", found)


def url_verdicts(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """The captures with listed, n_active and categories (sorted, comma-joined) at their fetch time."""
    intervals = validity(entries)
    slashes = F.size(F.split("pattern", "/")) - 1
    domain_labels = F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))
    deepest = intervals.agg(F.min(F.when(slashes == 0, domain_labels)).alias("shortest"), F.max(domain_labels).alias("labels"), F.max(slashes).alias("segments")).first()
    labels, segments, shortest = deepest["labels"] or 1, deepest["segments"] or 0, deepest["shortest"] or 1
    kept = captures.drop("listed", "n_active", "categories")
    # Different captures often share url and time; each such pair is looked up once.
    asked = kept.where(F.col(url).isNotNull() & F.col(fetched_at).isNotNull()).select(
        F.col(url).alias("_url"), F.col(fetched_at).alias("_at")).distinct()
    keys = asked.select("_url", "_at", F.explode(patterns_of(F.col("_url"), labels, segments, shortest)).alias("_key"))
    active = (keys.join(intervals, (F.col("_key") == F.col("pattern")) & (F.col("_at") >= F.col("valid_from"))
                        & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
              .groupBy("_url", "_at").agg(F.count("*").alias("n_active"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories")))
    known = F.col(url).isNotNull() & F.col(fetched_at).isNotNull()
    met = kept.where(known).join(active, (F.col(url) == F.col("_url")) & (F.col(fetched_at) == F.col("_at")), "left").drop("_url", "_at")
    # Rows without url or time would all meet under one key of the join.
    other = kept.where(~known).withColumns({"n_active": F.lit(None).cast("long"), "categories": F.lit(None).cast("string")})
    return met.unionByName(other).withColumns({
        "listed": F.col("n_active").isNotNull(), "n_active": F.coalesce("n_active", F.lit(0)).cast("long"), "categories": F.coalesce("categories", F.lit(""))})
