"""URL filters with dated lists. DataFrame operations only.

Dated entries of lists become validity intervals; an as-of join evaluates every capture against the entries that were
active when it was fetched. A capture looks up its host, every domain above it and every leading part of its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"
#: A host that is an address has no domains above it.
ADDRESS = r"^\[|^[0-9.]+$"


def host_of(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def keys_of(url: str | Column) -> Column:
    """Lookup keys: ``example.org`` for the host and each domain above it, ``host/path`` for each leading path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(above)
    parts = F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda x: x != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.coalesce(paths, F.array().cast("array<string>")))))


def entry_key(key: str | Column) -> Column:
    """A list's key as captures look it up: the host in lower case, the path as it is, no slash at the end."""
    given = F.regexp_replace(key, "/+$", "")
    host = F.substring_index(given, "/", 1)
    return F.concat(F.lower(host), F.substr(given, F.length(host) + 1))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, list, verdict, since, until``: when each added entry was valid; ``until`` is null while it still is.

    Takes ``list, key, verdict, action, day`` with action add or remove. A later line for the same list and key ends an
    interval; of lines on one day an add wins, and among adds block wins over allow. Lines with a null are ignored.
    Hosts of keys are compared in lower case, paths as they are.
    """
    lines = entries.where("list IS NOT NULL AND key IS NOT NULL AND verdict IS NOT NULL AND action IN ('add', 'remove') AND day IS NOT NULL")
    lines = lines.withColumn("key", entry_key("key"))
    days = lines.groupBy("list", "key", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("added"), F.max(F.when(F.col("action") == "add", F.col("verdict"))).alias("verdict"))
    until = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return days.withColumn("until", until).where("added = 1").select("key", "list", "verdict", F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures (``page_id, url, day``) with ``host, n_active, verdict, matched_key, matched_list``.

    ``n_active`` counts the entries active for the capture. The longest matching key decides; of entries with that
    key allow wins over block, then the list's name. Captures without an active entry have verdict ``none``. Null or
    odd URLs and null days match nothing. Repeated rows each keep their row. Other columns of either table are not
    read, whatever their names; empty tables give no rows, or no matches. URLs are read whole. The list side is broadcast only if
    Spark's own size check allows it; otherwise both sides meet by key, and adaptive execution splits hot hosts.
    """
    at = captures.select("page_id", "url", "day")
    wanted = at.where("url IS NOT NULL AND day IS NOT NULL").distinct().select("page_id", "url", "day", F.explode(keys_of("url")).alias("key"))
    active = wanted.join(intervals(entries), "key").where("day >= since AND (until IS NULL OR day < until)")
    rank = F.struct((-F.length("key")).alias("a"), F.col("verdict").alias("b"), F.col("list").alias("c"), F.col("key").alias("d"))
    found = active.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("best"))
    found = found.select(*(F.col(c).alias(f"{c}_") for c in ("page_id", "url", "day")), "n", "best")
    joined = at.join(found, F.col("page_id").eqNullSafe(F.col("page_id_")) & (F.col("url") == F.col("url_")) & (F.col("day") == F.col("day_")), "left")
    return joined.select(
        "page_id", "url", "day", host_of("url").alias("host"), F.coalesce("n", F.lit(0)).alias("n_active"),
        F.coalesce("best.b", F.lit("none")).alias("verdict"), F.col("best.d").alias("matched_key"), F.col("best.c").alias("matched_list"),
    )
