"""URL filters whose list entries have dates.

Dated entries of a pattern become validity intervals, and every capture is joined as of its fetch
time with the intervals of the patterns that cover its URL. Intervals are dealt to stretches of
days, so the join is an equi-join on (pattern, stretch) that can be split where a host is hot.
Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of a stretch.
STRETCH = 64
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
FIRST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)"


def host_of(url: Column) -> Column:
    """The host in lower case; empty for what is no absolute URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def parts_of(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case, path without slashes at its end, and query with its ``?``, of a URL or list entry."""
    bare = F.regexp_replace(F.regexp_replace(url, SCHEME, ""), "(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^(?:[^/?@]*@)?([^/?:@]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    return host, path, F.regexp_extract(bare, r"(?s)^[^?]*(\?.*)$", 1)


def _domains(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def prefixes_of(url: Column, depth: int) -> Column:
    """What may cover a URL: its host and all parent domains, each alone, with every beginning of
    the path of at most ``depth`` parts, and with the whole path and query."""
    _, path, query = parts_of(F.coalesce(url, F.lit("")))
    parts = F.split(path, "/")
    beginnings = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth))), lambda k: F.array_join(F.slice(parts, F.lit(1), k + 1), "/")
    )
    beginnings = F.filter(beginnings, lambda x: ~x.endswith("/"))
    beginnings = F.when(query != "", F.concat(beginnings, F.array(F.concat(path, query)))).otherwise(beginnings)
    both = F.flatten(F.transform(_domains(host_of(url)), lambda d: F.transform(beginnings, lambda x: F.concat(d, x))))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def patterns_of(url: Column) -> Column:
    """The short ones: host and all parent domains, and the host with the first path part."""
    domains = _domains(host_of(url))
    first = F.regexp_extract(F.coalesce(url, F.lit("")), FIRST, 1)
    both = F.when(first != "", F.concat(domains, F.array(F.concat(host_of(url), first)))).otherwise(domains)
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, since, until, blocked)`` from ``entries(pattern, day, blocked)``.

    An entry holds from its day until the next one of its pattern; of several on one day a
    blocking one wins. ``until`` is null for the last. Entries with nulls are left out.
    """
    daily = entries.dropna(subset=["pattern", "day", "blocked"]).groupBy("pattern", "day").agg(F.max("blocked").alias("blocked"))
    after = Window.partitionBy("pattern").orderBy("day")
    return daily.select("pattern", F.col("day").alias("since"), F.lead("day").over(after).alias("until"), "blocked")


def as_of(captures: DataFrame, entries: DataFrame, short: bool = False) -> DataFrame:
    """``(page_id, pattern, blocked)`` of every capture at its fetch day.

    ``captures`` needs ``page_id`` (unique), ``url`` and ``day`` (whole days); other columns are
    ignored. The longest covering pattern that has an active entry decides; without one, or
    without URL or day, nothing does: ``pattern`` is null and ``blocked`` false.

    An entry is a domain, a domain with the beginning of a path in whole parts, or a whole URL;
    scheme, user, port, fragment and slashes at the end of the path do not count, and ``pattern``
    is what is left. A domain covers its subdomains as well. With ``short`` only domains and exact
    hosts with their first path part cover a URL.
    """
    host, path, query = parts_of(F.col("pattern"))
    entries = entries.withColumn("pattern", F.concat(host, path, query))
    # Deeper beginnings of a path than any entry has need not be looked up.
    _, path, _ = parts_of(F.col("pattern"))
    depth = 0 if short else entries.agg(F.max(F.size(F.split(path, "/")) - 1)).first()[0] or 0
    covering = patterns_of(F.col("url")) if short else prefixes_of(F.col("url"), depth)
    captures = captures.select("page_id", "url", "day")
    last = captures.agg(F.max("day")).first()[0]
    horizon = F.lit(last if last is not None else 0)
    valid = intervals(entries).filter(F.col("since") <= horizon)
    until = F.coalesce(F.least(F.col("until") - 1, horizon), horizon)
    stretches = F.sequence(F.floor(F.col("since") / STRETCH), F.floor(until / STRETCH))
    valid = valid.withColumn("stretch", F.explode(stretches))
    asked = captures.filter("day is not null").select("page_id", "day", F.explode(covering).alias("pattern"))
    asked = asked.withColumn("stretch", F.floor(F.col("day") / STRETCH))
    met = asked.join(valid, ["pattern", "stretch"])
    met = met.filter((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = met.groupBy("page_id").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "blocked")).alias("best"))
    out = captures.select("page_id").join(best, "page_id", "left")
    return out.select("page_id", F.col("best.pattern").alias("pattern"), F.coalesce("best.blocked", F.lit(False)).alias("blocked"))
