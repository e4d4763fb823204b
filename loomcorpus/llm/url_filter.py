"""URL filters: captures judged by the list entries that were active when they were fetched.

A list is a log of dated additions and removals of patterns. The log becomes validity
intervals, closed at the start and open at the end; an addition of what is already listed and a
removal of what is not change nothing. A capture is looked up by its host, each parent domain
and its host with each leading part of its path that is no deeper than the deepest entry, in an
equi-join with the time range as a condition, so only entries that can match are met, however
many captures a host has.

Defined cases: a capture with a null or unparsable URL or a null time matches nothing and is
not blocked; a dot that ends a host is not part of it; a bracketed IPv6 address is a host without
parents; of entries of one pattern, list and time a removal comes last; entries with a null
list, kind, pattern or time are ignored; repeated captures get one row each; empty tables are
fine on either side; URLs of any length are read whole; columns of the captures named hits, lists,
listed_since or blocked give way to the result, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
PATH = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
FIRST = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^/?#]+)"
DOMAIN, PREFIX = "domain", "prefix"


def host(url):
    """Lower-cased host of a URL; null where there is none."""
    return F.nullif(F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit(".")), F.lit(""))


def intervals(log: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) of a log of (list, kind, pattern, action, at)."""
    clean = log.where("list is not null and kind is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    clean = clean.select("list", "kind", F.rtrim(F.lower("pattern"), F.lit("./")).alias("pattern"), (F.col("action") == "add").alias("on"), "at")
    # of one moment, a removal is the last word
    state = clean.groupBy("list", "kind", "pattern", "at").agg(F.min("on").alias("on"))
    w = W.partitionBy("list", "kind", "pattern").orderBy("at")
    change = state.withColumn("was", F.lag("on").over(w)).where(F.col("on") != F.coalesce("was", F.lit(False)))
    spans = change.withColumn("valid_to", F.lead("at").over(w))
    return spans.where("on").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, log: DataFrame) -> DataFrame:
    """Captures of (page_id, url, fetched_at, ...) with blocked, hits, lists and listed_since.

    hits: entries active at the fetch; lists: their lists in order; listed_since: the earliest
    start of those entries.
    """
    active = intervals(log)
    # the deepest path of an entry bounds what is looked up
    deepest = active.where(F.col("kind") == PREFIX).agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    looked = captures.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    named = looked.withColumn("host", host(F.col("url"))).where("host is not null")
    labels = F.when(F.col("host").startswith("["), F.array("host")).otherwise(F.split("host", r"\."))
    steps = F.filter(F.split(F.regexp_extract(F.lower("url"), PATH, 1), "/"), lambda x: x != "")
    named = named.withColumn("labels", labels).withColumn("steps", F.slice(steps, 1, deepest) if deepest else F.array().cast("array<string>"))
    domains = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.struct(F.lit(DOMAIN).alias("kind"), F.array_join(F.slice(F.col("labels"), i, F.size("labels")), ".").alias("pattern")))
    depths = F.when(F.size("steps") > 0, F.sequence(F.lit(1), F.size("steps"))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(depths, lambda i: F.struct(F.lit(PREFIX).alias("kind"), F.concat("host", F.lit("/"), F.array_join(F.slice(F.col("steps"), F.lit(1), i), "/")).alias("pattern")))
    keyed = named.select("url", "fetched_at", F.explode(F.concat(domains, prefixes)).alias("key")).select("url", "fetched_at", "key.kind", "key.pattern")
    met = keyed.join(active, (keyed.kind == active.kind) & (keyed.pattern == active.pattern) & (active.valid_from <= keyed.fetched_at) & (active.valid_to.isNull() | (keyed.fetched_at < active.valid_to)))
    found = met.groupBy(keyed.url.alias("__url"), keyed.fetched_at.alias("__at")).agg(F.count("*").alias("hits"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("listed_since"))
    plain = captures.drop("hits", "lists", "listed_since", "blocked")
    out = plain.join(found, (plain.url == found["__url"]) & (plain.fetched_at == found["__at"]), "left").drop("__url", "__at")
    return out.withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long")).withColumn("blocked", F.col("hits") > 0)
