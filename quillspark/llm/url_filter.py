"""URL filters by a temporal list join.

A list is a log of dated entries (``kind, key, category, verdict, listed,
action``); entries of one ``(kind, key, category)`` become validity intervals,
from an ``add`` to the next entry. Kinds are ``url`` (host, path and query),
``prefix`` (host and path up to a slash), ``host`` and ``domain`` (a host and
all below it).

A capture (``id, url, fetched``) is evaluated against the entries active when
it was fetched. Its candidate keys are few but shared (a domain may be that of
every capture), so the distinct keys and days are joined to the intervals
first: a hot host is one row a day there, whatever its captures. What matched
then goes back to the captures by a plain equi-join, which Spark may split.

Of the active entries the most specific decides (url, prefix, host, domain;
longer keys first), of one key the one listed last, then the smaller category.

Defined results: null or host-less URLs have their URL as only candidate (null:
the empty one); null ``fetched`` matches nothing; a removal beats an addition
of the same day, and repeated entries count once; null keys or dates of
entries are ignored; repeated captures are kept; empty tables are no problem;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: scheme, optional user, host, optional port, then path and query without fragment.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)([^#]*)"
RANK = {"url": 3, "prefix": 2, "host": 1, "domain": 0}


def intervals(entries: DataFrame) -> DataFrame:
    """``kind, key, category, verdict, valid_from, valid_to`` (null: still valid)."""
    # one row per key and day: a removal wins
    days = entries.filter("key is not null and listed is not null") \
        .groupBy("kind", "key", "category", F.col("listed").cast("date").alias("listed")) \
        .agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("added"),
             F.max(F.when(F.col("action") == "add", F.col("verdict"))).alias("verdict"))
    of_key = Window.partitionBy("kind", "key", "category").orderBy("listed")
    return days.withColumn("valid_to", F.lead("listed").over(of_key)).filter("added = 1") \
        .select("kind", "key", "category", "verdict", F.col("listed").alias("valid_from"), "valid_to")


def candidates(url: Column) -> Column:
    """All ``(kind, key)`` that an entry for this URL could have."""
    host = F.lower(F.regexp_extract(url, URL, 1))
    path = F.regexp_extract(url, URL, 2)
    labels = F.split(host, r"\.")
    parts = F.split(path, "/")
    make = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    domains = F.transform(labels, lambda _, i: make("domain", F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    # of /a/b: /, /a/
    prefixes = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1),
                           lambda _, i: make("prefix", F.concat(host, F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), F.lit("/"))))
    return F.when(host == "", F.array(make("url", url))).otherwise(F.concat(
        F.array(make("url", F.concat(host, path, F.regexp_extract(url, URL, 3))), make("host", host)), prefixes, domains))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, url, fetched, decision, kind, key, category, since, n_active`` of every capture."""
    rows = captures.select("id", F.coalesce("url", F.lit("")).alias("url"), F.col("fetched").cast("date").alias("fetched"))
    rows = rows.withColumn("c", F.explode(candidates(F.col("url")))).select("id", "url", "fetched", "c.kind", "c.key")
    asked = rows.groupBy("kind", "key", "fetched").agg(F.lit(1).alias("_")).drop("_")
    valid = intervals(entries)
    active = asked.join(valid, ["kind", "key"]).filter("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    # of the entries of one key on one day the one listed last
    found = active.groupBy("kind", "key", "fetched").agg(
        F.count("*").alias("n"), F.max("valid_from").alias("since"),
        F.min_by(F.struct("category", "verdict"), F.struct(F.datediff(F.lit("1970-01-01"), "valid_from"), "category")).alias("e"))
    rank = F.expr("case kind " + " ".join(f"when '{k}' then {r}" for k, r in RANK.items()) + " end")
    best = F.max_by(F.struct("kind", "key", "e", "since"), F.when(F.col("n").isNotNull(), F.struct(rank, F.length("key"))))
    # a capture's rows come together again; each of equal captures has one candidate of kind url
    out = rows.join(found, ["kind", "key", "fetched"], "left").groupBy("id", "url", "fetched").agg(
        F.sum(F.expr("cast(kind = 'url' as int)")).alias("times"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_active"), best.alias("b"))
    return out.select("id", "url", "fetched", "times", F.coalesce("b.e.verdict", F.lit("none")).alias("decision"), F.col("b.kind").alias("kind"),
                      F.col("b.key").alias("key"), F.col("b.e.category").alias("category"), F.col("b.since").alias("since"),
                      F.expr("cast(n_active div times as bigint)").alias("n_active")) \
        .withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
