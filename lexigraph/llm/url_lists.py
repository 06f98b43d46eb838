"""URL filters by dated lists: a temporal join of captures and list entries.

An entry is added to a list, or removed from it, on a date. The events of one
entry, in order, become validity intervals [added, next event); a capture is
judged by the entries whose interval holds its fetch time, so a page fetched
before its host was listed passes. Three kinds of entry: ``host`` (that host),
``domain`` (it and all below it) and ``prefix`` (host and leading path segments).

A capture is turned into the keys that could list it (its host, the suffixes of
its host at dots, its host followed by no, one, two, ... leading path segments),
so the as-of join is one equality on kind and key with the interval as a further
condition. The intervals are broadcast only if they are counted to be few and
short; else both sides are salted, for a key such as a whole top-level domain is
asked by a large share of all captures.

Patterns and addresses are brought to one form: lower case, no dot at a host's
end, runs of slashes as one, none at a path's end; so ``x.org``, ``x.org/`` and
``X.org//`` are the same prefix and list all of ``x.org``.

Defined cases: null or odd URLs have no keys and pass; URLs are read whole; a
null fetch time is outside every interval; events with a null field are ignored;
of events at the same time the removal comes first, and repeated additions make
one interval; repeated captures are judged each; no entries, or no captures, are
no error; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

#: Bytes of intervals that may be broadcast, and parts of a key beyond.
FEW = 64 << 20
SALT = 16


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, kind, pattern, start, until)`` from dated ``(list, kind, pattern, action, at)``; until is null while listed."""
    known = entries.select("list", "kind", plain(F.col("kind"), F.col("pattern")).alias("pattern"), "action", "at").dropna()
    order = W.partitionBy("list", "kind", "pattern").orderBy("at", F.desc("action"))  # remove before add
    events = known.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    events = events.withColumn("until", F.lead("at").over(order))
    return events.where("action = 'add'").select("list", "kind", "pattern", F.col("at").alias("start"), "until")


def plain(kind: Column, pattern: Column) -> Column:
    """A pattern in the form that :func:`keys` gives."""
    prefix = F.rtrim(F.regexp_replace(F.lower(pattern), "/+", "/"), F.lit("/"))
    host = F.rtrim(F.split_part(prefix, F.lit("/"), F.lit(1)), F.lit("."))
    return F.when(kind == "prefix", F.concat(host, F.substr(prefix, F.instr(F.concat(prefix, F.lit("/")), "/")))).otherwise(F.rtrim(F.lower(pattern), F.lit(".")))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column, segments_at_most: int, labels_at_most: int) -> Column:
    """Array of ``(kind, key)`` that may list a URL, where patterns have at most so many path segments and host labels.

    The bounds leave no match out; they keep the keys of an endless address short.
    """
    host, segments = host_of(url), F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    labels = F.split(host, r"\.")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("pattern"))
    below = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - labels_at_most + 1), F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    ahead = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(segments_at_most))), lambda i: pair("prefix", F.array_join(F.concat(F.array(host), F.slice(segments, 1, i)), "/")))
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.array(pair("host", host)), below, ahead))


def judge(captures: DataFrame, entries: DataFrame, key: str = "capture_id", few: int = FEW) -> DataFrame:
    """``(key, url, fetched_at, n_active, lists, blocked)`` for every capture; lists are those active, in order."""
    scratch = Scratch(captures.sparkSession, "lists")
    spans = intervals(entries)
    longest = lambda mark: F.coalesce(F.max(F.size(F.split("pattern", mark))), F.lit(1))
    weight, deep, wide = spans.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.octet_length("list") + 64), F.lit(0)), longest("/"), longest(r"\.")).first()
    spans = spans.withColumnsRenamed({"kind": "k", "pattern": "p"})
    # saved, so that a capture has one number whatever is run again
    rows = scratch.save(captures.select(F.col(key), "url", "fetched_at").withColumn("row", F.monotonically_increasing_id()), "captures")
    asked = rows.where("fetched_at is not null").select("row", "fetched_at", F.explode(keys(F.col("url"), deep, wide)).alias("ask")).select("row", "fetched_at", "ask.*")
    same = (F.col("kind") == F.col("k")) & (F.col("pattern") == F.col("p"))
    if weight <= few:
        spans = F.broadcast(spans)
    else:
        asked = asked.withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int"))
        spans = spans.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        same &= F.col("salt") == F.col("s")
    active = asked.join(spans, same & (F.col("fetched_at") >= F.col("start")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    hits = active.groupBy("row").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    out = rows.join(hits, "row", "left")
    return out.select(key, "url", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_active").isNotNull().alias("blocked"))
