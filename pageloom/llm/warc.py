"""Not-modified revisits resolved to the full responses that they stand for.

Each revisit is joined, by canonical URL, to the latest full response before it (strictly before in time; of several at
one time the one of greatest record_id). It is resolved if a validator agrees: the strong or weak entity tag if both
have one, else the payload digest, else the time of last modification. A resolved revisit takes the payload of the
response and its headers, with those replaced that a not-modified answer may update.

The join is one sorted pass: records are dealt by ranges of (URL, time), so that even one URL with a third of all
records spreads over many tasks. A task carries the last full response forward; what it must have carried in from the
tasks before it comes from one row per task.

Null URLs match nothing. Null times come first. Repeated records are each answered. record_id may be of any ordered
type; columns of other names are ignored. Header names are compared in lower case; of several that differ in case only
the first stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut

# Header fields that a 304 answer may bring up to date (RFC 9110, section 15.4.5, and RFC 9111).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, leading www., fragment, tracking parameters and trailing slash; lower-case
    host; the other parameters in order."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(f"^(?i:{TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _etag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, target_id (null if there is none), state and the merged headers of each revisit.

    records: record_id long, url string, ts (any ordered type), kind ('response' or 'revisit'), etag, last_modified and
    digest strings, headers map<string,string>. state: resolved, mismatch (a response, but no validator agrees) or
    missing (no response before it).
    """
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "digest", "headers")
    rows = rows.where("kind in ('response', 'revisit')")
    order = ["canonical_url", "ts", F.col("kind") == "response", "record_id"]
    n = max(12, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))

    # What each task ends with, and from it what the next ones begin with: one row a task. A task's end is that of its
    # last URL; the tasks after it that begin with the same URL take it over until one of them has a later one.
    at_end = F.struct("canonical_url", "ts", (F.col("kind") == "response").alias("is_full"), "record_id")
    known = dealt.where("canonical_url is not null")
    ends = known.where("kind = 'response'").groupBy("part").agg(F.max_by(F.struct("canonical_url", full.alias("full")), at_end).alias("end"))
    tasks = known.groupBy("part").agg(F.min("canonical_url").alias("first")).join(ends, "part", "left")
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = tasks.withColumn("last", F.last("end", ignorenulls=True).over(before)).where(F.col("last.canonical_url") == F.col("first"))
    carried = carried.select("part", F.col("first").alias("canonical_url"), F.col("last.full").alias("carried"))

    w = W.Window.partitionBy("part", "canonical_url").orderBy("ts", F.col("kind") == "response", "record_id").rowsBetween(W.Window.unboundedPreceding, -1)
    seen = dealt.withColumn("own", F.last(full, ignorenulls=True).over(w)).where("kind = 'revisit'")
    seen = seen.join(F.broadcast(carried), ["part", "canonical_url"], "left").withColumn("full", F.when(F.col("canonical_url").isNotNull(), F.coalesce("own", "carried")))

    agrees = F.coalesce(_etag(F.col("etag")) == _etag(F.col("full.etag")), F.col("digest") == F.col("full.digest"), F.col("last_modified") == F.col("full.last_modified"), F.lit(False))
    state = F.when(F.col("full").isNull(), "missing").when(agrees, "resolved").otherwise("mismatch")
    # names in lower case; of fields whose names differ in case only, the first stands
    entries = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = lambda m: F.transform(F.map_entries(m), lambda e: F.lower(e["key"]))
    lower = lambda m: F.map_from_entries(F.filter(entries(m), lambda e, i: F.array_position(names(m), e["key"]) == i + 1))
    fresh = F.map_filter(lower(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda k, _: k.isin(*PERMITTED))
    old = lower(F.coalesce("full.headers", F.create_map().cast("map<string,string>")))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    return seen.select("record_id", "canonical_url", F.col("full.record_id").alias("target_id"), state.alias("state"), F.when(state == "resolved", merged).alias("headers"))
