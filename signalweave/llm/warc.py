"""WARC revisits: not-modified records resolved to the latest earlier full response of their URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, hot_join, table
from .urls import canonical

#: Headers that a not-modified answer may renew in the stored response; all others stay the stored one's.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning"]
#: Seconds of a URL's history that one window partition holds.
SLICE = 86_400
#: Responses up to which the ids asked for are broadcast.
BROADCAST_IDS = 1_000_000


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of repeated names the last stays."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(pairs, lambda e: F.lower(F.trim(e["key"])))
    last = F.filter(F.transform(pairs, lambda e, i: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: e["i"] + 1 == F.size(names) - F.array_position(F.reverse(names), e["key"]).cast("int") + 1)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """One row for each revisit in ``records`` (record_id, url, at long, kind, headers map, body binary or string).

    ``kind`` is ``response`` or ``revisit``. A revisit is joined to the latest
    response of its canonical URL with a smaller (at, record_id). Its validators
    are the ``etag`` (compared weakly) and, where either side has none, the
    ``last-modified`` header. status: ``resolved``; ``mismatch`` if a validator
    differs; ``unchecked`` if both sides share none; ``orphan`` without an
    earlier response. Only resolved rows get a body and merged headers: the
    response's, renewed by the revisit's permitted ones. Records with null url,
    time or kind are orphans if revisits and never resolve others.

    The as-of join looks within a slice of a URL's time first, then takes the
    last response of an earlier slice from a pre-aggregated table, so that a URL
    with a third of all records is spread over its slices. Headers decide before
    any body moves; bodies are fetched once, by record. Of responses that repeat an
    id and time, the one with the smallest body digest, then headers, counts.
    """
    rows = records.select("record_id", "url", F.col("at").cast("long").alias("at"), "kind", _lowered(F.col("headers")).alias("headers"), "body").withColumns({"uri": canonical(F.col("url")), "slice": F.floor(F.col("at") / slice_seconds)})
    order = F.struct("at", "record_id")
    response = F.when((F.col("kind") == "response") & F.col("at").isNotNull(), order)
    slim = rows.select("record_id", "uri", "at", "kind", "slice", response.alias("response"))
    inside = W.partitionBy("uri", "slice").orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    asked = slim.where("uri is not null and at is not null").withColumn("found", F.last("response", ignorenulls=True).over(inside)).where("kind = 'revisit'").select("record_id", "uri", "slice", "found")
    lasts = slim.where("uri is not null and response is not null").groupBy("uri", "slice").agg(F.max("response").alias("last"))
    # Slices of a URL that were asked without an answer take the latest earlier slice's last response.
    wanted = asked.where("found is null").select("uri", "slice").distinct().withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType))
    earlier = lasts.unionByName(wanted).groupBy("uri", "slice").agg(F.max("last").alias("last")).withColumn("before", F.last("last", ignorenulls=True).over(W.partitionBy("uri").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).select("uri", "slice", "before")
    matched = asked.join(earlier, ["uri", "slice"], "left").select("record_id", F.coalesce("found", "before")["record_id"].alias("response_id"), F.coalesce("found", "before")["at"].alias("response_at"))
    scratch = Scratch(records.sparkSession, "warc")
    key = ["response_id", "response_at"]
    matched = scratch.save(matched.dropDuplicates(["record_id"]), "matched")
    found = matched.where("response_id is not null")
    asks = scratch.save(found.groupBy(*key).agg(F.count("*").alias("asks")), "asks")
    own = rows.where("kind = 'revisit'").select("record_id", "url", F.col("uri").alias("canonical_url"), "at", F.col("headers").alias("new"))
    full = rows.where("kind = 'response' and at is not null").select(F.col("record_id").alias("response_id"), F.col("at").alias("response_at"), F.coalesce(F.md5("body"), F.lit("")).alias("digest"), "headers", "body")
    held = full.select(*key, "digest", F.array_sort(F.map_entries("headers")).alias("old")).join(asks, key).groupBy(*key, "asks").agg(F.min(F.struct("digest", "old")).alias("pick"))
    held = scratch.save(held.select(*key, "asks", "pick.digest", F.map_from_entries("pick.old").alias("old")), "held")
    joined = own.join(hot_join(found, held, key, "asks").drop("asks"), "record_id", "left")
    tag = lambda c: F.regexp_replace(F.try_element_at(c, F.lit("etag")), "^W/", "")
    day = lambda c: F.try_element_at(c, F.lit("last-modified"))
    new, had = F.col("new"), F.col("old")
    same = F.when(tag(new).isNotNull() & tag(had).isNotNull(), tag(new) == tag(had)).when(day(new).isNotNull() & day(had).isNotNull(), day(new) == day(had))
    status = F.when(F.col("response_id").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    renewed = F.map_filter("new", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    resolved = F.col("status") == "resolved"
    columns = ["record_id", "url", "canonical_url", "at", *key, "status", "headers"]
    judged = scratch.save(joined.withColumn("status", status).withColumn("headers", F.when(resolved, merged)).select(*columns, "digest"), "judged")
    unsolved = judged.where(~resolved).select(*columns, F.lit(None).cast(full.schema["body"].dataType).alias("body"))
    return _with_bodies(judged.where(resolved), full.select(*key, "digest", "body"), asks, key).select(*columns, "body").unionByName(unsolved)


def _with_bodies(solved: DataFrame, bodies: DataFrame, asks: DataFrame, key: list[str]) -> DataFrame:
    """Resolved revisits with their bodies, each of which is shuffled once.

    A response with more than a share of 1 in 4 x partitions of the matches (so at
    most 4 x partitions of them) is dealt to as many parts as it has such shares.
    Where under half of the responses are asked for and these are few, the others'
    bodies are left out before the shuffle.
    """
    least = max(1, asks.agg(F.sum("asks")).first()[0] or 0) // (4 * int(solved.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1
    hot = F.broadcast(asks.where(F.col("asks") > least).select(*key, F.ceil(F.col("asks") / least).alias("parts")))
    wanted = solved.select(*key).distinct()
    n = wanted.limit(BROADCAST_IDS + 1).count()
    if n <= BROADCAST_IDS and 2 * n < bodies.count():
        bodies = bodies.join(F.broadcast(wanted), key, "left_semi")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = bodies.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    asked = solved.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64("record_id"), parts)).drop("parts")
    by = [*key, "digest", "part"]
    return asked.join(dealt.dropDuplicates(by), by)


def captures(pages: DataFrame) -> DataFrame:
    """Records from ``pages``: each is fetched at second 3600 x page_id, and asked for again 5,000 pages later.

    The second fetch is a revisit that carries the first one's tag, so that a
    page fetched meanwhile under the same canonical URL makes a mismatch.
    """
    at = F.col("page_id") * 3600
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    size = F.length(F.coalesce("html", F.lit("")).cast("binary")).cast("string")
    first = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), size, F.lit("Date"), at.cast("string")).alias("headers"), F.col("html").alias("body"))
    later = at + 5_000 * 3600
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"), F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), later.cast("string")).alias("headers"), F.lit(None).cast("string").alias("body"))
    return first.unionAll(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit with what it resolved to; texts as digests."""
    out = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    head = lambda k: F.try_element_at(F.col("headers"), F.lit(k))
    return out.select("record_id", "canonical_url", "response_id", "status", head("date").alias("date"), head("content-length").alias("content_length"), F.md5("body").alias("body_md5"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, html, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS size, page_id * 3600 AS at,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's') AS q
  FROM pages
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?|/index\.html?)$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '') END AS uri
  FROM p
), m AS (
  SELECT r.page_id * 2 + 1 AS record_id, r.uri AS canonical_url, r.tag AS asked, r.at + 5000 * 3600 AS asked_at, max(e.page_id) AS best
  FROM c r LEFT JOIN c e ON e.uri = r.uri AND e.at <= r.at + 5000 * 3600 AND (e.at, e.page_id * 2) < (r.at + 5000 * 3600, r.page_id * 2 + 1)
  GROUP BY ALL
)
SELECT record_id, canonical_url, best * 2 AS response_id,
  CASE WHEN best IS NULL THEN 'orphan' WHEN e.tag = asked THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN e.tag = asked THEN CAST(asked_at AS VARCHAR) END AS date,
  CASE WHEN e.tag = asked THEN CAST(e.size AS VARCHAR) END AS content_length,
  CASE WHEN e.tag = asked THEN md5(e.html) END AS body_md5
FROM m LEFT JOIN c e ON e.page_id = m.best
"""
