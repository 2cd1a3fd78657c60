"""WARC: resolving not-modified revisits to the latest earlier full response.

``resolve`` is an as-of join by canonical URL. It runs in three levels so that a URL with
very many captures is no single task: within (URL, minute) a range window finds the latest
response before each revisit; minutes of a day, then days, are windows over one row for
each (partially aggregated). A validator check and the header merge follow.

* canonical URL: scheme, leading ``www.``, default port, fragment, ``utm_*`` parameters and
  trailing slashes are dropped; the host is lowercased.
* earlier: strictly smaller date; among responses of one date the larger record_id wins.
* validators: equal ETags if both have one, else equal Last-Modified if both have one,
  else there is nothing that contradicts. outcome: resolved, mismatch or unresolved.
* merge: the response's headers, with those of PERMITTED that the revisit sends in their
  place; names are lowercased. A name that one record has several times (in whatever case)
  is one header whose values are joined by ", " (RFC 9110, 5.3), in order of the names as
  sent, then of the values; null values are left out, a header with no other is null.

Cases: null or empty URLs match nothing (unresolved); a null date has nothing earlier and
is no candidate; null headers are empty; repeated records are resolved alike, one row for
each revisit row; very long URLs and headers are kept whole; columns not named below are
ignored. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import read

#: fixed values: headers that a 304 response may update (RFC 9110, 15.4.5)
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
MINUTE, DAY = 60, 86_400


def canonical_url(url: Column) -> Column:
    u = F.regexp_replace(F.trim(url), r"(?i)^https?://(www\.)?", "")
    u = F.regexp_replace(u, "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, "^[^/?]*", 0), ":(80|443)$", ""))
    rest = F.regexp_replace(u, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Entries of headers by lowercased name, each name once."""
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    entries = F.transform(F.array_sort(entries), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def merged(name: Column) -> Column:
        values = F.filter(F.transform(F.filter(entries, lambda e: e["key"] == name), lambda e: e["value"]), lambda v: v.isNotNull())
        return F.struct(name.alias("key"), F.when(F.size(values) > 0, F.array_join(values, ", ")).alias("value"))

    # names that differ already are the usual case
    return F.when(F.size(names) == F.size(entries), entries).otherwise(F.transform(names, merged))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of records.

    records: record_id long, record_type ('response' or 'revisit'), url, date long (seconds),
    etag, last_modified, headers map<string,string>, payload_digest, payload_length.
    """
    kept = records.where("record_type in ('response', 'revisit')").select(
        "record_id", "record_type", "url", "date", "etag", "last_modified", _lower_keys(F.col("headers")).alias("headers"), "payload_digest", "payload_length",
        F.nullif(canonical_url(F.col("url")), F.lit("")).alias("canonical_url"),
    ).withColumn("day", F.floor(F.col("date") / DAY)).withColumn("minute", F.floor(F.col("date") / MINUTE))
    full = F.expr("record_type = 'response' and date is not null and canonical_url is not null")
    response = F.struct("date", "record_id", "etag", "last_modified", "payload_digest", "payload_length", "headers")
    kept = kept.withColumn("response", F.when(full, response))
    keyed = kept.where("canonical_url is not null and date is not null")

    within = W.partitionBy("canonical_url", "minute").orderBy("date").rangeBetween(W.unboundedPreceding, -1)
    near = keyed.withColumn("same_minute", F.max("response").over(within)).where("record_type = 'revisit'")
    upto = lambda *by: W.partitionBy("canonical_url", *by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    minutes = keyed.groupBy("canonical_url", "day", "minute").agg(F.max("response").alias("last"))
    days = minutes.groupBy("canonical_url", "day").agg(F.max("last").alias("day_last")).withColumn("day_before", F.max("day_last").over(upto("day"))).drop("day_last")
    minutes = minutes.withColumn("same_day", F.max("last").over(upto("day", "minute"))).drop("last").join(days, ["canonical_url", "day"])
    found = near.join(minutes.drop("day"), ["canonical_url", "minute"], "left").withColumn("response", F.coalesce("same_minute", "same_day", "day_before")).drop("same_minute", "same_day", "day_before")
    loose = kept.where("record_type = 'revisit' and (canonical_url is null or date is null)").withColumn("response", F.lit(None).cast(kept.schema["response"].dataType))
    found = found.unionByName(loose)

    r = F.col("response")
    agrees = F.when(r["etag"].isNotNull() & F.col("etag").isNotNull(), r["etag"] == F.col("etag")).when(r["last_modified"].isNotNull() & F.col("last_modified").isNotNull(), r["last_modified"] == F.col("last_modified")).otherwise(True)
    ok = r.isNotNull() & agrees
    updates = F.filter(F.col("headers"), lambda e: e["key"].isin(PERMITTED))
    stays = F.filter(r["headers"], lambda e: ~F.exists(updates, lambda u: u["key"] == e["key"]))
    return found.select(
        "record_id", "canonical_url", "date",
        F.when(ok, "resolved").when(r.isNotNull(), "mismatch").otherwise("unresolved").alias("outcome"),
        r["record_id"].alias("response_id"),
        r["date"].alias("response_date"),
        F.when(ok, r["payload_digest"]).alias("payload_digest"),
        F.when(ok, r["payload_length"]).alias("payload_length"),
        F.when(ok, F.map_from_entries(F.array_sort(F.concat(stays, updates)))).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of pages: each is captured in full at page_id minutes and asked for
    again, with its ETag, 500 minutes later."""
    tag, size, at = F.md5(F.encode("html", "UTF-8")), F.octet_length("html").cast("long"), F.col("page_id") * 60
    header = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("record_type"), "url", at.alias("date"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        header("Content-Type", "text/html", "Content-Length", size.cast("string"), "ETag", tag, "Date", at.cast("string"), "Cache-Control", "max-age=60").alias("headers"),
        F.sha2(F.encode("html", "UTF-8"), 256).alias("payload_digest"), size.alias("payload_length"),
    )
    later = at + 500 * 60
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("record_type"), "url", later.alias("date"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        header("Content-Length", "0", "ETag", tag, "Date", later.cast("string"), "Cache-Control", "max-age=600", "Server", "edge").alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_length"),
    )
    return full.unionAll(again)


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl that pages stand for, resolved."""
    found = resolve(records_of_pages(read(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "canonical_url", "date", "outcome", "response_id", "response_date", "payload_digest", "payload_length", text.alias("headers"))


ORACLE = r"""
WITH canon AS (
  SELECT page_id, html, md5(html) AS tag, page_id * 60 AS at_,
    regexp_replace(regexp_replace(trim(url), '^https?://(www\.)?', '', 'i'), '#.*$', '') AS u
  FROM pages
), parts AS (
  SELECT *, lower(regexp_replace(regexp_extract(u, '^[^/?]*'), ':(80|443)$', '')) AS host,
    regexp_replace(u, '^[^/?]*', '') AS rest FROM canon
), q AS (
  SELECT *, regexp_replace(regexp_replace(rest, '\?.*$', ''), '/+$', '') AS path,
    regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query FROM parts
), c AS (
  SELECT *, nullif(host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '') AS canonical_url FROM q
), found AS (
  SELECT v.page_id, v.canonical_url, v.tag, v.at_ + 30000 AS date_, r.page_id AS rid, r.at_ AS rdate, r.tag AS rtag, r.html AS rhtml
  FROM c v ASOF LEFT JOIN c r ON v.canonical_url = r.canonical_url AND v.at_ + 30000 > r.at_
)
SELECT page_id * 2 + 1 AS record_id, canonical_url, date_ AS date,
  CASE WHEN rid IS NULL THEN 'unresolved' WHEN rtag = tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  rid * 2 AS response_id, rdate AS response_date,
  CASE WHEN rtag = tag THEN sha256(rhtml) END AS payload_digest,
  CASE WHEN rtag = tag THEN strlen(rhtml) END AS payload_length,
  CASE WHEN rtag = tag THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || strlen(rhtml) || chr(10) || 'content-type: text/html'
    || chr(10) || 'date: ' || date_ || chr(10) || 'etag: ' || tag END AS headers
FROM found
"""
