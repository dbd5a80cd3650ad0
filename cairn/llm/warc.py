"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

Input: a row for each record: record_id, type ('response' or 'revisit'), url, ts (seconds), headers
(map of strings), payload (string or binary, of responses). The join never brings a URL's records
together: time is cut into ranges of `span` seconds, each range's last response is folded, the few
folded rows are carried forward, and only a range's own records are sorted together.

A revisit's validators are held against the response found: its ETag if it has one (weakly: W/ is
dropped), or else its Last-Modified. The result's headers are the response's, updated by those of the
revisit that a 304 may update; fields that frame the message or belong to one connection stay.

Defined cases: records without a URL or time are resolved to nothing (status 'no_response'); of
responses at one time the one with the greater record_id counts; a response at the revisit's own time
is not earlier; null header maps are empty; header names compare in lower case; repeated rows stay;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that only trace where a visit came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: Fields that a 304 does not update.
FIXED = ["connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
SPAN = 86_400


def canonical(url: Column) -> Column:
    """Scheme dropped, host in lower case without 'www.' and default port, no fragment, no tracking parameters, the others
    sorted, no 'index.html' and no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/index\\.html?$", "/"), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _lower_keys(headers: Column) -> Column:
    """A map with names in lower case; of equal names the one first in the order of name and value stays."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.aggregate(lower, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.array_append(acc, e)))
    return F.map_from_entries(first)


def as_of(records: DataFrame, span: int = SPAN) -> DataFrame:
    """records (url_key, ts, record_id, is_response and more) with `found`: (ts, record_id) of the latest earlier response of the url_key."""
    own = records.withColumn("range", F.floor(F.col("ts") / span).cast("long"))
    mark = F.when(F.col("is_response"), F.struct(F.col("ts").alias("ts"), F.col("record_id").alias("record_id")))
    folded = own.groupBy("url_key", "range").agg(F.max(mark).alias("best"))
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.select("url_key", "range", F.max("best").over(before).alias("carried"))
    inside = Window.partitionBy("url_key", "range").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    return own.withColumn("near", F.max(mark).over(inside)).join(carried, ["url_key", "range"]).withColumn("found", F.coalesce("near", "carried")).drop("near", "carried", "range")


def _text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """record_id, url_key, ts, status, source_id, headers, payload: a row for each revisit.

    status: 'resolved'; 'mismatch' (the response found has another validator); 'no_validator' (the revisit has none, or the
    response lacks the one it has); 'no_response'. Only a resolved revisit has headers and payload. source_id: the response found.
    """
    own = records.select("record_id", F.col("type") == "response", canonical(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), _lower_keys(F.col("headers")).alias("headers"), "payload", "type").withColumnRenamed("(type = response)", "is_response")
    slim = own.where("type IN ('response', 'revisit')").select("url_key", "ts", "record_id", "is_response", F.when(~F.col("is_response"), F.col("headers")).alias("headers"))
    joined = as_of(slim.where("url_key IS NOT NULL AND ts IS NOT NULL"), span).where("NOT is_response").drop("is_response")
    lost = slim.where("NOT is_response AND (url_key IS NULL OR ts IS NULL)").select(*(c for c in joined.columns if c != "found"), F.lit(None).cast(joined.schema["found"].dataType).alias("found"))
    full = own.where("is_response").select(F.col("record_id").alias("source_id"), F.col("headers").alias("stored"), "payload").dropDuplicates(["source_id"])
    rows = joined.unionByName(lost).withColumn("source_id", F.col("found.record_id")).join(full, "source_id", "left")
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    date = lambda h: F.element_at(h, "last-modified")
    h, s = F.col("headers"), F.col("stored")
    asked, held = F.coalesce(tag(h), date(h)), F.when(tag(h).isNotNull(), tag(s)).otherwise(date(s))
    status = F.when(F.col("source_id").isNull(), "no_response").when(asked.isNull() | held.isNull(), "no_validator").when(asked == held, "resolved").otherwise("mismatch")
    update = F.map_filter(h, lambda k, v: ~k.isin(FIXED))
    merged = F.map_concat(F.map_filter(s, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    good = F.col("status") == "resolved"
    return rows.withColumn("status", status).select("record_id", "url_key", "ts", "status", "source_id", F.when(good, merged).alias("headers"), F.when(good, F.col("payload")).alias("payload"))


def records_of(pages: DataFrame) -> DataFrame:
    """WARC records out of plain pages: page p is fetched at 1000 p and visited again 1,000,000 s later with 304.

    The ETag is the page's MD5, in responses of pages not divisible by 7; a revisit has its own page's
    (weak if the page is odd) except that pages divisible by 5 have another's; pages divisible by 7 have Last-Modified alone.
    """
    p = F.col("page_id")
    body = F.coalesce("html", F.lit(""))
    other = F.when(p % 5 == 0, F.lit("other")).otherwise(F.md5(body))
    full = F.map_filter(F.create_map(F.lit("ETag"), F.when(p % 7 != 0, F.md5(body)), F.lit("Last-Modified"), (p % 97).cast("string"), F.lit("Content-Length"), F.octet_length(body).cast("string"), F.lit("Date"), (1000 * p).cast("string")), lambda k, v: v.isNotNull())
    again = F.map_filter(F.create_map(F.lit("etag"), F.when(p % 7 != 0, F.concat(F.when(p % 2 == 1, F.lit("W/")).otherwise(F.lit("")), other)), F.lit("last-modified"), F.when(p % 7 == 0, (p % 97).cast("string")), F.lit("content-length"), F.lit("0"), F.lit("date"), (1000 * p + 1_000_000).cast("string")), lambda k, v: v.isNotNull())
    one = lambda i, kind, ts, headers, payload: F.struct((2 * p + i).alias("record_id"), F.lit(kind).alias("type"), F.col("url").alias("url"), ts.alias("ts"), headers.alias("headers"), payload.alias("payload"))
    both = F.array(one(0, "response", 1000 * p, full, body), one(1, "revisit", 1000 * p + 1_000_000, again, F.lit(None).cast("string")))
    return pages.select(F.explode(both).alias("r")).select("r.*")


def digest(resolved: DataFrame) -> DataFrame:
    return resolved.select("record_id", "url_key", "ts", "status", "source_id", _text(F.col("headers")).alias("header_text"), F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


ORACLE = """
WITH c AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
k AS (SELECT page_id AS p, coalesce(html, '') AS body,
  regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\\.html?$', '/'), '/+$', '') AS base,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS q FROM c),
u AS (SELECT p, body, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url_key FROM k),
r AS (SELECT url_key, p, 1000 * p AS ts, CASE WHEN p % 7 <> 0 THEN md5(body) END AS etag, (p % 97)::VARCHAR AS lm, strlen(body) AS len, md5(body) AS m FROM u),
v AS (SELECT url_key, p, 1000 * p + 1000000 AS ts, CASE WHEN p % 7 <> 0 THEN CASE WHEN p % 5 = 0 THEN 'other' ELSE md5(body) END END AS tag, CASE WHEN p % 7 <> 0 THEN CASE WHEN p % 2 = 1 THEN 'W/' ELSE '' END || CASE WHEN p % 5 = 0 THEN 'other' ELSE md5(body) END END AS sent, CASE WHEN p % 7 = 0 THEN (p % 97)::VARCHAR END AS lm FROM u),
j AS (SELECT v.*, r.p AS rp, r.etag AS retag, r.lm AS rlm, r.len AS rlen, r.m AS rm FROM v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.ts > r.ts),
s AS (SELECT *, CASE WHEN rp IS NULL THEN 'no_response' WHEN coalesce(tag, lm) IS NULL OR CASE WHEN tag IS NOT NULL THEN retag ELSE rlm END IS NULL THEN 'no_validator'
  WHEN coalesce(tag, lm) = CASE WHEN tag IS NOT NULL THEN retag ELSE rlm END THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT 2 * p + 1 AS record_id, url_key, ts, status, 2 * rp AS source_id,
  CASE WHEN status = 'resolved' THEN 'content-length: ' || rlen || chr(10) || 'date: ' || ts || coalesce(chr(10) || 'etag: ' || coalesce(sent, retag), '') || chr(10) || 'last-modified: ' || coalesce(lm, rlm) END AS header_text,
  CASE WHEN status = 'resolved' THEN rm END AS payload_md5
FROM s
"""
