"""Not-modified revisits resolved against the response they stand for.

Records (id, ts, kind, url, etag, last_modified, digest, headers) are joined as-of: a ``revisit`` record takes, among the
full ``response`` records of its canonical URL, the one of latest ts strictly before its own; equal ts go to the greater
id. Where records have a column ``status``, only a response of status 200 is full: a partial or error response isn't.
Its validators are then checked: entity tags if both have one (weak prefix ignored), else last-modified if both have
one, else payload digests if both have one. Where they agree (or none can be compared) the headers of the response are
taken, with those that a 304 may update replaced by the revisit's.

The join is cut by time: within a (URL, time block) group by a running maximum, between blocks by the last response of
each block. The blocks are quantiles of ts, at most ``BLOCKS`` of them and even in rows whatever the clocks say, so a URL
with a third of all records is dealt over that many groups and its second step has at most that many rows. Bodies never
move; only keys and header lists do.

Outcomes: ``validated``, ``unchecked`` (nothing to compare), ``mismatch`` (a response that the validators contradict:
no headers are merged), ``no_response`` (none earlier). Where nothing can be compared the headers are merged, as RFC 9111
(4.3.4) does for the only stored response. Defined results: null URLs match nothing, and revisits without one have a row
only if ``unkeyed`` is set (``no_response``); records with null ts or a kind other than the two are neither revisits nor responses; null header lists are empty; header names compare in lower
case, and the last of repeated names counts; repeated records each get their own result; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time blocks at most, a square: a row's block is found by two scans of its root.
BLOCKS = 1024
#: Header fields of a 304 response that update a stored response (RFC 9110 and 9111).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't select content.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. or default port; no scheme, fragment, tracking parameters, index page, .html or last slash; parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^(www|m)[.]", ""), ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/index[.]html?$", ""), "[.]html?$", ""), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _by_name(headers: Column) -> Column:
    """Headers with names in lower case, the last of each name only."""
    low = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    return F.filter(low, lambda h, k: ~F.exists(F.slice(low, k + 2, F.greatest(F.size(low), F.lit(1))), lambda later: later["name"] == h["name"]))


def merged(stored: Column, update: Column) -> Column:
    """Stored headers, with permitted ones replaced or added from the update; in order of name."""
    fresh = F.filter(_by_name(update), lambda h: h["name"].isin(*PERMITTED))
    kept = F.filter(_by_name(stored), lambda h: ~F.exists(fresh, lambda f: f["name"] == h["name"]))
    return F.array_sort(F.concat(kept, fresh))


def time_block(records: DataFrame) -> Column:
    """The block of a row's ts: how many of the quantiles of ts are at or below it."""
    cuts = sorted(set(records.select(F.percentile_approx("ts", [k / BLOCKS for k in range(1, BLOCKS)] or [0.5], 20 * BLOCKS)).first()[0] or []))
    step = max(1, math.isqrt(len(cuts)))
    if not cuts:
        return F.lit(0)
    # The bounds as one literal; every step-th of them is compared first, then those after the last that is passed.
    every = F.lit([int(c) for c in cuts])
    ahead = F.size(F.filter(F.lit([int(c) for c in cuts[step - 1 :: step]]), lambda c: c <= F.col("ts"))) * step
    return ahead + F.size(F.filter(F.slice(every, ahead + 1, F.lit(step)), lambda c: c <= F.col("ts")))


def resolve(records: DataFrame, unkeyed: bool = False) -> DataFrame:
    """One row per revisit: id, url_key, ts, target_id, target_ts, outcome, headers (array of name, value; null unless merged)."""
    empty = F.array().cast("array<struct<name:string,value:string>>")
    full = (F.col("kind") == "response") & (F.coalesce(F.col("status") == 200, F.lit(False)) if "status" in records.columns else F.lit(True))
    rows = records.select(
        "id", "ts", canonical_url(F.col("url")).alias("url_key"), (F.col("kind") == "revisit").alias("again"), full.alias("full"),
        F.struct("ts", "id", "etag", "last_modified", "digest", F.coalesce("headers", empty).alias("headers")).alias("own"),
    ).where(f"ts is not null and (again and ({str(unkeyed).lower()} or url_key is not null) or full and url_key is not null)")
    cut = rows.withColumn("block", time_block(records))
    # Within a block; the frame ends before the record's own ts.
    w = Window.partitionBy("url_key", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.max(F.when(F.col("full"), F.col("own"))).over(w)).where("again")
    # Between blocks: the last response of each block, carried to the blocks after it.
    ends = cut.groupBy("url_key", "block").agg(F.max(F.when(F.col("full"), F.col("own"))).alias("end"))
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    met = near.join(carried.select("url_key", "block", "far").where("far is not null"), ["url_key", "block"], "left").withColumn("target", F.coalesce("near", "far"))

    def agree(name: str) -> Column:
        a, b = F.col(f"own.{name}"), F.col(f"target.{name}")
        if name == "etag":
            a, b = F.regexp_replace(a, "^W/", ""), F.regexp_replace(b, "^W/", "")
        return a == b

    said = F.coalesce(agree("etag"), agree("last_modified"), agree("digest"))
    outcome = F.when(F.col("target").isNull(), "no_response").when(said.isNull(), "unchecked").when(said, "validated").otherwise("mismatch")
    out = met.select("id", "url_key", "ts", F.col("target.id").alias("target_id"), F.col("target.ts").alias("target_ts"), outcome.alias("outcome"), "own", "target")
    return out.withColumn("headers", F.when(F.col("outcome").isin("validated", "unchecked"), merged(F.col("target.headers"), F.col("own.headers")))).drop("own", "target")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records that stand for the pages: a response when a page was fetched, and a not-modified revisit some time later.

    A page's time is its id in minutes. Of every seven revisits one brings an entity tag of other content, one only a
    last-modified date, and one no validator at all.
    """
    tag, at, k = F.md5(F.col("html").cast("binary")), F.col("page_id") * 60, F.pmod(F.col("page_id"), F.lit(7))
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    full = pages.select(
        (F.col("page_id") * 2).alias("id"), at.alias("ts"), F.lit("response").alias("kind"), "url", tag.alias("etag"), at.cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.array(head("Content-Type", F.lit("text/html")), head("Content-Length", F.octet_length("html")), head("ETag", tag), head("Date", at), head("Expires", at + 3600)).alias("headers"),
    )
    later = at + 90 + F.pmod(F.col("page_id"), F.lit(11)) * 3600
    etag = F.when(k == 3, F.md5(F.lit("other").cast("binary"))).when(k.isin(4, 5), F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("id"), later.alias("ts"), F.lit("revisit").alias("kind"), "url", etag.alias("etag"), F.when(k != 5, at.cast("string")).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.array(head("date", later), head("Content-Length", F.lit(0)), head("Cache-Control", F.lit("max-age=60")), head("Set-Cookie", k)).alias("headers"),
    )
    return full.union(again)


def resolved_pages(pages: DataFrame) -> DataFrame:
    """The query's rows: one per revisit of a page, headers as text."""
    got = resolve(records_of_pages(pages), unkeyed=True)
    return got.select("id", "url_key", "ts", "target_id", "target_ts", "outcome", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("headers"))


#: The query's rows in DuckDB, by a join of each revisit with all earlier responses of its URL.
ORACLE = r"""
WITH bare AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
keyed AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^(www|m)[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index[.]html?$', ''), '[.]html?$', ''), '/+$', '') AS front,
  list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))) AS q FROM bare),
p AS (SELECT page_id, md5(html) AS tag, octet_length(encode(html)) AS size, page_id * 60 AS fetched, page_id % 7 AS k, front || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM keyed),
r AS (SELECT *, fetched + 90 + (page_id % 11) * 3600 AS later, CASE WHEN k = 3 THEN md5('other') WHEN k IN (4, 5) THEN NULL ELSE tag END AS etag, CASE WHEN k <> 5 THEN CAST(fetched AS VARCHAR) END AS modified FROM p),
best AS (SELECT r.page_id, max(struct_pack(ts := f.fetched, id := f.page_id)) AS b FROM r JOIN p AS f ON f.url_key = r.url_key AND f.fetched < r.later GROUP BY r.page_id),
met AS (SELECT r.*, f.page_id AS target, f.fetched AS target_at, f.tag AS ftag, f.size AS fsize,
  CASE WHEN f.page_id IS NULL THEN 'no_response' WHEN r.etag IS NOT NULL THEN (CASE WHEN r.etag = f.tag THEN 'validated' ELSE 'mismatch' END)
       WHEN r.modified IS NOT NULL THEN (CASE WHEN r.modified = CAST(f.fetched AS VARCHAR) THEN 'validated' ELSE 'mismatch' END) ELSE 'unchecked' END AS outcome
  FROM r LEFT JOIN best ON best.page_id = r.page_id LEFT JOIN p AS f ON f.page_id = best.b.id)
SELECT page_id * 2 + 1 AS id, url_key, later AS ts, target * 2 AS target_id, target_at AS target_ts, outcome,
  CASE WHEN outcome IN ('validated', 'unchecked') THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || fsize || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || later
    || chr(10) || 'etag: ' || ftag || chr(10) || 'expires: ' || (target_at + 3600) END AS headers
FROM met"""
