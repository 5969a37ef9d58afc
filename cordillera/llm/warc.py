"""WARC revisits: records that say "not modified" get the response they stand for.

An as-of join in two levels. Records are dealt by canonical URL and span of time; within one deal a window finds the latest
earlier full response, and what a deal lacks comes from the latest response of the URL's earlier spans, a row for each span.
So a URL with a third of all records is spread over its spans. Only identifiers, times and validators take part; bodies and
headers are joined by record at the end.

A match holds if the validators agree: entity tags if both have one (weakly compared), else the last-modified times, else
the payload digests. Of the revisit's headers, those that a not-modified answer may update replace the response's.

Revisits of one response are dealt in shares, and those without one by their own ids.

Defined cases: a null URL or time matches nothing; among responses of one time the largest record id counts, and a response
of the revisit's own time isn't earlier; of rows that repeat a record id as revisits, or as responses, the one with the least
hash of its URL, time and validators counts; header names are compared without regard to case, and of a revisit's own
repeated names the last one counts; a revisit without validators on either side is `unverified`; a null or empty body is
passed on as it is, a very long one is never split; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import hot_keys, salted_join, staged

#: Names of the headers that a not-modified answer updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters and a trailing slash go; the host is in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host, rest = F.regexp_extract(bare, r"^([^/?]*)", 1), F.regexp_replace(bare, r"^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, rf"([?&]){TRACKING}=[^&]*", "$1"), r"&&+", "&")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\?&", "?"), r"[?&]+$", ""), r"/$", "")
    return F.concat(host, rest)


def as_of(records: DataFrame, span: int) -> DataFrame:
    """(record_id, url_key, ts, full) -> record_id of every revisit with found, the id of the latest earlier full record."""
    rows = records.where("url_key is not null and ts is not null").select("record_id", "url_key", "ts", "full", F.floor(F.col("ts") / span).alias("span"))
    last = F.max(F.when(F.col("full"), F.struct("ts", "record_id")))
    here = last.over(Window.partitionBy("url_key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumn("here", here["record_id"]).where("not full").select("record_id", "url_key", "span", "here")
    spans = rows.groupBy("url_key", "span").agg(last.alias("last"))  # combined before the shuffle
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("url_key", "span", carried["record_id"].alias("earlier"))
    return inside.join(spans, ["url_key", "span"]).select("record_id", F.coalesce("here", "earlier").alias("found"))


def resolve(records: DataFrame, span: int = 1 << 16) -> DataFrame:
    """records: record_id, url, ts (long), full (boolean), etag, last_modified, digest, headers (map), body -> a row for each
    revisit: record_id, url_key, found, status, headers, body (null unless the validators agree)."""
    validators = ("etag", "last_modified", "digest")
    keyed = records.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", "full", *validators, "headers", "body").where("record_id is not null")
    order = F.xxhash64("url_key", "ts", *validators)
    if keyed.groupBy("record_id", "full").count().where("count > 1").limit(1).count():
        keyed = staged(keyed.groupBy("record_id", "full").agg(F.min_by(F.struct(*[c for c in keyed.columns if c not in ("record_id", "full")]), order).alias("r")).select("record_id", "full", "r.*"))
    matched = staged(as_of(keyed, span))
    asked = keyed.where("not full").select("record_id", "url_key", *[F.col(c).alias(f"r_{c}") for c in (*validators, "headers")])
    stored = keyed.where("full").select(F.col("record_id").alias("found"), *validators, "headers", "body")
    hot = hot_keys(matched, ["found"])
    both = salted_join(asked.join(matched.where("found is not null"), "record_id"), stored, ["found"], ["record_id"], "left", hot)
    lost = asked.join(matched.where("found is not null"), "record_id", "left_anti")
    both = both.unionByName(lost, allowMissingColumns=True)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    agree = F.coalesce(weak(F.col("etag")) == weak(F.col("r_etag")), F.col("last_modified") == F.col("r_last_modified"), F.col("digest") == F.col("r_digest"))
    status = F.when(F.col("found").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("changed")
    none = F.create_map().cast("map<string,string>")
    named = F.filter(F.map_entries(F.coalesce("r_headers", none)), lambda e: F.lower(e["key"]).isin(*PERMITTED))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda x: F.lower(x["key"]) == F.lower(e["key"])))
    allowed = F.map_from_entries(last)
    kept = F.map_filter(F.coalesce("headers", none), lambda k, v: ~F.exists(last, lambda e: F.lower(e["key"]) == F.lower(k)))
    merged = F.map_concat(kept, allowed)
    done = both.withColumn("status", status)
    return done.select("record_id", "url_key", "found", "status", *[F.when(F.col("status") == "resolved", x).alias(n) for n, x in (("headers", merged), ("body", F.col("body")))])


def crawls(pages: DataFrame) -> DataFrame:
    """Records of two crawls of pages: at time page_id the page itself in full; 2**20 later a revisit of its URL, whose entity
    tag is the page's, or another where the tag begins with c to f, and whose headers hold a date, an expiry and a length."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    full = pages.select(F.col("page_id").cast("long").alias("record_id"), "url", F.col("page_id").cast("long").alias("ts"), F.lit(True).alias("full"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.create_map(F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string")).alias("headers"), F.col("html").alias("body"))
    again = F.col("page_id").cast("long") + (1 << 20)
    other = F.when(tag.rlike("^[c-f]"), F.reverse(tag)).otherwise(tag)
    revisit = pages.select((-F.col("page_id").cast("long") - 1).alias("record_id"), "url", again.alias("ts"), F.lit(False).alias("full"), other.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), again.cast("string"), F.lit("expires"), (again + 60).cast("string")).alias("headers"), F.lit(None).cast("string").alias("body"))
    return full.unionByName(revisit)


def revisits_query(spark, sf_dir: str) -> DataFrame:
    done = resolve(crawls(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return done.select("record_id", "url_key", F.col("found").alias("response_id"), "status", F.array_join(entries, ";").alias("headers"), F.md5("body").alias("body_md5"))


REVISITS_SQL = r"""
with k as (select page_id, html, md5(coalesce(html, '')) as tag, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as bare from pages),
u as (select page_id, html, tag, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)$', '')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/$', '') as url_key from k),
r as (select -page_id - 1 as record_id, page_id + 1048576 as ts, url_key, case when regexp_matches(tag, '^[c-f]') then reverse(tag) else tag end as tag from u),
m as (select r.record_id, r.ts, r.url_key, r.tag, max(u.page_id) as response_id from r left join u on u.url_key = r.url_key and u.page_id < r.ts group by all),
s as (select m.record_id, m.ts, m.url_key, m.response_id, case when response_id is null then 'missing' when u.tag = m.tag then 'resolved' else 'changed' end as status, u.html from m left join u on u.page_id = m.response_id)
select record_id, url_key, response_id, status,
  case when status = 'resolved' then 'content-length=' || length(coalesce(html, '')) || ';content-type=text/html;date=' || ts || ';expires=' || (ts + 60) end as headers,
  case when status = 'resolved' then md5(html) end as body_md5 from s
"""
