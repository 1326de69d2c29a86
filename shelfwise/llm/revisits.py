"""Not-modified revisits: each gets the latest earlier full response to its canonical url.

The as-of join runs on points, the different (url, time) pairs of responses and revisits: points are cut into blocks of time at
quantiles over all records, a window looks back within (url, block), and the last response of each block is carried to the
blocks behind it. A url with a third of all records is thus spread over the blocks, and a moment with
any number of revisits is one point.

A revisit is ``resolved`` if a validator agrees (ETag by weak comparison, else Last-Modified), ``mismatch`` if the one that both have
doesn't, ``unverified`` if they have none in common, and ``orphan`` without an earlier response. Resolved revisits get the
response's headers, updated by those that a 304 may carry (RFC 9110, 15.4.5) and HTTP's other metadata of the stored response;
all other headers of the revisit are left out.

Defined results: a null url or time makes a revisit an orphan and a response useless; responses of one url and moment: the one
of the greatest record id; repeated records count each; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.shared import fewer_files, partitions, staged

#: Header fields of a 304 that update the stored response's.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and a closing slash; host in lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(url, "(?s)^[^:/?#]*://", ""), "(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.filter(F.split(F.regexp_extract(rest, "(?s)\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def weak_tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id long, kind string (response or revisit), url string, ts timestamp, headers map<string,string> with keys in lower case.

    Returns record_id, canonical_url, ts, response_id, status, headers of each revisit."""
    spark = records.sparkSession
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "ts", "headers")
    whole = rows.where("canonical_url is not null and ts is not null")
    blocks = partitions(spark)
    edges = whole.agg(F.percentile_approx(F.unix_micros("ts"), [k / blocks for k in range(1, blocks)], 10_000) if blocks > 1 else F.array().cast("array<bigint>")).first()[0] or []
    edges = F.array(*[F.lit(int(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<bigint>")

    points = whole.groupBy("canonical_url", "ts").agg(F.max(F.when(F.col("kind") == "response", F.col("record_id"))).alias("own"))
    points = points.withColumn("block", F.size(F.filter(edges, lambda e: e < F.unix_micros("ts"))))
    points = staged(fewer_files(points), "points")
    last = points.where("own is not null").groupBy("canonical_url", "block").agg(F.max_by("own", "ts").alias("last"))
    every = points.select("canonical_url", "block").distinct().join(last, ["canonical_url", "block"], "left")
    carried = every.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    back = Window.partitionBy("canonical_url", "block").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    before = points.withColumn("near", F.last("own", ignorenulls=True).over(back)).join(carried, ["canonical_url", "block"])
    before = before.select("canonical_url", "ts", F.coalesce("near", "carried").alias("response_id")).where("response_id is not null")

    revisits = rows.where("kind = 'revisit'").join(before, ["canonical_url", "ts"], "left")
    stored = rows.where("kind = 'response'").groupBy(F.col("record_id").alias("response_id")).agg(F.first("headers").alias("stored"))
    stored = staged(fewer_files(stored), "responses")  # so that the join can split a response with very many revisits
    joined = revisits.join(stored, "response_id", "left")
    own, old = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce("stored", F.create_map().cast("map<string,string>"))
    tags = (weak_tag(F.element_at(own, "etag")), weak_tag(F.element_at(old, "etag")))
    dates = (F.element_at(own, "last-modified"), F.element_at(old, "last-modified"))
    agrees = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    status = F.when(F.col("response_id").isNull(), "orphan").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    allowed = F.map_filter(own, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return joined.select("record_id", "canonical_url", "ts", "response_id", status.alias("status"), F.when(status == "resolved", merged).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """WARC-like records of pages: the response at first capture, and a later revisit whose validators depend on the page's number.

    Page 13 of each 13 has its revisit only; the ETag of 7 of each 49 differs, that of 3 of each 9 is weak; 11 of each 121 revisits have no validators."""
    p = F.pmod("page_id", F.lit(13))
    moment = lambda s: F.timestamp_seconds(F.lit(1_600_000_000) + s)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    date = F.date_format(moment(F.col("page_id") * 40), "yyyy-MM-dd HH:mm:ss")
    size = F.coalesce(F.length("html"), F.lit(0)).cast("string")
    response = pages.where(p != 12).select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", moment(F.col("page_id") * 60).alias("ts"),
        F.create_map(*[F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), size, F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("last-modified"), date]).alias("headers"),
    )
    changed = F.when(F.pmod("page_id", F.lit(7)) == 0, F.lit('"changed"')).when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    bare = F.pmod("page_id", F.lit(11)) == 0
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", moment(F.col("page_id") * 60 + 90_000).alias("ts"),
        F.map_filter(
            F.create_map(*[F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.date_format(moment(F.col("page_id") * 60 + 90_000), "yyyy-MM-dd HH:mm:ss"), F.lit("etag"), F.when(~bare, changed), F.lit("server"), F.lit("edge")]),
            lambda k, v: v.isNotNull(),
        ).alias("headers"),
    )
    return response.unionByName(revisit)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return done.select("record_id", "canonical_url", F.unix_seconds("ts").alias("seconds"), "response_id", "status", flat.alias("headers"))


_CANONICAL = r"""
  SELECT *, CASE WHEN len(params) > 0 THEN host || path || '?' || array_to_string(params, '&') ELSE host || path END AS canonical_url FROM (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
      regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
      list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS params
    FROM (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[^:/?#]*://', ''), '#.*$', '') AS rest FROM pages))
"""

ORACLE = f"""
WITH p AS ({_CANONICAL}),
r AS (SELECT page_id * 2 AS id, canonical_url, page_id * 60 AS seconds, '"' || md5(coalesce(html, '')) || '"' AS etag, page_id, length(coalesce(html, '')) AS size FROM p WHERE page_id % 13 <> 12),
v AS (SELECT page_id * 2 + 1 AS id, canonical_url, page_id * 60 + 90000 AS seconds, page_id, page_id % 11 = 0 AS bare,
  CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 3 = 0 THEN 'W/"' || md5(coalesce(html, '')) || '"' ELSE '"' || md5(coalesce(html, '')) || '"' END AS etag FROM p),
j AS (SELECT v.*, r.id AS response_id, r.etag AS old, r.page_id AS of_page, r.size FROM v LEFT JOIN r ON v.canonical_url = r.canonical_url AND r.seconds < v.seconds
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY r.seconds DESC NULLS LAST, r.id DESC) = 1),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN bare THEN 'unverified' WHEN regexp_replace(etag, '^W/', '') = old THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT id AS record_id, canonical_url, 1600000000 + seconds AS seconds, response_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: '
    || strftime(make_timestamp((1600000000 + seconds) * 1000000), '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || etag || chr(10) || 'last-modified: '
    || strftime(make_timestamp((1600000000 + of_page * 40) * 1000000), '%Y-%m-%d %H:%M:%S') END AS headers
FROM s
"""
