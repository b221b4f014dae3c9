"""Not-modified revisits of web captures: an as-of join by canonical URL to the latest earlier full response.

A revisit whose server said "not modified" has no body. It stands for the latest full response to the same canonical
URL that was captured strictly before it, if the validators agree: the entity tag, compared weakly, where the revisit
has one, else the modification date. Then its headers update the response's, but for those that describe the body or
the connection.

Scale: only URLs, times and ids take part in the join; headers are never read for it. Captures are dealt in ranges of
time, those of one URL at one time are one point (the response with the greatest id); each (URL, range) keeps its latest
response, a window over these carries it into later ranges, and another over a range's points finishes. So a URL with a
third of all captures is spread over all ranges. Headers come back by record id, to revisits that have a response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.llm.common import cut

#: Headers of a not-modified answer that don't replace the stored response's (RFC 9110 and 9111).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without user, default port or fragment; an empty path is /. Null where there is no ://."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1), r"(?s)^[^/?@]*@", "")
    port = F.when(scheme == "http", F.lit(":80")).when(scheme == "https", F.lit(":443")).otherwise(F.lit(":"))
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    host = F.when(F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    path = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    path = F.when(path == "", F.lit("/")).when(F.startswith(path, F.lit("?")), F.concat(F.lit("/"), path)).otherwise(path)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path))


def _headers(headers: Column) -> Column:
    """Entries with names in lower case; of equal names the last stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.coalesce(last, F.expr("cast(array() as array<struct<key:string,value:string>>)"))


def _value(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(1))["value"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """From record_id (string), kind ('response' or 'revisit'), url, ts (a number) and headers (map of strings), for each revisit:
    record_id, canonical_url, ts, response_id, response_ts, outcome, headers (a map with names in lower case).

    outcome is 'resolved'; 'changed' (the latest earlier response has other validators, whose ids stay in response_id);
    'unverified' (the revisit has no validator, or the response lacks the one it names); or 'no_response' (none is
    earlier, or url or ts is null or no URL). headers are merged only where resolved, else they are the revisit's own.
    Responses with a null url, ts or id never match; of several at one time the greatest id counts. A revisit that
    repeats gives a row each. Other kinds and columns are ignored; record ids of responses should be unique.
    """
    rows = records.select(F.col("record_id").cast("string").alias("record_id"), "kind", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("double").alias("ts"), "headers")
    response = (F.col("kind") == "response") & F.col("record_id").isNotNull()
    revisits = rows.where("kind = 'revisit'").drop("kind")
    usable = rows.where("canonical_url is not null and ts is not null").where(response | (F.col("kind") == "revisit"))
    seen = usable.select("canonical_url", "ts", F.when(response, F.col("record_id")).alias("id"), (F.col("kind") == "revisit").alias("revisit")).repartitionByRange("ts")
    points = seen.groupBy("canonical_url", "ts").agg(F.max("id").alias("response_id"), F.max("revisit").alias("asked"))  # in the ranges' own partitions
    points = cut(points.withColumn("bucket", F.spark_partition_id()))
    found = F.when(F.col("response_id").isNotNull(), F.struct(F.col("ts").alias("response_ts"), "response_id"))
    carried = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = points.groupBy("canonical_url", "bucket").agg(F.max(found).alias("latest")).select("canonical_url", "bucket", F.max("latest").over(carried).alias("carried"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    latest = points.select("canonical_url", "ts", "bucket", "asked", F.max(found).over(inside).alias("inside")).where("asked")
    asof = latest.join(ahead, ["canonical_url", "bucket"]).select("canonical_url", "ts", F.coalesce("inside", "carried").alias("latest")).where("latest is not null").select("canonical_url", "ts", "latest.*")
    stored = rows.where(response).select(F.col("record_id").alias("stored_id"), F.col("headers").alias("stored"))
    placed = revisits.join(asof, ["canonical_url", "ts"], "left")
    sought = F.coalesce("response_id", F.concat(F.lit("\0"), F.coalesce("record_id", F.lit(""))))  # so that those without a response don't meet in one task
    joined = placed.withColumn("sought", sought).join(stored, F.col("sought") == F.col("stored_id"), "left")
    entries = joined.withColumns({"own": _headers(F.col("headers")), "old": _headers(F.col("stored"))})
    own, old = F.col("own"), F.col("old")
    bare = lambda x: F.regexp_replace(F.trim(x), "^W/", "")
    tag, date = _value(own, "etag"), _value(own, "last-modified")
    same = F.when(tag.isNotNull(), bare(tag) == bare(_value(old, "etag"))).when(date.isNotNull(), F.trim(date) == F.trim(_value(old, "last-modified")))
    outcome = F.when(F.col("response_id").isNull(), "no_response").when(same, "resolved").when(same.isNull(), "unverified").otherwise("changed")
    updates = F.filter(own, lambda e: ~e["key"].isin(*KEPT_HEADERS))
    merged = F.concat(F.filter(old, lambda e: ~F.exists(updates, lambda u: u["key"] == e["key"])), updates)
    return entries.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", "response_id", "response_ts", "outcome", F.map_from_entries(F.when(F.col("outcome") == "resolved", merged).otherwise(own)).alias("headers")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records that follow from pages: a full response of each, a later one of every third, and three revisits.

    Times are hours spread by page_id; entity tags are checksums of the html; revisits vary their URL's form, come
    before or after the responses, and name the tag, an old tag, the date or nothing, by remainders of page_id.
    """
    p, url, tag, size, hours, k = (F.col(c) for c in ("page_id", "url", "tag", "size", "hours", "k"))
    tags = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    text = lambda x: x.cast("string")
    some = F.when(p % 3 == 0, F.array(*map(F.lit, range(5)))).otherwise(F.array(*map(F.lit, (0, 2, 3, 4))))
    rows = pages.select("page_id", "url", tags.alias("tag"), text(F.length(F.coalesce("html", F.lit("")))).alias("size"), ((p * 7919) % 1000 * 3600.0).alias("hours"), F.explode(some).alias("k"))
    h = lambda **x: F.map_from_arrays(F.array(*[F.lit(n.replace("_", "-")) for n in x]), F.array(*x.values()))
    case = lambda *x: F.when(k == 0, x[0]).when(k == 1, x[1]).when(k == 2, x[2]).when(k == 3, x[3]).otherwise(x[4])
    lit = F.lit
    headers = case(
        h(ETag=tag, Last_Modified=text(hours), Content_Length=size, Server=lit("a")),
        h(ETag=F.concat(tag, lit("2")), Last_Modified=text(hours + 7200.0), Content_Length=size, Server=lit("a")),
        h(etag=F.concat(lit("W/"), tag), Server=lit("b"), Content_Length=lit("0")),
        F.when(p % 2 == 0, h(ETag=tag, Date=lit("d"))).otherwise(h(Last_Modified=text(hours), Date=lit("d"))),
        F.when(p % 5 == 0, h(Date=lit("e"))).otherwise(h(ETag=tag)),
    )
    return rows.select(
        text(p * 10 + k).alias("record_id"),
        F.when(k < 2, "response").otherwise("revisit").alias("kind"),
        F.when(k == 2, F.concat(url, lit("#x"))).otherwise(url).alias("url"),
        (hours + case(lit(0.0), lit(7200.0), lit(3600.0), lit(9000.0), p % 2 * 120.0 - 60.0)).alias("ts"),
        headers.alias("headers"),
    )


SQL = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, CAST((page_id * 7919) % 1000 * 3600 AS DOUBLE) AS hours, CAST(length(coalesce(html, '')) AS VARCHAR) AS size FROM pages
),
canon AS (
  SELECT *, lower(regexp_extract(url, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         regexp_replace(regexp_extract(url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1), '(?s)^[^/?@]*@', '') AS rest FROM p
),
split AS (
  SELECT *, lower(regexp_extract(rest, '(?s)^([^/?]*)', 1)) AS host, regexp_extract(rest, '(?s)^[^/?]*(.*)$', 1) AS path FROM canon
),
u AS (
  SELECT page_id, tag, hours, size,
         CASE WHEN scheme <> '' THEN scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE regexp_replace(host, ':$', '') END
              || CASE WHEN path = '' THEN '/' WHEN starts_with(path, '?') THEN '/' || path ELSE path END END AS canonical_url
  FROM split
),
responses AS (
  SELECT CAST(page_id * 10 AS VARCHAR) AS response_id, canonical_url, hours AS response_ts, tag AS etag, hours AS modified, size FROM u
  UNION ALL SELECT CAST(page_id * 10 + 1 AS VARCHAR), canonical_url, hours + 7200, tag || '2', hours + 7200, size FROM u WHERE page_id % 3 = 0
),
points AS (SELECT canonical_url, response_ts, max(response_id) AS response_id FROM responses WHERE canonical_url IS NOT NULL GROUP BY ALL),
revisits AS (
  SELECT CAST(page_id * 10 + 2 AS VARCHAR) AS record_id, canonical_url, hours + 3600 AS ts, tag AS etag, 'W/' || tag AS sent, NULL::DOUBLE AS modified, 'b' AS server, '0' AS length, NULL AS date FROM u
  UNION ALL SELECT CAST(page_id * 10 + 3 AS VARCHAR), canonical_url, hours + 9000, CASE WHEN page_id % 2 = 0 THEN tag END, CASE WHEN page_id % 2 = 0 THEN tag END, CASE WHEN page_id % 2 = 1 THEN hours END, NULL, NULL, 'd' FROM u
  UNION ALL SELECT CAST(page_id * 10 + 4 AS VARCHAR), canonical_url, hours - 60 + page_id % 2 * 120, CASE WHEN page_id % 5 <> 0 THEN tag END, CASE WHEN page_id % 5 <> 0 THEN tag END, NULL, NULL, NULL, CASE WHEN page_id % 5 = 0 THEN 'e' END FROM u
),
matched AS (
  SELECT r.*, q.response_id, q.response_ts FROM revisits r ASOF LEFT JOIN points q ON r.canonical_url = q.canonical_url AND r.ts > q.response_ts
),
judged AS (
  SELECT a.*, s.etag AS old_etag, s.modified AS old_modified, s.size,
         CASE WHEN a.response_id IS NULL THEN 'no_response'
              WHEN a.etag IS NOT NULL THEN CASE WHEN a.etag = s.etag THEN 'resolved' ELSE 'changed' END
              WHEN a.modified IS NOT NULL THEN CASE WHEN a.modified = s.modified THEN 'resolved' ELSE 'changed' END
              ELSE 'unverified' END AS outcome
  FROM matched a LEFT JOIN responses s USING (response_id)
)
SELECT record_id, canonical_url, ts, response_id, response_ts, outcome,
       CASE WHEN outcome = 'resolved' THEN 'content-length=' || size || coalesce(' date=' || date, '') || ' etag=' || coalesce(sent, old_etag) || ' server=' || coalesce(server, 'a')
            ELSE ltrim(coalesce('content-length=' || length, '') || coalesce(' date=' || date, '') || coalesce(' etag=' || sent, '') || coalesce(' server=' || server, '')) END AS header_line
FROM judged
"""
