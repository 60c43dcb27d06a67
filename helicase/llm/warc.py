"""WARC records: reading files, and resolving not-modified revisits to the response they repeat.

A revisit record (a server's 304) has no body. It is resolved by an as-of join: the latest full response of the same
canonical URL before it. The revisit's validators (ETag, else Last-Modified) must not contradict the response's; then
the response's headers are merged with those that a 304 may update.

The as-of join has two levels, so that a URL with a third of all captures is no single task. Captures of a URL at one
time are reduced to one row, the response that counts, before they are exchanged. A URL's times are cut into slices;
within a slice a window over its times finds the last response, and a window over one row per slice hands the last
response of earlier slices on. With dates in whole seconds, as in WARC, a slice of an hour has 3,600 rows at most.

Reading goes on where a file is damaged: a line that begins no record is passed over, a block's length that is no number
counts as none, and a file that breaks off ends with its last whole record. Headers that repeat are joined by a comma.
A file is read by one task, compressed as it is, up to 2 GB; larger ones have to be cut at record boundaries before.

Defined cases: a null URL is canonical to null and matches nothing; a null time is never resolved and resolves
nothing; of responses at one time the one with the largest record id counts, and a response at the revisit's own time
is not earlier; a revisit without validators is resolved unchecked; missing headers count as none. Repeated rows keep
a row each. An empty table gives an empty table.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from helicase.llm import _common as c

#: Headers that a not-modified answer may update (RFC 9110, 15.4.5, and freshness).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "set-cookie")
SLICE_SECONDS = 3600

RECORDS = "record_id string, type string, url string, ts timestamp, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, default ports, fragment and trailing slashes removed, query arguments sorted without tracking ones."""
    part = lambda k: F.regexp_extract(url, r"(?s)^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"^.*@", ""), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.coalesce(part(2), F.lit("")), r"/+$", "")
    args = F.array_sort(F.filter(F.split(F.coalesce(part(3), F.lit("")), "&"), lambda a: (a != "") & ~a.rlike(r"^(utm_\w+|fbclid|gclid|ref)(=|$)")))
    query = F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise("")
    return F.when(url.isNotNull() & (host != ""), F.concat(host, path, query))


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(WARC headers in lower case, block) of every record."""
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while (line := stream.readline()).strip():
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            size = head.get("content-length", "0")
            size = int(size) if size.isascii() and size.isdigit() else 0
            block = stream.read(size)
            if len(block) < size:
                return
            yield head, block
    except (EOFError, OSError, zlib.error):  # the compressed file breaks off
        return


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields in lower case; values of repeated ones in order, joined by a comma."""
    out: dict[str, str] = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if colon:
            k = k.strip().lower()
            out[k] = f"{out[k]}, {v.strip()}" if k in out else v.strip()
    return out


def parse_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers in lower case and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("iso-8859-1").split("\r\n")
    words = first.split(" ")
    status = int(words[1]) if first.startswith("HTTP/") and len(words) > 1 and words[1].isdigit() else None
    return status, _fields(lines), body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of the WARC files at path, plain or gzipped; one row per response, resource or revisit."""

    def run(tables):
        for b in tables:
            for content in b.column(0).to_pylist():
                plain = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows = []
                for head, block in _records(plain):
                    kind = head.get("warc-type", "")
                    if kind in ("response", "revisit", "resource"):
                        status, fields, body = parse_http(block) if kind != "resource" else (200, {"content-type": head.get("content-type", "")}, block)
                        rows.append((head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), status, list(fields.items()), body))
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    raw = c.ship(spark.read.format("binaryFile").load(path)).select("content")
    text = raw.mapInArrow(run, RECORDS.replace("ts timestamp", "ts string"))
    return text.withColumn("ts", F.try_to_timestamp("ts"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "type", "url", "ts", "status", "headers", "body"])


def write_record(kind: str, url: str, date: str, record_id: str, block: bytes) -> bytes:
    """One uncompressed WARC record."""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nWARC-Record-ID: {record_id}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _is_full(kind: Column, status: Column) -> Column:
    return kind.isin("response", "resource") & (F.coalesce(status, F.lit(200)) == 200)


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Rows (record_id, url, canonical_url, ts, resolved_id, outcome, status, headers) of every revisit in records (as RECORDS, without need for a body).

    outcome: resolved; no-earlier-response; validator-mismatch. Unresolved ones keep their own status and headers.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    r = records.select(
        "record_id", "url", "ts", "status",
        F.coalesce("headers", none).alias("headers"),
        canonical_url(F.col("url")).alias("canonical_url"),
        _is_full(F.col("type"), F.col("status")).alias("full"),
        ((F.col("type") == "revisit") | (F.coalesce(F.col("status"), F.lit(0)) == 304)).alias("revisit"),
    ).where("full OR revisit")
    loose = r.where("revisit AND (canonical_url IS NULL OR ts IS NULL)")
    r = r.where("canonical_url IS NOT NULL AND ts IS NOT NULL").withColumn("slice", F.floor(F.unix_timestamp("ts") / slice_seconds))
    r = r.withColumn("t", F.unix_micros("ts"))
    response = F.when(F.col("full"), F.struct("ts", "record_id", "status", "headers"))
    # a row for each time of a URL; of responses at one time that of the largest record id
    times = r.groupBy("canonical_url", "slice", "t").agg(F.max_by(response, F.when(F.col("full"), F.col("record_id"))).alias("resp"))
    in_slice = W.partitionBy("canonical_url", "slice").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    times = times.withColumn("near", F.last("resp", ignorenulls=True).over(in_slice))
    slices = times.groupBy("canonical_url", "slice").agg(F.max_by("resp", F.when(F.col("resp").isNotNull(), F.col("t"))).alias("last"))
    carried = slices.select(
        "canonical_url", "slice", F.last("last", ignorenulls=True).over(W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("carried")
    )
    based = times.join(carried, ["canonical_url", "slice"]).select("canonical_url", "t", F.coalesce("near", "carried").alias("base"))
    found = r.where("revisit").join(based, ["canonical_url", "t"], "left").drop("t", "slice")
    found = found.unionByName(loose.withColumn("base", F.lit(None).cast(found.schema["base"].dataType)))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    h, bh = F.col("headers"), F.col("base.headers")
    etag, base_etag = weak(get(h, "etag")), weak(get(bh, "etag"))
    date, base_date = get(h, "last-modified"), get(bh, "last-modified")
    differs = F.when(etag.isNotNull() & base_etag.isNotNull(), etag != base_etag).when(date.isNotNull() & base_date.isNotNull(), date != base_date).otherwise(F.lit(False))
    outcome = F.when(F.col("base").isNull(), "no-earlier-response").when(differs, "validator-mismatch").otherwise("resolved")
    update = F.map_filter(h, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(bh, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    ok = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", "url", "canonical_url", "ts", F.when(ok, F.col("base.record_id")).alias("resolved_id"), "outcome",
        F.when(ok, F.col("base.status")).otherwise(F.col("status")).alias("status"), F.when(ok, merged).otherwise(h).alias("headers"),
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """RECORDS of a crawl of the pages: each page is fetched in full at minute page_id, and asked for again, with its
    ETag, a day later, when the server answers not-modified."""
    at = lambda minutes: F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) * 60 + 1_700_000_000 + minutes * 60)
    etag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    full = pages.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"), F.lit("response").alias("type"), "url", at(0).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), at(0).cast("string"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string")).alias("headers"),
    )
    again = pages.select(
        F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("record_id"), F.lit("revisit").alias("type"), "url", at(1440).alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("date"), at(1440).cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return full.unionByName(again)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's not-modified capture, resolved."""
    d = resolve_revisits(capture_log(c.table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    get = lambda k: F.try_element_at("headers", F.lit(k))
    return d.select(
        F.substring("record_id", 2, 20).cast("long").alias("page_id"), "canonical_url", F.substring("resolved_id", 2, 20).cast("long").alias("resolved_page"),
        "outcome", "status", get("etag").alias("etag"), get("content-length").cast("long").alias("content_length"), get("date").alias("date"),
    )


OP8_SQL = r"""
WITH u AS (SELECT page_id, url, html, regexp_extract(url, '(?s)^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['h', 'p', 'q']) AS x FROM pages),
v AS (SELECT page_id, regexp_replace(regexp_replace(lower(x.h), '^.*@', ''), '^www\.|:(80|443)$', '', 'g') AS host, regexp_replace(x.p, '/+$', '') AS path,
             list_sort(list_filter(string_split(x.q, '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_\w+|fbclid|gclid|ref)(=|$)'))) AS args,
             '"' || md5(coalesce(html, '')) || '"' AS etag, strlen(coalesce(html, '')) AS size,
             to_timestamp(page_id * 60 + 1700000000) AT TIME ZONE 'UTC' AS at, to_timestamp(page_id * 60 + 1700000000 + 86400) AT TIME ZONE 'UTC' AS again FROM u),
w AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical_url FROM v),
b AS (SELECT n.page_id, n.canonical_url, n.etag AS mine, n.again, r.page_id AS base, r.etag, r.size
      FROM w n ASOF LEFT JOIN w r ON n.canonical_url = r.canonical_url AND r.at < n.again)
SELECT page_id, canonical_url, CASE WHEN mine = etag THEN base END AS resolved_page,
       CASE WHEN base IS NULL THEN 'no-earlier-response' WHEN mine <> etag THEN 'validator-mismatch' ELSE 'resolved' END AS outcome,
       CASE WHEN mine = etag THEN 200 ELSE 304 END::INTEGER AS status, mine AS etag, CASE WHEN mine = etag THEN size ELSE 0 END::BIGINT AS content_length,
       strftime(again, '%Y-%m-%d %H:%M:%S') AS date
FROM b
"""
