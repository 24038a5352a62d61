"""WARC revisit records resolved to the responses they stand for.

A not-modified revisit belongs to the latest full response of its canonical URL
captured before it. Records are dealt out in ranges of (URL, time, id), so a URL
that holds a third of all captures is spread over many ranges; in each range a
window carries the last full response forward, and one row per range carries it
across range borders. Payloads do not move: a result names the record and digest
that hold the payload. A revisit resolves if its validators agree (ETags where
both have one, else Last-Modified), and its headers then override the stored
ones where a not-modified response may do so.

Defined results: a record without a URL or a time that can be read is
`unaddressed`, and such a response resolves nothing; a revisit with
no full response before it is `no-earlier-response`; one without any common
validator is `no-validator`; records of equal time are ordered by id; repeated
rows repeat; an empty table gives an empty table. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import materialise

#: Header fields that a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change what a URL names.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"

RECORD = "record_id string, kind string, url string, captured_at timestamp, http_status int, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Scheme, default port, fragment, tracking parameters and final slashes removed; host in lower case."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*(.*)$", 1), f"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&+", "&"), r"\?&", "?")
    return F.concat(host, F.regexp_replace(rest, "[/?&]+$", ""))


def _fields(block: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; a folded line continues the one before."""
    found: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parse_record(raw: bytes | None) -> dict:
    """One WARC record: its own fields, the HTTP status and headers, and the payload's digest."""
    head, _, block = (raw or b"").partition(b"\r\n\r\n")
    warc = _fields(head.partition(b"\r\n")[2])
    http, _, body = block.partition(b"\r\n\r\n")
    status_line, _, rest = http.partition(b"\r\n")
    headers = _fields(rest)
    code = status_line.split()[1:2]
    kind = warc.get("warc-type")
    return {
        "record_id": warc.get("warc-record-id"),
        "kind": kind,
        "url": warc.get("warc-target-uri"),
        "captured_at": warc.get("warc-date"),
        "http_status": int(code[0]) if code and code[0].isdigit() else None,
        "etag": headers.get("etag"),
        "last_modified": headers.get("last-modified"),
        "digest": "sha256:" + hashlib.sha256(body).hexdigest() if kind == "response" else warc.get("warc-payload-digest"),
        "headers": headers,
    }


def parse_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Records as columns, from one WARC record a row."""
    text = RECORD.replace("captured_at timestamp", "captured_at string")
    names = [x.split()[0] for x in text.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32()] + [pa.string()] * 3 + [pa.map_(pa.string(), pa.string())]
        for b in batches:
            rows = [parse_record(x) for x in b.column(0).to_pylist()]
            columns = [pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], kind) for n, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    parsed = raw.select(F.col(column).cast("binary").alias("raw")).mapInArrow(run, text)
    return parsed.withColumn("captured_at", F.try_to_timestamp("captured_at"))


def last_full_response(records: DataFrame) -> DataFrame:
    """records with `key` (canonical URL) and `source`: the latest full response before each record, or null."""
    full = (F.col("kind") == "response") & (F.col("http_status") == 200) & F.col("captured_at").isNotNull() & F.col("url").isNotNull()
    records = records.select(*[field.split()[0] for field in RECORD.split(", ")])
    keyed = records.withColumn("key", F.coalesce(canonical_url(F.col("url")), F.lit("")))
    own = F.when(full, F.struct("key", "record_id", "captured_at", "etag", "last_modified", "digest", "headers"))
    order = ["key", "captured_at", "record_id"]
    ranged = materialise(keyed.withColumn("_full", own).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part", "key").orderBy("captured_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: its last full response in order; the latest of all ranges before is handed on
    latest = ranged.groupBy("_part").agg(F.max_by("_full", F.when(full, F.struct(*order))).alias("_latest"))
    handed = latest.select("_part", F.last("_latest", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_handed"))
    carried = ranged.withColumn("_inside", F.last("_full", ignorenulls=True).over(before)).join(F.broadcast(handed), "_part")
    across = F.when(F.col("_handed.key") == F.col("key"), F.col("_handed"))
    return carried.withColumn("source", F.coalesce("_inside", across)).drop("_full", "_part", "_inside", "_handed")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, key, captured_at, status, refers_to, digest and the merged headers.

    Headers come out as `name: value` lines in order of name; unresolved revisits
    keep their own.
    """
    found = last_full_response(records).filter("kind = 'revisit'")
    s = F.col("source")
    etags, dates = F.col("etag").isNotNull() & s["etag"].isNotNull(), F.col("last_modified").isNotNull() & s["last_modified"].isNotNull()
    agree = F.when(etags, F.col("etag") == s["etag"]).when(dates, F.col("last_modified") == s["last_modified"])
    status = (
        F.when(F.col("url").isNull() | F.col("captured_at").isNull(), "unaddressed")
        .when(s.isNull(), "no-earlier-response")
        .when(agree.isNull(), "no-validator")
        .when(~agree | (F.col("digest") != s["digest"]), "validators-differ")
        .otherwise("resolved")
    )
    found = found.withColumn("status", status)
    hit = F.col("status") == "resolved"
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(s["headers"], lambda k, v: ~F.map_contains_key(fresh, k))
    merged = F.when(hit, F.map_concat(kept, fresh)).otherwise(F.col("headers"))
    lines = F.transform(F.array_sort(F.map_keys(merged)), lambda k: F.concat(k, F.lit(": "), F.element_at(merged, k)))
    return found.select(
        "record_id", F.col("key").alias("canonical_url"), "captured_at", "status", F.when(hit, s["record_id"]).alias("refers_to"), F.when(hit, s["digest"]).alias("digest"), F.array_join(lines, "\n").alias("headers")
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """raw: a crawl of the pages as WARC records, a response and a later revisit for each page.

    Every 7th revisit brings another ETag, every 11th none, and every 13th comes
    before its response.
    """
    i = F.col("page_id")
    stamp = lambda seconds: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    taken, week = i * 60, 7 * 86400
    again = F.when(i % 13 == 6, taken - week).otherwise(taken + week)
    etag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    etag2 = F.when(i % 7 == 3, F.lit('"changed"')).otherwise(etag)
    modified = F.concat(F.lit("day "), (i % 28).cast("string"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    head = lambda kind, mark, when: F.concat(line("WARC/1.1"), line("WARC-Type: ", F.lit(kind)), line("WARC-Record-ID: ", F.lit(mark), i.cast("string")), line("WARC-Target-URI: ", F.col("url")), line("WARC-Date: ", when), F.lit("\r\n"))
    response = F.concat(
        head("response", "r", stamp(taken)), line("HTTP/1.1 200 OK"), line("Content-Type: text/html"), line("Server: first"), line("Cache-Control: max-age=60"), line("ETag: ", etag), line("Last-Modified: ", modified), F.lit("\r\n"), F.col("html")
    )
    tag = F.when(i % 11 == 5, F.lit("")).otherwise(line("ETag: ", etag2))
    revisit = F.concat(head("revisit", "v", stamp(again)), line("HTTP/1.1 304 Not Modified"), line("Server: second"), line("Cache-Control: max-age=600"), tag, line("Last-Modified: ", modified), F.lit("\r\n"))
    return pages.filter("url IS NOT NULL AND html IS NOT NULL").select(F.explode(F.array(response, revisit)).alias("raw"))


#: DuckDB SQL of resolve_revisits over records_of_pages.
ORACLE = r"""
WITH u AS (
  SELECT page_id AS i, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages
  WHERE url IS NOT NULL AND html IS NOT NULL),
k AS (
  SELECT i, html, regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[/?&]+$', '') AS key FROM u),
r AS (SELECT key, 'r' || i AS id, 1700000000 + i * 60 AS t, '"' || md5(html) || '"' AS etag, 'day ' || (i % 28) AS lm, 'sha256:' || sha256(html) AS digest FROM k),
v AS (SELECT key, 'v' || i AS id, 1700000000 + i * 60 + CASE WHEN i % 13 = 6 THEN -604800 ELSE 604800 END AS t,
        CASE WHEN i % 11 = 5 THEN NULL WHEN i % 7 = 3 THEN '"changed"' ELSE '"' || md5(html) || '"' END AS etag, 'day ' || (i % 28) AS lm FROM k),
j AS (SELECT v.*, (SELECT max({'t': r.t, 'id': r.id, 'etag': r.etag, 'lm': r.lm, 'digest': r.digest}) FROM r WHERE r.key = v.key AND (r.t < v.t OR (r.t = v.t AND r.id < v.id))) AS s FROM v),
w AS (SELECT *, CASE WHEN s IS NULL THEN 'no-earlier-response' WHEN coalesce(etag = s.etag, lm = s.lm) THEN 'resolved' ELSE 'validators-differ' END AS status FROM j)
SELECT id AS record_id, key AS canonical_url, make_timestamp(t * 1000000) AS captured_at, status,
  CASE WHEN status = 'resolved' THEN s.id END AS refers_to, CASE WHEN status = 'resolved' THEN s.digest END AS digest,
  CASE WHEN status = 'resolved'
    THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(etag, s.etag) || chr(10) || 'last-modified: ' || lm || chr(10) || 'server: first'
    ELSE 'cache-control: max-age=600' || coalesce(chr(10) || 'etag: ' || etag, '') || chr(10) || 'last-modified: ' || lm || chr(10) || 'server: second' END AS headers
FROM w
"""
