"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record is a row (record_id, target_uri, warc_date, http_headers, payload). For each, two records
refer to it: a metadata record with the fields taken from the response, and a conversion record with the
page as plain text. Identifiers are name-based on the digests, so building twice gives equal records.
There is no shuffle and nothing to hold; the text is taken from a page by an Arrow function of linear time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh, table
from tallyforge.shipping import ship

WARC_DATE = "2024-01-01T00:00:00Z"
CONVERTED = "text/plain; charset=utf-8"
FIELDS = "application/warc-fields"


def urn(*parts: Column) -> Column:
    """A name-based identifier: the first 128 bits of the SHA-256 of the parts, as a UUID."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


_OPEN = re.compile("<script|<style|<!--", re.IGNORECASE | re.ASCII)
_CLOSE = {"<script": re.compile("</script>", re.IGNORECASE | re.ASCII), "<style": re.compile("</style>", re.IGNORECASE | re.ASCII), "<!--": re.compile("-->")}
_TAG, _BLANKS = re.compile("<[^>]*>"), re.compile(r"[ \t\n\x0b\f\r]+")
_TITLE = re.compile("<title[^>]*>", re.IGNORECASE | re.ASCII)
_TITLE_END = re.compile("</title>", re.IGNORECASE | re.ASCII)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def text_of(html: str) -> str:
    """Markup, scripts, styles and comments go, the five basic entities are resolved, blank runs become one space.

    Every search that fails once is not tried again, so time is linear in the page, whatever is left open in it.
    """
    out, at, failed = [], 0, set()
    for m in _OPEN.finditer(html):
        kind = m[0].lower()
        if m.start() < at or kind in failed:
            continue
        inner = m.end() if kind == "<!--" else html.find(">", m.end()) + 1
        end = _CLOSE[kind].search(html, inner) if inner else None
        if end is None:
            # nothing closes this one, so nothing closes a later one of the kind
            failed.add(kind)
            continue
        out += [html[at : m.start()], " "]
        at = end.end()
    html = "".join([*out, html[at:]])
    last = html.rfind(">") + 1
    html = _TAG.sub(" ", html[:last]) + html[last:]
    for entity, char in ENTITIES:
        html = html.replace(entity, char)
    return _BLANKS.sub(" ", html).strip(" ")


def title_of(html: str) -> str:
    start = _TITLE.search(html, 0, html.rfind(">") + 1)
    end = _TITLE_END.search(html, start.end()) if start else None
    return _BLANKS.sub(" ", html[start.end() : end.start()]).strip(" ") if end else ""


_LINK, _HREF = re.compile(r"<a[ \t\n\x0b\f\r]", re.IGNORECASE | re.ASCII), re.compile("href=", re.IGNORECASE | re.ASCII)


def links_of(html: str) -> int:
    """How often a tag of an anchor has "href=" behind a blank: what <a\\s[^>]*href= finds, in linear time."""
    n = at = 0
    for m in _LINK.finditer(html):
        if m.start() < at:
            continue
        end = html.find(">", m.end())
        end = len(html) if end < 0 else end
        last = None
        for last in _HREF.finditer(html, m.end(), end):
            pass
        # what stands between the last one and the tag's end holds no other
        n, at = n + (last is not None), end
    return n


def _parts():
    """Defined in here, the function travels to the workers by value; what it calls comes with the package."""

    def both(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": html.map(text_of), "title": html.map(title_of), "links": html.map(links_of)})

    return F.pandas_udf(both, "text string, title string, links long")


def responses(pages: DataFrame, date: str = WARC_DATE) -> DataFrame:
    """Pages (page_id, url, html) as response records; a null page is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", urn(F.lit("response"), F.col("page_id"), F.col("url"), payload).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Response records -> two rows each, ``metadata`` and ``conversion``, whose refers_to is the response.

    They carry the response's target_uri, warc_date and http_headers, its payload digest, and a digest and
    length of their own block. Null payloads, headers or dates count as empty; a null record_id stays null in
    refers_to. Repeated responses give repeated records with equal ids. An empty table gives no rows. Other
    columns are passed on, but for those whose names the records have themselves.
    """
    ship(responses.sparkSession)
    reserved = {"record_id", "payload", "warc_type", "content_type", "block", "refers_to", "content_length", "block_digest", "payload_digest"}
    names = [c for c in responses.columns if c.lower() not in reserved]
    parts, hashed, text_ = (fresh(names, n) for n in ("_parts", "_payload_digest", "_text"))
    payload = F.coalesce(F.col("payload"), F.lit(""))
    source = responses.select(*names, "record_id", payload.alias("payload")).withColumn(parts, _parts()("payload"))
    payload = F.col("payload")
    source = source.withColumns({hashed: digest(payload), text_: F.col(f"{parts}.text")})
    fields = F.concat(
        F.lit("via: "), F.coalesce("target_uri", F.lit("")), F.lit("\r\ntitle: "), F.col(f"{parts}.title"), F.lit("\r\npayload-length: "), F.octet_length(payload).cast("string"),
        F.lit("\r\nlinks: "), F.col(f"{parts}.links").cast("string"), F.lit("\r\nconverted-digest: "), digest(F.col(text_)), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit(FIELDS).alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit(CONVERTED).alias("content_type"), F.col(text_).alias("block")),
    )
    out = source.select(*names, "record_id", hashed, F.inline(kinds))
    return out.select(
        *names, "warc_type", urn(F.col("warc_type"), F.col("record_id"), F.col("block")).alias("record_id"), F.col("record_id").alias("refers_to"),
        "content_type", "block", F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), F.col(hashed).alias("payload_digest"),
    )


def record(row_version: str = "WARC/1.1") -> Column:
    """The bytes of a derivative record as they stand in a file, of derivatives()' columns."""
    head = F.concat_ws(
        "\r\n", F.lit(row_version), F.concat(F.lit("WARC-Type: "), "warc_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "warc_date"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Payload-Digest: "), "payload_digest"), F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return F.encode(F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")), "utf-8")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


_URN = "'<urn:uuid:' || {0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32] || '>'"
SQL = rf"""
WITH page AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
         sha256('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(html, '')) AS h
  FROM pages
), stripped AS (
  SELECT page_id, target_uri, payload, {_URN.format("h")} AS refers_to,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) || chr(13) || chr(10) AS http_headers,
         regexp_replace(regexp_replace(payload, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t,
         trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS title,
         len(regexp_extract_all(payload, '(?i)<a\s[^>]*href=')) AS links
  FROM page
), texts AS (
  SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS converted
  FROM stripped
), both_kinds AS (
  SELECT page_id, target_uri, payload, refers_to, http_headers, 'conversion' AS warc_type, '{CONVERTED}' AS content_type, converted AS block FROM texts
  UNION ALL
  SELECT page_id, target_uri, payload, refers_to, http_headers, 'metadata', '{FIELDS}',
         'via: ' || target_uri || chr(13) || chr(10) || 'title: ' || title || chr(13) || chr(10) || 'payload-length: ' || strlen(payload) || chr(13) || chr(10)
         || 'links: ' || links || chr(13) || chr(10) || 'converted-digest: sha256:' || sha256(converted) || chr(13) || chr(10)
  FROM texts
), named AS (
  SELECT *, sha256(warc_type || chr(10) || refers_to || chr(10) || block) AS h FROM both_kinds
)
SELECT page_id, target_uri, '{WARC_DATE}' AS warc_date, http_headers, warc_type, {_URN.format("h")} AS record_id, refers_to, content_type, block,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(payload) AS payload_digest
FROM named
"""
