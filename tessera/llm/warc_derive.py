"""WARC derivatives: response records to linked metadata and conversion (plain text) records.

Every response gives one ``conversion`` record, the text of its HTML, and one ``metadata`` record, fields found in it. Both carry the
response's id as refers-to, its target URI and date, its HTTP headers and payload digest, and have ids, digests and
lengths of their own. Ids are made from the response's id and the record's type, so a second run gives the same records. All work is done by
Spark's own functions over one scan without a shuffle.

Text of HTML: comments, scripts, styles and heads go with their content, tags of blocks end a line, other tags vanish, the
entities of ``ENTITIES`` are decoded, white space is collapsed.

Defined cases: a null payload counts as empty; a null URI is kept as null, and tells a response from one with another; repeated responses give repeated records; a very long payload
is one row like any other; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

# HTML entities that are decoded, in this order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
GONE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(?:p|br|div|article|section|header|footer|nav|aside|h[1-6]|ul|ol|li|table|tr|blockquote|pre|main|form)\b[^>]*>"
TAGS = r"<[a-zA-Z/!][^>]*>"
DATE = "1970-01-01T00:00:00Z"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.col("url").cast("string"), F.lit("-")))).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload), F.lit("\r\n")).alias("http_headers"),
        payload.alias("payload"),
    )


def urn(name: Column) -> Column:
    h = F.sha2(name, 256)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def decoded(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, GONE, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(decoded(text), "[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " ?\n[ \n]*", "\n"), r"\A\s+|\s+\z", "")


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response; ``kind`` is conversion or metadata."""
    html = F.col("payload")
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    lang = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)", 1)
    links = F.size(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*\bhref="), F.lit(0)))
    fields = F.concat(F.lit("title: "), F.trim(F.regexp_replace(decoded(title), "[ \t\r\n\f]+", " ")), F.lit("\r\nlanguage: "), lang, F.lit("\r\noutlinks: "), links.cast("string"), F.lit("\r\n"))
    kinds = F.array(
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(html).alias("block")),
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
    )
    digest = F.concat(F.lit("sha256:"), F.sha2(html, 256))
    out = records.withColumn("payload_digest", digest).withColumn("r", F.explode(kinds))
    return out.select(
        "page_id",
        F.col("r.kind").alias("kind"),
        urn(F.concat_ws("|", "r.kind", "record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "http_headers",
        "payload_digest",
        F.col("r.content_type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2("r.block", 256)).alias("block_digest"),
        F.col("r.block").alias("block"),
    )


def as_text(records: DataFrame) -> DataFrame:
    """Records as they stand in a WARC file, one row for each: header lines, an empty line, the block, two line ends."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("payload_digest")),
        F.array_join(F.transform(F.filter(F.split("http_headers", "\r\n"), lambda h: h != ""), lambda h: F.concat(F.lit("WARC-Source-HTTP-Header: "), h, F.lit("\r\n"))), ""),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select("page_id", "kind", F.concat(head, F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(documents(spark, sf_dir, "pages")))


def _sql_urn(name: str) -> str:
    h = f"sha256({name})"
    return f"concat('urn:uuid:', substr({h}, 1, 8), '-', substr({h}, 9, 4), '-8', substr({h}, 14, 3), '-a', substr({h}, 18, 3), '-', substr({h}, 21, 12))"


def _sql_decoded(text: str) -> str:
    for name, char in ENTITIES:
        text = f"replace({text}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return text


def _sql_text(html: str) -> str:
    text = rf"regexp_replace({html}, '{GONE}', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    text = rf"regexp_replace({_sql_decoded(text)}, '[ \t\r\f]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '\A\s+|\s+\z', '', 'g')"


SQL = rf"""
WITH r AS (
  SELECT page_id, {_sql_urn("concat_ws('|', 'response', coalesce(CAST(page_id AS VARCHAR), '-'), coalesce(url, '-'))")} AS refers_to, url AS target_uri, coalesce(html, '') AS h FROM pages),
k AS (
  SELECT *, 'conversion' AS kind, 'text/plain; charset=utf-8' AS content_type, {_sql_text("h")} AS block FROM r
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields', concat('title: ', trim(regexp_replace({_sql_decoded("regexp_extract(h, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")}, '[ \t\r\n\f]+', ' ', 'g')),
    chr(13), chr(10), 'language: ', regexp_extract(h, '(?i)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1), chr(13), chr(10), 'outlinks: ', len(regexp_extract_all(h, '(?i)<a\b[^>]*\bhref=')), chr(13), chr(10)) FROM r)
SELECT page_id, kind, {_sql_urn("concat_ws('|', kind, refers_to)")} AS record_id, refers_to, target_uri, '{DATE}' AS date,
  concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(h), chr(13), chr(10)) AS http_headers,
  concat('sha256:', sha256(h)) AS payload_digest, content_type, CAST(strlen(block) AS BIGINT) AS content_length, concat('sha256:', sha256(block)) AS block_digest, block
FROM k
"""
