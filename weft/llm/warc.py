"""WARC derivatives: metadata and plain-text conversion records of response records.

A response (record id, target URI, HTTP header block, payload) gives two records that refer to it by
WARC-Refers-To: metadata (application/warc-fields: the source's headers and digest, title, sizes) and a
conversion (text/plain). Record ids follow from the response's id and the type, digests are of the bytes.

Text of HTML: comments, scripts and styles go (to the end if unclosed), block tags break lines, other tags
go (a < that another < follows before any > is text), numeric entities, five named ones and &nbsp; are read, white space is folded. No pattern
reads a character more than a bounded number of times.

`read` gives the responses of WARC files with their own record ids, headers and digests; `responses` makes some of a
table of pages, which has no headers of its own.

Defined cases: null html is an empty payload, null url an empty target; such pages get their two records
all the same; repeated rows give repeated records, with equal ids; there are no ties, as nothing is chosen among rows; a page of any
length is worked on whole; numbers that are no character stay as they stand; empty tables give empty results. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

VERSION = "WARC/1.1"
CRLF = "\r\n"

#: Elements that break lines.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title"
#: Fixed values, in the order in which they apply: pattern, replacement.
CLEANING = (
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?is)<script(?:\s[^<>]*)?>.*?(?:</script\s*>|\z)", " "),
    (r"(?is)<style(?:\s[^<>]*)?>.*?(?:</style\s*>|\z)", " "),
    (rf"(?i)</?(?:{BLOCKS})(?:[\s/][^<>]*)?>", "\n"),
    (r"<[^<>]*>", ""),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
NUMBER = r"^(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
FOLDING = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+\z", ""))


def plain_text(html: Column) -> Column:
    for pattern, to in CLEANING:
        html = F.regexp_replace(html, pattern, to)
    # an array of one: so the cleaning is done once
    html = F.transform(F.array(html), lambda h: F.when(F.contains(h, F.lit("&#")), _numbers_read(h)).otherwise(h))[0]
    for entity, to in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(to))
    for pattern, to in FOLDING:
        html = F.regexp_replace(html, pattern, to)
    return html


def _numbers_read(text: Column) -> Column:
    """&#233; and &#xE9; as their characters; a no-break space is a space."""

    def read(part: Column, i: Column) -> Column:
        number = F.regexp_extract(part, NUMBER, 0)
        digits = F.substring(number, F.lit(1), F.length(number) - 1)
        code = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substring(digits, F.lit(2), F.lit(6)), 16, 10)).otherwise(digits).cast("int")
        valid = (number != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(code == 160, F.lit(" ")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        rest = F.substring(part, F.length(number) + 1, F.length(part))
        return F.when(i == 0, part).when(valid, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), part))

    return F.concat_ws("", F.transform(F.split(text, "&#", -1), read))


def record_id(*parts: Column) -> Column:
    """<urn:uuid:...> of the parts' MD5."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record_id, target_uri, http_headers, payload of pages (page_id, url, html)."""
    pages = pick(pages, "page_id", "url", "html")
    payload, target = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select("page_id", record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("")), target, F.lit("response")).alias("record_id"), target.alias("target_uri"), head.alias("http_headers"), payload.alias("payload"))


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; gzip members are unpacked one by one."""
    import io
    import zlib

    parts, plain = [], data
    if data[:2] == b"\x1f\x8b":
        while data:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data))
            data = z.unused_data.lstrip(b"\0")
        plain = b"".join(parts)
    stream = io.BytesIO(plain)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


def _responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in _records(content):
                if head.get("warc-type") == "response":
                    http, _, payload = block.partition(b"\r\n\r\n")
                    rows.append((head.get("warc-record-id", ""), head.get("warc-target-uri", ""), http.decode("utf-8", "replace") + CRLF, payload.decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["record_id", "target_uri", "http_headers", "payload"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, target_uri, http_headers, payload of the response records of WARC files, plain or gzip. A file, of at most 2 GB, is a task's; other record types are passed over."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_responses, "record_id string, target_uri string, http_headers string, payload string").withColumn("page_id", F.lit(None).cast("long"))


def derivatives(source: DataFrame) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, source_digest, content_type, block, block_digest, content_length of responses."""
    text = source.withColumn("text", plain_text(F.col("payload"))).withColumn("source_digest", digest(F.col("payload")))
    title = F.regexp_extract("payload", r"(?is)<title(?:\s[^<>]*)?>\s*([^<]*)", 1)
    title = F.regexp_replace(title, r"[\r\n\t]+", " ")
    fields = F.concat(
        F.regexp_replace("http_headers", r"(?m)^(?=[^\r\n])", "http-header: "),
        F.lit("source-payload-digest: "), "source_digest", F.lit(f"{CRLF}title: "), title,
        F.lit(f"{CRLF}text-length: "), F.octet_length("text").cast("string"), F.lit(CRLF),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = text.withColumn("d", F.explode(kinds)).select("page_id", "target_uri", "source_digest", F.col("record_id").alias("refers_to"), "d.*")
    return rows.select(
        "page_id", "record_type", record_id(F.col("refers_to"), F.col("record_type")).alias("record_id"), "refers_to", "target_uri", "source_digest", "content_type", "block",
        digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"),
    )


def serialized(records: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records with `warc`: the bytes that stand in a WARC file."""
    line = lambda name, value: [F.lit(f"{name}: "), value, F.lit(CRLF)]
    head = F.concat(
        F.lit(VERSION + CRLF),
        *line("WARC-Type", F.col("record_type")), *line("WARC-Record-ID", F.col("record_id")), *line("WARC-Date", F.lit(date)),
        *line("WARC-Refers-To", F.col("refers_to")), *line("WARC-Target-URI", F.col("target_uri")), *line("WARC-Block-Digest", F.col("block_digest")),
        *line("Content-Type", F.col("content_type")), *line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    )
    return records.withColumn("warc", F.encode(F.concat(head, F.col("block"), F.lit(CRLF * 2)), "utf-8"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    nl = lambda s: q(s).replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
    text = "payload"
    for pattern, to in CLEANING:
        text = f"regexp_replace({text}, {q(pattern)}, {nl(to)}, 'g')"
    number = f"regexp_extract(p, {q(NUMBER)}, 0)"
    code = f"CASE WHEN lower(left({number}, 1)) = 'x' THEN try_cast('0x' || {number}[2:-2] AS int) ELSE try_cast({number}[1:-2] AS int) END"
    read = f"CASE WHEN i = 1 THEN p WHEN {code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343 THEN CASE WHEN {code} = 160 THEN ' ' ELSE chr({code}) END || substr(p, length({number}) + 1) ELSE '&#' || p END"
    text = f"array_to_string(list_transform(string_split({text}, '&#'), lambda p, i: {read}), '')"
    for entity, to in ENTITIES:
        text = f"replace({text}, {q(entity)}, {q(to)})"
    for pattern, to in FOLDING:
        text = f"regexp_replace({text}, {nl(pattern)}, {nl(to)}, 'g')"
    uuid = lambda x: f"'<urn:uuid:' || substr(md5({x}),1,8) || '-' || substr(md5({x}),9,4) || '-' || substr(md5({x}),13,4) || '-' || substr(md5({x}),17,4) || '-' || substr(md5({x}),21,12) || '>'"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
s AS (SELECT *, {uuid("coalesce(cast(page_id AS varchar), '') || '|' || target_uri || '|response'")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest, {text} AS text FROM r),
d AS (SELECT *, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type, text AS block FROM s
  UNION ALL SELECT *, 'metadata', 'application/warc-fields',
    'http-header: HTTP/1.1 200 OK' || {crlf} || 'http-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'http-header: Content-Length: ' || strlen(payload) || {crlf}
    || 'source-payload-digest: ' || source_digest || {crlf} || 'title: ' || regexp_replace(regexp_extract(payload, '(?is)<title(?:\\s[^<>]*)?>\\s*([^<]*)', 1), '[\\r\\n\\t]+', ' ', 'g') || {crlf}
    || 'text-length: ' || strlen(text) || {crlf} FROM s)
SELECT page_id, record_type, {uuid("refers_to || '|' || record_type")} AS record_id, refers_to, target_uri, source_digest, content_type, block,
  'sha256:' || sha256(block) AS block_digest, cast(strlen(block) AS bigint) AS content_length FROM d"""


ORACLE_SQL = _oracle()
