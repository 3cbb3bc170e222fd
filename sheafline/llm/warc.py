"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each.

Both point to the response by WARC-Refers-To and keep its target URI, its
headers (date and content type among them) and its digest. The text is taken
from the HTML in one pass over it; all else is SQL functions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text.
HIDDEN = ("script", "style", "noscript", "template", "title")
#: Elements that can stand in a head; any other one, and any text, ends it, whether or not it is closed.
IN_HEAD = frozenset((*HIDDEN, "base", "basefont", "bgsound", "head", "link", "meta", "noframes"))
#: Elements that end a line.
BLOCKS = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
SOFTWARE = "software: sheafline"

#: A quote opens a value only right after "="; elsewhere it is part of a name or of a value without quotes.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|(?=>))"""
_ATTRIBUTES = rf"(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{_VALUE}|(?!\s*+=)))*+"
#: A whole tag (its name), the start of a comment, a tag without an end, or of what is neither tag nor text.
_MARK = re.compile(rf"<(?:(/?[a-zA-Z][^\s/>]*+){_ATTRIBUTES}>|(!--)|(?=/?[a-zA-Z])|([!?/]))")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in HIDDEN}
_COMMENT = re.compile("-?>")
_COMMENT_END = re.compile("--!?>")
_ENDS_LINE = frozenset(BLOCKS) | {f"/{name}" for name in BLOCKS}
# a single space stays as it is and need not be found
_SPACES, _LINES = re.compile("[ \\t\\r\\f\u00a0]{2,}|[\\t\\r\\f\u00a0]"), re.compile(" ?\\n[ \\n]*")


def text_of(page: str) -> str:
    """The text of an HTML page: a line for each block, character references decoded.

    Reads the page once from left to right. What a page leaves open (a tag, a
    value in quotes, a comment, a hidden element) lasts to its end, as in a
    browser; a head ends where something begins that cannot stand in it.
    """
    parts, at, in_head = [], 0, False
    while mark := _MARK.search(page, at):
        begin, tag = mark.start(), mark[1]
        if begin > at:
            in_head = in_head and page[at:begin].isspace()
            parts.append(html.unescape(page[at:begin]))
        at = mark.end()
        if tag:
            name = tag.lower()
            if name == "head":
                in_head = True
                parts.append(" ")
            elif in_head and name not in IN_HEAD and (name[0] != "/" or name in ("/head", "/body", "/html", "/br")):
                in_head = False
            if name in _ENDS_LINE and not in_head:
                parts.append("\n")
            elif name in _END_OF:
                end = _END_OF[name].search(page, at)
                at = end.start() if end else len(page)
                parts.append(" ")
        elif mark[2]:
            end = _COMMENT.match(page, at) or _COMMENT_END.search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
        elif mark[3]:
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        else:
            at = len(page)
    parts.append(html.unescape(page[at:]))
    return _LINES.sub("\n", _SPACES.sub(" ", "".join(parts))).strip(" \n")


def plain_text(pages: Column) -> Column:
    """``text_of`` a column of pages; null for null."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield some.map(text_of, na_action="ignore")

    return read(pages)


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid from the MD5 of the kind and the parts: the same row always gets the same id."""
    known = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    digest = F.md5(F.concat_ws("\n", F.lit(kind), *known).cast("binary"))
    cuts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def derivatives(responses: DataFrame, headers: Column | None = None) -> DataFrame:
    """Two records for each response with columns page_id, url, html: metadata, then conversion.

    headers: the response's own headers, WARC's and HTTP's, as a map; by default
    its content type, text/html, and its length. Columns: page_id, record_type,
    record_id, refers_to (the response's id), refers_to_target_uri,
    refers_to_date (the header WARC-Date, null without one), concurrent_to (the
    other derivative's id), source_payload_digest (of the response's HTML),
    source_headers (a line for each, by name), content_type, block_digest,
    content_length (bytes), block. The metadata block has the fields of
    application/warc-fields: the source's URI, digest, length, language and
    headers, and the conversion's id and digest. The conversion block is the
    plain text.

    A null html counts as empty, a null url as an empty URI, a null page_id as
    an empty part of the ids and null in the output; null headers are left out.
    Line ends in the URI or a header become spaces. The response's id comes
    from page_id, url and html, so rows that repeat all three repeat their
    records; nothing is merged. An empty table gives no rows. Other columns are
    not read. A text of any length is one block.
    """
    one_line = lambda x: F.regexp_replace(x, "[\\r\\n]+", " ")
    source = responses.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(one_line(F.col("url").cast("string")), F.lit("")).alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        (F.lit(None).cast("map<string,string>") if headers is None else headers).alias("headers"),
    )
    length = F.octet_length("html").cast("string")
    known = F.coalesce("headers", F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length))
    entries = F.filter(F.array_sort(F.map_entries(known)), lambda e: e["value"].isNotNull())
    source = source.withColumn("payload", _digest(F.col("html")))
    key = [F.col(x) for x in ("page_id", "uri", "payload")]
    source = source.select(
        "page_id", "uri", "payload", entries.alias("headers"), F.try_element_at(known, F.lit("WARC-Date")).alias("date"),
        F.octet_length("html").alias("source_length"),
        F.regexp_extract("html", "(?i)<html[^<>]*\\slang=\"([^\"]*)\"", 1).alias("lang"),
        plain_text(F.col("html")).alias("text"),
        *[record_id(kind, *key).alias(kind) for kind in ("response", "metadata", "conversion")],
    )
    source = source.withColumn("text_digest", _digest(F.col("text")))
    line = lambda name, value: F.concat(name, F.lit(": "), value, F.lit("\r\n"))
    source = source.withColumn("source_headers", F.array_join(F.transform("headers", lambda e: line(one_line(e["key"]), one_line(e["value"]))), ""))
    fields = [
        ("source-uri", "uri"), ("source-payload-digest", "payload"), ("source-length", "source_length"), ("source-language", "lang"),
        ("conversion-record-id", "conversion"), ("conversion-digest", "text_digest"),
    ]
    own = F.array_join(F.transform("headers", lambda e: line(F.concat(F.lit("source-header-"), F.lower(one_line(e["key"]))), one_line(e["value"]))), "")
    about = F.concat(F.lit(SOFTWARE + "\r\n"), *[line(F.lit(name), F.col(column).cast("string")) for name, column in fields], own)

    def one(kind: str, other: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.col(kind).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.array(one("metadata", "conversion", "application/warc-fields", about), one("conversion", "metadata", "text/plain", F.col("text")))
    rows = source.select("page_id", "uri", "payload", "date", "source_headers", "response", F.explode(both).alias("r"))
    return rows.select(
        "page_id", "r.record_type", "r.record_id", F.col("response").alias("refers_to"), F.col("uri").alias("refers_to_target_uri"), F.col("date").alias("refers_to_date"),
        "r.concurrent_to", F.col("payload").alias("source_payload_digest"), "source_headers", "r.content_type", _digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


def warc_text(records: DataFrame, date: str) -> DataFrame:
    """Each derivative as one WARC/1.1 record, ready to be written: page_id, record_type, record.

    date is when the derivatives were made. A header whose value is null is left
    out; repeated rows are written each by itself, an empty table gives no rows.
    """
    names = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"),
        ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Target-URI", "refers_to_target_uri"), ("WARC-Concurrent-To", "concurrent_to"),
        ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length"),
    ]
    head = [F.coalesce(F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n")), F.lit("")) for name, column in names]
    return records.select("page_id", "record_type", F.concat(F.lit(f"WARC/1.1\r\nWARC-Date: {date}\r\n"), *head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))


#: The text in SQL, by replacements: it holds for pages that leave nothing open and use these references only.
SQL_STEPS = (
    ("(?s)<!--.*?-->", " "),
    *((f"(?is)<{name}(\\s[^>]*)?>.*?</{name}\\s*>", " ") for name in (*HIDDEN, "head")),
    ("(?i)</?(" + "|".join(BLOCKS) + ")(\\s[^>]*)?/?>", "\n"),
    ("(?s)<[/!?a-zA-Z][^>]*>", ""),
)
SQL_REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))
SQL_TIDY = (("[ \\t\\r\\f\u00a0]+", " "), (" ?\\n[ \\n]*", "\n"), ("^[ \\n]+|[ \\n]+$", ""))


def _sql() -> str:
    """The same in DuckDB's SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        return "E'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    text = "html"
    for pattern, by in SQL_STEPS:
        text = f"regexp_replace({text}, {escaped(pattern)}, {escaped(by)}, 'g')"
    for name, by in SQL_REFERENCES:
        text = f"replace({text}, {quoted(name)}, {quoted(by)})"
    for pattern, by in SQL_TIDY:
        text = f"regexp_replace({text}, {escaped(pattern)}, {escaped(by)}, 'g')"

    def uuid(kind: str) -> str:
        d = f"md5(concat_ws(chr(10), '{kind}', coalesce(page_id::varchar, ''), uri, payload))"
        return f"'<urn:uuid:' || substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-' || substr({d}, 13, 4) || '-' || substr({d}, 17, 4) || '-' || substr({d}, 21, 12) || '>'"

    crlf = "chr(13) || chr(10)"
    about = " || ".join([f"'{SOFTWARE}' || {crlf}"] + [f"'{name}: ' || {column} || {crlf}" for name, column in (("source-uri", "uri"), ("source-payload-digest", "payload"), ("source-length", "strlen(html)::varchar"), ("source-language", "lang"), ("conversion-record-id", "conversion"), ("conversion-digest", "'sha256:' || sha256(text)"), ("source-header-content-length", "strlen(html)::varchar"), ("source-header-content-type", "'text/html'"))])
    headers = f"'Content-Length: ' || strlen(html)::varchar || {crlf} || 'Content-Type: text/html' || {crlf}"
    return f"""
    WITH source AS (SELECT page_id::bigint AS page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html, 'sha256:' || sha256(coalesce(html, '')) AS payload FROM pages),
    parts AS (SELECT *, {uuid('response')} AS response, {uuid('metadata')} AS metadata, {uuid('conversion')} AS conversion,
        regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS lang, {text} AS text FROM source),
    records AS (
        SELECT page_id, 'metadata' AS record_type, metadata AS record_id, response AS refers_to, uri AS refers_to_target_uri, NULL::varchar AS refers_to_date, conversion AS concurrent_to,
            payload AS source_payload_digest, {headers} AS source_headers, 'application/warc-fields' AS content_type, {about} AS block FROM parts
        UNION ALL
        SELECT page_id, 'conversion', conversion, response, uri, NULL::varchar, metadata, payload, {headers}, 'text/plain', text FROM parts)
    SELECT page_id, record_type, record_id, refers_to, refers_to_target_uri, refers_to_date, concurrent_to, source_payload_digest, source_headers, content_type,
        'sha256:' || sha256(block) AS block_digest, strlen(block)::bigint AS content_length, block FROM records"""


SQL = _sql()
