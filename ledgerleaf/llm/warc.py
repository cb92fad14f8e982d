"""Derived WARC records: a metadata and a plain-text conversion record for each response.

Both derived records name the response that they come from (WARC-Refers-To, its target and date) and each other
(WARC-Concurrent-To); the source's WARC and HTTP headers, all of them in their order, and its payload digest are kept in the
metadata record's fields. Record ids are made from the source's id and the kind of record, so that runs agree.

Pages are scanned once from left to right. A tag ends at the first ``>`` outside of a quoted attribute value; where none follows, the
rest is text; an open comment, script or style takes the rest. So the time follows the length of a page, whatever it holds.
"""

from __future__ import annotations

import gzip
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.common import attached, release

VERSION, CRLF, DATE = "WARC/1.1", "\r\n", "2026-01-01T00:00:00Z"
#: A comment's beginning, a tag (slash, name, attributes), or a declaration. Quotes count after an equals sign only. The text searched ends with ``>``.
_TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?>\"[^\"]*\"|'[^']*')?+)*+)>|[!?][^>]*>)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BREAKS = frozenset([
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li",
    "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
])
_UNSEEN = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template")}
_SPACE = re.compile(r"[^\S\n]+")


def _attribute(text: str, wanted: str) -> str:
    """Value of the first attribute of that name, entities resolved; empty where there is none."""
    for name, double, single, plain in _ATTRIBUTE.findall(text):
        if name.lower() == wanted:
            return entities.unescape(double or single or plain)
    return ""


def scanned(html: str | None) -> tuple[str, str, str, list[str]]:
    """Text, title, declared language and link targets of a page; all empty for null.

    The text has one line for each block, without what scripts, styles and comments hold, entities resolved.
    """
    html = html or ""
    out, links, title, title_at, language, at = [], [], None, -1, "", 0
    last = html.rfind(">") + 1
    while (token := _TOKEN.search(html, at, last)) is not None:
        out.append(html[at : token.start()])
        at = token.end()
        if token[1]:
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else len(html)
            out.append(" ")
            continue
        name = (token[3] or "").lower()
        if name in _UNSEEN and not token[2]:
            end = _UNSEEN[name].search(html, at)
            at = end.end() if end else len(html)
            out.append(" ")
        elif name == "a" and not token[2]:
            target = "".join(_attribute(token[4], "href").split())
            if target:
                links.append(target)
        elif name == "html" and not token[2] and not language:
            language = _attribute(token[4], "lang")
        elif name == "title" and title is None:
            if not token[2]:
                title_at = len(out)
            elif title_at >= 0:
                title = "".join(out[title_at:])
        if name in _BREAKS:
            out.append("\n")
    out.append(html[at:])
    lines = (_SPACE.sub(" ", x).strip() for x in entities.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(entities.unescape(title or "").split()), language, links


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the first 128 bits of the parts' SHA-256."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def one_line(value: Column) -> Column:
    """``value`` for a header or a field, where a line end would begin another: line ends are percent-encoded, as in a URL."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


HEADERS = "array<struct<name:string,value:string>>"
#: What a derived record takes of its response.
SOURCE = ("page_id", "record_id", "target_uri", "date", "status", "warc_headers", "http_headers", "payload_digest")


def _headers(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(name.replace("_", "-")).alias("name"), value.alias("value")) for name, value in values.items()])


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` (page_id, url, html) as response records: page_id, record_id, target_uri, date, status, content_type, warc_headers, http_headers, payload, payload_digest.

    A null url becomes an empty target, null html an empty payload. Rows equal in all three are one capture given twice, so their
    records are equal, ids too. Other columns don't matter, whatever their names.
    """
    payload, target, kind = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit("")), F.lit("text/html; charset=utf-8")
    own = record_id(F.lit("response"), F.col("page_id"), F.col("url"), F.sha2(payload.cast("binary"), 256))
    sent = _headers(WARC_Type=F.lit("response"), WARC_Record_ID=own, WARC_Date=F.lit(date), WARC_Target_URI=target, WARC_Payload_Digest=digest(payload))
    return pages.select(
        "page_id", own.alias("record_id"), target.alias("target_uri"), F.lit(date).alias("date"), F.lit("200").alias("status"), kind.alias("content_type"),
        sent.alias("warc_headers"), _headers(Content_Type=kind).alias("http_headers"), payload.alias("payload"), digest(payload).alias("payload_digest"),
    )


def derive(sources: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, record_type, record_id, refers_to, linked_id, target_uri, date, content_type, source_payload_digest, block, block_digest, content_length.

    The block of a conversion is the page's text, that of a metadata record its fields. Pages without text, title or links get
    records too, with an empty text and fewer fields; pages of any length are scanned whole. Line ends in a header's value are percent-encoded.
    Equal responses get equal records; an empty table gives none. Columns of ``sources`` that a response doesn't have don't matter, whatever their names.
    """

    def each(payloads: list) -> Iterator[tuple[int, int, list]]:
        told = [scanned(p) for p in payloads]
        yield 0, len(payloads), list(map(list, zip(*told, strict=True)))

    s = attached(sources, SOURCE, ("payload",), "text string, title string, language string, links array<string>", each)
    field = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value))
    listed = lambda column, kind: F.when(F.size(column) > 0, F.array_join(F.transform(column, lambda h: F.concat(F.lit(f"source-{kind}-"), F.lower(h["name"]), F.lit(": "), one_line(h["value"]))), CRLF))
    fields = F.concat_ws(
        CRLF, field("source-status", F.col("status")), field("source-payload-digest", F.col("payload_digest")), listed("warc_headers", "warc"), listed("http_headers", "http"),
        field("title", F.col("title")), field("language", F.col("language")), F.concat(F.lit("outlinks: "), F.size("links")), F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x)), CRLF),
    )
    own = lambda kind: record_id(F.lit(kind), F.col("record_id"))
    two = F.array(
        F.struct(F.lit("metadata").alias("record_type"), own("metadata").alias("id"), own("conversion").alias("linked_id"), F.lit("application/warc-fields").alias("type"), F.concat(F.rtrim(fields, F.lit(CRLF)), F.lit(CRLF)).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), own("conversion").alias("id"), own("metadata").alias("linked_id"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("text").alias("block")),
    )
    rows = s.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_payload_digest"), F.explode(two).alias("r"))
    return rows.select(
        "page_id", "r.record_type", F.col("r.id").alias("record_id"), "refers_to", "r.linked_id", "target_uri", "date", F.col("r.type").alias("content_type"), "source_payload_digest",
        "r.block", digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"),
    )


def serialised(derived: DataFrame) -> DataFrame:
    """One column, value: each record as WARC text without the two line ends that close it."""
    header = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), one_line(value)))
    head = F.concat_ws(
        CRLF, F.lit(VERSION), header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Date", F.col("date")), header("WARC-Target-URI", F.col("target_uri")),
        header("WARC-Refers-To", F.col("refers_to")), header("WARC-Refers-To-Target-URI", F.col("target_uri")), header("WARC-Refers-To-Date", F.col("date")), header("WARC-Concurrent-To", F.col("linked_id")),
        header("WARC-Block-Digest", F.col("block_digest")), header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")),
    )
    return derived.select(F.concat(head, F.lit(CRLF * 2), F.col("block")).alias("value"))


def write(derived: DataFrame, path: str) -> None:
    """WARC files under ``path``, one for each partition: the two line ends after a record are the text writer's separator."""
    serialised(derived).write.option("lineSep", CRLF * 2).text(path)


def records_of(content: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file, plain or in gzip members; blocks are as long as their Content-Length says."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while (start := content.find(b"WARC/", at)) >= 0:
        end = content.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = content[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(name.strip(), value.strip()) for name, _, value in (x.partition(":") for x in lines)]
        size = next((int(v) for n, v in headers if n.lower() == "content-length" and v.isdigit()), 0)
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files (1.0 or 1.1, plain or gzip) under ``path``: headers, all in their order, and block (binary). A file is read by one task."""
    schema = f"headers {HEADERS}, block binary"
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held, size = [], 0
                for record in records_of(content.as_py()):
                    held.append(record)
                    size += len(record[1])
                    if size > 8 << 20:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)
        release()

    def out(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([[{"name": n, "value": v} for n, v in h] for h, _ in held], kind), pa.array([x for _, x in held], pa.binary())], ["headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, schema)


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, in any case; null where there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def responses_of(records: DataFrame) -> DataFrame:
    """Response records of read() in the shape of responses(); page_id is null. The HTTP head of a block gives status and headers. Payloads are taken for UTF-8, what isn't is replaced."""
    text = F.make_valid_utf8(F.col("block").cast("string"))
    head, body = F.substring_index(text, CRLF * 2, 1), F.substring(text, F.instr(text, CRLF * 2) + 4, F.length(text))
    lines = F.filter(F.slice(F.split(head, CRLF), F.lit(2), F.size(F.split(head, CRLF))), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    rows = records.where(F.lower(header(F.col("headers"), "WARC-Type")) == "response").select("headers", head.alias("head"), body.alias("payload"), pairs.alias("http_headers"))
    warc = lambda name: header(F.col("headers"), name)
    return rows.select(
        F.lit(None).cast("long").alias("page_id"), warc("WARC-Record-ID").alias("record_id"), F.coalesce(warc("WARC-Target-URI"), F.lit("")).alias("target_uri"), warc("WARC-Date").alias("date"),
        F.regexp_extract("head", r"^HTTP/\S+ (\d{3})", 1).alias("status"), F.coalesce(header(F.col("http_headers"), "Content-Type"), F.lit("")).alias("content_type"), F.col("headers").alias("warc_headers"), "http_headers",
        "payload", F.coalesce(warc("WARC-Payload-Digest"), digest(F.col("payload"))).alias("payload_digest"),
    )
