"""WARC derivatives: metadata and plain-text conversion records of response records."""
from __future__ import annotations

import gzip
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .html_blocks import blocks

COLUMNS = ("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest",
           "headers", "block")


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the parts, the same on every run."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def sha1_label(block: Column) -> Column:
    """sha1:<base 32>, five hexadecimal digits at a time."""
    h = F.sha1(block)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.concat(F.lit("sha1:"), F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages (page_id, url, html), one per row; null html is an empty body.

    ``headers`` is the HTTP header of the response, ``block`` is header and body. Rows that repeat a page
    get the same record id.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return (pages.select("page_id", F.col("url").alias("target_uri"), body.alias("_body"), http.alias("headers"))
            .select(F.lit("response").alias("warc_type"), record_id(F.lit("response"), F.col("page_id"), F.col("target_uri"), F.md5("_body")).alias("record_id"),
                    F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
                    F.lit("application/http; msgtype=response").alias("content_type"), sha1_label(F.col("_body")).alias("payload_digest"),
                    sha1_label(F.concat("headers", "_body")).alias("block_digest"), "headers", F.concat("headers", "_body").alias("block")))


def plain_text(page: str) -> str:
    """All visible text of a page, a block a line; scripts, styles and the head are not visible."""
    return "\n".join(b.text for b in blocks(page))


def derive(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record; columns are ``COLUMNS``.

    Both refer to the response by its record id, and carry its target URI and date. The metadata block
    (application/warc-fields) holds the response's digests and every HTTP header line, prefixed with
    ``http-``, its body's length, and the length and digest of the conversion. The conversion block
    (text/plain) is the visible text; its payload digest is its block's, and ``headers`` of both keep the
    source's payload digest and date (WARC-Refers-To-Date). A response with a null block or without a blank
    line after its header has an empty body. Other record types, and records without an id, are left out.
    Repeated responses give repeated derivatives. Extra columns are not read.
    """
    source = responses.where((F.col("warc_type") == "response") & F.col("record_id").isNotNull())
    fields = [*COLUMNS[1:]]
    source = source.select(*fields)
    names = ["record_id", "target_uri", "date", "payload_digest", "block_digest", "http", "body_length", "text"]

    def convert(batches):
        for b in batches:
            http, size, text = [], [], []
            for block in b.column("block").to_pylist():
                head, _, body = (block or "").partition("\r\n\r\n")
                http.append(head)
                size.append(len(body.encode("utf-8")))
                text.append(plain_text(body))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:5]], pa.array(http, pa.string()), pa.array(size, pa.int64()),
                                              pa.array(text, pa.string())], names)
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in names[:6]], T.StructField("body_length", T.LongType()),
                           T.StructField("text", T.StringType())])
    made = source.mapInArrow(convert, schema).withColumn("text_digest", sha1_label(F.col("text")))
    kept = F.array_join(F.transform(F.filter(F.split("http", "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("http-"), x, F.lit("\r\n"))), "")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields_block = F.concat(
        F.lit("source-payload-digest: "), value("payload_digest"), F.lit("\r\nsource-block-digest: "), value("block_digest"),
        F.lit("\r\nsource-body-length: "), value("body_length"), F.lit("\r\nconversion-length: "), F.octet_length("text").cast("string"),
        F.lit("\r\nconversion-digest: "), F.col("text_digest"), F.lit("\r\n"), kept)
    refers = F.concat(F.lit("WARC-Refers-To-Target-URI: "), value("target_uri"), F.lit("\r\nWARC-Refers-To-Date: "), value("date"),
                      F.lit("\r\nX-Source-Payload-Digest: "), value("payload_digest"), F.lit("\r\n"))

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), record_id(F.lit(kind), F.col("record_id")).alias("record_id"),
                        F.col("record_id").alias("refers_to"), F.col("target_uri"), F.col("date"), F.lit(content_type).alias("content_type"),
                        sha1_label(block).alias("payload_digest"), sha1_label(block).alias("block_digest"), refers.alias("headers"),
                        block.alias("block"))
    both = F.array(record("metadata", "application/warc-fields", fields_block), record("conversion", "text/plain; charset=utf-8", F.col("text")))
    return made.select(F.explode(both).alias("r")).select("r.*").select(*COLUMNS)


def serialize(records: DataFrame, compress: bool = True) -> DataFrame:
    """record_id and ``warc``: each record as bytes of a WARC/1.1 file, a gzip member of its own if compressed.

    Members may be joined in any order to a file. Nulls are left out of the header.
    """
    named = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"))

    def write(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                block = (r["block"] or "").encode("utf-8")
                head = "".join(f"{k}: {r[c]}\r\n" for k, c in named if r[c] is not None)
                more = (r["headers"] or "") if r["warc_type"] in ("metadata", "conversion") else ""
                raw = f"WARC/1.1\r\n{head}{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
                out.append(gzip.compress(raw, mtime=0) if compress else raw)
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(out, pa.binary())], ["record_id", "warc"])
    return records.select(*COLUMNS).mapInArrow(write, "record_id string, warc binary")


def parse(content: bytes) -> list[dict]:
    """The records of a WARC file's bytes, compressed by member or not: header fields by name, and ``block``."""
    data = b""
    if content[:2] == b"\x1f\x8b":
        while content:
            d = zlib.decompressobj(31)
            data += d.decompress(content) + d.flush()
            content = d.unused_data
    else:
        data = content
    out, stream = [], io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip()] = value.strip()
        fields["block"] = stream.read(int(fields.get("Content-Length", 0)))
        out.append(fields)
    return out
