"""WARC archives: pages are written as transactions of three records, and records are read back and assembled into one nested row per capture.

Writing: each page is a request, a response (or a revisit, if an earlier page has the same payload) and a metadata record with the page's id; request and
metadata name the response by WARC-Concurrent-To, a revisit names the response it repeats by WARC-Refers-To. Every record is a gzip member of its own.
Files are written where executors share a folder and get their names by a rename; the manifest lists the ones that count, so a task that runs twice leaves
a spare file and no wrong row.

Reading: a task reads files record by record, blocks in pieces, so that its memory does not grow with them. ``assemble`` joins requests and metadata to
captures (responses, revisits, resources) over WARC-Concurrent-To, whichever side names the other, and over other requests and metadata in between.

Defined results: a null html is an empty payload, a null url is ``about:blank``. Payloads under ``REVISIT_BYTES`` are never revisited. Of equal page_ids
with one payload one row is the response; null page_ids count as the largest. Repeated rows stay rows. Other columns of pages are not read. In
``assemble``, captures with one record id are one (the first by file and place), requests and metadata without a capture make a row of their own whose
type is null, and a capture with over ``PART`` of them goes on in further rows (``part`` 1, 2, ...), so that no row is unbounded. Records of other types
(warcinfo, conversion, continuation) are read but not assembled. An empty table makes no files and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: The shortest payload that is revisited.
REVISIT_BYTES = 100
#: Bytes of an archive after which the next one begins.
FILE_BYTES = 128 << 20
#: Requests and metadata in one row of a capture.
PART = 10_000
#: Bytes of a block that are read at once; the headers of an http message lie in the first of them.
PIECE = 1 << 20
CAPTURES = ("response", "revisit", "resource")
SATELLITES = ("request", "metadata")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VISIBLE = "".join(map(chr, range(33, 127)))
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)")

RECORD = """file string, place long, record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, declared_digest string,
content_type string, block_bytes long, http_status int, http_length long, payload_bytes long, payload_sha256 string, fields map<string,string>, payload binary"""


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(kind: str, record_id: str, date: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """A record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def _urn(run: str, row: int, kind: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.UUID(run), f'{row}:{kind}')}"


def transaction(run: str, row: int, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, date: str, first: tuple[int, str | None] | None) -> list[bytes]:
    """The records of a page; ``first`` is the row and the url of the response with its payload, if that is another row (whose payload of ``size`` bytes is
    then not looked at)."""
    uri = quote(url, safe=_VISIBLE) if url else "about:blank"
    capture, target = _urn(run, row, "capture"), ("WARC-Target-URI", uri)
    host, path = m.groups() if (m := _URL.match(uri)) else ("", "/")
    with_capture = [target, ("WARC-Concurrent-To", f"<{capture}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    about = [target, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        answer = record("response", capture, date, http + payload, about)
    else:
        seen = quote(first[1], safe=_VISIBLE) if first[1] else "about:blank"
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_urn(run, first[0], 'capture')}>"), ("WARC-Refers-To-Target-URI", seen), ("WARC-Refers-To-Date", date)]
        answer = record("revisit", capture, date, http, about)
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [
        record("request", _urn(run, row, "request"), date, f"GET {path or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), [*with_capture, ("Content-Type", "application/http; msgtype=request")]),
        answer,
        record("metadata", _urn(run, row, "metadata"), date, fields, [*with_capture, ("Content-Type", "application/warc-fields")]),
    ]


@dataclass
class Archives:
    """Written archives: their folder and the manifest (path, n_records, n_bytes)."""

    folder: str
    manifest: DataFrame

    def records(self, payloads: bool = False) -> DataFrame:
        return read_warc(self.manifest.select("path"), payloads)


def first_rows(rows: DataFrame) -> DataFrame:
    """digest and the row and url of the response, for payloads of several of ``rows`` (row, page_id, url, digest, n_bytes)."""
    own = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "url")
    shared = rows.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1")
    return shared.select(F.col("digest").alias("shared"), F.col("first.row").alias("first_row"), F.col("first.url").alias("first_url"))


def write_warc(pages: DataFrame, date: str | None = None) -> Archives:
    """Write ``pages`` (page_id, url, html) as archives; ``date`` is the WARC-Date of all records, else the present time."""
    spark = pages.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder, run, limit = common.scratch_path(spark, "warc"), str(uuid.uuid4()), FILE_BYTES
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # Rows are numbered in a written table, so that tasks that run again see the same numbers.
    rows = common.written(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload")}), "pages")
    # A table of known size: where it is small, Spark broadcasts it and payloads aren't shuffled; else a payload's rows are split where they are many.
    shared = common.written(first_rows(rows.drop("payload")), "shared")
    fs, at = _fs(folder)
    fs.create_dir(at)

    def write(batches):
        fs, at = _fs(folder)
        names, out = ["path", "n_records", "n_bytes"], None

        def closed():
            stream, temp, records = out
            size = stream.tell()
            stream.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            fs.move(temp, f"{at}/{name}")
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])], names=names)

        for b in batches:
            for x in b.to_pylist():
                if out is None:
                    temp = f"{at}/.{uuid.uuid4().hex}"
                    info = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, b"software: folioflow\r\nformat: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])
                    out = [fs.open_output_stream(temp), temp, 1]
                    out[0].write(info)
                first = (x["first_row"], x["first_url"]) if x["first_row"] is not None and x["first_row"] != x["row"] else None
                for r in transaction(run, x["row"], x["page_id"], x["url"], x["payload"], x["n_bytes"], x["digest"], date, first):
                    out[0].write(r)
                    out[2] += 1
                if out[0].tell() >= limit:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    both = rows.join(shared, F.col("digest") == F.col("shared"), "left")
    # The payload of a revisit isn't written.
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    told = F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload")
    manifest = common.written(both.select("row", "page_id", "url", told, "digest", "n_bytes", "first_row", "first_url").mapInArrow(write, "path string, n_records long, n_bytes long"), "manifest")
    return Archives(folder, manifest)


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names in lower case and values; a line that begins with white space goes on with the value before it."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {text.strip()}"
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _bare(value: str | None) -> str | None:
    return value.strip("<> ") if value else None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() and len(value) < 18 else None


def read_records(stream, name: str, payloads: bool = False):
    """The records of an open archive, compressed or not, as dicts with the names of ``RECORD``."""
    stream = io.BufferedReader(stream, PIECE)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), PIECE)
    place = 0
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record begins at record {place}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line.rstrip(b"\r\n"))
        pairs = _headers(lines)
        head = dict(reversed(pairs))
        left = _number(head.get("content-length")) or 0
        kind, content = head.get("warc-type"), head.get("content-type") or ""
        out = {
            "file": name, "place": place, "record_id": _bare(head.get("warc-record-id")) or f"{name}#{place}", "type": kind, "date": head.get("warc-date"), "target_uri": head.get("warc-target-uri"),
            "concurrent_to": [_bare(v) for k, v in pairs if k == "warc-concurrent-to"], "refers_to": _bare(head.get("warc-refers-to")), "declared_digest": head.get("warc-payload-digest"),
            "content_type": content or None, "block_bytes": left, "http_status": None, "http_length": None, "fields": None,
        }
        piece = stream.read(min(left, PIECE))
        left -= len(piece)
        if content.startswith("application/http"):
            top, _, piece = piece.partition(b"\r\n\r\n")
            start, *rest = top.split(b"\r\n")
            http = dict(reversed(_headers(rest)))
            status = start.split(b" ")[1:2]
            out["http_status"] = _number(status[0].decode("latin-1")) if status and start.startswith(b"HTTP/") else None
            out["http_length"] = _number(http.get("content-length"))
        elif content.startswith("application/warc-fields"):
            out["fields"] = dict(reversed(_headers((piece + stream.read(left)).splitlines())))
            left = 0
        digest, size, kept = hashlib.sha256(), 0, []
        while True:
            digest.update(piece)
            size += len(piece)
            kept += [piece] * payloads
            if not left:
                break
            piece = stream.read(min(left, PIECE))
            if not piece:
                raise ValueError(f"{name}: record {place} is cut short")
            left -= len(piece)
        yield out | {"payload_bytes": size, "payload_sha256": digest.hexdigest(), "payload": b"".join(kept) if payloads else None}
        place += 1


def read_warc(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives ``paths`` (path: a URI that driver and executors reach), columns as in ``RECORD``; payloads only where asked for."""
    schema = T.StructType.fromDDL(RECORD)
    kind = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _fs(path)
                rows, size = [], 0
                with fs.open_input_file(at) as f:
                    for r in read_records(f, path, payloads):
                        rows.append(r)
                        size += 500 + len(r["payload"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return paths.select("path").repartition(max(common.n_shuffle(paths.sparkSession), 1), "path").mapInArrow(run, schema)


def homes(records: DataFrame) -> DataFrame:
    """satellite, capture: the captures that a request or metadata record belongs to, over as few links as possible. A round for each further link in between;
    a record that leads to no capture has no row."""
    captures = records.where(F.col("type").isin(*CAPTURES))
    named = records.where(F.size("concurrent_to") > 0).select("record_id", "type", F.explode("concurrent_to").alias("other"))
    known = captures.select("record_id").distinct()
    ways = named.where(F.col("type").isin(*SATELLITES)).select(F.col("record_id").alias("satellite"), "other")
    back = named.where(F.col("type").isin(*CAPTURES)).select(F.col("other").alias("satellite"), F.col("record_id").alias("other"))
    links = common.written(ways.unionByName(back).distinct(), "links")
    found = [common.written(links.join(known, links.other == known.record_id, "left_semi").select("satellite", F.col("other").alias("capture")), "homes")]
    # What isn't linked with a capture itself may be linked with a record that is.
    loose = links.join(known, links.other == known.record_id, "left_anti")
    both = common.written(loose.unionByName(loose.select(F.col("other").alias("satellite"), F.col("satellite").alias("other"))).distinct(), "loose")
    last = None if both.isEmpty() else found[0]
    while last is not None:
        seen = reduce(DataFrame.unionByName, found).select("satellite").distinct()
        step = both.join(last.select(F.col("satellite").alias("at"), "capture"), F.col("other") == F.col("at")).select("satellite", "capture").distinct().join(seen, "satellite", "left_anti")
        last = common.written(step, "homes")
        if last.isEmpty():
            break
        found.append(last)
    return reduce(DataFrame.unionByName, found)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, part, type, date, target_uri, http_status, payload_bytes, payload_digest (SHA-256; of a revisit as declared), intact (whether
    a declared SHA-256 is that of the payload), refers_to, requests and metadata. ``records`` is a written table with the columns of ``read_warc``."""
    own = F.struct("file", "place", "type", "date", "target_uri", "http_status", "http_length", "payload_bytes", "payload_sha256", "declared_digest", "refers_to")
    captures = records.where(F.col("type").isin(*CAPTURES)).groupBy("record_id").agg(F.min(own).alias("c"))
    revisit = F.col("c.type") == "revisit"
    declared = F.when(F.col("c.declared_digest").startswith("sha256:"), F.lower(F.substring("c.declared_digest", 8, 64)))
    captures = captures.select(
        F.col("record_id").alias("capture_id"), "c.type", "c.date", "c.target_uri", "c.http_status", F.when(revisit, F.col("c.http_length")).otherwise(F.col("c.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("c.payload_sha256")).alias("payload_digest"), F.when(~revisit, declared == F.col("c.payload_sha256")).alias("intact"), "c.refers_to",
    )
    around = records.where(F.col("type").isin(*SATELLITES)).select(F.col("record_id").alias("satellite"), F.struct("record_id", "file", "place", "date", "target_uri", "fields").alias("r"), (F.col("type") == "request").alias("asks"))
    # Records without a capture stay by themselves.
    around = around.join(homes(records), "satellite", "left").select(F.coalesce("capture", "satellite").alias("at"), "satellite", "r", "asks")
    many = around.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > PART).select(F.col("at").alias("of"), F.ceil(F.col("n") / PART).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("satellite"), F.col("parts")), F.lit(0)).cast("int")
    parts = around.join(many, F.col("at") == F.col("of"), "left").groupBy("at", part.alias("part"))
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("r"))), lambda a, b: F.when(_rank(a) < _rank(b), -1).when(_rank(a) > _rank(b), 1).otherwise(0))
    nested = parts.agg(listed(F.col("asks")).alias("requests"), listed(~F.col("asks")).alias("metadata"))
    out = captures.join(nested, F.col("capture_id") == F.col("at"), "full")
    none = F.array().cast(nested.schema["requests"].dataType)
    return out.select(
        F.coalesce("capture_id", "at").alias("capture_id"), F.coalesce("part", F.lit(0)).alias("part"), "type", "date", "target_uri", "http_status", "payload_bytes", "payload_digest", "intact", "refers_to",
        F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"),
    )


def _rank(r: Column) -> Column:
    return F.struct(r["file"], r["place"])


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(common.table(spark, sf_dir, "pages"))
    rows = common.written(assemble(common.written(archives.records(), "records")), "captures")
    page = F.get("metadata", F.lit(0))["fields"]["page-id"].cast("long")
    told = rows.select("capture_id", page.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").alias("to"))
    answers = told.where("record_type = 'response'")
    again = told.where("record_type = 'revisit'").join(answers.select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to")), "to", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return answers.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(again.select(*out))


OP13_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""
