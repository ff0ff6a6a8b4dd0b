"""WARC archives with record segmentation: writing, and reading with segment reassembly.

Payloads are stored once per digest: the record of the largest ``page_id`` is the response, the others
are revisits that refer to it. A response block longer than ``segment`` bytes is cut into a first
record and continuation records. The reader groups continuations by their origin's identifier, orders
them by segment number, checks the total length, and decodes the chunked transfer framing as it goes,
so it holds one segment at a time and not a whole record.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import zlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, partitions, ready, saved, scratch, spread_join

DATE = "2024-01-01T00:00:00Z"
CHUNK = 8192
SEGMENT = 32 << 10
VOLUME = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, copy: int) -> str:
    return f"urn:x-record:{'null' if page_id is None else page_id}:{copy}"


def page_of(urn: str) -> int | None:
    page = urn.split(":")[2]
    return None if page == "null" else int(page)


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), CHUNK):
        some = payload[at : at + CHUNK]
        parts += [b"%x\r\n" % len(some), some, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


class Unchunker:
    """Decodes an HTTP response block fed in parts: skips the header, strips the chunk framing."""

    def __init__(self):
        self.held, self.state, self.left = b"", "header", 0
        self.digest, self.length = hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        self.held += data
        while True:
            if self.state == "header":
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                self.held, self.state = self.held[end + 4 :], "size"
            elif self.state == "size":
                end = self.held.find(b"\r\n")
                if end < 0:
                    return
                self.left = int(self.held[:end].split(b";")[0], 16)
                self.held, self.state = self.held[end + 2 :], "data" if self.left else "trailer"
            elif self.state == "data":
                some = self.held[: self.left]
                self.digest.update(some)
                self.length += len(some)
                self.left -= len(some)
                self.held = self.held[len(some) :]
                if self.left:
                    return
                self.state = "mark"
            elif self.state == "mark":
                if len(self.held) < 2:
                    return
                if self.held[:2] != b"\r\n":
                    raise ValueError("broken chunk framing")
                self.held, self.state = self.held[2:], "size"
            else:  # trailer: lines up to an empty one
                end = self.held.find(b"\r\n")
                if end < 0:
                    return
                line, self.held = self.held[:end], self.held[end + 2 :]
                if not line:
                    self.state = "done"
                    return

    def finish(self) -> tuple[int, str]:
        if self.state != "done" or self.held:
            raise ValueError("the payload's chunks don't end where the block does")
        return self.length, base64.b32encode(self.digest.digest()).decode()


def records_of(row: dict, segment: int):
    """The WARC records (as gzip members) of one page."""
    own = f"<{record_id(row['page_id'], row['copy'])}>"
    head = [("WARC-Type", "revisit" if row["revisit"] else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _clean(row["url"])))
    head += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode())]
    if row["revisit"]:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(row['refers'], 0)}>")]
        yield record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["bytes"])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(row["html"])
    if len(block) <= segment:
        yield record(head, block)
        return
    yield record([*head, ("WARC-Segment-Number", "1")], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", own[:-1] + f":{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, block[at : at + segment])


def read_records(path: str):
    """(headers, block) of each record of a file, one gzip member at a time."""
    with open(path, "rb") as file:
        rest = file.read(1 << 20)
        while rest:
            member, parts = zlib.decompressobj(31), []
            while True:
                parts.append(member.decompress(rest))
                if member.eof:
                    rest = member.unused_data or file.read(1 << 20)
                    break
                rest = file.read(1 << 20)
                if not rest:
                    raise ValueError(f"{path} ends inside a record")
            data = b"".join(parts)
            end = data.index(b"\r\n\r\n")
            first, *lines = data[:end].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"{path}: no WARC record where one is due")
            headers = dict(x.split(": ", 1) for x in lines)
            n = int(headers["Content-Length"])
            if data[end + 4 + n :] != b"\r\n\r\n":
                raise ValueError(f"{path}: a record's length isn't what it says")
            yield headers, data[end + 4 : end + 4 + n]


def plan_records(pages: DataFrame, least: int) -> DataFrame:
    """Which rows are responses (with their html) and which revisits (without).

    Only responses carry their payload through a shuffle, keyed by page, so copies of one payload
    don't meet in one task.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    light = pages.select("page_id", "url", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    large = F.col("bytes") >= least
    keepers = light.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows"))
    same = Window.partitionBy("page_id", "digest").orderBy("url")
    numbered = light.withColumn("copy", F.row_number().over(same) - 1)
    # Of a payload's rows the first of the keeper's is the response; the keeper is null where no numbered page has the payload.
    judged = spread_join(numbered.where(large), saved(keepers), "digest", "rows")
    revisits = judged.where(~F.col("page_id").eqNullSafe(F.col("keeper")) | (F.col("copy") > 0))
    revisits = revisits.select("page_id", "url", "digest", "bytes", "copy", F.lit(True).alias("revisit"), F.col("keeper").alias("refers"), F.lit(None).cast("binary").alias("html"))
    full = pages.select("page_id", "url", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), html.alias("html"))
    # A payload goes to a page that holds it: one row a (digest, page), whatever the number of copies elsewhere.
    kept = full.join(keepers.where("keeper is not null").select("digest", F.col("keeper").alias("page_id")), ["digest", "page_id"], "left_semi").unionByName(
        full.where(F.col("page_id").isNull() & large).join(keepers.where("keeper is null").select("digest"), "digest", "left_semi")
    )
    own = F.row_number().over(same) - 1
    kept = kept.withColumn("copy", own).where("copy = 0")
    small = full.where(~large).withColumn("copy", own)
    responses = kept.unionByName(small).select("page_id", "url", "digest", "bytes", "copy", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers"), "html")
    return revisits.unionByName(responses)


def write_archives(planned: DataFrame, folder: str, segment: int = SEGMENT, volume: int = VOLUME) -> DataFrame:
    """Writes volumes below ``folder``; gives one row a volume (file, records). A task names its own volumes, so that
    what a lost attempt left behind is in no row."""

    def write(batches):
        out, name, n, held = None, "", 0, []
        schema = pa.schema([("file", pa.string()), ("records", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                for data in records_of(row, segment):
                    if out is None:
                        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out, n = open(name, "wb"), 0  # noqa: SIM115
                    out.write(data)
                    n += 1
                    if out.tell() >= volume:
                        out.close()
                        out = None
                        held.append((name, n))
        if out is not None:
            out.close()
            held.append((name, n))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return planned.mapInArrow(write, "file string, records bigint")


_PARSED = "origin string, number int, total bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, block binary"


def read_archives(spark: SparkSession, volumes: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, segments put together."""
    parsed_schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])

    def parse(batches):
        held, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for h, block in read_records(file):
                    kind = h["WARC-Type"]
                    if kind == "continuation":
                        row = (h["WARC-Segment-Origin-ID"][1:-1], int(h["WARC-Segment-Number"]), int(h.get("WARC-Segment-Total-Length", -1)), None, None, None, None, None, block)
                    else:
                        own, digest = h["WARC-Record-ID"][1:-1], h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "revisit":
                            n = int(block.split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
                            row = (own, 0, -1, page_of(own), n, digest, kind, page_of(h["WARC-Refers-To"][1:-1]), None)
                        elif "WARC-Segment-Number" in h:
                            row = (own, 1, -1, page_of(own), None, digest, kind, None, block)
                        else:
                            body = Unchunker()
                            body.feed(block)
                            n, found = body.finish()
                            if found != digest:
                                raise ValueError(f"{own}: the payload isn't what its digest says")
                            row = (own, 0, -1, page_of(own), n, digest, kind, None, None)
                    held.append(row)
                    size += len(row[8] or b"") + 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), parsed_schema)], schema=parsed_schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), parsed_schema)], schema=parsed_schema)

    def join(batches):
        schema = pa.schema([parsed_schema.field(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")])
        first = body = None
        number = length = 0
        total = -1

        def close():
            n, digest = body.finish()
            if length != total:
                raise ValueError(f"{first['origin']}: {length} bytes in its segments, {total} announced")
            if digest != first["payload_digest"]:
                raise ValueError(f"{first['origin']}: the payload isn't what its digest says")
            return (first["page_id"], n, digest, first["record_type"], None)

        for batch in batches:
            held = []
            for row in batch.to_pylist():
                if row["number"] == 0:
                    held.append((row["page_id"], row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"]))
                    continue
                if row["number"] == 1:
                    if first is not None:
                        held.append(close())
                    first, body, number, length, total = row, Unchunker(), 0, 0, -1
                if first is None or row["origin"] != first["origin"] or row["number"] != number + 1 or total >= 0:
                    raise ValueError(f"{row['origin']}: segment {row['number']} doesn't follow")
                number, length, total = row["number"], length + len(row["block"]), row["total"]
                body.feed(row["block"])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(close(), schema)], schema=schema)

    n = partitions(spark)
    parsed = volumes.select("file").repartition(n, "file").mapInArrow(parse, _PARSED)
    # A record's segments share the origin; no group is larger than one record.
    ordered = parsed.repartition(n, "origin").sortWithinPartitions("origin", "number")
    return ordered.mapInArrow(join, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_pages(spark: SparkSession, pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), read the archives back, one row a page.

    A null html is an empty payload. Rows alike in page and payload count as copies: the first (by url) can be the
    response, the others revisit it. A null ``page_id`` revisits like any other row; of a payload that no numbered page has,
    the first of its rows (by url) is the response, and the others refer to it (``refers_to`` is then null). An empty table gives an empty result; other columns are ignored.
    """
    ready(spark)
    folder = scratch(spark, "warc")
    atexit.register(drop, folder)
    volumes = saved(write_archives(plan_records(pages, least), folder, segment))
    return read_archives(spark, volumes)
