"""WARC archives: segmented records with chunked payloads, written and reassembled."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_frames
from ledgerloom.session import stage

# Payload bytes from which equal payloads are written once.
MIN_REVISIT_BYTES = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
# With segments of bounded size this bounds an archive at 64 MB before compression.
RECORDS_PER_FILE = 4_096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_RECORD = "record_id string, page_id string, type string, refers_to string, digest string, segment long, origin string, total long, block binary"


def split_text(text: str, size: int) -> list[str]:
    """Cut a text into parts of at most ``size`` UTF-8 bytes (at least one character each)."""
    raw, parts, at = text.encode(), [], 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        parts.append(raw[at:end].decode())
        at = end
    return parts


def chunked(payload: str, size: int = CHUNK_BYTES) -> str:
    """Chunked transfer framing of a payload."""
    parts = split_text(payload, size)
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunk(body: bytes) -> bytes | None:
    """Payload in chunked framing; None if the framing is broken. Chunk extensions are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """Payload of an HTTP message, None if it is broken."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    is_chunked = re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n"))
    return dechunk(body) if is_chunked else body


def record_urn(row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{row}'.encode()).digest())}>"


def _record(headers: list[tuple[str, object]], block: str) -> str:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block.encode())}", "", block])


def page_records(row: int, page_id, url, html, digest: str, refers_row, segment: int = SEGMENT_BYTES) -> list[str]:
    """Records of one page without their closing blank lines: the record and its continuations."""
    revisit = refers_row is not None
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = f"{head}\r\n" if revisit else f"{head}Transfer-Encoding: chunked\r\n\r\n{chunked(html)}"
    parts = split_text(block, segment)
    own = record_urn(row)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))]
    first = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own),
        *common,
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_urn(refers_row) if revisit else None),
        ("WARC-Segment-Number", 1 if len(parts) > 1 else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    out = [_record(first, parts[0])]
    for number, part in enumerate(parts[1:], 2):
        last = number == len(parts)
        out.append(
            _record(
                [
                    ("WARC-Type", "continuation"),
                    ("WARC-Record-ID", f"{own[:-1]}-{number}>"),
                    *common,
                    ("WARC-Segment-Origin-ID", own),
                    ("WARC-Segment-Number", number),
                    ("WARC-Segment-Total-Length", len(block.encode()) if last else None),
                ],
                part,
            )
        )
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` to gzip archives in folder ``path``.

    The payload is the html in UTF-8 (null: empty), in chunked framing, cut into segments.
    Of rows with equal payloads (by SHA-256) of at least MIN_REVISIT_BYTES the one with the smallest
    id is the response, ids that repeat by row, null ids last; all others revisit it. Records leave
    through Spark's text writer with the record end as line separator.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    slim = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")
    )
    rows = stage(slim.withColumn("row", F.monotonically_increasing_id()), "pages")
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    firsts = (
        rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(place)["row"].alias("first"))
        .where("n > 1")
        .select("digest", "first")
    )
    # written first: if few payloads repeat, Spark sees that and leaves the pages where they are
    firsts = stage(firsts, "firsts")
    refers = F.when(F.col("first") != F.col("row"), F.col("first"))
    named = rows.join(firsts, "digest", "left").select(
        "row", F.col("id").cast("string").alias("id"), "url",
        F.when(refers.isNull(), F.col("html")).alias("html"), "digest", refers.cast("string").alias("refers"),
    )

    def run(batches):
        for frame in batches:
            found = []
            for row, page, url, text, digest, first in frame[["row", "id", "url", "html", "digest", "refers"]].itertuples(index=False):
                ref = int(first) if isinstance(first, str) else None
                page, url = (x if isinstance(x, str) else None for x in (page, url))
                found += page_records(row, page, url, text, digest, ref)
            yield pd.DataFrame({"value": found})

    map_frames(named, run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def inflate(content: bytes) -> bytes:
    """Content of an archive of any number of gzip members, or of a plain one."""
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts) + content


def parse_records(data: bytes):
    """Headers (lower-case names) and block of every record. Raises ValueError on a broken record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of {size} bytes doesn't end at byte {at}")
        yield headers, data[end + 4 : at]
        at += 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in ``path``, gzip or plain, one row each.

    An archive is read as a whole by one task: archives of up to a gigabyte, the usual size, are
    the bound for foreign files; own ones are far smaller. Archives are cut by Content-Length alone.
    """

    def run(batches):
        for frame in batches:
            for content in frame["content"]:
                rows = []
                for h, block in parse_records(inflate(content)):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append(
                        (
                            h["warc-record-id"], h.get("warc-page-id"), h["warc-type"], h.get("warc-refers-to"),
                            h.get("warc-payload-digest"), int(number) if number else None,
                            h.get("warc-segment-origin-id"), int(total) if total else None, block,
                        )
                    )
                names = ["record_id", "page_id", "type", "refers_to", "digest", "segment", "origin", "total", "block"]
                frame_out = pd.DataFrame(rows, columns=names)
                yield frame_out.astype({"segment": "Int64", "total": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return map_frames(files.select("content"), run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Logical records: segments joined in order and verified.

    Continuations are grouped by the record they continue and sorted by segment number. A record is
    ``complete`` if its numbers run from 1 without gap or repeat and its length is what the
    last segment states; otherwise its block is null. Records without segments pass by
    the shuffle. A continuation whose first record is missing comes out as incomplete.
    """
    whole = records.where("segment IS NULL AND type <> 'continuation'").select(
        "record_id", "page_id", "type", "refers_to", "digest", F.lit(True).alias("complete"), "block"
    )
    parts = records.where("segment IS NOT NULL OR type = 'continuation'").withColumn(
        "key", F.coalesce("origin", "record_id")
    )
    own = F.col("origin").isNull()
    grouped = parts.groupBy("key").agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("page_id", "type", "refers_to", "digest")],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )

    def run(batches):
        for frame in batches:
            blocks = []
            for kind, total, own_parts in zip(frame["type"], frame["total"], frame["parts"], strict=True):
                block = b"".join(p["block"] for p in own_parts)
                in_order = [p["segment"] for p in own_parts] == list(range(1, len(own_parts) + 1))
                blocks.append(block if isinstance(kind, str) and in_order and len(block) == total else None)
            out = frame.rename(columns={"key": "record_id"})[["record_id", "page_id", "type", "refers_to", "digest"]]
            yield out.assign(complete=[b is not None for b in blocks], block=blocks)

    kinds = "record_id string, page_id string, type string, refers_to string, digest string, complete boolean, block binary"
    return whole.unionByName(map_frames(grouped, run, kinds))


def payloads(logical: DataFrame) -> DataFrame:
    """Logical records with their decoded ``payload`` in place of ``block``; null if broken or incomplete."""

    def run(batches):
        for frame in batches:
            yield frame.drop(columns="block").assign(
                payload=[http_payload(b) if b is not None else None for b in frame["block"]]
            )

    kinds = "record_id string, page_id string, type string, refers_to string, digest string, complete boolean, payload binary"
    return map_frames(logical, run, kinds)
