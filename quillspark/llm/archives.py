"""Web archives: writing and parsing ARC (versions 1 and 2) and WARC records, and converting the former to the latter.

Archives are BINARY values of bounded size, one row each, kept in Parquet or read with Spark's ``binaryFile``
source; gzip members are recognised.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import shared_path, stash

#: An archive is closed when it holds this many bytes.
ARCHIVE_BYTES = 4 << 20
#: Payloads below this many bytes are never stored as revisits.
REVISIT_BYTES = 100
# Fixed values of the formats.
ARC_FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# ---------------------------------------------------------------- ARC

def arc_archive(records: Iterable[dict], version: int, name: str) -> bytes:
    """An ARC file: its version block, then one header line and block for each record."""
    body = f"{version} 0 quill\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 20200101000000 text/plain ".encode() + (b"200 - - 0 " + name.encode() + b" " if version == 2 else b"") + str(len(body)).encode() + b"\n" + body + b"\n"]
    at = len(out[0])
    for r in records:
        values = [r["url"], r["ip"], r["date"], r["mime"]]
        if version == 2:
            values += [str(r.get("status", 200)), base64.b32encode(hashlib.sha1(r["block"]).digest()).decode(), "-", str(at), name]
        out.append(" ".join([*values, str(len(r["block"]))]).encode() + b"\n" + r["block"] + b"\n")
        at += len(out[-1])
    return b"".join(out)


def gunzipped(data: bytes) -> bytes:
    """The content of all gzip members, or the data itself if it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        one = zlib.decompressobj(31)
        out += [one.decompress(data), one.flush()]
        data = one.unused_data.lstrip(b"\0\r\n")
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, by its own field list and declared lengths.

    The version block names the fields; without one, a header line of five fields is version 1, of ten version 2.
    A header with other counts, a bad length or a block cut short ends the archive with one ``error`` record.
    URLs with spaces are kept whole: fields are counted from the right.
    """
    data, at, fields = gunzipped(data), 0, None
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        parts = line.split(" ")
        names = fields or (ARC_FIELDS[2] if len(parts) >= 10 else ARC_FIELDS[1])
        extra = len(parts) - len(names)
        try:
            if end < 0 or extra < 0:
                raise ValueError("header")
            head = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True))
            size = int(head["Archive-length"])
            block = data[end + 1 : end + 1 + size]
            if size < 0 or len(block) != size:
                raise ValueError("length")
        except ValueError as bad:
            yield {"error": f"{bad} at byte {at}"}
            return
        at = end + 1 + size
        if head["URL"].startswith("filedesc:"):
            lines = block.decode("latin-1").split("\n")
            if len(lines) > 1 and lines[1].strip().startswith("URL"):
                fields = lines[1].split()
            continue
        yield {"head": head, "block": block, "error": None}


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of an HTTP response; a block that isn't one is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        head, sep, payload = block.partition(b"\n\n")
    lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


# ---------------------------------------------------------------- WARC

def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, url: str, date: str, key: str) -> str:
    """A WARC-Record-ID made from what the record is, so that converting twice gives equal archives."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join((kind, url, date, key)))}>"


def warc_date(arc_date: str) -> str:
    """A 14-digit ARC date (shorter ones are padded) as a WARC date; unusable ones become the epoch."""
    digits = "".join(c for c in arc_date if c.isdigit())[:14]
    if len(digits) < 8:
        digits = "19700101"
    digits = digits.ljust(14, "0")
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file: ``fields`` (lower-case names, continuation lines joined), ``block``, ``error``."""
    data, at = gunzipped(data), 0
    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields: dict[str, str] = {}
        name = ""
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and name:
                fields[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        size = fields.get("content-length", "")
        block = data[end + 4 : end + 4 + int(size)] if size.isdigit() else b""
        if not lines[0].startswith("WARC/") or not size.isdigit() or len(block) != int(size):
            yield {"fields": {}, "block": b"", "error": f"bad record at byte {at}"}
            return
        at = end + 4 + int(size)
        yield {"fields": fields, "block": block, "error": None}


def converted(arc: dict, refers_to: dict | None = None) -> bytes:
    """The WARC record of one ARC record: identifier, timestamp, type and digests are synthesised.

    HTTP blocks give ``response``, others ``resource``; with ``refers_to`` (``id, url, date``) the record is a
    ``revisit`` that keeps the HTTP header only.
    """
    head, block = arc["head"], arc["block"]
    _, payload = http_payload(block)
    http = block.startswith(b"HTTP/")
    kind = "revisit" if refers_to else "response" if http else "resource"
    date = warc_date(head["Archive-date"])
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, head["URL"], date, arc.get("key", ""))), ("WARC-Date", date),
        ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]), ("WARC-Payload-Digest", sha1_digest(payload)),
    ]
    if refers_to:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", refers_to["id"]), ("WARC-Refers-To-Target-URI", refers_to["url"]), ("WARC-Refers-To-Date", refers_to["date"])]
        block = block[: len(block) - len(payload)]
    fields += [("WARC-Block-Digest", sha1_digest(block)), ("Content-Type", "application/http; msgtype=response" if http else head["Content-type"])]
    return warc_record(fields, block)


# ---------------------------------------------------------------- Spark

def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``name, content`` of all archive files below ``path`` (any file system Spark reads)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("name"), "content")


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """ARC archives ``name, content`` of a table ``page_id, url, html``: odd archives version 1, even ones version 2.

    The block is an HTTP response with the page's id in a header field; null html is an empty payload, a null url
    becomes ``about:blank``, spaces in urls are percent-encoded, a null page_id is kept as such. Archives hold
    about 4 MB, a longer page has one to itself.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, number, made = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            number += 1
            name = f"{held[0]['key']}-{number}.arc"
            data = arc_archive(held, 1 + number % 2, name)
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"name": [name], "content": [data]}, schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                key = "null" if page is None else str(page)
                payload = (html or "").encode("utf-8", "surrogatepass")
                block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {key}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                clean = "".join("%20" if c.isspace() else c for c in url) if url else "about:blank"
                made = (page or 0) % 86400
                date = f"20200101{made // 3600:02d}{made // 60 % 60:02d}{made % 60:02d}"
                held.append({"url": clean, "ip": "192.0.2.1", "date": date, "mime": "text/html", "block": block, "key": key})
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(build, "name string, content binary")


def arc_records(archives: DataFrame) -> DataFrame:
    """One row for each ARC record: ``page_id, arc_url, arc_date, arc_ip, arc_mime, block, payload_bytes, digest, error``."""
    columns = ["page_id", "arc_url", "arc_date", "arc_ip", "arc_mime", "block", "payload_bytes", "digest", "error"]
    schema = pa.schema([("page_id", pa.int64()), ("arc_url", pa.string()), ("arc_date", pa.string()), ("arc_ip", pa.string()), ("arc_mime", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("error", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for r in parse_arc(content.as_py() or b""):
                    if r["error"]:
                        rows.append((None,) * 8 + (r["error"],))
                        continue
                    fields, payload = http_payload(r["block"])
                    page = fields.get("x-page-id", "null")
                    h = r["head"]
                    rows.append((int(page) if page.lstrip("-").isdigit() else None, h["URL"], h["Archive-date"], h["IP-address"], h["Content-type"], r["block"], len(payload), hashlib.sha256(payload).hexdigest(), None))
                for k in range(0, len(rows), 200):
                    part = list(zip(*rows[k : k + 200], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(part, schema, strict=True)], schema=schema)

    return archives.select("content").mapInArrow(parse, "page_id long, arc_url string, arc_date string, arc_ip string, arc_mime string, block binary, payload_bytes long, digest string, error string").select(*columns)


def arc_to_warc(archives: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """WARC archives ``name, content`` of ARC archives.

    Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the smallest page id (ties: all
    rows with that id) stays a response, the others become revisits of it. The lookup of first holders is a
    map-side combined aggregation; the join back has one row for each digest on its right side, so AQE can split
    a hot digest. Records that could not be parsed are not carried over; ``arc_records`` shows them.
    """
    records = arc_records(archives).where("error is null")
    holder = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "arc_url", "arc_date")
    first = records.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest").agg(F.min(holder).alias("f"), F.count("*").alias("n")).where("n > 1").select(
        "digest", F.col("f.page_id").alias("first_id"), F.col("f.arc_url").alias("first_url"), F.col("f.arc_date").alias("first_date"), F.lit(True).alias("again"),
    )
    joined = records.join(first, "digest", "left")
    again = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = joined.select("page_id", "arc_url", "arc_date", "arc_ip", "arc_mime", "block", again.alias("again"), "first_id", "first_url", "first_date")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size, number, name = 0, 0, ""
        schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

        def close() -> pa.RecordBatch:
            nonlocal out, size, number
            number += 1
            info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", name, "", str(number))), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Filename", f"{name}-{number}.warc"), ("Content-Type", "application/warc-fields")], b"software: quillspark\r\nformat: WARC File Format 1.0\r\n")
            made = pa.RecordBatch.from_pydict({"name": [f"{name}-{number}.warc"], "content": [info + b"".join(out)]}, schema=schema)
            out, size = [], 0
            return made

        for batch in batches:
            for r in batch.to_pylist():
                key = "null" if r["page_id"] is None else str(r["page_id"])
                name = name or key
                to = None
                if r["again"]:
                    date = warc_date(r["first_date"])
                    first_key = "null" if r["first_id"] is None else str(r["first_id"])
                    to = {"id": record_id("response", r["first_url"], date, first_key), "url": r["first_url"], "date": date}
                arc = {"head": {"URL": r["arc_url"], "IP-address": r["arc_ip"], "Archive-date": r["arc_date"], "Content-type": r["arc_mime"]}, "block": r["block"], "key": key}
                made = converted(arc, to)
                if to:  # the revisited page and the full payload's facts, which a revisit's block does not hold
                    payload = http_payload(r["block"])[1]
                    facts = f"X-Refers-To-Page: {first_key}\r\nX-Payload-Sha256: {hashlib.sha256(payload).hexdigest()}\r\nX-Payload-Length: {len(payload)}\r\n".encode()
                    made = made.replace(b"WARC/1.0\r\n", b"WARC/1.0\r\n" + facts, 1)
                out.append(made)
                size += len(made)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if out:
            yield close()

    return rows.mapInArrow(build, "name string, content binary")


def warc_records(archives: DataFrame) -> DataFrame:
    """One row for each page record of WARC archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date, record_id, refers_to_record``."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string())])
    number = lambda s: int(s) if s and s.lstrip("-").isdigit() else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for r in parse_warc(content.as_py() or b""):
                    f = r["fields"]
                    if r["error"] or f.get("warc-type") == "warcinfo":
                        continue
                    http, payload = http_payload(r["block"])
                    again = f["warc-type"] == "revisit"
                    digest = f.get("x-payload-sha256") if again else hashlib.sha256(payload).hexdigest()
                    size = number(f.get("x-payload-length")) if again else len(payload)
                    rows.append((number(http.get("x-page-id")), size, digest, f["warc-type"], number(f.get("x-refers-to-page")), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-record-id"), f.get("warc-refers-to")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("content").mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string, refers_to_record string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages to ARC archives, those to WARC archives in the shared folder, and the WARC archives' records read back.

    Null page ids are kept; they sort behind all others when the first holder of a payload is chosen. Repeated
    rows give repeated records. An empty table gives an empty result. Extra columns are ignored.
    """
    warc = stash(arc_to_warc(pages_to_arc(pages)), "warc")
    return warc_records(warc)


__all__ = ["arc_archive", "arc_records", "arc_to_warc", "archive_pages", "converted", "pages_to_arc", "parse_arc", "parse_warc", "read_archives", "shared_path", "warc_records"]
