"""Web archives: WARC records in ZIP packages, written per task and read back by range.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip member a
record) and ``indexes/index.cdxj`` (one line a record with its offset and length). The reader takes only
the end of the file, the central directory (with its ZIP64 forms), the local headers of the members it
wants and the ranges of the records asked for; nothing is extracted.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is a response and
the others are revisits that name it; smaller payloads are always responses. Equal means equal SHA-1,
SHA-256 and length.

Packages go to the shared folder, each under a name of its own, and a manifest of the committed tasks' packages
is written as a table; what a lost or repeated task leaves behind is in no manifest. Reading is split by runs of
records, so a large package is read by many tasks.

Cases: a null payload is empty; a very long one is written and read as one record, in memory. Rows that repeat the largest id of their group are all responses. A null
id is written as such, never wins, and comes back as null. An empty table makes no package. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.storage import new_path, staged

MIN_REVISIT = 1000
PACKAGE_BYTES = 32 << 20
RUN = 500
BROADCAST_ROWS = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"


# ---------------------------------------------------------------- records


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit carries headers only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers of a record (names in lower case) and its payload under ``payload``."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


# ---------------------------------------------------------------- packages


class PackageWriter:
    """Writes one package to ``uri``; the stream need not seek."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.stream = uri, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.offset, self.lines = 0, []

    def add(self, url: str, record: bytes, digest: str, kind: str) -> None:
        packed = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packed.compress(record) + packed.flush()
        self.data.write(member)
        entry = {"url": url, "digest": f"sha1:{digest}", "type": kind, "offset": self.offset, "length": len(member)}
        self.lines.append(json.dumps(entry, ensure_ascii=False))
        self.offset += len(member)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines).encode())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [DATA, INDEX]}))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.offset


class PackageReader:
    """Reads a ZIP package by range. ``source`` has ``size()``, ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = source
        self.members = self._directory()

    def range(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        got = self.source.read(n)
        if len(got) != n:
            raise ValueError(f"the file ends within a range of {n} bytes at {start}")
        return got

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Member name to (local header offset, size, method)."""
        size = self.source.size()
        tail_at = max(0, size - 65557)
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        locator = tail_at + at - 20
        if (entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and locator >= 0:
            mark, _, end64, _ = struct.unpack("<4sIQI", self.range(locator, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end = self.range(end64, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = struct.unpack("<QQQ", end[32:56])
        directory, members, p = self.range(start, length), {}, 0
        for _ in range(entries):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a central directory entry is broken")
            method, = struct.unpack("<H", directory[p + 10 : p + 12])
            packed, plain, name_n, extra_n, note_n = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
            offset, = struct.unpack("<I", directory[p + 42 : p + 46])
            name = directory[p + 46 : p + 46 + name_n].decode()
            extra = directory[p + 46 + name_n : p + 46 + name_n + extra_n]
            q = 0
            while q + 4 <= len(extra):
                tag, n = struct.unpack("<HH", extra[q : q + 4])
                if tag == 1:  # ZIP64: the fields that did not fit, in this order
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                q += 4 + n
            members[name] = (offset, packed, method)
            p += 46 + name_n + extra_n + note_n
        return members

    def locate(self, name: str) -> tuple[int, int]:
        """(offset of the bytes, size) of a stored member."""
        offset, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.range(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        name_n, extra_n = struct.unpack("<HH", head[26:30])
        return offset + 30 + name_n + extra_n, size

    def index(self) -> list[dict]:
        at, size = self.locate(INDEX)
        text = self.range(at, size).decode()
        return [json.loads(line) for line in text.split("\n")] if text else []

    def records(self, entries: list[dict]) -> Iterator[dict]:
        """The records of index entries, each read by its own range."""
        base, size = self.locate(DATA)
        for e in entries:
            if e["offset"] + e["length"] > size:
                raise ValueError("an index entry points beyond the archive")
            yield parse_record(zlib.decompress(self.range(base + e["offset"], e["length"]), 31))


def open_package(uri: str) -> PackageReader:
    system, path = pafs.FileSystem.from_uri(uri)
    return PackageReader(system.open_input_file(path))


def open_bytes(data: bytes) -> PackageReader:
    """A package held in memory."""
    return PackageReader(pa.BufferReader(data) if data else io.BytesIO(data))


# ---------------------------------------------------------------- operators


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("check", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest", "check")
    groups = large.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = staged(groups, "warc-groups")
    # Repeated payloads are broadcast up to a counted bound; beyond it adaptive execution splits hot ones.
    known = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    met = rows.join(known, ["digest", "check"], "left")
    other = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    return met.select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def write_packages(rows: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the rows of ``with_roles`` as packages; returns the manifest (uri, records, bytes), already stored."""
    folder = new_path(rows.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    folder = folder.replace("file:///", "file:/").replace("file:/", "file:///")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer = [], None
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b[c] for c in b.schema.names)):
                if writer is None:
                    writer = PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                to = refers_to.as_py()
                record = warc_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), to)
                writer.add(url.as_py(), record, digest.as_py(), "response" if to is None else "revisit")
                if writer.offset >= package_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string())] + [pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)],
            ["uri", "records", "bytes"],
        )

    return staged(rows.mapInArrow(write, "uri string, records long, bytes long"), "warc-manifest")


def read_packages(manifest: DataFrame, run: int = RUN) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    The payload's digest and length are computed from what was read; for a revisit, which has no payload of its
    own, they are what its header says of the full payload.
    """
    starts = F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(run))).alias("start")
    runs = manifest.filter("records > 0").select("uri", starts)
    n = max(1, min(runs.count(), 100_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b["uri"].to_pylist(), b["start"].to_pylist()):
                package = open_package(uri)
                out = []
                for r in package.records(package.index()[start : start + run]):
                    kind, body = r["warc-type"], r["payload"]
                    size, digest = int(r["warc-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"a payload of {uri} does not match its digest")
                    ids = [int(v) if (v := r.get(k, "").removeprefix("<urn:page:").rstrip(">")) else None for k in ("warc-record-id", "warc-refers-to")]
                    out.append((ids[0], r["warc-target-uri"], kind, size, digest, ids[1], body if kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], _COLUMNS)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return runs.repartition(n).mapInArrow(read, schema)


_COLUMNS = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
