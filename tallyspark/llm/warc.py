"""WARC records in ZIP packages: tasks write stored members and indexes, others range-read records from them.

A package is a ZIP file of stored members: ``archive/*.warc.gz`` with one gzip member per record, and
``indexes/*.cdxj`` with a line per record. Readers parse the end record, its ZIP64 form and the central directory,
find where a member's bytes begin, and read just the ranges that the index names; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import scratch
from tallyspark.llm.batches import sliced

#: Bytes of compressed records in a package before the next one is begun.
PACKAGE_BYTES = 64 << 20
#: Revisits go to every task only up to so many rows (some 100 bytes each); beyond it pages are joined with them.
MAX_BROADCAST_ROWS = 500_000
#: Records in a range of the index, and bytes of neighbouring records that are read at once.
RANGE, READ_BYTES = 1000, 1 << 20
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_NEW_LINES = b"\r\n\r\n"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_at: int


# ---------------------------------------------------------------- packages


class PackageWriter:
    """Writes stored members one after another to a stream; sizes are known once a member ends."""

    def __init__(self, out: Any, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Write a member; returns where its bytes begin."""
        raw, crc, begin = name.encode(), zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if self.zip64 or len(data) >= 0xFFFFFFFF else b""
        size = 0xFFFFFFFF if extra else len(data)
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if extra else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        data_at = self.at
        self._put(data)
        self.entries.append((raw, crc, len(data), begin))
        return data_at

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, header_at in self.entries:
            wide = self.zip64 or size >= 0xFFFFFFFF or header_at >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header_at) if wide else b""
            size, header_at = (0xFFFFFFFF, 0xFFFFFFFF) if wide else (size, header_at)
            self._put(_ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, header_at) + raw + extra)
        length, n = self.at - begin, len(self.entries)
        if self.zip64 or n >= 0xFFFF or begin >= 0xFFFFFFFF or length >= 0xFFFFFFFF:
            end64 = self.at
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, begin) + _LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, length, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, n, n, length, begin, 0))


class PackageReader:
    """Finds members of a random-access file through its central directory."""

    def __init__(self, file: Any):
        self.file = file
        end = file.size()
        tail = self.read(max(0, end - 65557), min(end, 65557))
        at = tail.rfind(_END)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        n, _, length, begin = struct.unpack_from("<HHII", tail, at + 8)
        locator = tail[at - 20 : at] if at >= 20 else b""
        if locator[:4] == _LOCATOR64:
            (where,) = struct.unpack_from("<Q", locator, 8)
            wide = self.read(where, 56)
            if wide[:4] != _END64:
                raise ValueError("damaged ZIP64 end record")
            _, n, length, begin = struct.unpack_from("<QQQQ", wide, 24)
        self.members = self._entries(self.read(begin, length), n)

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _entries(self, raw: bytes, n: int) -> dict[str, Member]:
        found, at = {}, 0
        for _ in range(n):
            if raw[at : at + 4] != _ENTRY:
                raise ValueError("damaged central directory")
            method, packed, size, name_n, extra_n, comment_n, header_at = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<II", raw, at + 20), *struct.unpack_from("<HHH", raw, at + 28), *struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + name_n].decode()
            extra = raw[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                tag, m = struct.unpack_from("<HH", extra)
                if tag == 1:
                    values = iter(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header_at = next(values) if header_at == 0xFFFFFFFF else header_at
                extra = extra[4 + m :]
            found[name] = Member(name, method, size, header_at)
            at += 46 + name_n + extra_n + comment_n
        return found

    def data_at(self, member: Member) -> int:
        """Where a stored member's bytes begin; its local header's name and extra field can differ in length."""
        if member.method:
            raise ValueError(f"{member.name} is compressed: only stored members allow range reads")
        head = self.read(member.header_at, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"{member.name} has no local header")
        return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


# ---------------------------------------------------------------- records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + _NEW_LINES
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + json.dumps(url)[1:-1])
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _NEW_LINES + block + _NEW_LINES


def parse(raw: bytes) -> dict[str, Any]:
    """Headers and block of one record; what a reader derives from them."""
    head, _, rest = raw.partition(_NEW_LINES)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != _NEW_LINES or len(block) != int(headers["content-length"]):
        raise ValueError("record cut short")
    http, _, payload = block.partition(_NEW_LINES)
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])}
    named = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and digest(payload) != named:
        raise ValueError("payload differs from its digest")
    page, target = headers["warc-record-id"][10:-1], headers.get("warc-refers-to", "")[10:-1]
    return {
        "page_id": int(page) if page else None,
        "url": json.loads(f'"{headers["warc-target-uri"]}"') if "warc-target-uri" in headers else None,
        "record_type": headers["warc-type"],
        "refers_to": int(target) if target else None,
        "payload_digest": named,
        "payload_bytes": int(fields["content-length"]),
        "payload": payload if headers["warc-type"] == "response" else None,
    }


# ---------------------------------------------------------------- Spark


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha1 (hex, of the payload) and refers_to of pages whose payload another page with a larger id has, if
    it has least_bytes."""
    payload = F.coalesce("html", F.lit(""))
    found = pages.where("page_id is not null").select("page_id", F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("n"))
    found = scratch.stage(found.where(F.col("n") >= least_bytes).select("page_id", "sha1").distinct(), "digests")
    owners = found.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("refers_to > least").drop("least")
    # Written, so that the join has shuffles of its own and a hot payload can be split.
    return found.join(scratch.stage(owners, "owners"), "sha1").where("page_id < refers_to").select("page_id", "sha1", "refers_to")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, max_broadcast_rows: int = MAX_BROADCAST_ROWS, zip64: bool = False) -> DataFrame:
    """Write every page (page_id, url, html) as a record; returns the manifest: package, and a row for each range of its
    index with the range's first byte and length.

    ``folder`` must be shared. A task's packages carry its attempt in their names and are renamed when complete; the
    manifest names those of attempts that succeeded, so retries and speculative tasks leave nothing that is read.
    Null html is an empty payload, a null url is left out, pages without id are responses of their own, and repeated
    rows are repeated records. The page with the largest id among equal payloads is the response; a page_id that
    repeats with another html is judged by each payload for itself.
    """
    spark = pages.sparkSession
    again = scratch.stage(revisits(pages, least_bytes), "revisits")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1"))
    if (n := again.count()) <= max_broadcast_rows:
        again = F.broadcast(again) if n else again
    rows = rows.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        made, records, index, size = [], [], [], 0

        def flush() -> None:
            nonlocal size
            name = f"part-{task.partitionId():05d}-{len(made):04d}-{task.taskAttemptId()}"
            with store.open_output_stream(f"{base}/.{name}.tmp") as out:
                package = PackageWriter(out, zip64)
                package.add(f"archive/{name}.warc.gz", b"".join(records))
                package.add(f"indexes/{name}.cdxj", b"".join(index))
                package.close()
            store.move(f"{base}/.{name}.tmp", f"{base}/{name}.wacz")
            first = 0
            for at in range(0, len(index), RANGE):
                length = sum(map(len, index[at : at + RANGE]))
                made.append((f"{name}.wacz", first, length))
                first += length
            records.clear()
            index.clear()
            size = 0

        for batch in sliced(batches, 64):
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, url, payload, refers_to = page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = press.compress(record(page_id, url, payload, digest(payload), refers_to)) + press.flush()
                index.append((json.dumps({"page_id": page_id, "offset": size, "length": len(packed)}) + "\n").encode())
                records.append(packed)
                size += len(packed)
                if size >= package_bytes:
                    flush()
        if records:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["package", "first", "length"])

    return scratch.stage(rows.mapInArrow(write, "package string, first long, length long"), "manifest")


def read_packages(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the packages that the manifest names; ``payload`` only where asked for (null for revisits)."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for name, first, length in zip(*(batch[c].to_pylist() for c in ("package", "first", "length")), strict=True):
                with store.open_input_file(f"{base}/{name}") as file:
                    package = PackageReader(file)
                    archive = package.data_at(next(m for n, m in package.members.items() if n.startswith("archive/")))
                    index = package.data_at(next(m for n, m in package.members.items() if n.startswith("indexes/")))
                    lines = [json.loads(x) for x in package.read(index + first, length).decode().splitlines()]
                    for raws in _neighbours(package, archive, lines):
                        rows = [parse(zlib.decompress(raw, 31)) for raw in raws]
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names)

    # A package is read in ranges of its index, so one large package is not one task.
    spark: SparkSession = manifest.sparkSession
    return manifest.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "package", "first").mapInArrow(read, schema)


def _neighbours(package: PackageReader, archive: int, lines: list[dict[str, Any]]) -> Iterator[list[bytes]]:
    """The packed records that index lines name; those that stand side by side come by one read of READ_BYTES or so."""
    at = 0
    while at < len(lines):
        begin, end, n = lines[at]["offset"], lines[at]["offset"] + lines[at]["length"], at + 1
        while n < len(lines) and lines[n]["offset"] == end and end - begin < READ_BYTES:
            end += lines[n]["length"]
            n += 1
        raw = package.read(archive + begin, end - begin)
        yield [raw[x["offset"] - begin : x["offset"] - begin + x["length"]] for x in lines[at:n]]
        at = n
