"""WARC records in ZIP packages, read by ranges of bytes.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz`` with one gzip member
per record, and ``indexes/index.cdx`` with a line of place and length for each record. The reader
takes the end of the file, the central directory (its ZIP64 form as well), the index, and then
the range of each record; nothing is extracted.

A null payload is empty. Payloads below ``least`` bytes are always responses. Of equal larger
payloads the smallest id is the response, rows that share this id included; the others, those with
a null id too, revisit it. If every id of a group is null, all are responses. A null address is
written as ``urn:page``. Further columns are not stored. An empty table gives packages without
records.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of a data member after which a task begins another package.
PACKAGE_BYTES = 64 << 20
#: Above these a ZIP needs its 64-bit fields.
MOST_32, MOST_16 = 0xFFFFFFFF, 0xFFFF


def decide(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages with digest and size of the payload, record type and the page referred to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


# ---------------------------------------------------------------- records

def record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit has no payload, only the digest and size of the full one."""
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}:{digest[:16]}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=SAFE) if url else 'urn:page'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {name}",
        f"X-Payload-Length: {size}",
    ]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}:{digest[:16]}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, lower-cased, and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---------------------------------------------------------------- packages

class PackageWriter:
    """Stored members written one behind the other; sizes go into data descriptors and the directory."""

    def __init__(self, sink, wide: bool = False) -> None:
        self.sink, self.at, self.members, self.wide = sink, 0, [], wide

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        raw = name.encode()
        # Bit 3: sizes follow the data. The extra field says that they have 64 bits.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, MOST_32, MOST_32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> int:
        """Append to the present member; gives the place in it."""
        member = self.members[-1]
        place = member[2]
        member[2] += len(data)
        member[3] = zlib.crc32(data, member[3])
        self.write(data)
        return place

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self.write(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, at, size, crc in self.members:
            large = self.wide or max(size, at) >= MOST_32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if large else b""
            s, a = (MOST_32, MOST_32) if large else (size, at)
            self.write(
                struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc, s, s, len(name), len(extra), 0, 0, 0, 0, a)
                + name + extra
            )
        length, n = self.at - start, len(self.members)
        if self.wide or start >= MOST_32:
            place = self.at
            self.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, start))
            self.write(struct.pack("<IIQI", 0x07064B50, 0, place, 1))
            self.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, MOST_16, MOST_16, MOST_32, MOST_32, 0))
        else:
            self.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, start, 0))
        self.sink.close()


class PackageReader:
    """Members of a ZIP file by name, read by range."""

    def __init__(self, source, size: int) -> None:
        self.source, self.size = source, size
        tail_at = max(0, size - 65_557)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of a central directory")
        n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if MOST_16 == n or MOST_32 in (length, start):
            (place,) = struct.unpack("<Q", self.range(tail_at + end - 20, 20)[8:16])
            n, length, start = struct.unpack("<QQQ", self.range(place, 56)[32:56])
        self.members = dict(self._directory(self.range(start, length), n))

    def range(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("a range ends behind the file")
        return data

    def _directory(self, data: bytes, n: int) -> Iterator[tuple[str, tuple[int, int]]]:
        at = 0
        for _ in range(n):
            method, = struct.unpack_from("<H", data, at + 10)
            packed, size, names, extras, comment = struct.unpack_from("<IIHHH", data, at + 20)
            (place,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + names].decode()
            extra, k = data[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, k)
                if kind == 1:  # 64-bit fields, only those that did not fit, in this order
                    values = iter(struct.unpack(f"<{length // 8}Q", extra[k + 4 : k + 4 + length // 8 * 8]))
                    size = next(values) if size == MOST_32 else size
                    packed = next(values) if packed == MOST_32 else packed
                    place = next(values) if place == MOST_32 else place
                k += 4 + length
            if method:
                raise ValueError(f"{name} is not stored")
            at += 46 + names + extras + comment
            yield name, (place, size)

    def member(self, name: str) -> tuple[int, int]:
        """Place of a member's first byte, and its size."""
        place, size = self.members[name]
        names, extras = struct.unpack("<HH", self.range(place + 26, 4))
        return place + 30 + names + extras, size


# ---------------------------------------------------------------- Spark

def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, wide: bool = False) -> DataFrame:
    """Write decided pages as packages below ``folder``; gives path, size and number of records of each.

    Each attempt of a task writes files of its own name, and only those of the attempt that
    succeeded are returned, so lost executors and repeated tasks leave no wrong record. Write the
    returned frame before it is used more than once: reading it writes the packages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        made, writer, lines, path = [], None, [], ""

        def finish() -> None:
            writer.end()
            writer.begin(INDEX)
            writer.add("".join(lines).encode())
            writer.end()
            writer.close()
            made.append((path, writer.at, len(lines)))

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.wacz"
                    writer, lines = PackageWriter(system.open_output_stream(path), wide), []
                    writer.begin(DATA)
                data = gzip_member(
                    record(
                        row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"],
                        row["record_type"], row["refers_to"],
                    )
                )
                lines.append(f"{writer.add(data)} {len(data)}\n")
                if writer.members[0][2] >= package_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pylist(
            [{"path": p, "size": s, "records": n} for p, s, n in made],
            pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]),
        )

    return pages.mapInArrow(run, "path string, size long, records long")


def read_packages(packages: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of the listed packages, one row each. ``payload`` adds the bytes of responses.

    Digest and size of a response are taken from its payload and must agree with its headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if payload else ""

    def number(value: str | None):
        return None if value in (None, "none") else int(value)

    def records(path: str, size: int) -> Iterator[dict]:
        system, _ = fs.FileSystem.from_uri(folder)
        with system.open_input_file(path) as source:
            package = PackageReader(source, size)
            base, _ = package.member(DATA)
            for line in package.range(*package.member(INDEX)).decode().splitlines():
                at, length = map(int, line.split())
                fields, body = parse(zlib.decompress(package.range(base + at, length), 31))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                count = int(fields["x-payload-length"])
                if kind == "response" and (count, digest) != (len(body), hashlib.sha256(body).hexdigest()):
                    raise ValueError(f"a payload in {path} does not agree with its headers")
                yield {
                    "page_id": number(fields["x-page-id"]), "payload_bytes": count, "payload_digest": digest,
                    "record_type": kind, "refers_to": number(fields.get("x-refers-to-page-id")),
                } | ({"payload": body if kind == "response" else None} if payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        arrow += [("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for found in records(row["path"], row["size"]):
                    rows.append(found)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(arrow))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, pa.schema(arrow))

    return packages.mapInArrow(run, schema)
