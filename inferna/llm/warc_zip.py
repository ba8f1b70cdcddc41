"""WARC records in ZIP packages: writer, and a reader that extracts nothing.

A package holds members in pairs, all stored (not deflated): a gzip-by-record
WARC file ``archive/data-N.warc.gz`` and its index ``indexes/data-N.cdxj`` with
one JSON line for each record (offset and length inside the member, type, id).
The reader range-reads the end of each package, parses the central directory
(ZIP64 records too), range-reads the index members, and then range-reads the
records, blocks of them dealt out over tasks.  No member is unpacked to disk or
held whole; memory holds one directory, one index or one record.

Paths go through ``pyarrow.fs``, so packages can lie in any store it knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferna.llm.common import row_key, shared_dir, stage

# Fixed values of the ZIP format: signatures, marks for "see the ZIP64 record".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
DATE = "1970-01-01T00:00:00Z"
MEMBER_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20


def open_store(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class PackageWriter:
    """Writes stored members one after another to an output stream."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start, big = name.encode(), zlib.crc32(data), self.at, self.zip64 or len(data) >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = FULL32 if big else len(data)
        self._put(LOCAL + struct.pack("<5H3I2H", 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            wide = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            s, a = (FULL32, FULL32) if wide else (size, at)
            self._put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, s, s,
                                            len(raw), len(extra), 0, 0, 0, 0, a) + raw + extra)
        n, length = len(self.members), self.at - start
        if self.zip64 or n >= FULL16 or start >= FULL32 or length >= FULL32:
            end64 = self.at
            self._put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, length, start = FULL16, FULL32, FULL32
        self._put(END + struct.pack("<4H2IH", 0, 0, n, n, length, start, 0))


def directory(f, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, first data byte, stored bytes) of each member, from the central directory."""
    tail_at = max(0, size - 22 - 65535)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", tail[at + 10:at + 20])
    if (n == FULL16 or length == FULL32 or start == FULL32) and at + tail_at >= 20:
        f.seek(tail_at + at - 20)
        locator = f.read(20)
        if locator[:4] == LOCATOR64:
            f.seek(struct.unpack("<Q", locator[8:16])[0])
            _, length, start = struct.unpack("<QQQ", f.read(56)[32:56])
    f.seek(start)
    data, at = f.read(length), 0
    while data[at:at + 4] == CENTRAL:
        method, = struct.unpack("<H", data[at + 10:at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[at + 20:at + 34])
        header, = struct.unpack("<I", data[at + 42:at + 46])
        name = data[at + 46:at + 46 + n_name]
        extra, e = data[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, size_e = struct.unpack("<HH", extra[e:e + 4])
            if tag == 1:  # only the fields that are full above are there, in this order
                wide = iter(struct.unpack(f"<{size_e // 8}Q", extra[e + 4:e + 4 + size_e // 8 * 8]))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            e += 4 + size_e
        f.seek(header + 26)
        n_local, n_local_extra = struct.unpack("<HH", f.read(4))
        yield name.decode("utf-8", "replace"), method, header + 30 + n_local + n_local_extra, packed
        at += 46 + n_name + n_extra + n_comment


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> bytes:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value).encode()


def warc_record(kind: str, key, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone, with the digest of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(key).encode(),
            b"WARC-Date: " + DATE.encode(), b"WARC-Payload-Digest: sha1:" + b32(payload).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _field(url))
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to,
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of a plain record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in
              (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def record_types(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """Distinct (row key, record_type, refers_to), from digests alone: no payload is shuffled."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(*row_key(key, payload), F.col(key).alias("id"),
                        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    best = rows.groupBy("digest", "n").agg(F.max("id").alias("best"))
    return (rows.join(best, ["digest", "n"])
            .withColumn("again", (F.col("n") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("best")))
            .select("_k1", "_k2", F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
                    F.when(F.col("again"), F.col("best")).alias("refers_to")).distinct())


def write_packages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = 0, zip64: bool = False) -> DataFrame:
    """Write one package for each partition into ``folder``; returns the written table (path, records).

    Of records with equal payloads of at least ``min_bytes`` bytes that with
    the largest key is ``response``, others are ``revisit``.  Null payloads are
    empty; a null key counts as smaller than any; equal rows are written again,
    equal rows with the largest key all as responses.  A failed or repeated task
    leaves a package that the returned table doesn't name.
    """
    t = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{payload}`").alias("body"))
    rows = t.select("*", *row_key("id", "body")).join(record_types(t, "id", "body", min_bytes), ["_k1", "_k2"]).drop("_k1", "_k2")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = path = out = package = None
        data, index, n, k = bytearray(), [], 0, 0

        def flush():
            nonlocal data, index, k
            package.add(f"archive/data-{k:05d}.warc.gz", bytes(data))
            package.add(f"indexes/data-{k:05d}.cdxj", "\n".join(index).encode())
            data, index, k = bytearray(), [], k + 1

        for batch in batches:
            for row in batch.to_pylist():
                if package is None:
                    store, base = open_store(folder)
                    store.create_dir(base, recursive=True)
                    path = f"part-{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                    package = PackageWriter(out, zip64)
                packed = gzip.compress(warc_record(row["record_type"], row["id"], row["url"], (row["body"] or "").encode(),
                                                   row["refers_to"]), 5, mtime=0)
                index.append(json.dumps({"offset": len(data), "length": len(packed), "id": row["id"], "type": row["record_type"]}))
                data += packed
                n += 1
                if len(data) >= MEMBER_BYTES:
                    flush()
        if package is not None:
            if index:
                flush()
            package.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": pa.array([n], pa.int64())})

    return stage(rows.mapInArrow(write, "path string, records long"), "warc-manifest")


def locate_records(packages: DataFrame) -> DataFrame:
    """(path, offset, length) of every record: directories first, then the index members, by range reads."""
    def members(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, p = open_store(path)
                with store.open_input_file(p) as f:
                    found = list(directory(f, f.size()))
                at = {name: (start, size) for name, method, start, size in found if method == 0}
                if gone := [x[0] for x in found if x[0].startswith(("archive/", "indexes/")) and x[0] not in at]:
                    raise ValueError(f"{path}: members must be stored, not deflated: {gone[:3]}")
                names = [n for n in at if n.startswith("archive/")]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([path] * len(names), pa.string()), "start": pa.array([at[n][0] for n in names], pa.int64()),
                    "size": pa.array([at[n][1] for n in names], pa.int64()),
                    "index_start": pa.array([at.get(_index_of(n), (None, 0))[0] for n in names], pa.int64()),
                    "index_size": pa.array([at.get(_index_of(n), (0, 0))[1] for n in names], pa.int64())})

    def records(batches):
        for batch in batches:
            for m in batch.to_pylist():
                store, p = open_store(m["path"])
                with store.open_input_file(p) as f:
                    if m["index_start"] is None:
                        spans = scan_member(f, m["start"], m["size"])
                    else:
                        f.seek(m["index_start"])
                        lines = map(json.loads, f.read(m["index_size"]).splitlines())
                        spans = [(m["start"] + x["offset"], x["length"]) for x in lines]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([m["path"]] * len(spans), pa.string()),
                    "offset": pa.array([s[0] for s in spans], pa.int64()), "length": pa.array([s[1] for s in spans], pa.int64())})

    found = packages.select("path").repartition("path").mapInArrow(
        members, "path string, start long, size long, index_start long, index_size long")
    return found.repartition("path", "start").mapInArrow(records, "path string, offset long, length long")


def _index_of(name: str) -> str:
    return name.replace("archive/", "indexes/", 1).removesuffix(".warc.gz") + ".cdxj"


def scan_member(f, start: int, size: int) -> list[tuple[int, int]]:
    """Record spans of a member without index: its gzip members, found by unpacking block after block."""
    spans, at, end, first = [], start, start + size, start
    f.seek(start)
    unpack = zlib.decompressobj(31)
    while at < end:
        block = f.read(min(1 << 16, end - at))
        at += len(block)
        while block:
            unpack.decompress(block)
            if not unpack.eof:
                break
            block, stop = unpack.unused_data, at - len(unpack.unused_data)
            spans.append((first, stop - first))
            first, unpack = stop, zlib.decompressobj(31)
    return spans


def read_records(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """(path, offset, record_id, record_type, url, refers_to_id, payload_digest, payload) of every record.

    Located records are dealt out in blocks of neighbouring bytes, so that one
    large package is read by many tasks.
    """
    def read(batches):
        cols = ("path", "offset", "record_id", "record_type", "url", "refers_to_id", "payload_digest", "payload")
        for batch in batches:
            store = f = path = None
            rows = sorted(batch.to_pylist(), key=lambda r: (r["path"], r["offset"]))
            out, held = [], 0
            for r in rows:
                if r["path"] != path:
                    if f is not None:
                        f.close()
                    path = r["path"]
                    store, p = open_store(path)
                    f = store.open_input_file(p)
                f.seek(r["offset"])
                fields, payload = parse_record(gzip.decompress(f.read(r["length"])))
                out.append((path, r["offset"], fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"),
                            fields.get("warc-refers-to"), fields["warc-payload-digest"].removeprefix("sha1:"), payload))
                held += len(payload)
                if held > BLOCK_BYTES:
                    yield _records(cols, out)
                    out, held = [], 0
            if f is not None:
                f.close()
            if out:
                yield _records(cols, out)

    block = F.floor(F.col("offset") / BLOCK_BYTES)
    return (locate_records(packages).repartition("path", block)
            .mapInArrow(read, "path string, offset long, record_id string, record_type string, url string, "
                              "refers_to_id string, payload_digest string, payload binary"))


def _records(cols, out):
    kinds = dict(offset=pa.int64(), payload=pa.binary())
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], kinds.get(c, pa.string())) for i, c in enumerate(cols)})


def page_summary(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): digests of what was read.

    A response's size and digest come from its payload; a revisit's from the
    response that it refers to.  Raises if a payload doesn't have its digest.
    """
    def digests(batches):
        for b in batches:
            payload = b.column("payload").to_pylist()
            kinds, told = b.column("record_type").to_pylist(), b.column("payload_digest").to_pylist()
            got = [b32(p) if k == "response" else d for p, k, d in zip(payload, kinds, told)]
            if got != told:
                raise ValueError("a payload differs from its digest")
            yield pa.RecordBatch.from_pydict({"record_id": b.column("record_id"), "record_type": b.column("record_type"),
                                              "refers_to_id": b.column("refers_to_id"), "payload_digest": pa.array(got, pa.string()),
                                              "n": pa.array([len(p) for p in payload], pa.int64())})

    t = stage(records.mapInArrow(digests, "record_id string, record_type string, refers_to_id string, payload_digest string, n long"),
              "warc-read")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as long)")
    response = t.where("record_type = 'response'").groupBy(F.col("record_id").alias("to")).agg(F.max("n").alias("full"))
    return t.join(response, t["refers_to_id"] == response["to"], "left").select(
        number("record_id").alias("page_id"), F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.col("full")).alias("payload_bytes"),
        "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as packages in the shared folder, read them back, summarise each record."""
    spark = pages.sparkSession
    packages = write_packages(pages, shared_dir(spark, "warc"), key, url, payload)
    return page_summary(read_records(spark, packages))
