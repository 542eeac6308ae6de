"""WARC records in ZIP packages: writer, directory parser and range reader.

A package holds stored (uncompressed) members ``archive/data.warc.gz`` (each
record a gzip member of its own) and ``indexes/index.cdxj`` (a line for each
record: its key, its time and JSON with file name, offset and length).  A reader opens a
package by its end record (the last signature whose comment reaches the end of the file), goes on
through the ZIP64 end record where there is one, parses the central directory
with ZIP64 extra fields and finds the data of all stored members ``archive/*.warc.gz`` behind their local
headers.  It reads every index ``indexes/*.cdxj`` or ``*.cdx``, gzipped or deflated too, and then single
records of the members they name by their byte ranges; nothing is extracted.  A record that
several indexes name is read once; members of other names are left alone.

Of records with equal payloads of at least ``least`` bytes, the one of the
smallest id is the response and the others are revisits of it; smaller ones are
all responses.  Packages lie in the shared folder; a task writes under a name of
its own attempt and moves the file in place, so that a repeated task replaces it.

Null html is an empty payload, null urls are written empty.  Repeated rows of the
smallest id are all responses, of other ids all revisits.  Records without id are
written and read back with a null id; they refer to the smallest id where one has
their payload, else they are responses.  An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.llm.common import cut, shared_dir, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
TIME = "20240101000000"  # pages carry none
PACKAGE_BYTES = 32 << 20
PACKAGES_A_TASK = 8
DEFLATED = 8

# Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def zip_package(members: list[tuple[str, bytes]], zip64: bool = True) -> list[bytes]:
    """Parts of a ZIP of stored members, with ZIP64 fields or without."""
    parts, central, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if zip64 else b""
        size = MAX32 if zip64 else len(data)
        head = struct.pack("<IHHHHHIIIHH", LOCAL, 45 if zip64 else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if zip64 else b""
        central.append(
            struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45 if zip64 else 20, 45 if zip64 else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(more), 0, 0, 0, 0, MAX32 if zip64 else at)
            + raw
            + more
        )
        parts += [head, data]
        at += len(head) + len(data)
    directory = b"".join(central)
    parts.append(directory)
    if zip64:
        parts.append(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at))
        parts.append(struct.pack("<IIQI", LOCATOR64, 0, at + len(directory), 1))
        parts.append(struct.pack("<IHHHHIIH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
    else:
        parts.append(struct.pack("<IHHHHIIH", END, 0, 0, len(members), len(members), len(directory), at, 0))
    return parts


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Name to (data offset, length, method) of a ZIP; ``read(offset, length)`` is a range read."""
    tail_at = max(0, size - 22 - MAX16)
    tail = read(tail_at, size - tail_at)
    sign, end = struct.pack("<I", END), len(tail)
    while True:
        end = tail.rfind(sign, 0, end + 3) if end else -1
        if end < 0:
            raise ValueError("no end of central directory")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if (count == MAX16 or length == MAX32 or start == MAX32) and locator >= 0:
        sign, _, at64, _ = struct.unpack("<IIQI", read(locator, 20))
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sign, *_, count, length, start = struct.unpack("<IQHHIIQQQQ", read(at64, 56))
        if sign != END64:
            raise ValueError("no ZIP64 end record")
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        sign, *_, method, _, _, _, packed, plain, n, m, c, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if sign != CENTRAL:
            raise ValueError("broken central directory")
        name, extra = directory[at + 46 : at + 46 + n].decode(), directory[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == MAX32 else plain
                packed = wide.pop(0) if packed == MAX32 else packed
                local = wide.pop(0) if local == MAX32 else local
            extra = extra[4 + width :]
        head = read(local, 30)
        if struct.unpack_from("<I", head)[0] != LOCAL:
            raise ValueError("broken local header")
        found[name] = local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, method
        at += 46 + n + m + c
    return found


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(row: dict) -> bytes:
    payload = (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    first = row["first"]
    block = http if first is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Target-URI: {(row['url'] or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _surt(url: str) -> str:
    """Key of an index line: the host's labels from the last to the first, and the rest."""
    rest = url.partition("://")[2]
    host, slash, path = rest.partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")/" + path if host else "-"
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key)


def _writer(root: str):
    def write(batches):
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        task, packages = TaskContext.get().partitionId(), 0
        records, size, lines = [], 0, []

        def close():
            nonlocal records, size, lines, packages
            name, spare = f"{base}/part-{task:05d}-{packages:05d}.zip", f"{base}/.part-{uuid.uuid4().hex}"
            with fs.open_output_stream(spare) as out:
                for part in zip_package([(DATA, b"".join(records)), (INDEX, "".join(lines).encode())]):
                    out.write(part)
            fs.move(spare, name)
            done = pa.RecordBatch.from_pydict({"package": [f"{root}/part-{task:05d}-{packages:05d}.zip"], "n": pa.array([len(records)], pa.int64())})
            records, size, lines, packages = [], 0, [], packages + 1
            return done

        for batch in batches:
            for row in batch.to_pylist():
                raw = _record(row)
                place = {"url": row["url"] or "", "filename": DATA.rsplit("/", 1)[-1], "offset": str(size), "length": str(len(raw))}
                lines.append(f"{_surt(row['url'] or '')} {TIME} {json.dumps(place)}\n")
                records.append(raw)
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    yield close()
        if records:
            yield close()

    return write


def index_places(text: str) -> list[tuple[str, int, int]]:
    """(file, offset, length) of the lines of a CDXJ, or of a CDX whose head names its fields."""
    found, fields = [], None
    for line in text.splitlines():
        head, _, rest = line.partition("{")
        if line.lstrip().startswith("CDX"):
            fields = line.split()[1:]
        elif rest:
            said = json.loads("{" + rest)
            found.append((said["filename"], int(said["offset"]), int(said["length"])))
        elif fields and line.strip():
            said = dict(zip(fields, line.split(), strict=False))
            found.append((said["g"], int(said["V"]), int(said["S"])))
    return found


def _places(read, size: int) -> list[tuple[int, int]]:
    """(offset in the package, length) of every record that an index names."""
    held = members(read, size)
    archives = {name.rsplit("/", 1)[-1]: v for name, v in held.items() if name.startswith("archive/") and name.endswith((".warc", ".warc.gz"))}
    found = set()
    for name, (at, n, method) in held.items():
        if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdx", ".cdxj")):
            continue
        raw = read(at, n)
        if method == DEFLATED:
            raw = zlib.decompress(raw, -15)
        elif method:
            raise ValueError(f"{name}: unknown method {method}")
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        for file, offset, length in index_places(raw.decode()):
            start, whole, method = archives[file.rsplit("/", 1)[-1]]
            if method or offset + length > whole:
                raise ValueError(f"{file}: archives must be stored and hold the ranges that an index names")
            found.add((start + offset, length))
    return sorted(found)


def _indexer(batches):
    for batch in batches:
        for uri in batch.column("package").to_pylist():
            fs, path = _open(uri)
            with fs.open_input_file(path) as f:
                spots = _places(lambda at, n, f=f: f.read_at(n, at), f.size())
            yield pa.RecordBatch.from_pydict(
                {
                    "package": pa.array([uri] * len(spots), pa.string()),
                    "at": pa.array([s[0] for s in spots], pa.int64()),
                    "length": pa.array([s[1] for s in spots], pa.int64()),
                }
            )


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzip member."""
    text = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), "payload": payload}


def _page(name: str | None) -> int | None:
    said = (name or "")[len("<urn:page:") : -1]
    return int(said) if said else None


def _reader(batches):
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
        opened = None
        for uri, at, n in zip(*(batch.column(c).to_pylist() for c in ("package", "at", "length")), strict=True):
            if opened is None or opened[0] != uri:
                if opened:
                    opened[1].close()
                fs, path = _open(uri)
                opened = uri, fs.open_input_file(path)
            r = parse_record(opened[1].read_at(n, at))
            fields, size = r["fields"], int(r["http"]["Content-Length"])
            said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (len(r["payload"]) != size or _digest(r["payload"]) != said):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its headers")
            for c, v in zip(
                out,
                (_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), size, said, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), r["payload"]),
                strict=True,
            ):
                out[c].append(v)
        if opened:
            opened[1].close()
        long = ("page_id", "payload_bytes", "refers_to")
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64() if c in long else pa.binary() if c == "payload" else pa.string()) for c, v in out.items()})


def write_packages(pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages under ``root``; (package, n) of each."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("sum", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    big = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    first = rows.where(big).groupBy("sum").agg(F.min("page_id").alias("least"), F.count("*").alias("m")).where("m > 1 and least is not null").drop("m")
    marked = rows.join(first, "sum", "left").select(
        "page_id", "url", "html", F.when(big & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("first")
    )
    return cut(marked.mapInArrow(_writer(root), "package string, n bigint"))


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the packages, by byte range: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    spots = packages.select("package").mapInArrow(_indexer, "package string, at bigint, length bigint")
    shape = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    return spots.mapInArrow(_reader, shape)


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_packages(table(spark, sf_dir, "pages"), root)
    n = written.count()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // PACKAGES_A_TASK))
    return read_packages(written.repartition(tasks)).drop("payload", "url")


QUERIES = {"op6_warc_zip": op6_warc_zip}
ORACLE: dict[str, str] = {}
