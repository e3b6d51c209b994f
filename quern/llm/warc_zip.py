"""Web archives in ZIP packages: writing WARC records, and reading them back by ranges.

A package holds stored members only: archive/data.warc.gz, a gzip member for each record, and
indexes/index.cdxj, a line for each record with its place. The reader finds members through
the central directory (ZIP64 too), and fetches record ranges; it never unpacks an archive.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_path

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: A package is closed, and a ranged read of neighbouring records is cut, at about so many bytes.
PACKAGE, RANGE = 64 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Signatures of the ZIP format.
EOCD, LOCATOR64, EOCD64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
NO16, NO32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where, inner


# --- writing ---------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone, whose length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + escaped(url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{sha}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http if revisit else http + payload
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def escaped(url: str) -> str:
    """A URL without white space and control characters, which would end its line or field."""
    return "".join(c if c > " " and not c.isspace() and c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


class Package:
    """A ZIP package that is written front to back, so any output stream will do."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        where, inner = _open(self.path)
        where.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, url: str | None, raw: bytes, date: str) -> None:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = c.compress(raw) + c.flush()
        self.data.write(packed)
        self.lines.append(f"{escaped(url) if url else '-'} {date} {json.dumps({'offset': self.at, 'length': len(packed)})}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def mark_revisits(pages: DataFrame, salts: int = 64) -> DataFrame:
    """(page_id, url, payload, sha, refers_to): of equal payloads all but the least page_id's refer to that.

    Least ids are combined by task, then by (digest, salt), then by digest, and meet the rows
    by (digest, salt) again, so a payload of a third of all pages is dealt to many tasks.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("_d", F.unhex(F.sha2("payload", 256))).withColumn("_s", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    long = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    salted = long.groupBy("_d", "_s").agg(F.min("page_id").alias("_m"), F.count("*").alias("_c"))
    least = salted.groupBy("_d").agg(F.min("_m").alias("_first"), F.sum("_c").alias("_n"), F.collect_set("_s").alias("_ss")).where("_n > 1")
    least = least.select("_d", F.explode("_ss").alias("_s"), "_first")
    met = rows.join(least, ["_d", "_s"], "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return met.select("page_id", "url", "payload", F.lower(F.hex("_d")).alias("sha"), refers.alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns (path, n_records) of the packages.

    Each task writes packages of its own under new names, so a task that runs again leaves no
    half-written package among those returned. A null html is an empty payload. Rows that
    repeat the least page_id of a payload are all responses; a null page_id is never the least
    unless all are null, when all are responses.
    """

    def over(batches):
        done: list[tuple[str, int]] = []
        package = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                page_id, url, payload, sha, refers_to = row
                package = package or Package(folder)
                package.add(url, record(page_id, url, payload, sha, refers_to, date), date)
                if package.at >= PACKAGE:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n_records"])

    return materialise(mark_revisits(pages).mapInArrow(over, "path string, n_records bigint"), "packages")


# --- reading ---------------------------------------------------------------------------------


class Ranges:
    """Ranged reads of one file."""

    def __init__(self, path: str) -> None:
        where, inner = _open(path)
        self.f = where.open_input_file(inner)
        self.size = self.f.size()

    def read(self, at: int, n: int) -> bytes:
        got = self.f.read_at(n, at)
        if len(got) != n:
            raise ValueError(f"the file ends within bytes {at} to {at + n}")
        return got

    def close(self) -> None:
        self.f.close()


def _sizes64(extra: bytes, fields: list[int]) -> list[int]:
    """The fields of an entry, those that are all ones replaced from its ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, k = extra[at + 4 : at + 4 + n], 0
            for i, v in enumerate(fields):
                if v == NO32:
                    fields[i] = struct.unpack_from("<Q", body, k)[0]
                    k += 8
            break
        at += 4 + n
    return fields


def directory(r: Ranges) -> list[tuple[str, int, int, int, int]]:
    """(name, method, packed size, size, offset of the local header) of every member."""
    tail_at = max(0, r.size - (22 + NO16))
    tail = r.read(tail_at, r.size - tail_at)
    at = tail.rfind(EOCD)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    _, _, _, number, size, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    end = tail_at + at
    if end >= 20 and (locator := r.read(end - 20, 20))[:4] == LOCATOR64:
        wide = r.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if wide[:4] != EOCD64:
            raise ValueError("the ZIP64 locator does not lead to a ZIP64 record")
        number, size, start = struct.unpack_from("<QQQ", wide, 32)
    raw, at, out = r.read(start, size), 0, []
    while at + 46 <= len(raw) and raw[at : at + 4] == CENTRAL:
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, offset = _sizes64(raw[at + 46 + n_name : at + 46 + n_name + n_extra], [full, packed, offset])
        out.append((name, method, packed, full, offset))
        at += 46 + n_name + n_extra + n_note
    if len(out) != number:
        raise ValueError(f"the central directory lists {len(out)} members, its end record {number}")
    return out


def stored_at(r: Ranges, member: tuple[str, int, int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many they are."""
    name, method, packed, full, offset = member
    if method != 0 or packed != full:
        raise ValueError(f"{name} is not stored, so its records can't be read by range")
    head = r.read(offset, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return offset + 30 + n_name + n_extra, full


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for line in head.decode("utf-8").split("\r\n")[1:] for k, _, v in [line.partition(":")] if k}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def read_records(path: str) -> Iterator[tuple]:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record of a package."""
    r = Ranges(path)
    try:
        members = {m[0]: m for m in directory(r)}
        start, size = stored_at(r, members[DATA])
        index_at, index_size = stored_at(r, members[INDEX])
        places = [(e["offset"], e["length"]) for line in r.read(index_at, index_size).split(b"\n") if line for e in [json.loads(line.split(b" ", 2)[2])]]
        k = 0
        while k < len(places):
            first, n = k, 0
            while k < len(places) and places[k][0] == places[first][0] + n and (not n or n + places[k][1] <= RANGE):
                n += places[k][1]
                k += 1
            if places[first][0] + n > size:
                raise ValueError("the index points beyond its archive")
            piece = r.read(start + places[first][0], n)
            for offset, length in places[first:k]:
                raw = piece[offset - places[first][0] : offset - places[first][0] + length]
                warc, http, payload = parse(zlib.decompress(raw, 31))
                revisit = warc["warc-type"] == "revisit"
                told = warc["warc-payload-digest"].partition(":")[2]
                if not revisit and hashlib.sha256(payload).hexdigest() != told:
                    raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")
                yield _page(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], _page(warc.get("warc-refers-to")), int(http["content-length"]), told, None if revisit else payload
    finally:
        r.close()


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the packages at packages.path; the payload itself only on demand.

    A package is read by one task, record range by record range; packages are dealt out evenly.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    if not payloads:
        schema = schema.remove(6)

    def over(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for row in read_records(path):
                    rows.append(row[: len(schema)])
                    size += row[4] if payloads else 100
                    if size >= RANGE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * payloads
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(n).mapInArrow(over, kinds)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to packages in the shared scratch folder and reads their records back."""
    return read_packages(write_packages(pages, scratch_path(pages.sparkSession, "wacz")))
