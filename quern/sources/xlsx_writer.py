"""Writes a DataFrame as one sheet of a workbook: tasks pack rows, the commit joins their parts.

A deflate stream may be cut where its writer flushes, so each task packs its rows on its own
and the parts follow each other in one member. The driver copies packed bytes and never sees a row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from .xlsx import package_members, row_xml

#: Fixed value: the rows that a sheet can have, with its header.
MOST_ROWS = 1_048_576
SHEET = "xl/worksheets/sheet1.xml"
PIECE = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    index: int
    path: str
    rows: int
    crc: int
    size: int


def _times(rows: list[int], v: int) -> int:
    out = 0
    for k, r in enumerate(rows):
        if v >> k & 1:
            out ^= r
    return out


def joined_crc(a: int, b: int, b_size: int) -> int:
    """CRC-32 of two texts one after the other, from theirs: a goes through as many zero bytes as b has."""
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):  # one zero byte
        step = [_times(step, r) for r in step]
    while b_size:
        if b_size & 1:
            a = _times(step, a)
        step, b_size = [_times(step, r) for r in step], b_size >> 1
    return a ^ b


class Packer:
    """A raw deflate stream that can be followed by another, with the sum and size of what went in."""

    def __init__(self) -> None:
        self.z, self.crc, self.size = zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0

    def add(self, text: bytes) -> bytes:
        self.crc, self.size = zlib.crc32(text, self.crc), self.size + len(text)
        return self.z.compress(text)

    def flushed(self, last: bool = False) -> bytes:
        return self.z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


class XlsxWriter(DataSourceWriter):
    """path is a local path or a URI that pyarrow's file systems reach from driver and executors."""

    def __init__(self, path: str, sheet: str, names: list[str], overwrite: bool) -> None:
        self.path, self.sheet, self.names, self.overwrite = path, sheet, names, overwrite
        self.parts = f"{path}-parts-{uuid.uuid4().hex}"
        if not overwrite and self._exists():
            raise FileExistsError(path)

    def _at(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def _exists(self) -> bool:
        files, inner = self._at(self.path)
        return files.get_file_info(inner).type.name == "File"

    def write(self, iterator: Iterator[Row]) -> Part:
        at = TaskContext.get()
        # Attempts of one task write different files; only the committed one is joined.
        path = f"{self.parts}/{at.partitionId()}-{at.taskAttemptId()}"
        files, inner = self._at(path)
        files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        packer, rows = Packer(), 0
        with files.open_output_stream(inner) as out:
            for row in iterator:
                out.write(packer.add(row_xml(row).encode()))
                rows += 1
            out.write(packer.flushed())
        return Part(at.partitionId(), path, rows, packer.crc, packer.size)

    def commit(self, messages: list[Part]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.index)
        if (n := sum(p.rows for p in parts) + 1) > MOST_ROWS:
            self.abort(messages)
            raise ValueError(f"{n} rows with the header are more than a sheet can have ({MOST_ROWS})")
        files, inner = self._at(self.path)
        directory, at = [], 0
        with files.open_output_stream(inner) as out:
            for name, text in package_members([self.sheet]):
                packer = Packer()
                body = packer.add(text.encode()) + packer.flushed(last=True)
                at = self._member(out, directory, at, name, [body], packer.crc, packer.size, len(body))
            head, tail = Packer(), Packer()
            first = head.add(sheet_head().encode()) + head.add(row_xml(self.names).encode()) + head.flushed()
            last = tail.add(b"</sheetData></worksheet>") + tail.flushed(last=True)
            crc, size, packed = head.crc, head.size, len(first) + len(last)
            for p in parts:
                crc, size = joined_crc(crc, p.crc, p.size), size + p.size
                packed += self._at(p.path)[0].get_file_info(self._at(p.path)[1]).size
            crc, size = joined_crc(crc, tail.crc, tail.size), size + tail.size
            at = self._member(out, directory, at, SHEET, self._pieces(first, parts, last), crc, size, packed)
            central = b"".join(directory)
            out.write(central + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, len(directory), len(directory), len(central), at, 0))
        self._remove()

    def _pieces(self, first: bytes, parts: list[Part], last: bytes) -> Iterator[bytes]:
        yield first
        for p in parts:
            files, inner = self._at(p.path)
            with files.open_input_stream(inner) as f:
                while piece := f.read(PIECE):
                    yield piece
        yield last

    def _member(self, out, directory: list[bytes], at: int, name: str, pieces, crc: int, size: int, packed: int) -> int:
        """Writes a member whose sum and sizes are known, and its entry; returns where the next begins."""
        if max(size, packed, at) >= 0xFFFFFFFF:
            raise ValueError("the workbook is larger than 4 GB")
        fields = struct.pack("<5H3I2H", 20, 0x800, 8, 0, 0x21, crc, packed, size, len(name), 0)
        out.write(b"PK\x03\x04" + fields + name.encode())
        for piece in pieces:
            out.write(piece)
        directory.append(b"PK\x01\x02" + struct.pack("<H", 20) + fields + struct.pack("<3H2I", 0, 0, 0, 0, at) + name.encode())
        return at + 30 + len(name) + packed

    def abort(self, messages) -> None:
        self._remove()

    def _remove(self) -> None:
        files, inner = self._at(self.parts)
        if files.get_file_info(inner).type.name == "Directory":
            files.delete_dir(inner)


def sheet_head() -> str:
    from .cells import MAIN

    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'
