"""Spreadsheets: validation, a batch data source with a partition for each sheet, and a writer."""

from __future__ import annotations

import math
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from itertools import chain
from pathlib import PurePosixPath
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from .cells import EPOCHS, MAIN, ROOT, Styles, cell, prefixed_rows, row_elements, shared_texts

#: Signatures, members and limits of the format check.
OLE2, ZIP, EMPTY_ZIP = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04", b"PK\x05\x06"
ENCRYPTED, MACROS, REQUIRED, WORKBOOKS = ("EncryptedPackage", "EncryptionInfo"), ("xl/vbaProject.bin",), ("[Content_Types].xml",), ("xl/workbook.xml", "xl/workbook.bin")
MOST_BYTES, MOST_RATIO, RATIO_FROM, UPLOAD_BYTES = 4 << 30, 200, 1 << 20, 150 << 20
#: Unpacked bytes of a sheet that a task parses.
SPLIT_BYTES = 64 << 20
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "sheet string, sheet_ix int, source_row bigint, cells array<struct<text:string,is_string:boolean>>"


#: The reasons that files are rejected for.
REASONS = (
    "unreadable_file",
    "empty_file",
    "encrypted_or_legacy_ole2_container",
    "empty_zip_archive",
    "not_a_zip_archive",
    "encrypted_ooxml_package",
    "macro_enabled_workbook",
    "missing_ooxml_content_types",
    "missing_workbook_part",
    "unsafe_member_path",
    "declared_uncompressed_size_exceeds_limit",
    "compression_ratio_exceeds_limit",
    "actual_uncompressed_size_exceeds_limit",
    "member_decompression_failed",
    "corrupt_zip_archive",
)
UNREADABLE, EMPTY, LEGACY, NO_MEMBERS, NO_ZIP, LOCKED, MACRO, NO_TYPES, NO_WORKBOOK, UNSAFE, DECLARED, RATIO, ACTUAL, BROKEN, CORRUPT = REASONS


class Rejected(ValueError):
    """A file that is not taken; reason names the rule."""

    def __init__(self, reason: str) -> None:
        super().__init__(reason)
        self.reason = reason


def validate(path: str, most_bytes: int = MOST_BYTES, most_ratio: float = MOST_RATIO) -> int:
    """The unpacked bytes of a workbook that passes all rules.

    Declared sizes can lie, so members are read too, block by block, which checks their sums. A
    missing file counts as empty.
    """
    try:
        with opened(path) as f:
            head = f.read(8)
    except FileNotFoundError:
        head = b""
    except OSError as e:
        raise Rejected(UNREADABLE) from e
    if not head:
        raise Rejected(EMPTY)
    for sign, reason in ((OLE2, LEGACY), (EMPTY_ZIP, NO_MEMBERS)):
        if head.startswith(sign):
            raise Rejected(reason)
    if not head.startswith(ZIP):
        raise Rejected(NO_ZIP)
    try:
        with opened(path) as file, zipfile.ZipFile(file) as z:
            names = set(z.namelist())
            tests = (
                (names & set(ENCRYPTED), LOCKED),
                (names & set(MACROS), MACRO),
                (set(REQUIRED) - names, NO_TYPES),
                (not names & set(WORKBOOKS), NO_WORKBOOK),
                (any(n.startswith("/") or ".." in PurePosixPath(n).parts for n in names), UNSAFE),
                (sum(i.file_size for i in z.infolist()) > most_bytes, DECLARED),
                (any(i.file_size >= RATIO_FROM and i.file_size > most_ratio * i.compress_size > 0 for i in z.infolist()), RATIO),
            )
            for hit, reason in tests:
                if hit:
                    raise Rejected(reason)
            total = 0
            for i in z.infolist():
                try:
                    with z.open(i) as member:
                        while piece := member.read(1 << 20):
                            total += len(piece)
                            if total > most_bytes:
                                raise Rejected(ACTUAL)
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError) as e:
                    raise Rejected(BROKEN) from e
            return total
    except zipfile.BadZipFile as e:
        raise Rejected(CORRUPT) from e
    except OSError as e:
        raise Rejected(UNREADABLE) from e


def accepted_uploads(files: DataFrame) -> DataFrame:
    """Of binaryFile rows those whose name, size and first bytes may be a workbook."""
    return files.where(F.lower("path").endswith(".xlsx") & F.col("length").between(1, UPLOAD_BYTES))


def file_ages(spark: SparkSession, path: str) -> DataFrame:
    """(key, last_modified, length) of the files below a path; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("key"), F.col("modificationTime").alias("last_modified"), "length")


# --- reading --------------------------------------------------------------------------------------


def opened(path: str):
    """A seekable file: a local path, or what pyarrow's file systems (HDFS, S3, GCS) reach by its URI, from any executor."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path if path.startswith("file://") else path.replace("file:", "file://", 1))
    return files.open_input_file(inner)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in X.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = targets[s.get(f"{REL}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(path: str, member: str, begin: int = 0, end: int = 1 << 62) -> Iterator[tuple[int, list[tuple[str | None, bool]]]]:
    """(sheet row, cells) of every row that has any, of those that start in a range of the sheet's unpacked bytes."""
    with opened(path) as file, zipfile.ZipFile(file) as z:
        shared = shared_texts(z)
        styles = Styles(z.read("xl/styles.xml") if "xl/styles.xml" in z.namelist() else None, z.read("xl/workbook.xml"))
        plain = _splits(z, member)
        if not plain and begin:
            return
        with z.open(member) as f:
            ahead = None
            for before, e in row_elements(f, begin, end) if plain else prefixed_rows(f):
                # A row without a number follows the one before it; the rows that were passed over have numbers if this one's first sibling has.
                at = int(e.get("r")) if e.get("r") else (before + 1 if ahead is None else ahead + 1)
                ahead = at
                cells: list[tuple[str | None, bool]] = []
                for c in e.iter(f"{MAIN}c"):
                    i = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [(None, False)] * (i - len(cells))
                    cells.append(cell(c, shared, styles))
                yield at, cells


def _splits(z: zipfile.ZipFile, member: str) -> bool:
    """Whether ranges of the sheet can be read: its tags have no prefix."""
    with z.open(member) as f:
        return bool(ROOT.search(f.read(1 << 16)))


def blank(cells: list[tuple[str | None, bool]]) -> bool:
    return not any(t is not None and t.strip() for t, _ in cells)


class SheetPartition(InputPartition):
    def __init__(self, index: int, name: str, member: str, begin: int, end: int) -> None:
        self.index, self.name, self.member, self.begin, self.end = index, name, member, begin, end


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, most_bytes: int, split_bytes: int, most_rows: int | None) -> None:
        self.path, self.sheet, self.most_bytes, self.split_bytes, self.most_rows = path, sheet, most_bytes, split_bytes, most_rows

    def partitions(self):
        validate(self.path, self.most_bytes)
        out = []
        with opened(self.path) as file, zipfile.ZipFile(file) as z:
            for i, (name, member) in enumerate(_sheets(z)):
                if self.sheet in (None, name):
                    # A scan that ends at a row reads on from the first, so it has one range.
                    step = self.split_bytes if self.most_rows is None and _splits(z, member) else 1 << 62
                    size = max(1, z.getinfo(member).file_size)
                    out += [SheetPartition(i, name, member, k, k + step if k + step < size else 1 << 62) for k in range(0, size, step)]
        if not out:
            raise ValueError(f"SHEET_NOT_FOUND: {self.sheet}")
        return out

    def read(self, partition):
        names = ["sheet", "sheet_ix", "source_row", "cells"]
        kind = pa.list_(pa.struct([("text", pa.string()), ("is_string", pa.bool_())]))
        held: list[tuple[int, list | None]] = []

        def batch():
            n = len(held)
            cells = [c and [{"text": t, "is_string": s} for t, s in c] for _, c in held]
            return pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array([partition.index] * n, pa.int32()), pa.array([r for r, _ in held], pa.int64()), pa.array(cells, kind)], names=names)

        seen = 0
        for at, cells in sheet_rows(self.path, partition.member, partition.begin, partition.end):
            if self.most_rows is not None and at > 1 and not blank(cells):
                if seen == self.most_rows:
                    held.append((at, None))
                    break
                seen += 1
            held.append((at, cells))
            if len(held) == 5000:
                yield batch()
                held = []
        if held:
            yield batch()


class XlsxSource(DataSource):
    """spark.read.format("xlsx").option("path", …)[.option("sheet", …)]: raw rows with their cells, the header row first.

    splitbytes is the size of the ranges of unpacked sheet that tasks parse; maxrows ends the
    scan of each sheet after so many rows that aren't blank, and a row without cells (null) then
    stands for the first row that was not read. df.write.format("xlsx") writes one sheet.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return XlsxReader(o["path"], o.get("sheet"), int(o.get("maxbytes", MOST_BYTES)), int(o.get("splitbytes", SPLIT_BYTES)), int(o["maxrows"]) if "maxrows" in o else None)

    def writer(self, schema, overwrite: bool):
        from .xlsx_writer import XlsxWriter

        return XlsxWriter(self.options["path"], self.options.get("sheet", "Sayfa1"), schema.names, overwrite)


def raw(spark: SparkSession, path: str, sheet: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx").option("path", path).options(**options)
    return (reader.option("sheet", sheet) if sheet is not None else reader).load()


def sheet_names(path: str) -> list[str]:
    with opened(path) as file, zipfile.ZipFile(file) as z:
        return [n for n, _ in _sheets(z)]


def headers(cells: list) -> list[str]:
    """Trimmed header names; a blank one is named by its place."""
    return [(c["text"] or "").strip() or f"Kolon {i}" for i, c in enumerate(cells, 1)]


def scan_end(rows: DataFrame) -> DataFrame:
    """(sheet, source_row): of each sheet whose scan ended at its cap, the first row that was not read."""
    return rows.where(F.col("cells").isNull()).select("sheet", "source_row")


def read_sheet(spark: SparkSession, path: str, sheet: str, with_kinds: bool = False, **options) -> DataFrame:
    """A sheet as a table of text columns with source_row; wholly blank rows are no rows.

    Columns are named by the first row, the first of equal names having it alone. Rows are
    padded to the widest, so a missing cell is an empty one. with_kinds adds the raw cells;
    options are the source's.
    """
    rows = raw(spark, path, sheet, **options).where(F.col("cells").isNotNull())
    head = rows.where("source_row = 1").select("cells").first()
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    names = headers(head.cells if head else [])
    names += [f"Kolon {i}" for i in range(len(names) + 1, width + 1)]
    body = rows.where("source_row > 1").where(F.exists("cells", lambda c: T.strip(c["text"]) != ""))
    seen: set[str] = set()
    cols = []
    for i, n in enumerate(names):
        if n not in seen:
            cols.append(F.get("cells", F.lit(i))["text"].alias(n))
            seen.add(n)
    return body.select("source_row", *cols, *(["cells"] if with_kinds else []))


# --- writing --------------------------------------------------------------------------------------


def _ref(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


#: The style of dates in workbooks that are written here, by its place among the cell styles.
DATE_STYLE = 1
STYLES = f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN[1:-1]}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>'


def _serial(value: date) -> str:
    """A moment as days since the calendar's first, to the millisecond."""
    since = (value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)) - EPOCHS[False]
    return repr(since.days + (since.seconds * 1000 + since.microseconds // 1000) / 86_400_000)


def _xml_cell(value, ref: str = "") -> str:
    """A cell; without a reference it stands next to the one before it."""
    at = f' r="{ref}"' if ref else ""
    if value is None:
        return "" if ref else "<c/>"
    if isinstance(value, bool):
        return f'<c{at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, date):
        return f'<c{at} s="{DATE_STYLE}"><v>{_serial(value)}</v></c>'
    if isinstance(value, int | float | Decimal) and math.isfinite(value):
        return f"<c{at}><v>{value}</v></c>"
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c{at} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def row_xml(values, number: int | None = None) -> str:
    """A row; without a number it follows the one before it."""
    if number is None:
        return "<row>" + "".join(map(_xml_cell, values)) + "</row>"
    return f'<row r="{number}">' + "".join(_xml_cell(v, f"{_ref(c)}{number}") for c, v in enumerate(values)) + "</row>"


def package_members(sheets: list[str]) -> list[tuple[str, str]]:
    """(name, text) of all members of a workbook but its sheets."""
    head, office = '<?xml version="1.0" encoding="UTF-8"?>', REL[1:-1]
    package, kinds = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = "".join(f'<Override PartName="/xl/{n}" ContentType="{kinds}.{k}+xml"/>' for n, k in [("workbook.xml", "sheet.main"), ("styles.xml", "styles"), *((f"worksheets/sheet{i}.xml", "worksheet") for i in range(1, len(sheets) + 1))])
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="{office}/{k}" Target="{t}"/>' for i, (k, t) in enumerate([*(("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)), ("styles", "styles.xml")], 1))
    return [
        ("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'),
        ("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{rels}</Relationships>'),
        ("xl/styles.xml", STYLES),
    ]


def write_workbook(path: str, sheets: list[tuple[str, list[str], Iterator[tuple]]]) -> None:
    """Writes sheets (name, header, rows); rows stream, numbers and dates stay such. Text that a spreadsheet would run is the caller's to guard."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in package_members([n for n, _, _ in sheets]):
            z.writestr(name, text)
        for i, (_, header, rows) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                for r, row in enumerate(chain([header], rows), 1):
                    f.write(row_xml(row, r).encode())
                f.write(b"</sheetData></worksheet>")
