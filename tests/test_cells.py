"""What cells say, ranges of a sheet, the scan cap, and workbooks written by tasks."""

import io
import random
import zipfile
import zlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.sources import cells, xlsx, xlsx_writer

M = cells.MAIN[1:-1]


def book(path, rows, styles="", shared=(), workbook=""):
    members = dict(xlsx.package_members(["S"]))
    if styles:
        members["xl/styles.xml"] = f'<styleSheet xmlns="{M}">{styles}</styleSheet>'
    if workbook:
        members["xl/workbook.xml"] = members["xl/workbook.xml"].replace("<sheets>", workbook + "<sheets>")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in members.items():
            z.writestr(n, t)
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{M}" xmlns:x="urn:x"><sheetData>{rows}</sheetData><rowBreaks/></worksheet>')
    return str(path)


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="[$-41F]d mmm yyyy;@"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="172" formatCode="[h]:mm"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{k}"/>' for k in (0, 14, 170, 171, 172, 20, 46, 2)) + "</cellXfs>"


@pytest.mark.parametrize(
    ("xml", "text"),
    [
        ("<c><v>1.1000000000000001</v></c>", "1.1"),
        ("<c><v>1E3</v></c>", "1000.0"),
        ("<c><v>1000</v></c>", "1000"),
        ("<c><v>0.1</v></c>", "0.1"),
        ("<c><v>12345678901234567890</v></c>", "12345678901234567890"),
        ('<c s="1"><v>46000.5</v></c>', "2025-12-09 12:00:00"),
        ('<c s="1"><v>46000</v></c>', "2025-12-09 00:00:00"),
        ('<c s="2"><v>1</v></c>', "1900-01-01 00:00:00"),
        ('<c s="2"><v>61</v></c>', "1900-03-01 00:00:00"),
        ('<c s="3"><v>2.5</v></c>', "2.5"),
        ('<c s="4"><v>1.25</v></c>', "1 day, 6:00:00"),
        ('<c s="5"><v>0.75</v></c>', "18:00:00"),
        ('<c s="6"><v>0.5</v></c>', "12:00:00"),
        ('<c s="7"><v>3</v></c>', "3"),
        ('<c s="1"><v>1e12</v></c>', "#VALUE!"),
        ('<c s="99"><v>5</v></c>', "5"),
        ('<c t="b"><v>1</v></c>', "True"),
        ('<c t="e"><v>#N/A</v></c>', "#N/A"),
        ('<c t="str"><f>A1</f><v>kept</v></c>', "kept"),
        ('<c t="d"><v>2024-02-29T10:30:00</v></c>', "2024-02-29 10:30:00"),
        ('<c t="s"><v>0</v></c>', "東京"),
        ('<c t="s"><v>1</v></c>', "iki parça"),
        ('<c t="inlineStr"><is><t>a</t><rPh><t>b</t></rPh></is></c>', "a"),
        ('<c t="s"/>', None),
    ],
)
def test_cells_as_text(tmp_path, xml, text):
    shared = ["<t>東京</t><rPh sb='0' eb='2'><t>トウキョウ</t></rPh><phoneticPr/>", "<r><t>iki </t></r><r><rPr/><t>parça</t></r>"]
    path = book(tmp_path / "b.xlsx", f"<row>{xml}</row>", STYLES, shared)
    ((at, ((got, _),)),) = xlsx.sheet_rows(path, "xl/worksheets/sheet1.xml")
    assert (at, got) == (1, text)


def test_the_later_calendar(tmp_path):
    path = book(tmp_path / "b.xlsx", '<row><c s="1"><v>1.5</v></c></row>', STYLES, workbook='<workbookPr date1904="1"/>')
    assert next(xlsx.sheet_rows(path, "xl/worksheets/sheet1.xml"))[1][0][0] == "1904-01-02 12:00:00"


@pytest.mark.parametrize("piece", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("numbered", [True, False])
def test_ranges_give_each_row_once(monkeypatch, piece, numbered):
    monkeypatch.setattr(cells, "PIECE", piece)
    r = random.Random(piece)
    rows = [f'<row{f" r={chr(34)}{i}{chr(34)}" if numbered else ""} x:k="1"><c><v>{i}</v></c><c t="inlineStr"><is><t>{"é" * r.randrange(30)}</t></is></c></row>' for i in range(1, 120)]
    rows[50] = "<row/>" if not numbered else '<row r="51"/>'
    sheet = f'<?xml version="1.0"?><worksheet xmlns="{M}" xmlns:x="urn:x"><cols/><sheetData>{"".join(rows)}</sheetData><rowBreaks/></worksheet>'.encode()
    for cut in (1, 2, 5, 40):
        edges = [0, *sorted(r.randrange(len(sheet)) for _ in range(cut)), 1 << 62]
        got = [(before, e.findtext(f"{cells.MAIN}c/{cells.MAIN}v")) for a, b in zip(edges, edges[1:]) for before, e in cells.row_elements(io.BytesIO(sheet), a, b)]
        assert got == [(i - 1, None if i == 51 else str(i)) for i in range(1, 120)]


def test_one_sheet_in_many_partitions(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write_workbook(path, [("A", ["i", "t"], iter((i, f"metin {i % 7}") for i in range(3000))), ("B", ["x"], iter([(1,)]))])
    rows = xlsx.raw(spark, path, "A", splitbytes=20_000)
    assert rows.rdd.getNumPartitions() > 5
    assert [tuple(r) for r in rows.where("source_row > 1").selectExpr("source_row", "cells[0].text", "cells[1].text").orderBy("source_row").collect()] == [(i + 2, str(i), f"metin {i % 7}") for i in range(3000)]
    assert xlsx.read_sheet(spark, path, "A", splitbytes=20_000).exceptAll(xlsx.read_sheet(spark, path, "A")).count() == 0


def test_scan_cap_ends_reading_and_says_so(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write_workbook(path, [("A", ["i"], iter([(1,), (None,), (2,), (" ",), (3,), (4,)])), ("B", ["i"], iter([(1,), (2,)]))])
    rows = xlsx.raw(spark, path, maxrows=2)
    assert {tuple(r) for r in xlsx.scan_end(rows).collect()} == {("A", 6)}
    assert [r.i for r in xlsx.read_sheet(spark, path, "A", maxrows=2).orderBy("source_row").collect()] == ["1", "2"]
    assert xlsx.scan_end(xlsx.raw(spark, path, maxrows=4)).count() == 0


def test_workbook_written_by_tasks(spark, tmp_path):
    path = str(tmp_path / "out.xlsx")
    df = spark.range(0, 5000, 1, 6).select("id", F.concat(F.lit("<é & "), F.col("id").cast("string")).alias("t"), (F.col("id") / 8).alias("x"), F.expr("date'2024-01-01' + cast(id % 60 as int)").alias("d"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2 == 0).alias("b"))
    spark.dataSource.register(xlsx.XlsxSource)
    df.write.format("xlsx").option("path", path).option("sheet", "Veri & 1").mode("append").save()
    assert xlsx.validate(path) > 0 and xlsx.sheet_names(path) == ["Veri & 1"]
    got = xlsx.read_sheet(spark, path, "Veri & 1", splitbytes=50_000).orderBy("source_row").collect()
    assert len(got) == 5000 and [r.source_row for r in got] == list(range(2, 5002))
    for i in (0, 1, 2, 777, 4999):
        day = date.fromordinal(date(2024, 1, 1).toordinal() + i % 60)
        assert tuple(got[i])[1:] == (str(i), f"<é & {i}", repr(i / 8), f"{day} 00:00:00", None if i % 3 == 0 else str(i % 2 == 0))
    assert [p.name for p in tmp_path.iterdir()] == ["out.xlsx"]
    with pytest.raises(Exception, match="out.xlsx"):
        df.write.format("xlsx").option("path", path).mode("append").save()
    spark.range(0).write.format("xlsx").option("path", path).mode("overwrite").save()
    assert xlsx.read_sheet(spark, path, "Sayfa1").columns == ["source_row", "id"]


def test_too_many_rows_for_a_sheet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx_writer, "MOST_ROWS", 10)
    writer = xlsx_writer.XlsxWriter(str(tmp_path / "x.xlsx"), "S", ["a"], True)
    with pytest.raises(ValueError, match="more than a sheet"):
        writer.commit([xlsx_writer.Part(0, "p", 10, 0, 0)])


def test_joined_sums():
    r = random.Random(1)
    for n in (0, 1, 7, 1000, 70_001):
        a, b = r.randbytes(50), r.randbytes(n)
        assert xlsx_writer.joined_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_values_become_cells():
    assert xlsx.row_xml([datetime(2024, 1, 1, 12), Decimal("1.50"), float("nan"), None, "a\x00b"]) == '<row><c s="1"><v>45292.5</v></c><c><v>1.50</v></c><c t="inlineStr"><is><t xml:space="preserve">nan</t></is></c><c/><c t="inlineStr"><is><t xml:space="preserve">ab</t></is></c></row>'
