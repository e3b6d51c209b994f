import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import export
from quern.operators.filters import Request
from quern.operators.profile import column_profile, profile_violations, sample_values
from quern.plans.analysis import analyze
from quern.sources import xlsx
from quern.sources.generator import chat_messages


@pytest.fixture
def book(tmp_path):
    path = str(tmp_path / "b.xlsx")
    rows = [(i, f"bir soru {i % 5} var mıydı", "web" if i % 2 else "mobil", True) for i in range(40)]
    xlsx.write_workbook(path, [("Mesajlar", ["id", "mesaj", "", "bayrak"], iter([*rows[:20], (None, " ", None, None), *rows[20:]])), ("İkinci", ["a"], iter([("x",), ("y", "z")]))])
    return path


def test_sheets_round_trip(spark, book):
    assert xlsx.sheet_names(book) == ["Mesajlar", "İkinci"] and xlsx.validate(book) > 0
    df = xlsx.read_sheet(spark, book, "Mesajlar")
    assert df.columns == ["source_row", "id", "mesaj", "Kolon 3", "bayrak"] and df.count() == 40
    assert df.agg(F.max("source_row")).first()[0] == 42
    second = xlsx.read_sheet(spark, book, "İkinci")
    assert second.columns == ["source_row", "a", "Kolon 2"] and second.count() == 2
    p = {r.name: r for r in column_profile(df, ["id", "mesaj", "Kolon 3"]).collect()}
    assert p["mesaj"].unique_count == 5 and p["mesaj"].is_likely_text and not p["Kolon 3"].is_likely_text
    assert profile_violations(column_profile(df, ["id", "mesaj"]), 40).count() == 0
    assert len(sample_values(df, F.col("source_row"), ["mesaj"]).first().samples) == 3


def test_profile_in_one_scan_agrees(spark):
    df = chat_messages(spark, 500)
    a = {r.name: r for r in column_profile(df, ["mesaj", "kanal"]).collect()}
    b = {r.name: r for r in column_profile(df, ["mesaj", "kanal"], exact_distinct=False).collect()}
    for k in a:
        assert (a[k].non_empty_count, a[k].total_length, a[k].avg_length, a[k].is_likely_text) == (b[k].non_empty_count, b[k].total_length, b[k].avg_length, b[k].is_likely_text)
        assert abs(a[k].unique_count - b[k].unique_count) <= 0.1 * a[k].unique_count + 1


def test_bad_files_are_rejected(tmp_path, book):
    def reason(name, content):
        p = tmp_path / name
        p.write_bytes(content)
        with pytest.raises(xlsx.Rejected) as e:
            xlsx.validate(str(p))
        return e.value.reason

    assert reason("e.xlsx", b"") == "empty_file"
    assert reason("o.xlsx", xlsx.OLE2 + b"x") == "encrypted_or_legacy_ole2_container"
    assert reason("z.xlsx", b"nope") == "not_a_zip_archive"
    assert reason("c.xlsx", xlsx.ZIP + b"broken") == "corrupt_zip_archive"
    with open(book, "rb") as f:
        whole = f.read()
    with zipfile.ZipFile(book) as z:
        at = next(i for i in z.infolist() if i.filename == "xl/workbook.xml").header_offset + 60
    assert reason("m.xlsx", whole[:at] + bytes(x ^ 0xFF for x in whole[at : at + 8]) + whole[at + 8 :]) == "member_decompression_failed"
    with pytest.raises(xlsx.Rejected, match="empty_file"):
        xlsx.validate(str(tmp_path / "none.xlsx"))
    with pytest.raises(xlsx.Rejected, match="unreadable_file"):
        xlsx.validate(str(tmp_path))
    with zipfile.ZipFile(book, "a") as z:
        z.writestr("xl/vbaProject.bin", "x")
    with pytest.raises(xlsx.Rejected, match="macro"):
        xlsx.validate(book)
    bomb = str(tmp_path / "bomb.xlsx")
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<a/>")
        z.writestr("xl/workbook.xml", b"\0" * (8 << 20))
    with pytest.raises(xlsx.Rejected, match="ratio"):
        xlsx.validate(bomb)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["=sınav tarihi belli", "sınav tarihi belli", "harç ödemesi nedir"])], "i long, t string")
    x = analyze(df, F.col("i"), Request("t"))
    path = str(tmp_path / "r.xlsx")
    export.write_xlsx(path, x.summary, x.report.select("executive_summary"), x.top, x.themes)
    assert xlsx.sheet_names(path) == list(export.SHEETS)
    rows = xlsx.read_sheet(spark, path, "Sorular").collect()
    assert rows[0]["Adet"] == "2" and rows[0]["Soru"].startswith(("'=", "S"))
    assert '"top_questions"' in export.as_json(x.report).first().json
