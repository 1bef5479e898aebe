"""Workbooks: dates and booleans by style, error cells, and large sheets in bounded pieces."""
import datetime
import tracemalloc
import zipfile

import pytest

from prismtab.sources import spreadsheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
BOOK = ('<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{settings}'
        '<sheets><sheet name="First" sheetId="1" r:id="rId1"/></sheets></workbook>')
LINKS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>"""
STYLES = f"""<styleSheet {NS}><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts>
<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>"""


def text(ref, value):
    return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'


def write(path, rows, settings=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", BOOK.format(ns=NS, settings=settings))
        book.writestr("xl/_rels/workbook.xml.rels", LINKS)
        book.writestr("xl/styles.xml", STYLES)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet {NS}><sheetData>'.encode())
            for i, cells in enumerate(rows, 1):
                sheet.write(f'<row r="{i}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")


ROWS = [text("A1", "day") + text("B1", "at") + text("C1", "ok") + text("D1", "days") + text("E1", "mixed") + text("F1", "bad"),
        '<c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" s="3"><v>3</v></c><c r="E2" s="1"><v>59</v></c><c r="F2" t="e"><v>#N/A</v></c>',
        '<c r="A3" s="1"><v>61</v></c><c r="C3" t="b"><v>0</v></c><c r="D3"><v>4.5</v></c>' + text("E3", "x") + '<c r="F3"><v>2</v></c>']


def test_types_of_cells(spark, tmp_path):
    write(tmp_path / "a.xlsx", ROWS)
    df = spreadsheets.read_spreadsheets(spark, str(tmp_path))
    assert dict(df.dtypes) == {"day": "timestamp", "at": "timestamp", "ok": "boolean", "days": "double", "mixed": "string", "bad": "bigint"}
    day = datetime.datetime
    assert sorted(map(tuple, df.collect()), key=str) == sorted([
        (day(2024, 1, 1), day(2024, 1, 1, 12), True, 3.0, "1900-02-28 00:00:00", None), (day(1900, 3, 1), None, False, 4.5, "x", 2)], key=str)


def test_days_from_1904(spark, tmp_path):
    write(tmp_path / "a.xlsx", ROWS, '<workbookPr date1904="1"/>')
    df = spreadsheets.read_spreadsheets(spark, str(tmp_path))
    assert {r["day"] for r in df.collect()} == {datetime.datetime(2028, 1, 2), datetime.datetime(1904, 3, 2)}


@pytest.mark.parametrize("code, date", [("m/d/yy h:mm", True), ("[$-409]mmmm d", True), ("[h]:mm", True), ("General", False), ('0.00 "dollars"', False),
                                        ("#,##0;[Red]-#,##0", False), ("\\d0", False), ("@", False), ("0_d", False)])
def test_formats(code, date):
    assert spreadsheets.shows_date(code) is date


def test_a_long_sheet_takes_bounded_memory(tmp_path):
    path = tmp_path / "long.xlsx"
    write(path, (f'<c r="A{i}"><v>{i}</v></c>' + text(f"B{i}", f"row {i}") for i in range(1, 200_001)))
    content = path.read_bytes()
    tracemalloc.start()
    rows = sum(1 for _ in spreadsheets._sheet_rows(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200_000 and peak < 20_000_000
