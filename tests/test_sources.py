"""Readers and the dataset store on files written here."""
import zipfile

import pytest
from pyspark.sql import functions as F

from prismtab.operators import ledger
from prismtab.operators.ledger import LedgerColumns
from prismtab.sources import delimited, lines, reports, spreadsheets, store, tables


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, mark):
    (tmp_path / "a.csv").write_text("\n".join(mark.join(r) for r in [("id", " name ", ""), ("1", "x", "2.5"), ("2", "y", "3.5")]))
    df = delimited.read_delimited(spark, str(tmp_path))
    assert df.columns[:2] == ["id", "name"] and sorted(rows(df)) == [(1, "x", 2.5), (2, "y", 3.5)]


def test_fallback_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("plain words only")
    assert delimited.folder_delimiter(spark, str(tmp_path)) == ","


def test_delimiter_of_all_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(["x;y", *['1,5;"a,b,c"'] * 50]))
    assert delimited.folder_delimiter(spark, str(tmp_path)) == ";"
    (tmp_path / "b.csv").write_text("x|y\n1|2")
    with pytest.raises(ValueError):
        delimited.folder_delimiter(spark, str(tmp_path))


def test_one_entry(spark, tmp_path):
    plain, report = tmp_path / "plain", tmp_path / "report"
    plain.mkdir(), report.mkdir()
    (plain / "a.csv").write_bytes("id;name\n1;café\n2\n".encode("cp1252"))
    (report / "r.csv").write_text(REPORT)
    assert sorted(rows(tables.read_table(spark, str(plain)))) == [(1, "café"), (2, None)]
    read = tables.read_table(spark, str(report))
    assert read.columns == ["Date", "Time", "Category", "Item/Customer", "Amount (Rs)"] and read.count() == 3


def test_equal_rows_for_other_splits(spark, tmp_path):
    (tmp_path / "r.csv").write_text(REPORT + "\n" * 500)
    found, key = [], "spark.sql.files.maxPartitionBytes"
    for size in ("64", "128m"):
        spark.conf.set(key, size)
        detail = reports.report_rows(lines.read_lines(spark, str(tmp_path)))
        found.append(sorted(tuple(r["cells"]) for r in detail.collect()))
    spark.conf.unset(key)
    assert found[0] == found[1] and len(found[0]) == 3


def test_long_integers_keep_their_digits(spark):
    df = delimited.promote_numeric(spark.createDataFrame([("12345678901234567890123",), ("1",)], "n string"))
    assert df.dtypes == [("n", "decimal(38,0)")] and {int(r.n) for r in df.collect()} == {12345678901234567890123, 1}


def test_encodings_per_file(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿café,1".encode())
    (tmp_path / "utf.csv").write_bytes("naïve,2".encode())
    (tmp_path / "win.csv").write_bytes("€5 – ok,3".encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes("é\x81,4".encode("latin1"))
    values = sorted(r["value"] for r in lines.read_lines(spark, str(tmp_path)).collect())
    assert values == sorted(["café,1", "naïve,2", "€5 – ok,3", "é\x81,4"])


def test_ragged_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,note\n1,x,ok\n\n2,y,too,many\n3\n , ,\n4,"a,b","say ""hi"""\n')
    df = delimited.read_ragged(spark, str(tmp_path))
    assert sorted(rows(df)) == [(1, "x", "ok"), (2, "y", "too,many"), (3, None, None), (4, "a,b", 'say "hi"')]


def test_promotion_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "1", "1.5", None), ("2", "x", "2", None), (None, "3", "", None)], "a string, b string, c string, d string")
    types = dict(delimited.promote_numeric(df).dtypes)
    assert types == {"a": "bigint", "b": "string", "c": "string", "d": "string"}
    assert dict(delimited.promote_numeric(df.where("c <> ''")).dtypes)["c"] == "double"


def test_cells(spark):
    df = spark.createDataFrame([(" ",), ("7",), ("x",)], "c string")
    assert rows(df.select(delimited.cell_text(F.col("c")), delimited.cell_number(F.col("c")))) == [(None, None), ("7", 7.0), ("x", None)]


REPORT = """Monthly Ledger
Shop Name,Corner Shop
Generated At,2026-05-31

Summary
Total Sales,"Rs 9,000"
Net Profit,8500
Transaction Details
Date,Time,Category,Item/Customer,Amount (Rs)
2026-05-01,10:00,SALES,Rice,5000
2026-05-02,11:00,SALES,"Oil, 5l",2000
2026-05-03,12:00,EXPENSE,Rent,500
End of report
2026-05-09,12:00,SALES,Late,1
"""


def test_sectioned_reports(spark, tmp_path):
    (tmp_path / "r1.csv").write_text(REPORT)
    (tmp_path / "r2.csv").write_text(REPORT.replace("Corner Shop", "Other").split("End of")[0])
    (tmp_path / "plain.csv").write_text("a,b,c\n1,2,3\n")
    text, mark = reports.read_report_lines(spark, str(tmp_path))
    assert mark == ","
    found = reports.report_rows(text)
    header = reports.headers(found)
    assert header == [["Date", "Time", "Category", "Item/Customer", "Amount (Rs)"]]
    table = reports.detail_table(found, header[0])
    assert table.count() == 6 and dict(table.dtypes)["Amount (Rs)"] == "bigint"
    assert {r["Item/Customer"] for r in table.collect()} == {"Rice", "Oil, 5l", "Rent"}
    facts = reports.report_facts(text)
    assert {(r.section, r.key, r.value) for r in facts.where("source like '%r1.csv'").collect()} == {
        ("metadata", "report_title", "Monthly Ledger"), ("metadata", "Shop Name", "Corner Shop"),
        ("metadata", "Generated At", "2026-05-31"), ("summary", "Total Sales", "Rs 9,000"), ("summary", "Net Profit", "8500")}


def test_stated_summary_wins(spark):
    df = spark.createDataFrame([("2026-05-01", "SALES", "Rice", 10), ("2026-05-01", "EXPENSE", "Rent", 4)],
                               "d string, kind string, item string, amount int")
    stated = spark.createDataFrame([("Total Sales", "Rs 9,000"), ("Udhaar Outstanding", ""), ("Profit Status", "Great")], "key string, value string")
    columns = LedgerColumns("d", "kind", "item", "amount")
    summary = ledger.ledger_summary(df, columns, stated).first()
    assert (summary.total_sales, summary.total_expenses, summary.net_profit, summary.profit_status) == (9000.0, 4.0, 8996.0, "Great")
    computed = ledger.ledger_summary(df, columns).first()
    assert (computed.total_sales, computed.net_profit, computed.profit_status) == (10.0, 6.0, "Profit")


SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>amount</t></is></c><c r="C1" t="s"><v>1</v></c></row>
<row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>1.5</v></c></row>
<row r="3"/><row r="4"><c r="A4" t="inlineStr"><is><t>y</t></is></c><c r="C4"><v>7</v></c></row></sheetData></worksheet>"""
BOOK = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">
<sheets><sheet name="First" sheetId="1" r:id="rId7"/></sheets></workbook>"""
LINKS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId7" Target="worksheets/main.xml"/></Relationships>"""
SHARED = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>na</t><t>me</t></si><si><t>n</t></si></sst>"""


def test_spreadsheets(spark, tmp_path):
    for name in ("a.xlsx", "b.xlsx"):
        with zipfile.ZipFile(tmp_path / name, "w") as book:
            book.writestr("xl/workbook.xml", BOOK)
            book.writestr("xl/_rels/workbook.xml.rels", LINKS)
            book.writestr("xl/sharedStrings.xml", SHARED)
            book.writestr("xl/worksheets/main.xml", SHEET)
    df = spreadsheets.read_spreadsheets(spark, str(tmp_path))
    assert df.dtypes == [("name", "string"), ("amount", "double"), ("n", "bigint")]
    assert sorted(rows(df), key=str) == sorted([("x", 1.5, None), ("y", None, 7)] * 2, key=str)


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "id int, `odd name` string, v double")
    path = store.dataset_path(str(tmp_path), "d1")
    store.save_dataset(df, path)
    again = store.load_dataset(spark, path)
    assert again.dtypes == df.dtypes and sorted(rows(again)) == sorted(rows(df))
    assert store.load_facts(spark, path).first().row_count == 2
    store.save_roles(spark, {"v": "amount", "id": "order_id"}, path)
    assert list(store.load_roles(spark, path).items()) == [("v", "amount"), ("id", "order_id")]
    assert store.session_path("x/", "s") == "x/sessions/s"


def test_recent_datasets(spark):
    registry = spark.createDataFrame([(i, i % 2, f"2026-01-{i + 1:02d}") for i in range(9)], "dataset_id int, user_id int, created_at string")
    assert [r.dataset_id for r in store.recent_datasets(registry, 1, 3).collect()] == [7, 5, 3]
    assert [r.dataset_id for r in store.recent_datasets(registry, limit=2).collect()] == [8, 7]


def test_refuses_nothing(spark):
    with pytest.raises(ValueError):
        delimited.non_empty(spark.range(1).select())


def test_reports_are_sent_to_no_task_whole(spark):
    """Lines cut out of small columns look small to Spark; neither they nor the layouts may be broadcast."""
    text = spark.range(3).select(F.col("id").alias("source"), F.posexplode(F.array(*map(F.lit, (
        "Shop", "Name,A", "Summary", "Total,5", "Date,Item,Amount", "2024-01-01,x,1", "2024-01-02,y,2", "Note,z", "2024-01-03,late,3")))).alias("line_no", "value"))
    found = reports.report_rows(text)
    assert [(r.line_no, r.header[2], r.cells[2]) for r in found.where("source = 1").orderBy("line_no").collect()] == [(5, "Amount", "1"), (6, "Amount", "2")]
    facts = reports.report_facts(text)
    assert sorted(map(tuple, facts.where("source = 2").drop("source").collect())) == [
        ("metadata", "Name", "A"), ("metadata", "report_title", "Shop"), ("summary", "Total", "5")]
    for frame in (found, facts):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
