"""Records with line breaks in quoted cells against a plain reader, at different splits."""
import csv
import io
import random

import pytest

from prismtab.sources import delimited, lines, records, tables

KEY = "spark.sql.files.maxPartitionBytes"


def some_file(seed: int, mark: str = ",", rows: int = 300) -> str:
    r = random.Random(seed)
    cell = lambda: r.choice(["plain", "", "7", "two words", f"a{mark}b", 'say "hi"', "one\ntwo", '"\n"', f"x\n{mark}\n\ny", 'end"\n', "é€"])
    out = io.StringIO()
    writer = csv.writer(out, delimiter=mark, lineterminator="\n")
    writer.writerow(["id", "name", "note"])
    writer.writerows([i, "n" + cell(), cell()] for i in range(rows))
    return out.getvalue()


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
@pytest.mark.parametrize("split", ["61", "1000", "128m"])
def test_records_of_files(spark, tmp_path, mark, split):
    want = []
    for seed in range(3):
        text = some_file(seed, mark)
        (tmp_path / f"{seed}.csv").write_text(text)
        want += [tuple(c or None for c in row) for row in list(csv.reader(io.StringIO(text), delimiter=mark))[1:]]
    spark.conf.set(KEY, split)
    try:
        found = delimited.read_delimited(spark, str(tmp_path), mark, "id string, name string, note string", multiline=True)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset(KEY)


def test_quotes_that_open_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n5" wide,x\n1,6" and 7"\n"two"" \nlines" tail ,y\n')
    values = sorted(r["value"] for r in lines.read_lines(spark, str(tmp_path), ",").collect())
    assert values == sorted(["a,b", '5" wide,x', '1,6" and 7"', '"two"" \nlines" tail ,y'])


def test_rules_of_one_line():
    behind = records.quote_rules(",")
    for line, plain, inside in [(b"a,b", False, True), (b'a,"b', True, False), (b'a,"b"', False, False), (b'"a""', True, False), (b'"a""b",c', False, False),
                                (b'x"y"z', False, False), (b'",', True, False), (b'","', False, True), (b'"a,b",c,"', True, True), (b'""', False, True)]:
        assert (behind(line, False), behind(line, True)) == (plain, inside), line
    assert behind(b'"a",' * 100_000 + b'"', False) and not behind(b'""' * 100_000 + b'"', True)


def test_open_to_the_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n' + "y\n" * 20)
    assert sorted(len(r["value"].split("\n")) for r in lines.read_lines(spark, str(tmp_path), ",").collect()) == [1, 21]
    marked = records.marked_lines(lines.raw_lines(spark, str(tmp_path)), ",")
    with pytest.raises(ValueError, match="goes on for"):
        records.joined(records.checkpointed(marked), most_lines=10)


def test_encodings_of_plain_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,€5 – ok\n".encode("cp1252"))
    assert [tuple(r) for r in delimited.read_delimited(spark, str(tmp_path)).collect()] == [(1, "€5 – ok")]
    (tmp_path / "b.csv").write_bytes("id,name\n2,é\n".encode())
    with pytest.raises(ValueError, match="encodings"):
        delimited.read_delimited(spark, str(tmp_path))
    assert sorted(map(tuple, delimited.read_ragged(spark, str(tmp_path)).collect())) == [(1, "€5 – ok"), (2, "é")]


def test_mixed_folders_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.xlsx").write_bytes(b"PK")
    with pytest.raises(ValueError, match="workbooks"):
        tables.read_table(spark, str(tmp_path))
    report = tmp_path / "more"
    report.mkdir()
    (report / "r.csv").write_text("Title\nA,b\nDate,Item,Amount\n2026-01-01,x,1\n2026-01-02,y,2\n")
    (report / "p.csv").write_text("id,name,n\n1,x,2\n")
    with pytest.raises(ValueError, match="plain tables"):
        tables.read_table(spark, str(report))


def test_blocks_of_one_line(spark):
    """3,000 blocks of one source: keeping, swapping and settling ones, against a plain reading."""
    r = random.Random(4)
    rows = [r.choice(['1,"open', 'still', 'end",2', '"a""b', 'x,y', '3,"c",4', 'end" ,"open']) for _ in range(3000)]
    behind, want, record, is_open = records.quote_rules(","), [], None, False
    for i, line in enumerate(rows):
        want.append((i, is_open, record))
        if not is_open:
            record = i
        is_open = behind(line.encode(), is_open)
    data = spark.createDataFrame([("s", (i, i), v) for i, v in enumerate(rows)], "source string, line_no struct<block:bigint,at:bigint>, value string")
    marked = records.marked_lines(data.coalesce(1), ",")
    starts = records.block_starts(marked)
    assert [(b.block, b.open, b.carried and b.carried["at"]) for b in starts.orderBy("block").collect()] == want
    assert not any(word in starts._jdf.queryExecution().optimizedPlan().toString() for word in ("collect_list", "aggregate("))  # no list of all blocks
