"""Spreadsheets taken apart, results kept between queries, and signals on a stream."""

import datetime as dt
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.operators import timing
from gridloom.sources import kept, sheets
from gridloom.streaming import signals

DAY = dt.date(2003, 5, 1)
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def column(i):
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def workbook(path, rows, *, inline=False, early=False, sheet="data"):
    """A workbook as its archive: strings shared or inline, numbers as they are, None as no cell at all."""
    shared, body = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{column(c)}{r}"
            if isinstance(v, str) and inline:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(early)}"/><sheets><sheet name="{sheet}" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="x" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet {NS}><sheetData>{"".join(body)}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")


HEAD = [["Stkcd", "Trddt", "Unused", "Clsprc"], ["code", "day", "-", "close"], ["", "", "", "yuan"]]
SCHEMA = "code string, date date, close double, volume long"
NAMES = {"code": "Stkcd", "date": "Trddt", "close": "Clsprc", "volume": "Dnshrtrd"}


def test_two_files_with_title_rows_and_the_last_counts(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", HEAD + [["000001", "2003-05-01", "x", 10.5], ["000002", "2003-05-01", "x", 3], ["000001", "2003-05-02", None, 11.25], [None, None, None, None]])
    workbook(tmp_path / "b.xlsx", [[*h, "Dnshrtrd"] for h in HEAD] + [["000001", 37742.0, "x", 99.0, 700], ["000003", "no day", "x", "no number", 1.5]], inline=True)
    (tmp_path / "note.txt").write_text("not a workbook")
    rows = sheets.read_sheets(spark, str(tmp_path), SCHEMA, names=NAMES)
    assert rows.columns == ["code", "date", "close", "volume", "_file", "_row"]
    got = {(os.path.basename(r["_file"]), r["_row"]): (r["code"], r["date"], r["close"], r["volume"]) for r in rows.collect()}
    assert got == {
        ("a.xlsx", 4): ("000001", DAY, 10.5, None), ("a.xlsx", 5): ("000002", DAY, 3.0, None), ("a.xlsx", 6): ("000001", DAY + dt.timedelta(1), 11.25, None),
        ("b.xlsx", 4): ("000001", DAY, 99.0, 700), ("b.xlsx", 5): ("000003", None, None, None),
    }
    last = {(r["date"], r["code"]): (r["close"], r["volume"]) for r in sheets.last_of_files(rows).collect()}
    assert last[DAY, "000001"] == (99.0, 700) and last[DAY, "000002"] == (3.0, None) and len(last) == 4


def test_days_from_1904_wide_sheets_and_no_rows(spark, tmp_path):
    wide = [[f"c{i}" for i in range(60)], *[[float(i * j) for i in range(60)] for j in range(1, 4)]]
    workbook(tmp_path / "wide.xlsx", wide, sheet="figures")
    out = sheets.read_sheets(spark, str(tmp_path / "wide.xlsx"), "c59 double, c27 long", titles=0, sheet="figures").orderBy("_row").collect()
    assert [(r["c59"], r["c27"]) for r in out] == [(59.0, 27), (118.0, 54), (177.0, 81)]
    workbook(tmp_path / "mac.xlsx", [["d", "t"], [1.0, 0.5]], early=True)
    r = sheets.read_sheets(spark, str(tmp_path / "mac.xlsx"), "d date, t timestamp", titles=0).first()
    assert r["d"] == dt.date(1904, 1, 2) and r["t"].hour == 12
    workbook(tmp_path / "none.xlsx", [])
    assert sheets.read_sheets(spark, str(tmp_path / "none.xlsx"), SCHEMA).count() == 0
    with pytest.raises(Exception, match="no sheet named other"):
        sheets.read_sheets(spark, str(tmp_path / "wide.xlsx"), "c1 double", sheet="other").collect()


def test_a_kept_table_is_read_until_a_file_changes(spark, tmp_path):
    path, folder = str(tmp_path / "t"), str(tmp_path / "kept")
    spark.range(10).selectExpr("id", "id % 3 as k").write.parquet(path)
    sums = lambda: spark.read.parquet(path).groupBy("k").agg(F.sum("id").alias("s"))
    first = kept.kept(sums(), folder)
    tables = lambda: sorted(os.path.join(d, n) for d in os.listdir(folder) for n in os.listdir(f"{folder}/{d}") if not n.startswith("."))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, sums().collect())) and first.inputFiles()[0].startswith(f"file://{folder}")
    one = tables()
    at = os.stat(f"{folder}/{one[0]}/_SUCCESS").st_mtime_ns
    kept.kept(sums(), folder)
    assert tables() == one and os.stat(f"{folder}/{one[0]}/_SUCCESS").st_mtime_ns == at  # read, not written again
    spark.range(100, 103).selectExpr("id", "id % 3 as k").write.mode("append").parquet(path)
    assert sorted(map(tuple, kept.kept(sums(), folder).collect())) == sorted(map(tuple, sums().collect()))
    assert len(tables()) == 1 and tables() != one  # the old state is gone
    kept.kept(sums().filter("k = 1"), folder)
    assert len(os.listdir(folder)) == 2  # another plan is another table


def test_a_write_that_failed_is_done_again(spark, tmp_path):
    path, folder = str(tmp_path / "t"), str(tmp_path / "kept")
    spark.range(5).write.parquet(path)
    kept.kept(spark.read.parquet(path), folder)
    (table,) = (f"{folder}/{d}/{n}" for d in os.listdir(folder) for n in os.listdir(f"{folder}/{d}") if not n.startswith("."))
    for name in os.listdir(table):
        os.remove(f"{table}/{name}")
    assert kept.kept(spark.read.parquet(path), folder).count() == 5


def test_tables_between_steps_go_at_the_end(spark):
    with pytest.raises(RuntimeError), kept.steps(spark) as write:
        rows = write(spark.range(5).repartition(2), "five")
        (file, *_) = rows.inputFiles()
        assert rows.count() == 5 and os.path.exists(file.removeprefix("file://"))
        left = kept.settled(rows.filter("id > 2"))
        raise RuntimeError
    assert not os.path.exists(file.removeprefix("file://")) and left.count() == 2


def test_what_a_plan_doesn_t_show_isn_t_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    with pytest.raises(ValueError, match="only plans over files"):
        kept.kept(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "k"))
    with_python = spark.read.parquet(path).mapInArrow(lambda batches: batches, "id long")
    with pytest.raises(ValueError, match="needs a version"):
        kept.plan_digest(with_python)
    assert kept.plan_digest(with_python, "1") != kept.plan_digest(with_python, "2")


def test_a_stream_in_pieces_gives_what_the_whole_gives(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(8)
    flag = lambda: r.choice((True, False, False, None))
    rows = [(c, DAY + dt.timedelta(2 * i), flag(), flag(), flag(), flag()) for i in range(40) for c in "abc" if r.random() < 0.9]
    schema = "code string, date date, lo boolean, so boolean, lc boolean, sc boolean"
    want = {(q["code"], q["date"]): q["signal"] for q in timing.long_short_signal(spark.createDataFrame(rows, schema)).collect()}
    # Pieces of a few days each; within one, and with the next, rows are out of order by less than the delay.
    mixed = sorted(rows, key=lambda x: x[1].toordinal() + r.uniform(0, 6))
    source = str(tmp_path / "in")
    for i in range(0, len(mixed), 25):
        spark.createDataFrame(mixed[i : i + 25], schema).coalesce(1).write.mode("append").parquet(source)
    ends = [("zz", DAY + dt.timedelta(200), False, False, False, False), ("zz", DAY + dt.timedelta(400), False, False, False, False)]
    for end in ends:  # what comes later lets the rows before it go
        spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(source)
    late = [("a", DAY, True, False, False, False)]
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: signals.signal_stream(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("zz", DAY + dt.timedelta(800), False, False, False, False)], schema).coalesce(1).write.mode("append").parquet(source)
    run()  # goes on from its checkpoint; the row that is too late is dropped
    out = [q for q in spark.read.parquet(str(tmp_path / "out")).collect() if q["code"] != "zz"]
    assert len(out) == len(want) and {(q["code"], q["date"]): q["signal"] for q in out} == want
