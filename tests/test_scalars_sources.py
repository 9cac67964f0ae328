"""Scalars, sheet formats, specifications, inference, identity and events."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from slatework.functions.scalars import js_round, name_key, parse_number, parse_positions, surname
from slatework.operators import identity
from slatework.plans import source_queries
from slatework.sources import infer, sheets
from slatework.sources.reader import SourceSpec, SpecError, read_picks, read_rulings, read_source
from slatework.sources.sinks import ranking_lines, write_csv
from slatework.streaming import events as ev


def _map(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.withColumn("o", f(F.col("v"))).orderBy("i").collect()]


def test_numbers(spark):
    assert _map(spark, parse_number, ["1,047.5", "'11.6", "90.2%", "", "-", "--", "—", "N/A", "0", "5d", "NaN", "1e999", None, "x"]) == [1047.5, 11.6, 90.2, *[None] * 5, 0.0, *[None] * 5]
    assert round(_map(spark, parse_number, ["22:59"])[0], 5) == 22.98333
    assert _map(spark, lambda c: parse_number(c, lenient=False), ["1,047.5", "90.2%", "22:59"]) == [1047.5, None, None]
    assert _map(spark, lambda c: js_round(c.cast("double")), ["2.5", "-2.5", "0.4"]) == [3, -2, 0]


def test_names(spark):
    got = _map(spark, name_key, ["Éva Šimůnek", "T.T. Ask", "Nils Berg-Dahl", "Nils Berg (D)", "Bo O'Neil Jr.", None, ""])
    assert got == ["eva simunek", "tt ask", "nils berg dahl", "nils berg (d)", "bo oneil", None, ""]
    assert _map(spark, surname, ["nils berg (d)", "(d)", None]) == ["berg", "", None]
    assert _map(spark, parse_positions, ["C, LW", "F/D", "w", "x", None, "L/R/C"]) == [["C", "LW"], ["C", "LW", "RW", "D"], ["LW", "RW"], [], [], ["LW", "RW", "C"]]


@pytest.mark.parametrize(("a", "b", "ratio"), [("karl berg", "karla berg", 18 / 19), ("anna lind", "hanna lund", 16 / 19), ("abc", "xyz", 0.0), ("", "", 1.0)])
def test_ratio(spark, a, b, ratio):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(identity.sequence_ratio("a", "b").alias("r")).first()["r"] == ratio


def _workbook() -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="urn:r"><sheets><sheet name="Info" r:id="a"/><sheet name="Skaters" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="urn:p"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Player</t></si><si><r><t>Bo </t></r><r><t>Ek &amp; Co</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>G</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    return b.getvalue()


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i:03}.csv").write_text(f"{i},x\n")
    spark.dataSource.register(sheets.SheetsDataSource)
    df = spark.read.format("sheets").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() <= 3
    assert sorted(int(r["cells"][0]) for r in df.collect()) == list(range(600))
    (tmp_path / "large.csv").write_text("1,x\n" * 3_000_000)
    assert [len(p.paths) for p in sheets._Reader({"path": str(tmp_path)}).partitions()][-1] == 1


def test_sheet_files_of_an_earlier_run_are_not_read(spark, tmp_path):
    for run, ids in (("a", (1, 2)), ("b", (2, 3))):
        rows = [(i, s, n, [f"{i}", s, None, " z "]) for i in ids for s in ("main", "goalies") for n in (2, 1, 4)]
        spark.createDataFrame(rows, "file_id long, sheet string, row_no int, cells array<string>").write.parquet(str(tmp_path / run / "t/sheet_row.parquet"))
        spark.createDataFrame([(i, ("xlsx", "html", "csv")[i - 1]) for i in (1, 1, 2, 3)], "file_id long, fmt string").write.parquet(str(tmp_path / run / "t/sources.parquet"))
        got = source_queries.ref_sheet_files(spark, str(tmp_path / run / "t"))
        assert sorted(map(tuple, got.collect())) == sorted((i, s, n, f"{i}|{s}||z") for i, s, n, _ in rows)


def test_sheet_formats(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_workbook())
    (tmp_path / "b.xls").write_text("<html><table><tr><th>Player</th><td> G </td></tr><tr><td>Jö<b>rn</b></td><td>3</td></tr></table></html>", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes('﻿"Smith, John",COL,"He said ""hi"""\r\n;;\r\n\r\n'.encode())
    spark.dataSource.register(sheets.SheetsDataSource)
    got = spark.read.format("sheets").option("path", str(tmp_path)).load().collect()
    rows = {(r["file"][-6:], r["sheet"], r["row_no"]): r["cells"] for r in got}
    assert rows["a.xlsx", "Skaters", 1] == ["Player", None, "G"]
    assert rows["a.xlsx", "Skaters", 2] == []
    assert rows["a.xlsx", "Skaters", 3] == ["Bo Ek & Co", None, "2"]
    assert rows["/b.xls", "table0", 2] == ["Jörn", "3"]
    assert rows["/c.csv", "main", 1] == ["Smith, John", "COL", 'He said "hi"']
    one = spark.read.format("sheets").option("path", str(tmp_path / "a.xlsx")).option("sheet", "Skaters").option("max_col", 1).load()
    assert [r["cells"] for r in one.orderBy("row_no").collect()] == [["Player"], [], ["Bo Ek & Co"]]
    assert sheets.best_sheet(["Info", "Skaters"]) == 1
    assert sheets.sniff_delimiter('a;b\t"x;;;;"\tc\td') == "\t"


def _cells(spark, rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "row_no int, cells array<string>")


def test_read_source(spark):
    cells = _cells(spark, [["banner"], ["Player", "Team", "Pos", "GP", "G", "A", "G2"], ["Bo Ek", "ABC", "C", "10", "0.5", "1", ""], ["Player", "Team", "Pos", "GP", "G", "A", ""], ["No Games", "ABC", "C", "", "1", "1", ""], ["Gil Net", "XYZ", "G", "5", "9", "9", "2"], ["", "ABC", "C", "1", "1", "1", ""], ["Short"]])
    spec = SourceSpec("s", {"name": "player", "team": 2, "pos": "Pos", "GP": 4, "G": "G", "A": 6}, 2, {"G": "G2"}, ("team",), ("G",), {"PTS": ("G", "A")}, (("Bo Ek", "C", "Bo Ek (C)"),))
    got = {r["name"]: r["stats"] for r in read_source(cells, spec).collect()}
    assert got == {"Bo Ek (C)": {"GP": 10.0, "G": 5.0, "A": 1.0, "PTS": 6.0}, "Gil Net": {"GP": 5.0, "G": 10.0, "A": 9.0, "PTS": 19.0}}
    with pytest.raises(SpecError):
        read_source(cells, SourceSpec("s", {"name": "Nobody"}, 2))
    with pytest.raises(SpecError):
        SourceSpec("s", {"team": 1}).check()


def test_lists(spark):
    picks = read_picks(_cells(spark, [["# list"], ["name", "pick"], ["Bo Ek", "2.5"], ["Bo Ek", "9"], ["", "1"]]), "p", 0).collect()
    assert [(r["key"], r["value"]) for r in picks] == [("bo ek", 2.5)]
    rulings = read_rulings(_cells(spark, [["Bo Ek", "C/LW", "d"], ["X Y", "?"]]), "p").collect()
    assert [(r["key"], r["positions"]) for r in rulings] == [("bo ek", ["C", "LW", "D"])]


def test_inference(spark):
    cells = _cells(spark, [["Projections"], ["Player", "Tm", "S", "GP", "G", "G"], ["Bo", "ABC", "3", "10", "5", "6"]])
    got = infer.auto_map(cells)
    assert [(m["field"], m["uncertain"], m["sample"]) for m in got] == [("name", False, "Bo"), ("team", False, "ABC"), ("SOG", True, "3"), ("GP", False, "10"), ("G", False, "5"), ("G", True, "6")]
    stats = spark.createDataFrame([(50.0, 0.5, 0.5, 1.0)] * 6, "GP double, G double, A double, PTS double")
    assert infer.looks_per_game(stats)
    assert infer.points_agree(stats)
    assert infer.points_agree(stats.limit(2)) is None
    assert infer.text_column([["1", "x"]] * 6) == 1


def test_identity(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("c", "c"), (None, "q"), ("t", "x")], "alias string, canonical string")
    got = {r["alias"]: r["canonical"] for r in identity.alias_closure(a).collect()}
    assert got == {"a": "c", "b": "c", "x": "x", "y": "x", "t": "x"}
    assert identity.alias_closure(a.limit(0)).count() == 0
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(40)], "alias string, canonical string")
    assert {r["canonical"] for r in identity.alias_closure(chain).collect()} == {"40"}
    rows = spark.createDataFrame(
        [("k", "s1", 0, 1, "", None, [], None, {"G": 1.0}), ("k", "s1", 0, 2, "Bo", None, ["C"], None, {"G": 2.0}), ("k", "s2", 1, 1, "Bob", "ABC", ["D"], 30.0, {"G": 3.0})],
        "key string, source string, source_ord int, row_no int, name string, team string, pos array<string>, age double, stats map<string,double>",
    )
    r = identity.merge_sources(rows).first()
    assert (r["name"], r["team"], r["pos"], r["age"], r["lines"]) == ("Bo", "ABC", ["C"], 30.0, {"s1": {"G": 2.0}, "s2": {"G": 3.0}})
    known = spark.createDataFrame([("matthew boldy",), ("mark boldy",)], "key string")
    missing = spark.createDataFrame([("s", "matt boldy"), ("s", "mark boldy"), ("s", "no one")], "source string, key string")
    got = {r["key"]: r["candidate"] for r in identity.unmatched(missing, known).collect()}
    assert got == {"matt boldy": "matthew boldy", "no one": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'A "q"', 10.04, 1.0, ["C", "LW"])], "rank long, name string, points double, vorp double, pos array<string>")
    write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()["name"] == 'A "q"'
    assert ranking_lines(df).first()["line"].split() == ["1", "A", '"q"', "10.0", "1.0"]


def _events(spark):
    t = lambda m: dt.datetime(2050, 1, 1, 0, m)
    rows = [(1, t(1), 7, "click", 1.0), (2, t(2), 7, "click", 1.0), (3, t(3), 7, "click", 1.0), (4, t(1), 8, "purchase", 1.0), (5, t(2), 8, "click", 1.0), (6, t(3), 9, "error", 1.0)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_event_folds(spark):
    got = {r["user_id"]: r["state"] for r in ev.toggled(_events(spark), "user_id", "click", "purchase", "error").collect()}
    assert got == {7: True, 8: False, 9: False}
    level = ev.clamped_levels(_events(spark), "user_id", F.when(F.col("event_type") == "click", 1), 2)
    assert {r["user_id"]: r["level"] for r in level.collect()} == {7: 2, 8: 1}


def test_streams_equal_batches(spark, tmp_path):
    e = _events(spark)
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ev.event_stream(spark, str(tmp_path / "in"), "*.parquet")
    q = ev.toggle_stream(stream.select("user_id", "event_type", "ts", "event_id"), "user_id", "click", "purchase", "error").writeStream.format("memory").queryName("toggles").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = {r["user_id"]: r["n"] for r in spark.sql("select user_id, max(n) as n from toggles group by 1").collect()}
    assert n == {7: 3, 8: 2, 9: 1}
    q = ev.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, ev.windowed(e).collect()))
