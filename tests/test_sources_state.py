"""Lists, imports, output and state: small cases, nulls, repeats and empty tables."""

import datetime as dt
import json

import pytest

from slatework.functions import teams
from slatework.operators import blend, metrics
from slatework.operators import board as bd
from slatework.sources import infer, reader, sinks
from slatework.streaming import events as ev


def cells(spark, rows, first=1):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows, first)], "row_no long, cells array<string>")


def test_teams(spark):
    t = spark.createDataFrame([("Wolves", "ABC", "nickname"), ("A.C", "ABC", "short"), ("ABC", "ABC", "code"), (None, "X", "code")], "spelling string, code string, kind string")
    names, codes = teams.spelling_maps(t)
    got = spark.createDataFrame([(" wolves ",), ("a.c",), ("zz",), ("  ",), (None,)], "t string").select(teams.normalize_team(teams.F.col("t"), names, codes).alias("c"))
    assert [r["c"] for r in got.collect()] == ["ABC", "ABC", "ZZ", "", ""]
    known = got.select(teams.is_known_team(teams.F.col("c"), ["ABC"]).alias("k")).collect()
    assert [r["k"] for r in known] == [True, True, False, False, False]


def test_two_sheets(spark):
    rows = [("main", 1, ["Name", "Pos", "G"]), ("main", 2, ["a b", "C", "5"]), ("main", 3, ["c d", "G", "7"]), ("goalie", 1, ["banner", None, None]), ("goalie", 2, ["Player", "W", "Pos"]), ("goalie", 3, ["e f", "30", "G"])]
    sheets = spark.createDataFrame(rows, "sheet string, row_no int, cells array<string>")
    one = reader.SourceSpec("s", {"name": "Name", "pos": "Pos", "G": "G"}, goalie_columns={"name": 1, "pos": 3, "W": "W"}, goalie_sheet="goalie", goalie_header_row=2)
    got = {r["key"]: r["stats"] for r in reader.read_sheets(sheets, one).collect()}
    assert got == {"a b": {"G": 5.0}, "c d": {"G": 7.0}, "e f": {"W": 30.0}}


def test_lists(spark):
    ages = cells(spark, [["# ages"], ["Name", "Age"], ["A B", "30.5"], ["A B", "31.5"], ["c", "x"], [None, "3"], ["d"]])
    assert {r["key"]: r["age"] for r in reader.read_ages(ages).collect()} == {"a b": 32}
    alias = cells(spark, [["# spelling", None], ["alias", "canonical"], ["Mats B.", "Mats Berg"], ["", "x"], ["y", None]])
    assert [tuple(r) for r in reader.read_aliases(alias).collect()] == [("mats b", "mats berg")]
    sheets = [cells(spark, [["h", "v", "w"], ["A", "1", "9"], ["B", "2", "-"]]), cells(spark, [["h", "v", "w"], ["A", "3", "8"]])]
    got = {(r["key"], r["provider"]): r["value"] for r in reader.read_pick_sheets(sheets, {"p": 2, "q": 3}).collect()}
    assert got == {("a", "p"): 3.0, ("b", "p"): 2.0, ("a", "q"): 8.0}
    ref = reader.reference_list(cells(spark, [["A", "C, LW", "30.5"], ["A", "D", "1"], ["", "D", "1"]]), 1, 2, 3).collect()
    assert [tuple(r) for r in ref] == [("a", ["C", "LW"], 30)]


def test_rows_are_read_once_while_a_file_stays(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("a,b\n1,2\n")
    one = reader.load_rows(spark, str(f))
    assert one.count() == 2
    assert reader.load_rows(spark, str(f)) is one
    f.write_text("a,b\n1,2\n3,4\n")
    assert reader.load_rows(spark, str(f)).count() == 3
    assert reader.load_rows(spark, str(tmp_path / "none.csv")).count() == 0
    assert reader.load_rows(spark, str(f), max_col=1).first()["cells"] == ["a"]


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    f.write_text("\ufeff" + json.dumps({"teams": 10, "k": "many"}), encoding="utf-8")
    assert reader.load_settings(str(f), {"teams": 12, "k": 1.0, "label": "x"}) == {"teams": 10, "k": 1.0, "label": "x"}
    f.write_text("[1]")
    with pytest.raises(reader.SpecError):
        reader.load_settings(str(f), {})


def test_import(spark):
    rows = [["junk", None, None, None, None], ["Player", "G", "A", "Points", "Games Started"], *[[f"p {i}", str(i), "2", "99", "10"] for i in range(8)], ["p 1", "50", "1", "1", "1"], ["--", "1", "1", "1", "1"], ["empty", "", "-", "", ""]]
    sheet = cells(spark, rows)
    cols = infer.auto_map(sheet)
    assert [c["field"] for c in cols] == ["name", "G", "A", None, "GP"]
    assert [c["uncertain"] for c in cols] == [False, False, False, True, True]
    built = infer.build_source(sheet, cols, ["GP", "G", "A"], 2, True, ("G",))
    got = {r["key"]: r["stats"] for r in built.collect()}
    assert len(got) == 8
    assert got["p 1"] == {"GP": 10.0, "G": 10.0, "A": 2.0}
    board = spark.createDataFrame([("p 1", "S", 3, 1, "P One", "T", ["C"], 20.0, {"G": 1.0})], "key string, source string, source_ord int, row_no long, name string, team string, pos array<string>, age double, stats map<string,double>")
    both, weights, new = infer.commit_import(board, {"S": 1.0, "import-1": 2.0}, built)
    assert (new, weights["import-2"], both.count()) == ("import-2", 1.0, 9)
    with pytest.raises(ValueError, match="name"):
        infer.build_source(sheet, [], ["G"])
    assert infer.auto_map(sheet.limit(0)) == []


def test_output(spark, tmp_path):
    b = spark.createDataFrame(
        [(1, 'A "X" B', "T", ["C", "LW"], "C", 2, 1.005, 0.0, 10.0, 0.5, None, "C1 L2", None, 3, 9.0, 7.0, 4, 2, "star", True, None)],
        "rank long, name string, team string, pos array<string>, best_pos string, tier int, vorp double, drop_off double, points double, per_game double, gp double, label string, pick double, last_rank int, last_points double, last_gp double, sources int, adjustment int, mark string, taken boolean, mine boolean",
    )
    head, lines = sinks.ranking_csv(b, "24-25")
    assert len(head.split(",")) == 16
    assert lines.first()["line"] == '1,"A ""X"" B",T,"C/LW",C2,1.01,0.00,10.00,0.500,,"C1 L2",,3,9.00,7,4'
    head, lines = sinks.ranking_csv(b, view=True)
    assert len(head.split(",")) == 19
    assert lines.first()["line"] == '1,"A ""X"" B",T,"C/LW",2,star,C2,1.01,0.00,10.00,0.500,,"C1 L2",,3,9.00,7,Y,'
    assert sinks.ranking_text(b, {"C": 1.25})[-1] == "Replacement level:  C 1.2"
    sinks.write_list(spark.createDataFrame([("b,c", 2.0), ("a", None)], "name string, pick double"), str(tmp_path / "list"), "name", ("made here",))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "list")).collect() if r["value"]] in (["# made here", "name,pick", "a,", '"b,c",2.0'],)
    p = sinks.payload(spark.createDataFrame([(1, "a")], "player long, name string"), spark.createDataFrame([(1, {"S": [1.0]})], "player long, lines map<string,array<double>>"), ["G"], spark.range(1), spark.range(0))
    assert {r["part"]: json.loads(r["json"]) for r in p.collect()}["players"] == {"player": 1, "name": "a", "lines": {"S": [1.0]}}


def test_views(spark):
    r = spark.createDataFrame([(1, "Bo Ek", "T", 1, {"p": 4.0}), (2, "Bo Al", "T", 2, None)], "player long, name string, team string, rank long, picks map<string,double>")
    gone = spark.createDataFrame([(1,)], "player long")
    assert metrics.hide_taken(r, gone).count() == 1
    assert metrics.hide_taken(r, gone, "mine").count() == 2
    assert metrics.first_free_match(r, gone, "bo").first()["player"] == 2
    assert metrics.first_free_match(r, gone, " ").count() == 0
    assert [x["pick"] for x in metrics.pick_of(r, "p").orderBy("rank").collect()] == [4.0, None]
    assert [x["pick"] for x in metrics.pick_of(r, None).collect()] == [None, None]
    lines = spark.createDataFrame([(1, "S", "G", 1.0), (1, "S", "HIT", None), (1, "S", "GP", 3.0), (2, "T", "A", float("nan"))], "player long, source string, stat string, value double")
    assert {x["stat"] for x in blend.shown_stats(lines, ["G", "HIT", "A"]).collect()} == {"G", "GP"}
    goalies = spark.createDataFrame([(1, ["G"])], "player long, pos array<string>")
    assert [tuple(x) for x in blend.coverage(lines, goalies).collect()] == [("S", 1, 2, True)]


def test_state(spark):
    b = spark.createDataFrame([(1, "Bo Ek"), (2, "Al Om")], "player long, name string")
    saved = spark.createDataFrame([(2, "BO EK", 1), (1, "2", 2), (1, "x", 3), (2, "gone", 4), (None, "Bo Ek", 5)], "version int, ref string, level int")
    got, missing = bd.saved_state(b, saved)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 2)}
    assert [r["name"] for r in missing.collect()] == ["gone"]
    assert {tuple(r) for r in bd.save_state(b, got).collect()} == {(2, "Bo Ek", 1), (2, "Al Om", 2)}


def _log(spark, kinds):
    at = dt.datetime(2050, 1, 1)
    return spark.createDataFrame([(k, at + dt.timedelta(seconds=i // 2), i, e) for i, (k, e) in enumerate(kinds)], "k long, ts timestamp, event_id long, event_type string")


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_folds(spark, monkeypatch, block):
    """A key with nearly all events, in blocks of several sizes, against a plain loop."""
    monkeypatch.setattr(ev, "FOLD", block)
    import random

    rng = random.Random(block)
    log = [(rng.choice([1, 1, 1, 1, 2]), rng.choice(["d", "m", "other"])) for _ in range(400)]
    want: dict = {}
    for k, e in log:
        drafted, mine = want.get(k, (False, False))
        if e == "m":
            drafted, mine = (False, False) if mine else (True, True)
        elif e == "d":
            drafted, mine = (False, False) if drafted else (True, mine)
        want[k] = (drafted, mine)
    got = {r["k"]: (r["drafted"], r["mine"]) for r in ev.drafted_state(_log(spark, log), "k", "d", "m").collect()}
    assert got == want
    assert {r["k"]: r["mark"] for r in ev.exclusive_marks(_log(spark, [(1, "d"), (1, "m"), (2, "m"), (2, "m")]), "k", ["d", "m"]).collect()} == {1: "m", 2: None}
    assert ev.drafted_state(_log(spark, log).limit(0), "k", "d", "m").count() == 0
