"""Schema drift between files: rules, odd inputs and the routed table."""

import datetime as dt

from pyspark.sql import functions as F

from slatework.operators import schema_drift as S

FILES = "file_id long, edition string, header_row int, published_at timestamp, columns string, goalie_columns string, was string"


def _t(d):
    return dt.datetime(2050, 1, d)


def _changes(spark, *maps):
    rows = [(i, "E", 1, _t(i + 1), *(m if isinstance(m, tuple) else (m, None)), "clash") for i, m in enumerate(maps)]
    got = S.schema_changes(spark.createDataFrame(rows, FILES)).collect()
    return sorted((r["file_id"], r["section"], r["field"], r["change"]) for r in got)


def test_rules(spark):
    got = _changes(
        spark,
        '{"name": 1, "pos": 4, "G": "Goals", "A": 7, "X": "Old  Head"}',
        '﻿ {"A":8,"name":1,"elig":4,"G":"Scored","X":"OLD HEAD","B":9}',
        '{"name": 1, "elig": "4", "G": "Scored", "A": "2", "B": 9}',
        '{"name": 1, "elig": "5", "G": "Scored", "A": "2", "C": "b", "D": 9}',
    )
    assert got == [
        (1, "columns", "B", "added"), (1, "columns", "G", "renamed"), (1, "columns", "elig", "renamed"),
        (2, "columns", "A", "type"), (2, "columns", "X", "removed"), (2, "columns", "elig", "type"),
        (3, "columns", "C", "added"), (3, "columns", "D", "renamed"),
    ]


def test_absent_and_unreadable_mappings_are_empty(spark):
    assert _changes(spark, ('{"a": 1}', '{"g": 1}'), (None, None), ("no json", ""), ('{"a": 1}', "{}")) == [
        (1, "columns", "a", "removed"), (1, "goalie_columns", "g", "removed"), (3, "columns", "a", "added"),
    ]


def test_order_ties_repeats_and_nulls(spark):
    m = ['{"a": 1}', '{"b": 1}', '{"c": 1}']
    rows = [(2, "E", 1, _t(1), m[1], None, ""), (1, "E", 1, _t(1), m[0], None, ""), (3, None, 1, None, m[2], None, ""), (1, "E", 1, _t(1), m[0], None, "")]
    got = S.schema_changes(spark.createDataFrame(rows, FILES)).collect()
    assert [(r["file_id"], r["field"], r["change"], r["was"]) for r in got] == [(2, "b", "renamed", "a")]
    assert S.schema_changes(spark.createDataFrame([], FILES)).count() == 0


def test_one_edition_with_most_files(spark):
    rows = [(i, "hot", 1, _t(1), f'{{"k{i % 3}": 1}}', None, "") for i in range(300)]
    got = S.schema_changes(spark.createDataFrame(rows, FILES).repartition(6))
    assert got.where("change = 'renamed'").count() == 299
    origin = S.field_origins(spark.createDataFrame(rows, FILES))
    assert {r["origin"] for r in origin.collect()} == {"k0"}


def test_consistent_table(spark):
    files = spark.createDataFrame(
        [(1, "E", 2, _t(1), '{"name": 1, "team": 2, "pos": 3, "HIT": 4}', None, ""), (2, "E", 1, _t(2), '{"name": "Who", "team": 2, "pos": 3, "hits": 4, "SV%": 9}', None, "")], FILES
    )
    cells = spark.createDataFrame(
        [
            (1, "main", 1, ["banner"]), (1, "main", 2, ["Player", "Team", "Pos", "Hits"]), (1, "main", 3, ["Ann", "ABC", "C/LW", "'1,020.5"]), (1, "main", 4, ["Player", "Team", "Pos", "Hits"]),
            (1, "main", 5, ["League Average", "", "", "3"]), (1, "main", 6, [None, "x", "C", "1"]), (2, "main", 1, ["Who", "Team", "Pos", "Hits"]), (2, "main", 2, ["Bo", "ABC", "D", "--"]), (2, "other", 1, ["?"]),
        ],
        "file_id long, sheet string, row_no int, cells array<string>",
    ).withColumn("header_row", F.lit(7)).withColumn("heads", F.lit("clash"))
    got = {r["name"]: (r["file_id"], r["pos"], r["stats"]) for r in S.consistent_table(files, cells).collect()}
    assert got == {"Ann": (1, ["C", "LW"], {"HIT": 1020.5}), "Bo": (2, ["D"], {})}


def test_players_without_team_and_position_stay(spark):
    files = spark.createDataFrame([(1, "E", 1, _t(1), '{"name": 1, "team": 2, "pos": 3, "HIT": 4}', None, ""), (2, "E", 1, _t(2), '{"name": 1, "HIT": 2}', None, "")], FILES)
    cells = spark.createDataFrame(
        [
            (1, "main", 1, ["Player", "Team", "Pos", "Hits"]), (1, "main", 2, ["Ann", "", None, "3"]), (1, "main", 3, ["Cut Short"]), (1, "main", 4, ["League Average", "", "", "2"]), (1, "main", 5, ["TOTALS"]), (1, "main", 6, ["Sum", "ABC", "C", "1"]),
            (2, "main", 1, ["Player", "Hits"]), (2, "main", 2, ["Bo", "5"]), (2, "main", 3, ["Team average", "4"]),
        ],
        "file_id long, sheet string, row_no int, cells array<string>",
    )
    got = {r["name"]: (r["team"], r["pos"], r["stats"]) for r in S.consistent_table(files, cells).collect()}
    assert got == {"Ann": (None, [], {"HIT": 3.0}), "Cut Short": (None, [], {}), "Sum": ("ABC", ["C"], {"HIT": 1.0}), "Bo": (None, [], {"HIT": 5.0})}


def test_a_number_text_that_becomes_a_heading_is_renamed(spark):
    rows = [(1, "E", None, '{"PM": "13", "G": "5", "A": "Assists"}', None), (2, "E", dt.datetime(2050, 1, 1), '{"PM": "plus/minus", "G": "6", "A": " ASSISTS"}', None)]
    got = S.schema_changes(spark.createDataFrame(rows, "file_id long, edition string, published_at timestamp, columns string, goalie_columns string")).collect()
    assert [(r["field"], r["change"]) for r in got] == [("PM", "renamed")]


def test_versions(spark):
    maps = ['{"G": 1}', '{ "G":1 }', '{"G": 2}', None, '{"G": 2}']
    rows = [(i, None if i % 2 else "E", dt.datetime(2050, 1, 1 + i // 2), m, "{}") for i, m in enumerate(m for m in maps for _ in (0, 1))]
    v = S.schema_versions(spark.createDataFrame(rows, "file_id long, edition string, published_at timestamp, columns string, goalie_columns string").repartition(5))
    for odd in (0, 1):
        got = {r["file_id"] // 2: r["version"] for r in v.where("section = 'columns'").collect() if r["file_id"] % 2 == odd}
        assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["version"] for r in v.where("section = 'goalie_columns'").collect()} == {1}
    assert S.schema_versions(spark.createDataFrame([], "file_id long, edition string, published_at timestamp, columns string, goalie_columns string")).count() == 0
