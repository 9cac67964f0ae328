"""State joins, schedules, interchange, slot filling and pasted lists."""

from pyspark.sql import functions as F

from slatework.functions.scalars import escape_html, heading_key, level_label, ordinal, rounded
from slatework.operators import board as B
from slatework.sources.paste import paste_pairs


def test_by_name_and_state(spark):
    board = spark.createDataFrame([(1, "Bo"), (2, "BO"), (3, "Al"), (4, None)], "player long, name string")
    state = spark.createDataFrame([("bo", True), ("Cy", False), (None, True)], "name string, drafted boolean")
    hit, missing = B.by_name(board, state)
    assert [(r["player"], r["drafted"]) for r in hit.collect()] == [(2, True)]
    assert {r["name"] for r in missing.collect()} == {"Cy", None}
    assert {r["player"] for r in B.in_state(board, hit, F.col("drafted"), keep=False).collect()} == {1, 3, 4}


def test_schedule(spark):
    board = spark.createDataFrame([(1, "A"), (2, "Z")], "player long, team string")
    schedule = spark.createDataFrame([("A", 40), ("B", 30), ("C", 20)], "team string, nights int")
    assert {r["player"]: r["nights_band"] for r in B.attach_schedule(board, schedule, ("nights",)).collect()} == {1: 1, 2: None}
    window = spark.createDataFrame([("A", 3), ("Q", 4)], "team string, games int")
    assert [r["team"] for r in B.attach_window(schedule, window).collect()] == ["A"]


def test_interchange_and_import(spark):
    lines = spark.createDataFrame([(1, "s", "G", 1.23456789), (1, "t", "A", 2.0), (1, "t", "Z", 9.0)], "player long, source string, stat string, value double")
    assert B.interchange(lines, ["G", "A"]).first()["lines"] == {"s": [1.234568, None], "t": [None, 2.0]}
    kind = "key string, source string, source_ord int, row_no int, name string, team string, pos array<string>, age double, stats map<string,double>"
    own = spark.createDataFrame([("matthew boldy", "s", 0, 1, "Matthew Boldy", "A", ["C"], 20.0, {"G": 1.0})], kind)
    new = spark.createDataFrame([("matt boldy", "i", 9, 1, "Matt Boldy", "B", ["D"], 30.0, {"G": 2.0}), ("new one", "i", 9, 2, "New One", None, [], None, {})], kind)
    taken = spark.createDataFrame([("matt boldy", "matthew boldy")], "key string, candidate string")
    got = {r["key"]: (r["name"], r["lines"]) for r in B.merge_import(own, new, taken).collect()}
    assert got == {"matthew boldy": ("Matthew Boldy", {"s": {"G": 1.0}, "i": {"G": 2.0}}), "new one": ("New One", {"i": {}})}


def test_fill_slots(spark):
    picks = spark.createDataFrame([("me", 1, 9.0, ["C", "LW"]), ("me", 2, 8.0, ["C"]), ("me", 3, 7.0, ["C"]), ("me", 4, 6.0, []), ("you", 5, 1.0, ["C"])], "owner string, player long, vorp double, pos array<string>")
    got = {r["player"]: r["slot"] for r in B.fill_slots(picks, {"C": 1, "F": 1}, {"F": ["C", "LW", "RW"]}).collect()}
    assert got == {1: "C", 2: "F", 3: "XTRA", 4: "XTRA", 5: "C"}
    assert B.fill_slots(picks.limit(0), {"C": 1}, {}).count() == 0


def test_paste(spark):
    text = ["Rank", "1.5 20 30%", "Bo Ek", "ABC - C", "Al Ny", "7", "badge!", "2.5", "Cy O'Hara"]
    got = paste_pairs(spark.createDataFrame(list(enumerate(text)), "row_no int, line string").repartition(3))
    assert [(r["name"], r["value"]) for r in got.orderBy("row_no").collect()] == [("Bo Ek", 1.5), ("Cy O'Hara", 2.5)]


def test_texts(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)], "n int").select(ordinal(F.col("n")).alias("o"))
    assert [r["o"] for r in df.collect()] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    r = spark.range(1).select(escape_html(F.lit('<a & "b">')).alias("h"), level_label(F.lit(-2)).alias("l"), level_label(F.lit(0)).alias("z"), rounded(F.lit(2.5), 0).alias("r"), heading_key(F.lit("'Pts  (Total)/60")).alias("k")).first()
    assert tuple(r) == ("&lt;a &amp; &quot;b&quot;&gt;", "−−", "", 2.0, "pts total /60")
