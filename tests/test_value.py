"""Hand-computed cases of blending, scoring, replacement, tiers and drop-off."""

import pytest

from slatework.operators import blend, metrics, score, value
from slatework.plans import valuation

LINES = [(1, "S1", "GP", 80.0), (1, "S1", "G", 40.0), (1, "S1", "A", 40.0), (1, "S2", "GP", 100.0), (1, "S2", "G", 50.0), (2, "S1", "GP", 82.0), (2, "S1", "G", 30.0), (2, "S1", "A", 30.0)]


def _lines(spark, rows=LINES):
    return spark.createDataFrame(rows, "player long, source string, stat string, value double")


def _weights(spark, *w):
    return spark.createDataFrame(list(w), "source string, weight double")


def _got(df):
    return {(r["player"], r["stat"]): r["value"] for r in df.collect()}


def test_blend_totals(spark):
    got = _got(blend.blend_totals(_lines(spark), _weights(spark, ("S1", 1.0), ("S2", 1.0))))
    assert (got[1, "GP"], got[1, "G"], got[1, "A"]) == (90, 45, 40)
    got = _got(blend.blend_totals(_lines(spark), _weights(spark, ("S1", 3.0), ("S2", 1.0))))
    assert (got[1, "GP"], got[1, "G"]) == (85, 42.5)
    got = _got(blend.blend_totals(_lines(spark), _weights(spark, ("S1", 0.0), ("S2", None))))
    assert set(got.values()) == {None}


def test_blend_rates(spark):
    w = _weights(spark, ("S1", 1.0), ("S2", 1.0))
    got = _got(blend.blend_rates(_lines(spark), w, ["G", "A"]))
    assert (got[1, "GP"], got[1, "G"], got[1, "A"]) == (90, 45, 45)
    got = _got(blend.blend_rates(_lines(spark), w, ["G", "A"], volume_source="S2"))
    assert (got[1, "GP"], got[1, "G"]) == (100, 50)
    assert (got[2, "GP"], got[2, "G"]) == (82, 30)


def test_blend_ignores_nan_and_scale_of_weights(spark):
    rows = [*LINES, (1, "S3", "G", float("nan"))]
    a = _got(blend.blend_totals(_lines(spark, rows), _weights(spark, ("S1", 1.0), ("S2", 2.0), ("S3", 5.0))))
    b = _got(blend.blend_totals(_lines(spark, rows[::-1]), _weights(spark, ("S1", 10.0), ("S2", 20.0), ("S3", 50.0))))
    assert a == b


@pytest.mark.parametrize(
    ("stats", "pos", "scoring", "bonus", "points"),
    [
        ({"GP": 80, "G": 40, "A": 40}, ["C"], {"G": 4, "A": 2.5}, (0, 0), 260),
        ({"GP": 80, "G": 40}, ["C"], {"G": 4, "A": 2.5}, (0, 0), 160),
        ({"GP": 80, "G": 10, "A": 30, "PTS": 40}, ["D"], {"G": 4, "A": 2.5}, (1, 0), 155),
        ({"GP": 80, "G": 10, "A": 30}, ["D"], {}, (1, 0), 40),
        ({"GP": 80}, ["D"], {}, (1, 0), 0),
        ({"GP": 60, "G": 0, "A": 0}, ["G"], {"G": 1}, (0, -0.5), -30),
        ({"GP": 80, "G": 10, "A": 30, "PTS": 40}, ["D", "G"], {}, (1, 1), 120),
    ],
)
def test_score(spark, stats, pos, scoring, bonus, points):
    lines = spark.createDataFrame([(1, k, float(v)) for k, v in stats.items()], "player long, stat string, value double")
    positions = spark.createDataFrame([(1, pos)], "player long, pos array<string>")
    assert score.score(lines, scoring, positions, *bonus).first()["points"] == points


def test_slots():
    slots = {"C": 2, "LW": 2, "RW": 2, "D": 4, "G": 2, "BN": 4}
    got = value.positional_slots(slots, 12)
    assert round(got["C"], 4) == 34.6667
    assert (got["D"], got["G"]) == (56, 32)
    assert value.positional_slots(slots, 12, False)["C"] == 24
    assert value.positional_slots({"C": 1, "W": 2, "F": 3}, 1)["LW"] == 2
    assert value.roster_spots(slots) == 16


def _players(spark, rows):
    return spark.createDataFrame(rows, "player long, name string, points double, pos array<string>")


def test_replacement_and_value(spark):
    p = _players(spark, [(i, f"c{i}", 100.0 - 10 * i, ["C"]) for i in range(5)])
    levels = {r["position"]: (r["level"], r["depth"]) for r in value.nth_best(p, {"C": 2.0}).collect()}
    assert levels["C"] == (80, 3)
    assert levels["G"] == (0, 0)
    assert {r["position"]: r["level"] for r in value.nth_best(p, {"C": 99.0}).collect()}["C"] == 60
    repl = spark.createDataFrame([("C", 100.0), ("LW", 60.0)], "position string, level double")
    both = value.best_value(_players(spark, [(1, "x", 120.0, ["C", "LW"]), (2, "y", 120.0, ["C"]), (3, "z", 7.0, [])]), repl)
    assert [(r["vorp"], r["best_pos"]) for r in both.orderBy("player").collect()] == [(60, "LW"), (20, "C"), (7, None)]


def test_draft_replacement_and_rank(spark):
    rows = [(i, f"f{i}", 500.0 - 2 * i, [["C"], ["LW"], ["RW"]][i % 3]) for i in range(60)] + [(100 + i, f"g{i}", 300.0 - 8 * i, ["G"]) for i in range(24)]
    p = _players(spark, rows)
    slots = value.positional_slots({"C": 1, "D": 1, "G": 1}, 4)
    levels = {r["position"]: r["level"] for r in value.draft_replacement(p, slots).collect()}
    assert levels["G"] == 300 - 8 * 4
    assert levels["C"] == 500 - 2 * 6  # the four best forwards hold two centres
    ranked = value.overall_rank(value.best_value(p, value.draft_replacement(p, slots)))
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 85))


@pytest.mark.parametrize(
    ("vorp", "depth", "tiers"),
    [
        ([100, 99, 98, 60, 59, 58], None, [1, 1, 1, 2, 2, 2]),
        ([200, 100, 99, 98, 97], None, [1, 2, 2, 2, 2]),
        ([50, 40, 30, 20, 10], None, [1] * 5),
        ([7], None, [1]),
        ([], None, []),
    ],
)
def test_gap_tiers(spark, vorp, depth, tiers):
    df = spark.createDataFrame([(i, float(v), "C") for i, v in enumerate(vorp)], "player long, vorp double, best_pos string")
    assert [r["tier"] for r in value.gap_tiers(df, 1.0, depth).orderBy("player").collect()] == tiers


def test_gap_tiers_window(spark):
    vorp = [100, 90, 80, 70, 60] + [59.9 - 0.01 * i for i in range(200)]
    df = spark.createDataFrame([(i, float(v), "C") for i, v in enumerate(vorp)], "player long, vorp double, best_pos string")
    tier = lambda d: {r["player"]: r["tier"] for r in value.gap_tiers(df, 1.0, d).collect()}
    assert tier({"C": 5})[1] == 1
    assert tier(None)[1] > 1


def test_drop_off(spark):
    p = spark.createDataFrame([(i, f"G{i}", 300.0 - 8 * i, ["G"], "G", i + 1) for i in range(6)] + [(9, "tie", 260.0, ["G"], "G", 7)], "player long, name string, points double, pos array<string>, best_pos string, rank long")
    got = {r["player"]: (r["drop_off"], r["next_up"]) for r in value.drop_off(p).collect()}
    assert got[0] == (8, "G1")
    assert got[5] == (0, "")
    assert got[4] == (8, "G5")
    gone = spark.createDataFrame([(1,), (2,), (3,)], "player long")
    assert {r["player"]: (r["drop_off"], r["next_up"]) for r in value.drop_off(p, gone).collect()}[0] == (32, "G4")


def test_drop_off_counts_all_who_may_play_the_position(spark):
    """The next centre is better placed as a wing, but may still play centre."""
    rows = [(1, "a", 10.0, ["C"], "C", 1), (2, "b", 8.0, ["C", "LW"], "LW", 2), (3, "c", 5.0, ["C"], "C", 3), (4, "d", 1.0, [], None, 4)]
    p = spark.createDataFrame(rows, "player long, name string, points double, pos array<string>, best_pos string, rank long")
    assert {r["player"]: (r["drop_off"], r["next_up"]) for r in value.drop_off(p).collect()} == {1: (2, "b"), 2: (0, ""), 3: (0, ""), 4: (0, "")}


def test_consumed_and_spots(spark):
    p = spark.createDataFrame([(1, ["C", "D"]), (2, ["G", "C"]), (3, ["LW"]), (4, []), (5, ["D"])], "player long, pos array<string>")
    gone = spark.createDataFrame([(1,), (2,), (3,), (3,), (99,)], "player long")
    used = value.consumed_counts(p, gone)
    assert used == {"F": 1, "D": 1, "G": 1}
    assert value.remaining_spots({"C": 2, "BN": 1}, 4, sum(used.values())) == 9
    assert value.remaining_spots({"C": 1}, 1, 5) == 1
    assert value.consumed_counts(p.limit(0), gone) == {"F": 0, "D": 0, "G": 0}


def test_valuation(spark):
    """Last season is one source as it was; unusable settings fall back."""
    players = spark.createDataFrame([(1, "a", ["C"]), (2, "b", ["C"]), (3, "c", ["G"]), (4, "d", [])], "player long, name string, pos array<string>")
    lines = spark.createDataFrame([(i, s, k, float(v if s == "S" else 100 - v)) for i, v in ((1, 10), (2, 20), (3, 30)) for s in ("S", "ACT") for k in ("GP", "G")], "player long, source string, stat string, value double")
    weights = spark.createDataFrame([("S", 1.0)], "source string, weight double")
    s = valuation.Settings({"G": 1.0, "A": float("nan")}, {"C": 1, "G": float("inf")}, teams=1, minimum_games=float("nan"))
    v = valuation.valuation(players, lines, weights, s)
    assert [(r["player"], r["points"], r["vorp"]) for r in v.board.orderBy("rank").collect()] == [(2, 20.0, 10.0), (1, 10.0, 0.0), (3, 30.0, 0.0), (4, 0.0, 0.0)]
    assert v.spots == 1
    last = valuation.history(players, lines, s, "ACT").board
    got = {r["player"]: (r["last_points"], r["last_gp"]) for r in valuation.with_last_season(v.board, last).collect()}
    assert got == {1: (90.0, 90.0), 2: (80.0, 80.0), 3: (70.0, 70.0), 4: (None, None)}
    assert valuation.valuation(players.limit(0), lines, weights, s).board.count() == 0


def test_adjust(spark):
    lines = spark.createDataFrame([(1, "W", 30.0), (1, "GA", 150.0), (1, "HIT", 9.0)], "player long, stat string, value double")
    level = spark.createDataFrame([(1, 3)], "player long, level int")
    got = {r["stat"]: r["value"] for r in score.adjust(lines, level, [0.05, 0.1, 0.2], ["W", "GA"], {"W": 1, "GA": -1}).collect()}
    assert (round(got["W"], 9), round(got["GA"], 9), got["HIT"]) == (36, 120, 9)


def test_overlays_and_bands(spark):
    players = spark.createDataFrame([("b", 31.0), ("c", 39.0), ("d", None)], "key string, age double")
    listed = spark.createDataFrame([("b", 30.0), ("c", 19.0), ("d", 22.0)], "key string, age double")
    got = {r["key"]: (r["age"], r["rejected"]) for r in metrics.overlay_ages(players, listed).collect()}
    assert got == {"b": (30, None), "c": (39, 19), "d": (22, None)}
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert sorted((r["v"] or 0, r["band"]) for r in metrics.percentile_bands(v, "v", "band").collect()) == [(0, 0), (1, -1), (2, 0), (3, 0), (10, 1)]
    assert {r["band"] for r in metrics.percentile_bands(v.where("v is null"), "v", "band").collect()} == {0}
