"""Truth discovery: the strict order, the plain vote, odd inputs and one hot listing."""

import datetime as dt

import pytest

from slatework.llm import survivors as S

ROW = "row_id long, listing_id long, source_id string, feed string, team string, pos array<string>, age double, seen_at timestamp, value string, entity string, precedence int"


def _rows(spark, data):
    full = [(i, ls, s, f, t, p, a, None if d is None else dt.datetime(2050, 1, 1) + dt.timedelta(hours=d), "clash", "clash", 1) for i, ls, s, f, t, p, a, d in data]
    return spark.createDataFrame(full, ROW)


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([("Abc", "ABC", "code"), ("Wolves", "ABC", "nickname"), ("XYZ", "XYZ", "code")], "spelling string, code string, kind string")


def test_strict_order(spark, teams):
    got = S.latest_survivors(
        _rows(
            spark,
            [
                (1, 1, "s", "primary", " aBC ", ["C"], 20.0, 1), (2, 1, "s", "primary", "nowhere", [], 16.0, 9), (3, 1, "s", "mirror", "XYZ", ["W", "G"], 50.0, 5), (4, 1, "s", "primary", "wolves", ["X"], float("nan"), 5),
                (5, 1, "s", "primary", "XYZ", None, None, 5),  # a tie with 4: the lower row wins
                (6, 2, "s", "primary", None, None, None, None), (7, 2, "s", "primary", "", [], 51.0, None),
                (8, 3, "s", "primary", "ABC", ["C"], 20.0, 1),  # one row only
                (9, 4, "s", "mirror", "ABC", ["C"], 20.0, None), (9, 4, "s", "mirror", "ABC", ["C"], 20.0, None),
            ],
        ),
        teams,
    )
    assert {tuple(r) for r in got.collect()} == {(1, 4, 3, 3), (2, -1, -1, -1), (4, 9, 9, 9)}


def test_strict_order_against_brute_force_with_a_hot_listing(spark, teams):
    import random

    r = random.Random(2)
    data = [(i, 1 if i % 3 == 0 else r.randint(2, 40), "s", r.choice(["primary", "mirror"]), r.choice(["ABC", "XYZ", "?", None]), r.choice([["C"], ["D"], ["F"], None]), r.choice([17.0, 30.5, 99.0, None]), r.randint(0, 9)) for i in range(400)]
    got = {x["listing_id"]: tuple(x)[1:] for x in S.latest_survivors(_rows(spark, data), teams).collect()}
    usable = (lambda x: x[4] in ("ABC", "XYZ"), lambda x: bool(x[5]) and x[5][0] in "CD", lambda x: x[6] is not None and 17 <= x[6] <= 50)
    for ls in {x[1] for x in data}:
        mine = [x for x in data if x[1] == ls]
        if len(mine) < 2:
            assert ls not in got
            continue
        want = tuple(min(((-x[7], x[3] != "primary", x[0]) for x in mine if u(x)), default=(0, 0, -1))[2] for u in usable)
        assert got[ls] == want


def test_strict_order_needs_no_truth_discovery(spark, teams, monkeypatch):
    data = [(i, i % 7, "s" if i % 3 else "z", "mirror" if i % 2 else "primary", ("ABC", "XYZ", "?")[i % 3], [("C", "D", "F")[i % 3]], 15.0 + i % 5, i % 4) for i in range(60)]
    elected, _ = S.discover(S.listing_claims(_rows(spark, data), teams), rest=0.01)
    want = {(r["entity"], r["field"]): -r["precedence"]["neg_id"] for r in elected.collect()}
    monkeypatch.setattr(S, "discover", None)
    monkeypatch.setattr(S, "store", None)
    got = S.latest_survivors(_rows(spark, data), teams).collect()
    assert {(r["listing_id"], f): r[f"{f}_row_id"] for r in got for f in S.FIELDS} == want


def test_vote_and_reliability(spark, teams):
    data = []
    for ls in range(1, 21):
        for k, (src, feed, team) in enumerate([("a", "primary", "ABC"), ("a", "primary", "ABC"), ("a", "mirror", "XYZ")]):
            data.append((ls * 10 + k, ls, src, feed, team, ["C"], 20.0, k))
    got = S.voted_survivors(_rows(spark, data), teams).collect()
    assert {r["team"] for r in got} == {"ABC"}
    assert all(r["pos"] == ["C"] and r["age"] == 20.0 and r["team_share"] > 0.9 for r in got)
    trust = {(r["feed"], r["field"]): r["reliability"] for r in S.source_reliability(_rows(spark, data), teams).collect()}
    assert trust["primary", "team"] > 0.9 > 0.3 > trust["mirror", "team"]
    with pytest.raises(ValueError, match="rest"):
        S.discover(S.listing_claims(_rows(spark, data), teams), rest=0.5)


def test_empty(spark, teams):
    assert S.latest_survivors(_rows(spark, []), teams).count() == 0
    assert S.voted_survivors(_rows(spark, []), teams.limit(0)).count() == 0
    assert S.source_reliability(_rows(spark, []), teams).count() == 0


def test_rows_without_a_listing_are_one_listing(spark, teams):
    data = [(1, None, "s", "primary", "ABC", ["C"], 20.0, 1), (2, None, "s", "mirror", "XYZ", None, 30.0, 2), (3, 7, "s", "mirror", "XYZ", ["D"], 30.0, 2)]
    assert [tuple(r) for r in S.latest_survivors(_rows(spark, data), teams).collect()] == [(None, 2, 1, 2)]
    got = S.voted_survivors(_rows(spark, data), teams).first()
    assert (got["n_rows"], got["pos"]) == (2, ["C"])
