"""Distributed ordered operators against plain Python, also with one hot group."""

import random

from pyspark.sql import functions as F

from slatework.operators.ordering import global_row_number, linear_percentiles, nth_smallest, previous_row, rank_within, running


def _rows(n=400, seed=1):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + ["a", "b", None]), r.randint(0, 50), i, r.choice([None, 1, 2, 3])) for i in range(n)]


def test_previous_and_running(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, k int, id long, v int").repartition(5)
    prev = {r["id"]: r["prev"]["id"] if r["prev"] else None for r in previous_row(df, ["g"], [F.col("k"), F.col("id")]).collect()}
    run = {r["id"]: (r["s"], r["l"]) for r in running(df, ["g"], [F.col("k"), F.col("id")], {"s": F.col("v")}, {"l": F.col("v")}).collect()}
    rank = {r["id"]: r["n"] for r in rank_within(df, ["g"], [F.col("k"), F.col("id")], "n").collect()}
    for g in {x[0] for x in rows}:
        before, total, last = None, 0, None
        for n, (_, _, i, v) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])), 1):
            total += v or 0
            assert (prev[i], run[i], rank[i]) == (before, (total, last), n)
            before, last = i, v if v is not None else last


def test_global_row_number_and_nth(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, k int, id long, v int").repartition(7)
    got = {r["id"]: r["rn"] for r in global_row_number(df, [F.desc("k"), F.col("id")]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [x[2] for x in sorted(rows, key=lambda x: (-x[1], x[2]))]
    mid = {r["g"]: r["m"] for r in nth_smallest(df, ["g"], "k", F.floor(F.col("n") / 2), "m").collect()}
    for g in mid:
        k = sorted(x[1] for x in rows if x[0] == g)
        assert mid[g] == k[len(k) // 2]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, k int, id long, v int")
    assert global_row_number(df, [F.col("k")]).count() == 0
    assert previous_row(df, ["g"], [F.col("k")]).count() == 0
    assert running(df, ["g"], [F.col("k")], {"s": F.col("v")}).count() == 0


def test_percentiles(spark):
    df = lambda v: spark.createDataFrame([(x,) for x in v], "v double")
    assert linear_percentiles(df([4.0, 1.0, 3.0, 2.0, None, float("nan")]), "v", [0.5, 0.0, 1.0]) == [2.5, 1.0, 4.0]
    assert linear_percentiles(df([5.0]), "v", [0.75]) == [5.0]
    assert linear_percentiles(df([None]), "v", [0.5]) is None
    many = [float(i % 97) for i in range(5000)]
    want = spark.createDataFrame([(x,) for x in many], "v double").selectExpr("percentile(v, array(0.25, 0.75))").first()[0]
    assert linear_percentiles(df(many).repartition(9), "v", [0.25, 0.75]) == want
