"""Entity identity: aliases, merging of sources, fuzzy suggestions and dedupe rules."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.functions.scalars import surname
from slatework.session import cut


def alias_closure(aliases: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``alias, canonical``: every alias with the end of its chain.

    Input: ``alias, canonical`` as keys; null, empty and self-pointing rows are ignored, of repeated
    aliases the least target counts. Pointers double each round, so a chain of ``2**40`` steps is
    followed. An alias that leads into a cycle stands for the cycle's least key.
    """
    edges = aliases.where("alias is not null and canonical is not null and alias != '' and canonical != '' and alias != canonical")
    tree = cut(edges.groupBy("alias").agg(F.min("canonical").alias("to")).withColumn("least", F.col("to")))
    n = 0
    for n in range(max_rounds):
        step = tree.select(F.col("alias").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        new = tree.join(step, "to", "left").select("alias", F.coalesce("to2", "to").alias("to"), F.least("least", F.coalesce("least2", "least")).alias("least"), F.col("to2").isNotNull().alias("moved"))
        new = cut(new)
        left, tree = new.where("moved").count(), new.drop("moved")
        if left == 0 or 2 ** (n + 1) > new.count() + 1:
            break
    # What still points at an alias after more steps than there are aliases is in or before a cycle.
    ends = tree.join(tree.select(F.col("alias").alias("to"), F.lit(True).alias("_loop")), "to", "left")
    return ends.select("alias", F.when(F.col("_loop"), F.col("least")).otherwise(F.col("to")).alias("canonical"))


def resolve(df: DataFrame, key: str, closure: DataFrame) -> DataFrame:
    """``df`` with ``key`` replaced by its canonical one."""
    other = [c for c in df.columns if c != key]
    j = df.join(closure.select(F.col("alias").alias(key), F.col("canonical").alias("_canonical")), key, "left")
    return j.select(F.coalesce("_canonical", key).alias(key), *other)


def _first(c: str, blank: Column, order: Column) -> Column:
    return F.min_by(F.col(c), F.when(~blank, order))


def merge_sources(rows: DataFrame) -> DataFrame:
    """One row per ``key``: identity from the first source that has it, statistics of every source.

    Input: ``key, source, source_ord, row_no, name, team, pos, age, stats``. Name, team, positions and age are
    each the first that is not blank by source order, then row. A key repeated within a source keeps the
    statistics of its last row. One partial aggregation and one shuffle on the key.
    """
    order = F.struct("source_ord", "row_no")
    per = rows.groupBy("key", "source").agg(
        F.max_by("stats", "row_no").alias("stats"),
        *[_first(c, b, order).alias(c) for c, b in _blanks().items()], *[F.min(F.when(~b, order)).alias(f"_o_{c}") for c, b in _blanks().items()],
    )
    lines = F.map_from_entries(F.collect_list(F.struct("source", "stats")))
    return per.groupBy("key").agg(*[F.min_by(c, f"_o_{c}").alias(c) for c in _blanks()], lines.alias("lines"))


def _blanks() -> dict[str, Column]:
    return {
        "name": F.coalesce(F.trim("name"), F.lit("")) == "", "team": F.coalesce(F.trim("team"), F.lit("")) == "",
        "pos": F.col("pos").isNull() | (F.size("pos") == 0), "age": F.col("age").isNull(),
    }


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched length over the whole length (Ratcliff/Obershelp); 1 for two empty texts, null for a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def suggest(missing: DataFrame, known: DataFrame, least: float = 0.70) -> DataFrame:
    """``key, candidate, ratio``: for each missing key the most similar known one of the same surname.

    Blocked on the surname, so no cross join; of equal ratios the lowest candidate. Keys without a
    candidate of ``least`` are left out.
    """
    a = missing.select("key").distinct().withColumn("_s", surname(F.col("key"))).where("_s != ''")
    b = known.select(F.col("key").alias("candidate")).distinct().withColumn("_s", surname(F.col("candidate")))
    j = a.join(b, "_s").where(F.col("key") != F.col("candidate")).withColumn("ratio", sequence_ratio("key", "candidate")).where(F.col("ratio") >= least)
    best = j.groupBy("key").agg(F.max("ratio").alias("ratio"), F.min_by("candidate", F.struct(-F.col("ratio"), F.col("candidate"))).alias("candidate"))
    return best.select("key", "candidate", "ratio")


def unmatched(secondary: DataFrame, primary: DataFrame) -> DataFrame:
    """``source, key, candidate, ratio``: keys of other sources that the primary one lacks, with a suggestion."""
    missing = secondary.select("source", "key").distinct().join(primary.select("key"), "key", "left_anti")
    return missing.join(suggest(missing, primary), "key", "left").select("source", "key", "candidate", "ratio")


def prefer_aggregate(rows: DataFrame, key: str, team: str, games: str, order: str, pattern: str = r"^\d+TM$") -> DataFrame:
    """One row per key: the first whose team marks a whole-season row, else the one with most games, the first of equals.

    The team is tested as it stands, in capitals, without trimming. A falsy ``pattern`` disables the mark. One aggregation, no window.
    """
    mark = F.coalesce(F.upper(team).rlike(pattern), F.lit(False)) if pattern else F.lit(False)
    rank = F.struct(F.when(mark, 0).otherwise(1), F.when(mark, 0.0).otherwise(-F.coalesce(F.col(games), F.lit(float("-inf")))), F.col(order))
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(whole, rank).alias("_r")).select("_r.*")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key."""
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def first_filled(*cols: str) -> Column:
    """The first of several columns that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in cols])


def ruling_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``key, left, right``: keys of both whose lists differ, order included."""
    j = a.select("key", F.col("positions").alias("left")).join(b.select("key", F.col("positions").alias("right")), "key")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))


def rank_check(ranked: DataFrame, reference: DataFrame) -> DataFrame:
    """``n, missing, mean_apart, max_apart`` of ranks against a reference list by key."""
    j = reference.select("key", F.col("rank").alias("want")).join(ranked.select("key", "rank"), "key", "left")
    apart = F.abs(F.col("rank") - F.col("want"))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("rank").isNull()).alias("missing"), F.avg(apart).alias("mean_apart"), F.max(apart).alias("max_apart"))
