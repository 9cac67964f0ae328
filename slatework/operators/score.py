"""Scoring of blended lines and manual adjustment, on long lines ``player, stat, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.scalars import truthy


def _points(scoring: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k, v in scoring.items() for x in (k, float(v))]
    return F.create_map(*pairs)[F.col("stat")] if pairs else F.lit(None).cast("double")


def score(lines: DataFrame, scoring: dict[str, float], positions: DataFrame | None = None, defence_points: float = 0.0, goalie_games: float = 0.0) -> DataFrame:
    """``player, points``: the sum of value times points over scored statistics; 0 for nothing.

    With ``positions(player, pos)``, defenders get ``defence_points`` per point (PTS, else goals plus
    assists) and goalies ``goalie_games`` per game. The scoring is a literal map: no join.
    """
    p = _points({k: v for k, v in scoring.items() if v})
    is_ = lambda s: F.max(F.when(F.col("stat") == s, F.col("value")))
    agg = lines.groupBy("player").agg(F.coalesce(F.sum(F.col("value") * p), F.lit(0.0)).alias("base"), is_("PTS").alias("pts"), is_("G").alias("g"), is_("A").alias("a"), is_("GP").alias("gp"))
    if positions is None:
        return agg.select("player", F.col("base").alias("points"))
    j = agg.join(positions.select("player", "pos"), "player", "left")
    pts = F.coalesce("pts", F.when(F.col("g").isNotNull(), F.col("g") + F.coalesce("a", F.lit(0.0))), F.lit(0.0))
    d = F.when(F.coalesce(F.array_contains("pos", "D"), F.lit(False)), pts * float(defence_points)).otherwise(0.0)
    g = F.when(F.coalesce(F.array_contains("pos", "G"), F.lit(False)), F.coalesce("gp", F.lit(0.0)) * float(goalie_games)).otherwise(0.0)
    return j.select("player", (F.col("base") + d + g).alias("points"))


def level_share(level: Column, tiers: list[float]) -> Column:
    """The signed share of an adjustment level: its tier, clamped to the last one; 0 for level 0 or null."""
    t = F.array(*[F.lit(float(x)) for x in tiers])
    at = F.least(F.abs(level), F.lit(len(tiers))).cast("int")
    return F.when(level.isNull() | (level == 0), 0.0).otherwise(F.signum(level) * F.try_element_at(t, at))


def adjust(lines: DataFrame, levels: DataFrame, tiers: list[float], stats: list[str], scoring: dict[str, float]) -> DataFrame:
    """``player, stat, value`` with the named statistics moved by the player's level, in the direction that scores more."""
    share = level_share(F.col("level"), tiers)
    towards = F.when(_points(scoring) < 0, -1.0).otherwise(1.0)
    value = F.when(F.col("stat").isin(*stats), F.col("value") * (1 + share * towards)).otherwise(F.col("value"))
    return lines.join(levels.select("player", "level"), "player", "left").select("player", "stat", value.alias("value"))


def per_game(points: Column, games: Column) -> Column:
    """Points per game, 0 without games."""
    return F.when(truthy(games), F.try_divide(points, games)).otherwise(F.lit(0.0))
