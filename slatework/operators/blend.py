"""Null-aware blending of several sources' statistics.

Lines are long: ``player, source, stat, value``. A source counts for a statistic if its value is present
(not null, not NaN) and its weight is truthy. Blends are plain aggregates: partial sums per task,
one shuffle on the player and statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.scalars import truthy


def _present(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def mean_of(value: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean over present values with truthy weights; null if their weights sum to 0 or less."""
    on = _present(value) & truthy(weight)
    w = F.sum(F.when(on, weight.cast("double")))
    return F.when(w > 0, F.try_divide(F.sum(F.when(on, weight.cast("double") * value.cast("double"))), w))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """One row per key with the null-aware weighted mean ``name``."""
    return df.groupBy(*keys).agg(mean_of(F.col(value), F.col(weight)).alias(name))


def blend_totals(lines: DataFrame, weights: DataFrame) -> DataFrame:
    """``player, stat, value``: every statistic blended as it is. Sources without a weight don't count."""
    live = lines.join(weights.where(truthy(F.col("weight"))).select("source", "weight"), "source")
    out = weighted_mean(live, ["player", "stat"], "value", "weight", "value")
    return lines.select("player", "stat").distinct().join(out, ["player", "stat"], "left")


def blend_rates(lines: DataFrame, weights: DataFrame, counting: list[str], volume: str = "GP", volume_source: str | int | None = None) -> DataFrame:
    """``player, stat, value``: counting statistics blended per unit of volume, times the blended volume.

    Each source's counting values are divided by its own volume (a source without one is skipped) and
    multiplied by the player's volume: the blend over all sources, or that of ``volume_source`` if the
    source has one, whatever its weight. Without a volume the totals are blended. The volume itself and
    statistics that are not counted are never scaled.
    """
    w = weights.select("source", F.col("weight").cast("double").alias("weight"))
    all_lines = lines.join(w, "source", "left")
    vol = all_lines.where(F.col("stat") == volume)
    per = vol.groupBy("player").agg(
        mean_of(F.col("value"), F.col("weight")).alias("blended"),
        (F.max(F.when(F.col("source") == volume_source, F.col("value"))) if volume_source is not None else F.lit(None).cast("double")).alias("chosen"),
    )
    per = per.select("player", F.when(truthy(F.col("chosen")), F.col("chosen")).otherwise(F.col("blended")).alias("games"))
    own = vol.select("player", "source", F.col("value").alias("own"))
    j = all_lines.join(own, ["player", "source"], "left")
    rate = F.when(truthy(F.col("own")), F.try_divide(F.col("value"), F.col("own")))
    both = j.groupBy("player", "stat").agg(mean_of(F.col("value"), F.col("weight")).alias("total"), mean_of(rate, F.col("weight")).alias("rate"))
    both = both.join(per, "player", "left")
    scaled = F.col("stat").isin(*counting) & truthy(F.col("games"))
    games = F.when((F.col("stat") == volume) & truthy(F.col("games")), F.col("games"))
    return both.select("player", "stat", F.when(scaled, F.col("rate") * F.col("games")).otherwise(F.coalesce(games, F.col("total"))).alias("value"))


def mean_of_parts(picks: DataFrame, parts: list[str]) -> DataFrame:
    """``key, value``: the mean over whichever of the named providers have the key."""
    return picks.where(F.col("provider").isin(*parts)).groupBy("key").agg(F.avg("value").alias("value"))


def coverage(lines: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """``source, players, stats``: players and statistics with any value, per source; with ``positions(player, pos)`` also ``has_goalies``."""
    live = lines.where(_present(F.col("value")))
    counts = [F.countDistinct("player").alias("players"), F.countDistinct("stat").alias("stats")]
    if positions is None:
        return live.groupBy("source").agg(*counts)
    goalies = positions.groupBy("player").agg(F.max(F.array_contains("pos", "G")).alias("_g"))
    return live.join(goalies, "player", "left").groupBy("source").agg(*counts, F.max(F.coalesce("_g", F.lit(False))).alias("has_goalies"))


def shown_stats(lines: DataFrame, scored: list[str], volume: str = "GP") -> DataFrame:
    """``stat``: the statistics a detail view has columns for: scored ones and the volume, if any source has a value."""
    return lines.where(F.col("stat").isin(volume, *scored) & _present(F.col("value"))).select("stat").distinct()
