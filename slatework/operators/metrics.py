"""Overlays, bands, metric ranks, filters and sorts of a ranked list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.scalars import js_round, truthy
from slatework.operators.ordering import global_row_number, linear_percentiles
from slatework.operators.value import FORWARDS

# Sort keys that go up by default; all others go down.
ASCENDING = ("rank", "metric_rank", "pick", "position_rank", "last_rank", "name", "team", "label")


def first_pick(picks: DataFrame) -> DataFrame:
    """``key, provider, value``: the first value by ``ord``, then ``row_no``, per key and provider; nulls count for nothing."""
    return picks.where("value is not null").groupBy("key", "provider").agg(F.min_by("value", F.struct("ord", "row_no")).alias("value"))


def last_pick(picks: DataFrame) -> DataFrame:
    """``key, provider, value``: later sheets overwrite earlier ones."""
    return picks.where("value is not null").groupBy("key", "provider").agg(F.max_by("value", F.struct("ord", "row_no")).alias("value"))


def attach_picks(players: DataFrame, picks: DataFrame) -> DataFrame:
    """``players`` with ``picks``, a map of provider to value; picks of unknown players are dropped."""
    maps = picks.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "value")))).alias("picks"))
    return players.join(maps, "key", "left")


def overlay_ages(players: DataFrame, ages: DataFrame, within: float = 1.0) -> DataFrame:
    """``players`` with ``age`` from the list where it is missing or at most ``within`` away, and ``rejected`` for the listed age otherwise."""
    j = players.join(ages.select("key", F.col("age").alias("_listed")), "key", "left")
    use = F.col("_listed").isNotNull() & (F.col("age").isNull() | (F.abs(F.col("age") - F.col("_listed")) <= within))
    rest = [c for c in players.columns if c != "age"]
    return j.select(*rest, F.when(use, F.col("_listed")).otherwise(F.col("age")).alias("age"), F.when(F.col("_listed").isNotNull() & ~use, F.col("_listed")).alias("rejected"))


def overrides(players: DataFrame, rulings: DataFrame) -> DataFrame:
    """``key, provider, positions`` of the rulings that differ from the player's own positions, order included."""
    j = players.select("key", "pos").join(rulings, "key")
    return j.where(~F.col("positions").eqNullSafe(F.col("pos"))).select("key", "provider", "positions")


def effective_positions(players: DataFrame, rulings: DataFrame, provider: str) -> DataFrame:
    """``players`` with ``pos`` as the provider rules it, the own one where it doesn't."""
    rest = [c for c in players.columns if c != "pos"]
    j = players.join(rulings.where(F.col("provider") == provider).select("key", F.col("positions").alias("_ruled")), "key", "left")
    return j.select(*rest, F.coalesce("_ruled", "pos").alias("pos"))


def percentile_bands(df: DataFrame, value: str, name: str, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """``df`` with ``name``: 1 at or above the high percentile, -1 at or below the low one, else 0; null is 0.

    Percentiles interpolate linearly over all present values. The two cuts are literals, no join.
    """
    cuts = linear_percentiles(df, value, [low, high])
    if cuts is None:
        return df.withColumn(name, F.lit(0))
    v = F.col(value)
    return df.withColumn(name, F.when(v >= F.lit(cuts[1]), 1).when(v <= F.lit(cuts[0]), -1).otherwise(0))


def age_band(age: Column) -> Column:
    """``pre`` up to 24, ``post`` from 31, else ``prime``; null without an age."""
    return F.when(age <= 24, "pre").when(age >= 31, "post").when(age.isNotNull(), "prime")


def shift_mark(a: Column, b: Column, least: int = 2) -> Column:
    """1 if ``a`` lies ``least`` or more places after ``b``, both rounded half up, -1 if before, else 0."""
    d = js_round(a) - js_round(b)
    return F.when(d >= least, 1).when(d <= -least, -1).otherwise(0)


def round_pick(rank: Column, teams: int) -> Column:
    """A rank as round and pick, like ``3-07``."""
    rnd = F.ceil(rank / F.lit(float(teams)))
    return F.format_string("%d-%02d", rnd.cast("long"), (rank - (rnd - 1) * teams).cast("long"))


def metric_rank(ranked: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """``metric_rank`` by any column; nulls come last, in order of ``rank``."""
    by = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return global_row_number(ranked, [by, F.col("rank").asc()], "metric_rank")


def minimum_games(df: DataFrame, games: str, least: float) -> DataFrame:
    """Drops players below ``least`` games; ``least`` of 0 keeps all, also those without games."""
    return df.where(truthy(F.col(games)) & (F.col(games) >= least)) if least else df


def with_position(df: DataFrame, codes: list[str]) -> DataFrame:
    """Players of any of the positions; ``F`` stands for the forwards."""
    wide = sorted({p for c in codes for p in (FORWARDS if c == "F" else (c,))})
    return df.where(F.arrays_overlap("pos", F.array(*[F.lit(p) for p in wide])))


def text_search(df: DataFrame, query: str, cols: tuple[str, ...] = ("name", "team")) -> DataFrame:
    """Rows with the trimmed query in any of the columns, whatever the case; an empty query keeps all."""
    q = query.strip().lower()
    return df.where(reduce(Column.__or__, [F.coalesce(F.lower(c).contains(q), F.lit(False)) for c in cols])) if q else df


def sort_by(df: DataFrame, key: str, descending: bool | None = None, tie: str = "rank") -> DataFrame:
    """Sorted by one column, nulls last in both directions."""
    down = key not in ASCENDING if descending is None else descending
    return df.orderBy(F.col(key).desc_nulls_last() if down else F.col(key).asc_nulls_last(), F.col(tie))


def drop_sources(lines: DataFrame, removed: list[str]) -> DataFrame:
    """Lines without the removed sources; players left without lines are gone with them."""
    return lines.where(~F.col("source").isin(*removed)) if removed else lines


def best_per_group(ranked: DataFrame, groups: dict[str, list[str]], n: int = 3) -> DataFrame:
    """``slot, rank, player``: the first ``n`` players by rank of every slot, each a bounded top-n selection."""
    parts = [with_position(ranked, codes).orderBy("rank").limit(n).select(F.lit(slot).alias("slot"), "rank", "player") for slot, codes in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def history_join(ranked: DataFrame, last: DataFrame, order: str = "rank") -> DataFrame:
    """``ranked`` with ``last_rank`` and ``last_points``; of repeated keys the first counts."""
    one = last.groupBy("key").agg(F.min_by(F.struct("rank", "points"), order).alias("_h"))
    return ranked.join(one, "key", "left").select(*ranked.columns, F.col("_h.rank").alias("last_rank"), F.col("_h.points").alias("last_points"))


def pick_of(players: DataFrame, provider: str | None, name: str = "pick") -> DataFrame:
    """``players`` (with the map ``picks``) with one provider's pick; null without a provider or a pick of its own."""
    return players.withColumn(name, F.try_element_at("picks", F.lit(provider)) if provider else F.lit(None).cast("double"))


def provider_counts(players: DataFrame, rulings: DataFrame) -> DataFrame:
    """``provider, players, differs``: the keys each provider rules on, and the players it sees otherwise, order included."""
    own = players.select("key", "pos")
    j = rulings.join(own, "key", "left")
    return j.groupBy("provider").agg(F.countDistinct("key").alias("players"), F.count_if(F.col("pos").isNotNull() & ~F.col("positions").eqNullSafe(F.col("pos"))).alias("differs"))


def hide_taken(ranked: DataFrame, taken: DataFrame, view: str = "") -> DataFrame:
    """``ranked`` without the taken players, but for the views ``taken`` and ``mine``, which are about them."""
    return ranked if view in ("taken", "mine") else ranked.join(taken.select("player"), "player", "left_anti")


def first_free_match(ranked: DataFrame, taken: DataFrame, query: str) -> DataFrame:
    """The best ranked free player that a search finds: one row, or none, also for an empty query."""
    hits = text_search(ranked, query) if query.strip() else ranked.limit(0)
    return hide_taken(hits, taken).orderBy("rank").limit(1)
