"""The whole valuation as one plan: blend, filter, adjust, score, replace, rank, drop-off and tiers.

The scored players are stored once; everything after them reads that small table, not the statistics
they were made of.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.functions.scalars import finite_or
from slatework.operators import blend, metrics, score, value
from slatework.session import discard, store


#: Added before rounding, so that exact ties fall one way in whatever order values were summed.
NUDGE = 1e-7


@dataclass(frozen=True)
class Settings:
    """What a valuation depends on beside the tables. Numbers that are not finite fall back to the defaults."""

    scoring: dict[str, float]
    slots: dict[str, float]
    teams: int = 12
    rates: bool = False
    counting: tuple[str, ...] = ()
    volume_source: str | int | None = None
    minimum_games: float = 0.0
    provider: str | None = None
    tiers: tuple[float, ...] = (0.05, 0.10, 0.20)
    skater_stats: tuple[str, ...] = ()
    goalie_stats: tuple[str, ...] = ()
    defence_points: float = 0.0
    goalie_games: float = 0.0
    by_draft: bool = True
    count_bench: bool = True
    dynamic: bool = False
    tier_k: float = 1.0
    digits: int = 4
    used: dict[str, int] = field(default_factory=dict)

    def checked(self) -> Settings:
        """These settings with unusable numbers replaced."""
        clean = {k: finite_or(getattr(self, k), d) for k, d in (("minimum_games", 0.0), ("defence_points", 0.0), ("goalie_games", 0.0), ("tier_k", 1.0))}
        weigh = lambda m: {k: finite_or(v, 0.0) for k, v in m.items()}
        return replace(self, **clean, teams=int(finite_or(self.teams, 12)), scoring=weigh(self.scoring), slots=weigh(self.slots))


@dataclass(frozen=True)
class Valuation:
    """``board`` has one row per player; the rest are a league's few numbers."""

    board: DataFrame
    levels: dict[str, float]
    depth: dict[str, int]
    consumed: dict[str, int]
    spots: int


def scored_players(players: DataFrame, lines: DataFrame, weights: DataFrame, s: Settings, rulings: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """``players`` (by the ruled positions) with ``gp, points, per_game, adjustment, delta``, without those below the minimum of games.

    ``delta`` is what the adjustment is worth in points. Players without any line have 0 points, no games.
    """
    blended = blend.blend_rates(lines, weights, list(s.counting), volume_source=s.volume_source) if s.rates else blend.blend_totals(lines, weights)
    who = metrics.effective_positions(players.withColumn("key", F.col("player")), rulings, s.provider).drop("key") if rulings is not None and s.provider else players
    level = levels.groupBy("player").agg(F.max("level").alias("adjustment")) if levels is not None else None
    who = who.join(level, "player", "left") if level is not None else who.withColumn("adjustment", F.lit(None).cast("int"))
    who = who.withColumn("adjustment", F.coalesce("adjustment", F.lit(0)))
    games = blended.where("stat = 'GP'").groupBy("player").agg(F.max("value").alias("gp"))
    plain = score.score(blended, s.scoring, who, s.defence_points, s.goalie_games)
    out = who.join(games, "player", "left")
    if levels is None:
        out = out.join(plain, "player", "left").withColumn("_before", F.col("points"))
    else:
        goalies = F.array_contains("pos", "G")
        kinds = who.select("player", "pos", F.col("adjustment").alias("level"))
        joined = blended.join(kinds, "player", "left")
        parts = [score.adjust(joined.where(keep).select("player", "stat", "value"), kinds, list(s.tiers), list(stats), s.scoring) for keep, stats in ((F.coalesce(goalies, F.lit(False)), s.goalie_stats), (~F.coalesce(goalies, F.lit(False)), s.skater_stats))]
        moved = score.score(parts[0].unionByName(parts[1]), s.scoring, who, s.defence_points, s.goalie_games)
        out = out.join(moved, "player", "left").join(plain.withColumnRenamed("points", "_before"), "player", "left")
    out = metrics.minimum_games(out, "gp", s.minimum_games)
    before, after = F.coalesce("_before", F.lit(0.0)), F.coalesce("points", F.lit(0.0))
    out = out.withColumn("delta", F.round(F.when(F.col("adjustment") != 0, after - before).otherwise(0.0) + NUDGE, s.digits)).withColumn("points", F.round(after + NUDGE, s.digits)).drop("_before")
    return out.withColumn("per_game", score.per_game(F.col("points"), F.col("gp")))


def valuation(players: DataFrame, lines: DataFrame, weights: DataFrame, settings: Settings, rulings: DataFrame | None = None, levels: DataFrame | None = None, taken: DataFrame | None = None) -> Valuation:
    """Values every player of ``players`` (``player, name, pos`` and what else it has).

    ``lines``: ``player, source, stat, value``; ``weights``: ``source, weight``; ``rulings``: ``key, provider, positions`` with the player
    as key; ``levels``: ``player, level``; ``taken``: ``player``. With ``dynamic`` the pool is who is still free and the demand what is still
    open. Adds ``rank, vorp, best_pos, label, drop_off, next_up, gap, tier``.
    """
    s = settings.checked()
    rows = store(scored_players(players, lines, weights, s, rulings, levels))
    gone = rows.limit(0).select("player") if taken is None else taken
    used = value.consumed_counts(rows, gone) if taken is not None else {"F": 0, "D": 0, "G": 0}
    pool = value.live_pool(rows, gone) if s.dynamic and taken is not None else rows
    slots = value.positional_slots(s.slots, s.teams, s.count_bench)
    chosen = value.draft_replacement(pool, slots, used if s.dynamic else None) if s.by_draft else value.position_replacement(pool, slots)
    found = chosen.collect()
    levels_, depth = {r["position"]: float(r["level"]) for r in found}, {r["position"]: int(r["depth"]) for r in found}
    valued = value.best_value(rows, levels_).withColumn("vorp", F.round("vorp", s.digits))
    ranked = store(value.overall_rank(valued))
    labels = value.position_labels(value.position_ranks(ranked))
    steps = value.drop_off(ranked, taken)
    tiers = value.gap_tiers(ranked.select("player", "best_pos", "vorp"), s.tier_k, depth).select("player", "gap", "tier")
    out = ranked.join(labels, "player", "left").join(steps, "player", "left").join(tiers, "player", "left")
    board = store(out.withColumn("drop_off", F.round("drop_off", s.digits)).withColumn("gap", F.round("gap", s.digits)))
    discard(rows, ranked)
    return Valuation(board, levels_, depth, used, value.remaining_spots(s.slots, s.teams, sum(used.values())))


def history(players: DataFrame, lines: DataFrame, settings: Settings, source: str | int) -> Valuation:
    """Last season under the same scoring and roster: the one source ``source`` as it was, no rates, minimum, adjustment, rulings or draft."""
    weights = lines.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(1.0).alias("weight"))
    own = lines.where(F.col("source") == F.lit(source))
    plain = replace(settings, rates=False, minimum_games=0.0, provider=None, dynamic=False)
    return valuation(players.join(own.select("player").distinct(), "player", "left_semi"), own, weights, plain)


def with_last_season(board: DataFrame, last: DataFrame, key: str = "player") -> DataFrame:
    """``board`` with ``last_rank, last_points, last_gp`` of the history's board; of repeated keys the best ranked."""
    one = last.groupBy(key).agg(F.min_by(F.struct("rank", "points", "gp"), "rank").alias("_h"))
    return board.join(one, key, "left").select(*board.columns, F.col("_h.rank").alias("last_rank"), F.col("_h.points").alias("last_points"), F.col("_h.gp").alias("last_gp"))
