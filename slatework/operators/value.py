"""Replacement levels, value over replacement, ranks, tiers and drop-off.

Players: ``player, points, pos array``. Positions are few, so a window per position would put a large
part of all rows into one task; everything ordered runs over range partitions instead
(``slatework.operators.ordering``), and thresholds are bounded top-k selections.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.operators.ordering import global_row_number, nth_smallest, previous_row, rank_within, running
from slatework.session import store

# Position order and the tie order of choices among them.
POSITIONS = ("C", "LW", "RW", "D", "G")
FORWARDS = ("C", "LW", "RW")


def roster_spots(slots: dict[str, float]) -> float:
    """All spots of one roster."""
    return sum(slots.values())


def positional_slots(slots: dict[str, float], teams: int, count_bench: bool = True) -> dict[str, float]:
    """League-wide demand per position: own slots plus shares of the flexible and bench ones."""
    s = {k: float(slots.get(k, 0)) for k in ("C", "LW", "RW", "W", "F", "D", "G", "UTIL", "BN")}
    bench = s["BN"] if count_bench else 0.0
    flex = s["F"] / 3 + s["UTIL"] * 2 / 3 / 3 + bench * 2 / 3 / 3
    each = {"C": s["C"] + flex, "LW": s["LW"] + s["W"] / 2 + flex, "RW": s["RW"] + s["W"] / 2 + flex, "D": s["D"] + s["UTIL"] / 3 + bench / 6, "G": s["G"] + bench / 6}
    return {p: n * teams for p, n in each.items()}


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def eligible(players: DataFrame) -> DataFrame:
    """One row per player and position; a player without any position has none."""
    return players.withColumn("position", F.explode("pos"))


def nth_best(pool: DataFrame, depth: dict[str, float]) -> DataFrame:
    """``position, level, depth``: the points of the n-th best per position, n rounded half up, 0-based, within the pool.

    One scan: every task keeps the best n of each position ahead of the shuffle (a group limit, which Spark plans for
    limits up to ``spark.sql.optimizer.windowGroupLimitThreshold``). A position nobody plays has level 0 at depth 0.
    """
    size = {p: max(half_up(depth.get(p, 0.0)), 0) + 1 for p in POSITIONS}
    by = Window.partitionBy("position").orderBy(F.desc("points"))
    ranked = pool.select("points", F.explode(F.array_distinct("pos")).alias("position")).where(F.col("position").isin(*POSITIONS))
    ranked = ranked.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= max(size.values()))
    top = ranked.where(F.col("_n") <= F.create_map(*[F.lit(x) for kv in size.items() for x in kv])[F.col("position")])
    got = top.groupBy("position").agg(F.min("points").alias("level"), F.count("points").alias("depth"))
    every = pool.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in POSITIONS])).alias("position"))
    return every.join(got, "position", "left").select("position", F.coalesce("level", F.lit(0.0)).alias("level"), F.coalesce("depth", F.lit(0)).alias("depth"))


def position_replacement(pool: DataFrame, slots: dict[str, float]) -> DataFrame:
    """Replacement levels straight from the positional demand."""
    return nth_best(pool, slots)


def draft_replacement(pool: DataFrame, slots: dict[str, float], consumed: dict[str, int] | None = None) -> DataFrame:
    """Replacement levels from who would be picked: the best forwards by points share out the forwards' demand.

    ``consumed``: picks already made by group ``F``, ``D`` and ``G``.
    """
    used = consumed or {}
    n = max(half_up(sum(slots[p] for p in FORWARDS)) - used.get("F", 0), 0)
    front = pool.where(F.arrays_overlap("pos", F.array(*[F.lit(p) for p in FORWARDS])))
    top = front.orderBy(F.desc("points"), F.asc("player")).limit(n)
    got = top.agg(*[F.count_if(F.array_contains("pos", p)).alias(p) for p in FORWARDS]).first()
    depth = {p: float(got[p]) for p in FORWARDS} | {p: float(max(half_up(slots[p]) - used.get(p, 0), 0)) for p in ("D", "G")}
    return nth_best(pool, depth)


def live_pool(players: DataFrame, taken: DataFrame) -> DataFrame:
    """Players that nobody has taken."""
    return players.join(taken.select("player"), "player", "left_anti")


def best_value(players: DataFrame, replacement: DataFrame | dict[str, float]) -> DataFrame:
    """``players`` with ``vorp`` and ``best_pos``: the most points over a level of an eligible position.

    Ties go to the earlier of C, LW, RW, D, G. Without an eligible position ``vorp`` is the points
    and ``best_pos`` null. Levels are five rows, read as literals, or given by position.
    """
    level = replacement if isinstance(replacement, dict) else {r["position"]: float(r["level"]) for r in replacement.collect()}
    each = [F.when(F.array_contains("pos", p), F.struct((F.col("points") - F.lit(level.get(p, 0.0))).alias("v"), F.lit(-i).alias("o"), F.lit(p).alias("p"))) for i, p in enumerate(POSITIONS)]
    best = F.array_max(F.array_compact(F.array(*each)))
    return players.select("*", F.coalesce(best["v"], F.col("points")).alias("vorp"), best["p"].alias("best_pos"))


def overall_rank(valued: DataFrame) -> DataFrame:
    """``rank`` by ``vorp`` descending, equal ones by player."""
    return global_row_number(valued, [F.desc_nulls_last("vorp"), F.asc("player")], "rank")


def position_ranks(players: DataFrame) -> DataFrame:
    """``player, position, position_rank`` by points descending, equal ones by player."""
    return rank_within(eligible(players).select("player", "position", "points"), ["position"], [F.desc("points"), F.asc("player")], "position_rank").select("player", "position", "position_rank")


def position_labels(ranks: DataFrame) -> DataFrame:
    """``player, label``: like ``C1 L3 D7``, in position order."""
    order = F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), F.col("position"))
    short = F.when(F.col("position") == "LW", "L").when(F.col("position") == "RW", "R").otherwise(F.col("position"))
    made = ranks.select("player", F.struct(order.alias("o"), F.concat(short, F.col("position_rank").cast("string")).alias("t")).alias("x"))
    return made.groupBy("player").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("label"))


def gaps(valued: DataFrame, group: str = "best_pos") -> DataFrame:
    """``valued`` with ``gap``, how much less than the player before it in its group."""
    before = previous_row(valued, [group], [F.desc("vorp"), F.asc("player")])
    return before.withColumn("gap", F.col("prev.vorp") - F.col("vorp")).drop("prev")


def gap_tiers(valued: DataFrame, k: float = 1.0, depth: dict[str, int] | None = None, group: str = "best_pos") -> DataFrame:
    """``valued`` with ``gap`` and ``tier``: a tier ends where a gap exceeds the upper median plus ``k`` scaled deviations.

    Median and scaled median absolute deviation (1.4826 times) are taken over the first
    ``max(2, min(depth or all, all))`` gaps of each group; a scale of 0 becomes the median, or 1. A group
    with fewer than two rows is tier 1. ``depth`` maps a group to its window; none means all.
    """
    order = [F.desc("vorp"), F.asc("player")]
    # One pass gives both the place in the group and the value before it.
    g = running(valued, [group], order, sums={"_n": F.lit(1).cast("long")}, last_before={"_prev": F.col("vorp")})
    g = store(g.withColumn("gap", F.col("_prev") - F.col("vorp")).drop("_prev"))
    size = F.create_map(*[F.lit(x) for kv in (depth or {}).items() for x in kv])[F.col(group)] if depth else F.lit(None)
    limit = F.when(F.coalesce(size, F.lit(0)) <= 0, F.lit(2**62)).otherwise(F.greatest(size, F.lit(2)))
    sample = g.where(F.col("gap").isNotNull() & (F.col("_n") - 1 <= limit)).select(group, "gap")
    half = F.floor(F.col("n") / 2)
    median = nth_smallest(sample, [group], "gap", half, "median")
    apart = sample.join(median, sample[group].eqNullSafe(median[group])).select(sample[group], F.abs(F.col("gap") - F.col("median")).alias("apart"))
    spread = nth_smallest(apart, [group], "apart", half, "spread")
    cut_at = median.join(spread.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    scale = 1.4826 * F.col("spread")
    scale = F.when(scale != 0, scale).when(F.col("median") != 0, F.col("median")).otherwise(1.0)
    cut_at = cut_at.select(F.col(group).alias("_g"), (F.col("median") + k * scale).alias("_threshold"))
    j = g.join(cut_at, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g", "_n")
    out = running(j, [group], order, sums={"_breaks": F.when(F.col("gap") > F.col("_threshold"), 1).otherwise(0).cast("long")})
    return out.withColumn("tier", F.col("_breaks") + 1).drop("_breaks", "_threshold")


def drop_off(ranked: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``player, drop_off, next_up``: the step down to the best player still free with strictly fewer points.

    Among all who may play the player's best position; 0 and '' if there is none; of equal next players the best ranked.
    Input: ``player, name, points, pos, best_pos, rank``. An as-of lookup over distinct points, spread over tasks.
    """
    free = ranked.withColumn("_free", F.lit(True)) if taken is None else ranked.join(taken.select("player", F.lit(True).alias("_t")).distinct(), "player", "left").withColumn("_free", F.col("_t").isNull()).drop("_t")
    asks = free.where(F.col("best_pos").isNotNull()).select("best_pos", "points", F.lit(None).cast("struct<rank:bigint,name:string>").alias("_w"))
    offers = free.where("_free").select(F.explode("pos").alias("best_pos"), "points", F.struct(F.col("rank").cast("long").alias("rank"), "name").alias("_w"))
    steps = asks.unionByName(offers).groupBy("best_pos", "points").agg(F.min("_w").alias("_who"))
    mark = F.when(F.col("_who").isNotNull(), F.struct("points", F.col("_who.name").alias("name")))
    seen = running(steps, ["best_pos"], [F.asc("points")], last_before={"_next": mark}).select("best_pos", "points", "_next")
    j = free.join(seen, ["best_pos", "points"], "left")
    return j.select("player", F.coalesce(F.col("points") - F.col("_next.points"), F.lit(0.0)).alias("drop_off"), F.coalesce("_next.name", F.lit("")).alias("next_up"))


def consumed_counts(players: DataFrame, taken: DataFrame) -> dict[str, int]:
    """How many taken players fall to each of the groups F, D and G; their sum is the number drafted."""
    hit = players.join(taken.select("player").distinct(), "player", "left_semi")
    got = hit.agg(*[F.count_if(group_of(F.col("pos")) == g).alias(g) for g in ("F", "D", "G")]).first()
    return {g: int(got[g]) for g in ("F", "D", "G")}


def remaining_spots(slots: dict[str, float], teams: int, drafted: int) -> int:
    """Roster spots of the league that nobody fills yet; at least one."""
    return int(max(teams * roster_spots(slots) - drafted, 1))


def group_of(pos: Column) -> Column:
    """G before D before F."""
    return F.when(F.array_contains(pos, "G"), "G").when(F.array_contains(pos, "D"), "D").otherwise("F")
