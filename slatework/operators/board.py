"""Joins of a board with state and schedules, its interchange form, and order-dependent fills of small groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.operators.identity import merge_sources
from slatework.operators.metrics import percentile_bands


def by_name(board: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``state`` with ``player``, names of the state that the board lacks), whatever the case of names.

    Of board players of one name the last by ``player`` counts. Null names match nothing and are missing.
    """
    ids = board.where("name is not null").groupBy(F.lower("name").alias("_n")).agg(F.max("player").alias("player"))
    keyed = state.withColumn("_n", F.lower("name"))
    return keyed.join(ids, "_n").drop("_n"), keyed.join(ids, "_n", "left_anti").select("name").distinct()


def in_state(board: DataFrame, state: DataFrame, flag: Column, keep: bool = True) -> DataFrame:
    """Players whose state has the flag (or, ``keep`` false, hasn't)."""
    return board.join(state.where(flag).select("player"), "player", "left_semi" if keep else "left_anti")


def attach_schedule(board: DataFrame, schedule: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """``board`` with a band of 1, 0 or -1 for each of the schedule's numbers by ``team``; null for teams without one."""
    bands = schedule
    for m in marks:
        bands = percentile_bands(bands, m, f"{m}_band")
    return board.join(bands.select("team", *[f"{m}_band" for m in marks]), "team", "left")


def attach_window(schedule: DataFrame, window: DataFrame) -> DataFrame:
    """Numbers of a window of weeks, only for teams that the schedule has."""
    return window.join(schedule.select("team"), "team", "left_semi")


def merge_import(board_rows: DataFrame, imported: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """``merge_sources`` of the board's rows and an imported source behind them.

    ``accepted(key, candidate)``: near misses that were taken for the board's own key.
    """
    if accepted is not None:
        rest = [c for c in imported.columns if c != "key"]
        imported = imported.join(accepted.select("key", "candidate"), "key", "left").select(F.coalesce("candidate", "key").alias("key"), *rest)
    return merge_sources(board_rows.unionByName(imported))


def interchange(lines: DataFrame, stats: list[str], digits: int = 6) -> DataFrame:
    """``player, lines``: per source an array parallel to ``stats``, null where a source has no value."""
    at = [F.max(F.when(F.col("stat") == s, F.bround("value", digits))).alias(f"v{i}") for i, s in enumerate(stats)]
    per = lines.where(F.col("stat").isin(*stats)).groupBy("player", "source").agg(*at)
    row = F.struct(F.col("source").cast("string").alias("source"), F.array(*[F.col(f"v{i}") for i in range(len(stats))]).alias("values"))
    return per.groupBy("player").agg(F.map_from_entries(F.array_sort(F.collect_list(row))).alias("lines"))


def fill_slots(picks: DataFrame, slots: dict[str, int], accepts: dict[str, list[str]], overflow: str = "XTRA") -> DataFrame:
    """``owner, player, slot``: each owner's picks by ``vorp`` descending into the first open slot that accepts them.

    Order-dependent, hence one small group per owner: a roster holds as many players as its owner picked.
    Equal values go by player; who finds no slot is ``overflow``.
    """
    order = list(slots)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = dict(slots), []
        for r in pdf.sort_values(["vorp", "player"], ascending=[False, True]).itertuples():
            s = next((s for s in order if left[s] > 0 and set(r.pos) & set(accepts.get(s, [s]))), None)
            if s:
                left[s] -= 1
            out.append((r.owner, r.player, s or overflow))
        return pd.DataFrame(out, columns=["owner", "player", "slot"])

    return picks.select("owner", "player", "vorp", "pos").groupBy("owner").applyInPandas(fill, "owner string, player long, slot string")


def saved_state(board: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``player`` and the state's other columns, names that the board lacks) of saved rows ``version, ref, ...``.

    From version 2 on ``ref`` is a name, whatever its case; in version 1 it is the player's number, taken as it is.
    Rows of an unreadable number or of no version fall out.
    """
    rest = [c for c in state.columns if c not in ("version", "ref")]
    named, missing = by_name(board, state.where("version >= 2").withColumnRenamed("ref", "name"))
    old = state.where("version < 2").withColumn("player", F.expr("try_cast(ref as bigint)")).join(board.select("player"), "player", "left_semi")
    return named.select("player", *rest).unionByName(old.select("player", *rest)), missing


def save_state(board: DataFrame, state: DataFrame) -> DataFrame:
    """``version, ref, ...``: the state of players by name, as version 2 keeps it."""
    rest = [c for c in state.columns if c != "player"]
    return state.join(board.select("player", F.col("name").alias("ref")), "player").select(F.lit(2).alias("version"), "ref", *rest)
