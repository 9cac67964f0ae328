"""Order-dependent operators that stay distributed when one key, or no key at all, holds most rows.

``Window.partitionBy(key)`` puts a whole key into one task and ``Window.orderBy`` without a key puts
everything there. These operators range-partition on the full ordering instead, so a hot key is
spread over many tasks, and mend the seams with one small row per partition.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.session import cut


def range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted over range partitions and checkpointed, with ``_pid`` and ``_seq`` (row in partition)."""
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    mid = F.monotonically_increasing_id()
    return kept.withColumn("_pid", F.shiftright(mid, 33).cast("int")).withColumn("_seq", mid.bitwiseAND(F.lit((1 << 33) - 1)))


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """A 1-based row number over a total order without a single-task window.

    ``order`` must break all ties for a reproducible result. Only one count per partition reaches
    the driver. An empty input gives an empty output.
    """
    parts = range_sorted(df, order)
    counts = sorted((r["_pid"], r["n"]) for r in parts.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    ends = accumulate((n for _, n in counts), initial=0)
    starts = _per_partition(df, [(pid, at) for (pid, _), at in zip(counts, ends, strict=False)], "_start")
    return parts.join(starts, "_pid").withColumn(name, (F.col("_start") + F.col("_seq") + 1).cast("long")).drop("_pid", "_seq", "_start")


def _per_partition(df: DataFrame, pairs: list[tuple[int, int]], name: str) -> DataFrame:
    """``_pid`` and one number per partition, to be joined: as many rows as there are partitions."""
    return F.broadcast(df.sparkSession.createDataFrame(pairs, f"_pid int, {name} long"))


def previous_row(df: DataFrame, group: list[str], order: list[Column], prev: str = "prev") -> DataFrame:
    """``lag(struct(*), 1)`` within ``group``, spread over tasks by the full ordering.

    Adds ``prev``, a struct of all input columns of the row before it in the same group, null for the
    group's first row. Null group values count as one group. A hot group does not end in one task.
    """
    cols = df.columns
    parts = range_sorted(df, [F.col(g).asc_nulls_first() for g in group] + order)
    inner = Window.partitionBy("_pid").orderBy("_seq")
    lagged = parts.withColumn("_me", F.struct(*cols)).withColumn("_before", F.lag("_me").over(inner))
    pids = sorted(r["_pid"] for r in parts.select("_pid").distinct().collect())
    if len(pids) > 1:
        last = parts.groupBy(F.col("_pid").cast("long").alias("_from")).agg(F.max_by(F.struct(*cols), "_seq").alias("_edge"))
        edge = _per_partition(df, list(zip(pids[1:], pids, strict=False)), "_from").join(last, "_from").select("_pid", F.lit(0).cast("long").alias("_seq"), "_edge")
        lagged = lagged.join(edge, ["_pid", "_seq"], "left").withColumn("_before", F.coalesce("_before", "_edge"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_before.{g}"))
    return lagged.withColumn(prev, F.when(F.col("_before").isNotNull() & same, F.col("_before"))).select(*cols, prev)


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None, last_before: dict[str, Column] | None = None) -> DataFrame:
    """Running aggregates per group in order, without putting a group into one task.

    ``sums``: name -> column, its sum over the group's rows up to and including this one (nulls count
    as 0). ``last_before``: name -> column, its last value that is not null among the rows before
    this one. ``order`` must break all ties for a reproducible result.
    """
    sums, last_before = sums or {}, last_before or {}
    cols = df.columns
    src = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_s_{k}") for k, c in sums.items()], *[c.alias(f"_l_{k}") for k, c in last_before.items()])
    parts = range_sorted(src, [F.col(g).asc_nulls_first() for g in group] + order)
    inner = Window.partitionBy("_pid", *group).orderBy("_seq")
    upto, before = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    within = parts.select("*", *[F.sum(f"_s_{k}").over(upto).alias(f"_in_{k}") for k in sums], *[F.last(f"_l_{k}", ignorenulls=True).over(before).alias(f"_in_{k}") for k in last_before])
    ends = [F.sum(f"_s_{k}").alias(f"_e_{k}") for k in sums]
    ends += [F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.col("_seq"))).alias(f"_e_{k}") for k in last_before]
    edges = parts.groupBy("_pid", *group).agg(*ends)
    outer = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(
        F.col("_pid").alias("_cp"), *[F.col(g).alias(f"_cg_{g}") for g in group],
        *[F.sum(f"_e_{k}").over(outer).alias(f"_c_{k}") for k in sums], *[F.last(f"_e_{k}", ignorenulls=True).over(outer).alias(f"_c_{k}") for k in last_before],
    )
    on = F.col("_pid") == F.col("_cp")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_cg_{g}"))
    out = within.join(carry, on, "left")
    return out.select(*cols, *[(F.col(f"_in_{k}") + F.coalesce(f"_c_{k}", F.lit(0))).alias(k) for k in sums], *[F.coalesce(f"_in_{k}", f"_c_{k}").alias(k) for k in last_before])


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``row_number`` within ``group``, spread over tasks by the full ordering."""
    return running(df, group, order, sums={name: F.lit(1).cast("long")})


def nth_smallest(df: DataFrame, group: list[str], value: str, at: Column, name: str) -> DataFrame:
    """One row per group: the value at the 0-based sorted position ``at``, an expression over ``n`` (the group's rows)."""
    ranked = rank_within(df.select(*group, value).where(F.col(value).isNotNull()), group, [F.col(value).asc()], "_rn")
    size = ranked.groupBy(*group).agg(F.max("_rn").alias("n"))
    on = F.lit(True)
    sized = size.select(*[F.col(g).alias(f"_g_{g}") for g in group], (at + 1).cast("long").alias("_at"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return ranked.join(sized, on).where(F.col("_rn") == F.col("_at")).select(*group, F.col(value).alias(name))


def linear_percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float] | None:
    """Percentiles of a column with linear interpolation, over its values that are neither null nor NaN; null without any.

    Values are sorted over range partitions; two of them per share reach the driver.
    """
    some = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ranked = global_row_number(some, [F.col("v").asc()], "_rn")
    n = ranked.count()
    if not n:
        return None
    at = [(n - 1) * s for s in shares]
    wanted = sorted({k for x in at for k in (math.floor(x) + 1, math.ceil(x) + 1)})
    got = {r["_rn"]: r["v"] for r in ranked.where(F.col("_rn").isin(*wanted)).collect()}
    return [got[math.floor(x) + 1] + (got[math.ceil(x) + 1] - got[math.floor(x) + 1]) * (x - math.floor(x)) for x in at]
