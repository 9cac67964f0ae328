"""Event logs folded into state, in batch and with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.operators.ordering import range_sorted

#: Events of a key that are folded at a time.
FOLD = 4096


def event_stream(spark: SparkSession, path: str, pattern: str = "events*.parquet", watermark: str = "1 hour") -> DataFrame:
    """The event files of a folder as a stream, timestamps with zone and watermark."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, event_type, n, total`` per event-time window; the same for a stream and a table."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``user_id, start, end, n`` of each user's sessions, split where nothing happens for ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def toggled(events: DataFrame, key: str, toggle: str, on: str, off: str) -> DataFrame:
    """``key, state``: whether a switch is on after all events.

    ``toggle`` flips it, ``on`` and ``off`` set it; the state is that of the last setting event, flipped by
    every toggle after it. Input: ``key, event_type, ts, event_id``. Two aggregations, no ordered fold.
    """
    at = F.struct("ts", "event_id")
    sets = F.col("event_type").isin(on, off)
    last = events.groupBy(key).agg(F.max(F.when(sets, at)).alias("_at"), F.max_by(F.when(sets, F.col("event_type") == on), F.when(sets, at)).alias("_on"))
    flips = events.where(F.col("event_type") == toggle).join(last, key).where(F.col("_at").isNull() | (at > F.col("_at"))).groupBy(key).agg(F.count("*").alias("_n"))
    odd = F.coalesce("_n", F.lit(0)) % 2 == 1
    return last.join(flips, key, "left").select(key, (F.coalesce("_on", F.lit(False)) != odd).alias("state"))


def fold_states(events: DataFrame, key: str, steps: Column, states: int, start: int = 0) -> DataFrame:
    """``key, state``: a machine of a few states after all events of a key, in the order of ``ts, event_id``.

    ``steps``: per event an array with the next state for each of the states ``0 .. states - 1``; null changes nothing. Such
    maps compose in order, so that runs of events fold apart: range partitions split a key with very many events, each
    part becomes one map, and only these meet.
    """
    each = events.select(F.col(key).alias("_k"), "ts", "event_id", steps.alias("_m")).where(F.col("_m").isNotNull())
    sorted_ = range_sorted(each, [F.col("_k").asc_nulls_first(), F.col("ts").asc(), F.col("event_id").asc()])

    def compose(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        same = F.array(*[F.lit(i) for i in range(states)])
        maps = F.transform(F.array_sort(F.collect_list(F.struct(order, "_m"))), lambda x: x["_m"])
        return rows.groupBy(*by).agg(F.aggregate(maps, same, lambda a, m: F.transform(a, lambda s: F.element_at(m, s + 1))).alias("_m"))

    # Blocks bound what is collected within a partition.
    blocks = compose(sorted_.withColumn("_b", F.floor(F.col("_seq") / FOLD)), ["_k", "_pid", "_b"], "_seq")
    parts = compose(blocks, ["_k", "_pid"], "_b")
    return compose(parts, ["_k"], "_pid").select(F.col("_k").alias(key), F.element_at("_m", start + 1).alias("state"))


def clamped_levels(events: DataFrame, key: str, step: Column, most: int = 3) -> DataFrame:
    """``key, level``: steps of +1 and -1 in order, never beyond ``most`` either way. Keys without a step have no row."""
    n = 2 * most + 1
    move = F.array(*[F.least(F.lit(n - 1), F.greatest(F.lit(0), F.lit(s) + step.cast("int"))) for s in range(n)])
    out = fold_states(events, key, F.when(step.isNotNull() & (step != 0), move), n, most)
    return out.select(key, (F.col("state") - most).alias("level"))


def drafted_state(events: DataFrame, key: str, draft: str, mine: str) -> DataFrame:
    """``key, drafted, mine`` after all events: ``draft`` takes a player or, taken, frees them; ``mine`` takes them for oneself or, one's own, frees them.

    One's own players are drafted, and who is freed is no longer one's own.
    """
    free, drafted, own = 0, 1, 2
    of = {draft: [drafted, free, free], mine: [own, own, free]}
    steps = F.create_map(*[x for k, to in of.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in to]))])[F.col("event_type")]
    out = fold_states(events, key, steps, 3)
    return out.select(key, (F.col("state") > free).alias("drafted"), (F.col("state") == own).alias("mine"))


def exclusive_marks(events: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """``key, mark`` after all events: a mark replaces any other and, set again, is taken off; null for none."""
    n = len(marks) + 1
    steps = F.create_map(*[x for i, m in enumerate(marks, 1) for x in (F.lit(m), F.array(*[F.lit(0 if s == i else i) for s in range(n)]))])[F.col("event_type")]
    out = fold_states(events, key, steps, n)
    return out.select(key, F.when(F.col("state") > 0, F.element_at(F.array(*[F.lit(m) for m in marks]), F.col("state"))).alias("mark"))


def coalesced(stream: DataFrame, update, interval: str = "260 milliseconds"):
    """Starts a query that hands every trigger's events to ``update(batch, batch_id)`` at once, so that a burst is recomputed once."""
    return stream.writeStream.trigger(processingTime=interval).foreachBatch(update).start()


STATE = T.StructType([T.StructField("on", T.BooleanType()), T.StructField("n", T.LongType())])


def toggle_stream(events: DataFrame, key: str, toggle: str, on: str, off: str) -> DataFrame:
    """The streaming form of ``toggled``: ``key, state, n`` after every batch that touches a key.

    State is one flag and one count per key. Within a batch events apply by ``ts, event_id``.
    """
    out = T.StructType([T.StructField(key, T.LongType()), T.StructField("state", T.BooleanType()), T.StructField("n", T.LongType())])

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        flag, n = state.get if state.exists else (False, 0)
        for kind in pd.concat(list(batches)).sort_values(["ts", "event_id"])["event_type"]:
            flag = (not flag) if kind == toggle else True if kind == on else False if kind == off else flag
            n += 1
        state.update((bool(flag), int(n)))
        yield pd.DataFrame({key: [k[0]], "state": [bool(flag)], "n": [int(n)]})

    return events.groupBy(key).applyInPandasWithState(fold, out, STATE, "update", "NoTimeout")
