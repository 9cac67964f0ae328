"""Schemas that drift between the files of one edition.

Each mapping gets a fingerprint and, within its edition, a version number; only files whose fingerprint differs from their predecessor's are
compared key by key. Every change is a migration step (added, removed, renamed, type). Chained
rename steps lead each file's key back to the name its column had when it first appeared, and the
rows of all files are routed through rename, default and cast rules into one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.scalars import parse_number, parse_positions
from slatework.operators.ordering import previous_row, running
from slatework.session import store

SECTIONS = ("columns", "goalie_columns")
#: Sheet whose cells each mapping describes.
SHEET_OF = {"columns": "main", "goalie_columns": "goalie"}
# Words that name a summary line, anywhere in its name or as all of it.
SUMMARY = r"(?iu)\b(?:averages?|avg|totals?|subtotals?|median|durchschnitt|gesamt|moyenne|genomsnitt|totalt)\b|^\W*(?:mean|sum|summary|summe|summa|somme|medel)\W*$"
IDENTITY = ("name", "team", "pos", "age")


def heading_key(c: Column) -> Column:
    """Headings are compared without regard to case and spacing."""
    return F.lower(F.regexp_replace(c, r"[\s\p{Z}]+", ""))


def mapping_entries(text: Column) -> Column:
    """``map<key, struct<kind, col, head, text>>`` of a JSON object text.

    ``kind`` is ``number``, ``string`` or ``other``; ``col`` is the column number, also of one
    written as a string; ``head`` is the comparable heading of any other string and ``text`` that of every one. Null, blank and
    unreadable texts are an empty mapping; a byte order mark is ignored; of a repeated key the last
    value counts.
    """
    raw = F.from_json(F.regexp_replace(text, "^[\\s﻿]+", ""), "map<string,variant>")
    pairs = F.coalesce(F.map_entries(raw), F.array().cast("array<struct<key:string,value:variant>>"))

    def one(e: Column) -> Column:
        s = F.try_variant_get(e["value"], "$", "string")
        kind = F.schema_of_variant(e["value"])
        number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
        digits = F.trim(s).rlike(r"^[0-9]+(\.0+)?$")
        col = F.when(number | ((kind == "STRING") & digits), F.trim(s).try_cast("double").cast("long"))
        return F.struct(
            e["key"].alias("key"),
            F.struct(
                F.when(number, "number").when(kind == "STRING", "string").otherwise("other").alias("kind"),
                col.alias("col"),
                F.when((kind == "STRING") & ~digits, heading_key(s)).alias("head"),
                F.when(kind == "STRING", heading_key(s)).alias("text"),
            ).alias("value"),
        )

    return F.map_from_entries(F.transform(pairs, one))


def fingerprint(entries: Column) -> Column:
    """A hash of the mapping that layout and key order don't change."""
    return F.xxhash64(F.to_json(F.array_sort(F.map_entries(entries))))


def _canonical(files: DataFrame) -> DataFrame:
    out = files
    for s in SECTIONS:
        out = out.withColumn(f"m_{s}", mapping_entries(F.col(s))).withColumn(f"f_{s}", fingerprint(F.col(f"m_{s}")))
    return out


def _steps(prev: Column, cur: Column) -> Column:
    """Array of ``struct<field, change, was>`` between two mappings."""
    pk, ck = F.map_keys(prev), F.map_keys(cur)
    gone, new, kept = F.array_except(pk, ck), F.array_except(ck, pk), F.array_intersect(ck, pk)
    step = lambda f, c, w: F.struct(f.alias("field"), F.lit(c).alias("change"), w.cast("string").alias("was"))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["col"] == b["col"], F.lit(False)) | F.coalesce(a["head"] == b["head"], F.lit(False))

    origin = lambda k: F.filter(gone, lambda g: same(prev[g], cur[k]))
    renamed = F.transform(F.filter(new, lambda k: F.size(origin(k)) > 0), lambda k: step(k, "renamed", F.array_min(origin(k))))
    added = F.transform(F.filter(new, lambda k: F.size(origin(k)) == 0), lambda k: step(k, "added", F.lit(None)))
    removed = F.transform(F.filter(gone, lambda g: ~F.exists(new, lambda k: same(prev[g], cur[k]))), lambda g: step(g, "removed", g))
    # Of two texts only those that are both column numbers are no headings.
    other = lambda a, b: F.coalesce((a["text"] != b["text"]) & ~(a["col"].isNotNull() & b["col"].isNotNull()), F.lit(False))
    heading = F.transform(F.filter(kept, lambda k: other(prev[k], cur[k])), lambda k: step(k, "renamed", k))
    kinds = lambda k, a, b: (prev[k]["kind"] == a) & (cur[k]["kind"] == b)
    typed = F.transform(F.filter(kept, lambda k: kinds(k, "number", "string") | kinds(k, "string", "number")), lambda k: step(k, "type", k))
    return F.concat(renamed, added, removed, heading, typed)


def schema_changes(files: DataFrame) -> DataFrame:
    """Every change between a file and the one before it in its edition.

    Input: ``file_id, edition, published_at, columns, goalie_columns``; other columns are ignored.
    Output: ``file_id, section, field, change`` and ``was`` (the former key), ``edition``,
    ``published_at``. The predecessor is the one by ``published_at`` (null first), then ``file_id``;
    the first file of an edition has no changes. A null edition is an edition of its own. Unreadable
    mappings count as empty. Repeated rows of one file change nothing.
    """
    base = _canonical(files.select("file_id", "edition", "published_at", *SECTIONS).dropDuplicates())
    slim = base.select("file_id", "edition", "published_at", *[f"f_{s}" for s in SECTIONS], *SECTIONS)
    pairs = previous_row(slim, ["edition"], [F.col("published_at").asc_nulls_first(), F.col("file_id").asc_nulls_first()])
    out = None
    for s in SECTIONS:
        moved = pairs.where(F.col("prev").isNotNull() & (F.col(f"prev.f_{s}") != F.col(f"f_{s}")))
        moved = moved.select("file_id", "edition", "published_at", mapping_entries(F.col(f"prev.{s}")).alias("a"), mapping_entries(F.col(s)).alias("b"))
        rows = moved.select("file_id", "edition", "published_at", F.lit(s).alias("section"), F.explode(_steps(F.col("a"), F.col("b"))).alias("x"))
        rows = rows.select("file_id", "section", "x.field", "x.change", "x.was", "edition", "published_at")
        out = rows if out is None else out.unionByName(rows)
    return out


def schema_versions(files: DataFrame) -> DataFrame:
    """The version number of each file's schema: 1 + the changes of fingerprint so far in its edition.

    Output: ``file_id, edition, section, version, fingerprint, n_fields``. Order and predecessor as in ``schema_changes``.
    """
    base = _canonical(files.select("file_id", "edition", "published_at", *SECTIONS).dropDuplicates())
    slim = base.select("file_id", "edition", "published_at", *[f"f_{s}" for s in SECTIONS], *[F.size(f"m_{s}").alias(f"n_{s}") for s in SECTIONS])
    order = [F.col("published_at").asc_nulls_first(), F.col("file_id").asc_nulls_first()]
    pairs = previous_row(slim, ["edition"], order)
    moved = {f"v_{s}": F.when(F.col("prev").isNull() | (F.col(f"prev.f_{s}") != F.col(f"f_{s}")), 1).otherwise(0).cast("long") for s in SECTIONS}
    numbered = running(pairs.select("*", *[c.alias(f"_{k}") for k, c in moved.items()]).drop("prev"), ["edition"], order, sums={k: F.col(f"_{k}") for k in moved})
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"v_{s}").alias("version"), F.col(f"f_{s}").alias("fingerprint"), F.col(f"n_{s}").alias("n_fields")) for s in SECTIONS])
    return numbered.select("file_id", "edition", F.inline(each))


def field_origins(files: DataFrame, changes: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """For every file and key the key its column had when it first appeared in the edition.

    Output: ``file_id, section, field, origin, kind, col, head``. Rename steps between keys form
    chains; each step looks up the step before it and pointers double until none moves (``2**40``
    steps at most), so a long chain takes few rounds and no edition is folded in one task.
    """
    base = _canonical(files.select("file_id", "edition", "published_at", *SECTIONS).dropDuplicates(["file_id"]))
    at = F.struct(F.col("published_at"), F.col("file_id"))
    keys = None
    for s in SECTIONS:
        k = base.select("file_id", "edition", at.alias("at"), F.lit(s).alias("section"), F.explode(f"m_{s}").alias("field", "v"))
        keys = k if keys is None else keys.unionByName(k)
    changes = schema_changes(files) if changes is None else changes
    steps = changes.where((F.col("change") == "renamed") & (F.col("was") != F.col("field")))
    steps = store(steps.groupBy("edition", "section", "field", at.alias("at")).agg(F.min("was").alias("was")))
    steps = steps.withColumn("step", F.xxhash64("edition", "section", "field", "at"))

    def parent(rows: DataFrame, key: str, late: int) -> DataFrame:
        """Adds ``up``: the last step that ended in ``key`` at or (late 0) before the row's file."""
        marks = steps.select("edition", "section", F.col("field").alias("key"), "at", F.lit(1).alias("late"), F.col("step").alias("mark"), F.lit(None).cast("long").alias("rid"))
        asks = rows.select("edition", "section", F.col(key).alias("key"), "at", F.lit(late).alias("late"), F.lit(None).cast("long").alias("mark"), "rid")
        order = [F.col("at").asc_nulls_first(), F.col("late").asc(), F.col("mark").asc_nulls_first(), F.col("rid").asc_nulls_first()]
        found = running(marks.unionByName(asks), ["edition", "section", "key"], order, last_before={"up": F.col("mark")})
        return rows.join(found.where(F.col("rid").isNotNull()).select("rid", "up"), "rid", "left")

    tree = parent(steps.withColumn("rid", F.col("step")), "was", 0).select("step", "was", "up")
    tree = store(tree.select("step", F.coalesce("up", "step").alias("up"), F.col("was").alias("origin")))
    for _ in range(max_rounds):
        top = tree.select(F.col("step").alias("up"), F.col("up").alias("up2"), F.col("origin").alias("origin2"))
        jumped = tree.join(top, "up").select("step", F.col("up2").alias("up"), F.col("origin2").alias("origin"), (F.col("up") != F.col("up2")).alias("moved"))
        jumped = store(jumped)
        tree = jumped.select("step", "up", "origin")
        if jumped.where("moved").isEmpty():
            break
    keys = keys.withColumn("rid", F.xxhash64("file_id", "section", "field"))
    named = parent(keys, "field", 2).join(tree.select(F.col("step").alias("up"), "origin"), "up", "left")
    return named.select("file_id", "section", "field", F.coalesce("origin", "field").alias("origin"), "v.kind", "v.col", "v.head")


def consistent_table(files: DataFrame, cells: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """All data rows of all files under one schema.

    Output: ``file_id, sheet, row_no, name, team, pos array<string>, age double, stats map<string,double>``.
    Fields are named by their origin. Rules: a column number beyond the row, an unknown heading, a
    blank mark or an unreadable number is null (default rule); numbers lose thousands commas, a
    leading apostrophe and a per cent sign, and ``m:ss`` becomes minutes (cast rule). Banner, heading
    and repeated heading lines, lines without a name and summary lines (a name such as
    ``League Average``, no team and no position) are no data; other names stay, whether or not their file has a team or position. Files without a mapping for a sheet give no rows of it.
    """
    origins = field_origins(files) if origins is None else origins
    sheet = F.create_map(*[F.lit(x) for kv in SHEET_OF.items() for x in kv])[F.col("section")]
    head = files.select("file_id", "header_row").dropDuplicates(["file_id"])
    rows = cells.select("file_id", "sheet", "row_no", "cells").join(head, "file_id")
    heads = rows.where(F.col("row_no") == F.col("header_row")).groupBy("file_id", "sheet").agg(F.min("cells").alias("heads"))
    heads = heads.select("file_id", "sheet", F.transform("heads", heading_key).alias("heads"))
    plan = origins.select("file_id", sheet.alias("sheet"), "origin", "col", "head").join(heads, ["file_id", "sheet"])
    place = F.coalesce(F.col("col").cast("int"), F.nullif(F.array_position("heads", F.col("head")).cast("int"), F.lit(0)))
    plan = plan.select("file_id", "sheet", "heads", F.struct("origin", place.alias("place")).alias("r"))
    plan = plan.groupBy("file_id", "sheet").agg(F.min("heads").alias("heads"), F.array_sort(F.collect_set("r")).alias("rules"))
    data = rows.where(F.col("row_no") > F.col("header_row")).join(plan, ["file_id", "sheet"])
    cell = lambda r: F.when(r["place"] > 0, F.try_element_at(F.col("cells"), r["place"]))
    got = data.where(~(F.transform("cells", heading_key) == F.col("heads")))

    def text(f: str) -> Column:
        hit = F.try_element_at(F.filter("rules", lambda r: r["origin"] == f), F.lit(1))
        return F.nullif(F.trim(cell(hit)), F.lit(""))

    stats = F.map_from_entries(
        F.filter(
            F.transform(F.filter("rules", lambda r: ~r["origin"].isin(*IDENTITY)), lambda r: F.struct(r["origin"].alias("key"), parse_number(cell(r)).alias("value"))),
            lambda e: e["value"].isNotNull(),
        )
    )
    out = got.select("file_id", "sheet", "row_no", text("name").alias("name"), text("team").alias("team"), parse_positions(text("pos")).alias("pos"), parse_number(text("age")).alias("age"), stats.alias("stats"))
    return out.where(F.col("name").isNotNull() & ~(F.col("name").rlike(SUMMARY) & F.col("team").isNull() & (F.size("pos") == 0)))
