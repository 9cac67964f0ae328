"""Reading a source of cells by a declared specification into typed rows."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.scalars import finite_or, name_key, parse_number, parse_positions, truthy
from slatework.operators.metrics import first_pick, last_pick
from slatework.session import discard, store
from slatework.sources.sheets import SCHEMA, SheetsDataSource

IDENTITY = ("name", "team", "pos", "age")


class SpecError(ValueError):
    """A specification that can't be used."""


@dataclass(frozen=True)
class SourceSpec:
    """How a source's cells are read: a column is a 1-based number or a heading text."""

    id: str
    columns: dict[str, int | str]
    header_row: int = 1
    goalie_columns: dict[str, int | str] = field(default_factory=dict)
    require: tuple[str, ...] = ()
    per_game: tuple[str, ...] = ()
    derived: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rename: tuple[tuple[str, str, str], ...] = ()
    sheet: str = "main"
    #: A sheet of goalies with a mapping of its own (``goalie_columns``, else ``columns``) and its own heading line.
    goalie_sheet: str = ""
    goalie_header_row: int = 0

    @staticmethod
    def load(path: str, known: set[str] | None = None) -> list[SourceSpec]:
        """Specifications from a JSON list; raises SpecError naming what is wrong."""
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        except (OSError, ValueError) as e:
            raise SpecError(f"{path}: {e}") from e
        out = [SourceSpec(**{k: tuple(map(tuple, v)) if k == "rename" else tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in raw]
        for s in out:
            s.check(known)
        if len({s.id for s in out}) < len(out):
            raise SpecError("repeated id")
        return out

    def check(self, known: set[str] | None = None) -> None:
        if not self.id or "name" not in self.columns:
            raise SpecError(f"{self.id or 'a source'}: an id and a name column are needed")
        odd = {*self.columns, *self.goalie_columns, *self.derived} - set(IDENTITY) - (known if known is not None else {*self.columns, *self.goalie_columns, *self.derived})
        if odd:
            raise SpecError(f"{self.id}: unknown fields {sorted(odd)}")


def header_index(heads: list[str | None]) -> dict[str, int]:
    """Heading (lower case, single spaces) to 1-based column; of repeated headings the first."""
    out: dict[str, int] = {}
    for i, h in enumerate(heads, 1):
        out.setdefault(" ".join((h or "").lower().split()), i)
    return out


def resolve_columns(columns: dict[str, int | str], heads: list[str | None], source: str) -> dict[str, int]:
    """Field to 1-based column; raises SpecError for a heading that isn't there, before any job runs."""
    index = header_index(heads)
    out = {}
    for f, c in columns.items():
        at = c if isinstance(c, int) else index.get(" ".join(c.lower().split()))
        if not at:
            raise SpecError(f"{source}: no column {c!r} for {f}")
        out[f] = at
    return out


def cell(n: int) -> Column:
    """The 1-based cell, null beyond the row's end."""
    return F.try_element_at(F.col("cells"), F.lit(n))


def read_source(cells: DataFrame, spec: SourceSpec) -> DataFrame:
    """``source, row_no, name, key, team, pos, age, stats`` of one sheet's ``row_no, cells``.

    In order: blank names and repeated headings go; goalies (position list exactly G) read the goalie columns;
    renames by name and position, the first that fits; rows with a blank required field go; numbers are
    parsed; per-game statistics are multiplied by games, and without games the row goes; derived
    statistics are sums of their present parts, never rescaled; rows without any statistic go.
    """
    spec.check()
    first = cells.where(F.col("row_no") == spec.header_row).select("cells").first()
    heads = list(first["cells"]) if first else []
    main = resolve_columns(spec.columns, heads, spec.id)
    over = resolve_columns(spec.goalie_columns, heads, spec.id)
    rows = cells.where((F.col("row_no") > spec.header_row) & (F.coalesce(F.trim(cell(main["name"])), F.lit("")) != ""))
    labels = [h for h in header_index(heads) if h]
    rows = rows.where(~F.lower(F.trim(cell(main["name"]))).isin(*labels)) if labels else rows
    pos = parse_positions(cell(main["pos"])) if "pos" in main else F.array().cast("array<string>")
    goalie = pos == F.array(F.lit("G"))
    fields = [*dict.fromkeys([*main, *over])]
    get = lambda f: F.when(goalie, cell(over[f])).otherwise(cell(main[f]) if f in main else F.lit(None)) if f in over else cell(main[f])
    text = rows.select("row_no", pos.alias("pos"), *[get(f).alias(f"x_{f}") for f in fields if f != "pos"])
    name = F.trim("x_name")
    named = reduce(lambda c, r: c.when((name == r[0]) & F.array_contains("pos", r[1]), r[2]), spec.rename[1:], F.when((name == spec.rename[0][0]) & F.array_contains("pos", spec.rename[0][1]), spec.rename[0][2])).otherwise(name) if spec.rename else name
    for f in spec.require:
        text = text.where(F.size("pos") > 0) if f == "pos" else text.where(F.coalesce(F.trim(f"x_{f}"), F.lit("")) != "")
    stats = [f for f in fields if f not in IDENTITY]
    nums = text.select("row_no", named.alias("name"), F.trim(F.col("x_team") if "x_team" in text.columns else F.lit(None).cast("string")).alias("team"), "pos", (parse_number(F.col("x_age")) if "age" in fields else F.lit(None).cast("double")).alias("age"), *[parse_number(F.col(f"x_{f}")).alias(f) for f in stats])
    if spec.per_game:
        nums = nums.where(truthy(F.col("GP")))
        nums = nums.select(*[(F.col(c) * F.col("GP")).alias(c) if c in spec.per_game else F.col(f"`{c}`") for c in nums.columns])
    for d, parts in spec.derived.items():
        present = F.filter(F.array(*[F.col(f"`{p}`") for p in parts]), lambda x: x.isNotNull())
        nums = nums.withColumn(d, F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x)))
        stats = [*dict.fromkeys([*stats, d])]
    packed = F.map_filter(F.create_map(*[x for s in stats for x in (F.lit(s), F.col(f"`{s}`"))]), lambda _, v: v.isNotNull()) if stats else F.create_map().cast("map<string,double>")
    out = nums.select(F.lit(spec.id).alias("source"), "row_no", "name", name_key(F.col("name")).alias("key"), "team", "pos", "age", packed.alias("stats"))
    return out.where(F.size("stats") > 0)


def read_sheets(cells: DataFrame, spec: SourceSpec) -> DataFrame:
    """``read_source`` of ``sheet, row_no, cells``: the main sheet, and the sheet of goalies where the specification names one.

    With a sheet of goalies the main one has no goalie columns to overlay.
    """
    of = lambda name: cells.where(F.col("sheet") == name).select("row_no", "cells")
    if not spec.goalie_sheet:
        return read_source(of(spec.sheet), spec)
    main = read_source(of(spec.sheet), replace(spec, goalie_columns={}))
    own = replace(spec, columns=spec.goalie_columns or spec.columns, goalie_columns={}, header_row=spec.goalie_header_row or spec.header_row)
    return main.unionByName(read_source(of(spec.goalie_sheet), own))


def read_pick_sheets(sheets: list[DataFrame], columns: dict[str, int], name_col: int = 1, first_row: int = 2) -> DataFrame:
    """``key, provider, value`` of several sheets ``row_no, cells`` that each hold a column per provider; later sheets and rows overwrite."""
    each = []
    for i, s in enumerate(sheets):
        for provider, col in columns.items():
            row = s.where(F.col("row_no") >= first_row).select(name_key(cell(name_col)).alias("key"), F.lit(provider).alias("provider"), parse_number(cell(col)).alias("value"), F.lit(i).alias("ord"), "row_no")
            each.append(row.where("key is not null and key != '' and value is not null"))
    return last_pick(reduce(DataFrame.unionByName, each))


def _is_data(first: Column) -> Column:
    """Whether a line of a list is neither blank, nor a comment, nor its heading."""
    t = F.lower(F.trim(F.coalesce(first, F.lit(""))))
    return (t != "") & ~t.startswith("#") & ~t.isin("name", "player", "alias")


def read_ages(cells: DataFrame) -> DataFrame:
    """``key, age``: a name and an age, rounded half even to a whole number; unreadable ones fall out, the last row of a name counts."""
    age = F.bround(parse_number(cell(2), lenient=False), 0).cast("int")
    rows = cells.where(_is_data(cell(1))).select(name_key(cell(1)).alias("key"), age.alias("age"), "row_no").where("key != '' and age is not null")
    return rows.groupBy("key").agg(F.max_by("age", "row_no").alias("age"))


def read_aliases(cells: DataFrame) -> DataFrame:
    """``alias, canonical`` as name keys; comments, blank lines and headings are no aliases."""
    rows = cells.where(_is_data(cell(1))).select(name_key(cell(1)).alias("alias"), name_key(cell(2)).alias("canonical"))
    return rows.where("alias != '' and canonical != ''")


def reference_list(cells: DataFrame, name_col: int, pos_col: int, age_col: int) -> DataFrame:
    """``key, positions, age`` of a workbook list; the first row of a name counts, nameless rows fall out."""
    rows = cells.select(name_key(cell(name_col)).alias("key"), parse_positions(cell(pos_col)).alias("positions"), F.bround(parse_number(cell(age_col)), 0).cast("int").alias("age"), "row_no")
    return rows.where("key is not null and key != ''").groupBy("key").agg(F.min_by("positions", "row_no").alias("positions"), F.min_by("age", "row_no").alias("age"))


def load_settings(path: str, defaults: dict) -> dict:
    """Settings from a JSON object over ``defaults``; numbers that aren't finite fall back. Raises SpecError for an unreadable file or unknown keys."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    except (OSError, ValueError) as e:
        raise SpecError(f"{path}: {e}") from e
    if not isinstance(raw, dict) or set(raw) - set(defaults):
        raise SpecError(f"{path}: unknown settings {sorted(set(raw) - set(defaults)) if isinstance(raw, dict) else type(raw).__name__}")
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    return {k: finite_or(raw.get(k, d), d) if number(d) else raw.get(k, d) for k, d in defaults.items()}


_read: dict[tuple, DataFrame] = {}


def load_rows(spark: SparkSession, path: str, sheet: str | None = None, max_col: int | None = None) -> DataFrame:
    """``file, sheet, row_no, cells`` of a file, read once per session, sheet and width for as long as its time and size stay; empty if it is missing."""
    if not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    at = os.stat(path)
    key = (id(spark), path, sheet, at.st_mtime_ns, at.st_size, max_col)
    if key not in _read:
        for old in [k for k in _read if k[:3] == key[:3] and k[5] == max_col]:
            discard(_read.pop(old))
        spark.dataSource.register(SheetsDataSource)
        reader = spark.read.format("sheets").option("path", path)
        reader = reader if sheet is None else reader.option("sheet", sheet)
        _read[key] = store((reader if max_col is None else reader.option("max_col", max_col)).load())
    return _read[key]


def read_picks(cells: DataFrame, provider: str, ord_: int, name_col: int = 1, value_col: int = 2) -> DataFrame:
    """``key, provider, value``: a name and number list; comment, heading and unreadable rows fall out."""
    v = parse_number(cell(value_col), lenient=False)
    rows = cells.select(name_key(cell(name_col)).alias("key"), F.lit(provider).alias("provider"), v.alias("value"), F.lit(ord_).alias("ord"), "row_no")
    return first_pick(rows.where("key is not null and key != '' and not startswith(key, '#')"))


def read_rulings(cells: DataFrame, provider: str) -> DataFrame:
    """``key, provider, positions``: a name and its positions, over as many columns as the row has; unknown codes fall out."""
    parts = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: F.split(F.upper(F.coalesce(c, F.lit(""))), r"[/,;|]"))
    codes = F.array_distinct(F.filter(F.transform(F.flatten(parts), F.trim), lambda p: p.isin("C", "LW", "RW", "D", "G")))
    rows = cells.select(name_key(cell(1)).alias("key"), F.lit(provider).alias("provider"), codes.alias("positions"))
    return rows.where("key is not null and key != '' and not startswith(key, '#') and size(positions) > 0")


def row_range(cells: DataFrame, first: int, last: int, code_col: int = 1, longest: int = 4) -> DataFrame:
    """Rows of a table inside a sheet, by row numbers; codes longer than ``longest`` (totals) fall out."""
    code = F.upper(F.trim(cell(code_col)))
    return cells.where(F.col("row_no").between(first, last)).withColumn("code", code).where((F.length("code") > 0) & (F.length("code") <= longest))
