"""Queries over sources, lists, imports, sinks and state, with their SQL.

The cells of ``sheet_row`` are written as delimited, HTML and xlsx files in the shared folder and read again; a wide sheet
is made of ``source_row`` to be read by a specification and to be imported.
"""

from __future__ import annotations

import html
import io
import os
import shutil
import unicodedata
import uuid
import zipfile
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.scalars import escape_html, name_key, surname
from slatework.functions.teams import is_known_team, normalize_team, spelling_maps
from slatework.operators import board as bd
from slatework.operators import identity, metrics
from slatework.plans import reference_queries as ref
from slatework.session import ensure_checkpoint_dir, spread, store, table
from slatework.sources import infer, reader, sinks
from slatework.sources.sheets import SheetsDataSource
from slatework.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------------------------------------------
# names in SQL

#: Characters of which the compatibility decomposition has an ASCII part, by the length of that part.
_FOLDED = {chr(i): unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode() for lo, hi in ((0x80, 0x250), (0x2B0, 0x300), (0x2000, 0x2070), (0x2100, 0x2150), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)) for i in range(lo, hi)}
_ONE = {k: v for k, v in _FOLDED.items() if len(v) == 1}
_MORE = {k: v for k, v in _FOLDED.items() if len(v) > 1}


def _key_sql(c: str) -> str:
    """SQL of ``name_key``."""
    quoted = lambda x: x.replace("'", "''")
    plain = f"translate({c}, '{quoted(''.join(_ONE))}', '{quoted(''.join(_ONE.values()))}')"
    for k, v in _MORE.items():
        plain = f"replace({plain}, '{k}', '{quoted(v)}')"
    plain = rf"regexp_replace({plain}, '[^\x00-\x7F]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower({plain}), '[.''`]', '', 'g'), '-', ' '), '\b(jr|sr|ii|iii|iv)\b', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


# ---------------------------------------------------------------------------------------------------
# files


def _as_csv(rows: list[list[str]]) -> bytes:
    quote = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n\r;|\t') or not x else x
    return ("﻿" + "\r\n".join(",".join(quote(x or "") for x in r) for r in rows)).encode()


def _as_html(rows: list[list[str]]) -> bytes:
    body = "".join("<tr>" + "".join(f"<td>{html.escape(x or '')}</td>" for x in r) + "</tr>" for r in rows)
    return f"<html><body><table>{body}</table></body></html>".encode()


def _as_xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join(f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{html.escape(x or "")}</t></is></c>' for x in r) + "</row>" for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def write_files(cells: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Writes every file of ``files`` (``file_id, fmt``) with its ``cells`` into the shared folder: ``name`` of each one written.

    One file's sheets meet in one task, which writes its files one after the other; a delimited or HTML file is written per sheet.
    """
    at = folder.removeprefix("file:")
    os.makedirs(at, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in zip(*[pdf[c] for c in ("file_id", "fmt", "sheet", "row_no", "cells")], strict=True))
        names: list[str] = []
        for (file_id, fmt), own in groupby(rows, itemgetter(0, 1)):
            sheets: dict[str, list[list[str]]] = {}
            for _, _, s, n, c in own:
                grid = sheets.setdefault(s, [])
                grid += [[] for _ in range(n - len(grid))]
                grid[n - 1] = list(c)
            made = {f"{file_id}.xlsx": _as_xlsx(sheets)} if fmt == "xlsx" else {f"{file_id}-{s}.{fmt}": (_as_html if fmt == "html" else _as_csv)(g) for s, g in sheets.items()}
            for name, data in made.items():
                with open(os.path.join(at, name), "wb") as f:
                    f.write(data)
            names += made
        yield pd.DataFrame({"name": names}, dtype=str)

    rows = cells.where("sheet is not null").join(files.select("file_id", "fmt").dropDuplicates(["file_id"]), "file_id").select("file_id", "fmt", "sheet", "row_no", "cells")
    return spread(rows, "file_id").sortWithinPartitions("file_id", "sheet", "row_no").mapInPandas(write, "name string")


@_query(r"""
SELECT file_id, sheet, row_no, array_to_string(list_transform(cells, lambda x: trim(regexp_replace(coalesce(x, ''), '[\s' || chr(160) || ']+', ' ', 'g'))), '|') AS cells
FROM sheet_row JOIN (SELECT DISTINCT file_id FROM sources) USING (file_id) WHERE len(list_filter(cells, lambda x: trim(coalesce(x, '')) <> '')) > 0""")  # fmt: skip
def ref_sheet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered file written in its format and read again by the data source ``sheets``."""
    # A folder of its own, so that no file of an earlier run is read.
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "sheet_row"), table(spark, sf_dir, "sources"), folder).count()
    spark.dataSource.register(SheetsDataSource)
    got = store(spark.read.format("sheets").option("path", folder.removeprefix("file:")).load())
    shutil.rmtree(folder.removeprefix("file:"))
    name = F.element_at(F.split("file", "/"), -1)
    tidy = F.transform("cells", lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s ]+", " ")))
    rows = got.select(
        F.regexp_extract(name, r"^(\d+)", 1).cast("long").alias("file_id"), F.when(name.endswith(".xlsx"), F.col("sheet")).otherwise(F.regexp_extract(name, r"-(\w+)\.", 1)).alias("sheet"),
        F.col("row_no"), tidy.alias("cells"),
    )
    return rows.where(F.exists("cells", lambda x: x != "")).withColumn("cells", F.array_join("cells", "|"))


# ---------------------------------------------------------------------------------------------------
# a wide sheet read by specification

WIDE = ["Player", "Tm", "Pos", "Age", "GP", "G", "A", "Pts", "Hits", "Wins", "Svs", "Starts"]


def wide_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_no, cells``: the rows of ``source_row`` as text under a heading line at row 0; goals per game."""
    r = table(spark, sf_dir, "source_row")
    of = lambda s: F.try_element_at("stats", F.lit(s))
    num = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("--"))
    age = F.when(F.isnan("age"), None).otherwise(F.col("age"))
    rate = F.when(of("GP") != 0, of("G") / of("GP"))
    cells = F.array(F.col("name"), F.col("team"), F.array_join("pos", ", "), num(age), num(of("GP")), num(rate), num(of("A")), num(of("PTS")), num(of("HIT")), num(of("W")), num(of("SV")), num(of("GP")))
    head = spark.range(1).select(F.lit(0).cast("long").alias("row_no"), F.array(*[F.lit(h) for h in WIDE]).alias("cells"))
    return head.unionByName(r.select("row_no" if "row_no" in r.columns else F.col("row_id").alias("row_no"), cells.alias("cells")))


_WIDE_SQL = rf"""
WITH t AS (
  SELECT row_id AS row_no, name, team, list_filter(coalesce(pos, []), lambda p: p IS NOT NULL) AS pos, CASE WHEN NOT isnan(age) THEN round(age::DECIMAL(18,8), 4)::DOUBLE END AS age,
         stats['GP'] AS gp0, CASE WHEN stats['GP'] <> 0 THEN stats['G'] / stats['GP'] END AS g0, stats['A'] AS a, stats['PTS'] AS pts, stats['HIT'] AS hit, stats['W'] AS w, stats['SV'] AS sv FROM source_row),
e AS (SELECT row_no, unnest(string_split_regex(regexp_replace(upper(array_to_string(pos, ', ')), '[^A-Z,/]', '', 'g'), '[,/]')) AS p, generate_subscripts(string_split_regex(regexp_replace(upper(array_to_string(pos, ', ')), '[^A-Z,/]', '', 'g'), '[,/]'), 1) AS i FROM t),
x AS (SELECT row_no, i, unnest(CASE p WHEN 'F' THEN ['C', 'LW', 'RW'] WHEN 'W' THEN ['LW', 'RW'] WHEN 'L' THEN ['LW'] WHEN 'R' THEN ['RW'] ELSE [p] END) AS c FROM e),
k AS (SELECT row_no, c, min(i * 10 + CASE c WHEN 'C' THEN 0 WHEN 'LW' THEN 1 ELSE 2 END) AS i FROM x WHERE c IN ('C', 'LW', 'RW', 'D', 'G') GROUP BY 1, 2),
codes AS (SELECT row_no, string_agg(c, '/' ORDER BY i) AS pos FROM k GROUP BY 1),
u AS (SELECT t.row_no, trim(name, ' ') AS name, trim(team, ' ') AS team, coalesce(codes.pos, '') AS pos, age, gp0::DECIMAL(18,4)::DOUBLE AS gp, round(g0 + 1e-9, 4) AS g, a, pts, hit, w, sv FROM t LEFT JOIN codes USING (row_no)
      WHERE trim(coalesce(name, ''), ' ') <> '' AND lower(trim(name, ' ')) NOT IN ({", ".join(f"'{h.lower()}'" for h in WIDE)}))
"""


@_query(_WIDE_SQL + f""", v AS (
  SELECT row_no, CASE WHEN name = 'Elias Ek' AND contains(pos, 'D') THEN 'Elias Ek (D)' ELSE name END AS name, team, pos, age, gp,
         CASE WHEN pos <> 'G' THEN g * gp END AS g, CASE WHEN pos <> 'G' THEN a END AS a, CASE WHEN pos = 'G' THEN w END AS w, CASE WHEN pos = 'G' THEN sv END AS sv FROM u WHERE pos <> '' AND coalesce(gp, 0) <> 0)
SELECT row_no, {_key_sql('name')} AS key, team, pos, age, round(gp, 3) AS gp, round(g + 1e-7, 3) AS g, round(CASE WHEN g IS NULL AND a IS NULL THEN NULL ELSE coalesce(g, 0.0) + coalesce(a, 0.0) END + 1e-7, 3) AS pts, round(w, 3) AS w, round(sv, 3) AS sv FROM v""")  # fmt: skip
def ref_read_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet read by its specification: headings, goalie overlay, rename, required positions, per-game goals, derived points."""
    spec = reader.SourceSpec(
        "wide", {"name": "player", "team": 2, "pos": "Pos", "age": "age", "GP": 5, "G": 6, "A": 7, "W": 99, "SV": 99}, 0, {"GP": "Starts", "G": 99, "A": 99, "W": "Wins", "SV": "svs"}, ("pos",), ("G",),
        {"PTS": ("G", "A")}, (("Elias Ek", "D", "Elias Ek (D)"),),
    )
    r = reader.read_source(store(wide_sheet(spark, sf_dir)), spec)
    of = lambda s, up=0.0: F.round(F.try_element_at("stats", F.lit(s)) + up, 3).alias(s.lower())
    return r.select("row_no", "key", "team", F.array_join("pos", "/").alias("pos"), "age", of("GP"), of("G", 1e-7), of("PTS", 1e-7), of("W"), of("SV"))


@_query(_WIDE_SQL + f""", v AS (SELECT *, {_key_sql('name')} AS key FROM u WHERE gp IS NOT NULL AND lower(name) NOT IN ('', '-', '--', '—', '–', 'n/a', 'na', 'null', '.', 'none')),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_no) AS n FROM v WHERE key <> '')
SELECT row_no, key, name, coalesce(team, '') AS team, pos, round(gp, 3) AS gp, round(g * gp + 1e-7, 3) AS g, round(hit, 3) AS hit FROM f WHERE n = 1""")  # fmt: skip
def ref_build_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheet as an unknown one: columns found by heading, goals taken per game, the first row of each name."""
    cells = store(wide_sheet(spark, sf_dir))
    built = infer.build_source(cells, infer.auto_map(cells), ["GP", "G", "A", "PTS", "HIT", "W", "SV"], 0, True, ("G",))
    of = lambda s, up=0.0: F.round(F.try_element_at("stats", F.lit(s)) + up, 3).alias(s.lower())
    return built.select("row_no", "key", "name", "team", F.array_join("pos", "/").alias("pos"), of("GP"), of("G", 1e-7), of("HIT"))


@_query(_WIDE_SQL + f""", f AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY row_no) AS n FROM (SELECT row_no, {_key_sql('name')} AS key FROM u WHERE gp IS NOT NULL AND lower(name) NOT IN ('', '-', '--', '—', '–', 'n/a', 'na', 'null', '.', 'none')) WHERE key <> ''),
b AS (SELECT DISTINCT source_id AS source, {_key_sql('name')} AS key FROM source_row WHERE name IS NOT NULL UNION SELECT 'import-1', key FROM f WHERE n = 1)
SELECT key, count(*) AS sources, count(*) FILTER (source = 'import-1') AS imported FROM b GROUP BY 1""")  # fmt: skip
def ref_commit_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import joined to the board's sources and merged by name."""
    cells = store(wide_sheet(spark, sf_dir))
    built = infer.build_source(cells, infer.auto_map(cells), ["GP", "G", "A"], 0, True, ("G",))
    rows = ref._source_rows(spark, sf_dir).withColumn("key", name_key(F.col("name")))
    both, _, new = infer.commit_import(rows, {}, built)
    m = identity.merge_sources(both)
    return m.select("key", F.size("lines").cast("long").alias("sources"), F.map_contains_key("lines", F.lit(new)).cast("long").alias("imported"))


# ---------------------------------------------------------------------------------------------------
# lists


def _cells(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("string") for c in cols[1:]]).alias("cells"), F.col(cols[0]).alias("row_no"))


@_query(f"SELECT alias, canonical FROM (SELECT {_key_sql('c0')} AS alias, {_key_sql('c1')} AS canonical FROM aliases WHERE trim(coalesce(c0, ''), ' ') <> '' AND NOT starts_with(trim(c0, ' '), '#') AND lower(trim(c0, ' ')) NOT IN ('name', 'player', 'alias')) WHERE alias <> '' AND canonical <> ''")
def ref_alias_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.read_aliases(_cells(table(spark, sf_dir, "aliases"), "alias_id", "c0", "c1"))


@_query(f"""
SELECT key, provider, max(value) AS value FROM (SELECT {_key_sql('name')} AS key, provider, pick AS value, dense_rank() OVER (PARTITION BY {_key_sql('name')} ORDER BY provider DESC) AS n FROM adp WHERE pick IS NOT NULL AND NOT isnan(pick)) WHERE key <> '' GROUP BY 1, 2""")  # fmt: skip
def ref_pick_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider's picks read as sheets; of repeated names the last row, here the greatest pick, counts."""
    a = table(spark, sf_dir, "adp").where(~F.isnan("pick"))
    rows = a.select("provider", F.array(F.col("name"), F.format_string("%.9f", "pick")).alias("cells"), (F.col("pick") * 1000000).cast("long").alias("row_no"))
    providers = sorted(r["provider"] for r in a.select("provider").distinct().collect())
    sheets = [reader.read_pick_sheets([rows.where(F.col("provider") == p)], {p: 2}, first_row=0) for p in providers]
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s)
    return out


@_query(f"""
WITH a AS (SELECT {_key_sql('name')} AS key, round_even(round(age::DECIMAL(18,8), 4)::DOUBLE, 0)::INT AS age, row_id, name FROM source_row WHERE age IS NOT NULL AND NOT isnan(age))
SELECT key, arg_max(age, row_id) AS age FROM a WHERE key <> '' AND NOT starts_with(trim(name, ' '), '#') AND lower(trim(name, ' ')) NOT IN ('', 'name', 'player', 'alias') GROUP BY 1""")  # fmt: skip
def ref_age_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "source_row").where("name is not null and age is not null").where(~F.isnan("age")).withColumn("a", F.format_string("%.4f", "age"))
    return reader.read_ages(_cells(r, "row_id", "name", "a"))


@_query(f"SELECT DISTINCT name, {_key_sql('name')} AS key, coalesce(list_filter(string_split({_key_sql('name')}, ' '), lambda w: w <> '' AND NOT starts_with(w, '('))[-1], '') AS surname FROM eligibility WHERE name IS NOT NULL")
def ref_real_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and surnames of names with accents, suffixes and brackets."""
    e = table(spark, sf_dir, "eligibility").where("name is not null").select("name").distinct().withColumn("key", name_key(F.col("name")))
    return e.withColumn("surname", surname(F.col("key")))


@_query("""
WITH n AS (SELECT lower(trim(spelling, ' ')) AS s, min(code) AS code FROM team_code WHERE kind IN ('nickname', 'city') GROUP BY 1), c AS (SELECT upper(trim(spelling, ' ')) AS s, min(code) AS code FROM team_code WHERE kind NOT IN ('nickname', 'city') GROUP BY 1),
t AS (SELECT row_id, CASE WHEN trim(coalesce(team, ''), ' ') = '' THEN '' ELSE coalesce(n.code, c.code, upper(trim(team, ' '))) END AS team FROM source_row LEFT JOIN n ON n.s = lower(trim(team, ' ')) LEFT JOIN c ON c.s = upper(trim(team, ' ')))
SELECT row_id, team, team IN (SELECT code FROM team_code) AS known FROM t""")  # fmt: skip
def ref_known_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "team_code")
    names, codes = spelling_maps(t)
    r = table(spark, sf_dir, "source_row").select("row_id", normalize_team(F.col("team"), names, codes).alias("team"))
    return r.withColumn("known", is_known_team(F.col("team"), sorted({*names.values(), *codes.values()})))


@_query("""
WITH e AS (SELECT provider, name AS key, min(positions) AS p FROM eligibility GROUP BY 1, 2), o AS (SELECT key, p FROM e WHERE provider = (SELECT min(provider) FROM e))
SELECT e.provider, count(*) AS players, count(*) FILTER (o.p IS NOT NULL AND o.p <> e.p) AS differs FROM e LEFT JOIN o USING (key) GROUP BY 1""")  # fmt: skip
def ref_provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eligibility").groupBy("provider", F.col("name").alias("key")).agg(F.min("positions").alias("positions"))
    first = e.agg(F.min("provider")).first()[0]
    return metrics.provider_counts(e.where(F.col("provider") == first).select("key", F.col("positions").alias("pos")), e)


# ---------------------------------------------------------------------------------------------------
# output

_FIXED = lambda c, n: f"coalesce(CAST(round(CAST({c} AS DECIMAL(18,6)), {n})::DECIMAL(18,{n}) AS VARCHAR), '')"


@_query(ref._BOARD + f""", sch AS (SELECT player, value AS gp FROM totals WHERE stat = 'GP')
SELECT rank, rank || ',"' || replace(name, '"', '""') || '",' || brand || ',"' || array_to_string(pos, '/') || '",' || coalesce(best_pos, '') || size || ',' || {_FIXED('vorp', 2)} || ',' || {_FIXED('price', 2)} || ',' || {_FIXED('points', 2)} || ',' ||
       {_FIXED('round(points / 8, 5)', 3)} || ',' || {_FIXED('round(gp, 4)', 1)} || ',"' || coalesce(best_pos, '') || '",' || CASE WHEN player % 3 = 0 THEN '' ELSE (player / 2)::DOUBLE::VARCHAR END || ',' || CASE WHEN player % 5 = 0 THEN '' ELSE player::VARCHAR END || ',' || CASE WHEN player % 5 = 0 THEN '' ELSE {_FIXED('price', 2)} END || ',,' || size AS line
FROM board LEFT JOIN sch USING (player)""")  # fmt: skip
def ref_ranking_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking as CSV lines of 16 columns, some of them stand-ins from the part's own columns."""
    from slatework.operators import blend

    games = blend.blend_totals(ref.stat_lines(spark, sf_dir), ref.weights(spark, sf_dir)).where("stat = 'GP'").select("player", F.round("value", 4).alias("gp"))
    b = ref.board(spark, sf_dir).join(games, "player", "left")
    some = lambda n, c: F.when(F.col("player") % n != 0, c)
    b = b.select(
        "rank", "name", F.col("brand").alias("team"), "pos", "best_pos", F.col("size").alias("tier"), "vorp", F.col("price").alias("drop_off"), "points", F.round(F.col("points") / 8, 5).alias("per_game"), "gp",
        F.col("best_pos").alias("label"), some(3, F.col("player") / 2).alias("pick"), some(5, F.col("player")).alias("last_rank"), some(5, F.col("price")).alias("last_points"), F.lit(None).cast("double").alias("last_gp"), F.col("size").alias("sources"),
    )
    return sinks.ranking_csv(b)[1]


@_query("SELECT p_partkey AS player, replace(replace(replace(replace(p_name || ' <' || p_brand || '> & \"' || p_size || '\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS text FROM part")
def ref_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ref.parts(spark, sf_dir)
    return p.select("player", escape_html(F.concat("name", F.lit(" <"), "brand", F.lit('> & "'), F.col("size").cast("string"), F.lit('"'))).alias("text"))


# ---------------------------------------------------------------------------------------------------
# state


_FOLD = """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'purchase')),
s AS (SELECT user_id, list_reduce(list_prepend(0, list(CASE event_type WHEN 'click' THEN 1 ELSE 2 END ORDER BY n)), lambda x, y: CASE WHEN y = 1 THEN {one} ELSE {two} END) AS state FROM e GROUP BY 1)
"""


@_query(_FOLD.format(one="CASE WHEN x = 0 THEN 1 ELSE 0 END", two="CASE WHEN x = 2 THEN 0 ELSE 2 END") + "SELECT user_id, state > 0 AS drafted, state = 2 AS mine FROM s")
def ref_drafted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks draft and undraft, purchases take and give up a player of one's own."""
    return ev.drafted_state(ref._events(spark, sf_dir), "user_id", "click", "purchase")


@_query(_FOLD.format(one="CASE WHEN x = 1 THEN 0 ELSE 1 END", two="CASE WHEN x = 2 THEN 0 ELSE 2 END") + "SELECT user_id, CASE state WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' END AS mark FROM s")
def ref_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.exclusive_marks(ref._events(spark, sf_dir), "user_id", ["click", "purchase"])


@_query("""
WITH b AS (SELECT lower(p_name) AS n, max(p_partkey) AS player FROM part GROUP BY 1),
s AS (SELECT p_partkey, p_partkey % 2 + 1 AS version, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE upper(p_name) END AS ref FROM part)
SELECT coalesce(b.player, p.p_partkey) AS player, s.p_partkey AS level FROM s LEFT JOIN b ON s.version = 2 AND b.n = lower(s.ref) LEFT JOIN part p ON s.version = 1 AND p.p_partkey = try_cast(s.ref AS BIGINT) WHERE coalesce(b.player, p.p_partkey) IS NOT NULL""")  # fmt: skip
def ref_saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved state of two versions, by number and by name."""
    p = ref.parts(spark, sf_dir)
    old = F.col("player") % 2 == 0
    state = p.select(F.when(old, 1).otherwise(2).alias("version"), F.when(old, F.col("player").cast("string")).otherwise(F.upper("name")).alias("ref"), F.col("player").alias("level"))
    return bd.saved_state(p, state)[0]
