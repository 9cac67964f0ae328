"""Queries of the general training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.operators import schema_drift
from slatework.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, sf_dir, "sources")).select("file_id", "section", "field", "change")


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent table of what the files hold."""
    return schema_drift.consistent_table(table(spark, sf_dir, "sources"), table(spark, sf_dir, "sheet_row"))


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table with positions and statistics as text, in the order of their names."""
    t = p5_table(spark, sf_dir)
    pairs = F.transform(F.array_sort(F.map_entries("stats")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] + 1e-9, 6).cast("string")))
    return t.select("file_id", "sheet", "row_no", "name", "team", F.array_join("pos", "/").alias("pos"), F.round("age", 6).alias("age"), F.array_join(pairs, ";").alias("stats"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes of each kind each edition went through, and its schema versions."""
    files = table(spark, sf_dir, "sources")
    n = schema_drift.schema_changes(files).groupBy("edition", "section").pivot("change", ["added", "removed", "renamed", "type"]).count().na.fill(0)
    v = schema_drift.schema_versions(files).groupBy("edition", "section").agg(F.countDistinct("fingerprint").alias("schemas"), F.count("*").alias("files"))
    return v.join(n, ["edition", "section"], "left").na.fill(0, ["added", "removed", "renamed", "type"])


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of every file's schema within its edition."""
    return schema_drift.schema_versions(table(spark, sf_dir, "sources")).select("file_id", "edition", "section", "version", F.col("n_fields").cast("long").alias("n_fields"))


QUERIES = {"p5_found": p5_found, "p5_table": p5_table, "p5_cells": p5_cells, "p5_report": p5_report, "p5_versions": p5_versions}

_P5_STEPS = r"""
WITH files AS (
  SELECT file_id, edition, row_number() OVER (PARTITION BY edition ORDER BY published_at NULLS FIRST, file_id) AS n,
         columns, goalie_columns
  FROM sources),
texts AS (
  SELECT file_id, edition, n, 'columns' AS section, columns AS t FROM files
  UNION ALL SELECT file_id, edition, n, 'goalie_columns', goalie_columns FROM files),
clean AS (SELECT file_id, edition, n, section, regexp_replace(coalesce(t, '{}'), '^[\s' || chr(65279) || ']+', '') AS t FROM texts),
keys AS (SELECT file_id, edition, n, section, t::JSON AS j, unnest(json_keys(t::JSON)) AS k FROM clean),
vals AS (
  SELECT file_id, edition, n, section, k,
         json_type(j, '$."' || k || '"') AS jt, json_extract_string(j, '$."' || k || '"') AS s
  FROM keys),
e AS (
  SELECT file_id, edition, n, section, k,
         CASE WHEN jt = 'VARCHAR' THEN 's' ELSE 'n' END AS kind,
         CASE WHEN jt <> 'VARCHAR' OR regexp_full_match(trim(s), '[0-9]+(\.0+)?') THEN try_cast(trim(s) AS DOUBLE)::BIGINT END AS col,
         CASE WHEN jt = 'VARCHAR' AND NOT regexp_full_match(trim(s), '[0-9]+(\.0+)?') THEN lower(regexp_replace(s, '\s+', '', 'g')) END AS head,
         CASE WHEN jt = 'VARCHAR' THEN lower(regexp_replace(s, '\s+', '', 'g')) END AS txt
  FROM vals),
pair AS (SELECT b.file_id, b.section, b.edition, b.n FROM clean b WHERE b.n > 1),
gone AS (
  SELECT p.file_id, p.section, a.k, a.col, a.head
  FROM pair p JOIN e a ON a.edition = p.edition AND a.section = p.section AND a.n = p.n - 1
  WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.edition = p.edition AND b.section = p.section AND b.n = p.n AND b.k = a.k)),
fresh AS (
  SELECT p.file_id, p.section, b.k, b.col, b.head
  FROM pair p JOIN e b ON b.edition = p.edition AND b.section = p.section AND b.n = p.n
  WHERE NOT EXISTS (SELECT 1 FROM e a WHERE a.edition = p.edition AND a.section = p.section AND a.n = p.n - 1 AND a.k = b.k)),
kept AS (
  SELECT p.file_id, p.section, b.k, a.kind AS ak, b.kind AS bk, a.txt AS ah, b.txt AS bh, a.col AS ac, b.col AS bc
  FROM pair p JOIN e b ON b.edition = p.edition AND b.section = p.section AND b.n = p.n
  JOIN e a ON a.edition = p.edition AND a.section = p.section AND a.n = p.n - 1 AND a.k = b.k)
"""

_P5_CHANGES = """
SELECT f.file_id, f.section, f.k AS field, 'renamed' AS change FROM fresh f
WHERE EXISTS (SELECT 1 FROM gone g WHERE g.file_id = f.file_id AND g.section = f.section AND (g.col = f.col OR g.head = f.head))
UNION ALL
SELECT f.file_id, f.section, f.k, 'added' FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = f.file_id AND g.section = f.section AND (g.col = f.col OR g.head = f.head))
UNION ALL
SELECT g.file_id, g.section, g.k, 'removed' FROM gone g
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE g.file_id = f.file_id AND g.section = f.section AND (g.col = f.col OR g.head = f.head))
UNION ALL SELECT file_id, section, k, 'renamed' FROM kept WHERE ah <> bh AND NOT (ac IS NOT NULL AND bc IS NOT NULL)
UNION ALL SELECT file_id, section, k, 'type' FROM kept WHERE ak <> bk
"""

# All steps that give a key another name, with the former one; and every file's keys with their origin: the end of the chain of steps.
_P5_ORIGINS = """,
steps AS (
  SELECT c.edition, c.section, c.n, f.k AS field, min(g.k) AS was FROM fresh f JOIN gone g ON g.file_id = f.file_id AND g.section = f.section AND (g.col = f.col OR g.head = f.head)
  JOIN clean c ON c.file_id = f.file_id AND c.section = f.section GROUP BY 1, 2, 3, 4),
up AS (SELECT s.edition, s.section, s.n, s.field, s.was, max(p.n) AS pn FROM steps s LEFT JOIN steps p ON p.edition = s.edition AND p.section = s.section AND p.field = s.was AND p.n < s.n GROUP BY 1, 2, 3, 4, 5),
chain AS (
  SELECT edition, section, n, field, was, pn FROM up
  UNION ALL SELECT c.edition, c.section, c.n, c.field, u.was, u.pn FROM chain c JOIN up u ON u.edition = c.edition AND u.section = c.section AND u.field = c.was AND u.n = c.pn),
ends AS (SELECT edition, section, n, field, was AS origin FROM chain WHERE pn IS NULL),
lasts AS (SELECT e.file_id, e.section, e.k, max(s.n) AS sn FROM e JOIN steps s ON s.edition = e.edition AND s.section = e.section AND s.field = e.k AND s.n <= e.n GROUP BY 1, 2, 3),
origins AS (
  SELECT e.file_id, CASE e.section WHEN 'columns' THEN 'main' ELSE 'goalie' END AS sheet, coalesce(x.origin, e.k) AS origin, e.col, e.head
  FROM e LEFT JOIN lasts l ON l.file_id = e.file_id AND l.section = e.section AND l.k = e.k
  LEFT JOIN ends x ON x.edition = e.edition AND x.section = e.section AND x.field = e.k AND x.n = l.sn)"""

_P5_TABLE = r""",
heads AS (SELECT r.file_id, r.sheet, list_transform(min(r.cells), lambda x: lower(regexp_replace(x, '[\s' || chr(160) || ']+', '', 'g'))) AS h FROM sheet_row r JOIN sources s ON s.file_id = r.file_id AND r.row_no = s.header_row GROUP BY 1, 2),
rules AS (SELECT o.file_id, o.sheet, o.origin, coalesce(o.col::INT, nullif(coalesce(list_position(h.h, o.head), 0), 0)) AS place FROM origins o JOIN heads h USING (file_id, sheet)),
one AS (SELECT file_id, sheet, origin, min(place) AS place, max(place) AS high FROM rules GROUP BY 1, 2, 3),
rows_ AS (
  SELECT r.file_id, r.sheet, r.row_no, r.cells FROM sheet_row r JOIN sources s USING (file_id) JOIN heads h USING (file_id, sheet)
  WHERE r.row_no > s.header_row AND list_transform(r.cells, lambda x: lower(regexp_replace(x, '[\s' || chr(160) || ']+', '', 'g'))) <> h.h AND (r.file_id, r.sheet) IN (SELECT file_id, sheet FROM rules)),
v AS (SELECT r.file_id, r.sheet, r.row_no, o.origin, CASE WHEN o.place > 0 THEN r.cells[o.place] END AS t FROM rows_ r JOIN one o USING (file_id, sheet)),
ids AS (
  SELECT file_id, sheet, row_no, max(nullif(trim(t, ' '), '')) FILTER (origin = 'name') AS name, max(nullif(trim(t, ' '), '')) FILTER (origin = 'team') AS team, max(t) FILTER (origin = 'pos') AS pos FROM v GROUP BY 1, 2, 3),
nums AS (
  SELECT file_id, sheet, row_no, origin, t, regexp_replace(ltrim(trim(t, ' '), chr(39)), '[,$%]', '', 'g') AS x FROM v WHERE origin NOT IN ('name', 'team', 'pos')),
vals_ AS (
  SELECT file_id, sheet, row_no, origin, CASE WHEN lower(trim(t, ' ')) IN ('', '-', '--', '—', '–', 'n/a', 'na', 'null', '.', 'none') THEN NULL
         WHEN regexp_full_match(x, '[+-]?[0-9]+:[0-9]{1,2}') THEN CASE WHEN starts_with(x, '-') THEN -1.0 ELSE 1.0 END * (ltrim(split_part(x, ':', 1), '+-')::DOUBLE + split_part(x, ':', 2)::DOUBLE / 60)
         WHEN regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(x AS DOUBLE) END AS v FROM nums),
stats AS (SELECT file_id, sheet, row_no, string_agg(origin || '=' || round(v + 1e-9, 6)::VARCHAR, ';' ORDER BY origin) FILTER (origin <> 'age' AND v IS NOT NULL) AS stats, max(v) FILTER (origin = 'age') AS age FROM vals_ GROUP BY 1, 2, 3),
pe AS (SELECT file_id, sheet, row_no, unnest(string_split_regex(regexp_replace(upper(pos), '[^A-Z,/]', '', 'g'), '[,/]')) AS p, generate_subscripts(string_split_regex(regexp_replace(upper(pos), '[^A-Z,/]', '', 'g'), '[,/]'), 1) AS i FROM ids),
pw AS (SELECT file_id, sheet, row_no, i, unnest(CASE p WHEN 'F' THEN ['C', 'LW', 'RW'] WHEN 'W' THEN ['LW', 'RW'] WHEN 'L' THEN ['LW'] WHEN 'R' THEN ['RW'] ELSE [p] END) AS c FROM pe),
pk AS (SELECT file_id, sheet, row_no, c, min(i * 10 + CASE c WHEN 'C' THEN 0 WHEN 'LW' THEN 1 ELSE 2 END) AS i FROM pw WHERE c IN ('C', 'LW', 'RW', 'D', 'G') GROUP BY 1, 2, 3, 4),
codes AS (SELECT file_id, sheet, row_no, string_agg(c, '/' ORDER BY i) AS pos FROM pk GROUP BY 1, 2, 3)
SELECT i.file_id, i.sheet, i.row_no, i.name, i.team, coalesce(c.pos, '') AS pos, round(s.age, 6) AS age, coalesce(s.stats, '') AS stats
FROM ids i LEFT JOIN codes c USING (file_id, sheet, row_no) LEFT JOIN stats s USING (file_id, sheet, row_no)
WHERE i.name IS NOT NULL AND NOT (i.team IS NULL AND coalesce(c.pos, '') = '' AND (regexp_matches(lower(i.name), '\b(averages?|avg|totals?|subtotals?|median|durchschnitt|gesamt|moyenne|genomsnitt|totalt)\b') OR regexp_matches(lower(i.name), '^\W*(mean|sum|summary|summe|summa|somme|medel)\W*$')))"""

SQL = {
    "p5_found": _P5_STEPS + _P5_CHANGES,
    "p5_cells": _P5_STEPS.replace("WITH files", "WITH RECURSIVE files") + _P5_ORIGINS + _P5_TABLE,
    "p5_versions": _P5_STEPS
    + """,
shape AS (SELECT c.file_id, c.edition, c.section, c.n, list_sort(list(e.k || '|' || e.kind || '|' || coalesce(e.col::VARCHAR, '') || '|' || coalesce(e.txt, '')) FILTER (e.k IS NOT NULL)) AS m, count(e.k) AS n_fields
  FROM clean c LEFT JOIN e ON e.file_id = c.file_id AND e.section = c.section GROUP BY 1, 2, 3, 4),
moved AS (SELECT *, CASE WHEN n = 1 OR m IS DISTINCT FROM lag(m) OVER (PARTITION BY edition, section ORDER BY n) THEN 1 ELSE 0 END AS x FROM shape)
SELECT file_id, edition, section, sum(x) OVER (PARTITION BY edition, section ORDER BY n)::BIGINT AS version, n_fields FROM moved""",
    "p5_report": _P5_STEPS
    + """,
shape AS (SELECT c.file_id, c.edition, c.section, list_sort(list(e.k || '|' || e.kind || '|' || coalesce(e.col::VARCHAR, '') || '|' || coalesce(e.txt, '')) FILTER (e.k IS NOT NULL)) AS m
  FROM clean c LEFT JOIN e ON e.file_id = c.file_id AND e.section = c.section GROUP BY 1, 2, 3),
per AS (SELECT edition, section, count(DISTINCT coalesce(m, [])) AS schemas, count(*) AS files FROM shape GROUP BY 1, 2),
found AS ("""
    + _P5_CHANGES
    + """),
n AS (SELECT c.edition, c.section, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'renamed') AS renamed, count(*) FILTER (change = 'type') AS type
  FROM found f JOIN clean c USING (file_id, section) GROUP BY 1, 2)
SELECT edition, section, schemas, files, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(renamed, 0) AS renamed, coalesce(type, 0) AS type FROM per LEFT JOIN n USING (edition, section)""",
}
