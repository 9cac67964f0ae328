"""Queries of the operators of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.llm import leakage, linkage, lookalike, mixture, mojibake, residue, survivors
from slatework.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("listing_id_a", "listing_id_b")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with their confidence."""
    return linkage.match_listings(table(spark, sf_dir, "source_row"), table(spark, sf_dir, "team_code"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.latest_survivors(table(spark, sf_dir, "source_row"), table(spark, sf_dir, "team_code"))


def p2_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survivors.voted_survivors(table(spark, sf_dir, "source_row"), table(spark, sf_dir, "team_code"))
    return out.select("listing_id", "n_rows", *[x for f in survivors.FIELDS for x in ((F.array_join(f, "/").alias(f) if f == "pos" else f), F.round(f"{f}_share", 6).alias(f"{f}_share"), f"{f}_row_id")])


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.source_reliability(table(spark, sf_dir, "source_row"), table(spark, sf_dir, "team_code"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mojibake.label_names(table(spark, sf_dir, "source_row"), "row_id")
    return labelled.where(F.col("damage.pair").isNotNull()).select("row_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged names with their original spelling where nothing was lost."""
    labelled = mojibake.label_names(table(spark, sf_dir, "source_row"), "row_id").where(F.col("damage.pair").isNotNull())
    return labelled.select("row_id", "name", F.col("damage.pair").alias("pair"), F.when(F.col("damage.complete"), F.col("damage.restored")).alias("original"))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, id, value, damaged`` of both columns with names; both are judged by the model of the rows' names."""
    rows = table(spark, sf_dir, "source_row").select(F.lit("source_row").alias("tbl"), F.col("row_id").alias("id"), F.col("name").alias("value"))
    seen = table(spark, sf_dir, "aliases").select(F.lit("aliases").alias("tbl"), F.col("alias_id").alias("id"), F.col("c0").alias("value"))
    both = rows.unionByName(seen).withColumn("key", F.struct("tbl", "id"))
    labelled = mojibake.label_names(both, "key", "value", mojibake.fit(rows, "value"))
    return labelled.select("key.tbl", "key.id", "value", F.col("damage.pair").isNotNull().alias("damaged"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = _spellings(spark, sf_dir).where("not damaged")
    return lookalike.odd_spellings(sound, ["tbl", "id"], "value").select("tbl", "id")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name and alias beside its one consistent form."""
    rows = table(spark, sf_dir, "source_row").select(F.col("name").alias("value"))
    return lookalike.canonical_forms(rows.union(table(spark, sf_dir, "aliases").select("c0")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every target whether its share was met, to within a fiftieth, and no document used too often."""
    goals = table(spark, sf_dir, "mix_target")
    report = mixture.mix_report(table(spark, sf_dir, "documents"), goals).where("dimension = 'source'").select(F.col("value").alias("source"), "share", "most_copies")
    j = goals.join(report, "source", "left")
    return j.select("source", "target_share", (F.abs(F.col("share") - F.col("target_share")) <= 0.02).alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(residue.find_residue(docs), "doc_id", "left_anti")


QUERIES = {
    "p1_found": p1_found, "p1_matches": p1_matches,
    "p2_found": p2_found, "p2_golden": p2_golden, "p2_reliability": p2_reliability,
    "p3_found": p3_found, "p3_restored": p3_restored,
    "p4_found": p4_found, "p4_forms": p4_forms,
    "p6_found": p6_found, "p6_report": p6_report,
    "p7_mix": p7_mix, "p7_report": p7_report, "p7_targets": p7_targets,
    "p8_found": p8_found, "p8_clean": p8_clean,
}



_P6_WORDS = r"""
WITH t AS (
  SELECT doc_id AS id, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM eval_item),
clean AS (
  SELECT id, kind, strip_accents(lower(text)) AS t FROM t),
w AS (SELECT id, kind, regexp_extract_all(translate(replace(t, 'ß', 'ss'), 'øł', 'ol'), '[\p{L}\p{N}]+') AS w FROM clean)"""


def _p4_sql() -> str:
    """Look-alikes by one translation and a few replacements; equal under composition instead of collation."""
    quoted = lambda s: s.replace("'", "''")
    one = {k: v for k, v in lookalike.SHAPES.items() if len(v) == 1}
    gone = [k for k, v in lookalike.SHAPES.items() if not v]
    mapped = f"translate(value, '{quoted(''.join(one) + ''.join(gone))}', '{quoted(''.join(one.values()))}')"
    for k, v in lookalike.SHAPES.items():
        if len(v) > 1 and k not in lookalike.WORD_SIGNS:
            mapped = f"replace({mapped}, '{k}', '{quoted(v)}')"
    ordinary = r"regexp_full_match(value, '[\x20-\x7E\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}]*')"
    return f"""
WITH v AS (SELECT DISTINCT name AS value FROM source_row UNION SELECT c0 FROM aliases),
m AS (SELECT value, {ordinary} AS plain, CASE WHEN {ordinary} THEN value ELSE {mapped} END AS mapped FROM v WHERE value IS NOT NULL),
c AS (SELECT nfc_normalize(mapped) AS class, min(value) FILTER (plain) AS stored FROM m GROUP BY 1)
SELECT value, CASE WHEN plain THEN value ELSE coalesce(stored, class) END AS form FROM m JOIN c ON c.class = nfc_normalize(mapped) UNION ALL SELECT NULL, NULL FROM v WHERE value IS NULL"""


def _p2_sql(rounds: int = 12) -> str:
    """Truth discovery with its rounds written out; it reaches its fixed point well before the last, after which nothing changes."""
    sql = """
WITH spell AS (SELECT lower(trim(spelling, ' ')) AS s, min(code) AS code FROM team_code GROUP BY 1),
r AS (
  SELECT listing_id, row_id, source_id || '/' || coalesce(feed, '') AS source, source_id, coalesce(feed, '') AS feed, {'s': coalesce(seen_at, '0001-01-01'::TIMESTAMP), 'f': feed IS NOT DISTINCT FROM 'primary', 'i': -row_id} AS prec,
         code AS team, nullif(array_to_string(list_filter(coalesce(pos, []), lambda p: p IN ('C', 'LW', 'RW', 'D', 'G')), '/'), '') AS pos, CASE WHEN age BETWEEN 17 AND 50 AND NOT isnan(age) THEN round(age, 1)::VARCHAR END AS age
  FROM source_row LEFT JOIN spell ON spell.s = lower(trim(team, ' '))),
c AS (
  SELECT listing_id, source, 'team' AS field, team AS value, count(*) AS n, max(prec) AS prec FROM r WHERE team IS NOT NULL GROUP BY ALL
  UNION ALL SELECT listing_id, source, 'pos', pos, count(*), max(prec) FROM r WHERE pos IS NOT NULL GROUP BY ALL
  UNION ALL SELECT listing_id, source, 'age', age, count(*), max(prec) FROM r WHERE age IS NOT NULL GROUP BY ALL),
t0 AS (SELECT DISTINCT source, field, 0.8::DOUBLE AS rel FROM c)"""
    for k in range(rounds + 1):
        sql += f""",
v{k} AS MATERIALIZED (SELECT listing_id, field, value, sum(n * rel) AS support, max(prec) AS prec FROM c JOIN t{k} USING (source, field) GROUP BY ALL),
e{k} AS MATERIALIZED (SELECT listing_id, field, arg_max(value, {{'s': round(support, 9), 'p': prec, 'v': value}}) AS value, max({{'s': round(support, 9), 'p': prec, 'v': value}}) AS top, sum(support) AS whole FROM v{k} GROUP BY ALL),
t{k + 1} AS MATERIALIZED (SELECT c.source, c.field, greatest(0.05, (sum(n) FILTER (c.value = e.value) + 1.6) / (sum(n) + 2.0)) AS rel FROM c JOIN e{k} e USING (listing_id, field) GROUP BY ALL)"""
    return sql


SQL = {
    "p4_forms": _p4_sql(),
    "p7_targets": "SELECT source, target_share, true AS met, true AS capped FROM mix_target",
    "p2_golden": _p2_sql() + """
SELECT listing_id, n_rows, max(e.value) FILTER (e.field = 'team') AS team, round(max(top.s / whole) FILTER (e.field = 'team'), 6) AS team_share, max(-top.p.i) FILTER (e.field = 'team') AS team_row_id,
       max(e.value) FILTER (e.field = 'pos') AS pos, round(max(top.s / whole) FILTER (e.field = 'pos'), 6) AS pos_share, max(-top.p.i) FILTER (e.field = 'pos') AS pos_row_id,
       max(e.value) FILTER (e.field = 'age')::DOUBLE AS age, round(max(top.s / whole) FILTER (e.field = 'age'), 6) AS age_share, max(-top.p.i) FILTER (e.field = 'age') AS age_row_id
FROM (SELECT listing_id, count(*) AS n_rows FROM source_row GROUP BY 1 HAVING count(*) >= 2) LEFT JOIN e12 e USING (listing_id) GROUP BY ALL""",
    "p2_reliability": _p2_sql() + """
SELECT split_part(source, '/', 1) AS source_id, split_part(source, '/', 2) AS feed, field, round(rel, 6) AS reliability FROM t13""",
    "p2_found": """
WITH r AS (
  SELECT listing_id, row_id, seen_at, CASE WHEN feed = 'primary' THEN 0 ELSE 1 END AS f,
         lower(trim(team)) IN (SELECT lower(trim(spelling)) FROM team_code) AS team_ok,
         list_has_any(coalesce(pos, []), ['C', 'LW', 'RW', 'D', 'G']) AS pos_ok,
         age BETWEEN 17 AND 50 AS age_ok
  FROM source_row),
o AS (
  SELECT *,
         CASE WHEN team_ok THEN row_number() OVER (PARTITION BY listing_id, team_ok ORDER BY seen_at DESC NULLS LAST, f, row_id) END AS tn,
         CASE WHEN pos_ok THEN row_number() OVER (PARTITION BY listing_id, pos_ok ORDER BY seen_at DESC NULLS LAST, f, row_id) END AS pn,
         CASE WHEN age_ok THEN row_number() OVER (PARTITION BY listing_id, age_ok ORDER BY seen_at DESC NULLS LAST, f, row_id) END AS an
  FROM r)
SELECT listing_id,
       coalesce(max(CASE WHEN tn = 1 THEN row_id END), -1) AS team_row_id,
       coalesce(max(CASE WHEN pn = 1 THEN row_id END), -1) AS pos_row_id,
       coalesce(max(CASE WHEN an = 1 THEN row_id END), -1) AS age_row_id
FROM o GROUP BY listing_id HAVING count(*) >= 2
""",
    "p6_found": _P6_WORDS + """,
g AS (
  SELECT id, kind, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT id, kind, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g AND d.kind = 0 AND i.kind = 1""",
    # Exact runs of five words and more; a run of ten is exact, a shorter one needs a window of ten item words from either of its ends with one edit,
    # which can only be where the run ends: a word replaced, left out or put in.
    "p6_report": _P6_WORDS + """,
g AS (SELECT id, kind, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT id, kind, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= CASE kind WHEN 1 THEN 10 ELSE 5 END)),
m AS (SELECT d.id AS d, i.id AS t, d.i AS p, i.i AS j FROM g d JOIN g i ON d.g = i.g AND d.kind = 0 AND i.kind = 1),
island AS (SELECT d, t, p, j, p - row_number() OVER (PARTITION BY d, t, p - j ORDER BY p) AS k FROM m),
run AS (SELECT d, t, min(p) AS p, min(j) AS j, count(*) + 4 AS run FROM island GROUP BY d, t, p - j, k),
x AS (SELECT r.*, a.w AS dw, b.w AS iw, p + run AS q, j + run AS h FROM run r JOIN w a ON a.id = r.d AND a.kind = 0 JOIN w b ON b.id = r.t AND b.kind = 1),
ok AS (
  SELECT d, t, run FROM x WHERE run >= 10
     OR (j + 9 <= len(iw) AND (iw[h + 1 : j + 9] = dw[q : q + 8 - run] OR (q <= len(dw) AND (iw[h + 1 : j + 9] = dw[q + 1 : q + 9 - run] OR iw[h : j + 9] = dw[q + 1 : q + 10 - run]))))
     OR (h - 10 >= 1 AND (iw[h - 10 : j - 2] = dw[greatest(p - 9 + run, 1) : p - 1] OR (p >= 2 AND (iw[h - 10 : j - 2] = dw[greatest(p - 10 + run, 1) : p - 2] OR iw[h - 10 : j - 1] = dw[greatest(p - 11 + run, 1) : p - 2]))))),
per AS (SELECT d, t, max(run) AS run FROM ok GROUP BY 1, 2)
SELECT t AS item_id, count(*) FILTER (run >= 10) AS exact_docs, count(*) FILTER (run < 10) AS edited_docs, max(run)::INT AS longest_run FROM per GROUP BY 1""",
}
