"""Queries of the reference's own operators over the test tables, with their SQL.

Stand-ins: a player is a part, a source the nation of its suppliers, games the line items, goals the
quantity and assists the price in cents (both whole, so that sums are exact in any order), DR the mean discount
in per cent. Weights are ``n_nationkey % 3``, so some sources weigh nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.scalars import level_label, name_key, ordinal, parse_number, parse_positions, surname
from slatework.operators import blend, identity, metrics, score, value
from slatework.operators import board as bd
from slatework.operators.ordering import global_row_number
from slatework.plans import valuation as val
from slatework.session import store, table
from slatework.streaming import events as ev

SLOTS = {"C": 2, "LW": 2, "RW": 2, "D": 4, "G": 2, "BN": 4}
TEAMS = 12
NUDGE = val.NUDGE
SCORING = {"G": 4.0, "A": 0.001}
TYPES = {"ECONOMY": ["C"], "SMALL": ["LW"], "MEDIUM": ["RW"], "STANDARD": ["D"], "PROMO": ["G"], "LARGE": ["C", "LW"]}


# ---------------------------------------------------------------------------------------------------
# stand-ins


def stat_lines(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """``player, source, stat, value`` in long form."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    li = li.where(F.col("l_shipdate") < F.lit(before)) if before else li
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source"))
    base = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("player"), "source").agg(
        F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).alias("g"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("a"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
    )
    d = lambda c: F.col(c).cast("double")
    each = F.array(*[F.struct(F.lit(s).alias("stat"), v.alias("value")) for s, v in (("GP", d("n")), ("G", d("g")), ("A", d("a")), ("DR", d("d") / d("n")))])
    return base.select("player", "source", F.inline(each))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") % 3).cast("double").alias("weight"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``player, name, brand, size, price, pos``."""
    kind = F.split("p_type", " ")[0]
    pos = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[kind]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.coalesce(pos, F.array().cast("array<string>")).alias("pos"))


def players(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Parts with blended and scored points, rounded so that ranks don't hang on the last bit."""
    blended = blend.blend_totals(stat_lines(spark, sf_dir, before), weights(spark, sf_dir))
    pts = score.score(blended, SCORING).select("player", F.round("points", 4).alias("points"))
    return parts(spark, sf_dir).join(pts, "player", "left").withColumn("points", F.coalesce("points", F.lit(0.0)))


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a purchase event names."""
    most = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 1
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select((F.col("event_id") % most + 1).alias("player")).distinct()


def board(spark: SparkSession, sf_dir: str, live: bool = False) -> DataFrame:
    p = store(players(spark, sf_dir))
    slots = value.positional_slots(SLOTS, TEAMS)
    pool = value.live_pool(p, taken(spark, sf_dir)) if live else p
    return value.overall_rank(value.best_value(p, value.position_replacement(pool, slots)).withColumn("vorp", F.round("vorp", 4)))


# ---------------------------------------------------------------------------------------------------
# queries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINES = """base AS (
  SELECT l_partkey AS player, s_nationkey AS source, count(*)::DOUBLE AS n, sum(round(l_quantity)::BIGINT)::DOUBLE AS g,
         sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS a, sum(round(l_discount * 100)::BIGINT)::DOUBLE AS d
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {where} GROUP BY 1, 2),
lines AS (
  SELECT player, source, 'GP' AS stat, n AS value FROM base UNION ALL SELECT player, source, 'G', g FROM base
  UNION ALL SELECT player, source, 'A', a FROM base UNION ALL SELECT player, source, 'DR', d / n FROM base),
w AS (SELECT n_nationkey AS source, (n_nationkey % 3)::DOUBLE AS weight FROM nation),
totals AS (
  SELECT l.player, l.stat, sum(w.weight * l.value) FILTER (w.weight <> 0) / nullif(sum(w.weight) FILTER (w.weight <> 0), 0) AS value
  FROM lines l LEFT JOIN w USING (source) GROUP BY 1, 2),
parts AS (
  SELECT p_partkey AS player, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price,
         CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN ['C'] WHEN 'SMALL' THEN ['LW'] WHEN 'MEDIUM' THEN ['RW']
              WHEN 'STANDARD' THEN ['D'] WHEN 'PROMO' THEN ['G'] WHEN 'LARGE' THEN ['C', 'LW'] ELSE [] END AS pos
  FROM part),
players AS (
  SELECT p.*, coalesce(t.points, 0.0) AS points FROM parts p LEFT JOIN (
    SELECT player, round(coalesce(sum(CASE stat WHEN 'G' THEN value * 4.0::DOUBLE WHEN 'A' THEN value * 0.001::DOUBLE END), 0), 4) AS points
    FROM totals GROUP BY 1) t USING (player))"""
_BASE = "WITH " + _LINES.format(where="")
_TAKEN = "taken AS (SELECT DISTINCT event_id % (SELECT max(p_partkey) FROM part) + 1 AS player FROM events WHERE event_type = 'purchase')"


def _board_sql(pool: str) -> str:
    return f"""
demand AS (SELECT * FROM (VALUES ('C', 36, 0), ('LW', 36, 1), ('RW', 36, 2), ('D', 57, 3), ('G', 33, 4)) t(position, k, o)),
elig AS (SELECT player, points, unnest(pos) AS position FROM {pool}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC) AS rn FROM elig),
levels AS (SELECT d.position, d.o, coalesce(min(points), 0.0) AS level, count(points) AS depth FROM demand d LEFT JOIN numbered n ON n.position = d.position AND rn <= k GROUP BY 1, 2),
options AS (SELECT p.player, l.position, p.points - l.level AS v, l.o FROM (SELECT player, points, unnest(pos) AS position FROM players) p JOIN levels l USING (position)),
picked AS (SELECT player, position AS best_pos, v, row_number() OVER (PARTITION BY player ORDER BY v DESC, o) AS rn FROM options),
valued AS (SELECT p.*, round(coalesce(x.v, p.points), 4) AS vorp, x.best_pos FROM players p LEFT JOIN picked x ON x.player = p.player AND x.rn = 1),
board AS (SELECT *, row_number() OVER (ORDER BY vorp DESC, player) AS rank FROM valued)"""


_BOARD = _BASE + "," + _board_sql("players")


@_query(_BASE + " SELECT player, round(sum(weight * value) FILTER (weight <> 0) / nullif(sum(weight) FILTER (weight <> 0), 0), 6) AS mean FROM lines LEFT JOIN w USING (source) WHERE stat = 'G' GROUP BY 1")
def ref_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stat_lines(spark, sf_dir).where("stat = 'G'").join(weights(spark, sf_dir), "source", "left")
    return blend.weighted_mean(lines, ["player"], "value", "weight", "mean").withColumn("mean", F.round("mean", 6))


@_query(_BASE + " SELECT player, stat, round(value, 6) AS value FROM totals")
def ref_blend_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend.blend_totals(stat_lines(spark, sf_dir), weights(spark, sf_dir)).withColumn("value", F.round("value", 6))


_RATES = """, games AS (SELECT player, source, value AS own FROM lines WHERE stat = 'GP'),
vol AS (SELECT player, {chosen} FROM lines l LEFT JOIN w USING (source) WHERE stat = 'GP' GROUP BY 1),
r AS (
  SELECT player, stat, sum(weight * value / own) FILTER (weight <> 0) / nullif(sum(weight) FILTER (weight <> 0), 0) AS rate
  FROM lines JOIN games USING (player, source) LEFT JOIN w USING (source) GROUP BY 1, 2)
SELECT t.player, t.stat, round(CASE WHEN t.stat IN ('G', 'A') AND coalesce(v.games, 0) <> 0 THEN r.rate * v.games
       WHEN t.stat = 'GP' AND coalesce(v.games, 0) <> 0 THEN v.games ELSE t.value END + 1e-7, 4) AS value
FROM totals t JOIN vol v USING (player) JOIN r USING (player, stat)"""
_BLENDED = "sum(weight * value) FILTER (weight <> 0) / nullif(sum(weight) FILTER (weight <> 0), 0)"


@_query(_BASE + _RATES.format(chosen=f"{_BLENDED} AS games"))
def ref_blend_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend.blend_rates(stat_lines(spark, sf_dir), weights(spark, sf_dir), ["G", "A"]).withColumn("value", F.round(F.col("value") + NUDGE, 4))


@_query(_BASE + _RATES.format(chosen=f"coalesce(max(value) FILTER (source = 3), {_BLENDED}) AS games"))
def ref_blend_rates_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend.blend_rates(stat_lines(spark, sf_dir), weights(spark, sf_dir), ["G", "A"], volume_source=3).withColumn("value", F.round(F.col("value") + NUDGE, 4))


@_query(_BASE + " SELECT player, points FROM players WHERE player IN (SELECT player FROM lines)")
def ref_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = blend.blend_totals(stat_lines(spark, sf_dir), weights(spark, sf_dir))
    return score.score(blended, SCORING).withColumn("points", F.round("points", 4))


@_query(_BASE + """, wide AS (SELECT player, max(value) FILTER (stat = 'G') AS g, max(value) FILTER (stat = 'A') AS a, max(value) FILTER (stat = 'GP') AS gp FROM totals GROUP BY 1)
SELECT player, round(coalesce(g * 4.0::DOUBLE, 0.0) + CASE WHEN list_contains(pos, 'D') THEN coalesce(g + coalesce(a, 0.0), 0.0) * 0.5 ELSE 0.0 END
       + CASE WHEN list_contains(pos, 'G') THEN coalesce(gp, 0.0) * 2.0 ELSE 0.0 END, 4) AS points FROM wide JOIN parts USING (player)""")  # fmt: skip
def ref_score_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = blend.blend_totals(stat_lines(spark, sf_dir), weights(spark, sf_dir))
    return score.score(blended, {"G": 4.0}, parts(spark, sf_dir), 0.5, 2.0).withColumn("points", F.round("points", 4))


@_query(_BASE + """, lv AS (SELECT player, (player % 9) - 4 AS level FROM parts),
s AS (SELECT player, CASE WHEN level = 0 THEN 0.0::DOUBLE ELSE sign(level) * [0.05, 0.10, 0.20][least(abs(level), 3)]::DOUBLE END AS share FROM lv),
m AS (SELECT player, stat, value, CASE WHEN stat = 'G' THEN value * (1 + share) WHEN stat = 'A' THEN value * (1 - share) ELSE value END AS moved FROM totals JOIN s USING (player))
SELECT player, round(max(moved) FILTER (stat = 'G'), 6) AS g, round(max(moved) FILTER (stat = 'A') + 1e-7, 4) AS a, round(max(moved * 4.0) FILTER (stat = 'G') - max(value * 4.0) FILTER (stat = 'G') + 1e-7, 4) AS delta FROM m GROUP BY 1""")  # fmt: skip
def ref_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    blended = blend.blend_totals(stat_lines(spark, sf_dir), weights(spark, sf_dir))
    levels = parts(spark, sf_dir).select("player", (F.col("player") % 9 - 4).cast("int").alias("level"))
    moved = score.adjust(blended, levels, [0.05, 0.10, 0.20], ["G", "A"], {"G": 4.0, "A": -1.0})
    both = moved.join(blended.withColumnRenamed("value", "was"), ["player", "stat"]).groupBy("player")
    of = lambda s, c: F.max(F.when(F.col("stat") == s, c))
    return both.agg(F.round(of("G", F.col("value")), 6).alias("g"), F.round(of("A", F.col("value")) + NUDGE, 4).alias("a"), F.round(of("G", F.col("value") * 4.0) - of("G", F.col("was") * 4.0) + NUDGE, 4).alias("delta"))


@_query(_BOARD + " SELECT position, level, depth FROM levels")
def ref_replacement_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value.position_replacement(players(spark, sf_dir), value.positional_slots(SLOTS, TEAMS))


@_query(_BASE + """, top AS (SELECT pos FROM players WHERE list_has_any(pos, ['C', 'LW', 'RW']) ORDER BY points DESC, player LIMIT 104),
k AS (SELECT 'C' AS position, count(*) FILTER (list_contains(pos, 'C')) + 1 AS k FROM top UNION ALL SELECT 'LW', count(*) FILTER (list_contains(pos, 'LW')) + 1 FROM top
      UNION ALL SELECT 'RW', count(*) FILTER (list_contains(pos, 'RW')) + 1 FROM top UNION ALL SELECT 'D', 57 UNION ALL SELECT 'G', 33),
numbered AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC) AS rn FROM (SELECT points, unnest(pos) AS position FROM players))
SELECT k.position, coalesce(min(points), 0.0) AS level, count(points) AS depth FROM k LEFT JOIN numbered n ON n.position = k.position AND rn <= k GROUP BY 1""")  # fmt: skip
def ref_replacement_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value.draft_replacement(players(spark, sf_dir), value.positional_slots(SLOTS, TEAMS))


@_query(_BOARD + " SELECT rank, player, name, points, vorp, best_pos FROM board")
def value_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: blend, score, replacement level, value and rank."""
    return board(spark, sf_dir).select("rank", "player", "name", "points", "vorp", "best_pos")


@_query(_BASE + f", {_TAKEN}, pool AS (SELECT * FROM players WHERE player NOT IN (SELECT player FROM taken))," + _board_sql("pool") + " SELECT rank, player, vorp, best_pos FROM board")
def ref_live_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir, live=True).select("rank", "player", "vorp", "best_pos")


@_query(_BASE + """, e AS (SELECT player, points, unnest(pos) AS position FROM players),
n AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS rn FROM e)
SELECT player, string_agg(CASE position WHEN 'LW' THEN 'L' WHEN 'RW' THEN 'R' ELSE position END || rn, ' ' ORDER BY list_position(['C', 'LW', 'RW', 'D', 'G'], position)) AS label FROM n GROUP BY 1""")  # fmt: skip
def ref_position_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value.position_labels(value.position_ranks(players(spark, sf_dir)))


@_query(_BOARD + """, g AS (SELECT *, lag(vorp) OVER (PARTITION BY best_pos ORDER BY vorp DESC, player) - vorp AS gap, row_number() OVER (PARTITION BY best_pos ORDER BY vorp DESC, player) AS n FROM board),
smp AS (SELECT best_pos, gap FROM g WHERE gap IS NOT NULL AND n - 1 <= 60),
med AS (SELECT best_pos, list_sort(list(gap))[(count(*) // 2) + 1] AS m FROM smp GROUP BY 1),
mad AS (SELECT best_pos, any_value(m) AS m, 1.4826 * list_sort(list(abs(gap - m)))[(count(*) // 2) + 1] AS s FROM smp JOIN med USING (best_pos) GROUP BY 1),
thr AS (SELECT best_pos, m + CASE WHEN s <> 0 THEN s WHEN m <> 0 THEN m ELSE 1.0 END AS t FROM mad)
SELECT player, best_pos, round(gap, 4) AS gap, 1 + coalesce(sum(CASE WHEN gap > t THEN 1 ELSE 0 END) OVER (PARTITION BY best_pos ORDER BY vorp DESC, player), 0)::BIGINT AS tier FROM g LEFT JOIN thr USING (best_pos)""")  # fmt: skip
def ref_gap_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = value.gap_tiers(board(spark, sf_dir), 1.0, dict.fromkeys(value.POSITIONS, 60))
    return tiers.select("player", "best_pos", F.round("gap", 4).alias("gap"), "tier")


@_query(_BOARD + f", {_TAKEN}" + """, f AS (SELECT b.*, t.player IS NULL AS free FROM board b LEFT JOIN taken t USING (player)),
el AS (SELECT unnest(pos) AS position, points, name, rank FROM f WHERE free),
nx AS (SELECT a.player, max(b.points) AS p FROM f a JOIN (SELECT DISTINCT position, points FROM el) b ON a.best_pos = b.position AND b.points < a.points GROUP BY 1)
SELECT f.player, round(coalesce(f.points - nx.p, 0.0), 4) AS drop_off,
       coalesce((SELECT arg_min(x.name, x.rank) FROM el x WHERE x.position = f.best_pos AND x.points = nx.p), '') AS next_up FROM f LEFT JOIN nx USING (player)""")  # fmt: skip
def ref_drop_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value.drop_off(board(spark, sf_dir), taken(spark, sf_dir)).withColumn("drop_off", F.round("drop_off", 4))


@_query(_BOARD + " SELECT player, rank, row_number() OVER (ORDER BY CASE WHEN size % 5 = 0 THEN NULL ELSE size END ASC NULLS LAST, rank) AS metric_rank FROM board")
def ref_metric_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir).withColumn("m", F.when(F.col("size") % 5 != 0, F.col("size")))
    return metrics.metric_rank(b, "m", ascending=True).select("player", "rank", "metric_rank")


@_query(_BOARD + """ SELECT player, rank, printf('%d-%02d', ((rank + 11) // 12)::BIGINT, (rank - ((rank + 11) // 12 - 1) * 12)::BIGINT) AS pick,
  CASE WHEN size <= 24 THEN 'pre' WHEN size >= 31 THEN 'post' ELSE 'prime' END AS band,
  CASE WHEN floor(player * 0.75 + 0.5) - rank >= 2 THEN 1 WHEN floor(player * 0.75 + 0.5) - rank <= -2 THEN -1 ELSE 0 END AS mark FROM board""")  # fmt: skip
def ref_pick_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir)
    return b.select("player", "rank", metrics.round_pick(F.col("rank"), TEAMS).alias("pick"), metrics.age_band(F.col("size")).alias("band"), metrics.shift_mark(F.col("player") * 0.75, F.col("rank")).alias("mark"))


@_query(_BASE + """, c AS (SELECT quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM parts)
SELECT player, CASE WHEN price >= hi THEN 1 WHEN price <= lo THEN -1 ELSE 0 END AS band FROM parts, c""")  # fmt: skip
def ref_percentile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentile_bands(parts(spark, sf_dir), "price", "band").select("player", "band")


_FULL = _BASE + """, gone AS ({gone}),
who AS (SELECT player, name, size, CASE WHEN size % 10 = 0 THEN ['LW', 'RW'] WHEN size % 10 = 1 THEN ['D', 'C'] ELSE pos END AS pos, (player % 9 - 4)::INT AS adjustment FROM parts),
games AS (SELECT player, value AS gp FROM totals WHERE stat = 'GP'),
moved AS (SELECT t.player, t.stat, t.value, CASE WHEN w.adjustment <> 0 AND t.stat = CASE WHEN list_contains(w.pos, 'G') THEN 'A' ELSE 'G' END
            THEN t.value * (1 + sign(w.adjustment) * [0.05, 0.10, 0.20][least(abs(w.adjustment), 3)]::DOUBLE) ELSE t.value END AS v FROM totals t JOIN who w USING (player)),
pts AS (SELECT player, sum(CASE stat WHEN 'G' THEN value * 4.0::DOUBLE WHEN 'A' THEN value * 0.001::DOUBLE END) AS b, sum(CASE stat WHEN 'G' THEN v * 4.0::DOUBLE WHEN 'A' THEN v * 0.001::DOUBLE END) AS p FROM moved GROUP BY 1),
players2 AS (SELECT w.*, g.gp, round(coalesce(p.p, 0.0) + 1e-7, 4) AS points, round(coalesce(p.p, 0.0) - coalesce(p.b, 0.0) + 1e-7, 4) AS delta FROM who w JOIN games g USING (player) LEFT JOIN pts p USING (player) WHERE g.gp >= 1.2),
used AS (SELECT count(*) FILTER (k = 'F') AS f, count(*) FILTER (k = 'D') AS d, count(*) FILTER (k = 'G') AS g FROM (SELECT CASE WHEN list_contains(pos, 'G') THEN 'G' WHEN list_contains(pos, 'D') THEN 'D' ELSE 'F' END AS k FROM players2 WHERE player IN (SELECT player FROM gone))),
pool AS (SELECT * FROM players2 WHERE player NOT IN (SELECT player FROM gone)),
front AS (SELECT pos, row_number() OVER (ORDER BY points DESC, player) AS n FROM pool WHERE list_has_any(pos, ['C', 'LW', 'RW'])),
top AS (SELECT pos FROM front, used WHERE n <= greatest(104 - f, 0)),
demand AS (SELECT 'C' AS position, 0 AS o, count(*) FILTER (list_contains(pos, 'C')) + 1 AS k FROM top UNION ALL SELECT 'LW', 1, count(*) FILTER (list_contains(pos, 'LW')) + 1 FROM top
      UNION ALL SELECT 'RW', 2, count(*) FILTER (list_contains(pos, 'RW')) + 1 FROM top UNION ALL SELECT 'D', 3, greatest(56 - d, 0) + 1 FROM used UNION ALL SELECT 'G', 4, greatest(32 - g, 0) + 1 FROM used),
numbered AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC) AS rn FROM (SELECT points, unnest(pos) AS position FROM pool)),
levels AS (SELECT d.position, d.o, coalesce(min(points), 0.0) AS level, count(points) AS depth FROM demand d LEFT JOIN numbered n ON n.position = d.position AND rn <= k GROUP BY 1, 2),
e AS (SELECT player, points, name, unnest(pos) AS position FROM players2),
picked AS (SELECT player, position AS best_pos, points - level AS v, row_number() OVER (PARTITION BY player ORDER BY points - level DESC, o) AS rn FROM e JOIN levels USING (position)),
valued AS (SELECT p.*, round(coalesce(x.v, p.points), 4) AS vorp, x.best_pos FROM players2 p LEFT JOIN picked x ON x.player = p.player AND x.rn = 1),
board AS (SELECT *, row_number() OVER (ORDER BY vorp DESC, player) AS rank FROM valued),
pn AS (SELECT player, position, row_number() OVER (PARTITION BY position ORDER BY points DESC, player) AS rn FROM e),
lab AS (SELECT player, string_agg(CASE position WHEN 'LW' THEN 'L' WHEN 'RW' THEN 'R' ELSE position END || rn, ' ' ORDER BY list_position(['C', 'LW', 'RW', 'D', 'G'], position)) AS label FROM pn GROUP BY 1),
el AS (SELECT e.position, e.points, e.name, b.rank FROM e JOIN board b USING (player) WHERE player NOT IN (SELECT player FROM gone)),
nx AS (SELECT a.player, max(b.points) AS p FROM board a JOIN (SELECT DISTINCT position, points FROM el) b ON a.best_pos = b.position AND b.points < a.points GROUP BY 1),
up AS (SELECT position, points, arg_min(name, rank) AS name FROM el GROUP BY 1, 2),
g AS (SELECT *, lag(vorp) OVER (PARTITION BY best_pos ORDER BY vorp DESC, player) - vorp AS gap, row_number() OVER (PARTITION BY best_pos ORDER BY vorp DESC, player) AS n FROM board),
smp AS (SELECT best_pos, gap FROM g LEFT JOIN levels l ON l.position = g.best_pos WHERE gap IS NOT NULL AND (coalesce(l.depth, 0) <= 0 OR n - 1 <= greatest(l.depth, 2))),
med AS (SELECT best_pos, list_sort(list(gap))[(count(*) // 2) + 1] AS m FROM smp GROUP BY 1),
mad AS (SELECT s.best_pos, any_value(m) AS m, 1.4826 * list_sort(list(abs(gap - m)))[(count(*) // 2) + 1] AS s FROM smp s JOIN med ON med.best_pos IS NOT DISTINCT FROM s.best_pos GROUP BY 1),
thr AS (SELECT best_pos, m + CASE WHEN s <> 0 THEN s WHEN m <> 0 THEN m ELSE 1.0 END AS t FROM mad),
tier AS (SELECT player, round(gap, 4) AS gap, 1 + coalesce(sum(CASE WHEN gap > t THEN 1 ELSE 0 END) OVER (PARTITION BY g.best_pos ORDER BY vorp DESC, player), 0)::BIGINT AS tier FROM g LEFT JOIN thr ON thr.best_pos IS NOT DISTINCT FROM g.best_pos)
SELECT b.rank, b.player, b.points, b.delta, round(b.gp, 6) AS gp, b.vorp, b.best_pos, coalesce(lab.label, '') AS label, round(coalesce(b.points - nx.p, 0.0), 4) AS drop_off, coalesce(up.name, '') AS next_up, tier.gap, tier.tier
FROM board b LEFT JOIN lab USING (player) LEFT JOIN nx USING (player) LEFT JOIN up ON up.position = b.best_pos AND up.points = nx.p JOIN tier USING (player)"""


def _rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers: ``P`` rules parts of sizes that end in 0 or 1 otherwise, ``Q`` all as goalies."""
    p = parts(spark, sf_dir)
    ruled = F.when(F.col("size") % 10 == 0, F.array(F.lit("LW"), F.lit("RW"))).when(F.col("size") % 10 == 1, F.array(F.lit("D"), F.lit("C")))
    one = p.select(F.col("player").alias("key"), F.lit("P").alias("provider"), ruled.alias("positions")).where("positions is not null")
    return one.unionByName(p.select(F.col("player").alias("key"), F.lit("Q").alias("provider"), F.array(F.lit("G")).alias("positions")))


def _valued(spark: SparkSession, sf_dir: str, live: bool) -> val.Valuation:
    s = val.Settings(SCORING, SLOTS, TEAMS, minimum_games=1.2, provider="P", skater_stats=("G",), goalie_stats=("A",), dynamic=live)
    p = parts(spark, sf_dir)
    levels = p.select("player", (F.col("player") % 9 - 4).cast("int").alias("level"))
    return val.valuation(p, stat_lines(spark, sf_dir), weights(spark, sf_dir), s, _rulings(spark, sf_dir), levels, taken(spark, sf_dir) if live else None)


def _full(v: val.Valuation) -> DataFrame:
    return v.board.select("rank", "player", "points", "delta", F.round("gp", 6).alias("gp"), "vorp", "best_pos", F.coalesce("label", F.lit("")).alias("label"), "drop_off", "next_up", "gap", "tier")


@_query(_FULL.format(gone="SELECT -1 AS player WHERE false"))
def ref_full_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole valuation: minimum of games, ruled positions, adjustments, draft replacement, labels, drop-off and tiers."""
    return _full(_valued(spark, sf_dir, False))


@_query(_FULL.format(gone=_TAKEN.removeprefix("taken AS (").removesuffix(")")))
def ref_live_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while players are taken: the pool and the demand shrink together."""
    return _full(_valued(spark, sf_dir, True))


@_query(_FULL.format(gone=_TAKEN.removeprefix("taken AS (").removesuffix(")")).rsplit("SELECT b.rank", 1)[0] + "SELECT f, d, g, greatest(12 * 16 - (f + d + g), 1) AS spots FROM used")
def ref_remaining_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taken players by group, and the roster spots left."""
    v = _valued(spark, sf_dir, True)
    return spark.range(1).select(*[F.lit(v.consumed[g]).cast("long").alias(g.lower()) for g in ("F", "D", "G")], F.lit(v.spots).cast("long").alias("spots"))


_EARLY = "l_shipdate < TIMESTAMP '1998-01-01'"


@_query("WITH " + _LINES.format(where=f"WHERE {_EARLY}") + """, old AS (SELECT name AS key, points, row_number() OVER (ORDER BY points DESC, player) AS rank FROM players),
one AS (SELECT key, min(rank) AS last_rank, arg_min(points, rank) AS last_points FROM old GROUP BY 1)
SELECT p_partkey AS player, last_rank, last_points FROM part LEFT JOIN one ON one.key = p_name""")  # fmt: skip
def ref_history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = global_row_number(players(spark, sf_dir, "1998-01-01").select("player", F.col("name").alias("key"), "points"), [F.desc("points"), F.asc("player")], "rank")
    now = parts(spark, sf_dir).select("player", F.col("name").alias("key"))
    return metrics.history_join(now, old).select("player", "last_rank", "last_points")


def _source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "source_row")
    order = F.array(*[F.lit(s) for s in ("PLK", "NIC", "BTR", "OWL", "GRT", "KST", "MVD", "TNS")])
    return r.where("name is not null").select(F.trim("name").alias("key"), F.col("source_id").alias("source"), F.array_position(order, F.col("source_id")).alias("source_ord"), F.col("row_id").alias("row_no"), "name", "team", "pos", F.when(~F.isnan("age"), F.col("age")).alias("age"), "stats")


@_query("""
WITH r AS (SELECT trim(name, ' ') AS key, source_id AS source, list_position(['PLK', 'NIC', 'BTR', 'OWL', 'GRT', 'KST', 'MVD', 'TNS'], source_id) AS o, row_id, name, team, pos, CASE WHEN NOT isnan(age) THEN age END AS age, stats FROM source_row WHERE name IS NOT NULL)
SELECT key, arg_min(name, o * 1000000000::BIGINT + row_id) FILTER (trim(name, ' ') <> '') AS name, arg_min(team, o * 1000000000::BIGINT + row_id) FILTER (trim(coalesce(team, '')) <> '') AS team,
       array_to_string(arg_min(pos, o * 1000000000::BIGINT + row_id) FILTER (len(coalesce(pos, [])) > 0), '/') AS pos, arg_min(age, o * 1000000000::BIGINT + row_id) FILTER (age IS NOT NULL) AS age, count(DISTINCT source) AS sources
FROM r GROUP BY 1""")  # fmt: skip
def ref_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = identity.merge_sources(_source_rows(spark, sf_dir))
    return m.select("key", "name", "team", F.array_join("pos", "/").alias("pos"), "age", F.size("lines").cast("long").alias("sources"))


@_query("""
WITH RECURSIVE e AS (SELECT alias, min(canonical) AS canonical FROM (SELECT lower(trim(c0, ' ')) AS alias, lower(trim(c1, ' ')) AS canonical FROM aliases WHERE c0 IS NOT NULL AND c1 IS NOT NULL) WHERE alias <> canonical AND alias <> '' AND canonical <> '' GROUP BY 1),
t AS (SELECT alias, canonical, 1 AS n FROM e UNION ALL SELECT t.alias, e.canonical, n + 1 FROM t JOIN e ON e.alias = t.canonical WHERE n < 30),
ends AS (SELECT alias, arg_max(canonical, n) AS canonical, max(n) AS n, min(canonical) AS least FROM t GROUP BY 1)
SELECT alias, CASE WHEN n >= 30 THEN least ELSE canonical END AS canonical FROM ends""")  # fmt: skip
def ref_alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "aliases").select(F.lower(F.trim("c0")).alias("alias"), F.lower(F.trim("c1")).alias("canonical"))
    return identity.alias_closure(a)


@_query("SELECT name AS key, provider, arg_min(pick, provider || printf('%012d', CAST(round(pick * 1000) AS BIGINT))) AS value FROM adp WHERE pick IS NOT NULL AND NOT isnan(pick) GROUP BY 1, 2")
def ref_first_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "adp").where(~F.isnan("pick")).select(F.col("name").alias("key"), "provider", F.col("pick").alias("value"), F.col("provider").alias("ord"), F.col("pick").alias("row_no"))
    return metrics.first_pick(p)


@_query("SELECT name AS key, round(avg(pick), 6) AS value FROM adp WHERE provider IN (SELECT provider FROM adp GROUP BY 1 ORDER BY 1 LIMIT 2) AND pick IS NOT NULL GROUP BY 1")
def ref_mean_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "adp").where("pick is not null").select(F.col("name").alias("key"), "provider", F.col("pick").alias("value"))
    two = [r["provider"] for r in a.select("provider").distinct().orderBy("provider").limit(2).collect()]
    return blend.mean_of_parts(a, two).withColumn("value", F.round("value", 6))


@_query(_BASE + """, a AS (SELECT player AS key, size AS age FROM parts), l AS (SELECT player AS key, size + (player % 4) - 1 AS age FROM parts),
b AS (SELECT key, CASE WHEN key % 6 = 0 THEN NULL ELSE age END AS age FROM a)
SELECT b.key, (CASE WHEN l.age IS NOT NULL AND (b.age IS NULL OR abs(b.age - l.age) <= 1) THEN l.age ELSE b.age END)::DOUBLE AS age,
       (CASE WHEN l.age IS NOT NULL AND NOT (b.age IS NULL OR abs(b.age - l.age) <= 1) THEN l.age END)::DOUBLE AS rejected FROM b LEFT JOIN l USING (key)""")  # fmt: skip
def ref_age_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).select(F.col("player").alias("key"), F.col("size").cast("double").alias("age"))
    listed = p.select("key", (F.col("age") + F.col("key") % 4 - 1).alias("age"))
    return metrics.overlay_ages(p.withColumn("age", F.when(F.col("key") % 6 != 0, F.col("age"))), listed)


@_query("""
WITH e AS (SELECT provider, name AS key, min(positions) AS positions FROM eligibility GROUP BY 1, 2), p AS (SELECT key, min(positions) AS pos FROM e WHERE provider = (SELECT min(provider) FROM e) GROUP BY 1)
SELECT e.key, e.provider, e.positions FROM e JOIN p USING (key) WHERE e.positions <> p.pos""")  # fmt: skip
def ref_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eligibility").groupBy("provider", F.col("name").alias("key")).agg(F.min("positions").alias("positions"))
    first = e.agg(F.min("provider")).first()[0]
    lists = e.select("key", "provider", F.split("positions", "/").alias("positions"))
    own = lists.where(F.col("provider") == first).select("key", F.col("positions").alias("pos"))
    return metrics.overrides(own, lists).withColumn("positions", F.array_join("positions", "/"))


@_query("""
WITH e AS (SELECT provider, name AS key, min(positions) AS positions FROM eligibility GROUP BY 1, 2),
a AS (SELECT * FROM e WHERE provider = (SELECT min(provider) FROM e)), b AS (SELECT * FROM e WHERE provider = (SELECT max(provider) FROM e))
SELECT a.key, a.positions AS "left", b.positions AS "right" FROM a JOIN b USING (key) WHERE a.positions <> b.positions""")  # fmt: skip
def ref_ruling_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eligibility").groupBy("provider", F.col("name").alias("key")).agg(F.min("positions").alias("positions"))
    lo, hi = e.agg(F.min("provider"), F.max("provider")).first()
    return identity.ruling_differences(e.where(F.col("provider") == lo), e.where(F.col("provider") == hi))


@_query("""
SELECT row_id, team, age, gp FROM (
  SELECT row_id, listing_id, team, age, stats['GP'] AS gp, row_number() OVER (PARTITION BY listing_id ORDER BY CASE WHEN upper(team) SIMILAR TO '[0-9]+TM' THEN 0 ELSE 1 END,
         CASE WHEN upper(team) SIMILAR TO '[0-9]+TM' THEN 0.0 ELSE -coalesce(stats['GP'], '-infinity'::DOUBLE) END, row_id) AS rn FROM source_row) WHERE rn = 1""")  # fmt: skip
def ref_prefer_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "source_row").select("row_id", "listing_id", "team", "age", F.try_element_at("stats", F.lit("GP")).alias("gp"))
    return identity.prefer_aggregate(r, "listing_id", "team", "gp", "row_id").select("row_id", "team", "age", "gp")


@_query("SELECT min(row_id) AS row_id, listing_id FROM source_row GROUP BY 2")
def ref_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.first_wins(table(spark, sf_dir, "source_row").select("row_id", "listing_id"), "listing_id", "row_id")


@_query("SELECT source_id AS source, count(DISTINCT listing_id) AS players, count(DISTINCT k) AS stats FROM (SELECT source_id, listing_id, unnest(map_entries(stats)).key AS k, unnest(map_entries(stats)).value AS v FROM source_row) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1")
def ref_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "source_row").select(F.col("source_id").alias("source"), F.col("listing_id").alias("player"), F.explode("stats").alias("stat", "value"))
    return blend.coverage(lines)


@_query(_BOARD + """, slots AS (SELECT * FROM (VALUES ('C', ['C']), ('W', ['LW', 'RW']), ('F', ['C', 'LW', 'RW']), ('D', ['D']), ('G', ['G'])) t(slot, codes))
SELECT slot, rank, player FROM (SELECT slot, rank, player, row_number() OVER (PARTITION BY slot ORDER BY rank) AS rn FROM board JOIN slots ON list_has_any(pos, codes)) WHERE rn <= 3""")  # fmt: skip
def ref_best_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_per_group(board(spark, sf_dir), {"C": ["C"], "W": ["LW", "RW"], "F": ["F"], "D": ["D"], "G": ["G"]})


@_query(_BOARD + " SELECT player, rank FROM board WHERE contains(lower(name), 'bolt') AND list_has_any(pos, ['C', 'LW', 'RW'])")
def ref_search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.text_search(metrics.with_position(board(spark, sf_dir), ["F"]), " Bolt ", ("name",)).select("player", "rank")


@_query(_BOARD + ", r AS (SELECT player AS key, rank FROM board), f AS (SELECT player AS key, (player * 7) % 500 AS rank FROM parts UNION ALL SELECT -1, 1) SELECT count(*) AS n, count(*) FILTER (r.rank IS NULL) AS missing, round(avg(abs(r.rank - f.rank)), 6) AS mean_apart, max(abs(r.rank - f.rank)) AS max_apart FROM f LEFT JOIN r USING (key)")
def ref_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir).select(F.col("player").alias("key"), "rank")
    want = parts(spark, sf_dir).select(F.col("player").alias("key"), (F.col("player") * 7 % 500).alias("rank"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(1).cast("long").alias("rank"))
    return identity.rank_check(b, want.unionByName(extra)).withColumn("mean_apart", F.round("mean_apart", 6))


@_query()
def ref_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the pick lists that the eligibility list lacks, with the most similar name of the same surname."""
    a = table(spark, sf_dir, "adp").where("name is not null").select(F.col("provider").alias("source"), name_key(F.col("name")).alias("key"))
    b = table(spark, sf_dir, "eligibility").where("name is not null").select(name_key(F.col("name")).alias("key")).distinct()
    return identity.unmatched(a, b)


@_query("""
WITH c AS (SELECT file_id, sheet, row_no, unnest(cells) AS t FROM sheet_row),
d AS (SELECT *, regexp_replace(regexp_replace(trim(t), '^''', ''), '[,$%]', '', 'g') AS x FROM c),
v AS (SELECT *, CASE WHEN lower(trim(t)) IN ('', '-', '--', '—', '–', 'n/a', 'na', 'null', '.', 'none') THEN NULL WHEN regexp_full_match(x, '[+-]?[0-9]+:[0-9]{1,2}') THEN split_part(x, ':', 1)::DOUBLE + split_part(x, ':', 2)::DOUBLE / 60
       WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(x AS DOUBLE) END AS v FROM d)
SELECT file_id, sheet, count(*) AS cells, count(v) AS numbers, round(max(v), 6) AS most, round(min(v), 6) AS least FROM v GROUP BY 1, 2""")  # fmt: skip
def ref_parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "sheet_row").select("file_id", "sheet", F.explode("cells").alias("t")).withColumn("v", parse_number(F.col("t")))
    return c.groupBy("file_id", "sheet").agg(F.count("*").alias("cells"), F.count("v").alias("numbers"), F.round(F.max("v"), 6).alias("most"), F.round(F.min("v"), 6).alias("least"))


@_query("""
WITH e AS (SELECT provider, name, positions, unnest(string_split_regex(regexp_replace(upper(positions), '[^A-Z,/]', '', 'g'), '[,/]')) AS p, generate_subscripts(string_split_regex(regexp_replace(upper(positions), '[^A-Z,/]', '', 'g'), '[,/]'), 1) AS i FROM (SELECT DISTINCT provider, name, positions FROM eligibility)),
w AS (SELECT provider, name, positions, i, unnest(CASE p WHEN 'F' THEN ['C', 'LW', 'RW'] WHEN 'W' THEN ['LW', 'RW'] WHEN 'L' THEN ['LW'] WHEN 'R' THEN ['RW'] ELSE [p] END) AS c FROM e),
k AS (SELECT provider, name, positions, c, min(i * 10 + CASE c WHEN 'C' THEN 0 WHEN 'LW' THEN 1 ELSE 2 END) AS i FROM w WHERE c IN ('C', 'LW', 'RW', 'D', 'G') GROUP BY 1, 2, 3, 4)
SELECT provider, name, positions, string_agg(c, '/' ORDER BY i) AS codes FROM k GROUP BY 1, 2, 3""")  # fmt: skip
def ref_parse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eligibility").distinct()
    out = e.select("provider", "name", "positions", F.array_join(parse_positions(F.col("positions")), "/").alias("codes"))
    return out.where("codes != ''")


@_query(r"""
WITH k AS (SELECT DISTINCT c_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(c_name)), '[^\x00-\x7F]', '', 'g'), '[.''`]', '', 'g'), '-', ' ', 'g'), '\b(jr|sr|ii|iii|iv)\b', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM customer)
SELECT c_name, key, coalesce(list_filter(string_split(key, ' '), lambda w: w <> '' AND NOT starts_with(w, '('))[-1], '') AS surname FROM k""")  # fmt: skip
def ref_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_name").distinct().withColumn("key", name_key(F.col("c_name")))
    return c.withColumn("surname", surname(F.col("key")))


@_query("SELECT row_id, coalesce(t.code, upper(trim(team))) AS team FROM source_row LEFT JOIN (SELECT lower(trim(spelling)) AS s, min(code) AS code FROM team_code GROUP BY 1) t ON t.s = lower(trim(team))")
def ref_team_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "team_code").groupBy(F.lower(F.trim("spelling")).alias("s")).agg(F.min("code").alias("code"))
    r = table(spark, sf_dir, "source_row").select("row_id", "team", F.lower(F.trim("team")).alias("s"))
    return r.join(t, "s", "left").select("row_id", F.coalesce("code", F.upper(F.trim("team"))).alias("team"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@_query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(round(value * 10000)::BIGINT)::DOUBLE, 2) AS total FROM events GROUP BY 1, 2")
def ref_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("value", F.round(F.col("value") * 10000).cast("long"))
    return ev.windowed(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@_query("""
WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 minutes THEN 1 ELSE 0 END AS brk, event_id FROM events),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def ref_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.sessions(_events(spark, sf_dir))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@_query("""
WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, max(n) FILTER (event_type IN ('purchase', 'error')) AS at FROM o GROUP BY 1)
SELECT s.user_id, (coalesce(max(o.event_type) FILTER (o.n = s.at) = 'purchase', false)) <> (count(*) FILTER (o.event_type = 'click' AND (s.at IS NULL OR o.n > s.at)) % 2 = 1) AS state FROM s JOIN o USING (user_id) GROUP BY s.user_id""")  # fmt: skip
def ref_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.toggled(_events(spark, sf_dir), "user_id", "click", "purchase", "error")


@_query("""
WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS d FROM events)
SELECT user_id, list_reduce(list_prepend(0, list(d ORDER BY ts, event_id)), lambda x, y: least(3, greatest(-3, x + y)))::INT AS level FROM s WHERE d IS NOT NULL GROUP BY 1""")  # fmt: skip
def ref_clamped_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level per user that purchases raise and errors lower, never beyond three either way."""
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1)
    return ev.clamped_levels(_events(spark, sf_dir), "user_id", step)


@_query(_BASE + " SELECT player, source, round_even(max(value) FILTER (stat = 'GP'), 6) AS gp, round_even(max(value) FILTER (stat = 'G'), 6) AS g FROM lines GROUP BY 1, 2")
def ref_interchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bd.interchange(stat_lines(spark, sf_dir), ["GP", "G"])
    flat = packed.select("player", F.explode("lines").alias("source", "v"))
    return flat.select("player", F.col("source").cast("int").alias("source"), F.col("v")[0].alias("gp"), F.col("v")[1].alias("g"))


@_query("""
WITH b AS (SELECT lower(p_name) AS n, max(p_partkey) AS player FROM part GROUP BY 1), s AS (SELECT upper(p_name) || CASE WHEN p_partkey % 5 = 0 THEN '?' ELSE '' END AS name, p_partkey AS mark FROM part)
SELECT s.name, s.mark, b.player FROM s JOIN b ON b.n = lower(s.name)""")  # fmt: skip
def ref_name_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    end = F.when(F.col("player") % 5 == 0, "?").otherwise("")
    state = p.select(F.concat(F.upper("name"), end).alias("name"), F.col("player").alias("mark"))
    return bd.by_name(p, state)[0].select("name", "mark", "player")


@_query(_BOARD + """ SELECT player, rank || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
  CASE WHEN list_contains(pos, 'G') THEN 'G' WHEN list_contains(pos, 'D') THEN 'D' ELSE 'F' END AS kind, repeat(CASE WHEN player % 7 > 3 THEN '+' ELSE '−' END, abs(player % 7 - 3)::BIGINT) AS level FROM board""")  # fmt: skip
def ref_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir)
    return b.select("player", ordinal(F.col("rank")).alias("place"), value.group_of(F.col("pos")).alias("kind"), level_label(F.col("player") % 7 - 3).alias("level"))


@_query(_BOARD + """, nat AS (SELECT l_partkey AS player, min(s_nationkey) AS team FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), sch AS (SELECT n_nationkey AS team, (n_nationkey * 7) % 25 AS nights FROM nation WHERE n_nationkey <> 3),
c AS (SELECT quantile_cont(nights, 0.25) AS lo, quantile_cont(nights, 0.75) AS hi FROM sch)
SELECT board.player, CASE WHEN nights IS NULL THEN NULL WHEN nights >= hi THEN 1 WHEN nights <= lo THEN -1 ELSE 0 END AS nights_band FROM board JOIN nat USING (player) LEFT JOIN sch USING (team), c""")  # fmt: skip
def ref_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = stat_lines(spark, sf_dir).groupBy("player").agg(F.min("source").alias("team"))
    schedule = table(spark, sf_dir, "nation").where("n_nationkey != 3").select(F.col("n_nationkey").alias("team"), (F.col("n_nationkey") * 7 % 25).alias("nights"))
    return bd.attach_schedule(first, schedule, ("nights",)).select("player", "nights_band")


@_query(_BOARD.replace("WITH base", "WITH RECURSIVE base", 1) + """, o AS (SELECT (rank % 12)::VARCHAR AS owner, player, pos, row_number() OVER (PARTITION BY rank % 12 ORDER BY vorp DESC, player) AS n FROM board WHERE rank <= 192),
f AS (
  SELECT owner, player, n, [2, 2, 2, 4, 2] AS free, pos, 0 AS slot FROM (SELECT DISTINCT owner, -1::BIGINT AS player, 0::BIGINT AS n, []::VARCHAR[] AS pos FROM o)
  UNION ALL
  SELECT o.owner, o.player, o.n, CASE WHEN x.s > 0 THEN list_concat(free[1 : x.s - 1], list_concat([free[x.s] - 1], free[x.s + 1 : 5])) ELSE free END, o.pos, x.s
  FROM f JOIN o ON o.owner = f.owner AND o.n = f.n + 1, LATERAL (SELECT coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: f.free[i] > 0 AND list_contains(o.pos, ['C', 'LW', 'RW', 'D', 'G'][i]))), 0) AS s) x)
SELECT owner, player, CASE WHEN slot > 0 THEN ['C', 'LW', 'RW', 'D', 'G'][slot] ELSE 'XTRA' END AS slot FROM f WHERE n > 0""")  # fmt: skip
def ref_fill_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters of twelve owners who pick in turn, filled slot by slot."""
    b = board(spark, sf_dir).where(F.col("rank") <= TEAMS * 16)
    picks = b.select((F.col("rank") % TEAMS).cast("string").alias("owner"), "player", "vorp", "pos")
    return bd.fill_slots(picks, {k: v for k, v in SLOTS.items() if k != "BN"}, {})
