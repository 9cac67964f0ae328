"""Queries of filters, variants, sorts, lists and history over the ranked board, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions.scalars import heading_key, name_key, parse_positions
from slatework.operators import blend, identity, metrics, score
from slatework.operators import board as bd
from slatework.plans import reference_queries as ref
from slatework.plans import valuation as val
from slatework.plans.source_queries import _key_sql
from slatework.session import ensure_checkpoint_dir, table
from slatework.sources import infer, paste, reader, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BOARD = ref._BOARD
_TAKEN = ref._TAKEN


@_query(_BOARD + f", {_TAKEN} SELECT player, rank FROM board WHERE size >= 20 AND player NOT IN (SELECT player FROM taken)")
def ref_hide_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free players of a size of 20 and more, as games would be filtered."""
    b = metrics.minimum_games(ref.board(spark, sf_dir), "size", 20)
    return metrics.hide_taken(b, ref.taken(spark, sf_dir)).select("player", "rank")


@_query(_BOARD + f", {_TAKEN}, m AS (SELECT * FROM board WHERE contains(lower(name), 'bolt') AND player NOT IN (SELECT player FROM taken)) SELECT player, rank, name FROM m WHERE rank = (SELECT min(rank) FROM m)")
def ref_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best free player that a search finds."""
    return metrics.first_free_match(ref.board(spark, sf_dir).withColumn("team", F.lit("")), ref.taken(spark, sf_dir), "BOLT").select("player", "rank", "name")


@_query(_BOARD + ", s AS (SELECT event_id % (SELECT max(p_partkey) FROM part) + 1 AS player, event_type FROM events) SELECT player, rank, 'in' AS side FROM board WHERE player IN (SELECT player FROM s WHERE event_type = 'error') UNION ALL SELECT player, rank, 'out' FROM board WHERE player NOT IN (SELECT player FROM s WHERE event_type = 'error')")
def ref_state_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 1
    state = table(spark, sf_dir, "events").select((F.col("event_id") % most + 1).alias("player"), "event_type")
    b, flag = ref.board(spark, sf_dir).select("player", "rank"), F.col("event_type") == "error"
    return bd.in_state(b, state, flag).withColumn("side", F.lit("in")).unionByName(bd.in_state(b, state, flag, False).withColumn("side", F.lit("out")))


@_query("""
WITH a AS (SELECT name AS key, provider, min(pick) AS value FROM adp WHERE pick IS NOT NULL AND NOT isnan(pick) GROUP BY 1, 2), p AS (SELECT DISTINCT name AS key FROM eligibility WHERE name IS NOT NULL)
SELECT p.key, x.value AS pick, (SELECT count(*) FROM a WHERE a.key = p.key) AS providers FROM p LEFT JOIN a x ON x.key = p.key AND x.provider = (SELECT min(provider) FROM a)""")  # fmt: skip
def ref_attached_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed name with its picks, and the pick of one provider."""
    a = table(spark, sf_dir, "adp").where(~F.isnan("pick")).select(F.col("name").alias("key"), "provider", F.col("pick").alias("value"), F.lit(0).alias("ord"), F.col("pick").alias("row_no"))
    first = a.agg(F.min("provider")).first()[0]
    people = table(spark, sf_dir, "eligibility").where("name is not null").select(F.col("name").alias("key")).distinct()
    got = metrics.pick_of(metrics.attach_picks(people, metrics.first_pick(a)), first)
    return got.select("key", "pick", F.coalesce(F.size("picks"), F.lit(0)).cast("long").alias("providers")).withColumn("providers", F.greatest("providers", F.lit(0).cast("long")))


@_query(ref._BASE + """, ruled AS (SELECT player, CASE WHEN size % 10 = 0 THEN ['LW', 'RW'] WHEN size % 10 = 1 THEN ['D', 'C'] ELSE pos END AS pos FROM parts)
SELECT player, array_to_string(pos, '/') AS pos FROM ruled""")  # fmt: skip
def ref_ruled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ref.parts(spark, sf_dir).withColumn("key", F.col("player"))
    return metrics.effective_positions(p, ref._rulings(spark, sf_dir), "P").select("player", F.array_join("pos", "/").alias("pos"))


@_query(ref._BASE + " SELECT player, count(*) AS lines, count(DISTINCT source) AS sources FROM lines WHERE source NOT IN (1, 2, 3) GROUP BY 1")
def ref_removed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.drop_sources(ref.stat_lines(spark, sf_dir), [1, 2, 3]).groupBy("player").agg(F.count("*").alias("lines"), F.countDistinct("source").alias("sources"))


@_query("SELECT DISTINCT k AS stat FROM (SELECT unnest(map_entries(stats)).key AS k, unnest(map_entries(stats)).value AS v FROM source_row) WHERE v IS NOT NULL AND NOT isnan(v) AND k IN ('GP', 'G', 'HIT', 'FOW', 'SV')")
def ref_shown_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "source_row").select(F.explode("stats").alias("stat", "value"))
    return blend.shown_stats(lines, ["G", "HIT", "FOW", "SV"])


@_query("""
WITH s AS (SELECT source_id AS source, listing_id, pos, unnest(map_entries(stats)).key AS k, unnest(map_entries(stats)).value AS v FROM source_row), g AS (SELECT listing_id, bool_or(list_contains(pos, 'G')) AS g FROM source_row GROUP BY 1)
SELECT source, count(DISTINCT listing_id) AS players, count(DISTINCT k) AS stats, bool_or(coalesce(g.g, false)) AS has_goalies FROM s JOIN g USING (listing_id) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1""")  # fmt: skip
def ref_goalie_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "source_row")
    lines = r.select(F.col("source_id").alias("source"), F.col("listing_id").alias("player"), F.explode("stats").alias("stat", "value"))
    return blend.coverage(lines, r.select(F.col("listing_id").alias("player"), "pos"))


_SORTS = [("name", "name ASC NULLS LAST"), ("price", "price DESC NULLS LAST"), ("size", "size DESC NULLS LAST")]


@_query(_BOARD + " " + " UNION ALL ".join(f"(SELECT '{k}' AS by, player FROM board ORDER BY {o}, rank LIMIT 10)" for k, o in _SORTS))
def ref_sorted_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows by several columns, each in its usual direction."""
    b = ref.board(spark, sf_dir)
    views = [metrics.sort_by(b, k).limit(10).select(F.lit(k).alias("by"), "player") for k, _ in _SORTS]
    return views[0].unionByName(views[1]).unionByName(views[2])


_ONE = lambda c: f"CAST(round(CAST({c} AS DECIMAL(18,4)), 1)::DECIMAL(18,1) AS VARCHAR)"


@_query(_BOARD + f" SELECT rank, lpad(rank::VARCHAR, 4, ' ') || '  ' || rpad(name, 24, ' ') || lpad({_ONE('points')}, 9, ' ') || lpad({_ONE('vorp')}, 9, ' ') AS line FROM board WHERE rank <= 25")
def ref_ranking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.ranking_lines(ref.board(spark, sf_dir))


@_query("SELECT to_json({'player': p_partkey, 'name': p_name, 'size': p_size})::VARCHAR AS json FROM part")
def ref_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(ref.parts(spark, sf_dir), "player", "name", "size")


@_query("SELECT p_partkey AS player, coalesce(CASE WHEN trim(CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN p_brand END) <> '' THEN p_brand END, p_name) AS text FROM part")
def ref_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("size") % 3
    p = ref.parts(spark, sf_dir).withColumn("some", F.when(third == 0, " ").when(third == 1, F.col("brand")))
    return p.select("player", identity.first_filled("some", "name").alias("text"))


@_query("SELECT n_nationkey AS team, (n_nationkey * 3) % 7 AS games FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def ref_window_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's numbers for the teams that the schedule has."""
    window = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team"), (F.col("n_nationkey") * 3 % 7).alias("games"))
    return bd.attach_window(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team")).distinct(), window)


@_query(r"SELECT file_id, sheet, row_no, array_to_string(list_transform(cells, lambda c: trim(regexp_replace(lower(ltrim(coalesce(c, ''), '''')), '[^a-z0-9+\-/%]+', ' ', 'g'), ' ')), '|') AS heads FROM sheet_row WHERE row_no <= 3")
def ref_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading and banner lines of every sheet in comparable form."""
    s = table(spark, sf_dir, "sheet_row").where("row_no <= 3")
    return s.select("file_id", "sheet", "row_no", F.array_join(F.transform("cells", lambda c: heading_key(F.coalesce(c, F.lit("")))), "|").alias("heads"))


_HEADS = ", ".join(f"('{h}', '{f}')" for h, f in {**infer.WEAKER, **infer.STRONG}.items())


@_query(rf"""
WITH h(h, f) AS (VALUES {_HEADS}),
c AS (SELECT file_id, sheet, row_no, unnest(cells) AS c FROM sheet_row WHERE row_no <= 15),
k AS (SELECT file_id, sheet, row_no, f FROM c LEFT JOIN h ON h.h = trim(regexp_replace(lower(ltrim(coalesce(c, ''), '''')), '[^a-z0-9+\-/%]+', ' ', 'g'), ' ')),
s AS (SELECT file_id, sheet, row_no, count(DISTINCT f) + CASE WHEN count(*) FILTER (f = 'name') > 0 THEN 3 ELSE 0 END AS p FROM k GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, sheet ORDER BY p DESC, row_no) AS n FROM s)
SELECT file_id, sheet, row_no AS header_row FROM r WHERE n = 1""")  # fmt: skip
def ref_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the headings of every delivered sheet stand, by what they say."""
    return infer.header_rows(table(spark, sf_dir, "sheet_row"), ["file_id", "sheet"])


@_query("SELECT file_id, sheet, row_no, upper(trim(cells[1], ' ')) AS code FROM sheet_row WHERE row_no BETWEEN 2 AND 9 AND length(trim(cells[1], ' ')) BETWEEN 1 AND 4")
def ref_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.row_range(table(spark, sf_dir, "sheet_row"), 2, 9).select("file_id", "sheet", "row_no", "code")


@_query(r"""
SELECT n * 2 + 1 AS row_no, name, pick AS value FROM (SELECT trim(name, ' ') AS name, round(pick, 1) AS pick, row_number() OVER (ORDER BY provider, name, pick) AS n FROM adp WHERE name IS NOT NULL AND pick IS NOT NULL AND NOT isnan(pick))
WHERE regexp_full_match(name, '[\p{Lu}][\p{L}.''-]*([\t\n\f\r ]+[\p{L}.''-]+)+')""")  # fmt: skip
def ref_pasted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks as a page pastes them, numbers and names on lines of their own."""
    from slatework.operators.ordering import global_row_number

    a = table(spark, sf_dir, "adp").where("name is not null and pick is not null").where(~F.isnan("pick"))
    n = global_row_number(a, [F.asc("provider"), F.asc("name"), F.asc("pick")], "n")
    pick = F.format_string("%.1f", F.round("pick", 1))
    lines = n.select((F.col("n") * 2).alias("row_no"), pick.alias("line")).unionByName(n.select((F.col("n") * 2 + 1).alias("row_no"), F.trim("name").alias("line")))
    return paste.paste_pairs(lines)


@_query(f"SELECT DISTINCT provider AS source, key FROM (SELECT provider, {_key_sql('name')} AS key FROM adp WHERE name IS NOT NULL) WHERE key NOT IN (SELECT {_key_sql('name')} FROM eligibility WHERE name IS NOT NULL)")
def ref_unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the pick lists that the eligibility list lacks, without suggestions."""
    a = table(spark, sf_dir, "adp").where("name is not null").select(F.col("provider").alias("source"), name_key(F.col("name")).alias("key"))
    b = table(spark, sf_dir, "eligibility").where("name is not null").select(name_key(F.col("name")).alias("key")).distinct()
    return identity.unmatched(a, b).select("source", "key")


@_query("SELECT provider, name, CASE WHEN len(list_filter(string_split(positions, '/'), lambda p: p IN ('C', 'LW', 'RW', 'D', 'G', 'F', 'W', 'L', 'R'))) = 0 THEN 'C' ELSE 'known' END AS kind FROM (SELECT DISTINCT provider, name, positions FROM eligibility)")
def ref_default_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by default: a player without a known one is a centre."""
    e = table(spark, sf_dir, "eligibility").distinct().withColumn("none", F.size(parse_positions(F.col("positions"))) == 0)
    return e.select("provider", "name", F.when(F.col("none"), parse_positions(F.col("positions"), True)[0]).otherwise("known").alias("kind"))


@_query(ref._BASE + ", g AS (SELECT player, value AS gp FROM totals WHERE stat = 'GP') SELECT player, round(CASE WHEN coalesce(gp, 0) <> 0 THEN points / gp ELSE 0.0 END + 1e-7, 4) AS per_game FROM players LEFT JOIN g USING (player)")
def ref_per_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = blend.blend_totals(ref.stat_lines(spark, sf_dir), ref.weights(spark, sf_dir)).where("stat = 'GP'").select("player", F.col("value").alias("gp"))
    return ref.players(spark, sf_dir).join(games, "player", "left").select("player", F.round(score.per_game(F.col("points"), F.col("gp")) + val.NUDGE, 4).alias("per_game"))


@_query(ref._BASE + """, own AS (SELECT player, sum(CASE stat WHEN 'G' THEN value * 4.0::DOUBLE WHEN 'A' THEN value * 0.001::DOUBLE END) AS pts, max(value) FILTER (stat = 'GP') AS gp FROM lines WHERE source = 3 GROUP BY 1),
last AS (SELECT p.player, p.name, p.pos, round(o.pts + 1e-7, 4) AS points, o.gp FROM parts p JOIN own o USING (player)),""" + ref._board_sql("last").replace("FROM players", "FROM last").replace("valued AS (SELECT p.*", "valued AS (SELECT p.player, p.name, p.points, p.gp") + """
SELECT p.player, b.rank AS last_rank, b.points AS last_points, b.gp AS last_gp FROM parts p LEFT JOIN board b USING (player)""")  # fmt: skip
def ref_last_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source as last season, ranked under the same scoring and roster, beside every player."""
    s = val.Settings(ref.SCORING, ref.SLOTS, ref.TEAMS, by_draft=False)
    p = ref.parts(spark, sf_dir)
    last = val.history(p, ref.stat_lines(spark, sf_dir), s, 3)
    return val.with_last_season(p.select("player"), last.board).select("player", "last_rank", "last_points", "last_gp")


@_query("SELECT value FROM (SELECT '# ' || 'sizes' AS value UNION ALL SELECT 'name,size' UNION ALL SELECT p_name || ',' || max(p_size)::VARCHAR FROM part GROUP BY p_name)")
def ref_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference list written with its banner and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/list-of-sizes"
    sinks.write_list(ref.parts(spark, sf_dir).groupBy("name").agg(F.max("size").alias("size")), path, "name", ("sizes",))
    return spark.read.text(path)
