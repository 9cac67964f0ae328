"""Writing results: JSON, CSV and fixed-width text, each a distributed write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(c: Column, decimals: int) -> Column:
    """A number with fixed decimals, '' for null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c.cast("double"))).otherwise("")


def write_json(df: DataFrame, path: str) -> None:
    """Compact JSON lines, null fields left out, other scripts kept as they are."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a heading, quotes doubled; arrays are joined with ``/``."""
    flat = df.select(*[F.array_join(c, "/").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_grouped(df: DataFrame, path: str, *by: str) -> None:
    """Parquet in one folder per value."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def ranking_lines(ranked: DataFrame, n: int = 25) -> DataFrame:
    """The first ``n`` players as fixed-width text ``line``, with ``rank``."""
    top = ranked.orderBy("rank").limit(n)
    return top.select("rank", F.concat(F.lpad(F.col("rank").cast("string"), 4, " "), F.lit("  "), F.rpad("name", 24, " "), F.lpad(fixed(F.col("points"), 1), 9, " "), F.lpad(fixed(F.col("vorp"), 1), 9, " ")).alias("line"))


def json_rows(df: DataFrame, *cols: str) -> DataFrame:
    """One JSON text per row of the given columns."""
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


#: Columns of the rankings as CSV, with the season's label in place of ``{}``, and those that the board's view adds.
RANKING_HEADS = ["Rank", "Player", "Team", "Pos", "Tier", "VORP", "Next", "FanPts", "FP/GP", "GP", "PosRank", "ADP", "{} Rank", "{} FP", "{} GP"]
VIEW_HEADS = ["Adj", "Mark", "Drafted", "MyTeam"]


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def ranking_csv(ranked: DataFrame, label: str = "Last", view: bool = False) -> tuple[str, DataFrame]:
    """(heading, ``rank, line``) of the whole ranking as CSV: 16 columns, or with ``view`` the 19 of the board.

    Input: ``rank, name, team, pos, best_pos, tier, vorp, drop_off, points, per_game, gp, label, pick, last_rank, last_points,
    last_gp`` and ``sources``, for the view ``adjustment, mark, taken, mine``. Nulls are empty; a name's quotes are doubled.
    Sort the lines by ``rank`` where they are written.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "Y").otherwise("")
    first = [text("rank"), _quoted(F.col("name")), text("team"), _quoted(F.array_join("pos", "/"))]
    tier = F.concat(text("best_pos"), text("tier"))
    rest = [tier, fixed(F.col("vorp"), 2), fixed(F.col("drop_off"), 2), fixed(F.col("points"), 2), fixed(F.col("per_game"), 3), fixed(F.col("gp"), 1), _quoted(F.col("label")), text("pick"), text("last_rank"), fixed(F.col("last_points"), 2), fixed(F.col("last_gp"), 0)]
    heads = [h.format(label) for h in RANKING_HEADS]
    if not view:
        return ",".join([*heads, "Sources"]), ranked.select("rank", F.concat_ws(",", *first, *rest, text("sources")).alias("line"))
    more = [F.coalesce(F.col("adjustment"), F.lit(0)).cast("string"), text("mark")]
    return ",".join([*heads[:4], *VIEW_HEADS[:2], *heads[4:], *VIEW_HEADS[2:]]), ranked.select("rank", F.concat_ws(",", *first, *more, *rest, yes("taken"), yes("mine")).alias("line"))


def ranking_text(ranked: DataFrame, levels: dict[str, float], n: int = 25) -> list[str]:
    """A heading, the first ``n`` players and the replacement levels as lines of fixed width."""
    rows = [r["line"] for r in ranking_lines(ranked, n).orderBy("rank").collect()]
    return [f"{'#':>4}  {'Player':<24}{'Points':>9}{'Value':>9}", *rows, "", "Replacement level:  " + "   ".join(f"{p} {v:.1f}" for p, v in levels.items())]


def write_list(df: DataFrame, path: str, order: str, banner: tuple[str, ...] = ()) -> None:
    """A reference list as CSV text: comment lines, a heading, and rows in the order of a column."""
    flat = [F.array_join(c, "/") if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
    quoted = [F.when(c.rlike('[",\n]'), _quoted(c)).otherwise(c) for c in flat]
    body = df.select(F.concat_ws(",", *quoted).alias("value"), F.col(order).alias("_o")).orderBy("_o").select("value")
    head = [*[f"# {b}" for b in banner], ",".join(df.columns)]
    first = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(h) for h in head])).alias("value"))
    first.coalesce(1).unionByName(body).write.mode("overwrite").text(path)


def write_unmatched(unmatched: DataFrame, path: str) -> None:
    """The unmatched keys with their suggestions as CSV, by source and key."""
    write_csv(unmatched.withColumn("ratio", F.round("ratio", 6)).orderBy("source", "key"), path)


def payload(players: DataFrame, lines: DataFrame, stats: list[str], coverage: DataFrame, providers: DataFrame, **parts: DataFrame) -> DataFrame:
    """``part, json``: what a page needs, one JSON text per row: players, their lines by source, coverage, provider menus and other parts.

    ``lines`` as from ``interchange``. Rows stay distributed; a part's rows may be written side by side.
    """
    both = players.join(lines, "player", "left")
    head = players.sparkSession.range(1).select(F.array(*[F.lit(s) for s in stats]).alias("stats"))
    all_ = {"stats": head, "players": both, "coverage": coverage, "providers": providers, **parts}
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("part"), F.to_json(F.struct(*df.columns)).alias("json")) for k, df in all_.items()])
