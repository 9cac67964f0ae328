"""What the columns of an unknown sheet mean, judged on a bounded sample of its first rows."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.functions.scalars import BLANKS, heading_key, name_key, parse_number, parse_positions
from slatework.operators.identity import first_wins

# Headings by field, in normal form; an earlier field keeps a heading that a later one lists as well.
HEADINGS = {
    "name": ["name", "player", "player name", "full name", "skater", "goalie"],
    "team": ["team", "tm", "club", "squad"],
    "pos": ["pos", "position", "positions", "elig", "eligibility"],
    "age": ["age", "years", "age (oct)"],
    "GP": ["gp", "games", "games played", "gms"],
    "G": ["g", "goals"],
    "A": ["a", "assists", "ast"],
    "PTS": ["pts", "points"],
    "SOG": ["sog", "shots", "shots on goal"],
    "PPP": ["ppp", "power play pts", "power play points", "pp points"],
    "PPG": ["ppg", "power play goals", "pp goals"],
    "SHG": ["shg", "shorthanded goals", "sh goals"],
    "SHP": ["shp", "shorthanded points", "sh points"],
    "HIT": ["hit", "hits", "body checks"],
    "BLK": ["blk", "blocks", "blk shots", "blocked shots"],
    "PIM": ["pim", "pen", "penalty minutes"],
    "PM": ["+/-", "plus/minus", "plus minus"],
    "GWG": ["gwg", "game winning goals", "gw goals"],
    "FOW": ["fow", "fo w", "faceoffs won", "faceoff wins"],
    "FOL": ["fol", "fo l", "faceoffs lost"],
    "W": ["w", "wins"],
    "L": ["l", "losses"],
    "OTL": ["otl", "ot losses", "overtime losses"],
    "SO": ["so", "shutouts"],
    "SV": ["sv", "saves"],
    "SA": ["sa", "shots against"],
    "GA": ["ga", "goals against"],
    "SV%": ["sv%", "save pct", "save percentage"],
    "GAA": ["gaa", "goals against average"],
}
# Headings that count only where no better one is there, headings with two meanings, and the most of a statistic per game.
WEAK = {"GP": ["gs", "games started", "starts"]}
AMBIGUOUS = ["s", "p", "sh", "ot"]
CEILINGS = {"G": 3, "A": 4, "PTS": 5, "SOG": 10, "W": 2, "SV": 5}
_SHORT = {"s": "SOG", "p": "PTS", "sh": "SHP", "ot": "OTL"}


def _by_heading(fields: dict[str, list[str]]) -> dict[str, str]:
    out: dict[str, str] = {}
    for f, heads in fields.items():
        for h in heads:
            out.setdefault(normal_heading(h), f)
    return out


def normal_heading(h: str | None) -> str:
    """Lower case, only letters, digits and ``+ - / %``, single spaces, no leading apostrophe."""
    return " ".join(re.sub(r"[^a-z0-9+\-/%]+", " ", (h or "").lower().lstrip("'")).split())


STRONG = _by_heading(HEADINGS) | _SHORT
WEAKER = _by_heading(WEAK)


def heading_field(h: str | None) -> str | None:
    """The field that a heading names, weak headings included; null for others."""
    k = normal_heading(h)
    return STRONG.get(k) or WEAKER.get(k)


def _cell(row: list[str | None], i: int) -> str:
    return (row[i] or "").strip() if i < len(row) else ""


def _number(text: str) -> float | None:
    try:
        return float(re.sub("[,$%]", "", text.lstrip("'")))
    except ValueError:
        return None


def header_row(rows: list[list[str | None]], within: int = 15) -> int:
    """0-based index of the row that names the most fields, a name field counting 3 more; the earliest of equals."""
    def score(r: list[str | None]) -> int:
        f = {x for x in map(heading_field, r) if x}
        return len(f) + 3 * ("name" in f)

    scores = [score(r) for r in rows[:within]]
    return scores.index(max(scores)) if scores else 0


def header_rows(cells: DataFrame, group: list[str], within: int = 15) -> DataFrame:
    """``header_row`` of every sheet of ``group, row_no, cells``: the distributed form of ``header_row``, by ``row_no``.

    Sheets without a known heading in their first ``within`` rows have their first row.
    """
    known = STRONG | {k: v for k, v in WEAKER.items() if k not in STRONG}
    field = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    first = cells.where(F.col("row_no") <= within)
    named = F.array_distinct(F.filter(F.transform("cells", lambda c: field[heading_key(F.coalesce(c, F.lit("")))]), lambda f: f.isNotNull()))
    points = F.size(named) + F.when(F.array_contains(named, "name"), 3).otherwise(0)
    return first.groupBy(*group).agg(F.max_by("row_no", F.struct(points.alias("p"), (-F.col("row_no")).alias("n"))).alias("header_row"))


def auto_map(cells: DataFrame, sample: int = 56) -> list[dict]:
    """For every column ``index, header, sample, field, uncertain, duplicate, note`` from the first ``sample`` rows.

    Unsure are ambiguous and weak headings and such of a field that another column has. A points column
    that isn't goals plus assists has no field. Without a name column the first column of text is taken for it.
    """
    rows = [list(r["cells"]) for r in cells.orderBy("row_no").select("cells").limit(sample).collect()]
    at = header_row(rows)
    data = rows[at + 1 :]
    out, first_of = [], {}
    for i, h in enumerate(rows[at] if rows else []):
        f, k = heading_field(h), normal_heading(h)
        shown = next((_cell(r, i) for r in data[:30] if _cell(r, i)), None)
        again = f in first_of
        out.append({"index": i + 1, "header": h, "sample": shown, "field": f, "uncertain": f is not None and (k in AMBIGUOUS or k not in STRONG or again), "duplicate": again, "note": None})
        if f:
            first_of.setdefault(f, i)
    for c in out:
        if c["field"] == "PTS":
            fits = _points_fit(data, c["index"] - 1, first_of.get("G"), first_of.get("A"))
            c |= {"uncertain": False} if fits else {"uncertain": True, "field": None, "note": "does not match goals + assists"}
    if out and not any(c["field"] == "name" for c in out):
        guess = text_column(data)
        if guess is not None and guess < len(out):
            out[guess] |= {"field": "name", "uncertain": True}
    return out


def _points_fit(data: list[list[str | None]], pts: int, g: int | None, a: int | None, rows: int = 40, least: int = 5) -> bool:
    """Whether over 80 % of the first complete rows have points that are goals plus assists, to within 1 or 2 %."""
    if g is None or a is None:
        return False
    got = [[_number(_cell(r, i)) for i in (pts, g, a)] for r in data]
    full = [(p, x + y) for p, x, y in got if None not in (p, x, y)][:rows]
    return len(full) >= least and sum(abs(p - s) <= max(1.0, 0.02 * abs(p)) for p, s in full) > 0.8 * len(full)


def build_source(cells: DataFrame, columns: list[dict], stats: list[str], header: int = 1, per_game: bool = False, counting: tuple[str, ...] = ()) -> DataFrame:
    """``row_no, key, name, team, pos, age, stats`` of a mapped sheet ``row_no, cells``; ``columns`` as from ``auto_map``.

    Of several columns of one statistic the first with a value counts. Rows without a name or any statistic go, and with
    ``per_game`` those without games, whose counting statistics are multiplied by them. The first row of a key counts.
    """
    of: dict[str, list[int]] = {}
    for c in columns:
        if c["field"]:
            of.setdefault(c["field"], []).append(c["index"])
    if "name" not in of:
        raise ValueError("no column is mapped to the player's name")
    at = lambda f: F.trim(F.coalesce(F.try_element_at("cells", F.lit(of[f][0])), F.lit(""))) if f in of else F.lit("")
    number = lambda f: F.coalesce(*[parse_number(F.try_element_at("cells", F.lit(i))) for i in of[f]])
    known = [s for s in stats if s in of]
    rows = cells.where(F.col("row_no") > header).select("row_no", at("name").alias("name"), at("team").alias("team"), at("pos").alias("pos"), (number("age") if "age" in of else F.lit(None).cast("double")).alias("age"), *[number(s).alias(s) for s in known])
    rows = rows.where(~F.lower("name").isin(*BLANKS))
    if per_game:
        rows = rows.where(F.col("GP").isNotNull()) if "GP" in known else rows.where(F.lit(False))
        rows = rows.select(*[(F.col(f"`{c}`") * F.col("GP")).alias(c) if c in counting and c in known else F.col(f"`{c}`") for c in rows.columns])
    packed = F.map_filter(F.create_map(*[x for s in known for x in (F.lit(s), F.col(f"`{s}`"))]), lambda _, v: v.isNotNull()) if known else F.create_map().cast("map<string,double>")
    out = rows.select("row_no", name_key(F.col("name")).alias("key"), "name", "team", parse_positions(F.col("pos")).alias("pos"), "age", packed.alias("stats"))
    return first_wins(out.where((F.size("stats") > 0) & (F.col("key") != "")), "key", "row_no")


def commit_import(board_rows: DataFrame, weights: dict[str, float], built: DataFrame, weight: float = 1.0) -> tuple[DataFrame, dict[str, float], str]:
    """(rows with the import behind them, weights with its own, its new id ``import-n``); merge the rows by ``merge_sources``."""
    n = next(i for i in count(1) if f"import-{i}" not in weights)
    last = board_rows.agg(F.max("source_ord")).first()[0] or 0
    new = built.select("key", F.lit(f"import-{n}").alias("source"), F.lit(last + 1).alias("source_ord"), "row_no", "name", "team", "pos", "age", "stats")
    return board_rows.select(*new.columns).unionByName(new), weights | {f"import-{n}": weight}, f"import-{n}"


def points_agree(stats: DataFrame, rows: int = 40) -> bool | None:
    """Whether PTS is goals plus assists in over 80 % of the first complete rows by ``row_no``, to within 1 or 2 %; null below 5 rows.

    Without that column the order is that of all columns.
    """
    order = ["row_no"] if "row_no" in stats.columns else sorted(stats.columns)
    some = stats.where("G is not null and A is not null and PTS is not null").orderBy(*[F.col(f"`{c}`") for c in order]).limit(rows)
    fits = F.abs(F.col("PTS") - F.col("G") - F.col("A")) <= F.greatest(F.lit(1.0), 0.02 * F.abs("PTS"))
    r = some.agg(F.count("*").alias("n"), F.count_if(fits).alias("k")).first()
    return None if r["n"] < 5 else r["k"] > 0.8 * r["n"]


def looks_per_game(stats: DataFrame) -> bool:
    """Whether, among players with 10 games or more, every known statistic stays below what one game can give."""
    known = [s for s in CEILINGS if s in stats.columns]
    if not known or "GP" not in stats.columns:
        return False
    top = stats.where("GP >= 10").agg(*[F.max(s).alias(s) for s in known]).first()
    judged = {s: top[s] for s in known if top[s] is not None}
    return bool(judged) and all(v < CEILINGS[s] for s, v in judged.items())


def text_column(rows: list[list[str | None]], seen: int = 5, share: float = 0.8) -> int | None:
    """0-based index of the first column with at least ``seen`` cells of which more than ``share`` are no numbers."""
    for i in range(max(map(len, rows), default=0)):
        got = [r[i] for r in rows[:30] if len(r) > i and (r[i] or "").strip()]
        if len(got) >= seen and sum(not re.fullmatch(r"[-+']?[\d.,:%$]+", g.strip()) for g in got) > share * len(got):
            return i
    return None
