"""Club spellings folded to codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of spellings beyond this many rows is no list of clubs.
MOST_SPELLINGS = 10_000


def spelling_maps(teams: DataFrame, coded: tuple[str, ...] = ("code", "short", "old")) -> tuple[dict[str, str], dict[str, str]]:
    """(nicknames in lower case, code spellings in capitals), each to the club's code, from ``spelling, code, kind``.

    Kinds in ``coded`` are other codes, all others names. Of repeated spellings the least code counts. The list
    is read as literals, so it may not have more than ``MOST_SPELLINGS`` rows.
    """
    rows = teams.where("spelling is not null and code is not null").select("spelling", "code", "kind").limit(MOST_SPELLINGS + 1).collect()
    if len(rows) > MOST_SPELLINGS:
        raise ValueError(f"more than {MOST_SPELLINGS} spellings of clubs")
    names: dict[str, str] = {}
    codes: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r["code"], reverse=True):
        if r["kind"] in coded:
            codes[r["spelling"].strip().upper()] = r["code"]
        else:
            names[r["spelling"].strip().lower()] = r["code"]
    return names, codes


def _lookup(c: Column, of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[c] if of else F.lit(None).cast("string")


def normalize_team(c: Column, names: dict[str, str], codes: dict[str, str]) -> Column:
    """A club's code: by name, else by another code, else the text in capitals; '' for null and blank."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").otherwise(F.coalesce(_lookup(F.lower(t), names), _lookup(F.upper(t), codes), F.upper(t)))


def is_known_team(code: Column, known: list[str]) -> Column:
    """Whether a code is one of the league's; null is not."""
    return F.coalesce(code.isin(*known), F.lit(False)) if known else F.lit(False)
