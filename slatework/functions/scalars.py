"""Scalar functions as JVM-side column expressions."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that stand for "no value", position codes and name suffixes.
BLANKS = ("", "-", "--", "—", "–", "n/a", "na", "null", ".", "none")
POSITIONS = ("C", "LW", "RW", "D", "G")
SUFFIX_WORDS = ("jr", "sr", "ii", "iii", "iv")


def finite_or(x: object, other: float) -> float:
    """A setting as a finite number; ``other`` for anything else."""
    try:
        n = float(x)
    except (TypeError, ValueError):
        return other
    return n if math.isfinite(n) else other


def js_round(c: Column) -> Column:
    """Round half up towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def truthy(c: Column) -> Column:
    """Present, not NaN and not zero."""
    d = c.cast("double")
    return F.coalesce(d.isNotNull() & ~F.isnan(d) & (d != 0), F.lit(False))


def parse_number(c: Column, lenient: bool = True) -> Column:
    """Text to double; null for blanks, for anything unreadable and for non-finite values.

    Strips thousands commas and one leading apostrophe. ``lenient`` also strips ``$`` and ``%`` and
    reads ``m:ss`` as decimal minutes; strict mode does not.
    """
    t = F.regexp_replace(F.trim(c), "^'", "")
    t = F.regexp_replace(t, "[,$%]" if lenient else ",", "")
    plain = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    plain = F.when(F.abs(plain) <= 1.7976931348623157e308, plain)
    if not lenient:
        return F.when(F.lower(F.trim(c)).isin(*BLANKS), F.lit(None)).otherwise(plain)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    clock = F.regexp_extract(t, r"^[+-]?([0-9]+):[0-9]{1,2}$", 1).try_cast("double") + F.regexp_extract(t, r":([0-9]{1,2})$", 1).try_cast("double") / 60.0
    return F.when(F.lower(F.trim(c)).isin(*BLANKS), F.lit(None)).when(t.rlike(r"^[+-]?[0-9]+:[0-9]{1,2}$"), sign * clock).otherwise(plain)


def parse_positions(c: Column, default: bool = False) -> Column:
    """Position text to an ordered, repeat-free code list.

    Splits at comma and slash; ``F`` stands for C, LW, RW, ``W`` for LW, RW, ``L``/``R`` for the wing;
    unknown codes are dropped. Null or empty gives ``[]``, or ``['C']`` with ``default``.
    """
    raw = F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z,/]", ""), "[,/]")
    code = lambda *x: F.array(*[F.lit(i) for i in x])
    wide = F.flatten(
        F.transform(
            raw,
            lambda p: F.when(p == "F", code("C", "LW", "RW")).when(p == "W", code("LW", "RW")).when(p == "L", code("LW")).when(p == "R", code("RW")).otherwise(F.array(p)),
        )
    )
    out = F.array_distinct(F.filter(wide, lambda p: p.isin(*POSITIONS)))
    return F.when(F.size(out) == 0, code("C")).otherwise(out) if default else out


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def name_key(c: Column) -> Column:
    """A comparable name: compatibility-decomposed, ASCII only, lower case, no ``. ' ```, hyphens as
    spaces, no suffix words, single spaces. Parentheses stay. Null stays null.
    """
    t = F.regexp_replace(F.lower(_nfkd(c)), "[.'`]", "")
    t = F.regexp_replace(t, "-", " ")
    t = F.regexp_replace(t, rf"\b({'|'.join(SUFFIX_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def surname(key: Column) -> Column:
    """Last word of a name key, ignoring words that open a parenthesis; '' if there is none."""
    words = F.filter(F.split(key, " "), lambda w: ~w.startswith("(") & (w != ""))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.when(key.isNotNull(), F.lit("")))


def ordinal(n: Column) -> Column:
    """``1st 2nd 3rd 4th 11th …``."""
    ten, one = n % 100, n % 10
    end = F.when(ten.between(11, 13), "th").when(one == 1, "st").when(one == 2, "nd").when(one == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def escape_html(c: Column) -> Column:
    """``& < > "`` as entities."""
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def level_label(level: Column) -> Column:
    """A level as that many plus or minus signs, '' for 0 or null."""
    n = F.abs(F.coalesce(level, F.lit(0))).cast("int")
    return F.when(level > 0, F.repeat(F.lit("+"), n)).otherwise(F.repeat(F.lit("−"), n))


def rounded(c: Column, digits: int = 6) -> Column:
    """Half-even, as interchange files hold numbers: 6 digits for statistics, 1 for ages and picks."""
    return F.bround(c, digits)


def heading_key(c: Column) -> Column:
    """A comparable heading: lower case, only letters, digits and ``+ - / %``, single spaces, no leading apostrophe."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, "^'+", "")), r"[^a-z0-9+\-/%]+", " ")
    return F.trim(t)
