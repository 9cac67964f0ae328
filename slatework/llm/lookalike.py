"""Visually identical text with different characters.

Every value is mapped to what it looks like (look-alike letters to the Latin ones, odd spaces to a
plain space, invisible characters to nothing). Mapped values are grouped in SQL under Spark's
accent-sensitive Unicode collation, in which composed and decomposed accents are equal. The canonical
member of a class is a stored value in ordinary spelling if there is one, else the composed mapped
value; it is joined back to the stored values.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts, and signs, that look like the Latin ones beside them.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï", "Ѵ": "V", "Ү": "Y",
}
GREEK = {
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "τ": "t", "ω": "w", "η": "n", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
SIGNS = {
    "’": "'", "‘": "'", "ʼ": "'", "ʹ": "'", "′": "'", "＇": "'", "`": "'", "´": "'", "ʻ": "'", "‛": "'",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "－": "-", "⁃": "-",
    "‚": ",", "，": ",", "．": ".", "․": ".", "（": "(", "）": ")",
    "ɑ": "a", "ɡ": "g", "ꞌ": "'",
}
#: Code points seen as a space, and such as are not seen at all.
SPACES = (0x09, 0x0A, 0x0D, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
INVISIBLE = (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFE0E, 0xFE0F, 0xFEFF)


@lru_cache(maxsize=1)
def _shapes() -> dict[str, str]:
    out = {chr(c): " " for c in SPACES} | {chr(c): "" for c in INVISIBLE} | CYRILLIC | GREEK | SIGNS
    for c in [*range(0xFF01, 0xFF5F), *range(0x2100, 0x2150), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D800), *range(0x2070, 0x20A0), 0x212A, 0x212B]:
        t = unicodedata.normalize("NFKC", chr(c))
        if t != chr(c) and t.isascii() and t.strip():
            out.setdefault(chr(c), t)
    return out


#: Character -> what it looks like in ordinary spelling ('' if nothing is seen).
SHAPES = _shapes()

#: Ordinary spelling: ASCII, and composed letters of the Latin alphabet.
ORDINARY = r"^[\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u1E00-\u1EFF]*$"


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


# Signs that are read as words, but look like none; they stay as they are.
WORD_SIGNS = "℀℁℅℆№℠℡™℻"


def looks_like(c: Column) -> Column:
    """The text with every look-alike, odd space and invisible character mapped; nothing else changes."""
    one = {k: v for k, v in SHAPES.items() if len(v) == 1}
    more = {k: v for k, v in SHAPES.items() if len(v) > 1 and k not in WORD_SIGNS}
    gone = [k for k, v in SHAPES.items() if not v]
    out = F.translate(c, "".join(one) + "".join(gone), "".join(one.values()))
    wide = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), more.items(), out)
    return F.when(c.rlike(f"[{''.join(more)}]"), wide).otherwise(out)


def in_other_script(c: Column) -> Column:
    """Whether all letters are of one script that is not the Latin one."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    only = lambda script: letters.rlike(rf"^\p{{Is{script}}}+$")
    return ~letters.rlike(r"\p{IsLatin}") & (only("Cyrillic") | only("Greek") | ~letters.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")) & (letters != "")


def canonical_forms(values: DataFrame, col: str = "value") -> DataFrame:
    """``values`` (one text column, repeats allowed) with ``form``, in which equal-looking texts are equal.

    Rows come out once per distinct text. Letter case and the number of plain spaces are kept apart.
    Texts in ordinary spelling are their own form; null has the form null; '' is its own form.
    """
    each = values.select(F.col(col).alias("value")).distinct()
    odd = ~F.coalesce(F.col("value").rlike(ORDINARY), F.lit(True))
    mapped = each.withColumn("mapped", F.when(odd, looks_like(F.col("value"))).otherwise(F.col("value")))
    mapped.createOrReplaceTempView("_slatework_mapped")
    classes = each.sparkSession.sql(
        f"""
        SELECT min(CASE WHEN value RLIKE '{ORDINARY}' THEN value END) AS stored, min(mapped) AS composable,
               collate(mapped, 'UNICODE') AS class
        FROM _slatework_mapped WHERE value IS NOT NULL GROUP BY collate(mapped, 'UNICODE')
        """.replace("\\", "\\\\")
    )
    classes = classes.select("class", F.coalesce("stored", _composed("composable")).alias("form"))
    joined = mapped.withColumn("class", F.collate("mapped", "UNICODE")).join(classes, "class", "left")
    return joined.select("value", F.when(odd, F.col("form")).otherwise(F.col("value")).alias("form"))


def odd_spellings(values: DataFrame, key: list[str], col: str) -> DataFrame:
    """``key`` and ``form`` of the rows whose text looks like an ordinary spelling but is stored otherwise.

    Texts wholly in another script and texts whose look is not ordinary are no such rows, nor are null
    and empty ones.
    """
    odd = values.select(*key, F.col(col).alias("value")).where(~F.col("value").rlike(ORDINARY) & ~in_other_script(F.col("value")))
    forms = canonical_forms(values, col).where(~F.col("value").rlike(ORDINARY))
    out = odd.join(forms, "value")
    return out.where((F.col("form") != F.col("value")) & F.col("form").rlike(ORDINARY)).select(*key, "value", "form")
