"""Garbled text from wrong character encodings, by a hidden Markov model.

States: one clean state and one per encoding pair (encoded as, decoded as), among them UTF-8 read
twice, and one for characters that were lost. Emissions: every state emits original characters by one
trigram model of the corpus' own names (counted over all rows); the clean state shows them as they
are, a pair's state shows the characters its wrong decoding makes of them. Transitions: text starts
clean, may enter one pair's state, and goes between the two freely, because a wrong decoding hits
the whole string. The best path (Viterbi) labels every character; a labelled span is replaced by its
state's inverse transform. Spans of lost characters stay as they are.
"""

from __future__ import annotations

import math
import os
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.llm.lookalike import SHAPES
from slatework.session import spread, store

# Encodings that text is written in and wrongly read as.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "mac_roman", "cp850", "cp437")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "iso8859-2", "mac_roman", "cp850", "cp437")
LOST = "�?"
#: Prior probability of a name being damaged, and of a UTF-8 pair among the damages.
DAMAGED, UTF8_SHARE = 0.02, 0.7
#: Log odds from which a damage counts if the corpus knows the restored words, and how much oftener it must know them.
NEAR, OFTENER = -7.5, 2
#: Probabilities of unlikely emissions: a look-alike, an unknown sign in the clean state, a damaged sign without its partner.
LOOKALIKE, STRANGE, ORPHAN, MIXED, ODD_CASE = 3e-3, 1e-7, 1e-4, 1e-2, 0.03
ORPHAN_LOG, MIXED_LOG, STAR_LOG = math.log(ORPHAN), math.log(MIXED), math.log(0.02)


#: Signs that only the UTF-8 pairs are taken to damage: elsewhere they would explain any letter away.
SIGNS = "’‘“”–—… ´"


def _letters() -> list[str]:
    return [chr(c) for c in range(0xC0, 0x180) if unicodedata.category(chr(c)).startswith("L")]


def _cyrillic() -> list[str]:
    return [chr(c) for c in range(0x400, 0x460)]


def _read_as(raw: bytes, enc: str) -> str | None:
    """Decoded as software does it: undefined bytes of the Windows pages become control characters."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            if not 0x80 <= b < 0xA0:
                return None
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=1)
def transforms() -> tuple[list[str], dict[str, list[tuple[int, str]]], dict[tuple[int, str], str]]:
    """(names of the pairs, shown text -> [(pair, original)], (pair, original) -> shown text).

    Shown texts also come in small and in capital letters, as later software may have made them.
    """
    pairs, shown, exact = [], {}, {}
    for w in WRITTEN:
        for r in READ:
            if w == r:
                continue
            pairs.append(f"{w}>{r}")
            _add(shown, exact, len(pairs) - 1, w, [r])
    for r in ("cp1252", "latin-1"):
        pairs.append(f"utf-8>{r} twice")
        _add(shown, exact, len(pairs) - 1, "utf-8", [r, r])
    return pairs, shown, exact


def _add(shown: dict, exact: dict, pair: int, written: str, read: list[str]) -> None:
    for o in _letters() + ([*SIGNS, *_cyrillic()] if written == "utf-8" else []):
        t: str | None = o
        for k, r in enumerate(read):
            try:
                t = _read_as(t.encode(written if k == 0 else "utf-8"), r)
            except UnicodeEncodeError:
                t = None
            if t is None:
                break
        if t is None or t == o or t.isascii():
            continue
        exact[pair, o] = t
        for v in {t, t.lower(), t.upper()}:
            if not v.isascii() and (pair, o) not in shown.setdefault(v, []):
                shown[v].append((pair, o))


# --------------------------------------------------------------------------------------------------
# language model

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz") | frozenset(c.lower() for c in _letters() if len(c.lower()) == 1)
KNOWN = LETTERS | frozenset(" .,'-()^")


def _symbol(c: str) -> str:
    """The model's symbol of an original character: ``#`` for any Cyrillic letter, ``*`` for what is unknown."""
    c = c.lower()[:1]
    return c if c in KNOWN else "#" if "Ѐ" <= c <= "џ" else "*"


def _grams(name: str) -> Iterable[tuple[str, str, str]]:
    a, b = "^", "^"
    for c in name:
        c = _symbol(c)
        yield a, b, c
        a, b = b, (c if c != " " else "^")


class Language:
    """An interpolated trigram model; at most ``len(KNOWN) ** 3`` counts, whatever the corpus."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.tri, self.bi, self.ctx2, self.ctx1, self.uni = {}, Counter(), Counter(), Counter(), Counter()
        for (a, b, c), n in counts.items():
            if c in "*#":
                continue
            self.tri[a, b, c] = n
            self.bi[b, c] += n
            self.ctx2[a, b] += n
            self.ctx1[b] += n
            self.uni[c] += n
        self.n = max(1, sum(self.uni.values()))
        self.cache: dict[tuple[str, str, str], float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        if c == "#" or (b == "#" and c in LETTERS):
            # Words don't switch scripts; within one the letters are taken as equally likely.
            return -3.5 if c == "#" and b in "#^*-'" else -12.0
        got = self.cache.get((a, b, c))
        if got is None:
            n2, n1 = self.ctx2.get((a, b), 0), self.ctx1.get(b, 0)
            l2, l1 = n2 / (n2 + 20.0), n1 / (n1 + 20.0)
            p1 = l1 * (self.bi.get((b, c), 0) / n1 if n1 else 0) + (1 - l1) * (self.uni.get(c, 0) + 0.02) / (self.n + 3)
            got = self.cache[a, b, c] = math.log(l2 * (self.tri.get((a, b, c), 0) / n2 if n2 else 0) + (1 - l2) * p1)
        return got


COUNTS = T.StructType([T.StructField("odd", T.BooleanType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType()), T.StructField("n", T.LongType())])


def is_odd(c: Column) -> Column:
    """Whether a name can be damaged at all: it isn't pure ASCII, or holds a question mark."""
    return (F.octet_length(c) != F.length(c)) | c.contains("?")


def count_grams(names: DataFrame) -> dict[bool, Counter]:
    """Trigram counts of ``name``, each counted ``k`` times, apart for odd names and others.

    Counts are summed per task first; what reaches the driver is bounded by the alphabet.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: Counter = Counter()
        for pdf in batches:
            for name, odd, k in zip(pdf["name"], pdf["odd"], pdf["k"], strict=True):
                for g in _grams(name):
                    got[odd, *g] += k
        yield pd.DataFrame([(*g, n) for g, n in got.items()], columns=COUNTS.names)

    rows = names.select("name", "odd", "k").mapInPandas(count, COUNTS).groupBy("odd", "a", "b", "c").agg(F.sum("n").alias("n"))
    out: dict[bool, Counter] = {False: Counter(), True: Counter()}
    for r in rows.collect():
        out[r["odd"]][r["a"], r["b"], r["c"]] = r["n"]
    return out


# --------------------------------------------------------------------------------------------------
# decoding


class Decoder:
    """Viterbi over one string. State: the pair in force (-1 none yet, -2 lost characters) and the last two original characters."""

    def __init__(self, language: Language, priors: dict[str, float] | None = None):
        self.lm = language
        self.pairs, self.shown, self.exact = transforms()
        self.longest = max(map(len, self.shown))
        self.damaged_signs = frozenset(c for s in self.shown for c in s)
        utf8 = [p.startswith("utf-8") for p in self.pairs]
        first = [DAMAGED * (UTF8_SHARE / sum(utf8) if u else (1 - UTF8_SHARE) / (len(utf8) - sum(utf8))) for u in utf8]
        self.enter = [math.log((priors or {}).get(p, q)) for p, q in zip(self.pairs, first, strict=True)]
        self.lost = math.log(DAMAGED * 0.05)
        self.seen: dict[tuple[str, str, str, bool], tuple[float, str]] = {}
        self.last: tuple[str, frozenset[int], list[dict]] = ("", frozenset(), [{(-1, "^", "^"): (0.0, None)}])

    def clean(self, a: str, b: str, c: str, after_small: bool) -> tuple[float, str]:
        """``_clean``, each case worked out once."""
        key = (a, b, c, after_small)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[key] = self._clean(a, b, c, after_small)
        return got

    def _clean(self, a: str, b: str, c: str, after_small: bool) -> tuple[float, str]:
        """Log-probability that the clean state shows ``c``, and the original character."""
        if c.isascii() and c not in LOST:
            s = _symbol(c)
            return (self.lm.log(a, b, s) if s != "*" else -8.0), s
        low = c.lower()
        if len(low) == 1 and low in LETTERS:
            odd = math.log(ODD_CASE) if after_small and c.isupper() else 0.0
            return self.lm.log(a, b, low) + odd, low
        if c in SHAPES:
            odd = math.log(ODD_CASE) if after_small and c.isupper() else 0.0
            s = _symbol(SHAPES[c][:1] or " ")
            if not SHAPES[c] or s == "*":
                return math.log(LOOKALIKE), b
            return self.lm.log(a, b, s) + math.log(LOOKALIKE) + odd, s
        return math.log(STRANGE), "*"

    def decode(self, name: str, own_script: frozenset[int]) -> tuple[float, int, list[tuple[int, int, str]]]:
        """(log odds of the best damaged over the best clean path, pair, spans of that path).

        The states up to where the name parts from the last one are kept; they hang on nothing that follows, so the result is the
        same in whatever order names come.
        """
        n = len(name)
        last, last_own, at = self.last
        kept = len(os.path.commonprefix([name, last]))
        kept = min([kept, *(own_script ^ last_own)])
        del at[kept + 1 :]
        at += [{} for _ in range(n - kept)]
        self.last = (name, own_script, at)
        clean, cases, log, enter = self.clean, self.seen, self.lm.log, self.enter
        for i in range(max(0, kept + 1 - self.longest), n):
            # Of the signs ahead of that place only those that reach beyond it are taken again.
            again = i < kept
            c, small = name[i], i > 0 and name[i - 1].islower()
            odd = not c.isascii()
            options = [(k, o, i + ln) for ln in range(kept - i + 1 if again else 1, min(self.longest, n - i) + 1) for k, o in self.shown.get(name[i : i + ln], ())] if odd else []
            if again and not options:
                continue
            by_pair: dict[int, list[tuple[str, str, float, int]]] = {}
            for k, o, end in options:
                by_pair.setdefault(k, []).append((o, _symbol(o), math.log(ODD_CASE) if small and o.isupper() else 0.0, end))
            own, mixed, orphan, lost, after = i in own_script, odd and c not in SHAPES, odd and c in self.damaged_signs, c in LOST, at[i + 1]
            for key, (score, _) in at[i].items():
                pair, a, b = key
                if own:
                    if not again:
                        self._put(after, (pair, "^", "^"), score - 3.0, key, i, None)
                    continue
                if not again:
                    s, o = cases.get((a, b, c, small)) or clean(a, b, c, small)
                    if pair >= 0 and mixed:
                        s += MIXED_LOG
                    new = (pair, b, o) if o not in " ^" else (pair, "^", "^")
                    total = score + s
                    old = after.get(new)
                    if old is None or total > old[0]:
                        after[new] = (total, (key, i, None))
                    if orphan and pair >= 0:
                        self._put(after, (pair, b, "*"), score + ORPHAN_LOG, key, i, c)
                    if lost and pair < 0:
                        self._put(after, (-2, b, "*"), score + (self.lost if pair == -1 else 0.0) - 3.0, key, i, c)
                for k in by_pair if pair == -1 else (pair,) if pair in by_pair else ():
                    start = score + enter[k] if pair == -1 else score
                    for orig, low, case, end in by_pair[k]:
                        p = log(a, b, low) if low != "*" else STAR_LOG
                        self._put(at[end], (k, b, low), start + p + case, key, i, orig)
        whole = max((s for (p, _, _), (s, _) in at[n].items() if p == -1), default=-1e9)
        worst = max(((s, k) for k, (s, _) in at[n].items() if k[0] != -1), default=None)
        if worst is None:
            return -1e9, -1, []
        spans, i, key = [], n, worst[1]
        while i:
            _, (back, start, shown) = at[i][key]
            if shown is not None:
                spans.append((start, i, shown))
            i, key = start, back
        return worst[0] - whole, worst[1][0], spans[::-1]

    @staticmethod
    def _put(at: dict, key: tuple, score: float, back: tuple, start: int, shown: str | None) -> None:
        old = at.get(key)
        if old is None or score > old[0]:
            at[key] = (score, (back, start, shown))


def own_script_positions(name: str) -> frozenset[int]:
    """Positions of words wholly in a non-Latin script: such words are written as they should be.

    A word of a text that was read in a Cyrillic code page looks Cyrillic too, but mixes in signs or
    capitals after small letters, and then is not taken as a word of its own script. Words made of
    look-alikes only count where another word of the text is surely of the other script.
    """
    words: list[tuple[int, int]] = []
    i, sure = 0, False
    while i < len(name):
        j = i
        while j < len(name) and not name[j].isspace() and name[j] not in ",.()":
            j += 1
        word = name[i:j]
        letters = [c for c in word if c.isalpha()]
        foreign = letters and all(not unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH")) for c in letters)
        even = all(c.isalpha() or c in "-'’" or unicodedata.category(c) in ("Mn", "Cf") for c in word)
        switch = any(b.isupper() and a.islower() for a, b in zip(letters, letters[1:], strict=False))
        if foreign and even and not switch:
            words.append((i, j))
            sure |= any(c not in SHAPES for c in letters)
        i = j + 1
    return frozenset(k for i, j in words for k in range(i, j)) if sure else frozenset()


LABEL = T.StructType(
    [T.StructField("pair", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("complete", T.BooleanType()), T.StructField("odds", T.DoubleType()), T.StructField("sure", T.BooleanType())]
)


def label_one(decoder: Decoder, name: str | None) -> tuple[str | None, str | None, bool, float, bool]:
    """(pair or null if clean, restored text, whether nothing was lost, log odds, whether these suffice)."""
    if name is None or (name.isascii() and "?" not in name):
        return None, name, True, -1e9, False
    odds, pair, spans = decoder.decode(name, own_script_positions(name))
    if odds <= NEAR or (odds <= 0 and pair < 0):
        return None, name, True, odds, False
    out, at, whole = [], 0, pair >= 0
    rest = "".join(c for c in name if c.isascii() and c.isalpha())
    capitals = len(rest) > 1 and rest.isupper()
    for s, e, o in spans:
        out.append(name[at:s])
        # A mark without its partner, or a lost character, has no inverse and stays.
        known = pair >= 0 and any(k == pair and v == o for k, v in decoder.shown.get(name[s:e], ()))
        whole &= known
        small = known and name[s:e] != decoder.exact[pair, o] and name[s:e] == decoder.exact[pair, o].lower()
        out.append((o.upper() if capitals else o.lower() if small else o) if known else name[s:e])
        at = e
    out.append(name[at:])
    return (decoder.pairs[pair] if pair >= 0 else "lost"), "".join(out), whole, odds, odds > 0


def _labeller(model: tuple[Language, dict[str, float] | None]):
    """An iterator function from names to labels; ``model`` is a broadcast."""

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder, seen = Decoder(*model.value), {}
        for s in batches:
            if len(seen) > 100_000:
                seen.clear()
            # In order, so that a name finds the states of its beginning where the one before has left them.
            for name in sorted({x for x in s if x is not None and x not in seen}):
                seen[name] = label_one(decoder, name)
            yield pd.DataFrame([label_one(decoder, x) if x is None else seen[x] for x in s], columns=LABEL.names)

    label.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(label, LABEL)


def _distinct(names: DataFrame) -> DataFrame:
    """``name, k, odd``: every name once, with the number of its rows. A name that most rows share is summed up per task first."""
    return names.where("name is not null").groupBy("name").agg(F.count("*").alias("k")).withColumn("odd", is_odd(F.col("name")))


def fit(names: DataFrame, col: str = "name") -> tuple[Language, dict[str, float]]:
    """The language and the pairs' prior probabilities, by one round of hard expectation-maximisation.

    A first pass over all names decodes with uniform priors; what it restores trains the language anew
    and how often it found each pair gives the prior. Rows count as often as they occur; only odd names
    are decoded, each once. Only bounded counts reach the driver.
    """
    each = store(_distinct(names.select(F.col(col).alias("name"))))
    counts = count_grams(each)
    first = names.sparkSession.sparkContext.broadcast((Language(counts[False] + counts[True]), None))
    seen = spread(each.where("odd")).select("name", "k", _labeller(first)("name").alias("d"))
    pair = F.when(F.col("d.sure"), F.col("d.pair"))
    seen = store(seen.select(pair.alias("pair"), F.when(pair.isNotNull(), F.col("d.restored")).otherwise(F.col("name")).alias("name"), "k", F.lit(True).alias("odd")))
    n = {r["pair"]: r["n"] for r in seen.groupBy("pair").agg(F.sum("k").alias("n")).collect()}
    total = sum(n.values()) + (each.where("not odd").agg(F.sum("k")).first()[0] or 0) + 1.0
    pairs, _, _ = transforms()
    restored = count_grams(seen.where("pair is null or pair != 'lost'"))[True]
    return Language(counts[False] + restored), {p: (n.get(p, 0) + 0.2) / total for p in pairs}


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s\p{Z},.()]+"), lambda w: F.length(w) > 2)


def damages(rows: DataFrame, col: str = "name", model: tuple[Language, dict[str, float]] | None = None) -> DataFrame:
    """``name, d``: every distinct damaged text of ``rows`` with its label as in ``label_names``.

    A path that is likely, but not surely damaged (``sure`` false) counts if every word it
    changes is known to the corpus at least twice as often restored as it is shown.
    """
    slim = rows.select(F.col(col).alias("name"))
    model = fit(slim) if model is None else model
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # Every odd text is labelled once; the few that come out damaged are what is joined back to the rows.
    seen = store(spread(_distinct(slim).where("odd")).select("name", _labeller(shared)(F.col("name")).alias("damage")))
    seen = seen.where("damage.pair is not null")
    near = seen.where("not damage.sure").select("name", F.col("damage.restored").alias("restored"))
    shown, restored = _words(F.col("name")), _words(F.col("restored"))
    pairs = near.select("name", F.explode(F.filter(F.arrays_zip(shown.alias("shown"), restored.alias("mended")), lambda z: ~z["shown"].eqNullSafe(z["mended"]))).alias("z"))
    pairs = store(pairs.select("name", F.lower("z.shown").alias("shown"), F.lower("z.mended").alias("mended")))
    wanted = pairs.select(F.col("shown").alias("word")).union(pairs.select("mended")).distinct()
    counts = slim.select(F.explode(_words(F.col("name"))).alias("word")).join(wanted, "word", "left_semi").groupBy("word").count()
    a = counts.select(F.col("word").alias("shown"), F.col("count").alias("n_shown"))
    b = counts.select(F.col("word").alias("mended"), F.col("count").alias("n_mended"))
    judged = pairs.join(a, "shown", "left").join(b, "mended", "left").groupBy("name")
    known = judged.agg(F.min(F.coalesce("n_mended", F.lit(0)) >= F.greatest(F.lit(2), OFTENER * F.coalesce("n_shown", F.lit(0)))).alias("known")).where("known")
    found = F.col("damage.sure") | F.coalesce("known", F.lit(False))
    return seen.join(known, "name", "left").where(found).select("name", F.col("damage").alias("d"))


def label_names(rows: DataFrame, key: str, col: str = "name", model: tuple[Language, dict[str, float]] | None = None) -> DataFrame:
    """``key, name`` and a struct ``damage``: ``pair`` (null if clean), ``restored``, ``complete``, ``odds``, ``sure``.

    ``pair`` names how the text was written and read, or ``lost`` where characters were replaced.
    ``restored`` equals the input where it is clean. ``complete`` is false where a part could not be
    restored. Null and empty texts are clean; repeated keys keep one row each.
    """
    slim = rows.select(F.col(key).alias("key"), F.col(col).alias("name"))
    rows_ = slim.join(damages(slim, "name", model), "name", "left")
    kept = F.struct(
        F.col("d.pair").alias("pair"), F.coalesce("d.restored", "name").alias("restored"), F.coalesce("d.complete", F.lit(True)).alias("complete"),
        F.col("d.odds").alias("odds"), F.coalesce("d.sure", F.lit(False)).alias("sure"),
    )
    return rows_.select(F.col("key").alias(key), F.col("name").alias(col), kept.alias("damage"))
