"""Template residue, filler, error pages and script notices in place of content.

Seeds: patterns of unfilled places, which mark their document wherever they stand, and of filler,
error and script notices, which also label the segment (line or sentence) they stand in. Labels spread over two kinds of
links. Near-duplicates: distinct segments get a SimHash over their
five-word shingles, kept in partitioned tables (one per band of bits and class of size); labelled segments meet the
unlabelled ones of their buckets, pairs are verified by Hamming distance and then by shingle similarity. The twin
of a seed must also share ``AROUND`` of the shingles that touch the seed's notice, so that a sentence does not become residue by
a copy that has a notice in it. Company: a segment that recurs in several different texts nearly all of which hold a seed is
part of the same pages, so notices in words that no pattern knows are found by the known ones beside them. Labels go
from neighbour to neighbour until a round adds none, which labels whole connected components without ever pairing
unlabelled segments with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.llm.leakage import gram_hashes, word_hashes
from slatework.session import discard, store

SHINGLE, SIMILAR = 5, 0.8


def _any(patterns: tuple[str, ...]) -> str:
    return "(?:" + "|".join(patterns) + ")"


#: A fingerprint has WORDS times 64 bits, of which every word gives BANDS tables keyed by BAND_BITS bits. At a similarity
#: of 0.8 a bit differs with probability 0.15: 24 tables of 10 bits miss one pair in 170, a radius of 54 of 256 bits one in 200.
WORDS, BANDS, BAND_BITS, RADIUS = 4, 6, 10, 54
#: Part of the shingles around a seed's notice that a twin must have.
AROUND = 0.5
#: A segment in company: its words, the different texts that hold it, and the part of them that hold a seed.
COMPANY_WORDS, COMPANY_TEXTS, COMPANY_SHARE = 3, 5, 0.9
#: Up to so many segments a round's front is broadcast (72 rows of some 110 bytes each, 40 MB, whatever its texts); a larger one is shuffled.
FRONT = 5_000

# Words of the usual filler Latin.
LATIN_FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua aliquet commodo congue curae "
    "egestas fermentum lacinia mattis molestie nullam porta pulvinar rutrum sagittis semper tincidunt ultrices varius vestibulum viverra"
).split()
# Of these, the words that plain texts hold as well; the search ahead of the patterns looks for two of them in a row.
COMMON_FILLER = ("sit", "sed")
# Syntaxes of unfilled places. Case counts, but for the words in (?i:).
PLACES = (
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^%\n]{1,60}%\}", r"<%=?[^%\n]{1,60}%>", r"[$#]\{[\p{L}_][\w.]*\}", r"\{![\w .]+!\}", r"\{[\p{L}_]\w{2,}\}", r"\{[0-9]{1,2}\}",
    r"%\(\w+\)[sdSD]", r"(?<![0-9%])%[sdSD](?![\p{L}0-9])", r"%[A-Z][A-Z_]{2,}%", r"\$[A-Z][A-Z_]{2,}\$", r"~[A-Z][A-Z_]{2,}~", r"@@[A-Z][A-Z_]{2,}@@", r"__[A-Z][A-Z_]*[A-Z]__", r"\*\|[A-Z_]+\|\*",
    r"\[\[[\w ]+\]\]", r"<<[\w ]+>>", r"\[(?i:insert|your) [\w ]+\]", r"\[(?!(?:SIC|LW|RW|QUOTE)\])[A-Z][A-Z_]+\]", r"<[A-Z][A-Z_]{2,}>", r"<!--[^>]{1,80}-->",
    r"\((?i:\w+ TBD)\)", r"\(\([\p{L}_][\w ]*\)\)", r"\bTK TK\b", r"\b(?i:firstname lastname)\b", r"\[(?i:object object)\]", r"\bNaN\b",
    r"(?<!\b(?i:left|leave|remains|remained|still) )\b(?i:undefined)\b(?! (?i:roles?|terms?|behaviou?rs?|variables?|values?|results?)\b)",
)
#: A place that is the subject of the sentence, not a gap in it.
MENTION = r"(?i)\b(?:field|variable|tag|token|macro|template)\b[^.!?\n]{0,60}\bcalled\s+[\"'`“]?(?:\{\{[^{}\n]{1,60}\}\}|[$#]?\{\w+\}|\[\[\w+\]\]|%\w+%|<\w+>)"
# Notices, in lower case.
ERRORS = (
    r"\b[45][0-9][0-9] (?:not found|forbidden|unauthorized|bad (?:request|gateway)|internal server error|service unavailable|gateway time-?out)\b",
    r"\b(?:error|erreur|fehler|felkod)\s*:?\s*[45][0-9][0-9]\b", r"\baccess denied\b(?! to\b)", r"\ban administrator has been notified\b", r"\bchecking that the connection is secure\b",
    r"\bdatabase connection failed\b", r"\binternal (?:server )?error\s*(?:[.:!(\n]|$)", r"\blog in again to continue\b", r"\bpage introuvable\b", r"\bseite nicht gefunden\b", r"\bsidan kunde inte hittas\b",
    r"(?:^|[.!?:;\n)])[^\p{L}\n]*please,? try again (?:later|in a few minutes)\b", r"\brequest id: [0-9a-f]{6,}", r"\bretour à l[’']accueil\b", r"\b(?:service|page|site|server|content)(?: is)?(?: currently| temporarily)+ unavailable\b", r"\bist gerade nicht erreichbar\b", r"\bslow down and retry after\b",
    r"\bsomething went wrong on our end\b", r"\bpage you were looking for could not\b", r"\barticle has been moved or deleted\b", r"\btoo many requests\b", r"\btraceback: ", r"\brender aborted\b",
    r"\byou do not have permission to (?:view|access)\b", r"\bsession has expired\b",
)
SCRIPTS = (
    r"\b(?:enable|activate|allow|turn on|switch on|activer|autoriser|aktivera|aktivieren(?: sie)?) (?:le |les )?(?:javascript|scripts?|scripting)\b",
    r"\bjavascript (?:turned on|appears to be|is (?:disabled|off|required)|must be)\b", r"\bscripts (?:must be allowed|are blocked)\b", r"\bbrowser (?:with scripting|does not support scripts)\b",
    r"\bswitch to a supported browser\b", r"\bbesoin de scripts\b", r"\beingeschalteten skripten\b", r"\bnoscript: ",
)
FILLER = (
    rf"(?:\b(?:{'|'.join(LATIN_FILLER)})\b[\s,.;]*){{4,}}", r"\b(?:asdf\s+){2,}", r"\b(?:x{2,6}\s+){2,}x{2,6}\b", r"\bbody copy to come\b", r"\bdummy text\s*(?:[,.:;!\n]|$)", r"\bhär kommer texten\b",
    r"\bplaceholder text\b", r"\bplaceholder for (?:[\p{L}'’.-]+ ){1,6}(?:preview|recap|report|story|text|image|copy|headline|caption)\b", r"\breplace it with your own\b", r"\bplatzhaltertext\b", r"\b(?:text|copy|content) goes here\b", r"\byour content here\b", r"\btexte à venir\b", r"\btodo: ",
    r"\bwrite two to three sentences\b",
)


NOTICES = _any(ERRORS + SCRIPTS + FILLER)
SPLIT = r"(?<=[.!?])\s+|\n+"
# Every place, and every notice, holds one of these; a plain search for them spares most texts the patterns.
PLACE_SIGNS = ("{", "%", "<", "$", "~", "@@", "__", "*|", "[", "((", "tbd)", "tk tk", "firstname", "undefined", "nan")
NOTICE_SIGNS = (
    *(w for w in LATIN_FILLER if w not in COMMON_FILLER), "not found", "forbidden", "unauthorized", "bad request", "gateway", "server error", "service unavailable", "error", "erreur", "fehler", "felkod", "access denied", "administrator",
    "connection is secure", "connection failed", "log in again", "introuvable", "nicht gefunden", "inte hittas", "try again", "request id", "accueil", "slow down", "went wrong",
    "unavailable", "erreichbar", "looking for could", "moved or deleted", "too many requests", "traceback", "render aborted", "have permission", "has expired", "script", "skript", "supported browser", "asdf", "xx", "body copy", "dummy text",
    "kommer texten", "placeholder", "replace it with", "platzhalter", "goes here", "content here", "texte à venir", "todo: ", "to three sentences",
)


def _holds_any(text: Column, signs: tuple[str, ...]) -> Column:
    """Whether the text holds one of the signs: plain searches, stopped by the first hit."""
    return reduce(Column.__or__, [text.contains(x) for x in signs])


def has_notice(low: Column) -> Column:
    """Whether a lower-case text holds filler, an error page's message or a script notice."""
    common = "|".join(COMMON_FILLER)
    only_common = _holds_any(low, COMMON_FILLER) & low.rlike(rf"\b(?:{common})[\s,.;]+(?:{common})\b")
    return (_holds_any(low, NOTICE_SIGNS) | only_common) & low.rlike(NOTICES)


def has_unfilled_place(text: Column) -> Column:
    """Whether an unfilled template place stands in the text; one that is only talked about does not count."""
    bare = F.when(text.contains("called") | text.contains("CALLED"), F.regexp_replace(text, MENTION, " ")).otherwise(text)
    return _holds_any(F.lower(text), PLACE_SIGNS) & bare.rlike(_any(PLACES))


#: Stands for a notice that was cut out of a segment.
GAP = "\ue000"


def segments(docs: DataFrame) -> DataFrame:
    """The lines and sentences of every text as ``seg``, lower case, with digits as 0 and single spaces; other columns stay.

    ``docs`` has ``text`` and ``notice``; of texts with one, ``rest`` is the segment with ``GAP`` in place of its
    notices, and ``seed`` tells whether there are any. A text without words has one row with an empty ``seg``.
    """
    rest = [c for c in docs.columns if c != "text"]
    parts = docs.select(*rest, F.explode(F.split(F.lower("text"), SPLIT)).alias("raw"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[0-9]+(?:[.,][0-9]+)*", "0"), rf"[^\p{{L}}\p{{N}}'{GAP}]+", " "))
    parts = parts.select(*rest, plain(F.translate("raw", GAP, "")).alias("seg"), F.when(F.col("notice"), plain(F.regexp_replace("raw", NOTICES, f" {GAP} "))).alias("rest"))
    return parts.withColumn("seed", F.coalesce(F.col("rest").contains(GAP), F.lit(False)))


def _shingles(c: Column) -> Column:
    words = F.split(c, " ")
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _around(seg: Column, rest: Column) -> Column:
    """The shingles of a segment that touch its notices; all of them where ``rest`` is null."""
    clear = F.filter(F.split(rest, GAP), lambda piece: F.size(F.split(F.trim(piece), " ")) >= SHINGLE)
    free = F.flatten(F.transform(clear, lambda piece: _shingles(F.trim(piece))))
    return F.array_except(_shingles(seg), F.coalesce(free, F.array().cast("array<string>")))


@F.pandas_udf(T.ArrayType(T.LongType()))
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The number of a text's distinct five-word shingles (1, the whole text, if it is shorter) and their SimHash in words of 64 bits."""
    seen: dict[str, int] = {}
    for s in batches:
        grams, starts, at = [], [], 0
        for t in s:
            h = word_hashes((t or "").split(" "), seen)
            g = gram_hashes(h, min(SHINGLE, len(h)))
            some = set(g.tolist())
            grams.append(g if len(some) == len(g) else np.fromiter(some, np.uint64, len(some)))
            starts.append(at)
            at += len(grams[-1])
        if not starts:
            yield pd.Series([], dtype=object)
            continue
        flat, n = np.concatenate(grams), np.diff([*starts, at])[:, None]
        words = [n.ravel().astype(np.int64)]
        for w in range(WORDS):
            # Every word of the fingerprint is made of hashes of its own (splitmix64).
            x = flat + np.uint64(((w + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
            words.append(np.packbits(np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > n, axis=1).view(np.int64).ravel())
        yield pd.Series(list(np.stack(words, axis=1)))


def bands(df: DataFrame, reach: int) -> DataFrame:
    """One row per table: the ``band``, its ``bits`` and ``size``, the class of the number of shingles; ``reach`` more classes on either side.

    Sets of a similarity of SIMILAR or more differ by one class at most.
    """
    mask = F.lit((1 << BAND_BITS) - 1)
    each = [F.struct(F.lit(BANDS * w + k).alias("band"), F.shiftrightunsigned(F.col("hash")[w + 1], BAND_BITS * k).bitwiseAND(mask).alias("bits")) for w in range(WORDS) for k in range(BANDS)]
    size = F.floor(F.log(F.col("hash")[0].cast("double")) / F.log(F.lit(1.01 / SIMILAR))).cast("int")
    sized = df.withColumn("size", F.explode(F.array(*[size + i for i in range(-reach, reach + 1)])) if reach else size)
    return sized.select("*", F.inline(F.array(*each)))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return reduce(Column.__add__, [F.bit_count(a[w + 1].bitwiseXOR(b[w + 1])) for w in range(WORDS)])


def spread_labels(segs: DataFrame) -> DataFrame | None:
    """The segments in the same component as a seed, without the seeds: ``seg``; None if there are none.

    ``segs``: distinct ``seg``, with ``hash``, ``seed`` and ``rest`` as in ``segments``, null where the whole segment
    counts. A link is a pair within RADIUS bits whose sets of five-word shingles have a Jaccard similarity of
    SIMILAR or more; it must hold around a seed's notice as well. Every round adds a segment, so it ends.
    """
    # A text of less than SHINGLE words is its only shingle, so it has no twin but itself.
    long = segs.where(F.size(F.split("seg", " ")) >= SHINGLE)
    ident = lambda seg, x, y: (F.xxhash64(seg).alias(x), F.xxhash64(seg, F.lit(1)).alias(y))
    pool = long.where("not seed").select("hash", *ident("seg", "x", "y"))
    texts = long.where("not seed").select("seg", "hash", *ident("seg", "x", "y"))
    front = store(long.where("seed").select(F.col("seg").alias("from_seg"), F.col("hash").alias("from_hash"), "rest"))
    reached: DataFrame | None = None
    while True:
        n = front.count()
        if not n:
            return reached
        # Without texts, which would be held 72 times over by whoever builds the broadcast.
        keys = bands(front.select(F.col("from_hash").alias("hash"), *ident("from_seg", "from_x", "from_y")), 1).withColumnRenamed("hash", "from_hash")
        keys = F.broadcast(keys) if n <= FRONT else keys
        near = bands(pool, 0).join(keys, ["band", "bits", "size"]).where(distance(F.col("hash"), F.col("from_hash")) <= RADIUS)
        # Kept apart from the text comparison, which would else be made for every pair of a bucket.
        near = store(near.select("x", "y", "from_x", "from_y").distinct())
        a, b = _shingles(F.col("seg")), _shingles(F.col("from_seg"))
        same = F.size(F.array_intersect(a, b))
        around = _around(F.col("from_seg"), F.col("rest"))
        seeds = front.select("from_seg", "rest", *ident("from_seg", "from_x", "from_y"))
        alike = texts.join(near, ["x", "y"]).join(seeds, ["from_x", "from_y"]).where(same >= SIMILAR * (F.size(a) + F.size(b) - same))
        new = alike.where(F.size(F.array_intersect(a, around)) >= AROUND * F.size(around)).select("seg", "hash").distinct()
        if reached is not None:
            new = new.join(reached, "seg", "left_anti")
        new = store(new)
        discard(near, front)
        reached = new.select("seg") if reached is None else reached.union(new.select("seg"))
        front = store(new.select(F.col("seg").alias("from_seg"), F.col("hash").alias("from_hash"), F.lit(None).cast("string").alias("rest")))


def find_residue(docs: DataFrame) -> DataFrame:
    """``doc_id, place, notice, spread``: every document with residue, and by what it was found.

    ``place``: an unfilled template place; ``notice``: filler, an error or a script notice; ``spread``:
    a segment that keeps company with seeds, or is a near-duplicate, at any remove, of one that is labelled. Null and empty texts
    hold none. Texts are searched whole; repeated documents come out once per ``doc_id``.
    """
    slim = docs.select("doc_id", "text").where("text is not null and text != ''")
    marked = slim.select("doc_id", "text", F.xxhash64("text").alias("text_id"), has_unfilled_place(F.col("text")).alias("place"), has_notice(F.lower("text")).alias("notice"))
    lines = store(segments(marked))
    # Of texts under several ids one counts for the company.
    once = lines.where("seg != ''").groupBy("seg", "text_id").agg(F.max("seed").alias("seed"), F.max("notice").alias("beside"), F.min(F.when(F.col("seed"), F.col("rest"))).alias("rest"))
    each = once.groupBy("seg").agg(F.max("seed").alias("seed"), F.count("*").alias("texts"), F.count_if("beside").alias("beside"), F.min("rest").alias("rest"))
    company = (F.size(F.split("seg", " ")) >= COMPANY_WORDS) & (F.col("texts") >= COMPANY_TEXTS) & (F.col("beside") >= COMPANY_SHARE * F.col("texts"))
    distinct = store(each.select("seg", "rest", "seed", (~F.col("seed") & company).alias("company")).withColumn("hash", simhash("seg")))
    more = spread_labels(distinct.select("seg", "rest", (F.col("seed") | F.col("company")).alias("seed"), "hash"))
    # Other occurrences of a seed's own normal form, such as one with a comma in it, are labelled as well.
    own = distinct.where("seed or company").select("seg")
    labelled = (own if more is None else own.union(more)).distinct()
    extra = lines.join(labelled, "seg", "left_semi").select("doc_id", F.lit(False).alias("place"), F.lit(False).alias("notice"), (~F.col("notice")).alias("spread"))
    found = lines.where("place or notice").select("doc_id", "place", "notice", F.lit(False).alias("spread")).unionByName(extra)
    return found.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("place", "notice", "spread")])
