"""Evaluation texts leaking into training text, by pigeonhole edit matching.

A test passage is any window of ``min_words`` consecutive words of a test item. With an error budget
of ``k`` word edits, a window is split into ``k + 1`` pieces; a document that holds the window with at
most ``k`` edits holds one of its pieces exactly. All pieces of a block of items are one sorted array
of hashes, broadcast under a stated bound; every document is scanned for exact piece hits where it
is read, without a shuffle, hits are extended to whole exact runs, and windows around a run are
verified with Myers' bit-parallel edit distance over words. More items than one block holds are
matched block by block against all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
# Letters whose stroke counts as an accent though Unicode does not decompose them.
STROKES = str.maketrans({"ø": "o", "ł": "l"})
MULTIPLIER = 0x9E3779B97F4A7C15
#: Words of items per broadcast block: about 24 bytes each, so some 50 MB at most.
BLOCK_WORDS = 2_000_000


def plain_words(text: str | None) -> list[str]:
    """Runs of letters and digits without case, accents and invisible marks; ``ø`` and ``ł`` are ``o`` and ``l``."""
    if not text:
        return []
    if not text.isascii():
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
        text = "".join(c for c in t if c.isascii() or unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cf")).translate(STROKES)
    else:
        text = text.lower()
    return WORD.findall(text)


def word_hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``seen`` is a cache that is emptied when it grows large."""
    if len(seen) > 500_000:
        seen.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(MULTIPLIER) + h[j : len(h) - n + 1 + j]
            out ^= out >> np.uint64(29)
    return out


def myers(pattern: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance between ``pattern`` and any stretch of ``text`` (Myers 1999, over words)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        peq[w] = peq.get(w, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for w in text.tolist():
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best = score
    return best


class ItemBlock:
    """Pieces of a block of items, ready to be broadcast."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, errors: int):
        self.min_words, self.errors = min_words, errors
        self.piece = min_words // (errors + 1)
        seen: dict[str, int] = {}
        self.ids, self.words = [], []
        grams, owner, at = [], [], []
        for item_id, text in items:
            h = word_hashes(plain_words(text), seen)
            if len(h) < min_words:
                continue
            g = gram_hashes(h, self.piece)
            grams.append(g)
            owner.append(np.full(len(g), len(self.ids), np.int32))
            at.append(np.arange(len(g), dtype=np.int32))
            self.ids.append(item_id)
            self.words.append(h)
        grams_ = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(grams_, kind="stable")
        self.grams = grams_[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int32))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int32))[order]

    def search(self, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(item_id, run, errors, doc_at, item_at)`` of every verified exact run in one document."""
        g = gram_hashes(doc, self.piece)
        if not len(g) or not len(self.grams):
            return []
        lo = np.searchsorted(self.grams, g, "left")
        hits = np.flatnonzero((lo < len(self.grams)) & (self.grams[np.minimum(lo, len(self.grams) - 1)] == g))
        if not len(hits):
            return []
        done: set[tuple[int, int, int]] = set()
        out = []
        for i in hits.tolist():
            e = int(lo[i])
            while e < len(self.grams) and self.grams[e] == g[i]:
                own, j = int(self.owner[e]), int(self.at[e])
                e += 1
                item = self.words[own]
                if i and j and doc[i - 1] == item[j - 1]:
                    continue  # not the start of its run
                if (own, i, j) in done:
                    continue
                done.add((own, i, j))
                n = min(len(doc) - i, len(item) - j)
                differ = np.flatnonzero(doc[i : i + n] != item[j : j + n])
                run = int(differ[0]) if len(differ) else n
                if run < self.piece:
                    continue  # two different runs with one hash
                errors = self._verify(doc, item, i, j, run)
                if errors <= self.errors:
                    out.append((self.ids[own], run, errors, i, j))
        return out

    def _verify(self, doc: np.ndarray, item: np.ndarray, i: int, j: int, run: int) -> int:
        m, k = self.min_words, self.errors
        if run >= m:
            return myers(item[j : j + m], doc[i : i + m])
        best = m
        for s in range(max(0, j + run - m), min(j, len(item) - m) + 1):
            start = i - (j - s) - k
            best = min(best, myers(item[s : s + m], doc[max(0, start) : start + m + 2 * k]))
            if not best:
                break
        return best


FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("run", T.IntegerType()), T.StructField("errors", T.IntegerType()), T.StructField("doc_at", T.IntegerType()), T.StructField("item_at", T.IntegerType())]
)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_words`` words, each block collected by itself.

    Words are counted as they are cut, at every sign; a sign that may decompose into another word counts as one.
    """
    slim = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    plain = F.length("t") == F.octet_length("t")
    parts = F.size(F.split("t", r"[^\p{L}\p{N}]+"))
    total = slim.agg(F.sum(F.when(plain, parts).otherwise(parts + F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", ""))))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for b in range(n):
        part = slim if n == 1 else slim.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
        yield [(r["i"], r["t"]) for r in part.distinct().collect()]


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 10, errors: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every place where a document holds ``min_words`` words of an item with at most ``errors`` word edits.

    Input: ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are ignored. Output: ``doc_id,
    item_id, run`` (length of the exact run of words), ``errors`` (word edits of the best window around it),
    ``doc_at, item_at`` (word positions of the run). Null texts hold no words; items shorter than
    ``min_words`` words are no passages; repeated documents are each reported. Long texts are scanned
    whole.
    """
    if errors < 0 or min_words < 2 * (errors + 1):
        raise ValueError("pieces need two words at least")
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    out = None
    for block in item_blocks(items, "item_id", "text", block_words):
        shared = spark.sparkContext.broadcast(ItemBlock(block, min_words, errors))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, seen = shared.value, {}
            for pdf in batches:
                rows = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for hit in index.search(word_hashes(plain_words(t), seen))]
                yield pd.DataFrame(rows, columns=FOUND.names)

        found = slim.mapInPandas(scan, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = 10) -> DataFrame:
    """``doc_id, item_id`` wherever the two share ``min_words`` consecutive words exactly."""
    found = find_leaks(docs, items, min_words)
    return found.where(F.col("run") >= min_words).select("doc_id", "item_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame, min_words: int = 10, errors: int = 1) -> DataFrame:
    """One row per item that leaked: documents with an exact and with an edited passage, and the longest run."""
    found = find_leaks(docs, items, min_words, errors).groupBy("item_id", "doc_id").agg(F.max("run").alias("run"), F.min("errors").alias("errors"))
    exact = F.col("run") >= min_words
    return found.groupBy("item_id").agg(F.count_if(exact).alias("exact_docs"), F.count_if(~exact).alias("edited_docs"), F.max("run").alias("longest_run"))
