"""Mixing sources to target weights, by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' tokens are raked to the marginals
of all three, under the cap of each source; a document's expected number of copies is its cell's
multiplier. Copies are drawn by a hash of the document, and each source's threshold is calibrated
so that its tokens meet the target to within one document. Only the cell table and fixed-size
histograms reach the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.session import discard, hash01, store

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary's tokenizer cuts text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Terms and topics of the topic model.
TERMS, TOPICS = 4096, 8
#: Part of the largest feasible mix that is drawn, so that languages and topics leave room to be raked.
FILL = 0.9
#: A language with less than this part of all tokens is raked as "other".
LEAST_SHARE = 0.001
BINS = 4096


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with ``tokens``, the length of the whole text in tokens; 0 for null and empty texts."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(vocabulary).read_bytes().splitlines() if line)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        enc = tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return docs.withColumn("tokens", tokens("text"))


def count_terms(docs: DataFrame) -> DataFrame:
    """``docs`` with ``terms``, a sparse vector of the counts of its hashed words of four letters and more."""
    words = docs.withColumn("_w", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 3))
    return HashingTF(inputCol="_w", outputCol="terms", numFeatures=TERMS).transform(words).drop("_w")


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` stored in partitions and an order that come from ``doc_id`` alone."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(docs.repartition(n, "doc_id").sortWithinPartitions("doc_id"))


def assign_topics(docs: DataFrame, k: int = TOPICS, seed: int = 7) -> DataFrame:
    """``docs`` (with ``doc_id, terms``) with ``topic``, the nearest of ``k`` clusters of TF-IDF vectors, without ``terms``.

    Term weights and cluster centres are fitted on all documents. The first centres are drawn by partition and order of
    ``docs``: pass what ``placed`` gives, so that the same documents give the same centres. Without any document the topic is 0.
    """
    n = docs.count()
    rest = [c for c in docs.columns if c != "terms"]
    if not n:
        return docs.select(*rest, F.lit(0).alias("topic"))
    weighted = IDF(inputCol="terms", outputCol="_idf", minDocFreq=2).fit(docs).transform(docs)
    normed = Normalizer(inputCol="_idf", outputCol="features").transform(weighted)
    model = KMeans(k=k, seed=seed, maxIter=15).fit(normed.select("features"))
    return model.transform(normed).select(*rest, F.col("prediction").alias("topic"))


def rake(cells: pd.DataFrame, target: dict[str, float], cap: dict[str, float], fill: float = FILL, rounds: int = 500, tol: float = 1e-7) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with the multiplier ``weight`` of every cell.

    The mix has ``fill`` of the tokens of the largest mix whose sources can reach their shares. Languages
    and topics are raked to their shares of the eligible tokens, as far as caps allow; sources are raked
    last in every round, and exactly.
    """
    cells = cells.reset_index(drop=True)
    tokens = cells["tokens"].to_numpy(float)
    limit = cells["source"].map(cap).to_numpy(float)
    by_source = cells.groupby("source")["tokens"].sum()
    shares = {s: p for s, p in target.items() if p > 0 and by_source.get(s, 0) > 0}
    scale = sum(shares.values())
    if not shares:
        return cells.assign(weight=0.0)
    total = fill * min(cap[s] * by_source[s] / (p / scale) for s, p in shares.items())
    weight = cells["source"].map({s: min(cap[s], total * p / scale / by_source[s]) for s, p in shares.items()}).fillna(0.0).to_numpy(float)
    natural = {c: cells.groupby(c)["tokens"].sum() / tokens.sum() * total for c in ("lang", "topic")}
    wanted = {s: total * p / scale for s, p in shares.items()}

    def to_source(weight: np.ndarray) -> np.ndarray:
        weight = weight.copy()
        for s, goal in wanted.items():
            m = (cells["source"] == s).to_numpy()
            for _ in range(200):
                now = (weight[m] * tokens[m]).sum()
                if now <= 0 or abs(now - goal) <= 1e-12 * goal:
                    break
                weight[m] = np.minimum(weight[m] * goal / now, limit[m])
        return weight

    for _ in range(rounds):
        old = weight.copy()
        for c in ("lang", "topic"):
            now = pd.Series(weight * tokens).groupby(cells[c]).sum()
            factor = (natural[c] / now.where(now > 0)).fillna(1.0)
            weight = np.minimum(weight * cells[c].map(factor).to_numpy(float), limit)
        weight = to_source(weight)
        if np.abs(weight - old).max() <= tol:
            break
    return cells.assign(weight=weight)


def _thresholds(drawn: DataFrame, goals: dict[str, float]) -> dict[str, tuple[float, float]]:
    """For each source the ``order`` below which documents get their extra copy, by two rounds of histograms.

    ``drawn``: ``source, order`` in [0, 1), ``tokens``. The tokens below come to the goal from above by
    less than a bin of a bin, which holds a document or so.
    """
    lo = dict.fromkeys(goals, 0.0)
    width, left = 1.0, dict(goals)
    for _ in range(3):
        start = F.create_map(*[F.lit(x) for kv in lo.items() for x in kv])[F.col("source")]
        part = drawn.where((F.col("order") >= start) & (F.col("order") < start + F.lit(width)))
        hist = part.groupBy("source", F.least(F.floor((F.col("order") - start) / F.lit(width / BINS)), F.lit(BINS - 1)).alias("bin")).agg(F.sum("tokens").alias("n"))
        rows = hist.collect()
        for s in goals:
            got = sorted((r["bin"], r["n"]) for r in rows if r["source"] == s)
            at = 0
            for b, n in got:
                at = b
                if n > left[s]:
                    break
                left[s] -= n
                at = b + 1
            lo[s] += at * width / BINS
        width /= BINS
    return lo


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, fill: float = FILL, seed: int = 11) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, copies, expected``: every document with at least one copy.

    ``copies`` never exceeds its source's ``max_repeats``. Documents without a source, of a source
    without a target, or without tokens are not used. A source without documents leaves its share to
    the others. A null language is ``und``. Repeated targets of one source: the largest share counts.
    """
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r["source"]: (float(r["target_share"] or 0), float(r["max_repeats"] or 0)) for r in goal.collect()}
    slim = docs.select("doc_id", "text", "source", "lang").where(F.col("source").isin(*wanted) if wanted else F.lit(False))
    # The texts are read once, where they lie; what later passes need of them is kept.
    counted = placed(count_terms(count_tokens(slim, vocabulary)).drop("text").where("tokens > 0"))
    known = store(assign_topics(counted))
    discard(counted)
    langs = known.groupBy("lang").agg(F.sum("tokens").alias("n"))
    whole = langs.agg(F.sum("n")).first()[0] or 1
    common = [r["lang"] for r in langs.where(F.col("n") >= LEAST_SHARE * whole).collect() if r["lang"] is not None]
    lang = F.when(F.col("lang").isNull(), "und").when(F.col("lang").isin(*common) if common else F.lit(False), F.col("lang")).otherwise("other")
    known = known.withColumn("lang", lang)
    cells = known.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()
    if cells.empty:
        return known.select("doc_id", "source", "lang", "topic", "tokens", F.lit(0).alias("copies"), F.lit(0.0).alias("expected")).limit(0)
    raked = rake(cells, {s: p for s, (p, _) in wanted.items()}, {s: c for s, (_, c) in wanted.items()}, fill)
    weights = docs.sparkSession.createDataFrame(raked[["source", "lang", "topic", "weight"]], "source string, lang string, topic int, weight double")
    sure = F.floor(F.col("weight") + 1e-9)
    part = F.greatest(F.col("weight") - sure, F.lit(0.0))
    odds = hash01(F.col("doc_id"), seed=seed) / part
    drawn = known.join(weights, ["source", "lang", "topic"]).withColumn("sure", sure).withColumn("order", F.when(part > 1e-9, odds / (1.0 + odds)))
    drawn = store(drawn)
    sums = {r["source"]: r for r in drawn.groupBy("source").agg(F.sum(F.col("weight") * F.col("tokens")).alias("goal"), F.sum(F.col("sure") * F.col("tokens")).alias("base")).collect()}
    edge = _thresholds(drawn.where("order is not null").select("source", "order", "tokens"), {s: r["goal"] - r["base"] for s, r in sums.items()})
    start = F.create_map(*[F.lit(x) for kv in edge.items() for x in kv])[F.col("source")]
    copies = (F.col("sure") + F.when(F.col("order") < start, 1).otherwise(0)).cast("int")
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", copies.alias("copies"), F.col("weight").alias("expected")).where("copies > 0")


def mix_report(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, fill: float = FILL) -> DataFrame:
    """``dimension, value, target_share, share, tokens, documents, most_copies``: what the mix reached.

    One row per source with its target, and per language and topic (no target of their own).
    """
    drawn = store(mix(docs, targets, vocabulary, fill))
    used = F.col("tokens") * F.col("copies")
    rows = None
    for d in ("source", "lang", "topic"):
        r = drawn.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.sum(used).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
        rows = r if rows is None else rows.unionByName(r)
    goal = targets.groupBy(F.lit("source").alias("dimension"), F.col("source").alias("value")).agg(F.max("target_share").alias("target_share"))
    total = drawn.agg(F.sum(used)).first()[0] or 1
    out = rows.join(goal, ["dimension", "value"], "full")
    return out.select("dimension", "value", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.lit(total), 8).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
