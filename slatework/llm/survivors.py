"""Best representative of each duplicate group, by iterative truth discovery.

Rows claim values; sources have a reliability. Alternately, every entity's field takes the value
with the highest support (the sum of its claims' weights times their sources' reliability), and
every source's reliability becomes the share of its claims that agree with the elected values, until
no reliability moves. The claims are aggregated per entity, field, value and source before anything
else, so an entity with a third of all rows shuffles no more than its distinct claims.

Precedence can be built into the weights: the entity's claim that comes first in a stated order
keeps weight 1 and all its other claims share ``rest``. With
``rest < floor`` (the least reliability) the first claim outweighs all others together, whatever
the reliabilities, so the election follows the order strictly (``latest_survivors`` gives that without any rounds); with ``rest=None`` every claim has
weight 1 and the election is a plain reliability-weighted vote.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.session import discard, store


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the columns of ``a``, then the others of ``b``."""
    right = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def claims(rows: DataFrame, entity: str, source: list[Column], fields: dict[str, tuple[Column, Column]], precedence: Column) -> DataFrame:
    """One row per entity, field, value and source: ``n`` claims and the best ``precedence`` among them.

    ``fields`` maps a field name to (usable, value); unusable rows claim nothing. Values are compared
    as text. ``precedence`` is any orderable column, the greatest comes first.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.when(u, v.cast("string")).alias("value")) for f, (u, v) in fields.items()])
    src = F.concat_ws("\x1f", *[F.coalesce(s.cast("string"), F.lit("")) for s in source])
    flat = rows.select(F.col(entity).alias("entity"), src.alias("source"), precedence.alias("precedence"), F.explode(each).alias("c"))
    flat = flat.where(F.col("c.value").isNotNull())
    return flat.groupBy("entity", F.col("c.field").alias("field"), F.col("c.value").alias("value"), "source").agg(F.count("*").alias("n"), F.max("precedence").alias("precedence"))


def discover(claimed: DataFrame, rest: float | None = None, floor: float = 0.05, rounds: int = 50, tol: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(elected, reliability): the value of every entity and field, and every source's reliability by field.

    ``elected``: ``entity, field, value, support, share, precedence`` where ``share`` is the support's
    part of the field's whole support and ``precedence`` the best among the value's claims. Ties of
    support fall to the better precedence, then the greater text. ``rest`` as in the module's text;
    ``0 <= rest < floor`` is required for a strict order. Reliabilities stay within ``[floor, 1]``.
    Empty claims give empty results. Ends when no reliability moves by ``tol``; if some still do after ``rounds``, it warns.
    With ``rest`` the election does not hang on the reliabilities, so the second round already moves none.
    """
    if rest is not None and not 0 <= rest < floor:
        raise ValueError("rest must be below floor, else the first claim can be outvoted")
    base = claimed
    if rest is not None:
        whole = claimed.groupBy("entity", "field").agg(F.sum("n").alias("total"), F.max("precedence").alias("first"))
        base = _join(claimed, whole, ["entity", "field"])
        leads = F.col("precedence") == F.col("first")
        other = F.lit(rest) / F.greatest(F.col("total") - 1, F.lit(1))
        base = base.withColumn("weight", F.when(leads, 1.0 + (F.col("n") - 1) * other).otherwise(F.col("n") * other)).drop("total", "first")
    else:
        base = base.withColumn("weight", F.col("n").cast("double"))
    base = store(base)
    trust = store(base.groupBy("source", "field").agg(F.lit(0.8).alias("reliability")))

    def elect(trust: DataFrame) -> DataFrame:
        voted = base.join(trust, ["source", "field"]).groupBy("entity", "field", "value").agg(F.sum(F.col("weight") * F.col("reliability")).alias("support"), F.max("precedence").alias("precedence"))
        # Supports are sums of doubles: rounding makes ties ties in whatever order they were added.
        rank = F.struct(F.round("support", 9).alias("s"), F.col("precedence").alias("p"), F.col("value").alias("v"))
        best = voted.groupBy("entity", "field").agg(F.max(rank).alias("top"), F.sum("support").alias("all"))
        return best.select("entity", "field", F.col("top.v").alias("value"), F.col("top.s").alias("support"), (F.col("top.s") / F.col("all")).alias("share"), F.col("top.p").alias("precedence"))

    for _ in range(rounds):
        elected = elect(trust)
        judged = _join(base, elected.select("entity", "field", F.col("value").alias("won")), ["entity", "field"])
        # Smoothed by two claims of the starting reliability, so that a source seen once is neither perfect nor worthless.
        agreed = F.sum(F.when(F.col("value") == F.col("won"), F.col("n")).otherwise(0)) + 1.6
        new = store(judged.groupBy("source", "field").agg(F.greatest(F.lit(floor), agreed / (F.sum("n") + 2.0)).alias("reliability")))
        moved = new.join(trust.withColumnRenamed("reliability", "was"), ["source", "field"]).agg(F.max(F.abs(F.col("reliability") - F.col("was")))).first()[0]
        discard(trust)
        trust = new
        if moved is None or moved < tol:
            break
    else:
        warnings.warn(f"reliabilities still move by {moved} after {rounds} rounds", stacklevel=2)
    return elect(trust), trust.select("source", "field", "reliability")


#: Fixed values of the listings' fields: usable position codes and the ages that count.
FIELDS = ("team", "pos", "age")
POSITION_CODES = ("C", "LW", "RW", "D", "G")
AGES = (17, 50)


def _listing_fields(rows: DataFrame, teams: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, Column]], Column]:
    """The rows of ``source_row`` with their clubs' codes; (usable, value) of team, pos and age; the rows' precedence.

    A team is usable if, trimmed and without regard to case, it is a spelling of ``teams`` (its value
    is the club's code); positions with at least one code of C, LW, RW, D, G; an age from 17 to 50.
    Precedence: latest ``seen_at`` (null last), ``primary`` before other feeds, lowest ``row_id``.
    """
    spell = teams.select(F.lower(F.trim("spelling")).alias("_spell"), F.col("code").alias("_code")).groupBy("_spell").agg(F.min("_code").alias("_code"), F.lit(True).alias("_known"))
    slim = rows.select("row_id", "listing_id", "source_id", "feed", "team", "pos", "age", "seen_at").withColumn("_spell", F.lower(F.trim("team")))
    slim = slim.join(spell, "_spell", "left")
    codes = F.array_intersect(F.col("pos"), F.array(*[F.lit(p) for p in POSITION_CODES]))
    fields = {
        "team": (F.col("_known"), F.coalesce("_code", "_spell")),
        "pos": (F.size(codes) > 0, F.concat_ws("/", codes)),
        "age": (F.col("age").between(*AGES) & ~F.isnan("age"), F.round("age", 1)),
    }
    first = F.struct(F.col("seen_at"), F.coalesce(F.col("feed") == "primary", F.lit(False)).alias("primary"), (-F.col("row_id")).alias("neg_id"))
    return slim, fields, first


def listing_claims(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """Claims of team, pos and age by the rows of ``source_row`` about their listings (see ``_listing_fields``)."""
    slim, fields, first = _listing_fields(rows, teams)
    return claims(slim, "listing_id", [F.col("source_id"), F.col("feed")], fields, first)


def _wide(rows: DataFrame, elected: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """One row for each listing with two or more rows; ``cols`` are aggregates named ``<field>_<what>``."""
    groups = rows.groupBy(F.col("listing_id")).agg(F.count("*").alias("n_rows")).where("n_rows >= 2")
    per = elected.groupBy(F.col("entity").alias("listing_id")).agg(*[c.alias(k) for k, c in cols.items()])
    return _join(groups, per, ["listing_id"], "left")


def _of(field: str, what: Column) -> Column:
    return F.max(F.when(F.col("field") == field, what))


def latest_survivors(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """``listing_id, team_row_id, pos_row_id, age_row_id``: of each field the usable row that comes first, for each listing with two or more rows.

    -1 where no row of the listing is usable for the field. Rows with a null ``listing_id`` are one listing.
    The order leaves nothing to reliabilities, so none are sought: one aggregation gives what
    ``discover`` elects with ``rest``.
    """
    slim, fields, first = _listing_fields(rows, teams)
    best = slim.groupBy("listing_id").agg(F.count("*").alias("n_rows"), *[F.max(F.when(usable, first)).alias(f) for f, (usable, _) in fields.items()])
    return best.where("n_rows >= 2").select("listing_id", *[F.coalesce(-F.col(f"{f}.neg_id"), F.lit(-1).cast("long")).alias(f"{f}_row_id") for f in fields])


def voted_survivors(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """One record for each listing with two or more rows, every value the one with the highest support.

    ``listing_id, n_rows, team, pos, age``, the share of support of each and the row it was taken from.
    """
    elected, _ = discover(listing_claims(rows, teams))
    cols: dict[str, Column] = {}
    for f in FIELDS:
        cols |= {f: _of(f, F.col("value")), f"{f}_share": _of(f, F.col("share")), f"{f}_row_id": _of(f, -F.col("precedence.neg_id"))}
    out = _wide(rows, elected, cols)
    return out.withColumn("pos", F.split("pos", "/")).withColumn("age", F.col("age").cast("double"))


def source_reliability(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """``source_id, feed, field, reliability`` after convergence of the plain vote."""
    _, trust = discover(listing_claims(rows, teams))
    part = F.split("source", "\x1f")
    return trust.select(part[0].alias("source_id"), part[1].alias("feed"), "field", F.round("reliability", 6).alias("reliability"))
