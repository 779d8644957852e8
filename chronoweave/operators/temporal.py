"""Bi-temporal rules: overlap, contradiction, expiry, as-of and as-at reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _sure(condition: Column) -> Column:
    """A comparison that a null makes false."""
    return F.coalesce(condition, F.lit(False))


def apart(valid: Column, invalid: Column, other_valid: Column, other_invalid: Column) -> Column:
    """Whether one fact ended before the other began."""
    return _sure(other_invalid <= valid) | _sure(invalid <= other_valid)


def invalidates(valid: Column, invalid: Column, other_valid: Column, other_invalid: Column) -> Column:
    """Whether a fact ends a contradicted one: they overlap, and the other began strictly before."""
    return ~apart(valid, invalid, other_valid, other_invalid) & _sure(other_valid < valid)


def self_expired(edges: DataFrame, candidates: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Ends edges (invalid_at, expired_at) for which a contradicted candidate (valid_at) has newer information.

    Bounded facts without expiry expire now. Of others, the candidate that began first after the
    edge bounds it.
    """
    later = candidates.select(*keys, F.col("valid_at").alias("_later"))
    first = edges.join(later, keys).where("_later > valid_at").groupBy(*keys).agg(F.min("_later").alias("_later"))
    bounded = F.col("invalid_at").isNotNull() & F.col("expired_at").isNull()
    joined = edges.join(first, keys, "left").withColumn("expired_at", F.when(bounded, now).otherwise(F.col("expired_at")))
    hit = F.col("expired_at").isNull() & F.col("_later").isNotNull()
    return joined.withColumns({"invalid_at": F.when(hit, F.col("_later")).otherwise(F.col("invalid_at")), "expired_at": F.when(hit, now).otherwise(F.col("expired_at"))}).drop("_later")


def superseded(edges: DataFrame, slot: list[str]) -> DataFrame:
    """Edges with invalid_at: the start of the next later edge of the slot with another object.

    Every later start of another object contradicts the edge; the least is what stays when all
    decisions are folded. Peers of one start do not end each other. One shuffle by slot.
    """
    by_start = edges.groupBy(*slot, "valid_at").agg(F.min("dst").alias("_lo"), F.max("dst").alias("_hi"))
    w = Window.partitionBy(*slot).orderBy("valid_at")
    runs = by_start.withColumn("_only", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))
    # a start changes the slot unless it holds just the object that the start before held
    runs = runs.withColumn("_change", F.when(~F.coalesce(F.col("_only") == F.lag("_only").over(w), F.lit(False)), F.col("valid_at")))
    runs = runs.withColumn("_next_change", F.min("_change").over(w.rowsBetween(1, Window.unboundedFollowing)))
    runs = runs.withColumns({"_next": F.lead("valid_at").over(w), "_next_only": F.lead("_only").over(w), "_after": F.lead("_next_change").over(w)})
    joined = edges.join(runs.select(*slot, "valid_at", "_next", "_next_only", "_after"), [*slot, "valid_at"], "left")
    same = F.coalesce(F.col("_next_only") == F.col("dst"), F.lit(False))
    return joined.withColumn("invalid_at", F.when(same, F.col("_after")).otherwise(F.col("_next"))).drop("_next", "_next_only", "_after")


def as_of_state(valid: Column, invalid: Column, t: Column) -> Column:
    """hidden before a fact began, gone from its end on, else current; open bounds are null."""
    return F.when(_sure(valid > t), "hidden").when(_sure(invalid <= t), "gone").otherwise("current")


def as_at(rows: DataFrame, t: Column) -> DataFrame:
    """Rows believed at t."""
    return rows.where((F.col("created_at") <= t) & (F.col("expired_at").isNull() | (F.col("expired_at") > t)))


def first_decisions(decisions: DataFrame) -> DataFrame:
    """One decision for each edge of an episode: the first by seq. One without a value only holds the place."""
    w = Window.partitionBy("episode_id", "edge_id").orderBy("seq")
    return decisions.withColumn("_r", F.row_number().over(w)).where("_r = 1 and invalid_at is not null").drop("_r")


def folded_bounds(decisions: DataFrame) -> DataFrame:
    """The earliest end that any episode decided for an edge."""
    return decisions.groupBy("edge_id").agg(F.min("invalid_at").alias("invalid_at"))
