"""Summaries of entities from new facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions.text import MAX_SUMMARY_CHARS, may_append, merged_summary, truncate_at_sentence

# Fixed values.
FLIGHT_NODES = 30
EMBED_BATCH = 64


def facts_by_node(edges: DataFrame) -> DataFrame:
    """node_id, facts (array in edge order): each fact counts for both ends. edges: src, dst, fact, pos."""
    each = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), "pos", "fact")
    # a loop would count twice for one node, as its two ends do
    return each.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact"))), lambda x: x["fact"]).alias("facts"))


def refreshed(nodes: DataFrame, facts: DataFrame, keep: Column | None = None) -> DataFrame:
    """node_id, name, summary, needs_model for nodes (node_id, name, summary, n_drafts) and facts (node_id, facts).

    A node that k drafts resolved to takes its facts k times, one append after the other. A summary
    short enough after an append is kept; else that append waits for a model. `keep` is a
    condition; nodes that it rejects are untouched.
    """
    joined = nodes.join(facts, "node_id", "left")
    some = F.coalesce(F.col("facts"), F.array().cast("array<string>"))
    chosen = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))

    def append(state: Column, _: Column) -> Column:
        merged = merged_summary(state["summary"], some)
        short = may_append(merged)
        return F.struct(F.when(short, merged).otherwise(state["summary"]).alias("summary"), (state["needs"] | (~short & (merged != ""))).alias("needs"))

    turns = F.sequence(F.lit(1), F.greatest(F.col("n_drafts").cast("int"), F.lit(1)))
    state = F.aggregate(turns, F.struct(F.col("summary"), F.lit(False).alias("needs")), append)
    done = joined.withColumn("_state", F.when(chosen, state))
    return done.select("node_id", "name", F.coalesce("_state.summary", "summary").alias("summary"), F.coalesce("_state.needs", F.lit(False)).alias("needs_model"))


def in_flights(rows: DataFrame, group: list[str], order: list[str], size: int = FLIGHT_NODES) -> DataFrame:
    """Rows with the number of the flight or batch of `size` they go in."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("flight", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def applied(nodes: DataFrame, replies: DataFrame, most: int = MAX_SUMMARY_CHARS) -> DataFrame:
    """Nodes (node_id, name, summary) with the last reply (pos, name, summary) of their name, whatever its case; unknown names are passed over."""
    last = replies.groupBy(F.lower("name").alias("_key")).agg(F.max_by("summary", "pos").alias("_new"))
    out = nodes.join(last, F.lower("name") == F.col("_key"), "left")
    return out.withColumn("summary", F.coalesce(truncate_at_sentence(F.col("_new"), most), "summary")).drop("_key", "_new")
