"""One step of every group: its next episode, resolved against the group's state before it.

Groups are independent, so a step works on all of them at once and the order within a group is
kept. The change set of a step is computed first and given back whole; nothing that a step writes is
seen by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.functions.text import normalize_exact, primary_label
from chronoweave.functions.timestamps import parse_time
from chronoweave.operators import extraction, resolution, summaries, temporal
from chronoweave.session import materialize


@dataclass
class Changes:
    """What a step decided."""

    nodes: DataFrame  # new versions of rows of nodes, drafts merged away included
    edges: DataFrame  # new edges
    bounds: DataFrame  # edge_id, invalid_at, expired_at of stored edges
    mentions: DataFrame
    episodes: DataFrame
    merges: DataFrame  # draft_id, node_id


def content_id(*parts: Column) -> Column:
    """An id that follows from content, so that a repeated step writes the same rows."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 32)


def _with_vectors(rows: DataFrame, column: str, as_: str, vectors: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """rows with the vectors of a text column; null without a provider."""
    if vectors is None:
        return rows.withColumn(as_, F.lit(None).cast("array<float>"))
    known = vectors(rows.select(F.col(column).alias("text")).distinct())
    return rows.join(materialize(known.select(F.col("text").alias(column), F.col("vec").cast("array<float>").alias(as_))), column, "left")


def step(episodes: DataFrame, nodes: DataFrame, edges: DataFrame, entity_replies: DataFrame, edge_replies: DataFrame, types: DataFrame, now: Column,
         contradictory: tuple[str, ...] = (), judged_nodes: DataFrame | None = None, judged_edges: DataFrame | None = None,
         vectors: Callable[[DataFrame], DataFrame] | None = None) -> Changes:
    """Resolve one episode of each group.

    episodes: episode_id, group_id, kind, source, content, valid_at (text), seq. nodes and edges:
    the state before, of these groups. Replies: episode_id, reply. A relation named in
    `contradictory` holds one object at a time: another object contradicts the stored facts of its
    subject. Equal facts between equal ends are duplicates. judged_nodes: draft_id, node_id;
    judged_edges: draft_id, duplicates, contradicted (index arrays, see resolution.judged_edges()).
    vectors turns texts (a column text) into text, vec: names are then resolved within the pool of
    stored names whose vectors are near, and the vectors of new names and facts are kept. Without
    it a draft's pool is all stored names of its group.
    """
    e = episodes.select("episode_id", "group_id", F.coalesce(parse_time(F.col("valid_at")), now).alias("occurred_at"))
    drafts = extraction.extract_nodes(entity_replies, types).join(e, "episode_id")
    drafts = drafts.withColumn("draft_id", content_id(F.lit("node"), F.col("episode_id"), F.col("norm")))
    live = nodes.where(F.col("expired_at").isNull())
    drafts, pool = materialize(_with_vectors(drafts, "name", "name_vec", vectors)), None
    if vectors is not None:
        pool = materialize(resolution.cosine_pool(drafts.withColumnRenamed("name_vec", "vec"), live.withColumnRenamed("name_vec", "vec")))
    resolved = resolution.resolve_nodes(drafts, live, judged_nodes, pool).withColumnRenamed("labels", "final_labels")
    # each tier is read several times below, so it is written once
    d = materialize(drafts.join(resolved, "draft_id").withColumn("final_id", F.coalesce("node_id", "draft_id")))
    # facts name the drafts by their extracted names; their ends are the resolved nodes
    ends = d.select("episode_id", "name", F.col("final_id").alias("node_id"), "pos")
    facts = extraction.extract_edges(edge_replies, ends, e.select("episode_id", "group_id", "occurred_at"))
    facts = extraction.collapse_edges(facts)
    norm = normalize_exact(F.col("fact"))
    facts = facts.withColumn("draft_id", content_id(F.lit("edge"), F.col("episode_id"), F.col("src"), F.col("dst"), norm))
    none = F.lit(None).cast("timestamp")
    facts = facts.withColumns({"expired_at": none, "reference_time": F.col("occurred_at"), "seq": F.col("pos"), "rel": F.col("name")})
    facts = materialize(facts.withColumn("valid_at", F.coalesce("valid_at", F.when(F.col("invalid_at").isNull(), F.col("occurred_at")))))
    one_at_a_time = facts.where(F.col("rel").isin(list(contradictory))) if contradictory else facts.limit(0)
    old = edges.select("group_id", "src", "rel", F.col("dst").alias("_d"), "edge_id")
    contra = one_at_a_time.join(old, ["group_id", "src", "rel"]).where("dst <> _d").select("draft_id", "edge_id")
    same = facts.select("draft_id", F.lit(None).cast("string").alias("edge_id")).limit(0)
    if judged_edges is not None:
        same, against = resolution.judged_edges(facts, edges, judged_edges)
        contra = contra.unionByName(against).distinct()
    done, decisions = resolution.resolve_edges(facts, edges, same, contra, None, now)
    f = materialize(facts.drop("valid_at", "invalid_at", "expired_at").join(done, "draft_id"))
    decisions = materialize(decisions)
    fresh = f.where("duplicate_of is null")
    new_edges = _with_vectors(fresh, "fact", "fact_vec", vectors).select(
        F.col("draft_id").alias("edge_id"), "group_id", "src", "dst", "rel", "fact", "valid_at", "invalid_at", F.col("occurred_at").alias("created_at"), none.alias("expired_at"), "fact_vec"
    )
    # the duplicate's own slot comes before what the facts contradict; the first decision of an episode stays
    own = f.where("duplicate_of is not null").join(edges.select(F.col("edge_id").alias("duplicate_of"), F.col("invalid_at").alias("_was")), "duplicate_of")
    slots = own.select("episode_id", F.col("duplicate_of").alias("edge_id"), F.struct("seq", F.lit(0).alias("k")).alias("seq"), F.when(~F.col("invalid_at").eqNullSafe(F.col("_was")), F.col("invalid_at")).alias("invalid_at"))
    ended = decisions.join(f.select("draft_id", "episode_id", "seq"), "draft_id").select("episode_id", "edge_id", F.struct("seq", F.lit(1).alias("k")).alias("seq"), "invalid_at")
    first = temporal.first_decisions(slots.unionByName(ended))
    bounds = temporal.folded_bounds(first).withColumn("expired_at", now)
    # summaries take the facts of new edges, once for every draft of a node
    per_node = d.groupBy("final_id").agg(
        F.count(F.lit(1)).alias("n_drafts"), F.min_by("name", "pos").alias("_name"), F.max_by("final_labels", F.struct(F.size("final_labels"), -F.col("pos"))).alias("_labels"),
        F.first("group_id").alias("group_id"), F.min("occurred_at").alias("_at"), F.min_by("name_vec", "pos").alias("_vec"),
    ).withColumnRenamed("final_id", "node_id")
    stored = live.select("node_id", F.col("name").alias("_stored"), F.col("summary").alias("_summary"), F.col("created_at").alias("_created"), F.col("name_vec").alias("_stored_vec"))
    per_node = per_node.join(stored, "node_id", "left").withColumns({"name": F.coalesce("_stored", "_name"), "summary": F.coalesce("_summary", F.lit(""))})
    fresh_facts = summaries.facts_by_node(fresh.select("src", "dst", "fact", F.struct("episode_id", "seq").alias("pos")))
    summed = summaries.refreshed(per_node, fresh_facts).select("node_id", F.col("summary").alias("_new"))
    finals = per_node.drop("summary").join(summed, "node_id").select(
        "node_id", "group_id", primary_label(F.col("_labels")).alias("kind"), "name", F.col("_new").alias("summary"), F.col("_labels").alias("labels"),
        F.coalesce("_created", "_at").alias("created_at"), none.alias("expired_at"), F.lit(None).cast("string").alias("merged_into"),
        F.when(F.col("_stored").isNull(), F.col("_vec")).otherwise(F.col("_stored_vec")).alias("name_vec"),
    )
    ghosts = d.where("final_id <> draft_id").select(
        F.col("draft_id").alias("node_id"), "group_id", primary_label(F.col("labels")).alias("kind"), "name", F.lit("").alias("summary"), "labels",
        F.col("occurred_at").alias("created_at"), now.alias("expired_at"), F.col("final_id").alias("merged_into"), "name_vec",
    )
    edge_ids = f.select("episode_id", F.coalesce("duplicate_of", "draft_id").alias("target_id"), F.lit("edge").alias("target_kind"))
    mentions = d.select("episode_id", F.col("final_id").alias("target_id"), F.lit("node").alias("target_kind")).unionByName(edge_ids).distinct()
    log = episodes.join(e.select("episode_id", "occurred_at"), "episode_id").select("episode_id", "group_id", "kind", "source", "content", "occurred_at", now.alias("created_at"), "seq")
    return Changes(finals.unionByName(ghosts), new_edges, bounds, mentions, log, d.where("final_id <> draft_id").select("draft_id", F.col("final_id").alias("node_id")))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in place of those of old with equal keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*old.columns)


def bounded(edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """Edges with the earlier of their end and a decided one."""
    b = bounds.select("edge_id", F.col("invalid_at").alias("_i"))
    return edges.join(b, "edge_id", "left").withColumn("invalid_at", F.least("invalid_at", "_i")).select(*edges.columns)
