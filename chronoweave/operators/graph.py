"""Bounded traversal, history, provenance and merge chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.session import materialize


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 3, budget: int | None = 256) -> DataFrame:
    """node_id, depth of the nodes within `depth` hops of seeds (node_id), either direction of edges (src, dst).

    The budget keeps the nearest nodes, ties by id. Each hop is one join with the frontier, whose
    nodes have not been seen before, so a hub is expanded once.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("node_id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        met = frontier.select(F.col("node_id").alias("src")).join(both, "src").select(F.col("dst").alias("node_id")).distinct()
        frontier = materialize(met.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "node_id").limit(budget) if budget is not None else seen


def subgraph_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes found."""
    ids = found.select("node_id")
    out = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return out.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def history(edges: DataFrame, node_ids: DataFrame) -> DataFrame:
    """node_id with each incident edge: two equality joins, not one with OR; an edge from a node to itself counts once. in_order() numbers them."""
    ids = node_ids.select("node_id")
    out = edges.join(ids.withColumn("src", F.col("node_id")), "src").select("node_id", *edges.columns)
    into = edges.where("src <> dst").join(ids.withColumn("dst", F.col("node_id")), "dst").select("node_id", *edges.columns)
    return out.unionByName(into)


def in_order(found: DataFrame) -> DataFrame:
    """history() with pos: an edge's place among its node's by created_at, then id."""
    w = Window.partitionBy("node_id").orderBy(F.col("created_at").asc_nulls_first(), "edge_id")
    return found.withColumn("pos", F.row_number().over(w).cast("bigint"))


def canonical(merges: DataFrame, hops: int = 32) -> DataFrame:
    """node_id, into, hops: where a chain of merges (node_id, merged_into) ends, by pointer doubling."""
    now = merges.where("merged_into is not null").select("node_id", F.col("merged_into").alias("into"), F.lit(1).alias("hops"))
    step = 1
    while step < hops:
        further = now.select(F.col("node_id").alias("into"), F.col("into").alias("_next"), F.col("hops").alias("_hops"))
        joined = now.join(further, "into", "left")
        now = materialize(
            joined.select("node_id", F.coalesce("_next", "into").alias("into"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_next").isNotNull().alias("_moved"))
        )
        if now.where("_moved").isEmpty():
            return now.drop("_moved")
        now, step = now.drop("_moved"), step * 2
    return now


def remapped(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges with both ends on canonical nodes; those that become loops go."""
    to = merges.select("node_id", "into")
    for end in ("src", "dst"):
        edges = edges.join(to.select(F.col("node_id").alias(end), F.col("into").alias("_into")), end, "left")
        edges = edges.withColumn(end, F.coalesce("_into", end)).drop("_into")
    return edges.where("src <> dst")


def provenance(mentions: DataFrame) -> DataFrame:
    """target_id, episodes: sorted distinct episode ids."""
    return mentions.groupBy("target_id").agg(F.sort_array(F.collect_set("episode_id")).alias("episodes"))


def previous_window(episodes: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Each episode with the n before it (array of ids, oldest first) among those of equal keys."""
    w = Window.partitionBy(*keys).orderBy("occurred_at", "seq").rowsBetween(-n, -1)
    return episodes.withColumn("previous", F.collect_list("episode_id").over(w))


def visible(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are live nodes."""
    live = nodes.where(F.col("expired_at").isNull())
    return subgraph_edges(edges, live)


def edge_state_counts(edges: DataFrame, state: Column) -> DataFrame:
    return edges.groupBy("group_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
