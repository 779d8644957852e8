"""State dumps with content-derived aliases, and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def aliased(rows: DataFrame, prefix: str, order: list[str], group: str = "group_id") -> DataFrame:
    """rows with alias: the prefix and the number in the order of content, from 0, within a group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("alias", F.concat(F.lit(prefix), (F.row_number().over(w) - 1).cast("string")))


def edge_aliases(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ordered by fact and the aliases of their ends; nodes: node_id, alias."""
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(nodes.select(F.col("node_id").alias(end), F.col("alias").alias(f"{end}_alias")), end, "left")
    return aliased(ends, "e", ["fact", "src_alias", "dst_alias", "edge_id"])


def attributed(episode_edges: DataFrame, edge_episodes: DataFrame) -> DataFrame:
    """Pairs (episode_id, edge_id) that the edge's own list holds too."""
    return episode_edges.join(edge_episodes.select("episode_id", "edge_id"), ["episode_id", "edge_id"], "left_semi")


def expiry_agrees(expired_at: Column, invalid_at: Column) -> Column:
    """Bounds are compared by presence only."""
    return expired_at.isNotNull() == invalid_at.isNotNull()


def state_difference(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, left_value, right_value for every field that differs; a missing row differs in `row`."""
    a = left.select(key, *[F.col(c).cast("string").alias(f"l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(key, *[F.col(c).cast("string").alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    both = a.join(b, key, "full")
    there = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    yes = lambda c: F.when(c.isNotNull(), "present").otherwise("absent")
    parts = [F.when(~there, F.struct(F.lit("row").alias("field"), yes(F.col("_l")).alias("l"), yes(F.col("_r")).alias("r")))]
    parts += [F.when(there & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("l"), F.col(f"r_{c}").alias("r"))) for c in columns]
    diffs = both.select(key, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("d"))
    return diffs.select(key, "d.field", F.col("d.l").alias("left_value"), F.col("d.r").alias("right_value"))


def results_outside(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Search results whose fact the graph does not hold."""
    return results.join(facts.select("fact").distinct(), "fact", "left_anti")


def unequal_retrievals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Queries whose sets of facts differ."""
    per = lambda r, n: r.groupBy("query").agg(F.sort_array(F.collect_set("fact")).alias(n))
    both = per(left, "a").join(per(right, "b"), "query", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("query")
