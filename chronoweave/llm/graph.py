"""Connected components by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.session import kept, release


#: Up to so many edges a round is one task's work, without a shuffle.
SMALL = 100_000


def _pairs(*pairs: tuple[str, str]) -> Column:
    return F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on its smallest neighbour."""
    both = edges.select(_pairs(("u", "v"), ("v", "u"))).select("e.u", "e.v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of each node, and the node, on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").select(_pairs(("v", "m"), ("u", "m"))).select("e.u", "e.v")
    return hung.where("u <> v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and a digest of them."""
    table = kept(edges)
    row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for each node that has an edge.

    edges: columns u and v of one orderable type; nulls and loops are passed over. Returns node,
    component. Every round keeps at most as many edges as before and pre-aggregates minima before
    it shuffles, so a hub costs one row per task; joins on hubs are left to skew-join splitting.
    """
    now, seen = _written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while seen[0]:
        after, digest = _written(_small_star(_large_star(now.coalesce(1) if seen[0] <= SMALL else now)))
        release(now)
        now, same = after, digest == seen
        if same:
            break
        seen = digest
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
