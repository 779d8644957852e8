"""From model replies to drafts: entities and facts of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoweave.functions.text import GENERIC_LABEL, clamped_indices, normalize_exact
from chronoweave.functions.timestamps import parse_time


def mapped_types(entities: DataFrame, types: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Entities (type_id) with type_name and labels; unknown ids are Entity, excluded types go.

    types (type_id, type_name) and excluded (type_name) are lists of a caller's own types; Spark
    broadcasts them if they are small.
    """
    out = entities.join(types.select("type_id", "type_name"), "type_id", "left")
    out = out.withColumn("type_name", F.coalesce("type_name", F.lit(GENERIC_LABEL)))
    if excluded is not None:
        out = out.join(excluded.select("type_name"), "type_name", "left_anti")
    generic = F.array(F.lit(GENERIC_LABEL))
    labels = F.when(F.col("type_name") == GENERIC_LABEL, generic).otherwise(F.array_append(generic, F.col("type_name")))
    return out.withColumn("labels", labels)


def named(entities: DataFrame) -> DataFrame:
    """Entities whose name is not blank."""
    return entities.where(F.length(F.regexp_replace("name", r"(?U)\s+", "")) > 0)


def collapse_drafts(drafts: DataFrame) -> DataFrame:
    """One draft for each normalized name of an episode: episode_id, pos, name, labels, episode_indices.

    drafts: episode_id, pos, name, labels, episode_indices. The most specific wins, then the longer
    trimmed name, then the earlier; it takes the first's place and all indices.
    """
    specific = F.size(F.filter("labels", lambda x: x != GENERIC_LABEL))
    rank = F.struct(specific.alias("s"), F.length(F.trim("name")).alias("l"), (-F.col("pos")).alias("p"))
    best = F.max_by(F.struct("name", "labels"), rank)
    return (
        drafts.groupBy("episode_id", normalize_exact(F.col("name")).alias("norm"))
        .agg(F.min("pos").alias("pos"), best.alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("episode_indices")))).alias("episode_indices"))
        .select("episode_id", "norm", "pos", "best.name", "best.labels", "episode_indices")
    )


def last_by_name(drafts: DataFrame) -> DataFrame:
    """The node that a name stands for in an episode: of equal names the last."""
    return drafts.groupBy("episode_id", "name").agg(F.max_by("node_id", "pos").alias("node_id"))


def resolved_endpoints(facts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Facts (episode_id, source_name, target_name, fact) with src and dst; those with an unknown end, one end or no text go."""
    ids = last_by_name(drafts)
    out = facts.where(F.length(F.trim("fact")) > 0)
    out = out.join(ids.select("episode_id", F.col("name").alias("source_name"), F.col("node_id").alias("src")), ["episode_id", "source_name"])
    out = out.join(ids.select("episode_id", F.col("name").alias("target_name"), F.col("node_id").alias("dst")), ["episode_id", "target_name"])
    return out.where("src <> dst")


def reference_time(raw_indices: Column, times: Column, primary: Column) -> Column:
    """The time of the first raw index if there is such an episode, else the primary's."""
    first = F.get(raw_indices, 0)
    inside = F.coalesce((first >= 0) & (first < F.size(times)), F.lit(False))
    return F.when(inside, F.get(times, F.when(inside, first).otherwise(F.lit(0)).cast("int"))).otherwise(primary)


def latest(times: Column) -> Column:
    """The largest time by text; null counts as empty."""
    return F.array_max(F.transform(times, lambda t: F.coalesce(t, F.lit(""))))


def fact_bounds(facts: DataFrame) -> DataFrame:
    """Facts with valid_at and invalid_at read from text."""
    return facts.withColumns({c: parse_time(F.col(c)) for c in ("valid_at", "invalid_at")})


def collapse_edges(edges: DataFrame) -> DataFrame:
    """The first (by pos) of the edges of an episode with equal ends and normalized fact."""
    w = Window.partitionBy("episode_id", "src", "dst", normalize_exact(F.col("fact"))).orderBy("pos")
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fact_type_signatures(types: DataFrame, signatures: DataFrame) -> DataFrame:
    """Each edge type (name, description) with the pairs of node types (source_type, target_type) that may hold it; else Entity with Entity."""
    pair = F.struct("source_type", "target_type")
    per_name = signatures.select(F.explode("names").alias("name"), pair.alias("pair")).groupBy("name").agg(F.sort_array(F.collect_set("pair")).alias("signatures"))
    generic = F.array(F.struct(F.lit(GENERIC_LABEL).alias("source_type"), F.lit(GENERIC_LABEL).alias("target_type")))
    return types.join(per_name, "name", "left").withColumn("signatures", F.coalesce("signatures", generic))


def decoded_entities(replies: DataFrame) -> DataFrame:
    """episode_id, pos, name, type_id, episode_indices from replies (episode_id, reply)."""
    schema = "struct<extracted_entities: array<struct<name: string, entity_type_id: bigint, episode_indices: array<bigint>>>>"
    rows = replies.select("episode_id", F.posexplode(F.from_json("reply", schema)["extracted_entities"]).alias("pos", "e"))
    indices = F.coalesce("e.episode_indices", F.array(F.lit(0).cast("bigint")))
    return rows.select("episode_id", "pos", "e.name", F.col("e.entity_type_id").alias("type_id"), indices.alias("episode_indices"))


def decoded_edges(replies: DataFrame) -> DataFrame:
    schema = (
        "struct<edges: array<struct<source_entity_name: string, target_entity_name: string, relation_type: string, fact: string,"
        " valid_at: string, invalid_at: string, episode_indices: array<bigint>>>>"
    )
    rows = replies.select("episode_id", F.posexplode(F.from_json("reply", schema)["edges"]).alias("pos", "e"))
    return rows.select(
        "episode_id", "pos", F.col("e.source_entity_name").alias("source_name"), F.col("e.target_entity_name").alias("target_name"),
        F.col("e.relation_type").alias("name"), "e.fact", "e.valid_at", "e.invalid_at",
        F.coalesce("e.episode_indices", F.array(F.lit(0).cast("bigint"))).alias("episode_indices"),
    )


def extract_nodes(replies: DataFrame, types: DataFrame, excluded: DataFrame | None = None, n_episodes: int = 1) -> DataFrame:
    """Drafts of replies: decoded, blank names and excluded types dropped, indices clamped, equal names collapsed."""
    out = mapped_types(named(decoded_entities(replies)), types, excluded)
    out = out.withColumn("episode_indices", clamped_indices(F.col("episode_indices"), F.lit(n_episodes)))
    return collapse_drafts(out)


def extract_edges(replies: DataFrame, drafts: DataFrame, reference: DataFrame, group_override: str = "") -> DataFrame:
    """Draft edges of replies; reference: episode_id, group_id, reference_time. drafts: episode_id, name, node_id, pos."""
    out = fact_bounds(resolved_endpoints(decoded_edges(replies), drafts)).join(reference, "episode_id")
    return out.withColumn("group_id", F.coalesce(F.nullif(F.lit(group_override), F.lit("")), F.col("group_id")))
