"""What a model is told: a JSON context for each request, and the requests made of it.

Every builder gives one row per request. Lists that a model answers by number are numbered in a
fixed order. The instructions are our own; a caller may pass others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.functions.text import CANDIDATE_SUMMARY_CHARS, GENERIC_LABEL, brief_type_description, concatenate_episodes, spaced_time, specific_labels

# Fixed values.
NO_DESCRIPTION = "Default Entity Type"

#: Request name -> (reply schema, size of model, instruction).
REQUESTS = {
    "extract_message": ("ExtractedEntities", "medium", "Name the speakers and the entities that the last message speaks of."),
    "extract_json": ("ExtractedEntities", "medium", "Name the entities that the JSON record holds."),
    "extract_text": ("ExtractedEntities", "medium", "Name the entities that the text speaks of."),
    "edge": ("ExtractedEdges", "medium", "State the facts that hold between two of the listed entities, with their times."),
    "extract_timestamps": ("EdgeTimestamps", "small", "Say when the fact became true and when it ended, if it is told."),
    "dedupe_nodes": ("NodeResolutions", "medium", "For each extracted entity give the number of the existing one that it is, or -1."),
    "resolve_edge": ("EdgeDuplicate", "small", "Number the facts that the new one repeats, and those that it contradicts."),
    "extract_summaries_batch": ("SummarizedEntities", "small", "Renew the summary of each entity by name."),
}


def entity_types(types: DataFrame) -> DataFrame:
    """entity_type_id, entity_type_name, entity_type_description of types (pos from 0, name, description), after the generic type 0."""
    spark = types.sparkSession
    first = spark.createDataFrame([(0, GENERIC_LABEL, NO_DESCRIPTION)], "entity_type_id bigint, entity_type_name string, entity_type_description string")
    own = types.select((F.col("pos") + 1).cast("bigint").alias("entity_type_id"), F.col("name").alias("entity_type_name"), F.col("description").alias("entity_type_description"))
    return first.unionByName(own)


def type_descriptions(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """nodes (labels) with entity_type_description: that of their first specific label."""
    named = types.select(F.col("name").alias("_type"), F.col("description").alias("_description"))
    out = nodes.withColumn("_type", F.get(specific_labels(F.col("labels")), 0)).join(named, "_type", "left")
    return out.withColumn("entity_type_description", F.coalesce("_description", F.lit(NO_DESCRIPTION))).drop("_type", "_description")


def bare_attributes(attrs: Column) -> Column:
    """Attributes (a map) without the labels kept among them."""
    return F.map_filter(attrs, lambda k, _: k != "labels")


def previous(contents: Column) -> Column:
    """Earlier episodes as an array of content and timestamp."""
    return F.transform(contents, lambda x: F.struct(x["content"].alias("content"), x["occurred_at"].alias("timestamp")))


def numbered(rows: Column, first: str, number: str) -> Column:
    """An array of structs, sorted by its leading field, with that field in place of a number from 0."""
    return F.transform(F.array_sort(rows), lambda x, i: F.struct(i.alias(number), *[x[f].alias(f) for f in first.split()]))


#: Goes with requests about several episodes at once.
ATTRIBUTION = " Give with each entity the numbers of the episodes that mention it, counted from 0."


def extraction(episodes: DataFrame, types: DataFrame, custom: str = "") -> DataFrame:
    """episode_id, request, context: kind chooses the request. episodes: episode_id, kind, source, content, valid_at, previous.

    With a column `parts` (array of content, occurred_at), rows of several parts are taken together:
    their contents are joined, and the instructions ask for each entity's episodes.
    """
    listed = entity_types(types).agg(F.array_sort(F.collect_list(F.struct("entity_type_id", "entity_type_name", "entity_type_description"))).alias("entity_types"))
    content, instructions = F.col("content"), F.lit(custom)
    if "parts" in episodes.columns:
        several = F.size("parts") > 1
        joined = concatenate_episodes(F.transform("parts", lambda x: x["content"]), F.transform("parts", lambda x: x["occurred_at"]))
        content, instructions = F.when(several, joined).otherwise(content), F.when(several, F.lit(custom + ATTRIBUTION)).otherwise(instructions)
    body = F.struct(
        content.alias("episode_content"), previous(F.col("previous")).alias("previous_episodes"), instructions.alias("custom_extraction_instructions"), "entity_types",
        F.col("source").alias("source_description"), F.col("valid_at").alias("episode_timestamp"),
    )
    rows = episodes.join(F.broadcast(listed))  # one row: the caller's list of types
    return rows.select("episode_id", F.concat(F.lit("extract_"), "kind").alias("request"), F.to_json(body).alias("context"))


def edge_extraction(episodes: DataFrame, drafts: DataFrame, fact_types: DataFrame) -> DataFrame:
    """episode_id, request, context for episodes (episode_id, content, valid_at, previous), drafts (episode_id, pos, name, labels) and fact types (name, signatures, description)."""
    nodes = drafts.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.col("labels").alias("entity_types")))).alias("n"))
    kinds = fact_types.agg(
        F.array_sort(F.collect_list(F.struct(F.col("name").alias("fact_type_name"), F.col("signatures").alias("fact_type_signatures"), F.col("description").alias("fact_type_description")))).alias("edge_types")
    )
    listed = F.transform(F.coalesce("n", F.array().cast("array<struct<pos: bigint, name: string, entity_types: array<string>>>")), lambda x: F.struct(x["name"].alias("name"), x["entity_types"].alias("entity_types")))
    body = F.struct(F.col("content").alias("episode_content"), listed.alias("nodes"), previous(F.col("previous")).alias("previous_episodes"), spaced_time(F.col("valid_at")).alias("reference_time"), "edge_types")
    rows = episodes.join(nodes.withColumn("n", F.col("n").cast("array<struct<pos: bigint, name: string, entity_types: array<string>>>")), "episode_id", "left").join(F.broadcast(kinds))
    return rows.select("episode_id", F.lit("edge").alias("request"), F.to_json(body).alias("context"))


def node_dedupe(drafts: DataFrame, candidates: DataFrame, episodes: DataFrame | None = None) -> DataFrame:
    """episode_id, request, context for drafts (episode_id, pos, name, labels, entity_type_description) and candidates (episode_id, place, name, labels, summary).

    Candidates may have `attributes` (map of strings), which stand beside their other fields.
    episodes (episode_id, content, previous) add what the drafts come from.
    """
    new = drafts.groupBy("episode_id").agg(F.collect_list(F.struct("pos", "name", F.col("labels").alias("entity_type"), "entity_type_description")).alias("n"))
    short = F.left("summary", F.lit(CANDIDATE_SUMMARY_CHARS)).alias("summary")
    bare = F.to_json(bare_attributes(F.col("attributes"))) if "attributes" in candidates.columns else F.lit(None).cast("string")
    old = candidates.groupBy("episode_id").agg(F.collect_list(F.struct("place", "name", F.col("labels").alias("entity_types"), short, bare.alias("attributes"))).alias("o"))
    none = F.array().cast("array<struct<candidate_id: int, name: string, entity_types: array<string>, summary: string, attributes: string>>")
    known = F.coalesce(numbered(F.col("o"), "name entity_types summary attributes", "candidate_id"), none)
    # an entry's attributes come first, then its own fields, as one object
    own = lambda x: F.to_json(F.struct(*[x[f].alias(f) for f in ("candidate_id", "name", "entity_types", "summary")]))
    entry = lambda x: F.when(F.length(x["attributes"]) > 2, F.concat(F.regexp_replace(x["attributes"], r"\}$", ","), F.substr(own(x), F.lit(2)))).otherwise(own(x))
    rows = new.join(old, "episode_id", "left")
    drafted = F.to_json(F.struct(numbered(F.col("n"), "name entity_type entity_type_description", "id").alias("extracted_nodes")))
    parts = [F.regexp_replace(drafted, r"\}$", ""), F.lit(',"existing_nodes":['), F.array_join(F.transform(known, entry), ","), F.lit("]")]
    if episodes is not None:
        rows = rows.join(episodes.select("episode_id", "content", "previous"), "episode_id", "left")
        from_ = F.struct(F.coalesce("content", F.lit("")).alias("episode_content"), previous(F.col("previous")).alias("previous_episodes"))
        parts += [F.lit(","), F.regexp_replace(F.substr(F.to_json(from_), F.lit(2)), r"\}$", "")]
    return rows.select("episode_id", F.lit("dedupe_nodes").alias("request"), F.concat(*parts, F.lit("}")).alias("context"))


def edge_dedupe(drafts: DataFrame, listed: DataFrame) -> DataFrame:
    """draft_id, request, context for drafts (draft_id, fact) and their candidate lists (draft_id, list, idx, fact)."""
    part = lambda name: F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("idx", "fact"))))
    lists = listed.groupBy("draft_id").agg(part("related").alias("existing_edges"), part("pool").alias("edge_invalidation_candidates"))
    none = F.array().cast("array<struct<idx: bigint, fact: string>>")
    body = F.struct(F.coalesce("existing_edges", none).alias("existing_edges"), F.col("fact").alias("new_edge"), F.coalesce("edge_invalidation_candidates", none).alias("edge_invalidation_candidates"))
    return drafts.select("draft_id", "fact").join(lists, "draft_id", "left").select("draft_id", F.lit("resolve_edge").alias("request"), F.to_json(body).alias("context"))


def summary(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """flight, request, context for nodes (flight, pos, name, summary, labels), with the types' descriptions without extraction guidance."""
    described = types.where("description <> ''").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", brief_type_description(F.col("description")))))).alias("entity_type_descriptions"))
    flights = nodes.groupBy("flight").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "summary", F.col("labels").alias("entity_types")))).alias("e"))
    entities = F.transform("e", lambda x: F.struct(x["name"].alias("name"), x["summary"].alias("summary"), x["entity_types"].alias("entity_types")))
    body = F.struct(entities.alias("entities"), "entity_type_descriptions")
    return flights.join(F.broadcast(described)).select("flight", F.lit("extract_summaries_batch").alias("request"), F.to_json(body).alias("context"))


def requests(contexts: DataFrame, instructions: dict[str, tuple[str, str, str]] = REQUESTS) -> DataFrame:
    """contexts with request as JSON of messages, schema_name and model_size, as providers take it; an unknown name is an error."""
    out = F.raise_error(F.concat(F.lit("no request "), F.col("request"))).cast("string")
    for name, (schema, size, instruction) in instructions.items():
        message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        body = F.struct(F.array(message("system", F.lit(instruction)), message("user", F.col("context"))).alias("messages"), F.lit(schema).alias("schema_name"), F.lit(size).alias("model_size"))
        out = F.when(F.col("request") == name, F.to_json(body)).otherwise(out)
    return contexts.withColumn("request", out)
