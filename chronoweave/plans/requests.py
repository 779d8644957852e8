"""Contexts of model requests, and the small functions around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.models import contexts, providers
from chronoweave.operators import conformance, extraction, resolution
from chronoweave.plans import views
from chronoweave.plans.facts import SMALL_GROUPS, _priority_groups
from chronoweave.plans.views import with_views
from chronoweave.session import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


TYPES = [(0, "Customer", "A buyer. Orders goods. Lives somewhere. Not shown."), (1, "Part", "A thing.\n\nGuidance.")]


def _types(spark):
    return spark.createDataFrame(TYPES, "pos bigint, name string, description string")


@query("type_descriptions", with_views("nodes", " SELECT node_id, CASE group_id WHEN 'customer' THEN 'A buyer. Orders goods. Lives somewhere. Not shown.' WHEN 'part' THEN CASE WHEN len(labels) = 2 THEN 'A thing.' || chr(10) || chr(10) || 'Guidance.' ELSE 'Default Entity Type' END ELSE 'Default Entity Type' END AS description FROM nodes"))
def type_descriptions(spark, d):
    return contexts.type_descriptions(views.nodes(spark, d), _types(spark)).select("node_id", F.col("entity_type_description").alias("description"))


@query("entity_types", "SELECT * FROM (VALUES (0::BIGINT, 'Entity', 'Default Entity Type'), (1, 'Customer', 'A buyer. Orders goods. Lives somewhere.'), (2, 'Part', 'A thing.')) t(entity_type_id, entity_type_name, brief)")
def entity_types(spark, d):
    return contexts.entity_types(_types(spark)).select("entity_type_id", "entity_type_name", text.brief_type_description(F.col("entity_type_description")).alias("brief"))


@query("truncated_summaries", "SELECT doc_id, substr(text, 1, 120) AS summary, replace(text, chr(10), ' ') AS line FROM documents")
def truncated_summaries(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.left("text", F.lit(text.CANDIDATE_SUMMARY_CHARS)).alias("summary"), text.one_line(F.col("text")).alias("line"))


@query("bare_attributes", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'value' ELSE 'kind|value' END AS keys FROM events")
def bare_attributes(spark, d):
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("labels"), F.lit("x"), F.lit("value"), F.lit("y"))).otherwise(F.create_map(F.lit("kind"), F.lit("x"), F.lit("value"), F.lit("y")))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(contexts.bare_attributes(m))), "|").alias("keys"))


@query("missing_names", "SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_retailprice < 905)")
def missing_names(spark, d):
    p = table(spark, d, "part")
    stored = p.where("p_retailprice < 905").select(F.col("p_name").alias("name"), F.array(F.lit(1.0).cast("float")).alias("name_vec"))
    return providers.missing_names(p.select(F.col("p_name").alias("name")), stored)


@query(
    "fact_type_signatures",
    "SELECT * FROM (VALUES ('HAS_PRIORITY', 'Customer>Priority'), ('LIVES_IN', 'Customer>Nation|Supplier>Nation'), ('UNLISTED', 'Entity>Entity')) t(name, signatures)",
)
def fact_type_signatures(spark, d):
    types = spark.createDataFrame([("HAS_PRIORITY", ""), ("LIVES_IN", ""), ("UNLISTED", "")], "name string, description string")
    rows = [("Customer", "Nation", ["LIVES_IN"]), ("Customer", "Priority", ["HAS_PRIORITY"]), ("Supplier", "Nation", ["LIVES_IN", "OTHER"])]
    out = extraction.fact_type_signatures(types, spark.createDataFrame(rows, "source_type string, target_type string, names array<string>"))
    return out.select("name", F.array_join(F.transform("signatures", lambda x: F.concat(x["source_type"], F.lit(">"), x["target_type"])), "|").alias("signatures"))


@query("mention_set", with_views("priority", " SELECT DISTINCT episode_id, target_id FROM (SELECT episode_id, src AS target_id FROM priority UNION ALL SELECT episode_id, dst FROM priority UNION ALL SELECT episode_id, edge_id FROM priority)"))
def mention_set(spark, d):
    e = views.priority_edges(spark, d)
    return e.select("episode_id", F.explode(F.array("src", "dst", "edge_id")).alias("target_id")).distinct()


@query(
    "unequal_retrievals",
    "SELECT n_name AS query FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey IN (SELECT c_nationkey FROM customer)",
)
def unequal_retrievals(spark, d):
    hits = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    left = hits.select(F.col("n_name").alias("query"), F.col("c_name").alias("fact"))
    right = hits.select(F.col("n_name").alias("query"), F.when(F.col("n_nationkey") % 4 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("fact"))
    return conformance.unequal_retrievals(left, right)


@query(
    "edge_dedupe_context",
    with_views(
        "priority",
        SMALL_GROUPS
        + """, l AS (SELECT draft_id, fact, CASE WHEN g.src = dr.src AND g.dst = dr.dst THEN 'related' ELSE 'pool' END AS list,
  row_number() OVER (PARTITION BY draft_id ORDER BY (g.src = dr.src AND g.dst = dr.dst) DESC, fact, edge_id) - 1 AS idx FROM dr JOIN g USING (group_id))
SELECT draft_id, count(*) FILTER (list = 'related') AS n_related, count(*) FILTER (list = 'pool') AS n_pool, any_value(fact) FILTER (idx = 0) AS first_fact FROM l GROUP BY draft_id""",
    ),
)
def edge_dedupe_context(spark, d):
    """The context of each draft's judgment, read back."""
    stored, drafts = _priority_groups(spark, d)
    made = contexts.requests(contexts.edge_dedupe(drafts, resolution.candidate_lists(drafts, stored)))
    content = F.get(F.from_json("request", "struct<messages: array<struct<role: string, content: string>>>")["messages"], 1)["content"]
    edge = "array<struct<idx: bigint, fact: string>>"
    back = made.select("draft_id", F.from_json(content, f"struct<existing_edges: {edge}, edge_invalidation_candidates: {edge}>").alias("c"))
    return back.select(
        "draft_id", F.size("c.existing_edges").cast("bigint").alias("n_related"), F.size("c.edge_invalidation_candidates").cast("bigint").alias("n_pool"),
        F.get("c.existing_edges", 0)["fact"].alias("first_fact"),
    )


@query(
    "extraction_requests",
    with_views("messages", " SELECT 'ExtractedEntities' AS schema, 'medium' AS size, 3::BIGINT AS n_types, content, episode_id FROM messages"),
)
def extraction_requests(spark, d):
    m = views.messages(spark, d).withColumns({"source": F.lit("chat"), "valid_at": F.col("occurred_at").cast("string"), "previous": F.array().cast("array<struct<content: string, occurred_at: string>>")})
    made = contexts.requests(contexts.extraction(m, _types(spark)))
    r = F.from_json("request", "struct<messages: array<struct<role: string, content: string>>, schema_name: string, model_size: string>")
    made = made.select("episode_id", r.alias("r")).withColumn("c", F.from_json(F.get("r.messages", 1)["content"], "struct<episode_content: string, entity_types: array<struct<entity_type_id: bigint>>>"))
    return made.select("episode_id", F.col("r.schema_name").alias("schema"), F.col("r.model_size").alias("size"), F.size("c.entity_types").cast("bigint").alias("n_types"), F.col("c.episode_content").alias("content"))
