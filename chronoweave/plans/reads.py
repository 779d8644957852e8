"""Scans, counts, as-of reads, windows and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import graph, temporal
from chronoweave.plans import views
from chronoweave.plans.views import TIME, stamp, time_text, with_views
from chronoweave.session import table
from chronoweave.sources import store

AS_OF = "1997-01-01 00:00:00"
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("scan_nodes", with_views("nodes", " SELECT node_id, name, array_to_string(labels, '|') AS labels, merged_into FROM nodes WHERE group_id = 'part'"))
def scan_nodes(spark, d):
    return store.group_rows(views.nodes(spark, d), "part").select("node_id", "name", F.array_join("labels", "|").alias("labels"), "merged_into")


@query("scan_live_nodes", with_views("nodes", " SELECT node_id, name FROM nodes WHERE group_id = 'part' AND expired_at IS NULL"))
def scan_live_nodes(spark, d):
    return store.live(store.group_rows(views.nodes(spark, d), "part")).select("node_id", "name")


@query("scan_edges", with_views("priority", f" SELECT edge_id, src, dst, rel, strftime(valid_at, {TIME}) AS valid_at FROM priority WHERE group_id = 'order'"))
def scan_edges(spark, d):
    return store.group_rows(views.priority_edges(spark, d), "order").select("edge_id", "src", "dst", "rel", time_text("valid_at").alias("valid_at"))


@query("scan_episodes", with_views("messages", f" SELECT episode_id, content, strftime(occurred_at, {TIME}) AS occurred_at FROM messages WHERE group_id = 'conv-7'"))
def scan_episodes(spark, d):
    return store.group_rows(views.messages(spark, d), "conv-7").select("episode_id", "content", time_text("occurred_at").alias("occurred_at"))


@query("point_get", with_views("nodes", " SELECT o_orderkey AS order_id, name FROM orders LEFT JOIN nodes ON node_id = 'customer:' || o_custkey"))
def point_get(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("node_id"))
    return wanted.join(views.nodes(spark, d).select("node_id", "name"), "node_id", "left").select("order_id", "name")


@query(
    "status_counts",
    with_views(
        "nodes priority observations",
        """ SELECT (SELECT count(*) FROM observations) AS episodes, (SELECT count(*) FROM nodes WHERE expired_at IS NULL) AS live_nodes,
    (SELECT count(*) FROM priority) AS edges""",
    ),
)
def status_counts(spark, d):
    return store.status(views.observations(spark, d), views.nodes(spark, d), views.priority_edges(spark, d))


@query(
    "group_counts",
    with_views("nodes", " SELECT group_id, count(*) AS n, count(*) FILTER (expired_at IS NULL) AS live FROM nodes GROUP BY group_id"),
)
def group_counts(spark, d):
    n = views.nodes(spark, d)
    return n.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expired_at").isNull()).alias("live"))


PRIORITY_STATES = f""", states AS (SELECT e.*, (SELECT min(f.valid_at) FROM priority f WHERE f.src = e.src AND f.rel = e.rel AND f.dst <> e.dst
  AND f.valid_at > e.valid_at) AS invalid_at FROM priority e)"""


def priority_states(spark, d):
    return temporal.superseded(views.priority_edges(spark, d), ["group_id", "src", "rel"])


@query("supersession", with_views("priority", PRIORITY_STATES + f" SELECT edge_id, strftime(valid_at, {TIME}) AS valid_at, strftime(invalid_at, {TIME}) AS invalid_at FROM states"))
def supersession(spark, d):
    return priority_states(spark, d).select("edge_id", time_text("valid_at").alias("valid_at"), time_text("invalid_at").alias("invalid_at"))


@query(
    "facts_as_of",
    with_views(
        "priority nodes",
        PRIORITY_STATES
        + f""" SELECT n.name, s.dst, strftime(s.valid_at, {TIME}) AS since, s.episode_id FROM states s JOIN nodes n ON n.node_id = s.src
  WHERE s.valid_at <= TIMESTAMP '{AS_OF}' AND (s.invalid_at IS NULL OR s.invalid_at > TIMESTAMP '{AS_OF}')""",
    ),
)
def facts_as_of(spark, d):
    """What was true at a time, since when, and which episode says so."""
    s = priority_states(spark, d)
    s = s.where(temporal.as_of_state(F.col("valid_at"), F.col("invalid_at"), stamp(AS_OF)) == "current")
    n = views.nodes(spark, d).select(F.col("node_id").alias("src"), "name")
    return s.join(n, "src").select("name", "dst", time_text("valid_at").alias("since"), "episode_id")


@query(
    "edge_state_counts",
    with_views(
        "priority",
        PRIORITY_STATES
        + f""" SELECT group_id, CASE WHEN valid_at > TIMESTAMP '{AS_OF}' THEN 'hidden' WHEN invalid_at <= TIMESTAMP '{AS_OF}' THEN 'gone' ELSE 'current' END AS state,
  count(*) AS n FROM states GROUP BY ALL""",
    ),
)
def edge_state_counts(spark, d):
    return graph.edge_state_counts(priority_states(spark, d), temporal.as_of_state(F.col("valid_at"), F.col("invalid_at"), stamp(AS_OF)))


@query("as_at_nodes", with_views("nodes", " SELECT node_id FROM nodes WHERE created_at <= TIMESTAMP '2024-01-01 02:00:00' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-01-01 02:00:00')"))
def as_at_nodes(spark, d):
    return temporal.as_at(views.nodes(spark, d), stamp("2024-01-01 02:00:00")).select("node_id")


@query(
    "event_span",
    with_views("priority observations", f" SELECT strftime(min(t), {TIME}) AS first, strftime(max(t), {TIME}) AS last FROM (SELECT valid_at AS t FROM priority UNION ALL SELECT occurred_at FROM observations)"),
)
def event_span(spark, d):
    times = views.priority_edges(spark, d).select(F.col("valid_at").alias("t")).union(views.observations(spark, d).select("occurred_at"))
    return times.agg(time_text(F.min("t")).alias("first"), time_text(F.max("t")).alias("last"))


@query("label_domain", with_views("nodes", " SELECT DISTINCT coalesce(list_filter(labels, lambda l: l <> 'Entity')[1], 'Entity') AS label FROM nodes WHERE expired_at IS NULL"))
def label_domain(spark, d):
    from chronoweave.functions.text import primary_label

    return store.live(views.nodes(spark, d)).select(primary_label(F.col("labels")).alias("label")).distinct()


@query(
    "visible_edges",
    with_views(
        "place nodes",
        """ SELECT edge_id FROM place WHERE src IN (SELECT node_id FROM nodes WHERE expired_at IS NULL)
  AND dst IN (SELECT node_id FROM nodes WHERE expired_at IS NULL)""",
    ),
)
def visible_edges(spark, d):
    return graph.visible(views.nodes(spark, d), views.place_edges(spark, d)).select("edge_id")


def _window_sql(keys: str) -> str:
    return with_views(
        "observations",
        f""" SELECT episode_id, coalesce(array_to_string(list(episode_id) OVER (PARTITION BY {keys} ORDER BY occurred_at, seq
  ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '|'), '') AS previous FROM observations""",
    )


@query("previous_window", _window_sql("group_id, kind"))
def previous_window(spark, d):
    return graph.previous_window(views.observations(spark, d), ["group_id", "kind"]).select("episode_id", F.array_join("previous", "|").alias("previous"))


@query("previous_window_all_kinds", _window_sql("group_id"))
def previous_window_all_kinds(spark, d):
    return graph.previous_window(views.observations(spark, d), ["group_id"]).select("episode_id", F.array_join("previous", "|").alias("previous"))


@query("mentions_of", with_views("supply", " SELECT src || '>' || dst AS target_id, array_to_string(list_sort(list(DISTINCT episode_id)), '|') AS episodes FROM supply GROUP BY ALL"))
def mentions_of(spark, d):
    m = views.supply_edges(spark, d).select(F.concat("src", F.lit(">"), "dst").alias("target_id"), "episode_id")
    return graph.provenance(m).select("target_id", F.array_join("episodes", "|").alias("episodes"))


@query("merge_chain", with_views("nodes", " SELECT node_id, merged_into AS into_id, 1::BIGINT AS hops FROM nodes WHERE merged_into IS NOT NULL"))
def merge_chain(spark, d):
    return graph.canonical(views.nodes(spark, d)).select("node_id", F.col("into").alias("into_id"), F.col("hops").cast("bigint").alias("hops"))


@query(
    "remapped_edges",
    with_views(
        "supply nodes",
        """ SELECT edge_id, coalesce(a.merged_into, src) AS src, coalesce(b.merged_into, dst) AS dst FROM supply
  LEFT JOIN nodes a ON a.node_id = src LEFT JOIN nodes b ON b.node_id = dst WHERE coalesce(a.merged_into, src) <> coalesce(b.merged_into, dst)""",
    ),
)
def remapped_edges(spark, d):
    return graph.remapped(views.supply_edges(spark, d), graph.canonical(views.nodes(spark, d))).select("edge_id", "src", "dst")


@query(
    "node_history",
    with_views(
        "supply",
        f""" SELECT node_id, edge_id, strftime(valid_at, {TIME}) AS valid_at, row_number() OVER (PARTITION BY node_id ORDER BY supply_at, edge_id) AS pos
  FROM (SELECT src AS node_id, *, valid_at AS supply_at FROM supply UNION ALL SELECT dst, *, valid_at FROM supply)""",
    ),
)
def node_history(spark, d):
    """Histories of all nodes, in the order in which facts were made."""
    e = views.supply_edges(spark, d).withColumn("created_at", F.col("valid_at"))
    return graph.in_order(graph.history(e, views.nodes(spark, d))).select("node_id", "edge_id", time_text("valid_at").alias("valid_at"), "pos")


def _traverse_sql(where: str) -> str:
    return with_views(
        "place",
        f""", both_ways AS (SELECT src AS a, dst AS b FROM place {where} UNION SELECT dst, src FROM place {where}),
walk(node_id, depth) AS (SELECT 'region:1', 0 UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = node_id WHERE depth < 2)
SELECT node_id, min(depth)::BIGINT AS depth FROM walk GROUP BY node_id""",
        recursive=True,
    )


@query("traverse_depth2", _traverse_sql(""))
def traverse_depth2(spark, d):
    seeds = spark.createDataFrame([("region:1",)], "node_id string")
    return graph.traverse(views.place_edges(spark, d), seeds, 2, None).select("node_id", F.col("depth").cast("bigint").alias("depth"))


@query("traverse_asof", _traverse_sql("WHERE valid_at <= TIMESTAMP '2024-01-01 05:00:00'"))
def traverse_asof(spark, d):
    edges = views.place_edges(spark, d)
    edges = edges.where(temporal.as_of_state(F.col("valid_at"), F.lit(None).cast("timestamp_ntz"), stamp("2024-01-01 05:00:00")) == "current")
    seeds = spark.createDataFrame([("region:1",)], "node_id string")
    return graph.traverse(edges, seeds, 2, None).select("node_id", F.col("depth").cast("bigint").alias("depth"))


@query(
    "traverse_budget",
    with_views(
        "place",
        """, both_ways AS (SELECT src AS a, dst AS b FROM place UNION SELECT dst, src FROM place),
walk(node_id, depth) AS (SELECT 'region:1', 0 UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = node_id WHERE depth < 3)
SELECT node_id, min(depth)::BIGINT AS depth FROM walk GROUP BY node_id ORDER BY 2, 1 LIMIT 256""",
        recursive=True,
    ),
)
def traverse_budget(spark, d):
    seeds = spark.createDataFrame([("region:1",)], "node_id string")
    return graph.traverse(views.place_edges(spark, d), seeds).select("node_id", F.col("depth").cast("bigint").alias("depth"))


@query(
    "format_turns",
    """WITH u AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations)
SELECT conv_id, turn, 'User: ' || question || chr(10) || 'Assistant: ' || coalesce(answer, '') AS content FROM u
WHERE role = 'user' AND NOT (trim(question) = '' AND trim(coalesce(answer, '')) = '')""",
)
def format_turns(spark, d):
    return store.formatted_turns(table(spark, d, "conversations"))


@query("queue_drop_oldest", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def queue_drop_oldest(spark, d):
    return store.newest(table(spark, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn")


@query(
    "export_records",
    with_views(
        "nodes place",
        """ SELECT to_json({t: 'node', id: node_id, name: name, group_id: group_id})::VARCHAR AS line FROM nodes
  UNION ALL SELECT to_json({t: 'edge', id: edge_id, src: src, dst: dst, fact: fact})::VARCHAR FROM place
  UNION ALL SELECT to_json({t: 'mention', episode_id: episode_id, target_id: edge_id})::VARCHAR FROM place""",
    ),
)
def export_records(spark, d):
    n = views.nodes(spark, d).select(F.col("node_id").alias("id"), "name", "group_id")
    e = views.place_edges(spark, d)
    return store.tagged_lines({"node": n, "edge": e.select(F.col("edge_id").alias("id"), "src", "dst", "fact"), "mention": e.select("episode_id", F.col("edge_id").alias("target_id"))})
