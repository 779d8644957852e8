"""Aliases, differences, replay and ingestion over the views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from chronoweave.functions.jsontext import canonical_json, python_repr, spaced_json
from chronoweave.functions.timestamps import iso_seconds
from chronoweave.models import providers
from chronoweave.operators import conformance, ingest
from chronoweave.plans import views
from chronoweave.plans.views import with_views
from chronoweave.session import materialize, table
from chronoweave.sources import store

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


ALIASES = """, na AS (SELECT node_id, 'n' || (row_number() OVER (PARTITION BY group_id ORDER BY name, node_id) - 1) AS alias FROM nodes),
ea AS (SELECT edge_id, 'e' || (row_number() OVER (PARTITION BY group_id ORDER BY fact, a.alias, b.alias, edge_id) - 1) AS alias
  FROM place LEFT JOIN na a ON a.node_id = src LEFT JOIN na b ON b.node_id = dst)"""


@query("content_alias", with_views("nodes place", ALIASES + " SELECT node_id AS id, alias FROM na UNION ALL SELECT edge_id, alias FROM ea"))
def content_alias(spark, d):
    n = conformance.aliased(views.nodes(spark, d), "n", ["name", "node_id"])
    e = conformance.edge_aliases(views.place_edges(spark, d), n)
    return n.select(F.col("node_id").alias("id"), "alias").unionByName(e.select(F.col("edge_id").alias("id"), "alias"))


@query(
    "state_diff",
    """WITH l AS (SELECT * FROM customer WHERE c_acctbal >= 0), r AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_name END AS c_name,
  CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, 'row' AS field, CASE WHEN l.c_custkey IS NULL THEN 'absent' ELSE 'present' END AS left_value,
  CASE WHEN r.c_custkey IS NULL THEN 'absent' ELSE 'present' END AS right_value FROM l FULL JOIN r ON l.c_custkey = r.c_custkey WHERE l.c_custkey IS NULL OR r.c_custkey IS NULL
UNION ALL SELECT l.c_custkey, 'c_name', l.c_name, r.c_name FROM l JOIN r USING (c_custkey) WHERE l.c_name IS DISTINCT FROM r.c_name
UNION ALL SELECT l.c_custkey, 'c_mktsegment', l.c_mktsegment, r.c_mktsegment FROM l JOIN r USING (c_custkey) WHERE l.c_mktsegment IS DISTINCT FROM r.c_mktsegment""",
)
def state_diff(spark, d):
    """Customers in two states: some rows are on one side only, some names and segments differ."""
    c = table(spark, d, "customer")
    right = c.where("c_mktsegment <> 'MACHINERY'").select(
        "c_custkey", F.when(F.col("c_nationkey") == 3, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_acctbal") <= 9000, F.col("c_mktsegment")).alias("c_mktsegment")
    )
    return conformance.state_difference(c.where("c_acctbal >= 0"), right, "c_custkey", ["c_name", "c_mktsegment"])


def _requests(spark, d):
    """Chat turns as requests, with keys in an order that replay has to see through."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.to_json(F.struct("turn", "text", "conv_id")).alias("request"), F.to_json(F.struct("conv_id", "text", "turn")).alias("other"))


@query("replay_lookup", "SELECT conv_id, turn, 'reply to ' || conv_id || '-' || turn AS reply FROM conversations")
def replay_lookup(spark, d):
    r = _requests(spark, d)
    reply = F.concat(F.lit("reply to "), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    log = r.select(F.col("other").alias("request"), reply.alias("response"), F.lit(2).alias("seq"))
    older = r.select("request", F.lit("overwritten").alias("response"), F.lit(1).alias("seq"))
    return providers.replayed(r.select("conv_id", "turn", "request"), providers.loaded_recordings(log.unionByName(older))).select("conv_id", "turn", "reply")


@query("canonical_json", "SELECT conv_id, turn, to_json({conv_id: conv_id, text: text, turn: turn})::VARCHAR AS json FROM conversations")
def canonical(spark, d):
    return _requests(spark, d).select("conv_id", "turn", canonical_json(F.col("request")).alias("json"))


@query(
    "attributed_edges",
    with_views("priority", " SELECT episode_id, edge_id FROM priority WHERE valid_at >= TIMESTAMP '1996-01-01 00:00:00'"),
)
def attributed_edges(spark, d):
    e = views.priority_edges(spark, d)
    return conformance.attributed(e.select("episode_id", "edge_id"), e.where(F.col("valid_at") >= views.stamp("1996-01-01 00:00:00")))


@query("facts_outside", with_views("place priority", " SELECT DISTINCT fact FROM priority WHERE fact NOT IN (SELECT fact FROM place)"))
def facts_outside(spark, d):
    results = views.priority_edges(spark, d).select("fact").distinct()
    return conformance.results_outside(results, views.place_edges(spark, d)).select("fact")


@query(
    "graph_dump",
    with_views(
        "nodes place messages",
        """ SELECT group_id, 'nodes' AS section, node_id AS id, to_json({id: node_id, name: name})::VARCHAR AS json FROM nodes
  UNION ALL SELECT group_id, 'edges', edge_id, to_json({id: edge_id, src: src, dst: dst, fact: fact})::VARCHAR FROM place
  UNION ALL SELECT group_id, 'episodes', episode_id, to_json({id: episode_id, content: content})::VARCHAR FROM messages""",
    ),
)
def graph_dump(spark, d):
    n = views.nodes(spark, d).select("node_id", "group_id", "name")
    e = views.place_edges(spark, d).select("edge_id", "group_id", "src", "dst", "fact")
    p = views.messages(spark, d).select("episode_id", "group_id", "content")
    return store.graph_dump(n, e, p)


def _nation_json(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", F.array("n_regionkey", F.lit(1)).alias("at"))).alias("j"))


@query("spaced_json", """SELECT n_nationkey, '{"n_nationkey": ' || n_nationkey || ', "n_name": "' || n_name || '", "at": [' || n_regionkey || ', 1]}' AS json FROM nation""")
def spaced(spark, d):
    return _nation_json(spark, d).select("n_nationkey", spaced_json("j").alias("json"))


@query("python_repr", """SELECT n_nationkey, '{''n_nationkey'': ' || n_nationkey || ', ''n_name'': ''' || n_name || ''', ''at'': [' || n_regionkey || ', 1]}' AS literal FROM nation""")
def shown(spark, d):
    return _nation_json(spark, d).select("n_nationkey", python_repr("j").alias("literal"))


@query("expiry_agrees", "SELECT o_orderkey, (o_orderstatus = 'F') = (o_custkey % 3 = 0) AS agrees FROM orders")
def expiry_agrees(spark, d):
    """Filled orders as expired, those of every third customer as bounded."""
    o = table(spark, d, "orders")
    at = lambda when: F.when(when, F.col("o_orderdate"))
    return o.select("o_orderkey", conformance.expiry_agrees(at(F.col("o_orderstatus") == "F"), at(F.col("o_custkey") % 3 == 0)).alias("agrees"))


@query(
    "add_episode_batch",
    """WITH m AS (SELECT DISTINCT o_custkey AS c, left(o_orderpriority, 1) AS p, year(o_orderdate) AS y FROM orders),
f AS (SELECT c, p, min(y) AS y, count(*) AS n FROM m GROUP BY ALL), fresh AS (SELECT c, y, min(p) AS p FROM f GROUP BY ALL),
l AS (SELECT f.c, f.p, min(fresh.y) AS later FROM f JOIN fresh ON fresh.c = f.c AND fresh.y > f.y LEFT JOIN m ON m.c = f.c AND m.p = f.p AND m.y = fresh.y
  WHERE m.p IS NULL OR f.p > fresh.p GROUP BY ALL)
SELECT 'c' || c AS group_id, 'c' || c || ' PREFERS p' || p AS fact, y || '-01-01T00:00:00+00:00' AS valid_at, later || '-01-01T00:00:00+00:00' AS invalid_at, n AS n_episodes
FROM f LEFT JOIN l USING (c, p)""",
)
def add_episode_batch(spark, d):
    """All orders, a customer's of one year as an episode, ingested year by year: the facts, their bounds and how many episodes hold them.

    A year's first fact that is new ends those of earlier years, but for what the year has said again by then.
    """
    from pyspark.sql import Window

    who = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    o = table(spark, d, "orders").select(who.alias("group_id"), F.year("o_orderdate").alias("year"), F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))).alias("what"))
    years = o.groupBy("group_id", "year").agg(F.sort_array(F.collect_set("what")).alias("what"))  # a handful of priorities
    line = lambda x: F.concat(F.col("group_id"), F.lit(" PREFERS "), x)
    said = F.concat(F.array(F.concat("group_id", F.lit(": hello"))), F.transform("what", lambda x: F.concat(x, F.lit(": hello"))), F.transform("what", line))
    episodes = materialize(
        years.select(
            F.concat_ws("-", F.lit("ep"), "group_id", "year").alias("episode_id"), "group_id", F.lit("text").alias("kind"), F.lit("orders").alias("source"),
            F.array_join(said, "\n").alias("content"), F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("valid_at"),
            F.row_number().over(Window.partitionBy("group_id").orderBy("year")).cast("bigint").alias("seq"),
        )
    )
    types = spark.createDataFrame([(1, "Person")], "type_id bigint, type_name string")
    now = F.lit(views.NOW).cast("timestamp")
    nodes, edges = (spark.createDataFrame([], store.SCHEMAS[n]) for n in ("nodes", "edges"))
    mentions = []
    for k in range(1, (episodes.agg(F.max("seq")).first()[0] or 0) + 1):
        now_in = episodes.where(F.col("seq") == k)
        c = ingest.step(now_in, nodes, edges, providers.rule_entities(now_in), providers.rule_edges(now_in), types, now, ("PREFERS",))
        mentions.append(materialize(c.mentions.where("target_kind = 'edge'").select("target_id")))
        edges = materialize(ingest.upserted(ingest.bounded(edges, c.bounds), c.edges, "edge_id"))
        nodes = materialize(ingest.upserted(nodes, c.nodes, "node_id"))
    if not mentions:
        mentions = [spark.createDataFrame([], "target_id string")]
    held = reduce(DataFrame.unionByName, mentions).groupBy(F.col("target_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("n_episodes"))
    return edges.join(held, "edge_id").select("group_id", "fact", iso_seconds(F.col("valid_at")).alias("valid_at"), iso_seconds(F.col("invalid_at")).alias("invalid_at"), "n_episodes")
