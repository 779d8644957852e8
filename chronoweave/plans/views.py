"""Episodes, nodes, edges and facts over the star-schema tables, in Spark and as DuckDB text.

Tables without a time column get one from their sequence: BASE plus as many minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.session import table

BASE = "2024-01-01 00:00:00"
NOW = "2030-01-01 00:00:00"


def time_text(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def stamp(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def _minutes(c: str):
    return F.expr(f"timestamp_ntz'{BASE}' + make_dt_interval(0, 0, {c}, 0)")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("episode_id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("group_id"),
        F.lit("message").alias("kind"),
        F.concat("role", F.lit(": "), "text").alias("content"),
        _minutes("turn").alias("occurred_at"),
        F.col("turn").alias("seq"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("episode_id"),
        F.col("source").alias("group_id"),
        F.lit("text").alias("kind"),
        F.col("text").alias("content"),
        _minutes("doc_id").alias("occurred_at"),
        F.col("doc_id").alias("seq"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodes of their user; errors are messages, so that a group holds two kinds."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("episode_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("group_id"),
        F.when(F.col("event_type") == "error", "message").otherwise("json").alias("kind"),
        F.col("props").alias("content"),
        F.col("ts").alias("occurred_at"),
        F.col("event_id").alias("seq"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business tables as nodes. Parts of even size have no specific label; those of a repeated name are merged into the first of it."""

    def one(name, key, label, column, labels=None, merged=None):
        t = table(spark, sf_dir, name)
        return t.select(
            F.concat(F.lit(f"{label.lower()}:"), F.col(key).cast("string")).alias("node_id"),
            F.lit(label.lower()).alias("group_id"),
            F.col(column).alias("name"),
            labels if labels is not None else F.array(F.lit("Entity"), F.lit(label)).alias("labels"),
            F.col(key).cast("bigint").alias("seq"),
        )

    bare = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Entity"))).otherwise(F.array(F.lit("Entity"), F.lit("Part"))).alias("labels")
    out = one("customer", "c_custkey", "Customer", "c_name")
    for args in (("supplier", "s_suppkey", "Supplier", "s_name"), ("part", "p_partkey", "Part", "p_name", bare)):
        out = out.unionByName(one(*args))
    for args in (("nation", "n_nationkey", "Nation", "n_name"), ("region", "r_regionkey", "Region", "r_name")):
        out = out.unionByName(one(*args))
    first = out.groupBy("group_id", "name").agg(F.min("seq").alias("first"))
    merged = out.join(first, ["group_id", "name"])
    gone = F.col("seq") != F.col("first")
    return merged.select(
        "node_id", "group_id", "name", "labels", "seq",
        _minutes("cast(seq as int)").alias("created_at"),
        F.when(gone, _minutes("cast(seq + 1 as int)")).alias("expired_at"),
        F.when(gone, F.concat("group_id", F.lit(":"), F.col("first").cast("string"))).alias("merged_into"),
    )


def _edges(df: DataFrame, kind: str, key, src, rel: str, dst, valid_at) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{kind}:"), key).alias("edge_id"), F.lit(kind).alias("group_id"), src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"),
        F.concat_ws(" ", src, F.lit(rel), dst).alias("fact"), valid_at.alias("valid_at"), F.concat(F.lit("ep-"), key).alias("episode_id"),
    )


def priority_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's priority as of each order."""
    o = table(spark, sf_dir, "orders")
    src = F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))
    dst = F.concat(F.lit("priority:"), F.col("o_orderpriority"))
    return _edges(o, "order", F.col("o_orderkey").cast("string"), src, "HAS_PRIORITY", dst, F.col("o_orderdate"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplies of parts; line numbers repeat within an order, so the parts and suppliers are in the key."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"))
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    src = F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string"))
    dst = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    return _edges(li, "supply", key, src, "SUPPLIES", dst, F.col("l_shipdate"))


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    of = lambda prefix, key: F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))
    live = _edges(c, "place", of("c", "c_custkey"), of("customer", "c_custkey"), "LIVES_IN", of("nation", "c_nationkey"), _minutes("cast(c_custkey as int)"))
    part = _edges(n, "place", of("n", "n_nationkey"), of("nation", "n_nationkey"), "PART_OF", of("region", "n_regionkey"), _minutes("cast(n_nationkey as int)"))
    return live.unionByName(part)


#: The same views as DuckDB common table expressions.
SQL = {
    "messages": f"""messages AS (SELECT 'conv-' || conv_id || '-' || turn AS episode_id, 'conv-' || conv_id AS group_id, 'message' AS kind,
  role || ': ' || text AS content, TIMESTAMP '{BASE}' + to_minutes(turn) AS occurred_at, turn AS seq FROM conversations)""",
    "texts": f"""texts AS (SELECT 'doc-' || doc_id AS episode_id, source AS group_id, 'text' AS kind, text AS content,
  TIMESTAMP '{BASE}' + to_minutes(doc_id) AS occurred_at, doc_id AS seq FROM documents)""",
    "observations": """observations AS (SELECT 'event-' || event_id AS episode_id, 'user-' || user_id AS group_id,
  CASE WHEN event_type = 'error' THEN 'message' ELSE 'json' END AS kind, props AS content, ts AS occurred_at, event_id AS seq FROM events)""",
    "nodes": f"""all_nodes AS (
  SELECT 'customer:' || c_custkey AS node_id, 'customer' AS group_id, c_name AS name, ['Entity', 'Customer'] AS labels, c_custkey::BIGINT AS seq FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, ['Entity', 'Supplier'], s_suppkey::BIGINT FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, CASE WHEN p_size % 2 = 0 THEN ['Entity'] ELSE ['Entity', 'Part'] END, p_partkey::BIGINT FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, ['Entity', 'Nation'], n_nationkey::BIGINT FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, ['Entity', 'Region'], r_regionkey::BIGINT FROM region),
first_nodes AS (SELECT group_id, name, min(seq) AS first FROM all_nodes GROUP BY group_id, name),
nodes AS (SELECT node_id, group_id, name, labels, seq, TIMESTAMP '{BASE}' + to_minutes(seq) AS created_at,
  CASE WHEN seq <> first THEN TIMESTAMP '{BASE}' + to_minutes(seq + 1) END AS expired_at,
  CASE WHEN seq <> first THEN group_id || ':' || first END AS merged_into
  FROM all_nodes JOIN first_nodes USING (group_id, name))""",
    "priority": """priority AS (SELECT 'order:' || o_orderkey AS edge_id, 'order' AS group_id, 'customer:' || o_custkey AS src, 'HAS_PRIORITY' AS rel,
  'priority:' || o_orderpriority AS dst, 'customer:' || o_custkey || ' HAS_PRIORITY priority:' || o_orderpriority AS fact,
  o_orderdate AS valid_at, 'ep-' || o_orderkey AS episode_id FROM orders)""",
    "supply": """supply AS (SELECT 'supply:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS edge_id, 'supply' AS group_id, 'supplier:' || l_suppkey AS src,
  'SUPPLIES' AS rel, 'part:' || l_partkey AS dst, 'supplier:' || l_suppkey || ' SUPPLIES part:' || l_partkey AS fact,
  min(l_shipdate) AS valid_at, 'ep-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS episode_id
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber)""",
    "place": f"""place AS (SELECT 'place:c:' || c_custkey AS edge_id, 'place' AS group_id, 'customer:' || c_custkey AS src, 'LIVES_IN' AS rel,
  'nation:' || c_nationkey AS dst, 'customer:' || c_custkey || ' LIVES_IN nation:' || c_nationkey AS fact,
  TIMESTAMP '{BASE}' + to_minutes(c_custkey) AS valid_at, 'ep-c:' || c_custkey AS episode_id FROM customer
  UNION ALL SELECT 'place:n:' || n_nationkey, 'place', 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey,
  'nation:' || n_nationkey || ' PART_OF region:' || n_regionkey, TIMESTAMP '{BASE}' + to_minutes(n_nationkey), 'ep-n:' || n_nationkey FROM nation)""",
}


def with_views(names: str, select: str, recursive: bool = False) -> str:
    """A DuckDB statement over some of the views; `select` may begin with further expressions and a comma before each."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(SQL[n] for n in names.split())}{select}"


TIME = "'%Y-%m-%dT%H:%M:%S'"
