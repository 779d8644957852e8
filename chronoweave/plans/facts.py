"""Extraction, edge resolution, summaries and search over the edge views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.functions import text
from chronoweave.functions.timestamps import iso_millis, iso_seconds, parse_time
from chronoweave.operators import extraction, resolution, search, summaries, temporal
from chronoweave.plans import views
from chronoweave.plans.names import COSINE, exact
from chronoweave.plans.views import TIME, time_text, with_views
from chronoweave.session import materialize, scratch_dir, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


NOW = "2030-01-01 00:00:00"
now = lambda: F.lit(NOW).cast("timestamp_ntz")


@query(
    "type_map_exclude",
    """SELECT event_id, CASE user_id % 7 WHEN 1 THEN 'Person' WHEN 2 THEN 'Place' WHEN 3 THEN 'Topic' ELSE 'Entity' END AS type_name,
  CASE user_id % 7 WHEN 1 THEN 'Entity|Person' WHEN 2 THEN 'Entity|Place' ELSE 'Entity' END AS labels FROM events WHERE user_id % 7 <> 3 AND trim(event_type) <> ''""",
)
def type_map_exclude(spark, d):
    types = spark.createDataFrame([(1, "Person"), (2, "Place"), (3, "Topic")], "type_id bigint, type_name string")
    out = spark.createDataFrame([("Topic",)], "type_name string")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), (F.col("user_id") % 7).alias("type_id"))
    return extraction.mapped_types(extraction.named(e), types, out).select("event_id", "type_name", F.array_join("labels", "|").alias("labels"))


@query(
    "clamp_indices",
    """WITH e AS (SELECT event_id, [user_id % 5 - 1, event_id % 6] AS i, user_id % 4 AS n FROM events)
SELECT event_id, array_to_string(CASE WHEN len(list_filter(i, lambda x: x >= 0 AND x < n)) > 0 THEN list_filter(i, lambda x: x >= 0 AND x < n) ELSE range(n) END, '|') AS indices FROM e""",
)
def clamp_indices(spark, d):
    e = table(spark, d, "events")
    kept = text.clamped_indices(F.array(F.col("user_id") % 5 - 1, F.col("event_id") % 6), F.col("user_id") % 4)
    return e.select("event_id", F.array_join(F.transform(kept, lambda i: i.cast("string")), "|").alias("indices"))


@query(
    "endpoint_validate",
    """WITH n AS (SELECT l_orderkey AS episode_id, 'p' || (l_partkey % 50) AS name, l_linenumber AS pos, l_partkey % 5 AS node FROM lineitem),
m AS (SELECT episode_id, name, arg_max(node, pos) AS node FROM n GROUP BY ALL),
f AS (SELECT l_orderkey AS episode_id, l_linenumber AS pos, 'p' || (l_partkey % 50) AS a, 'p' || (l_suppkey % 50) AS b, CASE WHEN l_quantity < 5 THEN '  ' ELSE 'fact' END AS fact FROM lineitem)
SELECT f.episode_id, f.pos, x.node AS src, y.node AS dst FROM f JOIN m x ON x.episode_id = f.episode_id AND x.name = a JOIN m y ON y.episode_id = f.episode_id AND y.name = b
WHERE trim(fact) <> '' AND x.node <> y.node""",
)
def endpoint_validate(spark, d):
    li = table(spark, d, "lineitem")
    name = lambda c: F.concat(F.lit("p"), (F.col(c) % 50).cast("string"))
    drafts = li.select(F.col("l_orderkey").alias("episode_id"), name("l_partkey").alias("name"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 5).alias("node_id"))
    facts = li.select(
        F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("pos"), name("l_partkey").alias("source_name"), name("l_suppkey").alias("target_name"),
        F.when(F.col("l_quantity") < 5, "  ").otherwise("fact").alias("fact"),
    )
    return extraction.resolved_endpoints(facts, drafts).select("episode_id", "pos", "src", "dst")


@query(
    "reference_times",
    f"""WITH e AS (SELECT user_id, list(strftime(ts, {TIME}) ORDER BY event_id) AS ts FROM events GROUP BY user_id)
SELECT user_id, coalesce(CASE WHEN user_id % 6 < len(ts) THEN ts[user_id % 6 + 1] END, ts[1]) AS reference_time, list_max(ts) AS latest, replace(ts[1], 'T', ' ') AS spaced FROM e""",
)
def reference_times(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", time_text("ts").alias("t")))), lambda x: x["t"]).alias("ts"))
    first = F.get("ts", 0)
    return e.select(
        "user_id", extraction.reference_time(F.array(F.col("user_id") % 6), F.col("ts"), first).alias("reference_time"), extraction.latest(F.col("ts")).alias("latest"), text.spaced_time(first).alias("spaced")
    )


@query(
    "collapse_draft_edges",
    with_views(
        "supply",
        f""", p AS (SELECT edge_id, src, dst, CASE WHEN length(edge_id) % 2 = 0 THEN upper(fact) ELSE fact || ' ' END AS fact FROM supply)
SELECT min(edge_id) AS edge_id FROM p GROUP BY src, dst, {exact('fact')}""",
    ),
)
def collapse_draft_edges(spark, d):
    e = views.supply_edges(spark, d)
    fact = F.when(F.length("edge_id") % 2 == 0, F.upper("fact")).otherwise(F.concat("fact", F.lit(" ")))
    drafts = e.select(F.lit("all").alias("episode_id"), "edge_id", "src", "dst", fact.alias("fact"), F.col("edge_id").alias("pos"))
    return extraction.collapse_edges(drafts).select("edge_id")


SMALL_GROUPS = """, g AS (SELECT edge_id, src AS group_id, src, dst, fact, valid_at FROM priority),
dr AS (SELECT edge_id AS draft_id, src AS group_id, src, dst FROM g)"""


def _priority_groups(spark, d):
    """Orders' edges with a group for each customer, as stored edges and as drafts."""
    e = views.priority_edges(spark, d).withColumn("group_id", F.col("src"))
    return e, e.withColumnRenamed("edge_id", "draft_id")


@query(
    "candidate_pools",
    with_views(
        "priority",
        SMALL_GROUPS
        + """ SELECT draft_id, edge_id, CASE WHEN g.src = dr.src AND g.dst = dr.dst THEN 'related' ELSE 'pool' END AS list,
  row_number() OVER (PARTITION BY draft_id ORDER BY (g.src = dr.src AND g.dst = dr.dst) DESC, fact, edge_id) - 1 AS idx FROM dr JOIN g USING (group_id)""",
    ),
)
def candidate_pools(spark, d):
    stored, drafts = _priority_groups(spark, d)
    return resolution.candidate_lists(drafts, stored).select("draft_id", "edge_id", "list", "idx")


@query(
    "verbatim_fast_path",
    with_views(
        "supply",
        f""", s AS (SELECT group_id, src, dst, {exact('fact')} AS norm, min((fact, edge_id)) AS m FROM supply GROUP BY ALL)
SELECT d.edge_id AS draft_id, m[2] AS edge_id FROM supply d JOIN s ON s.src = d.src AND s.dst = d.dst AND norm = {exact("upper(d.fact)")}""",
    ),
)
def verbatim_fast_path(spark, d):
    e = views.supply_edges(spark, d)
    return resolution.verbatim(e.withColumn("fact", F.upper("fact")).withColumnRenamed("edge_id", "draft_id"), e)


@query(
    "judged_indices",
    """WITH j AS (SELECT o_orderkey AS draft_id, [o_custkey % 7 - 1, o_orderkey % 4, o_custkey % 3] AS i, o_custkey % 4 AS related, o_orderkey % 3 AS pool FROM orders),
e AS (SELECT draft_id, related, pool, unnest(i) AS i, generate_subscripts(i, 1) - 1 AS pos FROM j)
SELECT e.draft_id, e.pos, CASE WHEN e.i < e.related THEN 'related' ELSE 'pool' END AS list, CASE WHEN e.i < e.related THEN e.i ELSE e.i - e.related END AS at,
  list_filter(j.i, lambda x: x >= 0 AND x < j.related)[1] AS duplicate FROM e JOIN j USING (draft_id) WHERE e.i >= 0 AND e.i < e.related + e.pool""",
)
def judged_indices(spark, d):
    o = table(spark, d, "orders")
    ids = F.array(F.col("o_custkey") % 7 - 1, F.col("o_orderkey") % 4, F.col("o_custkey") % 3)
    j = o.select(F.col("o_orderkey").alias("draft_id"), ids.alias("contradicted"), (F.col("o_custkey") % 4).alias("n_related"), (F.col("o_orderkey") % 3).alias("n_pool"))
    dup = j.select("draft_id", resolution.first_duplicate(F.col("contradicted"), F.col("n_related")).alias("duplicate"))
    return resolution.split_contradictions(j).join(dup, "draft_id")


RAW_TIMES = f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+02:00'
  WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M') WHEN 4 THEN strftime(ts, '%Y') WHEN 5 THEN 'around ' || strftime(ts, '%Y-%m-%d') WHEN 6 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.250') ELSE strftime(ts, '%Y-%m') END AS raw, ts FROM events"""


@query(
    "parse_timestamps",
    f"""WITH r AS ({RAW_TIMES}) SELECT event_id, raw, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00+00:00')
  WHEN 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:00+00:00') WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS seconds,
  CASE event_id % 8 WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.250Z') WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00.000Z')
  WHEN 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:00.000Z') END AS millis FROM r""",
)
def parse_timestamps(spark, d):
    ts, k = F.col("ts"), F.col("event_id") % 8
    shown = lambda p: F.date_format(ts, p)
    raw = (
        F.when(k == 0, shown("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, shown("yyyy-MM-dd")).when(k == 2, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
        .when(k == 3, shown("yyyy-MM-dd'T'HH:mm")).when(k == 4, shown("yyyy")).when(k == 5, F.concat(F.lit("around "), shown("yyyy-MM-dd"))).when(k == 6, shown("yyyy-MM-dd HH:mm:ss'.250'")).otherwise(shown("yyyy-MM"))
    )
    out = table(spark, d, "events").select("event_id", raw.alias("raw"))
    t = parse_time(F.col("raw"))
    return out.select("event_id", "raw", iso_seconds(t).alias("seconds"), iso_millis(t).alias("millis"))


#: Facts of a customer with bounds: an order's edge ends 300 days after its start if its id ends in 3.
BOUNDED = """, b AS (SELECT edge_id, src, dst, valid_at, CASE WHEN edge_id LIKE '%3' THEN valid_at + INTERVAL 300 DAY END AS invalid_at FROM priority)"""


def _bounded(spark, d):
    e = views.priority_edges(spark, d)
    return e.withColumn("invalid_at", F.when(F.col("edge_id").endswith("3"), F.col("valid_at") + F.expr("interval 300 days")))


@query(
    "contradictions",
    with_views(
        "priority",
        BOUNDED
        + f""" SELECT a.edge_id AS draft_id, c.edge_id, strftime(a.valid_at, {TIME}) AS invalid_at FROM b a JOIN b c ON a.src = c.src AND a.dst <> c.dst
  WHERE NOT coalesce(c.invalid_at <= a.valid_at, false) AND NOT coalesce(a.invalid_at <= c.valid_at, false) AND c.valid_at < a.valid_at""",
    ),
)
def contradictions(spark, d):
    e = _bounded(spark, d)
    other = e.select("src", F.col("edge_id").alias("old_id"), F.col("dst").alias("od"), F.col("valid_at").alias("ov"), F.col("invalid_at").alias("oi"))
    pairs = e.join(other, "src").where("dst <> od").where(temporal.invalidates(F.col("valid_at"), F.col("invalid_at"), F.col("ov"), F.col("oi")))
    return pairs.select(F.col("edge_id").alias("draft_id"), F.col("old_id").alias("edge_id"), time_text("valid_at").alias("invalid_at"))


@query(
    "self_expiry",
    with_views(
        "priority",
        BOUNDED
        + f""", n AS (SELECT a.edge_id, min(c.valid_at) AS later FROM b a JOIN b c ON a.src = c.src AND a.dst <> c.dst AND c.valid_at > a.valid_at GROUP BY a.edge_id)
SELECT edge_id, strftime(CASE WHEN invalid_at IS NULL THEN later ELSE invalid_at END, {TIME}) AS invalid_at,
  CASE WHEN invalid_at IS NOT NULL OR later IS NOT NULL THEN '{NOW.replace(' ', 'T')}' END AS expired_at FROM b LEFT JOIN n USING (edge_id)""",
    ),
)
def self_expiry(spark, d):
    e = _bounded(spark, d).withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))
    # of all later starts of another object the next is enough: two windows by subject, no pairs
    cand = temporal.superseded(e.drop("invalid_at"), ["src"]).where("invalid_at is not null").select("edge_id", F.col("invalid_at").alias("valid_at"))
    out = temporal.self_expired(e, cand, ["edge_id"], now())
    return out.select("edge_id", time_text("invalid_at").alias("invalid_at"), time_text("expired_at").alias("expired_at"))


DECISIONS = """, d AS (SELECT 'ep-' || (l_orderkey % 500) AS episode_id, 'e-' || (l_partkey % 300) AS edge_id, l_orderkey * 10 + l_linenumber AS seq,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_shipdate END AS invalid_at FROM lineitem),
f AS (SELECT episode_id, edge_id, arg_min_null(invalid_at, seq) AS invalid_at FROM d GROUP BY ALL)"""


def _decisions(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("ep-"), (F.col("l_orderkey") % 500).cast("string")).alias("episode_id"), F.concat(F.lit("e-"), (F.col("l_partkey") % 300).cast("string")).alias("edge_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") != 2, F.col("l_shipdate")).alias("invalid_at"),
    )


@query("first_wins_invalidation", "WITH x AS (SELECT 1)" + DECISIONS + f" SELECT episode_id, edge_id, strftime(invalid_at, {TIME}) AS invalid_at FROM f WHERE invalid_at IS NOT NULL")
def first_wins_invalidation(spark, d):
    return temporal.first_decisions(_decisions(spark, d)).select("episode_id", "edge_id", time_text("invalid_at").alias("invalid_at"))


@query("min_fold", "WITH x AS (SELECT 1)" + DECISIONS + f" SELECT edge_id, strftime(min(invalid_at), {TIME}) AS invalid_at FROM f WHERE invalid_at IS NOT NULL GROUP BY edge_id")
def min_fold(spark, d):
    return temporal.folded_bounds(temporal.first_decisions(_decisions(spark, d))).select("edge_id", time_text("invalid_at").alias("invalid_at"))


@query(
    "resolve_edges",
    with_views(
        "priority",
        f""", v AS (SELECT src, dst, min((fact, edge_id))[2] AS dup FROM priority GROUP BY src, dst),
r AS (SELECT p.edge_id AS draft_id, p.src, p.dst, CASE WHEN o_orderstatus = 'F' THEN dup END AS dup, p.valid_at FROM priority p JOIN orders ON p.edge_id = 'order:' || o_orderkey JOIN v USING (src, dst)),
q AS (SELECT r.* REPLACE (CASE WHEN dup IS NULL THEN r.valid_at ELSE s.valid_at END AS valid_at) FROM r LEFT JOIN priority s ON s.edge_id = r.dup),
x AS (SELECT q.draft_id, min(s.valid_at) AS later FROM q JOIN priority s ON s.src = q.src AND s.dst <> q.dst AND s.valid_at > q.valid_at GROUP BY q.draft_id),
y AS (SELECT q.*, later FROM q LEFT JOIN x USING (draft_id)),
z AS (SELECT y.draft_id, list_sort(list(s.edge_id)) AS ended FROM y JOIN priority s ON s.src = y.src AND s.dst <> y.dst AND s.valid_at < y.valid_at
  AND NOT coalesce(y.later <= s.valid_at, false) GROUP BY y.draft_id)
SELECT y.draft_id, dup AS duplicate_of, strftime(valid_at, {TIME}) AS valid_at, strftime(later, {TIME}) AS invalid_at, coalesce(array_to_string(ended, '|'), '') AS ended FROM y LEFT JOIN z USING (draft_id)""",
    ),
)
def resolve_edges(spark, d):
    """Orders as drafts against all of them: filled ones are judged duplicates, other objects of the customer contradict."""
    e = views.priority_edges(spark, d).withColumn("group_id", F.col("src"))
    none = F.lit(None).cast("timestamp_ntz")
    stored = e.withColumns({"invalid_at": none, "expired_at": none})
    drafts = stored.withColumnRenamed("edge_id", "draft_id").withColumns({"reference_time": F.col("valid_at"), "fact": F.concat(F.lit("now "), F.col("fact"))})
    filled = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("draft_id"))
    first = stored.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id"))
    judged = drafts.join(filled, "draft_id", "left_semi").select("draft_id", "src", "dst").join(first, ["src", "dst"]).select("draft_id", "edge_id")
    contra = drafts.select("draft_id", "src", F.col("dst").alias("dd")).join(stored.select("src", "dst", "edge_id"), "src").where("dst <> dd").select("draft_id", "edge_id")
    resolved, decisions = resolution.resolve_edges(drafts, stored, judged, contra, None, now())
    ended = decisions.groupBy("draft_id").agg(F.array_join(F.sort_array(F.collect_list("edge_id")), "|").alias("ended"))
    out = resolved.join(ended, "draft_id", "left")
    return out.select("draft_id", "duplicate_of", time_text("valid_at").alias("valid_at"), time_text("invalid_at").alias("invalid_at"), F.coalesce("ended", F.lit("")).alias("ended"))


@query(
    "summary_append",
    with_views(
        "priority",
        """, f AS (SELECT node_id, string_agg(fact, chr(10) ORDER BY pos) AS facts FROM (SELECT unnest([src, dst]) AS node_id, edge_id AS pos, fact FROM priority) GROUP BY node_id),
n AS (SELECT 'customer:' || c_custkey AS node_id, c_name AS name, c_custkey % 2 + 1 AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS summary FROM customer),
a AS (SELECT n.*, facts, trim(summary || coalesce(chr(10) || facts, ''), ' ' || chr(10)) AS once FROM n LEFT JOIN f USING (node_id)),
b AS (SELECT *, CASE WHEN length(once) <= 2000 AND once <> '' THEN once ELSE summary END AS first FROM a),
c AS (SELECT *, CASE WHEN k = 2 THEN trim(first || coalesce(chr(10) || facts, ''), ' ' || chr(10)) ELSE first END AS twice FROM b)
SELECT node_id, CASE WHEN k = 2 AND length(twice) <= 2000 AND twice <> '' THEN twice ELSE first END AS summary,
  (once <> '' AND length(once) > 2000) OR (k = 2 AND twice <> '' AND length(twice) > 2000) AS needs_model FROM c""",
    ),
)
def summary_append(spark, d):
    e = views.priority_edges(spark, d).withColumn("pos", F.col("edge_id"))
    n = table(spark, d, "customer").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 2 + 1).alias("n_drafts"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("summary"),
    )
    return summaries.refreshed(n, summaries.facts_by_node(e)).select("node_id", "summary", "needs_model")


@query("summary_flights", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 30 AS flight FROM customer")
def summary_flights(spark, d):
    return summaries.in_flights(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"]).select("c_custkey", "flight")


@query("embed_batches", "SELECT s_suppkey, (row_number() OVER (PARTITION BY s_nationkey % 2 ORDER BY s_suppkey) - 1) // 64 AS flight FROM supplier WHERE s_name <> ''")
def embed_batches(spark, d):
    s = table(spark, d, "supplier").where("s_name <> ''").withColumn("half", F.col("s_nationkey") % 2)
    return summaries.in_flights(s, ["half"], ["s_suppkey"], summaries.EMBED_BATCH).select("s_suppkey", "flight")


@query(
    "summary_apply",
    """WITH r AS (SELECT lower(p_name) AS k, arg_max(p_brand || ' no. ' || p_partkey, p_partkey) AS s FROM part GROUP BY 1)
SELECT p_partkey, coalesce(s, 'old') AS summary FROM part LEFT JOIN r ON k = lower(upper(p_name))""",
)
def summary_apply(spark, d):
    p = table(spark, d, "part")
    replies = p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit(" no. "), F.col("p_partkey").cast("string")).alias("summary"))
    nodes = p.select("p_partkey", F.upper("p_name").alias("name"), F.lit("old").alias("summary"))
    return summaries.applied(nodes, replies).select("p_partkey", "summary")


@query(
    "truncate_sentence",
    r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents),
c AS (SELECT *, regexp_extract(h, '^(.*[.!?](?:[\s\p{Z}]|$))', 1, 's') AS w FROM h)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(CASE WHEN w <> '' THEN w ELSE h END, '[\s\p{Z}]+$', '') END AS cut FROM c""",
)
def truncate_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_at_sentence(F.col("text"), 300).alias("cut"))


@query("sentence_end", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[.!?]($| \p{Lu})') THEN length(regexp_extract(text, '^(.*?)[.!?]($| \p{Lu})', 1, 's')) END AS at FROM documents")
def sentence_end(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentence_end(F.col("text")).cast("bigint").alias("at"))


@query(
    "concatenated_episodes",
    """WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS ts, list(CASE WHEN turn % 2 = 0 THEN 'turn ' || turn END ORDER BY turn) AS ws FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, len(ts) AS n, unnest(ts) AS t, unnest(ws) AS w, generate_subscripts(ts, 1) - 1 AS i FROM c)
SELECT conv_id, CASE WHEN max(n) = 1 THEN max(t) ELSE string_agg('[Episode ' || i || '] (timestamp: ' || coalesce(w, 'unknown') || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY i) END AS joined FROM e GROUP BY conv_id""",
)
def concatenated_episodes(spark, d):
    c = table(spark, d, "conversations")
    when = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("turn "), F.col("turn").cast("string")))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", when.alias("w")))).alias("r"))
    return rows.select("conv_id", text.concatenate_episodes(F.transform("r", lambda x: x["text"]), F.transform("r", lambda x: x["w"])).alias("joined"))


@query("strip_fences", "SELECT event_id, props AS json FROM events")
def strip_fences(spark, d):
    wrapped = F.concat(F.lit("  ```json\n"), "props", F.lit("\n``` "))
    return table(spark, d, "events").select("event_id", text.strip_fences(F.when(F.col("event_id") % 2 == 0, wrapped).otherwise(F.col("props"))).alias("json"))


@query("salvage_shape", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def salvage_shape(spark, d):
    echoed = F.concat(F.lit('{"title": "x", "properties": '), "props", F.lit("}"))
    reply = F.when(F.col("event_id") % 2 == 0, echoed).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(text.salvaged(reply, ["k"]), "$.k").cast("bigint").alias("k"))


@query("json_decode", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, 0::BIGINT AS first_index FROM events")
def json_decode(spark, d):
    e = table(spark, d, "events").withColumn("r", F.from_json("props", "struct<k: bigint, episode_indices: array<bigint>>"))
    return e.select("event_id", "r.k", F.get(F.coalesce("r.episode_indices", F.array(F.lit(0).cast("bigint"))), 0).alias("first_index"))


@query(
    "extract_pipeline",
    with_views(
        "messages",
        r""", s AS (SELECT episode_id, unnest(list_distinct(regexp_extract_all(content, '(?:^|\n)([^:\n]+):', 1))) AS name FROM messages)
SELECT episode_id, name, 'Entity|Person' AS labels, '0' AS indices FROM s""",
    ),
)
def extract_pipeline(spark, d):
    """Speakers of messages as a rule-based extractor replies with them, decoded to drafts."""
    from chronoweave.models import providers

    replies = providers.rule_entities(views.messages(spark, d))
    types = spark.createDataFrame([(1, "Person")], "type_id bigint, type_name string")
    out = extraction.extract_nodes(replies, types)
    return out.select("episode_id", "name", F.array_join("labels", "|").alias("labels"), F.array_join(F.transform("episode_indices", lambda i: i.cast("string")), "|").alias("indices"))


FACT_ROWS = ", c AS (SELECT edge_id AS id, fact, src, dst FROM supply)"
TERMS = {
    "words": "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')",
    "trigrams": "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3))) ELSE []::VARCHAR[] END",
}
LENGTH = {"words": "len(t)", "trigrams": "greatest(length(fact) - 2, 0)"}


def _leg(name: str, query_text: str) -> str:
    terms = TERMS[name]
    q = terms.format(f"'{query_text}'")
    return f""", {name}_t AS (SELECT id, t, {LENGTH[name]} AS n FROM (SELECT id, fact, {terms.format('fact')} AS t FROM c)), {name}_a AS (SELECT count(*) AS n, avg(n) AS a FROM {name}_t),
{name}_h AS (SELECT id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT id, n, unnest(t) AS term FROM {name}_t) WHERE list_contains({q}, term) GROUP BY id, term),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_h GROUP BY term),
{name}_s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM {name}_h JOIN {name}_d USING (term), {name}_a
  GROUP BY id HAVING count(*) = len(list_distinct({q}))),
{name}_r AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_s QUALIFY rank <= 100)"""


def _corpus(spark, d):
    """Facts as a table, which a search reads more than once."""
    return materialize(views.supply_edges(spark, d).select(F.col("edge_id").alias("id"), "fact", "src", "dst"))


WORD_QUERY, GRAM_QUERY = "supplier 7 part", "part:77"


@query("bm25_search", with_views("supply", FACT_ROWS + _leg("words", WORD_QUERY) + " SELECT id, rank FROM words_r"))
def bm25_search(spark, d):
    return search.ranked(search.bm25(_corpus(spark, d), WORD_QUERY, search.WORDS), 100).select("id", F.col("rank").cast("bigint").alias("rank"))


@query("trigram_search", with_views("supply", FACT_ROWS + _leg("trigrams", GRAM_QUERY) + " SELECT id, rank FROM trigrams_r"))
def trigram_search(spark, d):
    return search.ranked(search.bm25(_corpus(spark, d), GRAM_QUERY, search.TRIGRAMS), 100).select("id", F.col("rank").cast("bigint").alias("rank"))


QUERY_VECTOR = [1.0 if k % 2 else -0.5 for k in range(64)]


@query(
    "vector_search",
    f"""WITH q AS (SELECT {QUERY_VECTOR}::DOUBLE[] AS q) SELECT vec_id AS id, round({COSINE.format('embedding', 'q')}, 6) AS score FROM embeddings, q
WHERE {COSINE.format('embedding', 'q')} > 0 ORDER BY {COSINE.format('embedding', 'q')} DESC, vec_id LIMIT 25""",
)
def vector_search(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search.ranked(search.by_vector(v, QUERY_VECTOR), 25).select("id", F.round("score", 6).alias("score"))


@query(
    "hybrid_rrf",
    with_views(
        "supply",
        FACT_ROWS
        + _leg("words", "supplier 7")
        + _leg("trigrams", "supplier:7 ")
        + """, u AS (SELECT * FROM words_r UNION ALL SELECT * FROM trigrams_r)
SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, any_value(fact) AS fact FROM u JOIN c USING (id) GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 10""",
    ),
)
def hybrid_rrf(spark, d):
    c = _corpus(spark, d)
    legs = [search.ranked(search.bm25(c, "supplier 7", search.WORDS), 100), search.ranked(search.bm25(c, "supplier:7 ", search.TRIGRAMS), 100)]
    return search.fused(legs).join(c.select("id", "fact"), "id").select("id", F.round("score", 6).alias("score"), "fact")


@query(
    "graph_expansion",
    with_views(
        "supply",
        FACT_ROWS
        + """, h AS (SELECT * FROM c WHERE src = 'supplier:7'), n AS (SELECT src AS node FROM h UNION SELECT dst FROM h)
SELECT id, count(*)::DOUBLE AS score FROM (SELECT id, src AS node FROM c UNION SELECT id, dst FROM c) JOIN n USING (node) WHERE id NOT IN (SELECT id FROM h) GROUP BY id""",
    ),
)
def graph_expansion(spark, d):
    c = _corpus(spark, d)
    return search.expansion(c.where("src = 'supplier:7'").select("id"), c)


@query("stored_postings", with_views("supply", FACT_ROWS + _leg("words", WORD_QUERY) + " SELECT id, rank FROM words_r"))
def stored_postings(spark, d):
    """The word search over postings that are written first and then read by the query's terms."""
    path = f"{scratch_dir(spark)}/postings-{uuid.uuid4().hex}"
    search.store_postings(_corpus(spark, d), search.WORDS, path)
    return search.ranked(search.search_postings(spark, path, WORD_QUERY, search.WORDS), 100).select("id", F.col("rank").cast("bigint").alias("rank"))


SEARCH_TEXT, SEARCH_TIME = "supplier:3 part", "1998-06-01 00:00:00"


@query(
    "search_edges",
    with_views(
        "supply",
        f""", v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT {QUERY_VECTOR}::DOUBLE[] AS q),
c AS (SELECT edge_id AS id, fact, src, dst, valid_at, embedding AS vec FROM supply LEFT JOIN v ON dst = 'part:' || vec_id WHERE valid_at <= TIMESTAMP '{SEARCH_TIME}')"""
        + _leg("words", SEARCH_TEXT)
        + _leg("trigrams", SEARCH_TEXT)
        + f""", vec_r AS (SELECT id, row_number() OVER (ORDER BY round({COSINE.format('vec', 'q')}, 9) DESC, id) AS rank FROM c, q WHERE vec IS NOT NULL AND {COSINE.format('vec', 'q')} > 0 QUALIFY rank <= 100),
h AS (SELECT id FROM words_r UNION SELECT id FROM trigrams_r UNION SELECT id FROM vec_r), ends AS (SELECT src AS node FROM c JOIN h USING (id) UNION SELECT dst FROM c JOIN h USING (id)),
near AS (SELECT id, count(*) AS score FROM (SELECT id, src AS node FROM c UNION SELECT id, dst FROM c) JOIN ends USING (node) WHERE id NOT IN (SELECT id FROM h) GROUP BY id),
near_r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 100),
u AS (SELECT * FROM words_r UNION ALL SELECT * FROM trigrams_r UNION ALL SELECT * FROM vec_r UNION ALL SELECT * FROM near_r),
sums AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY id),
best AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM sums QUALIFY place <= 10)
SELECT place AS rank, id, fact, round(score, 6) AS score, strftime(c.valid_at, {TIME}) AS valid_at, 'ep-' || substr(id, 8) AS episodes FROM best JOIN c USING (id)""",
    ),
)
def search_edges(spark, d):
    """Facts current at a time, by words, trigrams, vectors (a part's) and shared ends, with their episodes."""
    e = views.supply_edges(spark, d)
    vec = table(spark, d, "embeddings").select(F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("dst"), F.col("embedding").alias("vec"))
    items = e.select(F.col("edge_id").alias("id"), F.lit("edge").alias("kind"), "fact", "src", "dst", "valid_at", F.lit(None).cast("timestamp_ntz").alias("invalid_at")).join(vec, "dst", "left")
    mentions = e.select("episode_id", F.col("edge_id").alias("target_id"))
    out = search.search_edges(items, SEARCH_TEXT, QUERY_VECTOR, current_at=views.stamp(SEARCH_TIME), mentions=mentions)
    return out.select(F.col("rank").cast("bigint").alias("rank"), "id", "fact", F.round("score", 6).alias("score"), time_text("valid_at").alias("valid_at"), F.array_join("episodes", "|").alias("episodes"))


@query(
    "extraction_gate",
    with_views(
        "priority",
        f""" SELECT edge_id AS draft_id, CASE WHEN o_custkey % 4 <> 0 THEN strftime(o_orderdate, {TIME}) WHEN o_orderstatus <> 'O' AND o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, {TIME}) END AS valid_at,
  CASE WHEN o_custkey % 4 = 0 AND o_orderstatus <> 'O' AND o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 9 DAY, {TIME}) END AS invalid_at
FROM priority JOIN orders ON edge_id = 'order:' || o_orderkey""",
    ),
)
def extraction_gate(spark, d):
    """New facts without times take extracted ones, if there is a reference time; others keep theirs."""
    none = F.lit(None).cast("timestamp_ntz")
    date, src = F.col("o_orderdate").cast("timestamp_ntz"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))
    drafts = table(spark, d, "orders").select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("draft_id"), src.alias("group_id"), F.col("o_orderkey").alias("seq"), src.alias("src"), F.col("o_orderpriority").alias("dst"),
        F.concat_ws(" ", src, F.lit("order"), F.col("o_orderkey").cast("string")).alias("fact"), F.when(F.col("o_custkey") % 4 != 0, date).alias("valid_at"), none.alias("invalid_at"), none.alias("expired_at"),
        F.when(F.col("o_orderstatus") != "O", date).alias("reference_time"), date.alias("date"),
    )
    found = drafts.where(F.col("seq") % 3 != 0).select("draft_id", (F.col("date") + F.expr("interval 1 day")).alias("valid_at"), (F.col("date") + F.expr("interval 9 days")).alias("invalid_at"))
    stored = drafts.select(F.col("draft_id").alias("edge_id"), "group_id", "src", "dst", "fact", "valid_at", "invalid_at", "expired_at").limit(0)
    nothing = drafts.select("draft_id", F.lit(None).cast("string").alias("edge_id")).limit(0)
    out, _ = resolution.resolve_edges(drafts.drop("date"), stored, nothing, nothing, found, now())
    return out.select("draft_id", time_text("valid_at").alias("valid_at"), time_text("invalid_at").alias("invalid_at"))


@query(
    "group_override",
    with_views(
        "messages",
        r""", e AS (SELECT episode_id, unnest(list_distinct(regexp_extract_all(content, '(?:^|\n)([^:\n]+):', 1))) AS name FROM messages)
SELECT episode_id, 'other' AS group_id, name || ' SPOKE_IN room' AS fact FROM e""",
    ),
)
def group_override(spark, d):
    """Facts of every speaker, put into another group than the episode's."""
    from chronoweave.models import providers

    m = views.messages(spark, d)
    people = extraction.extract_nodes(providers.rule_entities(m), spark.createDataFrame([(1, "Person")], "type_id bigint, type_name string"))
    edge = F.struct(F.col("name").alias("source_entity_name"), F.lit("room").alias("target_entity_name"), F.lit("SPOKE_IN").alias("relation_type"), F.concat("name", F.lit(" SPOKE_IN room")).alias("fact"))
    replies = people.groupBy("episode_id").agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"))).alias("reply"))
    room = people.select("episode_id", F.lit("room").alias("name"), F.lit("room").alias("node_id"), F.lit(99).alias("pos")).distinct()
    ends = people.select("episode_id", "name", F.col("name").alias("node_id"), "pos").unionByName(room)
    reference = m.select("episode_id", "group_id", F.col("occurred_at").alias("reference_time"))
    return extraction.extract_edges(replies, ends, reference, "other").select("episode_id", "group_id", "fact")
