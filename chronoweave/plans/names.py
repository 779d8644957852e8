"""Name functions, candidate pools and node resolution over the node views."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import hashing, text, vectors
from chronoweave.operators import extraction, resolution
from chronoweave.plans import views
from chronoweave.plans.views import with_views
from chronoweave.session import materialize, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


EXACT = r"trim(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'))"
FUZZY = r"trim(regexp_replace(regexp_replace(" + EXACT + r", '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"
exact, fuzzy = EXACT.format, FUZZY.format
ENTROPY = """CASE WHEN length(replace({0}, ' ', '')) = 0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split(replace({0}, ' ', ''), '')),
  lambda c: (length(replace({0}, ' ', '')) - length(replace(replace({0}, ' ', ''), c, ''))) / length(replace({0}, ' ', ''))::DOUBLE
   * log2((length(replace({0}, ' ', '')) - length(replace(replace({0}, ' ', ''), c, ''))) / length(replace({0}, ' ', ''))::DOUBLE))) END"""
SHINGLES = """CASE WHEN length(replace({0}, ' ', '')) >= 3 THEN list_sort(list_distinct(list_transform(range(1, length(replace({0}, ' ', '')) - 1),
  lambda i: substr(replace({0}, ' ', ''), i, 3)))) WHEN length(replace({0}, ' ', '')) = 1 THEN [replace({0}, ' ', '')] ELSE []::VARCHAR[] END"""
JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"
TEXT = "coalesce(text, '')"


def _texts(spark, d):
    """Whole texts of documents, as messy names."""
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("name"))


@query("normalize_exact", f"SELECT doc_id, {exact(TEXT)} AS norm FROM documents")
def normalize_exact(spark, d):
    return _texts(spark, d).select("doc_id", text.normalize_exact(F.col("name")).alias("norm"))


@query("normalize_fuzzy", f"SELECT doc_id, {fuzzy(TEXT)} AS norm FROM documents")
def normalize_fuzzy(spark, d):
    return _texts(spark, d).select("doc_id", text.normalize_fuzzy(F.col("name")).alias("norm"))


PART_NAMES = f", p AS (SELECT node_id, {fuzzy('name')} AS f FROM nodes)"


def _fuzzy_nodes(spark, d):
    return views.nodes(spark, d).select("node_id", text.normalize_fuzzy(F.col("name")).alias("f"))


@query("name_entropy", with_views("nodes", PART_NAMES + f" SELECT node_id, round({ENTROPY.format('f')}, 6) AS bits FROM p"))
def name_entropy(spark, d):
    return _fuzzy_nodes(spark, d).select("node_id", F.round(text.name_entropy(F.col("f")), 6).alias("bits"))


@query("entropy_gate", with_views("nodes", PART_NAMES + f" SELECT node_id, NOT (length(f) < 6 AND len(list_filter(string_split(f, ' '), lambda t: t <> '')) < 2) AND {ENTROPY.format('f')} >= 1.5 AS passes FROM p"))
def entropy_gate(spark, d):
    return _fuzzy_nodes(spark, d).select("node_id", text.has_high_entropy(F.col("f")).alias("passes"))


@query("shingles", with_views("nodes", PART_NAMES + f" SELECT node_id, array_to_string({SHINGLES.format('f')}, '|') AS shingles FROM p"))
def shingles(spark, d):
    return _fuzzy_nodes(spark, d).select("node_id", F.array_join(text.shingles(F.col("f")), "|").alias("shingles"))


@query("jaccard", f"WITH p AS (SELECT p_partkey, {SHINGLES.format(fuzzy('p_name'))} AS a, {SHINGLES.format(fuzzy('p_type'))} AS b FROM part) SELECT p_partkey, round({JACCARD.format('a', 'b')}, 6) AS score FROM p")
def jaccard(spark, d):
    p = table(spark, d, "part")
    of = lambda c: text.shingles(text.normalize_fuzzy(F.col(c)))
    return p.select("p_partkey", of("p_name").alias("a"), of("p_type").alias("b")).select("p_partkey", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@query("minhash_signature")
def minhash_signature(spark, d):
    s = _fuzzy_nodes(spark, d)
    return s.select("node_id", F.array_join(hashing.minhash_signature(text.shingles(F.col("f"))), "|").alias("signature"))


@query("lsh_bands")
def lsh_bands(spark, d):
    s = _fuzzy_nodes(spark, d)
    s = s.select("node_id", hashing.minhash_signature(text.shingles(F.col("f"))).alias("signature"))
    return s.select("node_id", F.array_join(hashing.lsh_bands(F.col("signature")), "|").alias("bands"))


def _drafts(spark, d):
    """Node names as mentioned, in another case and with more blanks."""
    return views.nodes(spark, d).select(F.concat(F.lit("d:"), F.col("node_id")).alias("draft_id"), "group_id", F.concat(F.lit(" "), F.upper("name"), F.lit("  ")).alias("name"))


@query(
    "exact_name_resolve",
    with_views(
        "nodes",
        f""", s AS (SELECT group_id, {exact('name')} AS norm, count(*) AS n, min(node_id) AS id FROM nodes GROUP BY ALL)
SELECT 'd:' || node_id AS draft_id, n AS n_matches, CASE WHEN n = 1 THEN id END AS node_id FROM nodes JOIN s ON s.group_id = nodes.group_id AND norm = {exact("' ' || upper(name) || '  '")}""",
    ),
)
def exact_name_resolve(spark, d):
    return resolution.exact_matches(_drafts(spark, d), views.nodes(spark, d)).select("draft_id", "n_matches", "node_id")


@query(
    "fuzzy_resolve",
    f"""WITH s AS (SELECT s_suppkey AS k, {SHINGLES.format(fuzzy('s_name'))} AS s, {SHINGLES.format(fuzzy("s_name || ' Inc'"))} AS t FROM supplier),
p AS (SELECT a.k AS a, b.k AS b, {JACCARD.format('a.t', 'b.s')} AS score FROM s a, s b)
SELECT 'd:' || a AS draft_id, 'supplier:' || arg_min(b, (-score, 'supplier:' || b)) AS node_id, round(max(score), 6) AS score FROM p WHERE score >= 0.7 GROUP BY a""",
)
def fuzzy_resolve(spark, d):
    """Supplier names with an addition as drafts against all of them; the bound is lower, as the addition costs shingles."""
    s = table(spark, d, "supplier")
    drafts = s.select(F.concat(F.lit("d:"), F.col("s_suppkey").cast("string")).alias("draft_id"), F.lit("g").alias("group_id"), F.concat("s_name", F.lit(" Inc")).alias("name"))
    stored = s.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("g").alias("group_id"), F.col("s_name").alias("name"))
    return resolution.fuzzy_matches(drafts, stored, 0.7).select("draft_id", "node_id", F.round("score", 6).alias("score"))


@query(
    "label_promotion",
    with_views(
        "nodes",
        """ SELECT node_id, array_to_string(CASE WHEN len(list_filter(labels, lambda l: l <> 'Entity')) > 0 THEN labels ELSE ['Entity', 'Thing'] END, '|') AS labels FROM nodes""",
    ),
)
def label_promotion(spark, d):
    promoted = text.promoted_labels(F.col("labels"), F.array(F.lit("Entity"), F.lit("Thing")))
    return views.nodes(spark, d).select("node_id", F.array_join(promoted, "|").alias("labels"))


@query(
    "collapse_drafts",
    f"""WITH p AS (SELECT p_brand AS episode_id, p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN p_name || '  ' WHEN p_size % 3 = 1 THEN upper(p_name) ELSE p_name END AS name,
  CASE WHEN p_size % 2 = 0 THEN ['Entity'] ELSE ['Entity', 'Part'] END AS labels, p_size::BIGINT AS i FROM part),
r AS (SELECT *, {exact('name')} AS norm, row_number() OVER (PARTITION BY episode_id, {exact('name')} ORDER BY len(labels) DESC, length(trim(name)) DESC, pos) AS r FROM p)
SELECT episode_id, norm, min(pos) AS pos, max(name) FILTER (r = 1) AS name, max(array_to_string(labels, '|')) FILTER (r = 1) AS labels,
  array_to_string(list_sort(list(DISTINCT i)), '|') AS indices FROM r GROUP BY episode_id, norm""",
)
def collapse_drafts(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    name = F.when(size % 3 == 0, F.concat("p_name", F.lit("  "))).when(size % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    labels = F.when(size % 2 == 0, F.array(F.lit("Entity"))).otherwise(F.array(F.lit("Entity"), F.lit("Part")))
    drafts = p.select(F.col("p_brand").alias("episode_id"), F.col("p_partkey").alias("pos"), name.alias("name"), labels.alias("labels"), F.array(size.cast("bigint")).alias("episode_indices"))
    out = extraction.collapse_drafts(drafts)
    return out.select("episode_id", "norm", "pos", "name", F.array_join("labels", "|").alias("labels"), F.array_join(F.transform("episode_indices", lambda i: i.cast("string")), "|").alias("indices"))


COSINE = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
POOL_COSINE = 0.3


@query(
    "cosine_candidates",
    f"""WITH p AS (SELECT a.vec_id AS draft_id, b.vec_id AS node_id, {COSINE.format('a.embedding', 'b.embedding')} AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, node_id) AS rank FROM p WHERE score > {POOL_COSINE})
SELECT draft_id, node_id, round(score, 6) AS score, rank FROM r WHERE rank <= 15""",
)
def cosine_candidates(spark, d):
    """Every vector against those of its label, itself included."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("group_id"), F.col("embedding").alias("vec"))
    drafts, stored = e.withColumnRenamed("vec_id", "draft_id"), e.withColumnRenamed("vec_id", "node_id")
    out = resolution.cosine_pool(drafts, stored, POOL_COSINE)
    return out.select("draft_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("leading_components", "SELECT vec_id, array_to_string(list_transform(embedding[1:4], lambda x: round(x::DOUBLE, 6)::DECIMAL(18, 6)), '|') AS head FROM embeddings")
def leading_components(spark, d):
    head = F.transform(vectors.leading(F.col("embedding"), 4), lambda x: F.round(x.cast("double"), 6).cast("decimal(18,6)").cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(head, "|").alias("head"))


@query(
    "pool_union",
    """WITH a AS (SELECT s_suppkey AS node_id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier WHERE s_acctbal > 5000),
b AS (SELECT s_suppkey AS node_id, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS pos FROM supplier)
SELECT node_id, min((p, pos))[1] AS pool, min((p, pos))[2] AS pos FROM (SELECT 0::BIGINT AS p, * FROM a UNION ALL SELECT 1, * FROM b) GROUP BY node_id""",
)
def pool_union(spark, d):
    """Suppliers of a high balance by it, then all by nation: each at its first place."""
    from pyspark.sql import Window

    s = table(spark, d, "supplier")
    ranked = lambda rows, *order: rows.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select(F.col("s_suppkey").alias("node_id"), "pos")
    out = resolution.pool_union([ranked(s.where("s_acctbal > 5000"), F.desc("s_acctbal"), "s_suppkey"), ranked(s, "s_nationkey", "s_suppkey")])
    return out.select("node_id", F.col("at.pool").cast("bigint").alias("pool"), F.col("at.pos").cast("bigint").alias("pos"))


@query(
    "resolution_guard",
    """WITH j AS (SELECT l_orderkey AS batch_id, l_linenumber AS pos, (l_partkey % 9 - 1)::BIGINT AS id, (l_suppkey % 6 - 1)::BIGINT AS candidate_id FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, id ORDER BY pos) AS r FROM j WHERE id BETWEEN 0 AND 4)
SELECT batch_id, id, CASE WHEN candidate_id BETWEEN 0 AND 3 THEN candidate_id ELSE -1 END AS candidate_id FROM r WHERE r = 1""",
)
def resolution_guard(spark, d):
    li = table(spark, d, "lineitem")
    j = li.select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 9 - 1).cast("bigint").alias("id"), (F.col("l_suppkey") % 6 - 1).cast("bigint").alias("candidate_id")
    )
    return resolution.guarded_judgments(j, F.lit(5), F.lit(4)).select("batch_id", "id", "candidate_id")


@query(
    "node_resolution",
    with_views(
        "nodes",
        f""", v AS (SELECT nodes.*, embedding FROM nodes LEFT JOIN embeddings ON vec_id = seq),
pairs AS (SELECT d.node_id AS draft, s.node_id, {exact("' ' || upper(d.name) || '  '")} = {exact('s.name')} AS same, round({COSINE.format('d.embedding', 's.embedding')}, 12) AS score
  FROM v d JOIN v s ON d.group_id = s.group_id WHERE s.expired_at IS NULL),
pool AS (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY score DESC, node_id) AS rank FROM pairs WHERE score > {POOL_COSINE} QUALIFY rank <= 15),
e AS (SELECT draft, count(*) AS n, min(node_id) AS id FROM pool WHERE same GROUP BY draft),
r AS (SELECT v.node_id AS draft, n, CASE WHEN n = 1 THEN id ELSE merged_into END AS node_id, merged_into FROM v LEFT JOIN e ON draft = v.node_id)
SELECT 'd:' || draft AS draft_id, r.node_id, CASE WHEN n = 1 THEN 'exact' WHEN r.merged_into IS NOT NULL THEN 'judged' WHEN n > 1 THEN 'ambiguous' ELSE 'new' END AS how,
  CASE WHEN r.node_id IS NULL OR len(s.labels) = 1 THEN 'Entity|Thing' ELSE array_to_string(s.labels, '|') END AS labels
FROM r LEFT JOIN nodes s ON s.node_id = r.node_id""",
    ),
)
def node_resolution(spark, d):
    """Every node's name among the live nodes whose vectors are near its own; judgments send merged ones to where they went."""
    n = views.nodes(spark, d)
    vec = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("seq"), F.col("embedding").alias("vec"))
    n = materialize(n.join(vec, "seq", "left"))
    drafts = n.select(F.concat(F.lit("d:"), F.col("node_id")).alias("draft_id"), "group_id", F.concat(F.lit(" "), F.upper("name"), F.lit("  ")).alias("name"), "vec")
    drafts = drafts.withColumn("labels", F.array(F.lit("Entity"), F.lit("Thing")))
    pool = materialize(resolution.cosine_pool(drafts, n.where("expired_at is null"), POOL_COSINE))
    judged = n.where("merged_into is not null").select(F.concat(F.lit("d:"), F.col("node_id")).alias("draft_id"), F.col("merged_into").alias("node_id"))
    return resolution.resolve_nodes(drafts, n, judged, pool).select("draft_id", "node_id", "how", F.array_join("labels", "|").alias("labels"))


JUDGED = """, g AS (SELECT edge_id, src AS group_id, src, dst, fact FROM priority),
c AS (SELECT d.edge_id AS draft_id, s.edge_id, s.src = d.src AND s.dst = d.dst AS related, row_number() OVER (PARTITION BY d.edge_id ORDER BY (s.src = d.src AND s.dst = d.dst) DESC, s.fact, s.edge_id) - 1 AS idx
  FROM g d JOIN g s USING (group_id)),
z AS (SELECT draft_id, count(*) FILTER (related) AS related, count(*) AS n FROM c GROUP BY draft_id),
j AS (SELECT 'order:' || o_orderkey AS draft_id, [o_orderkey % 9 - 1, o_custkey % 3] AS dup, [o_orderkey % 7, o_custkey % 11 - 1, o_orderkey % 7] AS con FROM orders)"""


@query(
    "judged_edges",
    with_views(
        "priority",
        JUDGED
        + """ SELECT draft_id, edge_id, 'duplicate' AS kind FROM j JOIN z USING (draft_id) JOIN c USING (draft_id) WHERE idx = list_filter(dup, lambda i: i >= 0 AND i < z.related)[1]
UNION ALL SELECT DISTINCT draft_id, edge_id, 'contradicted' FROM j JOIN c USING (draft_id) WHERE list_contains(con, idx)""",
    ),
)
def judged_edges(spark, d):
    """Index replies about every order's fact, read against its candidate lists."""
    e = views.priority_edges(spark, d).withColumn("group_id", F.col("src"))
    o = table(spark, d, "orders")
    replies = o.select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("draft_id"), F.array(F.col("o_orderkey") % 9 - 1, F.col("o_custkey") % 3).alias("duplicates"),
        F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 11 - 1, F.col("o_orderkey") % 7).alias("contradicted"),
    )
    same, against = resolution.judged_edges(e.withColumnRenamed("edge_id", "draft_id"), e, replies)
    return same.withColumn("kind", F.lit("duplicate")).unionByName(against.withColumn("kind", F.lit("contradicted")))
