"""Resolution of drafts against what is stored: nodes by name, MinHash and judgment; facts by text and judgment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronoweave.functions.hashing import MIN_JACCARD, lsh_bands, minhash_signature
from chronoweave.functions.text import has_high_entropy, jaccard, normalize_exact, normalize_fuzzy, promoted_labels, shingles
from chronoweave.operators import temporal
from chronoweave.session import materialize

# Fixed values.
POOL_SIZE = 15
MIN_COSINE = 0.6
#: Vectors on a side that are compared in one matrix product.
POOL_BLOCK = 2048


def _unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one as rows, shorter ones filled with zeros, and which have a direction."""
    rows = [np.asarray(x.values, np.float64) if x.is_valid else np.zeros(0) for x in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _nearest(least: float, k: int, schema: pa.Schema):
    """The k nearest of a block's stored vectors for each of its drafts, group by group: matrix products."""

    def run(drafts: pa.Table, stored: pa.Table) -> pa.Table:
        parts = []
        stored = stored.sort_by("node_id")  # ties go to the first id
        groups = set(drafts.column("group_id").to_pylist()) & set(stored.column("group_id").to_pylist())
        for group in groups:
            a, b = (t.filter(pc.equal(t.column("group_id"), group)) for t in (drafts, stored))
            (x, x_ok), (y, y_ok) = _unit(a.column("vec")), _unit(b.column("vec"))
            width = max(x.shape[1], y.shape[1])
            x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
            # rounded, so that equal vectors tie whatever the order of the sums
            score = np.round(x @ y.T, 12)
            score[~x_ok], score[:, ~y_ok] = -np.inf, -np.inf
            if len(b) > k:
                cut = np.partition(score, len(b) - k, axis=1)[:, len(b) - k]
                rows, columns = np.nonzero((score > least) & (score >= cut[:, None]))
            else:
                rows, columns = np.nonzero(score > least)
            order = np.lexsort((columns, -score[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < k
            rows, columns = rows[keep], columns[keep]
            parts.append(pa.Table.from_arrays([a.column("draft_id").take(pa.array(rows)), b.column("node_id").take(pa.array(columns)), pa.chunked_array([pa.array(score[rows, columns])])], schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def cosine_pool(drafts: DataFrame, stored: DataFrame, least: float = MIN_COSINE, k: int = POOL_SIZE) -> DataFrame:
    """draft_id, node_id, score, rank: the k nearest stored vectors of a draft's group, over `least`; ties by id.

    drafts: draft_id, group_id, vec; stored: node_id, group_id, vec. Every draft meets all of its
    group, as the definition asks, in blocks of POOL_BLOCK by POOL_BLOCK vectors: a large group is
    many blocks, small ones share a block. Each block gives k rows a draft at most.
    """
    d, n = drafts.select("draft_id", "group_id", "vec"), stored.select("node_id", "group_id", "vec")
    count = lambda rows, name: rows.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / POOL_BLOCK).alias(name))
    blocks = materialize(count(d, "_d").join(count(n, "_n"), "group_id"))
    cells = max(1, blocks.where("_d = 1 and _n = 1").count() * 64 // POOL_BLOCK, drafts.sparkSession.sparkContext.defaultParallelism)
    large = (F.col("_d") > 1) | (F.col("_n") > 1)
    cell = F.when(large, F.xxhash64("group_id", "_i", "_j")).otherwise(F.pmod(F.xxhash64("group_id"), F.lit(cells)))
    spread = lambda size: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(size) - 1))
    dealt = lambda key, size: F.pmod(F.xxhash64(key), F.col(size))
    a = d.join(blocks, "group_id").withColumn("_i", dealt("draft_id", "_d")).withColumn("_j", spread("_n")).select(cell.alias("_cell"), "draft_id", "group_id", "vec")
    b = n.join(blocks, "group_id").withColumn("_j", dealt("node_id", "_n")).withColumn("_i", spread("_d")).select(cell, "node_id", "group_id", "vec").toDF("_cell", "node_id", "group_id", "vec")
    types = {f.name: f.dataType for f in (*d.schema, *n.schema)}
    out = T.StructType([T.StructField("draft_id", types["draft_id"]), T.StructField("node_id", types["node_id"]), T.StructField("score", T.DoubleType())])
    near = a.groupBy("_cell").cogroup(b.groupBy("_cell")).applyInArrow(_nearest(least, k, to_arrow_schema(out)), out)
    w = Window.partitionBy("draft_id").orderBy(F.desc("score"), "node_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_matches(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """Drafts (draft_id, group_id, name) with n_matches of their normalized name and node_id where it is just one."""
    norm = normalize_exact(F.col("name"))
    by_name = stored.groupBy("group_id", norm.alias("norm")).agg(F.count(F.lit(1)).alias("n_matches"), F.min("node_id").alias("_id"))
    out = drafts.withColumn("norm", norm).join(by_name, ["group_id", "norm"], "left")
    return out.withColumns({"n_matches": F.coalesce("n_matches", F.lit(0)).cast("bigint"), "node_id": F.when(F.col("n_matches") == 1, F.col("_id"))}).drop("_id", "norm")


def _fuzzy(rows: DataFrame, key: str) -> DataFrame:
    fuzzy = rows.select(key, "group_id", normalize_fuzzy(F.col("name")).alias("f")).where(has_high_entropy(F.col("f")))
    return fuzzy.select(key, "group_id", shingles(F.col("f")).alias("s"))


def fuzzy_matches(drafts: DataFrame, stored: DataFrame, least: float = MIN_JACCARD) -> DataFrame:
    """draft_id, node_id, score: the best stored name of similarity `least` or more that shares a band, ties by id.

    Names below the entropy bound are left out before the hashing. Stored names that gate lets
    through only matter as candidates, so they pass it too. Pairs meet once whatever the number of
    bands they share.
    """
    a, b = _fuzzy(drafts, "draft_id"), stored.select("node_id", "group_id", shingles(normalize_fuzzy(F.col("name"))).alias("s"))

    def bands(rows: DataFrame, key: str) -> DataFrame:
        signed = rows.select(key, "group_id", minhash_signature("s").alias("signature"))
        return signed.select(key, "group_id", F.posexplode(lsh_bands(F.col("signature"))).alias("band", "h"))

    pairs = bands(a, "draft_id").join(bands(b, "node_id"), ["group_id", "band", "h"]).select("draft_id", "node_id").distinct()
    scored = pairs.join(a.select("draft_id", F.col("s").alias("_a")), "draft_id").join(b.select("node_id", F.col("s").alias("_b")), "node_id")
    scored = scored.select("draft_id", "node_id", jaccard(F.col("_a"), F.col("_b")).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("draft_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pooled_matches(drafts: DataFrame, stored: DataFrame, pool: DataFrame) -> DataFrame:
    """draft_id, n_matches, exact, fuzzy: what the names of a draft's own candidates (pool: draft_id, node_id, rank) say.

    exact is the only candidate of equal normalized name; fuzzy the best that shares a band and is
    similar enough, ties by the first band, then by rank, and only where no name is equal.
    """
    signed = lambda rows, key, name: rows.select(
        key, normalize_exact(F.col("name")).alias(f"{name}_norm"), normalize_fuzzy(F.col("name")).alias(f"{name}_f"), shingles(normalize_fuzzy(F.col("name"))).alias(f"{name}_s")
    ).withColumn("_signature", minhash_signature(f"{name}_s")).withColumn(f"{name}_bands", lsh_bands(F.col("_signature"))).drop("_signature")
    wanted = stored.join(pool.select("node_id").distinct(), "node_id", "left_semi")
    pairs = pool.select("draft_id", "node_id", "rank").join(signed(drafts, "draft_id", "d"), "draft_id").join(signed(wanted, "node_id", "s"), "node_id")
    shared = F.array_position(F.zip_with("d_bands", "s_bands", lambda x, y: F.coalesce(x == y, F.lit(False))), True)
    score = jaccard(F.col("d_s"), F.col("s_s"))
    near = has_high_entropy(F.col("d_f")) & (shared > 0) & (score >= MIN_JACCARD)
    same = F.col("d_norm") == F.col("s_norm")
    out = pairs.groupBy("draft_id").agg(
        F.count_if(same).alias("n_matches"), F.min(F.when(same, F.col("node_id"))).alias("_exact"),
        F.min(F.when(near, F.struct((-score).alias("a"), shared.alias("b"), F.col("rank").alias("c"), F.col("node_id").alias("id")))).alias("_near"),
    )
    return out.select("draft_id", "n_matches", F.when(F.col("n_matches") == 1, F.col("_exact")).alias("exact"), F.when(F.col("n_matches") == 0, F.col("_near.id")).alias("fuzzy"))


def resolve_names(drafts: DataFrame, stored: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """draft_id, node_id, how: exact, fuzzy, ambiguous or new, among a draft's pool (cosine_pool()); without one, all stored names of the group.

    Only drafts without an exact hit go on to the costly tier; an ambiguous hit does not.
    """
    how = F.when(F.col("n_matches") == 1, "exact").when(F.col("n_matches") > 1, "ambiguous").when(F.col("_fuzzy").isNotNull(), "fuzzy").otherwise("new")
    if pool is not None:
        found = pooled_matches(drafts, stored, pool).withColumnsRenamed({"fuzzy": "_fuzzy", "exact": "_exact"})
        out = drafts.select("draft_id").join(found, "draft_id", "left")
        return out.select("draft_id", F.coalesce("_exact", "_fuzzy").alias("node_id"), how.alias("how"))
    exact = materialize(exact_matches(drafts, stored))
    rest = exact.where("n_matches = 0").select("draft_id", "group_id", "name")
    fuzzy = fuzzy_matches(rest, stored).select("draft_id", F.col("node_id").alias("_fuzzy"))
    return exact.join(fuzzy, "draft_id", "left").select("draft_id", F.coalesce("node_id", "_fuzzy").alias("node_id"), how.alias("how"))


def guarded_judgments(judgments: DataFrame, n_drafts: Column, n_candidates: Column) -> DataFrame:
    """Judgments (batch_id, pos, id, candidate_id) whose draft id is in range, the first of each; a bad candidate is new (-1)."""
    w = Window.partitionBy("batch_id", "id").orderBy("pos")
    kept = judgments.where((F.col("id") >= 0) & (F.col("id") < n_drafts)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    good = (F.col("candidate_id") >= 0) & (F.col("candidate_id") < n_candidates)
    return kept.withColumn("candidate_id", F.when(good, F.col("candidate_id")).otherwise(F.lit(-1).cast("bigint")))


def judged_nodes(unresolved: DataFrame, pool: DataFrame, replies: DataFrame) -> DataFrame:
    """draft_id, node_id from a model's replies (batch_id, pos, id, candidate_id) about the drafts that names left open.

    unresolved: batch_id, draft_id, pos; ids count them from 0 in the order of pos within a batch,
    candidate ids the candidates of the batch's pool (batch_id, node_id, pos). Ids out of range and
    repeats are passed over; a candidate out of range says that the draft is new.
    """
    numbered = lambda rows, name: rows.withColumn(name, (F.row_number().over(Window.partitionBy("batch_id").orderBy("pos")) - 1).cast("bigint")).drop("pos")
    drafts, candidates = numbered(unresolved.select("batch_id", "draft_id", "pos"), "id"), numbered(pool.select("batch_id", "node_id", "pos"), "candidate_id")
    sizes = drafts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_d")).join(candidates.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")), "batch_id", "left")
    good = guarded_judgments(replies.join(sizes, "batch_id"), F.col("_d"), F.coalesce("_n", F.lit(0)))
    return good.join(drafts, ["batch_id", "id"]).join(candidates, ["batch_id", "candidate_id"]).select("draft_id", "node_id")


def resolve_nodes(drafts: DataFrame, stored: DataFrame, judgments: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """resolve_names(), then judgments (draft_id, node_id) for those left over; what no tier resolves is new. With promoted labels.

    drafts: draft_id, group_id, name, labels; stored: node_id, group_id, name, labels; pool as in resolve_names().
    """
    out = resolve_names(drafts, stored, pool)
    if judgments is not None:
        out = out.join(judgments.select("draft_id", F.col("node_id").alias("_j")), "draft_id", "left")
        out = out.select("draft_id", F.coalesce("node_id", "_j").alias("node_id"), F.when(F.col("node_id").isNull() & F.col("_j").isNotNull(), "judged").otherwise(F.col("how")).alias("how"))
    labels = drafts.select("draft_id", F.col("labels").alias("_d")).join(out, "draft_id").join(stored.select("node_id", F.col("labels").alias("_s")), "node_id", "left")
    return labels.select("draft_id", "node_id", "how", F.when(F.col("_s").isNull(), F.col("_d")).otherwise(promoted_labels(F.col("_s"), F.col("_d"))).alias("labels"))


def candidate_lists(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """draft_id, edge_id, fact, list, idx: the related edges (same ends) of a draft from 0, then the rest of its group.

    Ordered by fact and id within each list. drafts: draft_id, group_id, src, dst.
    """
    d = drafts.select("draft_id", "group_id", F.col("src").alias("_s"), F.col("dst").alias("_d"))
    pairs = d.join(stored.select("edge_id", "group_id", "src", "dst", "fact"), "group_id")
    listed = pairs.withColumn("list", F.when((F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "related").otherwise("pool"))
    w = Window.partitionBy("draft_id").orderBy(F.desc("list"), "fact", "edge_id")
    return listed.select("draft_id", "edge_id", "fact", "list", (F.row_number().over(w) - 1).cast("bigint").alias("idx"))


def verbatim(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """draft_id, edge_id: the first stored edge (by fact, id) with equal ends and normalized fact."""
    norm = normalize_exact(F.col("fact"))
    first = stored.groupBy("group_id", "src", "dst", norm.alias("norm")).agg(F.min(F.struct("fact", "edge_id"))["edge_id"].alias("edge_id"))
    return drafts.withColumn("norm", norm).join(first, ["group_id", "src", "dst", "norm"]).select("draft_id", "edge_id")


def first_duplicate(ids: Column, n_related: Column) -> Column:
    """The first judged id that is a related edge; null if none is."""
    return F.get(F.filter(ids, lambda i: (i >= 0) & (i < n_related)), 0)


def split_contradictions(judged: DataFrame) -> DataFrame:
    """draft_id, pos, list, at from contradicted indices over both lists; indices out of range go, repeats stay.

    judged: draft_id, contradicted (array), n_related, n_pool.
    """
    each = judged.select("draft_id", "n_related", "n_pool", F.posexplode("contradicted").alias("pos", "i"))
    inside = each.where((F.col("i") >= 0) & (F.col("i") < F.col("n_related") + F.col("n_pool")))
    related = F.col("i") < F.col("n_related")
    return inside.select(
        "draft_id", F.col("pos").cast("bigint").alias("pos"), F.when(related, "related").otherwise("pool").alias("list"),
        F.when(related, F.col("i")).otherwise(F.col("i") - F.col("n_related")).alias("at"),
    )


def judged_edges(drafts: DataFrame, stored: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """duplicates and contradictions (draft_id, edge_id each) from a model's replies (draft_id, duplicates, contradicted: index arrays).

    Indices count candidate_lists(): related edges from 0, then the rest of the group. Of
    duplicates the first related one holds; contradictions may be in either list.
    """
    lists = materialize(candidate_lists(drafts, stored))
    sizes = lists.groupBy("draft_id").agg(F.count_if(F.col("list") == "related").alias("n_related"), F.count_if(F.col("list") == "pool").alias("n_pool"))
    judged = replies.join(sizes, "draft_id")
    same = judged.select("draft_id", first_duplicate(F.col("duplicates"), F.col("n_related")).alias("idx")).where("idx is not null")
    against = split_contradictions(judged.select("draft_id", "contradicted", "n_related", "n_pool")).join(sizes.select("draft_id", "n_related"), "draft_id")
    against = against.select("draft_id", F.when(F.col("list") == "related", F.col("at")).otherwise(F.col("at") + F.col("n_related")).alias("idx")).distinct()
    of = lambda rows: rows.join(lists, ["draft_id", "idx"]).select("draft_id", "edge_id")
    return of(same), of(against)


def resolve_edges(drafts: DataFrame, stored: DataFrame, duplicates: DataFrame, contradictions: DataFrame, extracted: DataFrame | None, now: Column) -> tuple[DataFrame, DataFrame]:
    """Resolved drafts, and the decisions on stored edges.

    drafts: draft_id, group_id, seq, src, dst, fact, valid_at, invalid_at, expired_at, reference_time.
    stored: edge_id, group_id, src, dst, fact, valid_at, invalid_at, expired_at. duplicates (draft_id,
    edge_id) and contradictions (draft_id, edge_id) are judgments. extracted (draft_id, valid_at,
    invalid_at) are times found for new facts without any.

    A verbatim hit needs no judgment and decides nothing else. A duplicate keeps its stored times;
    a new fact takes extracted ones if it has none. Then bounded facts expire, newer candidates end
    the draft, and the draft ends older ones. Returns (draft_id, duplicate_of, valid_at, invalid_at,
    expired_at) and (draft_id, edge_id, invalid_at, expired_at).
    """
    quick = verbatim(drafts, stored).withColumnRenamed("edge_id", "_v")
    judged = duplicates.select("draft_id", F.col("edge_id").alias("_j"))
    d = drafts.join(quick, "draft_id", "left").join(judged, "draft_id", "left").withColumn("duplicate_of", F.coalesce("_v", "_j"))
    old = stored.select(F.col("edge_id").alias("duplicate_of"), *[F.col(c).alias(f"_s_{c}") for c in ("valid_at", "invalid_at", "expired_at")])
    d = d.join(old, "duplicate_of", "left")
    dup = F.col("duplicate_of").isNotNull()
    d = d.withColumns({c: F.when(dup, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in ("valid_at", "invalid_at", "expired_at")})
    if extracted is not None:
        d = d.join(extracted.select("draft_id", F.col("valid_at").alias("_xv"), F.col("invalid_at").alias("_xi")), "draft_id", "left")
        bare = ~dup & F.col("valid_at").isNull() & F.col("invalid_at").isNull() & F.col("reference_time").isNotNull()
        d = d.withColumns({"valid_at": F.when(bare, F.col("_xv")).otherwise(F.col("valid_at")), "invalid_at": F.when(bare, F.col("_xi")).otherwise(F.col("invalid_at"))})
    open_ = contradictions.select("draft_id", "edge_id").distinct().join(quick.select("draft_id"), "draft_id", "left_anti")
    cand = open_.join(stored.select("edge_id", *[F.col(c).alias(f"c_{c}") for c in ("valid_at", "invalid_at", "expired_at")]), "edge_id")
    expired = temporal.self_expired(d.where("_v is null"), cand.select("draft_id", F.col("c_valid_at").alias("valid_at")), ["draft_id"], now)
    keep = ["draft_id", "duplicate_of", "valid_at", "invalid_at", "expired_at"]
    resolved = expired.select(*keep).unionByName(d.where("_v is not null").select(*keep))
    hits = expired.select("draft_id", "valid_at", "invalid_at").join(cand, "draft_id")
    hits = hits.where(temporal.invalidates(F.col("valid_at"), F.col("invalid_at"), F.col("c_valid_at"), F.col("c_invalid_at")))
    decisions = hits.select("draft_id", "edge_id", F.col("valid_at").alias("invalid_at"), F.coalesce("c_expired_at", now).alias("expired_at"))
    return resolved, decisions


def pool_union(pools: list[DataFrame]) -> DataFrame:
    """Distinct candidates (node_id, pos) of several pools, each at its first place."""
    tagged = [p.select("node_id", F.struct(F.lit(k).alias("pool"), F.col("pos")).alias("at")) for k, p in enumerate(pools)]
    return reduce(DataFrame.unionByName, tagged).groupBy("node_id").agg(F.min("at").alias("at"))
