"""Retrieval over facts: BM25 on words and on trigrams, vectors, graph expansion and rank fusion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chronoweave.functions.vectors import cosine
from chronoweave.session import materialize

# Our own choices, as the engine behind the searches publishes none.
K1, B = 1.2, 0.75
RRF_K = 60
LIMIT = 10
#: Parts that stored postings are dealt into by term; a search reads those of its terms.
POSTING_PARTS = 256


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased text; none if it is shorter."""
    low = F.lower(text)
    n = F.length(low)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, 3))
    return F.when(n >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Leg:
    """How a leg takes texts apart: its terms, and the parts from which a text's length and counts of given terms follow without a row for each term."""

    terms: Callable[[Column], Column]
    parts: Callable[[Column], Column]
    length: Callable[[Column], Column]
    count: Callable[[Column, str], Column]


#: A word counts as often as it stands there; a trigram counts once, and a text has two fewer than characters.
WORDS = Leg(words, words, F.size, lambda parts, term: F.size(F.filter(parts, lambda x: x == term)))
TRIGRAMS = Leg(trigrams, F.lower, lambda low: F.greatest(F.length(low) - 2, F.lit(0)), lambda low, term: F.contains(low, F.lit(term)).cast("int"))


def query_terms(spark: SparkSession, query: str, leg: Leg) -> list[str]:
    return spark.range(1).select(F.array_distinct(leg.terms(F.lit(query)))).first()[0]


def _score(tf: list[Column], length: Column, df: list[int], n: int, mean: float, k1: float, b: float) -> Column:
    parts = [F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5))) * t * (k1 + 1) / (t + k1 * (1 - b + b * length / F.lit(float(mean)))) for t, d in zip(tf, df, strict=True)]
    return reduce(lambda x, y: x + y, parts)


def bm25(facts: DataFrame, query: str, leg: Leg, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of the facts (id, fact) that hold every term of the query.

    Two passes over the facts, without a shuffle of them: one row of counts and lengths, then the
    facts that fit. search_postings() reads only the terms' postings instead.
    """
    spark = facts.sparkSession
    terms = query_terms(spark, query, leg)
    if not terms:
        return facts.select("id", F.lit(0.0).alias("score")).limit(0)
    names = [f"tf{i}" for i in range(len(terms))]
    parts = facts.select("id", leg.parts(F.col("fact")).alias("parts"))
    counted = parts.select("id", leg.length(F.col("parts")).alias("length"), *[leg.count(F.col("parts"), t).alias(n) for n, t in zip(names, terms, strict=True)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(n) > 0).alias(n) for n in names]).first()
    hits = counted.where(reduce(lambda x, y: x & y, [F.col(n) > 0 for n in names]))
    return hits.select("id", _score([F.col(n) for n in names], F.col("length"), [stats[n] for n in names], stats["n"], stats["mean"] or 1.0, k1, b).alias("score"))


def store_postings(facts: DataFrame, leg: Leg, path: str) -> None:
    """Postings (term, id, tf, length) of facts (id, fact) dealt and sorted by term, and one row of counts, under a path."""
    listed = facts.select("id", leg.parts(F.col("fact")).alias("parts"), leg.terms(F.col("fact")).alias("terms"))
    listed = listed.select("id", leg.length(F.col("parts")).alias("length"), "terms")
    listed.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).write.parquet(f"{path}/counts")
    each = listed.select("id", "length", F.explode("terms").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("length").alias("length"))
    part = F.pmod(F.xxhash64("term"), F.lit(POSTING_PARTS)).cast("int")
    # a frequent term's postings are split over tasks by id
    dealt = each.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/postings")


def search_postings(spark: SparkSession, path: str, query: str, leg: Leg, k1: float = K1, b: float = B) -> DataFrame:
    """bm25() over stored postings: reads the parts of the query's terms, and of them the row groups that may hold the terms."""
    terms = query_terms(spark, query, leg)
    postings = spark.read.schema("term string, id string, tf int, length int, part int").parquet(f"{path}/postings")
    if not terms:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    parts = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(POSTING_PARTS)).cast("int")).collect()
    mine = postings.where(F.col("part").isin([r[0] for r in parts]) & F.col("term").isin(terms))
    counts = spark.read.parquet(f"{path}/counts").first()
    df = {r["term"]: r["n"] for r in mine.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = mine.groupBy("id").agg(F.first("length").alias("length"), *[F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
    tf = [F.col(f"tf{i}") for i in range(len(terms))]
    hits = found.where(reduce(lambda x, y: x & y, [t > 0 for t in tf]))
    return hits.select("id", _score(tf, F.col("length"), [df.get(t, 0) for t in terms], counts["n"], counts["mean"] or 1.0, k1, b).alias("score"))


def by_vector(vectors: DataFrame, query: list[float], least: float = 0.0) -> DataFrame:
    """id, score: cosine of vectors (id, vec) of the query's dimension with it, over `least`."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", cosine(F.col("vec"), q).alias("score")).where(F.col("score") > least)


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """The best of a leg with their ranks from 1, ties by id. Scores that differ by rounding only are ties."""
    w = Window.orderBy(F.desc("score"), "id")
    return scores.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(limit).withColumn("rank", F.row_number().over(w))


def expansion(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score of edges that share an end with hits (id), scored by the number of ends shared."""
    ends = edges.join(hits.select("id"), "id", "left_semi").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    each = edges.select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    near = each.join(ends, "node").groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return near.join(hits.select("id"), "id", "left_anti")


def fused(legs: list[DataFrame], limit: int = LIMIT, k: int = RRF_K) -> DataFrame:
    """id, score: reciprocal-rank fusion of ranked legs, the best `limit`, ties by id."""
    if limit <= 0 or not legs:
        return legs[0].select("id", F.lit(0.0).alias("score")).limit(0)
    all_ranks = reduce(DataFrame.unionByName, [leg.select("id", "rank") for leg in legs])
    return all_ranks.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search(items: DataFrame, query: str, query_vec: list[float] | None = None, limit: int = LIMIT, pool: int = 100, current_at: Column | None = None,
           kinds: tuple[str, ...] = ("edge",), group_id: str | None = None, mentions: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """The best items in rank order: rank, id, score, all columns of items, and episodes (sorted ids, where mentions are given).

    items: id, fact (the text), src, dst, valid_at, invalid_at, vec, and kind and group_id where
    those are asked for; mentions: episode_id, target_id. Filters by kind, group and time come
    before any limit. The trigram leg is left out for queries without a word of three characters.
    The vector leg is left out without a query vector, and skips vectors of another dimension.
    Edges that share an end with hits make the last leg. items are read several times: `stored`
    says that they are a table already, else they are written first.
    """
    if "kind" in items.columns:
        items = items.where(F.col("kind").isin(list(kinds)))
    if group_id is not None:
        items = items.where(F.col("group_id") == group_id)
    if current_at is not None:
        items = items.where((F.col("valid_at").isNull() | (F.col("valid_at") <= current_at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > current_at)))
    if limit <= 0:
        out = items.limit(0).select(F.lit(0).alias("rank"), "*", F.lit(0.0).alias("score"))
        return out if mentions is None else out.withColumn("episodes", F.array().cast("array<string>"))
    items = items if stored else materialize(items)
    legs = [ranked(bm25(items, query, WORDS), pool)]
    if any(len(t) >= 3 for t in query_terms(items.sparkSession, query, WORDS)):
        legs.append(ranked(bm25(items, query, TRIGRAMS), pool))
    if query_vec:
        legs.append(ranked(by_vector(items.where(F.size("vec") == len(query_vec)).select("id", "vec"), query_vec), pool))
    legs = [materialize(leg) for leg in legs]
    seeds = reduce(DataFrame.unionByName, [leg.select("id") for leg in legs]).distinct()
    legs.append(ranked(expansion(seeds, items), pool))
    best = materialize(ranked(fused(legs, limit), limit))
    out = best.join(items, "id")
    if mentions is not None:
        held = mentions.join(F.broadcast(best.select(F.col("id").alias("target_id"))), "target_id").groupBy("target_id").agg(F.sort_array(F.collect_set("episode_id")).alias("episodes"))
        out = out.join(held, F.col("id") == F.col("target_id"), "left").drop("target_id").withColumn("episodes", F.coalesce("episodes", F.array().cast("array<string>")))
    return out.orderBy("rank")


def search_edges(edges: DataFrame, query: str, query_vec: list[float] | None = None, limit: int = LIMIT, **options) -> DataFrame:
    """search() over edges."""
    return search(edges, query, query_vec, limit, **options)
