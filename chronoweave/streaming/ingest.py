"""Structured Streaming ingestion into a store: each micro-batch is taken group by group in order of seq."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chronoweave.models import providers
from chronoweave.operators import ingest
from chronoweave.session import delete_folder, exists, materialize, release
from chronoweave.sources.store import Store

EPISODES = "episode_id string, group_id string, kind string, source string, content string, valid_at string, seq bigint"
# Fixed value: so many failures in a row and later batches are set aside.
STRIKES = 3

Replies = Callable[[DataFrame], DataFrame]


class Ingester:
    """Folds episodes into a store. Ids follow from content and a step is taken whole or not at all, so a batch that is run again, or was cut short, changes nothing twice."""

    def __init__(self, store: Store, types: DataFrame, now: Column, entities: Replies = providers.rule_entities, edges: Replies = providers.rule_edges, contradictory: tuple[str, ...] = (),
                 vectors: Callable[[DataFrame], DataFrame] | None = None):
        self.store, self.types, self.now, self.entities, self.edges, self.contradictory, self.vectors = store, types, now, entities, edges, contradictory, vectors
        self.failures = 0

    def add(self, episodes: DataFrame) -> None:
        """Take a batch: step k holds the k-th new episode of every group. Blank contents are passed over."""
        self.store.recover()
        known = self.store.read("episodes").select("episode_id")
        fresh = episodes.where(F.length(F.trim("content")) > 0).dropDuplicates(["episode_id"]).join(known, "episode_id", "left_anti")
        numbered = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("group_id").orderBy("seq", "episode_id")))
        rows = materialize(numbered)
        steps = rows.agg(F.max("_k")).first()[0] or 0
        for k in range(1, steps + 1):
            self._step(rows.where(F.col("_k") == k).drop("_k"))
        release(rows)

    def _step(self, episodes: DataFrame) -> None:
        groups = episodes.select("group_id").distinct()
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        here = lambda t: t.join(groups, "group_id", "left_semi")
        c = ingest.step(episodes, here(nodes), here(edges), self.entities(episodes), self.edges(episodes), self.types, self.now, self.contradictory, vectors=self.vectors)
        ended = here(edges).join(c.bounds.select("edge_id"), "edge_id", "left_semi")
        changed = ingest.bounded(ended, c.bounds).unionByName(c.edges, allowMissingColumns=True)
        self.store.write({"nodes": c.nodes, "edges": changed, "mentions": c.mentions, "episodes": c.episodes})

    def batch(self, episodes: DataFrame, batch_id: int) -> None:
        """For foreachBatch: three failures in a row open the breaker; the batch that opens it and later ones are set aside, not lost."""
        if self.failures >= STRIKES:
            self._set_aside(episodes, batch_id, "the breaker is open")
            return
        try:
            self.add(episodes)
        except Exception as e:
            self.failures += 1
            if self.failures < STRIKES:
                raise
            self._set_aside(episodes, batch_id, str(e)[:500])
        else:
            self.failures = 0

    def _set_aside(self, episodes: DataFrame, batch_id: int, reason: str) -> None:
        rows = episodes.select(F.to_json(F.struct("*")).alias("episode"), F.lit(reason).alias("reason"))
        rows.write.mode("overwrite").parquet(f"{self.store.path}/set_aside/batch={batch_id}")

    def set_aside(self) -> DataFrame:
        """batch, reason, episode (JSON) of what the breaker kept out."""
        path = f"{self.store.path}/set_aside"
        if not exists(self.store.spark, path):
            return self.store.spark.createDataFrame([], "episode string, reason string, batch bigint")
        return self.store.spark.read.schema("episode string, reason string, batch bigint").parquet(path)

    def retry(self) -> None:
        """Close the breaker and take in what was set aside."""
        rows = materialize(self.set_aside().select(F.from_json("episode", EPISODES).alias("e")).select("e.*"))
        self.failures = 0
        self.add(rows)
        delete_folder(self.store.spark, f"{self.store.path}/set_aside")
        release(rows)


def stream(spark: SparkSession, path: str, ingester: Ingester, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Ingest JSON lines that arrive in a folder until none is left; no watermark, as late facts are handled and not dropped."""
    lines = spark.readStream.schema(EPISODES).option("maxFilesPerTrigger", files_per_batch).json(path)
    return lines.writeStream.foreachBatch(ingester.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
