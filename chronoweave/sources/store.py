"""Tables of the graph store: readers, status, export, bounded queues and turns."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chronoweave.session import children, delete_folder, exists, materialize, touch

# Fixed values.
QUEUE_SLOTS = 256

SCHEMAS = {
    "episodes": "episode_id string, group_id string, kind string, source string, content string, occurred_at timestamp, created_at timestamp, seq bigint",
    "nodes": "node_id string, group_id string, kind string, name string, summary string, labels array<string>, attrs string, created_at timestamp, expired_at timestamp, merged_into string, name_vec array<float>",
    "edges": "edge_id string, group_id string, src string, dst string, rel string, fact string, valid_at timestamp, invalid_at timestamp, created_at timestamp, expired_at timestamp, fact_vec array<float>",
    "mentions": "episode_id string, target_id string, target_kind string",
}


#: Tables that change are dealt by group into so many parts; a step rewrites only the parts of its groups.
PARTS = 64
DEALT = ("nodes", "edges")


#: Tables that only grow: each step's rows are a folder of their own.
LOGS = ("mentions", "episodes")


class Store:
    """Parquet tables under one path; a missing one reads as empty.

    A step's changes are written whole to a folder of their own, then marked as ready, then applied.
    Applying reads nothing but that folder and may be repeated, so after a crash recover() takes
    every step either whole or not at all. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _dealt(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name] + ", part int").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name in DEALT:
            return self._dealt(name).drop("part")
        return self.spark.read.schema(SCHEMAS[name] + ", step string").parquet(f"{self.path}/{name}").drop("step")

    def _merged(self, name: str, rows: DataFrame, key: str) -> DataFrame | None:
        """All rows of the parts that rows belong to, with rows in place of those with equal keys; None without rows."""
        new = materialize(self._fit(name, rows).withColumn("part", F.pmod(F.xxhash64("group_id"), F.lit(PARTS)).cast("int")))
        parts = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS at most
        if not parts:
            return None
        if not exists(self.spark, f"{self.path}/{name}"):
            return new
        old = self._dealt(name).where(F.col("part").isin(parts))
        return old.join(new.select(key), key, "left_anti").unionByName(new)

    def write(self, rows: dict[str, DataFrame]) -> None:
        """Take rows of several tables in one step: of DEALT ones by key (node_id, edge_id), of LOGS as additions."""
        step = uuid.uuid4().hex
        for name, new in rows.items():
            out = self._merged(name, new, f"{name[:-1]}_id") if name in DEALT else self._fit(name, new)
            if out is not None:
                writer = out.write.partitionBy("part") if name in DEALT else out.write
                writer.parquet(f"{self.path}/changes/{step}/{name}")
        touch(self.spark, f"{self.path}/changes/{step}/_ready")
        self._apply(step)

    def _apply(self, step: str) -> None:
        at = f"{self.path}/changes/{step}"
        for name in (x for x in children(self.spark, at) if x in SCHEMAS):
            if name in DEALT:
                rows = self.spark.read.schema(SCHEMAS[name] + ", part int").parquet(f"{at}/{name}")
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
            else:
                self.spark.read.schema(SCHEMAS[name]).parquet(f"{at}/{name}").write.mode("overwrite").parquet(f"{self.path}/{name}/step={step}")
        delete_folder(self.spark, at)

    def recover(self) -> None:
        """Finish steps that were ready when a writer stopped, and forget those that were not."""
        for step in children(self.spark, f"{self.path}/changes"):
            if exists(self.spark, f"{self.path}/changes/{step}/_ready"):
                self._apply(step)
            else:
                delete_folder(self.spark, f"{self.path}/changes/{step}")

    def _fit(self, name: str, rows: DataFrame) -> DataFrame:
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])


def group_rows(rows: DataFrame, group_id: str) -> DataFrame:
    return rows.where(F.col("group_id") == group_id)


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("expired_at").isNull())


def status(episodes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; one pass over each table, partial counts per task."""
    parts = [episodes.select(F.lit("e").alias("t")), live(nodes).select(F.lit("n").alias("t")), edges.select(F.lit("d").alias("t"))]
    t = F.col("t")
    return reduce(DataFrame.unionByName, parts).agg(
        F.count_if(t == "e").alias("episodes"), F.count_if(t == "n").alias("live_nodes"), F.count_if(t == "d").alias("edges")
    )


def tagged_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON line for each row of each table, with its tag as field t."""
    lines = [rows.select(F.to_json(F.struct(F.lit(tag).alias("t"), *rows.columns)).alias("line")) for tag, rows in tables.items()]
    return reduce(DataFrame.unionByName, lines)


def graph_dump(nodes: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """group_id, section, id, json: each row of a group as a line of JSON; a group's document is its lines by section and id.

    Lines and not one value a group, so that no task has to hold a group.
    """
    parts = []
    for name, rows, key in (("nodes", nodes, "node_id"), ("edges", edges, "edge_id"), ("episodes", episodes, "episode_id")):
        rest = [c for c in rows.columns if c not in (key, "group_id")]
        line = F.to_json(F.struct(F.col(key).alias("id"), *rest))
        parts.append(rows.select("group_id", F.lit(name).alias("section"), F.col(key).alias("id"), line.alias("json")))
    return reduce(DataFrame.unionByName, parts)


def graph_document(dump: DataFrame, group_id: str) -> str:
    """The lines of one group that fits the driver as one document {nodes, edges, episodes}, in id order."""
    lines = dump.where(F.col("group_id") == group_id).orderBy("section", "id").select("section", "json").collect()
    body = {n: ", ".join(r["json"] for r in lines if r["section"] == n) for n in ("nodes", "edges", "episodes")}
    return "{" + ", ".join(f'"{n}": [{x}]' for n, x in body.items()) + "}"


def formatted_turns(turns: DataFrame, user: str = "User", assistant: str = "Assistant") -> DataFrame:
    """conv_id, turn, content: a user's turn and the one after it; pairs of blanks are passed over."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("answer", F.coalesce(F.lead("text").over(w), F.lit(""))).where("role = 'user'")
    blank = (F.trim("text") == "") & (F.trim("answer") == "")
    content = F.concat(F.lit(f"{user}: "), "text", F.lit(f"\n{assistant}: "), "answer")
    return pairs.where(~blank).select("conv_id", "turn", content.alias("content"))


def newest(rows: DataFrame, session: list[str], order: str, slots: int = QUEUE_SLOTS) -> DataFrame:
    """What a queue holds that drops its oldest when full."""
    w = Window.partitionBy(*session).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= slots).drop("_r")


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of a JSON spec {name, group_id, episodes[], queries[]}, in order."""
    schema = (
        "name string, group_id string, queries array<string>,"
        " episodes array<struct<name string, source string, source_description string, content string, reference_time string>>"
    )
    spec = spark.read.schema(schema).json(path, multiLine=True)
    return spec.select(F.col("name").alias("trace"), "group_id", F.posexplode("episodes").alias("seq", "e")).select("trace", "group_id", "seq", "e.*")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    spec = spark.read.schema("name string, queries array<string>").json(path, multiLine=True)
    return spec.select(F.col("name").alias("trace"), F.posexplode("queries").alias("seq", "query"))
