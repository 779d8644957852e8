"""Providers of replies and vectors: rules, replay of recordings, prompted clients, recording.

A judgment is a table: requests go in, replies come out. Replay is a join, a miss an error. Live
clients are plain callables that the caller gives; none is built in.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronoweave.functions.jsontext import canonical, canonical_json
from chronoweave.functions.text import speakers
from chronoweave.models import schemas

# Fixed values.
ATTEMPTS = 3
DEFAULT_TOKENS = 16_000
EDGE_TOKENS = 16_384


def rule_entities(episodes: DataFrame) -> DataFrame:
    """episode_id, reply: the speakers of an episode's lines, as entities of type 1."""
    entity = lambda name: F.struct(name.alias("name"), F.lit(1).cast("bigint").alias("entity_type_id"), F.array(F.lit(0).cast("bigint")).alias("episode_indices"))
    return episodes.select("episode_id", F.to_json(F.struct(F.transform(speakers(F.col("content")), entity).alias("extracted_entities"))).alias("reply"))


def rule_edges(episodes: DataFrame, pattern: str = r"(?m)^(\S+) (\S+) (\S+)$") -> DataFrame:
    """episode_id, reply: facts from lines of three words (source, relation, target)."""
    part = lambda k: F.regexp_extract_all("content", F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("s"), part(2).alias("r"), part(3).alias("t"))
    none = F.lit(None).cast("string")
    edge = lambda x: F.struct(
        x["s"].alias("source_entity_name"), x["t"].alias("target_entity_name"), x["r"].alias("relation_type"), F.concat_ws(" ", x["s"], x["r"], x["t"]).alias("fact"),
        none.alias("valid_at"), none.alias("invalid_at"), F.array(F.lit(0).cast("bigint")).alias("episode_indices"),
    )
    return episodes.select("episode_id", F.to_json(F.struct(F.transform(zipped, edge).alias("edges"))).alias("reply"))


def request_key(request: Column) -> Column:
    return canonical_json(request)


def loaded_recordings(recordings: DataFrame) -> DataFrame:
    """request_key, reply of recordings (request, response as JSON, seq): of equal requests the later."""
    keyed = recordings.select(request_key(F.col("request")).alias("request_key"), "response", "seq")
    return keyed.groupBy("request_key").agg(F.max_by("response", "seq").alias("reply"))


def replayed(requests: DataFrame, recordings: DataFrame) -> DataFrame:
    """requests (with a JSON column request) and their reply; a request that was not recorded is an error."""
    keyed = requests.withColumn("request_key", request_key(F.col("request")))
    joined = keyed.join(recordings.select("request_key", "reply"), "request_key", "left")
    miss = F.raise_error(F.concat(F.lit("no recording for request "), F.col("request_key"))).cast("string")
    return joined.withColumn("reply", F.when(F.col("reply").isNull(), miss).otherwise(F.col("reply")))


def recorded(requests: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """request, response rows to append to a table of recordings."""
    return requests.select(key, "request").join(replies.select(key, F.col("reply").alias("response")), key).select("request", "response")


def complete(request: dict, chat: Callable[[list[dict], int, str], str], pause: Callable[[float], None] = time.sleep) -> dict:
    """One prompted completion: the schema goes with the last message, replies are unwrapped and checked, faults go back to the model.

    Text that is no JSON is an error at once; a reply that fails its schema is tried again.
    """
    name = request["schema_name"]
    messages = [dict(m) for m in request["messages"]]
    messages[-1]["content"] += "\n\nReply with one JSON object of this schema:\n" + json.dumps(schemas.json_schema(name), ensure_ascii=False)
    budget, fault = request.get("max_tokens") or DEFAULT_TOKENS, None
    for attempt in range(ATTEMPTS):
        if attempt:
            pause(float(2 ** (attempt - 1)))
            messages = [*messages, {"role": "user", "content": f"The last reply did not fit the schema: {fault}. Reply again."}]
        value = json.loads(schemas.unfenced(chat(messages, budget, request.get("model_size", "medium"))))
        value = schemas.unwrapped(name, value)
        fault = schemas.fault(name, value)
        if fault is None:
            return value
    raise ValueError(f"{name}: {fault}")


def prompted(requests: DataFrame, chat: Callable[[list[dict], int, str], str], key: str = "request_id") -> DataFrame:
    """key, reply for requests (key, request) by a chat callable, one call at a time in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "reply": [canonical(complete(json.loads(r), chat)) for r in batch["request"]]})

    return requests.select(key, "request").mapInPandas(run, f"{key} {dict(requests.dtypes)[key]}, reply string")


def embedded(rows: DataFrame, column: str, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 64) -> DataFrame:
    """rows with vec: vectors of a text column by an embed callable, in batches, cut to dim; empty texts get none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            vecs: list = [None] * len(part)
            full = [i for i, x in enumerate(part[column]) if x]
            for at in range(0, len(full), batch):
                ids = full[at : at + batch]
                got = embed([part[column].iloc[i] for i in ids])
                if len(got) != len(ids) or any(len(v) < dim for v in got):
                    raise ValueError(f"embedder gave {len(got)} vectors for {len(ids)} texts, or fewer than {dim} components")
                for i, v in zip(ids, got, strict=True):
                    vecs[i] = [float(x) for x in v[:dim]]
            yield part.assign(vec=vecs)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, vec array<float>")


# What is tried again, and how often.
RETRIED = (408, 429)
RETRIES = 3


class Refused(Exception):
    """What a client raises for a reply of another status than success."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(f"status {status}: {text}")
        self.status = status


def with_retries(call: Callable[[], dict], pause: Callable[[float], None] = time.sleep) -> dict:
    """The reply of a call; overload, time-outs and server errors are tried again after 2, 4 and 8 seconds."""
    for attempt in range(RETRIES + 1):
        try:
            return call()
        except Refused as e:
            if attempt == RETRIES or not (e.status in RETRIED or e.status >= 500):
                raise
        pause(float(2 ** (attempt + 1)))
    raise AssertionError


def ordered_vectors(reply: dict, expected: int, dim: int) -> list[list[float]]:
    """Vectors of an embeddings reply {data: [{index, embedding}]} in the order of their indices, cut to dim."""
    data = reply.get("data")
    if not isinstance(data, list) or len(data) != expected or sorted(x.get("index", -1) for x in data) != list(range(expected)):
        raise ValueError(f"embeddings reply does not hold one vector for each of {expected} texts")
    if any(len(x.get("embedding") or ()) < dim for x in data):
        raise ValueError(f"embeddings reply has vectors of fewer than {dim} components")
    return [[float(v) for v in x["embedding"][:dim]] for x in sorted(data, key=lambda x: x["index"])]


def embedding_client(post: Callable[[dict], dict], model: str, dim: int, pause: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """An embed callable for embedded() over a post callable, which sends a body and returns the reply or raises Refused."""
    return lambda texts: ordered_vectors(with_retries(lambda: post({"model": model, "input": texts}), pause), len(texts), dim)


def embedding_request(inputs: Column, model_id: str) -> Column:
    """The form under which a batch of texts is recorded."""
    return F.to_json(F.struct(inputs.alias("inputs"), F.lit(model_id).alias("model_id")))


def replayed_embeddings(batches: DataFrame, recordings: DataFrame, model_id: str) -> DataFrame:
    """batches (with inputs, an array of texts) and vecs, one for each text; a batch that was not recorded is an error."""
    asked = replayed(batches.withColumn("request", embedding_request(F.col("inputs"), model_id)), recordings)
    return asked.withColumn("vecs", F.from_json("reply", "array<array<float>>")).drop("request", "request_key", "reply")


def save_recordings(recordings: DataFrame, path: str) -> None:
    """Write request, response (JSON) rows as one JSON array a file, the form that read_recordings() takes."""
    line = F.concat(F.lit('{"request": '), "request", F.lit(', "response": '), "response", F.lit("}"))
    rows = recordings.select("seq" if "seq" in recordings.columns else F.monotonically_increasing_id().alias("seq"), line.alias("line"))
    one = rows.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("l"))  # a capture run's exchanges
    one.select(F.concat(F.lit("["), F.array_join("l", ",\n "), F.lit("]"))).write.mode("overwrite").text(path)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """request, response, seq of files that hold a JSON array of {request, response}."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.posexplode(F.from_json("value", "array<struct<request: string, response: string>>")).alias("seq", "r"))
    return each.select("r.request", "r.response", F.col("seq").cast("bigint").alias("seq"))


def text_provider(kind: str, chat: Callable[[list[dict], int, str], str] | None = None, recordings: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """What answers requests (request_id, request) with request_id, reply: a host's chat callable or a replay. Networked providers are not built in."""
    if kind == "host" and chat is not None:
        return lambda requests: prompted(requests, chat)
    if kind == "replay" and recordings is not None:
        known = loaded_recordings(recordings)
        return lambda requests: replayed(requests, known).select("request_id", "reply")
    raise ValueError(f"provider {kind!r} is unknown, or misses its chat callable or recordings")


def missing_names(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """Sorted distinct names without a stored vector."""
    return drafts.where("name <> ''").select("name").distinct().join(stored.where("name_vec is not null").select("name"), "name", "left_anti").orderBy("name")
