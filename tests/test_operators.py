import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronoweave.models import providers, schemas
from chronoweave.operators import conformance, extraction, graph, ingest, resolution, search, temporal
from chronoweave.sources import store
from chronoweave.streaming.ingest import Ingester, stream


def day(n):
    return dt.datetime(2024, 1, n)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_contradictions(spark):
    cases = [(5, None, 2, None), (5, None, 2, 4), (2, 3, 4, None), (5, None, 5, None), (None, None, 2, None)]
    data = [tuple(day(x) if x else None for x in c) for c in cases]
    df = spark.createDataFrame(data, "v timestamp_ntz, i timestamp_ntz, ov timestamp_ntz, oi timestamp_ntz")
    got = [r[0] for r in df.select(temporal.invalidates(*[F.col(c) for c in ("v", "i", "ov", "oi")])).collect()]
    assert got == [True, False, False, False, False]


def test_superseded_against_brute_force(spark):
    import random

    rng = random.Random(4)
    edges = [(f"e{k}", f"s{rng.randrange(4)}", f"o{rng.randrange(3)}", day(rng.randrange(1, 20))) for k in range(200)]
    df = spark.createDataFrame(edges, "edge_id string, src string, dst string, valid_at timestamp_ntz")
    got = {r["edge_id"]: r["invalid_at"] for r in temporal.superseded(df, ["src"]).collect()}
    for e, s, o, v in edges:
        assert got[e] == min((v2 for _, s2, o2, v2 in edges if s2 == s and o2 != o and v2 > v), default=None)


def test_first_decision_and_blocker(spark):
    d = spark.createDataFrame([("p", "e", 1, None), ("p", "e", 2, day(3)), ("p", "f", 1, day(9)), ("q", "f", 1, day(4))], "episode_id string, edge_id string, seq int, invalid_at timestamp_ntz")
    assert rows(temporal.folded_bounds(temporal.first_decisions(d)), "edge_id", "invalid_at") == [("f", day(4))]


def test_node_tiers(spark):
    stored = spark.createDataFrame([("n1", "g", "Northwind Laboratories", ["Entity"]), ("n2", "g", "Sam", ["Entity"]), ("n3", "g", "sam", ["Entity"])], "node_id string, group_id string, name string, labels array<string>")
    drafts = spark.createDataFrame(
        [("a", "g", "NORTHWIND  laboratories", ["Entity", "Org"]), ("b", "g", "Northwind-Laboratories", ["Entity"]), ("c", "g", "Sam", ["Entity"]), ("d", "g", "Other", ["Entity"]), ("e", "h", "Sam", ["Entity"])],
        "draft_id string, group_id string, name string, labels array<string>",
    )
    got = {r["draft_id"]: (r["node_id"], r["how"], r["labels"]) for r in resolution.resolve_nodes(drafts, stored).collect()}
    assert got == {
        "a": ("n1", "exact", ["Entity", "Org"]), "b": ("n1", "fuzzy", ["Entity"]), "c": (None, "ambiguous", ["Entity"]), "d": (None, "new", ["Entity"]), "e": (None, "new", ["Entity"]),
    }


def test_extraction(spark):
    reply = json.dumps({"extracted_entities": [
        {"name": "Ana", "entity_type_id": 1, "episode_indices": [0, 7]}, {"name": "  ", "entity_type_id": 1}, {"name": "ANA ", "entity_type_id": 9}, {"name": "Secret", "entity_type_id": 2},
    ]})
    replies = spark.createDataFrame([("e1", reply)], "episode_id string, reply string")
    types = spark.createDataFrame([(1, "Person"), (2, "Hidden")], "type_id bigint, type_name string")
    out = spark.createDataFrame([("Hidden",)], "type_name string")
    got = extraction.extract_nodes(replies, types, out).collect()
    assert [(r["name"], r["labels"], r["episode_indices"], r["pos"]) for r in got] == [("Ana", ["Entity", "Person"], [0], 0)]


def test_graph(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d"), ("4", "x", "x")], "edge_id string, src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert rows(graph.traverse(edges, seeds, 2), "node_id", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.traverse(edges, seeds, 3, 2), "node_id", "depth") == [("a", 0), ("b", 1)]
    assert rows(graph.history(edges, spark.createDataFrame([("b",), ("x",)], "node_id string")), "node_id", "edge_id") == [("b", "1"), ("b", "2"), ("x", "4")]
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(7)], "node_id string, merged_into string")
    assert rows(graph.canonical(chain), "node_id", "into", "hops") == [(f"n{k}", "n7", 7 - k) for k in range(7)]


def test_search(spark):
    facts = [("1", "a", "b", "Ana works at Northwind"), ("2", "a", "c", "Ana moved to Lisbon"), ("3", "d", "c", "小明喜欢北京烤鸭")]
    schema = "id string, src string, dst string, fact string, valid_at timestamp_ntz, invalid_at timestamp_ntz, vec array<float>, group_id string, kind string"
    df = spark.createDataFrame([(i, s, t, f, None, None, [1.0, 0.0], "g", "edge") for i, s, t, f in facts] + [("n", None, None, "Northwind", None, None, None, "g", "node"), ("x", "a", "b", "Northwind in h", None, None, None, "h", "edge")], schema)
    mentions = spark.createDataFrame([("e2", "1"), ("e1", "1"), ("e9", "2")], "episode_id string, target_id string")
    first = search.search_edges(df, "works northwind", group_id="g", mentions=mentions).first()
    assert (first["id"], first["rank"], first["episodes"], first["src"]) == ("1", 1, ["e1", "e2"], "a")
    assert [r["id"] for r in search.search_edges(df.where("id = '3' or id = '1'"), "北京烤").collect()] == ["3"]
    assert search.search_edges(df, "works", limit=0, mentions=mentions).count() == 0
    assert {r["id"] for r in search.search(df, "northwind", kinds=("node",)).collect()} == {"n"}
    # a vector of another dimension is passed over, and a query of short words has no trigram leg
    assert search.search_edges(df, "zzz", [1.0, 0.0, 0.0], group_id="g").count() == 0 and search.search_edges(df, "zzz", [1.0, 0.0], group_id="g").count() == 3
    assert search.search_edges(df, "a-t x", group_id="g").count() == 0
    assert [r["id"] for r in search.bm25(df, "ana works", search.WORDS).collect()] == ["1"]
    assert search.bm25(df, " ", search.WORDS).count() == 0


def test_stored_postings(spark, tmp_path):
    facts = spark.createDataFrame([(str(k), f"fact {k % 3} of {k % 5} and {'x ' * (k % 4)}") for k in range(60)], "id string, fact string")
    for leg, q in ((search.WORDS, "fact 1 x"), (search.TRIGRAMS, "of 3 and")):
        path = str(tmp_path / ("w" if leg is search.WORDS else "t"))
        search.store_postings(facts, leg, path)
        got = {r["id"]: round(r["score"], 9) for r in search.search_postings(spark, path, q, leg).collect()}
        assert got and got == {r["id"]: round(r["score"], 9) for r in search.bm25(facts, q, leg).collect()}
    plan = search.search_postings(spark, path, "abc", search.TRIGRAMS)._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan


def test_state_difference(spark):
    a = spark.createDataFrame([("e0", "x", None), ("e1", "y", "z")], "alias string, fact string, until string")
    assert conformance.state_difference(a, a, "alias", ["fact", "until"]).count() == 0
    b = a.withColumn("fact", F.when(F.col("alias") == "e1", "changed").otherwise(F.col("fact")))
    assert rows(conformance.state_difference(a, b, "alias", ["fact", "until"]), "alias", "field", "left_value", "right_value") == [("e1", "fact", "y", "changed")]


def test_replay(spark):
    req = spark.createDataFrame([("1", '{"b": 1, "a": 2}')], "id string, request string")
    log = spark.createDataFrame([('{"a": 2, "b": 1}', "old", 1), ('{"a": 2, "b": 1}', "new", 2)], "request string, response string, seq int")
    assert [r["reply"] for r in providers.replayed(req, providers.loaded_recordings(log)).collect()] == ["new"]
    with pytest.raises(Exception, match="no recording"):
        providers.replayed(req, providers.loaded_recordings(log.where("seq = 9"))).collect()


def test_prompted_model():
    request = {"messages": [{"role": "user", "content": "q"}], "schema_name": "EdgeDuplicate"}
    said = iter(['{"duplicate_facts": "no"}', '```json\n{"properties": {"duplicate_facts": [1], "contradicted_facts": []}}\n```'])
    pauses = []
    assert providers.complete(request, lambda *_: next(said), pauses.append) == {"duplicate_facts": [1], "contradicted_facts": []}
    assert pauses == [1.0]
    with pytest.raises(ValueError):
        providers.complete(request, lambda *_: "no json", pauses.append)
    with pytest.raises(ValueError, match="missing"):
        providers.complete(request, lambda *_: "{}", pauses.append)
    assert len(schemas.RECORDS) == 17 and schemas.fault("Unlisted", 1) is None


def test_embedded(spark):
    df = spark.createDataFrame([("a",), ("",)], "name string")
    out = providers.embedded(df, "name", lambda xs: [[float(len(x)), 2.0, 3.0] for x in xs], 2).collect()
    assert [r["vec"] for r in out] == [[1.0, 2.0], None]


def test_recordings_and_dispatch(spark, tmp_path):
    log = spark.createDataFrame([('{"b": "x\\"y", "a": 2}', '{"r": [1]}', 1), ('{"inputs": ["s", "t"], "model_id": "m"}', "[[1.0, 2.0], [3.0, 4.0]]", 2), ('{"a": 2, "b": "x\\"y"}', '{"r": [2]}', 3)], "request string, response string, seq bigint")
    providers.save_recordings(log, str(tmp_path / "rec"))
    back = providers.read_recordings(spark, str(tmp_path / "rec"))
    assert [(json.loads(r["request"]), json.loads(r["response"]), r["seq"]) for r in back.orderBy("seq").collect()] == [(json.loads(r["request"]), json.loads(r["response"]), r["seq"] - 1) for r in log.orderBy("seq").collect()]
    asked = spark.createDataFrame([("1", '{"a": 2, "b": "x\\"y"}')], "request_id string, request string")
    assert rows(providers.text_provider("replay", recordings=back)(asked), "request_id", "reply") == [("1", '{"r":[2]}')]
    batches = spark.createDataFrame([(["s", "t"],)], "inputs array<string>")
    assert providers.replayed_embeddings(batches, providers.loaded_recordings(back), "m").first()["vecs"] == [[1.0, 2.0], [3.0, 4.0]]
    for kind in ("host", "replay", "anything"):
        with pytest.raises(ValueError, match="provider"):
            providers.text_provider(kind)


def test_embedding_client():
    replies = [providers.Refused(429), providers.Refused(503), {"data": [{"index": 1, "embedding": [3, 4, 5]}, {"index": 0, "embedding": [1, 2, 9]}]}]
    waits = []

    def post(body):
        assert body == {"model": "m", "input": ["a", "b"]}
        r = replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    assert providers.embedding_client(post, "m", 2, waits.append)(["a", "b"]) == [[1.0, 2.0], [3.0, 4.0]] and waits == [2.0, 4.0]
    replies[:] = [providers.Refused(400)]
    with pytest.raises(providers.Refused):
        providers.embedding_client(post, "m", 2, waits.append)(["a", "b"])
    replies[:] = [providers.Refused(500)] * 9
    with pytest.raises(providers.Refused):
        providers.embedding_client(post, "m", 2, waits.append)(["a", "b"])
    assert len(replies) == 5
    for bad in ({}, {"data": []}, {"data": [{"index": 0, "embedding": [1, 2]}, {"index": 0, "embedding": [1, 2]}]}, {"data": [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1, 2]}]}):
        with pytest.raises(ValueError):
            providers.ordered_vectors(bad, 2, 2)


EPISODES = [
    {"episode_id": "1", "group_id": "g", "kind": "text", "source": "s", "content": "Ana: hi\nNorthwind: hi\nAna WORKS_AT Northwind", "valid_at": "2024-01-01", "seq": 1},
    {"episode_id": "2", "group_id": "g", "kind": "text", "source": "s", "content": "ANA: hi\nMeridian: hi\nANA WORKS_AT Meridian", "valid_at": "2024-02-01", "seq": 2},
    {"episode_id": "3", "group_id": "h", "kind": "text", "source": "s", "content": " ", "valid_at": None, "seq": 1},
]


def test_streaming_ingestion(spark, tmp_path):
    """Two episodes: a merge, an invalidation at the later time, ghosts that point on; and a second run changes nothing."""
    (tmp_path / "in").mkdir()
    for k, e in enumerate(EPISODES):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(e))
    s = store.Store(spark, str(tmp_path / "db"))
    types = spark.createDataFrame([(1, "Person")], "type_id bigint, type_name string")
    now = F.lit("2030-01-01").cast("timestamp")
    ingester = Ingester(s, types, now, contradictory=("WORKS_AT",))
    q = stream(spark, str(tmp_path / "in"), ingester, str(tmp_path / "cp"), files_per_batch=3)
    assert q.awaitTermination(240) and q.exception() is None
    nodes = {r["name"]: r for r in s.read("nodes").where("expired_at is null").collect()}
    assert set(nodes) == {"Ana", "Northwind", "Meridian"}
    ghosts = s.read("nodes").where("merged_into is not null").collect()
    assert [g["merged_into"] for g in ghosts] == [nodes["Ana"]["node_id"]]
    edges = {r["fact"]: r for r in s.read("edges").collect()}
    assert edges["Ana WORKS_AT Northwind"]["invalid_at"] == dt.datetime(2024, 2, 1) and edges["ANA WORKS_AT Meridian"]["invalid_at"] is None
    assert nodes["Ana"]["summary"] == "Ana WORKS_AT Northwind\nANA WORKS_AT Meridian"
    before = [s.read(t).count() for t in ("nodes", "edges", "mentions", "episodes")]
    ingester.add(spark.createDataFrame(EPISODES, "episode_id string, group_id string, kind string, source string, content string, valid_at string, seq bigint"))
    assert [s.read(t).count() for t in ("nodes", "edges", "mentions", "episodes")] == before == [4, 2, 6, 2]


def _state(s):
    return [sorted(map(str, s.read(t).select(*cols).collect())) for t, cols in (("nodes", ("node_id", "name", "summary", "merged_into")), ("edges", ("edge_id", "fact", "invalid_at")), ("mentions", ("episode_id", "target_id")), ("episodes", ("episode_id",)))]


@pytest.mark.parametrize("writes", [0, 1, 3])
def test_a_writer_that_stops_between_writes(spark, tmp_path, writes, monkeypatch):
    """A step is taken whole or not at all: stopped before or after its changes were ready, the batch is run again to the same state."""
    types = spark.createDataFrame([(1, "Person")], "type_id bigint, type_name string")
    now = F.lit("2030-01-01").cast("timestamp")
    rows = spark.createDataFrame(EPISODES, "episode_id string, group_id string, kind string, source string, content string, valid_at string, seq bigint")
    whole = store.Store(spark, str(tmp_path / "whole"))
    Ingester(whole, types, now, contradictory=("WORKS_AT",)).add(rows)
    cut = store.Store(spark, str(tmp_path / "cut"))
    real_children, real_touch, calls = store.children, store.touch, []

    def children(spark, path):  # the tables that a step applies; it stops after some of them
        names = real_children(spark, path)
        return names[:writes] if "/changes/" in path and not calls else names

    def touch(spark, path):
        if not writes:
            raise RuntimeError("stopped")
        real_touch(spark, path)

    def delete(spark, path):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(store, "children", children)
        m.setattr(store, "touch", touch)
        m.setattr(store, "delete_folder", delete)
        with pytest.raises(RuntimeError):
            Ingester(cut, types, now, contradictory=("WORKS_AT",)).add(rows)
    Ingester(cut, types, now, contradictory=("WORKS_AT",)).add(rows)
    assert _state(cut) == _state(whole) and real_children(spark, str(tmp_path / "cut" / "changes")) == []


def test_breaker(spark, tmp_path):
    types = spark.createDataFrame([(1, "Person")], "type_id bigint, type_name string")
    rows = spark.createDataFrame(EPISODES, "episode_id string, group_id string, kind string, source string, content string, valid_at string, seq bigint")

    def broken(_):
        raise RuntimeError("no model")

    ingester = Ingester(store.Store(spark, str(tmp_path)), types, F.lit("2030-01-01").cast("timestamp"), entities=broken)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            ingester.batch(rows, 0)
    assert ingester.set_aside().count() == 0
    ingester.batch(rows.where("episode_id = '1'"), 0)
    ingester.batch(rows.where("episode_id = '2'"), 1)
    ingester.batch(rows.where("episode_id = '2'"), 1)  # a batch that is run again is set aside once
    assert ingester.failures == 3 and sorted((r["batch"], r["reason"]) for r in ingester.set_aside().collect()) == [(0, "no model"), (1, "the breaker is open")]
    ingester.entities = providers.rule_entities
    ingester.retry()
    assert ingester.failures == 0 and ingester.set_aside().count() == 0 and ingester.store.read("episodes").count() == 2


def test_names_resolve_within_their_pool(spark):
    """An equal name whose vector is far is another node; vectors are kept."""
    vec = {"Ana": [1.0, 0.0], "ANA": [0.0, 1.0], "Sam": [0.6, 0.8], "SAM": [0.61, 0.79], "Ana KNOWS Sam": [1.0, 1.0], "ANA KNOWS SAM": [1.0, 1.0]}
    lookup = spark.createDataFrame(list(vec.items()), "text string, vec array<double>")
    types = spark.createDataFrame([(1, "Person")], "type_id bigint, type_name string")
    now = F.lit("2030-01-01").cast("timestamp")
    none = {n: spark.createDataFrame([], store.SCHEMAS[n]) for n in ("nodes", "edges")}
    e = spark.createDataFrame([("1", "g", "text", "s", "Ana: hi\nSam: hi\nAna KNOWS Sam", "2024-01-01", 1), ("2", "g", "text", "s", "ANA: hi\nSAM: hi\nANA KNOWS SAM", "2024-02-01", 2)], "episode_id string, group_id string, kind string, source string, content string, valid_at string, seq bigint")
    vectors = lambda texts: texts.join(lookup, "text")
    take = lambda x, nodes, edges: ingest.step(x, nodes, edges, providers.rule_entities(x), providers.rule_edges(x), types, now, vectors=vectors)
    first = take(e.where("seq = 1"), none["nodes"], none["edges"])
    nodes, edges = first.nodes, first.edges
    assert {r["name"]: [round(x, 3) for x in r["name_vec"]] for r in nodes.collect()} == {"Ana": [1.0, 0.0], "Sam": [0.6, 0.8]}
    assert [r["fact_vec"] for r in edges.collect()] == [[1.0, 1.0]]
    second = take(e.where("seq = 2"), nodes, edges)
    got = {r["name"]: r["merged_into"] is not None for r in second.nodes.where("expired_at is null or merged_into is not null").collect()}
    assert got == {"ANA": False, "SAM": True, "Sam": False} and second.edges.count() == 1
    # a model's replies, by index, about what names left open
    open_ = spark.createDataFrame([("2", "d1", 0), ("2", "d2", 1)], "batch_id string, draft_id string, pos int")
    pool = spark.createDataFrame([("2", "n1", 5), ("2", "n2", 7)], "batch_id string, node_id string, pos int")
    replies = spark.createDataFrame([("2", 0, 1, 1), ("2", 1, 1, 0), ("2", 2, 9, 0), ("2", 3, 0, 5)], "batch_id string, pos int, id bigint, candidate_id bigint")
    assert rows(resolution.judged_nodes(open_, pool, replies), "draft_id", "node_id") == [("d2", "n2")]


def test_cosine_pool_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(resolution, "POOL_BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 5)).round(1)
    v[10], v[20], v[30] = v[5], v[5], 0
    group = ["big"] * 40 + [f"g{k % 6}" for k in range(20)]
    data = [(f"x{k:02d}", group[k], v[k].tolist() if k != 31 else None) for k in range(60)]
    a, b = spark.createDataFrame(data, "draft_id string, group_id string, vec array<double>"), spark.createDataFrame(data, "node_id string, group_id string, vec array<double>")
    unit = v / np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
    want = []
    for i in range(60):
        near = sorted((-round(float(unit[i] @ unit[j]), 12), f"x{j:02d}") for j in range(60) if group[i] == group[j] and 31 not in (i, j) and unit[i] @ unit[j] > 0.2)
        want += [(f"x{i:02d}", n, r + 1) for r, (_, n) in enumerate(near[:4])]
    assert rows(resolution.cosine_pool(a, b, 0.2, 4), "draft_id", "node_id", "rank") == sorted(want)


def test_spec(spark, tmp_path):
    spec = {"name": "t", "group_id": "g", "queries": ["q"], "episodes": [{"name": "a", "source": "text", "source_description": "d", "content": "c", "reference_time": "2024-01-01"}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    assert rows(store.read_spec(spark, str(tmp_path / "spec.json")), "group_id", "seq", "name", "content") == [("g", 0, "a", "c")]
    assert rows(store.read_queries(spark, str(tmp_path / "spec.json")), "query") == [("q",)]


def test_ids_follow_from_content(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "x string, y string").select(ingest.content_id(F.col("x"), F.col("y")))
    assert len({r[0] for r in df.collect()}) == 1
