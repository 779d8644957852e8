import json

from pyspark.sql import functions as F

from chronoweave.models import contexts
from chronoweave.operators import extraction

PREVIOUS = "array<struct<content: string, occurred_at: string>>"


def test_contexts(spark):
    types = spark.createDataFrame([(0, "Person", "One person. Two. Three. Four.")], "pos bigint, name string, description string")
    e = spark.createDataFrame([("e1", "text", "s", "Ana: hi", "2024-01-01T00:00:00Z", [("old", "2023")])], f"episode_id string, kind string, source string, content string, valid_at string, previous {PREVIOUS}")
    made = contexts.requests(contexts.extraction(e, types)).first()
    request, context = json.loads(made["request"]), json.loads(made["context"])
    assert request["schema_name"] == "ExtractedEntities" and json.loads(request["messages"][1]["content"]) == context
    assert [t["entity_type_name"] for t in context["entity_types"]] == ["Entity", "Person"]
    assert context["previous_episodes"] == [{"content": "old", "timestamp": "2023"}]

    drafts = spark.createDataFrame([("e1", 1, "Bo", ["Entity"], "d"), ("e1", 0, "Ana", ["Entity", "Person"], "p")], "episode_id string, pos bigint, name string, labels array<string>, entity_type_description string")
    kinds = extraction.fact_type_signatures(
        spark.createDataFrame([("KNOWS", "meets")], "name string, description string"), spark.createDataFrame([("Person", "Person", ["KNOWS"])], "source_type string, target_type string, names array<string>")
    )
    context = json.loads(contexts.edge_extraction(e, drafts, kinds).first()["context"])
    assert [n["name"] for n in context["nodes"]] == ["Ana", "Bo"] and context["reference_time"] == "2024-01-01 00:00:00Z"
    assert context["edge_types"][0]["fact_type_signatures"] == [{"source_type": "Person", "target_type": "Person"}]

    old = spark.createDataFrame([("e1", 0, "Anna", ["Entity"], "x" * 300)], "episode_id string, place bigint, name string, labels array<string>, summary string")
    context = json.loads(contexts.node_dedupe(drafts, old).first()["context"])
    assert [(n["id"], n["name"]) for n in context["extracted_nodes"]] == [(0, "Ana"), (1, "Bo")]
    assert context["existing_nodes"][0]["candidate_id"] == 0 and len(context["existing_nodes"][0]["summary"]) == 120

    assert "episode_content" not in context
    old = old.withColumn("attributes", F.create_map(F.lit("age"), F.lit('4"2'), F.lit("labels"), F.lit("x")))
    context = json.loads(contexts.node_dedupe(drafts, old, e).first()["context"])
    assert context["existing_nodes"][0]["age"] == '4"2' and "labels" not in context["existing_nodes"][0] and context["existing_nodes"][0]["name"] == "Anna"
    assert context["episode_content"] == "Ana: hi" and context["previous_episodes"] == [{"content": "old", "timestamp": "2023"}]
    assert json.loads(contexts.node_dedupe(drafts, old.where("false"), e).first()["context"])["existing_nodes"] == []
    two = e.withColumn("parts", F.array(*[F.struct(F.lit(c).alias("content"), F.lit(t).alias("occurred_at")) for c, t in (("first", "2024"), ("second", None))]))
    context = json.loads(contexts.extraction(two, types, "Only people.").first()["context"])
    assert "first" in context["episode_content"] and "second" in context["episode_content"] and context["custom_extraction_instructions"].startswith("Only people.") and len(context["custom_extraction_instructions"]) > 20

    nodes = spark.createDataFrame([(0, 1, "Bo", "b", ["Entity"]), (0, 0, "Ana", "a", ["Entity"])], "flight bigint, pos bigint, name string, summary string, labels array<string>")
    context = json.loads(contexts.summary(nodes, types).first()["context"])
    assert [x["name"] for x in context["entities"]] == ["Ana", "Bo"] and context["entity_type_descriptions"] == {"Person": "One person. Two. Three."}
    assert contexts.requests(contexts.summary(nodes, types)).select(F.get_json_object("request", "$.model_size")).first()[0] == "small"
