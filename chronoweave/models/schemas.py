"""Reply schemas: fields, checks and the Spark types to read them with."""

from __future__ import annotations

import re

# Fixed names. A field is name: type, with `?` where it may be missing.
RECORDS = {
    "ExtractedEntity": "name: str, entity_type_id: int, episode_indices?: [int]",
    "ExtractedEntities": "extracted_entities: [ExtractedEntity]",
    "EntitySummary": "summary: str",
    "SummarizedEntity": "name: str, summary: str",
    "SummarizedEntities": "summaries: [SummarizedEntity]",
    "Edge": "source_entity_name: str, target_entity_name: str, relation_type: str, fact: str, valid_at?: str, invalid_at?: str, episode_indices?: [int]",
    "ExtractedEdges": "edges: [Edge]",
    "EdgeTimestamps": "valid_at?: str, invalid_at?: str",
    "BatchEdgeTimestamps": "timestamps: [EdgeTimestamps]",
    "NodeDuplicate": "id: int, name: str, duplicate_candidate_id: int",
    "NodeResolutions": "entity_resolutions: [NodeDuplicate]",
    "EdgeDuplicate": "duplicate_facts: [int], contradicted_facts: [int]",
    "CombinedEntity": "name: str, entity_type_id: int, episode_indices?: [int]",
    "CombinedFact": "source_entity_name: str, target_entity_name: str, relation_type: str, fact: str, valid_at?: str, invalid_at?: str, episode_indices?: [int]",
    "CombinedExtraction": "extracted_entities: [CombinedEntity], edges: [CombinedFact]",
    "Summary": "summary: str",
    "SummaryDescription": "description: str",
}


def fields(name: str) -> dict[str, tuple[str, bool]]:
    """Field -> (type, required)."""
    out = {}
    for part in RECORDS[name].split(", "):
        field, kind = part.split(": ")
        out[field.rstrip("?")] = (kind, not field.endswith("?"))
    return out


def _spark(kind: str) -> str:
    if kind.startswith("["):
        return f"array<{_spark(kind[1:-1])}>"
    return {"str": "string", "int": "bigint"}.get(kind) or spark_type(kind)


def spark_type(name: str) -> str:
    """DDL of a schema, for from_json."""
    return "struct<" + ", ".join(f"{f}: {_spark(kind)}" for f, (kind, _) in fields(name).items()) + ">"


def json_schema(name: str) -> dict:
    def of(kind: str) -> dict:
        if kind.startswith("["):
            return {"type": "array", "items": of(kind[1:-1])}
        return {"str": {"type": "string"}, "int": {"type": "integer"}}.get(kind) or json_schema(kind)

    parts = fields(name)
    return {"title": name, "type": "object", "properties": {f: of(k) for f, (k, _) in parts.items()}, "required": [f for f, (_, r) in parts.items() if r]}


def fault(name: str, value) -> str | None:
    """What is wrong with a reply, or None. Schemas that are not listed pass."""
    if name not in RECORDS:
        return None

    def of(kind: str, x, where: str) -> str | None:
        if kind.startswith("["):
            if not isinstance(x, list):
                return f"{where} is no list"
            return next((f for i, y in enumerate(x) if (f := of(kind[1:-1], y, f"{where}[{i}]"))), None)
        if kind == "str":
            return None if isinstance(x, str) else f"{where} is no text"
        if kind == "int":
            return None if isinstance(x, int) and not isinstance(x, bool) else f"{where} is no whole number"
        if not isinstance(x, dict):
            return f"{where} is no object"
        for f, (sub, required) in fields(kind).items():
            if x.get(f) is None:
                if required:
                    return f"{where}.{f} is missing"
            elif found := of(sub, x[f], f"{where}.{f}"):
                return found
        return None

    return of(name, value, name)


def unfenced(text: str) -> str:
    """As functions.text.strip_fences()."""
    return re.sub(r"```\Z", "", re.sub(r"^```(?:json)?", "", text.strip())).strip()


def unwrapped(name: str, value):
    """A reply that echoes its schema, without the wrapping `properties`."""
    required = [f for f, (_, r) in fields(name).items() if r] if name in RECORDS else []
    inner = value.get("properties") if isinstance(value, dict) else None
    if required and isinstance(inner, dict) and any(f not in value for f in required) and all(f in inner for f in required):
        return inner
    return value
