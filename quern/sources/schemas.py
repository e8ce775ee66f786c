"""A check of artifacts against JSON schemas, as far as this engine's own artifacts need it."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

_KINDS = {"object": Mapping, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    return isinstance(value, _KINDS[kind]) and not (kind in ("number", "integer") and isinstance(value, bool))


def problems(value: Any, schema: Mapping[str, Any], at: str = "$", known: Mapping[str, Any] | None = None) -> list[str]:
    """What is wrong with a value, each with its dotted place; ``known`` holds the schemas that $ref names."""
    if "$ref" in schema:
        return problems(value, (known or {})[schema["$ref"]], at, known)
    if "anyOf" in schema and all(problems(value, x, at, known) for x in schema["anyOf"]):
        return [f"{at}: fits none of the forms allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: must be {' or '.join(kinds)}"]
    out = []
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: must be {schema['const']!r}")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: must be one of {schema['enum']}")
    if _is(value, "number"):
        out += [f"{at}: must be at least {schema['minimum']}"] if "minimum" in schema and value < schema["minimum"] else []
        out += [f"{at}: must be at most {schema['maximum']}"] if "maximum" in schema and value > schema["maximum"] else []
    if isinstance(value, str):
        out += [f"{at}: is too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: doesn't match {schema['pattern']}"] if "pattern" in schema and not re.search(schema["pattern"], value) else []
    if isinstance(value, list):
        out += [f"{at}: has too few items"] if len(value) < schema.get("minItems", 0) else []
        out += [f"{at}: repeats an item"] if schema.get("uniqueItems") and any(x in value[:i] for i, x in enumerate(value)) else []
        out += [p for i, x in enumerate(value) for p in problems(x, schema.get("items", {}), f"{at}.{i}", known)]
    if isinstance(value, Mapping):
        out += [f"{at}.{k}: is missing" for k in schema.get("required", []) if k not in value]
        fields, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        for k, x in value.items():
            if k in fields:
                out += problems(x, fields[k], f"{at}.{k}", known)
            elif others is False:
                out.append(f"{at}.{k}: isn't allowed")
            elif isinstance(others, Mapping):
                out += problems(x, others, f"{at}.{k}", known)
    return out


def require(value: Any, schema: Mapping[str, Any], known: Mapping[str, Any] | None = None) -> None:
    found = problems(value, schema, known=known)
    if found:
        raise ValueError("; ".join(found[:10]))


def _record(closed: bool = True, optional: tuple[str, ...] = (), **fields: Any) -> dict[str, Any]:
    """An object with these fields, all required but for the optional ones."""
    return {"type": "object", "additionalProperties": not closed, "required": [f for f in fields if f not in optional], "properties": fields}


def _null(schema: Mapping[str, Any]) -> dict[str, Any]:
    return {"anyOf": [schema, {"type": "null"}]}


_TEXT, _OBJECT, _FLAG, _COUNT = {"type": "string", "minLength": 1}, {"type": "object"}, {"type": "boolean"}, {"type": "integer", "minimum": 0}
_TEXTS, _DIGEST = {"type": "array", "items": {"type": "string"}}, {"type": "string", "pattern": "^[0-9a-f]{64}$"}
_MODEL = _record(model_id=_TEXT, revision={"type": "string", "pattern": "^[0-9a-f]{40}$"})
_PROMPT = _record(name=_TEXT, version=_TEXT, template_sha256=_DIGEST)
_RECIPE, _MODE = {"enum": ["base", "rag", "sft-rag", "raft-rag"]}, {"enum": ["sft", "raft"]}
_LEGACY = {"model": _MODEL, "adaptation_mode": _MODE, "training_prompt": _PROMPT, "chat_template_kwargs": _OBJECT, "training_dataset_fingerprint": _DIGEST, "validation_dataset_fingerprint": _DIGEST, "held_out_evaluation_sha256": _DIGEST, "training_configuration_sha256": _DIGEST, "adapter_artifact_sha256": _DIGEST}

#: The contracts of artifacts: an adapter's manifest in its two versions, benchmark plans and summaries, partition manifests. Fixed values.
ADAPTER_LEGACY = _record(closed=False, schema_version={"const": 2}, **_LEGACY)
ADAPTER = _record(
    schema_name=_TEXT, schema_version={"const": 3}, recipe=_null({"type": "string"}), **_LEGACY,
    training_source_fingerprint=_DIGEST, validation_source_fingerprint=_DIGEST, training_controls=_OBJECT, training_control_sha256=_DIGEST,
    best_checkpoint=_null({"type": "string"}), best_validation_metric=_null({"type": "number"}),
)
PROVENANCE = _record(
    path=_TEXT, verified=_FLAG, status={"enum": ["verified", "legacy_manifest_unavailable", "unverified_legacy_provenance"]},
    reason_code={"enum": ["manifest_missing", "legacy_schema_unsupported", "legacy_prompt_provenance_unavailable", "legacy_training_controls_unavailable", None]},
    artifact_sha256=_null(_DIGEST), adaptation_mode={"enum": ["sft", "raft", None]}, training_source_fingerprint=_null(_DIGEST), validation_source_fingerprint=_null(_DIGEST),
    training_control_sha256=_null(_DIGEST), training_controls=_null(_OBJECT), unchecked_fields=_TEXTS | {"uniqueItems": True}, warnings=_TEXTS,
    manifest_schema_version=_null({"type": "integer"}), manifest_schema_name=_null({"type": "string"}),
)
PLAN = _record(
    schema_name={"const": "benchmark-plan"}, schema_version={"const": 1},
    fixed_contract=_record(closed=False, **dict.fromkeys("model_config documents eval_set retriever scorer top_k seed generation chat_template_kwargs prompt bootstrap_samples warmup_examples load_in_4bit allow_unverified_adapter allow_unmatched_training_controls".split(), {})),
    jobs={"type": "array", "minItems": 1, "items": _record(recipe=_RECIPE, model_config={"type": "string"}, documents={"type": "string"}, eval_set={"type": "string"}, use_retrieval=_FLAG, adapter_path=_null({"type": "string"}))},
    validation=_record(
        validation_level={"enum": ["structural", "static-protocol"]}, model_weights_loaded={"const": False}, adapter_provenance_validated=_FLAG,
        adapter_provenance={"type": "object", "additionalProperties": PROVENANCE}, training_controls_matched=_null(_FLAG), scorer_configuration_validated=_FLAG, ready_for_execution=_FLAG,
    ),
)
SUMMARY = _record(
    schema_name={"const": "benchmark-summary"}, schema_version={"const": 3},
    configuration=_record(closed=False, **dict.fromkeys("model prompt retriever scorer seed bootstrap_samples".split(), {})),
    provenance=_record(verified=_FLAG, confounded=_FLAG, allow_unverified_adapter=_FLAG, allow_unmatched_training_controls=_FLAG, training_controls_matched=_null(_FLAG), training_control_mismatches=_TEXTS, warnings=_TEXTS),
    retrieval_metrics=_OBJECT,
    recipes={"type": "object", "additionalProperties": _record(closed=False, adapter_path=_null({"type": "string"}), adapter_sha256=_null({"type": "string"}), adapter_provenance=_null(PROVENANCE), retrieval_enabled=_FLAG, predictions={"type": "string"}, metrics=_OBJECT)},
    comparisons=_OBJECT,
)
PARTITIONS = _record(
    closed=False, schema_name={"const": "raft-partition-manifest"}, schema_version={"const": 1}, strategy={"enum": ["row", "grouped"]}, group_by=_TEXTS, group_counts=_OBJECT,
    corpus_policy={"enum": ["shared-corpus", "document-disjoint"]}, partition_fingerprints=_OBJECT, document_overlap_count=_COUNT, question_overlap_count=_COUNT,
    negative_mining_scope={"const": "split-before-mining"}, negative_strategy={"enum": ["random", "bm25-hard-negative"]}, candidate_pool_size={"type": "integer", "minimum": 1},
    distractors=_COUNT, document_pools=_record(train_count=_COUNT, validation_count=_COUNT, overlap_count=_COUNT), seed={"type": "integer"},
)
