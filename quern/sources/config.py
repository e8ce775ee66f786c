"""Configurations in YAML, and digests of files and settings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml

COMMIT = re.compile(r"[0-9a-f]{40}")


def read_settings(path: str | Path, paths: tuple[str, ...] = ()) -> dict[str, Any]:
    """The mapping in a YAML file; the settings named in ``paths`` are taken as paths beside it."""
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, Mapping):
        raise ValueError(f"{path} must hold a mapping")
    return dict(found) | {k: str(resolved(path, found[k])) for k in paths if isinstance(found.get(k), str)}


def resolved(config: str | Path, value: str) -> Path:
    """A path as it is if absolute or there, else beside the configuration if there, else as it is."""
    path = Path(value)
    beside = Path(config).resolve().parent / path
    return path if path.is_absolute() or path.exists() or not beside.exists() else beside


def model_settings(config: Mapping[str, Any]) -> dict[str, Any]:
    """The checked model: id, pinned revision, template arguments, generation, and whether it thinks.

    Remote code is refused, revisions must be commits, and a thinking model must say whether it thinks and, if so, sample
    with a positive temperature and at least 128 new tokens.
    """
    name, revision = config.get("model_id"), config.get("revision")
    if not isinstance(name, str) or not name.strip():
        raise ValueError("model_id is missing")
    if not isinstance(revision, str) or not COMMIT.fullmatch(revision):
        raise ValueError(f"{name} needs the 40 hexadecimal digits of a commit as its revision")
    if config.get("trust_remote_code", False) is not False:
        raise ValueError("trust_remote_code must be false")
    arguments, generation = config.get("chat_template_kwargs", {}), {"max_new_tokens": 64, "do_sample": False} | dict(config.get("generation", {}))
    if not isinstance(arguments, Mapping):
        raise ValueError("chat_template_kwargs must be a mapping")
    family, thinks = "qwen3" in name.casefold(), arguments.get("enable_thinking")
    if (family and thinks is None) or not isinstance(thinks, bool | None) or (thinks and not family):
        raise ValueError("enable_thinking must be said, true or false, by the models that know it and by no others")
    if not isinstance(generation["do_sample"], bool) or int(generation["max_new_tokens"]) < 1:
        raise ValueError("do_sample must be true or false and max_new_tokens positive")
    if family and not thinks and generation["do_sample"]:
        raise ValueError("without thinking the decoding must be deterministic")
    if thinks:
        heat = generation.get("temperature")
        if not generation["do_sample"] or isinstance(heat, bool) or not isinstance(heat, int | float) or heat <= 0 or int(generation["max_new_tokens"]) < 128:
            raise ValueError("thinking needs do_sample, a positive temperature and max_new_tokens of at least 128")
    return {"model_id": name, "revision": revision, "chat_template_kwargs": dict(arguments), "generation": generation, "thinking": bool(thinks)}


#: A judge's settings: their kind, default and least value; "share" is between 0 and 1, "positive" above 0. Fixed values.
JUDGE = """
max_retries int 2 0
retry_backoff_seconds float 0.5 0
concurrency_limit int 1 1
timeout_seconds positive 30 0
connection_timeout_seconds positive 30 0
read_timeout_seconds positive 30 0
max_response_bytes int 32768 128
max_completion_tokens int 256 1
max_rationale_characters int 1000 1
minimum_metric_coverage share 0.8 0
minimum_paired_examples int 30 1
"""


def judge_settings(config: Mapping[str, Any]) -> dict[str, Any]:
    """The checked settings of a judge, with their defaults; no server is asked."""
    raw = config.get("judge") or {}
    if not isinstance(raw, Mapping):
        raise ValueError("judge must be a mapping")
    out = {"kind": "disabled", "strict": False, "cache": True, "structured_output": True} | dict(raw)
    if out["kind"] not in ("disabled", "callable", "openai-compatible"):
        raise ValueError(f"unknown kind of judge: {out['kind']}")
    if out["kind"] == "openai-compatible" and not all(isinstance(out.get(k), str) and out[k].strip() for k in ("base_url", "model")):
        raise ValueError("the judge needs a base_url and a model")
    for name, kind, default, least in (row.split() for row in JUDGE.strip().splitlines()):
        default = out.get("timeout_seconds", default) if name.endswith("_timeout_seconds") else default
        value = (int if kind == "int" else float)(out.get(name, default))
        if value < float(least) or (kind == "share" and value > 1) or (kind == "positive" and value <= 0):
            raise ValueError(f"the judge's {name} is out of range")
        out[name] = value
    return out


def scorer_settings(config: Mapping[str, Any] | None) -> dict[str, Any]:
    """What to score by: each part's settings, or None where it isn't wanted."""
    config = dict(config or {})
    if config.get("mode") == "disabled":
        return dict.fromkeys(("correctness", "groundedness", "citations", "judge"))
    lexical = config.get("lexical_groundedness", {})
    if not isinstance(lexical, Mapping | None) and lexical is not False:
        raise ValueError("lexical_groundedness must be a mapping or false")
    threshold = float(dict(lexical or {}).get("claim_support_threshold", 0.5))
    if not 0 <= threshold <= 1:
        raise ValueError("claim_support_threshold must be between 0 and 1")
    judge = judge_settings(config)
    return {"correctness": {}, "groundedness": None if lexical is False else {"threshold": threshold}, "citations": {} if config.get("citation_metrics") else None, "judge": None if judge["kind"] == "disabled" else judge}


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def settings_digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def file_digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def artifact_digest(path: str | Path, skip: tuple[str, ...] = ()) -> str:
    """A file's digest, or one over the files of a folder in the order of their names: name, NUL, contents."""
    root = Path(path)
    if root.is_file():
        return file_digest(root)
    files = sorted(p for p in root.rglob("*") if p.is_file() and p.name not in skip)
    if not files:
        raise ValueError(f"{path} has no files")
    whole = hashlib.sha256()
    for p in files:
        whole.update(p.relative_to(root).as_posix().encode() + b"\0")
        with open(p, "rb") as f:
            while part := f.read(1 << 20):
                whole.update(part)
    return whole.hexdigest()


def differences(one: Mapping[str, Any], other: Mapping[str, Any], at: str = "") -> list[str]:
    """The dotted names of settings that differ."""
    out = []
    for key in sorted(set(one) | set(other)):
        a, b, name = one.get(key), other.get(key), f"{at}{key}"
        if isinstance(a, Mapping) and isinstance(b, Mapping):
            out += differences(a, b, f"{name}.")
        elif a != b:
            out.append(name)
    return out
