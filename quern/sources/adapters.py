"""Checking that an adapter is what its manifest says, and that two adapters may be compared."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from quern.sources import controls as training
from quern.sources import schemas
from quern.sources.config import artifact_digest

MANIFEST = "adapter_manifest.json"
"""The manifest's usual name; ``Run.manifest`` sets another, for adapters that come from elsewhere."""
LIBRARY_FILE = "adapter_config.json"
VERSION, LEGACY = 3, 2
MODES = {"sft-rag": "sft", "raft-rag": "raft"}
_UPPER, _LOWER, _FLAGS = ("peft_type", "task_type"), ("bias",), ("use_rslora", "use_dora")
_NEEDED = ("peft_type", "task_type", "rank", "alpha", "dropout", "bias", "target_modules")


class AdapterError(ValueError):
    """An adapter that can't be used; ``kind`` says why: config, manifest, mismatch, integrity or missing."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Run:
    """What a run expects of its adapters. prompt: name, version and template_sha256."""

    model_id: str
    revision: str
    prompt: Mapping[str, Any]
    template_arguments: Mapping[str, Any] = field(default_factory=dict)
    eval_sha256: str | None = None
    manifest: str = MANIFEST


@dataclass(frozen=True)
class Verification:
    path: str
    verified: bool
    status: str = "verified"
    reason_code: str | None = None
    artifact_sha256: str | None = None
    adaptation_mode: str | None = None
    training_source_fingerprint: str | None = None
    validation_source_fingerprint: str | None = None
    training_control_sha256: str | None = None
    training_controls: Mapping[str, Any] | None = None
    unchecked_fields: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    manifest_schema_version: int | None = None
    manifest_schema_name: str | None = None

    def as_dict(self) -> dict[str, Any]:
        return asdict(self) | {"unchecked_fields": list(self.unchecked_fields), "warnings": list(self.warnings)}


def library_view(config: Mapping[str, Any], complete: bool = True) -> dict[str, Any]:
    """The model and the shape in an adapter's own configuration, in the form of the controls.

    Without ``complete``, what isn't said stays out; with it, the main fields must be there and others take their defaults.
    """
    bad = lambda text: AdapterError("config", f"{LIBRARY_FILE}: {text}")
    base, revision = config.get("base_model_name_or_path"), config.get("revision")
    if not isinstance(base, str) or not base.strip():
        raise bad("base_model_name_or_path is missing")
    if not isinstance(revision, str | None):
        raise bad("revision must be a text")
    absent = [training.LIBRARY_NAMES[n] for n in _NEEDED if training.LIBRARY_NAMES[n] not in config]
    if complete and absent:
        raise bad(f"{absent} are missing")
    shape: dict[str, Any] = {}
    for ours, theirs in training.LIBRARY_NAMES.items():
        if theirs not in config and not complete:
            continue
        value = config.get(theirs, False if ours in _FLAGS else None)
        try:
            if ours in training.SHAPE:
                value = training.SHAPE[ours](value, theirs)
            elif ours in _FLAGS:
                right = isinstance(value, bool)
            elif ours in ("rank", "alpha"):
                right = type(value) is int
            elif ours == "dropout":
                right, value = isinstance(value, int | float) and not isinstance(value, bool), float(value)
            else:
                right = isinstance(value, str) and bool(value.strip())
                value = value.upper() if right and ours in _UPPER else value.lower() if right and ours in _LOWER else value
            if ours not in training.SHAPE and not right:
                raise ValueError(f"{theirs} is of the wrong kind")
        except (TypeError, ValueError) as error:
            raise bad(str(error)) from error
        shape[ours] = value
    return {"model_id": base.strip(), "revision": (revision or "").strip() or None, "adapter": shape}


def _json(path: Path, kind: str) -> Mapping[str, Any]:
    try:
        value = json.loads(path.read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise AdapterError("missing" if kind == "manifest" else kind, f"{path} isn't there") from None
    except (OSError, ValueError) as error:
        raise AdapterError(kind, f"{path} can't be read") from error
    if not isinstance(value, Mapping):
        raise AdapterError(kind, f"{path} must hold an object")
    return value


def _agree(pairs: Mapping[str, tuple[Any, Any]], kind: str, what: str) -> None:
    wrong = [f"{name}: {a!r} is not {b!r}" for name, (a, b) in pairs.items() if a != b]
    if wrong:
        raise AdapterError(kind, f"{what}: " + "; ".join(wrong))


def verify(path: str | Path, run: Run, mode: str | None = None, allow_unverified: bool = False) -> Verification:
    """Compare an adapter's files and manifest with what the run expects; a contradiction is always an error.

    In this order: the library's configuration, the manifest's schema, model, mode, prompt, digests, template arguments,
    controls and their digest, agreement with the configuration, evaluation set, and the files themselves. Only a
    manifest that is missing or of the older version may be let through, as unverified.
    """
    folder = Path(path)
    if not folder.is_dir():
        raise AdapterError("config", f"{path} must be a folder")
    config = _json(folder / LIBRARY_FILE, "config")
    said = library_view(config, complete=False)
    expected = {"model_id": (said["model_id"], run.model_id)} | ({"revision": (said["revision"], run.revision)} if said["revision"] else {})
    _agree(expected, "mismatch", f"{LIBRARY_FILE} names another model")
    files = artifact_digest(folder, skip=(run.manifest,))
    try:
        manifest = _json(folder / run.manifest, "manifest")
    except AdapterError as error:
        if error.kind != "missing" or not allow_unverified:
            raise
        unchecked = ("adaptation_mode", "training_prompt", "held_out_evaluation_sha256", "source_partitions", "training_controls")
        return Verification(str(folder), False, "legacy_manifest_unavailable", "manifest_missing", files, unchecked_fields=unchecked, warnings=(f"{folder.name} has no manifest",))
    version = manifest.get("schema_version")
    if version not in (VERSION, LEGACY):
        raise AdapterError("manifest", f"unknown version of the manifest: {version!r}")
    try:
        schemas.require(manifest, schemas.ADAPTER if version == VERSION else schemas.ADAPTER_LEGACY)
    except ValueError as error:
        raise AdapterError("manifest", str(error)) from error
    model, prompt = manifest["model"], manifest["training_prompt"]
    _agree({"model_id": (model["model_id"], run.model_id), "revision": (model["revision"], run.revision)}, "mismatch", "the manifest names another model")
    _agree({"adaptation_mode": (manifest["adaptation_mode"], mode or manifest["adaptation_mode"])}, "mismatch", "another adaptation")
    _agree({k: (prompt[k], run.prompt.get(k)) for k in ("name", "version", "template_sha256")}, "mismatch", "another prompt")
    _agree({"chat_template_kwargs": (dict(manifest["chat_template_kwargs"]), dict(run.template_arguments))}, "mismatch", "other template arguments")
    if version == VERSION:
        found = manifest["training_controls"]
        try:
            training.check(found)
        except ValueError as error:
            raise AdapterError("manifest", str(error)) from error
        if training.digest(found) != manifest["training_control_sha256"]:
            raise AdapterError("integrity", "the digest of the controls isn't theirs")
        view = library_view(config)["adapter"]
        _agree({n: (found["adapter"][n], view[n]) for n in training.LIBRARY_NAMES}, "config", f"the manifest contradicts {LIBRARY_FILE}")
    if run.eval_sha256 is not None:
        _agree({"held_out_evaluation_sha256": (manifest["held_out_evaluation_sha256"], run.eval_sha256)}, "mismatch", "checked against another evaluation set")
    if manifest["adapter_artifact_sha256"] != files:
        raise AdapterError("integrity", f"{folder}: the files aren't those of the manifest")
    common = {"artifact_sha256": files, "adaptation_mode": manifest["adaptation_mode"], "manifest_schema_version": version, "manifest_schema_name": manifest.get("schema_name")}
    if version == LEGACY:
        if not allow_unverified:
            raise AdapterError("manifest", "a manifest of version 2 says nothing of sources and controls")
        unchecked = ("training_source_fingerprint", "validation_source_fingerprint", "training_controls")
        return Verification(str(folder), False, "unverified_legacy_provenance", "legacy_training_controls_unavailable", unchecked_fields=unchecked, warnings=(f"{folder.name} has a manifest of version 2",), **common)
    kept = ("training_source_fingerprint", "validation_source_fingerprint", "training_control_sha256", "training_controls")
    return Verification(str(folder), True, **common, **{k: manifest[k] for k in kept})


@dataclass(frozen=True)
class Gate:
    """What the adapters of a run allow: their verifications, whether the controls match (null if unknown), and in what not."""

    verifications: Mapping[str, Verification]
    controls_matched: bool | None = None
    mismatches: tuple[str, ...] = ()

    @property
    def unverified(self) -> bool:
        return any(not v.verified for v in self.verifications.values())

    @property
    def warnings(self) -> list[str]:
        said = [f"{recipe}: {w}" for recipe, v in self.verifications.items() for w in v.warnings]
        return said + ([f"Confounded comparison: {', '.join(self.mismatches)}"] if self.controls_matched is False else [])


def gate(adapters: Mapping[str, str], run: Run, allow_unverified: bool = False, allow_unmatched: bool = False) -> Gate:
    """Verify the adapters of the recipes; two must differ, come from the same questions, and be trained alike.

    Unequal controls may be allowed, and then confound the comparison of the two.
    """
    paths = [Path(p).resolve() for p in adapters.values()]
    if len(set(paths)) < len(paths):
        raise AdapterError("mismatch", "two recipes have one adapter")
    found = {recipe: verify(path, run, MODES[recipe], allow_unverified) for recipe, path in adapters.items()}
    digests = [v.artifact_sha256 for v in found.values()]
    if len(set(digests)) < len(digests):
        raise AdapterError("mismatch", "two recipes have adapters of the same contents")
    both = list(found.values())
    if len(both) < 2 or not all(v.verified for v in both):
        return Gate(found)
    one, other = both
    _agree({k: (getattr(one, k), getattr(other, k)) for k in ("training_source_fingerprint", "validation_source_fingerprint")}, "mismatch", "trained on different questions")
    unequal = training.unequal(one.training_controls, other.training_controls)
    if unequal and not allow_unmatched:
        raise AdapterError("mismatch", f"the training controls differ: {unequal[:10]}")
    return Gate(found, not unequal, tuple(unequal))
