"""Training controls: the settings that can change what an adapter learns, in one form that two runs can be compared by."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from quern.sources.config import differences, settings_digest

#: Every control taken over as it is: its place, the setting that it comes from, its kind and its default. Fixed values.
SETTINGS = """
adapter.rank lora_r int 16
adapter.alpha lora_alpha int 32
adapter.dropout lora_dropout float 0.05
adapter.bias lora_bias str none
adapter.use_rslora use_rslora bool false
adapter.use_dora use_dora bool false
optimization.learning_rate learning_rate float 2e-4
optimization.optimizer optim str adamw_torch
optimization.optimizer_args optim_args str -
optimization.adam_beta1 adam_beta1 float 0.9
optimization.adam_beta2 adam_beta2 float 0.999
optimization.adam_epsilon adam_epsilon float 1e-8
optimization.scheduler lr_scheduler_type str linear
optimization.scheduler_kwargs lr_scheduler_kwargs dict -
optimization.weight_decay weight_decay float 0
optimization.max_grad_norm max_grad_norm float 1
optimization.num_train_epochs num_train_epochs float 2
optimization.max_steps max_steps int -1
batching.per_device_train_batch_size per_device_train_batch_size int 1
batching.per_device_eval_batch_size per_device_eval_batch_size int 1
batching.gradient_accumulation_steps gradient_accumulation_steps int 16
sequence.max_length max_seq_length int 2048
warmup.ratio warmup_ratio float 0.03
warmup.steps warmup_steps int 0
gradient_checkpointing.enabled gradient_checkpointing bool true
gradient_checkpointing.kwargs gradient_checkpointing_kwargs dict -
precision.bf16 bf16 bool true
precision.fp16 fp16 bool false
precision.tf32 tf32 bool false
quantization.load_in_4bit load_in_4bit bool true
seeds.training seed int 42
loss.label_smoothing_factor label_smoothing_factor float 0
checkpoint_selection.save_total_limit save_total_limit int 2
"""
#: Controls that only count with four-bit weights, and those that only count with validation rows; in the same form.
FOUR_BIT = """
quantization.type bnb_4bit_quant_type str nf4
quantization.double_quantization bnb_4bit_use_double_quant bool true
quantization.compute_dtype bnb_4bit_compute_dtype str bfloat16
"""
VALIDATED = """
checkpoint_selection.evaluation_strategy eval_strategy str steps
checkpoint_selection.evaluation_steps eval_steps int 50
checkpoint_selection.metric_for_best_model metric_for_best_model str eval_loss
checkpoint_selection.early_stopping_patience early_stopping_patience int 0
checkpoint_selection.early_stopping_threshold early_stopping_threshold float 0
"""
DTYPES = ("bfloat16", "float16", "float32")
_KINDS = {"int": int, "float": float, "str": str, "bool": lambda v: v if isinstance(v, bool) else str(v) == "true", "dict": lambda v: {} if v == "-" else dict(v)}


def names(value: Any, field: str, alone: bool = True) -> str | list[str] | None:
    """A name, or names sorted and without repeats; null stays. Blank names, and none at all, are refused."""
    if value is None or (alone and isinstance(value, str) and value.strip()):
        return value.strip() if isinstance(value, str) else None
    if isinstance(value, (list, tuple, set)) and value and all(isinstance(v, str) and v.strip() for v in value):
        return sorted({v.strip() for v in value})
    raise ValueError(f"{field} must be {'a name or ' if alone else ''}a list of names")


def pattern(value: Any, field: str) -> dict[str, int]:
    """Positive whole numbers by name, sorted; null is none."""
    value = value or {}
    if not isinstance(value, Mapping) or not all(isinstance(k, str) and k and type(v) is int and v >= 1 for k, v in value.items()):
        raise ValueError(f"{field} must map names to positive numbers")
    return dict(sorted(value.items()))


def layers(value: Any, field: str) -> int | list[int] | None:
    """A layer, or layers sorted and without repeats; null is all."""
    whole = lambda v: type(v) is int and v >= 0
    if value is None or whole(value):
        return value
    if isinstance(value, (list, tuple, set)) and all(map(whole, value)):
        return sorted(set(value))
    raise ValueError(f"{field} must be a number or a list of numbers from 0")


#: What an adapter's shape has besides numbers and flags: its field and how it is put in one form.
SHAPE = {
    "target_modules": names,
    "modules_to_save": lambda v, f: names(v, f, alone=False),
    "rank_pattern": pattern,
    "alpha_pattern": pattern,
    "layers_to_transform": layers,
    "layers_pattern": names,
}


def _take(rows: str, settings: Mapping[str, Any] | None) -> dict[str, dict[str, Any]]:
    """The controls of a table by section; all null if there are no settings to take them from."""
    out: dict[str, dict[str, Any]] = {}
    for place, source, kind, default in (row.split() for row in rows.strip().splitlines()):
        section, name = place.split(".")
        value = None
        if settings is not None:
            value = _KINDS[kind](settings.get(source, "" if (kind, default) == ("str", "-") else default))
        out.setdefault(section, {})[name] = value
    return out


def controls(settings: Mapping[str, Any], validated: bool) -> dict[str, Any]:
    """The controls of a training configuration, with its defaults made explicit.

    Paths, names, tracking, the kind of adaptation and the form of the data aren't controls, so that two adaptations can
    be compared as treatments. ``validated`` says whether there are validation rows: without them nothing is evaluated
    and no checkpoint is chosen.
    """
    out = _take(SETTINGS, settings)
    four_bit = out["quantization"]["load_in_4bit"]
    for part in (_take(FOUR_BIT, settings if four_bit else None), _take(VALIDATED, settings if validated else None)):
        for section, values in part.items():
            out.setdefault(section, {}).update(values)
    method = "qlora" if four_bit else "lora"
    if str(settings.get("method", method)).casefold() != method:
        raise ValueError(f"the method {settings['method']!r} contradicts load_in_4bit")
    if str(settings.get("bnb_4bit_compute_dtype", DTYPES[0])) not in DTYPES:
        raise ValueError(f"bnb_4bit_compute_dtype must be one of {DTYPES}")
    shape = {"target_modules": "all-linear"} | {f: settings[f] for f in SHAPE if f in settings}
    out["adaptation_method"] = method
    out["adapter"] |= {"peft_type": "LORA", "task_type": "CAUSAL_LM"} | {f: form(shape.get(f), f) for f, form in SHAPE.items()}
    batch = out["batching"]["per_device_train_batch_size"] * out["batching"]["gradient_accumulation_steps"]
    out["batching"] |= {"effective_batch_size_per_device": batch, "effective_batch_size": batch}
    out["seeds"]["data"] = int(settings.get("data_seed", out["seeds"]["training"]))
    out["loss"]["completion_only"] = True
    chosen = out["checkpoint_selection"]
    metric = chosen["metric_for_best_model"]
    greater = bool(settings.get("greater_is_better", not str(metric).endswith("loss"))) if validated else None
    if not validated:
        chosen |= {"evaluation_strategy": "no", "early_stopping_patience": 0, "early_stopping_threshold": 0.0}
    chosen |= {
        "validation_enabled": validated,
        "save_strategy": chosen["evaluation_strategy"] if validated else "steps",
        "save_steps": int(settings.get("save_steps", chosen["evaluation_steps"] or 50)),
        "load_best_model_at_end": validated,
        "early_stopping_metric": metric,
        "greater_is_better": greater,
        "best_model_selection_policy": {"load_best_model_at_end": validated, "metric": metric, "greater_is_better": greater},
    }
    check(out)
    return out


_WHOLE = re.compile(r"^(?:adapter\.(?:rank|alpha)|batching\..*|sequence\.max_length|checkpoint_selection\.save_(?:steps|total_limit))$")


def check(found: Mapping[str, Any]) -> None:
    """Refuse controls that lack something, have something else, or contradict themselves."""
    wanted: dict[str, set[str]] = {}
    for place in re.findall(r"^(\S+) ", SETTINGS + FOUR_BIT + VALIDATED, re.M):
        section, name = place.split(".")
        wanted.setdefault(section, set()).add(name)
    wanted["adapter"] |= {"peft_type", "task_type", *SHAPE}
    wanted["batching"] |= {"effective_batch_size_per_device", "effective_batch_size"}
    wanted["seeds"].add("data")
    wanted["loss"].add("completion_only")
    wanted["checkpoint_selection"] |= {"validation_enabled", "save_strategy", "save_steps", "load_best_model_at_end", "early_stopping_metric", "greater_is_better", "best_model_selection_policy"}
    wrong = sorted(set(found) ^ {*wanted, "adaptation_method"})
    wrong += [f"{s}.{n}" for s, fields in wanted.items() if isinstance(found.get(s), Mapping) for n in sorted(fields ^ set(found[s]))]
    if wrong:
        raise ValueError(f"controls that are missing or unknown: {wrong}")
    small = [f"{s}.{n}" for s in wanted for n, v in found[s].items() if _WHOLE.match(f"{s}.{n}") and (type(v) is not int or v < 1)]
    if small:
        raise ValueError(f"controls that must be positive whole numbers: {small}")
    batching = found["batching"]
    product = batching["per_device_train_batch_size"] * batching["gradient_accumulation_steps"]
    if {batching["effective_batch_size"], batching["effective_batch_size_per_device"]} != {product}:
        raise ValueError("the effective batch size must be the batch size times the accumulation")
    if found["adaptation_method"] != ("qlora" if found["quantization"]["load_in_4bit"] else "lora"):
        raise ValueError("the method contradicts load_in_4bit")


def unequal(one: Mapping[str, Any], other: Mapping[str, Any]) -> list[str]:
    """The dotted names of the controls that differ."""
    return differences(one, other)


digest = settings_digest

#: The names that an adapter's library gives to the controls of its shape. Fixed values.
LIBRARY_NAMES = {"peft_type": "peft_type", "task_type": "task_type", "rank": "r", "alpha": "lora_alpha", "dropout": "lora_dropout", "bias": "bias", "use_rslora": "use_rslora", "use_dora": "use_dora", **{f: f for f in SHAPE}}


def library_settings(found: Mapping[str, Any], model_id: str, revision: str | None) -> dict[str, Any]:
    """The adapter's shape under the library's names, as it is kept beside the weights."""
    return {"base_model_name_or_path": model_id, "revision": revision} | {theirs: found["adapter"][ours] for ours, theirs in LIBRARY_NAMES.items()}
