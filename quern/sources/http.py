"""Chat-completion servers as generators and judges, over the standard library."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from typing import Any

from quern.functions.prompts import prompt_text
from quern.operators.scoring import FIELDS, JUDGE_SYSTEM, Judge

BEGIN, END = "BEGIN UNTRUSTED DATA", "END UNTRUSTED DATA"


def complete(base_url: str, body: dict[str, Any], key: str = "", timeout: float = 30.0, max_bytes: int = 1 << 20) -> str:
    """The content of a streamed completion; one longer than max_bytes is refused."""
    request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body | {"stream": True, "temperature": 0}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    parts, size = [], 0
    with urllib.request.urlopen(request, timeout=timeout) as response:
        for line in response:
            text = line.decode("utf-8").strip()
            if not text.startswith("data:") or text == "data: [DONE]":
                continue
            choices = json.loads(text[5:]).get("choices") or [{}]
            part = choices[0].get("delta", {}).get("content") or ""
            size += len(part.encode())
            if size > max_bytes:
                raise ValueError("response too large")
            parts.append(part)
    return "".join(parts)


def generator(base_url: str, model: str, key_env: str = "", max_tokens: int = 64) -> Callable[[], Callable[[str, list[str]], str]]:
    """A maker of generators that send the shared prompt as one message."""

    def make() -> Callable[[str, list[str]], str]:
        key = os.environ.get(key_env, "") if key_env else ""
        return lambda question, contexts: complete(base_url, {"model": model, "max_completion_tokens": max_tokens, "messages": [{"role": "user", "content": prompt_text(question, contexts)}]}, key).strip()

    return make


def judge_prompt(question: str, answer: str, references: list[str], contexts: list[str]) -> str:
    """What a judge is asked, with the material fenced off."""
    material = json.dumps({"question": question, "answer": answer, "references": references, "contexts": contexts}, ensure_ascii=False)
    return f"Give numbers from 0 to 1 for {', '.join(FIELDS)}.\n{BEGIN}\n{material}\n{END}"


def parse_object(text: str) -> dict[str, Any]:
    """The JSON object in a reply: all of it, else from the first to the last brace."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        value = json.loads(text[text.find("{") : text.rfind("}") + 1])
    if not isinstance(value, dict):
        raise ValueError("the reply is no JSON object")
    return value


def judge(base_url: str, model: str, key_env: str = "", timeout: float = 30.0, max_bytes: int = 32_768, max_tokens: int = 256, longest: int = 1000, structured: bool = True) -> Callable[[str], dict]:
    """A call for scoring.judge: asks for the fields and a rationale, as a strict schema if the server knows those."""
    number = {"type": "number", "minimum": 0, "maximum": 1}
    wanted = {f: number for f in FIELDS} | {"rationale": {"type": "string", "maxLength": longest}}
    schema = {"type": "object", "additionalProperties": False, "required": list(wanted), "properties": wanted}

    def call(prompt: str) -> dict:
        body: dict[str, Any] = {"model": model, "max_completion_tokens": max_tokens, "messages": [{"role": "system", "content": JUDGE_SYSTEM}, {"role": "user", "content": prompt}]}
        if structured:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "scores", "strict": True, "schema": schema}}
        return parse_object(complete(base_url, body, os.environ.get(key_env, "") if key_env else "", timeout, max_bytes))

    return call


def judge_from(settings: dict[str, Any] | None) -> Judge | None:
    """The judge of checked settings, or none."""
    if not settings:
        return None
    if settings["kind"] != "openai-compatible":
        raise ValueError("a configuration can only name an openai-compatible judge")
    call = judge(settings["base_url"], settings["model"], settings.get("api_key_env", ""), settings["read_timeout_seconds"], settings["max_response_bytes"], settings["max_completion_tokens"], settings["max_rationale_characters"], settings["structured_output"])
    backend = json.dumps({k: settings.get(k) for k in ("kind", "base_url", "model", "model_revision")}, sort_keys=True)
    return Judge(call, backend, judge_prompt, settings.get("cache_path") if settings["cache"] else None, settings["strict"], settings["max_retries"], settings["retry_backoff_seconds"], settings["minimum_metric_coverage"], settings["minimum_paired_examples"], settings["max_rationale_characters"])
