"""Rows to tune a model on: prompts and completions, plain or as chats, and matched rows of the same sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import prompts
from quern.operators.records import BLANKS, question_of, raft_problems

#: What matched rows are told to do, word by word. Fixed value.
INSTRUCTION = "Answer the question accurately and return only the concise answer."
SHOWN = 10
CHAT = "array<struct<role:string,content:string>>"


def completions(rows: DataFrame, mode: str, chat: bool) -> DataFrame:
    """(id, prompt, completion) of tuning rows, so that prompts can be left out of the loss.

    mode sft: the question (question or input) without documents, and output or answer. mode raft: the question with all
    contexts, whose relevance the prompt doesn't tell, and answer. Plain prompts end with the mark of a response; chats
    are one user message and one assistant message. Rows with contexts must be sound in either mode, and no completion
    may be blank: the first SHOWN ids that break this are named in an error. Other columns are ignored.
    """
    if mode not in ("sft", "raft"):
        raise ValueError(f"unknown mode: {mode}")
    answer = F.coalesce(*(F.col(c) for c in ("output", "answer") if c in rows.columns), F.lit(""))
    empty = F.array().cast("array<string>")
    contexts = F.transform("contexts", lambda c: c["text"]) if mode == "raft" else empty
    wrong = [F.when(F.trim(answer, F.lit(BLANKS)) == "", F.lit("empty completion"))]
    checks = F.array_compact(F.array(*wrong))
    if "contexts" in rows.columns:
        checks = F.concat(checks, raft_problems(F.col("contexts"), F.coalesce("evidence_doc_ids", empty)))
    elif mode == "raft":
        raise ValueError("raft rows need contexts")
    bad = rows.select("id", checks.alias("p")).where(F.size("p") > 0).orderBy("id").limit(SHOWN).collect()
    if bad:
        raise ValueError("unusable rows: " + "; ".join(f"{r['id']!r}: {', '.join(r['p'])}" for r in bad))
    user = prompts.prompt(question_of(rows), contexts)
    if not chat:
        return rows.select("id", F.concat(user, F.lit(prompts.RESPONSE)).alias("prompt"), answer.alias("completion"))
    message = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    return rows.select("id", message("user", user).alias("prompt"), message("assistant", answer).alias("completion"))


class Renderer(Protocol):
    """A tokenizer's chat template: messages to a text that ends where the answer begins; eos ends an answer."""

    eos: str

    def __call__(self, messages: list[dict[str, str]], **arguments: Any) -> str: ...


def render_chats(chats: DataFrame, make: Callable[[], Renderer], arguments: Mapping[str, Any] | None = None) -> DataFrame:
    """(id, prompt, completion) as texts: chats through a template that is made once in every Python worker.

    A completion must be exactly one message that isn't blank; the end of an answer is added to it.
    """
    broken = chats.where((F.size("completion") != 1) | (F.trim(F.get("completion", F.lit(0))["content"], F.lit(BLANKS)) == "")).select("id").orderBy("id").limit(SHOWN).collect()
    if broken:
        raise ValueError(f"chats without exactly one answer: {[r['id'] for r in broken]}")
    given = dict(arguments or {})

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = make()
        for batch in batches:
            said = [template(messages, **given) for messages in batch.column("prompt").to_pylist()]
            answers = [messages[0]["content"] + (template.eos or "") for messages in batch.column("completion").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(said, pa.string()), pa.array(answers, pa.string())], ["id", "prompt", "completion"])

    return chats.select("id", "prompt", "completion").mapInArrow(render, "id string, prompt string, completion string")


def require_chat_template(settings: Mapping[str, Any]) -> None:
    """Training that is to be verified later must go through the chat template."""
    if settings.get("use_chat_template") is not True:
        raise ValueError("use_chat_template must be true")


def matched(ids: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, instruction, input, output, metadata): the questions of a mined partition as tuning rows, so both forms share their sources."""
    rows = questions.join(ids.select("id").distinct(), "id", "left_semi")
    metadata = F.col("metadata") if "metadata" in questions.columns else F.lit(None).cast("string")
    return rows.select("id", F.lit(INSTRUCTION).alias("instruction"), F.col("question").alias("input"), F.col("reference_answer").alias("output"), metadata.alias("metadata"))
