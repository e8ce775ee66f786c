"""The prompt that all recipes share, as columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prompt, version 4, word by word. Fixed values.
NAME, VERSION = "rag-user-prompt", "4"
INSTRUCTION = "Answer the question accurately and return only the concise answer. When documents are provided, use relevant evidence from them and ignore irrelevant documents."
NO_DOCUMENTS = "(no documents provided)"
RESPONSE = "\n\n### Response\n"


def context_block(contexts: Column) -> Column:
    numbered = F.transform(contexts, lambda t, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), t))
    return F.when(F.size(contexts) > 0, F.array_join(numbered, "\n\n")).otherwise(NO_DOCUMENTS)


def prompt(question: Column, contexts: Column) -> Column:
    head = F.lit(f"### Instruction\n{INSTRUCTION}\n\n### Question\n")
    return F.concat(head, question, F.lit("\n\n### Documents\n"), context_block(contexts))


def training_text(question: Column, contexts: Column, answer: Column) -> Column:
    return F.concat(prompt(question, contexts), F.lit(RESPONSE), answer)


def prompt_text(question: str, contexts: list[str]) -> str:
    """The same prompt for one question, on the driver or in a generator."""
    block = "\n\n".join(f"[Document {i}]\n{t}" for i, t in enumerate(contexts, 1)) or NO_DOCUMENTS
    return f"### Instruction\n{INSTRUCTION}\n\n### Question\n{question}\n\n### Documents\n{block}"


def identity() -> dict[str, str]:
    """Name, version and a digest over the prompt with none, one and two documents."""
    forms = [prompt_text("__QUESTION__", [f"__DOCUMENT_{i + 1}__" for i in range(n)]) for n in range(3)]
    text = json.dumps(forms, ensure_ascii=False, separators=(",", ":"))
    return {"name": NAME, "version": VERSION, "template_sha256": hashlib.sha256(text.encode()).hexdigest()}
