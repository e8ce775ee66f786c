"""Splitting generated token ids into reasoning and answer at a boundary token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "array<int>"


def token_id(tokenizer, token: str) -> int | None:
    """The id of a special token: from the vocabulary, else by conversion if that leads back, else as a one-token text."""
    known = getattr(tokenizer, "get_vocab", dict)().get(token)
    if known is not None:
        return known
    if hasattr(tokenizer, "convert_tokens_to_ids"):
        found = tokenizer.convert_tokens_to_ids(token)
        if isinstance(found, int) and found >= 0 and tokenizer.convert_ids_to_tokens(found) == token:
            return found
    ids = tokenizer.encode(token, add_special_tokens=False)
    return ids[0] if len(ids) == 1 else None


def trimmed(ids: Column, pad: int, eos: int | None) -> Column:
    """The ids without padding at the end; where padding is also the end of the text, one of them is kept."""
    kept = F.aggregate(F.reverse(ids), F.lit(0), lambda n, x: F.when((n >= 0) & (x == pad), n + 1).when(n >= 0, -(n + 1)).otherwise(n), lambda n: F.when(n >= 0, n).otherwise(-n - 1))
    extra = F.least(kept, F.lit(1)) if pad == eos else F.lit(0)
    return F.slice(ids, F.lit(1), F.size(ids) - kept + extra)


def split_thinking(ids: Column, pad: int, eos: int | None, opening: int, closing: int, enabled: bool = True) -> Column:
    """A struct (reasoning, answer, output, problem) of array<int> and, where the protocol is broken, what is wrong.

    With thinking there must be exactly one closing boundary, at most one opening one and that at the very beginning,
    and something behind the closing one; without it neither boundary may appear. A broken row has no parts. Null ids
    give an empty output and so a missing boundary.
    """
    output = trimmed(F.coalesce(ids, F.array().cast(NONE)), pad, eos)
    at = lambda token: F.filter(F.transform(output, lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())
    closes, opens, none = at(closing), at(opening), F.array().cast(NONE)
    if not enabled:
        problem = F.when((F.size(closes) > 0) | (F.size(opens) > 0), "boundary in a condition without thinking")
        return F.struct(none.alias("reasoning"), F.when(problem.isNull(), output).otherwise(none).alias("answer"), output.alias("output"), problem.alias("problem"))
    cut = F.get(closes, F.lit(0))
    first = F.when(F.size(opens) > 0, 1).otherwise(0)
    answer = F.slice(output, cut + 2, F.greatest(F.lit(0), F.size(output) - cut - 1))
    problem = (
        F.when(F.size(closes) == 0, "missing boundary")
        .when(F.size(closes) > 1, "several boundaries")
        .when((F.size(opens) > 1) | (F.coalesce(F.get(opens, F.lit(0)), F.lit(0)) > 0), "misplaced opening boundary")
        .when(F.size(answer) == 0, "empty answer")
    )
    reasoning = F.slice(output, first + 1, F.greatest(F.lit(0), cut - first))
    sound = problem.isNull()
    return F.struct(F.when(sound, reasoning).otherwise(none).alias("reasoning"), F.when(sound, answer).otherwise(none).alias("answer"), output.alias("output"), problem.alias("problem"))
