"""Text functions as columns. Word characters are letters, numbers and the underscore, in Spark and in the SQL checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"
OTHERS = r"[^\p{L}\p{N}_]+"
#: What counts as white space, as code points so that all regex engines agree. Fixed values.
SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tokens(text: Column, lowercase: bool = True) -> Column:
    """The words of a text, in order; none for an empty text, null for null."""
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(f"({WORDS})"), F.lit(1))


def normalize(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks, trimmed: what answers are compared by."""
    return F.trim(F.regexp_replace(F.lower(text), OTHERS, " "))


#: What folding changes in a lower-cased text, by rule: every character whose folded form isn't its lower-case form.
FOLDED = {chr(c): chr(c).casefold() for c in range(0x110000) if chr(c).lower() == chr(c) != chr(c).casefold()}
_SINGLE = {c: f for c, f in FOLDED.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in FOLDED.items() if len(f) > 1}


def folded(text: Column) -> Column:
    """The text with its case folded, as comparing without case needs it; texts without special characters take the short way."""
    low = F.lower(text)
    single = F.translate(low, "".join(_SINGLE), "".join(_SINGLE.values()))
    full = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(_SEVERAL[c])), _SEVERAL, single)
    return F.when(low.rlike(f"[{''.join(FOLDED)}]"), full).otherwise(low)


def question_key(question: Column) -> Column:
    """Folded case and single blanks, punctuation kept: what questions are compared by."""
    return F.trim(F.regexp_replace(folded(question), SPACES, " "))


def words_of(normalized: Column) -> Column:
    """The words of a normalized text; an empty one has none."""
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize(prediction) == normalize(reference)).cast("double")


def token_f1(prediction: Column, reference: Column) -> Column:
    """Harmonic mean of the shares of shared words, counted with repeats; 1 if both have none, 0 if only one has."""
    p, r = words_of(normalize(prediction)), words_of(normalize(reference))
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(count(p, w), count(r, w)))
    either_empty = (F.size(p) == 0) | (F.size(r) == 0)
    f1 = F.when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(p) + F.size(r)))
    return F.when(either_empty, (F.size(p) == F.size(r)).cast("double")).otherwise(f1)


def references(listed: Column, single: Column) -> Column:
    """The reference answers: the listed ones, trimmed, non-blank and distinct, else the single one unless it is empty."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    one = F.when(F.coalesce(single, F.lit("")) != "", F.array(single)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(clean) > 0, clean).otherwise(one)


def best_over(refs: Column, score) -> Column:
    """The largest score over the references; null if there are none."""
    return F.array_max(F.transform(refs, score))


def contains_answer(prediction: Column, refs: Column) -> Column:
    """1 if a normalized reference that isn't empty stands in the normalized prediction, else 0."""
    p = normalize(prediction)
    return F.exists(F.transform(refs, normalize), lambda r: (r != "") & F.contains(p, r)).cast("double")


def content_id(prefix: str, text: Column) -> Column:
    """A document id derived from the text."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 16))


def keyed_seed(*parts: Column | str) -> Column:
    """The first 64 bits of the SHA-256 of the parts joined by colons, as a decimal."""
    joined = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def lenient_json(text: Column) -> Column:
    """The JSON object in a text, as text: all of it, else from the first to the last brace; null if neither is one."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    is_object = lambda x: F.json_object_keys(x).isNotNull()
    return F.when(is_object(text), text).when(is_object(inner), inner)


SQL_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
SQL_NORMAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')"
_SQL_FOLDED = reduce(lambda x, c: f"replace({x}, '{c}', '{_SEVERAL[c]}')", _SEVERAL, f"translate(lower({{0}}), '{''.join(_SINGLE)}', '{''.join(_SINGLE.values())}')")
SQL_KEY = f"trim(regexp_replace(CASE WHEN regexp_matches(lower({{0}}), '[{''.join(FOLDED)}]') THEN {_SQL_FOLDED} ELSE lower({{0}}) END, '" + SPACES.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'), ' ')"
