"""JSON Lines as frames: typed, validated reading and validating writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.records import BLANKS, merged_evidence, raft_problems

SHOWN = 10

#: The record types: fields, whether a field must be there, and the default of those that needn't.
SCHEMAS = {
    "documents": "id string, text string, metadata string",
    "eval": "id string, question string, reference_answer string, relevant_doc_ids array<string>, evidence array<struct<doc_id:string,text:string>>, metadata string",
    "sft": "id string, instruction string, input string, output string, metadata string",
    "raft": "id string, question string, answer string, contexts array<struct<doc_id:string,text:string,relevant:boolean>>, evidence_doc_ids array<string>, metadata string",
}
DEFAULTS = {"sft": {"instruction": "Answer accurately.", "input": ""}}
REQUIRED = {"documents": ("text",), "eval": ("question",), "sft": ("output",), "raft": ("question", "answer")}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of the files, with the block of the file they begin in and their order there."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def line_numbers(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen with ``line``, the physical line number in its file; blocks are counted, not files gathered."""
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", "first", before.alias("before"))
    return chosen.join(starts, ["file", "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).drop("first", "before")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The objects of a JSON Lines file or folder as rows of the schema, with ``pos`` for their order.

    Blank lines are skipped. A line that isn't a JSON object raises an error that names the first such physical lines.
    Fields outside the schema are dropped; a field given as string in the schema keeps nested JSON as text.
    """
    lines = read_lines(spark, path)
    kept = lines.where(F.trim("value", F.lit(BLANKS)) != "")
    bad = kept.where(F.expr("try_parse_json(value)").isNull() | F.json_object_keys("value").isNull())
    broken = line_numbers(lines, bad.limit(SHOWN)).orderBy("file", "line").select("file", "line").collect()
    if broken:
        raise ValueError("not a JSON object: " + ", ".join(f"{r['file']}:{r['line']}" for r in broken))
    return kept.select(F.col("at").alias("pos"), F.from_json("value", schema).alias("r"), "value").select("pos", "r.*", "value").drop("value")


def unknown_fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(field, n) of the fields that records of this kind may not have."""
    known = T.StructType.fromDDL(SCHEMAS[kind]).names
    keys = read_lines(spark, path).where(F.trim("value", F.lit(BLANKS)) != "").select(F.explode(F.json_object_keys("value")).alias("field"))
    return keys.where(~F.col("field").isin(known)).groupBy("field").agg(F.count("*").alias("n"))


def problems(rows: DataFrame, kind: str) -> DataFrame:
    """(id, pos, problem) of the rows that break the rules of their kind."""
    blank = lambda c: F.coalesce(F.trim(c, F.lit(BLANKS)), F.lit("")) == ""
    found = [F.when(blank("id"), "blank id")] + [F.when(F.coalesce(F.col(c), F.lit("")) == "" if kind != "documents" else blank(c), f"missing {c}") for c in REQUIRED[kind]]
    listed = F.array_compact(F.array(*found))
    if kind == "raft":
        empty = F.array().cast("array<struct<doc_id:string,text:string,relevant:boolean>>")
        listed = F.concat(listed, raft_problems(F.coalesce("contexts", empty), F.coalesce("evidence_doc_ids", F.array().cast("array<string>"))))
    return rows.select("id", "pos", F.explode(listed).alias("problem"))


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Validated records of a kind: documents, eval (also for labelled training questions), sft or raft.

    Unknown fields, broken rules and repeated ids raise an error that shows the first SHOWN of them, in order. Ids are
    trimmed, defaults filled in, and the evidence's documents added to the relevant ones.
    """
    extra = unknown_fields(spark, path, kind).orderBy("field").limit(SHOWN).collect()
    if extra:
        raise ValueError(f"unknown fields in {path}: {[r['field'] for r in extra]}")
    rows = read_jsonl(spark, path, SCHEMAS[kind]).withColumn("id", F.trim("id", F.lit(BLANKS)))
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.get(kind, {}).items()})
    bad = problems(rows, kind).orderBy("pos").limit(SHOWN).collect()
    if bad:
        raise ValueError(f"invalid records in {path}: " + "; ".join(f"{r['id']!r}: {r['problem']}" for r in bad))
    twice = rows.groupBy("id").count().where("count > 1").orderBy("id").limit(SHOWN).collect()
    if twice:
        raise ValueError(f"duplicate ids in {path}: {[r['id'] for r in twice]}")
    if kind == "eval":
        rows = rows.withColumn("relevant_doc_ids", merged_evidence(F.col("relevant_doc_ids"), F.col("evidence")))
    return rows


def write_jsonl(rows: DataFrame, path: str, order: str | None = None, files: int | None = None) -> None:
    """Rows as JSON Lines, null fields included; in the order of a column if one is named, in that many files."""
    out = rows.orderBy(order) if order else rows
    out = out.drop(order) if order == "pos" else out
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_raft(rows: DataFrame, path: str) -> None:
    """Training examples, all validated before anything is written."""
    bad = problems(rows if "pos" in rows.columns else rows.withColumn("pos", F.lit(0)), "raft").orderBy("id").limit(SHOWN).collect()
    if bad:
        raise ValueError("invalid examples: " + "; ".join(f"{r['id']!r}: {r['problem']}" for r in bad))
    write_jsonl(rows, path)


def distinct_outputs(*paths: str | None) -> None:
    """Outputs must be different places."""
    from pathlib import Path

    given = [Path(p).resolve() for p in paths if p]
    if len(given) != len(set(given)):
        raise ValueError("output paths must be distinct")


def check_destination(output: str, plan: str | None = None) -> None:
    """An output folder must not be a file, a plan's file not a folder, and the two must differ."""
    from pathlib import Path

    if Path(output).is_file():
        raise ValueError(f"the output folder {output} is a file")
    if plan and Path(plan).is_dir():
        raise ValueError(f"the plan's file {plan} is a folder")
    distinct_outputs(output, plan)
