"""Running recipes over one corpus and one evaluation set, and reporting them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import prompts, text
from quern.operators import measures, ranking, scoring
from quern.operators.records import clean_ids, missing_references, repeated_ids
from quern.runtime import Stash, write_text
from quern.sources import adapters, schemas
from quern.sources.jsonl import check_destination
from quern.sources.tracking import NoTracker, Tracker

#: The recipes, and whether they see retrieved documents.
RECIPES = {"base": False, "rag": True, "sft-rag": True, "raft-rag": True}
NAMES = {"base": "Base", "rag": "RAG", "sft-rag": "SFT + RAG", "raft-rag": "RAFT + RAG"}
CANONICAL = ("exact_match", "token_f1")
OPTIONAL = ("reference_overlap", "lexical_groundedness", "lexical_unsupported_claim_rate", "citation_precision", "citation_recall")

#: What a generator may say of an answer besides its text. Fixed values.
SAID = {
    "raw_text": "string", "reasoning": "string", "prompt_tokens": "bigint", "output_tokens": "bigint", "reasoning_tokens": "bigint", "answer_tokens": "bigint",
    "thinking_boundary_token_id": "int", "thinking_boundary_found": "boolean", "thinking_protocol_violation": "string",
    "prompt_build_latency_s": "double", "chat_template_latency_s": "double", "tokenization_latency_s": "double", "device_transfer_latency_s": "double", "model_generate_latency_s": "double", "decode_latency_s": "double", "inference_e2e_latency_s": "double",
    "batch_size": "int", "generation_mode": "string",
}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_INSIDE = ("prompt_build_latency_s", "chat_template_latency_s", "tokenization_latency_s", "device_transfer_latency_s", "model_generate_latency_s", "decode_latency_s")


class Generator(Protocol):
    """Answers a question; made once in every Python worker. An answer is a text, or a mapping of text and what SAID names."""

    def __call__(self, question: str, contexts: list[str]) -> str | Mapping[str, Any]: ...


@dataclass(frozen=True)
class Job:
    recipe: str
    use_retrieval: bool
    adapter: str | None = None


def plan(recipes: list[str], given: Mapping[str, str | None] | None = None) -> list[Job]:
    unknown = sorted(set(recipes) - set(RECIPES))
    if not recipes or unknown or len(recipes) != len(set(recipes)):
        raise ValueError(f"recipes must be known and given once; unknown: {unknown}")
    return [Job(r, RECIPES[r], (given or {}).get(r)) for r in recipes]


@dataclass(frozen=True)
class Contract:
    """What all recipes of a run share, and what it allows. ``model``: config.model_settings; without it no adapters are checked."""

    model: Mapping[str, Any] | None = None
    top_k: int = 5
    samples: int = 10_000
    seed: int = 42
    warmup: int = 1
    allow_unverified: bool = False
    allow_unmatched: bool = False
    manifest: str = adapters.MANIFEST
    eval_sha256: str | None = None
    inputs: Mapping[str, Any] = field(default_factory=dict)

    def check(self, jobs: list[Job]) -> adapters.Gate:
        """Refuse impossible settings, verify the adapters, and say what they allow."""
        if self.top_k < 1 or self.samples < 1 or self.warmup < 0:
            raise ValueError("top_k and samples must be at least 1 and warmup at least 0")
        misplaced = [j.recipe for j in jobs if j.adapter and j.recipe not in adapters.MODES]
        if misplaced:
            raise ValueError(f"recipes that take no adapter: {misplaced}")
        if self.model is None:
            return adapters.Gate({})
        without = [j.recipe for j in jobs if not j.adapter and j.recipe in adapters.MODES]
        if without:
            raise ValueError(f"recipes without their adapter: {without}")
        run = adapters.Run(self.model["model_id"], self.model["revision"], prompts.identity(), self.model["chat_template_kwargs"], self.eval_sha256, self.manifest)
        return adapters.gate({j.recipe: j.adapter for j in jobs if j.adapter}, run, self.allow_unverified, self.allow_unmatched)


def generate(asked: DataFrame, make: Callable[[], Generator], warmup: int = 0) -> DataFrame:
    """(id, prediction, error and all of SAID) for (id, question, contexts); a failure is a row with its message.

    Every worker first answers ``warmup`` of its questions unmeasured. What a generator doesn't measure is timed from
    outside; the raw text is the answer, and the answer's tokens are the output's, unless it says otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator, cold = make(), warmup
        for batch in batches:
            rows: list[dict[str, Any]] = []
            questions = list(zip(*(batch.column(c).to_pylist() for c in ("id", "question", "contexts"))))
            for _, question, contexts in questions[:cold]:
                try:
                    generator(question or "", contexts or [])
                except Exception:  # noqa: BLE001, S110
                    pass
            cold -= len(questions[:cold])
            for id_, question, contexts in questions:
                row, began = dict.fromkeys(("id", "prediction", "error", *SAID)) | {"id": id_}, time.perf_counter()
                try:
                    said = generator(question or "", contexts or [])
                    took = time.perf_counter() - began
                    said = {"text": said} if isinstance(said, str) else dict(said)
                    answer = said.pop("text")
                    row |= {"prediction": answer, "raw_text": answer} | {k: v for k, v in said.items() if k in SAID}
                    row["model_generate_latency_s"] = said.get("model_generate_latency_s", said.get("latency_s", took))
                    if row["answer_tokens"] is None and row["output_tokens"] is not None:
                        row["answer_tokens"] = row["output_tokens"] - (row["reasoning_tokens"] or 0)
                except Exception as problem:  # noqa: BLE001
                    row["error"] = f"{type(problem).__name__}: {problem}"
                rows.append(row)
            kinds = {"id": "string", "prediction": "string", "error": "string"} | SAID
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _ARROW[t]) for c, t in kinds.items()], list(kinds))

    schema = ", ".join(f"{c} {t}" for c, t in ({"id": "string", "prediction": "string", "error": "string"} | SAID).items())
    return asked.select("id", "question", "contexts").mapInArrow(run, schema)


def check_inputs(documents: DataFrame, examples: DataFrame) -> None:
    """Ids are unique, both tables have rows, and every relevant document is in the corpus."""
    for name, frame in (("documents", documents), ("examples", examples)):
        if frame.limit(1).count() == 0:
            raise ValueError(f"there are no {name}")
        twice = [r["id"] for r in repeated_ids(frame).orderBy("id").limit(10).collect()]
        if twice:
            raise ValueError(f"repeated ids in {name}: {twice}")
    absent = [r["ref_id"] for r in missing_references(examples, documents).orderBy("ref_id").limit(10).collect()]
    if absent:
        raise ValueError(f"relevant documents that aren't in the corpus: {absent}")


def _retrieved(documents: DataFrame, examples: DataFrame, retriever: ranking.Retriever, top_k: int, stash: Stash) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """The examples with what was retrieved for each, the rankings, and their measures. All examples are ranked at once, so
    each one's latency is its share of the time."""
    began = time.perf_counter()
    ranked = stash.put(retriever.index(documents).rank(examples, top_k))
    share = (time.perf_counter() - began) / max(1, examples.count())
    strange = [r["doc_id"] for r in ranking.unranked_documents(ranked, documents).select("doc_id").distinct().orderBy("doc_id").limit(10).collect()]
    if strange:
        raise ValueError(f"the retriever returned documents outside of the corpus: {strange}")
    relevant = examples.select(F.col("id").alias("query_id"), F.explode(clean_ids(F.col("relevant_doc_ids"))).alias("doc_id"))
    found = ranking.retrieval_measures(ranked, relevant, top_k).first().asDict()
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "text")))
    texts = ranked.join(documents.select(F.col("id").alias("doc_id"), "text"), "doc_id").groupBy(F.col("query_id").alias("id")).agg(listed.alias("c"))
    references = F.col("reference_answers") if "reference_answers" in examples.columns else F.lit(None).cast("array<string>")
    rows = examples.select("id", "question", "reference_answer", clean_ids(F.col("relevant_doc_ids")).alias("relevant_doc_ids"), text.references(references, F.col("reference_answer")).alias("refs"))
    return stash.put(rows.join(texts, "id", "left").withColumn("retrieval_latency_s", F.lit(share))), ranked, found


def _answered(base: DataFrame, job: Job, make: Callable[[], Generator], scorer: scoring.Scorer, warmup: int, stash: Stash) -> DataFrame:
    """One recipe's prediction rows but for a judge's scores; written before anything is computed from them."""
    empty = F.array().cast("array<string>")
    contexts = F.coalesce(F.transform("c", lambda x: x["text"]), empty)
    rows = base.withColumns({
        "recipe": F.lit(job.recipe),
        "retrieval_used": F.lit(job.use_retrieval),
        "contexts": contexts if job.use_retrieval else empty,
        "retrieved_doc_ids": F.coalesce(F.transform("c", lambda x: x["doc_id"]), empty),
        "retrieval_results": F.transform("c", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["rank"].alias("rank"), x["score"].alias("score"))),
    }).drop("c")
    said = stash.put(rows.join(generate(rows, make, warmup), "id"))
    said = said.withColumns({"answer": F.coalesce("prediction", F.lit("")), "context_ids": F.when(F.col("retrieval_used"), F.col("retrieved_doc_ids")).otherwise(empty)})
    began = time.perf_counter()
    names = list(scorer.columns())
    scored = scoring.score(said, scorer)
    scored = stash.put(scored.withColumns({
        "exact_match": text.best_over(F.col("refs"), lambda r: text.exact_match(F.col("answer"), r)),
        "token_f1": text.best_over(F.col("refs"), lambda r: text.token_f1(F.col("answer"), r)),
        "inference_e2e_latency_s": measures.latency(F.col("inference_e2e_latency_s"), [F.col(c) for c in _INSIDE], F.when(F.col("retrieval_used"), F.col("retrieval_latency_s")).otherwise(0.0)),
        "output_tokens_per_model_generate_second": measures.row_rate(F.col("output_tokens"), F.col("model_generate_latency_s")),
        "total_tokens_per_model_generate_second": measures.row_rate(F.col("prompt_tokens") + F.col("output_tokens"), F.col("model_generate_latency_s")),
        "scores": F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("double") for n in names))) if names else F.create_map().cast("map<string,double>"),
    }).drop(*names))
    share = (time.perf_counter() - began) / max(1, scored.count())
    return scored.withColumn("scoring_latency_s", F.lit(share))


def _judged(predictions: DataFrame, judge: scoring.Judge | None) -> DataFrame:
    if judge is None:
        empty = {"judge_status": "string", "judge_error_type": "string", "judge_rationale": "string", "judge_cache_hit": "boolean", "judge_attempts": "int", "judge_latency_s": "double", **dict.fromkeys(scoring.COLUMNS, "double")}
        return predictions.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    rows = judge.rows(predictions)
    return predictions.join(rows, ["recipe", "id"], "left")


def _comparisons(predictions: DataFrame, judge: scoring.Judge | None, contract: Contract, gate: adapters.Gate, stash: Stash) -> dict[str, dict[str, Any]]:
    """Each pair's results by metric: optional metrics only if they have pairs, a judge's whenever one was asked."""
    plain = (*CANONICAL, *OPTIONAL)
    deltas = stash.put(measures.paired(predictions, (*plain, *measures.JUDGED)))
    least = (judge.minimum_coverage, judge.minimum_pairs) if judge else (0.0, 1)
    summary = measures.paired_summary(deltas.where(F.col("metric").isin(*plain))).unionByName(measures.paired_summary(deltas.where(F.col("metric").isin(*measures.JUDGED)), *least))
    intervals = measures.bootstrap_numpy(deltas, contract.samples, contract.seed).drop("pairs", "delta")
    rows = measures.decisions(summary, intervals, gate.unverified, gate.controls_matched)
    kept = rows.where((F.col("pairs") > 0) | (F.col("metric").isin(*measures.JUDGED) & F.lit(judge is not None)))
    ran = {r[0] for r in predictions.select("recipe").distinct().collect()}
    out: dict[str, dict[str, Any]] = {}
    for row in kept.orderBy("pair", "metric").collect():
        if set(row["pair"].split("->")) <= ran:
            out.setdefault(row["pair"], {})[row["metric"]] = row.asDict()
    return out


def run(
    documents: DataFrame,
    examples: DataFrame,
    makers: Mapping[str, Callable[[], Generator]],
    output: str,
    retriever: ranking.Retriever | None = None,
    retriever_config: Mapping[str, Any] | None = None,
    scorer: scoring.Scorer | None = None,
    judge: scoring.Judge | None = None,
    contract: Contract | None = None,
    given: Mapping[str, str] | None = None,
    tracker: Tracker | None = None,
) -> dict[str, Any]:
    """Run the recipes of ``makers``; write predictions (by recipe), summary.json and report.md to output; give the summary.

    documents: (id, text, pos); examples: (id, question, reference_answer, relevant_doc_ids, and reference_answers if
    there are several). ``given`` names the adapters. The corpus is indexed and ranked once for all recipes; predictions
    are written before anything is computed from them, so a lost executor never generates anew what has been written.
    """
    contract, tracker, scorer = contract or Contract(), tracker or NoTracker(), scorer or scoring.NoScores()
    jobs = plan(list(makers), given)
    gate = contract.check(jobs)
    check_inputs(documents, examples)
    check_destination(output)
    spark = documents.sparkSession
    stash, model = Stash(spark), dict(contract.model or {})
    tracker.start("benchmark", {"recipes": list(makers), "top_k": contract.top_k, "seed": contract.seed})
    try:
        base, _, retrieval = _retrieved(documents, examples, retriever or ranking.BM25(), contract.top_k, stash)
        parts = [_answered(base, job, makers[job.recipe], scorer, contract.warmup, stash) for job in jobs]
        together = parts[0]
        for part in parts[1:]:
            together = together.unionByName(part)
        predictions = stash.put(_judged(together, judge))
        old = {"latency_s": F.col("model_generate_latency_s"), "end_to_end_latency_s": F.col("inference_e2e_latency_s"), "tokens_per_second": F.col("output_tokens_per_model_generate_second")}
        shown = predictions.withColumns(old).withColumnsRenamed({"reference_answer": "reference", "refs": "references", "raw_text": "raw_prediction"}).drop("contexts", "context_ids", "answer")
        shown.write.mode("overwrite").partitionBy("recipe").option("ignoreNullFields", "false").json(f"{output}/predictions")
        if measures.unpaired_ids(predictions).limit(1).count():
            raise ValueError("the recipes of a pair didn't see the same examples")
        metrics = {r["recipe"]: r.asDict() for r in measures.recipe_metrics(predictions).collect()}
        for row in measures.score_means(predictions).collect():
            metrics[row["recipe"]][row["metric"]] = row["mean"]
        coverage = {r["recipe"]: r.asDict() for r in measures.judge_coverage(predictions, "recipe", "judge_status", "judge_cache_hit").collect()}
        blocks: dict[str, dict[str, Any]] = {}
        for row in measures.judge_blocks(predictions, minimum=judge.minimum_coverage if judge else 0.8).collect():
            blocks.setdefault(row["recipe"], {})[row["metric"]] = row.asDict()
        for row in measures.metric_means(predictions, "recipe", measures.JUDGED).collect():
            metrics[row["recipe"]][row["metric"]] = row["mean"]
        for recipe, found in metrics.items():
            c = coverage[recipe]
            found |= {"judge_examples": c["attempted"], "judge_successes": c["successes"], "judge_failures": c["failures"], "judge_coverage": c["coverage"], "judge_failure_rate": c["failure_rate"], "judge_cache_hits": c["hits"], "judge_cache_misses": c["attempted"] - c["hits"], "judge_total_evaluation_examples": c["total"], "judge_metrics": blocks[recipe]}
            found |= dict.fromkeys(("peak_allocated_vram_gb", "peak_reserved_vram_gb", "peak_gpu_vram_gb"))  # generators run elsewhere
        named = {f"retrieval/{k}": v for k, v in retrieval.items()}
        recipes = {}
        for job in jobs:
            seen = gate.verifications.get(job.recipe)
            recipes[job.recipe] = {"adapter_path": job.adapter, "adapter_sha256": seen.artifact_sha256 if seen else None, "adapter_provenance": seen.as_dict() if seen else None, "retrieval_enabled": job.use_retrieval, "predictions": f"predictions/recipe={job.recipe}", "metrics": metrics[job.recipe] | (named if job.use_retrieval else {})}
        thinking = bool(model.get("thinking"))
        summary = {
            "schema_name": "benchmark-summary",
            "schema_version": 3,
            "configuration": {
                "model": {"model_id": model.get("model_id"), "revision": model.get("revision"), "generation": model.get("generation", {}), "chat_template_kwargs": model.get("chat_template_kwargs", {}), "thinking_enabled": thinking, "condition": "thinking-enabled" if thinking else "concise-non-thinking", "trust_remote_code": False},
                "prompt": prompts.identity(),
                "retriever": dict(retriever_config or {"kind": "bm25"}) | {"top_k": contract.top_k},
                "scorer": {"name": scorer.name, "version": scorer.version, "metrics": list(scorer.columns()), "judge": judge.backend if judge else None},
                "seed": contract.seed,
                "bootstrap_samples": contract.samples,
                "warmup_examples": contract.warmup,
                "held_out_examples": examples.count(),
                "documents": documents.count(),
                "inputs": dict(contract.inputs),
            },
            "provenance": {"verified": not gate.unverified, "confounded": gate.controls_matched is False, "allow_unverified_adapter": contract.allow_unverified, "allow_unmatched_training_controls": contract.allow_unmatched, "training_controls_matched": gate.controls_matched, "training_control_mismatches": list(gate.mismatches), "warnings": gate.warnings},
            "retrieval_metrics": named,
            "recipes": recipes,
            "comparisons": _comparisons(predictions, judge, contract, gate, stash),
        }
        schemas.require(summary, schemas.SUMMARY)
        write_text(spark, f"{output}/summary.json", json.dumps(summary, indent=2, ensure_ascii=False, default=str) + "\n")
        write_text(spark, f"{output}/report.md", report(summary))
        tracker.log({f"{r}/{k}": v for r, x in recipes.items() for k, v in x["metrics"].items() if isinstance(v, int | float)})
        tracker.artifact(f"{output}/summary.json", "summary")
        tracker.artifact(f"{output}/report.md", "report")
        return summary
    finally:
        tracker.finish()


def plan_artifact(jobs: list[Job], paths: Mapping[str, str], model: Mapping[str, Any], contract: Contract, retriever: Mapping[str, Any], scorer: Mapping[str, Any] | None, gate: adapters.Gate | None = None) -> dict[str, Any]:
    """What a run would do; with the gate of its adapters also that nothing stands in its way. No model is loaded for either."""
    static = gate is not None
    out = {
        "schema_name": "benchmark-plan",
        "schema_version": 1,
        "fixed_contract": dict(paths) | {
            "retriever": dict(retriever), "scorer": dict(scorer or {"mode": "default"}), "top_k": contract.top_k, "seed": contract.seed,
            "generation": model["generation"], "chat_template_kwargs": model["chat_template_kwargs"], "prompt": prompts.identity(), "bootstrap_samples": contract.samples,
            "warmup_examples": contract.warmup, "load_in_4bit": False, "allow_unverified_adapter": contract.allow_unverified, "allow_unmatched_training_controls": contract.allow_unmatched,
        },
        "jobs": [dict(paths) | {"recipe": j.recipe, "use_retrieval": j.use_retrieval, "adapter_path": j.adapter} for j in jobs],
        "validation": {
            "validation_level": "static-protocol" if static else "structural", "model_weights_loaded": False,
            "adapter_provenance_validated": static and not gate.unverified,
            "adapter_provenance": {r: v.as_dict() for r, v in gate.verifications.items()} if static else {},
            "training_controls_matched": gate.controls_matched if static else None,
            "scorer_configuration_validated": static, "ready_for_execution": static,
        },
    }
    schemas.require(out, schemas.PLAN)
    return out


def number(value: Any, digits: int = 3, unit: str = "") -> str:
    return f"{value:.{digits}f}{unit}" if isinstance(value, int | float) and not isinstance(value, bool) else "—"


def verdict(result: Mapping[str, Any]) -> str:
    """What a comparison allows to say, by the first thing that stands in its way."""
    if result["status"] == "confounded_training_controls":
        return "confounded, as the training controls differ"
    if result["status"] == "unverified_adapter_provenance":
        return "undecided, as an adapter's origin is unverified"
    if not result["eligible"]:
        return "undecided, as too few examples are paired"
    if result["delta"] is None:
        return "not estimated"
    if not result["significant"]:
        return "not resolved: the interval includes zero"
    return "a supported improvement" if result["delta"] > 0 else "a supported regression"


#: The columns of the report's table: head, metric, digits, unit.
TABLE = (
    ("EM", "exact_match", 3, ""), ("Token F1", "token_f1", 3, ""), ("Reference overlap", "reference_overlap", 3, ""), ("Judge correctness", "judge_correctness", 3, ""),
    ("Lexical groundedness", "lexical_groundedness", 3, ""), ("Judge groundedness", "judge_groundedness", 3, ""), ("Judge coverage", None, 0, ""),
    ("p50 inference", "inference_e2e_latency_p50_s", 3, " s"), ("p95 inference", "inference_e2e_latency_p95_s", 3, " s"), ("Output tokens/s", "output_tokens_per_model_generate_second", 1, ""),
    ("Allocated VRAM", "peak_allocated_vram_gb", 2, " GB"), ("Reserved VRAM", "peak_reserved_vram_gb", 2, " GB"),
)
DECISIONS = {"base->rag": "Retrieval against the base model", "rag->sft-rag": "SFT with retrieval", "rag->raft-rag": "RAFT with retrieval", "sft-rag->raft-rag": "RAFT against SFT"}


def _judge_share(found: Mapping[str, Any]) -> str:
    block = (found.get("judge_metrics") or {}).get("judge_correctness")
    if not block or not found.get("judge_examples"):
        return "—"
    return f"{block['numeric']}/{block['total']} ({100 * block['numeric'] / block['total']:.1f} %)"


def report(summary: Mapping[str, Any]) -> str:
    """The summary as Markdown."""
    lines = ["# Benchmark", "", "| Recipe | " + " | ".join(head for head, *_ in TABLE) + " |", "|---|" + "---:|" * len(TABLE)]
    for recipe, x in summary["recipes"].items():
        found = x["metrics"]
        cells = [_judge_share(found) if name is None else number(found.get(name), digits, unit) for _, name, digits, unit in TABLE]
        lines.append(f"| {NAMES.get(recipe, recipe)} | " + " | ".join(cells) + " |")
    lines += ["", "Reference overlap counts words, like Token F1, and judges nothing. The time that judges take isn't part of inference.", "", "## Decisions", ""]
    compared = summary["comparisons"]
    decided = [(label, compared[pair]["token_f1"]) for pair, label in DECISIONS.items() if "token_f1" in compared.get(pair, {})]
    lines += [f"- **{label}**: {verdict(x)}; Token F1 {number(x['delta'])}, 95 % interval [{number(x['ci95_low'])}, {number(x['ci95_high'])}]." for label, x in decided] or ["No pair of recipes has Token F1 on both sides."]
    found = summary["retrieval_metrics"]
    lines += ["", "## Retrieval", "", ", ".join(f"{k.removeprefix('retrieval/')} {number(v) if not k.endswith('evaluated') else v}" for k, v in found.items()) + ".", "", "## Judge", ""]
    judged = [x["metrics"] for x in summary["recipes"].values() if x["metrics"].get("judge_examples")]
    if judged:
        successes, total, failures = (sum(m[k] for m in judged) for k in ("judge_successes", "judge_total_evaluation_examples", "judge_failures"))
        lines.append(f"Scores for {successes} of {total} answers ({number(successes / total if total else None)}); {failures} failures.")
    else:
        lines.append("No judge was asked; exact match and Token F1 don't depend on one.")
    lines += ["", "## Pairs", ""] + ([] if compared else ["No pair of recipes ran."])
    for pair, by_metric in compared.items():
        base, candidate = pair.split("->")
        lines += [f"### {NAMES[base]} and {NAMES[candidate]}", ""]
        lines += [f"- {metric}: {verdict(x)}; difference {number(x['delta'])}, 95 % interval [{number(x['ci95_low'])}, {number(x['ci95_high'])}], {x['pairs']} of {x['total']} examples paired ({number(100 * x['coverage'] if x['coverage'] is not None else None, 1, ' %')}), status {x['status']}." for metric, x in by_metric.items()]
        lines.append("")
    config, origin = summary["configuration"], summary["provenance"]
    lines += [
        "## What was fixed", "",
        f"- Model {config['model']['model_id'] or 'not named'} at {config['model']['revision'] or 'no revision'}, {config['model']['condition']}, template arguments {json.dumps(config['model']['chat_template_kwargs'])}.",
        f"- Retriever {config['retriever'].get('kind', 'not named')}, {config['retriever']['top_k']} documents; prompt version {config['prompt']['version']}; {config['bootstrap_samples']} bootstrap samples; seed {config['seed']}.",
        f"- Adapters verified: {origin['verified']} (unverified ones allowed: {origin['allow_unverified_adapter']}); training controls equal: {origin['training_controls_matched']} (unequal ones allowed: {origin['allow_unmatched_training_controls']}).",
        *(f"- **Warning:** {w}" for w in origin["warnings"]), "",
    ]
    return "\n".join(lines)
