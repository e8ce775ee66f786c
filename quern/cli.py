"""Command line: validate-data, eval-retrieval, prepare-splits, prepare-raft and benchmark over JSON Lines."""

from __future__ import annotations

import argparse
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import ranking, scoring, splits
from quern.operators.records import clean_ids, require_disjoint
from quern.plans import benchmark, prepare
from quern.runtime import session, write_text
from quern.sources import http, jsonl
from quern.sources.config import file_digest, model_settings, read_settings, scorer_settings
from quern.sources.tracking import FolderTracker, NoTracker, ServiceTracker


def _bounded(low: float, high: float, kind=int):
    def parse(text: str):
        value = kind(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"must be between {low} and {high}")
        return value

    return parse


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("quern")
    commands = parser.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--documents", required=True)
    common.add_argument("--eval", required=True)
    seeded = argparse.ArgumentParser(add_help=False)
    seeded.add_argument("--seed", type=int, default=42)
    commands.add_parser("validate-data", parents=[common])
    retrieval = commands.add_parser("eval-retrieval", parents=[common])
    retrieval.add_argument("--top-k", type=_bounded(1, 100), default=5)
    retrieval.add_argument("--retriever", help="a YAML configuration")
    split = commands.add_parser("prepare-splits", parents=[seeded])
    split.add_argument("--qa", required=True)
    split.add_argument("--ratio", type=_bounded(0, 0.99, float), default=0.1)
    split.add_argument("--by-document", action="store_true")
    split.add_argument("--train-output", required=True)
    split.add_argument("--validation-output", required=True)
    raft = commands.add_parser("prepare-raft", parents=[seeded])
    for name in ("--documents", "--training-set", "--held-out-eval", "--output"):
        raft.add_argument(name, required=True)
    raft.add_argument("--distractors", type=_bounded(0, 20), default=2)
    raft.add_argument("--negatives", choices=prepare.NEGATIVES, default="random")
    raft.add_argument("--pool", type=_bounded(1, 1 << 30), default=20)
    raft.add_argument("--validation-output", help="split before mining and write the validation side here")
    raft.add_argument("--split", help="a YAML configuration of the split")
    raft.add_argument("--ratio", type=_bounded(0, 0.99, float), default=0.1)
    raft.add_argument("--strategy", choices=("row", "grouped"), default="grouped")
    raft.add_argument("--group-by", default="")
    raft.add_argument("--policy", choices=prepare.POLICIES, default="shared-corpus")
    raft.add_argument("--manifest")
    bench = commands.add_parser("benchmark", parents=[common, seeded])
    bench.add_argument("--recipes", default=",".join(benchmark.RECIPES))
    bench.add_argument("--model", required=True, help="a YAML configuration")
    for name in ("--retriever", "--scorer", "--sft-adapter", "--raft-adapter", "--plan-output", "--generator-url", "--tracking"):
        bench.add_argument(name)
    bench.add_argument("--output", default="outputs/benchmark")
    bench.add_argument("--top-k", type=_bounded(1, 100))
    bench.add_argument("--samples", type=_bounded(1, 1 << 30), default=10_000)
    bench.add_argument("--warmup", type=_bounded(0, 1 << 20), default=1)
    bench.add_argument("--manifest-name")
    once = bench.add_mutually_exclusive_group()
    once.add_argument("--plan-only", action="store_true", help="say what would run")
    once.add_argument("--dry-run", action="store_true", help="check everything that needs no model")
    bench.add_argument("--allow-unverified-adapter", action="store_true")
    bench.add_argument("--allow-unmatched-training-controls", action="store_true")
    planned = commands.add_parser("plan")
    planned.add_argument("--recipes", nargs="+", default=list(benchmark.RECIPES))
    return parser


def _prepare_raft(args: argparse.Namespace) -> dict[str, Any]:
    spark = session("quern")
    manifest = args.manifest or f"{args.output.rstrip('/')}.manifest.json"
    jsonl.distinct_outputs(args.output, args.validation_output, manifest, args.training_set, args.documents)
    questions, held_out = jsonl.load(spark, args.training_set, "eval"), jsonl.load(spark, args.held_out_eval, "eval")
    require_disjoint(questions, held_out, ("training data", "held-out evaluation"))
    documents = jsonl.load(spark, args.documents, "documents")
    if args.validation_output is None:
        if args.split or args.policy == "document-disjoint":
            raise ValueError("a split needs a validation output, as mining comes after it")
        rows = prepare.build(questions, documents, args.distractors, args.negatives, args.seed)
        jsonl.write_raft(rows.drop("problems"), args.output)
        return {"rows": rows.count()}
    given = read_settings(args.split) if args.split else {}
    groups = given.get("group_by", [g.strip() for g in args.group_by.split(",") if g.strip()])
    if not isinstance(groups, list) or not all(isinstance(g, str) for g in groups):
        raise ValueError("group_by must be a list of fields")
    fields = tuple(g for g in groups if g != "normalized_question")
    train, validation, made = prepare.prepare(questions, documents, float(given.get("validation_ratio", args.ratio)), args.distractors, given.get("strategy", args.strategy), given.get("corpus_policy", args.policy), fields, args.negatives, args.pool, int(given.get("seed", args.seed)))
    for rows, path in ((train, args.output), (validation, args.validation_output)):
        scope = F.struct(F.struct(F.col("mining_scope").alias("scope")).alias("negative_mining"))
        jsonl.write_raft(rows.withColumn("metadata", scope).drop("problems", "mining_scope"), path)
    write_text(spark, manifest, json.dumps(made, indent=2) + "\n")
    return made


def _benchmark(args: argparse.Namespace, documents: DataFrame, examples: DataFrame) -> dict[str, Any]:
    spark = documents.sparkSession
    recipes = [r.strip() for r in args.recipes.split(",") if r.strip()]
    model = model_settings(read_settings(args.model))
    retriever = read_settings(args.retriever) if args.retriever else {"kind": "bm25", "top_k": 5}
    ranking.retriever(retriever)
    scorer = read_settings(args.scorer) if args.scorer else None
    given = {r: p for r, p in (("sft-rag", args.sft_adapter), ("raft-rag", args.raft_adapter)) if p and r in recipes}
    jobs = benchmark.plan(recipes, given)
    jsonl.check_destination(args.output, args.plan_output)
    more = {"manifest": args.manifest_name} if args.manifest_name else {}
    inputs = {n: {"path": p, "sha256": file_digest(p)} for n, p in (("model_config", args.model), ("documents", args.documents), ("eval_set", args.eval))}
    contract = benchmark.Contract(model, args.top_k or int(retriever.get("top_k", 5)), args.samples, args.seed, args.warmup, args.allow_unverified_adapter, args.allow_unmatched_training_controls, eval_sha256=inputs["eval_set"]["sha256"], inputs=inputs, **more)
    paths = {"model_config": args.model, "documents": args.documents, "eval_set": args.eval}
    if args.plan_only or args.dry_run:
        if args.dry_run:
            scorer_settings(scorer)
        out = benchmark.plan_artifact(jobs, paths, model, contract, retriever, scorer, contract.check(jobs) if args.dry_run else None)
        if args.plan_output:
            write_text(spark, args.plan_output, json.dumps(out, indent=2) + "\n")
        return out
    if not args.generator_url:
        raise ValueError("no model runs here: --generator-url must name a server of chat completions")
    names = {r: f"{model['model_id']}:{r}" if r in given else model["model_id"] for r in recipes}
    makers = {r: http.generator(args.generator_url, names[r], "GENERATOR_API_KEY", model["generation"]["max_new_tokens"]) for r in recipes}
    tracker = NoTracker() if args.tracking in (None, "none") else FolderTracker(spark, args.tracking.removeprefix("folder:")) if args.tracking.startswith("folder:") else ServiceTracker("benchmark", args.tracking)
    return benchmark.run(documents, examples, makers, args.output, ranking.retriever(retriever), retriever, scoring.scorer_for(scorer), http.judge_from(scorer_settings(scorer)["judge"]), contract, given, tracker)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "plan":
        print(json.dumps([vars(job) for job in benchmark.plan(args.recipes)]))
        return 0
    if args.command == "prepare-raft":
        print(json.dumps(_prepare_raft(args)))
        return 0
    spark = session("quern")
    if args.command == "prepare-splits":
        jsonl.distinct_outputs(args.train_output, args.validation_output, args.qa)
        rows = jsonl.load(spark, args.qa, "eval")
        assigned = splits.split_groups(splits.question_groups(rows, by_document=args.by_document), args.ratio, args.seed)
        for name, path in (("train", args.train_output), ("validation", args.validation_output)):
            jsonl.write_jsonl(rows.join(assigned.where(F.col("split") == name).select("id"), "id", "left_semi"), path, order="pos")
        print(splits.audit(rows, assigned).toJSON().first())
        return 0
    documents, examples = jsonl.load(spark, args.documents, "documents"), jsonl.load(spark, args.eval, "eval")
    benchmark.check_inputs(documents, examples)
    if args.command == "validate-data":
        print(json.dumps({"documents": documents.count(), "examples": examples.count()}))
        return 0
    if args.command == "benchmark":
        print(json.dumps(_benchmark(args, documents, examples), default=str))
        return 0
    chosen = ranking.retriever(read_settings(args.retriever) if args.retriever else {"kind": "bm25"})
    rankings = chosen.index(documents).rank(examples, args.top_k)
    relevant = examples.select(F.col("id").alias("query_id"), F.explode(clean_ids(F.col("relevant_doc_ids"))).alias("doc_id"))
    print(ranking.retrieval_measures(rankings, relevant, args.top_k).toJSON().first())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
