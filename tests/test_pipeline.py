import json

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.functions import prompts
from quern.operators import measures, scoring, tuning
from quern.plans import benchmark, prepare
from quern.sources import adapters, config, controls, datasets, jsonl, schemas, tracking

QA = "id string, question string, reference_answer string, relevant_doc_ids array<string>"


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl_round_trip(spark, tmp_path):
    path = lines(tmp_path / "d.jsonl", [{"id": " a ", "text": "größer"}, "", "  ", {"id": "b", "text": "y", "metadata": {"k": [1, 2]}}])
    rows = jsonl.load(spark, path, "documents").orderBy("pos")
    assert [(r["id"], r["text"], r["metadata"]) for r in rows.collect()] == [("a", "größer", None), ("b", "y", '{"k":[1,2]}')]
    jsonl.write_jsonl(rows, str(tmp_path / "out"), order="pos", files=1)
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("*.json")))
    assert [json.loads(x)["id"] for x in text.splitlines()] == ["a", "b"] and "größer" in text and '"metadata":null' in text


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([{"id": "a", "text": "x"}, "", "{oops"], ":3"),
        (["[1]"], ":1"),
        ([{"id": " ", "text": "x"}], "blank id"),
        ([{"id": "a", "text": " "}], "missing text"),
        ([{"id": "a", "text": "x", "more": 1}], "more"),
        ([{"id": "a", "text": "x"}, {"id": "a ", "text": "y"}], "duplicate ids"),
    ],
)
def test_jsonl_refuses(spark, tmp_path, rows, message):
    with pytest.raises(ValueError, match=message):
        jsonl.load(spark, lines(tmp_path / "d.jsonl", rows), "documents")


def test_evaluation_records_merge_evidence(spark, tmp_path):
    path = lines(tmp_path / "e.jsonl", [{"id": "e", "question": "q", "relevant_doc_ids": ["d1"], "evidence": [{"doc_id": "d2"}, {"doc_id": "d1"}]}])
    assert jsonl.load(spark, path, "eval").first()["relevant_doc_ids"] == ["d1", "d2"]
    sft = jsonl.load(spark, lines(tmp_path / "s.jsonl", [{"id": "s", "output": "o"}]), "sft").first()
    assert (sft["instruction"], sft["input"]) == ("Answer accurately.", "")


def test_raft_is_validated_before_it_is_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "q", "x", [("d", "t", False)], ["d"])], "id string, question string, answer string, contexts array<struct<doc_id:string,text:string,relevant:boolean>>, evidence_doc_ids array<string>")
    with pytest.raises(ValueError, match="evidence marked irrelevant"):
        jsonl.write_raft(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="distinct"):
        jsonl.distinct_outputs("a", "./a")


def corpus(spark):
    docs = spark.createDataFrame([("d1", "alpha is one. More.", 0), ("d2", "beta is two. More.", 1), ("d3", "gamma. Noise.", 2)], "id string, text string, pos bigint")
    asked = spark.createDataFrame([("q1", "what is alpha", "alpha is one", ["d1"]), ("q2", "what is beta", "beta is two", ["d2"])], QA)
    return docs, asked


def makers():
    """Makers of generators, local to a function so that they travel to the workers by value."""

    def extractive():
        def answer(question, contexts):
            text = contexts[0].split(".")[0] if contexts else "unknown"
            return {"text": text, "prompt_tokens": 10, "output_tokens": len(text.split()), "model_generate_latency_s": 0.5, "prompt_build_latency_s": 0.25, "generation_mode": "greedy"}

        return answer

    def broken():
        def fail(question, contexts):
            raise RuntimeError("no model")

        return fail

    return extractive, broken


def test_benchmark_run(spark, tmp_path):
    docs, asked = corpus(spark)
    extractive, broken = makers()
    judge = scoring.Judge(lambda prompt: {"correctness": 1.0, "groundedness": 0.5, "unsupported_claim_rate": 0.0, "rationale": "fine"}, "test", lambda q, a, r, c: f"{q} {a}", store=str(tmp_path / "judged"), minimum_pairs=2, backoff=0)
    options = {"scorer": scoring.scorer_for({"mode": "enabled", "lexical_groundedness": {}, "citation_metrics": True}), "contract": benchmark.Contract(samples=200)}
    summary = benchmark.run(docs, asked, {"base": extractive, "rag": extractive, "sft-rag": extractive, "raft-rag": broken}, str(tmp_path / "out"), judge=judge, tracker=tracking.FolderTracker(spark, str(tmp_path / "track")), **options)
    found = {r: x["metrics"] for r, x in summary["recipes"].items()}
    assert found["rag"]["exact_match"] == 1.0 and found["base"]["exact_match"] == 0.0 and found["raft-rag"]["token_f1"] == 0.0
    assert "lexical_groundedness" not in found["base"] and found["rag"]["lexical_groundedness"] == 1.0
    assert summary["retrieval_metrics"]["retrieval/recall_at_k"] == 1.0 and "retrieval/mrr" in found["rag"] and "retrieval/mrr" not in found["base"]
    assert found["rag"]["model_generate_latency_p50_s"] == found["rag"]["latency_p50_s"] == 0.5 and found["rag"]["output_tokens_per_model_generate_second"] == 6.0
    assert found["base"]["inference_e2e_latency_p50_s"] == 0.75 < found["rag"]["inference_e2e_latency_p50_s"] and found["base"]["retrieval_latency_p50_s"] is None
    assert found["rag"]["judge_metrics"]["judge_correctness"]["state"] == "ok" and found["rag"]["judge_correctness"] == 1.0
    rag = summary["comparisons"]["base->rag"]["token_f1"]
    assert rag["delta"] == pytest.approx(1.0) and rag["significant"]
    assert summary["comparisons"]["base->rag"]["judge_groundedness"]["pairs"] == 2 and "citation_recall" not in summary["comparisons"]["base->rag"]
    predictions = spark.read.json(f"{tmp_path}/out/predictions")
    assert predictions.count() == 8 and predictions.where("recipe = 'raft-rag' and error like '%no model%'").count() == 2
    row = predictions.where("recipe = 'base' and id = 'q1'").first()
    assert row["retrieved_doc_ids"] and row["raw_prediction"] == "unknown" and row["answer_tokens"] == 1 and row["latency_s"] == 0.5
    report = (tmp_path / "out/report.md").read_text()
    assert "supported improvement" in report and json.loads((tmp_path / "out/summary.json").read_text())["schema_version"] == 3
    assert '"kind": "metrics"' in (tmp_path / "track/tracking.jsonl").read_text()
    again = benchmark.run(docs, asked, {"base": extractive}, str(tmp_path / "again"), judge=judge, **options)
    assert again["recipes"]["base"]["metrics"]["judge_cache_hits"] == 2 and again["comparisons"] == {}


def test_benchmark_checks_its_inputs(spark, tmp_path):
    docs, asked = corpus(spark)
    with pytest.raises(ValueError, match="aren't in the corpus"):
        benchmark.check_inputs(docs.where("id <> 'd1'"), asked)
    with pytest.raises(ValueError, match="no documents"):
        benchmark.check_inputs(docs.limit(0), asked)
    with pytest.raises(ValueError, match="unknown"):
        benchmark.plan(["base", "other"])
    model = config.model_settings({"model_id": "m", "revision": "a" * 40})
    for contract, jobs, message in ((benchmark.Contract(top_k=0), ["base"], "at least 1"), (benchmark.Contract(model), ["sft-rag"], "without their adapter")):
        with pytest.raises(ValueError, match=message):
            contract.check(benchmark.plan(jobs))
    with pytest.raises(ValueError, match="take no adapter"):
        benchmark.Contract(model).check(benchmark.plan(["base"], {"base": "x"}))
    (tmp_path / "file").write_text("x")
    for output, plan in ((tmp_path / "file", None), (tmp_path / "o", tmp_path), (tmp_path / "o", tmp_path / "o")):
        with pytest.raises(ValueError):
            jsonl.check_destination(str(output), str(plan) if plan else None)


DELTAS = "pair string, metric string, id string, delta double, baseline double, candidate double"


def test_bootstrap(spark):
    deltas = spark.createDataFrame([("a->b", "m", "x", 1.0, 0.0, 1.0), ("a->b", "m", "y", 0.5, 0.0, 0.5), ("a->b", "m", "z", None, 0.0, None)], DELTAS)
    one, two = (measures.bootstrap_numpy(deltas, 500).first().asDict() for _ in range(2))
    assert one == two and one["delta"] == 0.75 and one["ci95_low"] > 0 and one["excludes_zero"] and one["pairs"] == 2
    hashed = measures.bootstrap_hashed(deltas, 501).first()
    assert 0.5 <= hashed["ci95_low"] <= 0.75 <= hashed["ci95_high"] <= 1.0
    summary = measures.paired_summary(deltas, minimum_coverage=0.8).first()
    assert (summary["total"], summary["pairs"], summary["coverage"], summary["eligible"]) == (3, 2, pytest.approx(0.666667), False)
    decided = measures.decisions(measures.paired_summary(deltas), measures.bootstrap_hashed(deltas, 501), unverified=True).first()
    assert decided["status"] == "ok" and decided["significant"]


def test_decisions_say_the_worst(spark):
    rows = spark.createDataFrame([(p, "m", "x", 1.0, 0.0, 1.0) for p in ("base->rag", "rag->sft-rag", "sft-rag->raft-rag")], DELTAS)
    summary, boot = measures.paired_summary(rows), measures.bootstrap_hashed(rows, 11)
    got = {r["pair"]: r["status"] for r in measures.decisions(summary, boot, unverified=True, controls_matched=False).collect()}
    assert got == {"base->rag": "ok", "rag->sft-rag": "unverified_adapter_provenance", "sft-rag->raft-rag": "confounded_training_controls"}


def test_citations_and_groundedness(spark):
    row = spark.createDataFrame([("[Document 1] and [document 2] [Document 9]", ["a", "b", "c"], ["a", "c"]), ("none", ["a"], ["z"]), ("[Document 1]", [], ["a"])], "answer string, context_ids array<string>, relevant_doc_ids array<string>")
    got = [tuple(r[-2:]) for r in scoring.score(row, scoring.Citations()).collect()]
    assert got == [(pytest.approx(1 / 3), 0.5), (None, None), (None, None)]
    said = spark.createDataFrame([("Alpha is one! Beta is nine.", ["alpha is one"]), ("...", ["x"]), ("x", [])], "answer string, contexts array<string>")
    got = [tuple(r[-2:]) for r in scoring.score(said, scoring.Groundedness()).collect()]
    assert got[1:] == [(0.0, 0.0), (None, None)] and got[0] == (pytest.approx(4 / 6), 0.5)
    with pytest.raises(ValueError, match="two scorers"):
        scoring.Composite([scoring.Citations(), scoring.Citations()]).columns()


def test_judge_and_cache(spark, tmp_path):
    def call(prompt):
        if "slow" in prompt:
            raise TimeoutError("timed out")
        return {"correctness": 0.5, "groundedness": 2 if "wild" in prompt else 1, "unsupported_claim_rate": 0, "rationale": "long " * 9}

    asked = spark.createDataFrame([("k1", "fine"), ("k2", "slow"), ("k3", "wild"), ("k4", "fine"), ("k4", "fine")], "key string, prompt string")
    store = scoring.JudgeStore(spark, str(tmp_path / "store"))
    assert store.results().count() == 0
    store.add(scoring.judge(asked.where("key = 'k1'"), call, backoff=0, longest=4))
    assert [(r["key"], r["rationale"]) for r in store.results().collect()] == [("k1", "long")]
    everything, fresh = scoring.judge_with_cache(asked, store.results(), call, retries=1, backoff=0)
    got = {r["key"]: (r["status"], r["error"], r["attempts"], r["judge_cache_hit"]) for r in everything.collect()}
    assert got == {"k1": ("ok", None, 0, True), "k2": ("error", "timeout", 2, False), "k3": ("error", "invalid_score", 2, False), "k4": ("ok", None, 1, False)}
    store.add(fresh)
    store.remove(spark.createDataFrame([("k1",)], "key string"))
    spark.createDataFrame([("bad", None, 7.0, 0.5, 0.5)], "key string, rationale string, judge_correctness double, judge_groundedness double, judge_unsupported_claim_rate double").selectExpr("*", "current_timestamp() as at", "false as gone").write.mode("append").parquet(store.path)
    assert [r["key"] for r in store.results().collect()] == ["k4"]
    with pytest.raises(Exception, match="no scores after 2 attempts"):
        scoring.judge(asked.where("key = 'k2'"), call, retries=1, backoff=0, strict=True).collect()


def test_kinds_of_failures():
    kinds = [scoring.error_kind(e) for e in (TimeoutError("x"), ValueError("bad JSON here"), ValueError("missing fields"), ValueError("must be a number between 0 and 1"), ValueError("response too large"), OSError("gone"))]
    assert kinds == ["timeout", "malformed_json", "missing_fields", "invalid_score", "response_too_large", "backend_error"]


def test_latency_and_percentiles(spark):
    rows = spark.createDataFrame([("r", 1.0, None), ("r", 2.0, 0.1), ("r", 3.0, 0.2), ("r", 4.0, 0.3)], "recipe string, a double, b double")
    got = {r["stage"]: (r["mean"], r["p50"], r["p95"]) for r in measures.stage_latencies(rows, ["a", "b"]).collect()}
    assert got["a"] == (2.5, 2.5, 3.85) and got["b"][0] == pytest.approx(0.2)
    whole = rows.select(measures.latency(F.lit(None).cast("double"), [F.col("a"), F.col("b")], F.lit(0.5))).collect()
    assert [r[0] for r in whole] == pytest.approx([1.5, 2.6, 3.7, 4.8])


def test_prepare_splits_before_it_mines(spark):
    docs = spark.createDataFrame([(f"d{i:02}", f"text of {i} here", i) for i in range(60)], "id string, text string, pos bigint")
    asked = spark.createDataFrame([(f"q{i:02}", f"question {i}", "yes", [f"d{i:02}"]) for i in range(20)], QA)
    train, validation, manifest = prepare.prepare(asked, docs, ratio=0.2)
    assert (train.count(), validation.count()) == (16, 4) and manifest["rows"] == {"train": 16, "validation": 4}
    used = [{c["doc_id"] for r in side.collect() for c in r["contexts"]} for side in (train, validation)]
    assert not used[0] & used[1] and all(len(r["contexts"]) == 3 and not r["problems"] for r in train.collect())
    assert manifest["document_pools"] == {"train_count": 48, "validation_count": 12, "overlap_count": 0} and manifest["group_counts"] == {"train": 16, "validation": 4}
    found = prepare.given_splits(train, validation, asked.limit(0), policy="document-disjoint")
    assert found["negative_mining_scope"] == "split-before-mining" and found["audit"]["document_overlap"] == 0
    with pytest.raises(ValueError, match="training data overlaps held-out evaluation"):
        prepare.given_splits(train, validation, train.limit(1))
    shared = prepare.prepare(asked, docs, ratio=0.2, negatives="bm25-hard-negative", policy="shared-corpus")[2]
    assert shared["question_overlap_count"] == 0 and shared["document_pools"]["overlap_count"] == 60
    with pytest.raises(ValueError, match="no documents to mine"):
        prepare.prepare(asked, docs.limit(0), ratio=0.2)


def test_sampled_contexts(spark):
    rows = spark.createDataFrame([(f"context  {i // 2}\n", f"t{i}", f"q {i}", ["a ", "a"] if i else []) for i in range(10)], "context string, title string, question string, answers array<string>")
    got = datasets.sample_contexts(rows, 4, exclude=[])
    assert len({r["context"] for r in got.collect()}) == 4
    assert datasets.as_documents(got).where("text like 'context _'").count() == 4
    assert all(r["reference_answers"] == ["a"] for r in datasets.as_questions(got).collect())
    with pytest.raises(ValueError, match="fewer"):
        datasets.sample_contexts(rows, 9)


def test_settings(tmp_path):
    good = {"model_id": "org/small", "revision": "a" * 40}
    assert config.model_settings(good)["generation"] == {"max_new_tokens": 64, "do_sample": False}
    for bad in ({"revision": "main"}, {"trust_remote_code": True}, {"model_id": "org/Qwen3-4B"}, {"chat_template_kwargs": {"enable_thinking": True}}):
        with pytest.raises(ValueError):
            config.model_settings(good | bad)
    thinking = {"model_id": "org/Qwen3-4B", "chat_template_kwargs": {"enable_thinking": True}, "generation": {"do_sample": True, "temperature": 0.6, "max_new_tokens": 256}}
    assert config.model_settings(good | thinking)["thinking"]
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="mapping"):
        config.read_settings(tmp_path / "c.yaml")
    (tmp_path / "d.yaml").write_text("data: c.yaml\nother: none.yaml\n")
    assert config.read_settings(tmp_path / "d.yaml", ("data", "other", "absent")) == {"data": str(tmp_path / "c.yaml"), "other": "none.yaml"}
    assert config.differences({"a": {"b": 1, "c": 2}}, {"a": {"b": 1, "c": 3}, "d": 1}) == ["a.c", "d"]
    with pytest.raises(ValueError):
        config.judge_settings({"judge": {"kind": "openai-compatible", "minimum_metric_coverage": 2}})
    server = {"kind": "openai-compatible", "base_url": "http://x", "model": "m"}
    for bad in ({"max_retries": -1}, {"read_timeout_seconds": 0}, {"max_response_bytes": 1}, {"model": " "}, {"kind": "other"}, {"minimum_paired_examples": 0}):
        with pytest.raises(ValueError):
            config.judge_settings({"judge": server | bad})
    assert config.judge_settings({"judge": server | {"timeout_seconds": 5}})["read_timeout_seconds"] == 5.0
    names = lambda c: [type(x).__name__ for x in getattr(scoring.scorer_for(c), "scorers", [])]
    assert names({}) == ["Correctness", "Groundedness"] and names({"mode": "disabled"}) == [] and names({"lexical_groundedness": False, "citation_metrics": True}) == ["Correctness", "Citations"]
    with pytest.raises(ValueError):
        scoring.scorer_for({"lexical_groundedness": {"claim_support_threshold": 2}})


def make_adapter(folder, text="x", mode="sft", settings=None, library=None, **more):
    """An adapter as it is kept: weights, the library's configuration, and a manifest that fits both."""
    folder.mkdir()
    (folder / "weights").write_text(text)
    found = controls.controls(settings or {}, True)
    (folder / adapters.LIBRARY_FILE).write_text(json.dumps(controls.library_settings(found, "m", "a" * 40) | (library or {})))
    digest = lambda c: c * 64
    manifest = {"schema_name": "adapter", "schema_version": 3, "model": {"model_id": "m", "revision": "a" * 40}, "recipe": None, "adaptation_mode": mode, "training_prompt": prompts.identity(), "chat_template_kwargs": {}}
    manifest |= {k: digest("b") for k in ("training_dataset_fingerprint", "validation_dataset_fingerprint", "training_source_fingerprint", "validation_source_fingerprint", "held_out_evaluation_sha256", "training_configuration_sha256")}
    manifest |= {"training_controls": found, "training_control_sha256": controls.digest(found), "adapter_artifact_sha256": config.artifact_digest(folder), "best_checkpoint": None, "best_validation_metric": 0.5} | more
    (folder / adapters.MANIFEST).write_text(json.dumps(manifest))
    return folder


RUN = adapters.Run("m", "a" * 40, prompts.identity(), {}, "b" * 64)


def test_digest_of_a_folder(tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "b").write_bytes(b"two")
    (tmp_path / "sub/a").write_bytes(b"one")
    (tmp_path / "skipped").write_bytes(b"x")
    assert config.artifact_digest(tmp_path, ("skipped",)) == hashlib.sha256(b"b\0two" + b"sub/a\0one").hexdigest()


def test_adapters(tmp_path):
    one = adapters.verify(make_adapter(tmp_path / "one"), RUN, "sft")
    assert one.verified and one.status == "verified" and schemas.problems(one.as_dict(), schemas.PROVENANCE) == []
    cases = {
        "mismatch": [({"model": {"model_id": "n", "revision": "a" * 40}}, {}), ({"adaptation_mode": "raft"}, {}), ({"training_prompt": prompts.identity() | {"version": "9"}}, {}), ({"chat_template_kwargs": {"x": 1}}, {}), ({"held_out_evaluation_sha256": "c" * 64}, {}), ({}, {"base_model_name_or_path": "n"}), ({}, {"revision": "b" * 40})],
        "integrity": [({"training_control_sha256": "c" * 64}, {}), ({"adapter_artifact_sha256": "c" * 64}, {})],
        "manifest": [({"schema_version": 9}, {}), ({"more": 1}, {}), ({"training_controls": {"x": 1}}, {})],
        "config": [({}, {"r": 17}), ({}, {"lora_alpha": True}), ({}, {"target_modules": []}), ({}, {"bias": ""})],
    }
    for n, (kind, more, library) in enumerate((k, m, x) for k, rows in cases.items() for m, x in rows):
        with pytest.raises(adapters.AdapterError) as error:
            adapters.verify(make_adapter(tmp_path / f"bad{n}", library=library, **more), RUN, "sft", allow_unverified=True)
        assert error.value.kind == kind, (kind, more, library, str(error.value))


def test_adapters_without_a_full_manifest(tmp_path):
    bare = make_adapter(tmp_path / "bare")
    (bare / adapters.MANIFEST).unlink()
    with pytest.raises(adapters.AdapterError):
        adapters.verify(bare, RUN)
    assert adapters.verify(bare, RUN, allow_unverified=True).status == "legacy_manifest_unavailable"
    old = make_adapter(tmp_path / "old", schema_version=2)
    with pytest.raises(adapters.AdapterError, match="version 2"):
        adapters.verify(old, RUN)
    found = adapters.verify(old, RUN, allow_unverified=True)
    assert not found.verified and found.reason_code == "legacy_training_controls_unavailable" and found.warnings
    (old / "weights").write_text("changed")
    with pytest.raises(adapters.AdapterError, match="files"):
        adapters.verify(old, RUN, allow_unverified=True)


def test_the_gate_between_two_adapters(tmp_path):
    sft, raft = make_adapter(tmp_path / "sft"), make_adapter(tmp_path / "raft", "y", "raft")
    assert adapters.gate({"sft-rag": str(sft), "raft-rag": str(raft)}, RUN).controls_matched
    with pytest.raises(adapters.AdapterError, match="one adapter"):
        adapters.gate({"sft-rag": str(sft), "raft-rag": str(sft)}, RUN)
    with pytest.raises(adapters.AdapterError, match="same contents"):
        adapters.gate({"sft-rag": str(sft), "raft-rag": str(make_adapter(tmp_path / "same", mode="raft"))}, RUN)
    with pytest.raises(adapters.AdapterError, match="different questions"):
        adapters.gate({"sft-rag": str(sft), "raft-rag": str(make_adapter(tmp_path / "far", "z", "raft", training_source_fingerprint="d" * 64))}, RUN)
    longer = str(make_adapter(tmp_path / "longer", "w", "raft", {"num_train_epochs": 3}))
    with pytest.raises(adapters.AdapterError, match="num_train_epochs"):
        adapters.gate({"sft-rag": str(sft), "raft-rag": longer}, RUN)
    let = adapters.gate({"sft-rag": str(sft), "raft-rag": longer}, RUN, allow_unmatched=True)
    assert let.controls_matched is False and let.mismatches == ("optimization.num_train_epochs",) and let.warnings[0].startswith("Confounded")


def test_controls():
    found = controls.controls({"per_device_train_batch_size": 2, "target_modules": ["v", "q", "q"], "rank_pattern": {"b": 2, "a": 1}}, False)
    assert found["batching"]["effective_batch_size"] == 32 and found["adapter"]["target_modules"] == ["q", "v"] and list(found["adapter"]["rank_pattern"]) == ["a", "b"]
    assert found["checkpoint_selection"]["evaluation_strategy"] == "no" and found["checkpoint_selection"]["metric_for_best_model"] is None
    assert controls.controls({"load_in_4bit": False}, True)["quantization"] == {"load_in_4bit": False, "type": None, "double_quantization": None, "compute_dtype": None}
    assert not controls.controls({}, True)["checkpoint_selection"]["greater_is_better"]
    for bad in ({"method": "lora"}, {"bnb_4bit_compute_dtype": "int8"}, {"gradient_accumulation_steps": 0}, {"target_modules": " "}, {"rank_pattern": {"a": 0}}, {"layers_to_transform": [-1]}):
        with pytest.raises(ValueError):
            controls.controls(bad, True)
    wrong = found | {"batching": found["batching"] | {"effective_batch_size": 1}}
    with pytest.raises(ValueError, match="effective"):
        controls.check(wrong)
    assert controls.unequal(found, wrong) == ["batching.effective_batch_size"]


def test_command_line(spark, tmp_path, capsys):
    docs = lines(tmp_path / "d.jsonl", [{"id": "d1", "text": "alpha evidence"}, {"id": "d2", "text": "beta noise"}])
    asked = lines(tmp_path / "e.jsonl", [{"id": f"q{i}", "question": f"alpha {i}", "reference_answer": "a", "relevant_doc_ids": ["d1"]} for i in range(6)])
    assert cli.main(["validate-data", "--documents", docs, "--eval", asked]) == 0
    assert json.loads(capsys.readouterr().out) == {"documents": 2, "examples": 6}
    cli.main(["eval-retrieval", "--documents", docs, "--eval", asked, "--top-k", "1"])
    assert json.loads(capsys.readouterr().out)["recall_at_k"] == 1.0
    cli.main(["prepare-splits", "--qa", asked, "--ratio", "0.5", "--train-output", str(tmp_path / "t"), "--validation-output", str(tmp_path / "v")])
    assert json.loads(capsys.readouterr().out)["validation_rows"] == 3
    assert cli.main(["plan"]) == 0 and len(json.loads(capsys.readouterr().out)) == 4
    train = lines(tmp_path / "q.jsonl", [{"id": f"t{i}", "question": f"beta {i}", "reference_answer": "b", "relevant_doc_ids": [f"d{i % 2 + 1}"]} for i in range(6)])
    raft = ["prepare-raft", "--documents", docs, "--training-set", train, "--held-out-eval", asked, "--distractors", "1", "--output", str(tmp_path / "raft")]
    assert cli.main([*raft, "--validation-output", str(tmp_path / "raftv"), "--ratio", "0.5"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == {"train": 3, "validation": 3} and json.loads((tmp_path / "raft.manifest.json").read_text())["schema_version"] == 1
    assert spark.read.json(str(tmp_path / "raft")).first()["metadata"]["negative_mining"]["scope"] == "global"
    with pytest.raises(ValueError, match="validation output"):
        cli.main([*raft, "--policy", "document-disjoint"])
    (tmp_path / "m.yaml").write_text(f"model_id: m\nrevision: {'a' * 40}\n")
    common = ["benchmark", "--documents", docs, "--eval", asked, "--model", str(tmp_path / "m.yaml"), "--output", str(tmp_path / "bench")]
    assert cli.main([*common, "--plan-only", "--plan-output", str(tmp_path / "plan.json")]) == 0
    planned = json.loads(capsys.readouterr().out)
    assert planned == json.loads((tmp_path / "plan.json").read_text()) and planned["validation"]["validation_level"] == "structural" and len(planned["jobs"]) == 4
    assert cli.main([*common, "--dry-run", "--recipes", "base,rag"]) == 0 and json.loads(capsys.readouterr().out)["validation"]["ready_for_execution"]
    with pytest.raises(ValueError, match="without their adapter"):
        cli.main([*common, "--dry-run", "--recipes", "base,sft-rag"])
    with pytest.raises(ValueError, match="generator-url"):
        cli.main([*common, "--recipes", "base"])


def test_chat_servers(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quern.sources import http

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"correctness": 1, "groundedness": 0.5, "unsupported_claim_rate": 0}) if "response_format" in body else "42" * (10_000 if "much" in body["messages"][-1]["content"] else 1)
            self.send_response(200)
            self.end_headers()
            for part in (said[:3], said[3:]):
                self.wfile.write(("data: " + json.dumps({"choices": [{"delta": {"content": part}}]}) + "\n\n").encode())
            self.wfile.write(b"data: [DONE]\n\n")

        def log_message(self, *args): ...

    server = HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    try:
        assert http.generator(url, "m")()("what", ["one"]) == "42"
        assert scoring.checked_scores(http.judge(url, "m")(http.judge_prompt("q", "a", [], []))) == {"correctness": 1.0, "groundedness": 0.5, "unsupported_claim_rate": 0.0}
        with pytest.raises(ValueError, match="too large"):
            http.complete(url, {"model": "m", "messages": [{"role": "user", "content": "much"}]}, max_bytes=1000)
    finally:
        server.shutdown()
    assert http.parse_object('so {"a": 1}.') == {"a": 1}


def test_schemas():
    from quern.sources import schemas

    shape = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"$ref": "word"}}}}
    known = {"word": {"type": "string", "minLength": 2, "pattern": "^x"}}
    assert schemas.problems({"a": 1, "b": ["xy"]}, shape, known=known) == []
    assert schemas.problems({"a": True, "b": ["y", 3], "c": 0}, shape, known=known) == ["$.a: must be integer or null", "$.b.0: is too short", "$.b.0: doesn't match ^x", "$.b.1: must be string", "$.c: isn't allowed"]
    assert schemas.problems({"a": 0}, shape) == ["$.a: must be at least 1"] and schemas.problems({}, shape) == ["$.a: is missing"]
    with pytest.raises(ValueError, match="must be object"):
        schemas.require([], shape)


def test_tuning_rows(spark):
    rows = spark.createDataFrame([("a", "q?", "yes"), ("b", None, "no")], "id string, input string, output string")
    plain = {r["id"]: r for r in tuning.completions(rows, "sft", chat=False).collect()}
    assert plain["a"]["prompt"] == prompts.prompt_text("q?", []) + prompts.RESPONSE and plain["a"]["completion"] == "yes"

    class Template:
        eos = "</s>"

        def __call__(self, messages, **given):
            return f"<{messages[0]['role']}>{messages[0]['content']}{given}"

    chats = tuning.completions(rows, "sft", chat=True)
    said = tuning.render_chats(chats, Template, {"x": 1}).where("id = 'a'").first()
    assert said["prompt"].startswith("<user>### Instruction") and said["prompt"].endswith("{'x': 1}") and said["completion"] == "yes</s>"
    with pytest.raises(ValueError, match="empty completion"):
        tuning.completions(rows.withColumn("output", F.lit(" ")), "sft", chat=False)
    raft = spark.createDataFrame([("r", "q", "x", [("d", "the text", True)], ["d"])], "id string, question string, answer string, contexts array<struct<doc_id:string,text:string,relevant:boolean>>, evidence_doc_ids array<string>")
    assert "[Document 1]\nthe text" in tuning.completions(raft, "raft", chat=False).first()["prompt"]
    with pytest.raises(ValueError, match="evidence not in contexts"):
        tuning.completions(raft.withColumn("evidence_doc_ids", F.array(F.lit("z"))), "raft", chat=False)
    with pytest.raises(ValueError):
        tuning.require_chat_template({"use_chat_template": "yes"})
    tuning.require_chat_template({"use_chat_template": True})


def test_tracing_begins_once():
    begun = []
    call = tracking.traced(lambda: begun.append(1) or (lambda f: lambda x: f(x) + 1))(lambda x: x * 10)
    assert [call(1), call(2)] == [11, 21] and begun == [1]


def test_pinned_datasets(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/org/qa/{'c' * 40}")
    assert datasets.pinned(spark, str(tmp_path), "org/qa", "c" * 40).count() == 2
    with pytest.raises(ValueError, match="commit"):
        datasets.pinned(spark, str(tmp_path), "org/qa", "main")


def test_exact_percentiles(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    values = [rng.choice([1.0, 2.0, 2.5, rng.expovariate(1e-3), -rng.random()]) for _ in range(3000)]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("b", None), ("c", None)], "g string, v double")
    got = {(r["g"], r["q"]): r["p"] for r in measures.exact_percentiles(rows, ["g"], "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    assert got == {("a", i): pytest.approx(np.percentile(values, 100 * q)) for i, q in enumerate((0, 0.5, 0.95, 1))} | {("b", i): 7.0 for i in range(4)}


def test_special_tokens():
    from quern.functions.thinking import token_id

    class Tokenizer:
        def get_vocab(self):
            return {"</think>": 7}

        def convert_tokens_to_ids(self, token):
            return 8 if token == "<think>" else 0

        def convert_ids_to_tokens(self, i):
            return {8: "<think>", 0: "<unk>"}[i]

        def encode(self, token, add_special_tokens):
            return [3] if token == "one" else [1, 2]

    assert [token_id(Tokenizer(), t) for t in ("</think>", "<think>", "one", "many")] == [7, 8, 3, None]
