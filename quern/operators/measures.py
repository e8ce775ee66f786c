"""Aggregates of predictions: summaries, latencies, coverage, and paired comparisons with bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import keyed_seed
from quern.runtime import Stash

PAIRS = (("base", "rag"), ("rag", "sft-rag"), ("rag", "raft-rag"), ("sft-rag", "raft-rag"))


MAX_RESAMPLED = 5_000_000


def rate(tokens: Column, seconds: Column) -> Column:
    """Tokens a second over all rows with a positive latency: a ratio of sums, null if there are none."""
    timed = (seconds > 0) & tokens.isNotNull()
    return F.sum(F.when(timed, tokens)) / F.sum(F.when(timed, seconds))


def row_rate(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds)


def percentile_of(value: Column, q: float) -> Column:
    """The exact percentile, linear between ranks."""
    return F.percentile(value, F.lit(q))


def latency(end_to_end: Column, stages: Sequence[Column], retrieval: Column) -> Column:
    """Retrieval plus the end-to-end latency, or plus the stages that are known if that is null; null if none is."""
    known = F.filter(F.array(*stages), lambda x: x.isNotNull())
    summed = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b))
    return F.coalesce(end_to_end, summed) + retrieval


def recipe_summary(predictions: DataFrame, metrics: Sequence[str], by: str = "recipe") -> DataFrame:
    """One row for each recipe: examples, the means of the metrics, and the sums of the tokens (0 where unknown)."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in predictions.columns if c.endswith("_tokens")]
    return predictions.groupBy(by).agg(F.count("*").alias("examples"), *means, *sums)


EDGES = 64


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """(by, q, p): exact percentiles, linear between ranks; q is the place in ``qs``. Null and NaN values don't count.

    Equal values are counted together. Approximate quantiles cut a group into EDGES ranges, the ranges' counts say which
    of them hold the wanted ranks, and only those are put in order; so no task holds a group. The ranges only choose
    what is sorted: the result is exact whatever they are.
    """
    by = list(by)
    counts = Stash(rows.sparkSession).put(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    edges = counts.groupBy(*by).agg(F.percentile_approx("_v", F.array(*(F.lit(i / EDGES) for i in range(1, EDGES))), F.lit(1000)).alias("_edges"))
    placed = counts.join(edges, by).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    ranges = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
    order = Window.partitionBy(*by).orderBy("_range")  # at most EDGES rows each
    ranges = ranges.withColumns({"_before": F.sum("_in").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in"), "_all": F.sum("_in").over(Window.partitionBy(*by))})
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.lit(float(q)).alias("at")) for i, q in enumerate(qs))))
    ranks = ranges.select("*", asked.alias("_q")).select("*", F.col("_q.q").alias("q"), ((F.col("_all") - 1) * F.col("_q.at")).alias("_rank")).drop("_q")
    low, high = F.floor("_rank"), F.ceil("_rank")
    ranks = ranks.where((low < F.col("_before") + F.col("_in")) & (high >= F.col("_before")))
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = placed.join(ranks.select(*by, "_range").distinct(), [*by, "_range"], "left_semi").withColumn("_upto", F.sum("_n").over(inside))
    met = wanted.join(ranks, [*by, "_range"]).withColumns({"_end": F.col("_before") + F.col("_upto"), "_start": F.col("_before") + F.col("_upto") - F.col("_n")})
    value_at = lambda r: F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.col("_v")))
    out = met.groupBy(*by, "q", "_rank").agg(value_at(low).alias("_low"), value_at(high).alias("_high"))
    return out.select(*by, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_rank") - F.floor("_rank"))).alias("p"))


def _long(rows: DataFrame, keys: Sequence[str], names: Sequence[str], out: str) -> DataFrame:
    """(keys, out, v): one row for each of the named columns, whose values are numbers or null."""
    return rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in names))).alias("x")).select(*keys, F.col("x.n").alias(out), "x.v")


def stage_latencies(predictions: DataFrame, stages: Sequence[str], by: str = "recipe", retrieval: str | None = None) -> DataFrame:
    """Rows (by, stage, mean, p50, p95) over the rows where the stage is known; null where none is.

    The stage named ``retrieval`` counts only rows whose ``retrieval_used`` is true.
    """
    if retrieval:
        predictions = predictions.withColumn(retrieval, F.when(F.col("retrieval_used"), F.col(retrieval)))
    long = _long(predictions, [by], stages, "stage")
    means = long.groupBy(by, "stage").agg(F.round(F.avg("v"), 6).alias("mean"))
    found = exact_percentiles(long, (by, "stage"), "v", (0.5, 0.95)).groupBy(by, "stage").agg(*(F.round(F.max(F.when(F.col("q") == i, F.col("p"))), 6).alias(n) for i, n in enumerate(("p50", "p95"))))
    return means.join(found, [by, "stage"], "left")


def metric_means(scores: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Rows (by, metric, numeric, mean): one for each metric that has a value anywhere."""
    return _means(_long(scores, [by], metrics, "metric"), by)


#: Scores that are no metrics of their own. Fixed values.
NO_METRICS = ("exact_match", "token_f1", "latency_s", "end_to_end_latency_s", "tokens_per_second", "prompt_tokens", "output_tokens", "retrieval_latency_s", "judge_latency_s", "judge_attempts", "judge_cache_hit")


def score_means(predictions: DataFrame, scores: str = "scores", by: str = "recipe", skip: Sequence[str] = NO_METRICS) -> DataFrame:
    """metric_means of whatever metrics a map of scores holds, but for those to ``skip``; nobody needs to name them."""
    long = predictions.select(by, F.explode(scores).alias("metric", "v")).where(~F.col("metric").isin(list(skip)))
    return _means(long, by)


def _means(long: DataFrame, by: str) -> DataFrame:
    return long.where("v is not null").groupBy(by, "metric").agg(F.count("*").alias("numeric"), F.round(F.avg("v"), 6).alias("mean"))


#: The older names of six figures, which readers of summaries may still ask for. Fixed values.
ALIASES = {
    "latency_mean_s": "model_generate_latency_mean_s",
    "latency_p50_s": "model_generate_latency_p50_s",
    "latency_p95_s": "model_generate_latency_p95_s",
    "end_to_end_latency_p50_s": "inference_e2e_latency_p50_s",
    "end_to_end_latency_p95_s": "inference_e2e_latency_p95_s",
    "tokens_per_second": "output_tokens_per_model_generate_second",
}
STAGES = ("retrieval_latency_s", "prompt_build_latency_s", "chat_template_latency_s", "tokenization_latency_s", "device_transfer_latency_s", "model_generate_latency_s", "decode_latency_s", "inference_e2e_latency_s", "scoring_latency_s", "judge_latency_s")
TOKENS = ("prompt_tokens", "output_tokens", "reasoning_tokens", "answer_tokens")
JUDGED = ("judge_correctness", "judge_groundedness", "judge_unsupported_claim_rate")


def recipe_metrics(predictions: DataFrame, by: str = "recipe", first: str = "id") -> DataFrame:
    """One wide row for each recipe over prediction rows: examples, mean scores, token sums, rates, stage latencies, aliases.

    ``batch_size`` and ``generation_mode`` are those of the row that comes first by ``first``. Retrieval counts only where
    it was used. Stages and tokens that the rows don't have are null and 0.
    """
    wide = predictions.withColumns({c: F.lit(None).cast("double") for c in (*STAGES, *TOKENS) if c not in predictions.columns})
    out, said, spent = F.col("output_tokens"), F.col("prompt_tokens"), F.col("model_generate_latency_s")
    rows = wide.groupBy(by).agg(
        F.count("*").alias("examples"),
        *(F.round(F.avg(m), 6).alias(m) for m in ("exact_match", "token_f1")),
        F.round(rate(out, spent), 6).alias("output_tokens_per_model_generate_second"),
        F.round(rate(out + said, spent), 6).alias("total_tokens_per_model_generate_second"),
        *(F.min_by(c, first).alias(c) for c in ("batch_size", "generation_mode") if c in predictions.columns),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}_total") for c in TOKENS),
    )
    stages = stage_latencies(wide, STAGES, by, retrieval="retrieval_latency_s")
    parts = [F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"{s.removesuffix('_s')}_{m}_s") for s in STAGES for m in ("mean", "p50", "p95")]
    rows = rows.join(stages.groupBy(by).agg(*parts), by, "left")
    return rows.withColumns({old: F.col(new) for old, new in ALIASES.items()})


def judge_blocks(rows: DataFrame, by: str = "recipe", minimum: float = 0.8, hit: str = "judge_cache_hit") -> DataFrame:
    """Rows (by, metric, total, numeric, successes, failures, coverage, hits, misses, minimum_coverage, state) of the judge's metrics.

    A judge was asked where ``judge_status`` isn't null; the coverage of a metric is over all rows, null if none was asked.
    """
    if not 0 <= minimum <= 1:
        raise ValueError("the minimum coverage must be between 0 and 1")
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in JUDGED)))
    tried, ok, known = F.col("judge_status").isNotNull(), F.col("judge_status") == "ok", F.coalesce(F.col(hit), F.lit(False))
    long = rows.select(by, tried.alias("tried"), ok.alias("ok"), (tried & known).alias("hit"), metric.alias("x")).select(by, "tried", "ok", "hit", "x.*")
    out = long.groupBy(by, "metric").agg(F.count("*").alias("total"), F.count("v").alias("numeric"), F.count_if("tried").alias("attempted"), F.count_if("ok").alias("successes"), F.count_if("hit").alias("hits"))
    coverage = F.when(F.col("attempted") > 0, F.col("numeric") / F.col("total"))
    state = F.when(F.col("attempted") == 0, "not_applicable").when(coverage >= minimum, "ok").otherwise("insufficient_coverage")
    return out.select(by, "metric", "total", "numeric", "successes", (F.col("attempted") - F.col("successes")).alias("failures"), F.round(coverage, 6).alias("coverage"), "hits", (F.col("attempted") - F.col("hits")).alias("misses"), F.lit(minimum).alias("minimum_coverage"), state.alias("state"))


#: What the paired evaluation compares, and its settings. Fixed values.
CONDITION_METRICS = ("exact_match", "token_f1", "answer_containment")


def condition_summary(rows: DataFrame) -> DataFrame:
    """(model, condition): examples, mean scores and latency, token sums of a paired evaluation's rows."""
    means = [F.round(F.avg(m), 6).alias(m) for m in CONDITION_METRICS]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("output_tokens", "reasoning_tokens", "answer_tokens")]
    return rows.groupBy("model", "condition").agg(F.count("*").alias("examples"), *means, F.round(F.avg("model_generate_latency_s"), 6).alias("model_generate_latency_s_per_example"), *sums)


def condition_deltas(summary: DataFrame, base: str = "base", tuned: str = "tuned") -> DataFrame:
    """(condition, metric, base, tuned, delta) of a condition_summary."""
    long = _long(summary, ["model", "condition"], CONDITION_METRICS, "metric")
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("v")))
    both = long.groupBy("condition", "metric").agg(side(base).alias("base"), side(tuned).alias("tuned"))
    return both.withColumn("delta", F.round(F.col("tuned") - F.col("base"), 6))


def condition_pairs(rows: DataFrame, metrics: Sequence[str] = ("exact_match", "token_f1"), base: str = "base", tuned: str = "tuned") -> DataFrame:
    """The pairs of a paired evaluation in the form of ``paired``; the condition is the pair."""
    parts = [paired(rows.where(F.col("condition") == c), metrics, ((base, tuned),), by="model").withColumn("pair", F.lit(c)) for c in ("rag", "oracle")]
    return parts[0].unionByName(parts[1])


def judge_coverage(rows: DataFrame, by: str, status: str, hit: str | None = None, minimum: float = 0.8) -> DataFrame:
    """Rows (by, total, attempted, successes, failures, coverage, failure_rate, state): coverage is over all rows."""
    tried, ok = F.col(status).isNotNull(), F.col(status) == "ok"
    out = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(tried).alias("attempted"), F.count_if(ok).alias("successes"), *([F.count_if(F.col(hit)).alias("hits")] if hit else []))
    out = out.withColumn("failures", F.col("attempted") - F.col("successes"))
    coverage = F.when(F.col("attempted") > 0, F.col("successes") / F.col("total"))
    state = F.when(F.col("attempted") == 0, "not_applicable").when(coverage >= minimum, "ok").otherwise("insufficient_coverage")
    return out.withColumns({"coverage": F.round(coverage, 6), "failure_rate": F.round(F.when(F.col("attempted") > 0, F.col("failures") / F.col("attempted")), 6), "state": state})


def metric_of(predictions: DataFrame, metric: str) -> Column:
    """A metric's value: the column of that name, else what a map ``scores`` holds under it, else null."""
    values = [F.col(metric).cast("double")] if metric in predictions.columns else []
    values += [F.try_element_at("scores", F.lit(metric)).cast("double")] if "scores" in predictions.columns else []
    return F.coalesce(*values) if values else F.lit(None).cast("double")


def paired(predictions: DataFrame, metrics: Sequence[str], pairs: Sequence[tuple[str, str]] = PAIRS, by: str = "recipe") -> DataFrame:
    """Rows (pair, metric, id, delta, baseline, candidate): each example of both recipes of a pair, null where a value is missing."""
    predictions = predictions.withColumns({m: metric_of(predictions, m) for m in metrics})
    long = _long(predictions, [by, "id"], metrics, "metric")
    spark = predictions.sparkSession
    names = F.broadcast(spark.createDataFrame([(a, b, f"{a}->{b}") for a, b in pairs], "base string, cand string, pair string"))
    one = long.join(names, long[by] == F.col("base")).select("pair", "metric", "id", F.col("v").alias("baseline"))
    two = long.join(names, long[by] == F.col("cand")).select("pair", "metric", "id", F.col("v").alias("candidate"))
    both = one.join(two, ["pair", "metric", "id"], "full_outer")
    return both.withColumn("delta", F.col("candidate") - F.col("baseline"))


def unpaired_ids(predictions: DataFrame, pairs: Sequence[tuple[str, str]] = PAIRS, by: str = "recipe") -> DataFrame:
    """Rows (pair, id, n_baseline, n_candidate) of examples that aren't exactly once on both sides of a pair whose recipes ran."""
    counted = predictions.groupBy(by, "id").agg(F.count("*").alias("n"))
    spark = predictions.sparkSession
    ran = [r[0] for r in predictions.select(by).distinct().collect()]
    names = spark.createDataFrame([(a, b, f"{a}->{b}") for a, b in pairs if a in ran and b in ran], "base string, cand string, pair string")
    one = counted.join(F.broadcast(names), counted[by] == F.col("base")).select("pair", "id", F.col("n").alias("n_baseline"))
    two = counted.join(F.broadcast(names), counted[by] == F.col("cand")).select("pair", "id", F.col("n").alias("n_candidate"))
    both = one.join(two, ["pair", "id"], "full_outer").na.fill(0)
    return both.where("n_baseline <> 1 or n_candidate <> 1")


def paired_summary(deltas: DataFrame, minimum_coverage: float = 0.0, minimum_pairs: int = 1) -> DataFrame:
    """Rows (pair, metric, total, baseline_numeric, candidate_numeric, pairs, coverage, delta, eligible)."""
    n = F.count("delta")
    return deltas.groupBy("pair", "metric").agg(
        F.count("*").alias("total"),
        F.count("baseline").alias("baseline_numeric"),
        F.count("candidate").alias("candidate_numeric"),
        n.alias("pairs"),
        F.round(n / F.count("*"), 6).alias("coverage"),
        F.round(F.avg("delta"), 6).alias("delta"),
        ((n / F.count("*") >= minimum_coverage) & (n >= minimum_pairs)).alias("eligible"),
    )


PER_HASH = 5
"""Draws taken from one hash."""
DRAW_BITS = 48


def poisson_steps(bits: int = DRAW_BITS, most: int = 14) -> list[int]:
    """The numbers at which a uniform draw of so many bits counts one more, for a Poisson distribution of mean 1."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * (1 << bits)))
    return out


def bootstrap_hashed(deltas: DataFrame, samples: int = 1001, seed: int = 42) -> DataFrame:
    """Rows (pair, metric, ci95_low, ci95_high, excludes_zero): a percentile bootstrap in one pass over the rows.

    In each sample a row counts as often as a Poisson draw of mean 1 says, which is what drawing n of n rows comes to
    when there are many; the draws are hashes of seed, id and sample. So the rows stay where they are: a task adds up its
    own rows for all samples, and only those sums move. Sums are of whole billionths, the same in any order.
    """
    steps = np.array(poisson_steps(), np.int64)

    def add(batches):
        sums: dict[tuple[str, str], list[list[int]]] = {}
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            for pair, metric, id_, value in zip(*(batch.column(c).to_pylist() for c in ("pair", "metric", "id", "units"))):
                weights = known.get(id_)
                if weights is None:
                    if len(known) > 10_000:
                        known.clear()
                    digests = (hashlib.sha256(f"{seed}:{id_}:{h}".encode()).hexdigest() for h in range(-(-samples // PER_HASH)))
                    draws = [int(d[12 * k : 12 * k + 12], 16) for d in digests for k in range(PER_HASH)][:samples]
                    known[id_] = weights = np.searchsorted(steps, np.array(draws, np.int64), "right")
                held = sums.setdefault((pair, metric), [np.zeros(samples, np.int64), np.zeros(samples, object)])
                held[0] += weights
                held[1] += weights.astype(object) * value  # Python's own numbers, which don't overflow
        for (pair, metric), (n, units) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([pair] * samples), pa.array([metric] * samples), pa.array(np.arange(1, samples + 1), pa.int32()), pa.array(n), pa.array([Decimal(int(u)) for u in units], pa.decimal128(38, 0))], ["pair", "metric", "i", "n", "units"])

    kept = deltas.where("delta is not null").select("pair", "metric", F.col("id").cast("string").alias("id"), F.round(F.col("delta") * 1e9).cast("bigint").alias("units"))
    parts = kept.repartition("id").mapInArrow(add, "pair string, metric string, i int, n bigint, units decimal(38,0)")
    means = parts.groupBy("pair", "metric", "i").agg(F.try_divide(F.sum("units").cast("double"), F.sum("n") * F.lit(1e9)).alias("mean")).where("mean is not null")
    low, high = percentile_of(F.col("mean"), 0.025), percentile_of(F.col("mean"), 0.975)
    return means.groupBy("pair", "metric").agg(F.round(low, 6).alias("ci95_low"), F.round(high, 6).alias("ci95_high"), ((low > 0) | (high < 0)).alias("excludes_zero"))


def bootstrap_numpy(deltas: DataFrame, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """Rows (pair, metric, pairs, delta, ci95_low, ci95_high, excludes_zero) with draws of numpy's default generator.

    The seed of a pair and metric is the first 64 bits of the SHA-256 of seed:pair:metric; the rows are in the order
    of their ids. One task for each pair and metric, over one number a row, as the generator's stream can't be divided:
    more than MAX_RESAMPLED rows of one are refused; use bootstrap_hashed for them.
    """

    def resample(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("id")["delta"].to_numpy(np.float64)
        rng = np.random.default_rng(int(frame["seed"].iloc[0]))
        block = max(1, min(samples, 1_000_000 // len(values)))
        means = np.concatenate([values[rng.integers(0, len(values), size=(min(block, samples - at), len(values)))].mean(axis=1) for at in range(0, samples, block)])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"pair": [frame["pair"].iloc[0]], "metric": [frame["metric"].iloc[0]], "pairs": [len(values)], "delta": [values.mean()], "ci95_low": [low], "ci95_high": [high], "excludes_zero": [bool(low > 0 or high < 0)]})

    most = deltas.where("delta is not null").groupBy("pair", "metric").count().agg(F.max("count")).first()[0] or 0
    if most > MAX_RESAMPLED:
        raise ValueError(f"{most} pairs are too many for one task; use bootstrap_hashed")
    kept = deltas.where("delta is not null").select("pair", "metric", "id", "delta", keyed_seed(str(seed), F.col("pair"), F.col("metric")).cast("string").alias("seed"))
    return kept.groupBy("pair", "metric").applyInPandas(resample, "pair string, metric string, pairs bigint, delta double, ci95_low double, ci95_high double, excludes_zero boolean")


def decisions(summary: DataFrame, intervals: DataFrame, unverified: bool = False, controls_matched: bool | None = None) -> DataFrame:
    """The comparison matrix: summary and intervals with status, eligible and significant.

    An unverified adapter makes every pair with an adapted recipe undecidable; differing training controls make the
    pair of the two adapted recipes so, and that is said last.
    """
    rows = summary.join(intervals, ["pair", "metric"], "left")
    adapted = F.col("pair").contains("sft-rag") | F.col("pair").contains("raft-rag")
    confounded = (F.col("pair") == "sft-rag->raft-rag") & F.lit(controls_matched is False)
    status = F.when(confounded, "confounded_training_controls").when(adapted & F.lit(unverified), "unverified_adapter_provenance")
    status = status.when(~F.col("eligible") | (F.col("pairs") == 0), "insufficient_coverage").otherwise("ok")
    eligible = status == "ok"
    return rows.withColumns({"status": status, "eligible": eligible, "significant": eligible & F.coalesce("excludes_zero", F.lit(False))})
