"""Quality of judgments: slices, coverage, drift, entity resolution, labels, reviews and their cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.inputs import spread


def rate(n: Column, of: Column) -> Column:
    """n / of as a double of 12 places; null when of is 0."""
    return F.round(n.cast("double") / F.when(of != 0, of), 12)


def slices(cases: DataFrame, dimensions: list[str], minimum: int) -> DataFrame:
    """Metrics of cases (variant, expected, observed, abstained, escalated, latency_ms, …dimensions) overall and by each dimension's values; memory_bytes (most) and reviewer_s (mean) where cases have them."""
    parts = F.array(F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("kind"), F.col(d).cast("string").alias("value")) for d in dimensions))
    spread = cases.withColumn("slice", F.explode(parts))
    right = F.coalesce((F.col("observed") == F.col("expected")).cast("int"), F.lit(0))
    return spread.groupBy("variant", F.col("slice.kind").alias("slice_kind"), F.col("slice.value").alias("slice_value")).agg(
        F.count("*").alias("support"),
        F.round(F.avg(right), 12).alias("quality"),
        F.round(F.avg(F.when(F.col("observed").isNotNull(), 1 - right)), 12).alias("false_trust"),
        F.round(F.avg(F.when(F.col("observed").isNotNull(), F.col("abstained").cast("int"))), 12).alias("abstention"),
        F.round(F.avg(F.col("escalated").cast("int")), 12).alias("escalation"),
        F.when(F.count("latency_ms") == F.count("*"), F.round(F.avg("latency_ms"), 6)).alias("latency_ms"),
        *([F.max("memory_bytes").alias("memory_bytes")] if "memory_bytes" in cases.columns else []),
        *([F.round(F.avg("reviewer_s"), 6).alias("reviewer_s")] if "reviewer_s" in cases.columns else []),
        (F.count("*") >= minimum).alias("supported"),
    )


def _located(candidates: DataFrame, positives: DataFrame, cap: int) -> DataFrame:
    """(source, query, rows, inside, found, places) of each query with positives: positives with each of their candidates, those within the cap, positives that are candidates at all, and the sum of normalised ranks. Both tables go through one shuffle, by query; nulls are nothing that matches."""
    c = candidates.where("source is not null and query is not null").select("source", "query", "item", "rank", F.lit(0).cast("bigint").alias("wanted"))
    p = positives.select("source", "query", "item", F.lit(None).cast("int").alias("rank"), F.lit(1).cast("bigint").alias("wanted"))
    rank = F.when(F.col("item").isNotNull(), F.col("rank"))
    items = spread(c.unionByName(p), "source", "query").groupBy("source", "query", "item").agg(
        F.sum("wanted").alias("wanted"), F.count(rank).alias("times"), F.count_if(rank <= cap).alias("within"), F.sum(rank).alias("ranks"), F.max("rank").alias("last"),
    )
    w, times, n = F.col("wanted"), F.col("times"), F.max("last")
    located = F.sum(F.when(times > 0, w * (F.col("ranks") - times)).otherwise(0))
    return items.groupBy("source", "query").agg(
        F.sum(w * F.greatest(times, F.lit(1))).alias("rows"), F.sum(w * F.col("within")).alias("inside"), F.sum(F.when(times > 0, w).otherwise(0)).alias("found"),
        (F.sum(F.when(times == 0, w).otherwise(0)) + F.when(n > 1, located / (n - 1)).otherwise(0.0)).alias("places"),
    ).where(F.col("rows") > 0)


def _by_source(located: DataFrame) -> DataFrame:
    n, inside = F.sum("rows"), F.sum("inside")
    return located.groupBy("source").agg(n.alias("positives"), inside.alias("in_bounded"), rate(inside, n).alias("coverage"), F.round(F.sum("places") / n, 12).alias("mean_rank"), F.sum("found").alias("in_candidates"))


def coverage(candidates: DataFrame, positives: DataFrame, cap: int) -> DataFrame:
    """By source: positives found within the first cap candidates, and their mean normalised rank; candidates (source, query, item, rank)."""
    return _by_source(_located(candidates, positives, cap)).drop("in_candidates")


def ordering_bias(coverage_: DataFrame) -> DataFrame:
    return coverage_.agg(F.count("*").alias("sources"), F.round(F.max("mean_rank") - F.min("mean_rank"), 12).alias("ordering_bias"), F.min("coverage").alias("least_coverage"))


def coverage_report(candidates: DataFrame, positives: DataFrame, cap: int) -> DataFrame:
    """One row of what the gates look at: positives, how many are candidates and how many within the cap, by-source extremes, bias, and whether ranks are 1 to n without gaps or ties."""
    per = _by_source(_located(candidates, positives, cap))
    shape = spread(candidates.select("source", "query", "rank"), "source", "query").groupBy("source", "query").agg((F.countDistinct("rank") == F.count("*")).alias("apart"), (F.min("rank") == 1).alias("first"), (F.max("rank") == F.count("*")).alias("whole"))
    ranks = shape.agg(F.coalesce(F.bool_and(F.col("apart") & F.col("first") & F.col("whole")), F.lit(False)).alias("contiguous"))
    total = per.agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"), F.coalesce(F.sum("in_bounded"), F.lit(0)).alias("in_bounded"), F.coalesce(F.sum("in_candidates"), F.lit(0)).alias("in_candidates"), F.min("positives").alias("least_support"), F.min("coverage").alias("least_coverage"), F.round(F.max("mean_rank") - F.min("mean_rank"), 12).alias("ordering_bias"))
    d = total.crossJoin(F.broadcast(ranks))  # one row each
    return d.withColumn("coverage", rate(F.col("in_bounded"), F.col("positives"))).withColumn("cap_excluded", F.col("in_candidates") - F.col("in_bounded")).withColumn("missed", F.col("positives") - F.col("in_candidates"))


def gate_failures(report: DataFrame, rule: dict[str, float]) -> DataFrame:
    """(nth, failure) of the seven gates, in order, that a coverage report fails."""
    c = F.col
    tests = [
        ("candidate_sql_not_bounded_prefix", ~c("contiguous")), ("positive_support_below_minimum", c("positives") < rule["support"]), ("source_support_below_minimum", c("least_support") < rule["source_support"]),
        ("overall_coverage_below_minimum", F.coalesce("coverage", F.lit(0.0)) < rule["coverage"]), ("source_coverage_below_minimum", c("least_coverage") < rule["source_coverage"]),
        ("cap_excluded_positive_pairs_exceeded", c("cap_excluded") > rule["cap_excluded"]), ("ordering_bias_exceeded", c("ordering_bias") > rule["bias"]),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("nth"), F.lit(name).alias("failure"), F.coalesce(test, F.lit(False)).alias("failed")) for k, (name, test) in enumerate(tests, 1)))
    return report.select(F.inline(F.filter(rows, lambda r: r["failed"]))).select("nth", "failure")


def qualification(runs: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(variant, runs, failed, qualified) of runs (variant, run, slice, …measures): every run must reach each threshold, overall and in every slice."""
    below = [F.coalesce(F.col(m) < least, F.lit(True)) for m, least in thresholds.items()]
    failed = reduce(lambda a, b: a | b, below)
    d = runs.groupBy("variant").agg(F.countDistinct("run").alias("runs"), F.count_if(failed).alias("failed"), F.bool_and(~failed).alias("qualified"))
    return d


#: Share of each part in a model's quality, of each part in its diagnostic quality, and of each fit in its resource fit.
QUALITY = dict(contract=0.13, entity_resolution=0.19, abstention=0.10, dirty_data=0.10, triage=0.08, numeric_evidence=0.05, extraction=0.08, policy_check=0.07, user_suite=0.03, row_watch=0.07, typed_action=0.04, materialization=0.04, confidence=0.02)
FITS = dict(artifact_gb=(0.4, 2.0), resident_gb=(0.3, 2.5), p95_ms=(0.2, 20000.0), active_params_b=(0.1, 3.0))
#: Verdicts from the best down: least values, and most values, of the measures that each asks for.
_TRUSTED = ({"schema_valid": 0.95, "contract": 0.95, "confidence": 0.95, "entity_accuracy": 0.8, "triage": 0.8, "extraction": 0.8, "policy_check": 0.8, "materialization": 0.95}, {"false_merge": 0.0, "hallucinated": 0.01})
VERDICTS = [
    ("default_candidate", {**_TRUSTED[0], "quality": 0.9}, _TRUSTED[1]), ("eligible_candidate", *_TRUSTED),
    ("triage_candidate", {"schema_valid": 0.5, "triage": 0.7, "confidence": 0.5}, {"false_merge": 0.0, "hallucinated": 0.01}),
    ("row_watch_candidate", {"row_watch": 0.7, "materialization": 0.5}, {}), ("hard_case_candidate", {"entity_resolution": 0.5, "schema_valid": 0.5}, {"false_merge": 0.0}),
    ("partial_candidate", {"schema_valid": 0.25}, {}), ("partial_candidate", {"materialization": 0.25}, {}), ("partial_candidate", {"row_watch": 0.25}, {}), ("diagnostic_only", {"diagnostic": 0.2}, {}),
]


def model_scores(models: DataFrame) -> DataFrame:
    """models (model, …measures of QUALITY, FITS and VERDICTS, complete, crashes) with quality, resource_fit, overall and verdict."""
    quality = reduce(lambda a, b: a + b, (F.col(k) * w for k, w in QUALITY.items()))
    fit = reduce(lambda a, b: a + b, (F.when(F.col(k) > 0, F.least(F.lit(1.0), F.lit(most) / F.col(k))).otherwise(0.0) * w for k, (w, most) in FITS.items()))
    d = models.withColumn("quality", F.round(quality, 9)).withColumn("resource_fit", F.round(fit, 9))
    d = d.withColumn("overall", F.round(F.col("quality") * (0.75 + 0.25 * F.col("resource_fit")), 9))
    verdict = F.when(~F.col("complete"), "not_supported").when(F.col("crashes") > 0, "unsafe_rejected")
    for name, least, most in VERDICTS:
        verdict = verdict.when(reduce(lambda a, b: a & b, [F.col(k) >= v for k, v in least.items()] + [F.col(k) <= v for k, v in most.items()]), name)
    return d.withColumn("verdict", verdict.when(F.col("schema_valid") > 0, "contract_blocked").otherwise("unusable"))


def entity_resolution(pairs: DataFrame) -> DataFrame:
    """(metric, numerator, denominator, rate) of pairs (expected, observed, in_candidates, escalated, reviewed, corrected, merge_ok).

    reviewed: what a reviewer answered; corrected: whether a correction was made of an answer; merge_ok: how a merge turned
    out. Each is null where nobody reported it, and counts only where somebody did.
    """
    truth, seen = F.col("expected") == "same_entity", F.coalesce("in_candidates", F.lit(False))
    definitions = [
        ("candidate_recall", truth & seen, truth),
        ("pair_classification", F.col("observed") == F.col("expected"), F.col("observed").isNotNull()),
        ("abstention", F.col("observed") == "unclear", F.col("observed").isNotNull()),
        ("escalation", F.col("escalated"), F.lit(True)),
        ("reported_reviewer_agreement", F.col("reviewed") == F.col("observed"), F.col("reviewed").isNotNull() & F.col("observed").isNotNull()),
        ("reported_correction", F.col("corrected"), F.col("corrected").isNotNull()),
        ("reported_downstream_merge_outcome", F.col("merge_ok"), F.col("merge_ok").isNotNull()),
        ("false_merge", ~truth & (F.col("observed") == "same_entity"), ~truth),
    ]
    one = pairs.agg(*(F.count_if(c & of).alias(f"n_{m}") for m, c, of in definitions), *(F.count_if(of).alias(f"d_{m}") for m, _, of in definitions))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("numerator"), F.col(f"d_{m}").alias("denominator")) for m, _, _ in definitions))
    return one.select(F.inline(rows)).withColumn("rate", rate(F.col("numerator"), F.col("denominator")))


def sampling_rule(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, rule, share, sampled): the rule of highest precedence that fits each case, and whether its hash falls into the rule's share.

    cases: (case_id, task, decision, has_action); rules: (rule, task, decision, action_free, share), nulls fit anything. A
    rule for cases without action comes before one for a decision, and that before one for a task alone. Rules are few.
    """
    r = rules.select(F.col("rule"), F.col("task").alias("r_task"), F.col("decision").alias("r_decision"), "action_free", "share")
    d = cases.join(F.broadcast(r), (F.coalesce("r_task", "task") == F.col("task")) & (F.coalesce("r_decision", "decision") == F.col("decision")) & (~F.coalesce("action_free", F.lit(False)) | ~F.col("has_action")))
    rank = F.when(F.col("action_free"), 0).when(F.col("r_decision").isNotNull(), 1).otherwise(2)
    best = d.groupBy("case_id").agg(F.min_by(F.struct("rule", "share"), F.struct(rank, "rule")).alias("b")).select("case_id", "b.*")
    return best.withColumn("sampled", F.conv(F.substring(F.sha2("case_id", 256), 1, 8), 16, 10).cast("bigint") < F.floor(F.col("share") * 2**32))


def drift(baseline: DataFrame, current: DataFrame, bucket: str) -> DataFrame:
    """Total-variation distance of two distributions of a column."""
    def shares(d: DataFrame, name: str) -> DataFrame:
        counts = d.groupBy(F.coalesce(F.col(bucket).cast("string"), F.lit("")).alias("bucket")).agg(F.count("*").alias("n"))
        return counts.select("bucket", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # one row a bucket

    both = shares(baseline, "p").join(shares(current, "q"), "bucket", "full")
    return both.agg(F.round(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2, 9).alias("distance"), F.count("*").alias("buckets"))


def drift_status(distance: Column, support: Column, minimum: int, limit: float) -> Column:
    return F.when(support < minimum, "insufficient_evidence").when(distance > limit, "drifted").otherwise("within_baseline")


def latest_review(reviews: DataFrame) -> DataFrame:
    """reviews (case_id, seq, outcome): the last one of each case."""
    return reviews.groupBy("case_id").agg(F.max_by("outcome", "seq").alias("outcome"))


def overturn(reviews: DataFrame) -> DataFrame:
    over = F.count_if(F.col("outcome").isin("reject", "correct"))
    return latest_review(reviews).agg(F.count("*").alias("reviewed"), over.alias("overturned"), rate(over, F.count("*")).alias("overturn_rate"))


def economics(cases: DataFrame, by: str, review_rate: float, compute_rate: float) -> DataFrame:
    """Cost of cases (reviewer_s, generate_ms, outcome) by group, known only where every part of it was measured."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    good = F.count_if(F.col("outcome").isin("accept", "correct"))
    d = cases.groupBy(by).agg(F.count("*").alias("cases"), good.alias("accepted"), (whole("reviewer_s") / 3600 * review_rate + whole("generate_ms") / 3.6e6 * compute_rate).alias("cost"))
    return d.withColumn("cost_per_accepted", F.round(F.col("cost") / F.when(F.col("accepted") > 0, F.col("accepted")), 9)).withColumn("cost", F.round("cost", 9))


def relative_delta(new: Column, old: Column) -> Column:
    return F.when((new == 0) & (old == 0), 0.0).when(old != 0, F.round((new - old) / old, 12))


def label_quality(labels: DataFrame) -> DataFrame:
    """labels (label_id, subject_id, source_hash, answer, supersedes) with why each is excluded: superseded, contradictory or nothing."""
    superseded = labels.where("supersedes is not null").select(F.col("supersedes").alias("label_id"), F.lit(True).alias("superseded")).distinct()
    d = labels.join(superseded, "label_id", "left")
    live = d.where("superseded is null").groupBy("subject_id", "source_hash").agg(F.countDistinct("answer").alias("answers"))
    d = d.join(live, ["subject_id", "source_hash"], "left")
    return d.select("label_id", F.when(F.col("superseded"), "superseded").when(F.col("answers") > 1, "contradictory").otherwise("none").alias("exclusion"))


def sampled(rows: DataFrame, key: Column, share: float) -> DataFrame:
    """A deterministic Bernoulli sample: rows whose hash, its first 32 bits, is below the share of 2**32."""
    return rows.where(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") < int(share * 2**32))


def shadow(baseline: DataFrame, candidate: DataFrame, minimum: int) -> DataFrame:
    """Whether a candidate may replace the baseline: (case_id, answer, correct) of each, on the same cases."""
    b = baseline.select("case_id", F.col("answer").alias("b"), F.col("correct").alias("bc"))
    c = candidate.select("case_id", F.col("answer").alias("c"), F.col("correct").alias("cc"))
    d = b.join(c, "case_id", "full").agg(
        F.count("*").alias("cases"), F.count_if(F.col("b").isNull() | F.col("c").isNull()).alias("unpaired"), F.count_if(F.col("b") == F.col("c")).alias("agree"),
        F.count_if(F.col("bc") & ~F.col("cc")).alias("lost"), F.count_if(~F.col("bc") & F.col("cc")).alias("won"),
    )
    return d.withColumn("promote", (F.col("cases") >= minimum) & (F.col("unpaired") == 0) & (F.col("won") >= F.col("lost")))


def scorecard(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted quality by model of results (model, …parts between 0 and 1), with the median and the 95th percentile of latency_ms."""
    means = results.groupBy("model").agg(F.count("*").alias("cases"), *(F.round(F.avg(p), 9).alias(p) for p in weights), F.expr("percentile_disc(0.5) within group (order by latency_ms)").cast("bigint").alias("p50_ms"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("bigint").alias("p95_ms"))
    total = sum(weights.values())
    quality = reduce(lambda a, b: a + b, (F.col(p) * (w / total) for p, w in weights.items()))
    return means.withColumn("quality", F.round(quality, 9))
