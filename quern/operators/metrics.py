"""Retrieval, citation and action metrics, run summaries and failure attribution.

Hits: (case_code, rank, chunk_id); gold: (case_code, chunk_id, grade). Without
gold a metric is null, never 0. Duplicates of a list count at their first rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import tasks_for

ACTIONS, ACTUAL = ("ANSWER", "REFUSE", "CLARIFY"), ("ANSWER", "REFUSE", "CLARIFY", "ERROR")
METRICS = (
    "recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_5", "ndcg_at_10", "fact_coverage",
    "citation_precision", "citation_recall", "faithfulness_score", "answer_relevance_score", "completeness_score", "citation_entailment_score", "conflict_handling_score",
)


def gold(evidence: DataFrame) -> DataFrame:
    """(case_code, chunk_id, grade, fact_keys); evidence that is not mapped is an error when the rows are read."""
    chunk = F.when((F.col("mapping_status") == "MAPPED") & F.col("mapped_chunk_id").isNotNull(), F.col("mapped_chunk_id")).otherwise(F.raise_error(F.concat(F.lit("evidence without a chunk: "), F.col("case_code"))).cast("long"))
    return evidence.select("case_code", chunk.alias("chunk_id"), "relevance_grade", "fact_key").groupBy("case_code", "chunk_id").agg(F.max("relevance_grade").alias("grade"), F.array_sort(F.collect_set("fact_key")).alias("fact_keys"))


def first_ranks(hits: DataFrame) -> DataFrame:
    """Each chunk at its first place, places renumbered without the repeats."""
    once = hits.groupBy("case_code", "chunk_id").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("case_code").orderBy("rank")))


def ranking_metrics(cases: DataFrame, hits: DataFrame, gold_rows: DataFrame, ks=(1, 3, 5, 10), ndcg_ks=(5, 10)) -> DataFrame:
    """recall_at_k, reciprocal_rank and ndcg_at_k of every case of ``cases`` in one pass over the joined rows."""
    if any(k < 1 for k in (*ks, *ndcg_ks)):
        raise ValueError("k must be at least 1")
    gain = F.when(F.col("grade").isin(0, 1, 2, 3), F.pow(F.lit(2.0), F.col("grade")) - 1).otherwise(F.raise_error(F.lit("grade outside 0..3")).cast("double"))
    ideal_rank = F.row_number().over(Window.partitionBy("case_code").orderBy(F.desc("grade"), "chunk_id"))
    g = gold_rows.select("case_code", "chunk_id", "grade").withColumn("gain", gain).withColumn("ideal_rank", ideal_rank)
    joined = g.join(first_ranks(hits), ["case_code", "chunk_id"], "left")
    discount = lambda c: F.log2(F.col(c) + 1.0)
    aggs = [F.count("*").alias("n_gold")]
    aggs += [F.count(F.when(F.col("rank") <= k, 1)).alias(f"found_{k}") for k in ks]
    aggs.append(F.min("rank").alias("first"))
    for k in ndcg_ks:
        aggs += [F.sum(F.when(F.col("rank") <= k, F.col("gain") / discount("rank"))).alias(f"dcg_{k}"), F.sum(F.when(F.col("ideal_rank") <= k, F.col("gain") / discount("ideal_rank"))).alias(f"ideal_{k}")]
    out = cases.select("case_code").join(joined.groupBy("case_code").agg(*aggs), "case_code", "left")
    return out.select(
        "case_code",
        *[F.round(F.col(f"found_{k}") / F.col("n_gold"), 6).alias(f"recall_at_{k}") for k in ks],
        F.when(F.col("n_gold").isNotNull(), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6)).alias("reciprocal_rank"),
        *[F.when(F.col(f"ideal_{k}") > 0, F.round(F.coalesce(f"dcg_{k}", F.lit(0.0)) / F.col(f"ideal_{k}"), 6)).alias(f"ndcg_at_{k}") for k in ndcg_ks],
    )


def fact_coverage(cases: DataFrame, hits: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_code, fact_coverage): facts (case_code, chunk_id, fact_key) with a hit, of all; null without facts."""
    seen = hits.select("case_code", "chunk_id").distinct().withColumn("hit", F.lit(1))
    per = facts.join(seen, ["case_code", "chunk_id"], "left").groupBy("case_code").agg(F.countDistinct("fact_key").alias("n"), F.countDistinct(F.when(F.col("hit") == 1, F.col("fact_key"))).alias("c"))
    return cases.select("case_code").join(per, "case_code", "left").select("case_code", F.round(F.col("c") / F.nullif("n", F.lit(0)), 6).alias("fact_coverage"))


def citation_metrics(cases: DataFrame, cited: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """cited_count, gold_count, true_positives, citation_precision, citation_recall per case."""
    c = cited.select("case_code", "chunk_id").distinct().withColumn("cited", F.lit(1))
    g = gold_rows.select("case_code", "chunk_id").distinct().withColumn("gold", F.lit(1))
    per = c.join(g, ["case_code", "chunk_id"], "full").groupBy("case_code").agg(F.count("cited").alias("cited_count"), F.count("gold").alias("gold_count"), F.count(F.when(F.col("cited").isNotNull() & F.col("gold").isNotNull(), 1)).alias("true_positives"))
    out = cases.select("case_code").join(per, "case_code", "left").fillna(0, ["cited_count", "gold_count", "true_positives"])
    tp = F.col("true_positives")
    has_gold = F.col("gold_count") > 0
    return out.withColumns({"citation_precision": F.when(has_gold & (F.col("cited_count") > 0), F.round(tp / F.col("cited_count"), 6)), "citation_recall": F.when(has_gold, F.round(tp / F.col("gold_count"), 6))})


def confusion(results: DataFrame) -> DataFrame:
    """One row for each expected action with the counts of the four actual ones, zeros filled in."""
    labels = results.sparkSession.createDataFrame([(a,) for a in ACTIONS], "expected_action string")
    counted = results.groupBy("expected_action").pivot("actual_action", list(ACTUAL)).agg(F.count(F.lit(1)))
    return labels.join(counted, "expected_action", "left").fillna(0)


def action_metrics(results: DataFrame) -> DataFrame:
    """Per action: support, predicted, true_positives, precision, recall, f1; 0 on a zero denominator."""
    both = results.select(F.explode(F.array(F.struct(F.col("expected_action").alias("action"), F.lit(1).alias("e"), F.lit(0).alias("p"), (F.col("expected_action") == F.col("actual_action")).cast("int").alias("t")), F.struct(F.col("actual_action").alias("action"), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    per = both.where(F.col("action").isin(*ACTIONS)).groupBy("action").agg(F.sum("e").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("true_positives"))
    labels = results.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    out = labels.join(per, "action", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = ratio("true_positives", "predicted"), ratio("true_positives", "support")
    return out.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6)})


def action_accuracy(results: DataFrame) -> DataFrame:
    right = (F.col("expected_action") == F.col("actual_action")).cast("int")
    return results.agg(F.count("*").alias("total"), F.sum(right).alias("correct"), F.round(F.coalesce(F.avg(right), F.lit(0.0)), 6).alias("accuracy"), F.count(F.when(F.col("actual_action") == "ERROR", 1)).alias("errors"))


def case_metrics(cases: DataFrame, hits: DataFrame, gold_rows: DataFrame, facts: DataFrame, cited: DataFrame) -> DataFrame:
    """All metrics of every case, one row each; cases: (case_code, expected_action, actual_action)."""
    parts = [ranking_metrics(cases, hits, gold_rows), fact_coverage(cases, hits, facts), citation_metrics(cases, cited, gold_rows)]
    right = F.when(F.col("expected_action").isNotNull() & F.col("actual_action").isNotNull(), (F.col("expected_action") == F.col("actual_action")).cast("int")).alias("action_correct")
    return reduce(lambda a, b: a.join(b, "case_code"), parts, cases.select("case_code", right))


def run_summary(results: DataFrame, metrics=METRICS) -> DataFrame:
    """One row over all results and one for each case type (grouping sets): counts, null-skipping means,
    judge rate, exact latency percentiles."""
    have = [m for m in metrics if m in results.columns]
    typed = results.withColumn("case_type", F.coalesce("case_type", F.lit("UNKNOWN")))
    return typed.rollup("case_type").agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("status") == "SUCCESS", 1)).alias("completed"),
        F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"),
        F.count(F.when(F.col("actual_action") == "ERROR", 1)).alias("errors"),
        *[F.round(F.avg(m), 6).alias(m) for m in have],
        F.count("judge_passed").alias("judged"),
        F.round(F.avg(F.col("judge_passed").cast("int")), 6).alias("judge_pass_rate"),
        F.round(F.percentile("latency_ms", F.lit(0.5)), 6).alias("latency_p50"),
        F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias("latency_p95"),
    )


def slices(cases: DataFrame) -> DataFrame:
    """(slice, value, total, passed, judge_pass_rate, recall_at_10, fact_coverage) by case_type and by difficulty."""
    pairs = F.array(*[F.struct(F.lit(c).alias("slice"), F.coalesce(F.col(c), F.lit("UNKNOWN")).alias("value")) for c in ("case_type", "difficulty")])
    return cases.withColumn("s", F.explode(pairs)).groupBy("s.slice", "s.value").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("primary_code") == "PASS", 1)).alias("passed"), F.round(F.avg(F.col("judge_passed").cast("int")), 6).alias("judge_pass_rate"), F.round(F.avg("recall_at_10"), 6).alias("recall_at_10"), F.round(F.avg("fact_coverage"), 6).alias("fact_coverage")
    )


def stage_coverage(cases: DataFrame, hits: DataFrame, facts: DataFrame, rows: int = 0) -> DataFrame:
    """Per case: coverage and missing facts after merging, reranking and packing; null coverage without facts.

    hits: (case_code, channel, chunk_id); facts: (case_code, chunk_id, fact_key). A chunk's stages are three flags, so
    that no list is built below a case; ``rows``, about how many hits there are, bounds what one task holds."""
    channel = F.upper(F.coalesce("channel", F.lit("")))
    stages = ("merged", "rerank", "final")
    of = {"rerank": channel == "RERANK", "final": channel == "FINAL", "merged": ~channel.isin("RERANK", "FINAL")}
    any_of = [F.max(s).alias(s) for s in stages]
    n, keys = tasks_for(hits.sparkSession, rows), ("case_code", "chunk_id")
    seen = hits.where("chunk_id is not null").select(*keys, *[of[s].alias(s) for s in stages]).repartition(n, *keys).groupBy(*keys).agg(*any_of)
    found = facts.where("fact_key is not null").select(*keys, "fact_key").repartition(n, *keys).join(seen, list(keys), "left")
    all_facts = found.repartition(n, "case_code").groupBy("case_code", "fact_key").agg(*any_of)  # both groupings are made where a case's rows are
    has = lambda s: F.coalesce(s, F.lit(False))
    per = all_facts.groupBy("case_code").agg(*[F.round(F.avg(has(s).cast("int")), 6).alias(s) for s in stages], *[F.array_sort(F.collect_set(F.when(~has(s), F.col("fact_key")))).alias(f"missing_{s}") for s in stages])
    return cases.select("case_code").join(per, "case_code", "left")


def attribute(cases: DataFrame, coverage: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``cases`` with primary_code, the first failure from upstream on, and secondary_codes."""
    j = cases.join(coverage, "case_code", "left")
    c = F.col
    below = lambda col: F.coalesce(c(col) < threshold, F.lit(False))
    judged = F.coalesce(c("judge_passed").cast("int") == 1, F.lit(False))
    secondary = F.array_compact(F.array(
        F.when(F.coalesce(c("citation_recall") < 1, F.lit(False)) | below("citation_entailment_score"), "CITATION_FAILURE"),
        F.when(below("completeness_score"), "ANSWER_INCOMPLETE"),
        F.when(below("faithfulness_score"), "ANSWER_UNFAITHFUL"),
        F.when(below("answer_relevance_score"), "ANSWER_IRRELEVANT"),
        F.when((c("case_type") == "CONFLICT") & below("conflict_handling_score"), "CONFLICT_HANDLING_FAILURE"),
    ))
    is_ = lambda col, value: F.coalesce(c(col) == value, F.lit(False))
    less = lambda a, b: F.coalesce(c(a) < c(b), F.lit(False))
    refuse, clarify = is_("expected_action", "REFUSE"), is_("expected_action", "CLARIFY")
    code = (
        F.when(is_("status", "FAILED") | is_("actual_action", "ERROR"), "EXECUTION_ERROR")
        .when(refuse & ~is_("actual_action", "REFUSE"), F.when(is_("actual_action", "ANSWER"), "FALSE_ANSWER").otherwise("ACTION_MISMATCH"))
        .when(refuse, F.when(judged, "PASS").otherwise("REFUSAL_QUALITY_FAILURE"))
        .when(clarify & ~is_("actual_action", "CLARIFY"), "CLARIFICATION_NOT_SUPPORTED")
        .when(clarify, F.when(judged, "PASS").otherwise("CLARIFICATION_QUALITY_FAILURE"))
        .when(is_("merged", 0.0), "RETRIEVAL_MISS")
        .when(c("merged") < 1, "RETRIEVAL_PARTIAL")
        .when(is_("rerank", 0.0), "RERANK_DROPPED")
        .when(less("rerank", "merged"), "RERANK_PARTIAL_DROP")
        .when(is_("final", 0.0), "CONTEXT_DROPPED")
        .when(less("final", "rerank"), "CONTEXT_PARTIAL_DROP")
        .when(is_("actual_action", "REFUSE"), "FALSE_REFUSAL")
        .when(~is_("actual_action", "ANSWER"), "ACTION_MISMATCH")
        .when(F.size("secondary") > 0, c("secondary")[0])
        .when(c("judge_passed").isNull(), "JUDGE_MISSING")
        .when(~judged, "ANSWER_QUALITY_FAILURE")
        .otherwise("PASS")
    )
    out = j.withColumn("secondary", secondary).withColumn("primary_code", code)
    return out.withColumn("secondary_codes", F.array_remove("secondary", F.col("primary_code"))).drop("secondary")


def attribution_summary(attributed: DataFrame) -> DataFrame:
    """(code, n, share, priority): the failures ranked by how many, then by code; PASS has no rank."""
    per = attributed.groupBy(F.col("primary_code").alias("code")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    failures = per.where("code <> 'PASS'").withColumn("priority", F.row_number().over(Window.orderBy(F.desc("n"), "code")))
    return per.crossJoin(F.broadcast(total)).join(failures.select("code", "priority"), "code", "left").select("code", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "priority")


def overview(attributed: DataFrame) -> DataFrame:
    return attributed.agg(
        F.count("*").alias("total"), F.count(F.when(F.col("primary_code") == "PASS", 1)).alias("passed"), F.round(F.avg((F.col("primary_code") == "PASS").cast("int")), 6).alias("pass_rate"), F.round(F.avg(F.col("judge_passed").cast("int")), 6).alias("judge_pass_rate"),
        *[F.round(F.avg(s), 6).alias(f"{s}_coverage") for s in ("merged", "rerank", "final")],
    )


def domain_diagnostics(cases: DataFrame, chunks: DataFrame, gold_chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(domain, n_cases, n_chunks, n_gold_chunks) of all domains, the null one kept, and the run's n_hits."""
    a = cases.groupBy("business_domain").agg(F.count("*").alias("n_cases"))
    b = chunks.where("status = 'ACTIVE'").groupBy("business_domain").agg(F.count("*").alias("n_chunks"))
    g = gold_chunks.select("chunk_id").distinct().join(chunks.select("chunk_id", "business_domain"), "chunk_id", "left").groupBy("business_domain").agg(F.count("*").alias("n_gold_chunks"))
    tagged = lambda df, n: df.select("business_domain", *[(F.col(n) if c == n else F.lit(0).cast("long")).alias(c) for c in ("n_cases", "n_chunks", "n_gold_chunks")])
    out = tagged(a, "n_cases").unionByName(tagged(b, "n_chunks")).unionByName(tagged(g, "n_gold_chunks")).groupBy(F.col("business_domain").alias("domain")).agg(*[F.sum(c).alias(c) for c in ("n_cases", "n_chunks", "n_gold_chunks")])
    return out.crossJoin(F.broadcast(hits.agg(F.count("*").alias("n_hits"))))


def domain_mismatch(diagnostics: DataFrame) -> DataFrame:
    """One row: whether no hit came back and no domain has both cases and chunks."""
    both = F.sum(((F.col("n_cases") > 0) & (F.col("n_chunks") > 0)).cast("int"))
    return diagnostics.agg(((F.coalesce(F.max("n_hits"), F.lit(0)) == 0) & (F.coalesce(both, F.lit(0)) == 0)).alias("mismatch"))


def task_summary(state: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document: how many tasks in each status, and whether all expected ones succeeded."""
    names = ("PENDING", "PROCESSING", "SUCCESS", "FAILED")
    per = state.groupBy("doc_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in names])
    out = expected.join(per, "doc_id", "left").fillna(0)
    return out.withColumn("all_succeeded", (F.col("success") == F.col("expected")) & (F.col("pending") + F.col("processing") + F.col("failed") == 0))


def rerank_features(results: DataFrame, hits: DataFrame) -> DataFrame:
    r = hits.where("channel = 'RERANK'").groupBy("case_code").agg(F.max(F.when(F.col("rank_no") == 1, F.col("rerank_score"))).alias("top1"), F.avg(F.when(F.col("rank_no") <= 3, F.col("rerank_score"))).alias("top3_mean"))
    return results.select("case_code", "fact_coverage").join(r, "case_code", "left")


def calibrate(rows: DataFrame, split: str, grid1=tuple(range(45, 76, 5)), grid3=tuple(range(40, 71, 5))) -> DataFrame:
    """The best pair of thresholds of a fixed grid (in hundredths), one row; the test split is refused."""
    if split.strip().lower() not in ("development", "validation"):
        raise ValueError("thresholds are calibrated on development or validation only")
    grid = F.array(*[F.struct(F.lit(a / 100).alias("t1"), F.lit(b / 100).alias("t3")) for a in grid1 for b in grid3])
    usable = rows.where("top1 is not null and top3_mean is not null and fact_coverage is not null")
    failed = F.col("fact_coverage") < 1
    hit = (F.col("top1") < F.col("g.t1")) & (F.col("top3_mean") < F.col("g.t3"))
    per = usable.withColumn("g", F.explode(grid)).groupBy("g.t1", "g.t3").agg(
        F.count("*").alias("n"), F.sum(failed.cast("int")).alias("failures"), F.sum((failed & hit).cast("int")).alias("found"), F.sum((~failed & hit).cast("int")).alias("false_hits"), F.sum(hit.cast("int")).alias("hits")
    )
    recall = F.col("found") / F.nullif("failures", F.lit(0))
    false_rate = F.coalesce(F.col("false_hits") / F.nullif(F.col("n") - F.col("failures"), F.lit(0)), F.lit(0.0))
    scored = per.withColumns({"failure_recall": F.round(recall, 6), "false_trigger_rate": F.round(false_rate, 6), "trigger_rate": F.round(F.col("hits") / F.col("n"), 6), "objective": F.round(recall - 0.35 * false_rate - 0.05 * F.col("hits") / F.col("n"), 6)})
    return scored.where("failures > 0").orderBy(F.desc("objective"), "false_trigger_rate", "trigger_rate", "t1", "t3").limit(1).select(F.col("t1").alias("top1_threshold"), F.col("t3").alias("top3_threshold"), "failure_recall", "false_trigger_rate", "trigger_rate", "objective", F.col("n").alias("case_count"))


SCORES = ("faithfulness_score", "answer_relevance_score", "completeness_score", "citation_entailment_score", "conflict_handling_score")


def _applicable() -> Column:
    four = F.array(*SCORES[:4])
    wanted = F.when(F.col("expected_action") != "ANSWER", F.array().cast("array<double>")).when(F.col("case_type") == "CONFLICT", F.array(*SCORES)).otherwise(four)
    return F.array_compact(wanted)


def judge_final(cases: DataFrame, reviews: DataFrame, threshold: float = 0.8, margin: float = 0.05) -> DataFrame:
    """(case_code, scores, refusal_correct, clarification_correct, borderline, passed).

    reviews: (case_code, review_no 1 or 2, the five scores, refusal_correct, clarification_correct, passed). A
    case whose first scores lie within the margin of the threshold is averaged with its second review."""
    one = cases.join(reviews.where("review_no = 1").drop("review_no"), "case_code")
    two = reviews.where("review_no = 2").select("case_code", *[F.col(c).alias(f"{c}_2") for c in (*SCORES, "refusal_correct", "clarification_correct", "passed")])
    near = F.exists(_applicable(), lambda s: F.round(F.abs(s - threshold), 9) <= margin)
    j = one.withColumn("borderline", near).join(two, "case_code", "left")
    second = F.col("borderline") & F.col("passed_2").isNotNull()
    mean = lambda c: F.when(second, F.when(F.col(c).isNull(), F.col(f"{c}_2")).when(F.col(f"{c}_2").isNull(), F.col(c)).otherwise(F.round((F.col(c) + F.col(f"{c}_2")) / 2, 4))).otherwise(F.col(c))
    agreed = lambda c: F.when(second & ~F.col(c).eqNullSafe(F.col(f"{c}_2")), F.lit(False)).otherwise(F.col(c))
    j = j.withColumns({c: mean(c) for c in SCORES} | {c: agreed(c) for c in ("refusal_correct", "clarification_correct")})
    own = _applicable()
    needed = F.when(F.col("case_type") == "CONFLICT", 5).otherwise(4)
    direct = F.when(F.col("expected_action") == "REFUSE", F.coalesce("refusal_correct", F.lit(False))).when(F.col("expected_action") == "CLARIFY", F.coalesce("clarification_correct", F.lit(False))).otherwise((F.size(own) == needed) & F.forall(own, lambda s: s >= threshold))
    passed = F.when(second, F.col("passed") & F.col("passed_2")).otherwise(direct)
    return j.select("case_code", *SCORES, "refusal_correct", "clarification_correct", "borderline", passed.alias("passed"))


def review_score(reviews: DataFrame) -> DataFrame:
    """A case review's score, the mean of five terms, and whether it passes."""
    yes = lambda c: F.col(c).cast("double")
    total = yes("expected_action_correct") + yes("reference_answer_supported") + yes("evidence_complete") + (1 - F.col("ambiguity_score")) + (1 - yes("semantic_duplicate"))
    passed = F.col("expected_action_correct") & F.col("reference_answer_supported") & F.col("evidence_complete") & (F.col("ambiguity_score") <= 0.15) & ~F.col("semantic_duplicate")
    return reviews.withColumns({"score": F.round(total / 5, 4), "passed": passed})


def document_review_passed(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("passed", F.expr("fact_coverage >= 1 and identifier_accuracy >= 1 and internal_consistency >= 0.90 and structure_score >= 0.85 and overall_score >= 0.88"))


def dataset_counts(registry: DataFrame, documents: DataFrame, cases: DataFrame) -> DataFrame:
    d = documents.groupBy("dataset_id").agg(F.count("*").alias("n_documents"))
    c = cases.groupBy("dataset_id").agg(F.count("*").alias("n_cases"))
    return registry.select("dataset_id").join(d, "dataset_id", "left").join(c, "dataset_id", "left").fillna(0)
