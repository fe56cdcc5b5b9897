"""Paired experiments: comparisons, outcomes, strategies, chains, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_match, stable_side
from .order import numbered_globally

METRICS = ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_5", "ndcg_at_10", "fact_coverage")
EPSILON = 1e-9
CHAIN_RATES = ("first_hop_hit", "fact_extracted", "supporting_chunk_right", "alias_matched", "fact_injected", "second_hop_hit", "end_to_end", "action_correct", "plan_match")


def pair(control: DataFrame, treatment: DataFrame, keep: tuple[str, ...] = ("case_type",)) -> DataFrame:
    """One row per case that both sides have: keep columns, and c_ and t_ columns of the sides."""
    shared = [c for c in control.columns if c in treatment.columns and c not in ("case_code", *keep)]
    c = control.select("case_code", *keep, *[F.col(x).alias(f"c_{x}") for x in shared])
    return c.join(treatment.select("case_code", *[F.col(x).alias(f"t_{x}") for x in shared]), "case_code")


def deltas(pairs: DataFrame, metrics=METRICS) -> DataFrame:
    """(case_code, case_type, metric, control, treatment, delta); a null metric counts as 0."""
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v(f"c_{m}").alias("control"), v(f"t_{m}").alias("treatment")) for m in metrics])
    return pairs.select("case_code", "case_type", F.explode(rows).alias("m")).select("case_code", "case_type", "m.*").withColumn("delta", F.round(F.col("treatment") - F.col("control"), 6))


def compare(pairs: DataFrame, metrics=METRICS, by: tuple[str, ...] = ()) -> DataFrame:
    """Per metric (and ``by``): means, delta of means, improved, regressed, unchanged, fully covered on each side."""
    full = lambda c: F.count(F.when(F.col(c) >= 1 - EPSILON, 1))
    return deltas(pairs, metrics).groupBy(*by, "metric").agg(
        F.count("*").alias("cases"), F.round(F.avg("control"), 6).alias("control"), F.round(F.avg("treatment"), 6).alias("treatment"), F.round(F.avg("treatment") - F.avg("control"), 6).alias("delta"),
        F.count(F.when(F.col("delta") > EPSILON, 1)).alias("improved"), F.count(F.when(F.col("delta") < -EPSILON, 1)).alias("regressed"), F.count(F.when(F.abs("delta") <= EPSILON, 1)).alias("unchanged"),
        full("control").alias("control_full"), full("treatment").alias("treatment_full"),
    )


def latency(pairs: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    p = lambda c, q: F.percentile(c, F.lit(q))
    return pairs.agg(
        F.count("*").alias("cases"), r(F.avg("c_latency_ms")).alias("control_mean"), r(F.avg("t_latency_ms")).alias("treatment_mean"), r(F.avg("t_latency_ms") - F.avg("c_latency_ms")).alias("mean_delta"),
        r(p("c_latency_ms", 0.5)).alias("control_p50"), r(p("t_latency_ms", 0.5)).alias("treatment_p50"), r(p("c_latency_ms", 0.95)).alias("control_p95"), r(p("t_latency_ms", 0.95)).alias("treatment_p95"),
        r(p("t_latency_ms", 0.95) - p("c_latency_ms", 0.95)).alias("p95_delta"),
    )


def triggers(pairs: DataFrame) -> DataFrame:
    """How many cases took a second round, and how many began from the same plan."""
    return pairs.agg(F.count("*").alias("cases"), F.count(F.when(F.col("t_retrieval_rounds") > 1, 1)).alias("triggered"), F.round(F.coalesce(F.avg((F.col("t_retrieval_rounds") > 1).cast("int")), F.lit(0.0)), 6).alias("trigger_rate"), F.round(F.coalesce(F.avg(F.coalesce("plan_match", F.lit(False)).cast("int")), F.lit(0.0)), 6).alias("plan_match_rate"))


def by_strategy(pairs: DataFrame, metric: str = "fact_coverage") -> DataFrame:
    """Per strategy of triggered cases: occurrences, and distinct cases improved, regressed, unchanged."""
    hit = pairs.where("t_retrieval_rounds > 1")
    d = F.round(F.coalesce(F.col(f"t_{metric}"), F.lit(0.0)) - F.coalesce(F.col(f"c_{metric}"), F.lit(0.0)), 6)
    rows = hit.select("case_code", d.alias("delta"), F.explode("t_retry_strategies").alias("strategy"))
    one = lambda rule: F.countDistinct(F.when(rule, F.col("case_code")))
    return rows.groupBy("strategy").agg(F.count("*").alias("occurrences"), F.countDistinct("case_code").alias("cases"), one(F.col("delta") > EPSILON).alias("improved"), one(F.col("delta") < -EPSILON).alias("regressed"), one(F.abs("delta") <= EPSILON).alias("unchanged"))


def compare_decomposition(pairs: DataFrame) -> DataFrame:
    """Two rows, all cases and those decomposed: sub-query means, coverage, fully covered cases, coverage gain."""
    scope = F.explode(F.when(F.coalesce("t_decomposed", F.lit(False)), F.array(F.lit("all"), F.lit("triggered"))).otherwise(F.array(F.lit("all")))).alias("scope")
    gain = F.coalesce("t_fact_coverage", F.lit(0.0)) - F.coalesce("c_fact_coverage", F.lit(0.0))
    return pairs.select(scope, "*").groupBy("scope").agg(
        F.count("*").alias("cases"), F.round(F.avg("t_sub_queries"), 6).alias("mean_sub_queries"), F.round(F.avg("t_coverage_rate"), 6).alias("mean_coverage"), F.count(F.when(F.col("t_coverage_rate") >= 1 - EPSILON, 1)).alias("fully_covered"), F.round(F.avg(gain), 6).alias("fact_coverage_delta")
    )


def compare_two_hop(chains: DataFrame, rates=CHAIN_RATES) -> DataFrame:
    """The rates of all chains and of each chain type."""
    return chains.withColumn("chain_type", F.coalesce("chain_type", F.lit("UNKNOWN"))).rollup("chain_type").agg(F.count("*").alias("cases"), *[F.round(F.avg(F.col(r).cast("int")), 6).alias(r) for r in rates])


def chain_flags(workflows: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Per case whether each hop's gold was hit, the fact was found in a gold chunk, fits an alias and is in the query.

    workflows: (case_code, intermediate_fact, supporting_chunk_id, second_query, aliases); hits and gold:
    (case_code, hop, chunk_id)."""
    found = gold.join(hits.select("case_code", "hop", "chunk_id").distinct(), ["case_code", "hop", "chunk_id"]).groupBy("case_code").agg(F.max((F.col("hop") == 1).cast("int")).alias("h1"), F.max((F.col("hop") == 2).cast("int")).alias("h2"))
    support = workflows.join(gold.where("hop = 1").select("case_code", F.col("chunk_id").alias("supporting_chunk_id")), ["case_code", "supporting_chunk_id"], "left_semi").select("case_code").withColumn("s", F.lit(True))
    j = workflows.join(found, "case_code", "left").join(support, "case_code", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "first_hop_hit": yes(F.col("h1") == 1), "fact_extracted": yes(F.trim("intermediate_fact") != ""), "supporting_chunk_right": yes(F.col("s")), "alias_matched": yes(alias_match(F.col("intermediate_fact"), F.col("aliases"))),
        "fact_injected": yes((F.col("intermediate_fact") != "") & F.contains("second_query", F.col("intermediate_fact"))), "second_hop_hit": yes(F.col("h2") == 1),
    }
    whole = None
    for f in flags:
        whole = F.col(f) if whole is None else whole & F.col(f)
    return j.select("case_code", *[v.alias(k) for k, v in flags.items()]).withColumn("end_to_end", whole)


def assign_side(cases: DataFrame) -> DataFrame:
    return cases.withColumn("first_side", F.when(stable_side(F.col("case_code")) == 0, "control").otherwise("treatment"))


def completed(results: DataFrame, judges: DataFrame) -> DataFrame:
    return results.where("status = 'SUCCESS' and actual_action <> 'ERROR'").join(judges, "case_result_id", "left_semi")


def resume_plan(results: DataFrame, judges: DataFrame) -> DataFrame:
    """Each result with plan SKIP or RESET; a reset also clears its judges and hits."""
    done = completed(results, judges).select("case_result_id").withColumn("_d", F.lit(True))
    return results.join(done, "case_result_id", "left").withColumn("plan", F.when(F.col("_d"), "SKIP").otherwise("RESET")).drop("_d")


def run_status(results: DataFrame) -> DataFrame:
    done, bad = F.count(F.when(F.col("status") == "SUCCESS", 1)), F.count(F.when(F.col("status") == "FAILED", 1))
    return results.groupBy("run_id").agg(done.alias("completed"), bad.alias("failed"), F.when(bad == 0, "SUCCESS").when(done > 0, "PARTIAL").otherwise("FAILED").alias("run_status"))


def flag_gold(hits: DataFrame, gold: DataFrame) -> DataFrame:
    g = gold.select("case_code", "chunk_id").distinct().withColumn("_g", F.lit(True))
    return hits.join(g, ["case_code", "chunk_id"], "left").withColumn("is_gold", F.col("_g").isNotNull()).drop("_g")


def plan_match(control: DataFrame, treatment: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    a = control.select("case_code", F.struct(*fields).alias("a"))
    return a.join(treatment.select("case_code", F.struct(*fields).alias("b")), "case_code").select("case_code", F.col("a").eqNullSafe(F.col("b")).alias("plan_match"))


def worst_cases(pairs: DataFrame, n: int = 30) -> DataFrame:
    """The n cases whose coverage moved most."""
    return deltas(pairs, ("fact_coverage",)).orderBy(F.desc(F.abs("delta")), "case_code").limit(n)


def run_results(results: DataFrame, cases: DataFrame, judges: DataFrame) -> DataFrame:
    """Results with their case and their latest judge row, if any."""
    latest = judges.groupBy("case_result_id").agg(F.max_by(F.struct(*[c for c in judges.columns if c not in ("case_result_id", "judge_id")]), "judge_id").alias("j"))
    return results.join(cases, "case_code").join(latest, "case_result_id", "left").select("*", "j.*").drop("j")


def run_hits(hits: DataFrame, results: DataFrame) -> DataFrame:
    return hits.join(results.select("case_result_id", "case_code"), "case_result_id").orderBy("case_result_id", "round_no", "channel", "rank_no")


def run_evidence(results: DataFrame, cases: DataFrame, relevance: DataFrame, source_docs: DataFrame) -> DataFrame:
    return results.select("case_result_id", "case_code").join(cases.select("case_code", "case_type"), "case_code").join(relevance, "case_code").join(source_docs, "source_doc_code")


def pending_work(state: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Waiting or failed tasks with their active chunk, oldest first.

    Rows are numbered over ranges of (updated_at, chunk_id), as a limit on sorted rows gathers them in one task."""
    waiting = state.where("status in ('PENDING', 'FAILED')").join(chunks.where("status = 'ACTIVE'").select("chunk_id", "content"), "chunk_id")
    return numbered_globally(waiting, "updated_at", "chunk_id", name="_n").where(F.col("_n") < limit).drop("_n").orderBy("updated_at", "chunk_id")


def markdown_rows(df: DataFrame) -> DataFrame:
    """``df`` as the rows of a markdown table."""
    from ..functions.text import markdown_cell

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c)) for c in df.columns]), F.lit(" |")).alias("line"))
