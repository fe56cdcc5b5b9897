"""The bounded loop of retrieval: a first round for all questions, a second for those that need it.

Both rounds are unrolled. What a question does in the second is decided by its state after
the first: a dependent plan fills its second query with a fact of the first hop, a
decomposed question asks again what has no evidence, any other retries by its quality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..storage import durable
from .analysis import UNCOVERED, coverage_override, dependent_queries, plan_retry, quality_features, quality_policy, route, validate_fact
from .fusion import coverage, fuse_rounds
from .retrieval import SUB_QUERIES

ROUND = ("query_id", "round_no", "rank", "chunk_id", "score", "source")
ASKED = ("query_id", "question", "queries", "mode", "target_types", "business_domain", "query_variant", "sub_queries")
FACTS = "query_id string, success boolean, intermediate_fact string, evidence_quote string, supporting_chunk_id long, confidence double"


def _first_round(questions: DataFrame) -> DataFrame:
    """``questions`` with sub_queries, is_dependent and template; a dependent plan asks its first query only."""
    given = F.transform("sub_queries", lambda s: F.struct(s["sub_query_id"].alias("sub_query_id"), s["question"].alias("question"))) if "sub_queries" in questions.columns else F.lit(None)
    kind = F.col("decomposition_type") if "decomposition_type" in questions.columns else F.lit(None).cast("string")
    rows = questions.withColumns({"planned": F.coalesce(given.cast(SUB_QUERIES), F.array().cast(SUB_QUERIES)), "query_variant": F.lit("ORIGINAL")})
    dependent = F.coalesce(kind == "DEPENDENT", F.lit(False)) & (F.size("planned") == 2)
    rows = rows.withColumns({"is_dependent": dependent, "template": F.when(dependent, F.get("planned", F.lit(1))["question"]), "second_id": F.when(dependent, F.get("planned", F.lit(1))["sub_query_id"])})
    return rows.withColumn("sub_queries", F.when(F.col("is_dependent"), F.slice("planned", 1, 1)).otherwise(F.col("planned")))


def adaptive_retrieve(
    questions: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    rerank: Callable[[DataFrame], DataFrame],
    chunks: DataFrame,
    rewrites: DataFrame,
    facts: DataFrame | None = None,
    sub_rewrites: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = durable,
    k: int = DEFAULTS.final_k,
) -> tuple[DataFrame, DataFrame]:
    """(fused hits of both rounds, the questions with what was decided) over the whole table of questions.

    questions: (query_id, question, queries, mode, target_types, business_domain) and where there sub_queries and
    decomposition_type. ``search`` gives hits (query_id, rank, chunk_id, score, source, sources and where there
    sub_query_ids) of such rows, ``rerank`` the hits' (query_id, chunk_id, rank, score, rerank_score); rewrites:
    (query_id, rewritten, expanded); sub_rewrites: (query_id, sub_query_id, rewritten) of single sub-queries; facts:
    what a model read in the first hop (query_id, success, intermediate_fact, evidence_quote, supporting_chunk_id,
    confidence), checked against the first hop's chunks. ``keep`` materialises what both rounds read; a checkpoint
    unless given.

    Decided: query_id, quality, quality_score, retry_strategy, reason, rounds, hop_status (SECOND_HOP_READY,
    SECOND_HOP_FALLBACK, FIRST_HOP_READY where the first hop found nothing, null for other plans), second_query and
    coverage_rate. A dependent plan whose fact is not accepted asks the question itself."""
    told = chunks.select("chunk_id", "doc_id", "chunk_type", "content", "title", "title_path", "source_section", "version")
    asked = keep(_first_round(questions))
    first = keep(search(asked.select(*ASKED)))
    reranked = keep(rerank(first))
    graded = quality_policy(quality_features(asked.select("query_id", "question", "queries", "mode", "target_types", "business_domain"), first.join(told, "chunk_id"), reranked.join(told, "chunk_id")))
    if "sub_query_ids" in first.columns:
        parts = asked.where("not is_dependent").select("query_id", F.explode("sub_queries").alias("s")).select("query_id", "s.sub_query_id", "s.question")
        ids = first.select("query_id", "chunk_id", "sub_query_ids")
        covered = keep(coverage(parts.drop("question"), ids, reranked.select("query_id", "chunk_id").join(ids, ["query_id", "chunk_id"])))
        rate = covered.groupBy("query_id").agg(F.first("coverage_rate").alias("coverage_rate"), F.lit(True).alias("decomposed"))
        graded = coverage_override(graded.join(rate, "query_id", "left"))
    else:
        parts = covered = None
        graded = graded.withColumns({"coverage_rate": F.lit(None).cast("double"), "decomposed": F.lit(None).cast("boolean")})
    graded = keep(graded.select("query_id", "quality", "quality_score", "retry_strategy", "reason", "candidate_count", "coverage_rate"))
    state = asked.join(graded, "query_id").withColumns({"round_no": F.lit(1), "has_candidates": F.col("candidate_count") > 0, "dependent_status": F.when(F.col("is_dependent"), "FIRST_HOP_READY")})
    routed = keep(route(state))
    kind = questions.schema["query_id"].dataType.simpleString()

    # the three ways into the second round
    retried = routed.where("next_step = 'retry'")
    partial = retried.where(F.col("reason") == UNCOVERED)
    plain = plan_retry(retried.join(partial.select("query_id"), "query_id", "left_anti").join(rewrites, "query_id", "left")).join(asked.select("query_id", "question"), "query_id")
    again = plain.withColumn("sub_queries", F.array().cast(SUB_QUERIES)).select(*ASKED)
    if parts is not None:
        open_parts = parts.join(covered.where("not covered").select("query_id", "sub_query_id"), ["query_id", "sub_query_id"], "left_semi")
        new = sub_rewrites if sub_rewrites is not None else parts.select("query_id", "sub_query_id", F.lit(None).cast("string").alias("rewritten"))
        text = F.coalesce(F.nullif(F.trim("rewritten"), F.lit("")), F.col("question"))
        listed = open_parts.join(new, ["query_id", "sub_query_id"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sub_query_id", text.alias("question")))).alias("sub_queries"))
        split = partial.drop("sub_queries", "query_variant").join(listed, "query_id").withColumn("query_variant", F.lit("SUB_QUERY_REWRITTEN"))
        again = again.unionByName(split.withColumn("queries", F.transform("sub_queries", lambda s: s["question"])).select(*ASKED))
    read = facts if facts is not None else questions.sparkSession.createDataFrame([], FACTS.replace("query_id string", f"query_id {kind}"))
    waiting = routed.where("next_step = 'dependent'")
    seen = reranked.join(told.select("chunk_id", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "content").join(waiting.select("query_id"), "query_id", "left_semi")
    checked = keep(validate_fact(read, seen).select("query_id", "accepted", "intermediate_fact"))
    hop = keep(dependent_queries(waiting.select("query_id", "question", "template"), checked).withColumnRenamed("query", "second_query").join(checked.where("accepted").select("query_id", F.lit("SECOND_HOP_READY").alias("hop_status")), "query_id", "left"))
    resolved = waiting.drop("queries", "sub_queries", "query_variant").join(hop, "query_id").withColumns(
        {"queries": F.array("second_query"), "sub_queries": F.array(F.struct(F.col("second_id").alias("sub_query_id"), F.col("second_query").alias("question"))), "query_variant": F.lit("DEPENDENT_HOP")}
    )
    second = search(keep(again.unionByName(resolved.select(*ASKED))))

    later = F.col("next_step").isin("retry", "dependent")
    strategy = F.when(F.col("next_step") == "dependent", "DEPENDENT_HOP").otherwise(F.col("retry_strategy"))
    attempts = asked.select("query_id", F.lit(1).alias("round_no"), F.lit("INITIAL").alias("strategy"), F.lit(0.0).alias("weight")).unionByName(
        routed.where(later).select("query_id", F.lit(2).alias("round_no"), strategy.alias("strategy"), F.lit(0.0).alias("weight"))
    )
    hits = first.withColumn("round_no", F.lit(1)).select(*ROUND).unionByName(second.withColumn("round_no", F.lit(2)).select(*ROUND))
    ended = F.when(F.col("next_step") == "dependent", F.coalesce("hop_status", F.lit("SECOND_HOP_FALLBACK"))).otherwise(F.col("dependent_status"))
    decided = routed.join(hop, "query_id", "left").select("query_id", "quality", "quality_score", strategy.alias("retry_strategy"), "reason", F.when(later, 2).otherwise(1).alias("rounds"), ended.alias("hop_status"), "second_query", "coverage_rate")
    return fuse_rounds(attempts, hits, k), decided
