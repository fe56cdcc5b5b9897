"""Rank fusion, quotas and reranking over whole tables of questions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..storage import tasks_for

#: The weight of a round by its strategy.
ROUND_WEIGHTS = {"INITIAL": 1.0, "QUERY_REWRITE": 0.9, "FORCE_BM25": 1.0, "RELAX_FILTER": 0.8, "DEPENDENT_HOP": 1.0}


def numbered(df: DataFrame, *order, by="query_id", name="rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def rrf(hits: DataFrame, c: int = DEFAULTS.rrf_constant, window: int = DEFAULTS.rrf_window, k: int = DEFAULTS.final_k) -> DataFrame:
    """(query_id, chunk_id, score, sources, channels, rank) of hits (query_id, chunk_id, rank, score, source).

    Each channel's first ``window`` ranks add 1 / (c + rank). Ties go by the vector
    channel first, then by rank, then by chunk."""
    seen = F.when(F.col("source") == "vector", F.col("rank")).otherwise(F.col("rank") + 1_000_000)
    fused = hits.where(F.col("rank") <= window).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_list(F.struct("source", "rank", F.col("score").alias("raw_score")))).alias("channels"),
        F.min(seen).alias("seen"),
    )
    return numbered(fused, F.desc("score"), "seen", "chunk_id").where(F.col("rank") <= k).drop("seen")


def fuse_rounds(attempts: DataFrame, hits: DataFrame, k: int = DEFAULTS.final_k, c: int = DEFAULTS.rrf_constant, rows: int = 0) -> DataFrame:
    """Rounds fused by weighted reciprocal ranks; an attempt's own weight, unless 0, counts.

    attempts: (query_id, round_no, strategy, weight); hits: (query_id, round_no, rank, chunk_id, score, source).
    Hits move once, by question; ``rows``, about how many there are, bounds what one task sorts."""
    weights = F.create_map(*[F.lit(x) for kv in ROUND_WEIGHTS.items() for x in kv])
    weight = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.try_element_at(weights, F.col("strategy")), F.lit(1.0))
    tried = attempts.groupBy("query_id").agg(F.collect_list(F.struct("round_no", "strategy", weight.alias("w"))).alias("tried"))
    n = tasks_for(hits.sparkSession, rows)
    met = hits.repartition(n, "query_id").join(tried.repartition(n, "query_id"), "query_id")
    joined = met.withColumn("a", F.explode(F.filter("tried", lambda x: x["round_no"] == F.col("round_no")))).select(*hits.columns, "a.strategy", "a.w")
    first = joined.groupBy("query_id", "round_no", "strategy", "w", "chunk_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("raw_score"))
    fused = first.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("w") / (c + F.col("rank"))), 9).alias("score"),
        F.array_sort(F.collect_set("round_no")).alias("rounds"),
        F.array_sort(F.collect_list(F.struct("round_no", "strategy", "rank", "raw_score"))).alias("provenance"),
        F.min(F.struct("round_no", "rank")).alias("seen"),
    )
    return numbered(fused, F.desc("score"), "seen", "chunk_id").where(F.col("rank") <= k).drop("seen")


def fuse_subqueries(hits: DataFrame, k: int = DEFAULTS.final_k, quota: int = DEFAULTS.sub_query_quota, c: int = DEFAULTS.rrf_constant) -> DataFrame:
    """Sub-queries' hits (query_id, sub_query_ord, sub_query_id, rank, chunk_id) fused by reciprocal ranks,
    with each sub-query's first ``quota`` distinct chunks placed first, in sub-query order."""
    distinct = hits.groupBy("query_id", "sub_query_ord", "sub_query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.sum(1.0 / (c + F.col("rank"))).alias("part"))
    nth = F.row_number().over(Window.partitionBy("query_id", "sub_query_ord").orderBy("rank"))
    fused = distinct.withColumn("nth", nth).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("part"), 9).alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("sub_query_ord", "sub_query_id"))), lambda x: x["sub_query_id"]).alias("sub_query_ids"),
        F.min(F.when(F.col("nth") <= quota, F.struct("sub_query_ord", "rank"))).alias("place"),
        F.min(F.struct("sub_query_ord", "rank")).alias("seen"),
    )
    return numbered(fused, F.col("place").asc_nulls_last(), F.desc("score"), "seen").where(F.col("rank") <= k).drop("place", "seen")


def with_anchor(hits: DataFrame, anchor_hits: DataFrame) -> DataFrame:
    """Anchor queries' hits joined to the sub-queries' as the last sub-query, ANCHOR."""
    last = hits.groupBy("query_id").agg((F.max("sub_query_ord") + 1).alias("sub_query_ord"))
    anchors = anchor_hits.select("query_id", "rank", "chunk_id").join(last, "query_id", "left").select("query_id", F.coalesce("sub_query_ord", F.lit(1)).alias("sub_query_ord"), F.lit("ANCHOR").alias("sub_query_id"), "rank", "chunk_id")
    return hits.select("query_id", "sub_query_ord", "sub_query_id", "rank", "chunk_id").unionByName(anchors)


def _restored(n: int, quota: int):
    """Over rows of whole questions (query_id, held, spare, asked): each choice depends on the one before."""
    schema = pa.schema([("query_id", pa.string()), ("rank", pa.int32()), ("chunk_id", pa.int64()), ("sub_query_ids", pa.list_(pa.string())), ("quota_restored", pa.bool_())])

    def restore(held, spare, asked):
        count = lambda s: sum(s in x[1] for x in held)
        for s in asked:
            while count(s) < quota:
                have = {x[0] for x in held}
                new = next((x for x in spare if x[0] not in have and s in x[1]), None)
                if new is None:
                    break
                if len(held) < n:
                    held.append(new)
                    continue
                at = next((i for i in reversed(range(len(held))) if all(count(t) > quota for t in held[i][1] if t in asked)), None)
                if at is None:
                    break
                held[at] = new
        return held

    def listed(column, restored):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten()
        chunks, subs, ends = flat.field("chunk_id").to_pylist(), flat.field("sub_query_ids").to_pylist(), column.value_lengths().to_pylist()
        at = 0
        for size in ends:
            yield [(chunks[i], subs[i], restored) for i in range(at, at + (size or 0))]
            at += size or 0

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for q, held, spare, asked in zip(batch.column("query_id").to_pylist(), listed(batch.column("held"), False), listed(batch.column("spare"), True), batch.column("asked").to_pylist(), strict=True):
                for rank, row in enumerate(restore(held[:n], spare, asked), 1):
                    for column, value in zip(out, (q, rank, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def restore_quota(reranked: DataFrame, candidates: DataFrame, sub_queries: DataFrame, n: int = DEFAULTS.rerank_n, quota: int = DEFAULTS.sub_query_quota) -> DataFrame:
    """Reranked rows with every sub-query's quota restored from the candidates where they have it.

    Each choice depends on the one before, so a question's rows (at most the rerank limit) are one row of lists;
    a task goes through batches of many questions."""
    schema = "query_id string, rank int, chunk_id bigint, sub_query_ids array<string>, quota_restored boolean"
    hit = lambda df, kind: df.select("query_id", F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("o"), F.col("chunk_id").cast("long").alias("chunk_id"), "sub_query_ids")
    subs = sub_queries.select("query_id", F.lit(2).alias("kind"), F.col("sub_query_ord").cast("int").alias("o"), F.lit(None).cast("long").alias("chunk_id"), F.array("sub_query_id").alias("sub_query_ids"))
    rows = hit(reranked, 0).unionByName(hit(candidates, 1)).unionByName(subs).withColumn("query_id", F.col("query_id").cast("string"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("o", "chunk_id", "sub_query_ids"))))
    lists = rows.groupBy("query_id").agg(of(0).alias("held"), of(1).alias("spare"), F.transform(of(2), lambda x: x["sub_query_ids"][0]).alias("asked"))
    return lists.mapInArrow(_restored(n, max(1, quota)), schema)


def coverage(sub_queries: DataFrame, candidates: DataFrame, final: DataFrame) -> DataFrame:
    """Per sub-query: candidate_count, final_count, covered; and the question's coverage_rate."""
    counted = lambda df, name: df.select("query_id", F.explode("sub_query_ids").alias("sub_query_id")).groupBy("query_id", "sub_query_id").agg(F.count("*").alias(name))
    keys = ["query_id", "sub_query_id"]
    out = sub_queries.select(*keys).join(counted(candidates, "candidate_count"), keys, "left").join(counted(final, "final_count"), keys, "left").fillna(0, ["candidate_count", "final_count"])
    out = out.withColumn("covered", F.col("final_count") > 0)
    return out.withColumn("coverage_rate", F.avg(F.col("covered").cast("int")).over(Window.partitionBy("query_id")))


def rerank(hits: DataFrame, scores: DataFrame, limit: int = DEFAULTS.rerank_limit, n: int = DEFAULTS.rerank_n) -> DataFrame:
    """The first ``limit`` hits with text, by the given scores (query_id, chunk_id, rerank_score); top n."""
    taken = hits.where((F.col("rank") <= limit) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    scored = taken.join(scores, ["query_id", "chunk_id"]).withColumnRenamed("rank", "rank_before")
    return numbered(scored, F.desc("rerank_score"), "rank_before").where(F.col("rank") <= n)


def rerank_fallback(hits: DataFrame, n: int = DEFAULTS.rerank_n) -> DataFrame:
    """The first n hits as they are; rows without a chunk go after the cut."""
    return hits.where((F.col("rank") <= n) & F.col("chunk_id").isNotNull())


def rerank_or_fallback(hits: DataFrame, scores: DataFrame, enabled: bool = True, fail_open: bool = True, n: int = DEFAULTS.rerank_n) -> DataFrame:
    """Reranked where a question has scores, its first n hits otherwise, with the status of each. Where that is not
    wanted (``fail_open`` false) a question without scores has one row, FAILED, without a chunk."""
    plain = rerank_fallback(hits, n).select("query_id", "chunk_id", "rank", F.lit(None).cast("double").alias("rerank_score"))
    if not enabled:
        return plain.withColumn("status", F.lit("SKIPPED"))
    done = rerank(hits, scores, n=n).select("query_id", "chunk_id", "rank", F.col("rerank_score").cast("double").alias("rerank_score")).withColumn("status", F.lit("SUCCESS"))
    rest = plain.join(scores.select("query_id").distinct(), "query_id", "left_anti")
    if fail_open:
        return done.unionByName(rest.withColumn("status", F.lit("FALLBACK")))
    failed = rest.select("query_id").distinct().select("query_id", F.lit(None).cast(plain.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("rerank_score"), F.lit("FAILED").alias("status"))
    return done.unionByName(failed)


def effective_n(queries: DataFrame, n: int = DEFAULTS.rerank_n) -> DataFrame:
    """``top_n``: n, and up to three more for a decomposed question."""
    return queries.withColumn("top_n", F.lit(n) + F.least(F.greatest(F.size(F.coalesce("sub_queries", F.array().cast("array<string>"))), F.lit(0)), F.lit(3)))


def min_score(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("rerank_score") >= least)
