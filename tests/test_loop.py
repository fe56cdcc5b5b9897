"""Sub-queries without evidence are asked again in the second round, alone."""

from pyspark.sql import functions as F

from quern.operators import loop, retrieval


def test_uncovered_sub_queries_are_asked_again(spark):
    subs = "array<struct<sub_query_id:string,question:string>>"
    questions = spark.createDataFrame(
        [("q", "whole", ["whole"], "hybrid", [], None, [("SQ1", "one"), ("SQ2", "two")], "PARALLEL"), ("p", "plain", ["plain"], "hybrid", [], None, None, None)],
        f"query_id string, question string, queries array<string>, mode string, target_types array<string>, business_domain string, sub_queries {subs}, decomposition_type string",
    )
    found = {"one": [1, 2, 3, 4], "two": [5], "two again": [6, 7], "plain": [8, 9, 10]}
    rows = [(text, i + 1, c, 1.0 - i / 10) for text, ids in found.items() for i, c in enumerate(ids)]
    table = spark.createDataFrame(rows, "query string, rank int, chunk_id long, score double")
    asked = []

    def engine(searches):
        asked.append({r["query"] for r in searches.select("query").collect()})
        return searches.join(table, "query").select("search_id", "rank", "chunk_id", "score", F.lit("bm25").alias("source"))

    def search(rows):
        return retrieval.merge_tasks(retrieval.multi_retrieve(rows, engine)).withColumn("sources", F.array("source"))

    def rerank(hits):
        return hits.where("chunk_id <> 5").withColumn("rerank_score", F.lit(0.9)).select("query_id", "chunk_id", "rank", "score", "rerank_score")

    chunks = spark.range(1, 11).select(F.col("id").alias("chunk_id"), F.col("id").alias("doc_id"), F.lit("FAQ").alias("chunk_type"), *[F.lit("t").alias(c) for c in ("content", "title", "title_path", "source_section")], F.lit(None).cast("string").alias("version"))
    rewrites = spark.createDataFrame([], "query_id string, rewritten string, expanded array<string>")
    again = spark.createDataFrame([("q", "SQ2", "two again"), ("q", "SQ1", "never")], "query_id string, sub_query_id string, rewritten string")
    fused, decided = loop.adaptive_retrieve(questions, search, rerank, chunks, rewrites, sub_rewrites=again)
    got = {r.query_id: r for r in decided.collect()}
    assert asked == [{"one", "two", "plain"}, {"two again"}]
    assert (got["q"].rounds, got["q"].retry_strategy, got["q"].coverage_rate) == (2, "QUERY_REWRITE", 0.5)
    assert (got["p"].rounds, got["p"].retry_strategy, got["p"].hop_status) == (1, "NONE", None)
    hits = {(r.query_id, r.chunk_id): r.rounds for r in fused.collect()}
    assert hits["q", 6] == [2] and hits["q", 1] == [1] and hits["p", 8] == [1]


def test_one_search_serves_several_questions(spark):
    questions = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["y", " "]), (3, "x", None)], "query_id long, question string, queries array<string>")
    seen = []

    def engine(searches):
        seen.extend(r["query"] for r in searches.collect())
        return searches.select("search_id", F.lit(1).alias("rank"), F.length("query").cast("long").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit("bm25").alias("source"))

    got = sorted((r.query_id, r.variant, r["query"]) for r in retrieval.multi_retrieve(questions, engine).collect())
    assert sorted(seen) == ["x", "y"]
    assert got == [(1, 0, "x"), (1, 1, "y"), (2, 0, "y"), (3, 0, "x")]
