"""Context packing: expansion by relations, budget, citations, rendering, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import citation_ids, estimate_tokens, text

#: The relations by which a type of chunk is expanded.
EXPANDED_BY = {"SOP": ("PARENT_CHILD", "PREVIOUS_NEXT"), "MANUAL": ("PARENT_CHILD", "PREVIOUS_NEXT"), "RULE": ("PREVIOUS_NEXT", "SAME_SECTION")}
SEPARATOR = "\n\n---\n\n"


def sort_score(rerank_score: Column, score: Column) -> Column:
    """A score of 0 counts as missing."""
    return F.coalesce(F.nullif(rerank_score, F.lit(0.0)), F.nullif(score, F.lit(0.0)), F.lit(0.0))


def context_rows(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, pos, sort_score, relation) of hits (query_id, chunk_id, rank, score, rerank_score)."""
    return hits.where("chunk_id is not null").select("query_id", "chunk_id", F.col("rank").alias("pos"), sort_score(F.col("rerank_score"), F.col("score")).alias("sort_score"), F.lit("SELF").alias("relation"))


def expand_hits(rows: DataFrame, relations: DataFrame, chunks: DataFrame, k: int = DEFAULTS.expansions) -> DataFrame:
    """``rows`` and, after each, up to k chunks related to it, at its score less 0.01.

    Edges count in both directions. The first k by sort_order are taken before it is
    asked whether they are active. A chunk listed under two relations keeps the last."""
    allowed = F.create_map(*[x for t, names in EXPANDED_BY.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    both = relations.select(F.col("from_chunk_id").alias("chunk_id"), F.col("to_chunk_id").alias("related_id"), "relation_type", "sort_order").unionByName(
        relations.select(F.col("to_chunk_id").alias("chunk_id"), F.col("from_chunk_id").alias("related_id"), "relation_type", "sort_order")
    )
    typed = rows.join(chunks.select("chunk_id", "chunk_type"), "chunk_id")
    near = typed.join(both, "chunk_id").where(F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("chunk_type")), F.array().cast("array<string>")), F.col("relation_type")))
    order = Window.partitionBy("query_id", "pos").orderBy("sort_order", "relation_type", "related_id")
    first = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    one = first.groupBy("query_id", "pos", "related_id").agg(F.max("sort_score").alias("sort_score"), F.max_by("relation_type", "n").alias("relation"), F.min("n").alias("n"))
    active = one.join(chunks.where("status = 'ACTIVE'").select(F.col("chunk_id").alias("related_id")), "related_id", "left_semi")
    added = active.select("query_id", F.col("related_id").alias("chunk_id"), (F.col("pos") + 1_000_000).alias("pos"), (F.col("sort_score") - 0.01).alias("sort_score"), "relation", F.col("n").alias("nth"))
    return rows.withColumn("nth", F.lit(0)).unionByName(added)


def dedup_context(rows: DataFrame) -> DataFrame:
    """Each chunk once: its highest score, the earliest row on ties."""
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("sort_score"), "pos", "nth")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def budget(rows: DataFrame, max_tokens: int = DEFAULTS.context_tokens, max_chunks: int = DEFAULTS.context_chunks) -> DataFrame:
    """The rows, by score, that fit before the first that overflows, with ``place`` and the question's status."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sort_score"), "pos", "nth", "chunk_id")
    total = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = rows.withColumn("place", F.row_number().over(order)).withColumn("total", total)
    fits = (F.col("total") <= max_tokens) & (F.col("place") <= max_chunks)
    status = F.when(F.count(F.when(~fits, 1)).over(Window.partitionBy("query_id")) > 0, "TRUNCATED").otherwise("SUCCESS")
    return seen.withColumn("status", status).where(fits)


def context_status(questions: DataFrame, rows: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, n_chunks, status) of every question: EMPTY without candidate rows, TRUNCATED where some did not fit, else SUCCESS."""
    had = rows.groupBy("query_id").agg(F.count("*").alias("had"))
    kept = packed.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    j = questions.select("query_id").join(had, "query_id", "left").join(kept, "query_id", "left").fillna(0, ["had", "n_chunks"])
    return j.select("query_id", "n_chunks", F.when(F.col("had") == 0, "EMPTY").when(F.col("n_chunks") < F.col("had"), "TRUNCATED").otherwise("SUCCESS").alias("status"))


def pack_context(hits: DataFrame, relations: DataFrame, chunks: DataFrame, max_tokens: int = DEFAULTS.context_tokens, max_chunks: int = DEFAULTS.context_chunks) -> DataFrame:
    """(query_id, place, chunk_id, sort_score, relation, tokens, status, citation_id), contents joined last."""
    rows = dedup_context(expand_hits(context_rows(hits), relations, chunks))
    sized = rows.join(chunks.select("chunk_id", estimate_tokens(F.col("content")).alias("tokens")), "chunk_id")
    return citations(budget(sized, max_tokens, max_chunks)).select("query_id", "place", "chunk_id", "sort_score", "relation", "tokens", "status", "citation_id")


def citations(packed: DataFrame) -> DataFrame:
    return packed.withColumn("citation_id", F.concat(F.lit("C"), F.col("place").cast("string")))


def block(citation_id: Column, title: Column, content: Column, header: bool = True) -> Column:
    head = F.concat(F.lit("["), citation_id, F.lit("] "), text(title), F.lit("\n")) if header else F.lit("")
    return F.concat(head, text(content))


def _joined(struct: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["b"]), sep)


def render(packed: DataFrame, chunks: DataFrame, header: bool = True) -> DataFrame:
    """(query_id, context): the packed chunks in order."""
    full = packed.join(chunks.select("chunk_id", "title", "content"), "chunk_id")
    return full.groupBy("query_id").agg(_joined(F.struct("place", block(F.col("citation_id"), F.col("title"), F.col("content"), header).alias("b")), SEPARATOR).alias("context"))


def render_grouped(packed: DataFrame, chunks: DataFrame, sub_queries: DataFrame) -> DataFrame:
    """(query_id, context) with the chunks under each of their sub-queries, a line where one has none,
    and the rest at the end. ``packed`` has sub_query_ids; a shared chunk keeps its one citation."""
    full = packed.join(chunks.select("chunk_id", "title", "content"), "chunk_id")
    known = sub_queries.select("query_id", "sub_query_ord", "sub_query_id", "question")
    placed = full.select("query_id", "place", F.explode_outer("sub_query_ids").alias("sub_query_id"), block(F.col("citation_id"), F.col("title"), F.col("content")).alias("b"))
    under = known.join(placed, ["query_id", "sub_query_id"], "left").groupBy("query_id", "sub_query_ord", "question").agg(_joined(F.struct("place", "b"), SEPARATOR).alias("body"))
    under = under.select("query_id", F.col("sub_query_ord").alias("o"), F.concat(F.lit("子问题："), "question", F.lit("\n"), F.when(F.col("body") == "", "（未找到相关证据）").otherwise(F.col("body"))).alias("b"))
    rest = placed.join(known.select("query_id", "sub_query_id"), ["query_id", "sub_query_id"], "left_anti")
    rest = rest.groupBy("query_id", "place").agg(F.first("b").alias("b")).join(placed.join(known, ["query_id", "sub_query_id"], "left_semi").select("query_id", "place").distinct(), ["query_id", "place"], "left_anti")
    rest = rest.groupBy("query_id").agg(_joined(F.struct("place", "b"), SEPARATOR).alias("body")).select("query_id", F.lit(1_000_000).alias("o"), F.concat(F.lit("其他证据：\n"), "body").alias("b"))
    return under.unionByName(rest).groupBy("query_id").agg(_joined(F.struct("o", "b"), "\n\n").alias("context"))


def blocks(context: Column) -> Column:
    """A rendered context's blocks again."""
    return F.filter(F.transform(F.split(text(context), SEPARATOR, -1), lambda x: F.trim(x)), lambda x: x != "")


def check_citations(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, used, unknown, valid, has_citation, passed) of answers (query_id, answer)."""
    known = packed.groupBy("query_id").agg(F.array_sort(F.collect_set("citation_id")).alias("known"))
    none = F.array().cast("array<string>")
    joined = answers.join(known, "query_id", "left").select("query_id", citation_ids(F.col("answer")).alias("used"), F.coalesce("known", none).alias("known"))
    out = joined.select("query_id", "used", F.array_except("used", "known").alias("unknown"), F.array_intersect("used", "known").alias("valid"))
    return out.withColumn("has_citation", F.size("used") > 0).withColumn("passed", F.col("has_citation") & (F.size("unknown") == 0))


def cited_chunks(answers: DataFrame, packed: DataFrame) -> DataFrame:
    used = answers.select("query_id", F.explode(citation_ids(F.col("answer"))).alias("citation_id"))
    return used.join(packed.select("query_id", "citation_id", "chunk_id"), ["query_id", "citation_id"]).select("query_id", "chunk_id").distinct()


def hit_log(attempt_hits: DataFrame, reranked: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, channel, round_no, rank_no, chunk_id, raw_score, fused_score, rerank_score) of all stages."""
    none = F.lit(None).cast("double")
    fused = F.col("source").isin("hybrid", "merged")
    a = attempt_hits.select("query_id", F.col("source").alias("channel"), "round_no", F.col("rank").alias("rank_no"), "chunk_id", F.when(~fused, F.col("score")).alias("raw_score"), F.when(fused, F.col("score")).alias("fused_score"), none.alias("rerank_score"))
    b = reranked.select("query_id", F.lit("rerank").alias("channel"), F.lit(None).cast("int").alias("round_no"), F.col("rank").alias("rank_no"), "chunk_id", none.alias("raw_score"), none.alias("fused_score"), "rerank_score")
    c = packed.select("query_id", F.lit("final").alias("channel"), F.lit(None).cast("int").alias("round_no"), F.col("place").alias("rank_no"), "chunk_id", none.alias("raw_score"), F.col("sort_score").alias("fused_score"), none.alias("rerank_score"))
    return a.unionByName(b).unionByName(c)


def answer_inputs(questions: DataFrame, packed: DataFrame, chunks: DataFrame, sub_queries: DataFrame) -> DataFrame:
    """(query_id, citation_summary, sub_query_plan): what an answer's writer is given, as text."""
    titled = packed.join(chunks.select("chunk_id", "title"), "chunk_id")
    summary = titled.groupBy("query_id").agg(_joined(F.struct("place", F.concat(F.lit("["), "citation_id", F.lit("] "), text(F.col("title"))).alias("b")), "\n").alias("citation_summary"))
    plan = sub_queries.groupBy("query_id").agg(_joined(F.struct("sub_query_ord", F.concat("sub_query_id", F.lit("："), "question").alias("b")), "\n").alias("sub_query_plan"))
    return questions.select("query_id").join(summary, "query_id", "left").join(plan, "query_id", "left").fillna("", ["citation_summary", "sub_query_plan"])
