"""Batch retrieval: filters, hybrid, routing and merging.

Hits are rows (query_id, chunk_id, score, source, rank). Ranks are numbered with
a second key, so ties have one order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import text
from . import keyword
from .fusion import fuse_subqueries, rrf, with_anchor

#: A parent domain's parts.
DOMAIN_ALIASES = {"ecommerce_after_sales": ("order", "payment", "refund", "return", "after_sales", "logistics", "coupon", "invoice", "member", "risk")}


def top(hits: DataFrame, k: int, *order, by=("query_id",)) -> DataFrame:
    """The first k rows of each query with their ``rank``."""
    window = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def filter_chunks(chunks: DataFrame, doc_type: str | None = None, domains: tuple[str, ...] = ()) -> DataFrame:
    out = chunks.where("status = 'ACTIVE'")
    out = out.where(F.col("chunk_type") == doc_type) if doc_type else out
    return out.where(F.col("business_domain").isin(*domains)) if domains else out


def expand_domains(queries: DataFrame, aliases: dict = DOMAIN_ALIASES) -> DataFrame:
    """``queries`` with ``domains``: parents replaced by their parts, once each, blanks dropped."""
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    given = F.filter(F.transform(F.coalesce("business_domains", F.array().cast("array<string>")), lambda d: F.trim(d)), lambda d: d.isNotNull() & (d != ""))
    return queries.withColumn("domains", F.array_distinct(F.flatten(F.transform(given, lambda d: F.coalesce(F.try_element_at(table, d), F.array(d))))))


def effective_filter(queries: DataFrame) -> DataFrame:
    """``type_filter``: the target type if there is exactly one."""
    return queries.withColumn("type_filter", F.when(F.size("target_types") == 1, F.col("target_types")[0]))


def hybrid(keyword_hits: DataFrame, vector_hits: DataFrame, k: int = DEFAULTS.final_k) -> DataFrame:
    """Both channels fused by reciprocal ranks; the vector list counts as seen first."""
    both = vector_hits.select("query_id", "chunk_id", "rank", "score", "source").unionByName(keyword_hits.select("query_id", "chunk_id", "rank", "score", "source"))
    return rrf(both, k=k)


def route(queries: DataFrame, channels: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """Each query's hits from the channel of its mode; an unknown mode is hybrid, or with ``strict`` an error."""
    known = F.col("mode").isin(*channels)
    other = F.raise_error(F.concat(F.lit("unknown mode "), text(F.col("mode")))).cast("string") if strict else F.lit("hybrid")
    moded = queries.select("query_id", F.when(known, F.col("mode")).otherwise(other).alias("mode"))
    out = None
    for mode, hits in channels.items():
        part = hits.select("query_id", "chunk_id", "rank", "score").join(moded.where(F.col("mode") == mode), "query_id")
        out = part if out is None else out.unionByName(part)
    return out


def fan_out(questions: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, variant, query) of up to ``limit`` distinct queries of each question (query_id, queries)."""
    q = F.slice(F.array_distinct(F.filter("queries", lambda x: x.isNotNull() & (F.trim(x) != ""))), 1, limit)
    return questions.select(F.col("query_id"), F.posexplode(q).alias("variant", "query"))


def merge_best(hits: DataFrame) -> DataFrame:
    """Each chunk once per query with its best score, first seen on ties; hits have ``seen``."""
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "seen")
    kept = hits.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "chunk_id")))


def retrieve_auto(analysed: DataFrame, channels: dict[str, DataFrame], chunks: DataFrame, k: int = DEFAULTS.final_k) -> DataFrame:
    """(query_id, chunk_id, rank, score, mode): each question's hits from the channel of its mode, of its target
    type where it has exactly one, the first k of them. analysed: (query_id, mode, target_types)."""
    asked = effective_filter(analysed)
    routed = route(asked, channels).join(asked.select("query_id", "type_filter"), "query_id").join(chunks.select("chunk_id", "chunk_type"), "chunk_id")
    return top(routed.where("type_filter is null or chunk_type = type_filter").drop("type_filter", "chunk_type").withColumnRenamed("rank", "rank_before"), k, "rank_before", "chunk_id").drop("rank_before")


# -- several queries of one question -----------------------------------------------

#: What tells one search from another.
SEARCH = ("query", "mode", "type_filter", "business_domain")
SUB_QUERIES = "array<struct<sub_query_id:string,question:string>>"


def _given(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def search_tasks(questions: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, query_variant, variant, sub_query_ord, sub_query_id, is_anchor, and what tells searches apart) of
    each query of each question.

    questions: (query_id, question) and where there queries, mode, target_types, business_domain, query_variant,
    sub_queries (an array of structs with sub_query_id and question) and anchor_queries. A question with sub-queries
    asks these, without a type filter, and its anchor queries; any other asks its first ``limit`` distinct queries,
    or itself, of its type if it has exactly one target type. ``variant`` numbers a question's queries."""
    texts = "array<string>"
    subs = F.coalesce(F.transform(F.col("sub_queries"), lambda s: F.struct(s["sub_query_id"].alias("sub_query_id"), s["question"].alias("question"))), F.array().cast(SUB_QUERIES)) if "sub_queries" in questions.columns else F.array().cast(SUB_QUERIES)
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast(texts)), lambda x: F.trim(x) != "")
    own = F.slice(F.array_distinct(clean(_given(questions, "queries", texts))), 1, limit)
    rows = questions.select(
        "query_id",
        F.coalesce(_given(questions, "query_variant", "string"), F.lit("ORIGINAL")).alias("query_variant"),
        F.coalesce(_given(questions, "mode", "string"), F.lit("hybrid")).alias("mode"),
        F.when(F.size(_given(questions, "target_types", texts)) == 1, F.get(_given(questions, "target_types", texts), F.lit(0))).alias("one_type"),
        _given(questions, "business_domain", "string").alias("business_domain"),
        subs.alias("subs"),
        F.when(F.size(own) > 0, own).otherwise(F.array("question")).alias("own"),
        clean(_given(questions, "anchor_queries", texts)).alias("anchors"),
    )
    one = lambda q, i, sub, anchor, typed: F.struct(q.alias("query"), i.alias("sub_query_ord"), sub.alias("sub_query_id"), F.lit(anchor).alias("is_anchor"), F.lit(typed).alias("typed"))
    none = F.lit(None).cast("string")
    parts = F.transform("subs", lambda s, i: one(F.concat(s["question"]), i + 1, F.concat(s["sub_query_id"]), False, False))
    anchors = F.transform("anchors", lambda q: one(F.concat(q), F.size("subs") + 1, F.lit("ANCHOR"), True, True))
    plain = F.transform("own", lambda q: one(F.concat(q), F.lit(None).cast("int"), none, False, True))
    tasks = rows.select("query_id", "query_variant", "mode", "one_type", "business_domain", F.posexplode(F.when(F.size("subs") > 0, F.concat(parts, anchors)).otherwise(plain)).alias("variant", "t"))
    return tasks.select("query_id", "query_variant", "variant", "t.sub_query_ord", "t.sub_query_id", "t.is_anchor", "t.query", "mode", F.when(F.col("t.typed"), F.col("one_type")).alias("type_filter"), "business_domain")


def multi_retrieve(questions: DataFrame, search, round_no: int = 1, limit: int = 5) -> DataFrame:
    """The hits of every query of every question, with where they come from: query_id, round_no, query_variant,
    variant, sub_query_ord, sub_query_id, is_anchor, query, rank, chunk_id, score and source.

    ``search`` gives (search_id, rank, chunk_id, score, source) of a table (search_id, query, mode, type_filter,
    business_domain). Each distinct search is made once, however many questions ask it; its hits are joined back."""
    key = F.sha2(F.to_json(F.struct(*SEARCH)), 256)
    tasks = search_tasks(questions, limit).withColumn("search_id", key)
    found = search(tasks.select("search_id", *SEARCH).distinct())
    return tasks.join(found.select("search_id", "rank", "chunk_id", "score", "source"), "search_id").select("query_id", F.lit(round_no).alias("round_no"), "query_variant", "variant", "sub_query_ord", "sub_query_id", "is_anchor", "query", "rank", "chunk_id", "score", "source")


def keyword_channel(index: keyword.KeywordIndex, k: int = DEFAULTS.channel_k):
    """A ``search`` for ``multi_retrieve`` over a keyword index."""

    def search(searches: DataFrame) -> DataFrame:
        domains = F.when(F.col("business_domain").isNotNull(), F.array("business_domain"))
        return keyword.search(index, searches.select(F.col("search_id").alias("query_id"), "query", "type_filter", domains.alias("domains")), k).withColumnRenamed("query_id", "search_id")

    return search


def merge_tasks(hits: DataFrame, k: int = DEFAULTS.rerank_limit, quota: int = DEFAULTS.sub_query_quota) -> DataFrame:
    """(query_id, rank, chunk_id, score, source, sub_query_ids) of a round's hits: sub-queries fused with their
    anchors as the last one, other questions' chunks by their best score, first seen on ties."""
    split = hits.where("sub_query_id is not null")
    anchored = with_anchor(split.where("not is_anchor"), split.where("is_anchor"))
    fused = fuse_subqueries(anchored, k, quota).select("query_id", "rank", "chunk_id", "score", F.lit("sub_query").alias("source"), "sub_query_ids")
    seen = hits.where("sub_query_id is null").withColumn("seen", F.struct("variant", "rank"))
    best = merge_best(seen).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score", "source", F.array().cast("array<string>").alias("sub_query_ids"))
    return fused.unionByName(best)
