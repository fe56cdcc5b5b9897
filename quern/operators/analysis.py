"""Query analysis, retrieval grading, retries and answer actions as column rules.

First-match rules are one ordered ``when``; every function maps a table of
questions to the same questions with more columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.text import (
    comparison_intent,
    constraints,
    contains_any,
    exact_terms,
    explicit_versions,
    fill_template,
    letters,
    ordered_distinct,
    strip,
    text,
)

#: Words that point to a type of document, in the order of the types.
TYPE_WORDS = {
    "RULE": ("规则", "能不能", "是否", "可不可以", "支持吗", "退款", "扣费", "条件", "限制", "例外", "生效", "条款", "第", "违约", "赔付"),
    "SOP": ("流程", "排查", "处理流程", "怎么处理", "如何处理", "步骤", "先做什么", "转人工", "异常处理"),
    "MANUAL": ("后台", "怎么操作", "在哪里", "入口", "菜单", "按钮", "点击", "配置", "新增", "编辑", "删除", "补发", "导出"),
    "FAQ": ("怎么办", "为什么", "什么原因", "常见问题", "不刷新", "离线", "看不到", "失败", "异常"),
}
ALL_TYPES = ("FAQ", "SOP", "RULE", "MANUAL")
EXACT_SIGNAL = r"\d+\.\d+(\.\d+)*|[A-Z]\d{3,}|【.+?】|/api/[a-zA-Z0-9_/\-]+|[a-zA-Z_]+_status"
SPOKEN_WORDS = ("咋", "怎么回事", "一直", "好像", "不太对", "看不到", "不动了", "没反应")
#: Replacements in a rewrite, in order, and queries added for a subject.
REWRITES = (("车位置", "车辆位置"), ("车在哪", "车辆位置在哪里"), ("不动了", "不刷新"), ("看不到车", "看不到车辆位置"), ("咋", "怎么"))
LOCATION_QUERIES = ("车辆定位不刷新怎么办", "车辆位置不更新怎么处理", "设备离线导致定位不刷新怎么排查")
REFUND_QUERIES = ("退款规则", "已发货订单退款条件", "订单退款例外情况")
COMPLEX_MARKERS = ("以及", "并且", "同时", "分别", "另外", "然后", "在此之前", "还需要")
CHOICE_MARKERS = ("还是", "或者应该")
FALLBACK_COMPARISON = ("新旧", "新版", "旧版", "版本", "区别", "不同")
CONNECTOR = r"^(?:核实|确认|判断|检查|查询|判定).{0,12}(?:后|之后)$"
#: What is said where no answer is given.
ASK_TEXT = "请补充问题所需的关键信息。"
REFUSE_TEXT = "当前知识库中没有足够信息回答该问题，建议补充相关 FAQ、SOP、业务规则或操作手册后再查询。"


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def target_types(question: Column) -> Column:
    """The types whose words occur; all four if none does."""
    found = F.array_compact(F.array(*[F.when(contains_any(question, words), t) for t, words in TYPE_WORDS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(_strings(*ALL_TYPES))


def mode(question: Column) -> Column:
    return F.when(text(question).rlike(EXACT_SIGNAL), "bm25").when(contains_any(question, SPOKEN_WORDS), "vector").otherwise("hybrid")


def rewrite(question: Column) -> Column:
    out = text(question)
    for old, new in REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def expand(question: Column) -> Column:
    again = rewrite(question)
    more = F.when(F.contains(question, F.lit("定位")) | F.contains(again, F.lit("车辆位置")), _strings(*LOCATION_QUERIES)).otherwise(_strings())
    return F.array_distinct(F.concat(F.array(question, again), more, F.when(F.contains(question, F.lit("退款")), _strings(*REFUND_QUERIES)).otherwise(_strings())))


def confidence(question: Column) -> Column:
    return F.when(target_types(question) == _strings(*ALL_TYPES), 0.4).when(text(question).rlike(EXACT_SIGNAL), 0.85).otherwise(0.65)


def analyse(questions: DataFrame, column: str = "question") -> DataFrame:
    q = strip(F.col(column))
    return questions.withColumns({"target_types": target_types(q), "mode": mode(q), "rewritten": rewrite(q), "queries": expand(q), "confidence": confidence(q)})


def needs_decomposition(question: Column, need_clarification: Column, enabled: bool = True, least: int = DEFAULTS.gate_length) -> Column:
    q = strip(question)
    marks = F.char_length(q) - F.char_length(F.regexp_replace(q, "[?？]", ""))
    return F.lit(enabled) & ~F.coalesce(need_clarification, F.lit(False)) & (F.char_length(q) >= least) & ~comparison_intent(q) & ~contains_any(q, CHOICE_MARKERS) & ((marks >= 2) | contains_any(q, COMPLEX_MARKERS))


def validate_decomposition(plans: DataFrame, least: float = DEFAULTS.min_benefit, most: int = DEFAULTS.max_sub_queries, dependent: bool = True) -> DataFrame:
    """(query_id, requires_decomposition, decomposition_type, sub_queries, reason) of plans (query_id, requires,
    decomposition_type, benefit_score, sub_queries array<struct<question, target_types, depends_on>>)."""
    items = plans.select("query_id", F.posexplode("sub_queries").alias("o", "s")).select("query_id", "o", F.trim(F.regexp_replace(text(F.col("s.question")), r"(?U)\s+", " ")).alias("q"), "s.target_types", "s.depends_on")
    items = items.withColumn("norm", F.lower(F.regexp_replace("q", r"[？?。 ]+$", ""))).where("norm <> ''")
    once = items.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "norm").orderBy("o"))).where("n = 1")
    once = once.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("o"))).where(F.col("k") <= most)
    types = F.array_distinct(F.filter(F.transform(F.coalesce("target_types", _strings()), lambda t: F.upper(F.trim(t))), lambda t: t.isin(*ALL_TYPES)))
    sub = F.struct("k", F.concat(F.lit("SQ"), F.col("k").cast("string")).alias("sub_query_id"), F.col("q").alias("question"), types.alias("target_types"), "depends_on", F.contains("q", F.lit("{{intermediate_fact}}")).alias("is_template"))
    made = once.groupBy("query_id").agg(F.array_sort(F.collect_list(sub)).alias("subs"))
    joined = plans.drop("sub_queries").join(made, "query_id", "left")
    first, second = F.get("subs", F.lit(0)), F.get("subs", F.lit(1))
    reason = (
        F.when(~F.coalesce("requires", F.lit(False)), "not required")
        .when(F.coalesce("benefit_score", F.lit(0.0)) < least, "benefit too low")
        .when((F.col("decomposition_type") == "DEPENDENT") & F.lit(not dependent), "dependent plans are off")
        .when(~F.coalesce(F.col("decomposition_type").isin("PARALLEL", "DEPENDENT"), F.lit(False)), "unknown type")
        .when(F.coalesce(F.size("subs"), F.lit(0)) < 2, "fewer than two sub-queries")
        .when((F.col("decomposition_type") == "DEPENDENT") & (F.size("subs") != 2), "a dependent plan has two sub-queries")
        .when((F.col("decomposition_type") == "DEPENDENT") & (first["depends_on"].isNotNull() | ~second["depends_on"].eqNullSafe(first["sub_query_id"])), "wrong dependency")
        .when((F.col("decomposition_type") == "DEPENDENT") & ~second["is_template"], "the second hop is no template")
    )
    return joined.withColumn("reason", reason).select("query_id", F.col("reason").isNull().alias("requires_decomposition"), "decomposition_type", F.when(F.col("reason").isNull(), F.col("subs")).alias("sub_queries"), "reason")


def quality_features(questions: DataFrame, merged: DataFrame, reranked: DataFrame) -> DataFrame:
    """One row of features per question (query_id, question, target_types).

    merged: (query_id, rank, chunk_id, doc_id, chunk_type, sources, content, title, title_path, source_section,
    version); reranked: the same with rerank_score and score. Texts and versions come from the reranked rows
    where a question has any."""
    score = F.coalesce(F.nullif("rerank_score", F.lit(0.0)), F.nullif("score", F.lit(0.0)), F.lit(0.0))
    overlap = F.array_contains("sources", "bm25") & F.array_contains("sources", "vector")
    m = merged.groupBy("query_id").agg(
        F.count("*").alias("candidate_count"),
        F.countDistinct("doc_id").alias("distinct_document_count"),
        F.avg(F.when(F.col("rank") <= 10, overlap.cast("double"))).alias("overlap"),
        F.collect_set(F.upper("chunk_type")).alias("types"),
    )
    r = reranked.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, score)).alias("top1"), F.max(F.when(F.col("rank") == 2, score)).alias("top2"), F.avg(F.when(F.col("rank") <= 3, score)).alias("top3")
    )
    read = ("query_id", "content", "title", "title_path", "source_section", "version")
    asked = questions.select("query_id", F.explode(exact_terms(F.col("question"))).alias("term"))

    def shown(evidence, name):
        """The exact terms and the versions that the evidence of each question holds."""
        whole = evidence.select("query_id", F.lower(F.concat_ws("\n", "content", "title", "title_path", "source_section")).alias("shown"))
        covered = asked.join(whole, "query_id").where(F.contains("shown", F.lower("term"))).groupBy("query_id").agg(F.countDistinct("term").alias(f"covered_{name}"))
        seen = evidence.select("query_id", F.explode(explicit_versions(F.col("content"), F.col("version"))).alias("v")).groupBy("query_id").agg(F.countDistinct("v").alias(f"versions_{name}"))
        return covered, seen

    # No question is in both parts, so they are joined side by side; a union of them would have to keep its parts' partitions.
    rest = merged.join(reranked.select("query_id").distinct(), "query_id", "left_anti")
    sides = [*shown(reranked.select(*read), "own"), *shown(rest.select(*read), "rest")]
    q = questions.select("query_id", "question", "target_types", exact_terms(F.col("question")).alias("exact_terms"))
    out = q.join(m, "query_id", "left").join(r, "query_id", "left")
    for side in sides:
        out = out.join(side, "query_id", "left")
    out = out.withColumns({"covered": F.coalesce("covered_own", "covered_rest"), "distinct_version_count": F.coalesce("versions_own", "versions_rest")})
    wanted = F.array_distinct(F.transform(F.filter(F.coalesce("target_types", _strings()), lambda t: t != ""), F.upper))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "query_id",
        zero("candidate_count").cast("long").alias("candidate_count"),
        zero("distinct_document_count").cast("long").alias("distinct_document_count"),
        F.round(zero("overlap"), 6).alias("channel_overlap_at_10"),
        F.round(zero("top1"), 6).alias("rerank_top1"),
        F.round(zero("top3"), 6).alias("rerank_top3_mean"),
        F.round(F.when(F.col("top2").isNull(), zero("top1")).otherwise(F.greatest(F.col("top1") - F.col("top2"), F.lit(0.0))), 6).alias("rerank_margin"),
        F.round(F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, F.coalesce("types", _strings()))) / F.size(wanted)), 6).alias("target_type_coverage"),
        "exact_terms",
        F.round(F.when(F.size("exact_terms") == 0, 1.0).otherwise(zero("covered") / F.size("exact_terms")), 6).alias("exact_term_coverage"),
        zero("distinct_version_count").cast("long").alias("distinct_version_count"),
        comparison_intent(F.col("question")).alias("comparison_intent"),
    )


def quality_policy(features: DataFrame, config=DEFAULTS) -> DataFrame:
    """``features`` with quality_score, quality, retry_strategy and reason; the first rule that holds wins."""
    part = lambda c, most: F.least(F.col(c) / most, F.lit(1.0))
    capped = lambda c: F.least(F.col(c), F.lit(1.0))
    score = (
        0.15 * part("candidate_count", config.min_candidates) + 0.10 * part("distinct_document_count", config.min_documents) + 0.10 * capped("channel_overlap_at_10")
        + 0.25 * capped("rerank_top1") + 0.15 * capped("rerank_top3_mean") + 0.10 * capped("target_type_coverage") + 0.075 * capped("exact_term_coverage")
        + 0.075 * F.when(F.col("comparison_intent"), part("distinct_version_count", config.min_versions)).otherwise(1.0)
    )
    rules = [
        (F.col("candidate_count") == 0, "POOR", "RELAX_FILTER", "no candidates"),
        ((F.size("exact_terms") > 0) & (F.col("exact_term_coverage") < 1), "WEAK", "FORCE_BM25", "exact terms missing"),
        (F.col("comparison_intent") & (F.col("distinct_version_count") < config.min_versions), "WEAK", "QUERY_REWRITE", "too few versions"),
        (F.col("target_type_coverage") == 0, "WEAK", "RELAX_FILTER", "no wanted type"),
        ((F.col("rerank_top1") < config.rerank_top1) & (F.col("rerank_top3_mean") < config.rerank_top3), "WEAK", "QUERY_REWRITE", "low relevance"),
        ((F.col("candidate_count") < config.min_candidates) | (F.col("distinct_document_count") < config.min_documents), "WEAK", "QUERY_REWRITE", "too few candidates or documents"),
    ]
    chosen = None
    for rule, *out in rules:
        row = F.struct(*[F.lit(x).alias(n) for x, n in zip(out, ("quality", "retry_strategy", "reason"), strict=True)])
        chosen = F.when(rule, row) if chosen is None else chosen.when(rule, row)
    good = F.struct(F.lit("GOOD").alias("quality"), F.lit("NONE").alias("retry_strategy"), F.lit("good enough").alias("reason"))
    return features.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 6)).withColumn("_d", chosen.otherwise(good)).select("*", "_d.*").drop("_d")


#: The reason of a retry that asks single sub-queries again.
UNCOVERED = "sub-query evidence missing"


def coverage_override(graded: DataFrame) -> DataFrame:
    """A decomposed question that lacks a sub-query's evidence and has no retry yet is rewritten."""
    weak = F.coalesce("decomposed", F.lit(False)) & (F.coalesce("coverage_rate", F.lit(1.0)) < 1) & (F.col("retry_strategy") == "NONE")
    return graded.withColumns({"quality": F.when(weak, "WEAK").otherwise(F.col("quality")), "retry_strategy": F.when(weak, "QUERY_REWRITE").otherwise(F.col("retry_strategy")), "reason": F.when(weak, UNCOVERED).otherwise(F.col("reason"))})


def rewrite_fallback(question: Column, current: Column) -> Column:
    """struct(rewritten, expanded) where no rewrite is supplied."""
    rewritten = strip(F.array_join(F.concat(exact_terms(question), F.array(question)), " "))
    more = F.when(contains_any(question, FALLBACK_COMPARISON), F.array(F.concat(question, F.lit(" 旧版 规则")), F.concat(question, F.lit(" 新版 生效规则")))).otherwise(F.slice(F.coalesce(current, _strings()), 1, 2))
    return F.struct(rewritten.alias("rewritten"), F.slice(F.filter(F.array_distinct(more), lambda x: (x != "") & (x != rewritten)), 1, 2).alias("expanded"))


def supplied_rewrite(rewritten: Column, expanded: Column) -> Column:
    """struct(rewritten, expanded) of a model's row; null where it is incomplete."""
    r = F.trim(text(rewritten))
    clean = F.array_distinct(F.filter(F.transform(expanded, lambda x: F.trim(x)), lambda x: (x != "") & (x != r)))
    return F.when((r != "") & expanded.isNotNull(), F.struct(r.alias("rewritten"), F.slice(clean, 1, 2).alias("expanded")))


def plan_retry(questions: DataFrame) -> DataFrame:
    """The next round's queries, mode, types and domain of questions (query_id, question, queries, mode,
    target_types, business_domain, retry_strategy, rewritten, expanded); without a rewrite the fallback is used."""
    q, current = F.col("question"), F.coalesce("queries", F.array("question"))
    given = F.coalesce(supplied_rewrite(F.col("rewritten"), F.col("expanded")), rewrite_fallback(q, current))
    used_fallback = supplied_rewrite(F.col("rewritten"), F.col("expanded")).isNull()
    exact = ordered_distinct(F.concat(F.array(strip(F.array_join(F.concat(exact_terms(q), F.array(q)), " "))), current))
    compared = ordered_distinct(F.concat(F.array(given["rewritten"], F.concat(q, F.lit(" V1 旧版 原规则")), F.concat(q, F.lit(" V2 新版 当前规则"))), given["expanded"]), 5)
    plain = ordered_distinct(F.concat(F.array(given["rewritten"]), given["expanded"]))
    bm25, relax = F.col("retry_strategy") == "FORCE_BM25", F.col("retry_strategy") == "RELAX_FILTER"
    types = F.coalesce("target_types", _strings())
    has_types = F.size(types) > 0
    drop_types = F.when(relax, has_types).otherwise(F.size(types) == 1)
    drop_domain = relax & ~has_types & (text(F.col("business_domain")) != "")
    return questions.select(
        "query_id",
        F.when(bm25, exact).when(relax, current).when(comparison_intent(q), compared).otherwise(plain).alias("queries"),
        F.when(bm25, "bm25").otherwise(F.coalesce("mode", F.lit("hybrid"))).alias("mode"),
        F.when(drop_types, _strings()).otherwise(types).alias("target_types"),
        F.when(drop_domain, None).otherwise(F.col("business_domain")).alias("business_domain"),
        F.when(bm25, "EXACT").when(relax, "RELAXED").when(used_fallback, "FALLBACK_REWRITE").otherwise("REWRITTEN").alias("query_variant"),
        F.when(drop_types, _strings("doc_type")).when(drop_domain, _strings("business_domain")).otherwise(_strings()).alias("removed_filters"),
    )


def route(questions: DataFrame, rounds: int = DEFAULTS.rounds) -> DataFrame:
    """``questions`` with next_step: dependent, retry, context or finish."""
    found = F.coalesce("has_candidates", F.lit(False))
    early = F.coalesce("round_no", F.lit(1)) < rounds
    step = F.when(F.coalesce(F.col("dependent_status") == "FIRST_HOP_READY", F.lit(False)) & early & found, "dependent").when((F.col("retry_strategy") != "NONE") & early, "retry").when(found, "context").otherwise("finish")
    return questions.withColumn("next_step", step)


def final_status(questions: DataFrame) -> DataFrame:
    status = F.when(F.col("quality") == "POOR", "RETRIEVAL_INSUFFICIENT").when(F.coalesce("has_context", F.lit(False)), "CONTEXT_READY").when(F.coalesce("has_reranked", F.lit(False)), "RERANK_READY").otherwise("RETRIEVAL_READY")
    return questions.withColumn("status", status)


def grade_simple(questions: DataFrame, hits: DataFrame) -> DataFrame:
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return questions.select("query_id").join(n, "query_id", "left").withColumn("grade", F.when(F.coalesce("n", F.lit(0)) == 0, "POOR").when(F.col("n") == 1, "WEAK").otherwise("GOOD"))


def validate_fact(facts: DataFrame, candidates: DataFrame, least: float = DEFAULTS.fact_confidence, first: int = 5, chars: int = 2400) -> DataFrame:
    """``facts`` (query_id, success, intermediate_fact, evidence_quote, supporting_chunk_id, confidence) with
    accepted and reason; candidates: (query_id, rank, chunk_id, content)."""
    usable = candidates.where(strip(F.col("content")) != "").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= first)
    joined = facts.join(usable.select("query_id", F.col("chunk_id").alias("supporting_chunk_id"), F.substring("content", 1, chars).alias("body")), ["query_id", "supporting_chunk_id"], "left")
    fact = strip(F.regexp_replace(text(F.col("intermediate_fact")), r"(?U)\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(fact, r"(?U)\s+", ""), "^[，。；：]+|[，。；：]+$", "")
    reason = (
        F.when(~F.coalesce("success", F.lit(False)), "no fact found")
        .when((fact == "") | (strip(F.col("evidence_quote")) == "") | F.col("supporting_chunk_id").isNull(), "fact, quote and chunk are needed")
        .when(bare.rlike(CONNECTOR), "only a connecting phrase")
        .when(F.coalesce("confidence", F.lit(0.0)) < least, "confidence too low")
        .when(F.col("body").isNull(), "not a candidate")
        .when(~F.contains(F.regexp_replace("body", r"(?U)\s+", ""), F.regexp_replace("evidence_quote", r"(?U)\s+", "")), "quote not in the chunk")
    )
    return joined.withColumn("reason", reason).withColumn("intermediate_fact", fact).withColumn("accepted", F.col("reason").isNull()).drop("body")


def dependent_queries(plans: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, query): the second hop's query filled with the accepted fact, else the question itself."""
    good = facts.where("accepted").select("query_id", "intermediate_fact")
    joined = plans.join(good, "query_id", "left")
    return joined.select("query_id", F.when(F.col("intermediate_fact").isNull(), F.col("question")).otherwise(fill_template(F.col("template"), F.col("intermediate_fact"))).alias("query"))


def gate(rule: DataFrame, model: DataFrame, columns: tuple[str, ...], least: float = 0.6) -> DataFrame:
    """The model's columns where it has a row that is confident enough, the rule's otherwise."""
    other = model.select("query_id", F.col("confidence").alias("_c"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rule.join(other, "query_id", "left")
    use = F.coalesce(F.col("_c") >= least, F.lit(False))
    return joined.withColumns({c: F.when(use, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {"fallback_used": ~use}).drop("_c", *[f"_{c}" for c in columns])


#: Clarification policies at most.
POLICIES = 1000


def clarify(questions: DataFrame, policies: DataFrame) -> DataFrame:
    """(query_id, policy_code, clarification_question, missing_slots) of questions that lack a slot.

    policies: (ord, code, trigger_groups, required_any_terms, excluded_terms, required_slots
    array<struct<code, label, values>>, clarification_question), a configuration table of at most ``POLICIES`` rows
    that is collected into one literal; more are an error. The first policy that applies counts, also when nothing
    is missing."""
    rows = policies.orderBy("ord").limit(POLICIES + 1).collect()
    if len(rows) > POLICIES:
        raise ValueError(f"more than {POLICIES} policies")
    q = letters(F.col("question"))
    chosen = None
    bare = lambda s: "".join(c for c in s if c.isalnum()).lower()
    has = lambda terms: contains_any(q, [bare(t) for t in terms])
    for r in rows:
        applies = F.lit(True)
        for group in r["trigger_groups"]:
            applies = applies & has(group)
        if r["excluded_terms"]:
            applies = applies & ~has(r["excluded_terms"])
        if r["required_any_terms"]:
            applies = applies & has(r["required_any_terms"])
        missing = F.array_compact(F.array(*[F.when(~has(s["values"]), F.struct(F.lit(s["code"]).alias("code"), F.lit(s["label"]).alias("label"))) for s in r["required_slots"]]))
        row = F.struct(F.lit(r["code"]).alias("policy_code"), F.lit(r["clarification_question"]).alias("clarification_question"), missing.alias("missing_slots"))
        chosen = F.when(applies, row) if chosen is None else chosen.when(applies, row)
    if chosen is None:
        return questions.select("query_id").where(F.lit(False)).selectExpr("query_id", "cast(null as string) policy_code", "cast(null as string) clarification_question", "cast(null as array<struct<code:string,label:string>>) missing_slots")
    return questions.select("query_id", chosen.alias("p")).where("p is not null and size(p.missing_slots) > 0").select("query_id", "p.*")


def constraint_gap(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, missing): amounts of the question that its context does not state."""
    joined = questions.select("query_id", "question").join(contexts.select("query_id", "context"), "query_id", "left")
    missing = F.array_except(constraints(F.col("question")), constraints(F.col("context")))
    return joined.select("query_id", missing.alias("missing")).where(F.size("missing") > 0)


def decide(questions: DataFrame, policies: DataFrame, contexts: DataFrame, assessments: DataFrame, enabled: bool = True, config=DEFAULTS) -> DataFrame:
    """(query_id, action, decision_source, clarification_question, missing) by the ordered rules.

    questions: (query_id, question, need_clarification, clarification_question, confidence); assessments:
    (query_id, needs_clarification, clarify_confidence, clarify_question, answerable, answer_confidence)."""
    asked = clarify(questions, policies).select("query_id", "policy_code", F.col("clarification_question").alias("policy_question"), F.transform("missing_slots", lambda s: s["label"]).alias("labels"))
    gap = constraint_gap(questions, contexts).withColumnRenamed("missing", "gap")
    j = questions.join(asked, "query_id", "left").join(contexts.select("query_id", "context"), "query_id", "left").join(gap, "query_id", "left").join(assessments, "query_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    at_least = lambda c, t: F.coalesce(F.col(c) >= t, F.lit(False))
    none = _strings()
    made = lambda action, source, ask=None, missing=none: F.struct(F.lit(action).alias("action"), F.lit(source).alias("decision_source"), (F.lit(None).cast("string") if ask is None else ask).alias("ask"), missing.alias("missing"))
    d = (
        F.when(yes("need_clarification") & (strip(F.col("clarification_question")) != "") & at_least("confidence", config.clarify_confidence), made("CLARIFY", "QUERY_ANALYSIS", strip(F.col("clarification_question"))))
        .when(F.col("policy_code").isNotNull(), made("CLARIFY", "POLICY_ENGINE", F.col("policy_question"), F.coalesce("labels", none)))
        .when(strip(F.col("context")) == "", made("REFUSE", "EMPTY_CONTEXT", None, _strings("知识库证据")))
        .when(F.col("gap").isNotNull(), made("REFUSE", "CONSTRAINT_GUARD", None, F.coalesce("gap", none)))
        .when(F.lit(not enabled), made("ANSWER", "FALLBACK"))
        .when(yes("needs_clarification") & at_least("clarify_confidence", config.clarify_confidence) & (strip(F.col("clarify_question")) != ""), made("CLARIFY", "LLM_EVIDENCE", strip(F.col("clarify_question"))))
        .when(yes("answerable"), made("ANSWER", "LLM_EVIDENCE"))
        .when(F.col("answerable").isNotNull() & at_least("answer_confidence", config.refuse_confidence), made("REFUSE", "LLM_EVIDENCE"))
        .otherwise(made("ANSWER", "FALLBACK"))
    )
    return j.select("query_id", d.alias("d")).select("query_id", "d.action", "d.decision_source", F.col("d.ask").alias("clarification_question"), "d.missing")


def actual_action(status: Column) -> Column:
    return F.when(status == "SUCCESS", "ANSWER").when(status == "CLARIFIED", "CLARIFY").when(status == "REFUSED", "REFUSE").otherwise("ERROR")


def direct_response(decisions: DataFrame) -> DataFrame:
    """(query_id, status, answer) of decisions that are no answers."""
    clarified = F.col("action") == "CLARIFY"
    return decisions.where("action <> 'ANSWER'").select("query_id", F.when(clarified, "CLARIFIED").otherwise("REFUSED").alias("status"), F.when(clarified, F.coalesce(F.nullif("clarification_question", F.lit("")), F.lit(ASK_TEXT))).otherwise(F.lit(REFUSE_TEXT)).alias("answer"))


