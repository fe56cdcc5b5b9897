"""Fusion, quotas, context, metrics, attribution and policies, with values worked by hand."""

import pytest
from pyspark.sql import functions as F

from quern.operators import analysis, context, experiment, fusion, metrics, retrieval


def test_rrf_and_ties(spark):
    rows = [("q", 1, 1, 0.9, "vector"), ("q", 2, 2, 0.8, "vector"), ("q", 2, 1, 5.0, "bm25"), ("q", 3, 2, 4.0, "bm25"), ("q", 4, 51, 1.0, "bm25")]
    got = fusion.rrf(spark.createDataFrame(rows, "query_id string, chunk_id long, rank int, score double, source string")).orderBy("rank").collect()
    assert [(r.chunk_id, r.sources) for r in got] == [(2, ["bm25", "vector"]), (1, ["vector"]), (3, ["bm25"])]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_round_fusion(spark):
    attempts = spark.createDataFrame([("q", 1, "INITIAL", 0.0), ("q", 2, "QUERY_REWRITE", None)], "query_id string, round_no int, strategy string, weight double")
    hits = spark.createDataFrame([("q", 1, 1, 1, 0.9, "h"), ("q", 1, 2, 2, 0.8, "h"), ("q", 2, 1, 2, 0.9, "h"), ("q", 2, 2, 3, 0.7, "h")], "query_id string, round_no int, rank int, chunk_id long, score double, source string")
    got = fusion.fuse_rounds(attempts, hits).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3] and got[0].score == pytest.approx(1 / 62 + 0.9 / 61, abs=1e-9) and got[0].rounds == [1, 2]


SUB = "query_id string, sub_query_ord int, sub_query_id string, rank int, chunk_id long"


def test_sub_query_fusion_quota_and_coverage(spark):
    hits = spark.createDataFrame([("q", 1, "SQ1", 1, 1), ("q", 1, "SQ1", 2, 2), ("q", 2, "SQ2", 1, 3), ("p", 1, "SQ1", 1, 7), ("p", 2, "SQ2", 1, 7)], SUB)
    got = fusion.fuse_subqueries(hits, k=2)
    assert {r.chunk_id for r in got.where("query_id = 'q'").collect()} == {1, 3}
    p = got.where("query_id = 'p'").collect()
    assert len(p) == 1 and p[0].sub_query_ids == ["SQ1", "SQ2"] and p[0].score == pytest.approx(2 / 61, abs=1e-9)
    cand = spark.createDataFrame([("q", 1, 1, ["SQ1"]), ("q", 2, 2, ["SQ1"]), ("q", 3, 3, ["SQ2"])], "query_id string, rank int, chunk_id long, sub_query_ids array<string>")
    subs = spark.createDataFrame([("q", 1, "SQ1", "a"), ("q", 2, "SQ2", "b")], "query_id string, sub_query_ord int, sub_query_id string, question string")
    got = fusion.restore_quota(cand.where("rank <= 2"), cand, subs, n=2).orderBy("rank").collect()
    assert [(r.chunk_id, r.quota_restored) for r in got] == [(1, False), (3, True)]
    cover = fusion.coverage(subs, cand, cand.where("rank <= 2")).orderBy("sub_query_id").collect()
    assert [(r.candidate_count, r.final_count, r.covered, r.coverage_rate) for r in cover] == [(2, 2, True, 0.5), (1, 0, False, 0.5)]
    anchored = fusion.with_anchor(hits.where("query_id = 'q'"), spark.createDataFrame([("q", 1, 9)], "query_id string, rank int, chunk_id long"))
    assert anchored.where("chunk_id = 9").first().sub_query_id == "ANCHOR"


def test_ranking_metrics(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_code string")
    hits = spark.createDataFrame([("a", i + 1, c) for i, c in enumerate([101, 101, 102, 999])] + [("b", i + 1, c) for i, c in enumerate([103, 101, 101, 102])], "case_code string, rank int, chunk_id long")
    gold = spark.createDataFrame([("a", 101, 1), ("a", 102, 1), ("b", 101, 3), ("b", 102, 2), ("b", 103, 1)], "case_code string, chunk_id long, grade int")
    got = {r.case_code: r for r in metrics.ranking_metrics(cases, hits, gold, ks=(1, 3), ndcg_ks=(3,)).collect()}
    assert (got["a"].recall_at_1, got["a"].recall_at_3) == (0.5, 1.0) and got["b"].ndcg_at_3 == pytest.approx(0.736364, abs=1e-6)
    assert got["c"].recall_at_1 is None and got["c"].reciprocal_rank is None and got["c"].ndcg_at_3 is None
    with pytest.raises(ValueError):
        metrics.ranking_metrics(cases, hits, gold, ks=(0,))
    with pytest.raises(Exception, match="grade outside"):
        metrics.ranking_metrics(cases, hits, gold.withColumn("grade", F.lit(4))).collect()


def test_facts_citations_actions(spark):
    cases = spark.createDataFrame([("a",)], "case_code string")
    facts = spark.createDataFrame([("a", 101, "refund_window"), ("a", 102, "coupon_return"), ("a", 103, "risk_exception"), ("a", 103, "refund_window")], "case_code string, chunk_id long, fact_key string")
    hits = spark.createDataFrame([("a", 1, 101), ("a", 2, 101), ("a", 3, 103)], "case_code string, rank int, chunk_id long")
    assert metrics.fact_coverage(cases, hits, facts).first().fact_coverage == pytest.approx(2 / 3, abs=1e-6)
    cite = metrics.citation_metrics(cases, spark.createDataFrame([("a", 1), ("a", 2)], "case_code string, chunk_id long"), spark.createDataFrame([("a", 1), ("a", 5), ("a", 6)], "case_code string, chunk_id long")).first()
    assert (cite.citation_precision, cite.citation_recall, cite.true_positives) == (0.5, pytest.approx(1 / 3, abs=1e-6), 1)
    results = spark.createDataFrame([("ANSWER", "ANSWER"), ("REFUSE", "ANSWER"), ("CLARIFY", "CLARIFY"), ("ANSWER", "ERROR")], "expected_action string, actual_action string")
    a = metrics.action_accuracy(results).first()
    assert (a.correct, a.accuracy, a.errors) == (2, 0.5, 1)
    m = {r.expected_action: r for r in metrics.confusion(results).collect()}
    assert m["ANSWER"].ERROR == 1 and m["REFUSE"].ANSWER == 1 and m["REFUSE"].REFUSE == 0
    per = {r.action: r for r in metrics.action_metrics(results).collect()}
    assert (per["ANSWER"].precision, per["ANSWER"].recall, per["REFUSE"].f1) == (0.5, 0.5, 0.0)


ATTR = "case_code string, status string, expected_action string, actual_action string, case_type string, judge_passed int, citation_recall double, citation_entailment_score double, completeness_score double, faithfulness_score double, answer_relevance_score double, conflict_handling_score double"


@pytest.mark.parametrize(
    "change,cover,want",
    [
        ({"status": "FAILED"}, (0, 0, 0), "EXECUTION_ERROR"), ({"expected_action": "REFUSE"}, (1, 1, 1), "FALSE_ANSWER"), ({"expected_action": "REFUSE", "actual_action": "REFUSE", "judge_passed": 0}, (1, 1, 1), "REFUSAL_QUALITY_FAILURE"),
        ({"expected_action": "CLARIFY"}, (1, 1, 1), "CLARIFICATION_NOT_SUPPORTED"), ({}, (0, 0, 0), "RETRIEVAL_MISS"), ({}, (0.5, 0.5, 0.5), "RETRIEVAL_PARTIAL"), ({}, (1, 0, 0), "RERANK_DROPPED"), ({}, (1, 0.5, 0.5), "RERANK_PARTIAL_DROP"),
        ({}, (1, 1, 0), "CONTEXT_DROPPED"), ({}, (1, 1, 0.5), "CONTEXT_PARTIAL_DROP"), ({"actual_action": "REFUSE"}, (1, 1, 1), "FALSE_REFUSAL"), ({"actual_action": "CLARIFY"}, (1, 1, 1), "ACTION_MISMATCH"),
        ({"citation_recall": 0.5, "completeness_score": 0.1}, (1, 1, 1), "CITATION_FAILURE"), ({"judge_passed": None}, (1, 1, 1), "JUDGE_MISSING"), ({"judge_passed": 0}, (1, 1, 1), "ANSWER_QUALITY_FAILURE"), ({}, (1, 1, 1), "PASS"), ({}, (None, None, None), "PASS"),
    ],
)
def test_attribution_order(spark, change, cover, want):
    row = {"case_code": "a", "status": "SUCCESS", "expected_action": "ANSWER", "actual_action": "ANSWER", "case_type": "DIRECT", "judge_passed": 1, "citation_recall": 1.0, "citation_entailment_score": 1.0, "completeness_score": 1.0, "faithfulness_score": 1.0, "answer_relevance_score": 1.0, "conflict_handling_score": None} | change
    cov = spark.createDataFrame([("a", *[None if x is None else float(x) for x in cover])], "case_code string, merged double, rerank double, final double")
    got = metrics.attribute(spark.createDataFrame([tuple(row.values())], ATTR), cov).first()
    assert got.primary_code == want and want not in got.secondary_codes


def test_calibration(spark):
    rows = spark.createDataFrame([(0.45, 0.42, 0.0), (0.50, 0.47, 0.5), (0.72, 0.66, 1.0), (0.86, 0.78, 1.0)], "top1 double, top3_mean double, fact_coverage double")
    r = metrics.calibrate(rows, "validation").first()
    assert (r.top1_threshold, r.top3_threshold, r.failure_recall, r.false_trigger_rate) == (0.55, 0.5, 1.0, 0.0)
    with pytest.raises(ValueError):
        metrics.calibrate(rows, "test")


def test_context_budget_and_rendering(spark):
    chunks = spark.createDataFrame([(i, "SOP" if i < 4 else "FAQ", f"t{i}", "字" * 2000, "ACTIVE" if i != 3 else "OFF") for i in range(1, 7)], "chunk_id long, chunk_type string, title string, content string, status string")
    relations = spark.createDataFrame([(1, 2, "PARENT_CHILD", 1), (1, 3, "PARENT_CHILD", 2), (1, 4, "PARENT_CHILD", 3)], "from_chunk_id long, to_chunk_id long, relation_type string, sort_order int")
    hits = spark.createDataFrame([("q", 1, 1, 0.5, 0.0), ("q", 5, 2, 0.4, None), ("q", 6, 3, 0.3, None)], "query_id string, chunk_id long, rank int, score double, rerank_score double")
    got = context.pack_context(hits, relations, chunks, max_tokens=6002).orderBy("place").collect()
    assert [(r.chunk_id, r.citation_id, r.relation) for r in got] == [(1, "C1", "SELF"), (2, "C2", "PARENT_CHILD")] and got[0].status == "TRUNCATED"
    packed = spark.createDataFrame([("q", 1, 1, "C1", ["SQ1", "SQ2"]), ("q", 2, 5, "C2", [])], "query_id string, place int, chunk_id long, citation_id string, sub_query_ids array<string>")
    subs = spark.createDataFrame([("q", 1, "SQ1", "甲"), ("q", 2, "SQ2", "乙"), ("q", 3, "SQ3", "丙")], "query_id string, sub_query_ord int, sub_query_id string, question string")
    text = context.render_grouped(packed, chunks, subs).first().context
    assert text.count("[C1]") == 2 and "丙\n（未找到相关证据）" in text and text.index("其他证据") > text.index("丙") and text.count("[C2]") == 1
    flat = context.render(packed, chunks)
    assert len(flat.select(F.explode(context.blocks(F.col("context")))).collect()) == 2
    answers = spark.createDataFrame([("q", "见[C1][C9]")], "query_id string, answer string")
    check = context.check_citations(answers, packed).first()
    assert (check.used, check.unknown, check.passed) == (["C1", "C9"], ["C9"], False) and context.cited_chunks(answers, packed).first().chunk_id == 1


def features(spark, **change):
    row = {"query_id": "q", "candidate_count": 5, "distinct_document_count": 3, "channel_overlap_at_10": 0.5, "rerank_top1": 0.9, "rerank_top3_mean": 0.8, "rerank_margin": 0.1, "target_type_coverage": 1.0, "exact_terms": [], "exact_term_coverage": 1.0, "distinct_version_count": 0, "comparison_intent": False} | change
    return spark.createDataFrame([tuple(row.values())], "query_id string, candidate_count long, distinct_document_count long, channel_overlap_at_10 double, rerank_top1 double, rerank_top3_mean double, rerank_margin double, target_type_coverage double, exact_terms array<string>, exact_term_coverage double, distinct_version_count long, comparison_intent boolean")


@pytest.mark.parametrize(
    "change,want",
    [
        ({"candidate_count": 0, "exact_terms": ["E1"], "exact_term_coverage": 0.0}, ("POOR", "RELAX_FILTER")), ({"exact_terms": ["E1"], "exact_term_coverage": 0.5, "comparison_intent": True}, ("WEAK", "FORCE_BM25")), ({"comparison_intent": True, "distinct_version_count": 1}, ("WEAK", "QUERY_REWRITE")),
        ({"target_type_coverage": 0.0, "rerank_top1": 0.1, "rerank_top3_mean": 0.1}, ("WEAK", "RELAX_FILTER")), ({"rerank_top1": 0.5, "rerank_top3_mean": 0.5}, ("WEAK", "QUERY_REWRITE")), ({"candidate_count": 2}, ("WEAK", "QUERY_REWRITE")), ({}, ("GOOD", "NONE")),
    ],
)
def test_quality_policy(spark, change, want):
    got = analysis.quality_policy(features(spark, **change)).first()
    assert (got.quality, got.retry_strategy) == want
    if not change:
        assert got.quality_score == pytest.approx(0.15 + 0.1 + 0.05 + 0.25 * 0.9 + 0.15 * 0.8 + 0.1 + 0.075 + 0.075, abs=1e-6)


def test_analysis_and_retries(spark):
    q = spark.createDataFrame([("后台怎么操作退款？",), ("车在哪，不动了",), ("E1002 失败",), ("你好",)], "question string")
    got = analysis.analyse(q).collect()
    assert [(r.target_types, r["mode"], r.confidence) for r in got] == [(["RULE", "MANUAL"], "hybrid", 0.65), (["FAQ", "SOP", "RULE", "MANUAL"], "vector", 0.4), (["FAQ"], "bm25", 0.85), (["FAQ", "SOP", "RULE", "MANUAL"], "hybrid", 0.4)]
    assert got[1].rewritten == "车辆位置在哪里，不刷新" and "车辆位置不更新怎么处理" in got[1].queries
    gate = lambda t: spark.createDataFrame([(t,)], "t string").select(analysis.needs_decomposition(F.col("t"), F.lit(False)).alias("v")).first().v
    assert gate("订单怎么取消以及退款要等多少个小时到账呢") and not gate("怎么取消以及退款") and not gate("订单怎么取消以及新版退款要等多少个小时到账呢")
    rows = [("a", "E1002 怎么办", ["E1002 怎么办"], "hybrid", ["FAQ"], None, "FORCE_BM25", None, None), ("b", "x", ["x"], "vector", [], "order", "RELAX_FILTER", None, None), ("c", "新版与旧版区别", ["y"], "hybrid", [], None, "QUERY_REWRITE", None, None), ("d", "z", ["z"], None, [], None, "QUERY_REWRITE", "zz", ["z1", "zz", "z2", "z3"])]
    got = {r.query_id: r for r in analysis.plan_retry(spark.createDataFrame(rows, "query_id string, question string, queries array<string>, mode string, target_types array<string>, business_domain string, retry_strategy string, rewritten string, expanded array<string>")).collect()}
    assert got["a"].queries == ["E1002 E1002 怎么办", "E1002 怎么办"] and got["a"]["mode"] == "bm25" and got["a"].removed_filters == ["doc_type"]
    assert got["b"].business_domain is None and got["b"].removed_filters == ["business_domain"]
    assert "新版与旧版区别 V1 旧版 原规则" in got["c"].queries and got["c"].query_variant == "FALLBACK_REWRITE"
    assert got["d"].queries == ["zz", "z1", "z2"] and got["d"].query_variant == "REWRITTEN"


def test_decomposition_and_facts(spark):
    sub = "array<struct<question:string,target_types:array<string>,depends_on:string>>"
    plans = [("a", True, "PARALLEL", 0.9, [("甲？", ["faq", "x"], None), ("甲", [], None), ("乙", [], None)]), ("b", True, "PARALLEL", 0.5, [("甲", [], None), ("乙", [], None)]), ("c", True, "DEPENDENT", 0.9, [("甲", [], None), ("{{intermediate_fact}}乙", [], "SQ1")]), ("d", True, "DEPENDENT", 0.9, [("甲", [], None), ("乙", [], "SQ1")])]
    got = {r.query_id: r for r in analysis.validate_decomposition(spark.createDataFrame(plans, f"query_id string, requires boolean, decomposition_type string, benefit_score double, sub_queries {sub}")).collect()}
    assert [s.sub_query_id for s in got["a"].sub_queries] == ["SQ1", "SQ2"] and got["a"].sub_queries[0].target_types == ["FAQ"]
    assert got["b"].reason == "benefit too low" and got["c"].requires_decomposition and got["d"].reason == "the second hop is no template"
    facts = [("a", True, "七天", "七天 内", 1, 0.9), ("b", True, "核实订单后", "x", 1, 0.9), ("c", True, "七天", "七天内", 1, 0.5), ("d", True, "七天", "不在", 1, 0.9), ("e", True, "七天", "七天", 99, 0.9)]
    cand = spark.createDataFrame([(q, 1, 1, "规定七天内可退") for q in "abcde"], "query_id string, rank int, chunk_id long, content string")
    got = {r.query_id: r.reason for r in analysis.validate_fact(spark.createDataFrame(facts, "query_id string, success boolean, intermediate_fact string, evidence_quote string, supporting_chunk_id long, confidence double"), cand).collect()}
    assert got == {"a": None, "b": "only a connecting phrase", "c": "confidence too low", "d": "quote not in the chunk", "e": "not a candidate"}


def test_action_cascade(spark):
    policy = "ord int, code string, trigger_groups array<array<string>>, required_any_terms array<string>, excluded_terms array<string>, required_slots array<struct<code:string,label:string,values:array<string>>>, clarification_question string"
    policies = spark.createDataFrame([(1, "P", [["退款"], ["多久", "时间"]], [], ["规则"], [("ch", "渠道", ["微信", "支付宝"])], "哪个渠道？"), (2, "R", [["退款"]], [], [], [("x", "X", ["永不"])], "?")], policy)
    q = [("a", "退款多久", False, None, 0.0), ("b", "微信退款多久到", False, None, 0.0), ("c", "要3天吗", False, None, 0.0), ("d", "你好", True, "请补充", 0.8), ("e", "你好", False, None, 0.0), ("f", "你好", False, None, 0.0), ("g", "你好", False, None, 0.0)]
    contexts = spark.createDataFrame([("b", "内容"), ("c", "需要5天"), ("f", "内容"), ("g", "内容")], "query_id string, context string")
    assess = spark.createDataFrame([("f", False, 0.0, None, False, 0.9), ("g", False, 0.0, None, False, 0.5)], "query_id string, needs_clarification boolean, clarify_confidence double, clarify_question string, answerable boolean, answer_confidence double")
    d = analysis.decide(spark.createDataFrame(q, "query_id string, question string, need_clarification boolean, clarification_question string, confidence double"), policies, contexts, assess)
    got = {r.query_id: (r.action, r.decision_source) for r in d.collect()}
    assert got == {"a": ("CLARIFY", "POLICY_ENGINE"), "b": ("ANSWER", "FALLBACK"), "c": ("REFUSE", "CONSTRAINT_GUARD"), "d": ("CLARIFY", "QUERY_ANALYSIS"), "e": ("REFUSE", "EMPTY_CONTEXT"), "f": ("REFUSE", "LLM_EVIDENCE"), "g": ("ANSWER", "FALLBACK")}
    said = {r.query_id: (r.status, r.answer) for r in analysis.direct_response(d).collect()}
    assert said["a"] == ("CLARIFIED", "哪个渠道？") and said["c"] == ("REFUSED", analysis.REFUSE_TEXT)


def test_fan_out_keeps_distinct_queries(spark):
    assert [r.query for r in retrieval.fan_out(spark.createDataFrame([("q", ["a", "a", " ", "b"])], "query_id string, queries array<string>")).collect()] == ["a", "b"]


def test_two_hop_chain(spark):
    w = spark.createDataFrame([("a", "七天", 1, "七天 之后怎么办", ["7天", "七天"]), ("b", None, None, "x", ["y"])], "case_code string, intermediate_fact string, supporting_chunk_id long, second_query string, aliases array<string>")
    rows = [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]
    flags = {r.case_code: r for r in experiment.chain_flags(w, spark.createDataFrame(rows[:2], "case_code string, hop int, chunk_id long"), spark.createDataFrame(rows, "case_code string, hop int, chunk_id long")).collect()}
    assert flags["a"].end_to_end and not flags["b"].first_hop_hit and not flags["b"].end_to_end


def test_quotas_are_restored_in_batches_of_questions(spark, capsys):
    """Each question's rows are a row of lists, and no function is called once a question."""
    reranked = spark.createDataFrame([(q, r, r, ["SQ1"]) for q in range(50) for r in (1, 2)], "query_id long, rank int, chunk_id long, sub_query_ids array<string>")
    candidates = reranked.unionByName(spark.createDataFrame([(q, 3, 9, ["SQ2"]) for q in range(50)], reranked.schema))
    subs = spark.createDataFrame([(q, o, f"SQ{o}") for q in range(50) for o in (1, 2)], "query_id long, sub_query_ord int, sub_query_id string")
    out = fusion.restore_quota(reranked, candidates, subs, n=2, quota=1)
    assert {(r.rank, r.chunk_id, r.quota_restored) for r in out.collect()} == {(1, 1, False), (2, 9, True)} and out.count() == 100
    out.explain()
    shown = capsys.readouterr().out
    assert "MapInArrow" in shown and "FlatMapGroups" not in shown


def test_rounds_are_fused_in_as_many_tasks_as_the_rows_ask_for(spark):
    """Hits move once, by question; adaptive execution may not merge the partitions that are sorted."""
    attempts = spark.createDataFrame([(1, 1, "INITIAL", 0.0), (1, 2, "QUERY_REWRITE", 0.0)], "query_id long, round_no int, strategy string, weight double")
    hits = spark.createDataFrame([(1, 1, 1, 7, 0.5, "vector"), (1, 2, 1, 8, 0.4, "bm25"), (1, 2, 2, 7, 0.3, "bm25"), (1, 3, 1, 9, 0.2, "bm25")], "query_id long, round_no int, rank int, chunk_id long, score double, source string")
    got = fusion.fuse_rounds(attempts, hits, rows=3_000_000)
    assert [(r.chunk_id, r.rounds, r.rank) for r in got.orderBy("rank").collect()] == [(7, [1, 2], 1), (8, [2], 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(query_id") >= 2 and "hashpartitioning(query_id" in plan and ", 6), REPARTITION_BY_NUM" in plan
    assert "hashpartitioning(query_id#" in plan and ", chunk_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_stages_of_facts_are_flags(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_code long")
    hits = spark.createDataFrame([(1, "hybrid", 7), (1, "RERANK", 7), (1, None, 8), (2, "final", 9), (2, "x", None)], "case_code long, channel string, chunk_id long")
    facts = spark.createDataFrame([(1, 7, "a"), (1, 8, "b"), (1, 6, "b"), (1, 5, "c"), (2, 9, "d"), (2, 9, None), (2, None, "e")], "case_code long, chunk_id long, fact_key string")
    made = metrics.stage_coverage(cases, hits, facts)
    got = {r.case_code: (r.merged, r.rerank, r.final, r.missing_merged, r.missing_final) for r in made.collect()}
    assert got == {1: (0.666667, 0.333333, 0.0, ["c"], ["a", "b", "c"]), 2: (0.0, 0.0, 0.5, ["d", "e"], ["e"]), 3: (None, None, None, None, None)}
    assert "array_contains" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_the_three_lists_of_a_case_are_one_pass(spark):
    from quern.plans import catalog

    rows = spark.createDataFrame([(1, r, 100 + r) for r in (1, 5, 6, 10, 11)], "case_code long, rank int, chunk_id long")
    hits = catalog._stage_hits(lambda table: {"case_hits": rows}[table])
    got = sorted((r.channel, r.chunk_id - 100) for r in hits.collect())
    assert got == sorted([("hybrid", r) for r in (1, 5, 6, 10, 11)] + [("rerank", r) for r in (1, 5, 6, 10)] + [("FINAL", r) for r in (1, 5)])
    assert "Union" not in hits._jdf.queryExecution().optimizedPlan().toString()
