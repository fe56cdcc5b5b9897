"""Evidence mapping, dedup, checks, planning, judging and the incremental forms."""

import pytest
from pyspark.sql import functions as F

from quern.operators import dataset, experiment, metrics
from quern.streaming import jobs

CHUNK = "doc_id long, chunk_id long, parent_chunk_id long, title string, content string, sort_order int, status string"


def test_evidence_tiers(spark):
    chunks = spark.createDataFrame(
        [(1, 101, None, "t", "说明：待支付订单 可由用户直接取消。", 1, "ACTIVE"), (1, 102, None, "t", "其他内容甲", 2, "ACTIVE"), (1, 103, None, "t", "乙结尾内容", 3, "ACTIVE"), (2, 201, None, "t", "父：七天退货。更多", 1, "ACTIVE"), (2, 202, 201, "t", "七天退货。", 2, "ACTIVE"), (3, 301, None, "t", "重复", 1, "ACTIVE"), (3, 302, None, "t", "重复", 2, "ACTIVE"), (1, 104, None, "t", "停用句子", 4, "OFF")],
        CHUNK,
    )
    docs = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "source_doc_code string, mapped_doc_id long")
    rows = [("1", "A", "待支付订单可由用户直接取消。"), ("2", "A", "待支付-订单可由用户，直接取消"), ("3", "A", "内容甲乙结尾"), ("4", "A", "没有"), ("5", "B", "七天退货。"), ("6", "C", "重复"), ("7", "Z", "x"), ("8", "A", "停用句子")]
    got = {r.case_code: (r.mapping_status, r.method, r.mapped_chunk_id) for r in dataset.map_evidence(spark.createDataFrame(rows, "case_code string, source_doc_code string, evidence_quote string"), docs, chunks).collect()}
    assert got == {
        "1": ("MAPPED", "EXACT", 101), "2": ("MAPPED", "PUNCTUATION_NORMALIZED", 101), "3": ("AMBIGUOUS", "ADJACENT_CHUNKS", None), "4": ("MISSING", "NOT_FOUND", None), "5": ("MAPPED", "EXACT_MOST_SPECIFIC", 202),
        "6": ("AMBIGUOUS", "EXACT", None), "7": ("MISSING", "NOT_FOUND", None), "8": ("MISSING", "NOT_FOUND", None),
    }
    facts = spark.createDataFrame([(2, "k", "七天退货"), (2, "m", "不在")], "doc_id long, fact_key string, fact_text string")
    assert {r.fact_key: r.chunk_ids for r in dataset.map_facts(facts, chunks).collect()} == {"k": [201, 202], "m": []}


def test_exact_correction(spark):
    chunks = spark.createDataFrame([(1, 11, None, "其他", "E1002 出现。E1002 又出现，说明较长。", 1, "ACTIVE"), (1, 12, None, "E1002 说明", "前文。错误码 E1002。", 2, "ACTIVE")], CHUNK)
    cases = spark.createDataFrame([("a", "E1002", 1), ("b", "E9", 1), ("c", "E1002", 1)], "case_code string, identifier string, doc_id long")
    evidence = spark.createDataFrame([("c", "含 E1002 的句子", 3), ("a", "E1002", 1)], "case_code string, evidence_quote string, relevance_grade int")
    got = {r.case_code: (r.chunk_id, r.evidence_quote, r.fact_key, r.resolved) for r in dataset.correct_exact(cases, evidence, chunks).collect()}
    assert got == {"a": (12, "错误码 E1002。", "exact_e1002", True), "b": (None, None, "exact_e9", False)}


def test_semantic_dedup_is_greedy(spark):
    rows = [(0, "dev", "D", [1.0, 0.0]), (1, "dev", "D", [0.99, 0.01]), (2, "dev", "D", [0.88, 0.47]), (3, "dev", "D", [0.0, 1.0]), (4, "dev", "P", [1.0, 0.0]), (5, "dev", "D", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "ord long, dataset_split string, case_type string, vec array<double>")
    got = {r.ord: (r.mark, r.nearest) for r in dataset.dedup_semantic(df).collect()}
    assert got == {0: ("KEEP", None), 1: ("DUPLICATE", 0), 2: ("REVIEW", 0), 3: ("KEEP", None), 4: ("KEEP", None), 5: ("KEEP", None)}


def test_semantic_dedup_equals_plain_version(spark):
    import math
    import random

    rnd = random.Random(3)
    vectors = [[rnd.uniform(0.2, 1) for _ in range(4)] for _ in range(60)]
    kept, want = [], {}
    for i, v in enumerate(vectors):
        sims = [(sum(a * b for a, b in zip(v, vectors[k], strict=True)) / math.hypot(*v) / math.hypot(*vectors[k]), k) for k in kept]
        best = max((s for s, _ in sims), default=0)
        want[i] = "DUPLICATE" if best >= 0.98 else "REVIEW" if best >= 0.95 else "KEEP"
        if want[i] != "DUPLICATE":
            kept.append(i)
    df = spark.createDataFrame([(i, "s", v) for i, v in enumerate(vectors)], "ord long, g string, vec array<double>")
    assert {r.ord: r.mark for r in dataset.dedup_semantic(df, ("g",), 0.98, 0.95).collect()} == want


def test_selection_and_deficits(spark):
    cases = spark.createDataFrame([("c1", "dev", "DIRECT", None, 0.9), ("c2", "dev", "DIRECT", None, 0.95), ("c3", "dev", "NO_ANSWER", "OUT", 0.9)], "case_code string, dataset_split string, case_type string, subtype string, review_score double").withColumns({"review_status": F.lit("PASSED"), "status": F.lit("ACTIVE")})
    quota = spark.createDataFrame([(1, "dev", "DIRECT", None, 1), (2, "dev", "NO_ANSWER", "OUT", 2)], "ord int, split string, case_type string, subtype string, n int")
    chosen, short = dataset.select_quota(cases, quota)
    assert {(r.case_code, r.new_code) for r in chosen.collect()} == {("c2", "CASE_DIRECT_001"), ("c3", "CASE_NO_ANSWER_001")}
    assert [(r.case_type, r.have, r.n) for r in short.collect()] == [("NO_ANSWER", 1, 2)]


def test_planning(spark):
    docs = spark.createDataFrame([("dev", f"D{i}", "t", "FAQ", [f"f{i}{k}" for k in range(2)], [f"I{i}"], "g" if i < 2 else None, f"V{i}") for i in range(3)], "split string, source_doc_code string, topic string, doc_type string, facts array<string>, required_identifiers array<string>, version_group string, version string")
    quota = spark.createDataFrame([("dev", "DIRECT", None, 4), ("dev", "MULTI_HOP", None, 2), ("dev", "EXACT", None, 1), ("dev", "CONFLICT", None, 2), ("dev", "NO_ANSWER", "MISSING_CONDITION", 1), ("dev", "NO_ANSWER", "OUT", 1)], "split string, case_type string, subtype string, n long")
    got = {(r.case_type, r.i): r for r in dataset.plan_seeds(quota, docs).collect()}
    assert [got["DIRECT", i].source_doc_codes for i in range(4)] == [["D0"], ["D1"], ["D2"], ["D0"]] and got["DIRECT", 3].fact_keys == ["f01"]
    assert got["MULTI_HOP", 1].source_doc_codes == ["D2", "D0"] and got["MULTI_HOP", 1].fact_keys == ["f21", "f00"] and got["EXACT", 0].required_identifier == "I0"
    assert [r.source_doc_codes for r in dataset.plan_conflicts(quota, docs).collect()] == [["D0", "D1"]] * 2
    assert {r.subtype: r.expected_action for r in dataset.plan_no_answer(quota).collect()} == {"MISSING_CONDITION": "CLARIFY", "OUT": "REFUSE"}
    assert dataset.plan_pool(quota).where("case_type = 'DIRECT'").first().n == 5
    extra = [(r.source_doc_code, r.fact_key) for r in dataset.plan_supplement(docs, "dev", "DIRECT", 5, 2, 1).orderBy("i").collect()]
    assert extra[0] == ("D2", "f21") and extra[1] == ("D0", "f00")


def test_checks(spark):
    bp = spark.createDataFrame([("A", ["B"], None, "g"), ("B", ["Z"], "A", "g"), ("B", [], None, None)], "source_doc_code string, conflicts_with array<string>, supersedes string, version_group string")
    got = {(r.code, r.entity_code) for r in dataset.check_blueprints(bp, expected=3, version_groups=1).collect()}
    assert got == {("DANGLING_REFERENCE", "B"), ("DUPLICATE_DOCUMENT_CODE", "B")}
    assert {r.source_doc_code for r in dataset.related_documents(spark.createDataFrame([("B",)], "source_doc_code string"), bp).collect()} == {"A", "B", "Z"}
    cases = spark.createDataFrame([("a", ("q", [("x", [1]), ("x", [2])])), ("b", None)], "case_code string, contract struct<clarification_question:string,branches:array<struct<condition_value:string,chunk_ids:array<bigint>>>>")
    chunks = spark.createDataFrame([(1, "ACTIVE"), (2, "OFF")], "chunk_id long, status string")
    assert {(r.code, r.entity_code) for r in dataset.check_contracts(cases, chunks).collect()} == {("BRANCH_VALUES_REPEAT", "a"), ("CHUNK_NOT_ACTIVE", "a"), ("CONTRACT_MISSING", "b")}
    seeds = spark.createDataFrame([("s", "EXACT", "E1", "退款规则", ["f"], ["证据"])], "seed_code string, case_type string, required_identifier string, title string, fact_keys array<string>, quotes array<string>")
    bad = spark.createDataFrame([("s", "退款规则是什么意思", "答", ["g"], ["别的"], 1)], "seed_code string, question string, reference_answer string, fact_keys array<string>, quotes array<string>, n_docs int")
    assert {r.code for r in dataset.check_cases_vs_seeds(bad, seeds).collect()} == {"TITLE_LEAK", "IDENTIFIER_MISSING", "FACTS_DIFFER", "QUOTE_NOT_CANONICAL"}
    codes = spark.createDataFrame([("Q",)], "source_doc_code string")
    with pytest.raises(Exception, match="unknown code"):
        dataset.select_blueprints(bp, codes).collect()


def test_freezing(spark, tmp_path):
    cases = spark.createDataFrame([("b", None), ("a", "x")], "case_code string, note string")
    dataset.export_frozen(cases, str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == ['{"case_code":"a","note":"x"}', '{"case_code":"b","note":null}']
    registry = spark.createDataFrame([], "name string, version string, sha256 string")
    one = dataset.freeze_version(cases, registry, "n", "1")
    assert dataset.freeze_version(cases.repartition(3), one, "n", "1").first().sha256 == one.first().sha256
    with pytest.raises(Exception, match="another digest"):
        dataset.freeze_version(cases.limit(1), one, "n", "1").collect()


def test_judging(spark):
    names = "faithfulness_score double, answer_relevance_score double, completeness_score double, citation_entailment_score double, conflict_handling_score double, refusal_correct boolean, clarification_correct boolean, passed boolean"
    reviews = [("a", 1, 0.9, 0.9, 0.82, 0.9, None, None, None, True), ("a", 2, 0.9, 0.9, 0.7, 0.9, None, None, None, False), ("b", 1, 0.9, 0.9, 0.9, 0.9, None, None, None, True), ("c", 1, None, None, None, None, None, True, None, True), ("d", 1, 0.9, 0.9, 0.9, 0.9, None, None, None, True)]
    cases = spark.createDataFrame([("a", "ANSWER", "DIRECT"), ("b", "ANSWER", "DIRECT"), ("c", "REFUSE", "NO_ANSWER"), ("d", "ANSWER", "CONFLICT")], "case_code string, expected_action string, case_type string")
    got = {r.case_code: (r.borderline, r.passed, r.completeness_score) for r in metrics.judge_final(cases, spark.createDataFrame(reviews, f"case_code string, review_no int, {names}")).collect()}
    assert got == {"a": (True, False, 0.76), "b": (False, True, 0.9), "c": (False, True, None), "d": (False, False, 0.9)}


def test_incremental_forms(spark, tmp_path):
    state = spark.createDataFrame([(1, "h", "SUCCESS", 0), (2, "h", "SUCCESS", 0), (3, "h", "PROCESSING", 1), (4, "h", "FAILED", 2)], "chunk_id long, text_hash string, status string, retry_count int")
    new = jobs.detect_changes(state, spark.createDataFrame([(1, "h"), (2, "x"), (3, "h"), (5, "n")], "chunk_id long, text_hash string"))
    assert {r.chunk_id: r.status for r in new.collect()} == {1: "SUCCESS", 2: "PENDING", 3: "PENDING", 4: "FAILED", 5: "PENDING"}
    done = jobs.apply_outcomes(new, spark.createDataFrame([(2, True), (3, False)], "chunk_id long, ok boolean"))
    assert {r.chunk_id: (r.status, r.retry_count) for r in done.where("chunk_id in (2, 3)").collect()} == {2: ("SUCCESS", 0), 3: ("FAILED", 2)}
    files = tmp_path / "in"
    files.mkdir()
    for i, t in enumerate(["内部资料\n正文", "另一个", "内部资料\n正文"]):
        (files / f"{i}.txt").write_text(t, encoding="utf-8")
    stream = spark.readStream.text(str(files), wholetext=True).withColumnRenamed("value", "content")
    run = jobs.arriving_documents(stream, "FAQ").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(60)
    assert sorted(r.clean_content for r in spark.table("arrived").collect()) == ["另一个", "正文"]


def test_resume_and_outcomes(spark):
    results = spark.createDataFrame([(1, "a", "SUCCESS", "ANSWER", 1), (2, "b", "SUCCESS", "ERROR", 1), (3, "c", "FAILED", "ERROR", 1), (4, "d", "SUCCESS", "ANSWER", 1)], "case_result_id long, case_code string, status string, actual_action string, run_id int")
    judges = spark.createDataFrame([(1,), (2,)], "case_result_id long")
    assert {r.case_result_id: r.plan for r in experiment.resume_plan(results, judges).collect()} == {1: "SKIP", 2: "RESET", 3: "RESET", 4: "RESET"}
    assert experiment.run_status(results).first().run_status == "PARTIAL"
    pairs = spark.createDataFrame([("a", "X", None, 0.5, 2, ["S", "S"], 10, 20, True), ("b", "X", 1.0, 0.5, 1, [], 30, 10, False)], "case_code string, case_type string, c_fact_coverage double, t_fact_coverage double, t_retrieval_rounds int, t_retry_strategies array<string>, c_latency_ms int, t_latency_ms int, plan_match boolean")
    c = experiment.compare(pairs, ("fact_coverage",)).first()
    assert (c.control, c.treatment, c.improved, c.regressed, c.control_full) == (0.5, 0.5, 1, 1, 1)
    s = experiment.by_strategy(pairs).first()
    assert (s.strategy, s.occurrences, s.cases, s.improved) == ("S", 2, 1, 1)
