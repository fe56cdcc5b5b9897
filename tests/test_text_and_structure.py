"""Text functions, structuring and chunking on small hand-worked inputs."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import user
from quern.operators import structure
from quern.sources import readers


def one(spark, col, **values):
    return spark.createDataFrame([Row(**values)]).select(col.alias("v")).first().v


def test_cleaning(spark):
    raw = "标题\r\n\r\n\r\n\r\n公司内部资料\n 第 1 页 / 共 3 页 \n1. 打开后台\n然后点击\n保存。\n结束"
    f = lambda kind: one(spark, T.clean(F.col("t"), F.lit(kind)), t=raw)
    assert f("FAQ") == "标题\n\n1. 打开后台\n然后点击\n保存。\n结束"
    assert f("SOP") == "标题\n\n1. 打开后台\n然后点击保存。\n结束"
    assert one(spark, T.clean(F.col("t"), F.lit("SOP")), t="") == ""


def plain_repair(text):
    import re

    numbered = lambda s: bool(re.match(r"^(\d+[.、]|第[一二三四五六七八九十]+步|第[一二三四五六七八九十]+条)", s))
    out = []
    for line in text.split("\n"):
        if out and out[-1] and line and not out[-1].endswith(("。", "；", "：", ":", "！", "？")) and not numbered(line) and not numbered(out[-1]):
            out[-1] += line
        else:
            out.append(line)
    return "\n".join(out)


def test_line_repair_equals_plain_version(spark):
    import random

    rnd = random.Random(1)
    texts = ["\n".join(rnd.choice(["", "a", "b。", "1. c", "第一步", "d：", "e"]) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.v == plain_repair(r.t) for r in df.select("t", T.repair_lines(F.col("t")).alias("v")).collect())


@pytest.mark.parametrize("given,want", [("退款需3个工作日", ["3工作日"]), ("三十天内", ["30天"]), ("一百二十元和5%", ["120元", "5%"]), ("十分钟", ["10分钟"]), ("两小时 1.5 小时", ["2小时", "1.5小时"]), ("无", [])])
def test_constraints(spark, given, want):
    assert one(spark, T.constraints(F.col("t")), t=given) == want


def test_terms_versions_and_intent(spark):
    assert one(spark, T.exact_terms(F.col("t")), t="错误码 E1002 和 AB-12 调 /api/order/refund 点【补发】 order_status E1002") == ["AB-12", "E1002", "order_status", "【补发】", "/api/order/refund"]
    assert one(spark, T.comparison_intent(F.col("t")), t="V1 与 v2.0") is True
    assert one(spark, T.comparison_intent(F.col("t")), t="新版有何不同") is True
    assert one(spark, T.comparison_intent(F.col("t")), t="怎么退款") is False
    assert one(spark, T.explicit_versions(F.col("c"), F.col("v")), c="规则 V1.0\nV2", v="v3") == ["1"]
    assert one(spark, T.explicit_versions(F.col("c"), F.col("v")), c="规则", v="V2.0") == ["2"]


def test_small_functions(spark):
    assert one(spark, T.estimate_tokens(F.col("t")), t="中文abcdefgh") == 4
    assert one(spark, T.estimate_tokens(F.col("t")), t="中文") == 3
    assert one(spark, T.fill_template(F.col("t"), F.col("f")), t="{{intermediate_fact}} 的  时限", f="七天") == "七天 的 时限"
    assert one(spark, T.fill_template(F.col("t"), F.col("f")), t="时限", f="七天") == "七天 时限"
    assert one(spark, T.citation_ids(F.col("t")), t="见[C2][C1]和[C2]") == ["C1", "C2"]
    assert one(spark, T.split_multi(F.col("t")), t="a；b, c|d，") == ["a", "b", "c", "d"]
    assert one(spark, T.letters(F.col("t")), t="A-b_C 中。") == "abc中"
    assert one(spark, T.markdown_cell(F.col("t")), t="a|b\nc") == "a\\|b c"
    assert one(spark, T.alias_match(F.col("t"), F.array(F.lit("七天无理由"))), t="七天") is True
    with pytest.raises(Exception, match="different sizes"):
        one(spark, T.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0])


def lines(spark, *rows):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id long, line_no int, line string")


def test_structuring(spark):
    faq = structure.extract_faq(lines(spark, "A：无主", "Q1：怎么退款？", "A：申请。", "再等待。", "别名：退钱；返款", "Q2：空", "问题3：在哪", "答案：后台")).orderBy("pair_no").collect()
    assert [(r.question, r.answer, r.aliases) for r in faq] == [("怎么退款？", "申请。\n再等待。", ["退钱", "返款"]), ("在哪", "后台", [])]
    rules = structure.extract_rules(lines(spark, "退款规则", "1.1 七天内可退", "二、例外", "第三条 定制品不退")).orderBy("line_no").collect()
    assert [(r.clause_no, r.title_path, r.content) for r in rules] == [("1.1", "退款规则", "七天内可退"), ("第三条", "二、例外", "定制品不退")]
    sop = structure.extract_sop(lines(spark, "退款流程", "适用场景：售后", "1. 查单", "第二步 核实", "注意：超时")).first()
    assert (sop.title, sop.scene, sop.steps, sop.notes) == ("退款流程", "适用场景：售后", ["1. 查单", "第二步 核实"], ["注意：超时"])
    manual = structure.extract_manual(lines(spark, "一、订单", "二、退款操作", "三、权限管理", "四、系统配置", "1. 点【保存】和[取消]", "2. 点【保存】")).first()
    assert manual.title_path == "二、退款操作 > 三、权限管理 > 四、系统配置" and manual.button_names == ["保存", "取消"]


def test_tables(spark):
    cells = [(1, 0, r, c, t) for r, row in enumerate([("问题", "答案", "标签"), ("Q", "A", "x；y"), ("", "B", "")]) for c, t in enumerate(row)]
    got = structure.extract_faq_table(spark.createDataFrame(cells, "doc_id long, table_no int, row_no int, col_no int, text string")).collect()
    assert [(r.question, r.answer, r.tags) for r in got] == [("Q", "A", ["x", "y"])]
    meta = [(1, 0, r, c, t) for r, row in enumerate([("版本", "1"), ("版本", "2"), ("", "x")]) for c, t in enumerate(row)]
    assert [(r.key, r.value) for r in structure.extract_metadata(spark.createDataFrame(meta, "doc_id long, table_no int, row_no int, col_no int, text string")).collect()] == [("版本", "2")]


PARSED = """doc_id long, doc_type string, title string, clean_content string, qa_pairs array<struct<question:string,answer:string,aliases:array<string>,tags:array<string>>>, scene string, steps array<string>,
notes array<string>, clauses array<struct<clause_no:string,title_path:string,content:string,raw_line:string>>, title_path string, button_names array<string>"""


def parsed(spark, doc_type, **kw):
    row = dict.fromkeys([p.split()[0] for p in PARSED.replace("\n", " ").split(", ") if " " in p and "<" not in p.split()[0]])
    row = {k: None for k in ("doc_id", "doc_type", "title", "clean_content", "qa_pairs", "scene", "steps", "notes", "clauses", "title_path", "button_names")} | {"doc_id": 1, "doc_type": doc_type} | kw
    return spark.createDataFrame([tuple(row.values())], PARSED)


def test_chunking_keeps_content(spark):
    faq = structure.chunk(parsed(spark, "FAQ", qa_pairs=[("Q", "A", ["a", "b"], ["t"]), ("", "x", [], [])])).collect()
    assert [(r.content, r.key) for r in faq] == [("问题：Q\n答案：A\n同义问法：a；b\n标签：t", "faq-1")]
    sop = structure.chunk(parsed(spark, "SOP", title="流程", scene="s", steps=["1", "2", "3", "4"], notes=["n"])).orderBy("sort_order").collect()
    assert [r.key for r in sop] == ["sop-parent", "sop-child-1", "sop-child-2"] and sop[1].content.endswith("1\n2\n3") and sop[2].parent_key == "sop-parent" and "注意事项：\nn" in sop[0].content
    rule = structure.chunk(parsed(spark, "RULE", title="规则", clauses=[("1.1", "总则", "x", "1.1、七天内可退"), ("2", "p", "", "2")])).collect()
    assert [(r.title, r.source_section) for r in rule] == [("1.1 七天内可退", "1.1")] and "规则内容：七天内可退" in rule[0].content
    manual = structure.chunk(parsed(spark, "MANUAL", steps=["1. 点"], button_names=["保存"])).first()
    assert manual.content == "操作手册：操作手册\n标题路径：操作手册\n操作步骤：\n1. 点\n涉及按钮：保存"
    assert structure.chunk(parsed(spark, "MANUAL")).count() == 0
    with pytest.raises(Exception, match="unknown document type"):
        structure.chunk(parsed(spark, "OTHER")).collect()


def test_readers_and_user_models(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"case_code":"A","evidences":[{"fact_key":"f","relevance_grade":3}]}\n\n{"case_code":"B"}\n', encoding="utf-8")
    assert [r.case_code for r in readers.read_cases(spark, str(tmp_path / "c.jsonl")).orderBy("case_code").collect()] == ["A", "B"]
    (tmp_path / "bad.jsonl").write_text('{"case_code":"A"}\nnot json\n', encoding="utf-8")
    with pytest.raises(Exception):
        readers.read_cases(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/R.json").write_text('{"source_doc_code":"R","title":"t",\n"sections":[{"section_code":"S","heading":"h","content":"c","aliases":[],"facts":[{"fact_key":"k","fact_text":"v"}]}]}', encoding="utf-8")
    sections, facts = readers.read_corpus(spark, str(tmp_path / "d"))
    assert sections.first().section_code == "S" and facts.first().fact_text == "v"
    files = readers.scan_files(spark, str(tmp_path / "d")).first()
    assert files.ext == "json" and len(files.sha256) == 64
    pairs = spark.createDataFrame([(1, 2, "q", "long text"), (1, 3, "q", "x")], "query_id int, chunk_id int, query string, content string")
    got = {r.chunk_id: r.rerank_score for r in user.score_pairs(pairs, lambda q, c: [float(len(x)) for x in c], batch=1).collect()}
    assert got == {2: 9.0, 3: 1.0}
    assert user.embed(pairs, lambda t: [[float(len(x))] for x in t], "chunk_id", "content").count() == 2


def test_structures_are_made_without_a_shuffle(spark, capsys):
    """A document goes from its text to its structures in one row, and these are those of the tables of lines."""
    text = "一、退款规则\n适用场景：售后\n1. 打开【A】再点【B】\n注意：小心\nQ1：怎么退？\nA1：联系\n等待\n同义问法：退货，退钱\nQ2: 空\n3.1 超过 3 天"
    docs = spark.createDataFrame([(1, "FAQ", text), (2, "RULE", " \n"), (3, "SOP", None)], "doc_id long, doc_type string, content string")
    parsed = structure.parse(docs, cleaned=False)
    (row,) = parsed.collect()
    lines = structure.to_lines(docs, "content")
    assert [(p.question, p.answer, p.aliases) for p in row.qa_pairs] == [(p.question, p.answer, p.aliases) for p in structure.extract_faq(lines).orderBy("pair_no").collect()]
    assert [tuple(c) for c in row.clauses] == [tuple(c) for c in structure.extract_rules(lines).orderBy("line_no").drop("doc_id", "line_no").collect()]
    parsed.explain()
    assert "Exchange" not in capsys.readouterr().out
