"""The engine's tables as views of the given ones, in SQL that Spark and DuckDB both read.

``{name}`` stands for a given table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # One chunk for each document; four in a row are one document, its first chunk the parent.
    "chunks": """select d.doc_id as chunk_id, d.doc_id - d.doc_id % 4 as doc_id, case when d.doc_id % 4 > 0 then d.doc_id - d.doc_id % 4 end as parent_chunk_id,
        case d.doc_id % 4 when 0 then 'FAQ' when 1 then 'SOP' when 2 then 'RULE' else 'MANUAL' end as chunk_type, substr(d.text, 1, 40) as title, concat(d.lang, ' > ', d.source) as title_path,
        d.text as content, d.source as keywords, d.lang as tags, d.lang as business_domain, d.source as source_section, d.doc_id % 4 as sort_order,
        case when l.toxic = 1 then 'INACTIVE' else 'ACTIVE' end as status from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    # Questions and their vectors.
    "questions": "select item_id as query_id, text as query from {benchmark}",
    # Questions with codes, amounts and versions, and lines of documents with headings, steps, pairs and rules, from orders.
    "asked": """select o_orderkey as query_id, concat(case o_orderkey % 8 when 0 then '退款规则的条件是什么' when 1 then '订单异常的处理流程和步骤' when 2 then '后台配置按钮在哪里' when 3 then '车位置不刷新' when 4 then 'V1 和 v2.0 的区别以及流程，同时'
        when 5 then '支持【退款】吗？多久到账？同时需要查看订单详情吗' when 6 then '咋一直没反应' else 'hello there' end, ' ', case o_orderkey % 5 when 0 then 'E1024' when 1 then concat(cast(o_custkey % 30 as varchar(9)), ' 天') when 2 then 'order_status' when 3 then '十五个工作日 ORD-A-7' else '' end) as question,
        o_orderkey % 4 as k, o_custkey as customer, o_totalprice as price from {orders}""",
    "texts": """select o_orderkey as doc_id, concat_ws(chr(10), concat('一、', o_orderpriority, '规则'), '没有写完的一行', '接着写。', '适用场景：售后', concat('1. 打开【', o_orderstatus, '】再点【查询】'), concat('2、 检查订单 ', cast(o_custkey as varchar(9))), '注意：不要重复提交', '系统配置',
        concat('Q1：订单 ', cast(o_orderkey as varchar(20)), ' 怎么退款？'), 'A1：联系客服', '再等待处理', case when o_orderkey % 3 = 0 then '同义问法：退货，退钱' else '补充一句' end, concat('Q2: ', o_orderstatus), case when o_orderkey % 2 = 0 then 'A2: 会的' end, '第 1 页 / 共 3 页', concat('3.1 超过 ', cast(o_custkey % 20 as varchar(9)), ' 天不退')) as text from {orders}""",
    # Two ranked lists of line items for each part.
    "items": "select l_partkey as query_id, l_orderkey * 10 + l_linenumber as chunk_id, max(l_extendedprice) as price, max(l_shipdate) as shipped, max(l_linenumber) as line, max(l_quantity) as quantity, max(l_suppkey) as supplier from {lineitem} group by l_partkey, l_orderkey * 10 + l_linenumber",
    "vector_hits": "select query_id, chunk_id, cast(r as int) as rank, price as score, 'vector' as source from (select *, row_number() over (partition by query_id order by price desc, chunk_id) as r from {items}) x where r <= 50",
    "bm25_hits": "select query_id, chunk_id, cast(r as int) as rank, price as score, 'bm25' as source from (select *, row_number() over (partition by query_id order by shipped, chunk_id) as r from {items}) x where r <= 50",
    "hits": "select * from {vector_hits} union all select * from {bm25_hits}",
    # Ranking cases: a part is a case, its line items by price are its list, some of them are gold.
    "cases": "select distinct query_id as case_code from {items}",
    "case_hits": "select query_id as case_code, rank, chunk_id from {vector_hits} where rank <= 20",
    "case_gold": "select query_id as case_code, chunk_id, cast(line % 4 as int) as grade from {items} where quantity > 40",
    "case_facts": "select query_id as case_code, chunk_id, concat('f', cast(supplier % 7 as varchar(9))) as fact_key from {items} where quantity > 30",
    "cited": "select query_id as case_code, chunk_id from {items} where quantity > 35 and line < 4",
    # Case results from events.
    "results": """select concat('E', cast(event_id as varchar(20))) as case_code, event_id as case_result_id, user_id % 10 as run_id, event_type as case_type, case event_id % 3 when 0 then 'EASY' when 1 then 'HARD' end as difficulty,
        case event_id % 5 when 0 then 'REFUSE' when 1 then 'CLARIFY' else 'ANSWER' end as expected_action,
        case when event_type = 'error' then 'ERROR' when user_id % 7 = 0 then 'REFUSE' when user_id % 7 = 1 then 'CLARIFY' else 'ANSWER' end as actual_action,
        case when event_type = 'error' then 'FAILED' else 'SUCCESS' end as status, case when event_id % 11 > 0 then cast(case when value > 20 then 1 else 0 end as int) end as judge_passed,
        value as latency_ms, case when event_id % 4 > 0 then cast((user_id % 5) / 4.0 as double) end as fact_coverage, case when event_id % 4 > 0 then cast((event_id % 7) / 8.0 as double) end as recall_at_10,
        case when event_id % 3 > 0 then cast((user_id % 3) / 2.0 as double) end as citation_recall, cast((event_id % 10) / 8.0 as double) as completeness_score, cast((user_id % 10) / 8.0 as double) as faithfulness_score, ts as finished_at from {events}""",
}
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view of them."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, VIEWS[name])


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def sql(text: str) -> str:
    """The text as one DuckDB statement, with the views it needs as common table expressions."""
    order: list[str] = []

    def need(part: str) -> None:
        for n in re.findall(r"\{(\w+)\}", part):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    head = ", ".join(f"{n} as materialized ({plain(VIEWS[n])})" for n in order)
    body = plain(text)
    if not head:
        return body
    return f"with {head}, {body.strip()[5:]}" if body.strip().lower().startswith("with ") else f"with {head} {body}"
