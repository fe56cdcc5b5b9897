"""Queries of the operators that write and read files: what was written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dataset
from ..sources import readers
from ..storage import shared_folder
from .catalog import query


def _folder(df) -> str:
    return f"{shared_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"


@query("""select 'C' || o_orderkey as case_code, o_orderpriority as question, o_orderkey % 100 / 100.0 as review_score, case when o_orderkey % 2 = 0 then 2 else 1 end as n_evidences, 'q' || o_custkey as quote from {orders}""")
def src1_cases(read):
    """Orders as cases in JSON lines, with blank lines between them."""
    o = read("orders")
    piece = lambda grade: F.struct(F.lit("d").alias("source_doc_code"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("evidence_quote"), F.lit(grade).alias("relevance_grade"))
    case = F.struct(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("case_code"),
        F.col("o_orderpriority").alias("question"),
        (F.col("o_orderkey") % 100 / 100).alias("review_score"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(piece(3), piece(2))).otherwise(F.array(piece(3))).alias("evidences"),
    )
    path = _folder(o)
    o.select(F.explode(F.array(F.to_json(case), F.lit(""))).alias("value")).write.text(path)
    cases = readers.read_cases(o.sparkSession, path)
    return cases.select("case_code", "question", "review_score", F.size("evidences").alias("n_evidences"), F.col("evidences")[0]["evidence_quote"].alias("quote"))


@query("select 'N' || c_nationkey as source_doc_code, c_mktsegment as section_code, 'c' || c_custkey as fact_key, c_name as fact_text, cast(row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) - 1 as int) as fact_ord from {customer}")
def src2_corpus(read):
    """A document for each nation, written as one JSON text over several lines, with its customers as facts."""
    c = read("customer")
    fact = F.struct("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("fact_key"), F.col("c_name").alias("fact_text"))
    sections = c.groupBy("c_nationkey", "c_mktsegment").agg(F.transform(F.sort_array(F.collect_list(fact)), lambda f: F.struct(f["fact_key"].alias("fact_key"), f["fact_text"].alias("fact_text"))).alias("facts"))
    section = F.struct(F.col("c_mktsegment").alias("section_code"), F.lit("h").alias("heading"), F.lit("text").alias("content"), F.array(F.lit("x")).alias("aliases"), "facts")
    docs = sections.groupBy("c_nationkey").agg(F.collect_list(section).alias("sections"))
    body = F.to_json(F.struct(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("source_doc_code"), F.lit("t").alias("title"), F.lit("FAQ").alias("doc_type"), "sections"), {"pretty": "true"})
    path = _folder(c)
    docs.select("c_nationkey", body.alias("value")).write.partitionBy("c_nationkey").text(path)
    _, facts = readers.read_corpus(c.sparkSession, f"{path}/*")
    return facts.select("source_doc_code", "section_code", "fact_key", "fact_text", "fact_ord")


@query("select sha256(string_agg(c_name, chr(10) order by c_name) || chr(10)) as sha256, 'txt' as ext, cast(count(*) + 1 as int) as n_lines from {customer} group by c_nationkey")
def src6_files(read):
    """A text file for each nation, found again by content."""
    c = read("customer")
    path = _folder(c)
    c.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_name")), "\n").alias("value")).write.partitionBy("c_nationkey").text(path)
    return readers.scan_files(c.sparkSession, path).where("ext = 'txt'").select("sha256", "ext", F.size(F.split("content", "\n", -1)).alias("n_lines"))


@query("""select 'C' || o_orderkey as case_code, '\x7b"answer":' || case when o_orderkey % 3 = 0 then 'null' else '"a' || o_custkey || '"' end || ',"case_code":"C' || o_orderkey || '","status":"' || o_orderstatus || '"\x7d' as line from {orders}""")
def snk1_export(read):
    """The frozen set's lines: sorted keys, nulls kept."""
    o = read("orders")
    cases = o.select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("case_code"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("a"), F.col("o_custkey").cast("string"))).alias("answer"))
    path = _folder(o)
    dataset.export_frozen(cases, path)
    return o.sparkSession.read.text(path).select(F.get_json_object("value", "$.case_code").alias("case_code"), F.col("value").alias("line"))


@query("""with l as (select sha256('\x7b"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '\x7d') as h from {customer}), b as (select sha256(string_agg(h, '' order by h)) as h from l group by substr(h, 1, 3)),
    own as (select sha256(string_agg(h, '' order by h)) as sha256 from b)
    select 'cases' as name, 'v2' as version, sha256 from own union all select n_name, 'v1', 'x' from {nation}""")
def pln7_freeze(read):
    """A registry with a version for each nation, one more for the customers, frozen twice."""
    cases = read("customer").select("c_custkey", "c_nationkey")
    registry = read("nation").select(F.col("n_name").alias("name"), F.lit("v1").alias("version"), F.lit("x").alias("sha256"))
    return dataset.freeze_version(cases, dataset.freeze_version(cases, registry, "cases", "v2"), "cases", "v2")
