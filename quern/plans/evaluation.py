"""Queries of the operators on evaluation sets, metrics and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, experiment, metrics
from ..streaming import jobs
from .catalog import query

C = F.col


def s(column: str):
    return C(column).cast("string")


# -- evidence and selection ---------------------------------------------------------


@query("""with e as (select o_orderkey, cast(o_orderkey % 40 as varchar) as case_code, case when o_orderkey % 3 = 0 then 3 else 1 end as grade, 'has ' || o_orderstatus as quote from {orders}), cases as (select distinct o_orderkey % 40 as n from {orders}),
    held as (select distinct case_code from e where grade = 3 and contains(quote, case when cast(case_code as int) % 2 = 0 then 'P' else 'Z' end)),
    c as (select n, case when n % 2 = 0 then 'P' else 'Z' end as ident from cases where cast(n as varchar) not in (select case_code from held)),
    chunks as (select p_partkey as chunk_id, p_partkey % 40 as doc, p_name as title, p_type || ' Part. Z' || p_partkey || ' zZ！P' as content, p_size as sort_order from {part}),
    f as (select c.n, ident, chunk_id, content, row_number() over (partition by c.n order by cast(contains(title, ident) as int) desc, length(content) - length(replace(content, ident, '')) desc, sort_order, chunk_id) as r from c join chunks on doc = c.n where contains(content, ident))
    select cast(c.n as varchar) as case_code, f.chunk_id, case when f.chunk_id is null then '' when ident = 'P' then 'P' else regexp_extract(f.content, '^.*！') end as quote, f.chunk_id is not null as resolved from c left join (select * from f where r = 1) f using (n, ident)""")
def jn9_correct_exact(read):
    o = read("orders")
    e = o.select((C("o_orderkey") % 40).cast("string").alias("case_code"), F.when(C("o_orderkey") % 3 == 0, 3).otherwise(1).alias("relevance_grade"), F.concat(F.lit("has "), "o_orderstatus").alias("evidence_quote"))
    cases = o.select((C("o_orderkey") % 40).alias("doc_id")).distinct().select(s("doc_id").alias("case_code"), F.when(C("doc_id") % 2 == 0, "P").otherwise("Z").alias("identifier"), "doc_id")
    p = read("part")
    chunks = p.select(C("p_partkey").alias("chunk_id"), (C("p_partkey") % 40).alias("doc_id"), C("p_name").alias("title"), F.concat("p_type", F.lit(" Part. Z"), s("p_partkey"), F.lit(" zZ！P")).alias("content"), C("p_size").alias("sort_order"), F.lit("ACTIVE").alias("status"))
    return dataset.correct_exact(cases, e, chunks).select("case_code", "chunk_id", F.coalesce("evidence_quote", F.lit("")).alias("quote"), "resolved")


@query("select a.o_orderkey as id, n_name as source_doc_code, sha256(replace(o_orderpriority, ' ', '')) as quote_sha256 from {orders} a join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey")
def jn15_case_evidence(read):
    r = read("orders").join(read("customer"), C("o_custkey") == C("c_custkey")).select(C("o_orderkey").alias("id"), s("o_custkey").alias("case_code"), C("o_orderpriority").alias("evidence_quote"), F.lit(1).alias("relevance_grade"), C("c_nationkey").cast("string").alias("source_doc_code"))
    d = read("nation").select(s("n_nationkey").alias("source_doc_code"), "n_name")
    return dataset.case_evidence(r, d).select("id", C("n_name").alias("source_doc_code"), "quote_sha256")


@query("select cast(n_nationkey as varchar) as source_doc_code, coalesce(string_agg(c_name, ',' order by c_custkey), '') as facts from {nation} left join {customer} on c_nationkey = n_nationkey group by 1")
def jn10_case_context(read):
    facts = read("customer").select(s("c_nationkey").alias("source_doc_code"), C("c_custkey").alias("fact_ord"), C("c_name").alias("fact_key"), F.lit("").alias("fact_text"))
    made = dataset.case_context(read("nation").select(s("n_nationkey").alias("source_doc_code")), facts)
    return made.select("source_doc_code", F.coalesce(F.array_join(F.transform("facts", lambda f: f["fact_key"]), ","), F.lit("")).alias("facts"))


def _blueprints(read):
    """Parts as blueprints: versions of a group, conflicts and forerunners."""
    k = C("p_partkey")
    return read("part").select(
        s("p_partkey").alias("source_doc_code"), F.when(k % 5 == 0, F.concat(F.lit("g"), (k % 35).cast("string"))).alias("version_group"), F.when(k % 4 == 0, F.array((k + 1).cast("string"), (k + 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("conflicts_with"),
        F.when(k % 6 == 0, (k - 1).cast("string")).alias("supersedes"), "p_name", "p_type", "p_size", "p_brand",
    )


@query("""with b as (select p_partkey as k, case when p_partkey % 5 = 0 then p_partkey % 35 end as g from {part}), m as (select * from b where k % 9 = 0) select distinct cast(x as varchar) as source_doc_code from (select k as x from m union all select k + 1 from m where k % 4 = 0 union all select k + 2 from m where k % 4 = 0
    union all select k - 1 from m where k % 6 = 0 union all select k from b where g in (select g from m where g is not null)) z""")
def jn16_related_documents(read):
    b = _blueprints(read)
    return dataset.related_documents(b.where("cast(source_doc_code as int) % 9 = 0").select("source_doc_code"), b)


def _cases(read):
    k = C("o_orderkey")
    return read("orders").select(
        k.alias("id"), s("o_orderkey").alias("case_code"), F.when(k % 3 == 0, "TEST").otherwise("DEV").alias("dataset_split"), F.when(k % 4 == 0, "REJECTED").otherwise("PASSED").alias("review_status"), F.when(C("o_orderstatus") == "F", "ACTIVE").otherwise("OLD").alias("status"),
        F.when(k % 5 == 0, "REFUSE").otherwise("ANSWER").alias("expected_action"), C("o_orderpriority").alias("case_type"), C("o_custkey").alias("customer"),
    )


@query("select cast(o_orderkey as varchar) as case_code from {orders} where o_orderkey % 3 = 0 and o_orderkey % 4 > 0 and o_orderstatus = 'F' and o_orderkey % 5 > 0 and o_orderpriority in ('1-URGENT', '2-HIGH')")
def flt4_select_cases(read):
    return dataset.select_cases(_cases(read), "TEST", actions=("ANSWER",), types=("1-URGENT", "2-HIGH")).select("case_code")


@query("select cast(o_orderkey as varchar) as case_code from {orders} where not (o_orderkey % 4 = 0 and o_orderpriority = '2-HIGH')")
def flt5_retain_reviews(read):
    return dataset.retain_reviews(_cases(read), True, "2-HIGH").select("case_code")


@query("select cast(p_partkey as varchar) as source_doc_code, p_name from {part} where p_partkey % 3 = 0")
def flt8_select_blueprints(read):
    b = _blueprints(read)
    return dataset.select_blueprints(b, b.where("cast(source_doc_code as int) % 3 = 0").select("source_doc_code")).select("source_doc_code", "p_name")


# -- checks ---------------------------------------------------------------------------


@query("""with c as (select o_orderkey as k, o_custkey as u, case when o_custkey % 7 = 0 then '' else o_orderpriority end as question, case o_orderkey % 4 when 0 then 'ANSWER' when 1 then 'REFUSE' when 2 then 'CLARIFY' else 'OTHER' end as action, case o_orderkey % 5 when 0 then 'NO_ANSWER' when 1 then 'MULTI_HOP' else 'FACT' end as type from {orders}),
    e as (select l_orderkey as k, l_quantity as q, l_linenumber as n from {lineitem} where l_quantity > 30), m as (select k, count(*) as ne, count(distinct n % 2) as nf from e group by 1), j as (select c.*, coalesce(ne, 0) as ne, coalesce(nf, 0) as nf from c left join m using (k))
    select 'QUESTION_EMPTY' as code, cast(k as varchar) as entity_code from j where question = '' union all select 'UNKNOWN_ACTION', cast(k as varchar) from j where action = 'OTHER' union all select 'NO_ANSWER_WITH_EVIDENCE', cast(k as varchar) from j where type = 'NO_ANSWER' and ne > 0
    union all select 'NO_ANSWER_EXPECTS_ANSWER', cast(k as varchar) from j where type = 'NO_ANSWER' and action = 'ANSWER' union all select 'ANSWER_WITHOUT_EVIDENCE', cast(k as varchar) from j where type <> 'NO_ANSWER' and action = 'ANSWER' and ne = 0 union all select 'MULTI_HOP_NEEDS_TWO_FACTS', cast(k as varchar) from j where type = 'MULTI_HOP' and nf < 2
    union all select 'EVIDENCE_QUOTE_EMPTY', cast(k as varchar) from e where q > 48 union all select 'GRADE_OUT_OF_RANGE', cast(k as varchar) from e where n > 5 union all select 'MAPPED_WITHOUT_CHUNK', cast(k as varchar) from e where n = 3""")
def val1_records(read):
    k = C("o_orderkey")
    cases = read("orders").select(
        k.cast("string").alias("case_code"), F.when(C("o_custkey") % 7 == 0, "").otherwise(C("o_orderpriority")).alias("question"),
        F.when(k % 4 == 0, "ANSWER").when(k % 4 == 1, "REFUSE").when(k % 4 == 2, "CLARIFY").otherwise("OTHER").alias("expected_action"), F.when(k % 5 == 0, "NO_ANSWER").when(k % 5 == 1, "MULTI_HOP").otherwise("FACT").alias("case_type"),
    )
    n = C("l_linenumber")
    evidence = read("lineitem").where("l_quantity > 30").select(
        s("l_orderkey").alias("case_code"), F.when(C("l_quantity") > 48, " ").otherwise("q").alias("evidence_quote"), F.when(n > 5, 9).otherwise(2).alias("relevance_grade"), (n % 2).cast("string").alias("fact_key"), F.when(n < 4, "MAPPED").otherwise("MISSING").alias("mapping_status"), F.when(n < 3, 1).cast("long").alias("mapped_chunk_id")
    )
    return dataset.check_records(cases, evidence)


@query("select distinct cast(l_orderkey as varchar) as case_code from {lineitem} where l_linenumber % 2 = 1 and (l_suppkey % 3 = 0 or l_quantity < 5)")
def val6_mapped(read):
    e = read("lineitem").select(s("l_orderkey").alias("case_code"), F.when(C("l_linenumber") % 2 == 1, 3).otherwise(1).alias("relevance_grade"), F.when(C("l_suppkey") % 3 == 0, "AMBIGUOUS").otherwise("MAPPED").alias("mapping_status"), F.when(C("l_quantity") >= 5, C("l_partkey")).alias("mapped_chunk_id"))
    return dataset.check_mapped(e)


@query("""with p as (select p_partkey as k from {part}), r as (select k, k + 1 as t from p where k % 4 = 0 union all select k, k + 2 from p where k % 4 = 0 union all select k, k - 1 from p where k % 6 = 0)
    select 'DANGLING_REFERENCE' as code, cast(k as varchar) as entity_code from r where t not in (select k from p) union all select 'WRONG_COUNT', '' from (select count(*) as n from p) where n <> 40""")
def val7_blueprints(read):
    return dataset.check_blueprints(_blueprints(read)).select("code", F.coalesce("entity_code", F.lit("")).alias("entity_code"))


@query("""with j as (select p_partkey as k, p_size as z from {part}) select 'DOCUMENT_MISSING' as code, cast(k as varchar) as entity_code from j where k % 11 = 0 union all select 'FIELD_MISMATCH', cast(k as varchar) from j where k % 11 > 0 and k % 5 = 0 union all select 'IDENTIFIER_MISSING', cast(k as varchar) from j where k % 11 = 0 or k % 3 = 0
    union all select 'SECTION_MISSING', cast(k as varchar) from j where k % 11 = 0 union all select 'FACT_MISSING', cast(k as varchar) from j where k % 11 = 0 or k % 7 = 0 union all select 'FAQ_SECTIONS', cast(k as varchar) from j where k % 11 > 0 and k % 2 = 0 and (z < 8 or z > 15)
    union all select 'FAQ_ALIASES', cast(k as varchar) from j where k % 11 > 0 and k % 2 = 0 and (z % 5 < 2) union all select 'SOP_STEPS', cast(k as varchar) from j where k % 11 > 0 and k % 2 = 1 and z < 4""")
def val8_documents_vs_blueprint(read):
    k = C("p_partkey")
    kind = F.when(k % 2 == 0, "FAQ").otherwise("SOP")
    b = read("part").select(s("p_partkey").alias("source_doc_code"), kind.alias("doc_type"), C("p_name").alias("title"), F.lit("1").alias("version"), F.array("p_brand").alias("required_identifiers"), F.array("p_type").alias("required_sections"), F.array(F.struct(F.lit("f").alias("fact_key"), F.concat(F.lit("fact "), "p_name").alias("description"))).alias("required_facts"))
    content = F.concat("p_type", F.when(k % 3 > 0, C("p_brand")).otherwise(""), F.lit(" / "), F.when(k % 7 > 0, F.concat(F.lit("fact "), "p_name")).otherwise(""))
    d = read("part").where(k % 11 > 0).select(s("p_partkey").alias("source_doc_code"), kind.alias("doc_type"), F.when(k % 5 == 0, "other").otherwise(C("p_name")).alias("title"), F.lit("1").alias("version"), content.alias("content"), C("p_size").alias("n_sections"), C("p_size").alias("n_steps"), F.array(C("p_size") % 5).alias("aliases"))
    return dataset.check_documents_vs_blueprint(b, d)


@query("""with j as (select o_orderkey as k, o_custkey as u from {orders}) select 'SEED_UNKNOWN' as code, cast(k as varchar) as entity_code from j where k % 13 = 0 union all select 'QUESTION_LENGTH', cast(k as varchar) from j where u % 9 = 0 union all select 'TITLE_LEAK', cast(k as varchar) from j where k % 13 > 0 and u % 9 > 0 and k % 6 = 0
    union all select 'IDENTIFIER_MISSING', cast(k as varchar) from j where k % 13 > 0 and k % 4 = 0 union all select 'FACTS_DIFFER', cast(k as varchar) from j where k % 13 > 0 and u % 5 = 0 union all select 'QUOTE_NOT_CANONICAL', cast(k as varchar) from j where k % 13 > 0 and u % 4 = 0
    union all select 'HOP_COUNT', cast(k as varchar) from j where k % 13 > 0 and k % 2 = 0 and u % 3 = 0 union all select 'ANSWER_LEAK', cast(k as varchar) from j where u % 9 > 0 and u % 7 = 0""")
def val9_cases_vs_seeds(read):
    k, u = C("o_orderkey"), C("o_custkey")
    seeds = read("orders").where(k % 13 > 0).select(s("o_orderkey").alias("seed_code"), F.when(k % 2 == 0, "MULTI_HOP").otherwise("FACT").alias("case_type"), F.when(k % 4 == 0, "ID-77").alias("required_identifier"), F.when(k % 6 == 0, "long Question").otherwise("no title of it").alias("title"), F.array(F.lit("b"), F.lit("a")).alias("fact_keys"), F.array(F.lit("q")).alias("quotes"))
    cases = read("orders").select(s("o_orderkey").alias("seed_code"), F.when(u % 9 == 0, "abc").otherwise("A long question, it is asked").alias("question"), F.when(u % 7 == 0, "it is asked").otherwise("short").alias("reference_answer"), F.when(u % 5 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("fact_keys"), F.when(u % 4 == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("q"))).alias("quotes"), F.when(u % 3 == 0, 1).otherwise(2).alias("n_docs"))
    return dataset.check_cases_vs_seeds(cases, seeds)


@query("""select 'CONTRACT_MISSING' as code, cast(o_orderkey as varchar) as entity_code from {orders} where o_orderkey % 5 = 0 union all select 'BRANCH_VALUES_REPEAT', cast(o_orderkey as varchar) from {orders} where o_orderkey % 5 > 0 and o_orderkey % 3 = 0
    union all select 'CHUNK_NOT_ACTIVE', cast(o_orderkey as varchar) from {orders} where o_orderkey % 5 > 0 and (o_custkey % 200 not in (select chunk_id from {chunks} where status = 'ACTIVE') or (o_custkey + 1) % 200 not in (select chunk_id from {chunks} where status = 'ACTIVE'))""")
def val10_contracts(read):
    k, u = C("o_orderkey"), C("o_custkey")
    branch = lambda v, c: F.struct(v.alias("condition_value"), F.array(c.cast("long")).alias("chunk_ids"))
    contract = F.struct(F.lit("which?").alias("clarification_question"), F.array(branch(F.lit("a"), u % 200), branch(F.when(k % 3 == 0, "a").otherwise("b"), (u + 1) % 200)).alias("branches"))
    return dataset.check_contracts(read("orders").select(s("o_orderkey").alias("case_code"), F.when(k % 5 > 0, contract).alias("contract")), read("chunks"))


QUOTA = "select c_mktsegment as split, case c_nationkey % 5 when 0 then 'CONFLICT' when 1 then 'NO_ANSWER' when 2 then 'EXACT' when 3 then 'MULTI_HOP' else 'MULTI_CONDITION' end as case_type, cast(c_nationkey as varchar) as subtype, count(*) as n from {customer} group by 1, 2, 3"


def _quota(read):
    n = C("c_nationkey") % 5
    kind = F.when(n == 0, "CONFLICT").when(n == 1, "NO_ANSWER").when(n == 2, "EXACT").when(n == 3, "MULTI_HOP").otherwise("MULTI_CONDITION")
    return read("customer").groupBy(C("c_mktsegment").alias("split"), kind.alias("case_type"), s("c_nationkey").alias("subtype")).agg(F.count("*").alias("n"))


@query(f"with q as ({QUOTA}) select 'SPLIT_TOTAL_MISMATCH' as code, split as entity_code from q group by 2 having sum(n) % 2 = 1 union all select 'TOPIC_IN_SEVERAL_SPLITS', subtype from q group by 2 having count(distinct split) > 1 union all select 'NEGATIVE_QUOTA', split || '/' || case_type from q where n < 0")
def val11_plan(read):
    q = _quota(read)
    totals = q.groupBy("split").agg((F.floor(F.sum("n") / 2) * 2).cast("long").alias("n"))
    return dataset.check_plan(q, totals, q.select("split", C("subtype").alias("topic")))


# -- planning --------------------------------------------------------------------------


@query(f"with q as ({QUOTA}) select split, subtype, unnest(range(n)) as i, 'REFUSE' as expected_action from q where case_type = 'NO_ANSWER'")
def pln3_no_answer(read):
    return dataset.plan_no_answer(_quota(read)).select("split", "subtype", C("i").cast("long").alias("i"), "expected_action")


@query(f"with q as ({QUOTA}) select split, case_type, subtype, cast(ceil(round(n * 1.25, 9)) as bigint) as n from q")
def pln4_pool(read):
    return dataset.plan_pool(_quota(read))


def _docs(read):
    k = C("p_partkey")
    return read("part").select(C("p_brand").alias("split"), F.lpad(s("p_partkey"), 8, "0").alias("source_doc_code"), F.array(F.concat(F.lit("a"), s("p_partkey")), F.concat(F.lit("b"), s("p_partkey"))).alias("facts"), F.array(F.concat(F.lit("ID"), s("p_partkey"))).alias("required_identifiers"), F.when(k % 2 == 0, s("p_size")).alias("version_group"), s("p_partkey").alias("version"))


SEED_QUOTA = "select p_brand as split, case p_size % 3 when 0 then 'EXACT' when 1 then 'MULTI_HOP' else 'MULTI_CONDITION' end as case_type, count(*) as n from {part} group by 1, 2"


def _seed_quota(read, *kinds):
    n = C("p_size") % 3
    kind = F.when(n == 0, kinds[0]).when(n == 1, kinds[1]).otherwise(kinds[2])
    return read("part").groupBy(C("p_brand").alias("split"), kind.alias("case_type")).agg(F.count("*").alias("n"))


@query(f"""with q as ({SEED_QUOTA}), d as (select p_brand as split, p_partkey as k, row_number() over (partition by p_brand order by lpad(cast(p_partkey as varchar), 8, '0')) - 1 as d, count(*) over (partition by p_brand) as n_docs from {{part}}), u as (select split, case_type, unnest(range(n)) as i from q),
    z as (select distinct split, n_docs from d), w as (select u.*, n_docs, case when case_type = 'MULTI_HOP' then 2 * i else i end % n_docs as d1 from u join z using (split)), v as (select *, case when case_type = 'MULTI_HOP' then case when (2 * i + 1) % n_docs = d1 then 2 * i + 2 else 2 * i + 1 end % n_docs end as d2 from w)
    select v.split, case_type, v.i, lpad(cast(x.k as varchar), 8, '0') || case when d2 is not null then ',' || lpad(cast(y.k as varchar), 8, '0') else '' end as codes, case when v.i % 2 = 0 then 'a' else 'b' end || x.k || case case_type when 'MULTI_HOP' then ',' || case when v.i % 2 = 0 then 'b' else 'a' end || y.k when 'MULTI_CONDITION' then ',' || case when v.i % 2 = 0 then 'b' else 'a' end || x.k else '' end as facts,
    case when case_type = 'EXACT' then 'ID' || x.k else '' end as identifier from v join d x on x.split = v.split and x.d = d1 left join d y on y.split = v.split and y.d = d2""")
def pln1_seeds(read):
    p = dataset.plan_seeds(_seed_quota(read, "EXACT", "MULTI_HOP", "MULTI_CONDITION"), _docs(read))
    return p.select("split", "case_type", C("i").cast("long").alias("i"), F.array_join("source_doc_codes", ",").alias("codes"), F.array_join("fact_keys", ",").alias("facts"), F.coalesce("required_identifier", F.lit("")).alias("identifier"))


@query("""with low as (select p_brand as split, p_size as g, p_partkey as k, row_number() over (partition by p_brand, p_size order by cast(p_partkey as varchar)) as r from {part} where p_partkey % 2 = 0), pairs as (select split, cast(g as varchar) as g, max(case when r = 1 then k end) as a, max(case when r = 2 then k end) as b from low where r <= 2 group by 1, 2 having count(*) = 2),
    n as (select *, row_number() over (partition by split order by g) - 1 as nth, count(*) over (partition by split) as all_ from pairs), q as (select p_brand as split, count(*) as c from {part} where p_size % 3 = 0 group by 1), w as (select split, unnest(range(c)) as i from q)
    select w.split, w.i, n.g as version_group, lpad(cast(a as varchar), 8, '0') || ',' || lpad(cast(b as varchar), 8, '0') as codes from w join n on n.split = w.split and w.i % all_ = nth""")
def pln2_conflicts(read):
    p = dataset.plan_conflicts(_seed_quota(read, "CONFLICT", "X", "Y"), _docs(read))
    return p.select("split", C("i").cast("long").alias("i"), "version_group", F.array_join("source_doc_codes", ",").alias("codes"))


@query("""with d as (select p_partkey as k, row_number() over (order by lpad(cast(p_partkey as varchar), 8, '0')) - 1 as d, count(*) over () as n from {part} where p_brand = 'Brand#5'), units as (select d.*, f from d, (values (0), (1)) v(f)), used as (select distinct k, i % 2 as f from d, range(7) r(i) where i % n = d.d),
    every_one as (select d, f, k, 0 as part from units where (k, f) not in (select (k, f) from used) union all select d, f, k, 1 from units), p as (select *, row_number() over (order by part, d, f) - 1 as u, count(*) over () as total from every_one)
    select i, lpad(cast(k as varchar), 8, '0') as source_doc_code, case f when 0 then 'a' else 'b' end || k as fact_key from range(9) r(i) join p on (9 + i) % total = u""")
def pln5_supplement(read):
    return dataset.plan_supplement(_docs(read), "Brand#5", "FACT", 7, 9, 2)


@query("select cast(o_orderkey as varchar) as case_code, o_orderpriority as question, 'a' || o_custkey as reference_answer, case when o_orderkey % 2 = 0 then 'FACT' else 'EXACT' end as case_type from {orders} where o_orderkey % 3 > 0")
def pln6_build_cases(read):
    o = read("orders")
    seeds = o.select(s("o_orderkey").alias("seed_code"), F.when(C("o_orderkey") % 2 == 0, "FACT").otherwise("EXACT").alias("case_type"), F.array(F.struct(F.lit("d").alias("source_doc_code"), F.lit("f").alias("fact_key"), F.lit("t").alias("fact_text"))).alias("facts"))
    texts = o.where("o_orderkey % 3 > 0").select(s("o_orderkey").alias("seed_code"), C("o_orderpriority").alias("question"), F.concat(F.lit("a"), s("o_custkey")).alias("reference_answer"))
    return dataset.build_cases(seeds, texts).select("case_code", "question", "reference_answer", "case_type")


@query("""select cast(p_partkey as varchar) as source_doc_code, coalesce(case when p_partkey % 5 > 0 then sha256(p_name) end, '') as sha256, case when p_partkey % 3 = 0 then 'PENDING' when p_size > 20 then 'PASSED' else 'REJECTED' end as review_status, case when p_partkey % 5 = 0 then 'NO_DOCUMENT' when p_partkey % 3 = 0 then 'NOT_REVIEWED' else '' end as issue from {part}""")
def pln8_register(read):
    p = read("part").select(s("p_partkey").alias("source_doc_code"), C("p_partkey").alias("k"), "p_name", "p_size")
    r = dataset.register_documents(p, p.where("k % 5 > 0").select("source_doc_code", C("p_name").alias("content")), p.where("k % 3 > 0").select("source_doc_code", (C("p_size") > 20).alias("passed"), F.lit(0.9).alias("overall_score")))
    return r.select("source_doc_code", F.coalesce("sha256", F.lit("")).alias("sha256"), "review_status", F.coalesce("issue", F.lit("")).alias("issue"))


# -- metrics ---------------------------------------------------------------------------


@query("select cast(query_id as varchar) as case_code, chunk_id % 9 as chunk_id, max(line % 4) as grade, array_to_string(list_sort(list_distinct(list('f' || supplier % 7))), ',') as facts from {items} where quantity > 30 group by 1, 2")
def met1_gold(read):
    e = read("items").where("quantity > 30").select(s("query_id").alias("case_code"), F.lit("MAPPED").alias("mapping_status"), (C("chunk_id") % 9).alias("mapped_chunk_id"), (C("line") % 4).alias("relevance_grade"), F.concat(F.lit("f"), (C("supplier") % 7).cast("string")).alias("fact_key"))
    return metrics.gold(e).select("case_code", "chunk_id", "grade", F.array_join("fact_keys", ",").alias("facts"))


@query("select count(*) as total, count(case when value > 20 then 1 end) as passed, round(avg(case when value > 20 then 1 else 0 end), 6) as pass_rate, round(avg(judge_passed), 6) as judge_pass_rate, round(avg(fact_coverage), 6) as merged_coverage, round(avg(recall_at_10), 6) as rerank_coverage, round(avg(citation_recall), 6) as final_coverage from (select *, latency_ms as value from {results})")
def met14_overview(read):
    r = read("results").select(F.when(C("latency_ms") > 20, "PASS").otherwise("FAIL").alias("primary_code"), "judge_passed", C("fact_coverage").alias("merged"), C("recall_at_10").alias("rerank"), C("citation_recall").alias("final"))
    return metrics.overview(r)


@query("with n as (select c_mktsegment as domain, count(*) as a, count(case when c_acctbal < 0 then 1 end) as b from {customer} group by 1) select not exists (select 1 from {orders} where o_totalprice > 200000) and not exists (select 1 from n where a > 0 and b > 0) as mismatch")
def met15_mismatch(read):
    d = read("customer").groupBy(C("c_mktsegment").alias("domain")).agg(F.count("*").alias("n_cases"), F.count(F.when(C("c_acctbal") < 0, 1)).alias("n_chunks"))
    hits = read("orders").where("o_totalprice > 200000").agg(F.count("*").alias("n_hits"))
    return metrics.domain_mismatch(d.crossJoin(F.broadcast(hits)))


@query("with h as (select query_id, max(case when rank = 1 then score end) as top1, avg(case when rank <= 3 then score end) as top3 from {vector_hits} group by 1) select c.case_code, round(c.case_code % 5 / 4.0, 6) as fact_coverage, round(top1, 6) as top1, round(top3, 6) as top3_mean from {cases} c join h on h.query_id = c.case_code")
def met17_rerank_features(read):
    h = read("vector_hits").select(C("query_id").alias("case_code"), F.lit("RERANK").alias("channel"), C("rank").alias("rank_no"), C("score").alias("rerank_score"))
    r = read("cases").select("case_code", F.round((C("case_code") % 5) / 4.0, 6).alias("fact_coverage"))
    f = metrics.rerank_features(r, h)
    return f.select("case_code", "fact_coverage", F.round("top1", 6).alias("top1"), F.round("top3_mean", 6).alias("top3_mean")).where("top1 is not null")


@query("""with c as (select event_id as k, case event_id % 4 when 0 then 'REFUSE' when 1 then 'CLARIFY' else 'ANSWER' end as action, case when event_id % 5 = 0 then 'CONFLICT' else 'FACT' end as type, round(0.7 + (user_id % 7) * 0.04, 4) as s1, event_id % 3 = 0 as ok, event_id % 6 < 5 as two from {events}),
    d as (select *, action = 'ANSWER' and (round(abs(s1 - 0.8), 9) <= 0.05 or round(abs(0.9 - 0.8), 9) <= 0.05) as near from c), e as (select *, near and two as second, case when near and two then round((s1 + 0.6) / 2, 4) else s1 end as f from d)
    select cast(k as varchar) as case_code, f as faithfulness_score, near as borderline, case when second then (user_ok and false) or (user_ok and ok2) else case action when 'REFUSE' then ok when 'CLARIFY' then not ok else f >= 0.8 end end as passed from (select *, s1 >= 0.8 as user_ok, ok as ok2 from e)""")
def met19_judge_final(read):
    e = C("event_id")
    cases = read("events").select(e.cast("string").alias("case_code"), F.when(e % 4 == 0, "REFUSE").when(e % 4 == 1, "CLARIFY").otherwise("ANSWER").alias("expected_action"), F.when(e % 5 == 0, "CONFLICT").otherwise("FACT").alias("case_type"))
    s1 = F.round(0.7 + (C("user_id") % 7) * 0.04, 4)
    scores = lambda f: [f.alias(metrics.SCORES[0]), *[F.lit(0.9).alias(n) for n in metrics.SCORES[1:]]]
    one = read("events").select(e.cast("string").alias("case_code"), F.lit(1).alias("review_no"), *scores(s1), (e % 3 == 0).alias("refusal_correct"), (e % 3 != 0).alias("clarification_correct"), (s1 >= 0.8).alias("passed"))
    two = read("events").where("event_id % 6 < 5").select(e.cast("string").alias("case_code"), F.lit(2).alias("review_no"), *scores(F.lit(0.6).cast("double")), (e % 3 == 0).alias("refusal_correct"), (e % 3 != 0).alias("clarification_correct"), (e % 3 == 0).alias("passed"))
    return metrics.judge_final(cases, one.unionByName(two)).select("case_code", "faithfulness_score", "borderline", "passed")


# -- experiments -------------------------------------------------------------------------


@query("""with p as (select event_id, user_id % 3 as n, user_id % 5 / 4.0 as r, event_id % 2 = 0 as d, (event_id % 7) / 8.0 - (user_id % 5) / 4.0 as gain from {events}), u as (select *, 'all' as scope from p union all select *, 'triggered' from p where d)
    select scope, count(*) as cases, round(avg(n), 6) as mean_sub_queries, round(avg(r), 6) as mean_coverage, count(case when r >= 1 then 1 end) as fully_covered from u group by 1""")
def exp4_decomposition(read):
    e, u = C("event_id"), C("user_id")
    p = read("events").select((e % 2 == 0).alias("t_decomposed"), ((e % 7) / 8.0).alias("t_fact_coverage"), ((u % 5) / 4.0).alias("c_fact_coverage"), (u % 3).alias("t_sub_queries"), ((u % 5) / 4.0).alias("t_coverage_rate"))
    return experiment.compare_decomposition(p).select("scope", "cases", "mean_sub_queries", "mean_coverage", "fully_covered")


@query("with c as (select coalesce(nullif(event_type, 'click'), 'UNKNOWN') as t, cast(user_id % 2 = 0 as int) as a, cast(event_id % 3 = 0 as int) as b from {events}) select coalesce(t, 'ALL') as chain_type, count(*) as cases, round(avg(a), 6) as first_hop_hit, round(avg(b), 6) as end_to_end from c group by rollup (t)")
def exp5_two_hop(read):
    c = read("events").select(F.nullif("event_type", F.lit("click")).alias("chain_type"), (C("user_id") % 2 == 0).alias("first_hop_hit"), (C("event_id") % 3 == 0).alias("end_to_end"))
    return experiment.compare_two_hop(c, ("first_hop_hit", "end_to_end")).withColumn("chain_type", F.coalesce("chain_type", F.lit("ALL")))


@query("""with g as (select case_code, chunk_id, 1 + chunk_id % 2 as hop from {case_gold}), h as (select case_code, chunk_id, 1 + chunk_id % 2 as hop from {case_hits}), f as (select case_code, max(case when hop = 1 then 1 else 0 end) as h1, max(case when hop = 2 then 1 else 0 end) as h2 from g join h using (case_code, chunk_id, hop) group by 1),
    w as (select case_code, case when case_code % 5 > 0 then 'fact ' || case_code else '' end as fact, case when case_code % 3 = 0 then 'about fact ' || case_code else 'none' end as q, (select min(chunk_id) from {case_hits} x where x.case_code = c.case_code) as support from {cases} c),
    j as (select w.case_code, coalesce(h1 = 1, false) as first_hop_hit, coalesce(h2 = 1, false) as second_hop_hit, fact <> '' as fact_extracted, (w.case_code, support) in (select (case_code, chunk_id) from g where hop = 1) as supporting_chunk_right, fact <> '' and contains(q, fact) as fact_injected, fact <> '' and w.case_code % 2 = 0 as alias_matched from w left join f using (case_code))
    select *, first_hop_hit and second_hop_hit and fact_extracted and supporting_chunk_right and fact_injected and alias_matched as end_to_end from j""")
def exp6_chain_flags(read):
    k = C("case_code")
    fact = F.when(k % 5 > 0, F.concat(F.lit("fact "), k.cast("string"))).otherwise("")
    support = read("case_hits").groupBy("case_code").agg(F.min("chunk_id").alias("supporting_chunk_id"))
    w = read("cases").join(support, "case_code", "left").select("case_code", "supporting_chunk_id", fact.alias("intermediate_fact"), F.when(k % 3 == 0, F.concat(F.lit("about fact "), k.cast("string"))).otherwise("none").alias("second_query"), F.when(k % 2 == 0, F.array(F.lit("Fact!"))).otherwise(F.array(F.lit("other"))).alias("aliases"))
    hop = (1 + C("chunk_id") % 2).alias("hop")
    return experiment.chain_flags(w, read("case_hits").select("case_code", hop, "chunk_id"), read("case_gold").select("case_code", hop, "chunk_id"))


@query("select cast(o_orderkey as varchar) as case_code, (o_orderstatus = 'F') and o_custkey % 2 = 0 as plan_match from {orders}")
def exp11_plan_match(read):
    a = read("orders").select(s("o_orderkey").alias("case_code"), C("o_orderstatus").alias("x"), (C("o_custkey") % 2).alias("y"))
    return experiment.plan_match(a, a.withColumn("x", F.lit("F")).withColumn("y", F.lit(0).cast("long")), ("x", "y"))


@query("select doc_id as chunk_id, text as content from {documents} d join (select chunk_id from {chunks} where status = 'ACTIVE') c on c.chunk_id = d.doc_id where doc_id % 3 < 2")
def jn1_pending_work(read):
    state = read("documents").select(C("doc_id").alias("chunk_id"), F.when(C("doc_id") % 3 == 0, "PENDING").when(C("doc_id") % 3 == 1, "FAILED").otherwise("SUCCESS").alias("status"), C("doc_id").alias("updated_at"))
    return experiment.pending_work(state, read("chunks"), 2_000_000_000).select("chunk_id", "content")


@query("select h.query_id as case_result_id, chunk_id, rank as rank_no, source as channel, 'c' || h.query_id as case_code from {hits} h where h.query_id % 3 = 0")
def jn3_run_hits(read):
    hits = read("hits").select(C("query_id").alias("case_result_id"), "chunk_id", C("rank").alias("rank_no"), C("source").alias("channel"), F.lit(1).alias("round_no"))
    results = read("cases").where("case_code % 3 = 0").select(C("case_code").alias("case_result_id"), F.concat(F.lit("c"), s("case_code")).alias("case_code"))
    return experiment.run_hits(hits, results).select("case_result_id", "chunk_id", "rank_no", "channel", "case_code")


@query("select o_orderkey as case_result_id, o_orderpriority as case_type, l_linenumber as n, s_name as doc from {orders} join {lineitem} on l_orderkey = o_orderkey join {supplier} on s_suppkey = l_suppkey")
def jn4_run_evidence(read):
    o = read("orders")
    r = o.select(C("o_orderkey").alias("case_result_id"), s("o_orderkey").alias("case_code"))
    rel = read("lineitem").select(s("l_orderkey").alias("case_code"), C("l_linenumber").alias("n"), s("l_suppkey").alias("source_doc_code"))
    d = read("supplier").select(s("s_suppkey").alias("source_doc_code"), C("s_name").alias("doc"))
    return experiment.run_evidence(r, o.select(s("o_orderkey").alias("case_code"), C("o_orderpriority").alias("case_type")), rel, d).select("case_result_id", "case_type", "n", "doc")


# -- incremental ------------------------------------------------------------------------


@query("select doc_id as chunk_id, case when doc_id % 4 = 0 then 'SUCCESS' when doc_id % 4 = 1 then 'FAILED' else 'PROCESSING' end as status, cast(doc_id % 3 + case when doc_id % 4 = 1 then 1 else 0 end as bigint) as retry_count from {documents}")
def str3_outcomes(read):
    d = read("documents")
    state = d.select(C("doc_id").alias("chunk_id"), F.lit("h").alias("text_hash"), F.lit("PROCESSING").alias("status"), (C("doc_id") % 3).alias("retry_count"))
    return jobs.apply_outcomes(state, d.where("doc_id % 4 < 2").select(C("doc_id").alias("chunk_id"), (C("doc_id") % 4 == 0).alias("ok"))).select("chunk_id", "status", C("retry_count").cast("long").alias("retry_count"))
