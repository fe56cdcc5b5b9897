"""Queries of the operators that clean, structure and chunk documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dataset, experiment, structure
from ..storage import shared_folder
from ..streaming import jobs
from .catalog import query

#: The lines of the view ``texts``, numbered and stripped, without blank ones.
LINES = """l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from {texts}), lines as (select * from l where line <> '')"""
LAST_ENDS = " or ".join(f"ends_with(before, '{e}')" for e in T.LINE_ENDS)
NUMBERED = r"^(\d+[\.、]|第[一二三四五六七八九十]+步|第[一二三四五六七八九十]+条)"


def _lines(read):
    return structure.to_lines(read("texts"))


def _faq(read):
    return structure.extract_faq(_lines(read))


REPAIRED = rf"""m as (select doc_id, line_no, line, lag(line) over (partition by doc_id order by line_no) as before from %s),
    g as (select *, sum(case when before <> '' and line <> '' and not regexp_matches(line, '{NUMBERED}') and not regexp_matches(before, '{NUMBERED}') and not ({LAST_ENDS}) then 0 else 1 end) over (partition by doc_id order by line_no) as n from m),
    s as (select doc_id, n, string_agg(line, '' order by line_no) as line from g group by doc_id, n)"""


@query(f"with {LINES}, {REPAIRED % 'l'} select doc_id, string_agg(line, chr(10) order by n) as text from s group by doc_id")
def prj3_repair_lines(read):
    return read("texts").select("doc_id", T.repair_lines(F.col("text")).alias("text"))


@query(f"""with {LINES}, k as (select * from l where not regexp_matches(line, '^第\\s*\\d+\\s*页\\s*/\\s*共\\s*\\d+\\s*页$')), {REPAIRED % 'k'}
    select doc_id, 'SOP' as doc_type, string_agg(line, chr(10) order by n) as clean from s group by doc_id union all select doc_id, 'FAQ', string_agg(line, chr(10) order by line_no) from k group by doc_id""")
def prj4_clean(read):
    both = read("texts").select("doc_id", "text", F.explode(F.array(F.lit("SOP"), F.lit("FAQ"))).alias("doc_type"))
    return both.select("doc_id", "doc_type", T.clean(F.col("text"), F.col("doc_type")).alias("clean"))


FAQ = f"""{LINES}, marked as (select *, case when regexp_matches(line, '^(?i:Q\\d*|问题\\d*)[:：]\\s*.+$') then 'q' when regexp_matches(line, '^(?i:A\\d*|答案\\d*)[:：]\\s*.+$') then 'a' when regexp_matches(line, '^(同义问法|相似问法|别名)[:：]') then 's' else 't' end as kind from lines),
    numbered as (select *, sum(case when kind = 'q' then 1 else 0 end) over (partition by doc_id order by line_no) as pair_no from marked),
    pairs as (select doc_id, pair_no, max(case when kind = 'q' then trim(regexp_replace(line, '^[^:：]*[:：]', '')) end) as question, coalesce(string_agg(case kind when 'a' then trim(regexp_replace(line, '^[^:：]*[:：]', '')) when 't' then line end, chr(10) order by line_no), '') as answer,
        replace(coalesce(max(case when kind = 's' then regexp_replace(line, '^[^:：]*[:：]', '') end), ''), '，', '~') as aliases from numbered where pair_no > 0 group by doc_id, pair_no having count(case when kind in ('a', 't') then 1 end) > 0)"""


@query(f"with {FAQ} select doc_id, pair_no, question, answer, aliases from pairs")
def prj5_faq_pairs(read):
    return _faq(read).select("doc_id", "pair_no", "question", "answer", F.array_join("aliases", "~").alias("aliases"))


CELLS = """select o_orderkey as doc_id, 0 as table_no, 0 as row_no, 0 as col_no, ' 问题 ' as text from {orders} union all select o_orderkey, 0, 0, 1, 'Answer' from {orders} union all select o_orderkey, 0, 0, 2, '标签' from {orders}
    union all select o_orderkey, 0, 1, 0, o_orderpriority from {orders} union all select o_orderkey, 0, 1, 1, o_orderstatus from {orders} union all select o_orderkey, 0, 1, 2, concat('a，b;', o_orderstatus) from {orders}
    union all select o_orderkey, 0, 2, 0, o_orderpriority from {orders} union all select o_orderkey, 0, 2, 1, cast(o_custkey as varchar(9)) from {orders} union all select o_orderkey, 0, 3, 0, '' from {orders} union all select o_orderkey, 0, 3, 1, 'x' from {orders}"""


def _cells(read):
    o = read("orders")
    cell = lambda row, col, value: F.struct(F.lit(0).alias("table_no"), F.lit(row).alias("row_no"), F.lit(col).alias("col_no"), value.alias("text"))
    made = F.array(
        cell(0, 0, F.lit(" 问题 ")), cell(0, 1, F.lit("Answer")), cell(0, 2, F.lit("标签")), cell(1, 0, F.col("o_orderpriority")), cell(1, 1, F.col("o_orderstatus")), cell(1, 2, F.concat(F.lit("a，b;"), "o_orderstatus")),
        cell(2, 0, F.col("o_orderpriority")), cell(2, 1, F.col("o_custkey").cast("string")), cell(3, 0, F.lit("")), cell(3, 1, F.lit("x")),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.explode(made).alias("c")).select("doc_id", "c.*")


@query("select o_orderkey as doc_id, 1 as row_no, o_orderpriority as question, o_orderstatus as answer, 'a~b~' || o_orderstatus as tags from {orders} union all select o_orderkey, 2, o_orderpriority, cast(o_custkey as varchar), '' from {orders}")
def prj7_faq_table(read):
    return structure.extract_faq_table(_cells(read)).select("doc_id", "row_no", "question", "answer", F.array_join("tags", "~").alias("tags"))


@query("select o_orderkey as doc_id, '问题' as key, 'Answer' as value from {orders} union all select o_orderkey, o_orderpriority, cast(o_custkey as varchar) from {orders}")
def prj8_metadata(read):
    return structure.extract_metadata(_cells(read))


RULES = f"""{LINES}, headed as (select *, max(case when starts_with(line, '一、') or ends_with(line, '规则') or ends_with(line, '说明') or ends_with(line, '规范') or ends_with(line, '流程') then line_no end) over (partition by doc_id order by line_no) as h from lines),
    rules as (select a.doc_id, a.line_no, regexp_extract(a.line, '^(\\d+(?:\\.\\d+)*)', 1) as clause_no, coalesce(b.line, '') as title_path, trim(regexp_replace(a.line, '^\\d+(?:\\.\\d+)*[\\.、\\s]*', '')) as content, a.line as raw_line from headed a left join lines b on a.doc_id = b.doc_id and a.h = b.line_no where regexp_matches(a.line, '^\\d'))"""


@query(f"with {RULES} select * from rules")
def prj9_clauses(read):
    return structure.extract_rules(_lines(read))


SOP = f"""{LINES}, sop as (select doc_id, min_by(line, line_no) as title, coalesce(string_agg(case when starts_with(line, '适用场景') then line end, chr(10) order by line_no), '') as scene,
    coalesce(string_agg(case when regexp_matches(line, '^\\d+[\\.、]') then line end, chr(10) order by line_no), '') as steps, coalesce(string_agg(case when starts_with(line, '注意') then line end, chr(10) order by line_no), '') as notes from lines group by doc_id)"""


def _sop(read):
    return structure.extract_sop(_lines(read))


@query(f"with {SOP} select * from sop")
def prj10_sop(read):
    return _sop(read).select("doc_id", "title", "scene", F.array_join("steps", "\n").alias("steps"), F.array_join("notes", "\n").alias("notes"))


@query(f"""with {LINES} select doc_id, min_by(line, line_no) as title, array_to_string((list(line order by line_no) filter (where starts_with(line, '一、') or ends_with(line, '操作') or ends_with(line, '说明') or ends_with(line, '配置') or ends_with(line, '管理')))[-3:], ' > ') as title_path,
    coalesce(string_agg(case when regexp_matches(line, '^\\d+[\\.、]') then line end, chr(10) order by line_no), '') as steps, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(line, '【(.+?)】', 1))))), '~') as buttons from lines group by doc_id""")
def prj11_manual(read):
    m = structure.extract_manual(_lines(read))
    return m.select("doc_id", "title", "title_path", F.array_join("steps", "\n").alias("steps"), F.array_join(F.array_sort("button_names"), "~").alias("buttons"))


def _kind():
    return F.element_at(F.array(*map(F.lit, structure.TYPES)), (F.col("doc_id") % 4 + 1).cast("int"))


def _parsed(read):
    docs = read("texts").select("doc_id", _kind().alias("doc_type"), F.col("text").alias("content"))
    return structure.parse(docs, cleaned=False).withColumn("clean_content", F.lit(""))


CHUNKED = ("doc_id", "chunk_type", "title", "title_path", "content", "source_section", "sort_order")
FAQ_CHUNKS = """select doc_id, 'FAQ' as chunk_type, question as title, 'FAQ > ' || question as title_path, '问题：' || question || chr(10) || '答案：' || answer || case when aliases <> '' then chr(10) || '同义问法：' || replace(aliases, '~', '；') else '' end as content, 'FAQ-' || n as source_section, n as sort_order
    from (select *, row_number() over (partition by doc_id order by pair_no) as n from pairs) where question <> '' and answer <> ''"""
RULE_CHUNKS = """select doc_id, 'RULE' as chunk_type, clause_no || ' ' || substr(content, 1, 30) as title, '业务规则 > ' || doc_title || ' > ' || title_path as title_path, '文档标题：' || doc_title || chr(10) || '章节：' || title_path || chr(10) || '条款编号：' || clause_no || chr(10) || '规则内容：' || content as content, clause_no as source_section,
    row_number() over (partition by doc_id order by line_no) as sort_order from (select rules.*, first_value(l.line) over () as x, t.doc_title from rules join (select doc_id, min_by(line, line_no) as doc_title from lines group by doc_id) t using (doc_id) join l on l.doc_id = rules.doc_id and l.line_no = 0) r"""
SOP_CHUNKS = """select doc_id, 'SOP' as chunk_type, title, 'SOP > ' || title as title_path, 'SOP标题：' || title || chr(10) || '适用场景：' || scene || chr(10) || '完整处理流程：' || chr(10) || steps || chr(10) || '注意事项：' || chr(10) || notes as content, 'SOP总览' as source_section, 1 as sort_order from sop
    union all select doc_id, 'SOP', title || ' - 步骤组 1', 'SOP > ' || title || ' > 步骤组 1', 'SOP标题：' || title || chr(10) || '适用场景：' || scene || chr(10) || '步骤组：1' || chr(10) || '处理步骤：' || chr(10) || steps, '步骤组-1', 2 from sop"""


@query(f"with {FAQ} {FAQ_CHUNKS}")
def prj12_chunk_faq(read):
    return structure.chunk_faq(_parsed(read).where("qa_pairs is not null")).select(*CHUNKED)


@query(f"with {SOP} {SOP_CHUNKS}")
def prj13_chunk_sop(read):
    return structure.chunk_sop(_parsed(read)).select(*CHUNKED)


@query(f"with {RULES} {RULE_CHUNKS}")
def prj14_chunk_rule(read):
    return structure.chunk_rule(_parsed(read)).select(*CHUNKED)


MANUAL_CHUNKS = """select doc_id, 'MANUAL' as chunk_type, title, '操作手册 > ' || path as title_path, '操作手册：' || title || chr(10) || '标题路径：' || path || chr(10) || '操作步骤：' || chr(10) || steps || chr(10) || '涉及按钮：' || buttons as content, path as source_section, 1 as sort_order from
    (select sop.*, sop.title || ' > 系统配置' as path, (select list_distinct(regexp_extract_all(x.line, '【(.+?)】', 1))[1] from lines x where x.doc_id = sop.doc_id and contains(x.line, '【')) as b, o.o_orderstatus || '；查询' as buttons from sop join {orders} o on o.o_orderkey = sop.doc_id)"""


@query(f"with {SOP} {MANUAL_CHUNKS}")
def prj15_chunk_manual(read):
    return structure.chunk_manual(_parsed(read)).select(*CHUNKED)


@query(f"""with {FAQ}, {SOP.removeprefix(LINES)[2:]}, {RULES.removeprefix(LINES)[2:]}, every as (select * from ({FAQ_CHUNKS}) union all select * from ({SOP_CHUNKS}) union all select * from ({RULE_CHUNKS}) union all select * from ({MANUAL_CHUNKS}))
    select every.* from every where chunk_type = case doc_id % 4 when 0 then 'FAQ' when 1 then 'SOP' when 2 then 'RULE' else 'MANUAL' end""")
def prj16_chunk(read):
    return structure.chunk(_parsed(read)).select(*CHUNKED)


#: The texts cleaned by their type, and the chunks that hold such a text or are made of its lines.
TYPED = f"""typed as (select doc_id, clean as text from (with {LINES}, k as (select * from l where not regexp_matches(line, '^第\\s*\\d+\\s*页\\s*/\\s*共\\s*\\d+\\s*页$')), {REPAIRED % 'k'}
        select doc_id, string_agg(line, chr(10) order by n) as clean from s where doc_id % 2 = 1 group by doc_id
        union all select doc_id, string_agg(line, chr(10) order by line_no) from k where doc_id % 2 = 0 group by doc_id))"""
MANUAL = """manual as (select doc_id, min_by(line, line_no) as title, array_to_string((list(line order by line_no) filter (where starts_with(line, '一、') or ends_with(line, '操作') or ends_with(line, '说明') or ends_with(line, '配置') or ends_with(line, '管理')))[-3:], ' > ') as path,
        list_distinct(flatten(list(regexp_extract_all(line, '【(.+?)】', 1) order by line_no))) as names, min_by(regexp_extract_all(line, '【(.+?)】', 1), line_no) filter (where contains(line, '【')) as named from lines group by doc_id)"""


@query(
    f"""with {TYPED}, {FAQ.replace("{texts}", "typed")}, {SOP.removeprefix(LINES)[2:]}, {RULES.removeprefix(LINES)[2:]}, {MANUAL},
    every as (select * from ({FAQ_CHUNKS}) union all select * from ({RULE_CHUNKS})
        union all select c.doc_id, c.chunk_type, c.title, c.title_path, case when c.sort_order = 1 then t.text else c.content end, c.source_section, c.sort_order from ({SOP_CHUNKS}) c join typed t on t.doc_id = c.doc_id
        union all select m.doc_id, 'MANUAL', m.title, '操作手册 > ' || m.path, t.text || chr(10) || '涉及按钮：' || array_to_string(list_concat(list_distinct(m.named[:1]), list_filter(m.named[2:], lambda x: x <> m.named[1])), '；'), m.path, 1 from manual m join typed t on t.doc_id = m.doc_id)
    select every.* from every where chunk_type = case doc_id % 4 when 0 then 'FAQ' when 1 then 'SOP' when 2 then 'RULE' else 'MANUAL' end"""
)
def str1_arriving(read):
    """All texts arrive in two batches, of which the first is played twice; what the reader then sees."""
    docs = read("texts").select("doc_id", _kind().alias("doc_type"), F.col("text").alias("content"))
    target = f"{shared_folder(docs.sparkSession)}/arrived-{uuid.uuid4().hex}"
    odd = F.col("doc_id") % 3 == 0
    for number, rows in ((0, docs.where(odd)), (1, docs.where(~odd)), (0, docs.where(odd))):
        jobs.ingest_batch(rows, number, target, "run")
    return jobs.current_chunks(docs.sparkSession, target).select(*CHUNKED)


@query("select p_partkey, 'exact_' || trim(lower(regexp_replace(p_name || '/' || p_brand, '[^\\p{L}\\p{N}]+', '_', 'g')), '_') as slug from {part}")
def fn19_fact_slug(read):
    return read("part").select("p_partkey", T.fact_slug(F.concat("p_name", F.lit("/"), "p_brand")).alias("slug"))


@query("select doc_id, case when length(x) > 80 then substr(x, 1, 79) || '…' else x end as cell from (select doc_id, replace(replace(text, '|', '\\|'), chr(10), ' ') as x from {documents})")
def fn20_markdown_cell(read):
    return read("documents").select("doc_id", T.markdown_cell(F.col("text")).alias("cell"))


@query("select '| ' || p_partkey || ' | ' || p_name || ' | ' || replace(p_brand, '|', '\\|') || ' |' as line from {part}")
def snk5_markdown_rows(read):
    return experiment.markdown_rows(read("part").select("p_partkey", "p_name", "p_brand"))


@query("select l_orderkey, l_linenumber, format('{:.2f}', round(l_discount * 100, 2)) || '%' as discount from {lineitem}")
def fn12_percent(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", T.percent(F.col("l_discount")).alias("discount"))


#: Quotes of whole chunks, with other punctuation, across two chunks, and of no chunk.
QUOTES = r"""c as (select *, lead(chunk_id) over (partition by doc_id order by sort_order, chunk_id) as next_id, lead(content) over (partition by doc_id order by sort_order, chunk_id) as next_content from {chunks} where status = 'ACTIVE'),
    e as (select doc_id as case_code, doc_id - doc_id % 4 as mapped, case doc_id % 4 when 0 then substr(replace(text, chr(10), ' '), 5, 40) when 1 then replace(substr(text, 5, 40), ' ', ' - ')
        when 2 then concat(right(text, 25), ' ', coalesce((select substr(d2.text, 1, 25) from {documents} d2 where d2.doc_id = d.doc_id + 1), '')) else concat(substr(text, 9, 12), 'xyzzy') end as quote from {documents} d where length(text) > 60)"""


@query(rf"""with {QUOTES},
    n as (select c.*, lower(regexp_replace(content, '\s+', '', 'g')) as squeezed, lower(regexp_replace(content, '[^\p{{L}}\p{{N}}]+', '', 'g')) as bare, lower(regexp_replace(content || coalesce(next_content, ''), '[^\p{{L}}\p{{N}}]+', '', 'g')) as pair_text from c),
    q as (select *, lower(regexp_replace(quote, '\s+', '', 'g')) as squeezed_quote, lower(regexp_replace(quote, '[^\p{{L}}\p{{N}}]+', '', 'g')) as bare_quote from e),
    tiered as (select q.case_code, chunk_id, parent_chunk_id, case when contains(squeezed, squeezed_quote) then 1 when bare_quote <> '' and contains(bare, bare_quote) then 2 when next_id is not null and bare_quote <> '' and contains(pair_text, bare_quote) then 3 end as tier from q join n on n.doc_id = q.mapped),
    best as (select * from tiered t where tier = (select min(tier) from tiered u where u.case_code = t.case_code)),
    marked as (select *, chunk_id in (select p.parent_chunk_id from best p where p.case_code = best.case_code) as is_parent from best),
    per as (select case_code, tier, count(*) as n, min(chunk_id) as one, count(case when is_parent then 1 end) as parents, min(case when not coalesce(is_parent, false) then chunk_id end) as leaf from marked group by all)
    select e.case_code, case when tier is null then 'MISSING' when tier < 3 and (n = 1 or (parents > 0 and n - parents = 1)) then 'MAPPED' else 'AMBIGUOUS' end as mapping_status,
        case tier when 1 then 'EXACT' when 2 then 'PUNCTUATION_NORMALIZED' when 3 then 'ADJACENT_CHUNKS' else 'NOT_FOUND' end || case when tier < 3 and n > 1 and parents > 0 and n - parents = 1 then '_MOST_SPECIFIC' else '' end as method,
        case when tier < 3 and n = 1 then one when tier < 3 and parents > 0 and n - parents = 1 then leaf end as mapped_chunk_id from e left join per using (case_code)""")
def jn7_map_evidence(read):
    d = read("documents")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.substring("text", 1, 25).alias("start"))
    quote = (
        F.when(F.col("doc_id") % 4 == 0, F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 5, 40))
        .when(F.col("doc_id") % 4 == 1, F.replace(F.substring("text", 5, 40), F.lit(" "), F.lit(" - ")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.right("text", F.lit(25)), F.lit(" "), F.coalesce("start", F.lit(""))))
        .otherwise(F.concat(F.substring("text", 9, 12), F.lit("xyzzy")))
    )
    e = d.where("char_length(text) > 60").join(following, "doc_id", "left").select(F.col("doc_id").alias("case_code"), (F.col("doc_id") - F.col("doc_id") % 4).cast("string").alias("source_doc_code"), quote.alias("evidence_quote"))
    docs = read("chunks").select(F.col("doc_id").cast("string").alias("source_doc_code"), F.col("doc_id").alias("mapped_doc_id")).distinct()
    return dataset.map_evidence(e, docs, read("chunks")).select("case_code", "mapping_status", "method", "mapped_chunk_id")


@query("""with f as (select doc_id, concat('f', doc_id % 2) as fact_key, max(substr(text, 1, 30)) as fact_text from (select doc_id - doc_id % 4 as doc_id, text from {documents} where length(text) > 30) group by 1, 2)
    select f.doc_id, f.fact_key, coalesce(string_agg(cast(c.chunk_id as varchar), ',' order by c.chunk_id), '') as chunk_ids from f left join {chunks} c on c.doc_id = f.doc_id and regexp_replace(f.fact_text, '[^\\p{L}\\p{N}]+', '', 'g') <> '' and contains(lower(regexp_replace(c.content, '[^\\p{L}\\p{N}]+', '', 'g')), lower(regexp_replace(f.fact_text, '[^\\p{L}\\p{N}]+', '', 'g'))) group by 1, 2""")
def jn8_map_facts(read):
    d = read("documents").where("char_length(text) > 30").select((F.col("doc_id") - F.col("doc_id") % 4).alias("doc_id"), "text")
    f = d.groupBy("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 2).cast("string")).alias("fact_key")).agg(F.max(F.substring("text", 1, 30)).alias("fact_text"))
    return dataset.map_facts(f, read("chunks")).select("doc_id", "fact_key", F.array_join("chunk_ids", ",").alias("chunk_ids"))
