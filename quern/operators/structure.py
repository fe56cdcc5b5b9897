"""Text lines to typed structures, structures to chunks, chunks to relations.

Lines come as (doc_id, line_no, line). Each structuring is a window or a grouping
per document; nothing is collected beyond a document's own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, split_multi, strip, text

#: Forms of lines.
QUESTION_LINE = r"(?i)^(Q\d*|问题\d*)[:：]\s*(.+)$"
ANSWER_LINE = r"(?i)^(A\d*|答案\d*)[:：]\s*(.+)$"
ALIAS_LINE = r"(?i)^(同义问法|相似问法|别名|aliases?)[:：]\s*(.+)$"
CLAUSE_LINE = r"(?s)^(\d+(?:\.\d+)*|第[一二三四五六七八九十]+条)[\.、\s]*(.+)"
STEP_LINE = r"^(\d+[\.、]|第[一二三四五六七八九十]+步)"
HEADING_STARTS = ("一、", "二、", "三、", "四、")
RULE_ENDS, MANUAL_ENDS = ("规则", "说明", "规范", "流程"), ("操作", "说明", "配置", "管理")
SCENE_STARTS, NOTE_STARTS = ("适用场景", "场景", "适用范围"), ("注意", "备注", "说明")
BUTTON = r"[【\[](.+?)[】\]]"
#: Header names of question-and-answer tables, by role, best first.
HEADERS = {"question": ("问题", "question", "q"), "answer": ("答案", "answer", "a"), "aliases": ("同义问法", "相似问法", "aliases"), "tags": ("标签", "tags")}


def _starts(col: Column, heads) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(col, F.lit(h))
    return out


def _ends(col: Column, tails) -> Column:
    out = F.lit(False)
    for t in tails:
        out = out | F.endswith(col, F.lit(t))
    return out


def _listed(value: Column, when: Column, order: str = "line_no") -> Column:
    """The values of a group where ``when`` holds, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda x: x["v"])


def to_lines(documents: DataFrame, content: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of the lines that are not blank, stripped."""
    split = documents.select("doc_id", F.posexplode(F.split(text(F.col(content)), "\n", -1)).alias("line_no", "raw"))
    return split.select("doc_id", "line_no", strip(F.col("raw")).alias("line")).where("line <> ''")


def extract_faq(lines: DataFrame) -> DataFrame:
    """(doc_id, pair_no, question, answer, aliases, tags): a question line starts a pair; answer lines
    and plain lines add to its answer; the last alias line counts; pairs without an answer go.
    Answer lines before the first question are carried to no pair."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    line = F.col("line")
    kind = F.when(line.rlike(QUESTION_LINE), "q").when(line.rlike(ANSWER_LINE), "a").when(line.rlike(ALIAS_LINE), "s").otherwise("t")
    marked = lines.withColumn("kind", kind).withColumn("pair_no", F.sum((F.col("kind") == "q").cast("int")).over(order)).where("pair_no > 0")
    said = F.when(F.col("kind") == "a", strip(F.regexp_extract("line", ANSWER_LINE, 2))).otherwise(line)
    pairs = marked.groupBy("doc_id", "pair_no").agg(
        F.max(F.when(F.col("kind") == "q", strip(F.regexp_extract("line", QUESTION_LINE, 2)))).alias("question"),
        strip(F.array_join(_listed(said, F.col("kind").isin("a", "t")), "\n")).alias("answer"),
        F.count(F.when(F.col("kind").isin("a", "t"), 1)).alias("parts"),
        F.max_by(F.when(F.col("kind") == "s", F.regexp_extract("line", ALIAS_LINE, 2)), F.when(F.col("kind") == "s", F.col("line_no"))).alias("alias_text"),
    )
    return pairs.where("parts > 0").select("doc_id", "pair_no", "question", "answer", split_multi(F.col("alias_text")).alias("aliases"), F.array().cast("array<string>").alias("tags"))


def extract_faq_table(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, question, answer, aliases, tags) from cells (doc_id, table_no, row_no,
    col_no, text). Row 0 is the header; the first known name of each role picks the column."""
    head = F.lower(strip(F.col("text")))
    names = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(i).alias("nth"), F.lit(n).alias("name")) for role, known in HEADERS.items() for i, n in enumerate(known)])
    roles = cells.where("row_no = 0").select("doc_id", "table_no", "col_no", F.explode(F.filter(names, lambda n: n["name"] == head)).alias("n"))
    roles = roles.groupBy("doc_id", "table_no", F.col("n.role").alias("role")).agg(F.min_by("col_no", F.struct("n.nth", "col_no")).alias("col_no"))
    body = cells.where("row_no > 0").join(roles, ["doc_id", "table_no", "col_no"])
    rows = body.groupBy("doc_id", "table_no", "row_no").pivot("role", list(HEADERS)).agg(F.first(strip(F.col("text"))))
    return rows.where((text(F.col("question")) != "") & (text(F.col("answer")) != "")).select("doc_id", "table_no", "row_no", "question", "answer", split_multi(F.col("aliases")).alias("aliases"), split_multi(F.col("tags")).alias("tags"))


def extract_metadata(cells: DataFrame) -> DataFrame:
    """(doc_id, key, value) of the first two cells of each table row; the last row of a key counts."""
    wide = cells.where("col_no in (0, 1)").groupBy("doc_id", "table_no", "row_no").pivot("col_no", [0, 1]).agg(F.first(strip(F.col("text")))).toDF("doc_id", "table_no", "row_no", "key", "value")
    return wide.where((text(F.col("key")) != "") & (text(F.col("value")) != "")).groupBy("doc_id", "key").agg(F.max_by("value", F.struct("table_no", "row_no")).alias("value"))


def extract_rules(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, clause_no, title_path, content, raw_line) of clause lines, under the last heading."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = _starts(F.col("line"), HEADING_STARTS) | _ends(F.col("line"), RULE_ENDS)
    headed = lines.withColumn("title_path", text(F.last(F.when(heading, F.col("line")), ignorenulls=True).over(order)))
    return headed.where(F.col("line").rlike(CLAUSE_LINE)).select(
        "doc_id", "line_no", F.regexp_extract("line", CLAUSE_LINE, 1).alias("clause_no"), "title_path", strip(F.regexp_extract("line", CLAUSE_LINE, 2)).alias("content"), F.col("line").alias("raw_line")
    )


def extract_sop(lines: DataFrame) -> DataFrame:
    """(doc_id, title, scene, steps, notes): a line is a scene, else a step, else a note line."""
    line = F.col("line")
    kind = F.when(_starts(line, SCENE_STARTS), "scene").when(line.rlike(STEP_LINE), "step").when(_starts(line, NOTE_STARTS), "note")
    return lines.withColumn("kind", kind).groupBy("doc_id").agg(
        F.min_by("line", "line_no").alias("title"),
        F.array_join(_listed(line, F.col("kind") == "scene"), "\n").alias("scene"),
        _listed(line, F.col("kind") == "step").alias("steps"),
        _listed(line, F.col("kind") == "note").alias("notes"),
    )


def extract_manual(lines: DataFrame) -> DataFrame:
    """(doc_id, title, title_path, steps, button_names): the last three headings, steps, buttons as first seen."""
    line = F.col("line")
    heading = _starts(line, HEADING_STARTS) | _ends(line, MANUAL_ENDS)
    grouped = lines.groupBy("doc_id").agg(
        F.min_by("line", "line_no").alias("title"),
        _listed(line, heading).alias("titles"),
        _listed(line, line.rlike(STEP_LINE)).alias("steps"),
        F.flatten(_listed(F.regexp_extract_all(line, F.lit(BUTTON), 1), F.lit(True))).alias("buttons"),
    )
    last = F.slice("titles", F.greatest(F.lit(1), F.size("titles") - 2), F.lit(3))
    return grouped.select("doc_id", "title", F.array_join(last, " > ").alias("title_path"), "steps", F.array_distinct("buttons").alias("button_names"))


CHUNK = ("doc_id", "chunk_type", "title", "title_path", "content", "summary", "keywords", "tags", "source_section", "parent_key", "key", "sort_order")


def _chunks(df: DataFrame, **columns) -> DataFrame:
    empty = F.lit(None).cast("string")
    return df.select(*[(columns.get(c, empty) if c != "doc_id" else F.col("doc_id")).alias(c) for c in CHUNK])


def chunk_faq(parsed: DataFrame) -> DataFrame:
    """One chunk for each pair of (doc_id, qa_pairs) with a question and an answer."""
    pairs = parsed.select("doc_id", F.posexplode_outer("qa_pairs").alias("i", "p"))
    q, a = strip(F.col("p.question")), strip(F.col("p.answer"))
    aliases, tags = text(F.array_join("p.aliases", "；")), text(F.array_join("p.tags", "；"))
    n = (F.col("i") + 1).cast("string")
    content = F.concat(F.lit("问题："), q, F.lit("\n答案："), a, F.when(aliases != "", F.concat(F.lit("\n同义问法："), aliases)).otherwise(""), F.when(tags != "", F.concat(F.lit("\n标签："), tags)).otherwise(""))
    return _chunks(
        pairs.where((q != "") & (a != "")), chunk_type=F.lit("FAQ"), title=q, title_path=F.concat(F.lit("FAQ > "), q), content=content, summary=F.substring(a, 1, 200),
        keywords=aliases, tags=tags, source_section=F.concat(F.lit("FAQ-"), n), key=F.concat(F.lit("faq-"), n), sort_order=F.col("i") + 1,
    )


def chunk_sop(parsed: DataFrame, group: int = 3) -> DataFrame:
    """An overview chunk for each (doc_id, title, scene, steps, notes, clean_content), and one for each ``group`` steps."""
    title = F.when(text(F.col("title")) == "", "SOP流程").otherwise(F.col("title"))
    scene, steps, notes = text(F.col("scene")), F.coalesce("steps", F.array().cast("array<string>")), F.coalesce("notes", F.array().cast("array<string>"))
    made = F.concat(
        F.lit("SOP标题："), title, F.lit("\n"), F.when(scene != "", F.concat(F.lit("适用场景："), scene, F.lit("\n"))).otherwise(""),
        F.when(F.size(steps) > 0, F.concat(F.lit("完整处理流程：\n"), F.array_join(steps, "\n"), F.lit("\n"))).otherwise(""),
        F.when(F.size(notes) > 0, F.concat(F.lit("注意事项：\n"), F.array_join(notes, "\n"))).otherwise(""),
    )
    parent = _chunks(
        parsed, chunk_type=F.lit("SOP"), title=title, title_path=F.concat(F.lit("SOP > "), title), content=F.when(strip(F.col("clean_content")) != "", strip(F.col("clean_content"))).otherwise(strip(made)),
        summary=F.concat(title, F.lit(" 总览")), source_section=F.lit("SOP总览"), key=F.lit("sop-parent"), sort_order=F.lit(1),
    )
    parts = parsed.where(F.size(steps) > 0).select("doc_id", title.alias("title"), scene.alias("scene"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(group)), lambda i: F.slice(steps, i + 1, F.lit(group)))).alias("i", "part"))
    n = (F.col("i") + 1).cast("string")
    body = F.array_join("part", "\n")
    children = _chunks(
        parts, chunk_type=F.lit("SOP"), title=F.concat("title", F.lit(" - 步骤组 "), n), title_path=F.concat(F.lit("SOP > "), "title", F.lit(" > 步骤组 "), n),
        content=F.concat(F.lit("SOP标题："), "title", F.lit("\n适用场景："), "scene", F.lit("\n步骤组："), n, F.lit("\n处理步骤：\n"), body),
        summary=F.substring(body, 1, 200), source_section=F.concat(F.lit("步骤组-"), n), parent_key=F.lit("sop-parent"), key=F.concat(F.lit("sop-child-"), n), sort_order=F.col("i") + 2,
    )
    return parent.unionByName(children)


def chunk_rule(parsed: DataFrame) -> DataFrame:
    """One chunk for each clause of (doc_id, title, clauses) that has content."""
    title = F.when(text(F.col("title")) == "", "业务规则").otherwise(F.col("title"))
    c = parsed.select("doc_id", title.alias("doc_title"), F.posexplode_outer("clauses").alias("i", "c"))
    no, path, raw = strip(F.col("c.clause_no")), strip(F.col("c.title_path")), strip(F.col("c.raw_line"))
    rest = F.when(F.startswith(raw, no), F.regexp_replace(F.substr(raw, F.char_length(no) + 1), r"(?U)^[\.、\s]*", "")).otherwise(raw)
    content = F.when(raw != "", strip(rest)).otherwise(strip(F.col("c.content")))
    c = c.select("*", no.alias("no"), path.alias("path"), raw.alias("raw"), content.alias("body")).where("body <> ''")
    n = (F.col("i") + 1).cast("string")
    return _chunks(
        c, chunk_type=F.lit("RULE"), title=F.concat("no", F.lit(" "), F.substring("body", 1, 30)), title_path=F.concat(F.lit("业务规则 > "), "doc_title", F.lit(" > "), "path"),
        content=F.concat(F.lit("文档标题："), "doc_title", F.lit("\n章节："), "path", F.lit("\n条款编号："), "no", F.lit("\n规则内容："), "body"),
        summary=F.substring("body", 1, 200), keywords=F.col("raw"), source_section=F.when(F.col("no") != "", F.col("no")).otherwise(F.concat(F.lit("规则-"), n)), key=F.concat(F.lit("rule-"), n), sort_order=F.col("i") + 1,
    )


def chunk_manual(parsed: DataFrame) -> DataFrame:
    """One chunk for each (doc_id, title, title_path, steps, button_names, clean_content) with steps or text."""
    title = F.when(text(F.col("title")) == "", "操作手册").otherwise(F.col("title"))
    path = F.when(text(F.col("title_path")) == "", title).otherwise(F.col("title_path"))
    steps = F.coalesce("steps", F.array().cast("array<string>"))
    clean_text, buttons = text(F.col("clean_content")), text(F.array_join("button_names", "；"))
    made = F.concat(F.lit("操作手册："), title, F.lit("\n标题路径："), path, F.lit("\n"), F.when(F.size(steps) > 0, F.concat(F.lit("操作步骤：\n"), F.array_join(steps, "\n"))).otherwise(""))
    content = F.concat(F.when(strip(clean_text) != "", strip(clean_text)).otherwise(made), F.when(buttons != "", F.concat(F.lit("\n涉及按钮："), buttons)).otherwise(""))
    return _chunks(
        parsed.where((F.size(steps) > 0) | (clean_text != "")), chunk_type=F.lit("MANUAL"), title=title, title_path=F.concat(F.lit("操作手册 > "), path), content=content,
        summary=F.when(F.size(steps) > 0, F.substring(F.array_join(steps, "\n"), 1, 200)).otherwise(F.substring(clean_text, 1, 200)), keywords=buttons, source_section=path, key=F.lit("manual-1"), sort_order=F.lit(1),
    )


TYPES = {"FAQ": chunk_faq, "SOP": chunk_sop, "RULE": chunk_rule, "MANUAL": chunk_manual}


def chunk(parsed: DataFrame) -> DataFrame:
    """The chunks of all documents by ``doc_type``; an unknown type is an error when the rows are read."""
    known = parsed.withColumn("doc_type", F.when(F.col("doc_type").isin(*TYPES), F.col("doc_type")).otherwise(F.raise_error(F.concat(F.lit("unknown document type "), text(F.col("doc_type"))))))
    out = None
    for kind, make in TYPES.items():
        part = make(known.where(F.col("doc_type") == kind))
        out = part if out is None else out.unionByName(part)
    return out


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _between(lines: Column, flag) -> Column:
    """The stretches of a list from each place where ``flag`` (entry, place) holds to the next."""

    def cut(all_lines):
        places = F.filter(F.transform(all_lines, lambda x, i: F.when(flag(x, i), i + 1)), lambda i: i.isNotNull())
        stretch = lambda a, b: F.slice(all_lines, a, F.coalesce(b, F.size(all_lines) + 1) - a)
        return _once(places, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), stretch))

    return _once(lines, cut)


def parse(documents: DataFrame, cleaned: bool = True) -> DataFrame:
    """The structures of documents (doc_id, doc_type, content), as the chunking functions take them: doc_id, doc_type,
    clean_content, title, scene, steps, notes, title_path, button_names, qa_pairs and clauses.

    The text is cleaned first unless ``cleaned`` is false. A document without a line that is not blank has no row.
    A document is one row from its text to its structures, as ``extract_faq`` and the others make them of tables of
    lines, so nothing is shuffled; each step takes a stretch of the lines once."""
    body = clean(F.col("content"), F.col("doc_type")) if cleaned else text(F.col("content"))
    docs = documents.where("doc_id is not null").select("doc_id", "doc_type", body.alias("clean_content"))
    stripped = F.filter(F.transform(F.split("clean_content", "\n", -1), strip), lambda x: x != "")
    # Generated, so that no later filter or projection makes the lines again.
    docs = docs.select("*", F.explode_outer(F.array(stripped)).alias("lines")).where(F.size("lines") > 0)
    lines = F.col("lines")
    note = lambda x: ~_starts(x, SCENE_STARTS) & ~x.rlike(STEP_LINE) & _starts(x, NOTE_STARTS)
    manual = F.filter(lines, lambda x: _starts(x, HEADING_STARTS) | _ends(x, MANUAL_ENDS))
    kind = lambda x: F.when(x.rlike(QUESTION_LINE), "q").when(x.rlike(ANSWER_LINE), "a").when(x.rlike(ALIAS_LINE), "s").otherwise("t")
    kinds = F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), x.alias("line")))

    def pair(part):
        said = F.filter(part, lambda x: x["kind"].isin("a", "t"))
        answer = F.transform(said, lambda x: F.when(x["kind"] == "a", strip(F.regexp_extract(x["line"], ANSWER_LINE, 2))).otherwise(x["line"]))
        aliases = F.get(F.reverse(F.filter(part, lambda x: x["kind"] == "s")), F.lit(0))["line"]
        question = strip(F.regexp_extract(F.get(part, F.lit(0))["line"], QUESTION_LINE, 2))
        return F.struct(question.alias("question"), strip(F.array_join(answer, "\n")).alias("answer"), split_multi(F.regexp_extract(aliases, ALIAS_LINE, 2)).alias("aliases"), F.array().cast("array<string>").alias("tags"), F.size(said).alias("parts"))

    def ruled(part):
        first = F.get(part, F.lit(0))
        made = F.when(_starts(first, HEADING_STARTS) | _ends(first, RULE_ENDS), first).otherwise("")
        clause = lambda x, path: F.struct(F.regexp_extract(x, CLAUSE_LINE, 1).alias("clause_no"), path.alias("title_path"), strip(F.regexp_extract(x, CLAUSE_LINE, 2)).alias("content"), x.alias("raw_line"))
        return _once(made, lambda path: F.transform(F.filter(part, lambda x: x.rlike(CLAUSE_LINE)), lambda x: clause(x, path)))

    sections = _between(lines, lambda x, i: (i == 0) | _starts(x, HEADING_STARTS) | _ends(x, RULE_ENDS))
    some = lambda made: F.when(F.size(made) > 0, made)
    made = docs.withColumns({"pairs": F.transform(_between(kinds, lambda x, i: x["kind"] == "q"), pair), "rules": F.flatten(F.transform(sections, ruled)), "titles": manual})
    spoken = F.transform(F.filter("pairs", lambda p: p["parts"] > 0), lambda p: p.dropFields("parts"))
    return made.select(
        "doc_id",
        "doc_type",
        "clean_content",
        F.get(lines, F.lit(0)).alias("title"),
        F.array_join(F.filter(lines, lambda x: _starts(x, SCENE_STARTS)), "\n").alias("scene"),
        F.filter(lines, lambda x: ~_starts(x, SCENE_STARTS) & x.rlike(STEP_LINE)).alias("steps"),
        F.filter(lines, note).alias("notes"),
        F.array_join(F.slice("titles", F.greatest(F.lit(1), F.size("titles") - 2), F.lit(3)), " > ").alias("title_path"),
        F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(BUTTON), 1)))).alias("button_names"),
        some(spoken).alias("qa_pairs"),
        some(F.col("rules")).alias("clauses"),
    )


def build_relations(chunks: DataFrame, same_section: bool = False) -> DataFrame:
    """(from_chunk_id, to_chunk_id, relation_type, sort_order): parent to child, each chunk to the next,
    and with ``same_section`` each chunk to the next of its section."""
    parents = chunks.where("parent_chunk_id is not null").select(F.col("parent_chunk_id").alias("from_chunk_id"), F.col("chunk_id").alias("to_chunk_id"), F.lit("PARENT_CHILD").alias("relation_type"), "sort_order")

    def following(kind, *keys):
        order = Window.partitionBy(*keys).orderBy("sort_order", "chunk_id")
        return chunks.select(F.col("chunk_id").alias("from_chunk_id"), F.lead("chunk_id").over(order).alias("to_chunk_id"), F.lit(kind).alias("relation_type"), "sort_order").where("to_chunk_id is not null")

    out = parents.unionByName(following("PREVIOUS_NEXT", "doc_id"))
    return out.unionByName(following("SAME_SECTION", "doc_id", "source_section")) if same_section else out
