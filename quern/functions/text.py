"""Scalar text functions over columns: cleaning, normalising, extracting, composing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines and line forms that carry no content.
NOISE_LINES = ("公司内部资料", "内部资料", "Confidential")
PAGE_LINE = r"^第\s*\d+\s*页\s*/\s*共\s*\d+\s*页$"
NUMBERED_LINE = r"^(\d+[\.、]|第[一二三四五六七八九十]+步|第[一二三四五六七八九十]+条)"
LINE_ENDS = ("。", "；", "：", ":", "！", "？")
#: Exact terms, in the order in which they are looked for.
EXACT_TERMS = (
    r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]\d{3,}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+(?![A-Za-z0-9])",
    r"【[^】]+】",
    r"/api/[a-zA-Z0-9_/\-]+",
)
VERSION = r"(?<![A-Za-z0-9])[Vv]\s*(\d+(?:\.\d+)?)(?![A-Za-z0-9])"
COMPARISON_TERMS = ("新旧", "新版", "旧版", "版本", "不同", "区别", "变更", "冲突", "优先", "生效")
#: Amounts with units, and the Chinese digits.
CONSTRAINT = r"(\d+(?:\.\d+)?|[零〇一二两三四五六七八九十百]+)\s*(分钟|小时|个?工作日|天|日|元|%)"
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def contains_any(col: Column, terms) -> Column:
    """Whether the text has any of the terms; false for null."""
    found = F.lit(False)
    for term in terms:
        found = found | F.coalesce(F.contains(col, F.lit(term)), F.lit(False))
    return found


def strip(col: Column) -> Column:
    """Without white space at either end, line ends and tabs included."""
    return F.regexp_replace(text(col), r"(?U)^\s+|\s+$", "")


def normalize_newlines(col: Column) -> Column:
    """Line feeds only, and no more than two in a row."""
    return F.regexp_replace(F.regexp_replace(text(col), r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def lines(col: Column) -> Column:
    return F.split(col, "\n", -1)


def drop_noise_lines(col: Column, noise=NOISE_LINES, pattern: str = PAGE_LINE) -> Column:
    """Each line stripped; confidentiality and page lines dropped; blank lines kept."""
    stripped = F.transform(lines(text(col)), strip)
    return F.array_join(F.filter(stripped, lambda x: ~x.isin(*noise) & ~x.rlike(pattern)), "\n")


def repair_lines(col: Column) -> Column:
    """Lines that were broken in the middle joined again, in one fold over the lines."""

    def step(acc, line):
        last = F.element_at(acc, -1)
        merge = (last != "") & (line != "") & ~line.rlike(NUMBERED_LINE) & ~last.rlike(NUMBERED_LINE)
        for end in LINE_ENDS:
            merge = merge & ~F.endswith(last, F.lit(end))
        return F.when(F.size(acc) == 0, F.array(line)).when(merge, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, line)))).otherwise(F.array_append(acc, line))

    return F.array_join(F.aggregate(lines(text(col)), F.array().cast("array<string>"), step), "\n")


def clean(col: Column, doc_type: Column) -> Column:
    """All cleaning steps; null and empty give an empty text."""
    base = drop_noise_lines(normalize_newlines(col))
    return strip(F.when(doc_type.isin("SOP", "MANUAL"), repair_lines(base)).otherwise(base))


def split_multi(col: Column) -> Column:
    """Values parted by ， ； ; | or a comma, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(col), r"[，；;|,]"), strip), lambda x: x != "")


def estimate_tokens(col: Column) -> Column:
    """CJK characters, and a quarter of the others but one at least; 0 for an empty text."""
    cjk = F.char_length(F.regexp_replace(text(col), r"[^一-鿿]", ""))
    rest = F.char_length(text(col)) - cjk
    return F.when(text(col) == "", 0).otherwise(cjk + F.greatest(F.lit(1), F.floor(rest / 4))).cast("long")


def exact_terms(col: Column) -> Column:
    """Codes, error numbers, identifiers, button names and paths, first seen first."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text(col), F.lit(p), 0) for p in EXACT_TERMS]))


def versions(col: Column) -> Column:
    """Version numbers like V2 or v1.5 in a text."""
    return F.regexp_extract_all(text(col), F.lit(VERSION), 1)


def normalize_version(col: Column) -> Column:
    """1.0 becomes 1; what is no number stays, in lower case."""
    number = F.regexp_replace(strip(col).cast("double").cast("string"), r"\.0$", "")
    return F.when(strip(col).rlike(r"^\d+(\.\d+)?$"), number).otherwise(F.lower(strip(col)))


def explicit_versions(content: Column, version: Column) -> Column:
    """The versions of a hit: those in its first line, else its own if it starts with v."""
    first = versions(F.substring_index(text(content), "\n", 1))
    own = F.when(F.lower(F.substring(strip(version), 1, 1)) == "v", F.array(normalize_version(F.substr(strip(version), F.lit(2))))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.when(F.size(first) > 0, F.transform(first, normalize_version)).otherwise(own), lambda x: x != "")


def comparison_intent(col: Column) -> Column:
    return contains_any(col, COMPARISON_TERMS) | (F.size(versions(col)) >= 2)


def chinese_number(col: Column) -> Column:
    """The number that Chinese numerals below 200 hundreds stand for."""
    digit = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    plain = lambda c: F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc * 10 + F.coalesce(F.try_element_at(digit, x), F.lit(0)))
    ones = lambda c: F.coalesce(F.try_element_at(digit, c), F.lit(0))
    lead = lambda c: F.coalesce(F.try_element_at(digit, c), F.lit(1))
    tens = lambda c: F.when(F.contains(c, F.lit("十")), lead(F.substring_index(c, "十", 1)) * 10 + ones(F.substr(c, F.locate("十", c) + 1))).otherwise(plain(c))
    rest = F.substr(col, F.locate("百", col) + 1)
    return F.when(F.contains(col, F.lit("百")), lead(F.substring_index(col, "百", 1)) * 100 + F.when(rest != "", tens(rest)).otherwise(0)).otherwise(tens(col))


def constraints(col: Column) -> Column:
    """Amounts with a unit, numerals as digits, 个 dropped."""
    found = F.arrays_zip(F.regexp_extract_all(text(col), F.lit(CONSTRAINT), 1).alias("number"), F.regexp_extract_all(text(col), F.lit(CONSTRAINT), 2).alias("unit"))
    return F.transform(found, lambda m: F.concat(F.when(m["number"].rlike(r"^\d"), m["number"]).otherwise(chinese_number(m["number"]).cast("string")), F.regexp_replace(m["unit"], "^个", "")))


def citation_ids(col: Column) -> Column:
    """The ids of citations like [C1], sorted, once each."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(col), F.lit(r"\[(C\d+)\]"), 1)))


def squeeze(col: Column) -> Column:
    """Without any white space, in lower case."""
    return F.lower(F.regexp_replace(text(col), r"(?U)\s+", ""))


def letters(col: Column) -> Column:
    """Letters and digits only, in lower case. (Full case folding differs for a few letters such as ß.)"""
    return F.lower(F.regexp_replace(text(col), r"[^\p{L}\p{N}]+", ""))


def folded(col: Column) -> Column:
    return F.lower(strip(col))


def ordered_distinct(col: Column, n: int | None = None) -> Column:
    """First-seen distinct values without blank ones, the first n of them."""
    out = F.array_distinct(F.filter(col, lambda x: x.isNotNull() & (x != "")))
    return F.slice(out, 1, n) if n else out


def alias_match(value: Column, aliases: Column) -> Column:
    """Whether an alias is in the value, or the value, of two letters at least, in an alias."""
    v = letters(value)
    return F.exists(aliases, lambda a: (letters(a) != "") & (F.contains(v, letters(a)) | ((F.char_length(v) >= 2) & F.contains(letters(a), v))))


def stable_side(code: Column) -> Column:
    """0 or 1 by the parity of the first byte of the code's SHA-256."""
    return (F.conv(F.substring(F.sha2(code, 256), 1, 2), 16, 10).cast("int") % 2).cast("int")


def fill_template(template: Column, fact: Column) -> Column:
    """The fact in place of {{intermediate_fact}} or {intermediate_fact}, or before a text that has no such place."""
    filled = F.replace(F.replace(template, F.lit("{{intermediate_fact}}"), fact), F.lit("{intermediate_fact}"), fact)
    named = F.contains(template, F.lit("{intermediate_fact}"))
    return strip(F.regexp_replace(F.when(named, filled).otherwise(F.concat(fact, F.lit(" "), template)), r"(?U)\s+", " "))


def fact_slug(identifier: Column) -> Column:
    """A fact key made of an identifier, 100 characters at most."""
    return F.substring(F.concat(F.lit("exact_"), F.trim(F.lower(F.regexp_replace(text(identifier), r"[^\p{L}\p{N}]+", "_")), F.lit("_"))), 1, 100)


def markdown_cell(col: Column, limit: int = 80) -> Column:
    """One table cell: no bars or line ends, cut with an ellipsis."""
    flat = F.replace(F.replace(text(col.cast("string")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def percent(col: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(col * 100, 2), F.lit("%")), F.lit("-"))


def labelled(*pairs: tuple[str, Column]) -> Column:
    """Lines of label and value; empty values have none."""
    return F.concat_ws("\n", *[F.when(text(c) != "", F.concat(F.lit(label), c)) for label, c in pairs])


def embedding_text(c) -> Column:
    """The text of a chunk that is embedded; ``c`` gives its columns by name."""
    path = F.when(text(c["title_path"]) != "", F.concat(F.lit("标题路径："), c["title_path"])).when(text(c["title"]) != "", F.concat(F.lit("标题："), c["title"]))
    head = labelled(("业务域：", c["business_domain"]))
    tail = labelled(("来源章节：", c["source_section"]), ("标签：", c["tags"]), ("关键词：", c["keywords"]))
    return strip(F.concat_ws("\n", F.concat(F.lit("文档类型："), text(c["chunk_type"])), F.nullif(head, F.lit("")), path, F.nullif(tail, F.lit("")), F.lit("正文："), text(c["content"])))


def rerank_text(c) -> Column:
    head = labelled(("文档类型：", c["chunk_type"]), ("标题路径：", c["title_path"]), ("来源章节：", c["source_section"]))
    return strip(F.concat_ws("\n", F.nullif(head, F.lit("")), F.lit("正文："), text(c["content"])))


def index_text(c) -> Column:
    return F.concat_ws("\n", *[text(c[n]) for n in ("chunk_type", "title", "title_path", "content", "keywords", "tags", "source_section")])


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero; an error where sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))


def safe_ratio(part: Column, whole: Column, otherwise=None) -> Column:
    """part / whole, rounded to six places; ``otherwise`` where the whole is 0 or either is null."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6), F.lit(otherwise).cast("double"))


def decode_json(col: Column, kind: str, default: Column) -> Column:
    """A JSON text as ``kind``; the default where it is null, empty or no such JSON."""
    return F.coalesce(F.from_json(F.nullif(strip(col), F.lit("")), kind, {"mode": "PERMISSIVE"}), default)


def dates_in_order(start: Column, end: Column) -> Column:
    """Whether a span of effective dates is one: it does not end before it starts. An open side is in order."""
    return F.coalesce(end >= start, F.lit(True))
