"""Evaluation datasets: evidence mapping, checks, dedup, planning, freezing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fact_slug, folded, letters, squeeze, strip, text
from ..storage import durable, stored
from .order import choose_in_order, numbered_globally, similar_pairs

#: What a finished document of each type needs at least.
FAQ_SECTIONS, FAQ_ALIASES, SOP_STEPS = (8, 15), (2, 4), 4
#: Pairs of a quote and a chunk of a document that are compared each with each; more meet by runs of characters.
FEW = 4096


def _first(df: DataFrame, keys, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def issues(df: DataFrame, entity: Column, *checks: tuple[str, Column]) -> DataFrame:
    """(code, entity_code) for each check that holds for a row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in checks]))
    return df.select(F.explode(found).alias("code"), entity.cast("string").alias("entity_code"))


# -- evidence ------------------------------------------------------------------


def anchored(quotes: DataFrame, chunks: DataFrame, sizes: tuple[int, ...] = (8, 3), few: int = FEW) -> DataFrame:
    """(quote_id, doc_id, chunk_id) of quotes (quote_id, doc_id, body) and chunks (doc_id, chunk_id, body) of the same
    document where the chunk holds the quote's anchor, a run of ``sizes[0]`` characters of it. Shorter quotes have
    shorter anchors; those below the last size meet all chunks of their document.

    The anchor is the quote's run with the least hash. In a document of at most ``few`` pairs of a quote and a chunk
    each chunk is searched for each anchor. Chunks of other documents post their runs by document and run, so a
    document with very many chunks is dealt out, and a quote's text moves only to chunks that can hold it."""
    runs = lambda col, n: F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    anchor = lambda n: F.array_min(F.transform(runs("body", n), lambda r: F.struct(F.xxhash64(r).alias("h"), r.alias("r"))))["r"]
    size = F.lit(0)
    for n in sorted(sizes):
        size = F.when(F.char_length("body") >= n, n).otherwise(size)
    run = F.lit("")
    for n in sizes:
        run = F.when(F.col("size") == n, anchor(n)).otherwise(run)
    keyed = quotes.where("body is not null").withColumn("size", size).select("quote_id", "doc_id", "size", run.alias("run"))
    met = keyed.groupBy("doc_id").agg(F.count("*").alias("asks")).join(chunks.groupBy("doc_id").agg(F.count("*").alias("has")), "doc_id")
    large = durable(met.where(F.col("asks") * F.col("has") > few).select("doc_id"))
    if large.isEmpty():
        return _searched(keyed, chunks).distinct()
    out = _searched(keyed.join(large, "doc_id", "left_anti"), chunks.join(large, "doc_id", "left_anti"))
    rest, posting = keyed.join(large, "doc_id", "left_semi"), chunks.join(large, "doc_id", "left_semi")
    for n in sizes:
        own = rest.where(F.col("size") == n)
        wanted = own.select("doc_id", "run").distinct()
        posted = posting.select("doc_id", "chunk_id", F.explode(F.array_distinct(runs("body", n))).alias("run")).join(wanted, ["doc_id", "run"], "left_semi")
        out = out.unionByName(own.join(posted, ["doc_id", "run"]).select("quote_id", "doc_id", "chunk_id"))
    return out.unionByName(rest.where("size = 0").select("quote_id", "doc_id").join(posting.select("doc_id", "chunk_id"), "doc_id")).distinct()


def _searched(keyed: DataFrame, chunks: DataFrame) -> DataFrame:
    held = chunks.select("doc_id", "chunk_id", text(F.col("body")).alias("body"))
    return held.join(keyed, "doc_id").where(F.contains("body", F.col("run"))).select("quote_id", "doc_id", "chunk_id")


def map_evidence(evidence: DataFrame, source_docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``evidence`` with mapped_doc_id, mapped_chunk_id, mapping_status and method, tier by tier: quote in one
    chunk without white space, then without punctuation, then across two neighbours (AMBIGUOUS), else MISSING.

    A quote is compared with the chunks that hold its anchor, with the pairs of neighbours that such a chunk ends, and
    with pairs whose seam holds it."""
    keyed = durable(evidence.join(source_docs.select("source_doc_code", "mapped_doc_id"), "source_doc_code", "left").withColumn("_e", F.xxhash64("case_code", "source_doc_code", "evidence_quote")))
    order = Window.partitionBy("doc_id").orderBy("sort_order", "chunk_id")
    near = 40
    own = chunks.where("status = 'ACTIVE'").select("doc_id", "chunk_id", "parent_chunk_id", "content", "sort_order", letters(F.col("content")).alias("body"))
    placed = own.withColumns({"next_id": F.lead("chunk_id").over(order), "before_id": F.lag("chunk_id").over(order), "_start": F.lead(F.substring("body", 1, near)).over(order)})
    active = stored(placed.drop("sort_order")).read()
    c = active.select("chunk_id", "parent_chunk_id", "content", "body", "next_id")
    quotes = keyed.select("_e", "mapped_doc_id", "evidence_quote").where("mapped_doc_id is not null").dropDuplicates(["_e"])
    bodies = durable(quotes.select(F.col("_e").alias("quote_id"), F.col("mapped_doc_id").alias("doc_id"), letters(F.col("evidence_quote")).alias("body"), "evidence_quote"))
    inner = anchored(bodies, active.select("doc_id", "chunk_id", "body"))
    seams = active.where("next_id is not null").select("doc_id", "chunk_id", F.concat(F.right("body", F.lit(near)), F.coalesce("_start", F.lit(""))).alias("body"))
    across = anchored(bodies, seams)
    found = durable(inner)
    ends = found.join(active.where("before_id is not null").select("chunk_id", "before_id"), "chunk_id").select("quote_id", "doc_id", F.col("before_id").alias("chunk_id"))
    ids = found.unionByName(across).unionByName(ends).distinct()
    told = bodies.select(F.col("quote_id").alias("_e"), "quote_id", "evidence_quote", F.col("body").alias("asked"))
    following = active.select(F.col("chunk_id").alias("next_id"), F.col("content").alias("next_content"), F.col("body").alias("next_body"))
    pairs = ids.join(told, "quote_id").join(c, "chunk_id").join(following, "next_id", "left")
    # only a sigma's lower case depends on what is beside it; without one, letters of a part are a part of the letters
    sigma = F.col("evidence_quote").rlike("[Σσς]")
    squeezed = squeeze(F.col("evidence_quote"))
    exact = (sigma | F.contains("body", F.col("asked"))) & (squeezed != "") & F.contains(squeeze(F.col("content")), squeezed)
    both = F.when(sigma, letters(F.concat(text(F.col("content")), text(F.col("next_content"))))).otherwise(F.concat("body", text(F.col("next_body"))))
    lettered = F.col("asked") != ""
    tier = F.when(exact, 1).when(lettered & F.contains("body", F.col("asked")), 2).when(F.col("next_id").isNotNull() & lettered & F.contains(both, F.col("asked")), 3)
    tiered = durable(pairs.select("_e", "chunk_id", "parent_chunk_id", tier.alias("tier")).where("tier is not null"))
    best = tiered.withColumn("least", F.min("tier").over(Window.partitionBy("_e"))).where("tier = least")
    parents = best.where("parent_chunk_id is not null").select("_e", F.col("parent_chunk_id").alias("chunk_id")).distinct().withColumn("is_parent", F.lit(True))
    per = best.join(parents, ["_e", "chunk_id"], "left").groupBy("_e", "tier").agg(F.count("*").alias("n"), F.min("chunk_id").alias("any_id"), F.count("is_parent").alias("n_parents"), F.min(F.when(F.col("is_parent").isNull(), F.col("chunk_id"))).alias("leaf_id"))
    one = (F.col("tier") < 3) & (F.col("n") == 1)
    leaf = (F.col("tier") < 3) & (F.col("n_parents") > 0) & (F.col("n") - F.col("n_parents") == 1)
    name = F.when(F.col("tier") == 1, "EXACT").when(F.col("tier") == 2, "PUNCTUATION_NORMALIZED").otherwise("ADJACENT_CHUNKS")
    status = F.when(F.col("tier").isNull(), "MISSING").when(one | leaf, "MAPPED").otherwise("AMBIGUOUS")
    method = F.when(F.col("tier").isNull(), "NOT_FOUND").when(~one & leaf, F.concat(name, F.lit("_MOST_SPECIFIC"))).otherwise(name)
    return keyed.join(per, "_e", "left").withColumns({"mapping_status": status, "method": method, "mapped_chunk_id": F.when(one, F.col("any_id")).when(leaf, F.col("leaf_id"))}).drop("_e", "tier", "n", "any_id", "n_parents", "leaf_id")


def map_facts(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, fact_key, chunk_ids): all chunks that hold the fact; an empty list is a missing fact."""
    asked = facts.select("doc_id", "fact_key", "fact_text", letters(F.col("fact_text")).alias("body"))
    quotes = asked.where("body <> ''").select(F.struct("doc_id", "fact_key", "body").alias("quote_id"), "doc_id", "body").distinct()
    bodies = chunks.select("doc_id", "chunk_id", letters(F.col("content")).alias("body"))
    met = anchored(quotes, bodies).join(bodies.drop("doc_id"), "chunk_id").where(F.contains("body", F.col("quote_id.body")))
    hits = met.groupBy("quote_id.doc_id", "quote_id.fact_key").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    keys = asked.select("doc_id", "fact_key").distinct()
    ids = dict(chunks.dtypes)["chunk_id"]
    return keys.join(hits, ["doc_id", "fact_key"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast(f"array<{ids}>")))


def missing_identifiers(blueprints: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, identifier) of required identifiers that no chunk of the document holds."""
    asked = blueprints.select("doc_id", F.explode("required_identifiers").alias("identifier"))
    found = asked.join(chunks.select("doc_id", "content"), "doc_id").where(F.contains("content", F.col("identifier"))).select("doc_id", "identifier").distinct()
    return asked.join(found, ["doc_id", "identifier"], "left_anti")


def correct_exact(cases: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """New grade-3 evidence (case_code, chunk_id, doc_id, evidence_quote, fact_key, resolved) for EXACT cases whose
    identifier is in no grade-3 quote. The best chunk has it in the title, then most often, then comes first; the
    quote is the shortest sentence with it. Cases without a chunk come back unresolved.

    cases: (case_code, identifier, doc_id)."""
    held = evidence.where("relevance_grade = 3").join(cases.select("case_code", "identifier"), "case_code").where(F.contains("evidence_quote", F.col("identifier"))).select("case_code").distinct()
    open_cases = cases.join(held, "case_code", "left_anti")
    times = (F.char_length("content") - F.char_length(F.replace("content", F.col("identifier"), F.lit("")))) / F.char_length("identifier")
    found = open_cases.join(chunks.where("status = 'ACTIVE'").select("doc_id", "chunk_id", "title", "content", "sort_order"), "doc_id").where(F.contains("content", F.col("identifier")))
    best = _first(found.withColumn("times", times), ["case_code"], F.contains("title", F.col("identifier")).desc_nulls_last(), F.desc("times"), "sort_order", "chunk_id")
    sentences = F.filter(F.transform(F.split("content", r"(?<=[。！？；\n])"), strip), lambda s: F.contains(s, F.col("identifier")))
    quote = F.element_at(F.array_sort(F.transform(sentences, lambda s: F.struct(F.char_length(s).alias("n"), s.alias("s")))), 1)["s"]
    made = best.select("case_code", "chunk_id", quote.alias("evidence_quote"))
    return open_cases.join(made, "case_code", "left").select("case_code", "doc_id", "chunk_id", "evidence_quote", fact_slug(F.col("identifier")).alias("fact_key"), F.col("chunk_id").isNotNull().alias("resolved"))


def case_evidence(relevance: DataFrame, source_docs: DataFrame) -> DataFrame:
    return relevance.join(source_docs, "source_doc_code").withColumn("quote_sha256", F.sha2(F.regexp_replace("evidence_quote", r"(?U)\s+", ""), 256)).orderBy("case_code", F.desc("relevance_grade"), "id")


def case_context(catalog: DataFrame, facts: DataFrame) -> DataFrame:
    """The catalogue's documents with their facts in order."""
    listed = facts.groupBy("source_doc_code").agg(F.array_sort(F.collect_list(F.struct("fact_ord", "fact_key", "fact_text"))).alias("facts"))
    return catalog.join(listed, "source_doc_code", "left")


def related_documents(selected: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Codes of the selected documents and of those in conflict with, superseded by or versions of them."""
    mine = blueprints.join(selected, "source_doc_code", "left_semi")
    conflicts = mine.select(F.explode("conflicts_with").alias("source_doc_code"))
    older = mine.where("supersedes is not null").select(F.col("supersedes").alias("source_doc_code"))
    same = blueprints.join(mine.where("version_group is not null").select("version_group").distinct(), "version_group", "left_semi").select("source_doc_code")
    return mine.select("source_doc_code").unionByName(conflicts).unionByName(older).unionByName(same).distinct()


# -- dedup ---------------------------------------------------------------------


def dedup_files(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``files`` (path, content) with sha256 and duplicate: the first path of a content counts, unless it is known."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    out = hashed.withColumn("duplicate", F.row_number().over(Window.partitionBy("sha256").orderBy("path")) > 1)
    if known is None:
        return out
    seen = known.select("sha256").distinct().withColumn("_k", F.lit(True))
    return out.join(seen, "sha256", "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("_k", F.lit(False))).drop("_k")


def dedup_lexical(cases: DataFrame) -> DataFrame:
    return _first(cases.withColumn("_q", letters(F.col("question"))), ["_q"], "case_code").drop("_q")


def semantic_pairs(rows: DataFrame, keys: tuple[str, ...], least: float = 0.85) -> DataFrame:
    """(keys, later, earlier, similarity) of rows (keys, ord, vec) of a group that are alike."""
    return similar_pairs(rows, keys, least)


def dedup_semantic(rows: DataFrame, keys: tuple[str, ...] = ("dataset_split", "case_type"), duplicate: float = 0.92, review: float = 0.85) -> DataFrame:
    """``rows`` (keys, ord, vec) with mark, nearest and similarity: each row against the kept ones before it."""
    return choose_in_order(rows, keys, duplicate, review)


# -- upserts and freezing --------------------------------------------------------


def replace_doc(target: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``target`` with all rows of the new rows' documents replaced by them."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_relations(relations: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Relations that touch a gone chunk at either end go; the new ones come."""
    ids = gone.select("chunk_id").distinct()
    kept = relations.join(ids.withColumnRenamed("chunk_id", "from_chunk_id"), "from_chunk_id", "left_anti").join(ids.withColumnRenamed("chunk_id", "to_chunk_id"), "to_chunk_id", "left_anti")
    return kept.unionByName(new)


def upsert(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The batch's last row of each key in place of the target's."""
    last = _first(batch, [key], F.desc(order))
    return target.join(last.select(key), key, "left_anti").unionByName(last.select(*target.columns))


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with sorted keys and its nulls."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def export_frozen(cases: DataFrame, path: str) -> None:
    cases.select("case_code", canonical_json(cases).alias("value")).orderBy("case_code").select("value").write.mode("overwrite").text(path)


def frozen_digest(cases: DataFrame) -> DataFrame:
    """One row, sha256: lines are hashed, then the sorted hashes of each of up to 4,096 buckets, then the buckets.
    (Not the hash of the whole text, which would gather the set in one row.)"""
    lines = cases.select(F.sha2(canonical_json(cases), 256).alias("h")).withColumn("b", F.substring("h", 1, 3))
    buckets = lines.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("sha256"))


def freeze_version(cases: DataFrame, registry: DataFrame, name: str, version: str) -> DataFrame:
    """The registry with this version's digest; a frozen version with another digest is an error when read."""
    new = frozen_digest(cases).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "sha256")
    old = registry.select("name", "version", F.col("sha256").alias("_old"))
    checked = new.join(old, ["name", "version"], "left").withColumn("sha256", F.when(F.col("_old").isNull() | (F.col("_old") == F.col("sha256")), F.col("sha256")).otherwise(F.raise_error(F.lit("a frozen version has another digest")))).drop("_old")
    return registry.join(new, ["name", "version"], "left_anti").select("name", "version", "sha256").unionByName(checked.select("name", "version", "sha256"))


def register_documents(blueprints: DataFrame, documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source_doc_code, sha256, review_status, review_score, issue) of each blueprint's document."""
    j = blueprints.select("source_doc_code").join(documents, "source_doc_code", "left").join(reviews, "source_doc_code", "left")
    issue = F.when(F.col("content").isNull(), "NO_DOCUMENT").when(F.col("passed").isNull(), "NOT_REVIEWED")
    return j.select("source_doc_code", F.sha2("content", 256).alias("sha256"), F.when(F.col("passed"), "PASSED").when(~F.col("passed"), "REJECTED").otherwise("PENDING").alias("review_status"), F.col("overall_score").alias("review_score"), issue.alias("issue"))


# -- checks ----------------------------------------------------------------------


def check_records(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    n = evidence.groupBy("case_code").agg(F.count("*").alias("n_evidence"), F.countDistinct("fact_key").alias("n_facts"))
    bad_evidence = issues(
        evidence, F.col("case_code"), ("EVIDENCE_QUOTE_EMPTY", strip(F.col("evidence_quote")) == ""), ("GRADE_OUT_OF_RANGE", ~F.col("relevance_grade").between(0, 3)),
        ("MAPPED_WITHOUT_CHUNK", (F.col("mapping_status") == "MAPPED") & F.col("mapped_chunk_id").isNull()),
    )
    j = cases.join(n, "case_code", "left").fillna(0, ["n_evidence", "n_facts"])
    answer = F.col("expected_action") == "ANSWER"
    none = F.col("case_type") == "NO_ANSWER"
    bad_cases = issues(
        j, F.col("case_code"), ("CODE_EMPTY", strip(F.col("case_code")) == ""), ("QUESTION_EMPTY", strip(F.col("question")) == ""), ("UNKNOWN_ACTION", ~F.col("expected_action").isin("ANSWER", "REFUSE", "CLARIFY")),
        ("NO_ANSWER_WITH_EVIDENCE", none & (F.col("n_evidence") > 0)), ("NO_ANSWER_EXPECTS_ANSWER", none & answer), ("ANSWER_WITHOUT_EVIDENCE", answer & ~none & (F.col("n_evidence") == 0)), ("MULTI_HOP_NEEDS_TWO_FACTS", (F.col("case_type") == "MULTI_HOP") & (F.col("n_facts") < 2)),
    )
    return bad_cases.unionByName(bad_evidence)


def check_documents(parsed: DataFrame) -> DataFrame:
    """(doc_id, check_item, check_result) of each document (doc_id, doc_type, clean_content, n_parts); PASS when
    nothing is wrong. ``n_parts`` counts pairs, steps or clauses."""
    none = F.coalesce("n_parts", F.lit(0)) == 0
    row = lambda item, result: F.struct(F.lit(item).alias("item"), F.lit(result).alias("result"))
    found = F.array_compact(F.array(
        F.when(strip(F.col("clean_content")) == "", row("CONTENT_EMPTY", "FAIL")),
        F.when((F.col("doc_type") == "FAQ") & none, row("FAQ_NO_QA", "FAIL")), F.when((F.col("doc_type") == "SOP") & none, row("SOP_NO_STEPS", "WARN")),
        F.when((F.col("doc_type") == "RULE") & none, row("RULE_NO_CLAUSES", "WARN")), F.when((F.col("doc_type") == "MANUAL") & none, row("MANUAL_NO_STEPS", "WARN")),
    ))
    return parsed.select("doc_id", F.explode(F.when(F.size(found) == 0, F.array(row("BASIC_CHECK", "PASS"))).otherwise(found)).alias("c")).select("doc_id", F.col("c.item").alias("check_item"), F.col("c.result").alias("check_result"))


def document_status(checks: DataFrame) -> DataFrame:
    return checks.groupBy("doc_id").agg(F.when(F.max((F.col("check_result") == "FAIL").cast("int")) == 1, "NEED_REVIEW").otherwise("CLEANED").alias("status"))


def _repeats(df: DataFrame, key: Column, code: str, entity: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("_k").orderBy(entity))
    return issues(df.withColumn("_k", key).withColumn("_r", n), F.col(entity), (code, F.col("_r") > 1))


def validate_dataset(documents: DataFrame, cases: DataFrame, evidence: DataFrame, least_document: float = 0.88, least_case: float | None = 0.88, mapped: bool = True) -> DataFrame:
    """(code, entity_code) of everything that keeps a dataset from being frozen."""
    low = F.col("review_score").isNull() | (F.col("review_score") < least_document)
    out = [
        _repeats(documents, F.col("source_doc_code"), "DUPLICATE_DOCUMENT_CODE", "source_doc_code"),
        issues(documents, F.col("source_doc_code"), ("DOCUMENT_NOT_REVIEWED", ~F.col("review_status").eqNullSafe("PASSED")), ("DOCUMENT_REVIEW_SCORE_TOO_LOW", low), ("DOCUMENT_NOT_MAPPED", F.lit(mapped) & F.col("mapped_doc_id").isNull())),
        _repeats(cases, F.col("case_code"), "DUPLICATE_CASE_CODE", "case_code"),
        _repeats(cases, folded(F.coalesce("normalized_question", "question")), "DUPLICATE_QUESTION", "case_code"),
        issues(
            cases, F.col("case_code"), ("CASE_NOT_REVIEWED", ~F.col("review_status").eqNullSafe("PASSED")), ("CASE_REVIEW_SCORE_TOO_LOW", F.lit(least_case is not None) & (F.col("review_score").isNull() | (F.col("review_score") < (least_case or 0)))),
            ("CASE_NOT_ACTIVE", ~F.col("status").eqNullSafe("ACTIVE")), ("CASE_SPLIT_UNASSIGNED", F.col("dataset_split") == "UNASSIGNED"),
        ),
    ]
    docs = documents.groupBy("source_doc_code").agg(F.max("mapped_doc_id").alias("doc_mapped_id")).withColumn("known", F.lit(True))
    j = evidence.join(docs, "source_doc_code", "left")
    unmapped = ~F.col("mapping_status").eqNullSafe("MAPPED") | F.col("mapped_doc_id").isNull() | F.col("mapped_chunk_id").isNull()
    known = F.col("known").isNotNull()
    out.append(issues(j, F.col("case_code"), ("EVIDENCE_SOURCE_NOT_FOUND", ~known), ("EVIDENCE_NOT_MAPPED", known & F.lit(mapped) & unmapped), ("EVIDENCE_DOCUMENT_MAPPING_MISMATCH", known & F.lit(mapped) & ~unmapped & ~F.col("mapped_doc_id").eqNullSafe(F.col("doc_mapped_id")))))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def check_counts(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """(value, actual, expected) of the values whose counts are not as expected (value, n)."""
    actual = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("actual"))
    return actual.join(expected.select("value", F.col("n").alias("expected")), "value", "full").fillna(0, ["actual", "expected"]).where("actual <> expected")


def check_leakage(cases: DataFrame) -> DataFrame:
    """(source_group, splits) of groups that are in more than one split."""
    return cases.where("source_group is not null").groupBy("source_group").agg(F.array_sort(F.collect_set("dataset_split")).alias("splits")).where("size(splits) > 1")


def check_mapped(evidence: DataFrame) -> DataFrame:
    return evidence.where("relevance_grade = 3 and (mapping_status <> 'MAPPED' or mapping_status is null or mapped_chunk_id is null)").select("case_code").distinct()


def check_blueprints(bp: DataFrame, expected: int = 40, version_groups: int = 4) -> DataFrame:
    refs = bp.select("source_doc_code", F.explode(F.concat(F.coalesce("conflicts_with", F.array().cast("array<string>")), F.when(F.col("supersedes").isNotNull(), F.array("supersedes")).otherwise(F.array().cast("array<string>")))).alias("ref"))
    dangling = refs.join(bp.select(F.col("source_doc_code").alias("ref")), "ref", "left_anti").select(F.lit("DANGLING_REFERENCE").alias("code"), F.col("source_doc_code").alias("entity_code"))
    repeated = _repeats(bp, F.col("source_doc_code"), "DUPLICATE_DOCUMENT_CODE", "source_doc_code")
    total = issues(bp.agg(F.count("*").alias("n"), F.countDistinct("version_group").alias("g")), F.lit(None), ("WRONG_COUNT", F.col("n") != expected), ("TOO_FEW_VERSION_GROUPS", F.col("g") < version_groups))
    return dangling.unionByName(repeated).unionByName(total)


def check_documents_vs_blueprint(blueprints: DataFrame, documents: DataFrame) -> DataFrame:
    """documents: (source_doc_code, doc_type, title, version, content, n_sections, n_steps, aliases array<int>)."""
    d = documents.select("source_doc_code", *[F.col(c).alias(f"d_{c}") for c in ("doc_type", "title", "version", "content", "n_sections", "n_steps", "aliases")])
    j = blueprints.join(d, "source_doc_code", "left")
    lacks = lambda col, value=lambda x: x: F.exists(col, lambda x: ~F.contains(text(F.col("d_content")), value(x)))
    return issues(
        j, F.col("source_doc_code"), ("DOCUMENT_MISSING", F.col("d_content").isNull()), ("FIELD_MISMATCH", (F.col("doc_type") != F.col("d_doc_type")) | (F.col("title") != F.col("d_title")) | (F.col("version") != F.col("d_version"))),
        ("IDENTIFIER_MISSING", lacks("required_identifiers")), ("SECTION_MISSING", lacks("required_sections")), ("FACT_MISSING", lacks("required_facts", lambda x: x["description"])),
        ("FAQ_SECTIONS", (F.col("doc_type") == "FAQ") & ~F.col("d_n_sections").between(*FAQ_SECTIONS)), ("FAQ_ALIASES", (F.col("doc_type") == "FAQ") & F.exists("d_aliases", lambda n: ~n.between(*FAQ_ALIASES))), ("SOP_STEPS", (F.col("doc_type") == "SOP") & (F.col("d_n_steps") < SOP_STEPS)),
    )


def check_cases_vs_seeds(cases: DataFrame, seeds: DataFrame) -> DataFrame:
    """cases: (seed_code, question, reference_answer, fact_keys, quotes, n_docs); seeds: (seed_code, case_type,
    required_identifier, title, fact_keys, quotes)."""
    s = seeds.select("seed_code", "case_type", "required_identifier", "title", F.col("fact_keys").alias("s_facts"), F.col("quotes").alias("s_quotes"))
    j = cases.join(s, "seed_code", "left")
    size = F.char_length(strip(F.col("question")))
    q, a = letters(F.col("question")), letters(F.col("reference_answer"))
    return issues(
        j, F.col("seed_code"), ("SEED_UNKNOWN", F.col("case_type").isNull()), ("QUESTION_LENGTH", ~size.between(6, 160)), ("TITLE_LEAK", (letters(F.col("title")) != "") & F.contains(q, letters(F.col("title")))),
        ("IDENTIFIER_MISSING", F.col("required_identifier").isNotNull() & ~F.contains(F.col("question"), F.col("required_identifier"))), ("FACTS_DIFFER", F.array_sort("fact_keys") != F.array_sort("s_facts")), ("QUOTE_NOT_CANONICAL", F.size(F.array_except("quotes", "s_quotes")) > 0),
        ("HOP_COUNT", (F.col("case_type") == "MULTI_HOP") & (F.col("n_docs") < 2)), ("ANSWER_LEAK", (F.char_length(a) >= 6) & F.contains(q, a)),
    )


def check_contracts(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """cases: (case_code, contract struct<clarification_question, branches array<struct<condition_value, chunk_ids>>>)."""
    base = issues(cases, F.col("case_code"), ("CONTRACT_MISSING", F.col("contract").isNull()), ("BRANCH_VALUES_REPEAT", F.size(F.array_distinct("contract.branches.condition_value")) < F.size("contract.branches")))
    ids = cases.select("case_code", F.explode(F.flatten("contract.branches.chunk_ids")).alias("chunk_id")).distinct()
    dead = ids.join(chunks.where("status = 'ACTIVE'").select("chunk_id"), "chunk_id", "left_anti").select(F.lit("CHUNK_NOT_ACTIVE").alias("code"), F.col("case_code").cast("string").alias("entity_code")).distinct()
    return base.unionByName(dead)


def check_plan(quota: DataFrame, totals: DataFrame, topics: DataFrame) -> DataFrame:
    """quota (split, case_type, subtype, n), totals (split, n), topics (split, topic)."""
    sums = quota.groupBy("split").agg(F.sum("n").alias("sum")).join(totals.select("split", F.col("n").alias("want")), "split", "full")
    wrong = issues(sums, F.col("split"), ("SPLIT_TOTAL_MISMATCH", ~F.col("sum").eqNullSafe(F.col("want"))))
    shared = topics.groupBy("topic").agg(F.countDistinct("split").alias("n"))
    return wrong.unionByName(issues(shared, F.col("topic"), ("TOPIC_IN_SEVERAL_SPLITS", F.col("n") > 1))).unionByName(issues(quota, F.concat_ws("/", "split", "case_type"), ("NEGATIVE_QUOTA", F.col("n") < 0)))


# -- selection and planning --------------------------------------------------------


def select_quota(cases: DataFrame, quota: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected cases renumbered CASE_<TYPE>_nnn, strata that fall short). cases: (case_code, dataset_split,
    case_type, subtype, review_score, review_status, status); quota: (ord, split, case_type, subtype, n)."""
    good = cases.where("review_status = 'PASSED' and status = 'ACTIVE'")
    q = quota.select(F.col("ord").alias("_ord"), F.col("split").alias("dataset_split"), F.col("case_type").alias("_type"), F.col("subtype").alias("_sub"), "n")
    joined = good.join(q, (good["dataset_split"] == q["dataset_split"]) & (good["case_type"] == q["_type"]) & (q["_sub"].isNull() | good["subtype"].eqNullSafe(q["_sub"]))).drop(q["dataset_split"])
    best = Window.partitionBy("_ord").orderBy(F.coalesce("review_score", F.lit(0.0)).desc(), "case_code")
    ranked = joined.withColumn("_r", F.row_number().over(best))
    taken = ranked.where(F.col("_r") <= F.col("n"))
    have = ranked.groupBy("_ord").agg(F.count("*").alias("have"))
    short = q.join(have, "_ord", "left").fillna(0, ["have"]).where("have < n").select("dataset_split", F.col("_type").alias("case_type"), F.col("_sub").alias("subtype"), "have", "n")
    number = F.row_number().over(Window.partitionBy("case_type").orderBy("_ord", "_r"))
    return taken.withColumn("new_code", F.concat(F.lit("CASE_"), "case_type", F.lit("_"), F.lpad(number.cast("string"), 3, "0"))).drop("_ord", "_type", "_sub", "_r", "n"), short


def select_cases(cases: DataFrame, split: str, codes=(), actions=(), types=(), limit: int | None = None) -> DataFrame:
    out = cases.where((F.col("dataset_split") == split) & (F.col("review_status") == "PASSED") & (F.col("status") == "ACTIVE"))
    for column, wanted in (("case_code", codes), ("expected_action", actions), ("case_type", types)):
        out = out.where(F.col(column).isin(*wanted)) if wanted else out
    return out.orderBy("id").limit(limit) if limit else out


def retain_reviews(reviews: DataFrame, recheck: bool, case_type: str | None = None) -> DataFrame:
    gone = (F.col("review_status") == "REJECTED") & (F.lit(case_type is None) | (F.col("case_type") == (case_type or "")))
    return reviews.where(~F.coalesce(gone, F.lit(False))) if recheck else reviews


def missing(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return requests.join(done.select(key).distinct(), key, "left_anti")


def select_blueprints(blueprints: DataFrame, codes: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """The blueprints of the codes; an unknown code is an error when the rows are read."""
    out = blueprints
    if codes is not None:
        asked = codes.select("source_doc_code").distinct().join(blueprints.withColumn("_known", F.lit(True)), "source_doc_code", "left")
        out = asked.withColumn("source_doc_code", F.when(F.col("_known"), F.col("source_doc_code")).otherwise(F.raise_error(F.concat(F.lit("unknown code "), "source_doc_code")))).select(*blueprints.columns)
    return out.orderBy("source_doc_code").limit(n) if n else out


def _numbered_docs(docs: DataFrame) -> DataFrame:
    """docs (split, source_doc_code, topic, doc_type, facts, required_identifiers) numbered within their split."""
    return docs.withColumn("d", F.row_number().over(Window.partitionBy("split").orderBy("source_doc_code")) - 1).withColumn("n_docs", F.count("*").over(Window.partitionBy("split")))


def plan_seeds(quota: DataFrame, docs: DataFrame) -> DataFrame:
    """(split, case_type, i, source_doc_codes, fact_keys, required_identifier): the i-th seed of a stratum takes
    document i and fact i, round and round; MULTI_HOP takes documents 2i and 2i+1, MULTI_CONDITION facts i and i+1."""
    n = quota.where("case_type not in ('CONFLICT', 'NO_ANSWER') and n > 0").select("split", "case_type", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    d = _numbered_docs(docs)
    size = d.select("split", "n_docs").distinct()
    hop = F.col("case_type") == "MULTI_HOP"
    first = F.when(hop, F.col("i") * 2).otherwise(F.col("i")) % F.col("n_docs")
    second = F.when((F.col("i") * 2 + 1) % F.col("n_docs") == first, F.col("i") * 2 + 2).otherwise(F.col("i") * 2 + 1) % F.col("n_docs")
    placed = n.join(size, "split").select("*", first.alias("d1"), F.when(hop, second).alias("d2"))
    pick = lambda a, k: F.get(a, (k % F.size(a)).cast("int"))
    one = d.select("split", F.col("d").alias("d1"), F.struct("source_doc_code", "facts", "required_identifiers").alias("x"))
    two = d.select("split", F.col("d").alias("d2"), F.struct("source_doc_code", "facts").alias("y"))
    j = placed.join(one, ["split", "d1"]).join(two, ["split", "d2"], "left")
    facts = F.when(hop, F.array(pick(F.col("x.facts"), F.col("i")), pick(F.col("y.facts"), F.col("i") + 1))).when(F.col("case_type") == "MULTI_CONDITION", F.array(pick(F.col("x.facts"), F.col("i")), pick(F.col("x.facts"), F.col("i") + 1))).otherwise(F.array(pick(F.col("x.facts"), F.col("i"))))
    codes = F.when(hop, F.array("x.source_doc_code", "y.source_doc_code")).otherwise(F.array("x.source_doc_code"))
    return j.select("split", "case_type", "i", codes.alias("source_doc_codes"), facts.alias("fact_keys"), F.when(F.col("case_type") == "EXACT", pick(F.col("x.required_identifiers"), F.col("i"))).alias("required_identifier"))


def plan_conflicts(quota: DataFrame, docs: DataFrame) -> DataFrame:
    """(split, i, version_group, source_doc_codes): the two lowest versions of each group, round and round."""
    low = docs.where("version_group is not null").withColumn("r", F.row_number().over(Window.partitionBy("split", "version_group").orderBy("version", "source_doc_code"))).where("r <= 2")
    pairs = low.groupBy("split", "version_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source_doc_code"))), lambda x: x["source_doc_code"]).alias("source_doc_codes")).where("size(source_doc_codes) = 2")
    pairs = pairs.withColumn("g", F.row_number().over(Window.partitionBy("split").orderBy("version_group")) - 1).withColumn("n_groups", F.count("*").over(Window.partitionBy("split")))
    want = quota.where("case_type = 'CONFLICT' and n > 0").select("split", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    return want.join(pairs, "split").where("i % n_groups = g").select("split", "i", "version_group", "source_doc_codes")


def plan_no_answer(quota: DataFrame) -> DataFrame:
    """(split, subtype, i, expected_action)."""
    want = quota.where("case_type = 'NO_ANSWER' and n > 0")
    return want.select("split", "subtype", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"), F.when(F.col("subtype") == "MISSING_CONDITION", "CLARIFY").otherwise("REFUSE").alias("expected_action"))


def plan_pool(quota: DataFrame, multiplier: float = 1.25) -> DataFrame:
    return quota.withColumn("n", F.ceil(F.round(F.col("n") * multiplier, 9)).cast("long"))


def plan_supplement(docs: DataFrame, split: str, case_type: str, pool: int, count: int, round_no: int) -> DataFrame:
    """(i, source_doc_code, fact_key): facts the pool did not use first, then all facts, offset by the round.

    Documents and units are numbered by ranges, not in one task."""
    d = numbered_globally(docs.where(F.col("split") == split), "source_doc_code", name="d")
    spark, n = d.sparkSession, d.count()
    used = spark.range(pool).select(F.col("id").alias("i"), (F.col("id") % max(n, 1)).alias("d")).join(d.select("d", "source_doc_code", "facts"), "d").select("source_doc_code", F.get("facts", (F.col("i") % F.size("facts")).cast("int")).alias("fact_key")).distinct().withColumn("used", F.lit(True))
    units = d.select("d", "source_doc_code", F.posexplode("facts").alias("f", "fact_key")).join(used, ["source_doc_code", "fact_key"], "left")
    both = units.where("used is null").withColumn("part", F.lit(0)).unionByName(units.withColumn("part", F.lit(1)))
    placed = numbered_globally(both.select("part", "d", "f", "source_doc_code", "fact_key"), "part", "d", "f", name="u")
    total = placed.count()
    want = spark.range(count).select(F.col("id").alias("i"), ((F.lit((round_no - 1) * count) + F.col("id")) % max(total, 1)).alias("u"))
    return want.join(placed, "u").select("i", "source_doc_code", "fact_key")


def build_cases(seeds: DataFrame, texts: DataFrame) -> DataFrame:
    """Seeds with their questions and answers, the facts as an evidence array."""
    j = seeds.join(texts, "seed_code")
    return j.select(F.col("seed_code").alias("case_code"), "question", "reference_answer", "case_type", F.transform("facts", lambda f: F.struct(f["source_doc_code"].alias("source_doc_code"), f["fact_text"].alias("evidence_quote"), f["fact_key"].alias("fact_key"), F.lit(3).alias("relevance_grade"), F.lit("PENDING").alias("mapping_status"))).alias("evidences"))
