"""Numbering, greedy choice and containment mapping against plain restatements."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import dataset, experiment, order


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 50) for _ in range(500)] + [None] * 5
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    numbered = order.numbered_globally(frame, "v", "i")
    got = [(r.v, r.i) for r in numbered.orderBy("n").collect()]
    assert got == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(r.n for r in numbered.collect()) == list(range(505))
    assert order.numbered_globally(frame.where("false"), "v").collect() == []


def plain_choice(rows, duplicate, review):
    kept, out = {}, {}
    for key, ident, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if key is None or v is None:
            out[key, ident] = ("KEEP", None)
            continue
        unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
        best = max(((float(unit(v) @ unit(w)), -i) for i, w in kept.setdefault(key, [])), default=(-2.0, 0))
        mark = "DUPLICATE" if best[0] >= duplicate else "REVIEW" if best[0] >= review else "KEEP"
        out[key, ident] = (mark, None if mark == "KEEP" else -best[1])
        if mark != "DUPLICATE":
            kept[key].append((ident, v))
    return out


@pytest.mark.parametrize("cell", [1024, 9])
def test_choice_in_order_equals_a_plain_walk(spark, monkeypatch, cell):
    rng = np.random.default_rng(2)
    angles = rng.uniform(0, 6.28, 60)
    rows = [("a" if i % 3 else "b", i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angles)] + [("a", 100, [0.0, 0.0]), ("a", 101, None), (None, 102, [1.0, 0.0])]
    made = order.similar_pairs
    monkeypatch.setattr(order, "similar_pairs", lambda r, k, least: made(r, k, least, cell))
    got = {(r.k, r.ord): (r.mark, r.nearest) for r in order.choose_in_order(spark.createDataFrame(rows, "k string, ord long, vec array<double>"), ("k",), 0.995, 0.97).collect()}
    assert got == plain_choice(rows, 0.995, 0.97)


def test_a_long_chain_of_choices(spark):
    pairs = spark.createDataFrame([("k", i + 1, i) for i in range(9)], "k string, later long, earlier long")
    assert {r.ord for r in order.first_kept(pairs, ("k",)).collect()} == {1, 3, 5, 7, 9}


def test_anchors_lose_no_containment(spark):
    rng = random.Random(3)
    body = lambda n: "".join(rng.choices("abc", k=n))
    chunks = [(rng.randint(0, 3), i, body(rng.randint(0, 60))) for i in range(40)]
    quotes = []
    for i in range(120):
        d, _, text = rng.choice(chunks)
        start = rng.randint(0, max(0, len(text) - 1))
        quotes.append((i, d, text[start : start + rng.choice([1, 2, 4, 9, 30])] if i % 5 else body(6)))
    met = dataset.anchored(spark.createDataFrame(quotes, "quote_id long, doc_id long, body string"), spark.createDataFrame(chunks, "doc_id long, chunk_id long, body string"))
    got = {(r.quote_id, r.chunk_id) for r in met.collect()}
    want = {(q, c) for q, d, b in quotes for e, c, t in chunks if d == e and b in t}
    assert want <= got
    assert all(any(b[i : i + 3] in t for i in range(len(b) - 2)) for q, d, b in quotes for e, c, t in chunks if len(b) > 2 and (q, c) in got and d == e)


def test_tiers_of_evidence(spark):
    chunks = [(1, 11, None, 0, "退款规则：七天内 可以退款，超过则不行。"), (1, 12, 11, 1, "七天内 可以退款"), (1, 13, None, 2, "运费由买家"), (1, 14, None, 3, "承担，签收后结算。")]
    frame = spark.createDataFrame(chunks, "doc_id long, chunk_id long, parent_chunk_id long, sort_order int, content string").withColumn("status", F.lit("ACTIVE"))
    quotes = {"exact": "七天内可以退款", "punct": "超过，则不行", "across": "买家承担签收", "short": "费", "none": "没有这句话吧", "mark": "，"}
    evidence = spark.createDataFrame([(k, "d", v) for k, v in quotes.items()] + [("nodoc", "x", "七天")], "case_code string, source_doc_code string, evidence_quote string")
    got = {r.case_code: (r.mapping_status, r.method, r.mapped_chunk_id) for r in dataset.map_evidence(evidence, spark.createDataFrame([("d", 1)], "source_doc_code string, mapped_doc_id long"), frame).collect()}
    assert got == {
        "exact": ("MAPPED", "EXACT_MOST_SPECIFIC", 12),
        "punct": ("MAPPED", "PUNCTUATION_NORMALIZED", 11),
        "across": ("AMBIGUOUS", "ADJACENT_CHUNKS", None),
        "short": ("MAPPED", "EXACT", 13),
        "none": ("MISSING", "NOT_FOUND", None),
        "mark": ("AMBIGUOUS", "EXACT", None),
        "nodoc": ("MISSING", "NOT_FOUND", None),
    }


@pytest.mark.parametrize("few", [0, 8, 4096])
def test_documents_of_few_and_many_pairs_give_the_same_anchors(spark, few):
    rng = random.Random(5)
    body = lambda n: "".join(rng.choices("abc", k=n))
    chunks = [(rng.randint(0, 3), i, body(rng.randint(0, 40))) for i in range(20)] + [(0, 20, None)]
    quotes = [(i, rng.randint(0, 3), body(rng.choice([0, 1, 2, 3, 5, 8, 9]))) for i in range(60)] + [(60, 1, None)]
    frames = spark.createDataFrame(quotes, "quote_id long, doc_id long, body string"), spark.createDataFrame(chunks, "doc_id long, chunk_id long, body string")
    ids = lambda df: {(r.quote_id, r.doc_id, r.chunk_id) for r in df.collect()}
    assert ids(dataset.anchored(*frames, few=few)) == ids(dataset.anchored(*frames, few=100))
    short = {(q, c) for q, d, b in quotes for e, c, _ in chunks if d == e and b is not None and len(b) < 3}
    assert short <= {(q, c) for q, _, c in ids(dataset.anchored(*frames, few=few))}


def test_few_pairs_post_no_runs(spark):
    quotes = spark.createDataFrame([(1, 1, "abcdefghij")], "quote_id long, doc_id long, body string")
    chunks = spark.createDataFrame([(1, 7, "x abcdefghij y"), (1, 8, "nothing")], "doc_id long, chunk_id long, body string")
    met = dataset.anchored(quotes, chunks)
    assert "Generate" not in met._jdf.queryExecution().executedPlan().toString()
    assert {r.chunk_id for r in met.collect()} == {7}


def test_quotes_with_a_sigma_at_a_words_end_are_found(spark):
    chunks = spark.createDataFrame([(1, 5, None, "λόγος ΟΔΟΣ", "ACTIVE", 0), (1, 6, None, "ΑΒΓ ΔΕΖ", "ACTIVE", 1)], "doc_id long, chunk_id long, parent_chunk_id long, content string, status string, sort_order int")
    evidence = spark.createDataFrame([("b", "d", "ΟΔΟΣ"), ("c", "d", "ΑΒΓ, ΔΕΖ")], "case_code string, source_doc_code string, evidence_quote string")
    got = {r.case_code: r.method for r in dataset.map_evidence(evidence, spark.createDataFrame([("d", 1)], "source_doc_code string, mapped_doc_id long"), chunks).collect()}
    assert got == {"b": "EXACT", "c": "PUNCTUATION_NORMALIZED"}


def test_pending_work_is_taken_oldest_first_without_a_single_task(spark):
    state = spark.createDataFrame([(i, "PENDING" if i % 2 else "SUCCESS", 100 - i // 4) for i in range(100)], "chunk_id long, status string, updated_at long")
    chunks = spark.range(100).selectExpr("id as chunk_id", "concat('t', id) as content", "if(id % 5 = 0, 'INACTIVE', 'ACTIVE') as status")
    got = experiment.pending_work(state, chunks, 7)
    want = sorted((100 - i // 4, i) for i in range(100) if i % 2 and i % 5)[:7]
    assert [(r.updated_at, r.chunk_id, r.content) for r in got.collect()] == [(u, i, f"t{i}") for u, i in want]
    assert not re.search("SinglePartition|Limit|TakeOrdered", got._jdf.queryExecution().executedPlan().toString())


def test_supplement_has_no_single_task(spark):
    docs = spark.createDataFrame([("s", f"d{i:02}", [f"f{i}", f"g{i}"]) for i in range(20)], "split string, source_doc_code string, facts array<string>")
    plan = dataset.plan_supplement(docs, "s", "FACT", 5, 7, 2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("SinglePartition|Window", plan)
