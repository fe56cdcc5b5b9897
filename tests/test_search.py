"""Keyword index and vector search against plain restatements on small tables."""

import math
import random
import re

import numpy as np
import pytest

from quern.operators import keyword, vectors

WORDS = ["the", "of", "red", "blue", "fox", "dog", "barn", "ridge", "oak", "elm"]
FIELDS = ("title", "content")


def plain_tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_bm25(chunks, queries, k):
    out = {}
    for q in queries:
        seq = plain_tokens(q["query"])
        scored = []
        for c in chunks:
            best, phrase = 0.0, 0.0
            for f in FIELDS:
                docs = [plain_tokens(x[f]) for x in chunks]
                n = sum(bool(d) for d in docs)
                mean = sum(map(len, docs)) / max(1, n)
                own = plain_tokens(c[f])
                idf = {t: math.log(1 + (n - sum(t in d for d in docs) + 0.5) / (sum(t in d for d in docs) + 0.5)) for t in seq}
                norm = lambda tf: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))  # noqa: B023, E731
                best = max(best, keyword.BOOSTS[f] * sum(idf[t] * norm(own.count(t)) for t in set(seq) if t in own))
                if f == "content" and seq:
                    times = sum(own[i : i + len(seq)] == seq for i in range(len(own)))
                    phrase = 2 * sum(idf[t] for t in seq) * norm(times) if times else 0.0
            fits = (q["type_filter"] in (None, c["chunk_type"])) and (not q["domains"] or c["business_domain"] in q["domains"])
            if best > 0 and fits:
                scored.append((-round(best + phrase, 6), c["chunk_id"]))
        out[q["query_id"]] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_keyword_search_equals_a_plain_scan(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices(WORDS, [40, 30, 5, 5, 4, 4, 3, 2, 2, 1], k=n))
    chunks = [{"chunk_id": i, "title": say(rng.randint(0, 3)), "content": say(rng.randint(0, 30)) or None, "chunk_type": rng.choice(["FAQ", "SOP"]), "business_domain": rng.choice(["a", "b", "c", None])} for i in range(90)]
    queries = [{"query_id": f"q{i}", "query": say(rng.randint(1, 5)), "type_filter": rng.choice([None, "FAQ"]), "domains": rng.choice([None, [], ["a", "b"]])} for i in range(25)]
    queries += [{"query_id": "none", "query": None, "type_filter": None, "domains": None}, {"query_id": "unknown", "query": "zebra", "type_filter": None, "domains": None}]
    frame = spark.createDataFrame(chunks + [{"chunk_id": None, "title": "fox", "content": "fox", "chunk_type": "FAQ", "business_domain": "a"}], "chunk_id long, title string, content string, chunk_type string, business_domain string")
    asked = spark.createDataFrame(queries, "query_id string, query string, type_filter string, domains array<string>")
    index = keyword.build_index(frame, FIELDS, block=20)
    for batch in (256, 7):
        got = {}
        for r in keyword.search(index, asked, 6, batch=batch).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        want = {q: hits for q, hits in plain_bm25(chunks, queries, 6).items() if hits}
        assert got.keys() == want.keys()
        for q, hits in want.items():
            assert [i for i, _ in got[q]] == [i for i, _ in hits]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits], abs=2e-6)
    listed = {(r.chunk_id, r.field, r.term): list(r.positions) for r in keyword.listed_postings(index).collect()}
    for c in chunks:
        for f in FIELDS:
            for t in set(plain_tokens(c[f])):
                assert listed.pop((c["chunk_id"], f, t)) == [i for i, w in enumerate(plain_tokens(c[f])) if w == t]
    assert not listed
    index.drop()


def test_phrase_brings_in_a_chunk_from_behind(spark):
    chunks = [(1, "red fox " * 3), (2, "fox red fox barn oak elm dog the of blue")] + [(i, "fox red " * 2) for i in range(3, 9)]
    index = keyword.build_index(spark.createDataFrame(chunks, "chunk_id long, content string"), ("content",))
    q = spark.createDataFrame([(7, "red fox barn")], "query_id long, query string")
    assert keyword.search(index, q, 1).first().chunk_id == 2


def test_keyword_index_of_nothing(spark):
    index = keyword.build_index(spark.createDataFrame([], "chunk_id long, content string"), ("content",))
    assert keyword.search(index, spark.createDataFrame([(1, "fox")], "query_id long, query string")).collect() == []
    some = keyword.build_index(spark.createDataFrame([(1, "fox")], "chunk_id long, content string"), ("content",))
    assert keyword.search(some, spark.createDataFrame([], "query_id long, query string")).collect() == []


def test_cjk_pairs_are_terms(spark):
    index = keyword.build_index(spark.createDataFrame([(1, "退款规则说明"), (2, "物流查询")], "chunk_id long, content string"), ("content",))
    assert [r.chunk_id for r in keyword.search(index, spark.createDataFrame([(1, "退款规则")], "query_id long, query string")).collect()] == [1]


def cosines(queries, chunks):
    unit = lambda v: np.zeros(len(v)) if v is None or not np.any(v) else np.array(v) / np.linalg.norm(v)
    return {q: sorted((-round(float(unit(a) @ unit(b)), 6), c) for c, b in chunks) for q, a in queries}


@pytest.mark.parametrize("query_bytes", [1 << 20, 600])
def test_knn_equals_a_plain_scan(spark, query_bytes):
    rng = np.random.default_rng(4)
    chunks = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(300)] + [(300, [0.0] * 6)]
    queries = chunks[::20]
    frame = spark.createDataFrame(chunks, "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in queries] + [("null", None)], "query_id string, vector array<double>")
    got = {}
    for r in vectors.knn(asked, frame, 7, query_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    want = cosines([(f"q{i}", v) for i, v in queries], chunks)
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [i for _, i in got[q]] == [i for _, i in hits[:7]]


def test_knn_filters_before_the_top_k(spark):
    chunks = spark.createDataFrame([(i, [1.0, i / 10], "FAQ" if i % 4 else "SOP", "a" if i < 15 else "b") for i in range(30)], "chunk_id long, vector array<double>, chunk_type string, business_domain string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "SOP", None), (2, [1.0, 0.0], None, ["b"]), (3, [1.0, 0.0], None, None)], "query_id long, vector array<double>, type_filter string, domains array<string>")
    for found in (vectors.knn(asked, chunks, 2), vectors.ann(vectors.build_vector_index(chunks, lists=3), asked, 2, probes=3)):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, set()).add(r.chunk_id)
        assert got == {1: {0, 4}, 2: {15, 16}, 3: {0, 1}}


def test_nothing_to_search(spark):
    none, some = spark.createDataFrame([], "chunk_id long, vector array<double>"), spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert vectors.knn(some, none).collect() == []
    assert vectors.knn(some.where("false"), some.withColumnRenamed("query_id", "chunk_id")).collect() == []
    assert vectors.build_vector_index(none) is None


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_inverted_file_has_the_recall_it_aims_at(spark, spread):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 3000) ** 2 % 12] + spread * rng.standard_normal((3000, 24))
    chunks = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    asked = chunks.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    index = vectors.build_vector_index(chunks, cell=200)
    measured = vectors.recall(vectors.ann(index, asked, 10, batch=16), vectors.knn(asked, chunks, 10)).first()
    assert measured.n == 600 and measured.recall >= 0.9
    assert index.probes < len(index.centroids) or spread > 1
    index.drop()


def test_only_rows_of_asked_terms_move_and_queries_are_scored_in_slices(spark):
    import numpy as np

    chunks = spark.createDataFrame([(i, f"fox common w{i}") for i in range(40)], "chunk_id long, content string")
    index = keyword.build_index(chunks, ("content",), block=10)
    asked = spark.createDataFrame([(i, f"common w{i}") for i in range(20)], "query_id long, query string")
    found = keyword.search(index, asked, 1, batch=3)
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(i, i) for i in range(20)]
    rows = [{"term": "a", "qs": np.array([0, 4, 5])}, {"term": "b", "qs": np.array([5, 9])}]
    assert [(low, [(r["term"], r["qs"].tolist()) for r in some]) for low, some in keyword._slices(rows, 3)] == [(0, [("a", [0])]), (3, [("a", [1, 2]), ("b", [2])]), (9, [("b", [0])])]
