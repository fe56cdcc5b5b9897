"""Whitening against a plain eigendecomposition, and the filter audit against a plain walk and its SQL."""

import math
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest

from quern.llm import filters, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows, components=16):
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in usable)
    usable = [(i, x + [1000000] * (d - len(x))) for i, x in usable]
    fit = np.array(sorted({tuple(x) for _, x in usable}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    order = order[values[order] > 1e-14 * values.max()]
    out = {}
    for i, x in usable:
        scaled = n * np.array(x) - sums
        out.setdefault(i, []).append((int((scaled.astype(object) ** 2).sum()), (scaled / n) @ (vectors[:, order] / np.sqrt(values[order]))))
    return n, values[order] / values.sum(), out


def compare(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    n, explained, plain = plain_whitening(rows)
    k = len(explained)
    assert len(got) == k * sum(map(len, plain.values()))
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-8
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-8)
        assert r.deviation in [d for d, _ in plain[r.vec_id]]
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    for c, whitened in by.items():
        mine = np.array([x for i in sorted(whitened) for x in sorted(whitened[i], key=abs)])
        own = np.array([x for i in sorted(whitened) for x in sorted((float(w[c - 1]) for _, w in plain[i]), key=abs)])
        turn = 1 if mine @ own > 0 else -1
        assert np.allclose(turn * mine, own, atol=1e-7)
    return got


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((120, 20)) @ rng.standard_normal((20, 20)) * 0.2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(500, rows[0][1]), (0, rows[0][1]), (501, None), (502, [None] + [0.0] * 19), (503, [float("nan")] * 20), (504, [float("inf")] * 20)]
    got = compare(spark, rows)
    assert {r.component for r in got} == set(range(1, 17))
    assert not {r.vec_id for r in got} & {501, 502, 503, 504}


def test_whitening_of_few_directions(spark):
    rng = np.random.default_rng(5)
    flat = rng.standard_normal((40, 3)) @ np.array([[1, 0, 0, 0, 0, 1], [0, 1, 0, 0, 0, 0], [0, 0, 1, 1, 0, 0]])
    exact = np.round(flat * 64) / 64
    compare(spark, [(i, [float(c) for c in v]) for i, v in enumerate(exact)])
    compare(spark, [(1, [1.0, 2.0, 0.5]), (2, [0.5]), (3, [2.0, 1.0, -0.25]), (4, [1.5, 0.25, 1.0])])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_deviation_that_no_long_holds_is_null(spark):
    rows = [(i, [float(2**40 * i), 1.0]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    assert {r.deviation for r in got if r.vec_id == 4} == {None}
    assert all(r.identity_error < 1e-6 for r in got)


def plain_audit(documents, labels):
    first, good, toxic = {}, set(), set()
    for i, text, _ in documents:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, quality, bad in labels:
        good |= {i} if quality == 1 else set()
        toxic |= {i} if bad == 1 else set()
    out = {}
    for i, text, source in documents:
        text = text or ""
        words = [w for w in __import__("re").split(r"[ \t-\r]+", text) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > first[text],
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((source or "", order, step), dict.fromkeys(filters.COUNTS, 0) | {"shapley": 0})
                row["kept"] += not gone and not fails[f]
                row["removed"] += not gone and fails[f]
                row["redundant"] += gone and fails[f]
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                row["good_lost"] += not gone and fails[f] and i is not None and i in good
                row["toxic_lost"] += not gone and fails[f] and i is not None and i in toxic
                gone |= fails[f]
    shares = {}
    for (part, order, step), row in out.items():
        shares[part, order[step - 1]] = shares.get((part, order[step - 1]), 0) + row["removed"]
    for (part, order, step), row in out.items():
        row["shapley"] = shares[part, order[step - 1]]
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): {c: r[c] for c in (*filters.COUNTS, "shapley")} for r in df.collect()}


def test_audit_equals_a_plain_walk_and_its_sql(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a b", "A" * 50, "#", "same text", "same text", "ä ö x", " ".join(f"w{i}" for i in range(250)), "x " * 400, "Word | " * 300, " ".join(f"W{i}" for i in range(260))]
    documents = [(i if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["web", "book", "", None])) for i in range(120)]
    documents += [(3, "same text", "web"), (3, "same text", "web")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 7) for d in documents], "doc_id long, text string, source string, mask int")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(filters.audit(frame, told))
    assert got == plain_audit(documents, labels)
    con = duckdb.connect()
    con.register("documents", frame.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", told.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    sql = {(r[0], r[1], r[2]): dict(zip((*filters.COUNTS, "shapley"), r[3:], strict=True)) for r in con.sql(filters.SQL).fetchall()}
    assert sql == got


def test_audit_of_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filters.audit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
