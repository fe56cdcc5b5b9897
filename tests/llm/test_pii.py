"""Base spans against plain patterns, positions, estimation and added spans."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, spans int")


CASES = [
    None, "", "no data", "a@b.com_x@y.org", "mail me: jo.e+x@mail-1.example.co.uk.", "a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "x4111111111111111y", "41111111111111110000", "1 2 3 4", "+1 (415) 555-2671", "+1 415", "++44 20 7946 0958.", "+1 (843) 555-7672 170.106.47.218",
    "ü € 😀 +49 30 901820 😀 é@x.de a@ä.de", "4-1-1-1 1111 1111 1111", "+1234567890123456", "1.1.1.1.", "..1.1.1.1..", "a" * 5000 + "@", "1" * 6000, "1.2." * 500, "+1" * 300, "5 " * 3000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(7)
    pool = ["@", ".", "+", "-", " ", "(", ")", "1", "25", "4111", "a", "b.c", "é", "😀", "\n", "_", "%"]
    texts = CASES + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(400)]
    texts += [" ".join(f"u{i}@h{i}.example.com" for i in range(700)), " ".join(f"10.{i % 256}.3.4" for i in range(600))]
    got = {r.doc_id: r for r in pii.digests(pii.find(documents(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = plain(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text[:80], want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        all_spans = got[i].spans.split(",") if got[i].spans else []
        assert set(want) <= set(all_spans) and len(set(all_spans)) == len(all_spans)
        order = [(list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])) for s in all_spans]
        assert order == sorted(order)


def test_numbers_lost_to_their_neighbours_are_added(spark):
    usual = [f"call +1 ({200 + i}) 555-01{i:02} or write u{i}@mail.example.com, host 10.2.3.{i}" for i in range(40)]
    texts = usual + ["phone +1 (843) 555-7672 170.106.47.218", "pay 4111111111111111 4111111111111111 now", "version 4111 2222 3333 4444 token", "plain words only", "jo [at] example [dot] com is my mail"]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(documents(spark, texts))).collect()}
    n = len(usual)
    assert "phone:6:23" in got[n].split(",") and "ip:24:38" in got[n].split(",")
    assert "card:4:20" in got[n + 1].split(",") and "card:21:37" in got[n + 1].split(",")
    assert got[n + 2] == "" and got[n + 3] == ""


def test_running_sums_of_long_arrays(spark):
    for n in (1, 255, 256, 257, 1000):
        values = [i % 7 for i in range(n)]
        row = spark.range(1).select(pii.running(F.lit(values).cast("array<int>")).alias("s")).first()
        assert list(row.s) == [sum(values[: i + 1]) for i in range(n)]


def test_reliabilities_are_found_without_labels(spark):
    rng = random.Random(11)
    right, counts = (0.97, 0.9, 0.7, 0.85, 0.6), {}
    for _ in range(4000):
        real = rng.random() < 0.6
        votes = [(1 if real else -1) * (1 if rng.random() < r else -1) for r in right]
        code = sum((v + 1) * 3**i for i, v in enumerate(votes))
        counts[code] = counts.get(code, 0) + 1
    patterns = spark.createDataFrame([(2, c, n) for c, n in counts.items()], "kind int, votes int, n long").coalesce(1)
    model = pii.estimate(patterns)
    assert model.share[2] == pytest.approx(0.6, abs=0.05)
    for i, r in enumerate(right):
        yes = math.exp(model.ratios[2 * 15 + i * 3 + 2])
        assert yes == pytest.approx(r / (1 - r), rel=0.5)
    weights = pii.train(patterns, model)
    assert weights[4] == max(weights[4:]) and all(w > 0 for w in weights[4:])


def test_no_documents(spark):
    assert pii.digests(pii.find(documents(spark, []))).collect() == []
    rows = spark.createDataFrame([(None, "a@b.de"), (None, "a@b.de"), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.digests(pii.find(rows)).collect()) == [(0, 1), (0, 1), (1, 0)]


def test_only_dataframe_functions(spark):
    plan = pii.digests(pii.find(documents(spark, CASES)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_base_spans_of_digits_in_small_groups(spark):
    """No three or four digits of these stand side by side, so a filter on runs of digits would lose them."""
    texts = ["41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "call +33 1 23 45 67 89 now", "+4 9 3 0 9 0 1 8 2", "4 1 1 1"]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(documents(spark, texts))).collect()}
    assert [plain(t) for t in texts] == [["card:0:23"], ["card:0:31"], ["phone:5:22"], ["phone:0:18"], []]
    for i, text in enumerate(texts):
        assert set(plain(text)) <= set(got[i].split(",")) | {""}, text
