"""Each operator against a plain version, and its defined cases."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, chat, decontaminate, embeddings, html, jaccard, lines, passages, quality, repeats
from quern.llm.graph import components

RND = random.Random(3)
WORDS = ["".join(RND.choice("aeiourstnlé") for _ in range(RND.randint(2, 8))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(9)
    passage = [prose(70, rnd) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(rnd.randint(1, 60), rnd)]
        if i % 3 == 0:
            parts.insert(rnd.randint(0, 1), rnd.choice(passage))
        rows.append((i, "\n".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, None), (103, ""), (104, "ab" * 200), (105, "ab" * 180 + "x"), (10, prose(3, rnd)), (None, passage[0])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def key(rows):
    return sorted(rows, key=str)


def test_repeats_equal_brute_force(docs):
    given = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for d, b in given:
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for d, b in given:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first.get(b[i : i + 50], 1 << 62) < (1 << 61 if d is None else d):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert key(got) == key(want)


def test_column_sort_gives_suffix_order_and_prefixes():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(97, 100, (40, 24)).astype(np.uint8)
    seen = {}
    repeats.sort_columns(rows, lambda c, order, prefixes: seen.__setitem__(c, (order.copy(), prefixes.copy())))
    for c, (order, prefixes) in seen.items():
        suffixes = [bytes(rows[i, c:]) for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], prefixes[1:], strict=False):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


def test_passages_find_planted_and_leave_others(spark):
    rnd = random.Random(4)
    planted = prose(80, rnd).split()
    rows = [(i, prose(120, rnd)) for i in range(20)]
    for i in (3, 8, 15):
        copy = list(planted)
        copy[rnd.randrange(80)] = "changed"
        del copy[rnd.randrange(80)]
        rows[i] = (i, " ".join(rows[i][1].split()[:40] + copy + rows[i][1].split()[40:]))
    found = passages.find_passages(spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} | {r.match_doc_id for r in found} == {3, 8, 15}
    assert all(r.match_doc_id < r.doc_id and r.identity >= 0.8 and r.stop - r.start >= 60 for r in found)


def test_chains_follow_order_and_gap_cost():
    places = [(0, 20, 0, 20), (22, 40, 21, 39), (41, 60, 300, 319), (45, 70, 42, 67)]
    assert passages.best_forerunner(places, 0.2)[0] == [0, 1, 3]


def test_jaccard_join_equals_brute_force(spark):
    rnd = random.Random(6)
    base = [prose(60, rnd).split() for _ in range(6)]
    rows = []
    for i in range(80):
        w = list(rnd.choice(base)) if i % 2 else prose(40, rnd).split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One, two!"), (None, "one two"), (5, rows[5][1])]
    known = passages.WordHashes()
    sets = [set(jaccard.shingles(t, known).tolist()) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    big = 1 << 62
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), big), big if d is None else d)
    want = [(d, least[top(i)] if least[top(i)] < big else None, links[i]) for i, (d, _) in enumerate(rows)]
    got = [tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), block=8).select("doc_id", "component_id", "n_links").collect()]
    assert key(got) == key(want)


def test_prefix_depth_follows_the_links_that_are_seen():
    few, close, wide = {48: 10}, {49: 5000}, {41: 3000, 49: 3000}
    assert jaccard.chance(0.8, jaccard.prefix_depth(few, 0.8)) >= jaccard.RECALL > jaccard.chance(0.8, jaccard.prefix_depth(few, 0.8) + 1)
    assert jaccard.prefix_depth(close, 0.8) == jaccard.LEVELS > jaccard.prefix_depth(wide, 0.8) >= jaccard.prefix_depth(few, 0.8)


def test_signatures_agree_as_often_as_sets_do():
    rnd = np.random.default_rng(5)
    for size in (8, 40, 400):
        agreed = []
        for _ in range(150):
            every = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
            x = jaccard.signatures([np.sort(every[: size - size // 10]), np.sort(every[size // 10 :])])
            agreed.append((x[0] == x[1]).mean())
        assert abs(np.mean(agreed) - (size - 2 * (size // 10)) / size) < 0.06


def test_jaccard_join_with_repeated_and_null_ids(spark):
    rnd = random.Random(16)
    a, b, c, d = (prose(80, rnd) for _ in range(4))
    rows = [(1, a), (5, a + " end"), (2, b), (5, b + " end"), (3, c), (None, c + " end"), (4, d), (None, d + " end"), (None, prose(50, rnd))]
    got = [tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "n_links", "kept").collect()]
    assert key(got) == key([(1, 1, 1, True), (5, 1, 1, False), (2, 2, 1, True), (5, 2, 1, False), (3, 3, 1, True), (None, 3, 1, False), (4, 4, 1, True), (None, 4, 1, False), (None, None, 0, True)])
    kept = jaccard.keep_one(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, first int"))
    assert kept.columns == ["doc_id", "text", "first"] and key([tuple(r)[:2] for r in kept.collect()]) == key([rows[i] for i in (0, 2, 4, 6, 8)])


def test_jaccard_join_finds_links_near_the_threshold(spark):
    rnd = random.Random(26)
    rows = []
    for i in range(400):  # one replaced run of words; similarities from 0.8 to 0.86
        w = prose(120, rnd).split()
        k, n = rnd.randrange(20, 90), rnd.randint(6, 8)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:k] + prose(n, rnd).split() + w[k + n :]))]
    known = passages.WordHashes()
    sets = [set(jaccard.shingles(t, known).tolist()) for _, t in rows]
    near = {i for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i for i in range(0, 800, 2) if got[i + 1] == i}
    assert len(near) > 200 and found <= near and len(found) >= 0.98 * len(near)


def test_line_dedup(spark):
    rows = [(1, "the quick brown foxes jumped over the lazy sleeping dogs\n\nunique words are standing here alone"), (2, "the quick brown foxes jumped over the lazy sleeping dog\nother content entirely different from everything"), (3, None), (4, ""), (5, "\n"), (6, "other content entirely different from everything"), (None, "x"), (7, "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.n_lines, r.removed) for r in lines.summary(df).collect()}
    assert got == {1: (3, []), 2: (2, [0]), 3: (1, []), 4: (1, []), 5: (2, []), 6: (1, [0]), None: (1, [0]), 7: (1, [])}
    kept = {r.doc_id: r.text for r in lines.drop_repeats(df).collect()}
    assert kept[2] == rows[5][1] and kept[6] == "" and kept[3] is None and kept[1] == rows[0][1]


def test_decontamination_by_overlap(spark):
    rnd = random.Random(8)
    items = [(i, prose(rnd.randint(15, 50), rnd).capitalize() + ". " + prose(6, rnd).capitalize() + ".") for i in range(30)] + [(40, None), (41, "")]
    rows = [(i, prose(200, rnd)) for i in range(20)] + [(50, None), (51, "")]
    rows[4] = (4, rows[4][1][:300] + " " + items[7][1].upper() + " " + rows[4][1][300:])
    rows[9] = (9, items[3][1])
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(4, 7), (9, 3)}
    small = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), index_bytes=800)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == {(4, 7), (9, 3)}


def test_block_max_pruning_loses_nothing():
    rnd = random.Random(2)
    index = decontaminate.Index([(i, prose(20, rnd), prose(5, rnd)) for i in range(60)])
    texts = [index.words[k] + prose(30, rnd).split() for k in range(0, 60, 7)] + [prose(90, rnd).split() for _ in range(10)]
    got = {(k, i) for k, _, i, _, _ in index.scan(texts, 0.75, 0.0)}
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - index.longest), index.longest):
            terms = {index.number[w] for w in text[a : a + 2 * index.longest]} - {-1}
            score = dict(index.retrieve(sorted(terms), np.arange(index.n_blocks), 0.75))
            for i in score:
                if min(index.overlap(i, text[a : a + 2 * index.longest])[1:]) >= 0.5:
                    assert (k, i) in got


def test_bpe_equals_reference_encoder():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.load(path)
    texts = [prose(40), "", " ", "x" * 700, "a" * 257 + "b" * 300, "日本語のテキスト 🙂🙂", "<|endoftext|>", "  \n\n\t code(x) { return 1; }", "aaaaaaaaaaaaaaaaa bbbbbbb"]
    import regex

    for t in texts:
        pieces = [p.encode() for p in regex.compile(P.PATTERN).findall(t)]
        ids = [i for x in bpe.encode_pieces(vocabulary, pieces) for i in x]
        assert ids == encoder.encode_ordinary(t)
        assert bpe.decode_ids(vocabulary, ids) == t.encode()
    long = b"the theory of them" * 40
    assert bpe.merge_long(vocabulary, long) == bpe.merge_matrix(vocabulary, [long])[0]


def test_bpe_frame_keeps_columns(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(1, "hello world", "old"), (2, None, "x"), (3, "", "y")], "doc_id long, text string, ids string")
    out = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert {r.doc_id: bytes(r.decoded) for r in out.collect()} == {1: b"hello world", 2: b"", 3: b""}
    assert [bytes(r.decoded) for r in bpe.decode(out.drop("decoded"), P.path("byte_bpe_50k.tiktoken")).orderBy("doc_id").collect()] == [b"hello world", b"", b""]


def test_chat_round_trip_with_typed_parts(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\l<[", "\\\\b", "<s>[TURN]user[/ROLE]x[/TURN]</s>", None, "", "a\nb é🙂"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(None, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)] and back[None] == [("", "x")]
    loss = {r.conv_id: r.m for r in out.select("conv_id", chat.masked(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    assert loss[1] == "".join(t or "" for t in nasty[1::2]) and loss[None] == ""
    parts = spark.createDataFrame([(1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", None), ("text", " and ", None, None), ("audio", None, "b.wav", 7), ("image", None, "c.png", 9)])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(parts).first()
    assert r.attachments == ["a.png", "b.wav", "c.png"] and r.attachment_tokens == [chat.TOKENS["image"], 7, 9]
    assert "<image 1> and <audio 2><image 3>" in r.formatted


def test_html_extraction():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/a>A</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>Head &amp; line</h1><p>First   para<br>goes on.<p>Second &lt;b&gt; para &copy; x.<ul><li>one</li><li>two</li></ul><form><input><p>Sign up</p></form><div class="share-buttons"><a href=x>Share</a></div></article>
    <aside>Related</aside><section class="comments"><p>Great post, thank you very much for it.</p></section><footer>&copy; me</footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert html.extract(page) == ["Head & line", "First para goes on.", "Second <b> para © x.", "one", "two"]
    assert html.extract(None) == html.extract("") == html.extract("<nav><a href=x>only a menu</a></nav>") == []
    assert html.extract("<p>Just one long paragraph without any frame around it, told in full.</p>") == ["Just one long paragraph without any frame around it, told in full."]


def test_minimum_cut_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(30):
        n = rnd.randint(1, 7)
        scores = [round(rnd.uniform(-3, 3), 3) for _ in range(n)]
        edges = [(i, j, rnd.choice([0.2, 0.6, 1.5])) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        price = lambda side: sum(s for s, x in zip(scores, side, strict=True) if s > 0 and not x) + sum(-s for s, x in zip(scores, side, strict=True) if s < 0 and x) + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(price(html.minimum_cut(scores, edges)) - best) < 1e-6


def test_quality_separates_held_out_and_handles_gaps(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd.randint(20, 120), rnd) if i % 4 else " ".join(rnd.choice(WORDS).upper() + "!!" for _ in range(50))) for i in range(400)] + [(900, None), (901, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 4 > 0) for r in held if r.doc_id < 400) >= 0.97 * len([r for r in held if r.doc_id < 400])
    none = quality.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_embedding_links_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((12, 16))
    x = np.concatenate([base + 0.03 * rnd.standard_normal((12, 16)) for _ in range(12)] + [base, base])
    rows = [(i, [float(v) for v in np.float32(r)], int(i % 3)) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, 2.0], 1), (904, rows[0][1], None), (905, [None] + [1.0] * 15, 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=16).collect()}
    y = np.array([r[1] for r in rows[: len(x)]], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.98) & (np.arange(len(x))[:, None] % 3 == np.arange(len(x)) % 3)
    for i in range(len(x)):
        reach, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - reach
            reach |= new
            todo += new
        assert got[i] == (int(near[i].sum()) - 1, min(reach))
    assert all(got[i] == (0, i) for i in range(900, 906))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20), (None, 5)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, **{i: 10 for i in (10, 11, 12)}, **{i: 100 for i in range(100, 161)}}


def test_components_of_random_graphs(spark):
    rnd = random.Random(31)
    for n in (40, 90):
        edges = [(rnd.randrange(100), rnd.randrange(100)) for _ in range(n)]
        root = list(range(100))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(top(a), top(b))] = min(top(a), top(b))
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert repeats.remove_repeats(none).count() == 0
    assert passages.find_passages(none).count() == 0
    assert jaccard.join(none).count() == 0
    assert lines.summary(none).count() == 0
    assert decontaminate.find_leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(empty.withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


def test_mask_bound_rejects_no_near_sets(spark):
    draw, rows = random.Random(5), []
    for i in range(400):
        a = [draw.getrandbits(63) for _ in range(draw.randint(1, 120))]
        b = [x for x in a if draw.random() < 0.9] + [draw.getrandbits(63) for _ in range(draw.randint(0, 1 + len(a) // 8))]
        rows += [(i, "a", x) for x in a] + [(i, "b", x) for x in b or a[:1]]
    sets = spark.createDataFrame(rows, "i int, side string, h long").groupBy("i", "side").agg(F.collect_set("h").alias("set"), lines.mask_of(F.col("h")).alias("mask"))
    a, b = (sets.where(F.col("side") == s).select("i", F.col("set").alias(f"set_{s}"), F.col("mask").alias(f"mask_{s}")) for s in "ab")
    possible = lines.can_be_near(F.col("set_a"), F.col("set_b"), F.col("mask_a"), F.col("mask_b"), 0.8)
    judged = a.join(b, "i").select("set_a", "set_b", possible.alias("possible")).collect()
    near = [len(set(r.set_a) & set(r.set_b)) >= 0.8 * len(set(r.set_a) | set(r.set_b)) - 1e-9 for r in judged]
    assert any(near) and not all(r.possible for r in judged)
    assert all(r.possible for r, n in zip(judged, near) if n)
