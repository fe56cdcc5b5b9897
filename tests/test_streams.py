"""Arriving documents and the status machine, on streams and replayed."""

import itertools
import random

import pytest

from quern.operators import structure
from quern.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shown(df):
    return sorted((r.doc_id, r.title, r.content) for r in df.collect())


def wanted(spark, docs):
    return shown(structure.chunk(structure.parse(spark.createDataFrame(docs, "doc_id long, doc_type string, content string"))))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    first = [(1, "FAQ", "Q1：退款？\nA1：七天"), (2, "SOP", "流程\n1. 打开\n2. 关闭"), (3, "FAQ", "Q1：退款？\nA1：七天"), (None, "FAQ", "x"), (4, "RULE", None)]
    second = [(1, "FAQ", "Q1：退款？\nA1：十天"), (5, "SOP", "流程\n1. 打开\n2. 关闭")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, doc_type string, content string")
    target = str(tmp_path / "t")
    for _ in range(2):
        jobs.ingest_batch(frame(first), 0, target, "a")
    once = shown(jobs.current_chunks(spark, target))
    assert {d for d, _, _ in once} in ({1, 2}, {2, 3})
    jobs.ingest_batch(frame(second), 1, target, "a")
    after = shown(jobs.current_chunks(spark, target))
    assert ("退款？" in str(after)) and "十天" in str([c for d, _, c in after if d == 1])
    assert not [d for d, _, _ in after if d == 5]
    jobs.ingest_batch(frame(first), 0, target, "a")
    jobs.ingest_batch(frame(first), 0, target, "another run")
    assert shown(jobs.current_chunks(spark, target)) == after
    assert sorted((r.batch, r.seq) for r in jobs.manifest(spark, target).collect()) == [("a-0", 1), ("a-1", 2), ("another run-0", 3)]


def test_a_stream_of_documents_is_chunked(spark, tmp_path):
    docs = [(i, "FAQ", f"Q1：问题{i}？\nA1：答案{i}") for i in range(6)]
    source, target = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame(docs[:3], "doc_id long, doc_type string, content string").coalesce(1).write.json(str(source), mode="append")
    run = lambda checkpoint: jobs.ingest(spark.readStream.schema("doc_id long, doc_type string, content string").json(str(source)), target, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(90)
    run("one")
    assert shown(jobs.current_chunks(spark, target)) == wanted(spark, docs[:3])
    spark.createDataFrame(docs[3:], "doc_id long, doc_type string, content string").coalesce(1).write.json(str(source), mode="append")
    run("one")
    run("two")
    assert shown(jobs.current_chunks(spark, target)) == wanted(spark, docs)


def plain_status(moves):
    out = {}
    for d, _, s in sorted(moves, key=lambda m: m[1]):
        status, rejected = out.get(d, (None, 0))
        allowed = jobs.TRANSITIONS.get(status, ()) if status else (jobs.START,)
        out[d] = (s, rejected) if s in allowed else (status, rejected + 1)
    return out


@pytest.mark.parametrize("width", [4096, 5])
def test_status_machine_equals_a_plain_walk(spark, width):
    rng = random.Random(4)
    moves = [(rng.randint(0, 5), i, rng.choice([*jobs.TRANSITIONS, "LOST", None])) for i in range(400)] + [(9, 401, "CHUNKED")]
    got = {r.doc_id: (r.status, r.rejected) for r in jobs.document_status(spark.createDataFrame(moves, "doc_id long, seq long, status string"), width).collect()}
    assert got == plain_status(moves)


def test_a_live_machine_rejects_an_illegal_move(spark, tmp_path):
    batches = [[(1, 1, "UPLOADED"), (2, 2, "PARSING"), (1, 3, "PARSING")], [(1, 4, "CHUNKED"), (1, 5, "CLEANED"), (2, 6, "UPLOADED")], [(1, 7, "CHUNKED"), (2, 8, "FAILED")]]
    source = tmp_path / "moves"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    seen = {}
    try:
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, "doc_id long, seq long, status string").coalesce(1).write.json(str(source), mode="append")
            moves = spark.readStream.schema("doc_id long, seq long, status string").json(str(source))
            kept = str(tmp_path / f"out{n}")
            write = lambda rows, _, kept=kept: rows.write.mode("append").parquet(kept)
            jobs.live_status(moves).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
            seen |= {r.doc_id: (r.status, r.rejected) for r in spark.read.parquet(kept).collect()}
            assert seen == plain_status(list(itertools.chain(*batches[: n + 1])))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
