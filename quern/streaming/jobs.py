"""Incremental forms: arriving files, change detection, task outcomes, live summaries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import clean
from ..operators.structure import chunk, parse
from ..storage import durable, exists

#: A document's statuses, and those that each may be followed by.
START = "UPLOADED"
TRANSITIONS = {
    "UPLOADED": ("PARSING",),
    "PARSING": ("CLEANED", "NEED_REVIEW", "FAILED"),
    "CLEANED": ("CHUNKED", "PARSING"),
    "NEED_REVIEW": ("PARSING",),
    "FAILED": ("PARSING",),
    "CHUNKED": ("CHUNKED", "PARSING"),
}


def arriving_documents(files: DataFrame, doc_type: str, watermark: str | None = None) -> DataFrame:
    """A stream of files (content, and ``arrived`` with a watermark) cleaned, each content once.

    Without a watermark every hash is remembered for ever; with one, repeats that come later than the
    watermark's span are new again, and the state stays bounded."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    once = hashed.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["sha256"]) if watermark else hashed.dropDuplicates(["sha256"])
    return once.withColumn("doc_type", F.lit(doc_type)).withColumn("clean_content", clean(F.col("content"), F.col("doc_type")))


def detect_changes(state: DataFrame, current: DataFrame) -> DataFrame:
    """The task table after a look at the current text hashes: PENDING for new and changed keys and for those
    left PROCESSING, unchanged otherwise. Keys that are gone stay as they are."""
    new = current.select("chunk_id", F.col("text_hash").alias("new_hash"))
    j = state.join(new, "chunk_id", "full")
    pending = F.col("new_hash").isNotNull() & (F.col("text_hash").isNull() | (F.col("text_hash") != F.col("new_hash")) | (F.col("status") == "PROCESSING"))
    return j.select("chunk_id", F.coalesce("new_hash", "text_hash").alias("text_hash"), F.when(pending, "PENDING").otherwise(F.col("status")).alias("status"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"))


def apply_outcomes(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tasks after a batch (chunk_id, ok): SUCCESS, or FAILED with one more try counted."""
    j = state.join(outcomes.select("chunk_id", "ok"), "chunk_id", "left")
    return j.select("chunk_id", "text_hash", F.when(F.col("ok"), "SUCCESS").when(~F.col("ok"), "FAILED").otherwise(F.col("status")).alias("status"), (F.col("retry_count") + F.when(~F.coalesce("ok", F.lit(True)), 1).otherwise(0)).alias("retry_count"))


def document_status(events: DataFrame, width: int = 4096) -> DataFrame:
    """(doc_id, status, rejected): each document's status after its moves (doc_id, seq, status) in order of seq, and
    how many moves the machine does not have, which change nothing. A document without a legal first move has none.

    Moves are functions of the status, so those of a stretch of ``width`` numbers are first made one function in a
    task of its own: a document with very many moves is not in one task."""
    states = [None, *TRANSITIONS]
    n = len(states)
    legal = F.lit([t is not None and t in (TRANSITIONS[s] if s else (START,)) for s in states for t in states])
    place = F.create_map(*[F.lit(x) for i, t in enumerate(states) if t for x in (t, i)])
    kind = "array<struct<state:int,rejected:bigint>>"
    same = F.transform(F.lit(list(range(n))), lambda i: F.struct(i.cast("int").alias("state"), F.lit(0).cast("long").alias("rejected"))).cast(kind)
    pick = lambda f, x: F.struct(F.element_at(f, x["state"] + 1)["state"].alias("state"), (x["rejected"] + F.element_at(f, x["state"] + 1)["rejected"]).alias("rejected"))

    def move(f, m):
        allowed = lambda x: F.coalesce(F.element_at(legal, x["state"] * n + m["to"] + 1), F.lit(False))
        return F.transform(f, lambda x: F.struct(F.when(allowed(x), m["to"]).otherwise(x["state"]).alias("state"), (x["rejected"] + F.when(allowed(x), 0).otherwise(1)).alias("rejected"))).cast(kind)

    numbered = events.select("doc_id", "seq", F.coalesce(F.try_element_at(place, F.col("status")), F.lit(0)).alias("to"), F.floor(F.col("seq") / width).alias("stretch"))
    parts = numbered.groupBy("doc_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("seq", "to"))).alias("moves")).select("doc_id", "stretch", F.aggregate("moves", same, move).alias("f"))
    whole = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "f"))).alias("parts"))
    ended = F.aggregate(F.transform("parts", lambda p: p["f"]), F.element_at(same, 1), lambda x, f: pick(f, x))
    return whole.select("doc_id", ended.alias("x")).select("doc_id", F.get(F.lit(["", *TRANSITIONS]), F.col("x.state")).alias("status"), "x.rejected").withColumn("status", F.nullif("status", F.lit("")))


class StatusMachine(StatefulProcessor):
    """The state of one document: its status and how many moves were rejected."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "status string, rejected long")

    def handleInputRows(self, key, rows, timerValues):
        status, rejected = self.held.get() if self.held.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: r["seq"]):
            if row["status"] in (TRANSITIONS.get(status, ()) if status else (START,)):
                status = row["status"]
            else:
                rejected += 1
        self.held.update((status, rejected))
        yield Row(doc_id=key[0], status=status, rejected=rejected)

    def close(self) -> None:
        pass


def live_status(moves: DataFrame) -> DataFrame:
    """A stream (doc_id, status, rejected) that follows a stream of moves (doc_id long, seq, status): the machine's
    state is kept by document, so a move that it does not have is rejected when it arrives.

    Moves of a document come in order of seq, those of one batch in any. Needs the RocksDB state store."""
    return moves.groupBy("doc_id").transformWithState(StatusMachine(), "doc_id long, status string, rejected long", "Update", "None")


def rolling_summary(results: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and latency percentiles of arriving results (finished_at, status, latency_ms) by window."""
    kept = results.withWatermark("finished_at", watermark) if results.isStreaming else results
    return kept.groupBy(F.window("finished_at", window)).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"), F.percentile_approx("latency_ms", 0.5).alias("latency_p50"), F.percentile_approx("latency_ms", 0.95).alias("latency_p95")
    ).select(F.col("window.start").alias("window_start"), "total", "failed", "latency_p50", "latency_p95")


# -- arriving documents ---------------------------------------------------------------


def ingest_batch(rows: DataFrame, number: int, target: str, run: str) -> None:
    """One batch of arriving documents (doc_id, doc_type, content, and where there ``arrived``) cleaned, structured,
    chunked and committed under ``target``.

    A batch has a folder of its own, named by run and number, and an entry in the manifest, which is written last
    and keeps its place. So a replay writes the same folder again and changes nothing; a batch that died before
    its entry does not count. A content that an earlier batch has brought is left out, whichever run brought it.
    Of several contents of a document in a batch the last to arrive counts, or the one of the largest hash."""
    spark, name = rows.sparkSession, f"{run}-{number}"
    entries = manifest(spark, target)
    own = entries.where(F.col("batch") == name).select("seq").collect()
    seq = own[0]["seq"] if own else (entries.agg(F.max("seq")).first()[0] or 0) + 1
    arrived = F.col("arrived") if "arrived" in rows.columns else F.lit(0)
    hashed = rows.select("doc_id", "doc_type", "content", F.sha2("content", 256).alias("sha256"), arrived.alias("arrived")).where("doc_id is not null and content is not null")
    last = hashed.groupBy("doc_id").agg(F.max_by(F.struct("doc_type", "content", "sha256"), F.struct("arrived", "sha256")).alias("d")).select("doc_id", "d.*")
    new = last.dropDuplicates(["sha256"])
    earlier = entries.where(F.col("seq") < seq).select("batch")
    if exists(spark, f"{target}/documents") and not earlier.isEmpty():
        known = spark.read.parquet(f"{target}/documents").join(F.broadcast(earlier), "batch", "left_semi")
        new = new.join(known.select("sha256").distinct(), "sha256", "left_anti")
    new = durable(new)
    new.select("doc_id", "doc_type", "sha256").write.mode("overwrite").parquet(f"{target}/documents/batch={name}")
    chunk(parse(new)).write.mode("overwrite").parquet(f"{target}/chunks/batch={name}")
    entry = spark.range(1).select(F.lit(name).alias("batch"), F.lit(seq).cast("long").alias("seq"), F.lit(new.count()).cast("long").alias("documents"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/entry={name}")


def manifest(spark, target: str) -> DataFrame:
    """(batch, seq, documents) of the committed batches."""
    schema = "batch string, seq long, documents long"
    if not exists(spark, f"{target}/manifest"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/manifest").select("batch", "seq", "documents")


def current_chunks(spark, target: str) -> DataFrame:
    """The chunks of each document's last committed version, with ``batch``."""
    entries = F.broadcast(manifest(spark, target).select("batch", "seq"))
    last = spark.read.parquet(f"{target}/documents").join(entries, "batch").groupBy("doc_id").agg(F.max_by("batch", "seq").alias("batch"))
    return spark.read.parquet(f"{target}/chunks").join(last, ["doc_id", "batch"], "left_semi")


def ingest(stream: DataFrame, target: str, checkpoint: str):
    """A writer that keeps ``target`` up to date with a stream of documents; start it, and read ``current_chunks``."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(lambda rows, number: ingest_batch(rows, number, target, run)).option("checkpointLocation", checkpoint)
