"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once; bounds the memory of a Python worker.
CHUNK_BYTES = 2 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine, a temporary one.

    On a cluster without the setting this raises, as a folder of the driver's own is lost with it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, of which later steps read single columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/quern-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def written_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``keys`` as the shuffle deals them: rows dealt by these keys
    are written where they are, and grouping the table by them needs no exchange."""
    spark, name = df.sparkSession, f"quern_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(spark), *keys).saveAsTable(name)
    return spark.table(name)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MUL
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX
    return x ^ (x >> np.uint64(31))


def cuts(sizes, limit: int = CHUNK_BYTES):
    """(start, end) runs of neighbours whose sizes add up to about ``limit``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Indices at which a run of equal values starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
