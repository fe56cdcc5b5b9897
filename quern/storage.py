"""Tables that an operator writes for later steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine, a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="quern-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Rows that one task sorts, where their number is known.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int = 0) -> int:
    """The shuffle partitions, or more where there are very many rows. A number that is given to ``repartition`` is
    kept by adaptive execution, which else merges well compressed partitions until a task sorts millions of rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


@dataclass(frozen=True)
class Stored:
    """A written table: ``read`` it as often as needed, ``drop`` it when done."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        place, files = _place(self.spark, self.path)
        files.delete(place, True)


def stored(df: DataFrame, path: str | None = None) -> Stored:
    """``df`` written to ``path``, or to a new folder in the shared one."""
    path = path or f"{shared_folder(df.sparkSession)}/quern-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return Stored(df.sparkSession, path)
