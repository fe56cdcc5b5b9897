"""Connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def are_stars(edges: DataFrame) -> bool:
    """Whether each larger end u of the distinct edges has one smaller end v, which is no larger end itself: all components are found."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("ups"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("ups"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("ups").alias("ups"), F.max("down").alias("down")).where("ups > 1 or (ups = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node that has an edge to another; component is the smallest id.

    Alternating large-star and small-star rounds: each round links every node's
    larger neighbours, then its smaller ones, to the smallest node around it, so
    paths halve and a few rounds are enough; it ends when only stars are left. A round's
    edges are written to the shared checkpoint folder. Each round shuffles the remaining
    edges only; minima are combined before they are shuffled. Null ids and loops are left out.
    """
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct())
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = durable(small)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def blocks(members: DataFrame, group: str, size: str, limit: int, key: str) -> DataFrame:
    """``members`` repeated into the cells (group, i, j) in which each pair of a group meets once.

    A group of up to ``limit`` rows has one cell. A larger one is dealt into
    blocks by a hash of ``key``, and each two blocks share a cell; ``side`` is the
    row's own block. So no cell holds more than about two blocks' rows.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / limit)).cast("int")
    own = F.pmod(F.xxhash64(key), n.cast("long")).cast("int")
    dealt = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select("*", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).drop("other")
