"""Work that depends on an order, without one task for all rows: numbering and greedy choice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable, stored

#: Rows of a group that are compared in one product; larger groups are dealt into blocks that meet pairwise.
CELL = 1024


def numbered_globally(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """``df`` with ``name``, the row's number from 0 in the given order.

    Rows are dealt into ranges and sorted there; what the driver sees is each partition's count, from which
    the ranges' first numbers follow. Ties in the order get numbers in any order. The rows are checkpointed,
    as their places must not change between the two steps."""
    bits = 33
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", bits)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        first.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.lit(first or [0]), part.cast("int") + 1).cast("long")
    return placed.withColumn(name, start + F.col("_place").bitwiseAND(F.lit((1 << bits) - 1))).drop("_place")


def _alike(least: float, keys: tuple[str, ...]):
    """The pairs of one cell with at least this cosine."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, side = table.column("ord").to_numpy(), table.column("side").to_numpy()
        vectors = table.column("vec").combine_chunks()
        sizes = vectors.value_lengths().to_numpy()
        if len(np.unique(sizes)) > 1:
            raise ValueError("vectors of different sizes")
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        found: list[tuple[np.ndarray, ...]] = []
        for k in range(0, len(ids), 256):
            cosine = x[k : k + 256] @ x.T
            near = (cosine >= least) & (ids[k : k + 256, None] > ids)
            if across:
                near &= side[k : k + 256, None] != side
            a, b = np.nonzero(near)
            found.append((ids[k + a], ids[b], cosine[a, b]))
        later, earlier, similarity = (np.concatenate(c) for c in zip(*found, strict=True))
        same = {c: pa.array([table.column(c)[0].as_py()] * len(later), table.schema.field(c).type) for c in keys}
        return pa.table({**same, "later": later, "earlier": earlier, "similarity": similarity})

    return run


def similar_pairs(rows: DataFrame, keys: tuple[str, ...], least: float, cell: int = CELL) -> DataFrame:
    """(keys, later, earlier, similarity) of rows (keys, ord, vec) of a group with at least this cosine, exact.

    A group is dealt into blocks of about ``cell`` rows and each two blocks meet in one task, so no task holds a
    whole group, and only alike pairs leave it. Rows with a null key, order or vector are alike to none; the
    cosine with a zero vector is 0."""
    kinds = dict(rows.dtypes)
    usable = rows.select(*keys, F.col("ord").cast("long").alias("ord"), F.col("vec").cast("array<double>").alias("vec")).where(" and ".join(f"`{c}` is not null" for c in (*keys, "ord", "vec")))
    sizes = usable.groupBy(*keys).agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("ord"), F.col("blocks").cast("long")).cast("int")
    dealt = usable.join(sizes, list(keys)).withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("blocks", "other")
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "later long", "earlier long", "similarity double"])
    return cells.groupBy(*keys, "i", "j").applyInArrow(_alike(least, keys), schema)


def first_kept(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, ord) of the rows that an ordered choice drops: those with a kept row before them among ``pairs``
    (keys, later, earlier), where a row is kept unless it has a kept one before it.

    In each round the rows that no open row comes before are kept, and those behind them dropped; all groups go on at
    once, and only pairs of open rows are left. A round's pairs are checkpointed; there are as many rounds as the
    longest chain of choices that hang on one another."""
    spark, k = pairs.sparkSession, list(keys)
    left = durable(pairs.select(*k, "later", "earlier").distinct())
    dropped = None
    while not left.isEmpty():
        waiting = left.select(*k, F.col("later").alias("ord")).distinct()
        kept = left.select(*k, F.col("earlier").alias("ord")).distinct().join(waiting, [*k, "ord"], "left_anti")
        gone = stored(left.join(kept.withColumnRenamed("ord", "earlier"), [*k, "earlier"], "left_semi").select(*k, F.col("later").alias("ord")).distinct()).read()
        dropped = gone if dropped is None else dropped.unionByName(gone)
        open_pairs = left.join(gone.withColumnRenamed("ord", "later"), [*k, "later"], "left_anti").join(gone.withColumnRenamed("ord", "earlier"), [*k, "earlier"], "left_anti")
        left = durable(open_pairs)
    if dropped is None:
        return spark.createDataFrame([], pairs.select(*k, F.col("later").alias("ord")).schema)
    return dropped


def choose_in_order(rows: DataFrame, keys: tuple[str, ...], duplicate: float, review: float) -> DataFrame:
    """``rows`` (keys, ord, vec) with mark, nearest and similarity: each row against the kept ones before it in
    its group. From ``duplicate`` on it is a DUPLICATE and not kept, from ``review`` on a REVIEW, else KEEP; the
    nearest is the first of the most similar."""
    k = list(keys)
    pairs = stored(similar_pairs(rows, keys, review)).read()
    dropped = first_kept(pairs.where(F.col("similarity") >= duplicate), keys)
    against = pairs.join(dropped.withColumnRenamed("ord", "earlier"), [*k, "earlier"], "left_anti")
    best = against.groupBy(*k, F.col("later").alias("ord")).agg(F.max(F.struct("similarity", (-F.col("earlier")).alias("back"))).alias("b"))
    marks = best.select(*k, "ord", F.when(F.col("b.similarity") >= duplicate, "DUPLICATE").otherwise("REVIEW").alias("mark"), (-F.col("b.back")).alias("nearest"), "b.similarity")
    return rows.join(marks, [*k, "ord"], "left").withColumn("mark", F.coalesce("mark", F.lit("KEEP")))
