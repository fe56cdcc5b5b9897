"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one class first. In each pass the classes' vectors
are ordered by label and by the signs of random projections, read as one string
of bits; each vector is compared with the ones before it in a bounded window, and
the verified pairs of all passes are united into components. What a window can
miss inside a large component is then made up exactly: within each component all
vectors are compared in blocks, which also gives the numbers of links. Cosines
are in double precision.

A window ends at a partition's border; a pair cut there meets in other passes.

Defined cases: a vector that is null, zero, or holds a null or non-finite
component, and a row with a null label, links with nothing (n_links 0, its own
component); vectors of different sizes do not link; repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions
from .graph import blocks, components

PASSES, BITS, WINDOW, BLOCK = 16, 64, 32, 1024


def usable(vector: str = "embedding", label: str = "label"):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    x = np.array(column.to_pylist(), np.float64) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True) if len(x) else x


def _keyed(passes: int, bits: int, seed: int):
    """Each vector once for each pass, with its string of sign bits."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(rows.column("vector").to_pylist()):
                    by_size.setdefault(len(v), []).append(i)
                for d, at in by_size.items():
                    part = rows.take(pa.array(at))
                    if d not in planes:
                        planes[d] = np.random.default_rng(seed + d).standard_normal((d, passes * bits))
                    signs = (_matrix(part.column("vector")) @ planes[d] > 0).reshape(len(at), passes, bits)
                    keys = np.packbits(signs, axis=2)
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), p, np.int32)), part.column("label"), pa.array(np.full(len(at), d, np.int32)), pa.array([k.tobytes() for k in keys[:, p]], pa.binary()), part.column("id"), part.column("vector")],
                            names=["pass", "label", "d", "key", "id", "vector"],
                        )

    return run


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray) -> tuple[list, list]:
    """The pairs without those that close a circle."""
    root: dict = {}

    def top(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    kept: tuple[list, list] = ([], [])
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept[0].append(a)
            kept[1].append(b)
    return kept


def _windows(threshold: float, window: int):
    """Verified pairs of rows up to ``window`` apart in the order they come in."""

    def run(batches):
        held = None
        for batch in batches:
            for rows in (pa.Table.from_batches([batch.slice(i, 4000)]) for i in range(0, batch.num_rows, 4000)):
                rows = rows if held is None else pa.concat_tables([held, rows])
                keys = [rows.column(c).to_numpy() for c in ("pass", "label", "d")]
                ids, found = rows.column("id").to_numpy(), ([], [])
                new = 0 if held is None else held.num_rows
                same = np.ones(len(ids), bool)
                same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
                starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
                for d in np.unique(keys[2]):
                    at = np.flatnonzero(keys[2] == d)
                    x = np.zeros((len(ids), d))
                    x[at] = _matrix(rows.column("vector").take(pa.array(at)))
                    for j in range(1, min(window, len(ids) - 1) + 1):
                        i = np.arange(max(j, new), len(ids))
                        i = i[(i - j >= starts[i]) & (keys[2][i] == d)]
                        hit = i[np.einsum("ij,ij->i", x[i], x[i - j]) >= threshold]
                        found[0].append(ids[hit])
                        found[1].append(ids[hit - j])
                if found[0]:
                    a, b = forest(np.concatenate(found[0]), np.concatenate(found[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                held = rows.slice(max(0, rows.num_rows - window)).combine_chunks()

    return run


def _counts(threshold: float):
    """Of one cell: how many copies of other classes each class is linked to."""

    def run(table: pa.Table) -> pa.Table:
        ids, copies, side = (table.column(c).to_numpy() for c in ("id", "copies", "side"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        total = np.zeros(len(ids), np.int64)
        sizes = np.array([len(v) for v in table.column("vector").to_pylist()])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x, own, weight = _matrix(table.column("vector").take(pa.array(at))), side[at], copies[at]
            for k in range(0, len(at), 512):
                near = x[k : k + 512] @ x.T >= threshold
                near[np.arange(len(near)), k + np.arange(len(near))] = False
                if i != j:
                    near &= own[k : k + 512, None] != own
                total[at[k : k + 512]] += near @ weight
        return pa.table({"id": ids, "n": total})

    return run


def link(vectors: DataFrame, threshold: float = 0.98, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), "label")
    good = rows.where(usable("vector"))
    classes = durable(good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).where("id is not null"))
    n = partitions(vectors.sparkSession)
    keyed = classes.select(F.col("label").cast("long").alias("label"), "id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        _keyed(passes, bits, seed), "pass int, label bigint, d int, key binary, id bigint, vector array<double>"
    )
    order = ["pass", "label", "d", "key", "id"]
    pairs = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_windows(threshold, window), "a bigint, b bigint")
    groups = components(pairs)
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "component").join(classes.select("id", "copies", F.col("vector").cast("array<double>").alias("vector")), "id")
    linked = blocks(members, "component", "size", block, "id").select("component", "i", "j", "side", "id", "copies", "vector").groupBy("component", "i", "j").applyInArrow(_counts(threshold), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(groups, "id", "left").join(linked, "id", "left").select("label", "vector", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    found = rows.where(usable("vector")).join(known, ["label", "vector"], "left")
    lone = rows.where(~usable("vector")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).unionByName(lone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
