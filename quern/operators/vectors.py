"""Cosine search of whole tables of query vectors: exact, and by an inverted file of learnt centroids.

Exact: the query vectors are taken in blocks whose size is checked. A block is broadcast
once, each batch of chunk vectors meets it in one matrix product, and a task keeps only
the best k of each query, so the chunk vectors are read where they lie, once for each
block, and not shuffled.

Approximate: centroids are fitted on a bounded sample, every vector is written to the
list of its nearest centroid, lists dealt into cells of bounded size. A query visits
as many lists as the sample shows to be needed for the target recall, and is compared
exactly with all vectors of their cells.

Cosine is in double precision; it is 0 where a vector is zero or null. Vectors of
another size than the queries' are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULTS
from ..storage import Stored, stored

#: Bytes of query vectors in a block, and rows of chunk vectors in a product.
QUERY_BYTES, ROWS = 32 << 20, 2048
#: Of the inverted file: the vectors that it is fitted on at most, the rows of a cell, the recall that probing aims at.
SAMPLE, CELL, RECALL = 65_536, 4096, 0.97


def unit(column, d: int) -> np.ndarray:
    """Rows of unit length from a column of arrays; zero where null or zero."""
    if column.null_count:
        column = column.fill_null([0.0] * d)
    flat = column.flatten()
    if len(flat) != len(column) * d:
        raise ValueError("vectors of different sizes")
    x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Best:
    """The best k of each query, a row of arrays; empty places have score -inf."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (queries, rows), -inf where a row may not be given. Ties go to the smaller id."""
        scores = np.round(scores, 6)
        for q in np.flatnonzero((scores > self.scores[:, -1:]).any(axis=1) | (scores == self.scores[:, -1:]).any(axis=1)):
            own = scores[q]
            at = np.flatnonzero(own >= max(self.scores[q, -1], np.partition(own, -self.k)[-self.k] if len(own) > self.k else -np.inf))
            s, i = np.append(self.scores[q], own[at]), np.append(self.ids[q], ids[at])
            order = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[order], i[order]

    def rows(self, queries: list, schema: pa.Schema) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array([queries[x] for x in q], schema.field(0).type), pa.array(self.ids[q, j]), pa.array(self.scores[q, j])], schema=schema)


@dataclass(frozen=True)
class QueryBlock:
    """Query ids, their unit vectors, and per query a chunk type or null and a list of domains or null."""

    ids: list
    x: np.ndarray
    types: list
    domains: list

    def forbid(self, scores: np.ndarray, types, domains) -> None:
        for q, (t, d) in enumerate(zip(self.types, self.domains, strict=True)):
            if t is not None:
                scores[q, types != t] = -np.inf
            if d:
                scores[q, ~np.isin(domains, d)] = -np.inf


def _with_filters(df: DataFrame, names: tuple[tuple[str, str], ...]) -> list:
    return [F.col(c).cast(kind).alias(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in names]


def _query_rows(queries: DataFrame) -> DataFrame:
    return queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), *_with_filters(queries, (("type_filter", "string"), ("domains", "array<string>"))))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector"), *_with_filters(chunks, (("chunk_type", "string"), ("business_domain", "string"))))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", F.lit("vector").alias("source"), "rank")


def _product(block, k: int, schema: pa.Schema):
    """The best k of each query of a broadcast block among a partition's vectors."""

    def run(batches):
        queries: QueryBlock = block.value
        best = _Best(len(queries.ids), k)
        filtered = any(t is not None for t in queries.types) or any(queries.domains)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                scores = queries.x @ unit(part.column("vector"), queries.x.shape[1]).T
                if filtered:
                    queries.forbid(scores, np.array(part.column("chunk_type").to_pylist(), object), np.array(part.column("business_domain").to_pylist(), object))
                best.add(scores, part.column("chunk_id").to_numpy())
        yield best.rows(queries.ids, schema)

    return run


def knn(query_vectors: DataFrame, chunk_vectors: DataFrame, k: int = DEFAULTS.channel_k, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, source, rank): the exact top k chunks of each query by cosine.

    query_vectors: (query_id, vector) and where there type_filter and domains; chunk_vectors: (chunk_id, vector) and
    where there chunk_type and business_domain. Queries of more than ``query_bytes`` are taken in blocks of that
    size, one pass each, whose hits are written before the next block is read."""
    spark = query_vectors.sparkSession
    kind = query_vectors.schema["query_id"].dataType
    schema = pa.schema([("query_id", to_arrow_type(kind)), ("chunk_id", pa.int64()), ("score", pa.float64())])
    ddl = f"query_id {kind.simpleString()}, chunk_id long, score double"
    asked, chunks = _query_rows(query_vectors), _chunk_rows(chunk_vectors)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size["n"]:
        return _ranked(spark.createDataFrame([], ddl), k)
    blocks = -(-size["n"] * size["d"] * 8 // query_bytes)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    path = None
    for b in range(blocks):
        table = dealt.where(F.col("block") == b).drop("block").toArrow()
        if not table.num_rows:
            continue
        block = QueryBlock(table.column("query_id").to_pylist(), unit(table.column("vector").combine_chunks(), size["d"]), table.column("type_filter").to_pylist(), table.column("domains").to_pylist())
        hits = chunks.mapInArrow(_product(spark.sparkContext.broadcast(block), k, schema), ddl)
        if blocks == 1:
            return _ranked(hits, k)
        if path is None:
            path = stored(hits).path
        else:
            hits.write.mode("append").parquet(path)
    return _ranked(spark.read.parquet(path), k)


# -- inverted file -----------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """cells: (list, cell, chunk_id, vector, chunk_type, business_domain); sizes: (list, cells); the lists' centroids,
    and how many of them a query visits."""

    cells: Stored
    sizes: Stored
    centroids: np.ndarray
    probes: int

    def drop(self) -> None:
        self.cells.drop()
        self.sizes.drop()


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by Lloyd rounds over the bounded sample; an empty list takes the worst placed vector."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        if len(empty):
            fit = np.einsum("ij,ij->i", sample, centroids[near])
            total[empty] = sample[np.argsort(fit)[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.divide(total, norm, out=centroids.copy(), where=norm > 0)
    return centroids


def needed_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """How many lists hold ``recall`` of the true k neighbours of some of the sample's vectors, each query's nearest lists first."""
    near = np.concatenate([(sample[i : i + 8192] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
    queries = sample[:: max(1, len(sample) // asked)]
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)
    scores = queries @ sample.T
    k = min(k, len(sample))
    found = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    ranks = np.sort(np.take_along_axis(place, near[found], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def build_vector_index(chunk_vectors: DataFrame, lists: int | None = None, k: int = DEFAULTS.channel_k, recall: float = RECALL, sample: int = SAMPLE, cell: int = CELL, seed: int = 7) -> VectorIndex | None:
    """The inverted file of all vectors; None without vectors. ``lists`` is the root of their number unless given,
    at most an eighth of the sample. Only the centroids and the probes are learnt from the sample."""
    chunks = _chunk_rows(chunk_vectors).where("vector is not null")
    n = chunks.count()
    if not n:
        return None
    share = min(1.0, 1.2 * sample / n)
    drawn = (chunks if share == 1.0 else chunks.where(F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20)))).select("vector").limit(sample).toArrow().column("vector").combine_chunks()
    d = len(drawn[0])
    x = unit(drawn, d)
    lists = max(1, min(lists or int(np.sqrt(n)), len(x) // 8 or 1))
    centroids = fit_centroids(x, lists, seed=seed)
    probes = needed_probes(x, centroids, k, recall)
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)

    def placed(batches):
        for batch in batches:
            near = [(unit(batch.column("vector").slice(i, ROWS), d) @ shared.value.T).argmax(axis=1) for i in range(0, batch.num_rows, ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near) if near else [], pa.int32()), *batch.columns], names=["list", *batch.schema.names])

    first = stored(chunks.mapInArrow(placed, "list int, chunk_id long, vector array<double>, chunk_type string, business_domain string"))
    sizes = stored(first.read().groupBy("list").agg(F.ceil(F.count("*") / cell).cast("int").alias("cells")))
    dealt = first.read().join(F.broadcast(sizes.read()), "list").withColumn("cell", F.pmod(F.xxhash64("chunk_id"), F.col("cells").cast("long")).cast("int")).drop("cells")
    cells = stored(dealt.repartition("list", "cell").sortWithinPartitions("list", "cell"))
    first.drop()
    return VectorIndex(cells, sizes, centroids, probes)


def _visited(k: int, schema: pa.Schema):
    """The best k of each query in one cell."""

    def run(cell: pa.Table, asked: pa.Table) -> pa.Table:
        if not cell.num_rows or not asked.num_rows:
            return schema.empty_table()
        asked = asked.combine_chunks()
        d = len(asked.column("vector")[0])
        queries = QueryBlock(asked.column("query_id").to_pylist(), unit(asked.column("vector").combine_chunks(), d), asked.column("type_filter").to_pylist(), asked.column("domains").to_pylist())
        best = _Best(len(queries.ids), k)
        for i in range(0, cell.num_rows, ROWS):
            part = cell.slice(i, ROWS).combine_chunks()
            scores = queries.x @ unit(part.column("vector").combine_chunks(), d).T
            queries.forbid(scores, np.array(part.column("chunk_type").to_pylist(), object), np.array(part.column("business_domain").to_pylist(), object))
            best.add(scores, part.column("chunk_id").to_numpy())
        return pa.Table.from_batches([best.rows(queries.ids, schema)])

    return run


def ann(index: VectorIndex, query_vectors: DataFrame, k: int = DEFAULTS.channel_k, probes: int | None = None, batch: int = 2048) -> DataFrame:
    """(query_id, chunk_id, score, source, rank) of the chunks in the lists that each query visits, exact scores.

    Queries and cells meet in groups of one cell and at most about ``batch`` queries."""
    spark = query_vectors.sparkSession
    kind = query_vectors.schema["query_id"].dataType
    schema = pa.schema([("query_id", to_arrow_type(kind)), ("chunk_id", pa.int64()), ("score", pa.float64())])
    probes = min(probes or index.probes, len(index.centroids))
    asked = _query_rows(query_vectors)
    parts = max(1, -(-asked.count() // batch))
    shared = spark.sparkContext.broadcast(index.centroids)
    d = index.centroids.shape[1]

    @F.pandas_udf("array<int>")
    def nearest(vectors):
        import pandas as pd

        x = unit(pa.array(list(vectors), pa.list_(pa.float64())), d)
        return pd.Series([row.tolist() for row in np.argsort(-(x @ shared.value.T), axis=1)[:, :probes]])

    visits = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("list", F.explode(nearest("vector"))).join(F.broadcast(index.sizes.read()), "list")
    visits = visits.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    cells = index.cells.read().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ("part", "list", "cell")
    hits = cells.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_visited(k, schema), f"query_id {kind.simpleString()}, chunk_id long, score double")
    return _ranked(hits, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many true neighbours there are and the share of them that was found."""
    hit = found.select("query_id", "chunk_id").withColumn("found", F.lit(1))
    return exact.select("query_id", "chunk_id").join(hit, ["query_id", "chunk_id"], "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
