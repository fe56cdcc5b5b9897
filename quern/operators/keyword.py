"""A written keyword index and BM25 search of whole tables of queries over it.

Chunks are dealt into blocks of bounded size. A row of the index is one term of one field
in one block: the chunks that have it, their BM25 part (without the idf), the positions,
and the block's largest part. It is written once, where the blocks are made, so that the
chunks' terms move once, and read by each search, of which only rows of asked terms move.

A search deals its queries into large batches. A batch meets each block once: the rows of
its terms are joined on (term, field, salt), where the salt is the block's, so that a stop
word's rows are dealt over all tasks and move once for a batch, not once for each query
or chunk. Blocks are dealt into parts, one a task; a part is given the batch's queries once,
walks its blocks with the queries' best k so far, scores a few queries at a time, leaves out
a query where the block's maxima can't reach its best, and hands on k hits a query. So no
row of (query, chunk) is shuffled beyond those.

Score: the best boosted field's sum over the query's distinct terms, plus twice the BM25
score of the query as a phrase of the content (its terms in order, idf added up).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULTS
from ..functions.text import text
from ..storage import Stored, stored

#: How much each field counts, and the phrase.
BOOSTS = {"title": 3.0, "title_path": 2.0, "content": 1.0, "keywords": 2.0, "tags": 2.0}
PHRASE_BOOST = 2.0
#: Chunks of a block, queries scored at once, and the parts that a frequent term's rows are dealt into.
BLOCK, BATCH, SALTS = 2048, 256, 16
#: Queries for which the index moves once; their texts and best hits are held in a task.
DEALT = 16_384
#: Asked terms that are broadcast, so that the index's other rows don't move before the join; more are joined without.
TOLD = 200_000


def tokens(col):
    """Lower-case words of Latin letters and digits, and pairs of neighbouring CJK characters."""
    latin = F.regexp_extract_all(F.lower(text(col)), F.lit(r"[\p{L}\p{N}&&[^一-鿿]]+"), 0)
    cjk = F.regexp_extract_all(text(col), F.lit(r"(?=([一-鿿]{2}))"), 1)
    return F.concat(latin, cjk)


@dataclass(frozen=True)
class KeywordIndex:
    """postings: (term, field, block, df, most, chunks, parts, positions); directory: (block, chunk_ids, types,
    domains), a chunk's place in it being its number in the postings; terms: (field, term, df); stats: (field,
    n_chunks, mean_length)."""

    postings: Stored
    directory: Stored
    terms: Stored
    stats: Stored

    def drop(self) -> None:
        for part in (self.postings, self.directory, self.terms, self.stats):
            part.drop()


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    return KeywordIndex(*[Stored(spark, f"{path}/{name}") for name in ("postings", "directory", "terms", "stats")])


POSTINGS = "term string, field string, block int, df int, most double, chunks array<int>, parts array<double>, positions array<array<int>>"
POSTINGS_SCHEMA = pa.schema(
    [("term", pa.string()), ("field", pa.string()), ("block", pa.int32()), ("df", pa.int32()), ("most", pa.float64()), ("chunks", pa.list_(pa.int32())), ("parts", pa.list_(pa.float64())), ("positions", pa.list_(pa.list_(pa.int32())))]
)


#: A block's chunks are numbered in this order.
NUMBERED = ("chunk_id", "chunk_type", "business_domain")


def _inverted(fields: tuple[str, ...], means: dict[str, float]):
    """Of one block's chunks (NUMBERED, and t_ with each field's terms): the postings of all fields."""

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table.select(NUMBERED), sort_keys=[(c, "ascending") for c in NUMBERED], null_placement="at_start")
        table = table.take(order).combine_chunks()
        block = table.column("block")[0].as_py()
        made = [_field(f, block, table.column(f"t_{f}").combine_chunks(), means[f]) for f in fields if f in means]
        return pa.concat_tables(made) if made else POSTINGS_SCHEMA.empty_table()

    return run


def _field(field: str, block: int, lists: pa.ListArray, mean: float) -> pa.Table:
    """One field's postings, by term."""
    words = lists.flatten().dictionary_encode()
    counts = lists.value_lengths().to_numpy()
    number = np.repeat(np.arange(len(lists)), counts)
    position = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.repeat(counts, counts)
    term = words.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term, number, position, length = term[order], number[order], position[order], length[order]
    if not len(term):
        return POSTINGS_SCHEMA.empty_table()
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (number[1:] != number[:-1])])
    tf = np.diff(np.r_[starts, len(term)])
    part = tf * (DEFAULTS.bm25_k1 + 1) / (tf + DEFAULTS.bm25_k1 * (1 - DEFAULTS.bm25_b + DEFAULTS.bm25_b * length[starts] / mean))
    firsts = np.flatnonzero(np.r_[True, term[starts][1:] != term[starts][:-1]])
    ends = np.r_[firsts, len(starts)].astype(np.int32)
    lists_of = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
    n = len(firsts)
    return pa.Table.from_pydict(
        {
            "term": words.dictionary.take(pa.array(term[starts][firsts])),
            "field": pa.array([field] * n, pa.string()),
            "block": pa.array(np.full(n, block, np.int32)),
            "df": pa.array(np.diff(ends), pa.int32()),
            "most": pa.array(np.maximum.reduceat(part, firsts)),
            "chunks": lists_of(pa.array(number[starts], pa.int32())),
            "parts": lists_of(pa.array(part)),
            "positions": lists_of(pa.ListArray.from_arrays(pa.array(np.r_[starts, len(term)].astype(np.int32)), pa.array(position, pa.int32()))),
        },
        schema=POSTINGS_SCHEMA,
    )


def build_index(chunks: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS), path: str | None = None, block: int = BLOCK) -> KeywordIndex:
    """The index of ``chunks`` (chunk_id, the fields, and for filters chunk_type and business_domain where there).

    Null chunk ids are left out; a chunk without a term of a field is not counted in that field's statistics; of
    rows that repeat a chunk_id each counts. No rows give an empty index."""
    given = [c for c in ("chunk_type", "business_domain") if c in chunks.columns]
    filters = [F.col(c).cast("string").alias(c) if c in given else F.lit(None).cast("string").alias(c) for c in ("chunk_type", "business_domain")]
    rows = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), *filters, *[tokens(F.col(f)).alias(f"t_{f}") for f in fields])
    blocks = max(1, -(-chunks.count() // block))
    dealt = stored(rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")))
    at = lambda p: None if path is None else f"{path}/{p}"
    listed = F.sort_array(F.collect_list(F.struct(*NUMBERED)))
    directory = dealt.read().groupBy("block").agg(listed.alias("l")).select("block", F.col("l.chunk_id").alias("chunk_ids"), F.col("l.chunk_type").alias("types"), F.col("l.business_domain").alias("domains"))
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.size(f"t_{f}").alias("length")) for f in fields])
    lengths = dealt.read().select(F.explode(parts).alias("p")).select("p.*").where("length > 0")
    stats = stored(lengths.groupBy("field").agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean_length")), at("stats"))
    # one row for each field
    means = {r.field: r.mean_length for r in stats.read().collect()}
    postings = stored(dealt.read().groupBy("block").applyInArrow(_inverted(tuple(fields), means), POSTINGS), at("postings"))
    terms = stored(postings.read().groupBy("field", "term").agg(F.sum("df").alias("df")), at("terms"))
    index = KeywordIndex(postings, stored(directory, at("directory")), terms, stats)
    dealt.drop()
    return index


def listed_postings(index: KeywordIndex) -> DataFrame:
    """(chunk_id, field, term, tf, positions) of the whole index, one row per chunk and term."""
    rows = index.postings.read().select("block", "field", "term", F.explode(F.arrays_zip("chunks", "positions")).alias("e"))
    return rows.join(index.directory.read().select("block", "chunk_ids"), "block").select(F.get("chunk_ids", F.col("e.chunks")).alias("chunk_id"), "field", "term", F.size("e.positions").alias("tf"), F.col("e.positions").alias("positions"))


def _occurrences(rows: list, sequence: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(chunk numbers, how often the terms follow one another in this order) from the content's rows by term."""
    found = None
    for i, term in enumerate(sequence):
        numbers, positions, counts = rows[term]
        keys = (np.repeat(numbers, counts).astype(np.int64) << 32) + positions - i + (1 << 30)
        found = keys if found is None else found[np.isin(found, keys, assume_unique=True)]
        if not len(found):
            break
    return np.unique(found >> 32, return_counts=True)


class _Best:
    """The best k hits of each query of a batch so far."""

    def __init__(self, queries: list[dict], k: int):
        self.queries, self.k = queries, k
        self.hits = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        self.least = np.zeros(len(queries))

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.hits[q][0], scores), np.append(self.hits[q][1], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.hits[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[q] = scores[order[-1]]


def _slices(rows: list[dict], batch: int):
    """(first query, rows with their queries among the next ``batch``) of the queries that rows have, in turn."""
    if not rows:
        return
    q = np.concatenate([r["qs"] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r["qs"]) for r in rows])
    order = np.argsort(q // batch, kind="stable")
    q, of = q[order], of[order]
    bounds = np.flatnonzero(np.r_[True, q[1:] // batch != q[:-1] // batch, True])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        low = int(q[a]) // batch * batch
        cuts = np.flatnonzero(np.r_[True, of[a + 1 : b] != of[a : b - 1], True])
        yield low, [{**rows[of[a + x]], "qs": q[a + x : a + y] - low} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _block(best: _Best, head: dict, rows: list[dict], boosts: dict[str, float], batch: int) -> None:
    """One block's hits of a batch."""
    for low, some in _slices(rows, batch):
        _score(best, low, best.queries[low : low + batch], head, some, boosts)


def _score(best: _Best, low: int, queries: list[dict], head: dict, rows: list[dict], boosts: dict[str, float]) -> None:
    """One block's hits of the queries from number ``low`` on."""
    n = len(head["chunk_ids"])
    fields = sorted({r["field"] for r in rows})
    bound = np.zeros((len(fields), len(queries)))
    content = {r["term"]: r for r in rows if r["field"] == "content"}
    for r in rows:
        bound[fields.index(r["field"]), r["qs"]] += boosts[r["field"]] * r["idf"] * r["most"]
    phrased = [bool(q["sequence"]) and all(t in content for t in q["sequence"]) for q in queries]
    weight = [sum(content[t]["idf"] for t in q["sequence"]) if p else 0.0 for q, p in zip(queries, phrased, strict=True)]
    extra = np.array([PHRASE_BOOST * w * min(content[t]["most"] for t in q["sequence"]) if p else 0.0 for q, p, w in zip(queries, phrased, weight, strict=True)])
    reach = bound.max(axis=0) + extra
    live = np.flatnonzero((reach > 0) & (reach >= best.least[low : low + len(queries)] - 1e-5))
    if not len(live):
        return
    place = np.full(len(queries), -1)
    place[live] = np.arange(len(live))
    score = np.zeros((len(fields), len(live), n))
    for r in rows:
        qs = place[r["qs"]]
        qs = qs[qs >= 0]
        if len(qs):
            score[fields.index(r["field"])][np.ix_(qs, r["chunks"])] += boosts[r["field"]] * r["idf"] * r["parts"]
    total = score.max(axis=0) if len(fields) else np.zeros((len(live), n))
    ids = head["chunk_ids"]
    for i, q in enumerate(live.tolist()):
        query, own = queries[q], total[i]
        if phrased[q]:
            numbers, times = _occurrences({t: (content[t]["chunks"], content[t]["flat"], content[t]["counts"]) for t in query["sequence"]}, query["sequence"])
            if len(numbers):
                parts = np.zeros(n)
                parts[content[query["sequence"][0]]["chunks"]] = content[query["sequence"][0]]["length_part"]
                norm = parts[numbers]
                own[numbers] += PHRASE_BOOST * weight[q] * times * (DEFAULTS.bm25_k1 + 1) / (times + norm)
        fits = own > 0
        if query["type_filter"] is not None:
            fits &= head["types"] == query["type_filter"]
        if query["domains"]:
            fits &= np.isin(head["domains"], query["domains"])
        at = np.flatnonzero(fits)
        if len(at) > 4 * best.k:
            at = at[own[at] >= np.partition(own[at], -best.k)[-best.k] - 1e-5]
        best.add(low + q, np.round(own[at], 6), ids[at])


def _walk(k: int, boosts: dict[str, float], id_type: pa.DataType, at_once: int):
    """Over rows sorted by batch and block, a batch's queries and a block's head first: the best k hits of each query
    in this partition."""
    schema = pa.schema([("query_id", id_type), ("chunk_id", pa.int64()), ("score", pa.float64())])

    def given(best):
        for q, (scores, ids) in zip(best.queries, best.hits, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([q["query_id"]] * len(ids), id_type), pa.array(ids), pa.array(scores)], schema=schema)

    def run(batches):
        best = head = None
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                if cell["is_head"].as_py():
                    if head is not None:
                        _block(best, head, rows, boosts, at_once)
                    rows, head = [], None
                    if cell["queries"].is_valid:
                        if best is not None:
                            yield from given(best)
                        best = _Best(cell["queries"].as_py(), k)
                    else:
                        head = {"chunk_ids": cell["chunk_ids"].values.to_numpy(), "types": np.array(cell["types"].as_py(), object), "domains": np.array(cell["domains"].as_py(), object)}
                    continue
                positions = cell["positions"].values
                row = {"field": cell["field"].as_py(), "term": cell["term"].as_py(), "idf": cell["idf"].as_py(), "most": cell["most"].as_py(), "qs": cell["qs"].values.to_numpy(), "chunks": cell["chunks"].values.to_numpy(), "parts": cell["parts"].values.to_numpy()}
                if row["field"] == "content":
                    counts = positions.value_lengths().to_numpy()
                    # part = tf (k1 + 1) / (tf + x), so x follows from the part
                    row |= {"counts": counts, "flat": positions.flatten().to_numpy(), "length_part": counts * (DEFAULTS.bm25_k1 + 1) / row["parts"] - counts}
                rows.append(row)
        if head is not None:
            _block(best, head, rows, boosts, at_once)
        if best is not None:
            yield from given(best)

    return run


def search(index: KeywordIndex, queries: DataFrame, k: int = DEFAULTS.channel_k, boosts: dict[str, float] = BOOSTS, batch: int = BATCH, dealt: int = DEALT) -> DataFrame:
    """(query_id, chunk_id, score, source, rank): the best k chunks of each query (query_id, query, and where there
    type_filter, one chunk type, and domains, an array of business domains). Filters act before the k are taken.

    Null query ids are left out; a query without known terms has no hits; of a repeated query_id the hits are those
    of its first query in order of text."""
    spark = queries.sparkSession
    column = lambda c, kind: F.col(c).cast(kind).alias(c) if c in queries.columns else F.lit(None).cast(kind).alias(c)
    asked = queries.where("query_id is not null").groupBy("query_id").agg(F.min(F.struct(F.coalesce("query", F.lit("")).alias("query"), column("type_filter", "string"), column("domains", "array<string>"))).alias("q"))
    asked = stored(asked.select("query_id", tokens(F.col("q.query")).alias("sequence"), "q.type_filter", "q.domains"))
    batches = max(1, -(-asked.read().count() // dealt))
    own = Window.partitionBy("batch").orderBy("query_id")
    numbered = asked.read().withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int")).withColumn("q", (F.row_number().over(own) - 1).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("q", "query_id", "sequence", "type_filter", "domains")))
    batch_rows = numbered.groupBy("batch").agg(listed.alias("queries"))
    words = numbered.select("batch", "q", F.explode(F.array_distinct("sequence")).alias("term"))
    known = index.terms.read().join(F.broadcast(index.stats.read()), "field")
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    used = index.postings.read()
    asked_terms = stored(words.select("term").distinct())
    if asked_terms.read().count() <= TOLD:
        # other rows stay where they are
        used = used.join(F.broadcast(asked_terms.read()), "term", "left_semi")
    weighed = words.join(known, "term").groupBy("batch", "term", "field").agg(F.first(idf).alias("idf"), F.sort_array(F.collect_list("q")).alias("qs")).select("*", salts)
    used = used.withColumn("salt", F.pmod("block", F.lit(SALTS)))
    hits = used.join(weighed, ["term", "field", "salt"]).select("batch", "block", F.lit(False).alias("is_head"), "field", "term", "idf", "most", "qs", "chunks", "parts", "positions")
    each_batch = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = lambda df: df.withColumn("part", F.pmod("block", F.lit(n)).cast("int"))
    heads = part(index.directory.read().select("*", each_batch)).withColumn("is_head", F.lit(True))
    # a part without blocks needs no queries
    used_parts = heads.select("part").distinct()
    told = batch_rows.join(used_parts, how="cross").select("batch", "part", F.lit(-1).alias("block"), F.lit(True).alias("is_head"), "queries")
    rows = told.unionByName(heads, allowMissingColumns=True).unionByName(part(hits), allowMissingColumns=True).repartitionById(n, F.col("part")).sortWithinPartitions("batch", "block", F.desc("is_head"))
    kind = queries.schema["query_id"].dataType
    best = rows.mapInArrow(_walk(k, dict(boosts), to_arrow_type(kind), batch), f"query_id {kind.simpleString()}, chunk_id long, score double")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", F.lit("bm25").alias("source"), "rank")
