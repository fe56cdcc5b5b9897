"""Similarity join on word shingles by a MinHash LSH forest.

A text is its set of hashed five-word shingles; equal sets are one class. A class has
a signature of ``TREES`` strings of ``LEVELS`` MinHash values, made by one permutation:
the least hash of each of TREES x LEVELS bins, where an empty bin takes the value of
the next that is not. Each string is a path in a tree, whose nodes are the common
prefixes.

The join starts with whole strings: classes below one node of the last level are
candidates, which meet in cells of bounded size, and every pair's Jaccard similarity
is computed exactly from the whole sets. A link of similarity s is met by prefixes of
length d with the probability 1 - (1 - s ** d) ** TREES, so the links found so far,
each weighted with its inverse, tell how many there are and what share a prefix length
finds. The matched prefixes are shortened to the longest length that reaches the target
recall, and again as long as the links found then show that it is missed. Where fewer
than ``SURE`` links are known the threshold's own similarity is taken for all. A pair
counts in the first round and tree in which it meets.

Defined cases: null text counts as empty; texts without words link with nothing;
texts of one to four words have one shingle, all their words; repeated rows are
copies of each other; rows that repeat a doc_id with other texts are documents of their
own; a null doc_id counts as larger than all others and is returned as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix, written
from .embeddings import forest
from .graph import blocks, components
from .lines import only_wanted
from .passages import WordHashes, grams, words
from .repeats import LAST

TREES, LEVELS, RECALL, BLOCK = 16, 8, 0.995, 512
#: Keys of 64 bits that are broadcast at most.
FEW_KEYS = 1 << 20
SHINGLE, THRESHOLD = 5, 0.8
#: Links from which the share that a prefix length finds is estimated; and the steps of similarity they are counted in.
SURE, STEPS = 1000, 50


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that two sets share a prefix in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(seen: dict[int, int], threshold: float, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> int:
    """The longest prefix that reaches the recall, for links of the similarities ``seen`` (step: number of links)."""
    links = {max(threshold, k / STEPS): n for k, n in seen.items()}
    if sum(links.values()) < SURE:
        links = {threshold: 1}
    for depth in range(levels, 1, -1):
        if sum(links.values()) >= recall * sum(n * chance(1.0, depth, trees) / chance(s, depth, trees) for s, n in links.items()):
            return depth
    return 1


def shingles(text: str | None, known: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = words(text, known)
    return np.unique(grams(w, min(k, len(w)))) if len(w) else np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], trees: int = TREES, levels: int = LEVELS) -> np.ndarray:
    """A row of trees x levels values for each set that isn't empty; a level's values of all trees are neighbouring bins."""
    bins, none = trees * levels, np.uint64(1 << 32)
    h = mix(np.concatenate(sets))
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least = np.full(len(sets) * bins, none, np.uint64)
    np.minimum.at(least, row * bins + (h % np.uint64(bins)).astype(np.int64), h >> np.uint64(32))
    least = least.reshape(len(sets), bins)
    place = np.where(least < none, np.arange(bins), 2 * bins)
    place = np.minimum.accumulate(np.concatenate([place, place + bins], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :bins]
    away = place - np.arange(bins)
    lent = np.take_along_axis(least, place % bins, axis=1)
    return (mix(lent + away.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype("<u4")


def _signed(trees: int, levels: int, k: int):
    """Each row's class key and its strings, tree by tree."""

    def run(batches):
        from xxhash import xxh3_128_digest

        known = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = [shingles(text.as_py(), known, k) for text in part.column("text")]
                some = [s for s in sets if len(s)]
                made = signatures(some, trees, levels).reshape(len(some), levels, trees).transpose(0, 2, 1) if some else []
                paths = iter(made)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("twin"), pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([next(paths).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc", "twin", "key", "paths"],
                )

    return run


def _sets(k: int):
    def run(batches):
        known = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                made = [shingles(t.as_py(), known, k).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.binary())], names=["id", "shingles"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, from the values that occur more than once."""
    n = len(sets)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    sizes = np.diff(np.append(starts, len(values)))
    number = np.repeat(np.cumsum(sizes > 1) - 1, sizes)
    shared = np.repeat(sizes > 1, sizes)
    row, number = row[shared], number[shared]
    out = np.zeros((n, n), np.float32)
    step = max(1, (4 << 20) // n)
    bounds = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + step, step))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a < b:
            x = np.zeros((n, step), np.float32)
            x[row[a:b], number[a:b] % step] = 1
            out += x @ x.T
    return out


def _verify(threshold: float, trees: int, levels: int, depth: int, before: int | None):
    """Of one cell: each class's number of links (copies counted), links that hold the cell's groups together
    (n = 0), and how many links there are of each similarity (a is null). Pairs that an earlier tree or round met are left out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies, side = (table.column(c).to_numpy() for c in ("id", "copies", "side"))
        tree, across = table.column("tree")[0].as_py(), table.column("across")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        paths = np.frombuffer(b"".join(table.column("paths").to_pylist()), "<u4").reshape(len(ids), trees, levels)
        size = np.array([len(s) for s in sets], np.float64)
        both = overlaps(sets).astype(np.float64)
        linked = both >= threshold * (size[:, None] + size - both) - 1e-9
        np.fill_diagonal(linked, False)
        if across:
            linked &= side[:, None] != side
        a, b = np.nonzero(np.triu(linked))
        first = np.ones(len(a), bool)
        for i in range(0, len(a), 20_000):
            part = slice(i, i + 20_000)
            equal = paths[a[part]] == paths[b[part]]
            first[part] &= ~equal[:, :tree, :depth].all(axis=2).any(axis=1)
            if before:
                first[part] &= ~equal[:, :, :before].all(axis=2).any(axis=1)
        a, b = a[first], b[first]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        x, y = forest(ids[a], ids[b])
        got = np.flatnonzero(n)
        steps, links = np.unique(np.floor(both[a, b] / (size[a] + size[b] - both[a, b]) * STEPS + 1e-9).astype(np.int64), return_counts=True)
        return pa.table(
            {
                "a": pa.array([*ids[got].tolist(), *x, *[None] * len(steps)], pa.int64()),
                "b": pa.array([*ids[got].tolist(), *y, *steps.tolist()], pa.int64()),
                "n": pa.array([*n[got].tolist(), *[0] * len(x), *links.tolist()], pa.int64()),
            }
        )

    return run


def _met(classes: DataFrame, trees: int, levels: int, depth: int, before: int | None, block: int) -> DataFrame:
    """(cell, tree, across, id, side) of classes that share a prefix of ``depth`` values; equal cells of several trees count once.
    Nodes whose classes all share the prefix of ``before`` values too, so that all their pairs have met, are left out."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    prefix = lambda n: F.xxhash64("tree", F.substr("paths", F.col("tree") * (4 * levels) + 1, F.lit(4 * n)))
    in_trees = classes.select("id", "paths", tree).select("id", "tree", prefix(depth).alias("prefix"), (prefix(before) if before else F.col("id")).alias("deeper"))
    sizes = in_trees.groupBy("tree", "prefix").agg(F.count("*").alias("size"), F.min("deeper").alias("a"), F.max("deeper").alias("b")).where("size > 1 and a <> b").select("tree", "prefix", "size")
    in_trees = in_trees.drop("deeper")
    dealt = blocks(in_trees.join(sizes, ["tree", "prefix"]), "prefix", "size", block, "id")
    cells = dealt.groupBy("tree", "prefix", "i", "j").agg(F.array_sort(F.collect_list(F.struct("id", "side"))).alias("members")).where("size(members) > 1")
    cells = cells.groupBy("members").agg(F.min(F.struct("tree", (F.col("i") != F.col("j")).alias("across"))).alias("of"))
    return cells.select(F.xxhash64("members", "of.tree").alias("cell"), "of.tree", "of.across", F.explode("members").alias("m")).select("cell", "tree", "across", "m.id", "m.side")


def _links(rows: DataFrame, classes: DataFrame, threshold: float, k: int, trees: int, levels: int, recall: float, block: int) -> DataFrame:
    """The rows of ``_verify`` of all rounds."""
    found, depth, before, seen = None, levels, None, {}
    while True:
        placed = durable(_met(classes, trees, levels, depth, before, block))
        key = F.xxhash64("doc", "twin").alias("key")
        wanted = durable(classes.join(placed.select("id").distinct(), "id", "left_semi").select("id", "doc", "twin", key))
        keyed = rows.select("doc", "twin", "text", key)
        few = wanted.count() <= FEW_KEYS  # their keys are broadcast; beyond that a bitmap of them, of at most 16 MB
        picked = keyed.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi") if few else only_wanted(keyed, wanted, "key")
        texts = picked.drop("key").join(wanted.drop("key"), ["doc", "twin"])
        sets = texts.select("id", "text").mapInArrow(_sets(k), "id bigint, shingles binary")
        whole = sets.dropDuplicates(["id"]).join(classes.select("id", "copies", "paths"), "id")
        made = durable(placed.join(whole, "id").groupBy("cell").applyInArrow(_verify(threshold, trees, levels, depth, before), "a bigint, b bigint, n bigint"))
        found = made if found is None else found.unionByName(made)
        for r in made.where("a is null").groupBy("b").agg(F.sum("n").alias("n")).collect():
            seen[r["b"]] = seen.get(r["b"], 0) + r["n"]
        least = prefix_depth(seen, threshold, trees, levels, recall)
        if least >= depth:
            return found
        depth, before = least, depth


def linked_rows(documents: DataFrame, threshold: float, k: int, trees: int, levels: int, recall: float, block: int) -> DataFrame:
    """doc, twin (which tell rows apart), class_doc, first (doc and twin of the component's first) and n_links of every row."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("twin"), "text")
    signed = written(rows.mapInArrow(_signed(trees, levels, k), "doc bigint, twin bigint, key binary, paths binary"))
    same = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("doc", "twin")).alias("first"), F.count("*").alias("copies"), F.first("paths").alias("paths"))
    classes = written(same.select(F.monotonically_increasing_id().alias("id"), "key", "first.doc", "first.twin", "copies", "paths"))
    found = _links(rows, classes, threshold, k, trees, levels, recall, block)
    counts = found.where("a is not null and n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = durable(components(found.where("n = 0")))
    firsts = groups.join(classes.select("id", "doc", "twin"), "id").groupBy("component").agg(F.min(F.struct("doc", "twin")).alias("first"))
    known = classes.select("id", "key", "doc", "twin", "copies").join(counts, "id", "left").join(groups.join(firsts, "component").select("id", "first"), "id", "left")
    known = known.select("key", F.col("doc").alias("class_doc"), F.coalesce("first", F.struct("doc", "twin")).alias("first"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = signed.select("doc", "twin", "key").join(known, "key", "left")
    return out.select("doc", "twin", F.coalesce("class_doc", "doc").alias("class_doc"), F.coalesce("first", F.struct("doc", "twin")).alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(documents: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the smallest doc_id with the same shingles), component_id (the smallest doc_id
    reachable by links), n_links (other rows linked directly) and kept (it is the component's first
    document by doc_id) of every row of ``documents`` (doc_id, text)."""
    out = linked_rows(documents, threshold, k, trees, levels, recall, block)
    real = lambda c: F.when(c != int(LAST), c)
    kept = (F.col("doc") == F.col("first.doc")) & (F.col("twin") == F.col("first.twin"))
    return out.select(real(F.col("doc")).alias("doc_id"), real(F.col("class_doc")).alias("class_id"), real(F.col("first.doc")).alias("component_id"), "n_links", kept.alias("kept"))


def keep_one(documents: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``documents`` without near copies: of each component its first document stays. Rows that repeat a doc_id and its text stay or go together."""
    gone = linked_rows(documents, threshold, k, trees, levels, recall, block).where((F.col("doc") != F.col("first.doc")) | (F.col("twin") != F.col("first.twin"))).select("doc", "twin").distinct()
    given = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("twin"))
    return given.join(gone, ["doc", "twin"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
