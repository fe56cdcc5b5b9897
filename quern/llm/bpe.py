"""Byte-level BPE encoding and decoding by length-bucketed padded matrices.

Texts are cut into pieces by the vocabulary's pattern. The distinct pieces of a
batch that are no token themselves become rows of padded id matrices, one matrix
per length class. In each round every row merges its leftmost pair of minimum
rank; the pairs' ranks come from an open-addressing hash table that is probed
with whole arrays; finished rows leave the matrix and the merged position is
closed up. Rows too long for a matrix are merged with a heap, with the same
order of merges.

Null text counts as empty; an empty text has no ids and decodes to no bytes.
Clashing extra columns are kept; the output columns replace columns of the same
name.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cuts

NONE = np.int32(2**31 - 1)
#: Longest piece, in bytes, that is merged in a matrix.
WIDEST = 256
#: Distinct pieces whose ids a worker remembers between batches.
REMEMBERED = 300_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of a byte-level BPE and the hash table of its mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it can't merge or a side is padding."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.int64) << 32 | right[at]
        slots, where, found = self._slots(keys), np.arange(len(keys)), np.full(len(keys), NONE, np.int32)
        while len(where):
            there = self.keys[slots]
            hit = there == keys
            found[where[hit]] = self.values[slots[hit]]
            more = ~hit & (there != -1)
            keys, where, slots = keys[more], where[more], (slots[more] + 1) & self.mask
        out[at] = found
        return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())})


def merge_matrix(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """The ids of pieces of similar length, merged together round by round."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = int(sizes.max())
    ids = np.full((len(pieces), width), -1, np.int32)
    ids[np.arange(width) < sizes[:, None]] = vocabulary.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    ranks = vocabulary.rank_of(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), NONE, np.int32)
    out: list = [None] * len(pieces)
    rows = np.arange(len(pieces))
    while len(rows):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
        if (ended := least == NONE).any():
            for row, have in zip(rows[ended], ids[ended], strict=True):
                out[row] = have[have >= 0].tolist()
            going = ~ended
            rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
            if not len(rows):
                break
        line = np.arange(len(rows))
        columns = np.arange(ids.shape[1] - 1)
        ids[line, at] = least
        ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
        columns = columns[:-1]
        ranks = np.take_along_axis(ranks, columns + (columns > at[:, None]), axis=1)
        right = at < ranks.shape[1]
        ranks[line[right], at[right]] = vocabulary.rank_of(ids[line[right], at[right]], ids[line[right], at[right] + 1])
        left = at > 0
        ranks[line[left], at[left] - 1] = vocabulary.rank_of(ids[line[left], at[left] - 1], ids[line[left], at[left]])
        if (used := int((ids >= 0).sum(axis=1).max())) < ids.shape[1]:
            ids, ranks = ids[:, :used], ranks[:, : max(0, used - 1)]
    return out


def merge_long(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """The ids of one long piece: the same merges, the next one taken from a heap."""
    ids = [int(vocabulary.of_byte[b]) for b in piece]
    n, pairs = len(ids), vocabulary.pairs
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (new := pairs.get(ids[k] << 32 | ids[after[k]])) is not None:
                heapq.heappush(heap, (new, k, ids[k], ids[after[k]]))
    return [x for x in ids if x >= 0]


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """The ids of each piece, in order."""
    out: list = [None] * len(pieces)
    classes: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        if (whole := vocabulary.ranks.get(piece)) is not None:
            out[i] = [whole]
        elif len(piece) > WIDEST:
            out[i] = merge_long(vocabulary, piece)
        else:
            classes.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
    for bits, members in classes.items():
        step = max(1, (1 << 20) >> bits)
        for k in range(0, len(members), step):
            some = members[k : k + step]
            for i, ids in zip(some, merge_matrix(vocabulary, [pieces[i] for i in some]), strict=True):
                out[i] = ids
    return out


def _encoder(vocabulary_path: str, pattern: str, column: str, schema: pa.Schema, decode: bool):
    def run(batches):
        import regex

        vocabulary, cut = load(vocabulary_path), regex.compile(pattern)
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
            for a, b in cuts(sizes):
                part = batch.slice(a, b - a)
                texts = [cut.findall(t or "") for t in part.column(column).to_pylist()]
                new = list({p for pieces in texts for p in pieces} - known.keys())
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list({p for pieces in texts for p in pieces})
                for piece, ids in zip(new, encode_pieces(vocabulary, [p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
                    known[piece] = np.array(ids, np.int32)
                ids = [np.concatenate([known[p] for p in pieces]) if pieces else np.zeros(0, np.int32) for pieces in texts]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                made = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))}
                if decode:
                    made["decoded"] = pa.array([decode_ids(vocabulary, x) for x in ids], pa.binary())
                columns = [made.get(f.name, None) if f.name in made else part.column(f.name) for f in schema]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def decode_ids(vocabulary: Vocabulary, ids) -> bytes:
    """The bytes of a list of ids; an id outside the vocabulary is an error."""
    if len(ids) and (min(ids) < 0 or max(ids) >= len(vocabulary.tokens)):
        raise ValueError("id outside the vocabulary")
    return b"".join(map(vocabulary.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def encode(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] | None = None, decode: bool = False) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``ids``, and with ``decode`` the bytes ``decoded``
    that the ids stand for. The vocabulary file must be readable under that path on every executor."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = tuple(c for c in (keep if keep is not None else df.columns) if c not in ("ids", "decoded"))
    fields = [df.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decode
    schema = T.StructType(fields)
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(_encoder(vocabulary_path, pattern, text, to_arrow_schema(schema), decode), schema)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``df`` with the bytes ``decoded`` of the id lists; null ids decode to no bytes."""

    @F.pandas_udf(T.BinaryType())
    def decoded(column):
        vocabulary = load(vocabulary_path)
        return column.map(lambda x: decode_ids(vocabulary, x) if x is not None else b"")

    return df.withColumn("decoded", decoded(F.col(ids)))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and bytes from encode(decode=True)."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
