"""Exact removal of repeated byte strings by column-wise suffix sorting.

A byte goes if it is covered by a string of ``length`` bytes that also starts in
a document with a smaller id. The work is cut by content, so no task sees more
than its share:

1. Each window of ``length`` bytes is keyed by the smallest hash of its short
   strings (its anchor). Neighbouring windows with one anchor form a run. Runs
   whose anchor occurs in a single document cannot repeat and end here; only
   hashes and places are shuffled for this, combined within each chunk first.
2. The remaining runs' bytes are read from their documents. Equal runs are one
   run of the smallest id from here on; the others are known to be repeats.
3. The runs of a bucket are a collection of short texts, aligned at their
   anchors. It is sorted column by column from the right: each round inserts one
   symbol of every text, which updates the order of all suffixes (the column of
   the Burrows-Wheeler transform) and their common prefixes from the last
   round's. The columns and the state pass through sequential files. Suffixes
   with a common prefix of ``length`` are equal windows.
4. The removed places go back to their documents.

Equal windows have equal anchors at equal places, so no repeat is missed, and
the comparison is of bytes, so none is wrong.

Defined cases: null text counts as empty; a text shorter than ``length`` keeps
all its bytes; rows that repeat a doc_id are compared with other ids only; a null
doc_id counts as larger than all others. Long texts are read in segments.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import deal, documents_in, gather, pack, pack_documents
from .common import CHUNK_BYTES, cuts, group_starts, mix, partitions

LENGTH, ANCHOR = 50, 16
PAD = 0xFF  # never a byte of UTF-8
LAST = np.iinfo(np.int64).max


def hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the 16 bytes from each position on."""
    n = len(data) - ANCHOR + 1
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    words = np.empty(n + 8 + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")
        mine = words[k::8]
        mine[:] = part[: len(mine)]
    return mix(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[8 : n + 8]))


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, first window, windows, bytes left of the anchor) of the runs of texts that end at ``ends``."""
    w = length - ANCHOR + 1
    if len(data) < length:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    h = hashes(data)
    bits = np.uint64(int(len(data)).bit_length())
    key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    anchor = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    window = np.arange(len(anchor))
    start = np.concatenate([[0], ends[:-1]])
    owner_end = np.repeat(ends, ends - start)[: len(anchor)]
    good = window + length <= owner_end
    new = good.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~good[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(good & ~np.concatenate([good[1:] & ~new[1:], [False]]))
    return h[anchor[first]], first, stop - first + 1, anchor[first] - first


def segments(text: bytes, length: int):
    """(offset, bytes) so that each window of a text is in one segment."""
    for at in range(0, max(1, len(text) - length + 1), CHUNK_BYTES):
        yield at, text[at : at + CHUNK_BYTES + length - 1]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int32)


def short(h: np.ndarray) -> np.ndarray:
    """The upper half of the hashes. Within a bucket it tells them apart; two that it does not cost a comparison."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _find(buckets: int, length: int):
    """Runs whose anchor a chunk has in several documents go on to their documents; of the
    others, hashes and places go to the hash's bucket."""

    def chunk(parts):
        data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        ends = np.cumsum([len(p[3]) for p in parts])
        h, first, n, left = runs(data, ends, length)
        of = np.searchsorted(ends, first, side="right")
        doc, twin, home, base = (np.array([p[i] for p in parts], t)[of] for i, t in ((0, np.int64), (1, np.int32), (4, np.int32), (2, np.int64)))
        at = (first - np.concatenate([[0], ends[:-1]])[of] + base).astype(np.int64)
        order = np.lexsort((doc, h))
        starts = group_starts(h[order])
        stops = np.append(starts[1:], len(h)) - 1
        several = doc[order][starts] != doc[order][stops]
        many = np.empty(len(h), bool)
        many[order] = np.repeat(several, stops - starts + 1)
        place = (doc, twin, at.astype(np.int32), n.astype(np.uint8), left.astype(np.uint8))
        for to, blob in deal(home[many], *[x[many] for x in place]):
            yield to % buckets, 1, to, blob
        seen = h[order][starts][several]
        for to, blob in deal(bucket_of(seen, buckets), short(seen)):
            yield to, 2, 0, blob
        one = ~many
        for to, blob in deal(bucket_of(h[one], buckets), short(h[one]), *[x[one] for x in place], home[one]):
            yield to, 0, 0, blob

    def run(batches):
        for batch in batches:
            ids, twins, homes = (batch.column(c).to_pylist() for c in ("doc_id", "twin", "home"))
            parts, size = [], 0
            for i, text in enumerate(batch.column("text")):
                for base, piece in segments(text.as_py() or b"", length):
                    if len(piece) < length:
                        continue
                    parts.append((ids[i], twins[i], base, piece, homes[i]))
                    size += len(piece)
                    if size >= CHUNK_BYTES:
                        yield from _rows(chunk(parts))
                        parts, size = [], 0
            if parts:
                yield from _rows(chunk(parts))

    return run


def _rows(made):
    if made := list(made):
        to, kind, home, blob = zip(*made, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(home, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "home", "blob"])


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket of anchors: the places of those that several documents have."""
    kinds, homes, blobs = (table.column(c).to_pylist() for c in ("kind", "home", "blob"))
    out = [(h, b) for k, h, b in zip(kinds, homes, blobs, strict=True) if k == 1]
    known = gather([b for k, b in zip(kinds, blobs, strict=True) if k == 2], 1)[0]
    singles = [b for k, b in zip(kinds, blobs, strict=True) if k == 0]
    if singles:
        h, doc, twin, at, n, left, home = gather(singles, 7)
        order = np.lexsort((doc, h))
        starts = group_starts(h[order])
        stops = np.append(starts[1:], len(h)) - 1
        many = np.empty(len(h), bool)
        many[order] = np.repeat(doc[order][starts] != doc[order][stops], stops - starts + 1)
        many |= np.isin(h, known)
        out += deal(home[many], doc[many], twin[many], at[many], n[many], left[many])
    return pa.table({"home": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})


def aligned(data: np.ndarray, start: np.ndarray, n: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """One row for each run, its anchor in a fixed column, padded on both sides."""
    w = length - ANCHOR
    width = (w + length + 7) // 8 * 8
    out = np.full((len(start), width), PAD, np.uint8)
    column = np.arange(width)
    for k in range(0, len(start), 10_000):
        lead = (w - left[k : k + 10_000].astype(np.int64))[:, None]
        inside = (column >= lead) & (column < lead + n[k : k + 10_000, None].astype(np.int64) + length - 1)
        at = start[k : k + 10_000, None] - lead + column
        out[k : k + 10_000][inside] = data[at[inside]]
    return out


def distinct(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, repeats): of equal rows those of the smallest document, and those of other documents."""
    words = rows.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * np.uint64(31) + words[:, k])
    order = np.lexsort((doc, h))
    starts = group_starts(h[order])
    head = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    same = (rows[order] == rows[head]).all(axis=1)
    later = same & (doc[order] > doc[head])
    return order[~later], order[later]


def _cut_out(buckets: int, length: int):
    """The runs asked for, with their bytes, for the sorting; equal ones of later documents are repeats."""

    def run(key, documents: pa.Table, asked: pa.Table) -> pa.Table:
        blobs = asked.column("blob").to_pylist()
        if not blobs or not documents.num_rows:
            return _sorted_rows([])
        doc, twin, at, n, left = gather(blobs, 5)
        at = at.astype(np.int64)
        ids, twins, sizes, data = documents_in(documents)
        places = dict(zip(zip(ids.tolist(), twins.tolist(), strict=True), (np.cumsum(sizes) - sizes).tolist(), strict=True))
        order = np.lexsort((at, twin, doc))
        doc, twin, at, n, left = (x[order] for x in (doc, twin, at, n, left))
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])
        base = np.repeat([places[(int(doc[i]), int(twin[i]))] for i in new], np.diff(np.append(new, len(doc))))
        out = []
        for k in range(0, len(doc), 100_000):
            part = slice(k, k + 100_000)
            rows = aligned(data, base[part] + at[part], n[part], left[part], length)
            kept, later = distinct(rows, doc[part])
            kept.sort()
            d, t, a, m, e = (x[part] for x in (doc, twin, at, n, left))
            if len(later):
                out.append((key[0].as_py() % buckets, key[0].as_py(), pack(d[later], t[later], a[later], a[later] + m[later] + length - 1)))
            anchor = np.ascontiguousarray(rows[kept][:, length - ANCHOR : length]).view("<u8")
            h = mix(anchor[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ mix(anchor[:, 1]))
            bucket = bucket_of(h, buckets)
            by = np.argsort(bucket, kind="stable")
            kept, bucket = kept[by], bucket[by]
            bounds = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                r = kept[x:y]
                out.append((int(bucket[x]), -1, pack(rows[r][rows[r] != PAD], d[r], t[r], a[r], m[r], e[r], np.full(len(r), key[0].as_py(), np.int32))))
        return _sorted_rows(out)

    return run


def _sorted_rows(out) -> pa.Table:
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "home": pa.array([x[1] for x in out], pa.int32()), "blob": pa.array([x[2] for x in out], pa.binary())})


class Columns:
    """Arrays of one kind kept one after another in a file that is deleted with the object."""

    def __init__(self, kind):
        self.file, self.kind = tempfile.TemporaryFile(), np.dtype(kind)

    def write(self, array: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(array, self.kind).data)

    def read(self, index: int, n: int) -> np.ndarray:
        self.file.seek(index * n * self.kind.itemsize)
        return np.frombuffer(self.file.read(n * self.kind.itemsize), self.kind)

    def replace(self, array: np.ndarray) -> None:
        self.file.seek(0)
        self.write(array)


def least_between(prefixes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of prefixes[low..high] for each pair."""
    table, span = [prefixes], 1
    while span * 2 <= len(prefixes):
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        span *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), prefixes.dtype)
    for k in np.unique(level):
        i = np.flatnonzero(level == k)
        out[i] = np.minimum(table[k][low[i]], table[k][high[i] - (1 << int(k)) + 1])
    return out


def sort_columns(rows: np.ndarray, visit) -> None:
    """Sorts all suffixes of the aligned texts column by column, from the right.

    visit(column, order, prefixes) gets the texts in the order of their suffixes
    from ``column`` on, and each suffix's common prefix with the one before.
    """
    n, width = rows.shape
    columns, order_file, prefix_file = Columns(np.uint8), Columns(np.int32), Columns(np.uint8)
    for c in range(width - 1, -1, -1):
        columns.write(rows[:, c])
    order_file.replace(np.arange(n))
    prefix_file.replace(np.zeros(n))
    for k in range(width):
        order, prefixes = order_file.read(0, n), prefix_file.read(0, n)
        symbols = columns.read(k, n)[order]
        by = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[by]
        same = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
        made = np.zeros(n, np.uint8)
        if k and len(same):
            made[same] = np.minimum(least_between(prefixes, by[same - 1] + 1, by[same]), 254) + 1
        elif len(same):
            made[same] = 1
        order = order[by]
        visit(width - 1 - k, order, made)
        order_file.replace(order)
        prefix_file.replace(made)


def _equal_windows(length: int):
    """Of a bucket of runs: the places to remove, for their documents."""

    def run(table: pa.Table) -> pa.Table:
        homes, blobs = table.column("home").to_pylist(), table.column("blob").to_pylist()
        out = [(h, b) for h, b in zip(homes, blobs, strict=True) if h >= 0]
        given = [b for h, b in zip(homes, blobs, strict=True) if h < 0]
        if given:
            data, doc, twin, at, n, left, home = gather(given, 7)
            size = n.astype(np.int64) + length - 1
            rows = aligned(data, np.cumsum(size) - size, n, left, length)
            kept, later = distinct(rows, doc)
            stop = at + size
            out += deal(home[later], doc[later], twin[later], at[later], stop[later])
            w = length - ANCHOR
            rows, d, lead = rows[kept], doc[kept], w - left[kept].astype(np.int64)
            last = lead + n[kept]
            removed = np.zeros((len(kept), w + 1), bool)

            def visit(column, order, prefixes):
                if column > w:
                    return
                group = np.cumsum(prefixes < length)
                good = (lead[order] <= column) & (column < last[order])
                group, order = group[good], order[good]
                if len(order):
                    starts = group_starts(group)
                    least = np.minimum.reduceat(d[order], starts)
                    removed[order, column] = d[order] > np.repeat(least, np.diff(np.append(starts, len(order))))

            if len(rows) > 1:
                sort_columns(rows, visit)
            edge = np.diff(np.pad(removed.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            r, c = np.nonzero(edge == 1)
            _, e = np.nonzero(edge == -1)
            k = kept[r]
            begin = at[k] + c - lead[r]
            out += deal(home[k], doc[k], twin[k], begin, begin + (e - c) + length - 1)
        return pa.table({"home": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    return run


def _finish(schema: pa.Schema, texts: bool):
    def run(key, documents: pa.Table, places: pa.Table) -> pa.Table:
        doc, twin, start, stop = gather(places.column("blob").to_pylist(), 4)
        order = np.lexsort((start, twin, doc))
        doc, twin, start, stop = (x[order] for x in (doc, twin, start, stop))
        of: dict = {}
        if len(doc):
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])
            for a, b in zip(new, np.append(new[1:], len(doc)), strict=True):
                of[(int(doc[a]), int(twin[a]))] = (a, b)
        out: dict = {f.name: [] for f in schema}
        ids, twins, sizes, data = documents_in(documents)
        data = data.tobytes()
        for d, t, z, w in zip(ids.tolist(), twins.tolist(), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            text, spans, real = data[z : z + w], [], None if d == LAST else d
            if (d, t) in of:
                a, b = of[(d, t)]
                reach = np.maximum.accumulate(stop[a:b])
                first = np.flatnonzero(np.r_[True, start[a + 1 : b] > reach[:-1]])
                spans = list(zip(start[a:b][first].tolist(), reach[np.append(first[1:], b - a) - 1].tolist(), strict=True))
            at, kept = 0, []
            for x, y in spans:
                kept.append(text[at:x])
                at = y
            kept.append(text[at:])
            rest = b"".join(kept)
            for name, value in (("doc_id", real), ("n_bytes", len(text)), ("n_removed", len(text) - len(rest)), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("spans", [{"start": x, "stop": y} for x, y in spans]), ("kept", rest)):
                if name in out:
                    out[name].append(value)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, texts: bool = True, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of struct(start, stop)) and,
    with ``texts``, the bytes ``kept`` of every row of ``documents`` (doc_id, text)."""
    buckets = buckets or partitions(documents.sparkSession)
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"),
        F.hash("text").alias("twin"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"),
    ).withColumn("home", F.pmod(F.hash("doc_id"), F.lit(buckets)).cast("int"))
    texts_by_home = pack_documents(rows, buckets, 4 * CHUNK_BYTES)
    found = rows.select("doc_id", "twin", "home", "text").mapInArrow(_find(buckets, length), "bucket int, kind int, home int, blob binary")
    asked = found.groupBy("bucket").applyInArrow(_repeated, "home int, blob binary")
    cut = texts_by_home.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(_cut_out(buckets, length), "bucket int, home int, blob binary")
    places = cut.groupBy("bucket").applyInArrow(_equal_windows(length), "home int, blob binary")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
    if texts:
        fields.append(("kept", pa.binary()))
        out += ", kept binary"
    return texts_by_home.groupBy("home").cogroup(places.groupBy("home")).applyInArrow(_finish(pa.schema(fields), texts), out)
