"""Arrays packed into one compressed value, so that a shuffle moves few large rows."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard

_KINDS = (np.uint8, np.int32, np.int64, np.uint64, np.uint32, np.uint16)


def pack(*arrays: np.ndarray) -> bytes:
    """Signed integers as differences, and all bytes of one significance together, so that they compress."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        kind = next(i for i, k in enumerate(_KINDS) if a.dtype == k)
        head.append(struct.pack("<BQ", kind, len(a)))
        a = np.diff(a, prepend=a.dtype.type(0)) if a.dtype.kind == "i" else np.ascontiguousarray(a)
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, sizes = 1, []
    for _ in range(data[0]):
        sizes.append(struct.unpack_from("<BQ", data, at))
        at += 9
    out = []
    for kind, n in sizes:
        width = np.dtype(_KINDS[kind]).itemsize
        a = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        a = np.ascontiguousarray(a.T).view(_KINDS[kind]).reshape(n)
        out.append(np.cumsum(a, dtype=a.dtype) if a.dtype.kind == "i" else a)
        at += n * width
    return out


def gather(blobs, n: int) -> list[np.ndarray]:
    """The arrays of several packed values, end to end; n of them if there are no values."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n


def deal(target: np.ndarray, *arrays: np.ndarray):
    """(target, packed arrays) for each value of ``target``."""
    order = np.argsort(target, kind="stable")
    target, arrays = target[order], [a[order] for a in arrays]
    bounds = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(target) else np.zeros(0, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(target[a]), pack(*[x[a:b] for x in arrays])


def pack_documents(rows, buckets: int, chunk: int):
    """(home, blob) of rows (doc_id, twin, home, text as bytes): a chunk's texts of one home in one value."""

    def run(batches):
        for batch in batches:
            ids, twins, homes = (batch.column(c).to_numpy() for c in ("doc_id", "twin", "home"))
            texts = batch.column("text")
            sizes = pa.compute.binary_length(texts).to_numpy()
            at = 0
            while at < len(ids):
                stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), chunk)))
                members: dict[int, list[int]] = {}
                for i in range(at, min(stop, len(ids))):
                    members.setdefault(int(homes[i]), []).append(i)
                made = []
                for home, some in members.items():
                    data = np.frombuffer(b"".join(texts[i].as_py() for i in some), np.uint8)
                    made.append((home, pack(ids[some].astype(np.int64), twins[some].astype(np.int32), sizes[some].astype(np.int64), data)))
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], names=["home", "documents"])
                at = stop

    return rows.select("doc_id", "twin", "home", "text").mapInArrow(run, "home int, documents binary")


def documents_in(table: pa.Table):
    """(doc_ids, twins, sizes, all bytes) of a group of packed documents."""
    return gather(table.column("documents").to_pylist(), 4)
