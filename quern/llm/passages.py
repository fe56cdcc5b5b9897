"""Fuzzy repeated passages by collinear chaining of shared word seeds.

1. Texts become lower-case words. Of the hashes of each ``K`` words in a row the
   smallest of each ``V`` neighbours are seeds, so a shared run of K + V - 1 words
   has a shared seed. The n-th occurrence of a seed in a text meets the n-th in
   another.
2. Copies are linked with their first text. The texts of a seed are linked each
   with each while they are few (``PAIRS``). A more frequent, hot seed links its
   occurrences to the one in the smallest document, first within a chunk of
   texts, then over the chunks' smallest ones; so that texts which share a passage
   of hot seeds meet although smaller documents hold its phrases singly, runs of
   2, 4, 8 and 16 hot seeds in a row are keys as well, treated alike.
3. A document's links to another document are joined along diagonals and chained
   in order, with costs for gaps; a Fenwick tree over the other document's places
   gives each piece its best forerunner.
4. The other document's words around a chain are fetched, and the chain is
   aligned with the document's own words and extended while it pays. Chains of at
   least ``min_words`` words with an identity of at least ``identity`` are
   passages. Of a chain that fails, the longest part that has the identity is
   judged, then what is left on either side of it.

A row of the result says that the words start..stop of doc_id repeat, more or
less, match_start..match_stop of match_doc_id, which has a smaller id. A text
that occurs in many documents gives each but the smallest a row.

Defined cases: null text counts as empty and texts below ``K`` words have no
seeds; rows that repeat a doc_id are not compared with each other; a null doc_id
counts as larger than all others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import deal, documents_in, gather, pack, pack_documents
from .common import CHUNK_BYTES, group_starts, mix, partitions, written
from .repeats import LAST, _rows, bucket_of, least_between, short

K, V = 5, 6
MIN_WORDS, IDENTITY = 45, 0.8
#: Texts of a key that are all linked with one another, and the seeds of the longest run that is a key.
PAIRS, RUN = 4, 16
#: Words between seeds of one piece, cost of a word of gap, words looked at beyond a chain's ends.
REACH, GAP_COST, BEYOND = 24, 0.2, 48
WORD = re.compile(r"\w+")


class WordHashes(dict):
    """The hash of each word, kept for words already seen."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words(text: str | None, known: WordHashes) -> np.ndarray:
    """The hashes of a text's lower-case words."""
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def grams(w: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of each k words in a row."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return h


def seeds(w: np.ndarray, k: int = K, v: int = V) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the smallest of each v neighbouring hashes; hashes carry their occurrence."""
    h = grams(w, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    low = np.arange(max(1, len(h) - v + 1))
    least = least_between(h, low, np.minimum(low + v, len(h)) - 1)
    taken = np.zeros(len(h), bool)
    for j in range(min(v, len(h))):
        taken[j : j + len(low)] |= h[j : j + len(low)] == least
    at = np.flatnonzero(taken)
    order = at[np.argsort(h[at], kind="stable")]
    starts = group_starts(h[order])
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    out = mix(h[order] + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return order, out


def meet(h, doc, twin, many) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of occurrences of keys: links (index, index of a smaller document's), the occurrences of different texts, by
    key, those of them whose key occurs in more than ``PAIRS`` texts or has the mark ``many``, and each one's centre.

    Copies are linked with their first only, up to ``PAIRS`` texts of a key each with each, more with the smallest."""
    order = np.lexsort((doc, twin, h))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (twin[order][1:] == twin[order][:-1])] if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(h) else order
    copies, firsts = order[same], order[first[same]]
    own = order[~same]
    own = own[np.lexsort((twin[own], doc[own], h[own]))]
    starts = group_starts(h[own])
    sizes = np.diff(np.append(starts, len(own)))
    begin = np.repeat(starts, sizes)
    marked = np.repeat(np.maximum.reduceat(many[own], starts), sizes) if len(own) else np.zeros(0, bool)
    hot = (np.repeat(sizes, sizes) > PAIRS) | marked.astype(bool)
    at = np.arange(len(own))
    pairs = [(copies, firsts), (own[hot & (at > begin)], own[begin[hot & (at > begin)]])]
    for back in range(1, PAIRS):
        later = at[~hot & (at - back >= begin)]
        pairs.append((own[later], own[later - back]))
    i, c = (np.concatenate(x) for x in zip(*pairs, strict=True))
    linked = doc[i] != doc[c]
    return i[linked], c[linked], own, hot, own[begin] if len(own) else own


def _links(h, doc, twin, at, home, many):
    """(links by home, occurrences of different texts, which of them are hot, hot occurrences by home)."""
    i, c, own, hot, centre = meet(h, doc, twin, many)
    order = np.lexsort((at[i], twin[i], doc[i]))
    i, c = i[order], c[order]
    x, z = own[hot], doc[centre[hot]]
    return deal(home[i], doc[i], twin[i], at[i], doc[c], twin[c], at[c], home[c]), own, hot, lambda keep: deal(home[x[keep]], doc[x[keep]], twin[x[keep]], at[x[keep]], h[x[keep]] if h.dtype == np.uint32 else short(h[x[keep]]), z[keep])


def _seed(buckets: int, k: int, v: int):
    def chunk(parts):
        h = np.concatenate([p[1] for p in parts])
        n = [len(p[1]) for p in parts]
        at = np.concatenate([p[0] for p in parts]).astype(np.int32)
        doc, twin, home = (np.repeat(np.array([p[i] for p in parts], t), n) for i, t in ((2, np.int64), (3, np.int32), (4, np.int32)))
        made, own, hot, marks = _links(h, doc, twin, at, home, np.zeros(len(h), np.uint8))
        for to, blob in made:
            yield to % buckets, 1, to, blob
        # of a hot key only the smallest document goes on, and its bucket marks that one
        later = np.r_[False, h[own][1:] == h[own][:-1]] if len(own) else np.zeros(0, bool)
        for to, blob in marks(later[hot]):
            yield to % buckets, 2, to, blob
        on = ~(hot & later)
        heads, many = own[on], hot[on].astype(np.uint8)
        order = np.argsort(heads, kind="stable")
        heads, many = heads[order], many[order]
        for to, blob in deal(bucket_of(h[heads], buckets), short(h[heads]), doc[heads], twin[heads], at[heads], home[heads], many):
            yield to, 0, 0, blob

    def run(batches):
        known = WordHashes()
        for batch in batches:
            ids, twins, homes = (batch.column(c).to_pylist() for c in ("doc_id", "twin", "home"))
            parts, size = [], 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py().decode("utf-8", "replace")
                place, h = seeds(words(text, known), k, v)
                if len(h):
                    parts.append((place, h, ids[i], twins[i], homes[i]))
                    size += len(text)
                if size >= 2 * CHUNK_BYTES:
                    yield from _rows(chunk(parts))
                    parts, size = [], 0
            if parts:
                yield from _rows(chunk(parts))

    return run


def _table(rows: list[tuple], *names: str) -> pa.Table:
    kinds = {"blob": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, kinds.get(n, pa.int32())) for n, c in zip(names, columns, strict=True)})


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket of seeds: links to smaller documents (kind 1) and hot occurrences (kind 2), for their documents."""
    kinds, homes, blobs = (table.column(c).to_pylist() for c in ("kind", "home", "blob"))
    out = [(k, h, b) for k, h, b in zip(kinds, homes, blobs, strict=True) if k]
    if given := [b for k, b in zip(kinds, blobs, strict=True) if k == 0]:
        made, _, hot, marks = _links(*gather(given, 6))
        out += [(1, to, blob) for to, blob in made] + [(2, to, blob) for to, blob in marks(np.ones(int(hot.sum()), bool))]
    return _table(out, "kind", "home", "blob")


def _lengthen(buckets: int):
    """Of a group of documents: runs of hot seeds as keys, for seeds too frequent to be met by all that have them; one value for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        doc, twin, at, h, centre = gather(table.column("blob").to_pylist(), 5)
        order = np.lexsort((at, twin, doc))
        doc, twin, at, h, centre = (x[order] for x in (doc, twin, at, h.astype(np.uint64), centre))
        breaks = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (at[1:] - at[:-1] > REACH)]) if len(doc) else doc
        home = np.int32(table.column("home")[0].as_py())
        found = []
        key, n = mix(h + np.uint64(1)), 1
        while n < RUN and len(doc) > n:
            # a run of 2n is one of n and the one after it
            key = mix(key[:-n] * np.uint64(0xD1342543DE82EF95) + key[n:])
            n *= 2
            x = np.flatnonzero(breaks[: len(key)] == breaks[n - 1 :]) if len(key) else np.zeros(0, np.int64)
            found.append((key[x], x, x + n - 1))
        if not found:
            return _table([], "bucket", "blob")
        key, x, last = (np.concatenate(a) for a in zip(*found, strict=True))
        return _table(list(deal(bucket_of(key, buckets), short(key), doc[x], twin[x], at[x], at[last], np.full(len(x), home, np.int32), centre[x])), "bucket", "blob")

    return run


def _meet_runs(table: pa.Table) -> pa.Table:
    """Of a bucket of runs: links to smaller documents that their seeds alone don't have, at both ends of a run."""
    h, doc, twin, at, end, home, centre = gather(table.column("blob").to_pylist(), 7)
    i, c = meet(h, doc, twin, np.zeros(len(h), np.uint8))[:2]
    new = doc[c] != centre[i]
    i, c = np.tile(i[new], 2), np.tile(c[new], 2)
    half = np.arange(len(i)) < len(i) // 2
    mine, theirs = np.where(half, at[i], end[i]), np.where(half, at[c], end[c])
    order = np.lexsort((mine, twin[i], doc[i]))
    i, c, mine, theirs = i[order], c[order], mine[order], theirs[order]
    return _table(list(deal(home[i], doc[i], twin[i], mine, doc[c], twin[c], theirs, home[c])), "home", "blob")


def best_forerunner(places: list[tuple[int, int, int, int]], cost: float) -> list[list[int]]:
    """Chains of pieces (start, stop, other's start, other's stop), best first.

    A piece may follow one that ends before it starts in both texts. Its score is
    its length plus the best forerunner's, less ``cost`` for each word between
    them; the Fenwick tree holds, by the other text's stop, the best score so far
    with the costs up to that stop added, so one prefix maximum answers a piece.
    """
    stops = sorted({p[3] for p in places})
    rank = {s: i + 1 for i, s in enumerate(stops)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(stops) + 1)
    score, before = [0.0] * len(places), [-1] * len(places)
    events = sorted([(p[1] - K + 1, 0, i) for i, p in enumerate(places)] + [(p[0], 1, i) for i, p in enumerate(places)])
    from bisect import bisect_right

    started: set[int] = set()
    for _, kind, i in events:
        a, b, c, d = places[i]
        if kind == 1:
            x, best = bisect_right(stops, c + K - 1), (0.0, -1)
            while x:
                best = max(best, tree[x])
                x &= x - 1
            gain = best[0] - cost * (a + c) if best[1] >= 0 else 0.0
            score[i], before[i] = (b - a) + max(0.0, gain), best[1] if gain > 0 else -1
            started.add(i)
        elif i in started:
            x, value = rank[d], (score[i] + cost * (b + d), i)
            while x < len(tree):
                tree[x] = max(tree[x], value)
                x += x & -x
    chains, used = [], set()
    for i in sorted(range(len(places)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(i)
            i = before[i]
        if chain:
            chains.append(chain[::-1])
    return chains


def _chain(min_words: int):
    """Of a group of documents: chains worth aligning, asked from the other documents' groups."""

    def run(table: pa.Table) -> pa.Table:
        doc, twin, at, cdoc, ctwin, cat, chome = gather(table.column("blob").to_pylist(), 7)
        at, cat = at.astype(np.int64), cat.astype(np.int64)
        home = table.column("home")[0].as_py()
        order = np.lexsort((at, at - cat, ctwin, cdoc, twin, doc))
        doc, twin, at, cdoc, ctwin, cat, chome = (x[order] for x in (doc, twin, at, cdoc, ctwin, cat, chome))
        same_pair = np.r_[False, (doc[1:] == doc[:-1]) & (twin[1:] == twin[:-1]) & (cdoc[1:] == cdoc[:-1]) & (ctwin[1:] == ctwin[:-1])]
        same = same_pair.copy()
        same[1:] &= (at[1:] - cat[1:] == at[:-1] - cat[:-1]) & (at[1:] - at[:-1] <= REACH)
        first = np.flatnonzero(~same)
        last = np.append(first[1:], len(at)) - 1
        start, stop = at[first], at[last] + K
        cstart, cstop = cat[first], cat[last] + K
        pair = np.cumsum(~same_pair)[first]
        bounds = np.append(group_starts(pair), len(pair))
        found: list[tuple] = []
        lone = np.diff(bounds) == 1
        for a, b, single in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lone.tolist(), strict=True):
            reach = stop[a:b].max() - start[a:b].min()
            if reach + 2 * BEYOND < min_words or (stop[a:b] - start[a:b]).sum() < min_words // 4:
                continue
            if single:
                found.append((first[a], [a]))
                continue
            places = list(zip(start[a:b].tolist(), stop[a:b].tolist(), cstart[a:b].tolist(), cstop[a:b].tolist(), strict=True))
            found += [(first[a], [a + i for i in chain]) for chain in best_forerunner(places, GAP_COST) if sum(places[i][1] - places[i][0] for i in chain) >= min_words // 4]
        out: dict = {}
        for i, chain in found:
            out.setdefault(int(chome[i]), []).append((doc[i], twin[i], cdoc[i], ctwin[i], max(0, cstart[chain[0]] - BEYOND), cstop[chain[-1]] + BEYOND, len(chain), [(start[j], stop[j], cstart[j]) for j in chain]))
        made = []
        for to, rows in out.items():
            pieces = np.array([p for r in rows for p in r[7]], np.int64).reshape(-1, 3)
            made.append((to, pack(np.full(len(rows), home, np.int32), *[np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, np.int32, np.int64, np.int32, np.int64, np.int64, np.int32))], *pieces.T)))
        return pa.table({"home": pa.array([x[0] for x in made], pa.int32()), "blob": pa.array([x[1] for x in made], pa.binary())})

    return run


def _texts(documents: pa.Table, wanted: set) -> dict:
    known = WordHashes()
    ids, twins, sizes, data = documents_in(documents)
    data, out = data.tobytes(), {}
    for key, z, w in zip(zip(ids.tolist(), twins.tolist(), strict=True), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        if key in wanted:
            out[key] = short(words(data[z : z + w].decode("utf-8", "replace"), known))
    return out


def _fetch(key, documents: pa.Table, asked: pa.Table) -> pa.Table:
    """The words around each chain, added for the group that asked."""
    out = []
    given = [gather([blob], 11) for blob in asked.column("blob").to_pylist()]
    texts = _texts(documents, {x for arrays in given for x in zip(arrays[3].tolist(), arrays[4].tolist(), strict=True)}) if given else {}
    for arrays in given:
        cdoc, ctwin, begin, end = arrays[3:7]
        parts = [texts[(d, t)][a:b] for d, t, a, b in zip(cdoc.tolist(), ctwin.tolist(), begin.tolist(), end.tolist(), strict=True)]
        out.append((int(arrays[0][0]), pack(*arrays, np.array([len(p) for p in parts], np.int64), np.concatenate(parts))))
    return pa.table({"home": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts go on alike: the best sum of +1 for equal, -2 for unequal words."""
    n = min(len(a), len(b))
    if not n:
        return 0
    total = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def align(own: np.ndarray, other: np.ndarray, pieces: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """(start, stop, other's start, other's stop, matched words) of a chain of pieces (start, stop, other's start)."""
    a0, _, c0 = pieces[0]
    matched, a, c = 0, a0, c0
    for start, stop, other_start in pieces:
        skip = max(0, a - start, c - other_start)
        start, other_start = start + skip, other_start + skip
        if start >= stop:
            continue
        matched += _common(own[a:start], other[c:other_start])
        n = stop - start
        matched += int((own[start:stop] == other[other_start : other_start + n]).sum())
        a, c = stop, other_start + n
    back = _extend(own[max(0, a0 - BEYOND) : a0][::-1], other[max(0, c0 - BEYOND) : c0][::-1])
    on = _extend(own[a : a + BEYOND], other[c : c + BEYOND])
    matched += int((own[a0 - back : a0] == other[c0 - back : c0]).sum()) + int((own[a : a + on] == other[c : c + on]).sum())
    return a0 - back, a + on, c0 - back, c + on, matched


def _runs(own: np.ndarray, other: np.ndarray, pieces: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """(start, stop, other's start, other's stop) of a chain's runs of equal words, and the words matched between each and the next."""
    runs, between = [], []
    a, c = pieces[0][0], pieces[0][2]
    for start, stop, other_start in pieces:
        skip = max(0, a - start, c - other_start)
        start, other_start = start + skip, other_start + skip
        if start >= stop:
            continue
        equal = own[start:stop] == other[other_start : other_start + stop - start]
        edges = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8))).reshape(-1, 2).tolist()
        for k, (x, y) in enumerate(edges):
            if runs:
                between.append(0 if k else _common(own[a:start], other[c:other_start]))
            runs.append((start + x, start + y, other_start + x, other_start + y))
        a, c = stop, other_start + stop - start
    return runs, between


def _parts(own: np.ndarray, other: np.ndarray, pieces: list[tuple[int, int, int]], min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """The passages, as from ``align``, in a chain that is none as a whole."""
    runs, between = _runs(own, other, pieces)
    if not runs:
        return []
    r, size = np.array(runs), np.array([y - x for x, y, _, _ in runs])
    upto = np.cumsum(size) + np.r_[0, np.cumsum(between)].astype(np.int64)
    # matched words less the wanted share of each text's words, up to a run's end and to its start
    ends = [upto - identity * r[:, k] for k in (1, 3)]
    starts = [upto - size - identity * r[:, k] for k in (0, 2)]
    out, rest = [], [(0, len(runs))]
    while rest:
        lo, hi = rest.pop()
        best = (0, lo, lo)
        for i in range(lo, hi):
            if r[hi - 1, 1] - r[i, 0] <= best[0]:
                break
            good = np.flatnonzero((ends[0][i:hi] >= starts[0][i] - 1e-9) & (ends[1][i:hi] >= starts[1][i] - 1e-9))
            if len(good) and r[i + good[-1], 1] - r[i, 0] > best[0]:
                best = (int(r[i + good[-1], 1] - r[i, 0]), i, i + int(good[-1]))
        words, i, j = best
        if not words:
            continue
        (a, _, c, _), (_, b, _, d), matched = runs[i], runs[j], int(upto[j] - upto[i] + size[i])
        low, high = (runs[i - 1] if i else (0, 0, 0, 0)), (runs[j + 1] if j + 1 < len(runs) else (len(own), 0, len(other), 0))
        back = _extend(own[max(low[1], a - BEYOND) : a][::-1], other[max(low[3], c - BEYOND) : c][::-1])
        on = _extend(own[b : min(high[0], b + BEYOND)], other[d : min(high[2], d + BEYOND)])
        more = int((own[a - back : a] == other[c - back : c]).sum()) + int((own[b : b + on] == other[d : d + on]).sum())
        for found in ((a - back, b + on, c - back, d + on, matched + more), (a, b, c, d, matched)):
            if is_passage(found, min_words, identity):
                out.append(found)
                break
        rest += [(lo, i), (j + 1, hi)]
    return sorted(out)


def is_passage(found: tuple[int, int, int, int, int], min_words: int, identity: float) -> bool:
    a, b, c, d, matched = found
    return min(b - a, d - c) >= min_words and matched >= identity * max(b - a, d - c)


def passages_of(own: np.ndarray, other: np.ndarray, pieces: list[tuple[int, int, int]], min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """A chain as ``align`` gives it if it is a passage, or else its parts that are."""
    whole = align(own, other, pieces)
    if is_passage(whole, min_words, identity):
        return [whole]
    return _parts(own, other, pieces, min_words, identity) if min(whole[1] - whole[0], whole[3] - whole[2]) >= min_words else []


def _align(min_words: int, identity: float):
    def run(key, documents: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        blobs = [gather([b], 13) for b in answers.column("blob").to_pylist()]
        wanted = {x for arrays in blobs for x in zip(arrays[1].tolist(), arrays[2].tolist(), strict=True)}
        texts = _texts(documents, wanted)
        for _, doc, twin, cdoc, _ctwin, begin, _end, sizes, start, stop, cstart, n, text in blobs:
            p = t = 0
            for i in range(len(doc)):
                pieces = [(int(start[k]), int(stop[k]), int(cstart[k] - begin[i])) for k in range(p, p + sizes[i])]
                p += sizes[i]
                other = text[t : t + n[i]]
                t += n[i]
                for a, b, c, d, matched in passages_of(texts[(int(doc[i]), int(twin[i]))], other, pieces, min_words, identity):
                    out.append((doc[i], cdoc[i], a, b, c + begin[i], d + begin[i], matched, matched / max(b - a, d - c)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        ids = [[None if x == LAST else int(x) for x in c] for c in columns[:2]]
        return pa.table(dict(zip(("doc_id", "match_doc_id", "start", "stop", "match_start", "match_stop", "matched"), [pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), *[pa.array([int(x) for x in c], pa.int64()) for c in columns[2:7]]], strict=True)) | {"identity": pa.array([float(x) for x in columns[7]], pa.float64())})

    return run


def find_passages(documents: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K, v: int = V, buckets: int | None = None) -> DataFrame:
    """doc_id, match_doc_id, start, stop, match_start, match_stop (in words), matched and identity
    of the fuzzy repeated passages of ``documents`` (doc_id, text)."""
    # each bucket sends a value to each group of documents, so there are up to the square of their number: no more of either than partitions
    buckets = buckets or partitions(documents.sparkSession)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"), F.hash("text").alias("twin"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).withColumn("home", F.pmod(F.hash("doc_id"), F.lit(buckets)).cast("int"))
    texts = pack_documents(rows, buckets, 4 * CHUNK_BYTES)
    found = rows.mapInArrow(_seed(buckets, k, v), "bucket int, kind int, home int, blob binary")
    met = written(found.groupBy("bucket").applyInArrow(_meet, "kind int, home int, blob binary"))
    runs = met.where("kind = 2").groupBy("home").applyInArrow(_lengthen(buckets), "bucket int, blob binary")
    links = met.where("kind = 1").select("home", "blob").unionByName(runs.groupBy("bucket").applyInArrow(_meet_runs, "home int, blob binary"))
    asked = links.groupBy("home").applyInArrow(_chain(min_words), "home int, blob binary")
    answers = texts.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(_fetch, "home int, blob binary")
    return texts.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(
        _align(min_words, identity), "doc_id bigint, match_doc_id bigint, start bigint, stop bigint, match_start bigint, match_stop bigint, matched bigint, identity double"
    )
