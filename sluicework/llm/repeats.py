"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Such strings are
found in suffix order: each suffix's nearest neighbours of a smaller document, the previous and the next one, and the
longest prefix it shares with either is its longest previous factor. Where that reaches ``LENGTH`` the string goes, so
later copies are removed and the first is kept.

One suffix array of a whole corpus would not be distributable, so it is kept in parts that hold all suffixes which
could share ``LENGTH`` bytes:

1. Documents are packed into blocks as they are read. Every string has a key, the least hash of its 20-byte
   substrings, which all its occurrences share; runs of neighbouring strings have the same key. Each block sends its
   distinct keys to buckets, and learns by one bit for each which of them other blocks have too.
2. The suffixes at which runs start are put in order in their block. A run whose factor spans all of it is settled; the
   others of keys that no other block has are ordered string by string there and then.
3. The runs left, of keys that recur, go to their bucket, where the same is done over all blocks. A key of more than
   ``HOT`` blocks is dealt by its single strings instead of by itself, so that no bucket has it all.
4. Blocks cut their documents.

A run is sent at most once per block and different text, however often a passage occurs. There are as many buckets as
the corpus has times ``BUCKET_BYTES``, so a bucket's size does not grow with it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.session import small_batches, written

LENGTH = 50
KMER = 20
BLOCK_BYTES = 1 << 21
BUCKET_BYTES = 1 << 24
#: Blocks from which on a key is dealt by single strings.
HOT = 256
#: Places whose keys are computed together; strings of the longest run; runs, and strings, that are put in order together.
STEP, LONGEST, RUNS, STRINGS = 1 << 18, 64, 1 << 16, 1 << 18
PAD = LONGEST + LENGTH + 8
LAST = (1 << 63) - 1

_BYTES = np.random.default_rng(3).integers(1, 1 << 64, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _pair(a: np.ndarray, size_a: int, b: np.ndarray, factor: int) -> np.ndarray:
    n = len(b) - size_a
    return a[:n] * np.uint64(factor) + b[size_a : size_a + n]


def keys(raw: np.ndarray) -> np.ndarray:
    """The key of each string of LENGTH bytes: the least hash of the k-mers in it."""
    h1 = _BYTES[raw]
    h2 = _pair(h1, 1, h1, 0x9FB21C651E98DF25)
    h4 = _pair(h2, 2, h2, 0xD6E8FEB86659FD93)
    h8 = _pair(h4, 4, h4, 0xC2B2AE3D27D4EB4F)
    h16 = _pair(h8, 8, h8, 0x165667B19E3779F9)
    h = _mix(_pair(h16, 16, h4, 0xFF51AFD7ED558CCD))
    span, window = LENGTH - KMER + 1, 1
    while window * 2 <= span:
        h, window = np.minimum(h[:-window], h[window:]), window * 2
    rest = span - window
    return _mix(np.minimum(h[: len(h) - rest], h[rest:]) if rest else h)


def runs(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document's number, start, count) of runs of at most LONGEST neighbouring strings with one key, starts counted in raw."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    found = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
    for c in range(0, max(0, len(raw) - LENGTH + 1), STEP):
        key = keys(raw[c : c + STEP + LENGTH - 1])
        n = len(key)
        own = doc[c : c + n]
        whole = own == doc[c + LENGTH - 1 : c + LENGTH - 1 + n]
        first = whole & np.concatenate(([True], (key[1:] != key[:-1]) | ~whole[:-1] | (own[1:] != own[:-1])))
        at = np.flatnonzero(first)
        count = np.bincount(np.cumsum(first)[whole] - 1, minlength=len(at))
        parts = (count + LONGEST - 1) // LONGEST
        if (parts > 1).any():
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, count = np.repeat(at, parts) + k * LONGEST, np.minimum(np.repeat(count, parts) - k * LONGEST, LONGEST)
        found.append((key[at], own[at].astype(np.int64), at + c, count))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- suffix order and longest previous factors ---------------------------------------------------------------------


def _lanes(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The strings raw[at : at + sizes] as columns of big-endian words, zero after their end. raw has PAD bytes more."""
    view = np.ndarray((len(raw) - 7,), ">u8", raw.data, strides=(1,))
    out = []
    for j in range(0, int(sizes.max()), 8):
        word, left = view[at + j].astype(np.uint64), sizes - j
        short = np.flatnonzero(left < 8)
        if len(short):
            gone = (8 * (8 - np.maximum(left[short], 0))).astype(np.uint64)
            word[short] = np.where(gone < 64, word[short] >> gone % np.uint64(64) << gone % np.uint64(64), np.uint64(0))
        out.append(word)
    return out


def suffix_order(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at``, compared over ``sizes`` bytes, and the length that each shares with the one before it.

    Suffixes that are equal over their sizes are found by hash, checked word for word, and take one place in the order
    beside each other, in the order given; so only different ones are compared.
    """
    lanes = _lanes(raw, at, sizes)
    h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for w in lanes:
        h = (h ^ w) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    alike = one[of]
    if not ((sizes == sizes[alike]).all() and all((w == w[alike]).all() for w in lanes)):  # two texts of one hash
        one = of = np.arange(len(at))
    some, lengths = [w[one] for w in lanes], sizes[one]
    by = np.lexsort((lengths, *some[::-1]))
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    rank = rank[of]
    order = np.argsort(rank, kind="stable")
    # Lengths shared by neighbours among the different ones, byte by byte of the first word that differs.
    shared = np.minimum(lengths[by][1:], lengths[by][:-1])
    open_ = np.arange(len(by) - 1)
    for j, w in enumerate(some):
        x = w[by[open_ + 1]] ^ w[by[open_]]
        differ = x != 0
        same = sum(((x[differ] >> np.uint64(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, 8)) if differ.any() else 0
        shared[open_[differ]] = np.minimum(shared[open_[differ]], 8 * j + same)
        open_ = open_[~differ]
    lcp = sizes[order].copy()
    head = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    lcp[head] = np.concatenate(([0], shared))
    return order, lcp


def previous_factors(lcp: np.ndarray, docs: np.ndarray, need: np.ndarray) -> np.ndarray:
    """In suffix order, each suffix's longest previous factor where that is at least ``need``, otherwise 0.

    On either side the nearest suffix of a smaller document is found by following pointers: what a pointer passes over is
    of no smaller document than where it starts, so it may go on by the pointer of where it ends, and carries the least
    shared length on its way. A pointer ends once that is below what its suffix needs.
    """
    n = len(docs)
    factor = np.zeros(n, np.int64)
    for back in (False, True):
        d, want = (docs[::-1], need[::-1]) if back else (docs, need)
        least = np.concatenate((lcp[1:], [0]))[::-1].copy() if back else lcp.copy()
        near, out = np.arange(-1, n - 1), np.zeros(n, np.int64)
        open_ = np.flatnonzero(least >= want)
        while len(open_):
            j = near[open_]
            smaller = d[j] < d[open_]
            out[open_[smaller]] = least[open_[smaller]]
            open_, j = open_[~smaller], j[~smaller]
            on, low = near[j], np.minimum(least[open_], least[j])
            near[open_], least[open_] = on, low
            open_ = open_[low >= want[open_]]
        factor = np.maximum(factor, out[::-1] if back else out)
    return factor


def _cuts(sizes: np.ndarray, group: np.ndarray, most: int) -> list[int]:
    """Where to cut sorted groups, whole, into parts of about ``most``."""
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    total = np.concatenate(([0], np.cumsum(sizes)))[at]
    part = total // most
    return [*at[np.concatenate(([True], part[1:] != part[:-1]))].tolist(), len(group)]


def earlier_runs(raw: np.ndarray, key: np.ndarray, at: np.ndarray, count: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which runs' longest previous factor spans the whole run."""
    out = np.zeros(len(at), bool)
    by = np.argsort(key, kind="stable")
    cuts = _cuts(np.ones(len(by), np.int64), key[by], RUNS) if len(by) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = by[a:b]
        sizes = count[own] + LENGTH - 1
        order, lcp = suffix_order(raw, at[own], sizes)
        out[own[order]] = previous_factors(lcp, docs[own][order], sizes[order]) > 0
    return out


def earlier_strings(raw: np.ndarray, key: np.ndarray, at: np.ndarray, count: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place in it) of the strings whose longest previous factor has LENGTH bytes or more."""
    hit_run, hit_at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    by = np.lexsort((docs, key))
    if len(by):  # a key of one document has no earlier one
        k, d = key[by], docs[by]
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        several = d[start] != d[np.append(start[1:], len(by)) - 1]
        by = by[np.repeat(several, np.diff(np.append(start, len(by))))]
    cuts = _cuts(count[by], key[by], STRINGS) if len(by) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = by[a:b]
        run = np.repeat(own, count[own])
        place = np.arange(len(run)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        need = np.full(len(run), LENGTH)
        order, lcp = suffix_order(raw, at[run] + place, need)
        hit = order[previous_factors(lcp, docs[run][order], need) >= LENGTH]
        hit_run.append(run[hit])
        hit_at.append(place[hit])
    return np.concatenate(hit_run), np.concatenate(hit_at)


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document without overlaps or gaps of nothing between them."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = (doc - doc.min()) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    at = np.flatnonzero(np.concatenate(([True], (start + shift)[1:] > reach[:-1])))
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (reach - shift)[last]


# ---- blocks and buckets --------------------------------------------------------------------------------------------

BLOCKS = "block long, n_bytes long, ids array<long>, sizes binary, text binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def out() -> pa.RecordBatch:
        row = [part << 32 | number], [size], [ids], [np.array(list(map(len, texts)), np.int64).tobytes()], [zstandard.compress(b"".join(texts), 3)]
        kinds = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["block", "n_bytes", "ids", "sizes", "text"])

    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            if ids and size + len(raw) > BLOCK_BYTES:
                yield out()
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(i.as_py())
            texts.append(raw)
            size += len(raw)
    if ids:
        yield out()


def _block(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with PAD more, sizes, ranks by id: null last)."""
    raw = np.frombuffer(zstandard.decompress(r["text"]) + b"\0" * PAD, np.uint8)
    return raw, np.frombuffer(r["sizes"], np.int64), np.array([LAST if i is None else i for i in r["ids"]], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _codes(key: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 more bits of each key. Keys that meet by chance cost work, not exactness."""
    return key % np.uint64(buckets) << np.uint64(32) | key // np.uint64(buckets) & np.uint64(0xFFFFFFFF)


def _keys_of(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            raw, sizes, _ = _block(r)
            code = np.unique(_codes(runs(raw[:-PAD], sizes)[0], buckets))
            bucket, low = (code >> np.uint64(32)).astype(np.int64), code.astype(np.uint32)
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(code) else np.empty(0, np.int64)
            blobs = [x.tobytes() for x in np.split(low, cut[1:])] if len(code) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([r["block"]] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "keys"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by bucket, bucket by bucket."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["bucket"] != r["bucket"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _shared(hot: int):
    """A function for mapInArrow: for each bucket and block, a bit for each of its keys that other blocks have too, and one for each that more than ``hot`` blocks have (empty where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            each = [np.frombuffer(r["keys"], np.uint32) for r in rows]
            key = np.concatenate(each)
            _, of, n = np.unique(key, return_inverse=True, return_counts=True)
            n, at, out = n[of], 0, []
            for r, own in zip(rows, each, strict=True):
                mine = n[at : at + len(own)]
                at += len(own)
                if (mine > 1).any():
                    out.append((r["block"], r["bucket"], np.packbits(mine > 1).tobytes(), np.packbits(mine > hot).tobytes() if (mine > hot).any() else b""))
            kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["block", "bucket", "shared", "hot"])

    return run


FOUND = "bucket long, block long, docs binary, starts binary, sizes binary, text binary, ids binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), *[pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "block", "docs", "starts", "sizes", "text", "ids"])


def _sent(buckets: int):
    """A function for mapInArrow: blocks with their keys' bits to runs for the buckets, and (bucket < 0) what is settled within the block: intervals as document, start, stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            raw, sizes, ids = _block(r)
            key, doc, at, count = runs(raw[:-PAD], sizes)
            code = _codes(key, buckets)
            codes = np.unique(code)
            shared, hot = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
            for b in r["bits"] or []:
                low, high = np.searchsorted(codes, np.array([b["bucket"], b["bucket"] + 1], np.uint64) << np.uint64(32))
                shared[low:high] = np.unpackbits(np.frombuffer(b["shared"], np.uint8))[: high - low]
                if b["hot"]:
                    hot[low:high] = np.unpackbits(np.frombuffer(b["hot"], np.uint8))[: high - low]
            place = np.searchsorted(codes, code)
            base = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            by = np.lexsort((doc, key))  # keys of one document here, that no other block has, have no earlier one
            k, d = key[by], doc[by]
            start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(by) else np.empty(0, np.int64)
            several = d[start] != d[np.append(start[1:], len(by)) - 1] if len(by) else np.empty(0, bool)
            inside = np.zeros(len(key), bool)
            inside[by] = np.repeat(several, np.diff(np.append(start, len(by))))
            pick = np.flatnonzero(inside | shared[place])
            whole = np.zeros(len(pick), bool)
            own = np.flatnonzero(inside[pick])
            p = pick[own]
            whole[own] = earlier_runs(raw, key[p], at[p], count[p], ids[doc[p]])
            settled, left = pick[whole], pick[~whole]
            alone = ~shared[place[left]]
            p = left[alone]
            hit, off = earlier_strings(raw, key[p], at[p], count[p], ids[doc[p]])
            x = np.concatenate([settled, p[hit]])
            if len(x):
                s = np.concatenate([at[settled], at[p[hit]] + off]) - base[doc[x]]
                e = s + np.concatenate([count[settled] + LENGTH - 1, np.full(len(hit), LENGTH)])
                yield _found([(-1 - r["block"] % buckets, r["block"], *(v.tobytes() for v in _merged(doc[x], s, e)), b"", b"")])
            p = left[~alone]
            n = np.where(hot[place[p]], count[p], 1)  # a hot key's strings go one by one
            p, k = np.repeat(p, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            single = hot[place[p]]
            a, c = at[p] + np.where(single, k, 0), np.where(single, 1, count[p])
            bucket = (key[p] % np.uint64(buckets)).astype(np.int64)
            if single.any():
                h = np.zeros(int(single.sum()), np.uint64)
                for w in _lanes(raw, a[single], np.full(len(h), LENGTH)):
                    h = _mix(h + w)
                bucket[single] = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = []
            text = raw.tobytes()
            for part in np.split(order, np.flatnonzero(bucket[order][1:] != bucket[order][:-1]) + 1) if len(order) else []:
                size = c[part] + LENGTH - 1
                pieces = b"".join(text[x : x + y] for x, y in zip(a[part].tolist(), size.tolist(), strict=True))
                own = doc[p[part]]
                packed = [x.tobytes() for x in (own.astype(np.int32), a[part] - base[own], size.astype(np.uint8))] + [pieces, ids[own].tobytes()]
                rows.append((int(bucket[part[0]]), r["block"], *(zstandard.compress(x, 1) for x in packed)))
            if rows:
                yield _found(rows)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of runs to intervals of their blocks' documents; settled ones pass."""
    for rows in _by_bucket(batches):
        if rows[0]["bucket"] < 0:
            yield _found([(-1, r["block"], r["docs"], r["starts"], r["sizes"], b"", b"") for r in rows])
            continue
        raw = np.frombuffer(b"".join(zstandard.decompress(r["text"]) for r in rows) + b"\0" * PAD, np.uint8)
        of = lambda c, kind: [np.frombuffer(zstandard.decompress(r[c]), kind).astype(np.int64) for r in rows]  # noqa: E731, B023
        docs = of("docs", np.int32)
        owner = np.repeat(np.arange(len(rows)), list(map(len, docs)))
        docs, starts, size, ids = np.concatenate(docs), *(np.concatenate(of(c, kind)) for c, kind in (("starts", np.int64), ("sizes", np.uint8), ("ids", np.int64)))
        at, count = np.cumsum(size) - size, size - LENGTH + 1
        key = keys_at(raw, at)
        whole = earlier_runs(raw, key, at, count, ids)
        left = np.flatnonzero(~whole)
        hit, off = earlier_strings(raw, key[left], at[left], count[left], ids[left])
        x = np.concatenate([np.flatnonzero(whole), left[hit]])
        s = starts[x] + np.concatenate([np.zeros(int(whole.sum()), np.int64), off])
        e = s + np.concatenate([size[whole], np.full(len(hit), LENGTH)])
        by = np.argsort(owner[x], kind="stable")
        own, cut = np.unique(owner[x[by]], return_index=True)
        out = [(-1, rows[k]["block"], *(v.tobytes() for v in _merged(docs[x[i]], s[i], e[i])), b"", b"") for k, i in zip(own.tolist(), np.split(by, cut[1:]), strict=True)] if len(own) else []
        if out:
            yield _found(out)


def keys_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The key of the string at each of some places (a run has one key, so that of its first string tells)."""
    out = [np.empty(0, np.uint64)]
    fold = lambda a, s, b, f: a[:, : b.shape[1] - s] * np.uint64(f) + b[:, s:]
    for k in range(0, len(at), 1 << 14):
        h1 = _BYTES[raw[at[k : k + (1 << 14), None] + np.arange(LENGTH)]]
        h2 = fold(h1, 1, h1, 0x9FB21C651E98DF25)
        h4 = fold(h2, 2, h2, 0xD6E8FEB86659FD93)
        h8 = fold(h4, 4, h4, 0xC2B2AE3D27D4EB4F)
        h16 = fold(h8, 8, h8, 0x165667B19E3779F9)
        out.append(_mix(_mix(h16[:, : h4.shape[1] - 16] * np.uint64(0xFF51AFD7ED558CCD) + h4[:, 16:]).min(axis=1)))
    return np.concatenate(out)


CUT = "id long, n_bytes long, n_removed long, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()
    for r in _rows(batches):
        text, sizes = zstandard.decompress(r["text"]), np.frombuffer(r["sizes"], np.int64)
        of = lambda c: np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x[c], np.int64) for x in r["found"] or [])])  # noqa: E731, B023
        doc, start, stop = _merged(of("docs"), of("starts"), of("sizes"))
        first = np.searchsorted(doc, np.arange(len(sizes) + 1)).tolist()
        start, stop, at, out = start.tolist(), stop.tolist(), 0, []
        for d, (i, size) in enumerate(zip(r["ids"], sizes.tolist(), strict=True)):
            body, digest, last, spans = text[at : at + size], hashlib.sha256(), 0, []
            at += size
            for x, y in zip(start[first[d] : first[d + 1]], stop[first[d] : first[d + 1]], strict=True):
                digest.update(body[last:x])
                last = y
                spans.append({"start": x, "stop": y})
            digest.update(body[last:])
            out.append((i, size, sum(s["stop"] - s["start"] for s in spans), spans, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, spans (removed runs of bytes, merged, end exclusive) and kept_sha256 for every row.

    A null text is empty. A null id counts as larger than all others, so such a row never takes from others. Rows
    with one id are one document to each other: they never take from each other. Repeated rows stay. Texts under 50
    bytes stay whole; a very long text is a block of its own. An empty table gives an empty result. Other columns are
    ignored.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = written(rows.mapInArrow(_pack, BLOCKS), "repeats-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))
    texts = blocks.select("block", "ids", "sizes", "text")
    sent = texts.mapInArrow(_keys_of(buckets), "bucket long, block long, keys binary")
    bits = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(hot), "block long, bucket long, shared binary, hot binary")
    bits = written(bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("bits")), "repeats-keys")
    asked = texts.join(bits, "block", "left").select(*texts.columns, "bits").mapInArrow(_sent(buckets), FOUND)
    found = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answered, FOUND)
    found = written(found.groupBy("block").agg(F.collect_list(F.struct("docs", "starts", "sizes")).alias("found")), "repeats-found")
    return written(texts.join(found, "block", "left").select(*texts.columns, "found").mapInArrow(_cut, CUT), "repeats-cut")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Every 50-byte string with the least document that has it; what later ones cover goes, in runs.
SQL = """
WITH h AS (SELECT doc_id, row_number() OVER () AS rid, encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT rid, doc_id, x, unnest(generate_series(1, octet_length(x)::BIGINT - 49)) AS i FROM h WHERE octet_length(x) >= 50),
s AS (SELECT rid, doc_id, i, x[i:i + 49] AS w FROM p),
f AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w),
g AS (SELECT rid, i FROM s JOIN f USING (w) WHERE doc_id > first),
o AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM g),
k AS (SELECT rid, i, sum(CASE WHEN prev IS NULL OR i > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM o),
r AS (SELECT rid, k, min(i) AS a, max(i) + 49 AS b FROM k GROUP BY ALL),
q AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS last FROM r),
z AS (SELECT q.rid, string_agg(hex(x[last + 1:a - 1]), '' ORDER BY a) AS head, max(b) AS e, count(*) AS n_spans, sum(b - a + 1)::BIGINT AS n_removed FROM q JOIN h USING (rid) GROUP BY q.rid)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(CASE WHEN e IS NULL THEN x ELSE x[e + 1:] END))) AS kept_sha256
FROM h LEFT JOIN z USING (rid)
"""
