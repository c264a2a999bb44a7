"""Counting n-grams of a corpus: blocks of words, a dictionary of ids, and range-partitioned runs of fixed-width keys.

A task turns its texts into blocks of about a million words, each with a dictionary of its own, so that a text is read
and split once. Blocks then ask and are answered, in two exchanges of packed columns:

- words: a block's distinct words are dealt by hash to buckets; a bucket sums their counts over all blocks, numbers
  those that are frequent enough, the most frequent first, and answers each block with ids and counts;
- n-grams: a block packs the ids of each n-gram to a key of fixed width (n 64-bit ids, zero for none), puts its keys in
  order with a radix sort, counts runs, and cuts them at splitters drawn from a sample of blocks; a bucket merges the
  runs of all blocks with another radix sort and counts runs again.

A word or n-gram comes to a bucket at most once from each block, however often it occurs. What is sent is cut from
blocks of bounded size and buckets grow in number with the corpus, so no task holds more than one block or bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.batches import cuts, handing_back
from sluicework.session import small_batches, written

#: Words of a block, and of a unit (a stretch of one text; a longer text has several).
TOKENS, UNIT = 1 << 20, 1 << 12
#: Words and keys that one bucket gathers, and the most buckets of keys.
WORDS, KEYS, MOST = 1 << 19, 1 << 20, 1 << 20
#: Blocks from which splitters are drawn at least, one key of so many.
SAMPLED, STRIDE = 16, 256
#: In a sequence of words: a break, and the end of a text.
BREAK, END = -1, -2
#: What stands for the end of a text in a dictionary; no word holds it.
END_WORD = b"\n"


# ---- packed columns ------------------------------------------------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative whole numbers in as few bytes each as the largest needs, byte by byte, compressed."""
    most = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    """What pack() was given, as unsigned numbers of that width."""
    width = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    """(joined bytes, lengths) of a large binary array."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    joined = b"" if data is None else data[int(ends[0]) : int(ends[-1])].to_pybytes()
    return zstandard.ZstdCompressor(level=1).compress(joined), pack(np.diff(ends))


def unpack_words(joined: bytes, lengths: bytes) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(unpack(lengths), dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(zstandard.ZstdDecompressor().decompress(joined))])


def radix_order(columns: Iterable[np.ndarray]) -> np.ndarray:
    """The stable order of rows of unsigned columns, the first column foremost: 16 bits at a time, the last first; digits that all rows share are passed over."""
    order = None
    for column in reversed(list(columns)):
        low, high = (int(column.min()), int(column.max())) if len(column) else (0, 0)
        for shift in range(0, 8 * column.itemsize, 16):
            if low >> shift == high >> shift:
                break
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(column)) if order is None else order


def _joined(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of numbers below 2^bits, as many to one as 64 bits hold; their order is the same."""
    each, out = max(1, 64 // bits), []
    for k in range(0, len(columns), each):
        one = columns[k].astype(np.uint64)
        for c in columns[k + 1 : k + each]:
            one = one << np.uint64(bits) | c
        out.append(one)
    return out


def _ordered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(radix_order(), where in that order a row differs from the one before it)."""
    order = radix_order(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


# ---- texts to blocks -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    """How texts become words: the bytes that part words, those that part pieces, the longest n-gram, whether a text's end counts."""

    spaces: bytes
    breaks: bytes
    order: int
    ends: bool

    def table(self) -> np.ndarray:
        """For each byte what it becomes: A-Z in lower case, 0x20 between words, 0x0A between pieces (neither is in a word)."""
        to = np.arange(256, dtype=np.uint8)
        to[65:91] += 32
        to[list(self.spaces)] = 0x20
        to[list(self.breaks)] = 0x0A
        return to


def words_of(texts: pa.Array, split: Split) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words of all texts, the text of each, the piece of each) of a string array without nulls."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = split.table()[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = (raw != 0x20) & (raw != 0x0A)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = ends[:-1][ends[:-1] < len(raw)]  # a word never runs on into the next text
    first[cut] |= inside[cut]
    starts = np.flatnonzero(first)
    size = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    return words, np.searchsorted(ends, starts, "right") - 1, np.cumsum(raw == 0x0A, dtype=np.int32)[starts]


@dataclass
class _Block:
    """Units of words on their way to a block."""

    parts: list[pa.Array] = field(default_factory=list)
    base: int = 0
    units: list[np.ndarray] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    docs: list[tuple[int, int | None, bool]] = field(default_factory=list)  # place, key, whether held out
    size: int = 0

    def add(self, words: pa.Array, unit: np.ndarray, before: int, doc: tuple[int, int | None, bool]) -> None:
        if not self.parts or self.parts[-1] is not words:
            self.base += len(self.parts[-1]) if self.parts else 0
            self.parts.append(words)
        self.units += [np.where(unit >= 0, unit + self.base, unit).astype(np.int32), np.array([BREAK], np.int32)]
        self.before.append(before)
        self.docs.append(doc)
        self.size += len(unit)


BLOCKS = "block long, name string, n_words long, words binary, lengths binary, counts binary, tokens binary, sizes binary, before binary, docs binary, held binary, keys array<long>"


def _block_row(number: int, name: str | None, b: _Block) -> dict:
    """Words by number of occurrences, those that count (own words of units of texts that are not held out)."""
    found = pa.concat_arrays(b.parts).dictionary_encode()
    of, words = np.asarray(found.indices), found.dictionary
    seq = np.concatenate(b.units)
    tokens = np.where(seq >= 0, of[np.maximum(seq, 0)] if len(of) else 0, np.where(seq == END, len(words), -1))
    words = pa.concat_arrays([words, pa.array([END_WORD], pa.large_binary())])
    sizes = np.array([len(u) for u in b.units[::2]])
    starts = np.cumsum(sizes + 1) - sizes - 1
    own, held = np.ones(len(seq), bool), np.array([h for _, _, h in b.docs])
    for s, k in zip(starts.tolist(), b.before, strict=True):
        own[s : s + k] = False
    used = np.bincount(tokens[tokens >= 0], minlength=len(words))
    order = np.argsort(-used, kind="stable")[: np.count_nonzero(used)]
    rank = np.full(len(words) + 1, -1, np.int32)
    rank[order] = np.arange(len(order))
    tokens = rank[tokens]
    counted = own & ~np.repeat(held, sizes + 1)
    counts = np.bincount(tokens[counted & (tokens >= 0)], minlength=len(order))
    joined, lengths = pack_words(words.take(pa.array(order)))
    return {"block": number, "name": name, "n_words": len(order), "words": joined, "lengths": lengths, "counts": pack(counts), "tokens": pack(tokens + 1), "sizes": pack(sizes), "before": pack(np.array(b.before)), "docs": pack(np.array([d for d, _, _ in b.docs])), "held": pack(held.astype(np.uint8)), "keys": [k for _, k, _ in b.docs]}


def _blocks(split: Split):
    """A function for mapInArrow: (name, key, held, text) to blocks of one name each. A text is known by its partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str | None, _Block] = {}
        part, row, number = TaskContext.get().partitionId() << 33, 0, 0

        def flushed(name: str | None) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([_block_row(part | number, name, open_.pop(name))], schema=_arrow(BLOCKS))

        for batch in batches:
            for a, z in cuts(batch.column(3), 1 << 22):
                names, keys, held, texts = (c.slice(a, z - a) for c in batch.columns)
                docs = list(zip(range(row, row + z - a), keys.to_pylist(), held.to_pylist(), strict=True))
                row += z - a
                for name in names.unique().to_pylist():
                    own = [k for k, n in enumerate(names.to_pylist()) if n == name]
                    found, text, piece = words_of(texts.take(pa.array(own)).fill_null(""), split)
                    for seq, doc in _sequences(text, piece, len(own), split):
                        for at in range(0, len(seq), UNIT):
                            b = open_.setdefault(name, _Block())
                            before = seq[max(0, at - split.order + 1) : at] if at or not split.ends else np.array([END])
                            b.add(found, np.concatenate([before, seq[at : at + UNIT]]), len(before), docs[own[doc]])
                            if b.size >= TOKENS:
                                yield flushed(name)
                while sum(b.size for b in open_.values()) > 2 * TOKENS or sum(p.nbytes for b in open_.values() for p in b.parts) > 1 << 26:
                    yield flushed(max(open_, key=lambda n: open_[n].size))
        for name in list(open_):
            yield flushed(name)

    return run


def _sequences(text: np.ndarray, piece: np.ndarray, n: int, split: Split) -> Iterator[tuple[np.ndarray, int]]:
    """Places of words, with what parts them, and which text it is; where ends don't count, all texts make one sequence, parted by breaks."""
    place = np.arange(len(text))
    if split.ends:
        stops = np.searchsorted(text, np.arange(n), "right")
        for d, (a, b) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)):
            yield np.append(place[a:b], END), d
    elif len(text):
        new = np.flatnonzero((text[1:] != text[:-1]) | (piece[1:] != piece[:-1])) + 1
        yield np.insert(place, new, BREAK), 0


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in ddl.split(", ")])


def blocks(df: DataFrame, split: Split, name, key, held, text) -> DataFrame:
    """The blocks of a table, written: ``name`` keeps what is counted apart, rows where ``held`` holds don't count. A null text is empty."""
    small_batches(df.sparkSession)
    rows = df.select(name.cast("string").alias("name"), key.cast("long").alias("key"), held.alias("held"), text.alias("text"))
    return written(rows.mapInArrow(handing_back(_blocks(split)), BLOCKS), "ngram-blocks")


# ---- words: asked by blocks, answered by buckets -------------------------------------------------------------------


def _bucket_of(words: pa.Array, name: str | None, buckets: int) -> np.ndarray:
    """Buckets of words, by a polynomial of their bytes; only evenness hangs on it."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts = ends[:-1] - ends[0]
    place = (np.arange(len(raw)) - np.repeat(starts, np.diff(ends))).astype(np.uint64)
    h = np.add.reduceat((raw + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (place + np.uint64(1)) ^ (place << np.uint64(7))), starts)
    h ^= np.uint64(sum(ord(c) * 31**k for k, c in enumerate(name or "")) & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


WORD_ASKS = "bucket int, name string, block long, words binary, lengths binary, counts binary"
#: An answer to a block, or (block null) a bucket's own words that have an id, with a name's sum of counts and number of counted words.
WORD_ANSWERS = "block long, bucket int, name string, ids binary, totals binary, words binary, lengths binary, n_counted long, total long"


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = unpack_words(r["words"], r["lengths"]), unpack(r["counts"])
                to = _bucket_of(words, r["name"], buckets)
                order = np.argsort(to, kind="stable")
                stops = np.searchsorted(to[order], np.arange(buckets + 1))
                out = []
                for k in np.flatnonzero(np.diff(stops)).tolist():
                    own = order[stops[k] : stops[k + 1]]
                    joined, lengths = pack_words(words.take(pa.array(own)))
                    out.append({"bucket": k, "name": r["name"], "block": r["block"], "words": joined, "lengths": lengths, "counts": pack(counts[own])})
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(WORD_ASKS))

    return run


def _answer_words(buckets: int, least: int, keep: bool):
    """A function for mapInArrow: asks sorted by bucket and name; ids of a bucket are its number and multiples of the number of buckets, small for frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: dict[int, int] = {}
        for (bucket, name), rows in _runs(batches, ("bucket", "name")):
            parts = [unpack_words(r["words"], r["lengths"]) for r in rows]
            found = pa.concat_arrays(parts).dictionary_encode()
            of, words = np.asarray(found.indices), found.dictionary
            totals = np.zeros(len(words), np.int64)
            np.add.at(totals, of, np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64))
            by = np.argsort(-totals, kind="stable")
            n = int((totals >= least).sum())
            ids = np.zeros(len(words), np.int64)
            ids[by[:n]] = (given.get(bucket, 0) + np.arange(n)) * buckets + bucket + 1
            given[bucket] = given.get(bucket, 0) + n
            at, out = 0, []
            for r, p in zip(rows, parts, strict=True):
                own = of[at : at + len(p)]
                at += len(p)
                out.append({"block": r["block"], "bucket": bucket, "ids": pack(ids[own]), "totals": pack(totals[own])})
            own = {"bucket": bucket, "name": name, "n_counted": int((totals > 0).sum()), "total": int(totals.sum())}
            if keep:
                joined, lengths = pack_words(words.take(pa.array(by[:n])))
                own |= {"ids": pack(ids[by[:n]]), "totals": pack(totals[by[:n]]), "words": joined, "lengths": lengths}
            yield pa.RecordBatch.from_pylist([*out, own], schema=_arrow(WORD_ANSWERS))

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of a sorted stream, gathered while the columns ``by`` stay alike."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            own = tuple(r[c] for c in by)
            if rows and own != key:
                yield key, rows
                rows = []
            key = own
            rows.append(r)
    if rows:
        yield key, rows


@dataclass
class Words:
    """The answers about words: a written table, the number of buckets, and how many blocks there are."""

    answers: DataFrame
    buckets: int
    blocks: int


def words(made: DataFrame, least: int, keep: bool) -> Words:
    """Ids and counts of all words that occur ``least`` times; ``keep``: buckets keep these words themselves."""
    n, many = made.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    buckets = max(1, math.ceil(many / WORDS))
    asks = made.select("block", "name", "words", "lengths", "counts").mapInArrow(handing_back(_ask_words(buckets)), WORD_ASKS)
    dealt = asks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "name", "block")
    return Words(written(dealt.mapInArrow(handing_back(_answer_words(buckets, least, keep)), WORD_ANSWERS), "ngram-words"), buckets, n)


# ---- n-grams -------------------------------------------------------------------------------------------------------

#: What comes to a block: answers about words (kind 0), about n-grams (1), then the block itself (2).
MET = "block long, kind int, bucket int, ids binary, totals binary, follow binary, words binary, lengths binary, tokens binary, sizes binary, before binary, docs binary, held binary, keys array<long>, name string"


def _filled(df: DataFrame, kind: int) -> DataFrame:
    have = set(df.columns)
    kinds = dict(f.split(" ") for f in MET.split(", "))
    return df.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def met(made: DataFrame, said: Words, more: DataFrame | None = None) -> DataFrame:
    """Blocks, each after the answers to it, in order of bucket."""
    rows = _filled(said.answers.where("block is not null").select("block", "bucket", "ids", "totals"), 0)
    if more is not None:
        rows = rows.unionByName(_filled(more, 1))
    rows = rows.unionByName(_filled(made.select("block", "name", "words", "lengths", "tokens", "sizes", "before", "docs", "held", "keys").withColumn("bucket", F.lit(0)), 2))
    return rows.repartition(max(1, math.ceil(said.blocks / 2)), "block").sortWithinPartitions("block", "kind", "bucket")


@dataclass
class Coded:
    """A block: each of its tokens as a number in the order of ids (0: none), with what is known of the numbers."""

    block: int
    name: str | None
    ids: np.ndarray  # of each number, ascending, the first zero
    totals: np.ndarray
    end: int  # the number of a text's end
    tokens: np.ndarray
    weight: np.ndarray  # 1 where a token counts, in a byte each
    sizes: np.ndarray
    before: np.ndarray
    docs: np.ndarray
    held: np.ndarray
    doc_keys: list[int | None]
    totals_of: np.ndarray  # of each token, also of words without an id
    answers: list[dict]

    def keys(self, order: int, shortest: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """(columns of distinct keys in order, lengths, counts, number of the key of each length that ends at each token, or -1)."""
        n, r, bits = len(self.tokens), self.tokens.astype(np.uint32), np.uint64(len(self.ids).bit_length())
        # Length by length: a key is the number of the key without its last word, then that word, so one column is put in order at a time.
        ends, parent, last, counts = [], [], [], []
        for m in range(1, order + 1):
            at = np.flatnonzero(r) if m == 1 else np.flatnonzero((r[1:] > 0) & (ends[-1][:-1] >= 0)) + 1
            key = r[at].astype(np.uint64)
            if m > 1:
                key |= ends[-1][at - 1].astype(np.uint64) << bits
            by, new = _ordered([key])
            starts, at = np.flatnonzero(new), at[by]
            ends.append(np.full(n, -1, np.int32))
            ends[-1][at] = np.cumsum(new, dtype=np.int32) - 1
            key = key[by[starts]]
            parent.append((key >> bits).astype(np.int32))
            last.append((key & (np.uint64(1) << bits) - np.uint64(1)).astype(np.uint32))
            counts.append(np.add.reduceat(self.weight[at], starts, dtype=np.int64) if m > 1 and len(starts) else np.zeros(len(starts), np.int64))
            del at, key, by, new, starts
        # A key stands after those that it begins with, and before all that begin with it.
        up = []
        for m in range(order):
            up.append(np.arange(len(last[m]), dtype=np.int32))
            if m >= shortest:
                up[m] += up[m - 1][parent[m]] + 1
        children = [np.concatenate(([0], np.cumsum(np.bincount(parent[m], minlength=len(last[m - 1]))))).astype(np.int32) for m in range(1, order)]
        size = sum(len(c) for c in last[shortest - 1 :])
        columns, length, weight, index = [np.zeros(size, np.uint32) for _ in range(order)], np.zeros(size, np.uint8), np.zeros(size, np.int64), {}
        for m in range(shortest - 1, order):
            to, k = up[m], np.arange(len(last[m]), dtype=np.int32)
            for c in children[m:]:
                k = c[k]
                to = to + k
            length[to], weight[to] = m + 1, counts[m]
            k = slice(None)
            for j in range(m, -1, -1):
                columns[j][to] = last[j][k]
                k = parent[j][k]
            index[m + 1] = np.append(to, np.int32(-1))[ends[m]]
            ends[m] = None
        return columns, length, weight, index


def coded(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[Coded]:
    """Blocks out of rows of met(). Of the rows no more is kept than the block needs."""
    for _, rows in _runs(batches, ("block",)):
        if rows[-1]["kind"] == 2:
            yield _coded(rows, buckets)


def _coded(rows: list[dict], buckets: int) -> Coded:
    b, said, more = rows[-1], [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
    rows.clear()
    words_ = unpack_words(b["words"], b["lengths"])
    order = np.argsort(_bucket_of(words_, b["name"], buckets), kind="stable")
    ids, totals = np.zeros(len(words_) + 1, np.uint64), np.zeros(len(words_) + 1, np.int64)
    if said:
        ids[order + 1] = np.concatenate([unpack(r["ids"]).astype(np.uint64) for r in said])
        totals[order + 1] = np.concatenate([unpack(r["totals"]).astype(np.int64) for r in said])
    ranked = np.argsort(ids, kind="stable")
    ranked = np.concatenate(([0], ranked[ids[ranked] > 0]))
    number = np.zeros(len(ids), np.int32)
    number[ranked[1:]] = np.arange(1, len(ranked))
    tokens = unpack(b["tokens"])
    sizes, before, held = unpack(b["sizes"]).astype(np.int64), unpack(b["before"]).astype(np.int64), unpack(b["held"]).astype(bool)
    weight = np.repeat(~held, sizes + 1).astype(np.uint8)
    for s, k in zip((np.cumsum(sizes + 1) - sizes - 1).tolist(), before.tolist(), strict=True):
        weight[s : s + k] = 0
    one = np.flatnonzero(np.asarray(pc.equal(words_, pa.scalar(END_WORD, pa.large_binary()))))
    end = int(number[one[0] + 1]) if len(one) else 0
    return Coded(b["block"], b["name"], ids[ranked], totals[ranked], end, number[tokens], weight, sizes, before, unpack(b["docs"]), held, b["keys"], totals[tokens], more)


KEY_ASKS = "bucket int, block long, name string, keys array<long>, columns binary, counts binary"


def _cut(columns: list[np.ndarray], ids: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Where each splitter (a row of ids) stands among keys in order, whose columns are numbers of ``ids``."""
    out = []
    for low, high in zip(np.searchsorted(ids, splitters, "left"), np.searchsorted(ids, splitters, "right"), strict=True):
        a, b = 0, len(columns[0])
        for c, x, y in zip(columns, low.astype(columns[0].dtype), high.astype(columns[0].dtype), strict=True):
            a, b = a + np.searchsorted(c[a:b], x, "left"), a + np.searchsorted(c[a:b], y, "left")
        out.append(a)
    return np.array([0, *out, len(columns[0])], np.int64)


def _framed(columns: list[np.ndarray]) -> bytes:
    parts = [pack(c) for c in columns]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unframed(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(unpack(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def _ask_keys(buckets: int, order: int, shortest: int, splitters: np.ndarray | None):
    """A function for mapInArrow on rows of met(): keys by bucket; without splitters one key of ``STRIDE``, and (bucket -1) how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in coded(batches, buckets):
            ranks, _, counts, _ = b.keys(order, shortest)
            if splitters is None:
                out = [{"bucket": 0, "keys": [int(b.ids[c[k]]) for c in ranks]} for k in range(STRIDE // 2, len(counts), STRIDE)]
                out.append({"bucket": -1, "keys": [len(counts)]})
            else:
                stops = _cut(ranks, b.ids, splitters)
                out = [{"bucket": k, "block": b.block, "name": b.name, "columns": _framed([b.ids[c[stops[k] : stops[k + 1]]] for c in ranks]), "counts": pack(counts[stops[k] : stops[k + 1]])} for k in np.flatnonzero(np.diff(stops)).tolist()]
            del b, ranks, counts
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[a : a + 256], schema=_arrow(KEY_ASKS))

    return run


def splitters(made: DataFrame, said: Words, order: int, shortest: int) -> np.ndarray:
    """Keys (rows) that cut all keys into about even parts of ``KEYS`` at most, drawn from whole blocks. No more than ``MOST``."""
    want = max(SAMPLED, said.blocks // (KEYS // STRIDE * 8))
    some = F.pmod(F.xxhash64("block"), F.lit(1 << 20)) < min(1 << 20, (want << 20) // max(1, said.blocks))
    taken = Words(said.answers.where(some), said.buckets, min(said.blocks, 2 * want))
    sample = met(made.where(some), taken).mapInArrow(handing_back(_ask_keys(said.buckets, order, shortest, None)), KEY_ASKS).select("bucket", "keys").toArrow()
    counted = np.asarray(sample["bucket"]) < 0
    if not counted.any():
        return np.zeros((0, order), np.uint64)
    lengths = [k[0] for k in sample.filter(pa.array(counted))["keys"].to_pylist()]
    rows = np.asarray(sample.filter(pa.array(~counted))["keys"].combine_chunks().flatten()).reshape(-1, order).astype(np.uint64)
    rows = rows[radix_order(rows.T)]
    parts = min(MOST, math.ceil(sum(lengths) * said.blocks / len(lengths) / KEYS))
    return np.unique(rows[np.arange(1, parts) * len(rows) // parts], axis=0) if len(rows) else rows


def asked(made: DataFrame, said: Words, order: int, shortest: int, at: np.ndarray) -> DataFrame:
    """Runs of keys of all blocks, dealt to buckets and in order of bucket and block."""
    asks = met(made, said).mapInArrow(handing_back(_ask_keys(said.buckets, order, shortest, at)), KEY_ASKS).drop("keys")
    return asks.repartition(len(at) + 1, "bucket").sortWithinPartitions("bucket", "block")


@dataclass
class Merged:
    """A bucket: its distinct keys in order with their sums, and the place of each row's keys among them."""

    bucket: int
    rows: list[dict]
    sizes: list[int]
    columns: list[np.ndarray]
    totals: np.ndarray
    of: np.ndarray
    first: np.ndarray  # a place in the rows, joined, of each distinct key


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[Merged]:
    """Buckets out of rows of asked(). The rows' packed keys are given up for the bucket's own."""
    for (bucket,), rows in _runs(batches, ("bucket",)):
        yield _merged(bucket, rows)


def _merged(bucket: int, rows: list[dict]) -> Merged:
    parts = [_unframed(r.pop("columns")) for r in rows]
    sizes = [len(p[0]) for p in parts]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    del parts
    counts = np.concatenate([unpack(r.pop("counts")) for r in rows])
    order, new = _ordered(columns)
    starts = np.flatnonzero(new)
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    first = order[starts]
    return Merged(bucket, rows, sizes, [c[first] for c in columns], np.add.reduceat(counts[order], starts, dtype=np.int64), of, first)
