"""SentencePiece encoding and decoding by suffix-array matching.

A batch's new words are joined to one text, whose suffix array is built by prefix doubling. Every piece of the
vocabulary is looked up in it by binary search, which gives all its occurrences; these are the edges of a lattice.
Sorted by where they end they are relaxed, all words in step.

The vocabulary is of the BPE kind, where the best path is not the one of the highest total score: it is the one
whose neighbouring pieces would not have been merged otherwise. An encoding by merges is the only path on which
every pair of neighbours is what the merges make of the pair's own text, and the path to each place has one last
piece; so relaxing keeps an edge if it agrees with the piece kept at its start. This gives the library's ids.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.llm.batches import cuts, handing_back
from sluicework.session import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes, about, of words and their ids that a worker remembers, and pairs of pieces; then it starts anew.
REMEMBERED, PAIRS = 1 << 25, 1 << 18
#: Slots in which pairs are looked up all at once; a slot holds one pair, the rest are found in a dictionary.
SLOTS = 1 << 19
#: Bytes of new words that are indexed together, and characters from which a word is indexed by itself and not remembered.
TOGETHER, LONG = 1 << 16, 1 << 10
#: Bytes of text that are encoded together.
SLICE = 1 << 20
#: Bytes of the UTF-8 character that begins with each byte.
_CHARACTER = np.repeat(np.array([1, 2, 3, 4], np.int32), [0xC0, 0x20, 0x10, 0x10])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a byte array in the order of their suffixes, compared over at least ``depth`` bytes (the end counts as zeros)."""
    n = len(text)
    head = np.ndarray((n,), ">u8", text.tobytes() + b"\0" * 8, strides=(1,)).astype(np.uint64)
    order = np.argsort(head)
    run, rank, seen = head[order], np.empty(n, np.int64), 8
    rank[order] = np.cumsum(np.concatenate(([1], run[1:] != run[:-1])))
    while seen < depth:
        later = np.zeros(n, np.int64)
        later[: n - seen] = rank[seen:] if seen < n else 0
        key = rank * (int(later.max()) + 1) + later
        order = np.argsort(key)
        run = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], run[1:] != run[:-1])))
        seen *= 2
    return order


class Pieces:
    """A BPE model's vocabulary, encoder and decoder."""

    def __init__(self, model: bytes) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.rank = {self.names[i]: (-sp.get_score(i), i) for i in range(n) if not special[i]}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte) if sp.is_byte(i)}
        self.raw = [b"" if sp.is_control(i) else bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.names)]
        self.unknown, self.fallback = sp.unk_id(), bool(self.byte_of)
        self.dummy = sp.normalize("a").startswith(SPACE)
        self.unit = self._unit()
        self.loose: dict[str, int] = {}  # characters without a piece of their own, numbered after the vocabulary
        self.loose_names: list[str] = []
        self.pairs: dict[int, bool] = {}
        self.slots = np.full(SLOTS, -1, np.int64)  # of a pair: twice its key, and one more if it stays apart
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self.held = 0
        usable = sorted((p.encode(), i) for p, (_, i) in self.rank.items() if self.merged(p) == [p])
        self.width = max(len(p) for p, _ in usable)
        self.piece_ids = np.array([i for _, i in usable], np.int32)
        self.piece_sizes = np.array([len(p) for p, _ in usable], np.int32)
        self.lower = np.array([p for p, _ in usable], f"S{self.width + 1}")
        self.upper = np.array([p + b"\xff" * (self.width + 1 - len(p)) for p, _ in usable], f"S{self.width + 1}")

    def _unit(self) -> re.Pattern | None:
        """What can be encoded by itself: a word with the spaces before it, or a run of letters or of other characters, if no piece joins such to the next.

        None if a piece goes on after a space that follows other text.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            return None
        texts = [p.lstrip(SPACE) for p in self.rank]
        odd = "".join(sorted({c for p in texts for m in re.findall(r"\w\W|\W\w", p) for c in m if re.match(r"\w", c)}))
        letters, others = (rf"[^\W{odd}]", rf"(?:[\W{odd}](?<!{SPACE}))") if odd else (r"\w", rf"(?:\W(?<!{SPACE}))")
        if any(re.search(f"{letters}{others}|{others}{letters}", p) for p in texts):
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        return re.compile(f"{SPACE}*(?:{letters}+|{others}+)|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """What merging the best-scored neighbours, leftmost first, makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _name(self, token: int) -> str:
        return self.names[token] if token < len(self.names) else self.loose_names[token - len(self.names)]

    def _agree(self, keys: np.ndarray) -> np.ndarray:
        """For each left * 2^32 + right, whether these two stay apart when their texts are merged together."""
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % SLOTS
        held = self.slots[slot]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != keys)
        if len(new):
            each, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            known = np.empty(len(each), bool)
            for k, key in enumerate(each.tolist()):
                said = self.pairs.get(key)
                if said is None:
                    said = self.pairs[key] = self._apart(key >> 32, key & 0xFFFFFFFF)
                known[k] = said
            self.slots[slot[new[first]]] = each << 1 | known
            out[new] = known[back]
        return out

    def _apart(self, left: int, right: int) -> bool:
        a, b = self._name(left), self._name(right)
        return self.merged(a + b) == [a, b]

    def _edges(self, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, token) of every occurrence of a piece in the first n bytes of text (the last of them a separator, with ``width`` + 1 more after it), and of every character without a piece."""
        order = suffix_array(text[:n], self.width).astype(np.int32)
        windows = np.lib.stride_tricks.sliding_window_view(text, self.width + 1)[order]
        keys = windows.view(f"S{self.width + 1}").ravel()
        low, high = np.searchsorted(keys, self.lower, "left").astype(np.int32), np.searchsorted(keys, self.upper, "right").astype(np.int32)
        del windows, keys
        many = high - low
        at = order[np.arange(many.sum(), dtype=np.int32) - np.repeat(np.cumsum(many, dtype=np.int32) - many, many) + np.repeat(low, many)]
        token, stop = np.repeat(self.piece_ids, many), at + np.repeat(self.piece_sizes, many)
        heads = np.flatnonzero((text[:n] & 0xC0 != 0x80) & (text[:n] < 0xFE)).astype(np.int32)
        covered = np.zeros(n, bool)
        covered[at[stop - at == _CHARACTER[text[at]]]] = True
        alone = heads[~covered[heads]]
        if len(alone):
            extra, width = [], _CHARACTER[text[alone]]
            for h, w in zip(alone.tolist(), width.tolist(), strict=True):
                c = text[h : h + w].tobytes().decode("utf-8", "surrogatepass")
                if c not in self.loose:
                    self.loose[c] = len(self.names) + len(self.loose)
                    self.loose_names.append(c)
                extra.append(self.loose[c])
            at, stop, token = np.concatenate([at, alone]), np.concatenate([stop, alone + width]), np.concatenate([token, np.array(extra, np.int32)])
        return at, stop, token

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, by matching, sorting and relaxing."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        text = np.frombuffer(b"\xfe".join(raw) + b"\xfe" * (self.width + 2), np.uint8)
        sizes = np.array([len(r) for r in raw], np.int32)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int32)
        n = int(starts[-1] + sizes[-1]) + 1
        at, stop, token = self._edges(text, n)
        place = (stop - np.repeat(starts, sizes + 1)[at]).astype(np.uint16)  # words are shorter than LONG
        by = np.argsort(place, kind="stable")
        at, stop, token, place = at[by], stop[by], token[by], place[by]
        last, back = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        begins = np.zeros(n + 1, bool)
        begins[starts] = True
        cuts = np.append(np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))), len(place))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, e, t = at[a:b], stop[a:b], token[a:b]
            first = begins[s]
            ready = ~first & (last[s] >= 0)
            good = first
            if ready.any():
                good = first.copy()
                good[ready] = self._agree(last[s[ready]].astype(np.int64) << 32 | t[ready])
            last[e[good]], back[e[good]] = t[good], s[good]
        # All paths back at once; read by place, the tokens that end on a path are the words' ids in order.
        ends = starts + sizes
        on, step = np.zeros(n + 1, bool), ends[sizes > 0]
        while len(step):
            on[step] = True
            step = back[step]
            step = step[~begins[step]]
        places = np.flatnonzero(on)
        cut = np.concatenate(([0], np.searchsorted(places, ends, "right"))).tolist()
        found = last[places]
        ids = found.tobytes()
        for w, a, b in zip(words, cut[:-1], cut[1:], strict=True):
            self.words[w] = ids[4 * a : 4 * b]
        for k in np.unique(np.searchsorted(cut, np.flatnonzero(found >= len(self.names)), "right") - 1).tolist():
            self.words[words[k]] = self._spelt_out(found[cut[k] : cut[k + 1]])
        self.held += sum(len(r) for r in raw) + len(ids) + 250 * len(words)

    def _long(self, word: str) -> bytes:
        """Ids of one long word. It is indexed in segments that overlap by the longest piece; the pieces kept so far carry over, so memory is a few bytes a byte of the word."""
        raw = word.encode("utf-8", "surrogatepass")
        n = len(raw)
        last = array("i", bytes(4 * (n + 1)))  # the piece kept that ends at each place, plus one
        for a in range(0, n, TOGETHER):
            b = a + TOGETHER + self.width
            while b < n and raw[b] & 0xC0 == 0x80:
                b += 1
            part = raw[a:b]
            at, stop, token = self._edges(np.frombuffer(part + b"\xfe" * (self.width + 3), np.uint8), len(part) + 1)
            by = np.argsort(at, kind="stable")
            by = by[: np.searchsorted(at[by], TOGETHER)]
            pairs = self.pairs
            for s, e, t in zip((at[by] + a).tolist(), (stop[by] + a).tolist(), token[by].tolist(), strict=True):
                before = last[s] - 1
                if before < 0:
                    if s:
                        continue
                    last[e] = t + 1
                    continue
                key = before << 32 | t
                apart = pairs.get(key)
                if apart is None:
                    apart = pairs[key] = self._apart(before, t)
                if apart:
                    last[e] = t + 1
            if len(pairs) > PAIRS:
                pairs.clear()
        out, e = array("i"), n
        while e:
            t = last[e] - 1
            out.append(t)
            e -= len(self._name(t).encode("utf-8", "surrogatepass"))
        found = np.frombuffer(out, np.int32)[::-1]
        return self._spelt_out(found) if (found >= len(self.names)).any() else found.tobytes()

    def _spelt_out(self, found: np.ndarray) -> bytes:
        out = array("i")
        for t in found.tolist():
            out.extend(self._spelt(t))
        return out.tobytes()

    def _spelt(self, token: int) -> list[int]:
        """The id of a piece, or those of a character that has none."""
        if token < len(self.names):
            return [token]
        c = self.loose_names[token - len(self.names)]
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.ids(texts)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """An array of 32-bit ids for each text."""
        if self.held > REMEMBERED:
            self.words.clear()
            self.held = 0
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
            self.slots.fill(-1)
            self.loose.clear()
            self.loose_names = []
        lines = [self.library.normalize(t) for t in texts]
        split = [self.unit.findall(x) if self.unit else [x] * bool(x) for x in lines]
        new = dict.fromkeys(w for words in split for w in words if w not in self.words)
        part, size, long = [], 0, []
        for w in new:
            if len(w) >= LONG:
                long.append(w)
                self.words[w] = self._long(w)
                continue
            part.append(w)
            size += len(w)
            if size >= TOGETHER:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)
        known = self.words
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]
        for w in long:
            del known[w]
        return out

    def forget(self) -> None:
        """Drops words, so that a worker that waits for other tasks holds the vocabulary and at most about ``PAIRS`` pairs, which the next task needs as well."""
        self.words = {}
        self.held = 0

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: pieces with spaces for marks, runs of bytes as UTF-8, without the added first space."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        if self.dummy and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


_LOADED: dict[str, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode(df: DataFrame, text_col: str = "text", model_path: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of df's columns, or of ``keep``), ids and decoded (the text that the ids stand for) for every row.

    A null text is encoded as an empty one, which has no ids. Very long texts are encoded whole, a long run without
    spaces segment by segment. Rows are taken by ``SLICE`` bytes of text, so memory doesn't grow with a batch. Columns of
    any name can be kept, since they stay inside ``row``; leave the text out of ``keep`` where decoded replaces it, so
    that it travels once. The driver reads the model and sends it along (half a megabyte), so executors need no file.
    An empty table gives an empty result; ties and repeated rows stay, each with its ids.
    """
    model = Path(model_path).read_bytes()
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for a, b in cuts(batch.column(1), SLICE):
                part = batch.slice(a, b - a)
                ids = pieces.ids([x or "" for x in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([pieces.decode(x.tolist()) for x in ids], pa.string())], ["row", "ids", "decoded"])
        pieces.forget()

    rows = df.select(F.struct(*[df[f"`{c}`"] for c in (df.columns if keep is None else keep)]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(handing_back(run), T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, n_tokens, ids and the decoded text's digest for every document."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
