"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated n-gram model with absolute discounting over (count + 1) / (N + V + 1), which leaves a share for
words not seen. Its n-grams are states; an arc reads a word and costs the logarithm of its probability; where a state has no
arc for a word, its failure arc leads to the state of the shorter history at the cost of the backoff weight. A text is
scored in one walk from left to right that carries the state.

The model of a corpus is as large as the corpus, so it is never sent around: every block of texts asks for the n-grams that
its own texts hold (``ngrams``), with their counts and how many different words follow them, and walks its texts, all
units of the block in step, over the part of the automaton that these make. What is outside that part can't be reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import ngrams
from sluicework.llm.batches import handing_back
from sluicework.session import written

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
ORDER = 3

#: A block's answers; or (block null) of a prefix whose n-grams go on in later buckets how many words follow it there; or (prefix null) how many n-grams of each length occur once and twice.
ANSWERS = "block long, bucket int, totals binary, follow binary, prefix array<long>, n long, m int, once long, twice long"


def _answer(order: int):
    """A function for mapInArrow on rows of ngrams.asked()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ngrams.merged(batches):
            n = len(b.totals)
            length = sum((c > 0).astype(np.uint8) for c in b.columns)
            follow, out = np.zeros(n, np.int64), []
            for m in range(1, order):
                new = np.zeros(n, bool)
                new[:1] = True
                for c in b.columns[:m]:
                    new[1:] |= c[1:] != c[:-1]
                starts = np.flatnonzero(new)
                many = np.add.reduceat(((length == m + 1) & (b.totals > 0)).astype(np.int64), starts)
                own = length[starts] == m  # the prefix itself comes first, unless it is in an earlier bucket
                follow[starts[own]] = many[own]
                if length[0] > m and many[0]:
                    out.append({"prefix": [int(c[0]) for c in b.columns[:m]], "n": int(many[0])})
            out += [{"m": m, "once": int(((length == m) & (b.totals == 1)).sum()), "twice": int(((length == m) & (b.totals == 2)).sum())} for m in range(2, order + 1)]
            at = 0
            for r, size in zip(b.rows, b.sizes, strict=True):
                own = b.of[at : at + size]
                at += size
                out.append({"block": r["block"], "bucket": b.bucket, "totals": ngrams.pack(b.totals[own]), "follow": ngrams.pack(follow[own])})
            del b, length, follow, own  # before the next bucket is read
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[a : a + 256], schema=ngrams._arrow(ANSWERS))

    return run


class Automaton:
    """The part of the model that one block's texts can reach, as flat arrays.

    Nodes are the block's n-grams in order, and one more for words not seen; as a state -1 is the root. ``arc[m]`` has for each place of
    the block's texts the arc that reads the word there from the state of the m - 1 words before it, -1 where there is none.
    """

    def __init__(self, b: ngrams.Coded, order: int, total: int, distinct: int, discounts: list[float], later: dict[tuple, int]) -> None:
        columns, length, _, index = b.keys(order, 1)
        said = sorted(b.answers, key=lambda r: r["bucket"])
        count, follow = (np.concatenate([ngrams.unpack(r[c]) for r in said], dtype=np.int64, casting="unsafe") if said else np.zeros(len(length), np.int64) for c in ("totals", "follow"))
        one = length == 1
        count[one] = b.totals[columns[0][one]]
        parent, suffix = np.full(len(length), -1, np.int32), np.full(len(length), -1, np.int32)
        for m in range(2, order + 1):
            at = np.flatnonzero(index[m] >= 0)
            parent[index[m][at]] = index[m - 1][at - 1]
            suffix[index[m][at]] = index[m - 1][at]
        self._add_later(b, columns, length, follow, later)
        del columns
        p = np.zeros(len(length))
        p[one] = (count[one] + 1) / (total + distinct + 1)
        back = np.ones(len(length))
        for m in range(2, order + 1):
            d = discounts[m - 2]
            has = (length == m - 1) & (count > 0) & (follow > 0)
            back[has] = d * follow[has] / count[has]
            own = np.flatnonzero((length == m) & (count > 0))
            p[own] = (count[own] - d) / count[parent[own]] + back[parent[own]] * p[suffix[own]]
        with np.errstate(divide="ignore"):
            self.log_p, self.log_back = np.log10(np.append(p, 1 / (total + distinct + 1))), np.log10(back)
        del p, back, parent, follow
        self.fail = suffix
        state = (length < order) & (count > 0)
        self.next = np.append(np.where(state, np.arange(len(length), dtype=np.int32), np.where(length == 1, np.int32(-1), suffix)), np.int32(-1))
        self.size = np.append(length, np.uint8(0))
        live = np.append(count > 0, False)
        self.arc = np.stack([np.where(live[index[m]], index[m], np.int32(-1)) for m in range(1, order + 1)])

    @staticmethod
    def _add_later(b: ngrams.Coded, columns: list[np.ndarray], length: np.ndarray, follow: np.ndarray, later: dict[tuple, int]) -> None:
        for prefix, n in later.items():
            at = np.searchsorted(b.ids, np.array(prefix, np.uint64))
            if (at < len(b.ids)).all() and (b.ids[np.minimum(at, len(b.ids) - 1)] == np.array(prefix, np.uint64)).all():
                lo, hi = 0, len(length)
                for c, x in zip(columns, np.array([*at, *[0] * (len(columns) - len(at))], columns[0].dtype), strict=True):
                    lo, hi = lo + np.searchsorted(c[lo:hi], x, "left"), lo + np.searchsorted(c[lo:hi], x, "right")
                follow[lo:hi] += n

    def read(self, state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, log10 of the probability) for each state and the word at a place, along failure arcs as far as needed."""
        cost, after = np.zeros(len(state)), np.full(len(state), -1)
        todo, s = np.arange(len(state)), state
        while len(todo):
            size = self.size[s]
            node = self.arc[size, place[todo]]
            hit = (node >= 0) | (size == 0)  # the root has an arc for every word
            cost[todo[hit]] += self.log_p[node[hit]]
            after[todo[hit]] = self.next[node[hit]]
            todo, s = todo[~hit], s[~hit]
            cost[todo] += self.log_back[s]
            s = self.fail[s]
        return after, cost

    def walk(self, b: ngrams.Coded) -> np.ndarray:
        """The log10 of each unit's probability: all units in step, from the root; the words before a unit's own only set the state."""
        starts = np.cumsum(b.sizes + 1) - b.sizes - 1
        by = np.argsort(-b.sizes, kind="stable")
        starts, sizes, before = starts[by], b.sizes[by], b.before[by]
        state, score = np.full(len(by), -1), np.zeros(len(by))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            k = np.searchsorted(-sizes, -t, "left")  # units longer than t
            state[:k], cost = self.read(state[:k], starts[:k] + t)
            score[:k] += np.where(t >= before[:k], cost, 0)
        out = np.empty(len(by))
        out[by] = score
        return out


SCORES = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(buckets: int, order: int, total: int, distinct: int, discounts: list[float], later: dict[tuple, int]):
    """A function for mapInArrow on rows of ngrams.met(): sums for each text in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ngrams.coded(batches, buckets):
            walked = Automaton(b, order, total, distinct, discounts, later).walk(b)
            unit = np.repeat(np.arange(len(b.sizes)), b.sizes + 1)
            place = np.arange(len(unit)) - np.repeat(np.cumsum(b.sizes + 1) - b.sizes - 1, b.sizes + 1)
            own = (place >= b.before[unit]) & (place < b.sizes[unit])
            unit, known = unit[own], b.totals_of[own]
            each, first, of = np.unique(b.docs, return_index=True, return_inverse=True)
            doc, sums = of[unit], lambda w: np.bincount(doc, w, len(each))  # noqa: B023
            base = np.log10((known + 1) / (total + distinct + 1))
            out = pa.RecordBatch.from_arrays([
                pa.array((b.block >> 33 << 33) + each.astype(np.int64)), pa.array([b.doc_keys[k] for k in first.tolist()], pa.int64()), pa.array(b.held[first]),
                pa.array(sums(None).astype(np.int64)), pa.array(sums(known > 0).astype(np.int64)), pa.array(sums(base)), pa.array(np.bincount(of, walked, len(each))),
            ], [f.split(" ")[0] for f in SCORES.split(", ")])
            del b, walked, unit, place, own, known, base, doc, sums, of  # before the next block is read
            yield out

    return run


def scored(df: DataFrame, held_out, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, learnt from rows where ``held_out`` (a condition on id) does not hold.

    Words are lower-cased in A-Z; a text's end is a token. ``base_score`` sums the logarithms of (count + 1) / (N + V + 1);
    ``score`` is the model's. Discounts are n1 / (n1 + 2 n2) of the n-grams of each length, kept within 0.05 and 0.95. A null
    text is an empty one, of one token; a null id is not held out where the condition is null. Very long texts are scored
    whole, in units of ``ngrams.UNIT`` words that begin with the state before them. Repeated rows are each a text. With
    nothing to learn from all words are unknown. An empty table gives an empty result. Other columns are ignored.
    """
    held = F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False))
    made = ngrams.blocks(df, ngrams.Split(SPACES, b"", order, ends=True), F.lit(None), F.col(f"`{id_col}`"), held, F.col(f"`{text_col}`"))
    said = ngrams.words(made, 1, keep=False)
    total, distinct = said.answers.where("block is null").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n_counted"), F.lit(0))).first()
    at = ngrams.splitters(made, said, order, 1)
    answers = written(ngrams.asked(made, said, order, 1, at).mapInArrow(handing_back(_answer(order)), ANSWERS), "lm-answers")
    counts = {r["m"]: r for r in answers.where("m is not null").groupBy("m").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).collect()}
    ratio = lambda r: r["once"] / (r["once"] + 2 * r["twice"]) if r and r["once"] else 0.5
    discounts = [min(0.95, max(0.05, ratio(counts.get(m)))) for m in range(2, order + 1)]
    # A bucket has at most order - 1 such prefixes, and there are at most ngrams.MOST buckets.
    later = {tuple(r["prefix"]): r["n"] for r in answers.where("prefix is not null").groupBy("prefix").agg(F.sum("n").alias("n")).collect()}
    rows = ngrams.met(made, said, answers.where("block is not null").select("block", "bucket", "totals", "follow"))
    parts = rows.mapInArrow(handing_back(_scores(said.buckets, order, total, distinct, discounts, later)), SCORES)
    whole = parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document's score under a model of the documents whose crc32(doc_id as text) mod 7 is not 2."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda i: F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(7)) == 2)
