"""Benchmark decontamination with a BM25 index and block-max WAND.

The benchmark's items are the indexed side, in blocks of bounded size; every
window of every training text is a query.  Scores are BM25 over an item's own
best score, so one threshold fits all items.  Most windows fall at WAND's first
test, that the terms' upper bounds reach the threshold at all; it is made for
all windows of a text at once.  The rest run block-max WAND, and what it
retrieves is verified by the overlap of the item's question and answer.

Texts are mapped where they lie: nothing is shuffled but the few hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dieflow.llm.common import Shared, cut, fresh, map_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
POSTINGS_BLOCK = 16
#: Half-windows of a text that the first test takes at once, which bounds memory on very long texts.
CELLS = 256
#: Items a bound of the first test covers, and the share of the threshold that common terms may make up.
BOUND_BLOCK, COMMON = 1, 0.6
#: Bounds of one block of the index.
MAX_ITEMS, MAX_CHARS = 4_000, 8 << 20

_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\W")
_LAST_SENTENCE = re.compile(r"(?s)^(.*[.!?\n])\s*(\S.*)$")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence and those of it; an item of one sentence is all question."""
    m = _LAST_SENTENCE.match(text.strip())
    question, answer = (words(m[1]), words(m[2])) if m else ([], words(text))
    return (question, answer) if question else (answer, [])


def shingles(of: Sequence[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(of[i : i + size]) for i in range(len(of) - size + 1)} or ({tuple(of)} if of else set())


@dataclass
class Postings:
    items: list[int]
    impacts: list[float]
    most: float
    block_most: list[float]
    block_last: list[int]


@dataclass
class Statistics:
    """Of all items that have words: how many, how many have each term, their words together, and those of the longest."""

    n: int = 0
    df: Counter[str] = field(default_factory=Counter)
    total: int = 0
    longest: int = 0

    def add(self, text: str) -> None:
        if of := words(text):
            self.n += 1
            self.df.update(set(of))
            self.total += len(of)
            self.longest = max(self.longest, len(of))

    def within(self, items: Sequence[tuple[int, str]]) -> Statistics:
        """The same with the terms of some items alone."""
        return Statistics(self.n, Counter({t: self.df[t] for _, x in items for t in words(x)}), self.total, self.longest)


class Index:
    """An inverted index of (item_id, text) pairs; items without words are left out.

    Weights and windows follow the statistics of the whole benchmark, of which
    the items may be a part.
    """

    def __init__(self, items: Sequence[tuple[int, str]], whole: Statistics | None = None) -> None:
        if whole is None:
            whole = Statistics()
            for _, text in items:
                whole.add(text)
        self.ids, self.parts, counts = [], [], []
        for item_id, text in items:
            if tf := Counter(words(text)):
                self.ids.append(item_id)
                self.parts.append(question_and_answer(text))
                counts.append(tf)
        n, df = whole.n, whole.df
        lengths = [sum(tf.values()) for tf in counts]
        mean = whole.total / n if n else 1
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, tf in enumerate(counts):
            raw = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * lengths[i] / mean)) for t, c in tf.items()}
            best = sum(raw.values())
            for t, x in raw.items():
                lists[t].append((i, float(x / best)))
        self.terms = {t: k + 1 for k, t in enumerate(lists)}
        self.postings: list[Postings | None] = [None]
        for entries in lists.values():
            blocks = [entries[k : k + POSTINGS_BLOCK] for k in range(0, len(entries), POSTINGS_BLOCK)]
            self.postings.append(Postings([e[0] for e in entries], [e[1] for e in entries], max(e[1] for e in entries), [max(e[1] for e in b) for b in blocks], [b[-1][0] for b in blocks]))
        #: A window and the next share half their words, so every run of words as long as the longest item lies in one.
        self.stride = max(32, whole.longest)
        self._bound_terms(len(counts), df, lists)

    def _bound_terms(self, n: int, df: Counter, lists: dict) -> None:
        """Upper bounds for the first test, by blocks of BOUND_BLOCK items.

        The commonest terms count together, as the most any item of the block
        has of them; every other term counts by its maximum in the block.
        """
        mass, common = np.zeros(n), set()
        for t in sorted(lists, key=lambda t: (-df[t], t)):
            trial = mass.copy()
            for i, x in lists[t]:
                trial[i] += x
            if trial.max() > COMMON * THRESHOLD:
                break
            mass, common = trial, common | {t}
        self.n_blocks = -(-n // BOUND_BLOCK)
        self.common = np.array([mass[k * BOUND_BLOCK : (k + 1) * BOUND_BLOCK].max() for k in range(self.n_blocks)])
        most: list[dict[int, float]] = [{}]
        for t, entries in lists.items():
            of: dict[int, float] = {}
            for i, x in entries if t not in common else ():
                of[i // BOUND_BLOCK] = max(of.get(i // BOUND_BLOCK, 0.0), x)
            most.append(of)
        self.sizes = np.array([len(m) for m in most])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bound_block = np.array([k for m in most for k in m], dtype=np.int64)
        self.bound = np.array([x for m in most for x in m.values()])

    def windows(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """The windows of a text's term ids in which the upper bounds of some block reach the threshold."""
        if not self.n_blocks:
            return []
        n = -(-len(ids) // self.stride)
        cell = np.flatnonzero(self.sizes[ids])
        # A term counts once in a cell of half a window.
        key = np.unique(cell // self.stride * len(self.sizes) + ids[cell])
        cell, term = np.divmod(key, len(self.sizes))
        sizes = self.sizes[term]
        at = np.arange(int(sizes.sum())) + np.repeat(self.firsts[term] - (np.cumsum(sizes) - sizes), sizes)
        sums = np.bincount(np.repeat(cell, sizes) * self.n_blocks + self.bound_block[at], self.bound[at], minlength=n * self.n_blocks).reshape(n, self.n_blocks)
        both = sums if n < 2 else sums[:-1] + sums[1:]
        found = np.flatnonzero((both + self.common >= threshold - 1e-9).any(axis=1))
        return [(int(k) * self.stride, min(len(ids), (int(k) + 2) * self.stride)) for k in found]

    def search(self, terms: Sequence[int], threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) of every item at or over the threshold, by block-max WAND."""
        cursors = [[0, self.postings[t]] for t in terms]
        while True:
            cursors = [c for c in cursors if c[0] < len(c[1].items)]
            cursors.sort(key=lambda c: c[1].items[c[0]])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[1].most
                if total >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return
            item = cursors[pivot][1].items[cursors[pivot][0]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1].items[cursors[pivot + 1][0]] == item:
                pivot += 1
            # The blocks in which the item would lie, in every list up to the pivot.
            reach, nearest = 0.0, None
            for c in cursors[: pivot + 1]:
                b = bisect_left(c[1].block_last, item, c[0] // POSTINGS_BLOCK)
                if b < len(c[1].block_last):
                    reach += c[1].block_most[b]
                    nearest = c[1].block_last[b] if nearest is None else min(nearest, c[1].block_last[b])
            if reach >= threshold - 1e-9:
                if cursors[0][1].items[cursors[0][0]] == item:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += c[1].impacts[c[0]]
                        c[0] += 1
                    if score >= threshold - 1e-9:
                        yield item, score
                else:
                    for c in cursors[:pivot]:
                        c[0] = bisect_left(c[1].items, item, c[0])
            else:
                # No item up to the nearest block end, or up to the next list's current one, can reach the threshold.
                to = nearest + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][1].items[cursors[pivot + 1][0]])
                to = max(to, item + 1)
                for c in cursors[: pivot + 1]:
                    c[0] = bisect_left(c[1].items, to, c[0])

    def overlap(self, item: int, window: Sequence[str]) -> tuple[float, float]:
        """Shares of the question's five-word shingles and of the answer's words that the window has."""
        question, answer = self.parts[item]
        size = min(SHINGLE, len(question))
        wanted, given = shingles(question, size), shingles(window, size)
        there = set(window)
        return len(wanted & given) / len(wanted), (len(set(answer) & there) / len(set(answer)) if answer else 1.0)

    def _stretches(self, text: str) -> Iterator[list[str]]:
        """The text's words, CELLS half-windows and one at a time; the next stretch begins with that one, so windows stay as they were."""
        held: list[str] = []
        at = 0
        while at < len(text):
            end = at + (1 << 20)
            if end < len(text):
                m = _GAP.search(text, end)
                end = m.start() if m else len(text)
            held += words(text[at:end])
            at = end
            while len(held) > (CELLS + 1) * self.stride:
                yield held[: (CELLS + 1) * self.stride]
                held = held[CELLS * self.stride :]
        yield held

    def leaks(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of every item found in the text, the best window's, in item order."""
        best: dict[int, tuple[float, float, float]] = {}
        for of in self._stretches(text or ""):
            ids = np.fromiter(map(self.terms.get, of, repeat(0)), dtype=np.int64, count=len(of))
            for start, end in self.windows(ids, threshold):
                for item, score in self.search([int(t) for t in np.unique(ids[start:end]) if t], threshold):
                    q, a = self.overlap(item, of[start:end])
                    if q >= overlap and a >= overlap and (q, a, score) > best.get(item, (0, 0, 0)):
                        best[item] = (q, a, score)
        return sorted((self.ids[i], score, q, a) for i, (q, a, score) in best.items())


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks within the bounds, streamed to the driver one after the other."""
    block, chars = [], 0
    for r in items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if block and (len(block) >= MAX_ITEMS or chars + len(r.t) > MAX_CHARS):
            yield block
            block, chars = [], 0
        block.append((r.i, r.t))
        chars += len(r.t)
    if block:
        yield block


def _indexes(spark: SparkSession, items: DataFrame) -> Iterator[Shared]:
    """Each block of the benchmark with the statistics of all blocks, sent to the executors when it is asked for."""
    whole = Statistics()
    for block in blocks(items):
        for _, text in block:
            whole.add(text)
    for block in blocks(items):
        yield Shared(spark, (block, whole.within(block)))  # within MAX_ITEMS and MAX_CHARS


def _hits(docs: DataFrame, index: Shared, keep: Sequence[str], text: str, threshold: float, overlap: float) -> DataFrame:
    given = docs.select(*keep, F.col(text).cast("string").alias(*fresh(docs, "query")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[: len(keep)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = index.build(lambda x: Index(*x))
        rows, hits = [], []
        for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            found = of.leaks(t, threshold, overlap)
            rows += [k] * len(found)
            hits += found
        kept = batch.take(pa.array(rows, pa.int64())).columns[:-1]
        more = [pa.array([h[i] for h in hits], kind) for i, kind in enumerate((pa.int64(), *[pa.float64()] * 3))]
        return pa.RecordBatch.from_arrays([*kept, *more], names=[*keep, "item_id", "score", "question_overlap", "answer_overlap"])

    return map_batches(given, run, f"{kinds}, item_id bigint, score double, question_overlap double, answer_overlap double")


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row for each (row of docs, benchmark item) whose item is found in the text: the kept columns, item_id, score, question_overlap and answer_overlap.

    Null and empty texts hold nothing; null items, and items without words, are
    found nowhere; equal items are each found.  Repeated rows of docs come out
    repeatedly.  A benchmark over the bounds is searched block by block, one
    block at the executors at a time, with the weights of the whole; so what is
    found doesn't depend on the blocks.  The cost grows with the text's length.
    """
    out = None
    for index in _indexes(docs.sparkSession, items):
        hits = _hits(docs, index, keep, text, threshold, overlap)
        # What earlier blocks found is written, so each block is a pass of its own.
        out = hits if out is None else cut(out, "hits").unionAll(hits)
    if out is None:
        out = _hits(docs.limit(0), Shared(docs.sparkSession, ([], Statistics())), keep, text, threshold, overlap)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs whose text holds no item of the benchmark; all columns stay.

    Null and empty texts hold none and stay; repeated rows stay or go together.
    Each further block of a benchmark over the bounds searches what the blocks
    before have left, written in between.
    """
    at = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    left = docs
    for index in _indexes(docs.sparkSession, items):

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            of = index.build(lambda x: Index(*x))
            return batch.filter(pa.array([not of.leaks(t, threshold, overlap) for t in batch.column(at).to_pylist()], pa.bool_()))

        left = map_batches(left if left is docs else cut(left, "clean"), run, schema)
    return left
