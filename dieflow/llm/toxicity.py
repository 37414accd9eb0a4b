"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A linear model scores each sentence, the
document's score is the noisy-or of its sentences with a leak, and the model is
trained through that noisy-or from document labels alone; the sentences with
the highest scores then say where the offence is.  The leak is the score of a
sentence without any evidence; it counts once a document, and sentences count
by what they have over it, so a clean text's score doesn't grow with its
length.  Features are words and the
first letters of words, so that unseen inflections of a learnt word count.
The training rows are a bounded sample; scoring is a narrow map over all rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dieflow.llm.common import Shared, fresh, map_batches

#: The bound on labelled rows that training takes, smallest hash of the id first.
MAX_TRAINING_ROWS = 6000
#: The bounds on their text, in characters: a longer text isn't drawn, and the sample ends before the row that would bring it over the whole.
MAX_ROW_CHARS, MAX_TRAINING_CHARS = 400_000, 40_000_000
#: A feature needs this many documents labelled 1, and at most this share of all documents.
MIN_POSITIVE, MAX_SHARE = 4, 0.5
#: And of documents labelled 1 so many standard deviations over their expected number.
MIN_SURPLUS = 4.0
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> list[str]:
    """The word itself and its prefixes."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class _Known(dict):
    """Those of a word's features that are in a table, kept for the words in use."""

    def __init__(self, table: dict) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 1 << 16:
            self.clear()
        self[word] = found = [f for f in features(word) if f in self.table]
        return found


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        w = self._words.get(word)
        if w is None:
            if len(self._words) > 1 << 17:
                self._words.clear()
            w = self._words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def read(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or over sentences, 0 to 1, and (start, end, score) of the offending ones, in code points; an empty text has the leak alone."""
        none, found = _log_keep(self.bias), []
        keep = none
        for m in _SENTENCE.finditer(text or ""):
            more = sum(map(self.word, set(_WORD.findall(m[0].lower()))))
            if more > 0:
                own = _log_keep(self.bias + more)
                keep += own - none
                if self.bias + more >= _OFFENDING:
                    found.append((m.start(), m.end(), -math.expm1(own)))
        return min(1.0, max(0.0, -math.expm1(keep))), found

    def score(self, text: str | None) -> float:
        return self.read(text)[0]


#: A sentence offends if its own score is at least THRESHOLD.
_OFFENDING = float(np.log(THRESHOLD / (1 - THRESHOLD)))


def _log_keep(z: float) -> float:
    """log(1 - sigmoid(z))."""
    return -z - math.log1p(math.exp(-z)) if z > 0 else -math.log1p(math.exp(z))


def gradient(w: np.ndarray, column: np.ndarray, sentence: np.ndarray, document: np.ndarray, y: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Of the mean negative log-likelihood, by weights and bias (the last of w).

    column and sentence list each feature of each sentence, document has each
    sentence's document, gain each document's share of the loss.
    """
    b, total = float(w[-1]), len(y)
    z = b + np.bincount(sentence, w[column], minlength=len(document))
    p, leak = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (z, b))
    counts = z >= b
    added = np.where(counts, np.log1p(-np.minimum(p, 1 - 1e-12)) - np.log1p(-leak), 0.0)
    keep = np.log1p(-leak) + np.bincount(document, added, minlength=total)
    whole = np.clip(-np.expm1(keep), 1e-9, 1 - 1e-12)
    slope = np.where(y == 1, -(1 - whole) / whole, 1.0) * gain / total
    g = np.where(counts, p, 0.0) * slope[document]
    own = np.where(counts, p - leak, 0.0) * slope[document]
    return np.append(np.bincount(column, g[sentence], minlength=len(w) - 1), leak * slope.sum() + own.sum())


def train(rows: Iterable[tuple[str | None, int]], rounds: int = 120, rate: float = 0.3, l1: float = 1e-3, l2: float = 1e-4) -> Model:
    """Fit by Adam on the noisy-or likelihood; rows are (text, label 0 or 1).

    Without rows, or with one class only, every score is that class's share.
    """
    rows = [(t or "", int(y)) for t, y in rows if y is not None]
    total, positive = len(rows), sum(y for _, y in rows)
    if not total or positive in (0, total):
        share = min(max(positive / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), {})
    # Three walks over the texts hold counts of a few features; one that kept every text's words would hold them all.
    hits = Counter(f for t, y in rows if y for f in {f for w in set(_WORD.findall(t.lower())) for f in features(w)})
    hits = {f: n for f, n in hits.items() if n >= MIN_POSITIVE}
    of_word = _Known(hits)
    seen = Counter(f for t, _ in rows for f in {f for w in set(_WORD.findall(t.lower())) for f in of_word[w]})
    # A feature must be commoner among positives than chance explains to say anything for toxicity.
    expected = {f: seen[f] * positive / total for f in hits}
    names = sorted(f for f, n in hits.items() if seen[f] <= MAX_SHARE * total and n - expected[f] > MIN_SURPLUS * math.sqrt(expected[f]))
    index = {f: i for i, f in enumerate(names)}
    of_word = _Known(index)
    column, sentence, document, n = array("q"), array("q"), array("q"), 0
    for d, (t, _) in enumerate(rows):
        for s in _SENTENCE.findall(t.lower()) or [""]:
            ids = [index[f] for w in set(_WORD.findall(s)) for f in of_word[w]]
            column.extend(ids)
            sentence.extend([n] * len(ids))
            document.append(d)
            n += 1
    column, sentence, document = (np.array(x, dtype=np.int64) for x in (column, sentence, document))
    y = np.array([r[1] for r in rows], dtype=float)
    # Few positives: each class counts for half.
    gain = np.where(y == 1, total / (2 * positive), total / (2 * (total - positive)))
    w, b = np.zeros(len(names) + 1), np.zeros(2 * (len(names) + 1))
    w[-1] = -4.0
    first, second = b[: len(w)], b[len(w) :]
    for step in range(1, rounds + 1):
        grad = gradient(w, column, sentence, document, y, gain)
        grad[:-1] += l2 * w[:-1]
        first[:] = 0.9 * first + 0.1 * grad
        second[:] = 0.99 * second + 0.01 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        w -= move * (0.98**step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - l1 * rate, 0)
    return Model(float(w[-1]), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-4})


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 4; rows without an id are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> list[tuple[str | None, int]]:
    """A bounded sample of labelled rows that are not held out and have a document, by the hash of the id.

    At most MAX_TRAINING_ROWS rows, drawn from twice as many labels, of which
    the join keeps those with a text of at most MAX_ROW_CHARS; null texts
    aren't drawn.  No text moves for other rows.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    picked = known.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(2 * MAX_TRAINING_ROWS)
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") <= MAX_ROW_CHARS)
    rows = given.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id", F.lit(7)), "id")
    out, chars = [], 0
    # Partition by partition: a limit would gather all rows at the driver at once.
    for r in rows.toLocalIterator():
        chars += len(r.text)
        if chars > MAX_TRAINING_CHARS or len(out) == MAX_TRAINING_ROWS:
            break
        out.append((r.text, r.y))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sentences: bool = False, name: str = "score") -> DataFrame:
    """The kept columns and the score, under a name; with sentences, also `offending`: struct(start, end, score) of sentences at or over the threshold.

    Null texts score as empty.  Every row stays, repeated ones too.  The cost
    grows with the text's length, and a text is held once.
    """
    given = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).cast("string").alias(*fresh(docs, "score")))
    at = keep.index(text) if text in keep else len(keep)
    # A few thousand weights: their number follows the bounded sample.
    shared = Shared(docs.sparkSession, (model.bias, model.weights))
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    names = [*keep, name, *(["offending"] if sentences else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.build(lambda x: Model(*x))
        found = [m.read(t) for t in batch.column(at).to_pylist()]
        arrays = [*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.float64())]
        if sentences:
            arrays.append(pa.array([[dict(zip(("start", "end", "score"), s)) for s in f[1]] for f in found], pa.list_(item)))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[: len(keep)])
    return map_batches(given, run, f"{schema}{', ' * bool(keep)}`{name}` double" + ", offending array<struct<start:int,end:int,score:double>>" * sentences)
