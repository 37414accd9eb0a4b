"""Language-model scores from a weighted backoff automaton.

Tokens are words and one end for each text.  Every token is a state, every pair
seen in training an arc.  From state a, with c the training counts,

    arc to b      (c(ab) + m(a) p(b)) / (c(a) + m(a))
    failure arc   m(a) / (c(a) + m(a)), to the root, whose arcs are
                  p(b) = (c(b) + 1) / (N + V + 1)

where m(a), the weight of the prior, grows with c(a) as the number of words
that follow a does.  The weights of a state sum to 1 over all known tokens and
one unknown.  A text is walked from left to right.  A walk that always failed
would weigh every token w by p(w) m(w) / (c(w) + m(w)), since each token is
left once as often as it is entered; an arc that exists adds the logarithm of
its weight over that of the failing way, its gain.

Sizes.  The commonest HEAD tokens (commonest by count, whatever their length)
travel with the walk, and the gains between the CACHED commonest of them in a
dense table: a cache, whose bound holds for any corpus.  All other pairs and
words go through one exchange, each occurrence once, packed by blocks of texts
and dealt out by a hash of the pair, or of the word that is entered if that is
outside the head.  A bucket thus has all there is to know of its pairs and
words: it counts them over the training texts and adds up what each text gains.
A second exchange, by block, brings the sums back to their texts.

A pair of head tokens outside the dense table may still be common: up to
1 / CACHED of all tokens.  If a word that the table leaves out is common enough
for that, pairs are looked for in a SAMPLE of texts, those found are counted
exactly in the pass that counts the table's, and their gains travel too, in a
sorted list beside it.  What the sample misses takes the exchange like any
other: it says where a pair is counted, never whether.

So the largest groups that aren't split are pairs of head tokens with about
`hot` occurrences (a quarter of a bucket, or 1 / MAX_HOT of all tokens), and
words outside the head with under 1 / HEAD of all tokens.  Words outside the
head, and pairs with them, are told apart by 64 bits of hash, words over
MAX_WORD_BYTES everywhere by 128 bits.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dieflow.llm.common import Shared, cut, discard, small_batches, utf8, word_blocks

CACHED = 2048
HEAD = 1 << 18
MAX_WORD_BYTES = 48
#: m(a) = KAPPA * max(c(a), FLOOR) ** BETA for tokens of the head, and its least value for all others.
KAPPA, BETA, FLOOR = 10.0, 0.7, 3
#: The end of a text as a token: no word is empty.
END = b""
#: Distinct words a task counts before it passes its counts on.
FLUSH = 1 << 19
#: Tokens of a block of texts, texts of one at most, and tokens of a bucket on average: raise the first and the last with the memory of a task.
BLOCK, BLOCK_TEXTS, BUCKET = 1 << 20, 1 << 16, 1 << 22
#: One in so many texts is looked through for hot pairs, and one in so many of all tokens makes a pair hot in any case.
SAMPLE, MAX_HOT = 64, 1 << 20
#: Bytes of a pair of head tokens: two ids of 20 bits.
ID_BITS, PAIR_BYTES = 20, 5


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id as text leaves 2 when divided by 7; rows without an id are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(7)) == 2, F.lit(False))


def short(word: bytes) -> bytes:
    """The word, or a space and its digest if it is long; no word has a space."""
    return word if len(word) <= MAX_WORD_BYTES else b" " + xxhash.xxh3_128_digest(word)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c): how often each token, shortened, occurs in a one-column table of texts; the end counts once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            both: Counter[bytes] = Counter()
            for w, n in seen.items():
                both[short(w)] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(both), pa.binary()), pa.array(list(both.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in utf8(batch.column(0)):
                for words in word_blocks(text or b""):
                    seen.update(words)
                    if len(seen) >= FLUSH:
                        yield passed()
                seen[END] += 1
        yield passed()

    return small_batches(texts).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most `most` words and their counts, commonest first.

    A table of words by 16ths of octaves of their count, some hundreds of rows,
    says which levels fit whole; of the next level, words are taken by their
    hash as far as there is room.  Nothing is sorted and no task sees all words.
    """
    fits = counts.where(F.length("word") > 0).withColumn("level", F.floor(F.log2("c") * 16).cast("int"))
    levels = sorted(((r.level, r.n) for r in fits.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    low, left, share = 1 << 30, most, 0.0
    for at, n in levels:
        if n > left:
            share = left / n
            break
        low, left = at, left - n
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(0.98 * share * (1 << 20))
    next_level = F.lit(False) if not share else (F.col("level") == at) & part
    top = fits.where((F.col("level") >= low) | next_level).select("word", "c").toArrow()  # about `most` rows
    rows = sorted(zip(top.column("c").to_pylist(), map(bytes, top.column("word").to_pylist())), key=lambda r: (-r[0], r[1]))[:most]
    return [w for _, w in rows], np.array([c for c, _ in rows], dtype=np.int64)


class Reader:
    """Token ids of texts: 0 is the end, then the head's words, commonest first; others have -1."""

    def __init__(self, head: list[bytes]) -> None:
        self.ids = {w: i + 1 for i, w in enumerate(head)}

    def read(self, text: bytes | None, named: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text's words and of its end, and the hashes of the words without one, if `named`."""
        parts, hashes = [], []
        for words in word_blocks(text or b""):
            ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            for i in np.flatnonzero(ids < 0).tolist():
                w = words[i]
                if len(w) > MAX_WORD_BYTES:
                    w = short(w)
                    ids[i] = self.ids.get(w, -1)
                if named and ids[i] < 0:
                    hashes.append(xxhash.xxh64_intdigest(w, 42))
            parts.append(ids)
        return np.concatenate([*parts, np.zeros(1, dtype=np.int64)]), np.array(hashes, dtype=np.uint64)


def hot_pairs(texts: DataFrame, head: Shared, states: int, least: int) -> np.ndarray:
    """Pairs of head tokens, not both among the `states` commonest, that occur `least` times or more in a sample, as from << ID_BITS | to, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, n = head.build(Reader), [], 0

        def passed() -> pa.RecordBatch:
            pairs, c = np.unique(np.concatenate(held) if held else np.zeros(0, dtype=np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(c, pa.int64())], names=["pair", "c"])

        for batch in batches:
            for text in utf8(batch.column(0)):
                ids = reader.read(text)[0]
                before = np.concatenate([[0], ids[:-1]])
                at = (before >= 0) & (ids >= 0) & ((before >= states) | (ids >= states))
                held.append(before[at] << ID_BITS | ids[at])
                n += len(held[-1])
                if n > FLUSH:
                    yield passed()
                    n = 0
        yield passed()

    counted = small_batches(texts).mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    return np.sort(counted.where(F.col("c") >= least).select("pair").toArrow().column(0).to_numpy())  # at most tokens of the sample / least rows


def found_in(pairs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each pair in a sorted table, or -1."""
    if not len(table):
        return np.full(len(pairs), -1)
    at = np.minimum(np.searchsorted(table, pairs), len(table) - 1)
    return np.where(table[at] == pairs, at, -1)


def count_arcs(texts: DataFrame, head: Shared, states: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each pair of the `states` commonest tokens follows one another, as arcs from * states + to and counts, and the counts of the hot pairs; a text starts in the end's state."""
    table = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, hot = head.build(Reader), table.value
        size = states * states + len(hot)
        total, held, n = np.zeros(size, dtype=np.int64), [], 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                ids = reader.read(text)[0]
                before = np.concatenate([[0], ids[:-1]])
                known = (before >= 0) & (ids >= 0)
                both = known & (before < states) & (ids < states)
                held.append(before[both] * states + ids[both])
                if len(hot):
                    at = found_in(before[known & ~both] << ID_BITS | ids[known & ~both], hot)
                    held.append(states * states + at[at >= 0])
                n += len(ids)
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        found = np.flatnonzero(total)
        for at in range(0, len(found), 1 << 16):
            part = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["arc", "c"])

    arcs = small_batches(texts).mapInArrow(run, "arc long, c long").groupBy("arc").agg(F.sum("c").alias("c")).toArrow()  # at most states squared and the hot pairs
    at, often = arcs.column("arc").to_numpy(), arcs.column("c").to_numpy()
    dense = at < states * states
    counts = np.zeros(len(hot), dtype=np.int64)
    counts[at[~dense] - states * states] = often[~dense]
    return at[dense], often[dense], counts


class Weights:
    """What a state and the root weigh, from the counts of the end and the head's words."""

    def __init__(self, counts: np.ndarray, total: int, distinct: int) -> None:
        self.size = total + distinct + 1
        self.prior = KAPPA * np.maximum(counts, FLOOR).astype(float) ** BETA
        self.least = KAPPA * float(FLOOR) ** BETA
        self.chance = (counts + 1) / self.size
        self.fall = np.log10(self.prior / (counts + self.prior))

    def rare(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Root weight and failure weight, log10, of tokens outside the head with these counts."""
        return np.log10((c + 1) / self.size), np.log10(self.least / (c + self.least))

    def gain(self, pairs: np.ndarray, before: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """What arcs with these counts add to the failing way, given their first tokens (-1 outside the head) and the root's probabilities of the second."""
        prior = np.where(before >= 0, self.prior[np.maximum(before, 0)], self.least)
        return np.log10(1 + pairs / (prior * chance))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned numbers, all first bytes first: equal high bytes then compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _whole(data: memoryview, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
    return out.reshape(-1).view("<u8"), at + n * width


class Block:
    """Occurrences of pairs of a number of texts, packed for their buckets.

    Three kinds: pairs of head tokens; pairs into a head token from outside the
    head; and pairs into a word outside the head.
    """

    #: Bytes of the columns of each kind, the text's number in the block last.
    WIDTHS = ((PAIR_BYTES, 2), (8, 3, 2), (8, 8, 3, 2))

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.ids, self.hashes, self.sizes, self.held = [], [], [], []
        self.tokens = 0

    def add(self, ids: np.ndarray, hashes: np.ndarray, held: bool) -> None:
        self.ids.append(ids)
        self.hashes.append(hashes)
        self.sizes.append(len(ids))
        self.held.append(held)
        self.tokens += len(ids)

    def full(self) -> bool:
        return self.tokens >= BLOCK or len(self.sizes) >= BLOCK_TEXTS

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token, its predecessor and its text's number."""
        to = np.concatenate(self.ids)
        sizes = np.array(self.sizes)
        before = np.concatenate([[0], to[:-1]])
        before[np.cumsum(sizes)[:-1]] = 0  # a text starts in the end's state
        return to, before, np.repeat(np.arange(len(sizes)), sizes)

    def packed(self, to: np.ndarray, before: np.ndarray, text: np.ndarray, done: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, data) of all pairs but those of head tokens that are done, for the tables hold them."""
        name = np.zeros(len(to), dtype=np.uint64)
        name[to < 0] = np.concatenate(self.hashes)
        name_before = np.concatenate([np.zeros(1, dtype=np.uint64), name[:-1]])
        u = np.uint64
        kinds = []
        head = (before >= 0) & (to >= 0)
        at = np.flatnonzero(head & ~done)
        pair = (before[at].astype(u) << u(ID_BITS)) | to[at].astype(u)
        kinds.append((_mix(pair), [pair, text[at]]))
        at = np.flatnonzero((before < 0) & (to >= 0))
        pair = _mix(name_before[at] ^ _mix(to[at].astype(u) + u(1)))
        kinds.append((pair, [pair, to[at], text[at]]))
        at = np.flatnonzero(to < 0)
        second = np.where(before[at] < 0, name_before[at], _mix(before[at].astype(u) + u(2)))
        pair = _mix(name[at] ^ _mix(second + u(1)))
        kinds.append((_mix(name[at]), [name[at], pair, before[at] + 1, text[at]]))  # 0 for a predecessor outside the head
        dealt = []
        for (key, columns), widths in zip(kinds, self.WIDTHS):
            bucket = key % u(self.buckets)
            # Sorted by what comes first too, so that its high bytes compress.
            order = np.lexsort((columns[0], bucket))
            ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=u))
            dealt.append((ends, [c[order].astype(u) for c in columns], widths))
        bits = np.packbits(np.array(self.held, dtype=bool)).tobytes()
        for k in range(self.buckets):
            sizes = [int(ends[k + 1] - ends[k]) for ends, _, _ in dealt]
            if any(sizes):
                parts = [_planes(c[ends[k] : ends[k + 1]], w) for ends, columns, widths in dealt for c, w in zip(columns, widths)]
                yield k, b"".join([struct.pack("<4I", len(self.sizes), *sizes), bits, *parts])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where each run of equal ones begins, and each sorted one's run."""
    order = np.argsort(keys, kind="stable")
    given = keys[order]
    first = np.flatnonzero(np.concatenate([[True], given[1:] != given[:-1]])[: len(given)])
    return order, first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(given))))


def judged(rows: list[tuple[int, bytes]], w: Weights) -> Iterator[tuple[int, bytes]]:
    """(block, data) from a bucket's (block, data): what its texts gain and, for words outside the head, their root weight and how many are known."""
    held, first, columns = [], [0], [[[] for _ in x] for x in Block.WIDTHS]
    for _, data in rows:
        texts, *sizes = struct.unpack_from("<4I", data)
        at = 16 + -(-texts // 8)
        held.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=at - 16, offset=16), count=texts).astype(bool))
        for k, (n, widths) in enumerate(zip(sizes, Block.WIDTHS)):
            for i, width in enumerate(widths):
                x, at = _whole(data, at, n, width)
                columns[k][i].append(x + np.uint64(first[-1]) if i == len(widths) - 1 else x)
        first.append(first[-1] + texts)
    learnt, n = ~np.concatenate(held), first[-1]
    (pair, pair_text), (near, near_to, near_text), (word, into, into_before, into_text) = ([np.concatenate(x).astype(np.uint64) for x in c] for c in columns)

    def counted(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, at, run = _runs(keys)
        return order, at, np.add.reduceat(learnt[text[order]].astype(np.int64), at)[run] if len(at) else run

    gain = np.zeros(n)
    order, _, c = counted(pair, pair_text)
    a, b = (pair[order] >> np.uint64(ID_BITS)).astype(np.int64), (pair[order] & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)
    gain += np.bincount(pair_text[order].astype(np.int64), w.gain(c, a, w.chance[b]), minlength=n)
    order, _, c = counted(near, near_text)
    b = near_to[order].astype(np.int64)
    gain += np.bincount(near_text[order].astype(np.int64), w.gain(c, np.full(len(b), -1), w.chance[b]), minlength=n)
    # Into words outside the head: first their own counts, then those of the pairs.
    order, _, own = counted(word, into_text)
    text = into_text[order].astype(np.int64)
    root, fall = w.rare(own)
    alone, known = np.bincount(text, root, minlength=n), np.bincount(text, own > 0, minlength=n)
    more, _, c = counted(into[order], into_text[order])
    gain += np.bincount(text, root + fall, minlength=n)
    gain += np.bincount(text[more], w.gain(c, into_before[order][more].astype(np.int64) - 1, 10.0 ** root[more]), minlength=n)
    for (block, _), start, end in zip(rows, first, first[1:]):
        some = np.flatnonzero(gain[start:end])
        rare = np.flatnonzero(alone[start:end])
        yield block, b"".join([struct.pack("<2I", len(some), len(rare)), some.astype("<u2").tobytes(), gain[start:end][some].astype("<f8").tobytes(), rare.astype("<u2").tobytes(), alone[start:end][rare].astype("<f8").tobytes(), known[start:end][rare].astype("<u4").tobytes()])


def _sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each value of a column, which come sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", head_words: int = HEAD, cached: int = CACHED, buckets: int | None = None, hot: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows that aren't held out.  base_score adds the
    root's weights alone, score the automaton's.  Null and empty texts are
    their end.  Repeated rows count and come out repeatedly.  If nothing is
    left to learn from, every token is unknown.  Other columns of docs are
    ignored, so their names can't clash.  A very long text is read a stretch at
    a time and held as 8 bytes a token.

    docs is read three times and must give the same rows in the same order when
    a lost task runs again, as a scan or a written table does; a block whose
    parts don't all come back ends the query with an error.
    """
    if head_words + 1 >= 1 << ID_BITS:
        raise ValueError(f"head_words must be under {(1 << ID_BITS) - 1}")
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    train = given.where(~F.col("held_out")).select("text")
    counts = cut(count_words(train), "unigrams")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    words, own = commonest(counts, head_words)
    discard(counts)
    head = Shared(spark, words)
    w = Weights(np.concatenate([[ends], own]), total, distinct)
    hot = hot or max(BUCKET // 4, total // MAX_HOT)
    # A pair outside the table has a word outside it, and is no commoner than that.
    sample = given.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)).select("text")
    pairs = hot_pairs(sample, head, cached, max(1, hot // (2 * SAMPLE))) if len(own) >= cached and own[cached - 1] >= hot else np.zeros(0, dtype=np.int64)
    at, often, counts = count_arcs(train, head, cached, pairs)
    dense = np.zeros(cached * cached, dtype=np.float32)
    dense[at] = w.gain(often, at // cached, w.chance[at % cached])
    gains = w.gain(counts, pairs >> ID_BITS, w.chance[pairs & ((1 << ID_BITS) - 1)])
    automaton = spark.sparkContext.broadcast((w, dense.reshape(cached, cached), ends > 0, pairs, gains))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = buckets or max(parts, -(-total // BUCKET))
    kind = given.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id:{kind},held_out:boolean,n_tokens:bigint,known:bigint,alone:double,weight:double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = head.build(Reader)
        w, dense, ended, pairs, gains = automaton.value
        root, fall = np.log10(w.chance), w.fall
        task, n = TaskContext.get().partitionId(), 0

        def closed(block: Block, ids: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            to, before, text = block.walk()
            name = (task << 32) + n
            texts = len(block.sizes)
            known = to >= 0
            own = to[known]
            both = known & (before >= 0) & (before < cached) & (to < cached)
            alone = np.bincount(text[known], root[own], minlength=texts)
            weight = np.bincount(text[known], root[own] + fall[own], minlength=texts) + np.bincount(text[both], dense[before[both], to[both]], minlength=texts)
            done = both
            if len(pairs):
                place = np.full(len(to), -1)
                rest = known & (before >= 0) & ~both
                place[rest] = found_in(before[rest] << ID_BITS | to[rest], pairs)
                weight += np.bincount(text[place >= 0], gains[place[place >= 0]], minlength=texts)
                done = both | (place >= 0)
            sizes = np.bincount(text, minlength=texts)
            has = np.bincount(text[known], minlength=texts) - (not ended)
            sent = 0
            schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("parts", pa.int32()), ("data", pa.binary()), ("texts", pa.list_(pa.struct([("doc_id", ids[0].type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("alone", pa.float64()), ("weight", pa.float64())])))])
            for k, data in block.packed(to, before, text, done):
                sent += 1
                yield pa.RecordBatch.from_pylist([{"bucket": k, "block": name, "parts": None, "data": data, "texts": None}], schema)
            listed = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(block.held, pa.bool_()), *map(pa.array, (sizes, has, alone, weight))], fields=list(schema.field("texts").type.value_type))
            row = [pa.array([name % buckets]), pa.array([name]), pa.array([sent], pa.int32()), pa.array([None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, texts], pa.int32()), listed)]
            yield pa.RecordBatch.from_arrays(row, schema=schema)

        block, ids = Block(buckets), []
        for batch in batches:
            for i, (t, h) in enumerate(zip(utf8(batch.column(2)), batch.column(1).to_pylist())):
                block.add(*reader.read(t, named=True), h)
                ids.append(batch.column(0).slice(i, 1))
                if block.full():
                    yield from closed(block, ids)
                    block, ids, n = Block(buckets), [], n + 1
        if ids:
            yield from closed(block, ids)

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = automaton.value[0]

        def rows() -> Iterator[pa.RecordBatch]:
            # Blocks' lists of texts pass through as they are.
            for batch in batches:
                through = batch.filter(pc.is_valid(batch.column("texts")))
                if through.num_rows:
                    passed.append(through)
                yield batch.filter(pc.is_valid(batch.column("data"))).select(["bucket", "block", "data"])

        passed: list[pa.RecordBatch] = []
        for group in _sorted_groups(rows(), "bucket"):
            yield from passed
            passed.clear()
            k = group[0]["bucket"]
            made = list(judged([(r["block"], r["data"]) for r in group], w))
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(made), pa.int64()), pa.array([b for b, _ in made], pa.int64()), pa.nulls(len(made), pa.int32()), pa.array([d for _, d in made], pa.binary()), pa.nulls(len(made), texts_type)], names=["bucket", "block", "parts", "data", "texts"])
        yield from passed

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _sorted_groups(batches, "block"):
            whole = [r for r in group if r["texts"] is not None]
            found = sorted((r["bucket"], r["data"]) for r in group if r["texts"] is None)
            if len(whole) != 1 or whole[0]["parts"] != len(found):
                raise RuntimeError("a block of texts changed while a lost task ran again")
            texts = whole[0]["texts"]
            gain, alone, known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for _, data in found:
                a, b = struct.unpack_from("<2I", data)
                x = np.frombuffer(data, "<u2", a, 8)
                gain[x] += np.frombuffer(data, "<f8", a, 8 + 2 * a)
                y, off = np.frombuffer(data, "<u2", b, 8 + 10 * a), 8 + 10 * a + 2 * b
                alone[y] += np.frombuffer(data, "<f8", b, off)
                known[y] += np.frombuffer(data, "<u4", b, off + 8 * b)
            rows = pa.array([t["doc_id"] for t in texts], texts_type.value_type.field("doc_id").type)
            more = [pa.array([t[c] for t in texts], k) for c, k in (("held_out", pa.bool_()), ("n_tokens", pa.int64()))]
            more.append(pa.array(known + np.array([t["known"] for t in texts])))
            more.append(pa.array([total] * len(texts), pa.int64()))
            more += [pa.array(np.array([t[c] for t in texts]) + x) for c, x in (("alone", alone), ("weight", gain))]
            yield pa.RecordBatch.from_arrays([rows, *more], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"bucket bigint, block bigint, parts int, data binary, texts array<struct<{columns}>>"
    walked = small_batches(given).mapInArrow(walk, schema)
    texts_type = to_arrow_type(walked.schema["texts"].dataType)
    few = min(buckets, 20_000)
    dealt = walked.repartitionById(few, F.pmod("bucket", F.lit(few)).cast("int")).sortWithinPartitions("bucket")
    back = dealt.mapInArrow(in_buckets, schema).repartition("block").sortWithinPartitions("block")
    return back.mapInArrow(summed, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
