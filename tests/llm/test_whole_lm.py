"""The whole backoff automaton, every pair an arc, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dieflow.llm import ngram_lm, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ""]


def is_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def scores_by_hand(rows, head=()):
    """What score() returns, given the head's words."""
    rows = [(d, tokens(t)) for d, t in rows]
    c = Counter(w for d, ws in rows if not is_out(d) for w in ws)
    n, z = sum(c.values()), sum(c.values()) + len(c) + 1
    pairs = Counter(p for d, ws in rows if not is_out(d) for p in zip(["", *ws], ws))
    root = lambda w: (c[w] + 1) / z

    def arc(a, b):
        m = 10 * max(c[a], 3) ** 0.7 if a in head or a == "" else 10 * 3**0.7
        return math.log10((pairs[a, b] + m * root(b)) / (c[a] + m))

    return sorted((str(d), is_out(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(root(w)) for w in ws), sum(arc(*p) for p in zip(["", *ws], ws))) for d, ws in rows)


def same(got, want):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect())
    want = sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-6, atol=1e-4)


@pytest.mark.parametrize("sizes", [{"cached": 16, "head_words": 100, "buckets": 3}, {"cached": 2, "head_words": 1}, None])
def test_every_pair_is_an_arc(spark, sizes, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = queries.op6_backoff_lm(spark, SF) if sizes is None else ngram_lm.score(docs, **sizes)
    counts = ngram_lm.count_words(docs.where(~ngram_lm.held_out(docs.doc_id)).select("text"))
    head = {w.decode() for w in ngram_lm.commonest(counts, (sizes or {}).get("head_words", ngram_lm.HEAD))[0]}
    same(got, scores_by_hand(rows, head))


def test_odd_rows_and_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    long = "L" * 100
    rows = [(i, " ".join(rng.choice(["the", "Cat", long, "sat", f"r{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(200)]
    rows += [(None, "the cat"), (None, None), (300, None), (301, ""), (302, " \t\n"), (303, "né   é"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("bucket", ngram_lm.F.lit(1)).withColumn("block", ngram_lm.F.lit("x"))
    monkeypatch.setattr(ngram_lm, "BLOCK", 64)
    monkeypatch.setattr(ngram_lm, "FLUSH", 8)
    everything = {w for _, t in rows for w in tokens(t)}
    same(ngram_lm.score(df.repartition(3), cached=4, buckets=5), scores_by_hand(rows, everything))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if is_out(i))
    rows = [(held, "a b"), (held, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(ngram_lm.score(df), scores_by_hand(rows))
    assert ngram_lm.score(df.limit(0)).count() == 0


def test_states_sum_to_one():
    counts, pairs = np.array([40, 900, 70, 5, 3, 1]), {1: {0: 30, 2: 50, 5: 1}, 0: {1: 40}, 4: {3: 2}}
    w = ngram_lm.Weights(counts, int(counts.sum()), len(counts))
    unknown = 1 / w.size
    for a in range(len(counts)):
        c = np.array([pairs.get(a, {}).get(b, 0) for b in range(len(counts))])
        c[1] += counts[a] - c.sum()  # every occurrence is followed by something
        arcs = w.chance * 10.0 ** (w.gain(c, np.full(len(c), a), w.chance) + w.fall[a])
        assert math.isclose(arcs.sum() + unknown * 10 ** w.fall[a], 1, rel_tol=1e-12)


def test_every_bucket_answers_every_block():
    w = ngram_lm.Weights(np.array([2, 2]), 4, 2)
    block = ngram_lm.Block(2)
    block.add(np.array([1, -1, 0]), np.array([7], dtype=np.uint64), False)
    sent = list(block.packed(*block.walk(), np.zeros(3, dtype=bool)))
    assert sent and all([b for b, _ in ngram_lm.judged([(9, data), (8, data)], w)] == [9, 8] for _, data in sent)


def test_head_takes_part_of_a_level(spark):
    df = spark.createDataFrame([(bytes(f"w{i}", "ascii"), 5 if i < 3 else 2) for i in range(1000)], "word binary, c long")
    for most, at_least in ((2, 1), (3, 3), (500, 400), (5000, 1000)):
        words, own = ngram_lm.commonest(df, most)
        assert at_least <= len(words) <= most and list(own) == sorted(own, reverse=True)


@pytest.mark.parametrize("sample", [1, 3])
def test_hot_pairs_are_counted_beside_the_table(spark, monkeypatch, sample):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha beta", "of", "of", "the", "the", *(f"r{rng.randrange(300)}" for _ in range(5))]) for _ in range(40))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(ngram_lm, "SAMPLE", sample)
    words = [w for w, _ in Counter(w for d, t in rows if not is_out(d) for w in tokens(t)).most_common() if w]
    head = ngram_lm.Shared(spark, [w.encode() for w in words])
    train = df.where(~ngram_lm.held_out(df.doc_id)).select("text")
    pairs = ngram_lm.hot_pairs(train, head, 3, 300)
    names = ["", *words]
    counts = Counter(p for d, t in rows if not is_out(d) for p in zip(["", *tokens(t)], tokens(t)))
    want = {p: n for p, n in counts.items() if n >= 300 and max(map(names.index, p)) >= 3}
    shown = [(names[p >> ngram_lm.ID_BITS], names[p & (1 << ngram_lm.ID_BITS) - 1]) for p in pairs.tolist()]
    assert dict.fromkeys(shown) == dict.fromkeys(want, None) and ("alpha", "beta") in want
    assert dict(zip(shown, ngram_lm.count_arcs(train, head, 3, pairs)[2].tolist())) == want
    same(ngram_lm.score(df, cached=3, hot=60, buckets=4), scores_by_hand(rows, set(words)))
    # A block sends no occurrence of a pair that the tables hold.
    block = ngram_lm.Block(1)
    ids = np.array([names.index(w) for w in ["alpha", "beta"] * 50 + [""]])
    block.add(ids, np.array([], dtype=np.uint64), False)
    to, before, text = block.walk()
    done = ngram_lm.found_in(before << ngram_lm.ID_BITS | to, pairs) >= 0
    sent = sum(len(data) for _, data in block.packed(to, before, text, done))
    assert done.sum() >= 50 and sent < sum(len(data) for _, data in block.packed(to, before, text, np.zeros(len(to), dtype=bool)))
