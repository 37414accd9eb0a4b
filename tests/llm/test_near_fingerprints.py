"""The near-duplicate stage has SimHash's step too: what its covering tables link is proposed, and whole sets decide."""

import random

import numpy as np

from dieflow.llm import near


def distance(a, b):
    return (near.fingerprint(a) ^ near.fingerprint(b)).bit_count()


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(9000)}" for _ in range(2500)]
    close = [*base[:-1], "other"]
    far = [f"v{rng.randrange(9000)}" for _ in range(2500)]
    rows = [(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(far)), (4, "a b"), (5, None)]
    sets = [near.shingles(" ".join(x).encode()) for x in (base, close, far)]
    assert distance(sets[0], sets[1]) <= near.RADIUS < distance(sets[0], sets[2])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(near, "pairs", lambda *args: none)  # no minimum hashes
    got = {r.doc_id: r.component_id for r in near.groups(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    monkeypatch.setattr(near, "SIMILARITY", 1.1)
    assert {r.doc_id: r.component_id for r in near.groups(docs).collect()} == {k: k for k in range(1, 6)}


def test_proposals_join_all_sets_of_linked_fingerprints(spark):
    fps = {1: 0, 2: 0, 3: 3, 4: 3, 5: 255, 6: -1}
    sets = spark.createDataFrame([*fps.items()], "id bigint, fp bigint")
    got = {tuple(r) for r in near.by_fingerprints(sets).collect()}
    assert got == {(1, 2), (3, 4), (1, 3)}


def test_fingerprint_of_no_shingles_and_of_stretches(monkeypatch):
    assert near.fingerprint(np.zeros(0, np.uint32)) == 0
    s = np.arange(1000, dtype=np.uint32)
    whole = near.fingerprint(s)
    monkeypatch.setattr(near, "STRETCH", 7)
    assert near.fingerprint(s) == whole
