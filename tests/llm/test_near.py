"""The pipeline's near-duplicate stage against brute force over whole shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dieflow.llm import near

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_drops_near_copies(spark):
    rng = random.Random(3)
    rows = []
    for d in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(10 * d, " ".join(base)), (10 * d + 1, edited(rng, base, 2)), (10 * d + 2, edited(rng, base, 3)), (10 * d + 3, edited(rng, base, 40))]
    rows += [(900, "a b"), (901, "A  b"), (902, "a c"), (903, None), (904, " \n")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), SF)
    got = {r.doc_id for r in kept.collect()}
    assert got == kept_by_hand(rows) and not any(10 * d + 1 in got or 10 * d + 2 in got for d in range(12)) and all(10 * d + 3 in got for d in range(12))


def test_stage_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == kept_by_hand(rows)


@pytest.mark.parametrize("bucket", [2, 16])
def test_large_group_needs_few_pairs(spark, bucket):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, edited(rng, base, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert near.groups(df, bucket=bucket).where("component_id <> 0").count() == 0
    read = near._read(df, ("doc_id",))
    met = near.shared_keys(read.where(F.size("keys") > 0).select("id", "keys").distinct())
    assert near.pairs(met, bucket).count() < 300 * 60


@pytest.mark.parametrize("part", [7, 512])
def test_members_apart_from_the_first_are_compared_exactly(spark, monkeypatch, part):
    # Edits of one text, of which some link to others only, and copies of those edits that link to nothing but them.
    monkeypatch.setattr(near, "SLICE", part)
    monkeypatch.setattr(near.rest, "__defaults__", (near.BUCKET, part))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, edited(rng, base, 6)) for i in range(60)]
    for d in range(100, 130):
        far = edited(rng, base, 11)
        rows += [(d, far), (d + 100, edited(rng, far.split(), 6))]
    met, linked = [], near.rest

    def spied(*a):
        met.append(linked(*a))
        return met[-1]

    monkeypatch.setattr(near, "rest", spied)
    got = {r.doc_id: r.component_id for r in near.groups(spark.createDataFrame(rows, SCHEMA), bucket=3).collect()}
    assert {d for d in got if got[d] == d} == kept_by_hand(rows) and met and met[0].count() > 0


def test_rows_of_one_id(spark):
    rows = [(3, "A b c d e f"), (5, "A b c d e f"), (5, "another text of its own"), (5, "another text of its own"), (None, "A b c d e f"), (None, None)]
    for order in (rows, rows[::-1], [*rows[2:], *rows[:2]]):
        df = spark.createDataFrame(order, SCHEMA).withColumns({c: F.lit("x") for c in ("kept", "mark", "id", "__kept", "root")}).repartition(3)
        kept = corpus_pipeline.drop_near_copies(spark, df, SF)
        assert kept.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, rows[0][1]), (5, rows[2][1]), (None, rows[0][1]), (None, None)], key=str)


def test_long_texts_by_stretches(monkeypatch):
    text = " ".join(f"w{i % 977} Und" for i in range(3000)).encode()
    whole, other = near.shingles(text), near.shingles(b"a b c d e f g")
    keys = near.bands([other, whole, other])
    monkeypatch.setattr(near, "STRETCH", 100)
    assert (near.bands([other, whole, other]) == keys).all() and (keys[0] == keys[2]).all() and (near.bands([whole])[0] == keys[1]).all()
    assert len(whole) == len(shingles(text.decode())) and (np.diff(whole.astype(np.int64)) > 0).all()


def test_links_of_slices():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 32, 200, dtype=np.uint32))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 32, 5, dtype=np.uint32)])) for _ in range(40)]
    want = {(i, j) for i in range(15) for j in range(25) if near.similarity(sets[i], sets[15 + j]) >= near.SIMILARITY}
    assert set(near._linked_to(sets[:15], sets[15:])) == want and want
