"""Keys that a third of the rows have: same results, and no task with all of them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dieflow.llm import secret_scan, sharding, simhash
from dieflow.llm.components import _large_star, connected_components

DOCS = "doc_id bigint, text string, source string"


@pytest.fixture
def plain(spark):
    """No adaptive plan and no broadcast: partitions are what the exchanges make."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_value_in_a_third_of_the_rows(plain):
    token = "Zx9Qw8Er7Ty6Ui5Op4As"
    docs = plain.createDataFrame([(i, f"key {token if i % 3 == 0 else f'Zx9Qw8Er7Ty{i:05d}Ui5Op4As'} end", f"s{i % 40}") for i in range(600)], DOCS)
    found = secret_scan.candidates(docs).select("doc_id", F.col("source").alias("owner"), F.col("doc_id").alias("repository"), "found", F.col("doc_id").alias("row"))
    cold, hot = (secret_scan._listed(found, 2, 100, slots=16, least=n) for n in (1 << 40, 20))
    assert Counter(map(str, cold.collect())) == Counter(map(str, hot.collect())) and hot.count() == 400


def test_repositories_decide_too(spark):
    rows = [(i, "key Zx9Qw8Er7Ty6Ui5Op4As end password=abcdefgh", "s1" if i < 30 else f"s{i}") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    one = df.where("source = 's1'").unionAll(spark.createDataFrame([(100 + i, "", f"t{i}") for i in range(30)], DOCS))
    kinds = lambda **k: {(s.kind, s.live) for r in secret_scan.secrets(one, **k).collect() for s in r.spans}
    assert kinds() == {(0, True), (3, True)}
    assert kinds(max_repositories=29) == {(0, False)}
    shown = secret_scan.digest(secret_scan.secrets(df)).where("doc_id = 1").first()
    assert shown.spans.startswith("assign:") and shown.live == ""


def test_star_with_a_third_of_the_edges(plain):
    rng = random.Random(2)
    pairs = [(0, i) for i in range(1, 700)] + [(rng.randrange(1000, 3000), rng.randrange(1000, 3000)) for _ in range(1300)]
    edges = plain.createDataFrame([(max(p), min(p)) for p in set(pairs) if p[0] != p[1]], "a long, b long")
    cold, hot = _large_star(edges), _large_star(edges, slots=16, hot=50)
    assert Counter(map(tuple, cold.collect())) == Counter(map(tuple, hot.collect()))
    roots = [{r.node: r.root for r in connected_components(edges, slots=16, hot=n).collect()} for n in (1 << 40, 50)]
    assert roots[0] == roots[1] and sum(r == 0 for r in roots[0].values()) == 700


def test_row_that_is_a_third_of_all(plain):
    rows = [(7, "the very same row " * 5, "s")] * 300 + [(i, f"text number {i} of its own {i * 7}", "s") for i in range(100, 700)] + [(None, None, None)]
    docs = plain.createDataFrame(rows, DOCS).repartition(8)
    kept = simhash.representatives(docs, hot_rows=50)
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, simhash.representatives(docs).collect()))
    assert kept.where("doc_id = 7").count() == 1
    # The join sees at most one such row of each of the eight partitions.
    join = kept.queryExecution if hasattr(kept, "queryExecution") else kept._jdf.queryExecution()
    assert "LeftSemi" in join.optimizedPlan().toString() and join.optimizedPlan().toString().count("Aggregate") >= 2


def test_slot_with_a_third_of_the_rows(plain):
    rows = [(7, "same", "s")] * 1000 + [(i, f"text {i}", "s") for i in range(2000)]
    docs = plain.createDataFrame(rows, DOCS).repartition(8)
    placed, used = sharding.shard(docs, 5, slots=64, least=100)
    got = placed.collect()
    for shard in range(5):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t) + 16) for i, t, _ in rows)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    slot = next(r.vslot for r in got if r.doc_id == 7)
    assert largest_share(placed.where(F.col("vslot") == slot)) < 0.6  # eight parts over sixteen tasks, where one had them all
