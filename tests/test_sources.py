import random
import struct

import pytest

from dieflow.operators import metrics
from dieflow.plans.derive import wafers
from dieflow.sources import tables, wmap

ROWS = [(1, 7, 1_600_000_000_000_000, "center", "train", 2, 3, bytes([0, 1, 2, 1, 1, 5])), (2, 7, 0, "unknown", "unsplit", 1, 1, b"\x01"), (-3, -1, -5, "none", "test", 0, 4, b"")]


def test_round_trip():
    assert wmap.parse(wmap.serialize(ROWS)) == ROWS
    assert wmap.parse(wmap.serialize([])) == []


@pytest.mark.parametrize(
    "damage,message",
    [
        (lambda b: b[:31], "header alone has 32"),
        (lambda b: b"WAFERMAX" + b[8:], "begins with"),
        (lambda b: b[:8] + struct.pack("<I", 2) + b[12:], "format version 2"),
        (lambda b: b[:12] + struct.pack("<I", 33) + b[16:], "records of 33 bytes"),
        (lambda b: b + b"\0", "the file has"),
        (lambda b: b[:16] + struct.pack("<Q", 1 << 63) + b[24:], "the file has"),
        (lambda b: b[: 32 + 16] + struct.pack("<Q", 1 << 60) + b[32 + 24 :], "record 0: bins at"),
        (lambda b: b[: 32 + 28] + b"\x09" + b[32 + 29 :], "record 0: truth 9 or split . has no name"),
    ],
)
def test_corruption(damage, message):
    with pytest.raises(wmap.WmapError, match=message.replace("(", r"\(")):
        wmap.parse(damage(wmap.serialize(ROWS)))


def test_data_source(spark, tmp_path):
    wmap.register(spark)
    w = wafers(spark, "/root/testdata/sf0.001").select(*wmap.COLUMNS)
    path = str(tmp_path / "maps")
    w.repartition(3).write.format("wmap").mode("overwrite").save(path)
    w.repartition(2).write.format("wmap").mode("overwrite").save(path)
    back = spark.read.format("wmap").option("recordsPerPartition", 40).load(path)
    key = lambda r: r.wafer_id
    want = sorted(w.collect(), key=key)
    assert sorted(back.collect(), key=key) == want and sorted(wmap.read_wmap(spark, path).collect(), key=key) == want
    assert back.rdd.getNumPartitions() >= 5
    assert back.where("split = 'val' and lot_id in (1, 2)").count() == w.where("split = 'val' and lot_id in (1, 2)").count() > 0


def test_excursion_files(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("# comment\nexcursion,7,center,100,200\nwafer,1,7\nwafer,1,8\nexcursion,8,loc,-5,6\n\n")
    e, w = tables.read_excursions(spark, str(p))
    assert sorted(map(tuple, e.collect())) == [(7, "center", 100, 200), (8, "loc", -5, 6)] and w.collect()[0].excursion_id == 8
    tables.write_excursions(e, w, str(tmp_path / "out"))
    e2, w2 = tables.read_excursions(spark, str(tmp_path / "out"))
    assert sorted(e2.collect()) == sorted(e.collect()) and w2.collect() == w.collect()
    p.write_text("excursion,7,center,100,200\nwafer,x,7\n")
    with pytest.raises(tables.TableError, match=":2: bad line 'wafer,x,7'"):
        tables.read_excursions(spark, str(p))
    p.write_text("wafer,1,7\n")
    with pytest.raises(tables.TableError, match="no excursions"):
        tables.read_excursions(spark, str(p))


def test_alarm_files(spark, tmp_path):
    p = tmp_path / "alarms.csv"
    p.write_text("# c\nexcursion_id,pattern,pattern_wafers,first_sorted_h,alarm_h\n6,random,119,21,50\n# x\n22,edge_loc,165,29,0\n")
    assert sorted(map(tuple, tables.read_alarms(spark, str(p)).collect())) == [(6, "random", 119, 21.0, 50.0), (22, "edge_loc", 165, 29.0, 0.0)]
    p.write_text("h\n6,nonsense,1,2,3\n")
    with pytest.raises(tables.TableError, match="bad line"):
        tables.read_alarms(spark, str(p))


def test_logits(spark, tmp_path):
    rows = [(1, [float(k) for k in range(9)]), (5, [0.5] * 9)]
    (tmp_path / "a.logits").write_bytes(tables.serialize_logits(rows))
    got = tables.read_logits(spark, str(tmp_path))
    assert sorted((r.wafer_id, r.logits) for r in got.collect()) == rows
    w = spark.createDataFrame([(1,), (2,)], "wafer_id int")
    assert tables.join_logits(w, got, strict=False).where("logits is null").count() == 1
    with pytest.raises(Exception, match="wafer 2: no logits"):
        tables.join_logits(w, got).collect()
    with pytest.raises(tables.TableError):
        tables.parse_logits(b"WCNNLOGT\x01\0\0\0")


def test_lists_to_bins(spark):
    df = spark.createDataFrame([(1, [[0, 1, 2], [3, 16, 255]])], "id int, m array<array<int>>")
    rows, cols, bins = tables.bins_of_lists(df["m"])
    r = df.select(rows.alias("r"), cols.alias("c"), bins.alias("b")).first()
    assert (r.r, r.c, bytes(r.b)) == (2, 3, bytes([0, 1, 2, 3, 16, 255]))


def test_conflicts(spark):
    e = spark.createDataFrame([(1, "loc"), (2, "donut"), (3, "loc")], "excursion_id int, spatial_pattern string")
    tables.check_conflicts(e, spark.createDataFrame([(9, 1), (9, 3)], "wafer_id int, excursion_id int"))
    with pytest.raises(tables.TableError, match="wafer 9"):
        tables.check_conflicts(e, spark.createDataFrame([(9, 1), (9, 2)], "wafer_id int, excursion_id int"))


def test_predictions(spark, tmp_path):
    w = wafers(spark, "/root/testdata/sf0.001").where("wafer_id < 3")
    (tmp_path / "p.csv").write_text("wafer_id,lot_id,pred\n0,1,center\n1,1,none\n0,1,donut\n9,1,loc\n")
    given = tables.read_predictions(spark, str(tmp_path / "p.csv"))
    assert {(r.wafer_id, r.pred) for r in tables.join_predictions(w, given, strict=False).collect()} == {(0, "donut"), (1, "none")}
    with pytest.raises(Exception, match="wafer 2: no prediction"):
        tables.join_predictions(w, given).collect()
    (tmp_path / "p.csv").write_text("wafer_id,pred\n0,centre\n")
    with pytest.raises(Exception, match="no pattern centre"):
        tables.read_predictions(spark, str(tmp_path / "p.csv")).collect()


def test_splits_and_dense_lots(spark):
    df = spark.createDataFrame([(0,), (3,)], "split int")
    assert [r.split for r in tables.named_splits(df).collect()] == ["train", "unsplit"]
    with pytest.raises(Exception, match="no split 4"):
        tables.named_splits(spark.createDataFrame([(4,)], "split int")).collect()
    rng = random.Random(1)
    names = [f"LOT-{rng.randrange(500):0{rng.choice((3, 6, 9))}d}{rng.choice(('', 'é', '-b'))}" for _ in range(2000)] + ["LOT-"]
    want = {n: i for i, n in enumerate(sorted(set(names), key=str.encode))}
    got = tables.dense_lots(spark.createDataFrame([(n,) for n in names], "lot_name string")).collect()
    assert len(got) == len(names) and all(r.lot_id == want[r.lot_name] for r in got)
    assert tables.dense_lots(spark.createDataFrame([("x",)], "lot_name string")).first().lot_id == 0
    assert tables.dense_lots(spark.createDataFrame([], "lot_name string")).count() == 0


def test_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice((rng.randrange(50), rng.random(), None))) for _ in range(3000)] + [("d", 1.0), ("e", None)]
    rows = [(a, None if v is None else float(v)) for a, v in rows]
    got = {r.k: (r.median, r.median_upper) for r in metrics.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    by = {k: sorted(v for a, v in rows if a == k and v is not None) for k in "abcd"}
    assert got == {k: ((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v[len(v) // 2]) for k, v in by.items()}
