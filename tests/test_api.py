import numpy as np
import pytest
from pyspark.sql import functions as F

from dieflow import __main__ as cli
from dieflow import api
from dieflow.functions import sql
from dieflow.functions.geometry import hough_angles
from dieflow.operators import signatures
from dieflow.plans.derive import wafers
from dieflow.sources import wmap

SF = "/root/testdata/sf0.001"


def test_one_map_equals_a_batch():
    rng = np.random.default_rng(0)
    m = rng.integers(0, 4, (5, 12, 9)).astype(np.uint8)
    batch = api.features_batch(m)
    for i in range(5):
        assert api.features(m[i])["zone_fails"] == batch["zone_fails"][i].tolist()
        assert api.signals(m[i])["z"] == pytest.approx(api.signals_batch(m)["z"][i])
        assert sum(c["size"] for c in api.clusters(m[i])) == (m[i] >= 2).sum()
        assert api.hough_line(m[i])["votes"] > 0
    c = api.Classifier.fitted()
    assert [c.classify_row(api.signals(x)) for x in m] == api.classify_batch(c, m)
    for bad in (m.astype(int), m[0, 0], m[:, ::2], np.zeros((65, 64), np.uint8)):
        with pytest.raises(TypeError):
            api.features(bad)


def test_sql_functions(spark):
    sql.register(spark)
    die = signatures.dies(wafers(spark, SF).where("wafer_id < 9"))
    from dieflow.functions.geometry import rho, with_buckets

    a = with_buckets(die).join(hough_angles(spark).where("angle in (0, 33, 90, 179)"))
    a = a.withColumn("want", rho(F.col("x"), F.col("y"), F.col("cos"), F.col("sin")))
    assert a.where("zone_of(r, c, rows, cols) <> zone or ring_of(r, c, rows, cols) <> ring or sector_of(r, c, rows, cols) <> sector or hough_rho(r, c, rows, cols, cos, sin) <> want").count() == 0
    z = signatures.join_z(signatures.join_counts(die))
    assert z.where("abs(join_count_z(dies, fails, joins, join_pairs, fail_joins) - z) > 1e-9").count() == 0


def test_commands(spark, tmp_path, capsys):
    rows = [tuple(r[c] for c in wmap.COLUMNS) for r in wafers(spark, SF).select(*wmap.COLUMNS).collect()]
    path, rules = str(tmp_path / "a.wmap"), str(tmp_path / "rules.txt")
    (tmp_path / "a.wmap").write_bytes(wmap.serialize(rows))
    assert len(api.read_wmap(path)["bins"]) == 200
    cli.main(["maps", path])
    cli.main(["fit", path, rules, "--candidates", "5"])
    cli.main(["eval", path, rules, "--signals", str(tmp_path / "signals")])
    cli.main(["explain", path, rules, "6"])
    (tmp_path / "x.csv").write_text("excursion,1,scratch,1600000000000000,1600000900000000\n" + "".join(f"wafer,{i},1\n" for i in range(8, 200, 10)))
    (tmp_path / "al.csv").write_text("h\n1,scratch,20,0,1\n")
    cli.main(["closedloop", path, str(tmp_path / "x.csv"), "--detector", "truth", "--alarms", str(tmp_path / "al.csv"), "--k", "1", "--window", "1"])
    out = capsys.readouterr().out
    assert "macro_f1" in out and "near_full -> near_full" in out and "sorted_before_hold" in out
    with pytest.raises(SystemExit):
        cli.main(["explain", path, rules, "99999"])
