import numpy as np
import pytest

from dieflow.operators import cnn
from dieflow.plans.derive import wafers
from dieflow.streaming.pipeline import detector


def model(seed=None):
    rng = np.random.default_rng(seed)
    shapes = cnn.Model.shapes()
    t = [(np.zeros(s) if seed is None else rng.normal(0, 0.05, s)).astype(np.float32) for s in shapes]
    if seed is None:
        t[-1][:] = 0.25
    return cnn.Model([(t[2 * k], t[2 * k + 1]) for k in range(8)], t[-2], t[-1])


def test_conv_and_pool_by_hand():
    x, w = np.ones((1, 1, 3, 3), np.float32), np.ones((1, 1, 3, 3), np.float32)
    assert cnn.conv_relu(x, w, np.zeros(1, np.float32)).ravel().tolist() == [4, 6, 4, 6, 9, 6, 4, 6, 4]
    assert cnn.conv_relu(x, w, np.full(1, -5, np.float32)).ravel().tolist() == [0, 1, 0, 1, 4, 1, 0, 1, 0]
    assert cnn.pool(np.arange(16, dtype=np.float32).reshape(1, 1, 4, 4)).ravel().tolist() == [5, 7, 13, 15]


@pytest.mark.parametrize("shape", [(64, 64), (7, 5), (4, 9), (1, 1)])
def test_tiles_give_what_taps_give(shape):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 5, *shape)).astype(np.float32)
    w, b = rng.normal(size=(6, 5, 3, 3)).astype(np.float32), rng.normal(size=6).astype(np.float32)
    pad = np.pad(x.astype(np.float64), ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = sum(np.einsum("mchw,oc->mohw", pad[:, :, i : i + shape[0], j : j + shape[1]], w[:, :, i, j]) for i in range(3) for j in range(3))
    want = np.maximum(want + b[:, None, None], 0)
    tiles = cnn.conv_relu_by_tiles(np.ascontiguousarray(x.transpose(2, 3, 0, 1)), cnn.tile_weights(w), b).transpose(2, 3, 0, 1)
    assert np.abs(cnn.conv_relu(x, w, b) - want).max() < 1e-4 and np.abs(tiles - want).max() < 1e-4


@pytest.mark.parametrize("precision", ["fp32", "fp16", "int8"])
def test_layers_give_what_plain_convolutions_give_with_few_products(precision, monkeypatch):
    m, x = model(4), cnn.preprocess(np.random.default_rng(3).integers(0, 6, (3, 25, 27)).astype(np.uint8))
    scales, products, matmul = [1.5] * 8, [], np.matmul

    def counted(a, b, **more):
        products.append(a.size * b.shape[-1])
        return matmul(a, b, **more)

    with monkeypatch.context() as p:
        p.setattr(np, "matmul", counted)
        got = [*cnn.layers(m, x, precision, scales)]
    assert products and sum(products) < 0.4 * 3 * sum(9 * i * o * (64 >> k // 2) ** 2 for k, (i, o) in enumerate(cnn.CONVS))
    for k, (weight, bias) in enumerate(m.convs):
        given = got[k - 1] if k else x
        given = cnn.pool(given) if k and k % 2 == 0 else given
        if precision == "fp16":
            weight, given = weight.astype(np.float16).astype(np.float32), given.astype(np.float16).astype(np.float32)
        elif precision == "int8":
            weight = cnn._quantised(weight, np.abs(weight).max(axis=(1, 2, 3), keepdims=True) / 127)
            given = cnn._quantised(given, scales[k - 1] / 127) if k else given
        want = cnn.conv_relu(given, weight, bias)
        assert np.abs(got[k] - want).max() < 1e-5 * max(1, want.max())
    assert (got[8] == cnn.pool(got[7])).all()


@pytest.mark.parametrize("precision", ["fp32", "fp16", "int8"])
@pytest.mark.parametrize("shape", [(24, 24), (25, 27), (1, 1), (32, 5), (33, 7)])
def test_scores_are_those_of_plain_convolutions(shape, precision):
    m, scales = model(4), [1.5] * 8
    bins = np.random.default_rng(6).integers(0, 4, (3, *shape)).astype(np.uint8)
    x = cnn.preprocess(bins)
    for k, (weight, bias) in enumerate(m.convs):
        if precision == "fp16":
            weight, x = weight.astype(np.float16).astype(np.float32), x.astype(np.float16).astype(np.float32)
        elif precision == "int8":
            weight = cnn._quantised(weight, np.abs(weight).max(axis=(1, 2, 3), keepdims=True) / 127)
            x = cnn._quantised(x, scales[k - 1] / 127) if k else x
        x = cnn.conv_relu(x, weight, bias)
        x = cnn.pool(x) if k % 2 else x
    want = x.mean(axis=(2, 3)) @ m.weight.T + m.bias
    most = {"fp32": 2e-6, "fp16": 2e-4, "int8": 2e-3}[precision]  # a sum on the edge of two steps may round either way
    for _ in range(2):  # anew, and from what is known
        assert np.abs(cnn.scores(m, bins, precision, scales) - want).max() < most
    assert np.abs(cnn.forward(m, cnn.preprocess(bins), precision, scales) - want).max() < most


def test_scoring_looks_up_the_first_convolutions(monkeypatch):
    from dieflow.plans.derive import paint

    m, products, matmul = model(4), [], np.matmul

    def counted(a, b, **more):
        products.append(a.size * b.shape[-1])
        return matmul(a, b, **more)

    maps = [paint(np.arange(k, k + 96, 3), 24, 24).reshape(-1, 24, 24) for k in range(0, 960, 96)]
    for bins in maps[:-1]:
        cnn.scores(m, bins)
    monkeypatch.setattr(np, "matmul", counted)
    got = cnn.scores(m, maps[-1])
    direct = [9 * i * o * (64 >> k // 2) ** 2 for k, (i, o) in enumerate(cnn.CONVS)]
    assert sum(products) < 32 * (0.26 * sum(direct[2:]) + 0.1 * sum(direct[:2]))
    monkeypatch.undo()
    again = model(4)
    monkeypatch.setattr(cnn, "CONTEXTS", 20_000)  # too few for all of them
    monkeypatch.setattr(cnn, "FEW", 3)
    for bins in maps:
        last = cnn.scores(again, bins)
    assert np.abs(last - got).max() < 1e-6 and again.made["fp32", None].known <= 20_000


def test_interleaved_layers_keep_their_own_arrays():
    m = model(4)
    x, other = (cnn.preprocess(np.random.default_rng(k).integers(0, 4, (2, 24, 24)).astype(np.uint8)) for k in (1, 2))
    want = [*cnn.layers(m, x)]
    for a, b, c in zip(want, cnn.layers(m, x), cnn.layers(m, other)):
        cnn.forward(m, other)
        assert (a == b).all() and a.shape == c.shape


def test_model_files():
    m = model(3)
    data = m.serialize()
    again = cnn.Model.parse(data)
    assert all((a == b).all() for a, b in zip(m.tensors(), again.tensors()))
    with pytest.raises(cnn.ModelError, match="checksum"):
        cnn.Model.parse(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(cnn.ModelError, match="begins with"):
        cnn.Model.parse(b"x" * 60)


def test_nearest_and_preprocess():
    assert cnn.nearest(64).tolist() == list(range(64)) and all(0 <= cnn.nearest(n).min() and cnn.nearest(n).max() <= n - 1 for n in range(1, 200))
    x = cnn.preprocess(np.array([[[0, 1], [2, 7]]], dtype=np.uint8))
    assert x.shape == (1, 3, 64, 64) and (x.sum(axis=1) == 1).all() and x[0, 2, 63].sum() == 64 and x[0, 0, 0, 0] == 1


def test_zero_weights_give_bias_and_detectors_run(spark):
    w = wafers(spark, "/root/testdata/sf0.001").where("wafer_id < 6")
    got = cnn.logits(w, model()).collect()
    assert len(got) == 6 and all(r.logits == [0.25] * 9 for r in got)
    m = model(1)
    x = cnn.preprocess(np.ones((2, 5, 5), np.uint8))
    full = cnn.forward(m, x)
    scales = cnn.calibrate(w, m)
    assert np.abs(cnn.forward(m, x, "fp16") - full).max() < 0.05 and np.abs(cnn.forward(m, x, "int8", scales) - full).max() < 0.2
    assert cnn.parse_scales(cnn.scales_text(scales)) == scales and all(v > 0 for v in scales)
    both = detector("rules+cnn", model=m)(w).select("wafer_id", "pattern", "rule", "second").collect()
    assert len(both) == 6
    with pytest.raises(ValueError):
        detector("magic")


def test_conformal_text():
    text = "# c\nmodel_sha256 00ff\nthresholds 0.1 " + "0.5 " * 9 + "\nthresholds 0.05 " + "0.7 " * 9 + "\naccept_confidence 0.9\nreported_coverage 0.1 0.9 0.8\n"
    c = cnn.Conformal.parse(text)
    assert c.thresholds_10 == (0.5,) * 9 and c.accept_confidence == 0.9
    with pytest.raises(cnn.ModelError):
        cnn.Conformal.parse("accept_confidence 0.9")


def test_batch_norm_folding():
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(4, 3, 3, 3)).astype(np.float32), rng.normal(size=4).astype(np.float32)
    g, be, mu, va = (rng.random(4) + 0.5 for _ in range(4))
    x = rng.normal(size=(1, 3, 6, 6)).astype(np.float32)
    fw, fb = cnn.fold_batch_norm(w, b, g, be, mu, va)
    pad = lambda wt, bs: cnn.conv_relu(x, wt, bs + 100) - 100
    want = (pad(w, b) - mu[None, :, None, None]) / np.sqrt(va + 1e-5)[None, :, None, None] * g[None, :, None, None] + be[None, :, None, None]
    assert np.abs(pad(fw, fb.astype(np.float32)) - want).max() < 1e-3


def test_thresholds_are_finite_sample_quantiles(spark):
    from pyspark.sql import functions as F

    from dieflow.operators import conformal, metrics

    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate((1, 9, 10, 200, 57)):
        for _ in range(n):
            p = rng.dirichlet(np.ones(9) * 0.4).round(2)
            rows.append((k if k < 4 else 255, p.tolist()))
    scored = spark.createDataFrame(rows, "truth_code int, p array<double>").repartition(3)
    for miss in (0.1, 0.05):
        got = {r.truth_code: (r.n, r.threshold) for r in conformal.class_thresholds(scored, miss).collect()}
        want = {}
        for k in range(4):
            s = sorted(1.0 - p[k] for c, p in rows if c == k)
            place = int(np.ceil((len(s) + 1) * (1.0 - miss)))
            want[k] = (len(s), s[place - 1] if place <= len(s) else 1.0)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    c = conformal.calibrate(scored, "00ff", error=0.3)
    again = cnn.Conformal.parse(conformal.to_text(c))
    assert again == c and c.thresholds_10[7] == 1.0
    kept = [(t, p) for t, p in rows if t < 9 and max(p) >= c.accept_confidence]
    assert kept and sum(int(np.argmax(p)) != t for t, p in kept) <= 0.3 * len(kept)
    covered = metrics.conformal_metrics(scored.withColumn("set", metrics.prediction_set(F.col("p"), list(c.thresholds_10))), c.accept_confidence).first()
    assert covered.coverage >= 0.9 and dict(c.reported)["reported_coverage 0.1"][0] == covered.coverage


def test_verify_layers_and_commands(spark, tmp_path, capsys):
    from dieflow import __main__ as cli
    from dieflow.operators import conformal
    from dieflow.sources import tables, wmap

    m = model(7)
    w = wafers(spark, "/root/testdata/sf0.001").where("wafer_id < 8")
    own = [(r.wafer_id, list(r.logits)) for r in cnn.logits(w, m).collect()]
    given = spark.createDataFrame([*own, (99, [0.0] * 9)], "wafer_id int, logits array<float>")
    row = conformal.verify(w, m, given).first()
    assert (row.n, row.missing, row.same_class, row.max_diff) == (len(own) + 1, 1, len(own), 0.0)
    layers = {r.layer: r for r in conformal.layer_differences(w, m, "fp16").collect()}
    x = [cnn.preprocess(np.frombuffer(bytes(r.bins), np.uint8).reshape(1, r.rows, r.cols)) for r in w.collect()]
    most = max(cnn.layer_maxima(m, a)[0, 7] for a in x)
    assert sorted(layers) == list(range(1, 9)) and abs(layers[8].largest - most) < 1e-6 and all(0 < r.max_diff < 0.1 * r.largest for r in layers.values())
    wmap.register(spark)
    w.coalesce(1).write.format("wmap").mode("append").save(str(tmp_path / "maps"))
    (tmp_path / "m.wcnn").write_bytes(m.serialize())
    (tmp_path / "l.bin").write_bytes(tables.serialize_logits(own))
    maps, file = str(tmp_path / "maps"), str(tmp_path / "m.wcnn")
    cli.main(["verify", maps, file, str(tmp_path / "l.bin")])
    cli.main(["layers", maps, file])
    cli.main(["calibrate", maps, file, str(tmp_path / "scales.txt")])
    cli.main(["conformal", maps, file, str(tmp_path / "c.txt"), "--split", "all", "--write"])
    assert len(cnn.parse_scales((tmp_path / "scales.txt").read_text())) == 8
    assert cnn.Conformal.parse((tmp_path / "c.txt").read_text()).model_sha256 == m.sha256.hex()
    (tmp_path / "l.bin").write_bytes(tables.serialize_logits([(i, x[::-1]) for i, x in own]))
    with pytest.raises(SystemExit):
        cli.main(["verify", maps, file, str(tmp_path / "l.bin")])
