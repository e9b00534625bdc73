"""Where an operator exists as Spark expressions and as a kernel of the run, both give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.functions import scalars as S
from lithoframe.functions import vectors as V
from lithoframe.operators import detail as D
from lithoframe.operators import lowrank as L
from lithoframe.operators import planes as P
from lithoframe.operators import quality as Q
from lithoframe.operators import registration as G
from lithoframe.operators import resample as R
from lithoframe.operators import tiles, wald
from lithoframe.operators import uncertainty as U
from lithoframe.plans import pipeline


def frame(spark, **planes):
    first = next(iter(planes.values()))
    y, x = np.mgrid[: first.shape[0], : first.shape[1]]
    rows = [(int(a), int(b), *(None if np.isnan(p[a, b]) else float(p[a, b]) for p in planes.values())) for a, b in zip(y.ravel(), x.ravel())]
    return spark.createDataFrame(rows, "y int, x int, " + ", ".join(f"{n} double" for n in planes))


def plane(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", name).collect():
        out[r.y, r.x] = np.nan if r[2] is None else r[2]
    return out


def test_warp(spark):
    rng = np.random.default_rng(0)
    a = rng.random((19, 23))
    a[5, 7] = np.nan
    m = np.array([[0.97, 0.05, 1.3], [-0.04, 1.02, -0.6]])
    df = frame(spark, v=a)
    got = plane(R.warp(R.affine_coordinates(df.select("y", "x"), m), df, ["v"]), "v", a.shape)
    want = G.warp(a, m, a.shape)
    assert np.array_equal(np.isnan(got), np.isnan(want)) and np.allclose(got, want, equal_nan=True)


def test_sensor_down_up_and_unseen(spark):
    rng = np.random.default_rng(1)
    a, s = rng.random((24, 20)), D.Sensor((24, 20), (7, 6), 1.3, 0.8)
    df = frame(spark, v=a)
    low = R.degrade(df, s.high, s.low, s.sigma_x, s.sigma_y, ["v"])
    assert np.allclose(plane(low, "v", s.low), s.down(a))
    assert np.allclose(plane(R.upsample(low, s.low, s.high, ["v"]), "v", s.high), s.up(s.down(a)))
    assert np.allclose(plane(R.nullspace(df, s.high, s.low, s.sigma_x, s.sigma_y, "v"), "v", s.high), s.unseen(a))


@pytest.mark.parametrize("tile", [5, 16, 64])
def test_tiled_kernels_equal_whole_planes(spark, tile):
    rng = np.random.default_rng(2)
    a = rng.random((27, 31))
    kernels = {"g": lambda v: P.gaussian(v, 1.1), "b": lambda v: P.box(v, 2), "s": lambda v: P.magnitude(v, "scharr"), "d": P.dilate}
    got = tiles.stencil(frame(spark, v=a), lambda t: {k: f(t["v"]) for k, f in kernels.items()}, ["v"], list(kernels), P.reach(1.1), tile=tile)
    for k, f in kernels.items():
        assert np.allclose(plane(got, k, a.shape), f(a)), k


def test_inverse_distance_field(spark):
    rng = np.random.default_rng(3)
    p = np.column_stack([rng.random(30) * 40, rng.random(30) * 30, rng.standard_normal((30, 2)), 0.4 + 0.6 * rng.random(30), rng.random((30, 2))])
    points = spark.createDataFrame([(k, *map(float, r[:5])) for k, r in enumerate(p)], "pid long, ref_y double, ref_x double, dy double, dx double, score double")
    queries = spark.range(12 * 11).select(F.col("id").alias("qid"), F.expr("cast(id div 11 as double)").alias("qy"), F.expr("cast(id % 11 as double)").alias("qx"))
    got = np.array([r.dy for r in U.idw(queries, points, "dy").orderBy("qid").collect()]).reshape(12, 11)
    # the kernel's field before its smoothing
    y, x = (g.astype(float) for g in np.mgrid[:12, :11])
    d2 = (y[..., None] - p[:, 0]) ** 2 + (x[..., None] - p[:, 1]) ** 2
    near = np.argsort(d2, -1, kind="stable")[..., :10]
    w = np.maximum(0.05, p[near, 4] - 0.2) ** 2 / (np.take_along_axis(d2, near, -1) + 18)
    raw = (w * p[near, 2]).sum(-1) / w.sum(-1)
    assert np.allclose(got, raw)
    assert np.allclose(G.field_from_points(p, (12, 11))[..., 0], P.gaussian(raw, 2.2))


def test_rows_of_spectra(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((40, 6))
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "k int, v array<double>")
    rgb = rng.random((40, 3))
    df = df.join(spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rgb)], "k int, r double, g double, b double"), "k").orderBy("k")
    model = L.Subspace(rng.random(6), rng.standard_normal((3, 6)), np.ones(3), "pca")
    m = V.savgol_matrix(6, 5, 2)
    got = df.select(V.simplex(F.col("v")).alias("p"), V.smooth(F.col("v"), m).alias("s"), S.rgb_features(F.col("r"), F.col("g"), F.col("b")).alias("f"), L.coefficients(F.col("v"), model).alias("c"), V.top_components(F.col("v"), 2).alias("t")).collect()
    col = lambda n: np.array([r[n] for r in got])
    assert np.allclose(col("p"), L.project_rows(v)) and np.allclose(col("s"), v @ m.T) and np.allclose(col("f"), wald.features(rgb[:, None, :])[:, 0])
    assert [[t.component for t in r.t] for r in got] == np.argsort(-v, 1, kind="stable")[:, :2].tolist()


def test_product_view_equals_its_factors(spark, tmp_path):
    rng = np.random.default_rng(5)
    model = L.Subspace(rng.random(7), np.linalg.qr(rng.standard_normal((7, 2)))[0].T, np.ones(2), "pca")
    coef, gain, additive, scale = rng.standard_normal((6, 5, 2)), 0.5 + rng.random((6, 5)), rng.standard_normal((6, 5)), rng.random(7)
    store = pipeline.Store(spark, str(tmp_path))
    for n, a in (("coefficients", coef), ("gain", gain), ("additive", additive)):
        pipeline.from_plane(spark, a, n).write.parquet(store.path(n))
    got = pipeline.to_plane(pipeline._view(spark, store, model, scale), "values", (6, 5))
    whole = pipeline.Product(coef, gain, additive, model, scale)
    assert np.allclose(got, np.maximum(whole.bands(np.arange(7)), 0)) and np.allclose(got, np.maximum((coef @ model.basis + model.mean) * gain[..., None] + additive[..., None] * scale, 0))


def test_masks_equal_percentiles_of_planes(spark):
    rng = np.random.default_rng(6)
    planes = {n: rng.random((30, 28)) for n in ("luma", "coherence", "strength", "gradient")}
    got = Q.masks(frame(spark, **planes))
    lit = planes["luma"] > max(float(np.quantile(planes["luma"][planes["luma"] > 0.003], 0.01)), 0.003)
    reliable = lit & (planes["coherence"] >= 0.6) & (planes["strength"] >= np.quantile(planes["strength"][lit], 0.3))
    assert np.array_equal(plane(got.withColumn("m", F.col("reliable").cast("double")), "m", (30, 28)) > 0, reliable)


def test_jacobian_and_column_profile(spark):
    from pyspark.sql import Window

    from lithoframe.operators.quantiles import quantiles

    rng = np.random.default_rng(7)
    f = np.stack([P.gaussian(rng.standard_normal((25, 22)), 2.0) for _ in range(2)], -1)
    wy, wx = Window.partitionBy("x").orderBy("y"), Window.partitionBy("y").orderBy("x")
    c = lambda v, w: (F.lead(v).over(w) - F.lag(v).over(w)) / 2
    g = frame(spark, sy=f[..., 0], sx=f[..., 1]).select("y", "x", c("sy", wy).alias("yy"), c("sx", wx).alias("xx"), c("sy", wx).alias("yx"), c("sx", wy).alias("xy"))
    inner = g.where("yy is not null and xx is not null")
    got = quantiles(inner, [], {"q": F.expr("(1 + yy) * (1 + xx) - yx * xy")}, [0.01]).first().q[0]
    gy, gx = np.gradient(f[..., 0]), np.gradient(f[..., 1])
    j = ((1 + gy[0]) * (1 + gx[1]) - gy[1] * gx[0])[1:-1, 1:-1]  # the kernel takes one-sided differences at the border as well
    assert got == pytest.approx(np.quantile(j, 0.01)) and abs(got - G.jacobian_p01(f)) < 0.1
    a = D.stretch(P.gaussian(rng.standard_normal((30, 40)), 1.0))
    grad = tiles.stencil(frame(spark, v=a), lambda t: {"gx": P.gradient(t["v"], "scharr")[0]}, ["v"], ["gx"], 1)
    rows = quantiles(grad, ["x"], {"v": F.abs("gx")}, [0.82]).orderBy("x").collect()
    v = np.array([r.v[0] for r in rows])
    assert np.allclose(D.stretch(np.convolve(np.pad(v, 4, mode="edge"), np.full(9, 1 / 9), "valid")), G.column_profile(a))


def test_borders_are_mirrored_not_joined():
    rng = np.random.default_rng(8)
    a = rng.random((9, 8))
    a[0] = 5.0  # nothing of the first row may reach the last
    p = np.pad(a, 2, mode="reflect")
    near = np.stack([p[2 + dy : 11 + dy, 2 + dx : 10 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    assert np.array_equal(P.dilate(a), near.max(0)) and np.array_equal(P.erode(a), near.min(0)) and P.dilate(a)[-1].max() < 5
    want = np.zeros_like(a)
    for y in range(9):
        for x in range(8):
            cells = [(dy, dx, p[2 + y + dy, 2 + x + dx]) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4]
            w = [np.exp(-(dy * dy + dx * dx) / (2 * 1.2**2)) * np.exp(-((v - a[y, x]) ** 2) / (2 * 0.1**2)) for dy, dx, v in cells]
            want[y, x] = sum(k * v for k, (_, _, v) in zip(w, cells)) / sum(w)
    assert np.allclose(P.bilateral(a, 5, 0.1, 1.2), want)
