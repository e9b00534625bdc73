import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.functions import vectors as V
from lithoframe.operators import identifiability as I
from lithoframe.operators import lowrank as L
from lithoframe.operators import planes as P
from lithoframe.operators import uncertainty as U
from lithoframe.operators.tiles import stencil


def frame(spark, cube, name="v"):
    rows = [(y, x, y * cube.shape[1] + x, [float(u) for u in cube[y, x]]) for y in range(cube.shape[0]) for x in range(cube.shape[1])]
    return spark.createDataFrame(rows, f"y int, x int, id int, {name} array<double>")


def test_simplex_mixture_is_recovered(spark):
    rng = np.random.default_rng(123)
    b = np.linspace(0, 1, 16)
    ends = np.stack([0.2 + 0.6 * b, 0.8 - 0.5 * b, 0.4 + 0.3 * np.sin(3 * b)])
    a = rng.dirichlet([0.55, 0.70, 0.60], (20, 15))
    a[0, :3] = np.eye(3)
    cube = a @ ends
    m = L.fit_simplex(frame(spark, cube), "v", "id", 3)
    got = np.array([m.basis[np.abs(m.basis - e).sum(1).argmin()] for e in ends])
    assert np.sqrt(((got - ends) ** 2).mean()) < 0.025
    w = L.with_abundances(frame(spark, cube), "v", "a", m.basis, steps=200)
    e = w.agg(F.sqrt(F.avg(V.square_error(F.col("v"), V.combine(F.col("a"), m.basis)))), F.max(F.abs(V.total(F.col("a")) - 1))).first()
    assert e[0] / np.sqrt((cube**2).sum(-1).mean()) < 0.015 and e[1] < 1e-9
    h = m.meta["history"]
    assert all(y <= x * 1.05 for x, y in zip(h, h[1:])) and L.Subspace.from_json(m.to_json()).kind == "simplex"
    signed = cube + 0.018 * (np.sin(5 * np.pi * b)[None, None] * np.sin(np.arange(15) / 3.7)[None, :, None] * np.cos(np.arange(20) / 4.7)[:, None, None])
    f = frame(spark, signed)
    one, two = L.fit_hybrid(f, "v", "id", 3, 2)
    d = L.with_abundances(f, "v", "a", one.basis, steps=200).withColumn("r", V.subtract(F.col("v"), V.combine(F.col("a"), one.basis)))
    r = d.agg(F.avg(V.square_error(F.col("r"), V.lit_vector(np.zeros(16)))), F.avg(V.square_error(F.col("r"), L.reconstruct(L.coefficients(F.col("r"), two), two)))).first()
    assert np.sqrt(r[1]) < 0.55 * np.sqrt(r[0])
    with pytest.raises(ValueError):
        L.fit_simplex(frame(spark, cube - 1), "v", "id", 3)


def test_pca_and_digests(spark):
    rng = np.random.default_rng(17)
    cube = rng.standard_normal((8, 9, 3)) @ rng.standard_normal((3, 12)) + rng.random(12)
    m = L.fit_pca(frame(spark, cube), "v", 3)
    x = cube.reshape(-1, 12)
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(m.basis.T @ m.basis, v[:3].T @ v[:3], atol=1e-9)
    assert m.explained.sum() == pytest.approx(1)
    text = m.to_json()
    assert np.array_equal(L.Subspace.from_json(text).basis, m.basis.astype("f4"))
    with pytest.raises(ValueError):
        L.Subspace.from_json(text.replace('"mean"', '"nean"', 1).replace('"nean"', '"mean"', 1).replace("float32", "float32", 1).replace(m.to_json()[-70:-6], "0" * 64))


def test_cone(spark):
    rng = np.random.default_rng(7)
    ref, cand = rng.random((40, 11)) * 0.7 + 0.05, None
    cand = np.maximum(ref + 0.3 * rng.standard_normal(ref.shape), 0.01)
    ref[0] = 0
    cand[1] = 1.0001 * ref[1]
    d = spark.createDataFrame([(k, c.tolist(), r.tolist()) for k, (c, r) in enumerate(zip(cand, ref))], "k int, c array<double>, r array<double>")
    got = {r.k: np.array(r.o) for r in d.select("k", V.cone(F.col("c"), F.col("r"), 10.0).alias("o")).collect()}
    assert np.array_equal(got[0], ref[0]) and np.array_equal(got[1], cand[1])
    for k in range(2, 40):
        al = cand[k] @ ref[k]
        assert got[k] @ ref[k] == pytest.approx(al)
        assert np.degrees(np.arccos(got[k] @ ref[k] / np.linalg.norm(got[k]) / np.linalg.norm(ref[k]))) <= 10 + 1e-6
    with pytest.raises(Exception, match="negative projection"):
        spark.createDataFrame([([-1.0, 0.0], [1.0, 0.0])], "c array<double>, r array<double>").select(V.cone(F.col("c"), F.col("r"), 10.0)).collect()
    with pytest.raises(ValueError):
        V.cone(F.col("c"), F.col("r"), 90.0)


@pytest.mark.parametrize("tile", [7, 16, 64])
def test_tiles_equal_whole_plane(spark, tile):
    rng = np.random.default_rng(0)
    a = rng.random((2, 33, 41))
    rows = [(s, y, x, float(a[s, y, x])) for s in range(2) for y in range(33) for x in range(41)]
    d = spark.createDataFrame(rows, "scene int, y int, x int, v double")
    got = stencil(d, lambda p: {"o": P.gaussian(p["v"], 1.3)}, ["v"], ["o"], P.reach(1.3), keys=["scene"], tile=tile).toPandas()
    for s in range(2):
        g = got[got.scene == s].pivot(index="y", columns="x", values="o").to_numpy()
        np.testing.assert_allclose(g, P.gaussian(a[s], 1.3), atol=1e-12)


def _plane(spark, f, t):
    h, w = f.shape
    return spark.createDataFrame([(y, x, float(f[y, x]), float(t[y, x])) for y in range(h) for x in range(w)], "y int, x int, f double, t double")


def test_blocked_cv_equals_refits_and_guards_leakage(spark):
    rng = np.random.default_rng(5)
    h, w, rows, cols, gap, ridge = 48, 40, 4, 4, 2, 0.03
    f = P.gaussian(rng.standard_normal((h, w)), 1.5)
    t = 0.7 * f + 0.05 * rng.standard_normal((h, w))
    folds = I.blocked_cv(_plane(spark, f, t), "f", "t", h, w, rows, cols, gap, ridge, least_train=10, least_test=4)
    got = I.pooled(folds).first()
    sse = sst = 0.0
    yy, xx = np.mgrid[:h, :w]
    for _, a0, a1, b0, b1, c0, c1, d0, d1 in I.rectangles(h, w, rows, cols, gap):
        tr = ~((yy >= a0) & (yy <= a1) & (xx >= b0) & (xx <= b1))
        te = (yy >= c0) & (yy <= c1) & (xx >= d0) & (xx <= d1)
        sl = np.cov(f[tr], t[tr], bias=True)[0, 1] / (f[tr].var() * (1 + ridge))
        sse += ((t[te] - t[tr].mean() - sl * (f[te] - f[tr].mean())) ** 2).sum()
        sst += ((t[te] - t[tr].mean()) ** 2).sum()
    assert got.r2 == pytest.approx(1 - sse / sst, abs=1e-9)
    a = I.amplitude(folds).first()
    assert a.estimate == pytest.approx(0.7 / 1.03, abs=0.035) and a.held_out_stability == 1.0
    ci = I.bootstrap(folds, 100).first()
    assert ci.r2_ci[0] <= got.r2 <= ci.r2_ci[1] and ci.slope_ci[0] > 0
    n = I.shift_null(_plane(spark, f, t), "f", "t", h, w, rows, cols, gap, I.shifts(h, w, gap, rows, cols, 9, 1), got.r2, least_train=10, least_test=4).collect()
    assert len(n) == 9 and not any(r.reaches for r in n)
    # a relation that lives only within the gap of block borders isn't found
    rim = np.ones((h, w), bool)
    for _, _, _, _, _, c0, c1, d0, d1 in I.rectangles(h, w, rows, cols, gap):
        rim[c0 : c1 + 1, d0 : d1 + 1] = False
    leak = np.where(rim, f, P.gaussian(rng.standard_normal((h, w)), 1.5))
    loose = I.pooled(I.blocked_cv(_plane(spark, f, leak), "f", "t", h, w, rows, cols, 0, ridge, least_train=10, least_test=4)).first().r2
    strict = I.pooled(I.blocked_cv(_plane(spark, f, leak), "f", "t", h, w, rows, cols, gap, ridge, least_train=10, least_test=4)).first().r2
    assert loose > 0.1 and strict < 0.05


def test_covariance_is_monotone(spark):
    q = spark.createDataFrame([(1, 5.0, 5.0), (2, 60.0, 60.0)], "qid int, qy double, qx double")
    pt = lambda s, e: spark.createDataFrame([(k, 4.0 + k, 5.0, 0.1, -0.1, s, 0.05, e) for k in range(3)], "pid int, ref_y double, ref_x double, res_y double, res_x double, score double, margin double, backward_error double")
    good, bad = ({r.qid: r for r in U.local_covariance(q, pt(*v)).collect()} for v in ((0.95, 0.1), (0.4, 0.9)))
    assert good[1].cov_yy < bad[1].cov_yy and good[1].cov_yy < good[2].cov_yy
    for r in (*good.values(), *bad.values()):
        assert np.linalg.eigvalsh([[r.cov_yy, r.cov_yx], [r.cov_yx, r.cov_xx]]).min() >= 0.04 - 1e-9
    with pytest.raises(ValueError):
        U.Settings(neighbours=0)
    with pytest.raises(ValueError):
        U.local_covariance(q, pt(1.0, 0.0).limit(0))
