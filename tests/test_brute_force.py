"""Operators that SQL can't express, against plain versions written from their definitions."""

import numpy as np
import pytest
import xxhash

from lithoframe.operators import identifiability as I
from lithoframe.operators import planes as P
from lithoframe.operators import report as R
from lithoframe.plans import scene


def test_clahe_pixel_by_pixel():
    rng = np.random.default_rng(0)
    a = np.clip(P.gaussian(rng.random((37, 45)), 1.5), 0, 1)
    tiles, bins, clip = 4, 64, 2.0
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")

    def curve(i, j):
        values = [int(v * (bins - 1) + 0.5) for v in p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel()]
        n = [float(values.count(b)) for b in range(bins)]
        top = max(1.0, clip * th * tw / bins)
        spare = sum(max(0.0, x - top) for x in n) / bins
        out, total = [], 0.0
        for x in n:
            total += min(x, top) + spare
            out.append(total / (th * tw))
        return out

    curves = [[curve(i, j) for j in range(tiles)] for i in range(tiles)]
    got = P.clahe(a, tiles, bins, clip)
    for y in range(0, h, 5):
        for x in range(0, w, 4):
            fy, fx = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            i, j = min(max(int(np.floor(fy)), 0), tiles - 1), min(max(int(np.floor(fx)), 0), tiles - 1)
            ay, ax = min(max(fy - i, 0), 1), min(max(fx - j, 0), 1)
            b = int(a[y, x] * (bins - 1) + 0.5)
            at = lambda r, c: curves[min(r, tiles - 1)][min(c, tiles - 1)][b]
            want = (1 - ay) * ((1 - ax) * at(i, j) + ax * at(i, j + 1)) + ay * ((1 - ax) * at(i + 1, j) + ax * at(i + 1, j + 1))
            assert got[y, x] == pytest.approx(want)


@pytest.mark.parametrize("screen,weight", [(0.24, 1.0), (2.0, 0.5)])
def test_screened_poisson_solves_its_linear_system(screen, weight):
    """Without padding the plane is a torus: (screen + weight L) d = screen a - weight div g, L its five-point Laplacian."""
    rng = np.random.default_rng(1)
    a, gx, gy = (rng.standard_normal((9, 7)) for _ in range(3))
    n, at = a.size, lambda y, x: (y % 9) * 7 + x % 7
    m, rhs = np.zeros((n, n)), np.zeros(n)
    for y in range(9):
        for x in range(7):
            k = at(y, x)
            m[k, k] += screen + 4 * weight
            for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                m[k, at(y + dy, x + dx)] -= weight
            div = gx[y, x] - gx[y, (x - 1) % 7] + gy[y, x] - gy[(y - 1) % 9, x]
            rhs[k] = screen * a[y, x] - weight * div
    assert np.allclose(P.screened_poisson(a, gx, gy, screen, weight, 0).ravel(), np.linalg.solve(m, rhs))


def test_screened_poisson_keeps_a_plane_with_its_own_gradient():
    rng = np.random.default_rng(2)
    a = P.gaussian(rng.standard_normal((30, 26)), 2.0)
    gx, gy = np.roll(a, -1, 1) - a, np.roll(a, -1, 0) - a  # the gradient on the torus
    assert np.allclose(P.screened_poisson(a, gx, gy, 0.24, 1.0, 0), a)


def test_hash_sample_is_the_rows_of_least_hash(spark):
    ids = [k * 7 % 1009 for k in range(1009)]
    rows = [(k, f"r{k}") for k in ids]
    unsigned = lambda k: xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), seed=42)
    df = spark.createDataFrame(rows, "id long, name string")
    from pyspark.sql import functions as F

    own = {r.id: r.h for r in df.select("id", F.xxhash64("id", F.lit(17)).alias("h")).collect()}
    want = sorted(ids, key=lambda k: (own[k], k))[:50]
    for parts in (1, 7):
        assert [r.id for r in R.hash_sample(df.repartition(parts), "id", 50, 17).collect()] == want
    assert {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()} == {k: unsigned(k) - (1 << 64) * (unsigned(k) >> 63) for k in ids}
    other = [r.id for r in R.hash_sample(df, "id", 50, 18).collect()]
    assert set(other) != set(want)


@pytest.mark.parametrize("alpha", [0.0, 0.03, 3.0])
def test_blocked_ridge_refits_over_pixels(spark, alpha):
    rng = np.random.default_rng(3)
    h, w, rows, cols, gap = 24, 20, 3, 2, 1
    f = rng.standard_normal((h, w, 3))
    t = f @ [1.0, -0.5, 0.2] + 0.3 * rng.standard_normal((h, w))
    data = [(y, x, *map(float, f[y, x]), float(t[y, x])) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(data, "y int, x int, f0 double, f1 double, f2 double, t double")
    got = {r.block: r for r in I.blocked_ridge(df, ["f0", "f1", "f2"], "t", h, w, rows, cols, gap, [alpha]).collect()}
    ys, xs = np.mgrid[:h, :w]
    block = np.minimum(ys * rows // h, rows - 1) * cols + np.minimum(xs * cols // w, cols - 1)
    for b in range(rows * cols):
        y0, y1, x0, x1 = ys[block == b].min(), ys[block == b].max(), xs[block == b].min(), xs[block == b].max()
        train = ~((ys >= y0 - gap) & (ys <= y1 + gap) & (xs >= x0 - gap) & (xs <= x1 + gap))
        test = (ys >= y0 + gap) & (ys <= y1 - gap) & (xs >= x0 + gap) & (xs <= x1 - gap)
        m, s = f[train].mean(0), np.maximum(f[train].std(0), 1e-8)
        z = (f[train] - m) / s
        beta = np.linalg.solve(z.T @ z / len(z) + max(alpha, 1e-12) * np.eye(3), z.T @ (t[train] - t[train].mean()) / len(z))
        p = t[train].mean() + ((f[test] - m) / s) @ beta
        assert (got[b].n_train, got[b].n_test) == (train.sum(), test.sum())
        assert got[b].sse == pytest.approx(((t[test] - p) ** 2).sum()) and got[b].sst == pytest.approx(((t[test] - t[train].mean()) ** 2).sum())


def test_rock_proxy_masks_by_all_pairs_of_thresholds(spark):
    got = {(r.scene, r.c): (r.n, r.core) for r in scene.rock_proxy_masks(spark, "/root/testdata/sf0.001").collect()}
    for name, pdf in scene._scene(spark, "/root/testdata/sf0.001").toPandas().groupby("scene"):
        h, w = pdf.y.max() + 1, pdf.x.max() + 1
        v = np.full((h, w), np.nan)
        rgb = np.array(pdf.rgb.tolist())
        v[pdf.y, pdf.x] = rgb[:, 1] - 0.5 * (rgb[:, 0] + rgb[:, 2])
        assert np.isfinite(v).all()
        b = np.floor(255 * (v - v.min()) / (v.max() - v.min())).astype(int)
        best = None
        present = sorted(set(b.ravel().tolist()))
        for i in present:
            for j in present:
                if i < j < max(present):
                    parts = [b[b <= i], b[(b > i) & (b <= j)], b[b > j]]
                    score = round(sum(float(p.sum()) ** 2 / len(p) for p in parts), 3)
                    if best is None or score > best[0]:
                        best = (score, i, j)
        c = np.where(b <= best[1], 0, np.where(b <= best[2], 1, 2))
        pad = np.pad(c, 1, mode="reflect")
        near = np.stack([pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        core = (near == c).all(0)
        for k in range(3):
            if (c == k).any():
                assert got[name, float(k)] == ((c == k).sum(), core[c == k].sum())


def test_band_report_fails_closed_and_counts_shifts(spark):
    rng = np.random.default_rng(8)
    h, w = 24, 20
    f = rng.standard_normal((h, w))
    rows = []
    for band, t in ((0, 2 * f + 0.1 * rng.standard_normal((h, w))), (1, rng.standard_normal((h, w))), (2, np.full((h, w), np.nan))):
        rows += [(band, y, x, float(f[y, x]), None if np.isnan(t[y, x]) else float(t[y, x])) for y in range(h) for x in range(w)]
    rows += [(3, 0, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "band int, y int, x int, f double, t double")
    moves = I.shifts(h, w, 1, 3, 2, 19, 5)
    got = {r.band: r for r in I.band_report(df, "band", [0, 1, 2, 3, 7], "f", "t", h, w, 3, 2, 1, moves, least_train=20, least_test=4).collect()}
    assert (got[0].status, got[0].reason, got[0].p) == ("identifiable", "", pytest.approx(0.05))
    assert got[1].status == "unidentifiable" and got[1].reason == "" and got[1].p > 0.05
    assert [(got[k].status, got[k].reason) for k in (2, 3, 7)] == [("unidentifiable", "no_rows"), ("unidentifiable", "insufficient_support"), ("unidentifiable", "no_rows")]
