"""Two spectrometers on one wavelength axis: overlap calibration, reliability weights, tapered blend, band table.

Pixels stay rows with array spectra. Everything about bands (percentiles, gains, noise, weights) is aggregated to one
value a band, brought back as constants, and applied in one projection; no pixel is shuffled except to pair the sensors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions import scalars as S
from lithoframe.functions import vectors as V
from lithoframe.operators import planes as P
from lithoframe.operators.quantiles import quantiles
from lithoframe.operators.tiles import stencil
from lithoframe.session import checkpointed


@dataclass(frozen=True)
class Settings:
    start: float = 700.0
    end: float = 2500.0
    step: float = 5.0
    gain_limits: tuple[float, float] = (0.25, 4.0)
    offset_limits: tuple[float, float] = (-1.0, 1.0)
    window: int = 11
    degree: int = 3
    bad_quantile: float = 0.97


def target_axis(s: Settings) -> np.ndarray:
    """From start to end by step; the end itself is added where the step misses it."""
    w = np.arange(s.start, s.end + 0.5 * s.step, s.step)
    w = w[w <= s.end + 1e-6]
    return w if w[-1] >= s.end - 1e-6 else np.append(w, s.end)


def radiometric_scale(df: DataFrame, v: str) -> float:
    """The 99.5th percentile of all values where that exceeds 3, else 1."""
    q = df.select(F.explode(v).alias("u")).agg(F.percentile_approx("u", 0.995, 100_000).alias("q")).first().q
    return float(q) if q is not None and q > 3 else 1.0


def _columns(n: int, f) -> list:
    return [f(k) for k in range(n)]


def robust_affine(pairs: DataFrame, bands: int, s: Settings, passes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Gain and offset of b on a for each band (arrays a, b): quartiles, then reweighted passes, then smoothing over bands."""
    a, b = (lambda k: F.col("a")[k]), (lambda k: F.col("b")[k])

    def per_band(f, probs: list[float]) -> np.ndarray:
        """Exact quantiles of f(k) for each band k, as (bands, probs); a band without values has zeros."""
        q = quantiles(pairs, [], {f"q{k}": f(k) for k in range(bands)}, probs).first()
        return np.array([q[f"q{k}"] or [0.0] * len(probs) for k in range(bands)], float)

    p = [0.1, 0.25, 0.5, 0.75, 0.9]
    x, y = per_band(a, p), per_band(b, p)
    n = np.array(pairs.agg(F.array(*_columns(bands, lambda k: F.count(a(k) * b(k)))).alias("n")).first().n)
    dx = x[:, 3] - x[:, 1]
    gain = np.clip(np.where(np.abs(dx) > 1e-9, (y[:, 3] - y[:, 1]) / np.where(np.abs(dx) > 1e-9, dx, 1), 1.0), *s.gain_limits)
    offset = y[:, 2] - gain * x[:, 2]

    def kept(k: int):
        return a(k).between(float(x[k, 0]), float(x[k, 4])) & b(k).between(float(y[k, 0]), float(y[k, 4]))

    for _ in range(passes):
        res = lambda k: F.when(kept(k), b(k) - (float(gain[k]) * a(k) + float(offset[k])))
        mid = per_band(res, [0.5])[:, 0]
        scale = 1.4826 * per_band(lambda k: F.abs(res(k) - float(mid[k])), [0.5])[:, 0] + 1e-6

        def sums(k: int):
            w = 1 / (1 + (res(k) / float(2.5 * scale[k])) ** 2)
            return F.array(F.sum(w), F.sum(w * a(k)), F.sum(w * b(k)), F.sum(w * a(k) * a(k)), F.sum(w * a(k) * b(k)))

        t = np.array(pairs.agg(F.array(*_columns(bands, sums)).alias("t")).first().t, float)
        det = t[:, 0] * t[:, 3] - t[:, 1] ** 2
        ok = np.abs(det) > 1e-10
        new = np.clip((t[:, 0] * t[:, 4] - t[:, 1] * t[:, 2]) / np.where(ok, det, 1), *s.gain_limits)
        gain = np.where(ok, new, gain)
        offset = np.where(ok, np.clip((t[:, 2] - gain * t[:, 1]) / np.maximum(t[:, 0], 1e-10), *s.offset_limits), offset)
    few = n < 64
    gain, offset = np.where(few, 1.0, gain), np.where(few, 0.0, np.clip(offset, *s.offset_limits))
    w = max(3, min(s.window, bands if bands % 2 else bands - 1))
    if bands >= w:
        m = V.savgol_matrix(bands, w, min(s.degree, w - 1))
        gain, offset = m @ gain, m @ offset
    return np.clip(gain, *s.gain_limits), np.clip(offset, *s.offset_limits)


def band_noise(df: DataFrame, v: str, bands: int) -> np.ndarray:
    """1.4826 MAD of each band's residual against a Gaussian of 0.8 pixels."""
    names = [f"b{k}" for k in range(bands)]
    wide = df.select("y", "x", *[F.coalesce(F.col(v)[k], F.lit(0.0)).alias(n) for k, n in enumerate(names)])
    r = stencil(wide, lambda a: {n: a[n] - P.gaussian(a[n], 0.8) for n in names}, names, names, P.reach(0.8))
    r = checkpointed(r)  # read twice; the stencil shuffles once
    mid = quantiles(r, [], {n: F.col(n) for n in names}, [0.5]).first()
    mad = quantiles(r, [], {n: F.abs(F.col(n) - float(mid[n][0])) for n in names}, [0.5]).first()
    return np.maximum(1.4826 * np.array([mad[n][0] for n in names], float), 1e-6)


def reliability(noise: np.ndarray) -> np.ndarray:
    r = 1 / np.maximum(noise, 1e-6) ** 2
    return np.clip(r / max(float(np.median(r)), 1e-9), 0.05, 20.0)


def harmonise(nir: DataFrame, swir: DataFrame, nir_w: np.ndarray, swir_w: np.ndarray, s: Settings | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(y, x, values) on the common axis, the band table, and a summary with the overlap error before and after."""
    s = s or Settings()
    nir_w, swir_w = np.asarray(nir_w, float), np.asarray(swir_w, float)
    n_scale, w_scale = radiometric_scale(nir, "values"), radiometric_scale(swir, "values")
    both = nir.select("y", "x", F.transform("values", lambda v: v / n_scale).alias("n")).join(swir.select("y", "x", F.transform("values", lambda v: v / w_scale).alias("w")), ["y", "x"])
    lo, hi = max(nir_w.min(), swir_w.min()), min(nir_w.max(), swir_w.max())
    idx = np.flatnonzero((swir_w >= lo) & (swir_w <= hi))
    if len(idx) < 3:
        raise ValueError("the sensors have no usable overlap")
    over = both.select("y", "x", "n", "w", V.interpolate(F.col("n"), nir_w, swir_w[idx]).alias("b"), F.slice("w", int(idx[0]) + 1, len(idx)).alias("a")).cache()
    mid = lambda c: F.array_sort(F.filter(c, lambda v: v.isNotNull()))
    half = lambda c: F.get(mid(c), F.floor(F.size(mid(c)) / 2).cast("int"))
    level = over.withColumn("i", 0.5 * half(F.col("a")) + 0.5 * half(F.col("b")))
    known = level.where("i is not null")
    q = quantiles(known, [], {"q": F.col("i")}, [0.05, 0.985]).first()
    material = level if q.n_rows < 32 else level.where((F.col("i") > q.q[0]) & (F.col("i") < q.q[1]))
    gain, offset = robust_affine(material, len(idx), s)
    g_all, o_all = np.interp(swir_w, swir_w[idx], gain), np.interp(swir_w, swir_w[idx], offset)
    cal = over.select("y", "x", "n", F.zip_with(F.zip_with("w", V.lit_vector(g_all), lambda v, g: v * g), V.lit_vector(o_all), lambda v, o: v + o).alias("w"))
    nr, wr = reliability(band_noise(cal, "n", len(nir_w))), reliability(band_noise(cal, "w", len(swir_w)))
    t = target_axis(s)
    p = np.clip((t - lo) / max(hi - lo, 1e-6), 0, 1)
    c = 0.5 - 0.5 * np.cos(np.pi * p)
    nw = np.where(t < lo, 1.0, np.where(t > hi, 0.0, 1 - c)) * np.interp(t, nir_w, nr, left=0, right=0)
    ww = np.where(t < lo, 0.0, np.where(t > hi, 1.0, c)) * np.interp(t, swir_w, wr, left=0, right=0)
    d = np.maximum(nw + ww, 1e-8)
    on = cal.select("y", "x", V.interpolate(F.col("n"), nir_w, t).alias("n"), V.interpolate(F.col("w"), swir_w, t).alias("w"))
    mixed = F.zip_with(F.zip_with("n", V.lit_vector(nw / d), lambda v, k: F.coalesce(v, F.lit(0.0)) * k), F.zip_with("w", V.lit_vector(ww / d), lambda v, k: F.coalesce(v, F.lit(0.0)) * k), lambda a, b: a + b)
    cube = on.select("y", "x", mixed.alias("values"))
    shared = np.flatnonzero((nw > 0) & (ww > 0))
    dis = np.zeros(len(t))
    if len(shared):
        apart = quantiles(on, [], {f"d{k}": F.abs(F.col("n")[int(k)] - F.col("w")[int(k)]) for k in shared}, [0.5]).first()
        dis[shared] = [(apart[f"d{k}"] or [0.0])[0] for k in shared]
    base = 1 / np.maximum(nw + ww, 1e-6)
    base /= max(float(np.median(base)), 1e-6)
    unc = np.clip(0.65 * base + 0.35 * dis / max(float(np.median(dis[shared])) if len(shared) else 0.0, 1e-6), 0, 10)
    bad = float(np.quantile(unc, s.bad_quantile))
    spark = nir.sparkSession
    rows = spark.createDataFrame([(k, float(t[k]), float(nw[k] / d[k]), float(ww[k] / d[k]), float(unc[k])) for k in range(len(t))], "band_index int, wavelength_nm double, nir_weight double, swir_weight double, uncertainty double")
    wet, noisy = S.water_absorption(F.col("wavelength_nm")), F.col("uncertainty") >= bad
    table = rows.withColumn("is_low_confidence", wet | noisy).withColumn("reason", F.when(wet, "water_absorption_or_low_snr").when(noisy, "high_noise").otherwise(""))
    fixed = F.zip_with(F.zip_with("a", V.lit_vector(gain), lambda v, g: v * g), V.lit_vector(offset), lambda v, o: v + o)
    e = over.agg(F.sqrt(F.sum(V.square_error(F.col("a"), F.col("b"))) / (F.count(F.lit(1)) * len(idx))).alias("before"), F.sqrt(F.sum(V.square_error(fixed, F.col("b"))) / (F.count(F.lit(1)) * len(idx))).alias("after")).first()
    return cube, table, {"bands": len(t), "overlap_nm": [lo, hi], "overlap_rmse_before": e.before, "overlap_rmse_after": e.after, "nir_scale": n_scale, "swir_scale": w_scale}
