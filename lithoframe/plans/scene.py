"""Whole-plane queries over the embedding grid: one task a scene. Not expressible in SQL; tests hold them against known truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lithoframe.operators import detail as D
from lithoframe.operators import planes as P
from lithoframe.operators import registration as G
from lithoframe.operators.scenes import per_scene
from lithoframe.plans.base import pixels, query, r6
from lithoframe.plans.statistics import three_class_otsu

LOW = (5, 4)


def _scene(spark, sf_dir):
    """Scenes of 25 rows of the grid, with three colours in [0, 1] and three coefficients."""
    v = F.col("v")
    d = pixels(spark, sf_dir).withColumn("scene", F.expr("cast(y div 25 as int)")).withColumn("y", F.expr("cast(y % 25 as int)"))
    return d.select("scene", "y", "x", F.array(*[F.least(F.abs(v[k]) * 2, F.lit(1.0)) for k in range(3)]).alias("rgb"), F.array(*[0.6 * v[k] + 0.4 * v[k + 3] for k in range(3)]).alias("coef"))


def _sensor(p) -> D.Sensor:
    return D.Sensor(p["rgb"].shape[:2], LOW, 1.5, 1.5)


def _rows(df, names):
    return df.select("scene", "y", "x", *[r6(n, n) for n in names])


def _kernel_query(name: str, doc: str, kernel, outputs: list[str]):
    def f(spark, sf_dir):
        return _rows(per_scene(_scene(spark, sf_dir), kernel, ["rgb", "coef"], outputs), outputs)

    f.__name__, f.__doc__ = name, doc
    return query()(f)


def _gain(method):
    def k(p):
        s = _sensor(p)
        g, a = D.detail_gain(method, p["rgb"], s, D.exposure_confidence(p["rgb"]))
        return {"gain": g, "additive": a}

    return k


def _injected(f):
    def k(p):
        s = _sensor(p)
        low = s.down(p["coef"])
        out = f(s.up(low), low, p["rgb"], s, D.exposure_confidence(p["rgb"]))
        out = out[0] if isinstance(out, tuple) else out
        return {f"c{i}": out[..., i] for i in range(3)}

    return k


def _simplex(p):
    s = _sensor(p)
    a = D.project_rows(np.abs(p["coef"]).reshape(-1, 3)).reshape(p["coef"].shape)
    low = s.down(a)
    out = D.simplex_detail(D.project_rows(s.up(low).reshape(-1, 3)).reshape(a.shape), low, p["rgb"], s, np.ones(s.high))
    return {f"a{i}": out[..., i] for i in range(3)}


def _cycle(p):
    s = _sensor(p)
    basis, mean = np.eye(3, 5), np.full(5, 0.5)
    gain, additive = D.coherent_gain(p["rgb"], s)
    out, _ = D.back_project(s.up(s.down(p["coef"])), s.down(p["coef"]) @ basis + mean, basis, mean, gain, additive, np.full(5, 0.01), s)
    return {f"c{i}": out[..., i] for i in range(3)}


def _poisson(p):
    a = D.luma(p["rgb"])
    gx, gy = P.forward_gradient(p["rgb"][..., 0])
    return {"detail": P.screened_poisson(a, gx, gy, 0.22, 1.0, 8)}


def _refined(p):
    s = _sensor(p)
    c, _ = D.refine_with_backoff(s.down(p["coef"]), p["rgb"], s)
    return {f"c{i}": c[..., i] for i in range(3)}


def _registered(p):
    a = D.luma(p["rgb"])
    if min(a.shape) < 2:  # a line has no gradient across it, so no shift can be told
        return {n: np.full((1, 1), np.nan) for n in ("dx", "dy", "score")}
    m, rho, _ = G.estimate_affine(a, np.roll(a, 1, 1), motions=("translation",))
    return {"dx": np.full((1, 1), m[0, 2]), "dy": np.full((1, 1), m[1, 2]), "score": np.full((1, 1), rho)}


def _confidence(p):
    return {"coherence": D.texture_coherence(p["rgb"]), "dark": D.dark_confidence(p["rgb"]), "exposure": D.exposure_confidence(p["rgb"])}


def _band_adaptive(p):
    s = _sensor(p)
    d, scale = D.band_adaptive(s.down(p["coef"]), p["rgb"], s)
    return {f"d{i}": d * scale[i] for i in range(3)}


poisson_fft = _kernel_query("poisson_fft", "Screened Poisson reconstruction of a plane from target gradients.", _poisson, ["detail"])
clahe = _kernel_query("clahe", "Contrast-limited equalisation of the luminance.", lambda p: {"v": P.clahe(D.luma(p["rgb"]), tiles=4)}, ["v"])
visual_detail_gain = _kernel_query("visual_detail_gain", "Gain and additive planes of full visual detail.", _gain("visual_multiscale_gradient"), ["gain", "additive"])
coherent_detail_gain = _kernel_query("coherent_detail_gain", "Gain of coherent log detail.", _gain("coherent_mtf_log_hpm"), ["gain", "additive"])
legacy_detail_gain = _kernel_query("legacy_detail_gain", "Gain of compressed luminance detail.", _gain("legacy"), ["gain", "additive"])
local_detail_injection = _kernel_query("local_detail_injection", "Detail by regression in windows.", _injected(lambda *a: D.local_detail(*a, radius=1)), ["c0", "c1", "c2"])
global_detail_injection = _kernel_query("global_detail_injection", "Detail by one regression.", _injected(D.global_detail), ["c0", "c1", "c2"])
bridge_detail_injection = _kernel_query("bridge_detail_injection", "Detail along predicted directions.", _injected(D.bridge_detail), ["c0", "c1", "c2"])
simplex_detail_injection = _kernel_query("simplex_detail_injection", "Detail of abundances on the simplex.", _simplex, ["a0", "a1", "a2"])
product_back_projection = _kernel_query("product_back_projection", "Coefficients after the product cycle.", _cycle, ["c0", "c1", "c2"])
variational_refinement = _kernel_query("variational_refinement", "Coefficients refined along the guide's edges.", _refined, ["c0", "c1", "c2"])
registration_shift = _kernel_query("registration_shift", "Shift found between a plane and its moved copy.", _registered, ["dx", "dy", "score"])
detail_confidence = _kernel_query("detail_confidence", "Coherence, dark-texture and exposure confidence.", _confidence, ["coherence", "dark", "exposure"])
band_adaptive_detail = _kernel_query("band_adaptive_detail", "Additive detail of each band by its own regression.", _band_adaptive, ["d0", "d1", "d2"])


@query()
def rock_proxy_masks(spark, sf_dir):
    """Three classes of a colour index G - (R + B) / 2 by two thresholds, eroded to their cores."""
    d = _scene(spark, sf_dir).select("scene", "y", "x", (F.col("rgb")[1] - 0.5 * (F.col("rgb")[0] + F.col("rgb")[2])).alias("v"))
    t = three_class_otsu(d, "scene", "v").join(d.groupBy("scene").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "scene")
    b = F.floor(255 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    c = d.join(t, "scene").select("scene", "y", "x", F.when(b <= F.col("t1"), 0.0).when(b <= F.col("t2"), 1.0).otherwise(2.0).alias("c"))
    from lithoframe.operators.tiles import stencil

    e = stencil(c, lambda a: {"core": (P.erode(a["c"]) == P.dilate(a["c"])).astype(float)}, ["c"], ["core"], 1, keys=["scene"])
    return c.join(e, ["scene", "y", "x"]).groupBy("scene", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("core").cast("long").alias("core"))


@query()
def wald_benchmark(spark, sf_dir):
    """Nine fusion candidates on the degraded scene, with their gain over bicubic."""
    from lithoframe.operators import wald

    v = F.col("v")
    d = pixels(spark, sf_dir).withColumn("scene", F.expr("cast(y div 25 as int)")).withColumn("y", F.expr("cast(y % 25 as int)"))
    d = d.select("scene", "y", "x", F.array(*[0.5 + v[k] + 0.2 * v[k + 4] for k in range(6)]).alias("values"), F.array(*[F.least(F.greatest(0.5 + v[k], F.lit(0.0)), F.lit(1.0)) for k in range(3)]).alias("rgb"))
    return wald.benchmark(d, wald.Protocol(ratio=2, rank=4)).select("scene", "candidate", "metric", F.round("value", 5).alias("value"), F.round("gain_percent", 3).alias("gain_percent"))
