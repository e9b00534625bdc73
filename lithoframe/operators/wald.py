"""Reduced-resolution benchmark of fusion candidates: a cube is degraded by a known ratio, fused again with a colour plane, and compared.

Candidates see only the degraded cube and the colour plane. Scenes are tasks of one grouped map; results are long rows
(scene, candidate, metric, value), from which reports take differences to a baseline.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.operators import detail as D
from lithoframe.operators import planes as P
from lithoframe.operators.scenes import MOST_PIXELS, fill_missing

CANDIDATES = ("bicubic", "gsa_additive", "hpm_linear", "hpm_log", "brovey", "ridge_global", "ridge_cv", "lowrank_ridge", "lowrank_cone")
METRICS = ("rmse", "sam_deg", "ergas", "forward_rmse", "psnr", "detail_rho", "dark_rmse")


@dataclass(frozen=True)
class Protocol:
    ratio: int = 4
    mtf: float = 0.25
    ridge: float = 0.01
    lambdas: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0)
    folds: int = 4
    buffer: int = 1
    rank: int = 8
    cone_deg: float = 0.5
    margin: int = 2
    ratio_limits: tuple[float, float] = (0.6, 1.6)
    log_clip: float = 0.35

    @property
    def sigma(self) -> float:
        """The Gaussian whose response at the reduced grid's limit is ``mtf``."""
        return self.ratio * float(np.sqrt(-2 * np.log(self.mtf))) / np.pi


def features(rgb: np.ndarray) -> np.ndarray:
    """The fifteen colour features as planes."""
    r, g, b = (rgb[..., k] for k in range(3))
    t = np.maximum(r + g + b, 1e-6)
    log = lambda v: np.log(np.maximum(v, 0) + 1e-3)
    return np.stack([r, g, b, 0.2126 * r + 0.7152 * g + 0.0722 * b, r / t, g / t, log(r), log(g), log(b), r * g, r * b, g * b, r * r, g * g, b * b], -1)


def ridge_per_output(x: np.ndarray, y: np.ndarray, row: np.ndarray, p: Protocol) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes, intercepts and the penalty chosen for each output by blocks of rows, trained without a buffer around the block."""
    n = int(row.max()) + 1
    block = np.minimum(row * p.folds // n, p.folds - 1)
    sse = np.zeros((len(p.lambdas), y.shape[1]))
    for k in range(p.folds):
        rows = row[block == k]
        te = block == k
        if not te.any():  # fewer rows than folds
            continue
        tr = (row < rows.min() - p.buffer) | (row > rows.max() + p.buffer)
        if tr.sum() < x.shape[1] + 2:
            continue
        for i, lam in enumerate(p.lambdas):
            b, c = D.ridge_fit(x[tr], y[tr], lam)
            sse[i] += ((y[te] - x[te] @ b - c) ** 2).sum(0)
    pick = sse.argmin(0)
    b, c = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for i in np.unique(pick):  # outputs of one penalty share a factorisation
        s = pick == i
        b[:, s], c[s] = D.ridge_fit(x, y[:, s], p.lambdas[i])
    return b, c, np.array(p.lambdas)[pick]


def cone_hold(candidate: np.ndarray, reference: np.ndarray, angle_deg: float) -> np.ndarray:
    """Candidates pulled to within an angle of their reference spectra; the part along them is kept."""
    rr = np.maximum((reference**2).sum(-1, keepdims=True), 1e-30)
    al = np.maximum((candidate * reference).sum(-1, keepdims=True) / rr, 0)
    side = candidate - al * reference
    most = np.tan(np.radians(angle_deg)) * al * np.sqrt(rr)
    size = np.linalg.norm(side, axis=-1, keepdims=True)
    return al * reference + side * np.minimum(1, most / np.maximum(size, 1e-30))


def candidates(low: np.ndarray, rgb: np.ndarray, s: D.Sensor, p: Protocol) -> dict[str, np.ndarray]:
    base, fh = s.up(low), features(rgb)
    fl = s.down(fh)
    x, y = fl.reshape(-1, fl.shape[-1]), low.reshape(-1, low.shape[-1])
    row = np.repeat(np.arange(low.shape[0]), low.shape[1])
    lo, hi = np.quantile(y, 0.0005, 0), np.quantile(y, 0.9995, 0)
    held = lambda a: np.clip(a, lo - 0.5 * (hi - lo), hi + 0.5 * (hi - lo))
    plane = lambda b, c: fh @ b + c
    out = {"bicubic": base}
    mean = y.mean(0)
    axis = np.linalg.svd(y - mean, full_matrices=False)[2][0]
    score = (y - mean) @ axis
    pan = plane(*(v for v in D.ridge_fit(x, score[:, None], p.ridge)))[..., 0]
    gains = ((y - mean) * (score - score.mean())[:, None]).mean(0) / max(float(score.var()), 1e-12)
    out["gsa_additive"] = base + s.unseen(pan)[..., None] * gains
    eps = np.maximum(1e-6, 0.01 * np.median(y, 0))
    b, c = D.ridge_fit(x, y, p.ridge)
    pred = plane(b, c)
    seen = s.up(s.down(pred))
    out["hpm_linear"] = base * np.clip(np.maximum(pred, eps) / np.maximum(seen, eps), *p.ratio_limits)
    lp = plane(*D.ridge_fit(x, np.log(np.maximum(y, 0) + eps), p.ridge))
    out["hpm_log"] = (base + eps) * np.exp(np.clip(s.unseen(lp), -p.log_clip, p.log_clip)) - eps
    l = fh[..., 3]
    out["brovey"] = base * np.clip(np.maximum(l, 1e-3) / np.maximum(s.up(s.down(l)), 1e-3), *p.ratio_limits)[..., None]
    out["ridge_global"] = base + s.unseen(pred)
    b, c, _ = ridge_per_output(x, y, row, p)
    out["ridge_cv"] = base + s.unseen(plane(b, c))
    k = min(p.rank, *y.shape)
    v = np.linalg.svd(y - mean, full_matrices=False)[2][:k]
    b, c, _ = ridge_per_output(x, (y - mean) @ v.T, row, p)
    out["lowrank_ridge"] = base + s.unseen(plane(b, c)) @ v
    done = {n: held(a) for n, a in out.items()}
    done["lowrank_cone"] = cone_hold(done["lowrank_ridge"], done["bicubic"], p.cone_deg)
    return done


def evaluate(truth: np.ndarray, got: np.ndarray, low: np.ndarray, s: D.Sensor, p: Protocol, known: np.ndarray | None = None) -> dict[str, float]:
    """RMSE, angle, ERGAS, forward RMSE, mean PSNR and correlation, and detail statistics off the margin, over known pixels.

    Where the margin leaves no pixel, only the forward RMSE can be told; the others are NaN.
    """
    m = p.margin
    t, g = truth[m:-m or None, m:-m or None], got[m:-m or None, m:-m or None]
    ok = np.isfinite(t).all(-1) & np.isfinite(g).all(-1)
    if known is not None:
        ok &= known[m:-m or None, m:-m or None]
    if not ok.any():
        return dict.fromkeys(METRICS, float("nan")) | {"forward_rmse": float(np.sqrt(((s.down(got) - low) ** 2).mean()))}
    a, b = t[ok], g[ok]
    mse = ((a - b) ** 2).mean(0)
    cos = (a * b).sum(-1) / np.maximum(np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1), 1e-10)
    hp = lambda v: v - P.gaussian(v, 1.2)
    rho = [D.correlation(np.where(ok, hp(t[..., k]), np.nan), hp(g[..., k]), 16) for k in range(t.shape[-1])]
    dark = a.mean(-1) <= np.quantile(a.mean(-1), 0.25)
    return {
        "rmse": float(np.sqrt(mse.mean())),
        "sam_deg": float(np.degrees(np.arccos(np.clip(cos, -1, 1))).mean()),
        "ergas": float(100 / p.ratio * np.sqrt((mse / np.maximum(a.mean(0) ** 2, 1e-12)).mean())),
        "forward_rmse": float(np.sqrt(((s.down(got) - low) ** 2).mean())),
        "psnr": float(np.mean(20 * np.log10(np.maximum(a.max(0), 1e-12)) - 10 * np.log10(np.maximum(mse, 1e-15)))),
        "detail_rho": float(np.nanmean(rho)) if np.isfinite(rho).any() else float("nan"),
        "dark_rmse": float(np.sqrt(((a - b)[dark] ** 2).mean())),
    }


def centre_crop(shape: tuple[int, int], ratio: int) -> tuple[int, int, int, int]:
    """(y, x, height, width) of the centred part of a plane whose sides are multiples of a ratio."""
    h, w = (n // ratio * ratio for n in shape[:2])
    return (shape[0] - h) // 2, (shape[1] - w) // 2, h, w


def run_scene(truth: np.ndarray, rgb: np.ndarray, p: Protocol, known: np.ndarray | None = None) -> list[tuple[str, str, float]]:
    """(candidate, metric, value) of one scene, cropped to a multiple of the ratio around its centre; NaN where a scene is too
    small to be degraded by it."""
    y, x, h, w = centre_crop(truth.shape, p.ratio)
    if not h or not w:
        return [(n, m, float("nan")) for n in CANDIDATES for m in METRICS]
    truth, rgb = truth[y : y + h, x : x + w], rgb[y : y + h, x : x + w]
    known = None if known is None else known[y : y + h, x : x + w]
    s = D.Sensor((h, w), (h // p.ratio, w // p.ratio), p.sigma, p.sigma)
    low = s.down(truth)
    return [(n, m, v) for n, c in candidates(low, rgb, s, p).items() for m, v in evaluate(truth, c, low, s, p, known).items()]


def benchmark(df: DataFrame, p: Protocol | None = None, scene: str = "scene") -> DataFrame:
    """(scene, candidate, metric, value, gain_percent): gains are over bicubic, where less is better, and null elsewhere.

    Pixels that a scene lacks are filled for the candidates and left out of the metrics.
    """
    p = p or Protocol()
    top = df.groupBy(scene).count().agg(F.max("count")).first()[0]
    if top is not None and top > MOST_PIXELS:
        raise ValueError(f"a scene of {top} pixels is over the bound of {MOST_PIXELS}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        cube, rgb = np.zeros((h, w, len(pdf["values"].iloc[0]))), np.zeros((h, w, 3))
        cube[pdf["y"], pdf["x"]], rgb[pdf["y"], pdf["x"]] = np.array(pdf["values"].tolist()), np.array(pdf["rgb"].tolist())
        known = np.zeros((h, w), bool)
        known[pdf["y"], pdf["x"]] = True
        known &= np.isfinite(cube).all(-1) & np.isfinite(rgb).all(-1)
        if not known.all():
            cube, rgb = fill_missing(cube, known), fill_missing(rgb, known)
        out = pd.DataFrame(run_scene(cube, rgb, p, known), columns=["candidate", "metric", "value"])
        out.insert(0, scene, pdf[scene].iloc[0])
        return out

    rows = df.select(scene, "y", "x", "values", "rgb").groupBy(scene).applyInPandas(run, f"{scene} {df.schema[scene].dataType.simpleString()}, candidate string, metric string, value double")
    base = rows.where("candidate = 'bicubic'").select(scene, "metric", F.col("value").alias("base"))
    gain = F.when(F.col("metric").isin("rmse", "sam_deg", "ergas", "dark_rmse") & (F.abs("base") > 1e-12), 100 * (F.col("base") - F.col("value")) / F.col("base"))
    return rows.join(base, [scene, "metric"]).select(scene, "candidate", "metric", "value", gain.alias("gain_percent"))


def policy(results: DataFrame, status: DataFrame, scene: str = "scene") -> DataFrame:
    """(scene, candidate, accepted, reason): fail-closed. A candidate is accepted where it gains on bicubic and the scene's bands are identifiable."""
    g = results.where("metric = 'rmse'").select(scene, "candidate", "gain_percent")
    j = g.join(status, scene, "left")
    ok = F.col("status").isin("identifiable", "weakly_identifiable")
    reason = F.when(F.col("status").isNull(), "no identifiability result").when(~ok, "bands not identifiable").when(F.col("gain_percent") <= 0, "no gain over bicubic").otherwise("")
    return j.select(scene, "candidate", F.coalesce(ok & (F.col("gain_percent") > 0), F.lit(False)).alias("accepted"), reason.alias("reason"))
