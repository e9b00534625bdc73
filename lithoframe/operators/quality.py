"""Quality of transferred detail: support masks, multi-scale statistics, gradient structure, halos, screening limits.

Masks and high-pass planes come from one tiled pass; the statistics of every (scale, mask) are moments of one aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.operators import moments as M
from lithoframe.operators import planes as P
from lithoframe.operators.detail import correlation, luma, stretch
from lithoframe.operators.quantiles import quantiles
from lithoframe.operators.registration import sample
from lithoframe.operators.tiles import stencil

SCALES = (1.2, 2.4, 4.8)
#: Default bounds of the published detail screening.
LIMITS = {
    "dark_percentile": 20.0, "coherence_min": 0.60, "detail_percentile": 30.0, "flat_percentile": 30.0, "rho_min": 0.80, "rho_dark_min": 0.70, "beta_min": 0.80, "beta_max": 1.20, "energy_min": 0.80, "energy_max": 1.25,
    "residual_max": 0.35, "beta_dark_min": 0.80, "beta_dark_max": 1.20, "energy_dark_min": 0.80, "energy_dark_max": 1.25, "residual_dark_max": 0.35, "flat_energy_max": 1.10, "orientation_min": 0.90, "edge_f1_min": 0.85, "halo_p95_max": 0.05,
}


def limits(**overrides: float) -> dict[str, float]:
    """The default bounds with some replaced; unknown names, crossed ranges and values out of range are errors."""
    if unknown := set(overrides) - set(LIMITS):
        raise ValueError(f"unknown limits: {sorted(unknown)}")
    out = LIMITS | {k: float(v) for k, v in overrides.items()}
    for k, v in out.items():
        if k.endswith("percentile") and not 0 < v < 100:
            raise ValueError(f"{k} must lie between 0 and 100")
        if k in ("coherence_min", "rho_min", "rho_dark_min", "orientation_min", "edge_f1_min") and not 0 <= v <= 1:
            raise ValueError(f"{k} must lie within 0 and 1")
    for k in ("beta", "energy", "beta_dark", "energy_dark"):
        if out[f"{k}_min"] > out[f"{k}_max"]:
            raise ValueError(f"{k} range is crossed")
    return out


def detail_planes(df: DataFrame, band: str, scales=SCALES, eps: float = 0.012) -> DataFrame:
    """df (y, x, r, g, b and a band) with luminance, coherence, strength, gradient, and log high-passes of both at each scale, by one shuffle."""
    outs = ["luma", "coherence", "strength", "gradient"] + [f"{k}{i}" for k in ("ref", "out") for i in range(len(scales))]

    def kernel(a):
        rgb = np.stack([a[c] for c in "rgb"], -1)
        y = luma(rgb)
        own = P.log_high_pass(y, eps, 2.4)
        apart = np.mean([(P.log_high_pass(rgb[..., k], eps, 2.4) - own) ** 2 for k in range(3)], 0)
        common, other = P.gaussian(own * own, 2.0), P.gaussian(apart, 2.0)
        o = {"luma": y, "coherence": common / np.maximum(common + other, 1e-10), "strength": np.sqrt(np.maximum(common, 0)), "gradient": P.magnitude(P.gaussian(np.log(np.maximum(y, 0) + eps), 0.8), "scharr")}
        for i, s in enumerate(scales):
            o[f"ref{i}"], o[f"out{i}"] = P.log_high_pass(y, eps, s), P.log_high_pass(a[band], eps, s)
        return o

    return stencil(df, kernel, ["r", "g", "b", band], outs, P.reach(max(2.4, *scales)) + P.reach(2.0))


def masks(d: DataFrame, lim: dict[str, float] | None = None) -> DataFrame:
    """detail_planes with boolean columns all_valid, dark, reliable, dark_reliable, flat, from percentiles of the valid pixels."""
    lim = lim or limits()
    lit = quantiles(d.where("luma > 0.003"), [], {"q": F.col("luma")}, [0.01, lim["dark_percentile"] / 100]).first()
    signal = lit and lit.q or [0.003, 0.003]
    valid = F.col("luma") > max(float(signal[0]), 0.003)
    detail, flat = lim["detail_percentile"] / 100, lim["flat_percentile"] / 100
    q = quantiles(d.where(valid), [], {"s": F.col("strength"), "g": F.col("gradient")}, [detail, flat]).first()
    s, g = (q and q.s or [0.0, 0.0]), (q and q.g or [0.0, 0.0])[1]
    dark = valid & (F.col("luma") <= float(signal[1]))
    reliable = valid & (F.col("coherence") >= lim["coherence_min"]) & (F.col("strength") >= float(s[0]))
    flat = valid & (F.col("gradient") <= float(g)) & (F.col("strength") <= float(s[1]))
    return d.select("*", valid.alias("all_valid"), dark.alias("dark"), reliable.alias("reliable"), (dark & reliable).alias("dark_reliable"), flat.alias("flat"))


def detail_report(d: DataFrame, scales=SCALES) -> DataFrame:
    """(scale, mask, statistics...) of every scale and mask, in one aggregate over the pixels."""
    names = ("all_valid", "dark", "reliable", "dark_reliable", "flat")
    cells = []
    for i, s in enumerate(scales):
        for m in names:
            st = M.detail_statistics(M.pair_moments(F.col(f"ref{i}"), F.col(f"out{i}"), F.col(m)))
            cells.append(F.struct(F.lit(float(s)).alias("scale"), F.lit(m).alias("mask"), *[c.alias(k) for k, c in st.items()]))
    return d.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def structure_gradient(a: np.ndarray, eps: float = 0.012) -> tuple[np.ndarray, np.ndarray]:
    """Scharr components of the logarithm of a plane stretched between its 2nd and 98th percentile, smoothed by 0.7 pixels."""
    return P.gradient(P.gaussian(np.log(stretch(a) + eps), 0.7), "scharr")


def gradient_structure(ref: np.ndarray, out: np.ndarray, mask: np.ndarray) -> dict:
    """Top-decile edges within one pixel: precision, recall, F1, and mean |cos| of their orientations. Pixels that aren't finite don't count."""
    (ax, ay), (bx, by) = structure_gradient(ref), structure_gradient(out)
    a, b = np.hypot(ax, ay), np.hypot(bx, by)
    mask = mask & np.isfinite(a) & np.isfinite(b)
    none = {"status": "insufficient_support", "pixels": int(mask.sum())}
    if mask.sum() < 128:
        return none
    ea, eb = mask & (a >= max(float(np.percentile(a[mask], 90)), 1e-8)), mask & (b >= max(float(np.percentile(b[mask], 90)), 1e-8))
    if min(ea.sum(), eb.sum()) < 16:
        return none
    p, r = (eb & (P.dilate(ea.astype(float)) > 0)).sum() / eb.sum(), (ea & (P.dilate(eb.astype(float)) > 0)).sum() / ea.sum()
    o = ea & (b > max(float(np.percentile(b[mask], 50)), 1e-8))
    cos = np.abs(ax * bx + ay * by)[o] / np.maximum((a * b)[o], 1e-8)
    return {"status": "evaluated", "pixels": int(mask.sum()), "precision": float(p), "recall": float(r), "f1": float(2 * p * r / max(p + r, 1e-12)), "orientation": float(np.clip(cos, 0, 1).mean()) if o.any() else float("nan")}


def high_frequency_energy(a: np.ndarray, sigma: float = 1.4) -> float:
    """The 95th percentile of what a Gaussian takes from a plane stretched between its 2nd and 98th percentile."""
    n = stretch(a)
    high = np.abs(n - P.gaussian(n, sigma))
    return float(np.percentile(high[np.isfinite(high)], 95))


def edge_correlation(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Correlation of the edge strengths of two planes; NaN with fewer than 32 pixels or without any edges."""
    x, y = (np.hypot(*structure_gradient(v)) for v in (a, b))
    return correlation(np.where(mask, x, np.nan) if mask is not None else x, y)


#: metric, its place in the report, and its bounds' names; only the halo may go unevaluated.
CHECKS = (
    ("rho_reliable", ("reliable", "rho"), "rho_min", None), ("rho_dark_reliable", ("dark_reliable", "rho"), "rho_dark_min", None),
    ("beta_reliable", ("reliable", "beta"), "beta_min", "beta_max"), ("energy_reliable", ("reliable", "energy_ratio"), "energy_min", "energy_max"),
    ("residual_reliable", ("reliable", "residual_ratio"), None, "residual_max"), ("beta_dark_reliable", ("dark_reliable", "beta"), "beta_dark_min", "beta_dark_max"),
    ("energy_dark_reliable", ("dark_reliable", "energy_ratio"), "energy_dark_min", "energy_dark_max"), ("residual_dark_reliable", ("dark_reliable", "residual_ratio"), None, "residual_dark_max"),
    ("energy_flat", ("flat", "energy_ratio"), None, "flat_energy_max"), ("orientation", ("structure", "orientation"), "orientation_min", None),
    ("edge_f1", ("structure", "f1"), "edge_f1_min", None), ("halo_p95", ("halo", "p95"), None, "halo_p95_max"),
)


def screened(statistics: dict[str, dict], lim: dict[str, float]) -> dict:
    """The twelve checks of one band at one scale, and their status. ``statistics``: by mask, and ``structure`` and ``halo``."""
    checks = []
    for name, (part, key), low, high in CHECKS:
        v = statistics.get(part, {}).get(key)
        v = float(v) if v is not None and np.isfinite(v) else None
        lo, hi = lim.get(low), lim.get(high)
        within = None if v is None else (lo is None or v >= lo) and (hi is None or v <= hi)
        checks.append({"metric": name, "value": v, "minimum": lo, "maximum": hi, "evaluated": v is not None, "within_bound": within})
    need = [c for c in checks if c["metric"] != "halo_p95"]
    failed = sum(c["within_bound"] is False for c in checks)
    status = "insufficient_support" if any(not c["evaluated"] for c in need) else "within_conservative_screening_bounds" if failed == 0 else "outside_conservative_screening_bounds"
    return {"status": status, "failed": failed, "evaluated": sum(c["evaluated"] for c in checks), "checks": checks}


def edge_width(profile: np.ndarray, offsets: np.ndarray) -> float:
    """Distance between the 10 and 90 % crossings of a profile's running maximum."""
    a, b = profile[:6].mean(), profile[-6:].mean()
    if abs(b - a) <= 1e-8:
        return float("nan")
    m = np.maximum.accumulate((profile - a) / (b - a))
    at = []
    for level in (0.1, 0.9):
        k = np.flatnonzero(m >= level)
        if not len(k):
            return float("nan")
        k = int(k[0])
        rise = m[k] - m[k - 1] if k else 0.0
        at.append(offsets[k] if k == 0 or rise <= 1e-8 else offsets[k - 1] + (level - m[k - 1]) / rise * (offsets[k] - offsets[k - 1]))
    return float(at[1] - at[0])


def halo(ref: np.ndarray, out: np.ndarray, mask: np.ndarray, most: int = 4096) -> dict:
    """Over- and undershoot of the candidate along normals of the reference's strongest edges, and how much wider its edges are."""
    span = lambda v: (v - np.percentile(v, 2)) / max(float(np.percentile(v, 98) - np.percentile(v, 2)), 1e-6)
    a, b = span(ref), span(out)
    gx, gy = P.gradient(P.gaussian(a, 0.8), "scharr")
    g = np.hypot(gx, gy)
    ok = mask.copy()
    ok[:6], ok[-6:], ok[:, :6], ok[:, -6:] = False, False, False, False
    none = {"status": "insufficient_support", "profiles": 0}
    if ok.sum() < 128:
        return none
    y, x = np.nonzero(ok & (g >= max(float(np.percentile(g[ok], 97)), 1e-8)))
    keep = (y % 3 == 0) & (x % 3 == 0)
    y, x = y[keep], x[keep]
    if len(y) > most:
        pick = np.linspace(0, len(y) - 1, most).round().astype(int)
        y, x = y[pick], x[pick]
    if len(y) < 32:
        return none | {"profiles": len(y)}
    off = np.linspace(-4, 4, 33)
    n = np.maximum(g[y, x], 1e-8)
    sy, sx = y[:, None] + (gy[y, x] / n)[:, None] * off, x[:, None] + (gx[y, x] / n)[:, None] * off
    pa, pb = sample(a, sy, sx), sample(b, sy, sx)

    def scaled(p: np.ndarray, least: float):
        l, r = p[:, :6].mean(1), p[:, -6:].mean(1)
        return (p - l[:, None]) / np.where(np.abs(r - l) > 1e-8, r - l, 1)[:, None], np.abs(r - l) >= least

    (na, oa), (nb, ob) = scaled(pa, 0.08), scaled(pb, 0.03)
    both = oa & ob
    if both.sum() < 32:
        return none | {"profiles": int(both.sum())}
    h = np.maximum(0, nb[both].max(1) - 1) + np.maximum(0, -nb[both].min(1))
    wa, wb = edge_width(np.median(na[both], 0), off), edge_width(np.median(nb[both], 0), off)
    return {"status": "evaluated", "profiles": int(both.sum()), "p50": float(np.median(h)), "p95": float(np.percentile(h, 95)), "width_ratio": wb / wa if wa > 1e-8 else float("nan")}


def spread_patches(score: np.ndarray, size: int, k: int) -> list[tuple[int, int]]:
    """Up to k places of best score, no two nearer than three quarters of a patch."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(-score, axis=None, kind="stable"):
        y, x = divmod(int(i), score.shape[1])
        if all(np.hypot(y - a, x - b) >= 0.75 * size for a, b in out):
            out.append((y, x))
        if len(out) == k:
            break
    return out


def components(mask: np.ndarray, least: int = 1) -> np.ndarray:
    """Labels from 1 of 4-connected parts with at least ``least`` pixels, 0 elsewhere, by spreading the least label."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        low = np.where(lab > 0, lab, mask.size + 1)
        p = np.pad(low, 1, constant_values=mask.size + 1)
        new = np.where(mask, np.min([low, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]], 0), 0)
        if (new == lab).all():
            break
        lab = new
    ids, n = np.unique(lab[lab > 0], return_counts=True)
    return np.select([lab == i for i in ids[n >= least]], list(range(1, int((n >= least).sum()) + 1)), 0) if len(ids[n >= least]) else np.zeros_like(lab)
