"""Guarded statistics from one pass of moments: every function returns aggregate columns for ``agg``.

All of them are sums, so Spark adds them up before the shuffle, and none raises on flat or empty groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def pair_moments(x: Column, y: Column, where: Column | None = None) -> dict[str, Column]:
    """n, means and centred population moments of the rows where both are known."""
    ok = x.isNotNull() & y.isNotNull()
    ok = ok & where if where is not None else ok
    a, b = F.when(ok, x), F.when(ok, y)
    return {"n": F.count(a), "mx": F.avg(a), "my": F.avg(b), "vx": F.var_pop(a), "vy": F.var_pop(b), "cxy": F.covar_pop(a, b)}


def correlation(m: dict[str, Column] | str, least: int, fallback: float | None = None) -> Column:
    """Pearson's r held within 1; the fallback (or null) with too few rows or a vanishing spread."""
    n, vx, vy, c = (F.col(f"{m}.{k}") if isinstance(m, str) else m[k] for k in ("n", "vx", "vy", "cxy"))
    d = F.sqrt(vx * vy) * n
    r = F.greatest(F.least(c / F.when(d > 1e-9, d / n), F.lit(1.0)), F.lit(-1.0))
    return F.when((n >= least) & (d > 1e-9), r).otherwise(F.lit(fallback).cast("double"))


def slope(m: dict[str, Column], least: int = 3) -> Column:
    return F.when((m["n"] >= least) & (m["vx"] > FLOOR), m["cxy"] / F.when(m["vx"] > FLOOR, m["vx"]))


def detail_statistics(m: dict[str, Column], least: int = 64) -> dict[str, Column]:
    """rho, beta, energy ratio, orthogonal residual ratio and root mean squares of two detail signals.

    A flat reference has beta 0 and both ratios relative to a variance of 1e-12, so that screening fails on it.
    """
    n, vx, vy, c = m["n"], m["vx"], m["vy"], m["cxy"]
    some, flat = n >= least, vx <= FLOOR
    sx, sv = F.when(~flat, vx), F.when(~flat & (vy > FLOOR), F.sqrt(vx * vy))
    beta = F.when(some & flat, F.lit(0.0)).when(some, c / sx)
    floor_ratio = F.sqrt(vy / FLOOR)
    rest = F.sqrt(F.greatest(vy - c * c / sx, F.lit(0.0)))
    rho = F.when(some, F.greatest(F.least(c / sv, F.lit(1.0)), F.lit(-1.0)))
    return {
        "pixel_count": n,
        "rho": rho,
        "beta": beta,
        "energy_ratio": F.when(some & flat, floor_ratio).when(some, F.sqrt(vy / sx)),
        "residual_ratio": F.when(some & flat, floor_ratio).when(some, rest / F.sqrt(sx)),
        "aligned_fraction": rho * rho,
        "reference_rms": F.when(some & flat, F.lit(0.0)).when(some, F.sqrt(vx)),
        "candidate_rms": F.when(some, F.sqrt(vy)),
        "residual_rms": F.when(some & flat, F.sqrt(vy)).when(some, rest),
    }


def log_relation(x: Column, y: Column, eps: float = 0.012, least_rho: float = 0.20, least_slope: float = 0.05) -> dict[str, Column]:
    """Slope, intercept and correlation of log(y + eps) on log(x + eps) over non-negative pairs, with a status."""
    ok = (x >= 0) & (y >= 0)
    m = pair_moments(F.when(ok, F.log(x + eps)), F.when(ok, F.log(y + eps)))
    good = (m["n"] >= 64) & (m["vx"] > FLOOR) & (m["vy"] > FLOOR)
    alpha = F.when(good, m["cxy"] / F.when(m["vx"] > FLOOR, m["vx"]))
    rho = F.when(good, F.greatest(F.least(m["cxy"] / F.when((m["vx"] > FLOOR) & (m["vy"] > FLOOR), F.sqrt(m["vx"] * m["vy"])), F.lit(1.0)), F.lit(-1.0)))
    strong = (F.abs(rho) >= least_rho) & (F.abs(alpha) >= least_slope)
    status = F.when(m["n"] < 64, "insufficient_support").when(~good, "degenerate_low_resolution_signal").when(strong, "identifiable").otherwise("weak_cross_modal_relation")
    return {"pixel_count": m["n"], "alpha": alpha, "intercept": m["my"] - alpha * m["mx"], "rho": rho, "status": status}


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def prediction_metrics(observed: Column, predicted: Column, baseline: Column) -> dict[str, Column]:
    """n, predictive R2 against a baseline prediction, r, RMSE and RMSE over the observed spread."""
    m = pair_moments(observed, predicted)
    sse, base = F.sum((observed - predicted) ** 2), F.sum((observed - baseline) ** 2)
    root = F.sqrt(sse / m["n"])
    return {"n": m["n"], "r2": F.when(base > FLOOR, 1 - sse / F.when(base > FLOOR, base)), "rho": correlation(m, 3), "rmse": root, "nrmse": F.when(m["vx"] > FLOOR, root / F.sqrt(F.when(m["vx"] > FLOOR, m["vx"])))}


def clip_statistics(v: Column, lo: float, hi: float | None) -> dict[str, Column]:
    """Counts beyond the limits and the ranges before and after clipping."""
    held = F.greatest(v, F.lit(float(lo)))
    held = F.least(held, F.lit(float(hi))) if hi is not None else held
    return {"n": F.count(v), "below": F.count_if(v < lo), "above": F.count_if(v > hi) if hi is not None else F.lit(0).cast("long"), "min_before": F.min(v), "max_before": F.max(v), "min_after": F.min(held), "max_after": F.max(held)}


def band_moments(df: DataFrame, x: str, y: str, bands: int) -> DataFrame:
    """(band, n, mx, my, vx, vy, cxy) of two array columns: one Arrow pass sums whole batches, a row a band and partition is shuffled.

    Plans and generated code don't grow with the bands. Sums are merged with their means, so no precision is lost to large offsets.
    """
    names = ["band", "n", "mx", "my", "vx", "vy", "cxy"]
    schema = pa.schema([("band", pa.int32()), ("n", pa.int64()), *((k, pa.float64()) for k in names[2:])])

    def run(it):
        held = [np.zeros(bands) for _ in names[1:]]
        for batch in it:
            for at in range(0, len(batch), 4096):
                a, b = (np.array(batch.column(c).slice(at, 4096).to_pylist(), float).reshape(-1, bands) for c in ("a", "b"))
                ok = np.isfinite(a) & np.isfinite(b)
                n = ok.sum(0).astype(float)
                a, b, d = np.where(ok, a, 0), np.where(ok, b, 0), np.maximum(n, 1)
                ma, mb = a.sum(0) / d, b.sum(0) / d
                da, db = np.where(ok, a - ma, 0), np.where(ok, b - mb, 0)
                held = _merged(held, [n, ma, mb, (da * da).sum(0), (db * db).sum(0), (da * db).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bands, dtype=np.int32)), pa.array(held[0].astype(np.int64)), *map(pa.array, held[1:])], schema=schema)

    sums = df.select(F.col(x).alias("a"), F.col(y).alias("b")).mapInArrow(run, "band int, n long, mx double, my double, vx double, vy double, cxy double").where("n > 0")
    # Merging of centred sums: within parts, and of the parts' means around the common mean.
    w = sums.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.expr("n * mx")).alias("sx"), F.sum(F.expr("n * my")).alias("sy"), F.sum("vx").alias("wx"), F.sum("vy").alias("wy"), F.sum("cxy").alias("wxy"), F.collect_list(F.struct("n", "mx", "my")).alias("parts"))
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")

    def between(f):
        return F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["n"] * f(p))

    return w.withColumn("mx", mx).withColumn("my", my).select(
        "band", "n", "mx", "my",
        ((F.col("wx") + between(lambda p: (p["mx"] - F.col("mx")) ** 2)) / F.col("n")).alias("vx"),
        ((F.col("wy") + between(lambda p: (p["my"] - F.col("my")) ** 2)) / F.col("n")).alias("vy"),
        ((F.col("wxy") + between(lambda p: (p["mx"] - F.col("mx")) * (p["my"] - F.col("my")))) / F.col("n")).alias("cxy"),
    )


def _merged(one: list, two: list) -> list:
    """Counts, means and centred sums of two parts together."""
    n = one[0] + two[0]
    d = np.maximum(n, 1)
    dx, dy = two[1] - one[1], two[2] - one[2]
    k = one[0] * two[0] / d
    return [n, one[1] + dx * two[0] / d, one[2] + dy * two[0] / d, one[3] + two[3] + k * dx * dx, one[4] + two[4] + k * dy * dy, one[5] + two[5] + k * dx * dy]
