"""From a folder of three rasters to an audited product: inspect, register, run, validate.

Rasters are read in strips and stay Spark tables; so does every cube. What reaches the driver are planes: of the analysis
grid (as coarse as the spectrometers), and the colour, coefficient and gain planes of the region of interest, whose
pixels are bounded by ``scenes.MOST_PIXELS``. Quality over all bands is summed in chunks of ``CHUNK`` bands.

Tables and small files of a run go through Hadoop's file system. Rasters are written at positions of one file, so for
them the folder must be mounted on all executors.
"""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
from dataclasses import asdict, dataclass, field, fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions import scalars as S
from lithoframe.functions import vectors as V
from lithoframe.operators import alignment as A
from lithoframe.operators import detail as D
from lithoframe.operators import harmonise as H
from lithoframe.operators import lowrank as L
from lithoframe.operators import planes as P
from lithoframe.operators import quality as Q
from lithoframe.operators import registration as G
from lithoframe.operators import report as R6
from lithoframe.operators import resample as R
from lithoframe.operators import uncertainty as U
from lithoframe.operators.scenes import MOST_PIXELS
from lithoframe.session import checkpointed
from lithoframe.sources import artifacts, envi
from lithoframe.sources.store import Store

TABLES = ("harmonised", "coefficients", "gain", "additive", "support", "bands")
FILES = ("subspace.json", "scale.json", "registration.json", "bands.csv", "quality.json", "manifest.json")
RASTERS = ("cube", "coefficients", "harmonised", "gain", "additive")
PREVIEWS = ("rgb", "false_colour", "band", "mean", "gain", "registration_rgb", "registration_nir", "registration_swir", "checkerboard_nir", "checkerboard_swir", "vectors_nir", "vectors_swir", "edges")
#: Wavelengths that are looked at one by one, and bands that are reconstructed at once.
SELECTED, CHUNK = (900.0, 1650.0, 2200.0), 8


@dataclass
class Config:
    data_dir: str = ""
    output_dir: str = ""
    overwrite: bool = False
    rank: int = 8
    residual_rank: int = 6
    factorisation: str = "pca"
    refiner: str = "variational"
    coefficient_detail: str = "local"
    confidence: str = "exposure"
    gain: str = "visual_multiscale_gradient"
    additive: str = "spectral"
    product_mode: str = "scientific"
    back_projection: int = 4
    most_rmse: float = 0.08
    limits: dict = field(default_factory=dict)
    region: A.Region = field(default_factory=A.Region)
    dense: A.Dense = field(default_factory=A.Dense)
    spectral: H.Settings = field(default_factory=H.Settings)
    uncertainty: U.Settings = field(default_factory=U.Settings)
    write_rasters: bool = False
    write_uncertainty: bool = True
    write_previews: bool = True


CHOICES = {
    "factorisation": ("pca", "simplex", "hybrid"), "refiner": ("variational", "bicubic", "none"), "coefficient_detail": ("none", "local", "global", "bridge", "simplex"),
    "confidence": ("exposure", "dark", "none"), "gain": tuple(D.GAINS), "additive": ("none", "spectral", "band_adaptive"), "product_mode": ("scientific", "visual_full_detail"),
}


def overlay(base, values: dict):
    """A dataclass with values put over it, nested ones too; unknown keys are errors, lists become tuples."""
    names = {f.name for f in fields(base)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    out = {f.name: getattr(base, f.name) for f in fields(base)}
    for k, v in values.items():
        out[k] = overlay(out[k], v) if is_dataclass(out[k]) else tuple(v) if isinstance(v, list) else v
    return type(base)(**out)


def load_config(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        c = overlay(Config(), yaml.safe_load(f) or {})
    if not c.data_dir or not c.output_dir:
        raise ValueError("data_dir and output_dir are required")
    for k, allowed in CHOICES.items():
        if getattr(c, k) not in allowed:
            raise ValueError(f"{k} must be one of {allowed}")
    if c.coefficient_detail == "simplex" and c.factorisation != "simplex":
        raise ValueError("simplex detail needs a simplex factorisation")
    if c.region.mode not in ("auto", "manual") or (c.region.mode == "manual" and None in (c.region.y, c.region.x)):
        raise ValueError("region.mode must be auto, or manual with y and x")
    Q.limits(**c.limits)
    return c


def planned(config: Config) -> list[str]:
    """All that a run may write, in its output folder; the manifest comes last."""
    out = list(TABLES) + (["uncertainty"] if config.write_uncertainty else [])
    if config.write_rasters:
        names = RASTERS + (("uncertainty",) if config.write_uncertainty else ())
        out += [f"rasters/{n}.{e}" for n in names for e in ("hdr", "dat")]
    if config.write_previews:
        out += [f"previews/{n}.png" for n in PREVIEWS]
    return out + list(FILES)


def guard(spark: SparkSession, config: Config) -> Store:
    """Raises before any input is read where a planned output exists already; with ``overwrite`` they are deleted first, the manifest before all."""
    store = Store(spark, config.output_dir)
    there = [n for n in planned(config) if store.exists(n)]
    if there and not config.overwrite:
        raise FileExistsError(f"{config.output_dir} holds {', '.join(there[:5])}" + (f" and {len(there) - 5} more" if len(there) > 5 else ""))
    for n in reversed(there):
        store.delete(n)
    return store


def to_plane(df: DataFrame, value: str, shape: tuple[int, int]) -> np.ndarray:
    if shape[0] * shape[1] > MOST_PIXELS:
        raise ValueError(f"a plane of {shape} is over the bound of {MOST_PIXELS} pixels")
    pdf = df.select("y", "x", value).toPandas()
    first = pdf[value].iloc[0]
    deep = isinstance(first, (list, np.ndarray))
    a = np.full(shape + ((len(first),) if deep else ()), np.nan)
    a[pdf["y"], pdf["x"]] = np.array(pdf[value].tolist(), float)
    return a


def from_plane(spark: SparkSession, a: np.ndarray, name: str) -> DataFrame:
    import pandas as pd

    y, x = (g.ravel().astype(np.int32) for g in np.mgrid[: a.shape[0], : a.shape[1]])
    flat = a.reshape(len(y), -1)
    return spark.createDataFrame(pd.DataFrame({"y": y, "x": x, name: list(flat) if a.ndim == 3 else flat[:, 0]}), f"y int, x int, {name} {'array<double>' if a.ndim == 3 else 'double'}")


def _unit_rgb(h: envi.Header, df: DataFrame) -> DataFrame:
    top = float(np.iinfo(np.dtype(h.dtype)).max) if np.dtype(h.dtype).kind in "ui" else 1.0
    return df.select("y", "x", *[F.greatest(F.least(F.col("values")[k] / top, F.lit(1.0)), F.lit(0.0)).alias(n) for k, n in enumerate("rgb")])


def _rgb_plane(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    return to_plane(df.select("y", "x", F.array("r", "g", "b").alias("v")), "v", shape)


class Coarse:
    """Both spectrometers registered to the colour plane reduced to the first one's grid."""

    def __init__(self, spark: SparkSession, config: Config):
        found = envi.discover(config.data_dir)
        self.heads = {s: envi.read_header(p) for s, p in found.items()}
        self.high, self.small = self.heads["RGB"].shape[:2], self.heads["NIR"].shape[:2]
        self.rgb = _unit_rgb(self.heads["RGB"], envi.read_raster(spark, found["RGB"]))
        self.cubes = {s: envi.read_raster(spark, found[s]) for s in ("NIR", "SWIR")}
        self.ref = G.rgb_structure(_rgb_plane(R.degrade(self.rgb, self.high, self.small, 0, 0, list("rgb")), self.small))
        self.structure, self.matrix, self.report = {}, {}, {}
        for s, cube in self.cubes.items():
            h = self.heads[s]
            pick = sorted({int(k) for k in np.linspace(0, h.bands - 1, min(6, h.bands)).round()})
            mov = self.structure[s] = G.spectral_structure(to_plane(cube.select("y", "x", F.array(*[F.col("values")[k] for k in pick]).alias("v")), "v", h.shape[:2]))
            start = np.array([[h.samples / self.small[1], 0, 0], [0, h.lines / self.small[0], 0]], float)
            if h.shape[:2] == self.small:
                m, score, motion = G.estimate_affine(self.ref, mov, min_gain=0.01)
            else:
                (m, score), motion = G.refine_affine(self.ref, mov, start), "affine"
            self.matrix[s] = m
            self.report[s] = {"matrix": m.tolist(), "motion": motion, "score": score, "status": "failed" if score < config.dense.fail else "warning" if score < config.dense.warn else "passed"}


def register(spark: SparkSession, config: Config) -> dict:
    """Both spectrometers' coarse matrix, score and status, and the region and analysis grid that a run would take."""
    c = Coarse(spark, config)
    roi, shape, _ = _grid(c, config)
    return c.report | {"region": roi, "analysis_shape": list(shape)}


def _grid(c: Coarse, config: Config) -> tuple[dict, tuple[int, int], dict]:
    texture = P.gaussian(P.magnitude(c.ref), 2.0)
    seen = np.logical_and.reduce([A.covered(c.small, c.matrix[s], c.heads[s].shape[:2], 0.5) for s in c.matrix])
    roi = A.place_region(config.region, texture, seen, c.high)
    return (roi, *A.analysis_grid(roi, c.high, c.small, c.matrix, {s: c.heads[s].shape[:2] for s in c.matrix}))


def gathered(df: DataFrame, bands: int, shape: tuple[int, int], matrix: np.ndarray, dense_field: np.ndarray, source: tuple[int, int]) -> DataFrame:
    """Whole spectra read where each grid pixel looks: it gathers up to four rows, whatever the number of bands."""
    spark = df.sparkSession
    if shape == source and np.allclose(matrix, A.ONE) and not dense_field.any():
        return df.select("y", "x", "values")
    sy, sx = A.coordinates(shape, matrix, dense_field)
    at = from_plane(spark, np.stack([sy, sx], -1), "at").select("y", "x", F.col("at")[0].alias("sy"), F.col("at")[1].alias("sx"))
    names = [f"b{k}" for k in range(bands)]
    got = R.warp(at, df.select("y", "x", *[F.col("values")[k].alias(n) for k, n in enumerate(names)]), names)
    return got.where(" and ".join(f"{n} is not null" for n in names)).select("y", "x", F.array(*names).alias("values"))


def _fitted(cube: DataFrame, config: Config, width: int) -> tuple[L.Subspace, DataFrame]:
    """The subspace and (y, x, c) of every pixel."""
    if config.factorisation == "pca":
        model = L.fit_pca(cube, "values", config.rank)
        return model, cube.select("y", "x", L.coefficients(F.col("values"), model).alias("c"))
    held = cube.select("y", "x", F.transform("values", lambda v: F.greatest(v, F.lit(0.0))).alias("values"), F.expr(f"y * {width} + x").alias("key"))
    if config.factorisation == "simplex":
        model = L.fit_simplex(held, "values", "key", config.rank)
        return model, L.with_abundances(held, "values", "c", model.basis).select("y", "x", "c")
    ends, rest = L.fit_hybrid(held, "values", "key", config.rank, config.residual_rank)
    left = L.with_abundances(held, "values", "a", ends.basis).withColumn("rest", V.subtract(F.col("values"), L.reconstruct(F.col("a"), ends)))
    both = L.Subspace(ends.mean + rest.mean, np.vstack([ends.basis, rest.basis]), np.concatenate([ends.explained, rest.explained]), "hybrid", {"simplex": len(ends.basis), "residual": len(rest.basis)})
    return both, left.select("y", "x", F.concat("a", L.coefficients(F.col("rest"), rest)).alias("c"))


def _detailed(fine: np.ndarray, lc: np.ndarray, rgb: np.ndarray, sensor: D.Sensor, conf: np.ndarray, how: str) -> np.ndarray:
    if how == "none":
        return fine
    if how == "bridge":
        return D.bridge_detail(fine, lc, rgb, sensor, conf)[0]
    return {"local": D.local_detail, "global": D.global_detail, "simplex": D.simplex_detail}[how](fine, lc, rgb, sensor, conf)


def _confidence(rgb: np.ndarray, how: str) -> np.ndarray:
    return np.ones(rgb.shape[:2]) if how == "none" else D.dark_confidence(rgb) if how == "dark" else D.exposure_confidence(rgb)


def band_scale(lc: np.ndarray, model: L.Subspace, strength: float = 0.1) -> np.ndarray:
    """Strength of additive detail in each band, from spread and mean of the measured spectra; by factors, without a cube."""
    flat = lc.reshape(-1, lc.shape[-1])
    mean = flat.mean(0) @ model.basis + model.mean
    spread = np.sqrt(np.maximum(np.einsum("kb,kl,lb->b", model.basis, np.cov(flat.T, bias=True).reshape(flat.shape[1], -1), model.basis), 0))
    return strength * np.maximum(0.35 * spread, 0.04 * np.abs(mean))


def adaptive_scale(lc: np.ndarray, model: L.Subspace, rgb: np.ndarray, sensor: D.Sensor, strength: float = 0.5, floor: float = 0.1, smooth: float = 2.0, most: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """``detail.band_adaptive`` by factors: an additive plane, and its scale for each band by that band's regression on reduced luminance."""
    y = D.luma(rgb)
    x = (lambda v: v - v.mean())(sensor.down(y))
    vx = max(float((x * x).mean()), 1e-12)
    c = lc - lc.mean((0, 1))
    cross = (x[..., None] * c).mean((0, 1)) @ model.basis
    var = np.maximum(np.einsum("kb,kl,lb->b", model.basis, np.einsum("yxk,yxl->kl", c, c) / x.size, model.basis), 1e-15)
    s = cross / vx * np.clip((np.abs(cross / np.sqrt(vx * var)) - floor) / (1 - floor), 0, 1)
    s = P.blur_matrix(len(s), smooth) @ s if len(s) > 1 else s
    d = sensor.unseen(y, 2)
    lim = most * np.sqrt(var) / max(float(np.abs(d).max()), 1e-9)
    return d, strength * np.clip(s, -lim, lim)


class Product:
    """The factors of a product: values = max(0, (c @ basis + mean) * gain + additive * scale)."""

    def __init__(self, coef: np.ndarray, gain: np.ndarray, additive: np.ndarray, model: L.Subspace, scale: np.ndarray):
        self.coef, self.gain, self.additive, self.model, self.scale = coef, gain, additive, model, scale

    def bands(self, pick) -> np.ndarray:
        """Some bands as planes, before the clip."""
        return (self.coef @ self.model.basis[:, pick] + self.model.mean[pick]) * self.gain[..., None] + self.additive[..., None] * self.scale[pick]


def observation(product: Product, cube: DataFrame, shape: tuple[int, int], sensor: D.Sensor) -> dict:
    """The final clipped product, reduced, against the harmonised cube: error and angle over all bands, and what the clip changed. A few bands at a time."""
    n = len(product.scale)
    sse = np.zeros(shape)
    ab, aa, bb = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    below, low, high = 0, np.inf, -np.inf
    known = np.ones(shape, bool)
    for at in range(0, n, CHUNK):
        pick = np.arange(at, min(n, at + CHUNK))
        raw = product.bands(pick)
        below, low, high = below + int((raw < 0).sum()), min(low, float(raw.min())), max(high, float(raw.max()))
        a = sensor.down(np.maximum(raw, 0))
        b = to_plane(cube.select("y", "x", F.slice("values", at + 1, len(pick)).alias("v")), "v", shape)
        known &= np.isfinite(b).all(-1)
        b = np.nan_to_num(b)
        sse, ab, aa, bb = sse + ((a - b) ** 2).sum(-1), ab + (a * b).sum(-1), aa + (a * a).sum(-1), bb + (b * b).sum(-1)
    cos = np.clip(ab / np.maximum(np.sqrt(aa * bb), 1e-10), -1, 1)
    return {"product_rmse": float(np.sqrt(sse[known].sum() / (known.sum() * n))), "product_sam_deg": float(np.degrees(np.arccos(cos[known])).mean()), "clip": {"below": below, "minimum_before": low, "maximum_before": high}}


def band_reports(spark: SparkSession, product: Product, rgb: np.ndarray, axis: np.ndarray, lim: dict[str, float]) -> list[dict]:
    """Multi-scale detail statistics, gradient structure, halo and the twelve checks at each selected wavelength."""
    out, y = [], D.luma(rgb)
    colour = from_plane(spark, rgb, "v").select("y", "x", *[F.col("v")[k].alias(n) for k, n in enumerate("rgb")])
    for target in SELECTED:
        k = V.nearest_index(axis, target)
        if abs(axis[k] - target) > max(5.0, float(np.diff(axis).max())):
            continue
        plane = np.maximum(product.bands([k])[..., 0], 0)
        # The planes are cut once: masks, statistics and support read them again.
        marked = Q.masks(checkpointed(Q.detail_planes(colour.join(from_plane(spark, plane, "band"), ["y", "x"]), "band")), lim)
        rows = [r.asDict() for r in Q.detail_report(marked).collect()]
        ok = to_plane(marked.select("y", "x", F.col("reliable").cast("double").alias("m")), "m", y.shape) > 0
        extra = {"structure": Q.gradient_structure(y, plane, ok), "halo": Q.halo(y, plane, ok)}
        at = {r["mask"]: r for r in rows if r["scale"] == Q.SCALES[1]}
        out.append({"wavelength_nm": float(axis[k]), "statistics": rows, **extra, "screening": Q.screened(at | extra, lim)})
    return out


def uncertainty_plane(spark: SparkSession, observed: D.Observed, coef: np.ndarray, found: dict, sensor: D.Sensor, settings: U.Settings) -> np.ndarray:
    """Of each pixel: the reduced product's error, and what the registration's local spread does to the mean spectrum's gradient."""
    rest = observed.per_pixel(observed.parts(coef))
    points = [(int(k), *map(float, p)) for k, p in enumerate(np.concatenate([found[s]["residuals"] for s in found] or [np.zeros((0, 7))]))]
    spread = np.zeros(sensor.low)
    if points:
        p = spark.createDataFrame(points, "pid long, ref_y double, ref_x double, res_y double, res_x double, score double, margin double, backward_error double")
        w = sensor.low[1]
        grid = spark.range(sensor.low[0] * w).select(F.col("id").alias("qid"), F.expr(f"cast(id div {w} as double)").alias("qy"), F.expr(f"cast(id % {w} as double)").alias("qx"))
        c = U.local_covariance(grid, p, settings).select(F.expr(f"cast(qid div {w} as int)").alias("y"), F.expr(f"cast(qid % {w} as int)").alias("x"), F.sqrt((F.col("cov_yy") + F.col("cov_xx")) / 2).alias("s"))
        spread = to_plane(c, "s", sensor.low)
    level = observed.low @ np.abs(observed.gram[: observed.low.shape[-1], observed.low.shape[-1]]) / observed.bands
    gy, gx = np.gradient(level)
    return np.maximum(sensor.up(np.hypot(rest, spread * np.hypot(gy, gx))), 0)


def _png_planes(product: Product, axis: np.ndarray, rgb: np.ndarray, ref: np.ndarray, found: dict) -> dict[str, bytes]:
    pick = [V.nearest_index(axis, t) for t in (2200.0, 1650.0, 900.0)]
    b = np.maximum(product.bands(pick), 0)
    mean = np.maximum((product.coef @ product.model.basis.mean(1) + product.model.mean.mean()) * product.gain + product.additive * product.scale.mean(), 0)
    out = {
        "rgb": artifacts.png(np.rint(255 * np.clip(rgb, 0, 1)).astype(np.uint8)), "false_colour": artifacts.png(np.stack([artifacts.stretched(b[..., k]) for k in range(3)], -1)),
        "band": artifacts.png(artifacts.stretched(b[..., 0])), "mean": artifacts.png(artifacts.stretched(mean)), "gain": artifacts.png(artifacts.stretched(product.gain)),
        "registration_rgb": artifacts.png(artifacts.stretched(ref)), "edges": artifacts.png(A.edges(ref)),
    }
    for s, d in found.items():
        out |= {f"registration_{s.lower()}": artifacts.png(A.overlay(ref, d["plane"])), f"checkerboard_{s.lower()}": artifacts.png(A.checkerboard(ref, d["plane"])), f"vectors_{s.lower()}": artifacts.png(A.vectors_drawn(ref, d["points"]))}
    return out


def _mounted(path: str) -> str:
    p = path.removeprefix("file://").removeprefix("file:")
    if "://" in p:
        raise ValueError(f"{path}: rasters need a folder that is mounted on all executors")
    return p


def _write_rasters(store: Store, config: Config, shape: tuple[int, int], high: tuple[int, int], axis: list[float], rank: int, view: DataFrame) -> None:
    import os

    folder = _mounted(store.path("rasters"))
    os.makedirs(folder, exist_ok=True)
    read = lambda n: store.spark.read.parquet(store.path(n))
    at = lambda n: f"{folder}/{n}.hdr"
    envi.write_raster(view, at("cube"), (*high, len(axis)), wavelengths=axis, description="product")
    envi.write_raster(read("harmonised"), at("harmonised"), (*shape, len(axis)), wavelengths=axis, description="harmonised spectra of the analysis grid")
    envi.write_raster(read("coefficients"), at("coefficients"), (*high, rank), values="coefficients", description="coefficients of the subspace")
    for n in ("gain", "additive") + (("uncertainty",) if config.write_uncertainty else ()):
        envi.write_raster(read(n).select("y", "x", F.array(n).alias("values")), at(n), (*high, 1), description=n)


def run(spark: SparkSession, config: Config) -> dict:
    store = guard(spark, config)
    run_id, lim = uuid.uuid4().hex, Q.limits(**config.limits)
    coarse = Coarse(spark, config)
    roi, shape, maps = _grid(coarse, config)
    high = (roi["height"], roi["width"])
    if high[0] * high[1] > MOST_PIXELS:
        raise ValueError(f"a region of {high} is over the bound of {MOST_PIXELS} pixels")
    crop = coarse.rgb.where(F.col("y").between(roi["y"], roi["y"] + high[0] - 1) & F.col("x").between(roi["x"], roi["x"] + high[1] - 1)).select((F.col("y") - roi["y"]).alias("y"), (F.col("x") - roi["x"]).alias("x"), "r", "g", "b")
    rgb = _rgb_plane(crop, high)
    reduced = D.Sensor(high, shape, 0.0, 0.0).down(rgb)
    ref = G.rgb_structure(reduced)
    found = {s: A.dense(ref, G.warp(coarse.structure[s], maps[s], shape), config.dense) for s in maps}
    pair = A.pair_lock(found["NIR"], found["SWIR"], config.dense)
    cubes = {s: gathered(coarse.cubes[s], coarse.heads[s].bands, shape, A.chained(maps[s], d["matrix"]), d["field"], coarse.heads[s].shape[:2]) for s, d in found.items()}
    cube, bands, spectral = H.harmonise(cubes["NIR"], cubes["SWIR"], coarse.heads["NIR"].wavelengths, coarse.heads["SWIR"].wavelengths, config.spectral)

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(store.path(name))
        return spark.read.parquet(store.path(name))

    cube, bands = table(cube, "harmonised"), table(bands, "bands")
    rows = [r.asDict() for r in bands.orderBy("band_index").collect()]
    axis = np.array([r["wavelength_nm"] for r in rows])
    model, coef = _fitted(cube, config, shape[1])
    lc = to_plane(coef, "c", shape)
    measured = np.isfinite(lc).all(-1)
    lc = np.where(measured[..., None], lc, np.nanmean(lc, (0, 1)))
    sensor, score = D.estimate_sensor(rgb, G.spectral_structure(lc))
    fine, sensor = D.refine_with_backoff(lc, rgb, sensor, config.most_rmse, method=config.refiner)
    conf = _confidence(rgb, config.confidence)
    fine = _detailed(fine, lc, rgb, sensor, conf, config.coefficient_detail)
    gain, additive = D.detail_gain(config.gain, rgb, sensor, conf)
    if config.additive == "band_adaptive":
        additive, scale = adaptive_scale(lc, model, rgb, sensor)
    else:
        scale = band_scale(lc, model) * (config.additive != "none")
    observed = D.Observed(lc, model.basis, model.mean, gain, additive, scale, sensor)
    fine, history = D.back_project_factors(fine, observed, config.back_projection, simplex=config.factorisation == "simplex")
    whole = Product(fine, gain, additive, model, scale)
    for name, plane in (("coefficients", fine), ("gain", gain), ("additive", additive)):
        table(from_plane(spark, plane, name), name)
    near = np.minimum(np.arange(high[0]) * shape[0] // high[0], shape[0] - 1)[:, None], np.minimum(np.arange(high[1]) * shape[1] // high[1], shape[1] - 1)[None]
    table(from_plane(spark, measured[near].astype(float), "measured").select("y", "x", (F.col("measured") > 0).alias("measured")), "support")
    if config.write_uncertainty:
        table(from_plane(spark, uncertainty_plane(spark, observed, fine, found, sensor, config.uncertainty), "uncertainty"), "uncertainty")
    low_error = float(np.sqrt(((sensor.down(fine) - lc) ** 2).mean()))
    quality = observation(whole, cube, shape, sensor) | {
        "run_id": run_id, "coefficient_rmse": low_error, "history": history, "sensor": asdict(sensor), "sensor_score": score, "unmeasured_pixels": int((~measured).sum()),
        "detail_correlation": D.correlation(np.log(gain) - P.gaussian(np.log(gain), 2.4), P.log_high_pass(D.luma(rgb), 0.012, 2.4)), "spectral": spectral,
        "bands": band_reports(spark, whole, rgb, axis, lim),
    }
    registration = {"run_id": run_id, "coarse": coarse.report, "pair": pair, "region": roi, "analysis_shape": list(shape)} | {
        s: {"matrix": A.chained(maps[s], d["matrix"]).tolist(), "points": d["points"].tolist()} | {k: d[k] for k in ("motion", "steps", "factor", "score_before", "score", "status", "jacobian_p01")} for s, d in found.items()
    }
    order = ["passed", "warning", "failed"]
    own = "passed" if quality["product_rmse"] < config.most_rmse else "failed"
    quality["status"] = max([own, pair["status"], *(d["status"] for d in found.values())], key=order.index)
    store.write("subspace.json", model.to_json().encode())
    store.write("scale.json", artifacts.scale_payload(axis.tolist(), np.abs(scale).tolist(), {"run_id": run_id, "signs": np.sign(scale).tolist()}).encode())
    text = io.StringIO()
    w = csv.DictWriter(text, fieldnames=list(rows[0]))
    w.writeheader()
    w.writerows(rows)
    store.write("bands.csv", text.getvalue().encode("utf-8-sig"))
    if config.write_rasters:
        _write_rasters(store, config, shape, high, axis.tolist(), lc.shape[-1], _view(spark, store, model, scale))
    if config.write_previews:
        for n, data in _png_planes(whole, axis, rgb, ref, found).items():
            store.write(f"previews/{n}.png", data)
    store.write_json("registration.json", registration)
    store.write_json("quality.json", quality)
    manifest = {"run_id": run_id, "scale": scale.tolist(), "high": list(high), "low": list(shape), "region": roi, "bands": len(axis), "rank": int(lc.shape[-1]), "inputs": {s: {"shape": list(h.shape), "dtype": str(h.dtype), "interleave": h.interleave} for s, h in coarse.heads.items()}, "config": asdict(config), "status": quality["status"], "digests": dict(store.digests)}
    manifest |= contract(config, [n for n in planned(config) if n != "manifest.json"])
    store.write_json("manifest.json", manifest)
    return manifest


def contract(config: Config, names: list[str]) -> dict:
    """What each output is for: numbers, or pictures that no metric may use."""
    pictures = {n: n for n in names if n.startswith("previews/")}
    numbers = {n: n for n in names if n not in pictures}
    return {"contract_version": "dual-product.v1" if config.product_mode == "scientific" else "visual-full-detail.v1", "product_mode": config.product_mode, "outputs": numbers, "scientific": dict(numbers), "previews": pictures, "visual": dict(pictures), "exclusions": ["RMSE", "SAM"], "not_quantitative": True}


def _view(spark: SparkSession, store: Store, m: L.Subspace, scale) -> DataFrame:
    read = lambda n: spark.read.parquet(store.path(n))
    j = read("coefficients").join(read("gain"), ["y", "x"]).join(read("additive"), ["y", "x"])
    base = L.reconstruct(F.col("coefficients"), m)
    return j.select("y", "x", F.zip_with(base, V.lit_vector(scale), lambda b, s: F.greatest(b * F.col("gain") + F.col("additive") * s, F.lit(0.0))).alias("values"))


def product(spark: SparkSession, folder: str) -> DataFrame:
    """The product as a view: (y, x, values) from its factors, clipped once at the end. The cube itself is never stored."""
    store = Store(spark, folder)
    return _view(spark, store, L.Subspace.from_json(store.read("subspace.json").decode()), store.read_json("manifest.json")["scale"])


def manifest_rows(spark: SparkSession, manifests: dict[str, dict]) -> DataFrame:
    """Manifests as the rows that ``report.contract_errors`` judges."""
    kinds = "run string, contract_version string, outputs map<string,string>, scientific map<string,string>, previews map<string,string>, visual map<string,string>, exclusions array<string>, not_quantitative boolean"
    keys = ("contract_version", "outputs", "scientific", "previews", "visual", "exclusions", "not_quantitative")
    return spark.createDataFrame([(run, *(m.get(k) for k in keys)) for run, m in manifests.items()], kinds)


def validate(spark: SparkSession, folder: str) -> dict:
    """All checks of a finished run; every failed one is listed."""
    store = Store(spark, folder)
    if not store.exists("manifest.json"):
        return {"valid": False, "errors": ["missing manifest.json"]}
    manifest = store.read_json("manifest.json")
    errors = [f"missing {n}" for n in [*manifest.get("outputs", {}), *manifest.get("previews", {})] if not store.exists(n)]
    if errors:
        return {"valid": False, "errors": errors}
    errors += [f"{n} doesn't match its digest" for n, d in manifest.get("digests", {}).items() if hashlib.sha256(store.read(n)).hexdigest() != d]
    errors += [e for r in R6.contract_errors(manifest_rows(spark, {folder: manifest})).collect() for e in r.errors]
    high, low, n_bands, model = tuple(manifest["high"]), tuple(manifest["low"]), manifest["bands"], None
    try:
        model = L.Subspace.from_json(store.read("subspace.json").decode())
        if model.basis.shape != (manifest["rank"], n_bands):
            errors.append("the subspace doesn't have the product's rank and bands")
    except ValueError as e:
        errors.append(str(e))
    try:
        axis, scale = artifacts.read_scale(store.read("scale.json").decode())
        if len(axis) != n_bands or not np.allclose(scale, np.abs(manifest["scale"]), atol=1e-6):
            errors.append("the additive scale doesn't belong to the product")
    except ValueError as e:
        errors.append(str(e))
    ids = {n: store.read_json(n).get("run_id") for n in ("quality.json", "registration.json")} | {"manifest.json": manifest.get("run_id")}
    if len(set(ids.values())) != 1:
        errors.append(f"files of different runs: {ids}")
    read = lambda n: spark.read.parquet(store.path(n))
    b = read("bands").orderBy("band_index").select("wavelength_nm").toPandas()["wavelength_nm"].to_numpy()
    if len(b) != n_bands or not (np.diff(b) > 0).all():
        errors.append("wavelengths don't rise, or aren't as many as the bands")
    if len(store.read("bands.csv").decode("utf-8-sig").splitlines()) != n_bands + 1:
        errors.append("bands.csv doesn't have a line for each band")
    for name, shape, deep in (("harmonised", low, n_bands), ("coefficients", high, manifest["rank"]), ("gain", high, 0), ("additive", high, 0), ("support", high, 0), ("uncertainty", high, 0)):
        if name in manifest["outputs"]:
            value = {"harmonised": "values", "support": "measured"}.get(name, name)
            errors += _plane_errors(read(name), name, value, shape, deep, whole=name != "harmonised")
    sampled = None if model is None else _view(spark, store, model, manifest["scale"]).where(F.expr(f"y % {max(1, high[0] // 16)} = 0 and x % {max(1, high[1] // 12)} = 0"))
    if sampled is not None and sampled.where(F.exists("values", lambda v: v.isNull() | F.isnan(v) | (v < 0))).count():
        errors.append("sampled spectra of the product aren't finite")
    if manifest["status"] == "failed" or store.read_json("quality.json").get("status") != manifest["status"]:
        errors.append("quality status is failed or differs from the manifest")
    return {"valid": not errors, "errors": errors}


def _plane_errors(df: DataFrame, name: str, value: str, shape: tuple[int, int], deep: int, whole: bool) -> list[str]:
    """Whether a table fills a grid, once each pixel, with finite values of the right length."""
    v = F.col(value)
    if deep:
        odd = F.coalesce(F.size(v) != deep, F.lit(True)) | F.exists(v, lambda e: e.isNull() | F.isnan(e))
    else:
        odd = v.isNull() | S.finite(v.cast("double")).isNull()
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"), F.count_distinct("y", "x").alias("d"), F.max("y").alias("y"), F.max("x").alias("x")).first()
    out = []
    if r.n != r.d or (whole and r.n != shape[0] * shape[1]) or (r.y or 0) >= shape[0] or (r.x or 0) >= shape[1]:
        out.append(f"{name} doesn't fill the grid {shape} once")
    if r.odd:
        out.append(f"{r.odd} rows of {name} aren't finite or have the wrong length")
    return out
