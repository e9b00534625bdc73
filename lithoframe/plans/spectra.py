"""Spectra queries: axes, interpolation, blending, projections, products, low-rank models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions import scalars as S
from lithoframe.functions import vectors as V
from lithoframe.operators import lowrank as L
from lithoframe.operators import moments as M
from lithoframe.operators import planes as P
from lithoframe.operators.quantiles import quantiles
from lithoframe.operators.tiles import stencil
from lithoframe.plans.base import AXIS, BANDS, LONG, PX, REF, mean_spectrum, pixels, q6, query, r6, table
from lithoframe.plans.grid import sql_along
from lithoframe.plans.statistics import _with_reference

TARGET = [700.0 + 77.0 * k for k in range(24)]


def _list(v) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in v) + "]"


def _numbered(df: DataFrame, keys: list[str], v: str = "v", name: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(v).alias("band", name)).select(*keys, F.col("band").cast("long").alias("band"), r6(name, name))


@query(f"WITH {PX}, t AS (SELECT unnest(range(24)) AS band, 700.0 + 77.0 * unnest(range(24)) AS w), b AS (SELECT band, CASE WHEN w BETWEEN 691 AND 2518 THEN least(CAST(floor((w - 691) / 29) AS INTEGER), 62) END AS k, w FROM t) SELECT vec_id, band, CASE WHEN k IS NOT NULL THEN round(v[k + 1] * (1 - (w - 691 - 29 * k) / 29) + v[k + 2] * ((w - 691 - 29 * k) / 29), 6) + 0.0 END AS value FROM px, b")
def spectral_interpolation(spark, sf_dir):
    """Linear interpolation of every spectrum onto another axis, null outside its own."""
    return _numbered(pixels(spark, sf_dir).select("vec_id", V.interpolate(F.col("v"), np.array(AXIS), np.array(TARGET)).alias("v")), ["vec_id"])


@query(f"WITH a AS (SELECT unnest(range(64)) AS band, 691.0 + 29.0 * unnest(range(64)) AS w) SELECT CAST(band AS INTEGER) AS band, {q6('CASE WHEN w < 1000 THEN 1 WHEN w > 1500 THEN 0 ELSE 0.5 + 0.5 * cos(pi() * (w - 1000) / 500) END', 'nir')}, {q6('1 - CASE WHEN w < 1000 THEN 1 WHEN w > 1500 THEN 0 ELSE 0.5 + 0.5 * cos(pi() * (w - 1000) / 500) END', 'swir')} FROM a")
def taper_weights(spark, sf_dir):
    """Cosine taper between two sensors over their overlap."""
    d = spark.range(BANDS).select(F.col("id").cast("int").alias("band"), (691.0 + 29.0 * F.col("id")).alias("w"))
    t = S.cosine_taper(F.col("w"), 1000.0, 1500.0)
    return d.select("band", r6(t, "nir"), r6(1 - t, "swir"))


@query(
    f"WITH {LONG}, s AS (SELECT band, stddev_pop(v) AS s FROM lg GROUP BY band), r AS (SELECT band, 1 / (s * s) AS r FROM s), q AS (SELECT median(r) AS m FROM r) SELECT CAST(band AS INTEGER) AS band, {q6('least(greatest(r / m, 0.05), 20)', 'reliability')} FROM r, q"
)
def reliability(spark, sf_dir):
    """Inverse variance of each band relative to the median band, held within [0.05, 20]."""
    s = pixels(spark, sf_dir).agg(F.array(*[F.stddev_pop(F.col("v")[k]) for k in range(BANDS)]).alias("s"))
    r = s.select(F.transform("s", lambda v: 1 / (F.greatest(v, F.lit(1e-6)) ** 2)).alias("r"))
    o = F.array_sort("r")
    return r.select(F.posexplode(F.transform("r", lambda v: S.clip(v / ((o[BANDS // 2 - 1] + o[BANDS // 2]) / 2), 0.05, 20))).alias("band", "reliability")).select("band", r6("reliability", "reliability"))


_K = P.gaussian_weights(0.8)


@query(
    f"WITH {PX}, dims AS (SELECT max(y) AS my, max(x) AS mx FROM px), p0 AS (SELECT y, x, v[1] AS v FROM px), p1 AS (SELECT y, x, v[2] AS v FROM px), "
    + ", ".join(f"{sql_along(f'p{b}', f'q{b}', _K, 'x')}, {sql_along(f'q{b}', f's{b}', _K, 'y')}, r{b} AS (SELECT p.v - s.v AS r FROM p{b} p JOIN s{b} s USING (y, x)), m{b} AS (SELECT median(r) AS m FROM r{b}), n{b} AS (SELECT greatest(1.4826 * median(abs(r - m)), 1e-6) AS n FROM r{b}, m{b})" for b in (0, 1))
    + f" SELECT 0 AS band, {q6('n', 'noise')} FROM n0 UNION ALL SELECT 1, round(n, 6) + 0.0 FROM n1"
)
def band_noise(spark, sf_dir):
    """Noise of a band: median absolute deviation of its residual against a small Gaussian."""
    d = pixels(spark, sf_dir).select("y", "x", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col("v")[b].alias("v")) for b in (0, 1)])).alias("s")).select("y", "x", "s.*")
    r = stencil(d, lambda a: {"r": a["v"] - P.gaussian(a["v"], 0.8, skip=True)}, ["v"], ["r"], P.reach(0.8), keys=["band"], tile=16)
    mid = quantiles(r, ["band"], {"m": F.col("r")}, [0.5]).select("band", F.col("m")[0].alias("m"))
    mad = quantiles(r.join(mid, "band"), ["band"], {"d": F.abs(F.col("r") - F.col("m"))}, [0.5])
    return mad.select("band", r6(F.greatest(1.4826 * F.col("d")[0], F.lit(1e-6)), "noise"))


@query(
    f"WITH {PX}, a AS (SELECT vec_id, unnest(range(24)) AS k, v FROM px), w AS (SELECT vec_id, k, v[k + 1] AS n, v[k + 41] AS s, 1.0 - 0.5 * (1 - cos(pi() * k / 23.0)) AS wn, 0.5 * (1 - cos(pi() * k / 23.0)) AS ws FROM a), d AS (SELECT k, median(abs(n - s)) AS d FROM w GROUP BY k), q AS (SELECT median(d) AS q FROM d) "
    f"SELECT vec_id, k AS band, {q6('(n * wn + s * ws) / (wn + ws)', 'blended')}, {q6('least(greatest(0.65 * 1 / (wn + ws) + 0.35 * d / q, 0), 10)', 'uncertainty')} FROM w JOIN d USING (k), q"
)
def overlap_blend(spark, sf_dir):
    """Weighted blend of two sensors over their overlap, with an uncertainty from weights and disagreement."""
    px = pixels(spark, sf_dir).select("vec_id", F.slice("v", 1, 24).alias("n"), F.slice("v", 41, 24).alias("s"))
    ws = [0.5 * (1 - np.cos(np.pi * k / 23.0)) for k in range(24)]
    d = quantiles(px, [], {f"d{k}": F.abs(F.col("n")[k] - F.col("s")[k]) for k in range(24)}, [0.5]).select(F.array(*[F.col(f"d{k}")[0] for k in range(24)]).alias("d"))
    o = F.array_sort("d")
    u = d.select(F.transform("d", lambda x: S.clip(0.65 + 0.35 * x / F.greatest((o[11] + o[12]) / 2, F.lit(1e-6)), 0, 10)).alias("u"))
    b = px.select("vec_id", F.zip_with(F.zip_with("n", V.lit_vector([1 - w for w in ws]), lambda x, w: x * w), F.zip_with("s", V.lit_vector(ws), lambda x, w: x * w), lambda x, y: x + y).alias("b"))
    z = b.join(F.broadcast(u), F.lit(True))  # u is one row
    return z.select("vec_id", F.posexplode(F.arrays_zip("b", "u")).alias("band", "z")).select("vec_id", F.col("band").cast("long").alias("band"), r6("z.b", "blended"), r6("z.u", "uncertainty"))


@query(
    f"WITH {PX}, c AS (SELECT vec_id, list_transform(v, lambda e: 3 * e) AS c FROM px), s AS (SELECT vec_id, c, list_reverse_sort(c) AS s FROM c), t AS (SELECT vec_id, c, unnest(range(1, 65)) AS k, s FROM s), u AS (SELECT vec_id, any_value(c) AS c, max(CASE WHEN s[k] - (list_sum(s[1:k]) - 1) / k > 0 THEN (k, (list_sum(s[1:k]) - 1) / k) END) AS m FROM t GROUP BY vec_id), "
    f"p AS (SELECT vec_id, list_transform(c, lambda e: greatest(e - m[2], 0)) AS p FROM u) SELECT vec_id, unnest(range(64)) AS band, round(unnest(list_transform(p, lambda e: e / list_sum(p))), 6) + 0.0 AS value FROM p"
)
def simplex_project(spark, sf_dir):
    """Projection of all coefficients onto the probability simplex."""
    c = F.transform("v", lambda e: 3 * e)
    return _numbered(pixels(spark, sf_dir).select("vec_id", V.simplex(c).alias("v")), ["vec_id"])


_CONE = (
    f"WITH {REF}, j AS (SELECT vec_id, label, list_transform(list_zip(reference, v), lambda p: p[1] + 0.3 * p[2] + CASE WHEN list_dot_product(v, reference) < 0 THEN 2 * p[1] ELSE 0 END) AS c, reference AS r FROM px JOIN ref USING (label)), k AS (SELECT *, list_dot_product(c, r) / list_dot_product(r, r) AS al FROM j), "
    "s AS (SELECT *, list_transform(list_zip(c, r), lambda p: p[1] - al * p[2]) AS side FROM k), t AS (SELECT *, sqrt(list_dot_product(side, side)) AS size, tan(radians(40.0)) * al * sqrt(list_dot_product(r, r)) AS lim FROM s WHERE al >= 0) "
)


@query(_CONE + "SELECT vec_id, unnest(range(64)) AS band, round(unnest(CASE WHEN size <= lim THEN c ELSE list_transform(list_zip(side, r), lambda p: al * p[2] + p[1] * (lim / size)) END), 6) + 0.0 AS value FROM t")
def cone_project(spark, sf_dir):
    """Spectra held within a cone around their reference; the part along it is kept."""
    d = _cone_input(spark, sf_dir)
    return _numbered(d.select("vec_id", V.cone(F.col("c"), F.col("reference"), 40.0).alias("v")), ["vec_id"])


def _cone_input(spark, sf_dir):
    d = _with_reference(spark, sf_dir)
    add = F.when(V.dot(F.col("v"), F.col("reference")) < 0, 2.0).otherwise(0.0)
    c = V.let(add, lambda k: F.zip_with("reference", "v", lambda r, v: r + 0.3 * v + k * r))
    # Spark may compute the cone before it filters, so a candidate that points away is null before it is dropped.
    d = d.withColumn("c", V.let(c, lambda e: F.when(V.dot(e, F.col("reference")) >= 0, e)))
    return d.where("c is not null")


@query(_CONE + f", z AS (SELECT degrees(atan2(size, al * sqrt(list_dot_product(r, r)))) AS before, size > lim AS cut FROM t) SELECT count(*) AS n, count(*) FILTER (cut) AS clipped, {q6('avg(before)', 'mean_angle_before')}, {q6('max(before)', 'max_angle_before')}, {q6('max(least(before, 40.0))', 'max_angle_after')} FROM z")
def cone_diagnostics(spark, sf_dir):
    """How many spectra the cone changes, and angles before and after."""
    d = _cone_input(spark, sf_dir)
    a, b = V.spectral_angle(F.col("c"), F.col("reference")), V.spectral_angle(V.cone(F.col("c"), F.col("reference"), 40.0), F.col("reference"))
    z = d.select(a.alias("a"), b.alias("b"))
    return z.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > 40.0).alias("clipped"), r6(F.avg("a"), "mean_angle_before"), r6(F.max("a"), "max_angle_before"), r6(F.max("b"), "max_angle_after"))


_RNG = np.random.default_rng(3)
_BASIS, _MEAN = np.round(_RNG.standard_normal((4, 6)), 3), np.round(_RNG.random(6), 3)
_MOD = ("least(greatest((" + " + ".join(f"v[{k + 1}] * b{k}" for k in range(4)) + " + m) * (1 + 0.2 * v[5]) + 0.1 * v[6] * s, 0), 0.8)", "((" + " + ".join(f"v[{k + 1}] * b{k}" for k in range(4)) + " + m) * (1 + 0.2 * v[5]) + 0.1 * v[6] * s)")
_BT = "bt(band, b0, b1, b2, b3, m, s) AS (VALUES " + ", ".join(f"({b}, {', '.join(repr(float(x)) + '::DOUBLE' for x in _BASIS[:, b])}, {float(_MEAN[b])!r}::DOUBLE, {0.5 + 0.1 * b!r}::DOUBLE)" for b in range(6)) + ")"


def modulated(coef, basis, mean, gain, additive, scale) -> object:
    """Spectrum of a factorised product: reconstruct, times the gain, plus the additive plane along a spectral scale. Not yet clipped."""
    base = V.combine(coef, basis, mean)
    return F.zip_with(base, V.lit_vector(scale), lambda b, s: b * gain + additive * s)


def _product(spark, sf_dir):
    v = F.col("v")
    full = modulated(F.slice("v", 1, 4), _BASIS, _MEAN, 1 + 0.2 * v[4], 0.1 * v[5], [0.5 + 0.1 * b for b in range(6)])
    return pixels(spark, sf_dir).select("vec_id", full.alias("v"))


@query(f"WITH {PX}, {_BT} SELECT vec_id, CAST(band AS BIGINT) AS band, round({_MOD[0]}, 6) + 0.0 AS value FROM px, bt")
def reconstruct_modulate_clip(spark, sf_dir):
    """Reconstruction, gain, additive detail and one clip at the end."""
    d = _product(spark, sf_dir)
    return _numbered(d.select("vec_id", F.transform("v", lambda x: S.clip(x, 0, 0.8)).alias("v")), ["vec_id"])


@query(f"WITH {PX}, {_BT}, z AS (SELECT {_MOD[1]} AS u FROM px, bt) SELECT count(*) AS n, count(*) FILTER (u < 0) AS below, count(*) FILTER (u > 0.8) AS above, {q6('min(u)', 'min_before')}, {q6('max(u)', 'max_before')}, {q6('min(least(greatest(u, 0), 0.8))', 'min_after')}, {q6('max(least(greatest(u, 0), 0.8))', 'max_after')} FROM z")
def clip_statistics(spark, sf_dir):
    """What the physical clip changes in a product."""
    s = M.clip_statistics(F.col("u"), 0.0, 0.8)
    return _product(spark, sf_dir).select(F.explode("v").alias("u")).agg(*[c.alias(k) if k in ("n", "below", "above") else r6(c, k) for k, c in s.items()])


@query(f"WITH {LONG} SELECT band, {q6('0.5 * greatest(0.35 * stddev_pop(v), 0.04 * abs(avg(v)))', 'scale')} FROM lg GROUP BY band")
def additive_spectral_scale(spark, sf_dir):
    """Strength of additive detail in each band, from its spread and mean."""
    v = F.col("v")
    one = pixels(spark, sf_dir).agg(F.array(*[0.5 * F.greatest(0.35 * F.stddev_pop(v[k]), 0.04 * F.abs(F.avg(v[k]))) for k in range(BANDS)]).alias("s"))
    return one.select(F.posexplode("s").alias("band", "scale")).select(F.col("band").cast("long").alias("band"), r6("scale", "scale"))


_SG = V.savgol_matrix(BANDS, 11, 3)


@query(f"WITH {PX}, m(k, w) AS (VALUES " + ", ".join(f"({k}, {_list(row)})" for k, row in enumerate(_SG)) + f") SELECT vec_id, CAST(k AS BIGINT) AS band, {q6('list_dot_product(v, w)', 'value')} FROM px, m")
def savgol_smooth(spark, sf_dir):
    """Savitzky-Golay smoothing along bands, polynomial at both ends."""
    return _numbered(pixels(spark, sf_dir).select("vec_id", V.smooth(F.col("v"), _SG).alias("v")), ["vec_id"])


@query(f"WITH {PX} SELECT vec_id, {q6('0.299 * v[1] + 0.587 * v[2] + 0.114 * v[3]', 'luma')}, {q6('ln(1 + 4 * greatest(v[1], 0)) / ln(5)', 'compressed')}, {q6('CASE WHEN v[4] <= 0 THEN 0 WHEN v[4] >= 0.2 THEN 1 ELSE (v[4] / 0.2) * (v[4] / 0.2) * (3 - 2 * (v[4] / 0.2)) END', 'gate')}, {q6('CASE WHEN abs(v[5] - 2 * v[6] + v[7]) <= 1e-6 THEN 0 ELSE least(greatest(0.5 * (v[5] - v[7]) / (v[5] - 2 * v[6] + v[7]), -0.75), 0.75) END', 'peak_offset')} FROM px")
def scalar_functions(spark, sf_dir):
    """Luma, log compression, smoothstep gate and sub-pixel peak."""
    v = F.col("v")
    return pixels(spark, sf_dir).select("vec_id", r6(S.luma(v[0], v[1], v[2]), "luma"), r6(S.log_compress(v[0]), "compressed"), r6(S.smoothstep_gate(v[3], 0.0, 0.2), "gate"), r6(S.subpixel_peak(v[4], v[5], v[6]), "peak_offset"))


_RGB = ["r", "g", "b", "0.2126 * r + 0.7152 * g + 0.0722 * b", "r / t", "g / t", "ln(r + 1e-3)", "ln(g + 1e-3)", "ln(b + 1e-3)", "r * g", "r * b", "g * b", "r * r", "g * g", "b * b"]


@query(f"WITH {PX}, c AS (SELECT vec_id, abs(v[1]) AS r, abs(v[2]) AS g, abs(v[3]) AS b FROM px), d AS (SELECT *, greatest(r + g + b, 1e-6) AS t FROM c) SELECT vec_id, unnest(range(15)) AS band, round(unnest([{', '.join(_RGB)}]), 6) + 0.0 AS value FROM d")
def rgb_fifteen_features(spark, sf_dir):
    """Fifteen colour features of every pixel."""
    a = [F.abs(F.col("v")[k]) for k in range(3)]
    return _numbered(pixels(spark, sf_dir).select("vec_id", S.rgb_features(*a).alias("v")), ["vec_id"])


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE round(CAST(p_size AS DOUBLE) + 0.5, 6) + 0.0 END AS wavelength, {q6('CASE WHEN p_size > 25 THEN 100 * (p_retailprice - 1000) / 1000 ELSE 100 * (1000 - p_retailprice) / 1000 END', 'improvement')}, {q6('CASE WHEN p_size = 1 THEN NULL ELSE 100 * (p_retailprice - (p_size - 1)) / abs(p_size - 1) END', 'raw_change')} FROM part")
def labels_and_changes(spark, sf_dir):
    """Wavelength labels read, and directional and raw changes in percent."""
    p = table(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 5 == 0, F.lit("none")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5nm")))
    way = F.when(F.col("p_size") > 25, "higher").otherwise("lower")
    return p.select("p_partkey", r6(S.wavelength_of(label), "wavelength"), r6(S.improvement_percent(F.col("p_retailprice"), F.lit(1000.0), way, F.lit(0.0)), "improvement"), r6(S.raw_change_percent(F.col("p_retailprice"), (F.col("p_size") - 1).cast("double")), "raw_change"))


@query(f"WITH {LONG}, m AS (SELECT band, avg(v) AS m, var_pop(v) AS s FROM lg GROUP BY band) SELECT CAST(64 AS BIGINT) AS bands, {q6('sum(s)', 'total_variance')} FROM m")
def pca_total_variance(spark, sf_dir):
    """Total variance by the summed Gram matrix: the components' shares add up to it."""
    px = pixels(spark, sf_dir)
    m = L.fit_pca(px, "v", BANDS)
    d = px.select(L.coefficients(F.col("v"), m).alias("c"))
    one = d.agg(F.array(*[F.var_pop(F.col("c")[k]) for k in range(BANDS)]).alias("s"))
    return one.select(F.size("s").cast("long").alias("bands"), r6(V.total(F.col("s")), "total_variance"))


@query()
def pca_components(spark, sf_dir):
    """Shares of variance of eight components and the error of reconstruction from them."""
    px = pixels(spark, sf_dir)
    m = L.fit_pca(px, "v", 8)
    e = px.select(V.square_error(F.col("v"), L.reconstruct(L.coefficients(F.col("v"), m), m)).alias("e")).agg(r6(F.sqrt(F.avg("e") / BANDS), "rmse"))
    shares = spark.createDataFrame([(k, float(x)) for k, x in enumerate(m.explained)], "component int, share double")
    return shares.join(F.broadcast(e), F.lit(True)).select("component", r6("share", "share"), "rmse")


@query()
def simplex_factorisation(spark, sf_dir):
    """Endmembers and simplex weights of absolute spectra: mean weights, their sum, and the error."""
    px = pixels(spark, sf_dir).select("vec_id", F.transform("v", F.abs).alias("v"))
    m = L.fit_simplex(px, "v", "vec_id", 4, iterations=12)
    d = L.with_abundances(px, "v", "a", m.basis)
    e = V.square_error(F.col("v"), V.combine(F.col("a"), m.basis))
    return d.agg(*[F.round(F.avg(F.col("a")[k]), 4).alias(f"weight{k}") for k in range(4)], F.round(F.max(F.abs(V.total(F.col("a")) - 1)), 6).alias("sum_error"), F.round(F.sqrt(F.avg(e) / BANDS), 5).alias("rmse"))


@query()
def hybrid_factorisation(spark, sf_dir):
    """A simplex model with components of its residual, and both errors."""
    px = pixels(spark, sf_dir).select("vec_id", F.transform("v", F.abs).alias("v"))
    a, b = L.fit_hybrid(px, "v", "vec_id", 4, 4, iterations=8)
    d = L.with_abundances(px, "v", "a", a.basis).withColumn("s", V.combine(F.col("a"), a.basis)).withColumn("r", V.subtract(F.col("v"), F.col("s")))
    rest = V.square_error(F.col("r"), L.reconstruct(L.coefficients(F.col("r"), b), b))
    return d.agg(F.round(F.sqrt(F.avg(V.square_error(F.col("v"), F.col("s"))) / BANDS), 5).alias("simplex_rmse"), F.round(F.sqrt(F.avg(rest) / BANDS), 5).alias("hybrid_rmse"))


@query(
    f"WITH {PX}, m AS (SELECT list(m ORDER BY band) AS m FROM (SELECT band, avg(v) AS m FROM (SELECT unnest(range({BANDS})) AS band, unnest(v) AS v FROM px) GROUP BY band)), "
    "s0 AS (SELECT vec_id, v, round(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 12) AS d FROM px, m), c0 AS (SELECT vec_id, v FROM s0 ORDER BY d DESC, vec_id LIMIT 1), "
    "s1 AS (SELECT p.vec_id, p.v, list_sum(list_transform(list_zip(p.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM px p, c0 c), c1 AS (SELECT vec_id, v FROM s1 ORDER BY round(d, 12) DESC, vec_id LIMIT 1), "
    "s2 AS (SELECT p.vec_id, p.v, least(p.d, list_sum(list_transform(list_zip(p.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM s1 p, c1 c), c2 AS (SELECT vec_id, v FROM s2 ORDER BY round(d, 12) DESC, vec_id LIMIT 1), "
    f"a AS (SELECT 0 AS seed, v FROM c0 UNION ALL SELECT 1, v FROM c1 UNION ALL SELECT 2, v FROM c2) SELECT seed, {q6('list_sum(list_transform(v, lambda e: greatest(e, 0)))', 'total')} FROM a"
)
def farthest_seeds(spark, sf_dir):
    """Three spectra, each the farthest from those before."""
    s = L.farthest(pixels(spark, sf_dir), "v", "vec_id", 3)
    return spark.createDataFrame([(k, float(row.sum())) for k, row in enumerate(s)], "seed int, total double").select("seed", r6("total", "total"))
