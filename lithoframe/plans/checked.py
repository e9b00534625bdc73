"""Queries that run the product's own code (sources, registration and quality rules, artifacts) over whole tables, with SQL.

Python rules are applied by ``rowwise``: an Arrow UDF that calls the same function as the run does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lithoframe.functions import scalars as S
from lithoframe.functions import vectors as V
from lithoframe.operators import alignment as A
from lithoframe.operators import moments as M
from lithoframe.operators import planes as P
from lithoframe.operators import quality as Q
from lithoframe.operators import registration as G
from lithoframe.operators.lowrank import Subspace
from lithoframe.operators.quantiles import quantiles
from lithoframe.operators.tiles import stencil
from lithoframe.operators.wald import Protocol, centre_crop
from lithoframe.plans.base import AXIS, BANDS, LONG, PX, pixels, q6, query, r6, table
from lithoframe.plans.grid import _PLANE, plane, sql_blur, sql_gradient
from lithoframe.session import shared_dir
from lithoframe.sources import artifacts, envi


def rowwise(kind: str, f: Callable, *columns: Column) -> Column:
    """f of the columns' values, row by row, in Arrow batches."""

    @F.arrow_udf(kind)
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_string

        arrow = ARROW.get(kind) or to_arrow_type(_parse_datatype_string(kind))
        for arr in it:
            yield pa.array([f(*r.values()) for r in arr.to_pylist()], arrow)

    return run(F.struct(*[c.alias(f"a{k}") for k, c in enumerate(columns)]))


def mapwise(kind: str, f: Callable, *columns: Column) -> Column:
    """f of a stack of affine maps (n, 2, 3), a batch at a time, from the columns of their six entries; null where one is."""

    @F.arrow_udf(kind)
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            m = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in arr.flatten()], -1).reshape(-1, 2, 3)
            out, known = f(m), np.isfinite(m).all((1, 2))
            yield pa.array([v if ok else None for v, ok in zip(out.tolist(), known)], ARROW[kind])

    return run(F.struct(*[c.alias(f"a{k}") for k, c in enumerate(columns)]))


ARROW = {
    "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
    "struct<samples:int,lines:int,bands:int,kind:string,waves:array<double>>": pa.struct([("samples", pa.int32()), ("lines", pa.int32()), ("bands", pa.int32()), ("kind", pa.string()), ("waves", pa.list_(pa.float64()))]),
}


# Sources and sinks -------------------------------------------------------------------------------------------------


@query(f"WITH {LONG} SELECT band, count(*) AS n, {q6('avg(v)', 'mean')}, {q6('min(v)', 'lowest')}, {q6('max(v)', 'highest')}, CAST(691.0 + 29.0 * band AS DOUBLE) AS wavelength FROM lg GROUP BY band")
def envi_round_trip(spark, sf_dir):
    """The pixel grid written as a raster by its executors and read again in strips, each band with its wavelength."""
    px = pixels(spark, sf_dir)
    lines = int(px.agg(F.max("y")).first()[0] or 0) + 1
    folder = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/envi-{uuid.uuid4().hex}"
    os.makedirs(folder)
    path = f"{folder}/NIR-1.hdr"
    h = envi.write_raster(px.select("y", "x", F.col("v").alias("values")), path, (lines, 20, BANDS), wavelengths=AXIS, description="grid")
    waves = F.broadcast(spark.createDataFrame([(k, float(w)) for k, w in enumerate(h.wavelengths)], "band int, wavelength double"))
    # A grid whose last row isn't full has pixels that were never written; they are zero in all bands.
    known = px.select("y", "x")
    rows = envi.read_raster(spark, path, rows=7).join(known, ["y", "x"]).select(F.posexplode("values").alias("band", "v"))
    got = rows.groupBy("band").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    return got.join(waves, "band").select(F.col("band").cast("long").alias("band"), "n", r6("mean", "mean"), r6("lowest", "lowest"), r6("highest", "highest"), "wavelength")


_HEAD = "concat('ENVI\\n; note = no\\nSamples = ', k, '\\nLINES=', k % 7 + 1, '\\n  bands = 3 \\nData Type = ', CASE k % 3 WHEN 0 THEN '4' WHEN 1 THEN '12' ELSE '1' END, '\\ninterleave = BIL\\nbyte order = ', k % 2, '\\nwavelength = {\\n ', k, '.5, x,\\n 700.25\\n, 2.5e3 }\\n')"


def _header(text: str) -> dict:
    raw = envi.parse_fields(text)
    kind = envi.DTYPES[int(raw["data type"])]
    order = "" if kind == "u1" else ">" if raw["byte order"] == "1" else "<"
    return {"samples": int(raw["samples"]), "lines": int(raw["lines"]), "bands": int(raw["bands"]), "kind": order + kind, "waves": envi.numbers(raw["wavelength"])}


@query(
    "WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS custkey, CAST(k AS INTEGER) AS samples, CAST(k % 7 + 1 AS INTEGER) AS lines, 3 AS bands, CASE k % 3 WHEN 0 THEN CASE k % 2 WHEN 1 THEN '>f4' ELSE '<f4' END WHEN 1 THEN CASE k % 2 WHEN 1 THEN '>u2' ELSE '<u2' END ELSE 'u1' END AS kind, 3 AS waves, k + 0.5::DOUBLE AS first_nm, 2500.0::DOUBLE AS last_nm FROM c"
)
def envi_headers(spark, sf_dir):
    """Header texts read: keys in any case, comments, lists over several lines, signs that aren't numbers left out."""
    text = F.expr(_HEAD.replace("\\n", "\n"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("h", rowwise("struct<samples:int,lines:int,bands:int,kind:string,waves:array<double>>", _header, text))
    return d.select(F.col("k").alias("custkey"), "h.samples", "h.lines", "h.bands", "h.kind", F.size("h.waves").alias("waves"), F.col("h.waves")[0].alias("first_nm"), F.element_at("h.waves", -1).alias("last_nm"))


@query(
    "WITH n AS (SELECT s_nationkey AS folder, concat(CASE s_suppkey % 3 WHEN 0 THEN 'rgb-' WHEN 1 THEN 'NIR-' ELSE 'Swir-' END, s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '.HDR' WHEN 1 THEN '.dat' ELSE '.hdr' END) AS f FROM supplier) "
    "SELECT folder, max(f) FILTER (upper(f) LIKE 'RGB-%' AND lower(f) LIKE '%.hdr') AS rgb, max(f) FILTER (upper(f) LIKE 'NIR-%' AND lower(f) LIKE '%.hdr') AS nir, max(f) FILTER (upper(f) LIKE 'SWIR-%' AND lower(f) LIKE '%.hdr') AS swir FROM n GROUP BY folder"
)
def triplet_discovery(spark, sf_dir):
    """The header of each sensor among a folder's files, whatever their case."""
    s = F.col("s_suppkey")
    name = F.concat(F.when(s % 3 == 0, "rgb-").when(s % 3 == 1, "NIR-").otherwise("Swir-"), s.cast("string"), F.when(s % 4 == 0, ".HDR").when(s % 4 == 1, ".dat").otherwise(".hdr"))
    # A folder's listing is short by nature.
    files = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("folder")).agg(F.collect_list(name).alias("files"))
    pick = lambda sensor: rowwise("string", lambda names: envi.pick_headers(names).get(sensor), F.col("files"))
    return files.select("folder", pick("RGB").alias("rgb"), pick("NIR").alias("nir"), pick("SWIR").alias("swir"))


@query(f"WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events) SELECT event_id, v IS NULL AS missing, {q6('v', 'value')} FROM e")
def json_safe_values(spark, sf_dir):
    """Values through JSON, where NaN and infinities become null."""
    k = F.col("event_id")
    v = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    d = table(spark, sf_dir, "events").select("event_id", rowwise("string", lambda x: json.dumps(artifacts.json_safe({"v": x})), v).alias("j"))
    got = F.get_json_object("j", "$.v").cast("double")
    return d.select("event_id", got.isNull().alias("missing"), r6(got, "value"))


@query(f"WITH {LONG}, s AS (SELECT label, band, avg(v) AS m FROM lg GROUP BY label, band) SELECT label, label % 3 <> 0 AS intact, {q6('avg(m)', 'mean')} FROM s GROUP BY label")
def subspace_checksums(spark, sf_dir):
    """Subspaces through their checked JSON; every third is changed on the way and must be refused."""
    ref = pixels(spark, sf_dir).groupBy("label").agg(F.array(*[F.avg(F.col("v")[k]) for k in range(BANDS)]).alias("m"))

    def intact(label: int, mean: list[float]) -> bool:
        text = Subspace(np.array(mean), np.eye(2, len(mean)), np.ones(2), "pca").to_json()
        if label % 3 == 0:
            d = json.loads(text)
            d["arrays"]["mean"]["values"][5] += 1e-3
            text = json.dumps(d)
        try:
            return bool(np.allclose(Subspace.from_json(text).mean, mean, atol=1e-6))
        except ValueError:
            return False

    return ref.select("label", rowwise("boolean", intact, F.col("label"), F.col("m")).alias("intact"), r6(F.aggregate("m", F.lit(0.0), lambda t, x: t + x) / BANDS, "mean"))


@query(f"WITH {LONG}, s AS (SELECT label, band, CAST(stddev_pop(v) AS FLOAT) AS s FROM lg GROUP BY label, band) SELECT label, label % 4 <> 0 AS intact, {q6('round(CASE WHEN label % 4 <> 0 THEN sum(CAST(s AS DOUBLE)) END, 4)', 'total')} FROM s GROUP BY label")
def scale_payloads(spark, sf_dir):
    """Additive scales through their checked JSON; every fourth comes with another axis and must be refused."""
    ref = pixels(spark, sf_dir).groupBy("label").agg(F.array(*[F.stddev_pop(F.col("v")[k]) for k in range(BANDS)]).alias("s"))

    def back(label: int, scale: list[float]) -> list[float] | None:
        text = artifacts.scale_payload(AXIS, scale, {"label": label})
        if label % 4 == 0:
            d = json.loads(text)
            d["wavelengths_nm"][0] += 1.0
            text = json.dumps(d)
        try:
            return artifacts.read_scale(text)[1].astype(float).tolist()
        except ValueError:
            return None

    d = ref.select("label", rowwise("array<double>", back, F.col("label"), F.col("s")).alias("b"))
    # Scales are stored as float32.
    return d.select("label", F.col("b").isNotNull().alias("intact"), r6(F.round(F.aggregate("b", F.lit(0.0), lambda t, x: t + x), 4), "total"))


# Regions, maps, registration rules ---------------------------------------------------------------------------------


@query(
    "WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 97 AS INTEGER) - 20 AS y, CAST(o_custkey % 61 AS INTEGER) - 10 AS x, CAST(o_orderkey % 53 AS INTEGER) + 1 AS h, CAST(o_custkey % 47 AS INTEGER) + 1 AS w FROM orders), s AS (SELECT o_orderkey, y, x, least(h, 40) AS height, least(w, 30) AS width FROM o) "
    "SELECT o_orderkey, CAST(least(greatest(y, 0), 40 - height) AS INTEGER) AS y, CAST(least(greatest(x, 0), 30 - width) AS INTEGER) AS x, height, width FROM s"
)
def region_clip(spark, sf_dir):
    """A wanted region shrunk to a plane of 40 x 30 and moved inside it."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def placed(y, x, h, w):
        r = A.place_region(A.Region("manual", y, x, h, w), np.zeros((4, 3)), np.ones((4, 3), bool), (40, 30))
        return [r["y"], r["x"], r["height"], r["width"]]

    d = table(spark, sf_dir, "orders").select("o_orderkey", rowwise("array<int>", placed, k % 97 - 20, c % 61 - 10, k % 53 + 1, c % 47 + 1).alias("r"))
    return d.select("o_orderkey", F.col("r")[0].alias("y"), F.col("r")[1].alias("x"), F.col("r")[2].alias("height"), F.col("r")[3].alias("width"))


_MAP = "SELECT c_custkey AS k, 0.9 + 0.01 * (c_custkey % 23) AS a, 0.002 * (c_custkey % 41 - 20) AS b, 0.3 * (c_custkey % 31 - 15) AS tx, 0.003 * (c_custkey % 17 - 8) AS c, 0.88 + 0.01 * (c_custkey % 29) AS d, 0.4 * (c_custkey % 19 - 9) AS ty FROM customer"


def _maps(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (0.9 + 0.01 * (k % 23)).alias("a"), (0.002 * (k % 41 - 20)).alias("b"), (0.3 * (k % 31 - 15)).alias("tx"), (0.003 * (k % 17 - 8)).alias("c"), (0.88 + 0.01 * (k % 29)).alias("d"), (0.4 * (k % 19 - 9)).alias("ty"))


def _matrix(a, b, tx, c, d, ty) -> np.ndarray:
    return np.array([[a, b, tx], [c, d, ty]], float)


_SIX = ("a", "b", "tx", "c", "d", "ty")


@query(f"WITH m AS ({_MAP}), n AS (SELECT *, sqrt(a * a + c * c) AS nx, sqrt(b * b + d * d) AS ny FROM m) SELECT k AS custkey, nx BETWEEN 0.92 AND 1.08 AND ny BETWEEN 0.92 AND 1.08 AND a * d - b * c > 0 AND abs(a * b + c * d) / (nx * ny) <= 0.04 AND abs(tx) <= 0.25 * 16 AND abs(ty) <= 0.25 * 12 AS physical FROM n")
def physical_maps(spark, sf_dir):
    """Whether affine maps are ones that a camera mount could have."""
    return _maps(spark, sf_dir).select(F.col("k").alias("custkey"), rowwise("boolean", lambda *m: G.physical(_matrix(*m), (12, 16)), *map(F.col, _SIX)).alias("physical"))


@query(f"WITH m AS ({_MAP}), g AS (SELECT k, a * x + b * y + tx AS sx, c * x + d * y + ty AS sy FROM m, (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(12)) AS y)) SELECT k AS custkey, {q6('avg(CASE WHEN sx >= 1 - 1e-6 AND sy >= 1 - 1e-6 AND sx <= 14 + 1e-6 AND sy <= 10 + 1e-6 THEN 1.0 ELSE 0.0 END)', 'covered')} FROM g GROUP BY k")
def coverage_fraction(spark, sf_dir):
    """The part of a plane that a map sends into a raster, one pixel from its border."""
    f = lambda m: A.covered((12, 16), m, (12, 16), 1.0).mean((-2, -1))
    return _maps(spark, sf_dir).select(F.col("k").alias("custkey"), r6(mapwise("double", f, *map(F.col, _SIX)), "covered"))


@query(f"WITH m AS ({_MAP}), p AS (SELECT k, (a - 1) * x + b * y + tx AS ex, c * x + (d - 1) * y + ty AS ey FROM m, (SELECT 8 + i * (119 - 16) / 10.0 AS y FROM range(11) t(i)) CROSS JOIN (SELECT 8 + j * (99 - 16) / 8.0 AS x FROM range(9) t(j))), e AS (SELECT k, sqrt(ex * ex + ey * ey) AS e FROM p) SELECT k AS custkey, {q6('median(e)', 'median')}, {q6('quantile_cont(e, 0.95)', 'p95')}, {q6('max(e)', 'highest')} FROM e GROUP BY k")
def affine_point_errors(spark, sf_dir):
    """Distances between a map and the identity at 11 x 9 points."""

    def f(m):
        e = G.affine_errors(m, A.ONE, (120, 100))
        return np.stack([np.median(e, -1), np.quantile(e, 0.95, axis=-1), e.max(-1)], -1)

    d = _maps(spark, sf_dir).select("k", mapwise("array<double>", f, *map(F.col, _SIX)).alias("e"))
    return d.select(F.col("k").alias("custkey"), *[r6(F.col("e")[i], n) for i, n in enumerate(("median", "p95", "highest"))])


@query("SELECT p_partkey, p_size AS source, CAST(p_partkey % 9 AS INTEGER) AS target, round(CAST(CASE WHEN p_partkey % 9 <= 1 OR p_size <= 1 THEN 0 ELSE (p_size - 1) / CAST(p_partkey % 9 - 1 AS DOUBLE) END AS DOUBLE), 6) + 0.0 AS step FROM part")
def endpoint_steps(spark, sf_dir):
    """Steps that map the first and last of target samples to those of source samples."""
    t = (F.col("p_partkey") % 9).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("source"), t.alias("target"), r6(S.endpoint_scale(F.col("p_size"), t), "step"))


# Masks, checks, ranks ----------------------------------------------------------------------------------------------

_DET = "d AS (SELECT vec_id, abs(v[1]) + 0.002 AS luma, abs(v[2]) * 4 AS coherence, abs(v[3]) AS strength, abs(v[4]) AS gradient FROM px)"


@query(
    f"WITH {PX}, {_DET}, s AS (SELECT greatest(quantile_cont(luma, 0.01), 0.003) AS lo, quantile_cont(luma, 0.2) AS dark FROM d WHERE luma > 0.003), t AS (SELECT quantile_cont(strength, 0.3) AS st, quantile_cont(gradient, 0.3) AS gr FROM d, s WHERE luma > lo), "
    "m AS (SELECT vec_id, luma > lo AS ok, luma <= dark AS dk, coherence >= 0.6 AND strength >= st AS rel, gradient <= gr AND strength <= st AS fl FROM d, s, t) SELECT vec_id, ok AS all_valid, ok AND dk AS dark, ok AND rel AS reliable, ok AND dk AND rel AS dark_reliable, ok AND fl AS flat FROM m"
)
def rgb_detail_masks(spark, sf_dir):
    """Valid, dark, reliable and flat pixels, from percentiles of the valid ones."""
    v = F.col("v")
    d = pixels(spark, sf_dir).select("vec_id", (F.abs(v[0]) + 0.002).alias("luma"), (F.abs(v[1]) * 4).alias("coherence"), F.abs(v[2]).alias("strength"), F.abs(v[3]).alias("gradient"))
    return Q.masks(d).select("vec_id", "all_valid", "dark", "reliable", "dark_reliable", "flat")


@query(f"WITH {PX}, q AS (SELECT quantile_cont(abs(v[1]), 0.2) AS lo, quantile_cont(abs(v[1]), 0.8) AS hi FROM px) SELECT vec_id, abs(v[1]) BETWEEN lo AND hi AS scored FROM px, q")
def low_contrast_scope(spark, sf_dir):
    """Pixels whose detail lies within the 20th and 80th percentile of its size."""
    d = pixels(spark, sf_dir).select("vec_id", F.abs(F.col("v")[0]).alias("a"))
    q = quantiles(d, [], {"q": F.col("a")}, [0.2, 0.8])
    return d.join(F.broadcast(q), F.lit(True)).select("vec_id", F.col("a").between(F.col("q")[0], F.col("q")[1]).alias("scored"))  # q is one row


@query(f"WITH {PX}, u AS (SELECT vec_id, unnest(range(8)) AS component, unnest(v[1:8]) AS value FROM px), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, component) AS place FROM u) SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(component AS INTEGER) AS component, {q6('value', 'value')} FROM k WHERE place <= 2")
def top_components(spark, sf_dir):
    """The two largest of eight components of each pixel."""
    d = pixels(spark, sf_dir).select("vec_id", F.posexplode(V.top_components(F.slice("v", 1, 8), 2)).alias("p", "c"))
    return d.select("vec_id", (F.col("p") + 1).alias("place"), F.col("c.component").alias("component"), r6("c.value", "value"))


@query("WITH k AS (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) SELECT c_nationkey, CAST(place AS INTEGER) AS place, c_custkey FROM k WHERE place <= 12")
def capped_lists(spark, sf_dir):
    """Lists held at their twelve best entries."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("place", F.row_number().over(w)).where("place <= 12").select("c_nationkey", "place", "c_custkey")


@query("WITH m AS (SELECT l_suppkey, count(*) AS n, covar_pop(l_quantity, l_extendedprice) / sqrt(var_pop(l_quantity) * var_pop(l_extendedprice)) AS r FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, n, round(CASE WHEN n >= 600 THEN r ELSE -1 END, 6) + 0.0 AS rho FROM m")
def correlation_with_fallback(spark, sf_dir):
    """Correlation, or -1 for suppliers with fewer than 600 lines."""
    m = M.pair_moments(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(m["n"].alias("n"), r6(M.correlation(m, 600, -1.0), "rho"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def keys_without_partner(spark, sf_dir):
    """Keys of one set that the other lacks."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderkey, printf('%.2f', o_totalprice / 7) AS number, printf('%+.1f %%', 100 * (o_totalprice - 150000) / 150000) AS percent FROM orders")
def number_formats(spark, sf_dir):
    """Numbers and signed percentages as a report writes them."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.number_text(F.col("o_totalprice") / 7, 2).alias("number"), S.percent_text(100 * (F.col("o_totalprice") - 150000) / 150000, 1).alias("percent"))


@query(f"SELECT p_partkey, CAST(p_size % 7 + 2 AS INTEGER) AS ratio, {q6('(p_size % 7 + 2) * sqrt(-2 * ln(0.05 + 0.01 * (p_partkey % 60))) / pi()', 'sigma')} FROM part")
def mtf_sigma(spark, sf_dir):
    """The blur whose response at a reduced grid's limit is a wanted one."""
    r, m = (F.col("p_size") % 7 + 2).cast("int"), 0.05 + 0.01 * (F.col("p_partkey") % 60)
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("ratio"), r6(rowwise("double", lambda ratio, mtf: Protocol(ratio=ratio, mtf=mtf).sigma, r, m), "sigma"))


@query("WITH p AS (SELECT p_partkey, p_size + 20 AS h, p_partkey % 90 + 20 AS w, p_size % 5 + 2 AS r FROM part), q AS (SELECT *, h // r * r AS ch, w // r * r AS cw FROM p) SELECT p_partkey, CAST((h - ch) // 2 AS INTEGER) AS y, CAST((w - cw) // 2 AS INTEGER) AS x, CAST(ch AS INTEGER) AS height, CAST(cw AS INTEGER) AS width FROM q")
def centre_crops(spark, sf_dir):
    """The centred part of a plane whose sides are multiples of a ratio."""
    d = table(spark, sf_dir, "part").select("p_partkey", rowwise("array<int>", lambda h, w, r: list(centre_crop((h, w), r)), F.col("p_size") + 20, (F.col("p_partkey") % 90 + 20).cast("int"), F.col("p_size") % 5 + 2).alias("c"))
    return d.select("p_partkey", *[F.col("c")[k].alias(n) for k, n in enumerate(("y", "x", "height", "width"))])


@query(f"WITH {_PLANE}, q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM p), l AS (SELECT y, x, ln(least(greatest((v - lo) / (hi - lo), 0), 1) + 0.012) AS v FROM p, q), {sql_blur('l', 'b', 0.7)}, {sql_gradient('b', 'g', 'scharr')} SELECT y, x, {q6('gx', 'gx')}, {q6('gy', 'gy')}, {q6('v', 'magnitude')} FROM g")
def structure_gradient(spark, sf_dir):
    """Scharr derivatives of the logarithm of a plane stretched by percentiles, as the quality report takes edges."""
    d = plane(spark, sf_dir)
    q = quantiles(d, [], {"q": F.col("v")}, [0.02, 0.98]).first().q

    def k(a):
        gx, gy = P.gradient(P.gaussian(np.log(np.clip((a["v"] - q[0]) / max(q[1] - q[0], 1e-6), 0, 1) + 0.012), 0.7, skip=True), "scharr", skip=True)
        return {"gx": gx, "gy": gy, "m": np.hypot(gx, gy)}

    return stencil(d, k, ["v"], ["gx", "gy", "m"], P.reach(0.7) + 1, tile=16).where("m is not null").select("y", "x", r6("gx", "gx"), r6("gy", "gy"), r6("m", "magnitude"))


_LIM = Q.limits()


@query(
    "WITH m AS (SELECT l_suppkey, 0.5 + 10 * avg(l_discount) AS a, 20 * avg(l_tax) AS b FROM lineitem GROUP BY l_suppkey), "
    "c AS (SELECT l_suppkey, unnest([a, b, b, a, 0.35 * b, b, a, 0.35 * a, 1.1 * b, a, 0.9 * a, CASE WHEN l_suppkey % 2 = 0 THEN 0.05 * b END]) AS v, unnest([0.8, 0.7, 0.8, 0.8, NULL, 0.8, 0.8, NULL, NULL, 0.9, 0.85, NULL]) AS lo, unnest([NULL, NULL, 1.2, 1.25, 0.35, 1.2, 1.25, 0.35, 1.1, NULL, NULL, 0.05]) AS hi FROM m) "
    "SELECT l_suppkey, CAST(count(*) FILTER (v < lo OR v > hi) AS INTEGER) AS failed, CAST(count(v) AS INTEGER) AS evaluated, CASE WHEN count(*) FILTER (v < lo OR v > hi) = 0 THEN 'within_conservative_screening_bounds' ELSE 'outside_conservative_screening_bounds' END AS status FROM c GROUP BY l_suppkey"
)
def twelve_checks(spark, sf_dir):
    """The quality report's twelve checks and their status; the halo may go unevaluated."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((0.5 + 10 * F.avg("l_discount")).alias("a"), (20 * F.avg("l_tax")).alias("b"))

    def f(k, a, b):
        s = {"reliable": {"rho": a, "beta": b, "energy_ratio": a, "residual_ratio": 0.35 * b}, "dark_reliable": {"rho": b, "beta": b, "energy_ratio": a, "residual_ratio": 0.35 * a}, "flat": {"energy_ratio": 1.1 * b}, "structure": {"orientation": a, "f1": 0.9 * a}, "halo": {"p95": 0.05 * b if k % 2 == 0 else float("nan")}}
        r = Q.screened(s, _LIM)
        return json.dumps([r["failed"], r["evaluated"], r["status"]])

    d = m.select("l_suppkey", rowwise("string", f, F.col("l_suppkey"), F.col("a"), F.col("b")).alias("j"))
    return d.select("l_suppkey", F.get_json_object("j", "$[0]").cast("int").alias("failed"), F.get_json_object("j", "$[1]").cast("int").alias("evaluated"), F.get_json_object("j", "$[2]").alias("status"))


@query(f"WITH {_PLANE}, q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM p), n AS (SELECT y, x, least(greatest((v - lo) / (hi - lo), 0), 1) AS v FROM p, q), {sql_blur('n', 'b', 1.4)} SELECT {q6('quantile_cont(abs(n.v - b.v), 0.95)', 'energy')} FROM n JOIN b USING (y, x)")
def high_frequency_energy(spark, sf_dir):
    """The 95th percentile of what a Gaussian takes from a stretched plane."""
    d = plane(spark, sf_dir)
    q = quantiles(d, [], {"q": F.col("v")}, [0.02, 0.98]).first().q

    def k(a):
        n = np.clip((a["v"] - q[0]) / max(q[1] - q[0], 1e-6), 0, 1)
        return {"h": np.abs(n - P.gaussian(n, 1.4, skip=True))}

    h = stencil(d, k, ["v"], ["h"], P.reach(1.4), tile=16)
    return quantiles(h, [], {"q": F.col("h")}, [0.95]).select(r6(F.col("q")[0], "energy"))
