"""Evidence over finished runs: metrics of many run folders as tables, their comparison, sweeps of settings, audits.

A run's small JSON files are read by Spark, whole, one row a folder; everything after that is DataFrame work, so
thousands of runs compare like two.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lithoframe.functions import scalars as S
from lithoframe.operators.report import long_rows

CHECK = "struct<metric:string,value:double,minimum:double,maximum:double,evaluated:boolean,within_bound:boolean>"
STATISTIC = "struct<scale:double,mask:string,pixel_count:bigint,rho:double,beta:double,energy_ratio:double,residual_ratio:double,aligned_fraction:double,reference_rms:double,candidate_rms:double,residual_rms:double>"
STRUCTURE = "struct<status:string,pixels:bigint,precision:double,recall:double,f1:double,orientation:double>"
HALO = "struct<status:string,profiles:bigint,p50:double,p95:double,width_ratio:double>"
BAND = f"struct<wavelength_nm:double,statistics:array<{STATISTIC}>,structure:{STRUCTURE},halo:{HALO},screening:struct<status:string,failed:int,evaluated:int,checks:array<{CHECK}>>>"
QUALITY = f"run_id string, status string, product_rmse double, product_sam_deg double, coefficient_rmse double, detail_correlation double, unmeasured_pixels bigint, history array<double>, bands array<{BAND}>"
SENSOR = "struct<motion:string,factor:double,score_before:double,score:double,status:string,jacobian_p01:double>"
REGISTRATION = f"run_id string, pair struct<score:double,status:string>, NIR {SENSOR}, SWIR {SENSOR}"
MANIFEST = "run_id string, product_mode string, contract_version string, high array<int>, low array<int>, bands int, rank int, config string"
#: Which way each metric is better.
BETTER = {"product_rmse": "lower", "product_sam_deg": "lower", "coefficient_rmse": "lower", "detail_correlation": "higher", "pair_score": "higher", "rho": "higher", "rho_dark": "higher", "f1": "higher", "orientation": "higher", "beta": "target", "energy_ratio": "target", "halo_p95": "lower"}


def _json(spark: SparkSession, folders: dict[str, str], name: str, schema: str) -> DataFrame:
    """(run, fields of one JSON file) of each folder."""
    paths = spark.createDataFrame([(run, f"{at.rstrip('/')}/{name}") for run, at in folders.items()], "run string, path string")
    text = spark.read.schema(StructType([StructField("value", StringType())])).text([p.path for p in paths.collect()], wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    return paths.join(text, bare(F.col("path")) == bare(F.url_decode("file"))).select("run", F.from_json("value", schema).alias("j")).select("run", "j.*")


def extract(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """One row a run: identity, settings, registration scores and product errors; ``bands`` as they are in the report."""
    q = _json(spark, folders, "quality.json", QUALITY)
    r = _json(spark, folders, "registration.json", REGISTRATION).select("run", F.col("run_id").alias("registration_id"), F.col("pair.score").alias("pair_score"), F.col("NIR.score").alias("nir_score"), F.col("SWIR.score").alias("swir_score"), F.least("NIR.jacobian_p01", "SWIR.jacobian_p01").alias("jacobian_p01"))
    m = _json(spark, folders, "manifest.json", MANIFEST).select("run", F.col("run_id").alias("manifest_id"), "product_mode", "contract_version", F.col("bands").alias("n_bands"), "rank", "config")
    return q.join(r, "run", "left").join(m, "run", "left")


def band_metrics(runs: DataFrame, scale: float = 2.4) -> DataFrame:
    """(run, wavelength_nm, 19 metrics, screening): one row a run and selected band, at one scale."""
    b = runs.select("run", F.explode("bands").alias("b")).select("run", "b.*")

    def at(mask: str, key: str, name: str):
        found = F.filter("statistics", lambda s: (s["mask"] == mask) & (F.abs(s["scale"] - scale) < 1e-9))
        return F.get(found, 0)[key].alias(name)

    keys = ("rho", "beta", "energy_ratio", "residual_ratio", "pixel_count")
    return b.select(
        "run", "wavelength_nm", *[at("reliable", k, k) for k in keys], *[at("dark_reliable", k, f"{k}_dark") for k in keys], at("all_valid", "rho", "rho_all"), at("flat", "energy_ratio", "energy_flat"),
        F.col("structure.precision").alias("precision"), F.col("structure.recall").alias("recall"), F.col("structure.f1").alias("f1"), F.col("structure.orientation").alias("orientation"),
        F.col("halo.p50").alias("halo_p50"), F.col("halo.p95").alias("halo_p95"), F.col("halo.width_ratio").alias("halo_width_ratio"),
        F.col("screening.status").alias("screening"), F.col("screening.failed").alias("failed_checks"),
    )


def metric_rows(runs: DataFrame, scale: float = 2.4) -> DataFrame:
    """(run, wavelength_nm, metric, value), wavelength null for metrics of the whole product."""
    whole = long_rows(runs.withColumn("wavelength_nm", F.lit(None).cast("double")), ["run", "wavelength_nm"], ["product_rmse", "product_sam_deg", "coefficient_rmse", "detail_correlation", "pair_score", "nir_score", "swir_score"])
    bands = band_metrics(runs, scale)
    return whole.union(long_rows(bands, ["run", "wavelength_nm"], [c for c in bands.columns if c not in ("run", "wavelength_nm", "screening")]))


def within_all_bounds(runs: DataFrame) -> DataFrame:
    """(run, within): whether every evaluated check of every selected band holds, and each required one is evaluated."""
    b = runs.select("run", F.explode_outer("bands").alias("b"))
    ok = F.coalesce(F.col("b.screening.status") == "within_conservative_screening_bounds", F.lit(False))
    return b.groupBy("run").agg(F.bool_and(ok).alias("within"))


def compare(rows: DataFrame, baseline: str, targets: dict[str, float] | None = None) -> DataFrame:
    """(run, wavelength_nm, metric, value, base, raw_percent, improvement_percent) against one run, by each metric's own direction."""
    base = rows.where(F.col("run") == baseline).select(F.col("wavelength_nm").alias("w"), F.col("metric").alias("m"), F.col("value").alias("base"))
    on = F.col("wavelength_nm").eqNullSafe(F.col("w")) & (F.col("metric") == F.col("m"))
    better = F.create_map(*[F.lit(x) for kv in BETTER.items() for x in kv])
    goal = F.create_map(*[F.lit(x) for kv in ({"beta": 1.0, "energy_ratio": 1.0} | (targets or {})).items() for x in kv])
    way = F.try_element_at(better, F.col("metric"))
    gain = F.when(way.isNotNull(), S.improvement_percent(F.col("value"), F.col("base"), way, F.coalesce(F.try_element_at(goal, F.col("metric")), F.lit(1.0))))
    return rows.where(F.col("run") != baseline).join(base, on).select("run", "wavelength_nm", "metric", "value", "base", S.raw_change_percent(F.col("value"), F.col("base")).alias("raw_percent"), gain.alias("improvement_percent"))


def faults(runs: DataFrame, wanted: int) -> list[str]:
    """What speaks against using the runs as evidence: files of different runs, runs met twice, missing runs, errors that aren't finite."""
    r = runs.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("ids"), F.count_if((F.col("run_id") != F.col("registration_id")) | (F.col("run_id") != F.col("manifest_id")) | F.col("manifest_id").isNull()).alias("mixed"),
        F.count_if(S.finite(F.col("product_rmse")).isNull() | S.finite(F.col("product_sam_deg")).isNull()).alias("odd"), F.count_if(F.size(F.coalesce("bands", F.array().cast(f"array<{BAND}>"))) == 0).alias("bare"),
    ).first()
    tests = ((r.n != wanted, f"{r.n} of {wanted} runs are there"), (r.ids != r.n, "a run is met twice"), (r.mixed, f"{r.mixed} folders hold files of different runs"), (r.odd, f"{r.odd} runs without finite errors"), (r.bare, f"{r.bare} runs without selected bands"))
    return [text for bad, text in tests if bad]


def sweep(spark: SparkSession, config, variants: dict[str, dict]) -> dict[str, str]:
    """The same inputs run under each variant of the settings, into a folder of its own beside the others. A variant whose folder is valid already isn't run again."""
    from lithoframe.plans import pipeline

    folders = {}
    for name, changes in variants.items():
        c = pipeline.overlay(replace(config, output_dir=f"{config.output_dir.rstrip('/')}/{name}"), changes)
        if not pipeline.validate(spark, c.output_dir)["valid"]:
            pipeline.run(spark, replace(c, overwrite=True))
        folders[name] = c.output_dir
    return folders


def audit(spark: SparkSession, folder: str, digests: dict[str, str]) -> DataFrame:
    """(file, expected, found, same): SHA-256 of small files against what was recorded; missing files have no digest."""
    from lithoframe.sources.store import Store

    store = Store(spark, folder)
    there = [store.path(n) for n in digests if store.exists(n)]
    want = spark.createDataFrame(list(digests.items()) or [("", "")], "file string, expected string").where("file <> ''")
    if not there:
        return want.select("file", "expected", F.lit(None).cast("string").alias("found"), F.lit(False).alias("same"))
    got = spark.read.format("binaryFile").load(there).select(F.url_decode("path").alias("path"), F.sha2("content", 256).alias("found"))
    met = want.join(got, F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("file"))), "left") if len(digests) <= 1000 else want.join(got.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)), "file", "left")
    return met.select("file", "expected", "found", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)).alias("same"))


def pivoted(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row for each value of ``by``, a column a metric."""
    return rows.groupBy(*by).pivot("metric", metrics).agg(F.first("value"))


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A table of a report; for tables of a few rows."""
    cells = [[F.coalesce(S.number_text(F.col(c), digits) if t in ("double", "float") else F.col(c).cast("string"), F.lit("-")).alias(c) for c, t in df.dtypes]]
    rows = df.select(*cells[0]).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"
