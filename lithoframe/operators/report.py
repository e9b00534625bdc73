"""Reports as tables: screening of metrics, product contracts, version comparison, digests, sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Contract versions that validation accepts: the scientific and preview pair, and the full-detail preview product.
CONTRACTS = ("dual-product.v1", "visual-full-detail.v1")
#: Metrics that previews must be kept out of.
REQUIRED_EXCLUSIONS = ("RMSE", "SAM")


def screen(metrics: DataFrame, limits: DataFrame, by: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """by, metric, value, minimum, maximum, evaluated, within_bound: each limit against its metric (null within where not finite)."""
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    wide = metrics.select(*by).distinct().join(limits, F.lit(True))  # limits are a fixed short list
    d = wide.join(metrics, [*by, "metric"], "left")
    within = (v >= F.coalesce("minimum", F.lit(float("-inf")))) & (v <= F.coalesce("maximum", F.lit(float("inf"))))
    return d.select(*by, "metric", F.when(ok, v).alias("value"), "minimum", "maximum", F.coalesce(ok, F.lit(False)).alias("evaluated"), F.when(ok, within).alias("within_bound"), F.col("metric").isin(*optional).alias("optional") if optional else F.lit(False).alias("optional"))


def screening_status(checks: DataFrame, by: list[str]) -> DataFrame:
    """by, failed, evaluated, status over the checks that aren't optional."""
    need = ~F.col("optional")
    g = checks.groupBy(*by).agg(F.count_if(need & ~F.coalesce("within_bound", F.lit(True))).alias("failed"), F.count_if(need & F.col("evaluated")).alias("evaluated"), F.count_if(need).alias("required"))
    s = F.when((F.col("evaluated") == 0) | (F.col("evaluated") < F.col("required")), "insufficient_support").when(F.col("failed") == 0, "within_conservative_screening_bounds").otherwise("outside_conservative_screening_bounds")
    return g.select(*by, "failed", "evaluated", s.alias("status"))


def contract_errors(manifests: DataFrame) -> DataFrame:
    """run, present, valid, errors of manifests: run, contract_version, outputs and scientific (maps key -> path), previews, visual, exclusions, not_quantitative.

    All broken rules are listed. A manifest without a contract is accepted as a legacy one (valid is null).
    """
    c = F.col

    def differing(a: str, b: str) -> Column:
        return F.array_sort(F.filter(F.map_keys(c(a)), lambda k: ~F.coalesce(F.element_at(c(a), k) == F.try_element_at(c(b), k), F.lit(False))))

    named = lambda keys, text: F.transform(keys, lambda k: F.concat(F.lit(text), k))
    one = lambda bad, text: F.when(bad, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(x) for x in REQUIRED_EXCLUSIONS]), F.transform(F.coalesce("exclusions", F.array().cast("array<string>")), lambda x: F.upper(x)))
    errors = F.concat(
        one(~c("contract_version").isin(*CONTRACTS), "unknown contract version"),
        named(differing("outputs", "scientific"), "unclassified output "),
        named(differing("scientific", "outputs"), "scientific member without output "),
        named(differing("previews", "visual"), "preview without entry "),
        named(differing("visual", "previews"), "entry without preview "),
        named(missing, "previews not excluded from "),
        one(~F.coalesce("not_quantitative", F.lit(False)), "previews not marked as not quantitative"),
    )
    there = c("contract_version").isNotNull()
    out = manifests.withColumn("errors", F.when(there, errors).otherwise(F.array().cast("array<string>")))
    return out.select("run", there.alias("present"), F.when(there, F.size("errors") == 0).alias("valid"), "errors")


def planned_conflicts(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned outputs that exist already: nothing may be written while there are any."""
    return planned.join(existing, "path", "left_semi")


def increasing(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by and whether a value rises strictly along an order."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_p", F.lag(value).over(w)).groupBy(*by).agg(F.bool_and(F.col("_p").isNull() | (F.col(value) > F.col("_p"))).alias("increasing"))


def compare_versions(metrics: DataFrame, by: list[str], versions: list[str]) -> DataFrame:
    """by, a column for each version, and the first version's change against each other one."""
    p = metrics.groupBy(*by).pivot("version", versions).agg(F.first("value"))
    first = versions[0]
    return p.select(*by, *versions, *[(F.col(first) - F.col(v)).alias(f"delta_{v}") for v in versions[1:]])


def long_rows(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: one row a metric."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select(*keys, "s.*")


def float32_digest(v: Column) -> Column:
    """SHA-256 of the little-endian float32 bytes of an array."""

    @F.arrow_udf(StringType())
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            yield pa.array([None if x is None else hashlib.sha256(np.array(x, "<f4").tobytes()).hexdigest() for x in arr.to_pylist()], pa.string())

    return run(v)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def spaced_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows evenly spaced along a key, the first and the last included.

    Ranks come from counts of key ranges, so no task sorts the whole table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges by quantiles that are fixed here: the ranges of repartitionByRange may differ from job to job.
    cuts = sorted(set(df.select(F.percentile_approx(key, [k / parts for k in range(1, parts)]).alias("q")).first().q or []))
    at_most = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key)) if cuts else F.array()
    placed = df.withColumn("_p", F.size(at_most))
    w = Window.partitionBy("_p").orderBy(key)
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    rows = sorted((r._p, r._n) for r in counts.collect())  # one number a partition
    start, at = {}, 0
    for p, c in rows:
        start[p] = at
        at += c
    if at <= n:
        return df
    wanted = sorted({round(k * (at - 1) / (n - 1)) if n > 1 else 0 for k in range(n)})
    spark: SparkSession = df.sparkSession
    first = F.broadcast(spark.createDataFrame([(p, s) for p, s in start.items()], "_p int, _s long"))
    ids = spark.createDataFrame([(int(k),) for k in wanted], "_r long")
    return placed.join(first, "_p").withColumn("_r", F.row_number().over(w) - 1 + F.col("_s")).join(ids, "_r", "left_semi").drop("_p", "_s", "_r")


def psnr(mse: Column, peak: Column) -> Column:
    return F.when(mse > 0, 20 * F.log10(peak) - 10 * F.log10(F.when(mse > 0, mse)))
