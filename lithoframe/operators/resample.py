"""Resampling of planes: area reduction, bicubic enlargement, sensor degradation, warps. All are equi-joins with sparse weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import planes as P

#: Weight rows up to which an axis table is broadcast (24 bytes each); longer axes are joined by shuffle.
BROADCAST_WEIGHTS = 1 << 20
#: For each target sample, its source samples and their weights.
Weights = list[list[tuple[int, float]]]


def weight_table(spark: SparkSession, m: np.ndarray | Weights, source: str, target: str, weight: str) -> DataFrame:
    """A dense matrix's entries, or those of a list of weights for each target, as they are."""
    if isinstance(m, np.ndarray):
        t, s = np.nonzero(np.abs(m) > 1e-15)
        rows = [(int(a), int(b), float(m[b, a])) for b, a in zip(t, s)]
    else:
        rows = [(s, t, float(w)) for t, row in enumerate(m) for s, w in row]
    df = spark.createDataFrame(rows, f"{source} int, {target} int, {weight} double")
    return F.broadcast(df) if len(rows) <= BROADCAST_WEIGHTS else df


def separable(df: DataFrame, rows: np.ndarray | Weights, cols: np.ndarray | Weights, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, y, x and each value as rows @ plane @ cols.T, for sparse matrices: a pixel goes to the cells that it weighs in.

    Sums are built up before each of the two shuffles. A cell is null when a pixel that it needs is.
    """
    keys, spark = keys or [], df.sparkSession
    wx = weight_table(spark, cols, "x", "_tx", "_wx")
    first = df.join(wx, "x").groupBy(*keys, "y", "_tx").agg(*[F.when(F.count_if(F.col(v).isNull()) == 0, F.sum(F.col(v) * F.col("_wx"))).alias(v) for v in values])
    wy = weight_table(spark, rows, "y", "_ty", "_wy")
    done = first.join(wy, "y").groupBy(*keys, "_ty", "_tx").agg(*[F.when(F.count_if(F.col(v).isNull()) == 0, F.sum(F.col(v) * F.col("_wy"))).alias(v) for v in values])
    return done.select(*keys, F.col("_ty").alias("y"), F.col("_tx").alias("x"), *values)


def degrade(df: DataFrame, high: tuple[int, int], low: tuple[int, int], sigma_x: float, sigma_y: float, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Sensor blur, then area reduction, as one linear map an axis."""

    def axis(k: int, sigma: float) -> np.ndarray | Weights:
        w = P.area_weights(high[k], low[k])
        return P.matrix(w, high[k]) @ P.blur_matrix(high[k], sigma) if sigma > 0 else w

    return separable(df, axis(0, sigma_y), axis(1, sigma_x), values, keys)


def block_mean(df: DataFrame, factor: int, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Area reduction by a whole factor: the mean of each block's pixels, of those that there are where the plane ends within it."""
    keys = keys or []
    at = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return df.select(*keys, *at, *values).groupBy(*keys, "y", "x").agg(*[F.avg(v).alias(v) for v in values])


def upsample(df: DataFrame, low: tuple[int, int], high: tuple[int, int], values: list[str], keys: list[str] | None = None) -> DataFrame:
    return separable(df, P.bicubic_weights(low[0], high[0]), P.bicubic_weights(low[1], high[1]), values, keys)


def nullspace(df: DataFrame, high: tuple[int, int], low: tuple[int, int], sigma_x: float, sigma_y: float, value: str, keys: list[str] | None = None) -> DataFrame:
    """The part of a plane that the sensor doesn't see: v - U(D v)."""
    keys = keys or []
    seen = upsample(degrade(df, high, low, sigma_x, sigma_y, [value], keys), low, high, [value], keys).withColumnRenamed(value, "_seen")
    return df.join(seen, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col(value) - F.col("_seen")).alias(value))


def warp(targets: DataFrame, plane: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """targets (keys, y, x, sy, sx) with each value read bilinearly at (sy, sx); null unless all pixels that weigh in are known."""
    keys = keys or []
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")

    def corner(dy: int, dx: int) -> Column:
        w = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
        return F.struct((F.floor("sy") + dy).cast("int").alias("py"), (F.floor("sx") + dx).cast("int").alias("px"), w.alias("w"))

    cut = targets.select(*keys, "y", "x", F.explode(F.filter(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]), lambda c: c["w"] > 1e-12)).alias("c")).select(*keys, "y", "x", "c.*")
    src = plane.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), *values)
    met = cut.join(src, [*keys, "py", "px"], "left")
    got = met.groupBy(*keys, "y", "x").agg(*[F.struct(F.sum(F.when(F.col(v).isNotNull(), F.col("w"))).alias("s"), F.sum(F.col("w") * F.col(v)).alias("v")).alias(v) for v in values])
    return got.select(*keys, "y", "x", *[F.when(F.col(f"{v}.s") >= 1 - 1e-6, F.col(f"{v}.v") / F.col(f"{v}.s")).alias(v) for v in values])


def affine_coordinates(df: DataFrame, m: np.ndarray) -> DataFrame:
    """df with sy, sx: where the affine map m (2 x 3, in x, y) sends each pixel."""
    x, y = F.col("x"), F.col("y")
    return df.withColumn("sx", m[0][0] * x + m[0][1] * y + m[0][2]).withColumn("sy", m[1][0] * x + m[1][1] * y + m[1][2])


def piecewise(x: Column, knots: list[float], values: list[float]) -> Column:
    """Piecewise linear interpolation, constant beyond the ends."""
    out = F.when(x <= knots[0], F.lit(float(values[0])))
    for k in range(len(knots) - 1):
        a, b, va, vb = knots[k], knots[k + 1], values[k], values[k + 1]
        out = out.when(x <= b, va + (x - a) * ((vb - va) / (b - a)))
    return out.otherwise(float(values[-1]))
