"""Registration uncertainty: interpolation and local covariance from tie points, and sigma points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tie points of one scene up to which they are sent to every task (9 doubles each).
MOST_POINTS = 100_000


@dataclass(frozen=True)
class Settings:
    #: The defaults of a published registration uncertainty proxy.
    neighbours: int = 12
    bandwidth: float = 36.0
    floor: float = 0.04
    score_penalty: float = 0.35
    margin_reference: float = 0.02
    margin_penalty: float = 0.25
    backward_weight: float = 0.5
    per_bandwidth: float = 0.25
    most_inflation: float = 2.0

    def __post_init__(self):
        if self.neighbours < 1 or min(self.bandwidth, self.margin_reference) <= 0:
            raise ValueError("neighbours, bandwidth and margin_reference must be positive")
        if min(self.floor, self.score_penalty, self.margin_penalty, self.backward_weight, self.per_bandwidth, self.most_inflation) < 0:
            raise ValueError("uncertainty settings must not be negative")


def quality_variance(score: Column, margin: Column, backward: Column, s: Settings) -> Column:
    """Squared pixels that low score, low margin and backward error stand for."""
    lost = 1 - F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
    vague = 1 / (1 + F.greatest(margin, F.lit(0.0)) / s.margin_reference)
    return (s.score_penalty * lost) ** 2 + s.margin_penalty**2 * vague + (s.backward_weight * backward) ** 2


class Near:
    """Points in square cells, so that a query looks at the cells around it only."""

    def __init__(self, pid: np.ndarray, y: np.ndarray, x: np.ndarray, per_cell: int = 8):
        span = max(float(np.ptp(y)), float(np.ptp(x)), 1e-9)
        self.side = span / max(1.0, np.sqrt(len(pid) / per_cell))
        self.y0, self.x0 = float(y.min()), float(x.min())
        cell = np.stack([(y - self.y0) // self.side, (x - self.x0) // self.side]).astype(np.int64)
        self.rows, self.cols = (int(c.max()) + 1 for c in cell)
        order = np.lexsort((pid, cell[0] * self.cols + cell[1]))
        self.pid, self.y, self.x, at = pid[order], y[order], x[order], (cell[0] * self.cols + cell[1])[order]
        self.first = np.searchsorted(at, np.arange(self.rows * self.cols + 1))

    def _around(self, cy: int, cx: int, ring: int) -> np.ndarray:
        """Places of the points in the cells within so many rings."""
        lo, hi = max(0, cx - ring), min(self.cols - 1, cx + ring)
        parts = [np.arange(self.first[r * self.cols + lo], self.first[r * self.cols + hi + 1]) for r in range(max(0, cy - ring), min(self.rows - 1, cy + ring) + 1) if lo <= hi]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def nearest(self, qy: np.ndarray, qx: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each query the ids and squared distances of its k nearest points; equal distances go to the lesser id."""
        ids, far = [np.zeros(0, np.int64)] * len(qy), [np.zeros(0)] * len(qy)
        cell = np.stack([(qy - self.y0) // self.side, (qx - self.x0) // self.side]).astype(np.int64)
        which = np.unique(cell, axis=1, return_inverse=True)[1].ravel()
        for todo in np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1]) if len(qy) else ():
            cy, cx = (int(c) for c in cell[:, todo[0]])
            # the first ring that can reach a cell with points, for queries outside all of them
            ring = max(1, -cy, cy - self.rows + 1, -cx, cx - self.cols + 1)
            while len(todo):
                at = self._around(cy, cx, ring)
                whole = cy - ring <= 0 and cx - ring <= 0 and cy + ring >= self.rows - 1 and cx + ring >= self.cols - 1
                d2 = (qy[todo, None] - self.y[at]) ** 2 + (qx[todo, None] - self.x[at]) ** 2
                done = np.full(len(todo), whole)
                if len(at) >= k:
                    # a point outside these cells is farther than the distance to their edge
                    gap = np.min([qy[todo] - self.y0 - (cy - ring) * self.side, self.y0 + (cy + ring + 1) * self.side - qy[todo], qx[todo] - self.x0 - (cx - ring) * self.side, self.x0 + (cx + ring + 1) * self.side - qx[todo]], 0)
                    done |= np.partition(d2, k - 1, 1)[:, k - 1] < np.maximum(gap, 0) ** 2 * (1 - 1e-9) - 1e-9
                for j in np.flatnonzero(done):
                    pick = np.lexsort((self.pid[at], np.round(d2[j], 9)))[:k]
                    ids[todo[j]], far[todo[j]] = self.pid[at[pick]], d2[j][pick]
                todo, ring = todo[~done], ring * 2
        return ids, far


def _nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Each query with its k nearest points. Points are few by nature and their number is checked, so they are broadcast, in cells."""
    n = points.count()
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} tie points in one scene")
    if n == 0:
        raise ValueError("no tie points")
    p = points.select("pid", F.col("ref_y").cast("double"), F.col("ref_x").cast("double")).toPandas()
    index = queries.sparkSession.sparkContext.broadcast(Near(p["pid"].to_numpy(np.int64), p["ref_y"].to_numpy(float), p["ref_x"].to_numpy(float)))

    @F.arrow_udf("array<struct<pid:long,d2:double>>")
    def near(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("pid", pa.int64()), ("d2", pa.float64())]))
        for y, x in it:
            ids, far = index.value.nearest(y.to_numpy(zero_copy_only=False).astype(float), x.to_numpy(zero_copy_only=False).astype(float), k)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([*ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*far, np.zeros(0)]))], names=["pid", "d2"])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)), flat).cast(kind)

    met = queries.withColumn("_near", F.explode(near("qy", "qx"))).select("*", "_near.d2", F.col("_near.pid").alias("_pid")).drop("_near")
    return met.join(F.broadcast(points), F.col("_pid") == F.col("pid")).drop("_pid")


def idw(queries: DataFrame, points: DataFrame, value: str, k: int = 10, soften: float = 18.0) -> DataFrame:
    """qid and the value interpolated from the k nearest points, weights max(.05, score - .2)^2 / (d^2 + soften)."""
    w = F.greatest(F.lit(0.05), F.col("score") - 0.2) ** 2 / (F.col("d2") + soften)
    return _nearest(queries, points, k).withColumn("w", w).groupBy("qid").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def local_covariance(queries: DataFrame, points: DataFrame, s: Settings | None = None) -> DataFrame:
    """qid, covariance (yy, yx, xx), nearest distance and effective number of points.

    points: pid, ref_y, ref_x, res_y, res_x (residual against the final warp), score, margin, backward_error.
    The covariance is the weighted second moment of the residuals plus isotropic terms, so it is at least the floor.
    """
    s = s or Settings()
    q = quality_variance(F.col("score"), F.col("margin"), F.col("backward_error"), s)
    near = _nearest(queries, points.withColumn("qv", q), s.neighbours)
    first = F.min("d2").over(Window.partitionBy("qid"))
    near = near.withColumn("d0", first).withColumn("w", F.exp(-0.5 * (F.col("d2") - F.col("d0")) / s.bandwidth**2) / (s.floor + F.col("qv")))
    m = near.groupBy("qid").agg(
        F.sum("w").alias("sw"), F.sum(F.expr("w * w")).alias("sww"), F.sum(F.expr("w * res_y * res_y")).alias("yy"), F.sum(F.expr("w * res_y * res_x")).alias("yx"), F.sum(F.expr("w * res_x * res_x")).alias("xx"), F.sum(F.expr("w * qv")).alias("qv"), F.sqrt(F.min("d2")).alias("nearest"),
    )
    far = F.least(F.lit(s.most_inflation), s.per_bandwidth * F.col("nearest") / s.bandwidth)
    iso = s.floor + F.col("qv") / F.col("sw") + far * far
    return m.select("qid", (F.col("yy") / F.col("sw") + iso).alias("cov_yy"), (F.col("yx") / F.col("sw")).alias("cov_yx"), (F.col("xx") / F.col("sw") + iso).alias("cov_xx"), "nearest", (F.col("sw") * F.col("sw") / F.col("sww")).alias("effective"))


def sigma_points(my: Column, mx: Column, yy: Column, yx: Column, xx: Column, centre: float = 1 / 3) -> Column:
    """Five points (ordinal, y, x, weight) with the mean and covariance given: the mean, then both ways along each axis.

    The axes are the eigenvectors of the covariance in closed form, the smaller eigenvalue first.
    """
    half, diff = (yy + xx) / 2, (yy - xx) / 2
    root = F.sqrt(diff * diff + yx * yx)
    lo, hi = F.greatest(half - root, F.lit(0.0)), half + root
    # eigenvector of hi: (yx, hi - yy) or an axis where yx vanishes
    flat = F.abs(yx) < 1e-15
    vy = F.when(flat, F.when(yy >= xx, 1.0).otherwise(0.0)).otherwise(yx)
    vx = F.when(flat, F.when(yy >= xx, 0.0).otherwise(1.0)).otherwise(hi - yy)
    size = F.sqrt(vy * vy + vx * vx)
    uy, ux = vy / size, vx / size
    k = (2 / (1 - centre)) ** 0.5
    w = (1 - centre) / 4

    def p(n: int, dy: Column, dx: Column, weight: float) -> Column:
        return F.struct(F.lit(n).alias("ordinal"), (my + dy).alias("y"), (mx + dx).alias("x"), F.lit(weight).alias("weight"))

    a, b = k * F.sqrt(lo), k * F.sqrt(hi)
    return F.array(p(0, F.lit(0.0), F.lit(0.0), centre), p(1, -a * ux, a * uy, w), p(2, a * ux, -a * uy, w), p(3, b * uy, b * ux, w), p(4, -b * uy, -b * ux, w))
