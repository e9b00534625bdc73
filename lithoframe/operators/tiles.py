"""Stencils over planes of any size: pixels are dealt into square tiles with a halo, one shuffle whatever the kernel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def shapes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Height and width of each plane."""
    return df.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("_h"), (F.max("x") + 1).cast("int").alias("_w"))


def stencil(df: DataFrame, kernel: Kernel, values: list[str], outputs: list[str], halo: int, keys: list[str] | None = None, shape: tuple[int, int] | None = None, tile: int = 256) -> DataFrame:
    """keys, y, x and the outputs of a kernel over padded arrays, for the pixels that there are.

    The kernel gets each value column as an array that reaches ``halo`` pixels beyond its tile, mirrored at the border
    of the plane (the edge pixel isn't repeated), NaN where a pixel is missing, and gives arrays of the same size. A task
    holds (tile + 2 halo)^2 pixels at a time; a pixel is sent to at most four tiles.
    """
    keys = keys or []
    tile = max(tile, halo)
    if shape is None:
        sized = shapes(df, keys)
        sized = df.join(sized, keys) if keys else df.crossJoin(F.broadcast(sized))  # without keys the sizes are one row
    else:
        sized = df.withColumn("_h", F.lit(shape[0])).withColumn("_w", F.lit(shape[1]))

    def tiles(c: str, n: str):
        lo = F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile).cast("int"))
        hi = F.least(F.floor((F.col(c) + halo) / tile).cast("int"), F.floor((F.col(n) - 1) / tile).cast("int"))
        return F.explode(F.sequence(lo, hi))

    cast = [F.col(v).cast("double").alias(v) for v in values]
    dealt = sized.select(*keys, "y", "x", "_h", "_w", *cast).withColumn("_ty", tiles("y", "_h")).withColumn("_tx", tiles("x", "_w"))
    names = [*keys, "y", "x", *outputs]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, ty, tx = (int(pdf[c].iloc[0]) for c in ("_h", "_w", "_ty", "_tx"))
        y0, x0, y1, x1 = ty * tile, tx * tile, min(h, ty * tile + tile), min(w, tx * tile + tile)
        top, left, bottom, right = max(0, y0 - halo), max(0, x0 - halo), min(h, y1 + halo), min(w, x1 + halo)
        iy, ix = pdf["y"].to_numpy() - top, pdf["x"].to_numpy() - left
        pad = ((halo - (y0 - top), halo - (bottom - y1)), (halo - (x0 - left), halo - (right - x1)))
        arrays = {}
        for v in values:
            a = np.full((bottom - top, right - left), np.nan)
            a[iy, ix] = pdf[v].to_numpy(dtype=float)
            arrays[v] = np.pad(a, pad, mode="reflect")
        out = kernel(arrays)
        there = np.zeros((bottom - top, right - left), bool)
        there[iy, ix] = True
        there = there[y0 - top : y1 - top, x0 - left : x1 - left]
        yy, xx = np.nonzero(there)
        got = pd.DataFrame({"y": (yy + y0).astype(np.int32), "x": (xx + x0).astype(np.int32)})
        for k in keys:
            got[k] = pdf[k].iloc[0]
        for o in outputs:
            got[o] = out[o][halo : halo + y1 - y0, halo : halo + x1 - x0][there]
        return got[names]

    fields = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["y int", "x int"] + [f"{o} double" for o in outputs]
    done = dealt.groupBy(*keys, "_ty", "_tx").applyInPandas(run, ", ".join(fields))
    return done.select(*keys, "y", "x", *[F.when(~F.isnan(o), F.col(o)).alias(o) for o in outputs])
