"""Operators that need a whole plane at once: one task a scene, with the size of a scene checked first."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels that a scene may have (float64 planes of 128 MB each); larger scenes are cut into regions first.
MOST_PIXELS = 1 << 24


def fill_missing(a: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A plane or stack whose unknown pixels take the mean of their known neighbours (four), ring by ring from the known ones.

    So a kernel that mixes a whole plane meets no gap, and what the scene lacks is continued as its border is.
    """
    a, known = np.where(known if a.ndim == 2 else known[..., None], a, 0.0), known.copy()
    while known.any() and not known.all():
        p, k = np.pad(a, [(1, 1), (1, 1)] + [(0, 0)] * (a.ndim - 2)), np.pad(known, 1)
        n = sum(k[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]].astype(int) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))
        t = sum(p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))
        ring = (n > 0) & ~known
        a[ring] = t[ring] / (n[ring] if a.ndim == 2 else n[ring][:, None])
        known |= ring
    return a


def per_scene(df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], values: list[str], outputs: list[str], scene: str = "scene") -> DataFrame:
    """scene, y, x and the outputs of a kernel over whole planes; outputs may have another shape than the inputs.

    Array columns become stacks (y, x, k). Pixels that a scene lacks (its last row may be short) or whose values aren't all
    finite are filled for the kernel (``fill_missing``); outputs of the inputs' shape have no row where a pixel is lacking.
    Scenes run in parallel; one larger than ``MOST_PIXELS`` is an error.
    """
    top = df.groupBy(scene).count().agg(F.max("count")).first()[0]
    if top is not None and top > MOST_PIXELS:
        raise ValueError(f"a scene of {top} pixels is over the bound of {MOST_PIXELS}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        iy, ix = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        planes, there = {}, np.zeros((h, w), bool)
        there[iy, ix] = True
        for v in values:
            first = pdf[v].iloc[0]
            if isinstance(first, (list, tuple, np.ndarray)):
                a = np.full((h, w, len(first)), np.nan)
                a[iy, ix] = np.array(pdf[v].tolist(), dtype=float)
            else:
                a = np.full((h, w), np.nan)
                a[iy, ix] = pdf[v].to_numpy(dtype=float)
            known = np.isfinite(a) if a.ndim == 2 else np.isfinite(a).all(-1)
            planes[v] = a if known.all() else fill_missing(a, known)
        out = kernel(planes)
        oh, ow = out[outputs[0]].shape[:2]
        keep = there if (oh, ow) == (h, w) else np.ones((oh, ow), bool)
        yy, xx = (g.astype(np.int32) for g in np.nonzero(keep))
        return pd.DataFrame({scene: pdf[scene].iloc[0], "y": yy, "x": xx} | {o: out[o][keep] for o in outputs})

    kind = df.schema[scene].dataType.simpleString()
    return df.select(scene, "y", "x", *values).groupBy(scene).applyInPandas(run, f"{scene} {kind}, y int, x int, " + ", ".join(f"{o} double" for o in outputs))
