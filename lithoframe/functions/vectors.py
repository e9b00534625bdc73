"""Array expressions over spectra: one row holds a whole spectrum, so no operator explodes bands that it needn't."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_vector(v) -> Column:
    """A literal array<double> that Catalyst folds into one constant."""
    return F.array(*[F.lit(float(x)) for x in v])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row. Inside a lambda an expression is computed for every element, so what a
    lambda needs of the whole array is bound by this first."""
    return F.get(F.transform(F.array(value), body), 0)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle between spectra in degrees over their common bands; null with fewer than max(3, B/2) of them or a vanishing norm."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def step(t: Column, s: Column) -> Column:
        x, y = s["x"], s["y"]
        more = F.struct((t["n"] + 1).alias("n"), (t["xy"] + x * y).alias("xy"), (t["xx"] + x * x).alias("xx"), (t["yy"] + y * y).alias("yy"))
        return F.when(x.isNotNull() & y.isNotNull(), more).otherwise(t)

    def angle(t: Column) -> Column:
        d = F.sqrt(t["xx"]) * F.sqrt(t["yy"])
        ok = (t["n"] >= F.greatest(F.lit(3), F.floor(F.size(a) / 2).cast("int"))) & (d > 1e-10)
        return F.when(ok, F.degrees(F.acos(F.greatest(F.least(t["xy"] / F.when(d > 1e-10, d).otherwise(1.0), F.lit(1.0)), F.lit(-1.0)))))

    return F.aggregate(pairs, zero, step, angle)


def square_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))


def combine(coef: Column, matrix: np.ndarray, offset: np.ndarray | None = None) -> Column:
    """coef (K) times a constant matrix (K, B), plus a constant offset (B)."""
    columns = F.array(*[F.struct(lit_vector(matrix[:, b]).alias("m"), F.lit(float(offset[b]) if offset is not None else 0.0).alias("o")) for b in range(matrix.shape[1])])
    return let(coef, lambda c: F.transform(columns, lambda k: dot(c, k["m"]) + k["o"]))


def simplex(v: Column) -> Column:
    """Euclidean projection onto the probability simplex."""
    s = F.reverse(F.array_sort(v))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("theta"))

    def step(t, x):
        n, c = t["n"] + 1, t["sum"] + x
        theta = (c - 1.0) / n
        return F.struct(n.alias("n"), c.alias("sum"), F.when((x - theta > 0) | (n == 1), theta).otherwise(t["theta"]).alias("theta"))

    raw = let(F.aggregate(s, start, step, lambda t: t["theta"]), lambda theta: F.transform(v, lambda x: F.greatest(x - theta, F.lit(0.0))))
    return let(raw, lambda r: let(F.greatest(total(r), F.lit(1e-15)), lambda t: F.transform(r, lambda x: x / t)))


def cone(candidate: Column, reference: Column, angle_deg: float) -> Column:
    """Candidate with its part orthogonal to the reference scaled back to at most the angle; the reference itself where that is zero.

    A candidate that points away from its reference is an error. Inside the cone the candidate is returned as it is.
    """
    if not 0 <= angle_deg < 90:
        raise ValueError("the angle must lie in [0, 90)")
    slope = math.tan(math.radians(angle_deg))

    def around(k: Column) -> Column:
        """k: rr and al, the reference's square and the candidate's share along it."""
        side = F.zip_with(candidate, reference, lambda c, r: c - k["al"] * r)

        def pull(q: Column) -> Column:
            """q: the orthogonal part, its size, and the size that the cone allows."""
            pulled = F.zip_with(q["side"], reference, lambda s, r: k["al"] * r + s * (q["limit"] / F.when(q["size"] > 0, q["size"]).otherwise(1.0)))
            return F.when(q["size"] <= q["limit"], candidate).otherwise(pulled)

        sized = let(side, lambda s: let(F.struct(s.alias("side"), norm(s).alias("size"), (slope * k["al"] * F.sqrt(k["rr"])).alias("limit")), pull))
        return F.when(k["rr"] <= 0, reference).when(k["al"] < 0, F.raise_error(F.lit("negative projection on the reference")).cast("array<double>")).otherwise(sized)

    rr = dot(reference, reference)
    return let(rr, lambda q: let(F.struct(q.alias("rr"), (dot(candidate, reference) / F.when(q > 0, q).otherwise(1.0)).alias("al")), around))


def top_components(v: Column, k: int) -> Column:
    """The k largest entries as (value, component), the lesser component first on ties."""
    pairs = F.transform(v, lambda x, n: F.struct((-x).alias("value"), n.alias("component")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["value"]).alias("value"), p["component"].alias("component")))


def interpolation_stencil(source: np.ndarray, target: np.ndarray) -> list[tuple[int, float] | None]:
    """For each target, the knot at its left and the weight of the next one; None outside the source axis."""
    source, out = np.asarray(source, float), []
    for t in np.asarray(target, float):
        if not source[0] <= t <= source[-1]:
            out.append(None)
            continue
        k = min(int(np.searchsorted(source, t, side="right")) - 1, len(source) - 2)
        out.append((k, float((t - source[k]) / (source[k + 1] - source[k]))))
    return out


def interpolate(v: Column, source: np.ndarray, target: np.ndarray) -> Column:
    """Linear interpolation of a spectrum onto another axis; null outside. Two reads a target, whatever the axis lengths."""
    stencil = interpolation_stencil(source, target)
    left = F.array(*[F.lit(None if s is None else s[0]).cast("int") for s in stencil])
    weight = F.array(*[F.lit(None if s is None else s[1]).cast("double") for s in stencil])
    return F.zip_with(left, weight, lambda k, w: F.when(k.isNotNull(), F.get(v, k) * (1 - w) + F.get(v, k + 1) * w))


def nearest_index(axis: np.ndarray, wanted: float) -> int:
    """Index of the nearest wavelength, the first one on ties."""
    return int(np.argmin(np.abs(np.asarray(axis, float) - wanted)))


def smooth(v: Column, matrix: np.ndarray) -> Column:
    """A constant matrix (out, in) times a spectrum."""
    return F.array(*[dot(v, lit_vector(row)) for row in matrix])


def savgol_matrix(n: int, window: int, degree: int) -> np.ndarray:
    """Rows that fit a polynomial in each window; the end windows give the values at both ends."""
    half, m = window // 2, np.zeros((n, n))
    for k in range(n):
        first = min(max(k - half, 0), n - window)
        t = np.arange(first, first + window) - k
        fit = np.linalg.pinv(np.vander(t.astype(float), degree + 1, increasing=True))
        m[k, first : first + window] = fit[0]
    return m
