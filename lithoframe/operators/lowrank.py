"""Low-rank models of spectra: principal components, simplex mixtures, and both.

Rows are spectra (an array column without nulls). What reaches the driver is a Gram matrix or a K x B product, never
spectra; fits read every row. Gram matrices are summed by tasks over Arrow batches and added up in a tree.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions import vectors as V

#: Bands up to which Gram matrices are held on the driver (B^2 doubles: 128 MB).
MOST_BANDS = 4096


def _matrix(arr) -> np.ndarray:
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(arr), -1)


def _sum_products(df: DataFrame, products) -> np.ndarray:
    """The sum over all rows of products(batch matrix): one array a task, added up by position."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in it:
            if len(b):
                p = products([_matrix(b.column(k)) for k in range(b.num_columns)])
                out = p if out is None else out + p
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64())), pa.array([list(out.shape)], pa.list_(pa.int32()))], names=["s", "shape"])

    parts = df.mapInArrow(run, "s array<double>, shape array<int>")

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = shape = None
        for b in it:
            for s, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out, shape = (np.array(s) if out is None else out + np.array(s)), h
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64())), pa.array([shape], pa.list_(pa.int32()))], names=["s", "shape"])

    merged = parts.repartition(16).mapInArrow(add, "s array<double>, shape array<int>").collect()
    if not merged:
        raise ValueError("no spectra")
    return np.sum([np.array(r.s) for r in merged], 0).reshape(merged[0].shape)


@dataclass
class Subspace:
    mean: np.ndarray
    basis: np.ndarray
    explained: np.ndarray
    kind: str
    meta: dict = field(default_factory=dict)

    def to_json(self) -> str:
        """Arrays in full with a digest of each and of all of them in order of name."""
        arrays = {n: np.ascontiguousarray(getattr(self, n), "<f4") for n in ("basis", "explained", "mean")}
        each = {n: {"shape": list(a.shape), "dtype": "float32", "sha256": hashlib.sha256(a.tobytes()).hexdigest(), "values": a.tolist()} for n, a in arrays.items()}
        return json.dumps({"kind": self.kind, "meta": self.meta, "arrays": each, "digest": collection_digest(arrays)})

    @classmethod
    def from_json(cls, text: str) -> Subspace:
        """The model again; raises where an array doesn't have its shape or digest."""
        d = json.loads(text)
        arrays = {}
        for n, a in d["arrays"].items():
            arrays[n] = np.array(a["values"], "<f4").reshape(a["shape"])
            if hashlib.sha256(arrays[n].tobytes()).hexdigest() != a["sha256"]:
                raise ValueError(f"array {n} doesn't match its digest")
        if collection_digest(arrays) != d["digest"]:
            raise ValueError("the arrays don't match their common digest")
        if arrays["basis"].shape[1] != arrays["mean"].shape[0]:
            raise ValueError("basis and mean have different bands")
        return cls(arrays["mean"], arrays["basis"], arrays["explained"], d["kind"], d["meta"])


def collection_digest(arrays: dict[str, np.ndarray]) -> str:
    """SHA-256 over names, shapes and little-endian float32 bytes, in order of name."""
    h = hashlib.sha256(b"float32-arrays\x00")
    for n in sorted(arrays):
        a = np.ascontiguousarray(arrays[n], "<f4")
        h.update(n.encode() + b"\x00" + np.array(a.shape, "<i8").tobytes() + a.tobytes())
    return h.hexdigest()


def fit_pca(df: DataFrame, v: str, rank: int) -> Subspace:
    """Principal components from the exact Gram matrix; the largest loading of each is positive."""
    g = _sum_products(df.select(v), lambda m: (lambda x: x.T @ x)(np.hstack([np.ones((len(m[0]), 1)), m[0]])))
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    if len(mean) > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands")
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    val, vec = np.linalg.eigh(cov)
    k = min(rank, len(mean), max(1, int(n) - 1))
    basis = vec[:, ::-1][:, :k].T
    basis = basis * np.sign(basis[np.arange(k), np.abs(basis).argmax(1)])[:, None]
    return Subspace(mean, basis, np.maximum(val[::-1][:k], 0) / max(float(np.maximum(val, 0).sum()), 1e-15), "pca")


def coefficients(v: Column, model: Subspace) -> Column:
    """Coordinates of a spectrum in the model."""
    rows = F.array(*[V.lit_vector(b) for b in model.basis])
    return V.let(V.subtract(v, V.lit_vector(model.mean)), lambda c: F.transform(rows, lambda r: V.dot(c, r)))


def reconstruct(coef: Column, model: Subspace) -> Column:
    return V.combine(coef, model.basis, model.mean)


def farthest(df: DataFrame, v: str, key: str, k: int) -> np.ndarray:
    """k spectra, each the farthest from those before it; the first the farthest from the mean. Ties go to the smallest key."""
    n = df.select(F.size(v)).first()[0]
    mean = df.agg(F.array(*[F.avg(F.col(v)[b]) for b in range(n)]).alias("m")).first().m
    chosen: list[list[float]] = []
    for _ in range(k):
        if chosen:
            near = F.least(*[V.square_error(F.col(v), V.lit_vector(c)) for c in chosen]) if len(chosen) > 1 else V.square_error(F.col(v), V.lit_vector(chosen[0]))
        else:
            near = V.square_error(F.col(v), V.lit_vector(mean))
        chosen.append(df.agg(F.max_by(v, F.struct(F.round(near, 12), -F.col(key))).alias("c")).first().c)
    return np.maximum(np.array(chosen), 0.0)


def project_rows(m: np.ndarray) -> np.ndarray:
    """Rows projected onto the simplex."""
    s = -np.sort(-m, axis=1)
    c = (np.cumsum(s, axis=1) - 1) / np.arange(1, m.shape[1] + 1)
    k = np.maximum((s - c > 0).sum(1) - 1, 0)
    out = np.maximum(m - c[np.arange(len(m)), k][:, None], 0)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-15)


def abundances(x: np.ndarray, ends: np.ndarray, steps: int, ridge: float, start: np.ndarray | None = None) -> np.ndarray:
    """Simplex weights of rows by projected gradient from a ridge solution (or from given weights)."""
    g = ends @ ends.T
    a = project_rows(np.linalg.solve(g + max(ridge, 1e-12) * np.eye(len(g)), ends @ x.T).T if start is None else start)
    size = max(float(np.linalg.norm(g, 2)), 1e-12)
    for _ in range(steps):
        a = project_rows(a - (a @ ends - x) @ ends.T / size)
    return a


def with_abundances(df: DataFrame, v: str, out: str, ends: np.ndarray, steps: int = 40, ridge: float = 1e-8) -> DataFrame:
    """df with the simplex weights of each spectrum, computed on Arrow batches."""

    @F.arrow_udf("array<double>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            yield pa.array(abundances(_matrix(arr), ends, steps, ridge).tolist() if len(arr) else [], pa.list_(pa.float64()))

    return df.withColumn(out, run(F.col(v)))


def fit_simplex(df: DataFrame, v: str, key: str, rank: int, iterations: int = 30, steps: int = 40, ridge: float = 1e-8, tolerance: float = 1e-6) -> Subspace:
    """Non-negative endmembers and simplex weights by alternating least squares.

    Each round is one pass: tasks solve the weights of their rows and sum A'A, A'X and the residual; the driver updates
    K endmembers. Weights are solved afresh from the ridge start every round, so no row state is kept between rounds and
    a lost executor costs its tasks only.
    """
    low = df.agg(F.min(F.array_min(v))).first()[0]
    if low is None or low < -1e-7:
        raise ValueError(f"simplex factorisation needs non-negative spectra, least value {low}")
    ends = farthest(df, v, key, rank)
    history: list[float] = []
    for _ in range(iterations):
        e = ends

        def products(m, e=e):
            a = abundances(m[0], e, steps, ridge)
            top = np.hstack([a.T @ a, a.T @ m[0]])
            tail = np.zeros((1, top.shape[1]))
            tail[0, 0] = ((a @ e - m[0]) ** 2).sum()
            tail[0, 1] = (m[0] ** 2).sum()
            return np.vstack([top, tail])

        s = _sum_products(df.select(v), products)
        history.append(0.5 * s[-1, 0] + 0.5 * ridge * float((e * e).sum()))
        if len(history) > 5 and 0 <= (history[-2] - history[-1]) / max(abs(history[-2]), 1e-15) <= tolerance:
            break
        aa, ax = s[:-1, :rank] + max(ridge, 1e-12) * np.eye(rank), s[:-1, rank:]
        now = np.maximum(np.linalg.solve(aa, ax), 0)
        size = max(float(np.linalg.norm(aa, 2)), 1e-12)
        for _ in range(4):
            now = np.maximum(now - (aa @ now - ax) / size, 0)
        ends = now
    return Subspace(np.zeros(ends.shape[1]), ends, np.array([1 - s[-1, 0] / max(s[-1, 1], 1e-15)]), "simplex", {"history": history, "rounds": len(history)})


def fit_hybrid(df: DataFrame, v: str, key: str, rank: int, residual_rank: int, **settings) -> tuple[Subspace, Subspace]:
    """A simplex model and the principal components of what it leaves."""
    first = fit_simplex(df, v, key, rank, **settings)
    rest = with_abundances(df, v, "_a", first.basis).select(V.subtract(F.col(v), V.combine(F.col("_a"), first.basis)).alias(v))
    return first, fit_pca(rest, v, residual_rank)
