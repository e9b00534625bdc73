"""Spatially blocked identifiability tests from moments.

A plane is cut into blocks. The model of a block is trained on everything outside the block grown by a gap and scored on
the block shrunk by it. Both come from sums: training moments are those of the plane minus those of the grown block, and
squared errors expand into moments of the core. So every test is two grouped sums over the pixels, whatever the number of
blocks, features, bands, bootstrap replicates or shifts, and no model is refitted over pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the two published classifiers (identifiable, weakly identifiable).
CLASSIFIERS = {
    "bootstrap": {"r2": (0.15, 0.02), "rho": (0.45, 0.20), "p": (0.05, 0.20), "fraction": (0.20, 0.10), "stability": (0.75, 0.60)},
    "fold": {"rho": (0.50, 0.35), "r2": (0.20, 0.05), "fold_rho": (0.35, 0.20), "positive": (0.67, 0.56), "stability": (0.70, 0.45), "delta": (0.05, 0.01)},
}


def block_of(y: Column, x: Column, h: int, w: int, rows: int, cols: int) -> Column:
    """The block of a pixel, numbered by row."""
    r = F.least(F.floor(y * rows / h), F.lit(rows - 1))
    c = F.least(F.floor(x * cols / w), F.lit(cols - 1))
    return (r * cols + c).cast("int")


def edges(n: int, parts: int, k: int) -> tuple[int, int]:
    """First and last index of part k of n samples."""
    return -(-k * n // parts), -(-(k + 1) * n // parts) - 1


def rectangles(h: int, w: int, rows: int, cols: int, gap: int) -> list[tuple]:
    """Of each block: its number, the grown rectangle, the shrunk one."""
    out = []
    for r in range(rows):
        for c in range(cols):
            (y0, y1), (x0, x1) = edges(h, rows, r), edges(w, cols, c)
            out.append((r * cols + c, y0 - gap, y1 + gap, x0 - gap, x1 + gap, y0 + gap, y1 - gap, x0 + gap, x1 - gap))
    return out


def extents(df: DataFrame, h: int, w: int, rows: int, cols: int, gap: int) -> list[tuple]:
    """``rectangles`` of blocks as far as the plane's pixels reach: where its last row is short, a block may end before its share."""
    ends = df.select(block_of(F.col("y"), F.col("x"), h, w, rows, cols).alias("block"), "y", "x").groupBy("block").agg(F.min("y"), F.max("y"), F.min("x"), F.max("x"))
    # One row a block.
    return [(b, y0 - gap, y1 + gap, x0 - gap, x1 + gap, y0 + gap, y1 - gap, x0 + gap, x1 - gap) for b, y0, y1, x0, x1 in sorted(map(tuple, ends.collect()))]


def _sums(cols: list[Column]) -> list[Column]:
    return [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]


def blocked_moments(df: DataFrame, features: list[str], target: str, h: int, w: int, rows: int, cols: int, gap: int, keys: list[str] | None = None, rect: list[tuple] | None = None) -> DataFrame:
    """keys, block, and sums of products of (1, features, target) outside the grown block (a...) and in its core (b...).

    ``rect`` are the blocks' rectangles, by default those of a plane without gaps.
    """
    keys = keys or []
    ok = df.where(" and ".join(f"{c} is not null" for c in [*features, target]))
    one = [F.lit(1.0), *[F.col(f) for f in features], F.col(target)]
    rect = rectangles(h, w, rows, cols, gap) if rect is None else rect
    inside = lambda k, a: F.col("y").between(k[a], k[a + 1]) & F.col("x").between(k[a + 2], k[a + 3])
    near = F.filter(F.array(*[F.when(inside(k, 1), F.lit(k[0])) for k in rect]), lambda v: v.isNotNull())
    core = F.coalesce(*[F.when(inside(k, 5), F.lit(k[0])) for k in rect])
    names = [f"s{i}_{j}" for i in range(len(one)) for j in range(i, len(one))]
    total = ok.groupBy(*keys).agg(*_sums(one)) if keys else ok.agg(*_sums(one))
    grown = ok.withColumn("block", F.explode(near)).groupBy(*keys, "block").agg(*_sums(one))
    cores = ok.withColumn("block", core).where("block is not null").groupBy(*keys, "block").agg(*_sums(one))
    t = total.select(*keys, *[F.col(n).alias(f"t_{n}") for n in names])
    g = grown.select(*keys, "block", *[F.col(n).alias(f"g_{n}") for n in names])
    # Totals are one row a key, and all three tables have a row a block: small whatever the planes' size.
    met = g.join(t, keys) if keys else g.join(F.broadcast(t), F.lit(True))
    c = cores.select(*keys, "block", *[F.col(n).alias(f"b{n[1:]}") for n in names])
    return met.join(c, [*keys, "block"]).select(*keys, "block", *[(F.col(f"t_{n}") - F.col(f"g_{n}")).alias(f"a{n[1:]}") for n in names], *[f"b{n[1:]}" for n in names])


def blocked_cv(df: DataFrame, feature: str, target: str, h: int, w: int, rows: int, cols: int, gap: int, ridge: float = 0.03, keys: list[str] | None = None, least_train: int = 192, least_test: int = 24, rect: list[tuple] | None = None) -> DataFrame:
    """keys, block, slope, intercept, base (training mean), counts, and the core's sums for scoring: one standardised feature, in closed form."""
    keys = keys or []
    m = blocked_moments(df, [feature], target, h, w, rows, cols, gap, keys, rect)
    c = F.col
    n, mx, my = c("a0_0"), c("a0_1") / c("a0_0"), c("a0_2") / c("a0_0")
    vx, cov = c("a1_1") / n - mx * mx, c("a1_2") / n - mx * my
    slope = cov / (F.greatest(vx, F.lit(1e-16)) * (1 + ridge))
    kept = m.where((n >= least_train) & (c("b0_0") >= least_test))
    d = kept.select(*keys, "block", n.cast("long").alias("n_train"), c("b0_0").cast("long").alias("n_test"), slope.alias("slope"), (my - slope * mx).alias("intercept"), my.alias("base"), "b0_1", "b0_2", "b1_1", "b1_2", "b2_2", "b0_0")
    # squared errors of the model and of the training mean over the core
    sse = c("b2_2") - 2 * c("slope") * c("b1_2") - 2 * c("intercept") * c("b0_2") + c("slope") ** 2 * c("b1_1") + 2 * c("slope") * c("intercept") * c("b0_1") + c("intercept") ** 2 * c("b0_0")
    sst = c("b2_2") - 2 * c("base") * c("b0_2") + c("base") ** 2 * c("b0_0")
    p1, p2, py = c("slope") * c("b0_1") + c("intercept") * c("b0_0"), c("slope") ** 2 * c("b1_1") + 2 * c("slope") * c("intercept") * c("b0_1") + c("intercept") ** 2 * c("b0_0"), c("slope") * c("b1_2") + c("intercept") * c("b0_2")
    block_slope = (c("b1_2") - c("b0_1") * c("b0_2") / c("b0_0")) / F.nullif(c("b1_1") - c("b0_1") ** 2 / c("b0_0"), F.lit(0.0))
    return d.select(*keys, "block", "n_train", "n_test", "slope", "intercept", "base", sse.alias("sse"), sst.alias("sst"), p1.alias("sp"), p2.alias("spp"), py.alias("spy"), c("b0_2").alias("sy"), c("b2_2").alias("syy"), c("b0_1").alias("sx"), c("b1_1").alias("sxx"), c("b1_2").alias("sxy"), block_slope.alias("block_slope"))


def pooled(folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, predictive R2, correlation and RMSE over all cores together."""
    keys = keys or []
    s = folds.groupBy(*keys).agg(F.sum("n_test").alias("n"), *[F.sum(k).alias(k) for k in ("sse", "sst", "sp", "spp", "spy", "sy", "syy")])
    c = F.col
    cov = c("spy") / c("n") - c("sp") / c("n") * c("sy") / c("n")
    spread = F.sqrt(F.greatest(c("spp") / c("n") - (c("sp") / c("n")) ** 2, F.lit(0.0)) * F.greatest(c("syy") / c("n") - (c("sy") / c("n")) ** 2, F.lit(0.0)))
    return s.select(*keys, "n", F.when(c("sst") > 1e-12, 1 - c("sse") / F.nullif(c("sst"), F.lit(0.0))).alias("r2"), F.when(spread > 1e-12, cov / F.nullif(spread, F.lit(0.0))).alias("rho"), F.sqrt(F.greatest(c("sse"), F.lit(0.0)) / c("n")).alias("rmse"))


def amplitude(folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, support-weighted mean slope, its share of the target's spread, sign stability of training and held-out slopes."""
    keys = keys or []
    s = folds.groupBy(*keys).agg((F.sum(F.col("slope") * F.col("n_test")) / F.sum("n_test")).alias("estimate"), F.collect_list(F.struct("slope", "block_slope")).alias("all"), F.sum("n_test").alias("n"), *[F.sum(k).alias(k) for k in ("sx", "sxx", "sy", "syy")])
    sd = lambda a, b: F.sqrt(F.greatest(F.col(b) / F.col("n") - (F.col(a) / F.col("n")) ** 2, F.lit(0.0)))
    same = lambda f: F.aggregate("all", F.lit(0.0), lambda t, v: t + (F.signum(v[f]) == F.signum(F.col("estimate"))).cast("double")) / F.size("all")
    return s.select(*keys, "estimate", (F.abs("estimate") * sd("sx", "sxx") / F.nullif(sd("sy", "syy"), F.lit(0.0))).alias("fraction"), same("slope").alias("training_stability"), same("block_slope").alias("held_out_stability"))


def bootstrap(folds: DataFrame, replicates: int, keys: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """keys and percentile intervals of R2 and of the coherent slope over replicates that draw blocks with replacement.

    A block's multiplicity in a replicate is the number of draws that hit it, by a hash of (replicate, draw), so blocks
    are joined with multiplicities and pixels are never read again.
    """
    keys, spark = keys or [], folds.sparkSession
    blocks = folds.groupBy(*keys).agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    draws = spark.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    hit = blocks.join(F.broadcast(draws), F.lit(True)).select(*keys, "replicate", F.explode(F.transform(F.sequence(F.lit(1), F.size("blocks")), lambda k: F.get(F.col("blocks"), F.pmod(F.xxhash64("replicate", k), F.size("blocks")).cast("int")))).alias("block"))
    times = hit.groupBy(*keys, "replicate", "block").agg(F.count(F.lit(1)).alias("times"))
    m = folds.join(times, [*keys, "block"])
    s = m.groupBy(*keys, "replicate").agg(*[F.sum(F.col(k) * F.col("times")).alias(k) for k in ("sse", "sst", "sx", "sxx", "sy", "sxy", "n_test")])
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n_test")) / F.nullif(F.col("sxx") - F.col("sx") ** 2 / F.col("n_test"), F.lit(0.0))
    v = s.select(*keys, (1 - F.col("sse") / F.col("sst")).alias("r2"), slope.alias("slope"))
    q = [(1 - level) / 2, (1 + level) / 2]
    return v.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), F.percentile("r2", q).alias("r2_ci"), F.percentile("slope", q).alias("slope_ci"))


def shifts(h: int, w: int, gap: int, rows: int, cols: int, repeats: int, seed: int) -> list[tuple[int, int, int]]:
    """Distinct circular shifts of at least a gap and half a block along some axis."""
    rng, least = np.random.default_rng(seed), max(1, gap + 1, min(max(1, h // rows), max(1, w // cols)) // 2)
    out: list[tuple[int, int]] = []
    for _ in range(max(1000, repeats * 100)):
        dy, dx = int(rng.integers(0, h)), int(rng.integers(0, w))
        if max(min(dy, h - dy), min(dx, w - dx)) >= least and (dy, dx) not in out:
            out.append((dy, dx))
        if len(out) == repeats:
            break
    return [(k, dy, dx) for k, (dy, dx) in enumerate(out)]


def shift_null(df: DataFrame, feature: str, target: str, h: int, w: int, rows: int, cols: int, gap: int, moves: list[tuple[int, int, int]], observed: float, **settings) -> DataFrame:
    """shift, R2 and whether it reaches the observed one: the feature moved around the torus against the target in place."""
    spark = df.sparkSession
    m = F.broadcast(spark.createDataFrame(moves, "shift int, dy int, dx int"))  # one row a shift
    f = df.select("y", "x", F.col(feature).alias("_f")).join(m, F.lit(True)).select("shift", F.pmod(F.col("y") + F.col("dy"), F.lit(h)).alias("y"), F.pmod(F.col("x") + F.col("dx"), F.lit(w)).alias("x"), "_f")
    t = df.select("y", "x", F.col(target).alias("_t"))
    got = pooled(blocked_cv(f.join(t, ["y", "x"]), "_f", "_t", h, w, rows, cols, gap, keys=["shift"], **settings), ["shift"])
    return got.select("shift", "r2", (F.col("r2") >= observed).alias("reaches"))


def status(metrics: dict[str, Column], kind: str = "bootstrap", ci_excludes_zero: Column | None = None) -> Column:
    """identifiable, weakly_identifiable or unidentifiable by the thresholds of a classifier; "p" must not exceed, all others must reach."""
    t = CLASSIFIERS[kind]

    def passed(k: int) -> Column:
        out = F.lit(True)
        for name, limits in t.items():
            v = F.abs(metrics[name]) if name == "rho" else metrics[name]
            out = out & F.coalesce(v <= limits[k] if name == "p" else v >= limits[k], F.lit(False))
        return out

    strong = passed(0) if ci_excludes_zero is None else passed(0) & ci_excludes_zero
    return F.when(strong, "identifiable").when(passed(1), "weakly_identifiable").otherwise("unidentifiable")


def band_report(df: DataFrame, key: str, wanted: list, feature: str, target: str, h: int, w: int, rows: int, cols: int, gap: int, moves: list[tuple[int, int, int]] | None = None, kind: str = "bootstrap", **settings) -> DataFrame:
    """One row for each wanted band, fail-closed: key, n, r2, rho, rmse, estimate, fraction, training_stability, held_out_stability, p, status, reason.

    ``df`` has key, y, x, feature, target. A band without rows, without a scored block, or with statistics that aren't
    finite is ``unidentifiable``, and its reason says so. With ``moves`` p is the share of shifted features that reach
    the band's R2, of all bands in one pass; without, p is 0.
    """
    folds = blocked_cv(df, feature, target, h, w, rows, cols, gap, keys=[key], **settings)
    met = pooled(folds, [key]).join(amplitude(folds, [key]), key)
    seen = df.groupBy(key).agg(F.count(F.col(feature) * F.col(target)).alias("support"))
    if moves:
        m = F.broadcast(df.sparkSession.createDataFrame(moves, "shift int, dy int, dx int"))  # one row a shift
        f = df.select(key, "y", "x", F.col(feature).alias("_f")).join(m, F.lit(True)).select(key, "shift", F.pmod(F.col("y") + F.col("dy"), F.lit(h)).alias("y"), F.pmod(F.col("x") + F.col("dx"), F.lit(w)).alias("x"), "_f")
        null = pooled(blocked_cv(f.join(df.select(key, "y", "x", F.col(target).alias("_t")), [key, "y", "x"]), "_f", "_t", h, w, rows, cols, gap, keys=[key, "shift"], **settings), [key, "shift"])
        reach = null.join(met.select(key, F.col("r2").alias("_o")), key).groupBy(key).agg(((1 + F.count_if(F.col("r2") >= F.col("_o"))) / (1 + F.count(F.lit(1)))).alias("p"))
        met = met.join(reach, key, "left")
    else:
        met = met.withColumn("p", F.lit(0.0))
    bands = df.sparkSession.createDataFrame([(b,) for b in wanted], f"{key} {df.schema[key].dataType.simpleString()}")
    names = ("r2", "rho", "rmse", "estimate", "fraction", "training_stability", "held_out_stability", "p")
    j = bands.join(seen, key, "left").join(met, key, "left")
    sound = F.lit(True)
    for n in names:
        sound = sound & F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))
    metrics = {k: F.col(k) for k in ("r2", "rho", "fraction", "p")} | {"stability": F.least("training_stability", "held_out_stability")}
    metrics = {k: metrics[k] for k in CLASSIFIERS[kind] if k in metrics}
    reason = F.when(F.col("support").isNull() | (F.col("support") == 0), "no_rows").when(F.col("n").isNull(), "insufficient_support").when(~sound, "not_finite").otherwise("")
    told = F.when(reason != "", "unidentifiable").otherwise(status(metrics, kind))
    return j.select(key, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"), *names, told.alias("status"), reason.alias("reason"))


def blocked_ridge(df: DataFrame, features: list[str], target: str, h: int, w: int, rows: int, cols: int, gap: int, alphas: list[float], keys: list[str] | None = None, rect: list[tuple] | None = None) -> DataFrame:
    """keys, block, alpha, counts, sse, sst of standardised ridge on several features. Only moments (one row a block) reach Python."""
    keys = keys or []
    p = len(features)
    m = blocked_moments(df, features, target, h, w, rows, cols, gap, keys, rect)

    def run(it):
        for pdf in it:
            out = []
            for _, r in pdf.iterrows():
                a, b = np.zeros((p + 2, p + 2)), np.zeros((p + 2, p + 2))
                for i in range(p + 2):
                    for j in range(i, p + 2):
                        a[i, j] = a[j, i] = r[f"a{i}_{j}"]
                        b[i, j] = b[j, i] = r[f"b{i}_{j}"]
                n, mean = a[0, 0], a[0] / a[0, 0]
                cov = a / n - np.outer(mean, mean)
                sd = np.maximum(np.sqrt(np.maximum(np.diag(cov)[1 : p + 1], 0)), 1e-8)
                z, q = cov[1 : p + 1, 1 : p + 1] / np.outer(sd, sd), cov[1 : p + 1, p + 1] / sd
                for alpha in alphas:
                    beta = np.linalg.solve(z + max(alpha, 1e-12) * np.eye(p), q) / sd
                    v = np.concatenate([[mean[p + 1] - mean[1 : p + 1] @ beta], beta, [-1.0]])
                    u = np.zeros(p + 2)
                    u[0], u[-1] = mean[p + 1], -1.0
                    out.append([*[r[k] for k in keys], int(r["block"]), alpha, int(round(n)), int(round(b[0, 0])), float(v @ b @ v), float(u @ b @ u)])
            yield pd.DataFrame(out, columns=[*keys, "block", "alpha", "n_train", "n_test", "sse", "sst"])

    head = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return m.mapInPandas(run, head + "block int, alpha double, n_train long, n_test long, sse double, sst double")
