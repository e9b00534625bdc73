"""Quantiles of larger input: exact for any spread of values, bounded by all groups and columns together, and not planned ever longer."""

import glob
import time

import numpy as np
from pyspark.sql import functions as F

from lithoframe.operators import quantiles as Q
from lithoframe.plans import statistics
from lithoframe.session import cut, shared_dir

PROBS = [0.0, 0.003, 0.25, 0.5, 0.9, 1.0]


def test_groups_count_together(spark):
    """Groups that are small each fill a reducer together."""
    df = spark.range(2000).select((F.col("id") % 4).alias("g"), (F.col("id") * 7919 % 2003).cast("double").alias("x"))
    got = Q.quantiles(df, ["g"], {"x": F.col("x")}, PROBS, most=1000)
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {g: np.quantile([k * 7919 % 2003 for k in range(2000) if k % 4 == g], PROBS) for g in range(4)}
    assert all(np.allclose(r.x, want[r.g]) for r in got.collect()) and got.count() == 4


def test_any_spread(spark, monkeypatch):
    """Values over 600 powers of ten, infinities, ties, a null group and a group of one value."""
    rng = np.random.default_rng(2)
    wide = [float(s * 10.0**e) for s, e in zip(rng.choice([-1, 1], 900), rng.uniform(-300, 300, 900))]
    groups = {"wide": wide, "ends": [float("-inf")] * 3 + [1.0, 2.0, 2.0, 2.0, 3.0] * 40 + [float("inf")] * 2, None: [float(v) for v in rng.standard_normal(300)], "one": [4.0] * 50}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    monkeypatch.setattr(Q, "FEW", 20)
    got = {r.g: r.x for r in Q.quantiles(df, ["g"], {"x": F.col("x")}, [0.25, 0.5, 0.9], most=1, accuracy=16).collect()}
    assert got.keys() == groups.keys() and all(np.allclose(got[g], np.quantile(v, [0.25, 0.5, 0.9]), rtol=1e-12, atol=0) for g, v in groups.items())


def test_cut_forgets_constraints(spark):
    df = spark.range(10).where("id > 3").select("id", (F.col("id") * 2).alias("b")).where("b < 9")
    done = cut(df)
    assert done._jdf.queryExecution().analyzed().constraints().size() == 0 and sorted(map(tuple, done.collect())) == [(4, 8)]
    assert done.schema.simpleString() == df.schema.simpleString()


def test_robust_fit_of_larger_input(spark, monkeypatch):
    """The same fit by either form of quantiles, in a time that doesn't grow with the passes before, and no table is left."""
    rng = np.random.default_rng(3)
    x = rng.random(3000)
    y = np.where(rng.random(3000) < 0.1, 3 * rng.random(3000), 1.3 * x + 0.1 + 0.01 * rng.standard_normal(3000))
    df = spark.createDataFrame([(int(k % 3), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")
    plain = {r.g: r for r in statistics.irls_affine(df, ["g"], "x", "y").collect()}
    small_only = Q.quantiles.__defaults__
    monkeypatch.setattr(Q.quantiles, "__defaults__", (10, *small_only[1:]))
    began = time.time()
    got = {r.g: r for r in statistics.irls_affine(df, ["g"], "x", "y").collect()}
    assert time.time() - began < 240
    assert all(np.isclose(got[g].gain, plain[g].gain) and np.isclose(got[g].offset, plain[g].offset) and abs(got[g].gain - 1.3) < 0.05 for g in plain)
    assert not glob.glob(f"{shared_dir(spark)}/table-*")
