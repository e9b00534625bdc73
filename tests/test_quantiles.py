import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.operators.quantiles import quantiles

PROBS = [0.0, 0.01, 0.1, 0.5, 0.75, 0.995, 1.0]


@pytest.mark.parametrize("most", [1 << 22, 10])
@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_both_forms_are_exact(spark, most, by):
    rng = np.random.default_rng(1)
    rows = [(int(g), "ab"[int(h)], float(x) if k % 11 else None, float(np.round(x * 3))) for k, (g, h, x) in enumerate(zip(rng.integers(0, 3, 4000), rng.integers(0, 2, 4000), rng.standard_normal(4000)))]
    df = spark.createDataFrame(rows, "g int, h string, x double, t double")
    got = {tuple(r[b] for b in by): r for r in quantiles(df, by, {"x": F.col("x"), "t": F.col("t") * 2}, PROBS, most=most, accuracy=200).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(tuple({"g": r[0], "h": r[1]}[b] for b in by), []).append(r)
    assert got.keys() == groups.keys()
    for k, rs in groups.items():
        assert got[k].n_rows == len(rs)
        assert np.allclose(got[k].x, np.quantile([r[2] for r in rs if r[2] is not None], PROBS)) and np.allclose(got[k].t, np.quantile([2 * r[3] for r in rs], PROBS))


@pytest.mark.parametrize("most", [1 << 22, 1])
def test_edges(spark, most):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0), (2, 5.0), (2, 5.0), (None, 1.0), (None, 2.0)], "g int, x double")
    got = {r.g: r.x for r in quantiles(df, ["g"], {"x": F.col("x")}, [0.25, 0.5], most=most).collect()}
    assert got[1] is None and got[2] == [5.0, 5.0]
    assert quantiles(df.limit(0), ["g"], {"x": F.col("x")}, [0.5], most=most).count() == 0


def test_no_task_holds_the_group(spark):
    """Of a group of 200,000 distinct values, the values sorted together are those between the brackets."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    got = quantiles(df, [], {"x": F.col("x")}, [0.5], most=1000)
    want = float(np.median([k * 7919 % 200_003 for k in range(200_000)]))
    assert got.first().x == [want] and "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString().replace("percentile_approx", "")
