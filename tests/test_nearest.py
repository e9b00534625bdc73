import numpy as np
import pytest

from lithoframe.operators import uncertainty as U


@pytest.mark.parametrize("n,k", [(1, 1), (3, 5), (40, 12), (3000, 10)])
@pytest.mark.parametrize("shape", ["plane", "line", "lumps", "grid"])
def test_cells_against_all_pairs(n, k, shape):
    rng = np.random.default_rng(n)
    y, x = rng.random(n) * 100, rng.random(n) * 60
    if shape == "line":
        y[:] = 5.0
    if shape == "lumps":
        y, x = np.where(rng.random(n) < 0.5, y * 0.01, y * 0.01 + 900), x * 0.01
    if shape == "grid":
        y, x = np.round(y / 5), np.round(x / 5)
    pid = rng.permutation(n)
    qy, qx = np.concatenate([rng.random(120) * 140 - 20, [-5000.0, 1e6]]), np.concatenate([rng.random(120) * 100 - 20, [3.0, -1e6]])
    ids, far = U.Near(pid, y, x).nearest(qy, qx, k)
    for j in range(len(qy)):
        d2 = (qy[j] - y) ** 2 + (qx[j] - x) ** 2
        pick = np.lexsort((pid, np.round(d2, 9)))[:k]
        assert ids[j].tolist() == pid[pick].tolist() and np.allclose(far[j], d2[pick])


def test_no_pairs_of_queries_and_points_in_the_plan(spark):
    points = spark.range(500).selectExpr("id as pid", "cast(id % 37 as double) as ref_y", "cast(id % 41 as double) as ref_x", "0.1 as res_y", "0.7 as score")
    queries = spark.range(300).selectExpr("id as qid", "cast(id % 30 as double) as qy", "cast(id % 29 as double) as qx")
    got = U.idw(queries, points, "res_y")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 300 and "Cartesian" not in plan and "NestedLoop" not in plan
