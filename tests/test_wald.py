import numpy as np

from lithoframe.operators import wald


def scene(n=64, seed=2):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    tex = 0.1 * np.sin(x / 1.7) * np.cos(y / 1.9) + 0.02 * rng.standard_normal((n, n))
    base = 0.5 + 0.2 * (x > n // 2) + tex
    rgb = np.clip(np.stack([base, 0.9 * base, 0.8 * base], -1), 0, 1)
    return np.stack([base * (0.6 + 0.1 * k) + 0.05 * k for k in range(5)], -1), rgb


def test_candidates_gain_and_stay_consistent():
    truth, rgb = scene()
    rows = wald.run_scene(truth, rgb, wald.Protocol())
    v = {(c, m): x for c, m, x in rows}
    names = {c for c, _, _ in rows}
    assert len(names) == 9
    for c in ("gsa_additive", "hpm_linear", "hpm_log", "ridge_cv", "lowrank_ridge"):
        assert v[c, "rmse"] < 0.8 * v["bicubic", "rmse"] and v[c, "detail_rho"] > v["bicubic", "detail_rho"]
    assert v["lowrank_cone", "sam_deg"] <= v["lowrank_ridge", "sam_deg"] + 0.6


def test_spark_rows_and_policy(spark):
    truth, rgb = scene(32)
    rows = [("s", y, x, truth[y, x].tolist(), rgb[y, x].tolist()) for y in range(32) for x in range(32)]
    d = spark.createDataFrame(rows, "scene string, y int, x int, values array<double>, rgb array<double>")
    got = wald.benchmark(d)
    mine = {(r.candidate, r.metric): r for r in got.collect()}
    assert mine["bicubic", "rmse"].gain_percent == 0 and mine["ridge_cv", "rmse"].gain_percent > 0 and mine["ridge_cv", "psnr"].gain_percent is None
    p = {r.candidate: r for r in wald.policy(got, spark.createDataFrame([("s", "identifiable")], "scene string, status string")).collect()}
    assert p["ridge_cv"].accepted and not p["bicubic"].accepted and p["bicubic"].reason == "no gain over bicubic"
    q = wald.policy(got, spark.createDataFrame([("s", "unidentifiable")], "scene string, status string"))
    assert q.where("accepted").count() == 0
    none = wald.policy(got, spark.createDataFrame([], "scene string, status string"))
    assert none.where("accepted").count() == 0
