import hashlib
import json

import numpy as np
import pytest

from lithoframe.operators import detail as D
from lithoframe.operators import evidence as E
from lithoframe.operators import planes as P
from lithoframe.operators import quality as Q
from lithoframe.plans import pipeline
from lithoframe.sources.store import Store
from test_raster_run import conf, scene  # noqa: F401


@pytest.fixture(scope="module")
def folders(spark, scene, tmp_path_factory):  # noqa: F811
    at = tmp_path_factory.mktemp("sweep")
    c = conf(at, scene, write_previews=False, write_uncertainty=False)
    return E.sweep(spark, c, {"base": {}, "plain": {"coefficient_detail": "none", "gain": "legacy"}}), c


def test_extraction_equals_the_files(spark, folders):
    at, _ = folders
    runs = E.extract(spark, at)
    got = {r.run: r for r in runs.collect()}
    for name, folder in at.items():
        q, g = (json.loads(open(f"{folder}/{n}.json").read()) for n in ("quality", "registration"))
        assert got[name].product_rmse == q["product_rmse"] and got[name].pair_score == g["pair"]["score"] and got[name].n_bands == q["spectral"]["bands"]
    rows = {(r.run, r.wavelength_nm): r for r in E.band_metrics(runs).collect()}
    for name, folder in at.items():
        for b in json.loads(open(f"{folder}/quality.json").read())["bands"]:
            one = next(s for s in b["statistics"] if s["mask"] == "reliable" and s["scale"] == 2.4)
            r = rows[name, b["wavelength_nm"]]
            assert r.rho == one["rho"] and r.f1 == b["structure"]["f1"] and r.screening == b["screening"]["status"]
    assert E.faults(runs, 2) == [] and E.faults(runs, 3) == ["2 of 3 runs are there"]
    assert {r.run: r.within for r in E.within_all_bounds(runs).collect()} == {n: all(b["screening"]["status"].startswith("within") for b in json.loads(open(f"{f}/quality.json").read())["bands"]) for n, f in at.items()}


def test_comparison_with_a_baseline(spark, folders):
    at, _ = folders
    rows = E.metric_rows(E.extract(spark, at))
    got = {(r.wavelength_nm, r.metric): r for r in E.compare(rows, "base").collect()}
    q = {n: json.loads(open(f"{f}/quality.json").read()) for n, f in at.items()}
    a, b = q["base"]["product_rmse"], q["plain"]["product_rmse"]
    assert got[None, "product_rmse"].raw_percent == pytest.approx(100 * (b - a) / a) and got[None, "product_rmse"].improvement_percent == pytest.approx(100 * (a - b) / a)
    wide = E.pivoted(rows.where("wavelength_nm is null"), ["run"], ["product_rmse", "product_sam_deg"])
    text = E.markdown(wide.orderBy("run"), 6)
    assert text.splitlines()[0] == "| run | product_rmse | product_sam_deg |" and f"{a:.6f}" in text and len(text.splitlines()) == 4


def test_a_valid_variant_is_not_run_again(spark, folders):
    at, c = folders
    before = json.loads(open(f"{at['base']}/manifest.json").read())["run_id"]
    assert E.sweep(spark, c, {"base": {}}) == {"base": at["base"]}
    assert json.loads(open(f"{at['base']}/manifest.json").read())["run_id"] == before


def test_mixed_folders_and_changed_files_are_found(spark, folders):
    at, _ = folders
    store = Store(spark, at["plain"])
    digests = store.read_json("manifest.json")["digests"]
    assert all(r.same for r in E.audit(spark, at["plain"], digests).collect()) and len(digests) >= 5
    old = store.read("registration.json")
    try:
        store.write_json("registration.json", json.loads(old) | {"run_id": "other"})
        assert E.faults(E.extract(spark, at), 2) == ["1 folders hold files of different runs"]
        rows = {r.file: r for r in E.audit(spark, at["plain"], digests | {"gone.json": "x"}).collect()}
        assert not rows["registration.json"].same and rows["quality.json"].same and rows["gone.json"].found is None and not rows["gone.json"].same
        assert rows["registration.json"].expected == hashlib.sha256(old).hexdigest()
        assert "registration.json doesn't match its digest" in pipeline.validate(spark, at["plain"])["errors"]
    finally:
        store.write("registration.json", old)


def test_sweep_metrics_of_planes():
    rng = np.random.default_rng(0)
    a = P.gaussian(rng.standard_normal((50, 40)), 1.0)
    lo, hi = np.percentile(a, [2, 98])
    n = np.clip((a - lo) / (hi - lo), 0, 1)
    assert Q.high_frequency_energy(a) == pytest.approx(np.percentile(np.abs(n - P.gaussian(n, 1.4)), 95))
    assert Q.edge_correlation(a, 3 * a + 1) > 0.999 and abs(Q.edge_correlation(a, P.gaussian(rng.standard_normal((50, 40)), 1.0))) < 0.3
    assert np.isnan(Q.edge_correlation(a, np.zeros_like(a))) or D.correlation(a, np.zeros_like(a)) != D.correlation(a, np.zeros_like(a))
