import json

import numpy as np
import pytest

from lithoframe.operators import detail as D
from lithoframe.operators import harmonise as H
from lithoframe.plans import pipeline
from lithoframe.sources import envi


def _raster(path, cube, dtype, waves=None):
    h, w, b = cube.shape
    path.with_suffix(".dat").write_bytes(np.ascontiguousarray(cube).astype(dtype).tobytes())
    code = {"<f4": 4, "u1": 1}[dtype]
    head = f"ENVI\nsamples = {w}\nlines = {h}\nbands = {b}\ndata type = {code}\ninterleave = bip\nbyte order = 0\n"
    path.write_text(head + (f"wavelength = {{{', '.join(map(str, waves))}}}\n" if waves is not None else ""))


@pytest.fixture(scope="module")
def triplet(tmp_path_factory):
    """Two materials in rows and columns, one colour plane and two spectrometers that disagree by gain and offset."""
    d = tmp_path_factory.mktemp("triplet")
    h, w, r = 96, 64, 4
    y, x = np.mgrid[:h, :w]
    m = 0.5 + 0.35 * np.sin(x / 9) * np.cos(y / 13) + 0.1 * (x > w // 2)
    rgb = np.clip(np.stack([0.2 + 0.6 * m, 0.25 + 0.5 * m, 0.3 + 0.3 * m], -1), 0, 1)
    s = D.Sensor((h, w), (h // r, w // r), 2.0, 2.0)
    low = s.down(m)
    nw, sw = np.arange(700.0, 1501, 50), np.arange(1000.0, 2501, 75)
    spec = lambda wl, q: q[..., None] * (0.3 + 0.0002 * (wl - 700)) + 0.1 - 0.05 * np.exp(-(((wl - 1400) / 60) ** 2)) - 0.04 * np.exp(-(((wl - 2200) / 50) ** 2))
    _raster(d / "RGB-1.hdr", np.round(rgb * 255), "u1")
    _raster(d / "NIR-1.hdr", spec(nw, low), "<f4", nw)
    _raster(d / "SWIR-1.hdr", (spec(sw, low) - 0.02) / (0.85 + 0.0001 * (sw - 1000)), "<f4", sw)
    return d


def test_harmonise_closes_the_overlap(spark, triplet):
    heads = {s: envi.read_header(p) for s, p in envi.discover(str(triplet)).items()}
    cubes = {s: envi.read_raster(spark, str(triplet / f"{s}-1.hdr")) for s in ("NIR", "SWIR")}
    cube, bands, info = H.harmonise(cubes["NIR"], cubes["SWIR"], heads["NIR"].wavelengths, heads["SWIR"].wavelengths, H.Settings(step=25.0))
    assert info["overlap_rmse_after"] < 0.45 * info["overlap_rmse_before"] and info["bands"] == 73 == bands.count()
    assert cube.where("exists(values, v -> v is null or isnan(v))").count() == 0 and cube.count() == 24 * 16
    assert bands.where("wavelength_nm between 1340 and 1450 and not is_low_confidence").count() == 0


def test_run_and_validate(spark, triplet, tmp_path):
    conf = tmp_path / "c.yaml"
    conf.write_text(json.dumps({"data_dir": str(triplet), "output_dir": str(tmp_path / "out"), "rank": 3, "spectral": {"step": 100.0}}))
    c = pipeline.load_config(str(conf))
    manifest = pipeline.run(spark, c)
    assert manifest["status"] in ("passed", "warning")
    assert pipeline.validate(spark, str(tmp_path / "out")) == {"valid": True, "errors": []}
    q = json.loads((tmp_path / "out" / "quality.json").read_text())
    assert q["product_rmse"] < 0.02 and q["product_sam_deg"] < 2
    p = pipeline.product(spark, str(tmp_path / "out"))
    assert p.count() == 96 * 64 and p.where("exists(values, v -> v < 0)").count() == 0
    with pytest.raises(FileExistsError):
        pipeline.run(spark, c)
    model = json.loads((tmp_path / "out" / "subspace.json").read_text())
    model["arrays"]["mean"]["values"][0] += 1
    (tmp_path / "out" / "subspace.json").write_text(json.dumps(model))
    assert not pipeline.validate(spark, str(tmp_path / "out"))["valid"]
    assert not pipeline.validate(spark, str(tmp_path))["valid"]


def test_config_is_strict(tmp_path):
    p = tmp_path / "c.yaml"
    for text in ("{}", "data_dir: a\noutput_dir: b\nother: 1", "data_dir: a\noutput_dir: b\nspectral:\n  stepp: 1", "data_dir: a\noutput_dir: b\ngain: twist"):
        p.write_text(text)
        with pytest.raises(ValueError):
            pipeline.load_config(str(p))
