import json
import zlib

import numpy as np
import pytest

from lithoframe.operators import planes as P
from lithoframe.operators import quality as Q
from lithoframe.sources import artifacts as A


def test_report_sees_amplitude_loss(spark):
    y, x = np.mgrid[:64, :56]
    tex = np.sin(x / 2.2) * np.cos(y / 2.6)
    rgb = np.clip(0.5 + 0.10 * tex, 0, 1)
    rows = [(int(a), int(b), *[float(rgb[a, b] * k) for k in (1.0, 0.9, 0.8)], float(0.5 + 0.010 * tex[a, b])) for a in range(64) for b in range(56)]
    d = spark.createDataFrame(rows, "y int, x int, r double, g double, b double, band double")
    m = Q.masks(Q.detail_planes(d, "band"))
    got = {(r.scale, r["mask"]): r for r in Q.detail_report(m).collect()}
    r = got[1.2, "all_valid"]
    assert 0.07 < r.beta < 0.14 and 0.07 < r.energy_ratio < 0.14 and r.rho > 0.95 and len(got) == 15
    assert got[2.4, "dark"].pixel_count < got[2.4, "all_valid"].pixel_count


def test_halo_and_edges():
    y, x = np.mgrid[:128, :128]
    step = P.gaussian((x > 64).astype(float) + 0 * y, 0.8)
    ring = step + 0.2 * (np.exp(-(((x - 67) / 1.2) ** 2)) - np.exp(-(((x - 61) / 1.2) ** 2)))
    ok = np.ones_like(step, bool)
    clean, bad = Q.halo(step, step, ok), Q.halo(step, ring, ok)
    assert bad["p95"] > 0.15 and bad["p95"] > clean["p95"] + 0.10 and clean["width_ratio"] == pytest.approx(1)
    assert Q.halo(step, ring, np.zeros_like(ok))["status"] == "insufficient_support"
    g = Q.gradient_structure(step + 0.01 * np.sin(y / 3), step + 0.01 * np.sin(y / 3), ok)
    assert g["f1"] == 1.0 and g["orientation"] == pytest.approx(1)


def test_limits_and_helpers():
    assert Q.limits(beta_min=0.5)["beta_min"] == 0.5
    for bad in ({"x": 1}, {"beta_min": 2}, {"dark_percentile": 0}, {"rho_min": 1.5}):
        with pytest.raises(ValueError):
            Q.limits(**bad)
    m = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 0, 0]], bool)
    lab = Q.components(m, least=2)
    assert lab.max() == 2 and lab[3, 0] == 0 and lab[0, 0] == lab[1, 1] != lab[0, 3] == lab[1, 3]
    s = np.zeros((20, 20))
    s[3, 3], s[3, 4], s[15, 15] = 3, 2, 1
    assert Q.spread_patches(s, 8, 2) == [(3, 3), (15, 15)] or Q.spread_patches(s, 8, 2)[0] == (3, 3)


def test_artifacts(tmp_path):
    img = np.arange(12, dtype=np.uint8).reshape(3, 4)
    b = A.png(img)
    at = b.index(b"IDAT")
    n = int.from_bytes(b[at - 4 : at], "big")
    raw = np.frombuffer(zlib.decompress(b[at + 4 : at + 4 + n]), np.uint8).reshape(3, 5)
    assert (raw[:, 1:] == img).all() and b[:4] == b"\x89PNG"
    assert set(A.previews(np.random.default_rng(0).random((5, 6, 4)), [900, 1650, 2200, 2300])) == {"false_colour", "band", "mean"}
    t = A.scale_payload([700, 705], [0.1, 0.2], {"a": 1})
    assert A.read_scale(t)[1].tolist() == pytest.approx([0.1, 0.2])
    d = json.loads(t)
    d["scale"][0] = 9
    with pytest.raises(ValueError):
        A.read_scale(json.dumps(d))
    with pytest.raises(ValueError):
        A.scale_payload([700], [-1.0], {})
    A.write_json(str(tmp_path / "a.json"), {"x": float("nan"), "y": np.float32(1.5), "é": [np.inf]})
    assert json.loads((tmp_path / "a.json").read_text()) == {"x": None, "y": 1.5, "é": [None]}
    A.write_csv(str(tmp_path / "a.csv"), [{"a": 1, "b": "é"}])
    assert (tmp_path / "a.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b")
