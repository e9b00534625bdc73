import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.sources import envi


def _write(tmp, name, cube, inter, order=0, dtype="f4", extra=""):
    a = {"bip": cube, "bil": cube.transpose(0, 2, 1), "bsq": cube.transpose(2, 0, 1)}[inter]
    (tmp / f"{name}.dat").write_bytes(b"zz" + np.ascontiguousarray(a).astype((">" if order else "<") + dtype).tobytes())
    h, w, b = cube.shape
    (tmp / f"{name}.hdr").write_text(f"ENVI\nSamples = {w}\nlines = {h}\nbands = {b}\ndata type = {envi.WRITABLE[dtype]}\ninterleave = {inter.upper()}\nbyte order = {order}\nheader offset = 2\nwavelength = {{\n {', '.join(str(700 + 5 * k) for k in range(b))},\n x}}\n{extra}")
    return str(tmp / f"{name}.hdr")


@pytest.mark.parametrize("inter", ["bip", "bil", "bsq"])
@pytest.mark.parametrize("order", [0, 1])
def test_every_interleave(spark, tmp_path, inter, order):
    cube = (np.arange(8 * 7 * 5).reshape(8, 7, 5) / 100).astype("f4")
    cube[3, 2, 1] = np.nan
    df = envi.read_raster(spark, _write(tmp_path, "c", cube, inter, order), rows=3)
    assert df.rdd.getNumPartitions() == 3
    got = np.full(cube.shape, -1.0)
    for r in df.collect():
        got[r.y, r.x] = [np.nan if v is None else v for v in r["values"]]
    np.testing.assert_array_equal(got, cube.astype(float))


def test_round_trip_and_guards(spark, tmp_path):
    cube = np.random.default_rng(0).random((6, 5, 4)).astype("f4")
    rows = [(y, x, [float(v) for v in cube[y, x]]) for y in range(6) for x in range(5)]
    df = spark.createDataFrame(rows, "y int, x int, values array<double>")
    h = envi.write_raster(df, str(tmp_path / "o.hdr"), (6, 5, 4), wavelengths=[700.0, 705.0, 710.0, 715.0], description="test")
    assert h.wavelengths == (700.0, 705.0, 710.0, 715.0) and h.shape == (6, 5, 4)
    back = envi.read_raster(spark, str(tmp_path / "o.hdr"))
    assert back.join(df.withColumnRenamed("values", "v"), ["y", "x"]).where(F.col("values") == F.col("v")).count() == 30
    with pytest.raises(FileExistsError):
        envi.write_raster(df, str(tmp_path / "o.hdr"), (6, 5, 4))
    with pytest.raises(ValueError, match="shorter"):
        (tmp_path / "o.dat").write_bytes(b"12")
        envi.read_header(str(tmp_path / "o.hdr"))
    (tmp_path / "bad.hdr").write_text("ENVI\nsamples = 2\n")
    with pytest.raises(ValueError, match="lacks"):
        envi.read_header(str(tmp_path / "bad.hdr"), str(tmp_path / "o.dat"))


def test_discovery(spark, tmp_path):
    cube = np.ones((2, 2, 3), "f4")
    for n in ("rgb-a", "RGB-b", "NIR-1"):
        _write(tmp_path, n, cube, "bip")
    with pytest.raises(FileNotFoundError, match="SWIR"):
        envi.discover(str(tmp_path))
    _write(tmp_path, "SWIR-1", cube, "bsq")
    assert envi.discover(str(tmp_path))["RGB"].endswith("rgb-a.hdr")
    assert envi.summary(spark, str(tmp_path)).where("bands = 3 and first_nm = 700").count() == 3
