"""ENVI rasters: headers, a Spark data source that reads row strips, a writer, and discovery of sensor sets.

``spark.read.format("envi").option("path", "cube.hdr").load()`` gives one row a pixel: y, x, values (array<double>, NaN
as null). Each input partition is a strip of rows, read by position from the binary, so a 2 GB cube is never held whole.
``SparkSession.dataSource.register(EnviSource)`` makes the name known.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Data type codes of the format.
DTYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
WRITABLE = {"u1": 1, "i2": 2, "i4": 3, "f4": 4, "f8": 5, "u2": 12, "u4": 13, "i8": 14, "u8": 15}
#: Suffixes under which a header's binary is looked for, in this order.
BINARY_SUFFIXES = ("", ".dat", ".raw", ".img", ".bin")
REQUIRED = ("samples", "lines", "bands", "data type", "interleave")


def parse_fields(text: str) -> dict[str, str]:
    """Keys in lower case and values of a header; a value in braces may run over several lines."""
    out: dict[str, str] = {}
    for m in re.finditer(r"^[ \t]*([^=\n;]+?)[ \t]*=[ \t]*(\{.*?\}|[^\n]*)", text, re.M | re.S):
        v = m[2].strip()
        out[m[1].strip().lower()] = " ".join(v[1:-1].split()) if v.startswith("{") and v.endswith("}") else v
    return out


def numbers(value: str | None) -> list[float]:
    """The numbers of a list; what isn't one is left out."""
    out = []
    for t in re.split(r"[,\s]+", (value or "").strip("{} ")):
        try:
            out.append(float(t))
        except ValueError:
            continue
    return out


@dataclass(frozen=True)
class Header:
    samples: int
    lines: int
    bands: int
    dtype: str
    interleave: str
    offset: int
    wavelengths: tuple[float, ...]
    fwhm: tuple[float, ...]
    units: str
    binary: str
    raw: dict[str, str] = field(hash=False, default_factory=dict)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.lines, self.samples, self.bands

    @property
    def size(self) -> int:
        return self.lines * self.samples * self.bands * np.dtype(self.dtype).itemsize


def binary_of(path: str) -> str:
    stem = re.sub(r"\.hdr$", "", path, flags=re.I)
    for suffix in BINARY_SUFFIXES:
        if os.path.isfile(stem + suffix):
            return stem + suffix
    raise FileNotFoundError(f"no binary beside {path}")


def read_header(path: str, binary: str | None = None) -> Header:
    """The header of a raster; raises on missing keys, unknown types, and binaries shorter than declared."""
    with open(path, encoding="utf-8", errors="replace") as f:
        raw = parse_fields(f.read())
    if missing := [k for k in REQUIRED if k not in raw]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    code, order, inter = int(raw["data type"]), int(raw.get("byte order", "0")), raw["interleave"].lower()
    if code not in DTYPES:
        raise ValueError(f"unknown data type {code}")
    if inter not in ("bil", "bip", "bsq"):
        raise ValueError(f"unknown interleave {inter}")
    kind = DTYPES[code]
    dtype = kind if kind == "u1" else (">" if order == 1 else "<") + kind
    binary = binary or binary_of(path)
    waves = tuple(numbers(raw.get("wavelength")))
    h = Header(int(raw["samples"]), int(raw["lines"]), int(raw["bands"]), dtype, inter, int(raw.get("header offset", "0")), waves, tuple(numbers(raw.get("fwhm"))), raw.get("wavelength units", ""), binary, raw)
    if waves and len(waves) != h.bands:
        raise ValueError(f"{len(waves)} wavelengths for {h.bands} bands")
    if os.path.getsize(binary) < h.offset + h.size:
        raise ValueError(f"{binary} is shorter than its header says")
    return h


def read_strip(h: Header, first: int, last: int) -> np.ndarray:
    """Rows first..last-1 as (y, x, band)."""
    n, s, b = last - first, h.samples, h.bands
    item = np.dtype(h.dtype).itemsize
    if h.interleave == "bsq":
        out = np.empty((n, s, b), h.dtype)
        for k in range(b):
            out[:, :, k] = np.fromfile(h.binary, h.dtype, n * s, offset=h.offset + (k * h.lines + first) * s * item).reshape(n, s)
        return out
    a = np.fromfile(h.binary, h.dtype, n * s * b, offset=h.offset + first * s * b * item)
    return a.reshape(n, s, b) if h.interleave == "bip" else a.reshape(n, b, s).transpose(0, 2, 1)


class Strip(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class EnviReader(DataSourceReader):
    def __init__(self, header: Header, rows: int):
        self.header, self.rows = header, rows

    def partitions(self):
        return [Strip(a, min(a + self.rows, self.header.lines)) for a in range(0, self.header.lines, self.rows)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        h = self.header
        for y in range(partition.first, partition.last):
            v = read_strip(h, y, y + 1)[0]
            v = np.abs(v).astype(float) if np.iscomplexobj(v) else v.astype(float)
            flat = pa.array(v.ravel(), from_pandas=True)  # NaN becomes null
            values = pa.ListArray.from_arrays(pa.array(np.arange(h.samples + 1, dtype=np.int32) * h.bands), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(h.samples, y, np.int32)), pa.array(np.arange(h.samples, dtype=np.int32)), values], names=["y", "x", "values"])


class EnviSource(DataSource):
    """options: path (header), rows (of a strip; by default about 32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return "y int, x int, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        h = read_header(self.options["path"])
        row = max(1, h.samples * h.bands * np.dtype(h.dtype).itemsize)
        return EnviReader(h, int(self.options.get("rows", max(1, (32 << 20) // row))))


def read_raster(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    spark.dataSource.register(EnviSource)
    r = spark.read.format("envi").option("path", path)
    return (r.option("rows", str(rows)) if rows else r).load()


def _listed(name: str, values, per_line: int) -> str:
    lines = [", ".join(values[k : k + per_line]) for k in range(0, len(values), per_line)]
    return f"{name} = {{\n " + ",\n ".join(lines) + "}"


def write_raster(df: DataFrame, path: str, shape: tuple[int, int, int], values: str = "values", dtype: str = "f4", wavelengths: list[float] | None = None, description: str = "") -> Header:
    """A pixel-interleaved raster from rows (y, x, values). Each task writes its own pixels at their positions in a shared file.

    The folder must be one that all executors see. Null values are written as NaN. Refuses to replace a raster.
    """
    lines, samples, bands = shape
    if dtype not in WRITABLE:
        raise ValueError(f"{dtype} can't be written")
    if wavelengths is not None and len(wavelengths) != bands:
        raise ValueError(f"{len(wavelengths)} wavelengths for {bands} bands")
    stem = re.sub(r"\.hdr$", "", path, flags=re.I)
    if os.path.exists(path) or os.path.exists(stem + ".dat"):
        raise FileExistsError(path)
    kind = "<" + dtype if dtype != "u1" else dtype
    item = np.dtype(kind).itemsize
    with open(stem + ".dat", "wb") as f:
        f.truncate(lines * samples * bands * item)

    def run(it):
        n = 0
        with open(stem + ".dat", "r+b") as f:
            for b in it:
                for part in (b.slice(at, 4096) for at in range(0, len(b), 4096)):
                    y, x = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    v = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).astype(kind).reshape(len(part), bands)
                    place = y * samples + x
                    # pixels that follow each other are one write
                    edge = [0, *(np.flatnonzero(np.diff(place) != 1) + 1).tolist(), len(place)]
                    for i, j in zip(edge[:-1], edge[1:]):
                        f.seek(int(place[i]) * bands * item)
                        f.write(v[i:j].tobytes())
                    n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # Sorted rows make runs of neighbouring writes.
    df.select("y", "x", values).repartitionByRange("y").sortWithinPartitions("y", "x").mapInArrow(run, "n long").collect()
    head = ["ENVI", f"description = {{{description}}}", f"samples = {samples}", f"lines = {lines}", f"bands = {bands}", "header offset = 0", "file type = ENVI Standard", f"data type = {WRITABLE[dtype]}", "interleave = bip", "byte order = 0"]
    if wavelengths is not None:
        head += ["wavelength units = Nanometers", _listed("wavelength", [f"{w:.6f}" for w in wavelengths], 12), _listed("band names", [f"{w:.1f}nm" for w in wavelengths], 8)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(head) + "\n")
    return read_header(path)


def pick_headers(names: list[str], sensors: tuple[str, ...] = ("RGB", "NIR", "SWIR")) -> dict[str, str]:
    """Of file names the header of each sensor: NAME-*.hdr whatever its case, the last in order of name."""
    out = {}
    for n in sorted(names):
        for s in sensors:
            if n.upper().startswith(s + "-") and n.lower().endswith(".hdr"):
                out[s] = n
    return out


def discover(folder: str, sensors: tuple[str, ...] = ("RGB", "NIR", "SWIR")) -> dict[str, str]:
    """The header of each sensor in a folder; raises where one is missing."""
    out = {s: os.path.join(folder, n) for s, n in pick_headers(os.listdir(folder), sensors).items()}
    if missing := [s for s in sensors if s not in out]:
        raise FileNotFoundError(f"{folder} has no header for {', '.join(missing)}")
    return out


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row a sensor: path, size, type, interleave, wavelengths."""
    rows = []
    for s, p in discover(folder).items():
        h = read_header(p)
        rows.append((s, p, h.lines, h.samples, h.bands, h.dtype, h.interleave, min(h.wavelengths, default=None), max(h.wavelengths, default=None)))
    return spark.createDataFrame(rows, "sensor string, path string, lines int, samples int, bands int, dtype string, interleave string, first_nm double, last_nm double")
