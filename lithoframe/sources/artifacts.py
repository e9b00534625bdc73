"""Small product files: PNG previews, additive-scale JSON with digests, JSON and CSV sinks."""

from __future__ import annotations

import csv
import json
import math
import struct
import zlib

import numpy as np

from lithoframe.functions import vectors as V
from lithoframe.operators.lowrank import collection_digest


def png(plane: np.ndarray) -> bytes:
    """A grey (y, x) or colour (y, x, 3) plane of bytes as PNG."""
    a = np.ascontiguousarray(plane, np.uint8)
    h, w = a.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def stretched(a: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    """Bytes of a plane by percentiles; missing pixels are 0."""
    ok = np.isfinite(a)
    if not ok.any():
        return np.zeros(a.shape, np.uint8)
    lo, hi = np.percentile(a[ok], [low, high])
    return np.rint(255 * np.nan_to_num(np.clip((a - lo) / max(hi - lo, 1e-6), 0, 1))).astype(np.uint8)


def previews(cube: np.ndarray, axis: list[float], targets=(2200.0, 1650.0, 900.0)) -> dict[str, bytes]:
    """False colour at three wavelengths, one band and the mean, as PNG."""
    pick = [V.nearest_index(np.array(axis), t) for t in targets]
    return {"false_colour": png(np.stack([stretched(cube[..., k]) for k in pick], -1)), "band": png(stretched(cube[..., pick[0]])), "mean": png(stretched(np.nanmean(cube, -1)))}


def scale_payload(axis: list[float], scale: list[float], source: dict) -> str:
    """JSON of an additive spectral scale with a digest over axis and scale."""
    w, s = np.array(axis, "<f4"), np.array(scale, "<f4")
    if w.shape != s.shape or w.ndim != 1 or not (np.isfinite(w).all() and np.isfinite(s).all()) or (s < 0).any():
        raise ValueError("axis and scale must be finite, of one length, and the scale not negative")
    return json.dumps({"wavelengths_nm": w.tolist(), "scale": s.tolist(), "source": source, "digest": collection_digest({"scale": s, "wavelengths_nm": w})})


def read_scale(text: str) -> tuple[np.ndarray, np.ndarray]:
    d = json.loads(text)
    w, s = np.array(d["wavelengths_nm"], "<f4"), np.array(d["scale"], "<f4")
    if collection_digest({"scale": s, "wavelengths_nm": w}) != d["digest"]:
        raise ValueError("the scale doesn't match its digest")
    return w, s


def json_safe(v):
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, np.ndarray)):
        return [json_safe(x) for x in v]
    if isinstance(v, np.generic):
        v = v.item()
    return None if isinstance(v, float) and not math.isfinite(v) else v


def write_json(path: str, v) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json_safe(v), f, indent=2, ensure_ascii=False)


def write_csv(path: str, rows: list[dict]) -> None:
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else [])
        w.writeheader()
        w.writerows(rows)
