"""Arrow helpers: whole texts as bytes, word hashes of whole texts, sharing of bounded models."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object that an operator may broadcast; beyond it the operator refuses or takes its shuffled form.
BROADCAST_BYTES = 64 << 20


#: Bytes of texts that a Python worker gets at once; Spark's own default is 64 MB, twice held on each side.
BATCH_BYTES = 8 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Let texts pass in batches of ``BATCH_BYTES``, unless the session has another size than Spark's default."""
    if int(spark.conf.get(_BATCH, str(_DEFAULT)).rstrip("b")) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _trim():
    """The C library's own way to give freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def settle() -> None:
    """Give back what Arrow and the C library keep of freed memory: workers live on, and would each keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces_of(arr: pa.Array, rows: int = 256) -> Iterator[pa.Array]:
    """The array in slices, so that Python objects exist for few rows at a time."""
    for at in range(0, len(arr), rows):
        yield arr.slice(at, rows)
    settle()


def utf8(arr: pa.Array) -> Iterator[np.ndarray | None]:
    """Each text as a uint8 view of Arrow's own buffer; None for null."""
    if arr.type not in (pa.large_string(), pa.large_binary()):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    for k in range(n):
        yield data[off[k] : off[k + 1]] if valid[k] else None
    settle()


@lru_cache(1)
def word_chars() -> np.ndarray:
    """For each code point, whether it is a letter, a digit or a combining mark within a word."""
    import unicodedata

    ok = np.zeros(0x110000, bool)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum():
            ok[k] = True
    for lo, hi in ((0x300, 0x370), (0x900, 0x0E50), (0x1AB0, 0x1B00)):
        for k in range(lo, hi):
            if unicodedata.category(chr(k))[0] == "M":
                ok[k] = True
    return ok


_P = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _PINV = np.uint64(pow(int(_P), -1, 1 << 64))


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _PINV)]))
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a code sequence, by differences of one running polynomial sum."""
    return SpanHasher(codes)(starts, ends)


class SpanHasher:
    """The same for many sets of spans of one sequence."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(max(17, int(len(codes)).bit_length()))
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.total[ends] - self.total[starts]) * self.down[starts]
            return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Starts, ends and 64-bit hashes of the lower-cased words (runs of letters and digits) of a whole text, and that lower-cased text."""
    low = text.lower()
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), low
    ok = word_chars()[cp]
    edge = np.flatnonzero(np.diff(ok.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, span_hashes(cp, starts, ends), low


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of a word-hash sequence, repeats included; none when there are fewer words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = mix(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out


#: What HashTable.get gives for a key that it doesn't hold.
NONE = -1


class HashTable:
    """From distinct 64-bit keys to non-negative numbers, looked up as arrays (open addressing). ``mixed``: the keys are hashes already."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, mixed: bool = False):
        self.mixed = mixed
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        slot = (self._spread(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        for k, v, s in zip(keys.tolist(), values.tolist(), slot.tolist()):
            while self.values[s] != NONE:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.values[s] = k, v

    def _spread(self, keys: np.ndarray) -> np.ndarray:
        return keys if self.mixed else mix(keys)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = (self._spread(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero((out != NONE) & (self.keys[slot] != keys))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            out[miss] = self.values[slot[miss]]
            miss = miss[(out[miss] != NONE) & (self.keys[slot[miss]] != keys[miss])]
        return out


def publish(spark: SparkSession, obj, size: int):
    """A broadcast of a model whose size has been checked."""
    small_batches(spark)
    if size > BROADCAST_BYTES:
        raise ValueError(f"model of {size} bytes is over the broadcast bound of {BROADCAST_BYTES}")
    return spark.sparkContext.broadcast(obj)


def id_text_crc(col) -> F.Column:
    return F.crc32(col.cast("string").cast("binary"))
