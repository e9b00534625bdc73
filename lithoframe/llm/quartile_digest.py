"""Quartile bucket digest of whole texts, and its likeness.

Three skip patterns of byte triplets are hashed into 256 buckets over the whole UTF-8 text. Each bucket is written as
the quartile (0 to 3) that its count falls into, after two bytes of logarithmic length: 132 hex digits. The difference
of two digests is the sum of bucket quartile differences, held at what unrelated buckets have on average, scaled by how
close the lengths are; ``likeness`` is 1 for equal digests and 0 from that bound on. Equal texts have equal digests.

``with_edits`` gives each document's digest, that of its edited text (the last third replaced by the start of the next
document in descending id order, the first following the last) and both likenesses. Rows are dealt into id ranges of
even size by sampled quantiles; one row of each range is also sent to its neighbour, so a task streams over its sorted
rows holding two texts at a time.

Defined results: null text is read as empty; null ids follow all others; repeated ids are ordered by a hash of their
text, and exact repeats each get their own row; a single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

BUCKETS = 256
_SKIPS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_SALTS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: Mean quartile difference of two unrelated buckets: (4*0 + 6*1 + 4*2 + 2*3) / 16.
UNRELATED = 1.25
LENGTH_STEPS, LENGTH_BOUND = 24, 48


def counts(b: np.ndarray) -> np.ndarray:
    """Counts of the hashed byte triplets."""
    out = np.zeros(BUCKETS, np.int64)
    e = b.astype(np.uint32)
    for salt, (i, j, k) in zip(_SALTS, _SKIPS):
        m = len(e) - k
        if m > 0:
            t = (e[i : i + m] | (e[j : j + m] << np.uint32(8)) | (e[k : k + m] << np.uint32(16))) * np.uint32(salt)
            out += np.bincount((t >> np.uint32(24)).astype(np.int64), minlength=BUCKETS)
    return out


def digest(text: bytes) -> str:
    c = counts(np.frombuffer(text, np.uint8))
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = ((c > q[0]).astype(np.uint8) + (c > q[1]) + (c > q[2])).reshape(-1, 4)
    body = (code[:, 0] << 6) | (code[:, 1] << 4) | (code[:, 2] << 2) | code[:, 3]
    size = min(0xFFFF, int(round(LENGTH_STEPS * np.log2(len(text) + 1))))
    return f"{size:04x}" + body.astype(np.uint8).tobytes().hex()


_PAIR = np.abs(((np.arange(256)[:, None, None] >> np.array([6, 4, 2, 0])) & 3).astype(np.int8) - ((np.arange(256)[None, :, None] >> np.array([6, 4, 2, 0])) & 3)).sum(2)


def likeness(a: str, b: str) -> float:
    """Bounded likeness of two digests, 0 to 1."""
    x, y = (np.frombuffer(bytes.fromhex(v[4:]), np.uint8) for v in (a, b))
    body = max(0.0, 1 - float(_PAIR[x, y].sum()) / (UNRELATED * BUCKETS))
    size = max(0.0, 1 - abs(int(a[:4], 16) - int(b[:4], 16)) / LENGTH_BOUND)
    return body * size


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _ranges(rows: DataFrame, ranges: int) -> F.Column:
    """The range of a row of (i, h, t) as a column: even ranges in descending order of id, then of the text's hash.

    An id that fills several ranges (it is several quantiles) has as many of its own, cut by the hash; so have null ids.
    """
    got = rows.select(F.percentile_approx("i", [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges).alias("q"), F.count(F.lit(1)).alias("n"), F.count("i").alias("m")).first()
    cuts, times = np.unique(np.array(got.q or [], np.int64), return_counts=True)
    nulls = max(1, round(ranges * (got.n - got.m) / max(1, got.n)))
    # places of the range below each cut, the greatest cut's first; those of an id's own ranges come before the others'
    wide = np.where(times > 1, times + 1, 1)
    start = 1 + np.concatenate([[0], np.cumsum(wide[::-1])])[::-1]

    @F.arrow_udf(IntegerType())
    def place(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def share(h: np.ndarray, parts: np.ndarray) -> np.ndarray:
            """Which of the parts a hash falls into, the greatest hashes into the first."""
            down = ~(h.view(np.uint64) ^ np.uint64(1 << 63))
            return (down >> np.uint64(32)) * parts.astype(np.uint64) >> np.uint64(32)

        for ids, hashes in it:
            null = ~ids.is_valid().to_numpy(zero_copy_only=False)
            v, h = ids.fill_null(0).to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
            at = np.searchsorted(cuts, v, side="left")
            out = np.zeros(len(v), np.int64)
            low = at < len(cuts)
            k = at[low]
            own = (cuts[k] == v[low]) & (times[k] > 1)
            out[low] = start[k + 1] + np.where(own, share(h[low], times[k]), wide[k] - 1)
            out[null] = start[0] + share(h[null], np.full(null.sum(), nulls))
            yield pa.array(out.astype(np.int32))

    return place(F.col("i"), F.col("h"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("i", "t", F.xxhash64("t").alias("h"))
    place = _ranges(rows, ranges or 4 * parts)
    # The first row of each range follows the last row of the range before it: one short row for each range.
    first = {r.b: (r.i, r.h) for r in rows.select("i", "h", place.alias("b")).groupBy("b").agg(F.max(F.struct(F.coalesce("i", F.lit(-(2**63))).alias("i"), "h")).alias("m")).select("b", "m.*").collect()}
    order = sorted(first)
    firsts = [(b, *first[b], order[k - 1]) for k, b in enumerate(order)]
    guests = spark.createDataFrame(firsts or [(0, 0, 0, 0)], "gb int, gi long, gh long, goes int").where(F.lit(bool(firsts)))
    keyed = rows.select("i", "t", "h", place.alias("b"))
    sent = keyed.join(F.broadcast(guests), (F.col("gb") == F.col("b")) & (F.col("gi") == F.coalesce("i", F.lit(-(2**63)))) & (F.col("gh") == F.col("h")), "left")
    own = F.struct(F.col("b"), F.lit(0).alias("guest"))
    dealt = sent.select("i", "t", "h", F.explode(F.when(F.col("goes").isNotNull(), F.array(own, F.struct(F.col("goes").alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(own))).alias("to"))
    # Equal firsts would send a guest each; the stream takes the first of them.
    ordered = dealt.select("i", "t", "h", "to.*").repartition(parts, "b").sortWithinPartitions("b", "guest", F.desc_nulls_last("i"), F.desc("h"))
    schema = pa.schema([("i", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, id, text, digest
        for batch in it:
            out = []
            ids, texts, range_of, guest = (batch.column(n) for n in ("i", "t", "b", "guest"))
            for k in range(len(batch)):
                i, t, b, g = ids[k].as_py(), texts[k].as_py(), range_of[k].as_py(), guest[k].as_py()
                if g and (held is None or held[0] != b):
                    continue  # a second guest
                d = digest(t.encode())
                if held is not None and held[0] == b:
                    e = edited(held[2], t)
                    raw = e.encode()
                    de = digest(raw)
                    out.append((held[1], len(held[2]), hashlib.sha256(raw).hexdigest(), held[3], de, likeness(held[3], de), likeness(held[3], d)))
                held = None if g else (b, i, t, d)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 7, schema)], schema=schema)

    ddl = "i long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, ddl).withColumnRenamed("i", id_col)


def fingerprint(text: F.Column) -> F.Column:
    """The digest of each whole text as a column."""

    @F.arrow_udf("string")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            yield pa.array([digest((x.as_py() or "").encode()) for x in arr], pa.string())

    return run(text)
