"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: the text with A-Z lower-cased, split into words at ASCII white space; each 3-word shingle (repeats
included; the whole sequence where there are fewer words) is hashed by XXH64 with seed 42, and bit k of the fingerprint
is 1 if it is set in over half of the hashes. Documents whose fingerprints differ in at most ``budget`` (3) bits are
linked; a component is what links reach.

Search: 64 bits are a ring of four 16-bit segments. If two fingerprints differ in at most 3 bits, some segment starts a
chain whose first 1, 2, 3 and 4 segments differ together in at most 0, 1, 2 and 3 bits (each chain within its share of
the budget). So the first segment is equal, and of the next one, which differs by a bit at most, one half is equal: the
key of an index with eight entries for each distinct fingerprint. Pairs that meet under a key must keep the chain's
budgets before their full distance is counted, and each bucket gives a spanning forest of its links, never all pairs.
A bucket of more than ``block`` fingerprints is cut into blocks, and every pair of blocks is a task's work of its own.

Defined results: null text is read as empty; a text without words has fingerprint zero and is linked like any other;
documents of equal fingerprint are one class, however many; a component's id is its smallest non-null id (null if it
has none); repeated rows each get their own result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.components import components, drop, one_row_each, written
from lithoframe.llm.textarr import mix, utf8

SEGMENTS, WIDTH, BUDGET = 4, 16, 3
_hash = xxhash.xxh64_intdigest


def fingerprint_of(text: bytes, words: int = 3, seed: int = 42) -> int:
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        h = np.array([_hash(b" ".join(w), seed)], np.uint64)
    else:
        flat = b" ".join(w)
        end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        h = np.fromiter((_hash(flat[a:b], seed) for a, b in zip(start[: len(w) - words + 1].tolist(), end[words - 1 :].tolist())), np.uint64, len(w) - words + 1)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def simhash(text: Column) -> Column:
    """The fingerprint of each whole text, as a long that holds its 64 bits."""

    @F.arrow_udf("long")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            got = np.fromiter((fingerprint_of(b"" if b is None else b.tobytes()) for b in utf8(arr)), np.uint64, len(arr))
            yield pa.array(got.view(np.int64))

    return run(text)


def chain_ok(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether every chain that starts at segment ``first`` stays within its share of the budget; the last one is the full distance."""
    x, ok, total = a ^ b, np.ones(len(a), bool), np.zeros(len(a), np.int64)
    for k in range(SEGMENTS):
        shift = (((first + k) % SEGMENTS) * WIDTH).astype(np.uint64)
        total += np.bitwise_count((x >> shift) & np.uint64((1 << WIDTH) - 1))
        ok &= total <= (k + 1) * BUDGET // SEGMENTS
    return ok


_LANES = np.uint64(0x0101010101010101)


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of ``words`` times 64 bits of a set of hashes: a bit is 1 if set in over half of them, mixed anew for each word."""
    count = np.zeros((8, 8 * words), np.int64)
    seeds = mix(np.arange(1, words + 1, dtype=np.uint64))
    for at in range(0, len(h), 255 * 16):
        x = mix(h[at : at + 255 * 16, None] ^ seeds)
        for k in range(8):
            # A byte holds the sum of a bit over up to 255 hashes.
            lanes = np.add.reduceat((x >> np.uint64(k)) & _LANES, np.arange(0, len(x), 255), axis=0)
            count[k] += lanes.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits((count * 2 > len(h)).T, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def ring_ok(d: np.ndarray, budget: int) -> np.ndarray:
    """Whether some segment starts chains that all stay within their shares of the budget, by the distances d (pair, segment)."""
    n = d.shape[1]
    share = np.arange(1, n + 1) * budget // n
    ok = np.zeros(len(d), bool)
    for first in range(n):
        ok |= (np.cumsum(np.roll(d, -first, axis=1), axis=1, dtype=np.int64) <= share).all(1)
    return ok


def ring_pairs(left: np.ndarray, right: np.ndarray, begin: np.ndarray, end: np.ndarray, segments: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) within the budget of a ring of the first ``segments`` words of wide fingerprints, a few rows i at a time.

    Row i of the left meets rows begin[i] to end[i] of the right; both bounds must not decrease. A pair whose first
    segments are all over their share is never looked at again. At budgets of a third of the bits that is the filter's
    whole gain: no key of a segment keeps apart what a scan of it wouldn't.
    """
    step = max(1, (1 << 17) // max(1, len(right)))
    one, other = np.ascontiguousarray(left[:, :segments].T), np.ascontiguousarray(right[:, :segments].T)
    for a in range(0, len(left), step):
        b = min(a + step, len(left))
        x, y = int(begin[a]), int(end[b - 1])
        if x >= y:
            continue
        near = np.zeros((b - a, y - x), bool)
        for k in range(segments):
            near |= np.bitwise_count(one[k, a:b, None] ^ other[k, None, x:y]) <= budget // segments
        i, j = np.divmod(np.flatnonzero(near), y - x)
        i, j = i + a, j + x
        met = (j >= begin[i]) & (j < end[i])
        i, j = i[met], j[met]
        ok = ring_ok(np.bitwise_count(left[i, :segments] ^ right[j, :segments]), budget)
        if ok.any():
            yield i[ok], j[ok]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the pairs, as stars around the least node."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within runs of equal keys."""
    u = fps.view(np.uint64)
    first = (keys >> 25) & 3
    left, right = [], []
    for lag in range(1, len(keys)):
        same = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(same):
            break
        hit = same[chain_ok(u[same], u[same + lag], first[same])]
        left.append(fps[hit])
        right.append(fps[hit + lag])
    if not left:
        return fps[:0], fps[:0]
    return forest(np.concatenate(left), np.concatenate(right))


def link_fingerprints(fps: DataFrame, block: int = 1024) -> DataFrame:
    """From distinct fingerprints (fp) to edges (a, b) that connect what is within the budget."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def segment(k: int) -> str:
        return f"(shiftrightunsigned(fp, {16 * (k % 4)}) & 65535L)"

    # 24 bits of the pair's segments, the half (bit 24) and the first segment (bits 25, 26)
    entries = [f"(({segment(k)} << 8) | (shiftrightunsigned({segment(k + 1)}, {8 * h}) & 255L) | {(k << 25) | (h << 24)}L)" for k in range(4) for h in range(2)]
    entry = fps.select("fp", F.explode(F.array(*[F.expr(e) for e in entries])).alias("k"))
    shared = written(entry.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = entry.join(shared, "k").select("k", "fp", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = met.withColumn("own", own).select("k", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("lo"), F.greatest(o, "own").alias("hi")))).alias("pair"))
    dealt = cut.select("k", "pair.lo", "pair.hi", "fp").repartition(parts, "k", "lo", "hi").sortWithinPartitions("k", "lo", "hi")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def out(tag, key, fp):
            # runs of (key, lo, hi): a run's number stands above the key's 27 bits
            if not len(key):
                return None
            new = np.concatenate([[False], (tag[1:] != tag[:-1]) | (key[1:] != key[:-1])])
            a, b = _links((np.cumsum(new) << 27) | key, fp)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in it:
            k, lo, hi, fp = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("k", "lo", "hi", "fp"))
            tag, key, fp = (np.concatenate([h, x]) for h, x in zip(held, ((lo << 32) | hi, k, fp)))
            if not len(key):
                continue
            last = np.flatnonzero((tag != tag[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [tag[cut:], key[cut:], fp[cut:]]
            if (got := out(tag[:cut], key[:cut], fp[:cut])) is not None:
                yield got
        if (got := out(*held)) is not None:
            yield got

    return dealt.mapInArrow(run, "a long, b long")


def _found(docs: DataFrame, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(i, h, fp) of every row, h the text's xxhash64; and (fp, root, component_id), root the component's least fingerprint."""
    fps = written(docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), simhash(F.col(text_col)).alias("fp")), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("i").alias("least")), "classes")
    roots = written(components(link_fingerprints(classes.select("fp"), block)), "roots")
    members = roots.join(classes, roots.node == classes.fp).select("fp", "root", "least")
    tops = members.groupBy("root").agg(F.min("least").alias("top"))
    reached = written(members.join(tops, "root").select("fp", "root", "top"), "reached")
    named = written(classes.join(reached, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("top").isNull(), F.col("least")).otherwise(F.col("top")).alias("component_id")), "named")
    drop(classes, roots, reached)
    return fps, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    fps, named = _found(docs, id_col, text_col, block)
    return fps.join(named, "fp").select(F.col("i").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1 << 20) -> DataFrame:
    """The documents with one row of each component left, whatever its ids are: the row of least non-null id."""
    fps, named = _found(docs, id_col, text_col, 1024)
    found = fps.join(named, "fp").select(F.col("i").alias("_i"), F.col("h").alias("_h"), F.col("root").alias("_c"))
    return one_row_each(docs, found, id_col, text_col, broadcast_rows)
