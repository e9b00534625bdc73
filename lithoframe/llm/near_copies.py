"""Near copies: texts whose sets of five-word shingles have a Jaccard coefficient of 0.8 or more, by SimHash and pigeonring.

Words are what stands between ASCII white space, A-Z lower-cased; a text of fewer words is one shingle. Texts of equal
shingle sets are one class before any search. The fingerprint of a class is a SimHash of its distinct shingles, of 512
bits, since 64 bits don't tell: pairs at 0.8 differ in 15 % of the bits (16 % at worst where sets are small), and by
chance in up to 27 of 64, as 13 % of unrelated pairs do. A pair must be within ``BUDGETS[0]`` bits on a ring of the first
two words, by pigeonring, and within ``BUDGETS[1]`` over all eight; sets of 4 and 5 shingles (19 %) get ``SLACK`` more.
Each of the two misses a pair at exactly 0.8 with probability 1e-6 or less, and rarer above. Every link is then verified
on the shingles themselves (64-bit hashes of them).

Search: two sets at 0.8 differ in size by a quarter at most, so classes are dealt by the logarithm of their size, in
blocks, and a block meets the blocks of its own and the next sizes, each pair of blocks as a task's work. A task scans
first segments within the window of sizes, keeps what pigeonring's chains leave, and gives a spanning forest of it.
At this budget no key of a segment would spare that scan, so comparisons
grow with the square of the classes of like size, at some nanoseconds each. What the forests join is a
group; its classes get their shingles, and the links within it are verified in a task's memory, the nearest class of each
component first, where only links that join two components come out: a group of texts that are nearly alike costs
comparisons, but never a row for each pair. A group of more than ``block`` classes is cut into blocks likewise.

Defined results: null text is read as empty; texts without words are one class and linked to nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.components import components, drop, one_row_each, written
from lithoframe.llm.simhash_pigeonring import forest, ring_pairs, wide_fingerprint
from lithoframe.llm.textarr import settle, utf8

SHINGLE, THRESHOLD = 5, 0.8
#: Words of 64 bits of a fingerprint, and how many of them, as segments, are the ring that is searched.
WORDS, RING = 8, 2
#: Most bits that a pair may differ in on the ring and in all; more of them for sets of up to FEW shingles.
BUDGETS, SLACK, FEW = (43, 126), (4, 14), 5
#: Different sets of up to this many shingles are never at 0.8.
ALONE = 3
#: How many shingles a block of classes may hold, about, when it is verified.
BLOCK_SHINGLES = 1 << 21
_hash = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, sorted."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = min(words, len(w))
    flat = b" ".join(w)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return np.unique(np.fromiter((_hash(flat[a:b], 42) for a, b in zip(start[: len(w) - n + 1].tolist(), end[n - 1 :].tolist())), np.uint64, len(w) - n + 1))


def _sketch(text: F.Column) -> F.Column:
    """key: hash of the shingle set; size: its size; fp: its fingerprint."""

    @F.arrow_udf("struct<key:long,size:int,fp:binary>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            keys, sizes, fps = [], [], []
            for b in utf8(arr):
                h = shingle_hashes(b"" if b is None else b.tobytes())
                keys.append(_hash(h.tobytes(), 1))
                sizes.append(len(h))
                fps.append(wide_fingerprint(h, WORDS).tobytes() if len(h) > ALONE else b"")
            yield pa.StructArray.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary())], names=["key", "size", "fp"])

    return run(text)


def _shingles(text: F.Column) -> F.Column:
    @F.arrow_udf("array<long>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            yield pa.array([shingle_hashes(b"" if b is None else b.tobytes()).view(np.int64) for b in utf8(arr)], pa.list_(pa.int64()))

    return run(text)


def _sets(wanted: DataFrame, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(key, s): the shingles of each of the wanted keys, from one text that has them."""
    one = rows.select("key", "_i", "_h").join(wanted, "key", "left_semi").groupBy("key").agg(F.min(F.struct("_i", "_h")).alias("m"))
    at = written(one.select("key", "m._i", "m._h"), "wanted")
    small = F.broadcast(at) if at.count() <= broadcast_rows else at
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(small, F.col("i").eqNullSafe(F.col("_i")) & (F.xxhash64("t") == F.col("_h")))
    out = written(texts.dropDuplicates(["key"]).select("key", _shingles(F.col("t")).alias("s")), "shingles")
    drop(at)
    return out


def _met(entries: DataFrame) -> DataFrame:
    """Entries (band, own, from, to) dealt so that every pair of blocks (lo, hi) of a band that meet is in one place."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = F.explode(F.transform(F.sequence("from", "to"), lambda o: F.struct(F.least(o, "own").alias("lo"), F.greatest(o, "own").alias("hi")))).alias("pair")
    return entries.select("*", pair).select("*", "pair.lo", "pair.hi").drop("pair", "from", "to").repartition(parts, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")


def _by_size(classes: DataFrame, block: int | None) -> DataFrame:
    """The classes in one band, in blocks of like size; each meets those of its own and of the next sizes.

    A block holds a 32nd of all classes, so that copies of a class in pairs of blocks are as many however many there are.
    """
    step = F.floor(F.log("size") / F.log(F.lit(1 / THRESHOLD))).cast("int")
    at = classes.where(F.col("size") > ALONE).withColumn("step", step)
    counts = dict(at.groupBy("step").count().collect())
    block = block or min(max(sum(counts.values()) // 32, 1 << 8), 1 << 17)
    first, where = 0, {}
    for k in sorted(counts):
        where[k] = (first, -(-counts[k] // block))
        first += where[k][1]
    plan = [(k, a, n, where.get(k - 1, (a,))[0], sum(where.get(k + 1, (a, n))) - 1) for k, (a, n) in where.items()]
    steps = classes.sparkSession.createDataFrame(plan, "step int, first int, n int, from int, to int")
    own = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("n"))).cast("int").alias("own")
    return at.join(F.broadcast(steps), "step").select("key", "size", "fp", F.lit(0).cast("long").alias("band"), own, "from", "to")


def _by_group(work):
    """work, which takes the table of one (band, lo, hi), as a function for mapInArrow over rows sorted by these."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in it:
            settle()
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            b, lo, hi = (t.column(n).to_numpy() for n in ("band", "lo", "hi"))
            edge = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), len(t)]
            for x, y in zip(edge[:-1], edge[1:]):
                this = (b[x], lo[x], hi[x])
                if held and this != last:
                    yield from work(pa.concat_tables(held))
                    held = []
                held.append(t.slice(x, y - x))
                last = this
        if held:
            yield from work(pa.concat_tables(held))

    return run


def _candidates(t: pa.Table, budgets: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of a group, across its two blocks or within its one, that sizes and fingerprints allow."""
    size, own = t.column("size").to_numpy(), t.column("own").to_numpy()
    fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(len(t), -1)
    lo, within = t.column("lo")[0].as_py(), t.column("lo")[0] == t.column("hi")[0]
    order = np.argsort(size, kind="stable")
    left, right = (order, order) if within else (order[own[order] == lo], order[own[order] != lo])
    for few in (True, False):
        some = left[(size[left] <= FEW) == few]
        if not len(some):
            continue
        ring, whole = (x + y for x, y in zip(budgets, SLACK)) if few else budgets
        begin = np.searchsorted(size[right], np.ceil(size[some] * THRESHOLD - 1e-9), "left")
        if within:
            begin = np.arange(len(some)) + (0 if few else len(left) - len(some)) + 1
        end = np.searchsorted(size[right], np.floor(size[some] / THRESHOLD + 1e-9), "right")
        for i, j in ring_pairs(fp[some], fp[right], begin, np.maximum(begin, end), RING, ring):
            i, j = some[i], right[j]
            d = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64)
            ok = d <= whole
            if ok.any():
                yield i[ok], j[ok], d[ok]


def _reached(t: pa.Table, budgets: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """A spanning forest (a, b) of the candidate pairs of a group."""
    key, label = t.column("key").to_numpy(), np.arange(len(t))
    for i, j, _ in _candidates(t, budgets):
        a, b = label[i], label[j]
        new = a != b
        if new.any():
            node, root = forest(a[new], b[new])
            to = np.arange(len(t))
            to[node] = root
            label = to[label]
            yield pa.RecordBatch.from_arrays([pa.array(key[node]), pa.array(key[root])], names=["a", "b"])


class _Sets:
    """The shingle sets of a group's classes."""

    def __init__(self, t: pa.Table):
        self.size = t.column("size").to_numpy()
        flat = t.column("s").combine_chunks().flatten().to_numpy()
        self.number = np.unique(flat, return_inverse=True)[1]
        self.of = np.split(self.number, np.cumsum(self.size)[:-1])
        self.member = None

    def shared(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many shingles each of ``at`` shares with k."""
        if len(at) <= 16:
            return np.array([len(np.intersect1d(self.of[k], self.of[x], assume_unique=True)) for x in at], np.int64)
        if self.member is None:
            self.member = np.repeat(np.arange(len(self.size)), self.size)[np.argsort(self.number, kind="stable")]
            self.first = np.concatenate([[0], np.cumsum(np.bincount(self.number))])
        begin, n = self.first[self.of[k]], self.first[self.of[k] + 1] - self.first[self.of[k]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(self.member[np.repeat(begin, n) + step], minlength=len(self.size))[at]

    def alike(self, k: int, at: np.ndarray) -> np.ndarray:
        """Those of ``at`` that are near copies of k."""
        n = self.shared(k, at)
        return at[n >= THRESHOLD * (self.size[at] + self.size[k] - n) - 1e-9]


def _verified(t: pa.Table, budgets: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a group that join what is alike and not joined yet; never all pairs."""
    key, label, sets = t.column("key").to_numpy(), np.arange(len(t)), _Sets(t)
    left, right = [], []

    def join(k: int, at: np.ndarray) -> None:
        new, one = np.unique(label[at], return_index=True)
        left.extend([key[k]] * len(new))
        right.extend(key[at[one]].tolist())
        label[np.isin(label, new)] = label[k]

    for i, j, d in _candidates(t, budgets):
        order = np.lexsort((d, i))
        i, j = i[order], j[order]
        cut = np.flatnonzero(i[1:] != i[:-1]) + 1
        for k, at in zip(i[np.concatenate([[0], cut])].tolist(), np.split(j, cut)):
            # The nearest class of each component; then all of those components that it didn't join.
            for nearest in (True, False):
                at = at[label[at] != label[k]]
                if len(at):
                    join(k, sets.alike(k, at[np.unique(label[at], return_index=True)[1]] if nearest else at))
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, int] = BUDGETS, block: int | None = None, broadcast_rows: int = 1 << 20) -> DataFrame:
    """One row per input row: _i, _h (xxhash64 of the text), _c (the component's least class)."""
    rows = written(docs.select(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"), _sketch(F.col(text_col)).alias("s")).select("_i", "_h", "s.*"), "sketches")
    classes = written(rows.dropDuplicates(["key"]).select("key", "size", "fp"), "classes")
    near = written(_met(_by_size(classes, block)).mapInArrow(_by_group(partial(_reached, budgets=budgets)), "a long, b long"), "near")
    groups = written(components(near).select(F.col("node").alias("key"), F.col("root").alias("band")).join(classes, "key"), "groups")
    sets = _sets(groups.select("key"), docs, rows, id_col, text_col, broadcast_rows)
    # A task holds two blocks: of at most ``block`` classes, and of about BLOCK_SHINGLES shingles.
    blocks = written(groups.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / (block or 1024)), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n")), "blocks")
    cut = groups.join(blocks, "band").select("*", F.pmod(F.xxhash64("key"), F.col("n")).cast("int").alias("own"), F.lit(0).alias("from"), (F.col("n") - 1).alias("to")).drop("n")
    links = written(_met(cut.join(sets, "key")).mapInArrow(_by_group(partial(_verified, budgets=budgets)), "a long, b long"), "links")
    comps = written(components(links).select(F.col("node").alias("key"), F.col("root").alias("comp")).where("key <> comp"), "comps")
    drop(classes, near, groups, sets, blocks, links)
    return rows.select("_i", "_h", "key").join(comps, "key", "left").select("_i", "_h", F.coalesce("comp", "key").alias("_c"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, int] = BUDGETS, block: int | None = None, broadcast_rows: int = 1 << 20) -> DataFrame:
    """The documents with one row of each component left, whatever its ids are: the row of least non-null id."""
    return one_row_each(docs, found(docs, id_col, text_col, budgets, block, broadcast_rows), id_col, text_col, broadcast_rows)
