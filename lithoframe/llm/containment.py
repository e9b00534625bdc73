"""Benchmark decontamination: short test items found inside whole documents.

Texts are lower-cased word sequences (runs of letters and digits). An item is its set of five-word shingles; one with
fewer words is a single shingle, its whole word sequence. It is contained in a document when at least ``threshold`` of
its shingles occur there.

The search partitions the items by size (number of shingles, in powers of two) and keeps of each item the bottom-k
MinHash sketch with the k that its partition needs: among the k = floor((1 - threshold) * upper) + 1 smallest shingle
hashes at least one must occur in any document that contains the item, so no containment is missed, however long the
document. Every shingle of a document is looked up among the sketches; each candidate is then verified on the shingles
themselves. The sketches are broadcast when they and the items' texts fit ``broadcast_bytes``, measured first; beyond
that the look-up is a join on shingle hashes.

Defined results: null and wordless texts hold no item, and null and wordless items are found nowhere; equal items with
different ids are each reported; a repeated (item id, text) row counts once; repeated document rows are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.components import written
from lithoframe.llm.textarr import BROADCAST_BYTES, NONE, HashTable, pieces_of, publish, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
#: Into how many parts the texts that share a shingle are cut in the joined form.
SALTS = 16


def shingle_set(text: str | None, n: int = SHINGLE) -> frozenset[str]:
    """The distinct shingles of an item, as text."""
    s, e, _, low = words(text or "")
    w = [low[a:b] for a, b in zip(s.tolist(), e.tolist())]
    if not w:
        return frozenset()
    n = min(n, len(w))
    return frozenset(" ".join(w[k : k + n]) for k in range(len(w) - n + 1))


def needed(size: int, threshold: float) -> int:
    """The least number of shared shingles."""
    k = max(1, int(np.floor(threshold * size)))
    return k if k >= threshold * size - 1e-9 else k + 1


def sketch(text: str | None, n: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[np.ndarray, int, int]:
    """Bottom-k hashes of an item, its number of shingles, and the words in a shingle."""
    _, _, h, _ = words(text or "")
    if not len(h):
        return np.zeros(0, np.uint64), 0, 0
    n = min(n, len(h))
    g = np.unique(shingles(h, n))
    upper = 1 << int(len(g) - 1).bit_length()
    return g[: upper - needed(upper, threshold) + 1], len(g), n


class Items:
    """The sketches of all items in one table, with the items' shingles for verification."""

    def __init__(self, rows: list[tuple], n: int, threshold: float):
        self.n, self.threshold = n, threshold
        self.ids, self.sets, keys, owner, self.lengths = [], [], [], [], set()
        for i, text in rows:
            g, size, width = sketch(text, n, threshold)
            if size:
                keys.append(g)
                owner.append(np.full(len(g), len(self.ids)))
                self.ids.append(i)
                self.sets.append(shingle_set(text, n))
                self.lengths.add(width)
        k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        o = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(k, kind="stable")
        distinct, at = np.unique(k[order], return_index=True)
        self.owner, self.at = o[order], np.append(at, len(o))
        self.table = HashTable(distinct, np.arange(len(distinct)), mixed=True)

    @property
    def size(self) -> int:
        return sum(2 * len(x) + 100 for s in self.sets for x in s) + self.table.keys.nbytes + self.table.values.nbytes + self.owner.nbytes * 2

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """Items contained in a whole text: place, shingles, shared shingles."""
        if not text or not self.ids:
            return []
        s, e, h, low = words(text)
        hits: set[int] = set()
        for n in self.lengths:
            g = self.table.get(shingles(h, n))
            for k in np.unique(g[g != NONE]).tolist():
                hits.update(self.owner[self.at[k] : self.at[k + 1]].tolist())
        if not hits:
            return []
        w, own, out = [low[a:b] for a, b in zip(s.tolist(), e.tolist())], {}, []
        for k in sorted(hits):
            n = self.sets[k].__iter__().__next__().count(" ") + 1
            if n not in own:
                own[n] = {" ".join(w[j : j + n]) for j in range(len(w) - n + 1)}
            shared = len(self.sets[k] & own[n])
            if shared >= needed(len(self.sets[k]), self.threshold):
                out.append((k, len(self.sets[k]), shared))
        return out


def _clean(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where("item_text is not null").distinct()


def load_items(items: DataFrame, item_id: str, item_text: str, n: int, threshold: float, broadcast_bytes: int = BROADCAST_BYTES):
    """The items broadcast, or None where they are over the bound."""
    rows = _clean(items, item_id, item_text)
    size, count = rows.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0)), F.count(F.lit(1))).first()
    if size * 40 + count * 1000 > broadcast_bytes * 8:  # far over it: don't even gather them
        return None
    got = Items(sorted(((r.item_id, r.item_text) for r in rows.collect()), key=lambda r: (r[0] is None, r[0], r[1])), n, threshold)
    return publish(items.sparkSession, got, got.size) if got.size <= broadcast_bytes else None


def holds_item(text: Column, model) -> Column:
    """Whether a whole text holds any of the items of ``load_items``."""

    @F.arrow_udf("boolean")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for arr in it:
            yield pa.array([bool(m.found(t)) for part in pieces_of(arr) for t in part.to_pylist()], pa.bool_())

    return run(text)


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row and item contained in it: id, item id, item_shingles, shared, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("doc_text"))
    kind = items.schema[item_id].dataType
    model = load_items(items, item_id, item_text, n, threshold, broadcast_bytes)
    if model is None:
        return _joined(rows, _clean(items, item_id, item_text), n, threshold)
    ids = spark.createDataFrame([(k, v) for k, v in enumerate(model.value.ids)], f"place int, item_id {kind.simpleString()}")

    @F.arrow_udf("array<struct<place:int,item_shingles:long,shared:long>>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        out = pa.list_(pa.struct([("place", pa.int32()), ("item_shingles", pa.int64()), ("shared", pa.int64())]))
        for arr in it:
            yield pa.array([[{"place": k, "item_shingles": a, "shared": b} for k, a, b in m.found(t)] for part in pieces_of(arr) for t in part.to_pylist()], out)

    hits = rows.select("doc_id", F.explode(run("doc_text")).alias("f")).select("doc_id", "f.*")
    # Places and ids of the broadcast items, so of a size checked already.
    return hits.join(F.broadcast(ids), "place").select("doc_id", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def _joined(rows: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """The look-up as a join on shingle hashes, for items over the broadcast bound."""

    @F.arrow_udf("struct<keys:array<long>,width:int>")
    def keys(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            got = [sketch(t, n, threshold) for t in arr.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([g.view(np.int64) for g, _, _ in got], pa.list_(pa.int64())), pa.array([w for _, _, w in got], pa.int32())], names=["keys", "width"])

    @F.arrow_udf("array<long>")
    def all_keys(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            out = []
            for part in pieces_of(arr):
                for t in part.to_pylist():
                    h = words(t or "")[2]
                    out.append(np.unique(np.concatenate([shingles(h, k) for k in range(1, n + 1)])).view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    @F.arrow_udf("struct<item_shingles:long,shared:long>")
    def verify(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for docs, texts in it:
            a, b = [], []
            for d, t in zip(docs.to_pylist(), texts.to_pylist()):
                own = shingle_set(t, n)
                width = next(iter(own)).count(" ") + 1
                s, e, _, low = words(d)
                w = [low[x:y] for x, y in zip(s.tolist(), e.tolist())]
                a.append(len(own))
                b.append(len(own & {" ".join(w[k : k + width]) for k in range(len(w) - width + 1)}))
            yield pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["item_shingles", "shared"])

    # Equal texts are one class, named by two hashes of the text, so a task that is run again names it alike.
    keyed = rows.withColumn("row", F.struct(F.xxhash64("doc_text").alias("x"), F.md5(F.col("doc_text").cast("binary")).alias("m")))
    classes = keyed.dropDuplicates(["row"]).select("row", "doc_text")
    placed = items.withColumn("place", F.xxhash64("item_id", "item_text"))
    right = written(placed.select("place", F.explode(keys("item_text")["keys"]).alias("key")), "item_keys")
    # A shingle that very many texts have is a hot key: its items are sent to each of SALTS parts of those texts.
    salt = F.pmod(F.col("row.x"), F.lit(SALTS)).cast("int")
    left = classes.select("row", F.explode(all_keys("doc_text")).alias("key")).withColumn("salt", salt)
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = written(left.join(salted, ["key", "salt"]).select("row", "place").distinct(), "met")
    both = pairs.join(keyed, "row").join(placed, "place").select("doc_id", "item_id", verify("doc_text", "item_text").alias("f")).select("doc_id", "item_id", "f.*")
    return both.where(F.col("shared") >= F.lit(threshold) * F.col("item_shingles") - 1e-9).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that hold no item; columns stay as they are."""
    model = load_items(items, item_id, item_text, n, threshold, broadcast_bytes)
    if model is not None:
        return docs.where(~holds_item(F.col(text_col), model))
    # Rows are told apart by id and text, so that both forms judge each row by its own text.
    rows = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("doc_id"), F.col(text_col).alias("doc_text"))
    found = _joined(rows, _clean(items, item_id, item_text), n, threshold).select(F.col("doc_id.i").alias("_found"), F.col("doc_id.h").alias("_hash")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_found"]) & (F.xxhash64(docs[text_col]) == found["_hash"]), "left_anti")


#: The query's rows in DuckDB: every shingle of every document against every item's shingles.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id, text, w, least(5, len(w)) AS n FROM i WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, text, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
docs AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM n))),
size AS (SELECT item_id, text, count(*) AS total FROM items GROUP BY item_id, text),
hit AS (SELECT doc_id, items.item_id, items.text, count(*) AS shared FROM items JOIN docs USING (n, s) GROUP BY doc_id, items.item_id, items.text)
SELECT doc_id, hit.item_id, total AS item_shingles, shared, shared / total AS containment FROM hit JOIN size ON hit.item_id = size.item_id AND hit.text = size.text WHERE shared >= 0.8 * total - 1e-9"""
