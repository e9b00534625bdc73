"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages: consecutive windows of ``PASSAGE`` UTF-8 bytes that cover the whole text. Each passage
is encoded as shares of byte-class bigrams plus a few counts (among them words that repeat their predecessor), embedded by a hidden layer, and weighted by gated
attention, softmax over passages of ``w . (tanh(V h) * sigmoid(U h))``; a logistic unit scores the weighted passage
representation. Weights are learned from document labels alone, by Adam over minibatches of whole bags.

Fitting reads a sample of at most about ``max_docs`` labelled rows, drawn by a hash of the id and then by one of id and
text (so an id on many rows can't exceed it; equal rows count once), and of a bag with more than ``max_passages``
passages it uses that many, evenly spaced; both bounds are parameters and bind fitting only.
Scoring reads every passage of every whole text, a block of passages at a time with a running softmax.

Defined results: null and empty texts are a bag of one empty passage and are scored like any other; with no labelled
rows every score is 0.5; with labels of one class every score is that class; repeated rows each get their own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lithoframe.llm.textarr import publish, span_hashes, utf8

PASSAGE = 256
CLASSES = 20
_CLASS = np.full(256, 12, np.int64)  # other ASCII signs
_CLASS[97:123] = 0
for _c in b"aeiou":
    _CLASS[_c] = 1
_CLASS[65:91] = 2
for _c in b"AEIOU":
    _CLASS[_c] = 3
_CLASS[48:58] = 4
_CLASS[128:192] = 5
_CLASS[192:] = 6
for _k, _s in ((7, b" "), (8, b"\n\r"), (9, b"."), (10, b","), (11, b"\t\x0b\x0c"), (13, b"!?"), (14, b"|"), (15, b"%&$#*@^~"), (16, b"'\"`"), (17, b"-_"), (18, b"()[]{}<>"), (19, b":;=/\\+")):
    for _c in _s:
        _CLASS[_c] = _k
#: Class bigrams, class shares, then: fill, word length, lines, words that repeat their predecessor, emptiness.
DIM = CLASSES * CLASSES + CLASSES + 5
_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def encode(b: np.ndarray | None) -> np.ndarray:
    """Float32 passages x DIM of a whole text."""
    if b is None or not len(b):
        x = np.zeros((1, DIM), np.float32)
        x[0, -1] = 1
        return x
    n = -(-len(b) // PASSAGE)
    c = _CLASS[b]
    at = np.arange(len(b)) // PASSAGE
    uni = np.bincount(at * CLASSES + c, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    pair = c[:-1] * CLASSES + c[1:]
    bi = np.bincount(at[1:] * (CLASSES * CLASSES) + pair, minlength=n * CLASSES * CLASSES).reshape(n, -1).astype(np.float32)
    size = uni.sum(1, keepdims=True)
    x = np.empty((n, DIM), np.float32)
    x[:, : CLASSES * CLASSES] = np.sqrt(bi / size)
    x[:, CLASSES * CLASSES : -5] = np.sqrt(uni / size)
    x[:, -5] = size[:, 0] / PASSAGE
    gaps = uni[:, 7] + uni[:, 8] + uni[:, 11] + 1
    x[:, -4] = np.log1p(size[:, 0] / gaps)
    x[:, -3] = np.log1p(uni[:, 8])
    edge = np.flatnonzero(np.diff((~_GAP[b]).view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    h = span_hashes(b, starts, ends)
    again = starts[1:][h[1:] == h[:-1]] // PASSAGE
    words = np.bincount(starts // PASSAGE, minlength=n)
    x[:, -2] = np.bincount(again, minlength=n) / np.maximum(words, 1)
    x[:, -1] = 0
    return x


class Attention:
    """The weights: embedding, gated attention and output."""

    NAMES = ("E", "e", "V", "U", "w", "c", "d")

    def __init__(self, hidden: int = 24, att: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.E, self.e, self.V, self.U = g(DIM, hidden), np.zeros(hidden, np.float32), g(hidden, att), g(hidden, att)
        self.w, self.c, self.d = g(att, 1)[:, 0], g(hidden, 1)[:, 0], np.zeros(1, np.float32)
        self.constant: float | None = None

    @property
    def size(self) -> int:
        return sum(getattr(self, n).nbytes for n in self.NAMES)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.maximum(x @ self.E + self.e, 0)
        t, s = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        return h, t, s, (t * s) @ self.w

    def score(self, b: np.ndarray | None, block: int = 1 << 20) -> float:
        """The score of a whole text, in blocks of its bytes with a running softmax."""
        if self.constant is not None:
            return self.constant
        top, norm, z = -np.inf, 0.0, 0.0
        for at in range(0, max(1, 0 if b is None else len(b)), block):
            h, _, _, a = self.forward(encode(b if b is None else b[at : at + block]))
            new = max(top, float(a.max()))
            p, keep = np.exp(a - new), float(np.exp(top - new))
            norm, z, top = norm * keep + float(p.sum()), z * keep + p @ h, new
        return float(1 / (1 + np.exp(-((z / norm) @ self.c + self.d[0]))))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, l2: float = 1e-4, seed: int = 11) -> Attention:
        rng = np.random.default_rng(seed)
        state = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES}
        step, total = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                x = np.concatenate([bags[k] for k in take])
                first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in take])])[:-1]
                bag = np.repeat(np.arange(len(take)), [len(bags[k]) for k in take])
                h, t, s, a = self.forward(x)
                p = np.exp(a - np.maximum.reduceat(a, first)[bag])
                p /= np.add.reduceat(p, first)[bag]
                z = np.add.reduceat(p[:, None] * h, first)
                out = 1 / (1 + np.exp(-(z @ self.c + self.d[0])))
                dout = ((out - y[take]) / len(take)).astype(np.float32)
                g = {"c": z.T @ dout, "d": dout.sum(keepdims=True)}
                dz = (dout[:, None] * self.c)[bag]
                dp = (dz * h).sum(1)
                da = p * (dp - np.add.reduceat(p * dp, first)[bag])
                g["w"] = (t * s).T @ da
                dts = da[:, None] * self.w
                dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
                g["V"], g["U"] = h.T @ dt, h.T @ ds
                dh = (p[:, None] * dz + dt @ self.V.T + ds @ self.U.T) * (h > 0)
                g["E"], g["e"] = x.T @ dh, dh.sum(0)
                step += 1
                lr = 0.01 * (1 - 0.95 * step / total)
                for n in self.NAMES:
                    w, (m, v) = getattr(self, n), state[n]
                    grad = g[n] + (l2 * w if n in "EVUwc" else 0)
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    setattr(self, n, (w - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        return self


def _bags(max_passages: int):
    @F.arrow_udf(BinaryType())
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            out = []
            for b in utf8(arr):
                x = encode(b)
                if len(x) > max_passages:
                    x = x[np.linspace(0, len(x) - 1, max_passages).round().astype(int)]
                out.append(x.astype(np.float16).tobytes())
            yield pa.array(out, pa.binary())

    return run


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 3000, max_passages: int = 32) -> list:
    """At most about max_docs rows (i, y, x) on the driver, each of up to max_passages passages (0.9 KB each)."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))

    def drawn(key: F.Column, n: int) -> F.Column:
        return F.pmod(key, F.lit(1 << 30)) / float(1 << 30) < min(1.0, max_docs / max(n, 1))

    picked = F.broadcast(known.where(drawn(F.xxhash64(F.col("i").cast("string"), F.lit("quality")), known.count())))
    key = F.xxhash64(F.col("i").cast("string"), F.col("t"), F.lit("rows"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(picked, "i").withColumn("key", key)
    once = rows.where(drawn(F.col("key"), rows.select(F.approx_count_distinct("key")).first()[0])).dropDuplicates(["i", "key"]).select("i", "y", _bags(max_passages)("t").alias("x")).collect()
    return sorted(once, key=lambda r: (str(r.i), bytes(r.x)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 3000, max_passages: int = 32, **settings) -> Attention:
    """Fit on a bounded sample of the rows that have a label."""
    rows = sample(docs, labels, id_col, text_col, label_col, max_docs, max_passages)
    model = Attention()
    if len({r.y for r in rows}) < 2:
        model.constant = float(rows[0].y) if rows else 0.5
        return model
    return model.fit([np.frombuffer(r.x, np.float16).reshape(-1, DIM).astype(np.float32) for r in rows], np.array([r.y for r in rows], np.float32), **settings)


def score(text: F.Column, model: Attention, spark) -> F.Column:
    """Score of each whole text, 0 to 1; higher means that label 1 is likelier."""
    shared = publish(spark, model, model.size)

    @F.arrow_udf("double")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for arr in it:
            yield pa.array([m.score(b) for b in utf8(arr)], pa.float64())

    return run(text)


def good_documents(docs: DataFrame, model: Attention, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents that the model doesn't reject; columns stay as they are."""
    return docs.where(score(F.col(text_col), model, docs.sparkSession) >= least)
