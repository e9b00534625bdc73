"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One logistic classifier per bit reads the hashed byte n-grams (1 to 3 bytes,
ASCII letters lower-cased, everything else in ASCII as a space) of a window of ``WINDOW`` bytes; windows cover the whole
text. Decoding adds up, for each language, the logistic losses of the bits against its codeword, each weighted by that
bit's accuracy on the fitting windows; the soft-max over languages is the window's share of each. A text takes the
language of the greatest mean share over its windows, weighted by their letters, so a passage in another language counts
by its length; ``score`` is that mean, and ``ambiguous`` marks a text whose runner-up lies within ``margin`` of it.

Fitting reads at most about ``per_lang`` texts of each language (fewer where ``fit_bytes`` for all languages together
would not do), drawn by a hash of id and text, and ``fit_windows`` evenly spaced windows of each; equal rows count once.
These bounds are parameters and bind fitting only. Prediction reads every window of every text.

Defined results: null, empty and letterless texts get ``und`` with score 0.0; with no labelled rows at all every text
is ``und``; ties between languages go to the one first in order of name; repeated rows each get their own result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lithoframe.llm.textarr import publish, utf8

BITS = 11
DIM = 1 << BITS
WINDOW = 384
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of a text: unit-length square-root frequencies of its hashed byte n-grams, and how many bytes are letters."""
    e = np.concatenate([_FOLD[32:33], _FOLD[b], _FOLD[32:33]])
    n = max(1, -(-len(b) // WINDOW))
    at = np.minimum(np.arange(len(e)) // WINDOW, n - 1) * DIM
    total = np.zeros(n * DIM, np.int64)
    g = e
    for k, salt in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        if k > 1:
            g = (g[:-1] << np.uint32(8)) | e[k - 1 :]
        total += np.bincount(at[: len(g)] + ((g * np.uint32(salt)) >> np.uint32(32 - BITS)).astype(np.int64), minlength=n * DIM)
    x = np.sqrt(total.reshape(n, DIM), dtype=np.float32)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return x, np.bincount(at // DIM, weights=e != 32, minlength=n)


def has_letter(b: np.ndarray | None) -> bool:
    if b is None or not len(b):
        return False
    if ((b >= 65) & (b <= 90) | (b >= 97) & (b <= 122)).any():
        return True
    return bool((b >= 128).any()) and _LETTER.search(bytes(b).decode("utf-8", "replace")) is not None


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: exhaustive up to seven languages, else the random dense code of greatest distance among 200."""
    if k <= 7:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(cols, np.int8).T.reshape(k, -1)
    rng, width, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(200):
        m = rng.choice(np.array([1, -1], np.int8), (k, width))
        m = m[:, np.abs(m.sum(0)) < k]
        far = ((m[:, None] != m[None]).sum(2) + np.eye(k, dtype=int) * width).min()
        if best is None or far > best[0]:
            best = (far, m)
    return best[1]


class Ecoc:
    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, weight: np.ndarray):
        self.langs, self.code, self.w, self.bias, self.weight = langs, code, w, bias, weight

    @property
    def size(self) -> int:
        return self.w.nbytes + self.code.nbytes

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Of feature rows: the soft-max share of each language."""
        z = x @ self.w + self.bias
        loss = np.zeros((len(x), len(self.langs)))
        for k in range(len(self.langs)):
            loss[:, k] = (np.logaddexp(0, -z * self.code[k]) * self.weight).sum(1)
        p = np.exp((loss.min(1, keepdims=True) - loss) * (4 / len(self.weight)))  # softened: bits of one text err together
        return p / p.sum(1, keepdims=True)

    def decode(self, b: np.ndarray, margin: float, block: int = 1 << 18) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous, of a whole text taken in blocks of whole windows."""
        total, weight, step = np.zeros(len(self.langs)), 0.0, block // WINDOW * WINDOW
        for at in range(0, max(1, len(b)), step):
            x, letters = features(b[at : at + step])
            total += letters @ self.shares(x)
            weight += float(letters.sum())
        p = total / max(weight, 1e-9)
        top = np.sort(p)
        return self.langs[int(p.argmax())], float(min(1.0, top[-1])), bool(len(p) > 1 and top[-1] - top[-2] < margin)


def fit_matrix(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 120, l2: float = 1e-6) -> Ecoc:
    """One logistic classifier for each bit, by Adam over all rows."""
    if len(langs) == 1:
        return Ecoc(langs, np.ones((1, 1), np.int8), np.zeros((x.shape[1], 1), np.float32), np.ones(1, np.float32), np.ones(1))
    code = codewords(len(langs))
    t = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(langs)).astype(np.float32)
    weight = (len(y) / (len(langs) * share[y]))[:, None]  # each language counts the same
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for k in range(1, steps + 1):
        z = x @ w + b
        g = -t / (1 + np.exp(np.clip(t * z, -30, 30))) * weight / len(x)
        gw, gb = x.T @ g + l2 * w, g.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        lr = 0.5 / (1 + k / 40)
        w = w - lr * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        b = b - lr * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    right = ((x @ w + b) * t > 0).mean(0)
    weight = np.maximum(2 * right - 1, 0.05)
    return Ecoc(langs, code, w.astype(np.float32), b.astype(np.float32), weight / weight.sum() * len(weight))


def _packed(fit_windows: int):
    @F.arrow_udf(BinaryType())
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            out = []
            for b in utf8(arr):
                if not has_letter(b):
                    out.append(None)
                    continue
                n = -(-len(b) // WINDOW)
                pick = np.unique(np.linspace(0, n - 1, min(n, fit_windows)).round().astype(int))
                x = np.concatenate([features(b[k * WINDOW : (k + 1) * WINDOW])[0] for k in pick])
                out.append(x.astype(np.float16).tobytes())
            yield pa.array(out, pa.binary())

    return run


def sample(docs: DataFrame, text_col: str, label_col: str, id_col: str, per_lang: int = 600, max_langs: int = 500, fit_windows: int = 4, fit_bytes: int = 96 << 20) -> list:
    """At most about ``per_lang`` rows (i, l, x) of each language on the driver, and at most about ``fit_bytes`` in all: a window takes 4 KB."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).where("l is not null and t is not null")
    # Rows are drawn, not ids, so an id on many rows weighs as they do; equal rows are drawn together and count once.
    rows = rows.withColumn("key", F.xxhash64(F.col("i").cast("string"), F.col("t"), F.lit("langid")))
    counts = sorted((r.l, r.n) for r in rows.groupBy("l").agg(F.approx_count_distinct("key").alias("n")).limit(max_langs + 1).collect())
    if not counts:
        return []
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    most = max(1, min(per_lang, fit_bytes // (len(counts) * fit_windows * DIM * 2)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, most / max(n, 1)))]), F.col("l"))
    drawn = rows.where(F.pmod(F.col("key"), F.lit(1 << 30)) / float(1 << 30) < share)
    once = drawn.dropDuplicates(["l", "key"]).select("i", "l", _packed(fit_windows)("t").alias("x")).where("x is not null").collect()
    return sorted(once, key=lambda r: (r.l, str(r.i), bytes(r.x)))


def fit(docs: DataFrame, text_col: str, label_col: str, id_col: str, **bounds) -> Ecoc | None:
    """Fit on a bounded sample of the labelled rows given; ``bounds`` are those of ``sample``."""
    rows = sample(docs, text_col, label_col, id_col, **bounds)
    if not rows:
        return None
    langs = sorted({r.l for r in rows})
    at = {lang: k for k, lang in enumerate(langs)}
    rows_of = [np.frombuffer(r.x, np.float16).reshape(-1, DIM) for r in rows]
    y = np.repeat([at[r.l] for r in rows], [len(x) for x in rows_of])
    return fit_matrix(np.concatenate(rows_of).astype(np.float32), y, langs)


def predict(text: F.Column, model: Ecoc | None, spark, margin: float = 0.1) -> F.Column:
    """A struct column: lang_pred, score, ambiguous."""
    shared = publish(spark, model, model.size if model else 0)

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for arr in it:
            names, scores, unsure = [UND] * len(arr), np.zeros(len(arr)), np.ones(len(arr), bool)
            for n, b in enumerate(utf8(arr)):
                if m is not None and has_letter(b):
                    names[n], scores[n], unsure[n] = m.decode(b, margin)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)], names=["lang_pred", "score", "ambiguous"])

    return run(text)


def identify(docs: DataFrame, model: Ecoc | None, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.1) -> DataFrame:
    """One row per input row: id, lang_pred, score, ambiguous."""
    return docs.select(F.col(id_col), predict(F.col(text_col), model, docs.sparkSession, margin).alias("p")).select(id_col, "p.*")
