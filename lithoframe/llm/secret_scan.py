"""Secret scan: fixed credential patterns, plus zstandard novelty of strings in sensitive contexts.

Base kinds (leftmost, non-overlapping within a kind): ``assign``, ``access``, ``hex``. Each base span stays as found.
The novelty kind measures how many bytes a candidate adds to a zstandard frame whose raw dictionary holds a list of
common identifiers and the text around the candidate. A string that repeats or resembles its surroundings adds few
bytes; a key adds about its own length, or as much as a random string of its alphabet does. Candidates stand within
``reach`` characters after a sensitive word, are at least ``least`` characters long, mix letters and digits (or, without
digits, change between upper and lower case more often than joined words do), and overlap no base span.

Defined results: null text is read as empty; empty text has no spans; texts are scanned whole whatever their length;
repeated rows each get their own result; an empty table gives an empty result. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.textarr import pieces_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE_WORDS = ASSIGN_WORDS + ("credential", "private_key", "privatekey", "access_key", "accesskey", "bearer", "authorization", "pwd", "passphrase")
SENSITIVE = re.compile("(?ai:" + "|".join(SENSITIVE_WORDS) + ")")
TOKEN = re.compile(r"[A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]*")
#: Identifiers and words that stand beside credentials without being any.
IDENTIFIERS = (
    "access_key access_token account api_key apikey auth authorization bearer client_id client_secret config connection credential "
    "database default docker endpoint environment example export function github import localhost login oauth options password "
    "passphrase passwd private_key production public_key redis refresh_token region request response secret secret_key security "
    "server service session signature staging string tenant token undefined username variable version webhook your_api_key_here "
    "YOUR_TOKEN_HERE changeme placeholder 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx ________________ "
)


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed kinds as (start, kind's place, end)."""
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: Alphabets of keys, the narrowest first.
ALPHABETS = tuple((re.compile(f"[{c}]+"), signs) for c, signs in (
    ("0-9a-f", "0123456789abcdef"), ("0-9A-F", "0123456789ABCDEF"), ("A-Z0-9=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("a-z0-9", "abcdefghijklmnopqrstuvwxyz0123456789"), ("A-Za-z0-9+/_.=-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
))


def _added(value: bytes, prime: bytes) -> int:
    import zstandard as z

    d = z.ZstdCompressionDict(prime, dict_type=z.DICT_TYPE_RAWCONTENT)
    params = z.ZstdCompressionParameters.from_level(19, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=20)
    c = z.ZstdCompressor(dict_data=d, compression_params=params)
    return len(c.compress(value)) - len(c.compress(b""))


@lru_cache(4096)
def random_added(alphabet: int, length: int) -> int:
    """The bytes that a random string of an alphabet and length adds."""
    return _added("".join(random.Random(length).choices(ALPHABETS[alphabet][1], k=length)).encode(), IDENTIFIERS.encode())


def mixed(value: str) -> bool:
    """Whether a string's signs may be a key's: letters and digits, or cases that change at more than 0.4 of its places."""
    if not re.search("[A-Za-z]", value):
        return False
    if re.search("[0-9]", value):
        return True
    return sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:])) > 0.4 * (len(value) - 1)


class Novelty:
    """Marginal compressed bytes of a candidate, given the identifiers and the text around it.

    It is novel if it adds ``ratio`` of its length, or ``likeness`` of what a random string of its alphabet and length
    adds: zstandard codes the signs of long strings in fewer bits. Other copies of it are no part of the text around it,
    unless ``common`` of them or more stand there away from sensitive words.
    """

    def __init__(self, least: int = 16, reach: int = 64, around: int = 1024, ratio: float = 0.8, likeness: float = 0.9, common: int = 8):
        self.least, self.reach, self.around, self.ratio, self.likeness, self.common = least, reach, around, ratio, likeness, common

    def surroundings(self, text: str, start: int, end: int) -> str:
        """The text after and before a candidate without its other copies, whole or cut by the window's edge."""
        own, n = text[start:end], end - start
        lo, hi = max(0, start - self.around - n), min(len(text), end + self.around + n)
        before, after = text[lo:start], text[end:hi]
        if own not in before and own not in after:
            return text[end : end + self.around] + text[max(0, start - self.around) : start]
        copies = [m.start() for m in re.finditer(re.escape(own), text[lo:hi]) if m.start() + lo != start]
        ordinary = sum(1 for k in copies if not SENSITIVE.search(text, max(0, lo + k - self.reach - 16), lo + k))
        if ordinary >= self.common:
            return text[end : end + self.around] + text[max(0, start - self.around) : start]
        before, after = before.replace(own, ""), after.replace(own, "")
        return (after[: max(0, len(after) - n)] if hi < len(text) else after) + (before[n:] if lo > 0 else before)

    def added(self, text: str, start: int, end: int) -> int:
        return _added(text[start:end].encode(), (IDENTIFIERS + self.surroundings(text, start, end)).encode("utf-8", "replace"))

    def novel(self, text: str, start: int, end: int) -> bool:
        got, n = self.added(text, start, end), end - start
        if got >= self.ratio * n:
            return True
        kind = next(k for k, (signs, _) in enumerate(ALPHABETS) if signs.fullmatch(text, start, end))
        return got >= self.likeness * random_added(kind, n)

    def spans(self, text: str, low: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
        if not any(w in low for w in SENSITIVE_WORDS):
            return []
        found, done = [], 0
        for m in SENSITIVE.finditer(text):
            for t in TOKEN.finditer(text, max(m.end(), done)):
                if t.start() > m.end() + self.reach:
                    break
                s, e = t.span()
                done = max(done, e)
                if s > 0 and re.match("[A-Za-z0-9_]", text[s - 1]):  # the rest of a token that began within the sensitive word
                    continue
                v = t.group()
                if e - s < self.least or not mixed(v):
                    continue
                if any(a < e and s < b for a, _, b in taken):
                    continue
                if self.novel(text, s, e):
                    found.append((s, 3, e))
        return found


def scan_text(text: str | None, novelty: Novelty) -> tuple[list, list]:
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    return base, novelty.spans(text, low, base)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: F.Column, **settings) -> F.Column:
    """A struct column: counts by kind, base_sha256 and spans (kind:start:end by start, then kind, comma-joined)."""

    @F.arrow_udf("struct<n_assign:long,n_access:long,n_hex:long,n_novel:long,base_sha256:string,spans:string>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(**settings)
        for arr in it:
            rows = []
            for part in pieces_of(arr):
                for t in part.to_pylist():
                    base, more = scan_text(t, novelty)
                    n = [sum(1 for x in base if x[1] == k) for k in range(3)]
                    rows.append((*n, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return run(text)


def redact(text: F.Column, mark: str = "[SECRET]", **settings) -> F.Column:
    """The text with each span, or run of overlapping spans, replaced by the mark; null stays null."""

    @F.arrow_udf("string")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(**settings)
        for arr in it:
            out = []
            for part in pieces_of(arr):
                for t in part.to_pylist():
                    base, more = scan_text(t, novelty)
                    merged: list[list[int]] = []
                    for s, _, e in sorted(base + more):
                        if merged and s < merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in reversed(merged):
                        t = t[:s] + mark + t[e:]
                    out.append(t)
            yield pa.array(out, pa.string())

    return run(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: the id, counts by kind, digest of the base spans, and all spans."""
    return docs.select(F.col(id_col), scan(F.col(text_col), **settings).alias("found")).select(id_col, "found.*")
