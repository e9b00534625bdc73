"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

``Transducer.compile`` reads a model file and builds, once, on the driver:

* the normaliser: the model's character map (at each place the longest entry is rewritten, read from its double-array
  trie), dummy prefix, removal of extra white space where the model asks for it, and white space as U+2581;
* the lexicon: pieces by a hash of their text, so that the arcs into an input position are found by hash of the last
  1 to ``longest`` code points;
* user-defined pieces: arcs that nothing else crosses (the longest one at a place; in a unigram model an arc with a bonus);
* byte fallback: a code point that no piece covers is an arc that emits the pieces of its UTF-8 bytes;
* arc weights: minus the piece score for a unigram model. A BPE model's segmentation is the only path on which merging
  would never join or regroup two neighbours, so there the transducer is composed with a bigram acceptor of the pairs of
  pieces that merging leaves apart; each prefix of an input then has one path, and it is the shortest.

Each input is composed with it and solved position by position (tropical semiring: weights add along a path, the least
is kept). Where no piece holds U+2581 after another sign, a text falls apart into words that are solved on their own;
the new words of a block of texts are solved in step, as arrays, and kept in a bounded table.

Defined results: null text is read as empty; empty text has no ids and decodes to the empty text; texts of any length
are encoded whole; ties between equal weights go to the longest last piece; repeated rows each get their own result.
A U+2581 in the text itself is encoded as white space, so ``round_trip`` is false there.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.textarr import NONE, HashTable, SpanHasher, mix, pieces_of, publish, span_hashes

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNK = -2
#: In the lexicon: an ending of a piece that is no piece itself.
INNER = 1 << 30
#: The table of pairs holds two to this power.
PAIR_BITS = 18


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            x = b[i]
            i += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        else:
            if kind == 2:
                n, i = varint(i)
            else:
                n = {1: 8, 5: 4}[kind]
            v, i = b[i : i + n], i + n
        yield key >> 3, v


def charmap(blob: bytes) -> dict[bytes, bytes]:
    """The entries of a model's character map: the size of a trie, the trie's units, and the zero-ended texts that its leaves point to."""
    size = int.from_bytes(blob[:4], "little")
    unit, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]

    def children(u: int) -> int:
        return (u >> 10) << ((u & 512) >> 6)

    out: dict[bytes, bytes] = {}
    todo = [(children(int(unit[0])), b"")]
    while todo:
        at, key = todo.pop()
        place = at ^ np.arange(1, 256)
        inside = place[place < len(unit)]
        for k in inside[(unit[inside] & 0x800000FF) == (at ^ inside)].tolist():
            u, longer = int(unit[k]), key + bytes([at ^ k])
            below = k ^ children(u)
            if u >> 8 & 1:
                start = int(unit[below]) & 0x7FFFFFFF
                out[longer] = texts[start : texts.index(b"\0", start)]
            todo.append((below, longer))
    return out


class Rewriter:
    """A character map as a transducer over texts: the longest entry at each place, other signs as they are."""

    def __init__(self, entries: dict[bytes, bytes], keep: re.Pattern | None):
        known = {k.decode(): v.decode() for k, v in entries.items()}
        self.single = str.maketrans({k: v for k, v in known.items() if len(k) == 1})
        self.known, self.keep = known, keep
        long = sorted((k for k in known if len(k) > 1), key=len, reverse=True)
        self.later = frozenset(c for k in long for c in k[1:])
        self.long = re.compile("|".join(map(re.escape, long))) if long else None

    def _plain(self, text: str) -> str:
        if self.long is None or self.later.isdisjoint(text):
            return text.translate(self.single)
        out, at = [], 0
        for m in self.long.finditer(text):
            out += [text[at : m.start()].translate(self.single), self.known[m[0]]]
            at = m.end()
        return "".join(out) + text[at:].translate(self.single)

    def __call__(self, text: str) -> str:
        if self.keep is None:
            return self._plain(text)
        return "".join(x if k % 2 else self._plain(x) for k, x in enumerate(self.keep.split(text)))


class Transducer:
    """A compiled model. Arcs are numbered by ``order``: single signs first, then pieces in the order of merging."""

    @classmethod
    def compile(cls, model: bytes) -> Transducer:
        t = cls()
        pieces: list[tuple[str, float, int]] = []
        t.kind, t.prefix, t.squeeze, entries = UNIGRAM, True, True, {}
        for f, v in _fields(model):
            if f == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif f == 2:
                t.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif f == 3:
                d = dict(_fields(v))
                entries = charmap(d[2]) if d.get(2) else {}
                t.prefix, t.squeeze = bool(d.get(3, 1)), bool(d.get(4, 1))
        if t.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {t.kind} is neither unigram nor BPE")
        t._build(pieces)
        t.rewrite = Rewriter(entries, re.compile(f"({t.user_pattern})") if t.user else None) if entries else None
        return t

    def _build(self, pieces: list[tuple[str, float, int]]) -> None:
        self.unk_id = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_id = np.full(256, self.unk_id, np.int32)
        self.spell: list[bytes] = []
        for k, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = k
                self.spell.append(bytes([int(p[3:5], 16)]))
            else:
                self.spell.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode())
        self.is_byte = np.array([p[2] == BYTE for p in pieces])
        self.spell_size = np.array([len(x) for x in self.spell], np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size
        self.spell_bytes = np.frombuffer(b"".join(self.spell), np.uint8)
        self.has_bytes = bool(self.is_byte.any())
        self.user = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == USER and p}
        self.user_pattern = "|".join(map(re.escape, sorted(self.user, key=len, reverse=True)))
        top = max((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        bonus = self.kind == UNIGRAM
        usable = [(p, len(p.encode()) * top - 0.1 if kind == USER else s, k) for k, (p, s, kind) in enumerate(pieces) if p and (kind == NORMAL or kind == USER and bonus)]
        self.rank = {p: s for p, s, _ in usable}
        usable.sort(key=lambda x: (len(x[0]) > 1, -x[1], x[2]))
        if self.kind == BPE:
            usable = [x for x in usable if len(x[0]) == 1 or self.merge(x[0]) == [x[0]]]
        self.text = [p for p, _, _ in usable]
        self.ids = np.array([k for _, _, k in usable], np.int32)
        self.cost = np.array([-s for _, s, _ in usable], np.float64)
        self.unk_cost = float(self.cost.max(initial=0.0)) + 10
        self.length = np.array([len(p) for p in self.text], np.int32)
        self.longest = int(self.length.max(initial=1))
        self.by_text = {p: k for k, p in enumerate(self.text)}
        flat = np.frombuffer("".join(self.text).encode("utf-32-le"), np.uint32)
        end = np.cumsum(self.length, dtype=np.int64)
        h = span_hashes(flat, end - self.length, end)
        assert len(np.unique(h)) == len(h), "two pieces share a hash"
        # Endings of pieces: only where the last l code points are one can a piece of l or more end. Value: the piece, or INNER.
        start = np.concatenate([np.arange(e - n, e) for e, n in zip(end.tolist(), self.length.tolist())]) if len(h) else np.zeros(0, np.int64)
        inner = np.setdiff1d(span_hashes(flat, start, np.repeat(end, self.length)), h)
        self.lexicon = HashTable(np.concatenate([h, inner]), np.concatenate([np.arange(len(h)), np.full(len(inner), INNER)]), mixed=True)
        self.apart = all(re.fullmatch(f"{SPACE}*[^{SPACE}]*", p) for p in self.text)
        if self.kind == BPE:
            n = len(self.text)
            self.left, self.right = np.arange(n), np.arange(n)
            for k, p in enumerate(self.text):
                if len(p) > 1:
                    a, b = self.merge(p, last=True)
                    self.left[k], self.right[k] = self.by_text[a], self.by_text[b]
            made = self.left != np.arange(n)
            self.joined = HashTable((self.left[made].astype(np.uint64) << np.uint64(32)) | self.right[made].astype(np.uint64), np.flatnonzero(made))
        self._forget()

    def _forget(self) -> None:
        """Empty tables of what is found out on the way; a copy of the model starts with them."""
        self.pair_key, self.pair_answer = np.full(1 << PAIR_BITS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << PAIR_BITS, bool)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @property
    def size(self) -> int:
        return sum(len(p) * 4 + 64 for p in self.text) * 2 + self.lexicon.keys.nbytes * 3

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pairs", "pair_key", "pair_answer", "words", "older")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def merge(self, word: str, last: bool = False) -> list[str]:
        """Pieces of a short string by merging the best pair again and again; ``last``: the two sides of the last merge."""
        sign = list(word)
        nxt, prv = list(range(1, len(sign) + 1)), list(range(-1, len(sign) - 1))
        heap: list[tuple[float, int, str, int]] = []
        sides = ["", ""]

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(sign) and (p := sign[a] + sign[b]) in self.rank:
                heapq.heappush(heap, (-self.rank[p], a, p, b))

        for a in range(len(sign) - 1):
            offer(a, a + 1)
        while heap:
            _, a, p, b = heapq.heappop(heap)
            if not sign[a] or not sign[b] or sign[a] + sign[b] != p or nxt[a] != b:
                continue
            sides = [sign[a], sign[b]]
            sign[a], sign[b], nxt[a] = p, "", nxt[b]
            if nxt[b] < len(sign):
                prv[nxt[b]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        return sides if last else [x for x in sign if x]

    # The bigram acceptor -------------------------------------------------------------------------------------------

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether merging leaves two neighbouring pieces as they are; by merging their text."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return known

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for arrays of pairs; answers are kept in a table of fixed size, where later pairs replace earlier ones."""
        pair = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = (mix(pair) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_answer[slot]
        miss = np.flatnonzero(self.pair_key[slot] != pair)
        if len(miss):
            out[miss] = self._undone(a[miss], b[miss])
            self.pair_key[slot[miss]], self.pair_answer[slot[miss]] = pair[miss], out[miss]
        return out

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs stay apart, by undoing merges from the latest on: a pair stays apart unless, at some step, the two
        pieces at the seam have a joint piece that comes before the merge being undone."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 40)
        while len(live):
            j = self.joined.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            bad = (j != NONE) & (j < limit)
            out[live[bad]] = False
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            undo_a = ~whole_a & ((a > b) | whole_b)
            undo_b = ~whole_b & ~undo_a
            limit = np.where(undo_a, a, b + 1)
            go = ~bad & (undo_a | undo_b)
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_b, self.left[b], b)[go]
            limit, live = limit[go], live[go]
        return out

    # Shortest paths ------------------------------------------------------------------------------------------------

    def solve(self, word: str) -> bytes:
        """Ids (int32) of one string's shortest path."""
        n = len(word)
        best, back = [0.0] + [np.inf] * n, [NONE] * (n + 1)
        for i in range(1, n + 1):
            for size in range(min(i, self.longest), 0, -1):
                k = self.by_text.get(word[i - size : i], NONE)
                if k == NONE or best[i - size] == np.inf:
                    continue
                if self.kind == BPE:
                    if back[i - size] in (NONE, UNK) or self.stays_apart(back[i - size], k):
                        best[i], back[i] = 0.0, k
                        break
                elif (c := best[i - size] + float(self.cost[k])) < best[i]:
                    best[i], back[i] = c, k
            if word[i - 1] not in self.by_text and (c := best[i - 1] + self.unk_cost) < best[i]:
                best[i], back[i] = c, UNK
        out, i = [], n
        while i:
            out.append((back[i], word[i - 1]))
            i -= 1 if back[i] == UNK else int(self.length[back[i]])
        ids: list[int] = []
        for k, c in reversed(out):
            ids += self._fallback(c) if k == UNK else [int(self.ids[k])]
        return np.array(ids, "<i4").tobytes()

    def _fallback(self, sign: str) -> list[int]:
        return [int(self.byte_id[x]) for x in sign.encode("utf-8", "replace")] if self.has_bytes else [self.unk_id]

    def solve_all(self, words: list[str]) -> list[bytes]:
        """Ids of many short words, solved in step."""
        if not words:
            return []
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        size = np.array([len(words[k]) for k in order], np.int64)
        flat = np.frombuffer("".join(words[k] for k in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum(size)
        first = end - size
        # arcs[l][e]: the piece that spans the l code points up to e, over the whole block
        arcs, hashes = [], SpanHasher(flat)
        ends = np.arange(1, len(flat) + 1)
        inside = ends - np.repeat(first, size)
        for span in range(1, min(self.longest, int(size[0])) + 1):
            ends, inside = ends[inside >= span], inside[inside >= span]
            arc = np.full(len(flat) + 1, NONE, np.int32)
            got = self.lexicon.get(hashes(ends - span, ends))
            piece = (got != NONE) & (got != INNER)
            arc[ends[piece]] = got[piece]
            arcs.append(arc)
            ends, inside = ends[got != NONE], inside[got != NONE]
        back = np.full(len(flat) + 1, NONE, np.int64)  # at first[w] + i stands the arc into position i; position 0 is shared with the word before, so it is not read
        cost = np.zeros(len(flat) + 1)
        for i in range(1, int(size[0]) + 1):
            live = int(np.searchsorted(-size, -i, side="right"))
            at = first[:live] + i
            todo = np.arange(live)
            low = np.full(live, np.inf)
            for span in range(min(i, len(arcs)), 0, -1):
                k = arcs[span - 1][at[todo]]
                hit = k != NONE
                w, k = todo[hit], k[hit].astype(np.int64)
                if not len(w):
                    continue
                if self.kind == BPE:
                    ok = np.ones(len(w), bool)
                    if span < i:
                        before = back[at[w] - span]
                        known = before >= 0
                        ok[known] = self.stay_apart(before[known], k[known])
                        ok &= before != NONE
                    back[at[w[ok]]] = k[ok]
                    keep = np.ones(live, bool)
                    keep[w[ok]] = False
                    todo = todo[keep[todo]]
                else:
                    c = self.cost[k] + (cost[at[w] - span] if span < i else 0.0)
                    ok = c < low[w]
                    low[w[ok]] = c[ok]
                    back[at[w[ok]]] = k[ok]
            bare = np.flatnonzero(arcs[0][at] == NONE)
            c = self.unk_cost + (cost[at[bare] - 1] if i > 1 else 0.0)
            ok = (back[at[bare]] == NONE) if self.kind == BPE else c < low[bare]
            back[at[bare[ok]]] = UNK
            low[bare[ok]] = c[ok] if isinstance(c, np.ndarray) else c
            if self.kind != BPE:
                cost[at] = low
        pos, live, steps = end.copy(), np.arange(len(words)), []
        while len(live):
            k = back[pos[live]]
            steps.append((live, k, flat[pos[live] - 1]))
            pos[live] -= np.where(k == UNK, 1, self.length[k])
            live = live[pos[live] > first[live]]
        word = np.concatenate([s[0] for s in steps])
        arc = np.concatenate([s[1] for s in steps])
        sign = np.concatenate([s[2] for s in steps])
        turn = np.concatenate([np.full(len(s[0]), -k) for k, s in enumerate(steps)])
        o = np.lexsort((turn, word))
        word, arc, sign = word[o], arc[o], sign[o]
        ids = np.where(arc == UNK, self.unk_id, self.ids[arc]).astype("<i4")
        cut = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        raw, out = ids.tobytes(), [b""] * len(words)
        odd = set(word[arc == UNK].tolist())
        cut = cut.tolist()
        for w, k in enumerate(order):
            if w in odd:
                got: list[int] = []
                for a, i, s in zip(arc[cut[w] // 4 : cut[w + 1] // 4], ids[cut[w] // 4 : cut[w + 1] // 4], sign[cut[w] // 4 : cut[w + 1] // 4]):
                    got += self._fallback(chr(s)) if a == UNK else [int(i)]
                out[k] = np.array(got, "<i4").tobytes()
            else:
                out[k] = raw[cut[w] : cut[w + 1]]
        return out

    # Texts ---------------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.rewrite is not None:
            text = self.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def units(self, norm: str) -> list[str]:
        """Parts of a normalised text between which no piece can reach. A line break that no piece covers stands alone."""
        if self.user and self.kind == BPE:
            parts = re.split(f"({self.user_pattern})", norm)
            return [x for k, p in enumerate(parts) for x in ([p] if k % 2 else self._words(p))]
        return self._words(norm)

    def _words(self, norm: str) -> list[str]:
        if not self.apart:
            return [norm] if norm else []
        if SPACE + SPACE in norm or norm.endswith(SPACE):
            parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", norm)
        else:
            parts = norm.replace(SPACE, "\x00" + SPACE).split("\x00") if "\x00" not in norm else re.findall(f"{SPACE}?[^{SPACE}]+", norm)
        if "\n" in norm and "\n" not in self.by_text:
            parts = [x for p in parts for x in (re.split("(\n)", p) if "\n" in p else (p,))]
        return [p for p in parts if p]

    def encode_all(self, texts: list[str | None], most_words: int = 40_000) -> list[np.ndarray]:
        """Ids of each whole text."""
        split = [self.units(self.normalise(t or "")) for t in texts]
        if len(self.words) > most_words:  # two generations: words met again lately stay
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        if self.kind == BPE:
            known.update((p, np.array([k], "<i4").tobytes()) for p, k in self.user.items())
        new = {w for parts in split for w in parts if w not in known}
        known.update((w, older[w]) for w in new if w in older)
        new = {w for w in new if w not in older}
        short = [w for w in new if len(w) <= 48 and not w.startswith(SPACE + SPACE)]
        known.update(zip(short, self.solve_all(short)))
        long = {w: self.solve(w) for w in new if w not in known}
        get = (lambda w: known.get(w) or long[w]) if long else known.__getitem__
        out = [np.frombuffer(b"".join(map(get, parts)), "<i4") for parts in split]
        if self.has_bytes:
            return out
        # a run of unknown signs is one unknown piece
        return [x[np.concatenate([[True], (x[1:] != self.unk_id) | (x[:-1] != self.unk_id)])[: len(x)]] for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each id list: the bytes of all of them are gathered at once."""
        flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int64)
        n, cut = self.spell_size[flat], np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.spell_bytes[np.repeat(self.spell_start[flat] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        out, at = [], ends[cut].tolist()
        for a, b in zip(at[:-1], at[1:]):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


def load(spark, path: str):
    """The compiled model, broadcast. The file is read on the driver; its compiled size is checked."""
    with open(path, "rb") as f:
        t = Transducer.compile(f.read())
    return publish(spark, t, t.size)


def encode(text: Column, model) -> Column:
    """A struct column: ids array<int>, n_byte_ids, decoded_sha256, round_trip. ``model`` is what ``load`` returns."""

    @F.arrow_udf("struct<ids:array<int>,n_byte_ids:long,decoded_sha256:string,round_trip:boolean>")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = model.value
        for arr in it:
            ids, n_bytes, sha, same = [], [], [], []
            for part in pieces_of(arr, 128):
                texts = part.to_pylist()
                found = t.encode_all(texts)
                for x, got, back in zip(texts, found, t.decode_all(found)):
                    ids.append(got)
                    n_bytes.append(int(t.is_byte[got].sum()))
                    sha.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == (x or ""))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.StructArray.from_arrays([listed, pa.array(n_bytes, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["ids", "n_byte_ids", "decoded_sha256", "round_trip"])

    return run(text)


def decode(ids: Column, model) -> Column:
    """The text of each id list; null ids give null."""

    @F.arrow_udf("string")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = model.value
        for arr in it:
            yield pa.array([None if x is None else t.decode(np.array(x, np.int32)) for part in pieces_of(arr) for x in part.to_pylist()], pa.string())

    return run(ids)


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_ids, n_byte_ids, ids, decoded_sha256, round_trip."""
    got = docs.select(F.col(id_col), encode(F.col(text_col), load(docs.sparkSession, path)).alias("e"))
    return got.select(id_col, F.size("e.ids").cast("long").alias("n_ids"), "e.n_byte_ids", "e.ids", "e.decoded_sha256", "e.round_trip")
