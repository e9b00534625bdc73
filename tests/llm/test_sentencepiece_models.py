import itertools
import os
import random
import struct

import numpy as np
import pytest
import sentencepiece

from lithoframe.llm import sentencepiece_fst as sf

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(n, v):
    if isinstance(v, float):
        return varint(n << 3 | 5) + struct.pack("<f", v)
    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


def model(kind, pieces, normaliser=b""):
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    return out + field(2, field(3, kind)) + field(3, normaliser)


SIGNS = "▁abcdefg<>sp"
NORMAL = [(c, -20.0 - k, 1) for k, c in enumerate(SIGNS)]
PIECES = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *NORMAL, ("ab", -1.0, 1), ("cd", -2.0, 1), ("abcd", -3.0, 1), ("▁a", -4.0, 1), ("bc", -5.0, 1), ("ef", -6.0, 1), ("efg", -7.0, 1), ("▁ab", -8.0, 1)]


def texts(rng, more):
    return ["".join(rng.choices([*"abcdefg  ", "x", "é", *more], k=rng.randrange(0, 25))) for _ in range(600)]


@pytest.mark.parametrize("kind", [sf.UNIGRAM, sf.BPE])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_user_defined_pieces(kind, squeeze):
    users = ["<sep>", "<sep>s", "bcd", "é"]
    blob = model(kind, [*PIECES, *((u, 0.0, 4) for u in users)], field(3, 1) + field(4, squeeze))
    t, lib = sf.Transducer.compile(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for x in ["a<sep>b", *texts(random.Random(4), users)]:
        assert t.encode_all([x])[0].tolist() == lib.encode(x), x


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_map(rule):
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    spec = dict(sf._fields(norm.serialized_model_proto()))[3]
    blob = dict(sf._fields(spec))[2]
    rewrite, rng = sf.Rewriter(sf.charmap(blob), None), random.Random(7)
    odd = ["\u00c5", "A\u030a", "e\u0301\u0323", "ﬁ", "①", "ｶﾞ", "\u3000", "\t", "\r\n", "\u200b", "한", "ᄒ", "ᅡ", "ᆫ", "ß", "İ", "Ａ", "\ufeff", "½", "a", "B", " ", "漢", "\u0300", "\u0345", "ǆ", "𝔄", "\x00", "\x7f"]
    every = [chr(c) for c in range(32, 0x3100) if chr(c).isprintable()]
    for x in [*odd, *every[::3], *("".join(rng.choices(odd + every, k=rng.randrange(1, 12))) for _ in range(1500))]:
        assert rewrite(x) == norm.normalize(x), x.encode("unicode_escape")


def test_model_with_character_map_and_user_pieces():
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(sf._fields(norm.serialized_model_proto()))[3]
    blob = model(sf.BPE, [*PIECES, ("Ａ", 0.0, 4)], field(2, dict(sf._fields(spec))[2]) + field(3, 1) + field(4, 1))
    t, lib = sf.Transducer.compile(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for x in texts(random.Random(9), ["Ａ", "ａ", "\u3000", "\t", "ﬀ", "a\u0301"]):
        assert t.encode_all([x])[0].tolist() == lib.encode(x), x


@pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
def test_the_composed_transducer_has_one_path_so_it_is_the_shortest():
    t = sf.Transducer.compile(open(PATH, "rb").read())

    def paths(word, at=0, last=None):
        """Every path of the composed transducer over a word."""
        if at == len(word):
            yield ()
        for size in range(1, min(t.longest, len(word) - at) + 1):
            k = t.by_text.get(word[at : at + size])
            if k is not None and (last is None or t.stays_apart(last, k)):
                yield from ((k, *rest) for rest in paths(word, at + size, k))

    words = ["".join(p) for p in itertools.product(["▁", "th", "er", "ing", "s"], repeat=4)] + ["▁understanding", "▁antidisestablishment", "▁tokenisation"]
    for w in words:
        assert [[int(t.ids[k]) for k in p] for p in paths(w)] == [np.frombuffer(t.solve(w), "<i4").tolist()]
