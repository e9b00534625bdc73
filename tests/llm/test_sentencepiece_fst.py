import itertools
import os
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoframe.llm import sentencepiece_fst as sf

PATH = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def t():
    return sf.Transducer.compile(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_library_on_documents(t, lib):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for x, got in zip(texts, t.encode_all(texts)):
        assert got.tolist() == lib.encode(x)
        assert t.decode(got) == x


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["the", "tion", " ", "  ", "\n", "é", "漢", "𓀀", "▁", "a", "b", "!", "1", "ing", "<s>", "\t", "\x00", "ß", "anti", "dis", "ment"]), max_size=25))
def test_equals_library(t, lib, parts):
    x = "".join(parts)
    got = t.encode_all([x])[0]
    assert got.tolist() == lib.encode(x)
    assert t.decode(got) == lib.decode(lib.encode(x))


def test_in_step_equals_one_by_one(t):
    words = ["".join(p) for p in itertools.product(["▁", "th", "er", "ñ", "漢", "x"], repeat=4)]
    words = [w for w in words if "▁▁" not in w]
    assert t.solve_all(words) == [t.solve(w) for w in words]


def _model(pieces, kind):
    def field(n, v):
        if isinstance(v, int):
            return bytes([n << 3, v])
        return bytes([n << 3 | 2]) + bytes([len(v)]) + v if not isinstance(v, float) else bytes([n << 3 | 5]) + struct.pack("<f", v)

    out = b""
    for p, s, k in pieces:
        out += field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k))
    return out + field(2, field(3, kind)) + field(3, field(3, 1) + field(4, 0))


def test_unigram_is_the_cheapest_path():
    rng = np.random.default_rng(2)
    pool = sorted({"".join(rng.choice(list("abc▁"), int(rng.integers(1, 4)))) for _ in range(40)} | set("abc"))
    pool = [p for p in pool if "▁" not in p[1:]]
    pieces = [("<unk>", 0, sf.UNKNOWN)] + [(p, -float(rng.integers(1, 30)) / 3, sf.NORMAL) for p in pool]
    t = sf.Transducer.compile(_model(pieces, sf.UNIGRAM))
    cost = {p: -struct.unpack("<f", struct.pack("<f", s))[0] for p, s, _ in pieces[1:]}

    def least(x):
        best = [0.0] + [np.inf] * len(x)
        for i in range(1, len(x) + 1):
            for j in range(i):
                if x[j:i] in cost:
                    best[i] = min(best[i], best[j] + cost[x[j:i]])
        return best[-1]

    names = [p for p, _, _ in pieces]
    for _ in range(200):
        x = "".join(rng.choice(list("abc "), int(rng.integers(1, 12))))
        ids = t.encode_all([x])[0].tolist()
        norm = t.normalise(x)
        if all(c in cost for c in norm):
            assert "".join(names[k] for k in ids) == norm
            assert sum(cost[names[k]] for k in ids) == pytest.approx(least(norm))
        assert t.solve(norm) == np.array(ids, "<i4").tobytes()


def test_rows_and_edges(spark):
    long = "anti " * 200_000 + "q" * 5000
    rows = [(1, None, 0), (2, "", 0), (3, "a  b\n", 0), (3, "a  b\n", 0), (4, long, 0), (5, "x▁y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sf.tokenise(df, PATH).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].ids == by[2].ids == [] and by[1].round_trip
    assert by[3].round_trip and by[4].round_trip and by[4].n_ids > 200_000 and not by[5].round_trip
    assert sf.tokenise(df.limit(0), PATH).count() == 0
    back = sf.tokenise(df, PATH).select("doc_id", sf.decode("ids", sf.load(spark, PATH)).alias("t")).collect()
    assert {r.doc_id: r.t for r in back}[4] == long
