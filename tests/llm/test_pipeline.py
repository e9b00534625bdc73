import os
import re

import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline as cp
from lithoframe.llm import mil_quality, simhash_pigeonring
from lithoframe.llm.registry import TOKENIZER

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER) or not os.path.isdir(DIR), reason="no tokenizer files or tables")


def plain(rows, model, items):
    """The same in plain Python; the model's scores are taken as they are."""
    import numpy as np

    kept = [(i, t) for i, t in rows if model.score(np.frombuffer(t.encode(), np.uint8)) >= 0.3]
    fps = [simhash_pigeonring.fingerprint_of(t.encode()) for _, t in kept]
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(kept)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(kept):
        least[find(k)] = min(i, least.get(find(k), i))
    kept = [(i, t) for k, (i, t) in enumerate(kept) if least[find(k)] == i]

    def sh(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    wanted = [sh(t) for t in items]
    kept = [(i, t) for i, t in kept if not any(s and len(s & sh(t)) >= 0.8 * len(s) for s in wanted)]
    lib, out = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER), {}
    for i, t in kept:
        spans = [m.span() for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
        spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        merged = []
        for s, e in sorted(spans):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            t = t[:s] + "[SECRET]" + t[e:]
        out[i] = lib.encode(t)
    return out


def test_against_plain_version(spark):
    got = cp.run(spark, DIR)
    mine = {r.doc_id: list(r.ids) for r in got.collect()}
    docs = pq.read_table(f"{DIR}/documents.parquet").to_pylist()
    model = mil_quality.fit(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    items = pq.read_table(f"{DIR}/benchmark.parquet").column("text").to_pylist()
    assert mine == plain([(d["doc_id"], d["text"]) for d in docs], model, items) and 100 < len(mine) < len(docs)


def test_stages_keep_columns_and_take_edges(spark):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "y"), (3, "some clean words stand here for the reader of this page", None, None, None, "z")]
    rows += [(4, "key password=abcdef123456 and more clean words stand here", "en", "s", 1, "w")] * 3 + [(None, "a text whose id is not known at all to anyone", "en", "s", 1, "w")] * 2
    rows += [(5, "long text of words " * 100_000, "en", "s", 1, "v"), (9, rows[2][1], "en", "s", 1, "copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _extra string")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), DIR).count() == 0
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in cp.near_duplicates(spark, docs, DIR).collect())
    assert left == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    by = {r.doc_id: r for r in cp.secrets(spark, docs, DIR).collect()}
    assert by[4].text == "key [SECRET] and more clean words stand here" and by[4].n_chars == len(by[4].text) and by[1].text is None
    assert cp.token_ids(spark, docs, DIR).count() == len(rows)
