"""The whole pipeline against a plain version whose near copies are those of a five-word Jaccard of 0.8 or more."""

import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline as cp
from lithoframe.llm import mil_quality
from lithoframe.llm.registry import TOKENIZER

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER) or not os.path.isdir(DIR), reason="no tokenizer files or tables")


def one_of_each(rows):
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or (x and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return [(i, t) for k, (i, t) in enumerate(rows) if least[find(k)] == i]


def without_items(rows, items):
    def sh(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    wanted = [sh(t) for t in items]
    return [(i, t) for i, t in rows if not any(s and len(s & sh(t)) >= 0.8 * len(s) for s in wanted)]


def without_secrets(t):
    spans = [m.span() for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    for s, e in sorted(spans, reverse=True):  # later ones first; of overlapping ones the outer marks remain one
        t = t[:s] + "\x00" * (e - s) + t[e:]
    return re.sub("\x00+", "[SECRET]", t)


def test_whole_pipeline(spark):
    got = {r.doc_id: list(r.ids) for r in cp.run(spark, DIR).collect()}
    docs = pq.read_table(f"{DIR}/documents.parquet").to_pylist()
    model = mil_quality.fit(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    good = [(d["doc_id"], d["text"]) for d in docs if model.score(np.frombuffer(d["text"].encode(), np.uint8)) >= 0.3]
    items = pq.read_table(f"{DIR}/benchmark.parquet").column("text").to_pylist()
    kept = without_items(one_of_each(good), items)
    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    assert got == {i: lib.encode(without_secrets(t)) for i, t in kept} and 100 < len(got) < len(good)


def test_recall_of_near_copies_at_a_tenth(spark):
    """All non-identical pairs at 0.8 that a join on rare shingles can show meet in one component, and no others."""
    from collections import defaultdict

    from lithoframe.llm import near_copies as nc

    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = [(r.doc_id, nc.shingle_hashes((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()]
    by = defaultdict(list)
    for k, (_, h) in enumerate(rows):
        for x in h.tolist():
            by[x].append(k)
    shared = defaultdict(int)
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[a], own[b]] += 1
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(rows[a][1]) + len(rows[b][1]) - n) - 1e-9]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    empty = [k for k, (_, h) in enumerate(rows) if not len(h)]
    for k in empty:
        root[find(k)] = find(empty[0])
    assert nc.one_of_each(docs).count() == len({find(k) for k in range(len(rows))}) < len(rows)


def test_near_copies_with_clashing_columns_and_repeated_ids(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, *"abcdefg"), (1, "other words of another text that stands alone", *"abcdefg"), (2, text + " more", *"hijklmn"), (None, "a text without any id at all here", *"opqrstu"), (None, "another text without id is kept too", *"opqrstu")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, _i string, _f string, _g string, _c string, _n string, _k string, _h string")
    got = cp.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(str(r.doc_id) + r.text[:5] for r in got.collect()) == sorted(["1word0", "1other", "Nonea tex", "Noneanoth"])


def test_secrets_stage_keeps_the_columns_it_gets(spark):
    docs = spark.createDataFrame([(1, "token=abcdef123456")], "doc_id long, text string")
    assert cp.secrets(spark, docs, "").columns == ["doc_id", "text"]
