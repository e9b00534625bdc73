import re

import numpy as np
import pytest

from lithoframe.llm import containment as ct


def brute(docs, items):
    def sh(t, n):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        n = min(n, len(w)) if n is None or n == 5 else n
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()

    out = set()
    for i, it in items:
        s = sh(it, 5)
        if not s:
            continue
        width = len(next(iter(s)))
        for d, t in docs:
            w = re.findall(r"[^\W_]+", (t or "").lower())
            own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            if len(s & own) >= 0.8 * len(s) - 1e-9:
                out.add((d, i, len(s), len(s & own)))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(60)] + ["é", "ÜBER", "don't", "x%%%"]
    items = [(k, " ".join(rng.choice(vocab, int(rng.integers(1, 60))))) for k in range(60)] + [(60, None), (61, ""), (62, "?! --"), (3, "w1"), (64, "Über é")]
    docs = []
    for d in range(150):
        w = list(rng.choice(vocab, int(rng.integers(0, 300))))
        for k in rng.integers(0, 60, 2):
            part = items[k][1].split()
            for _ in range(int(rng.integers(0, 3))):  # some words changed
                part[int(rng.integers(0, len(part)))] = "changed"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = part
        docs.append((d, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "w1")], items


@pytest.mark.parametrize("bound", [1 << 26, 10])
def test_against_brute_force(spark, data, bound):
    docs, items = data
    d = spark.createDataFrame([(*x, "q", 1) for x in docs], "doc_id long, text string, item_id string, shared int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = ct.find_contained(d, i, broadcast_bytes=bound).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items))
    model = ct.load_items(i, "item_id", "text", 5, 0.8)
    flags = {r.doc_id for r in d.where(ct.holds_item("text", model)).collect()}
    assert flags == {x[0] for x in brute(docs, items)}


def test_long_document_and_repeats(spark):
    item = "one two three four five six seven eight nine ten"
    doc = "filler words go here " * 150_000 + item.upper() + " tail" * 1000
    d = spark.createDataFrame([(1, doc), (1, doc), (2, "one two three four five"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in ct.find_contained(d, i).collect())
    assert got == sorted([(1, 7, 6, 6, 1.0), (1, 8, 6, 6, 1.0)] * 2)
    assert ct.find_contained(d.limit(0), i).count() == 0 and ct.find_contained(d, i.limit(0)).count() == 0


def test_needed():
    assert [ct.needed(k, 0.8) for k in (1, 4, 5, 10, 11)] == [1, 4, 4, 8, 9]
