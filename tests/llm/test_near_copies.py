import numpy as np
import pytest

import corpus_pipeline as cp
from lithoframe.llm import near_copies as nc


def grams(t):
    w = (t or "").lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def plain(rows):
    """The least id of each component of the pairs at 0.8."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def texts():
    rng = np.random.default_rng(3)
    out = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        for _ in range(12):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 40))):
                w[at] = f"z{rng.integers(0, 999)}"
            out.append(" ".join(w))
    return list(enumerate(out + [None, "", "one two", "One  TWO", "one two three"]))


@pytest.mark.parametrize("block,bound", [(256, 1 << 20), (3, 0)])
def test_against_all_pairs(spark, block, bound):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in nc.one_of_each(docs, block=block, broadcast_rows=bound).collect())
    assert got == plain(rows)


def test_stage_takes_copies_at_0_8_and_leaves_others(spark):
    w = [f"w{k}" for k in range(300)]
    copy, other = list(w), list(w)
    for k in (40, 120, 200, 280):
        copy[k] = "x"  # 276 of 316 shingles shared: 0.87
    for k in range(10, 300, 30):
        other[k] = "y"  # 246 of 346: 0.71
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(copy)), (3, " ".join(other)), (None, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    left = cp.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "3", "None", "None"]
