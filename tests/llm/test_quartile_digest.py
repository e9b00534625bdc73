import hashlib

import numpy as np

from lithoframe.llm import quartile_digest as qd


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        d = [qd.digest(x.encode()) for x in (t, e, n)]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), d[0], d[1], qd.likeness(d[0], d[1]), qd.likeness(d[0], d[2]))
    return out


def check(spark, rows, **k):
    got = qd.with_edits(spark.createDataFrame(rows, "doc_id long, text string"), **k).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(rows)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "".join(rng.choice(list("abcd éß\n"), int(rng.integers(0, 400))))) for i in rng.permutation(997)[:300]]
    check(spark, rows)
    check(spark, rows, ranges=300)
    check(spark, [(i * 10**12 if i % 2 else i, t) for i, t in rows], ranges=7)


def test_edges(spark):
    check(spark, [(5, None), (4, ""), (3, "ab"), (2, "xyz" * 400_000), (-9, "é" * 9)])
    check(spark, [(1, "alone in the table")])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert qd.with_edits(df).count() == 0
    twice = qd.with_edits(spark.createDataFrame([(1, "a b c d", "z"), (1, "a b c d", "z"), (None, "q", "z"), (None, None, "z")], "doc_id long, text string, b string")).collect()
    assert len(twice) == 4 and len({r.fingerprint for r in twice if r.doc_id == 1}) == 1


def test_likeness():
    a, b = "the quick brown fox jumps over the lazy dog " * 20, "pack my box with five dozen liquor jugs now " * 20
    d = [qd.digest(x.encode()) for x in (a, a[:-9] + "weary cat", b, "")]
    assert qd.likeness(d[0], d[0]) == 1.0 and qd.likeness(d[0], d[1]) > 0.8 > 0.4 > qd.likeness(d[0], d[2])
    assert qd.likeness(d[3], d[3]) == 1.0 and qd.likeness(d[0], d[3]) == 0.0
    assert all(len(x) == 132 for x in d)
