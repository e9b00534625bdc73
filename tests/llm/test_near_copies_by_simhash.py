"""Near copies are sought by SimHash on a ring, and only verified on shingles."""

import numpy as np
from pyspark.sql import functions as F

from lithoframe.llm import near_copies as nc
from lithoframe.llm import simhash_pigeonring as sh
from lithoframe.llm.textarr import mix


def test_rows_come_through_fingerprints(spark):
    w = [f"w{k}" for k in range(300)]
    copy = ["x" if k in (40, 120, 200, 280) else x for k, x in enumerate(w)]  # 276 of 316 shingles shared: 0.87
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(copy)), (3, " ".join(w).upper())], "doc_id long, text string")
    assert [r.doc_id for r in nc.one_of_each(docs).collect()] == [1]
    assert sorted(r.doc_id for r in nc.one_of_each(docs, budgets=(0, 0)).collect()) == [1, 2]


def test_wide_fingerprint_against_plain():
    rng = np.random.default_rng(5)
    for n in (1, 4, 5, 255, 256, 5000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        got = sh.wide_fingerprint(h, 3)
        for k, seed in enumerate(mix(np.arange(1, 4, dtype=np.uint64))):
            x = mix(h ^ seed).tolist()
            assert int(got[k]) == sum(1 << b for b in range(64) if sum(v >> b & 1 for v in x) * 2 > n)


def test_pairs_at_0_8_are_within_the_budgets():
    rng = np.random.default_rng(6)
    for shared, own in ((4, (1, 0)), (8, (1, 1)), (80, (20, 0)), (80, (10, 10)), (400, (50, 50))):
        slack = nc.SLACK if shared + max(own) <= nc.FEW else (0, 0)
        for _ in range(200):
            h = rng.integers(0, 2**64, shared + sum(own), dtype=np.uint64)
            a, b = sh.wide_fingerprint(h[: shared + own[0]], nc.WORDS), sh.wide_fingerprint(np.concatenate([h[:shared], h[shared + own[0] :]]), nc.WORDS)
            d = np.bitwise_count(a ^ b)[None]
            assert sh.ring_ok(d[:, : nc.RING], nc.BUDGETS[0] + slack[0])[0] and d.sum() <= nc.BUDGETS[1] + slack[1]


def test_ring_pairs_against_all_pairs():
    rng = np.random.default_rng(7)
    left = rng.integers(0, 2**64, (300, 4), dtype=np.uint64)
    right = np.concatenate([left[:100] ^ (np.uint64(1) << rng.integers(0, 64, (100, 4), dtype=np.uint64)), rng.integers(0, 2**64, (400, 4), dtype=np.uint64)])
    begin, end = np.arange(300) // 7, 400 + np.arange(300) // 3
    for segments, budget in ((2, 43), (4, 3), (4, 90), (3, 60)):
        got = sorted((int(a), int(b)) for i, j in sh.ring_pairs(left, right, begin, end, segments, budget) for a, b in zip(i, j))
        d = np.bitwise_count(left[:, None, :segments] ^ right[None, :, :segments]).sum(2, dtype=int)
        want = [(a, b) for a in range(300) for b in range(begin[a], end[a]) if d[a, b] <= budget]
        assert got == want


def test_copies_dealt_do_not_grow_faster_than_classes(spark):
    def dealt(n):
        size = (F.exp(F.lit(5.4) + (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 - 0.5) * 3)).cast("int")
        classes = spark.range(n).select(F.col("id").alias("key"), size.alias("size"), F.lit(b"").alias("fp"))
        return nc._by_size(classes, None).agg(F.sum(F.col("to") - F.col("from") + 1)).first()[0]

    assert dealt(100_000) < 6 * dealt(20_000)
