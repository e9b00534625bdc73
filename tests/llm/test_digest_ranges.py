import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import quartile_digest as qd


def rows_of(rng, n):
    ids = [int(i) if i >= 0 else None for i in rng.choice([7, 7, 7, -1, -1, *range(100, 400)], n)]
    return [(i, f"text {k} " + "x" * int(rng.integers(0, 90))) for k, i in enumerate(ids)]


def test_one_id_and_null_ids_on_a_third_of_the_rows_are_dealt(spark):
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else 1000 + k, f"text {k}") for k in range(6000)]
    df = spark.createDataFrame(rows, "i long, t string").select("i", "t", F.xxhash64("t").alias("h"))
    sizes = [(r.b, r.n, r.d) for r in df.select("i", qd._ranges(df, 60).alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("i", F.lit(-1))).alias("d")).collect()]
    assert max(n for _, n, _ in sizes) < 300 and len(sizes) > 50
    order = df.select("i", "h", qd._ranges(df, 60).alias("b")).orderBy(F.desc_nulls_last("i"), F.desc("h")).collect()
    assert [r.b for r in order] == sorted(r.b for r in order)


@pytest.mark.parametrize("ranges", [1, 5, 40, 300])
def test_against_brute_force_with_hot_ids(spark, ranges):
    rows = rows_of(np.random.default_rng(2), 400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    want = []
    for k, r in enumerate(order):
        t, n = r.text, order[(k + 1) % len(order)].text
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        want.append((r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), qd.digest(t.encode()), qd.digest(e.encode())))
    got = [tuple(r)[:5] for r in qd.with_edits(df, ranges=ranges).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
