import re

import numpy as np
import xxhash

from lithoframe.llm import simhash_pigeonring as sh
from lithoframe.llm.components import components


def slow_fp(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = re.findall("[^\x20\x09-\x0d]+", t)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute(rows):
    f = [(i, slow_fp(t)) for i, t in rows]
    comp = list(range(len(f)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(f)):
        for b in range(a):
            if (f[a][1] ^ f[b][1]).bit_count() <= 3:
                comp[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(f):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, f"{x:016x}", least.get(find(k))) for k, (i, x) in enumerate(f) if i is not None)


def test_documents_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [" ".join(rng.choice(["Ab", "cd", "éF", "gh,", "İx", "kl"], int(n))) for n in rng.integers(0, 120, 60)]
    rows = []
    for k in range(400):
        w = base[int(rng.integers(0, len(base)))].split()
        for _ in range(int(rng.integers(0, 2))):
            if w:
                w[int(rng.integers(0, len(w)))] = "zz"
        rows.append((k * 7 % 401, "\x0b".join(w) if k % 3 else "  ".join(w)))
    rows += [(900, None), (901, ""), (902, "  x"), (0, rows[0][1]), (903, "word " * 100_000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component_id string, fp string")
    for block in (1024, 3):
        got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(df, block=block).collect())
        assert got == brute(rows)
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_planted_distances_are_all_found(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = set(int(s) for s in seeds)
    for s in seeds:
        x = int(s)
        for _ in range(3):  # chains of up to three changed bits a step
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    for k in range(64):
        fps |= {1 << k, (1 << k) | 1}
    rows = np.array(sorted(fps), np.uint64)
    edges = sh.link_fingerprints(spark.createDataFrame([(int(x),) for x in rows.view(np.int64)], "fp long"), block=20)
    got = {r.node: r.root for r in components(edges).collect()}
    d = np.bitwise_count(rows[:, None] ^ rows[None]) <= 3
    label = np.arange(len(rows))
    while True:
        low = np.where(d, label[None], len(rows)).min(1)
        if (low == label).all():
            break
        label = low
    signed = rows.view(np.int64)
    want, mine = {}, {}
    for k in range(len(rows)):
        want.setdefault(label[k], set()).add(int(signed[k]))
        mine.setdefault(got.get(int(signed[k]), int(signed[k])), set()).add(int(signed[k]))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_and_stars(spark):
    path = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(301)) and all(got[k] == 1000 for k in range(1000, 1100)) and got[2001] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
